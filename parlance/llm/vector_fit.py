"""Vector best-fit packing: tokens, documents and attention cost are capacities of a sequence, all kept.

What a piece takes of each capacity follows from its length, so bins are chosen for lengths and how often they occur: the
driver sees a histogram of at most max_len rows, and places whole runs of equal pieces into whole runs of equal bins. Spark
numbers the pieces of each length and looks their run up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from . import vec
from .bpe import Codec, _opened
from .common import cut

#: How a bin is chosen among those with room in every capacity: the least weighted norm of what would be left, or the largest
#: weighted dot product of what is left and what the piece takes.
NORM, DOT = "norm", "dot"
IDS = StructField("ids", ArrayType(IntegerType()))
RULES = ((NORM, (1.0, 0.0, 0.0)), (NORM, (1.0, 1.0, 1.0)), (NORM, (1.0, 0.2, 0.5)), (DOT, (1.0, 1.0, 1.0)))


@dataclass
class Capacities:
    """Of one sequence: tokens, documents' pieces, and the sum of squares of the pieces' lengths."""

    tokens: int
    pieces: int
    cost: int

    def longest(self) -> int:
        """The longest piece that fits a sequence alone."""
        if min(self.tokens, self.pieces, self.cost) < 1:
            raise ValueError("every capacity must be 1 at least")
        return min(self.tokens, math.isqrt(self.cost))


@dataclass
class Plan:
    """Runs of pieces, by length and first rank: the first bin, pieces of the run in each bin, and where the first of them begins."""

    keys: np.ndarray
    bins: np.ndarray
    per_bin: np.ndarray
    offsets: np.ndarray
    total: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each piece, by its length and its rank among pieces of that length."""
        at = np.searchsorted(self.keys, (lengths << 44) | ranks, "right") - 1
        own = ((lengths << 44) | ranks) - self.keys[at]
        return self.bins[at] + own // self.per_bin[at], self.offsets[at] + own % self.per_bin[at] * lengths


def best_fit(histogram: dict[int, int], limits: Capacities, rule: str = NORM, weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> Plan:
    """Places the pieces of a histogram of lengths, the longest first, each into the best open bin with room for it, or a new one.

    Bins of one content are one run, so that the work depends on the number of lengths and not on that of pieces."""
    whole = np.array([limits.tokens, limits.pieces, limits.cost], np.int64)
    scale, w = whole.astype(np.float64), np.array(weights)
    left, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        need, todo, rank = np.array([length, 1, length * length], np.int64), histogram[length], 0

        def put(bin_: int, bins: int, each: int, used: int) -> None:
            nonlocal rank
            runs.append(((length << 44) | rank, bin_, each, used))
            rank += bins * each

        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if not len(fits):
                break
            open_ = left[fits]
            if rule == NORM:
                best = fits[np.argmin((w * (((open_ - need) / scale) ** 2)).sum(axis=1))]
            else:
                best = fits[np.argmax((w * (open_ / scale) * (need / scale)).sum(axis=1))]
            # by the norm, the bin that took the last piece is the best for the next like it while it has room
            each = int((left[best] // need).min()) if rule == NORM else 1
            each = min(each, todo)
            bins = min(int(many[best]), todo // each)
            put(int(first[best]), bins, each, limits.tokens - int(left[best, 0]))
            todo -= bins * each
            if bins < many[best]:
                left = np.vstack([left, left[best]])
                first, many = np.append(first, first[best] + bins), np.append(many, many[best] - bins)
            left[best] -= each * need
            many[best] = bins
        for each in (int((whole // need).min()), todo % int((whole // need).min())):
            bins = todo // each if each else 0
            if bins:
                put(opened, bins, each, 0)
                left = np.vstack([left, whole - each * need])
                first, many = np.append(first, opened), np.append(many, bins)
                opened, todo = opened + bins, todo - bins * each
        live = left[:, 0] > 0
        left, first, many = left[live], first[live], many[live]
    runs.sort()
    keys, bins, each, used = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
    return Plan(keys, bins, each, used, opened)


def plan(histogram: dict[int, int], limits: Capacities) -> Plan:
    """The plan with the fewest bins of those that the rules make."""
    return min((best_fit(histogram, limits, *r) for r in RULES), key=lambda p: p.total)


def pieces_of(docs: DataFrame, codec: Codec, longest: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, with keep_ids) of every document's pieces; _task and _rank number those of one length.

    A document's ids are followed by end_id. Where there are more than `longest`, all pieces but the first are of that length."""
    shared, name = codec.shared, codec.name
    source = docs.select(id_col, text_col)
    schema = source.select(id_col).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("_task", "integer").add("_rank", "long")
    if keep_ids:
        schema = schema.add(IDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon, seen, task = shared.value, _opened(name), np.zeros(longest + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for lo, hi, data, offsets in vec.text_blocks(b.column(1), 2 * vec.BLOCK):
                ids, first = bpe.encode(data, offsets, lexicon)
                n = np.diff(first) + 1
                ptr = np.append(0, np.cumsum(n))
                out = np.full(int(ptr[-1]), end_id, "<u4")
                out[vec.ragged(ptr[:-1], n - 1)] = ids
                count = -(-n // longest)
                doc, piece = np.repeat(np.arange(len(n)), count), vec.ragged(np.zeros(len(n), np.int64), count)
                head = (n - longest * (count - 1))[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * longest)
                length = np.where(piece == 0, head, longest)
                at, raw = ptr[doc] + start, memoryview(out.view(np.uint8))
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run = np.flatnonzero(np.append(True, np.diff(length[order]) != 0))
                own = np.empty(len(order), np.int64)
                own[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
                rank = seen[length] + own
                seen += np.bincount(length, minlength=longest + 1)
                columns = [b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1]).astype(np.int32)), pa.array(out.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(scan, schema)


def pack(docs: DataFrame, codec: Codec, *, max_len: int = 1024, max_pieces: int | None = None, max_cost: int | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document as pieces in sequences: id, piece, start, length, ids_crc32, sequence_id and offset (and ids, with keep_ids).

    A sequence holds at most max_len tokens, max_pieces pieces and a sum of squared lengths of max_cost; what is not given
    does not bind beyond max_len. Pieces are numbered within the task that made them, in a checkpointed table, and tasks' counts
    for each length are summed by a window over tasks; a length, or a document, that a third of all rows have is
    numbered by many tasks.

    Defined cases: a null or empty text has the end token alone; a text of more tokens than a sequence may hold is cut into
    pieces of the longest length that fits, the first of them the shorter one, and none of its tokens is lost; special strings
    in a text become their special ids, as the library does; repeated rows and ids, and null ids, are packed each; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    limits = Capacities(max_len, max_len if max_pieces is None else max_pieces, max_len**2 if max_cost is None else max_cost)
    pieces = cut(pieces_of(docs, codec, limits.longest(), end_id, id_col, text_col, keep_ids))
    counts = cut(pieces.groupBy("_task", "length").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram, limits))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_task")) - F.col("_n")).drop("_n")
    numbered = pieces.join(before, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kept = [id_col, "piece", "start", "length", "ids_crc32"]
    last = ["ids"] if keep_ids else []
    source = numbered.select(*kept, *last, "_rank")
    schema = source.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    if keep_ids:
        schema = schema.add(IDS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins, offsets = shared.value.place(b.column(3).to_numpy(), b.column(b.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offsets), *b.columns[5:-1]], schema.names)

    return source.mapInArrow(place, schema)


def sequences(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids (of the whole sequence, in order) and pieces (id, start and length of each), from pack(keep_ids=True)."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id"), "start", "length")))
    return placed.groupBy("sequence_id").agg(held.alias("_h")).select(
        "sequence_id", F.flatten("_h.ids").alias("ids"), F.transform("_h", lambda h: F.struct(h["id"].alias("id"), h["start"].alias("start"), h["length"].alias("length"))).alias("pieces")
    )
