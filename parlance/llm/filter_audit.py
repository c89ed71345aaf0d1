"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Workers scan Arrow's text buffers with byte classes and prefix sums, count distinct words by sorted hashes whose words are
compared, and reduce each document to a mask of the filters that it fails. Spark counts masks; orders are sums over masks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cut

FILTERS = "ABCDE"
SHORT, REPETITIVE, CAPITALS, SYMBOLS, COPY = (1 << i for i in range(5))

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return vec.group_sums(flags, offsets)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each text: runs of equal hashes in sorted order, after every word was compared with its neighbour's bytes.

    A text in which two words share a hash is counted by its words themselves."""
    n = len(first) - 1
    if not len(starts):
        return np.zeros(n, np.int64)
    h = vec.span_hashes(data, starts, ends) if hashes is None else hashes
    text = np.repeat(np.arange(n), np.diff(first))
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (text.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[same], order[same + 1]
    size = ends[a] - starts[a]
    wrong = size != ends[b] - starts[b]
    ok = np.flatnonzero(~wrong)
    differs = data[vec.ragged(starts[a[ok]], size[ok])] != data[vec.ragged(starts[b[ok]], size[ok])]
    if differs.any():
        wrong[ok] |= vec.group_sums(differs, np.append(0, np.cumsum(size[ok]))) > 0
    out = np.diff(first) - np.bincount(text[a], minlength=n)
    for t in np.unique(text[a[wrong]]).tolist():
        out[t] = len({data[s:e].tobytes() for s, e in zip(starts[first[t] : first[t + 1]].tolist(), ends[first[t] : first[t + 1]].tolist(), strict=True)})
    return out


def masks(data: np.ndarray, offsets: np.ndarray, min_words: int = 200, distinct_pct: int = 50, capital_pct: int = 3) -> np.ndarray:
    """For each text, which of the four filters on the text alone it fails."""
    starts, ends, first = vec.word_spans(data, offsets)
    words = np.diff(first)
    points = _sums((data & 0xC0) != 0x80, offsets)
    fails = (words < min_words) * SHORT
    fails |= (100 * distinct_words(data, starts, ends, first) < distinct_pct * words) * REPETITIVE
    fails |= (100 * _sums(_CAPITAL[data], offsets) > capital_pct * points) * CAPITALS
    return fails | (_sums(_SYMBOL[data], offsets) > 0) * SYMBOLS


def scan_masks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _mask (int) and _digest (of the text's bytes) in the place of the text."""
    kept = [c for c in docs.columns if c != text_col]
    source = docs.select(*kept, text_col)
    schema = source.select(*kept).schema.add("_mask", "integer").add("_digest", "binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in vec.text_blocks(b.column(len(kept))):
                raw, at = memoryview(np.ascontiguousarray(data)), offsets.tolist()
                digests = [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(at[:-1], at[1:], strict=True)]
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(masks(data, offsets).astype(np.int32)), pa.array(digests, pa.binary())], schema.names)

    return source.mapInArrow(scan, schema)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (which of the five filters fail), n, good and toxic (how many of the n are labelled so).

    A row fails the last filter if a row with a smaller id has its text. Rows of one text and id are summed before any join,
    so that copies, null ids and repeated rows, however many, do not meet in one task."""
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = cut(scan_masks(named).groupBy("id", "part", "_mask", "_digest").agg(F.count("*").alias("n")))
    least = rows.where("id is not null").groupBy("_digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.where("id is not null").join(least, ["_digest", "id"], "left").join(told, "id", "left")
    mask = F.col("_mask").bitwiseOR(F.when(F.col("first").isNull(), F.lit(COPY)).otherwise(F.lit(0)))
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0).cast("long"))).alias(flag)
    nameless = rows.where("id is null").select("part", F.col("_mask").alias("mask"), "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.select("part", mask.alias("mask"), "n", "good", "toxic").unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from counts of masks (part, mask, n, good, toxic).

    What a step does depends on its filter and on the set of the earlier ones alone: 80 pairs, which the 600 steps of all
    orders then look up."""
    spark = counts.sparkSession
    pairs = [(1 << f, before) for f in range(5) for before in range(32) if not before >> f & 1]
    steps = []
    for p in itertools.permutations(range(5)):
        for s in range(5):
            steps.append(("".join(FILTERS[i] for i in p), s + 1, 1 << p[s], sum(1 << i for i in p[:s])))
    own, before, mask = F.col("own"), F.col("before"), F.col("mask")
    fails, earlier = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda cond, what="n": F.sum(F.when(cond, F.col(what)).otherwise(F.lit(0).cast("long")))
    every = F.array(*[F.struct(F.lit(f).alias("own"), F.lit(b).alias("before")) for f, b in pairs])
    sums = counts.withColumn("pair", F.explode(every)).select("*", "pair.own", "pair.before").groupBy("part", "own", "before").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(mask == own).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in 120 / k of the orders
        F.sum(F.when(fails, F.expr("n * 120 div bit_count(mask)")).otherwise(F.lit(0).cast("long"))).alias("shapley"),
    )
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, own int, before int"))
    return sums.join(table, ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What the five filters remove from each part, in all 120 orders: the columns of orders().

    A fails under 200 words, B where fewer than half of the words are distinct, C where more than 3 % of the code points are
    capitals, D with any of ``#$%&*|``, E where a row with a smaller id has the same text.

    Defined cases: a null text counts as empty; a null part is the part ''; a null id is smaller than none and larger than
    none, so its row never fails E and makes no other row fail; repeated rows are counted each, and an id's own repetitions
    are no copies of it; labels of one id are joined into one (good or toxic if any of them says so); very long texts are
    read whole; an empty table gives no rows; other columns are not read. Texts are compared by digests of 128 bits.
    """
    return orders(mask_counts(docs, labels, id_col, text_col, part_col))
