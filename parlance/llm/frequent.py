"""Frequent byte strings of a corpus, from summaries of bounded size.

Each partition counts all of its strings and puts those that make up at least 1 / limit of them into one summary. Summaries are
merged in a tree, FAN at a time, and cut to a bounded number of their heaviest strings on the way: no string travels as a row of
its own, and none is grouped by. Which strings are found may depend on how the corpus is split, and one that never comes
twice in a block is not found: the choice must serve for speed alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cut as once

#: Distinct strings a worker holds before it drops the rarest of what it has seen so far.
HELD = 1_500_000
#: Summaries that are merged into one.
FAN = 8

#: From bytes and texts' offsets to the bytes to read, and starts and ends of the strings in them.
Splitter = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Counter:
    """Counts of strings by hash, with one example of each that was met twice in a block or more often."""

    def __init__(self, limit: int):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.examples: dict[int, bytes] = {}
        self.limit, self.total = limit, 0

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if not len(starts):
            return
        self.total += len(starts)
        h = vec.span_hashes(data, starts, ends)
        keys, first, counts = np.unique(h, return_index=True, return_counts=True)
        for i in np.flatnonzero(counts >= max(2, len(starts) / self.limit)).tolist():
            k = int(keys[i])
            if k not in self.examples:
                a = first[i]
                self.examples[k] = data[starts[a] : ends[a]].tobytes()
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate([self.counts, counts])[order]
        fresh = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        self.keys, self.counts = both[fresh], np.add.reduceat(counts, fresh)
        if len(self.keys) > HELD:
            keep = self.counts > np.partition(self.counts, len(self.counts) - HELD // 2)[len(self.counts) - HELD // 2]
            self.keys, self.counts = self.keys[keep], self.counts[keep]

    def frequent(self) -> list[tuple[bytes, int]]:
        pick = np.flatnonzero(self.counts >= max(2, self.total / self.limit))
        return [(self.examples[k], c) for k, c in zip(self.keys[pick].tolist(), self.counts[pick].tolist(), strict=True) if k in self.examples]


def _packed(found: list[tuple[bytes, int]]) -> bytes:
    """A summary: numbers of strings, their lengths and counts, and the strings."""
    words, counts = [w for w, _ in found], np.array([c for _, c in found], "<i8")
    raw = np.array([len(w) for w in words], "<i4").tobytes() + counts.tobytes() + b"".join(words)
    return len(words).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(summary: bytes) -> list[tuple[bytes, int]]:
    n, size = int.from_bytes(summary[:8], "little"), int.from_bytes(summary[8:16], "little")
    raw = pa.decompress(summary[16:], size, codec="zstd", asbytes=True)
    ends = 12 * n + np.cumsum(np.frombuffer(raw, "<i4", n))
    starts = np.append(12 * n, ends)[:n]
    return [(raw[a:b], c) for a, b, c in zip(starts.tolist(), ends.tolist(), np.frombuffer(raw, "<i8", n, 4 * n).tolist(), strict=True)]


def _merged(summaries: Iterable[bytes], most: int) -> list[tuple[bytes, int]]:
    """The `most` heaviest strings of several summaries; of equal weights the first in order."""
    sums: dict[bytes, int] = {}
    for s in summaries:
        for w, c in _unpacked(s):
            sums[w] = sums.get(w, 0) + c
    return heapq.nsmallest(most, sums.items(), key=lambda x: (-x[1], x[0]))


def frequent(docs: DataFrame, split: Callable[[], Splitter], top: int, limit: int) -> list[tuple[bytes, int]]:
    """The `top` most frequent of the strings that split() makes of docs.text and partitions report, with at most their counts."""
    schema = "part long, summary binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = split(), Counter(limit)
        for b in batches:
            for _, _, data, offsets in vec.text_blocks(b.column(0)):
                seen.add(*cut(data, offsets))
        if rows := seen.frequent():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([_packed(rows)], pa.binary())], ["part", "summary"])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        found = _merged((s.as_py() for s in rows["summary"]), 2 * top)
        return pa.table({"part": pa.array([key[0].as_py()]), "summary": pa.array([_packed(found)], pa.binary())})

    summaries = once(docs.where("text is not null").select("text").mapInArrow(count, schema))
    while summaries.count() > FAN:
        # numbers of partitions may have gaps, so that a group may hold fewer
        summaries = once(summaries.groupBy(F.expr(f"part div {FAN}").alias("g")).applyInArrow(join, schema))
    return _merged((r["summary"] for r in summaries.collect()), top)
