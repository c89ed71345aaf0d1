"""Interpolated Kneser-Ney models of characters, one for each class, in sorted hash arrays.

For every order there is one sorted array of the hashes of the n-grams that any class has seen, with each class's whole
interpolated log-probability beside it, and one of contexts with each class's back-off weight. A text's score is the sum
over its characters of the longest n-gram found, plus the weights of the contexts that were passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

_U = np.uint64
_STEPS = [_U(pow(0x9FB21C651E98DF25, k, 1 << 64)) for k in range(16)]
SALTS = [_U(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(16)]
SPACE = 32


@dataclass
class Sequences:
    """Symbols of a block of texts, each text after order - 1 spaces; first has each text's first place."""

    symbols: np.ndarray
    first: np.ndarray
    order: int

    def lengths(self) -> np.ndarray:
        return np.diff(self.first) - (self.order - 1)


def sequences(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, order: int) -> Sequences:
    """Maps code points by table (0: dropped), squeezes runs of spaces, and ends each text that has a symbol with a space."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    first = lead[offsets]
    mapped = table[points]
    space = mapped == SPACE
    keep = mapped != 0
    keep[1:] &= ~(space[1:] & space[:-1])
    begin = first[:-1][np.diff(first) > 0]
    keep[begin] = (mapped[begin] != 0) & ~space[begin]
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    kept, ptr = mapped[keep], place[first]
    sizes = np.diff(ptr)
    out_first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.where(sizes > 0, sizes + order, order - 1), out=out_first[1:])
    symbols = np.full(int(out_first[-1]), SPACE, np.uint32)
    symbols[vec.ragged(out_first[:-1] + order - 1, sizes)] = kept
    return Sequences(symbols, out_first, order)


def rolling(s: np.ndarray, order: int) -> list[np.ndarray]:
    """For k from 1 to order, a polynomial over the k last symbols at every place (places before have none)."""
    out, acc = [], np.zeros(len(s), _U)
    wide = s.astype(_U)
    for k in range(1, order + 1):
        acc = acc.copy()
        acc[k - 1 :] += wide[: len(s) - k + 1] * _STEPS[k - 1]
        out.append(acc)
    return out


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of symbols; those of a text's places are the same."""
    n, k = grams.shape
    acc = np.zeros(n, _U)
    for j in range(k):
        acc += grams[:, k - 1 - j].astype(_U) * _STEPS[j]
    return vec.mix(acc + SALTS[k])


class CharModel:
    """Models of all classes over the union of their n-grams."""

    def __init__(self, classes: list[str], order: int, table: np.ndarray):
        self.classes, self.order, self.table = classes, order, table
        self.grams: list[tuple[vec.HashIndex, np.ndarray]] = []
        self.contexts: list[tuple[vec.HashIndex, np.ndarray] | None] = []
        self.unknown = np.zeros(len(classes), np.float32)

    def scores(self, s: Sequences) -> np.ndarray:
        """Sums of log10 probabilities: one row for each class, one column for each text."""
        n = self.order
        out = np.zeros((len(self.classes), len(s.first) - 1))
        count = s.lengths()
        if not count.sum():
            return out
        at = vec.ragged(s.first[:-1] + n - 1, count)
        sums = rolling(s.symbols, n)
        ptr = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=ptr[1:])
        todo = np.arange(len(at))
        value = np.zeros((len(self.classes), len(at)), np.float32)
        for k in range(n, 0, -1):
            index, logs = self.grams[k - 1]
            key = vec.mix(sums[k - 1][at[todo]] + SALTS[k])
            found = index.find(key)
            hit = found >= 0
            for c in range(len(out)):
                value[c, todo[hit]] += logs[c, found[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k > 1:
                index, weights = self.contexts[k - 1]
                found = index.find(vec.mix(sums[k - 2][at[todo] - 1] + SALTS[k - 1]))
                hit = found >= 0
                for c in range(len(out)):
                    value[c, todo[hit]] += weights[c, found[hit]]
            else:
                value[:, todo] += self.unknown[:, None]
        for c in range(len(out)):
            out[c] = vec.group_sums(value[c].astype(np.float64), ptr)
        return out


def _discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and from 3 up, from the counts of counts."""
    n = [max(1, int((counts == k).sum())) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    if not modified:
        return np.array([0, y, y, y])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return np.array([0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def build(tables: dict[str, tuple[np.ndarray, np.ndarray]], order: int, symbol_table: np.ndarray, modified: bool) -> CharModel:
    """tables has each class's distinct n-grams of the highest order (rows of symbols) and their counts."""
    classes = sorted(tables)
    model = CharModel(classes, order, symbol_table)
    model.grams, model.contexts = [None] * order, [None] * order
    levels = [dict() for _ in range(order + 1)]
    for c in classes:
        grams, counts = tables[c]
        for k in range(order, 0, -1):
            levels[k][c] = (grams, counts)
            if k > 1:  # counts of lower orders are numbers of distinct symbols to the left
                grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
    lower_keys = lower = None
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([levels[k][c][0] for c in classes]), axis=0)
        keys = gram_keys(union)
        sort = np.argsort(keys)
        keys, union = keys[sort], union[sort]
        context_keys = gram_keys(union[:, :-1]) if k > 1 else np.zeros(len(union), _U)
        contexts, context_at = np.unique(context_keys, return_inverse=True)
        logs = np.zeros((len(classes), len(keys)), np.float32)
        weights = np.zeros((len(classes), len(contexts)), np.float32)
        below = np.full((len(classes), len(keys)), 1.0 / (len(keys) + 1)) if k == 1 else 10.0 ** lower[:, np.searchsorted(lower_keys, gram_keys(union[:, 1:]))].astype(np.float64)
        for i, c in enumerate(classes):
            grams, got = levels[k][c]
            count = np.zeros(len(keys), np.int64)
            count[np.searchsorted(keys, gram_keys(grams))] = got
            off = _discounts(got, modified)[np.minimum(count, 3)]
            off = np.minimum(off, count)
            total = np.bincount(context_at, count, len(contexts))
            spare = np.bincount(context_at, off, len(contexts))
            seen = total > 0
            weight = np.where(seen, spare / np.where(seen, total, 1), 1.0)
            p = (count - off) / np.where(seen, total, 1)[context_at] + weight[context_at] * below[i]
            logs[i], weights[i] = np.log10(p), np.log10(np.maximum(weight, 1e-12))
            if k == 1:
                model.unknown[i] = np.log10(max(weight[0], 1e-12) / (len(keys) + 1))
        model.grams[k - 1] = vec.HashIndex(keys), logs
        if k > 1:
            model.contexts[k - 1] = vec.HashIndex(contexts), weights
        lower_keys, lower = keys, logs
    return model


def count_grams(docs: DataFrame, class_col: str, make_table: Callable[[], np.ndarray], order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of the n-grams of each class in docs (class_col, text), which holds a bounded sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = make_table()
        for b in batches:
            label = np.array(b.column(0).to_pylist(), dtype=object)
            for lo, hi, data, offsets in vec.text_blocks(b.column(1)):
                s = sequences(data, offsets, table, order)
                own = label[lo:hi]
                for c in sorted(set(own)):
                    pick = np.flatnonzero(own == c)
                    at = vec.ragged(s.first[pick] + order - 1, s.lengths()[pick])
                    if len(at):
                        rows = np.ascontiguousarray(s.symbols[at[:, None] + np.arange(1 - order, 1)]).view(f"V{4 * order}").ravel()
                        grams, n = np.unique(rows, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([c] * len(n)), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n)], ["c", "gram", "n"])

    got = docs.select(class_col, "text").mapInArrow(count, "c string, gram binary, n long").groupBy("c", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    labels = np.array(got["c"].to_pylist(), dtype=object)
    grams = np.frombuffer(b"".join(got["gram"].to_pylist()), np.uint32).reshape(-1, order)
    n = got["n"].to_numpy()
    for c in sorted(set(labels)):
        rows, at = np.unique(grams[labels == c], axis=0, return_index=True)
        out[c] = rows, n[labels == c][at]
    return out


def stratified(docs: DataFrame, by: str, per_class: int, id_col: str = "doc_id", most: float = 1.0) -> DataFrame:
    """About per_class rows of each value of `by`, by the hash of the id, but no larger share of them than `most`.

    Only the values' counts come to the driver; values are languages, so they are few."""
    counts = {r[0]: r[1] for r in docs.groupBy(by).agg(F.count("*")).collect()}
    if not counts:
        return docs
    share = F.coalesce(*[F.when(F.col(by).eqNullSafe(F.lit(v)), F.lit(min(most, per_class / n))) for v, n in counts.items()], F.lit(0.0))
    return docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30))
