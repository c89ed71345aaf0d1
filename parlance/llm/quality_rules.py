"""Quality rules: base counts of a text, and a hashed n-gram logistic regression with calibrated probabilities.

The regression is fitted on a bounded sample of labelled rows and scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .calibration import platt, probability

_U = np.uint64
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Lengths of word n-grams and of character n-grams (code points); each length has 2 ** BITS places of its own.
WORD_N, CHAR_N = (1, 2, 3), (4,)
BITS = 18
KINDS = len(WORD_N) + len(CHAR_N)
PLACES = KINDS << BITS
WINDOW = 8

OUT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


@dataclass
class Block:
    """A block of texts with its words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def read_block(data: np.ndarray, offsets: np.ndarray) -> Block:
    s, e, first = vec.word_spans(data, offsets)
    return Block(data, offsets, s, e, first, vec.span_hashes(data, s, e))


def repeat_words(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window found twice or more in it."""
    w, ptr = vec.window_hashes(h, first, window)
    out = np.zeros(len(first) - 1, np.int64)
    if not len(w):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(ptr))
    own = vec.mix(w ^ (doc.astype(_U) * _U(0x9E3779B97F4A7C15)))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == own)
    place = first[:-1][doc[hit]] + (hit - ptr[:-1][doc[hit]])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + window, -1)
    return vec.group_sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), first)


def duplicate_lines(b: Block) -> np.ndarray:
    """For each text, its lines that hold a word and equal an earlier line."""
    n = len(b.offsets) - 1
    out = np.zeros(n, np.int64)
    if not len(b.data):
        return out
    breaks = np.flatnonzero(b.data == 10)
    edges = np.union1d(b.offsets, breaks + 1)
    edges = edges[edges <= len(b.data)]
    starts, ends = edges[:-1], edges[1:].copy()
    ends -= b.data[ends - 1] == 10
    words = np.searchsorted(b.starts, edges)
    keep = np.diff(words) > 0
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(b.offsets, starts, "right") - 1
    own = vec.mix(vec.span_hashes(b.data, starts, ends) ^ (doc.astype(_U) * _U(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    again = own[order][1:] == own[order][:-1]
    np.add.at(out, doc[order[1:][again]], 1)
    return out


def base_counts(b: Block) -> dict[str, np.ndarray]:
    per_text = lambda mask: vec.group_sums(mask.astype(np.int64), b.offsets)
    n_words = np.diff(b.first).astype(np.int64)
    repeat = repeat_words(b.hashes, b.first)
    return {
        "n_words": n_words,
        "word_chars": per_text(~vec.WHITE[b.data] & ((b.data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[b.data]),
        "n_dup_lines": duplicate_lines(b),
        "n_repeat_words": repeat,
        "base_failed": (n_words < 20) | (100 * repeat > 30 * n_words),
    }


def buckets(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, the places of all of the block's, and each text's first."""
    for k, n in enumerate(WORD_N):
        h, ptr = vec.window_hashes(b.hashes, b.first, n)
        yield (h >> _U(64 - BITS)).astype(np.int64) + (k << BITS), ptr
    points = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(_U)
    lead = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=lead[1:])
    for k, n in enumerate(CHAR_N, len(WORD_N)):
        h, ptr = vec.window_hashes(points, lead[b.offsets], n)
        yield (h >> _U(64 - BITS)).astype(np.int64) + (k << BITS), ptr


def features(b: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its feature places and values: each n-gram's share among those of its kind in the text."""
    sides = []
    for place, ptr in buckets(b):
        n = np.diff(ptr)
        doc = np.repeat(np.arange(len(n)), n)
        key, count = np.unique(doc * PLACES + place, return_counts=True)
        at = key // PLACES
        sides.append((np.searchsorted(at, np.arange(len(n) + 1)), key % PLACES, count / n[at]))
    return [tuple(np.concatenate([s[k][s[0][i] : s[0][i + 1]] for s in sides]) for k in (1, 2)) for i in range(len(b.offsets) - 1)]


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in batches:
        rows = []
        for _, _, data, offsets in vec.text_blocks(r.column(1)):
            rows += [(at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()) for at, value in features(read_block(data, offsets))]
        yield pa.RecordBatch.from_arrays([r.column(0), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["label", "at", "value"])


@dataclass
class Model:
    """Weights of all kinds of n-grams, their intercept, and the line that turns a margin into a probability."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, b: Block) -> np.ndarray:
        out = np.full(len(b.offsets) - 1, self.intercept)
        for place, ptr in buckets(b):
            out += vec.group_sums(self.weights[place].astype(np.float64), ptr) / np.maximum(np.diff(ptr), 1)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return probability(margin, self.slope, self.shift)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 60, decay: float = 1e-6) -> Model:
    """Logistic regression by full-batch Adam on two thirds of the rows, and Platt's line on the rest. Classes weigh the same."""
    if len({y for y, _, _ in rows}) < 2:
        return Model(np.zeros(PLACES, np.float32), 4.0 if not rows or rows[0][0] else -4.0)
    sides = [[r for i, r in enumerate(rows) if (i % 3 == 2) == held] for held in (False, True)]
    packed = []
    for side in sides:
        at, value = (np.concatenate([r[k] for r in side] or [np.zeros(0)]) for k in (1, 2))
        ptr = np.cumsum([0] + [len(r[1]) for r in side])
        packed.append((at.astype(np.int32), value.astype(np.float32), ptr, np.array([r[0] for r in side], float)))
    (at, value, ptr, y), (held_at, held_value, held_ptr, held_y) = packed
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ptr))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    used = np.unique(at)
    local = np.searchsorted(used, at).astype(np.int32)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = vec.group_sums(w[local] * value, ptr) + b
        g = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        grad, gb = np.bincount(local, value * g[row], len(used)) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.2 * step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(PLACES, np.float32)
    weights[used] = w
    model = Model(weights, float(b))
    if len(held_y):
        margin = vec.group_sums(weights[held_at] * held_value, held_ptr) + b
        model.slope, model.shift = platt(margin, held_y > 0)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, label_col: str = "quality") -> Model:
    """Fits on at most `sample` labelled ids, those with the smallest hash; whole texts are read."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).select(F.col("doc_id").alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    chosen = chosen.groupBy("_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "_id long, label int")
    # of rows that share an id, the one with the least text is learned from, so that repeats add no rows to the sample
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    got = rows.select("label", "text").mapInArrow(_feature_batches, "label int, at binary, value binary").toArrow()
    keyed = sorted(zip(*(got[c].to_pylist() for c in ("at", "label", "value")), strict=True))
    del got
    return fit([(y, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, y, v in keyed])


def judge(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Base counts and verdict for every row of docs (doc_id, text).

    kept is false where the base rules fail (fewer than 20 words, or over 30 % of the words in repeated 8-word
    windows) or where the calibrated probability of good quality is under the fixed threshold.

    Defined cases: a null or empty text has no words and fails; a null id stays null; repeated rows are judged each;
    an empty table gives an empty result; without labelled rows, or with one class of them, the regression gives every
    text the verdict of that class (kept, if there are none); other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for r in batches:
            parts = []
            for _, _, data, offsets in vec.text_blocks(r.column(1)):
                b = read_block(data, offsets)
                parts.append(base_counts(b) | {"p_good": model.probability(model.margins(b))})
            if parts:
                cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                cols["kept"] = ~cols["base_failed"] & (cols["p_good"] >= threshold)
                yield pa.RecordBatch.from_arrays([r.column(0), *map(pa.array, cols.values())], ["doc_id", *cols])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, OUT_SCHEMA)
