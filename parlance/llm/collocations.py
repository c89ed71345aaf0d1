"""Phrase collocations: count tries of shards, merged by ranges of prefixes, and walked for the parts of every phrase.

Workers count all phrases of up to three words in tries, one for each shard of bounded size, and write them sorted: the
language at the root, then words in the order of their bytes. Borders of prefixes, from marks in the tries of some shards,
cut every trie into slices; the slices of one range meet in one task and are merged there. A slice has the nodes above its
lower border too, so that a walk from the root gives a phrase's left parts inside its range. Its right parts are nodes
elsewhere: links to the suffix, which Spark joins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import cut

#: Words of a phrase at most. Levels of a trie: the language, and one for each word.
DEPTH = 3
#: Words of text in a shard, and nodes in a range, about.
SHARD_WORDS, RANGE_NODES = 1_500_000, 2_000_000
#: Marks of one shard, and shards whose marks are looked at for borders. They decide how even ranges are, never a count.
MARKS, MARKED_SHARDS = 512, 64
#: Shares of a language's phrases that are ranked by themselves first.
SHARES = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


# tries


@dataclass
class Trie:
    """Sorted nodes by level: the place of each one's parent in the level above, its own label (a place in `words`, which are in
    the order of their bytes), and its count. Level 0 has the languages, with all their words counted."""

    words: pa.Array
    parents: list[np.ndarray]
    labels: list[np.ndarray]
    counts: list[np.ndarray]

    def nodes(self) -> int:
        return sum(map(len, self.labels))

    def key(self, level: int, i: int) -> tuple[bytes, ...]:
        out = []
        for k in range(level, -1, -1):
            out.append(self.words[int(self.labels[k][i])].as_py())
            i = int(self.parents[k][i])
        return tuple(out[::-1])

    def to_bytes(self) -> bytes:
        """Compressed; parents as numbers of children, labels and counts in the narrowest type."""
        parts = [pc.binary_length(self.words).to_numpy().astype(np.uint32), np.frombuffer(b"".join(self.words.to_pylist()), np.uint8)]
        for k in range(DEPTH + 1):
            parts += [np.bincount(self.parents[k], minlength=len(self.labels[k - 1])) if k else np.array([len(self.labels[0])]), self.labels[k], self.counts[k]]
        head, body = [], []
        for p in parts:
            kind = np.min_scalar_type(int(p.max())) if len(p) else np.dtype(np.uint8)
            head += [len(p), kind.itemsize]
            body.append(np.ascontiguousarray(p.astype(kind)).tobytes())
        raw = np.array(head, "<i8").tobytes() + b"".join(body)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def of_bytes(cls, packed: bytes) -> Trie:
        raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        n = 2 + 3 * (DEPTH + 1)
        head = np.frombuffer(raw, "<i8", 2 * n).tolist()
        parts, at = [], 16 * n
        for size, width in zip(head[::2], head[1::2], strict=True):
            parts.append(np.frombuffer(raw, f"<u{width}", size, at))
            at += size * width
        words = pa.Array.from_buffers(pa.binary(), len(parts[0]), [None, pa.py_buffer(np.append(0, np.cumsum(parts[0])).astype(np.int32)), pa.py_buffer(parts[1])])
        children, labels, counts = parts[2::3], parts[3::3], parts[4::3]
        parents = [np.repeat(np.arange(len(c)), c) for c in children]
        return cls(words, parents, [x.astype(np.int64) for x in labels], [x.astype(np.int64) for x in counts])

    def split(self, border: tuple[bytes, ...]) -> tuple[list[int], list[int]]:
        """For each level the place of the first node at or after a border, and how many nodes before it (0 or 1) are a prefix of it."""
        at, above = [], []
        lo, hi = 0, len(self.labels[0])  # the nodes among which the next step is sought; none once the path is left
        follow = True
        for k in range(DEPTH + 1):
            if follow and k < len(border):
                want = bisect.bisect_left(self.words, border[k], key=lambda w: w.as_py())
                i = lo + int(np.searchsorted(self.labels[k][lo:hi], want))
                hit = i < hi and want < len(self.words) and self.labels[k][i] == want and self.words[want].as_py() == border[k]
                prefix = hit and k + 1 < len(border)
                at.append(i + prefix)
                above.append(int(prefix))
                follow = prefix
            else:
                at.append(lo)
                above.append(0)
                i = lo
            if k < DEPTH:
                # below: after a prefix, among its children; else at the children of the first node that is not before the border
                lo = int(np.searchsorted(self.parents[k + 1], i))
                hi = int(np.searchsorted(self.parents[k + 1], i + 1)) if follow else lo
        return at, above

    def slice(self, lo: tuple[list[int], list[int]] | None, hi: tuple[list[int], list[int]] | None) -> Trie | None:
        """The nodes from one border to the next, and those above the first border; None if there are none."""
        begin = [a - b for a, b in zip(*lo, strict=True)] if lo else [0] * (DEPTH + 1)
        end = hi[0] if hi else [len(x) for x in self.labels]
        if all(b >= e for b, e in zip(begin, end, strict=True)):
            return None
        own = [slice(b, max(b, e)) for b, e in zip(begin, end, strict=True)]
        labels = [x[s] for x, s in zip(self.labels, own, strict=True)]
        used = np.unique(np.concatenate(labels))
        place = np.zeros(len(self.words), np.int64)
        place[used] = np.arange(len(used))
        parents = [x[s] - (begin[k - 1] if k else 0) for k, (x, s) in enumerate(zip(self.parents, own, strict=True))]
        return Trie(self.words.take(pa.array(used)), parents, [place[x] for x in labels], [x[s] for x, s in zip(self.counts, own, strict=True)])


def _grown(parent: np.ndarray, label: np.ndarray, count: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One level: parents, labels and counts of its nodes in order, and the node of each entry."""
    keys, at = np.unique(parent * np.int64(words) + label, return_inverse=True)
    total = np.bincount(at, minlength=len(keys)) if count is None else _sums(at, count, len(keys))
    return keys // words, keys % words, total, at


def _sums(at: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of counts by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, count)
    return out


def merge(tries: list[Trie]) -> Trie:
    """The trie with the nodes of all and the sums of their counts."""
    both = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[both.indices.to_numpy()]
    words, start = both.dictionary.take(pa.array(order)), np.cumsum([0] + [len(t.words) for t in tries])
    parents, labels, counts, above = [], [], [], [None] * len(tries)
    for k in range(DEPTH + 1):
        label = np.concatenate([place[start[i] + t.labels[k]] for i, t in enumerate(tries)])
        parent = np.concatenate([above[i][t.parents[k]] if k else np.zeros(len(t.labels[0]), np.int64) for i, t in enumerate(tries)])
        p, w, n, at = _grown(parent, label, np.concatenate([t.counts[k] for t in tries]), max(1, len(words)))
        parents.append(p)
        labels.append(w)
        counts.append(n)
        above = np.split(at, np.cumsum([len(t.labels[k]) for t in tries])[:-1])
    return Trie(words, parents, labels, counts)


class Builder:
    """Words of a shard: their hashes in the order of the text, with breaks after pieces, and every distinct word once.

    Words of a shard are told apart by 64-bit hashes; across shards they are compared themselves."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)
        self.hashes, self.langs, self.runs, self.texts = [], [], [], []
        self.order: list[np.ndarray] = []
        self.names: dict[bytes, int] = {}
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[bytes]) -> None:
        data = vec.LOWER[data]
        starts, ends, first = vec.spans(~_GAP[data], offsets)
        if not len(starts):
            return
        h = vec.span_hashes(data, starts, ends)
        uniq, one = np.unique(h, return_index=True)
        fresh = ~np.isin(uniq, self.known, assume_unique=True)
        a, b = starts[one[fresh]], ends[one[fresh]]
        flat = data[vec.ragged(a, b - a)]
        self.texts.append(pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.append(0, np.cumsum(b - a)).astype(np.int32)), pa.py_buffer(flat)]))
        self.order.append(uniq[fresh])
        self.known = np.union1d(self.known, uniq[fresh])
        breaks = np.append(0, np.cumsum(_BREAK[data]))
        joined = np.zeros(len(starts), bool)  # in one piece with the word before
        joined[1:] = breaks[ends[:-1]] == breaks[starts[1:]]
        joined[first[:-1][np.diff(first) > 0]] = False
        ids = np.array([self.names.setdefault(x, len(self.names)) for x in langs], np.int64)
        self.hashes.append(h)
        self.runs.append(joined)
        self.langs.append(np.repeat(ids, np.diff(first)))
        self.size += len(h)

    def build(self) -> Trie:
        names = pa.array(list(self.names), pa.binary())
        texts = pa.concat_arrays(self.texts)
        words = pc.unique(pa.concat_arrays([texts, names]))
        words = words.take(pc.sort_indices(words))
        hashes = np.concatenate(self.order)
        by_hash = np.argsort(hashes)
        rank = pc.index_in(texts, words).to_numpy().astype(np.int64)[by_hash]
        label = rank[np.searchsorted(hashes[by_hash], np.concatenate(self.hashes))]
        lang = pc.index_in(names, words).to_numpy().astype(np.int64)[np.concatenate(self.langs)]
        joined = np.concatenate(self.runs)
        n = len(words)
        p, w, c, node = _grown(np.zeros(len(lang), np.int64), lang, None, n)
        parents, labels, counts = [p], [w], [c]
        at = np.arange(len(label))  # where phrases begin that are so long
        for k in range(DEPTH):
            if k:
                going = np.flatnonzero((at + k < len(label)) & joined[np.minimum(at + k, len(label) - 1)])
                at, node = at[going], node[going]
            p, w, c, node = _grown(node, label[at + k], None, n)
            parents.append(p)
            labels.append(w)
            counts.append(c)
        return Trie(words, parents, labels, counts)


# shards and ranges


def shard_tries(docs: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """trie, nodes, spot (a hash of the shard's number) and marks (keys of its nodes at even distances), one row for each shard."""
    source = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard = Builder(), TaskContext.get().partitionId() << 20

        def out() -> pa.RecordBatch:
            trie = made.build()
            marks = []
            for k in range(1, DEPTH + 1):  # in proportion to the levels' sizes
                n = len(trie.labels[k])
                marks += [trie.key(k, i) for i in np.unique(np.linspace(0, n - 1, min(n, -(-MARKS * n // trie.nodes()))).astype(np.int64)).tolist()] if n else []
            spot = vec.mix(np.array([shard], np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([trie.to_bytes()], pa.binary()), pa.array([trie.nodes()]), pa.array(spot), pa.array([marks], pa.list_(pa.list_(pa.binary())))], ["trie", "nodes", "spot", "marks"]
            )

        for b in batches:
            langs = [x.encode() for x in b.column(1).to_pylist()]
            for lo, hi, data, offsets in vec.text_blocks(b.column(0)):
                made.add(data, offsets, langs[lo:hi])
                if made.size >= shard_words:
                    yield out()
                    made, shard = Builder(), shard + 1
        if made.size:
            yield out()
        vec.give_back()

    return source.mapInArrow(scan, "trie binary, nodes long, spot long, marks array<array<binary>>")


def borders_of(tries: DataFrame, range_nodes: int) -> list[tuple[bytes, ...]]:
    """Keys that cut all nodes into about so many ranges of range_nodes; from the marks of a bounded number of shards."""
    total = tries.agg(F.sum("nodes")).first()[0] or 0
    wanted = -(-total // range_nodes)
    if wanted < 2:
        return []
    some = tries.select("spot", "nodes", "marks").orderBy("spot").limit(max(MARKED_SHARDS, 8 * wanted // MARKS)).collect()
    marks = sorted((tuple(bytes(w) for w in m), r["nodes"] / len(r["marks"])) for r in some for m in r["marks"])
    whole, sums, out = sum(w for _, w in marks), 0.0, []
    for key, w in marks:
        if sums >= (len(out) + 1) * whole / wanted and (not out or out[-1] < key):
            out.append(key)
        sums += w
    return out


def ranged(tries: DataFrame, borders: list[tuple[bytes, ...]]) -> DataFrame:
    """part (the range) and trie: every shard's trie, cut at the borders."""
    shared = tries.sparkSession.sparkContext.broadcast(borders)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                trie = Trie.of_bytes(packed.as_py())
                cuts = [None, *(trie.split(x) for x in shared.value), None]
                for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if (own := trie.slice(lo, hi)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([own.to_bytes()], pa.binary())], ["part", "trie"])
        vec.give_back()

    return tries.select("trie").mapInArrow(scan, "part long, trie binary")


PHRASES = "lang string, size int, w1 string, w2 string, w3 string, a long, l1 long, l2 long, n long"


def merged(pieces: DataFrame, borders: list[tuple[bytes, ...]], min_count: int) -> DataFrame:
    """lang, size, w1 to w3, a (the phrase's count), l1 and l2 (of its first word, and two words) and n (all words of the language)
    for every phrase with a count of min_count or more."""
    shared = pieces.sparkSession.sparkContext.broadcast(borders)

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        trie = merge([Trie.of_bytes(x.as_py()) for x in rows["trie"]])
        border = shared.value[part - 1] if part else ()
        text = trie.words.cast(pa.string())
        tables = []
        path: list[np.ndarray] = []  # for each level's nodes: counts and labels of all nodes on the way from the root
        for k in range(DEPTH + 1):
            up = trie.parents[k]
            path = [(n[up], w[up]) for n, w in path] + [(trie.counts[k], trie.labels[k])]
            if not k:
                continue
            keep = trie.counts[k] >= min_count
            if len(keep) and len(border) > k + 1 and trie.key(k, 0) == border[: k + 1]:
                keep[0] = False  # above the lower border: its own range is an earlier one
            at = np.flatnonzero(keep)
            word = lambda j: text.take(pa.array(path[j][1][at])) if j <= k else pa.nulls(len(at), pa.string())  # noqa: B023,E731
            count = lambda j: pa.array(path[j][0][at]) if j <= k else pa.nulls(len(at), pa.int64())  # noqa: B023,E731
            tables.append(pa.table([word(0), pa.array(np.full(len(at), k, np.int32)), word(1), word(2), word(3), count(k), count(1), count(2), count(0)], ["lang", "size", "w1", "w2", "w3", "a", "l1", "l2", "n"]))
        return pa.concat_tables(tables)

    return pieces.groupBy("part").applyInArrow(walk, PHRASES)


def phrases(docs: DataFrame, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, range_nodes: int = RANGE_NODES) -> DataFrame:
    """Every phrase of one to three words with its exact count, those of its left parts, and the language's words: see merged()."""
    tries = cut(shard_tries(docs, text_col, lang_col, shard_words))
    borders = borders_of(tries, range_nodes)
    return cut(merged(ranged(tries, borders), borders, min_count))


# parts, scores, ranks


def _linked(rows: DataFrame, nodes: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """rows with nodes' columns, joined on a suffix; rows of heavy suffixes, of which there are few, do not travel."""
    few = F.broadcast(heavy)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(nodes, on))


def candidates(found: DataFrame) -> DataFrame:
    """lang, size, w1 to w3, a, l, r, n and score of every phrase of two or three words, from phrases().

    A phrase's suffix is a node too, with a suffix of its own: pairs are linked to their last word, and triples to their last
    pair, which knows both right parts. Suffixes with a thousandth of all words or more are at most a thousand of one length."""
    total = found.where("size = 1").groupBy("lang").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    heavy = F.col("a") * 1000 >= F.lit(total)
    ones = found.where("size = 1").select("lang", F.col("w1").alias("w2"), F.col("a").alias("r1"))
    pairs = _linked(found.where("size = 2").drop("w3"), ones, ["lang", "w2"], found.where("size = 1").where(heavy).select("lang", F.col("w1").alias("w2"), F.col("a").alias("r1")))
    pairs = cut(pairs.select("lang", "w1", "w2", "a", "l1", "n", "r1"))
    tail = lambda df: df.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r1").alias("r2"))
    triples = _linked(found.where("size = 3"), tail(pairs), ["lang", "w2", "w3"], tail(pairs.where(heavy)))
    # products of two counts fill 38 digits at most, for counts below 10^16
    score = lambda l, r: F.expr(f"cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))) as long)")  # noqa: E731,E741
    two = pairs.select("lang", F.lit(2).alias("size"), "w1", "w2", F.lit(None).cast("string").alias("w3"), "a", F.col("l1").alias("l"), F.col("r1").alias("r"), "n", score("l1", "r1").alias("score"))
    cuts = triples.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "size", "w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), "n", F.least("s1", "s2").alias("score"))
    return two.unionByName(three)


def standing(found: DataFrame, share: int = 50) -> DataFrame:
    """The candidates that no longer one makes up for: pairs go that lie in a triple with share % of their count or more."""
    triples, pairs = found.where("size = 3"), found.where("size = 2")
    inside = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    most = inside.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    left = pairs.join(most, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return triples.unionByName(left.drop("longer"))


def collocations(docs: DataFrame, *, min_count: int = 10, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, range_nodes: int = RANGE_NODES) -> DataFrame:
    """Each language's `top` phrases: lang, rank (from 1), phrase, a, l, r, n and score.

    Words are lower-cased (A-Z) and lie between blanks; phrases do not cross ``.,;:!?`` or ends of lines. A phrase's score is
    a * a / (l * r) in millionths, rounded down, for the cut into two parts where it is the lowest.

    Tries, slices and merged ranges are bounded by shard_words and range_nodes, and written before they are read twice. A word, a
    language or a document that a third of all rows have is one node of each shard's trie; the range in which it lies is no
    larger than others.

    Defined cases: a null text counts as empty; a null language counts as ``und``; repeated rows are counted each; very long
    texts are read whole; among equal scores the larger a, then the phrase's bytes decide; an empty table gives no rows; other
    columns are not read.
    """
    found = standing(candidates(phrases(docs, min_count, text_col, lang_col, shard_words, range_nodes)), share)
    named = found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the best of each share of a language first, so that no task sorts all of its phrases
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    best = named.withColumn("_own", F.row_number().over(shares)).where(F.col("_own") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
