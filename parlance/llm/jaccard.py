"""Similarity join on word shingles by parity sketches.

Shingles are hashed into the parts of a sketch, each part the XOR of its shingles' hashes. A shingle that only one of two
sets holds changes one part, so the number of parts that differ is a lower bound of the symmetric difference: with more
parts than that difference can be, two similar sets agree in at least one part. Texts are joined on parts inside bands of
set size, checked by the Hamming distance of one-bit parities where many meet, and verified on their whole shingle sets.

Only connected components are asked for, so each key links its members to one leader; keys under which a pair fails are
looked at again, block by block, for pairs that are in different components. No pair over the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import cut, near_ids, partitions, release
from .components import components

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_ORDER = _U(0xC2B2AE3D27D4EB4F)
#: Keys held at once by a worker before they are handed on, members of a block in a further look.
FLUSH, BLOCK = 600_000, 1024
#: Further looks; the last takes all pairs that are still open.
LOOKS = 2


def wrapped_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (A-Z lower-cased), one text after another, and their borders.

    A text of fewer words has its whole sequence as one shingle; one without words has none."""
    low = vec.LOWER[data]
    starts, ends, first = vec.word_spans(low, offsets)
    h = vec.span_hashes(low, starts, ends)
    w, ptr = vec.window_hashes(h, first, k)
    words = np.diff(first)
    sizes = np.diff(ptr)
    short = (words > 0) & (words < k)
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(sizes + short, out=out_ptr[1:])
    out = np.empty(int(out_ptr[-1]), _U)
    out[vec.ragged(out_ptr[:-1], sizes)] = w
    for m in range(1, k):
        at = np.flatnonzero(words == m)
        if len(at):
            acc = np.zeros(len(at), _U)
            for j in range(m):
                acc = acc * _ORDER + h[first[at] + j]
            out[out_ptr[at]] = vec.mix(acc ^ (_GOLD >> _U(m)))
    for a, b in zip(out_ptr[:-1].tolist(), out_ptr[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[out_ptr[:-1][np.diff(out_ptr) > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return out[fresh], kept[out_ptr]


@dataclass(frozen=True)
class Bands:
    """Bands of set size for similarity num / den. Group g joins sets of band g with each other and with those of band g + 1."""

    num: int
    den: int

    def __post_init__(self):
        upper = [1]
        while upper[-1] < 1 << 40:
            upper.append(max(upper[-1] + 1, upper[-1] * self.den // self.num))
        u = np.array(upper, np.int64)
        limit = self.most_apart(u + u * self.den // self.num)
        seeds = vec._seeded(2 * len(u), 29)
        for name, value in (("upper", u), ("limit", limit), ("parts", self.enough_parts(limit, np.append(1, u[:-1] + 1))), ("bits", 64 * np.maximum(1, (8 * limit + 63) // 64)), ("seed", seeds[: len(u)]), ("seed2", seeds[len(u) :])):
            object.__setattr__(self, name, value)

    @staticmethod
    def enough_parts(limit: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        """The fewest parts of which even a group's smallest sets fill more than can differ, three deviations aside; at most twice the limit."""
        parts = limit + 2
        while True:
            empty = parts * np.exp(-smallest / parts)
            short = (parts - empty - 3 * np.sqrt(empty) < limit + 1) & (parts < 2 * (limit + 2))
            if not short.any():
                return parts
            parts = np.where(short, parts + 1 + parts // 100, parts)

    def most_apart(self, both: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of two linked sets whose sizes add up to `both`."""
        return both * (self.den - self.num) // (self.den + self.num)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upper, n)

    def scaled(self, h: np.ndarray, seed: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A place from 0 to n - 1 for each hash."""
        return (((vec.mix(h ^ seed) >> _U(32)) * n.astype(_U)) >> _U(32)).astype(np.int64)


def identities(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    n = np.diff(ptr).astype(_U)
    return vec.mix(wrapped_sums(vec.mix(h), ptr) + n), vec.mix(wrapped_sums(vec.mix(h ^ _ORDER), ptr) ^ n)


def sketches(h: np.ndarray, ptr: np.ndarray, group: np.ndarray, bands: Bands) -> list[bytes]:
    """One-bit parities of each set for its group, packed; empty where the group is below 0."""
    n = np.diff(ptr)
    bits = np.where(group >= 0, bands.bits[np.maximum(group, 0)], 0)
    base = np.zeros(len(n) + 1, np.int64)
    np.cumsum(bits, out=base[1:])
    own = np.repeat(group, n)
    use = own >= 0
    at = bands.scaled(h[use], bands.seed2[own[use]], np.repeat(bits, n)[use]) + np.repeat(base[:-1], n)[use]
    packed = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def part_keys(h: np.ndarray, ptr: np.ndarray, group: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets for their groups, and each key's set. Only filled parts make keys.

    If a set fills more parts than can differ, some filled part agrees; a set that fills fewer also gets a key for every
    shingle of its own, as then both sets of an otherwise missed pair do."""
    n = np.diff(ptr)
    use = (group >= 0) & (bands.limit[np.maximum(group, 0)] > 0) & (n > 0)
    rows = np.flatnonzero(use)
    sizes, g = n[rows], group[rows]
    h = h[vec.ragged(ptr[:-1][rows], sizes)]
    own_g = np.repeat(g, sizes)
    parts = bands.parts[g]
    base = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(parts, out=base[1:])
    at = bands.scaled(h, bands.seed[own_g], np.repeat(parts, sizes)) + np.repeat(base[:-1], sizes)
    acc = np.zeros(int(base[-1]), _U)
    np.bitwise_xor.at(acc, at, vec.mix(h + bands.seed2[own_g]))
    filled = np.bincount(at, minlength=int(base[-1])) > 0
    owner = np.repeat(np.arange(len(rows)), parts)
    place = np.arange(int(base[-1])) - np.repeat(base[:-1], parts)
    keys = vec.mix(acc ^ vec.mix(g[owner].astype(_U) * _GOLD + place.astype(_U) * _ORDER))[filled]
    owners = owner[filled]
    weak = np.bincount(owners, minlength=len(rows)) <= bands.limit[g]
    if weak.any():
        pick = np.repeat(weak, sizes)
        keys = np.concatenate([keys, vec.mix(h[pick] ^ vec.mix(own_g[pick].astype(_U) + _ORDER))])
        owners = np.concatenate([owners, np.repeat(np.arange(len(rows)), sizes)[pick]])
    return keys, rows[owners]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def describe(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """id, th (the text's hash), n_shingles, and for texts with words: node and check (hashes of the set), band, and sketches for the band's two groups."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in vec.text_blocks(b.column(1)):
                h, ptr = shingle_sets(data, offsets, k)
                n = np.diff(ptr)
                node, check = identities(h, ptr)
                band = np.where(n > 0, bands.band(n), -1)
                own, below = sketches(h, ptr, band, bands), sketches(h, ptr, band - 1, bands)
                empty = n == 0
                columns = [pa.array(n), pa.array(node.view(np.int64), mask=empty), _signed(check), pa.array(band.astype(np.int32)), pa.array(own, pa.binary()), pa.array(below, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), *columns], ["id", "th", "n", "node", "check", "band", "own", "below"])

    docs = docs.select("id", "text", F.xxhash64("text").alias("th"))
    return docs.mapInArrow(scan, docs.select("id", "th").schema.add("n", "long").add("node", "long").add("check", "long").add("band", "integer").add("own", "binary").add("below", "binary"))


def keyed(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """part, key, node, others: for each key of a batch of sets, the smallest node that has it, at part = key; and if there are others,
    they with that node in a row of its own, at a part of its own, so that a frequent key brings one node a batch to its part."""

    def emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes = nodes.view(np.int64)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[fresh], nodes[fresh]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(first)
        more = np.diff(np.append(start, len(keys))) - 1
        some = np.flatnonzero(more)
        offsets = np.append(0, np.cumsum(more[some])).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes[~first]))
        key, node = keys[start], nodes[start]
        own = vec.mix(key[some] ^ node[some].view(_U))
        for part, k, n, o in ((key, pa.nulls(len(key), pa.int64()), node, pa.nulls(len(key), pa.list_(pa.int64()))), (own, _signed(key[some]), node[some], others)):
            out = pa.RecordBatch.from_arrays([_signed(part), k, pa.array(n), o], ["part", "key", "node", "others"])
            for lo in range(0, len(part), 100_000):
                yield out.slice(lo, 100_000)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, set()
        for b in batches:
            for _, _, data, offsets in vec.text_blocks(b.column(0)):
                h, ptr = shingle_sets(data, offsets, k)
                node, _ = identities(h, ptr)
                n = np.diff(ptr)
                new = []
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                pick = np.array(new)
                h, n, node = h[vec.ragged(ptr[:-1][pick], n[pick])], n[pick], node[pick]
                ptr = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=ptr[1:])
                band = bands.band(n)
                for group in (band, band - 1):
                    keys, owner = part_keys(h, ptr, group, bands)
                    parts.append((keys, node[owner]))
                    held += len(keys)
                if held > FLUSH:
                    yield from emit(parts)
                    parts, held, seen = [], 0, set()
                    vec.give_back()
        if held:
            yield from emit(parts)

    return docs.select("text").mapInArrow(scan, "part long, key long, node long, others array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, bands: Bands) -> DataFrame:
    """pairs (x, y) with linked: whether their whole shingle sets are similar enough."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_text", "y_text")
    num, den = bands.num, bands.den

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                s = b.slice(lo, 128)
                sets, known = [], {}
                for name in (2, 3):
                    for _, _, data, offsets in vec.text_blocks(s.column(name)):
                        at = np.flatnonzero(np.diff(offsets))
                        for i in range(len(offsets) - 1):
                            sets.append(None)
                        base = len(sets) - len(offsets) + 1
                        todo = []
                        for i in at.tolist():
                            text = data[offsets[i] : offsets[i + 1]].tobytes()
                            if text in known:
                                sets[base + i] = known[text]
                            else:
                                todo.append((base + i, text))
                        if todo:
                            joined = np.frombuffer(b"".join(t for _, t in todo), np.uint8)
                            own = np.cumsum([0] + [len(t) for _, t in todo])
                            h, ptr = shingle_sets(joined, own, k)
                            for j, (place, text) in enumerate(todo):
                                sets[place] = known[text] = h[ptr[j] : ptr[j + 1]]
                n = s.num_rows
                linked = []
                for a, c in zip(sets[:n], sets[n:], strict=True):
                    if a is None or c is None:
                        linked.append(False)
                        continue
                    small, big = (a, c) if len(a) <= len(c) else (c, a)
                    at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                    common = int((big[at] == small).sum())
                    linked.append(den * common >= num * (len(a) + len(c) - common))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])
            sets, known = [], {}
            vec.give_back()

    return both.mapInArrow(scan, "x long, y long, linked boolean")


def fetch(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of one document for each wanted node.

    Few other texts are shuffled. A document is known by its id and its text's hash, as ids may repeat."""
    need = cut(wanted.join(nodes.select("node", "rep.id", "rep.th"), "node").select("id", "th", "node"))
    near = near_ids(docs.select("id", "text"), need)
    one = near.withColumn("th", F.xxhash64("text")).dropDuplicates(["id", "th"])
    return one.join(need, ["id", "th"]).select("node", "text")


def second_look(members: DataFrame, nodes: DataFrame, failed: DataFrame, bands: Bands, forest: bool) -> DataFrame:
    """Untested pairs of members of one key (key, node, root) in different components that can still be similar: key, x, y, open.

    With `forest`, a block gives only pairs that would join what its earlier, closer pairs have not joined: fewer than its
    members. open says that it has others, which matter if one of the given pairs fails."""
    size = members.groupBy("key").agg(F.count("*").alias("c"), F.countDistinct("root").alias("r"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    size = size.where("c > 2 and r > 1").groupBy("s", "c").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = (
        members.join(size.select("key", "c"), "key").join(nodes.select("node", "n", "band", "own", "below"), "node").join(failed, "node", "left")
        .withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        .withColumn("j", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("lo", F.least("b", "j")).withColumn("hi", F.greatest("b", "j"))
    )

    def compare(t: pa.Table) -> pa.Table:
        node, root, n, band, b = (t[c].to_numpy() for c in ("node", "root", "n", "band", "b"))
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        g, size = int(band.min()), len(node)
        own, below = t["own"].to_pylist(), t["below"].to_pylist()
        sk = np.frombuffer(b"".join(own[i] if band[i] == g else below[i] for i in range(size)), np.uint64).reshape(size, -1)
        place = {x: i for i, x in enumerate(node.tolist())}
        tried = {min(i, j) * size + max(i, j) for i, f in enumerate(t["failed"].to_pylist()) for y in f or () if (j := place.get(y)) is not None}
        tried = np.array(sorted(tried), np.int64)
        left, right = (np.arange(size),) * 2 if lo == hi else (np.flatnonzero(b == lo), np.flatnonzero(b == hi))
        near, xs, ys = [], [], []
        for at in range(0, len(left), 32):
            rows = left[at : at + 32]
            far = np.bitwise_count(sk[rows][:, None, :] ^ sk[right][None, :, :]).sum(axis=2, dtype=np.int64)
            a, c = n[rows][:, None], n[right][None, :]
            fits = (far <= bands.most_apart(a + c)) & (bands.den * np.minimum(a, c) >= bands.num * np.maximum(a, c))
            i, j = np.nonzero(fits & (root[rows][:, None] != root[right][None, :]))
            near.append(far[i, j])
            xs.append(rows[i])
            ys.append(right[j])
        d, x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (near, xs, ys))
        x, y = np.minimum(x, y), np.maximum(x, y)
        code, first = np.unique(x * size + y, return_index=True)
        fresh = first[~np.isin(code, tried)]
        x, y = x[fresh], y[fresh]
        found = len(x)
        if forest and len(x):
            up = {r: r for r in root.tolist()}

            def top(r: int) -> int:
                while up[r] != r:
                    up[r] = r = up[up[r]]
                return r

            keep = []
            for e in np.argsort(d[fresh], kind="stable").tolist():
                p, q = top(int(root[x[e]])), top(int(root[y[e]]))
                if p != q:
                    up[p] = q
                    keep.append(e)
            x, y = x[keep], y[keep]
        vec.give_back()
        return pa.table({"key": np.full(len(x), t["key"][0].as_py(), np.int64), "x": np.maximum(node[x], node[y]), "y": np.minimum(node[x], node[y]), "open": np.full(len(x), found > len(x))})

    dealt = dealt.repartition(partitions(dealt.sparkSession), "key", "lo", "hi")  # much work for few bytes: not to be put together by size
    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "key long, x long, y long, open boolean")


def link(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shingle count and component: id, n_shingles, component_id (the smallest id that links reach).

    Documents link when den * |A and B| >= num * |A or B| for their sets of distinct k-word shingles.

    Defined cases: null and empty texts, and those of white space only, have no shingles and link with nothing, so
    their component is their own id; a text of fewer than k words is one shingle; very long texts are read whole; rows with
    one id are joined by their texts only; a row with a null id makes no links of its own, and has the component of the rows
    with its shingle set, if there are any, else a null one; an empty table gives an empty result; columns besides id and text are not read, whatever their names.
    """
    bands = Bands(num, den)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    all_docs = cut(describe(docs, k, bands))
    nodes = all_docs.where("node is not null and id is not null").groupBy("node").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("own").alias("own"), F.first("below").alias("below"), F.min("check").alias("c1"), F.max("check").alias("c2"))
    nodes = cut(nodes)
    if nodes.where("c1 <> c2").limit(1).count():
        raise ValueError("two shingle sets have one hash; change the seeds in vec")
    over = Window.partitionBy("part")
    met = (
        keyed(docs.where("id is not null"), k, bands).withColumn("leader", F.min("node").over(over))
        .where("node <> leader or others is not null")
        .select(F.coalesce("key", "part").alias("key"), F.explode(F.expr("if(others is null, array(struct(node as x, leader as y)), transform(others, o -> struct(o as x, node as y)))")).alias("p"))
    )
    met = cut(met.select("key", "p.x", "p.y"))
    release(docs.sparkSession)  # the keys' shuffle is the largest by far
    pairs = cut(met.select("x", "y").distinct())
    ends = lambda p: p.select(F.col("x").alias("node")).union(p.select(F.col("y").alias("node"))).distinct()
    told = cut(verify(pairs, fetch(docs, nodes, ends(pairs)), k, bands))
    release(docs.sparkSession)  # the texts' shuffles
    found = components(told.where("linked").select("x", "y"))
    root_of = lambda df, name, out: df.join(found.select(F.col("node").alias(name), F.col("root").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))
    apart = cut(root_of(root_of(told.where("not linked").select("x", "y"), "x", "rx"), "y", "ry").where("rx <> ry").select("x", "y"))
    if apart.limit(1).count():
        keys = met.join(apart, ["x", "y"], "left_semi").select("key").distinct()
        again = met.join(keys, "key", "left_semi")
        members = again.select("key", F.col("x").alias("node")).union(again.select("key", F.col("y").alias("node"))).distinct()
        members = cut(members)
        for look in range(LOOKS):
            failed = told.where("not linked").groupBy(F.col("x").alias("node")).agg(F.collect_set("y").alias("failed"))
            more = cut(second_look(root_of(members, "node", "root"), nodes, failed, bands, look + 1 < LOOKS))
            release(docs.sparkSession)  # the sketches' shuffles: a large group's go to each of its blocks
            new = more.select("x", "y").distinct()
            if not new.limit(1).count():
                break
            late = cut(verify(new, fetch(docs, nodes, ends(new)), k, bands))
            release(docs.sparkSession)
            told = told.union(late)
            links = late.where("linked").select("x", "y")
            if links.limit(1).count():
                found = components(found.select(F.col("node").alias("x"), F.col("root").alias("y")).union(links))
            keys = cut(more.where("open").join(late.where("not linked"), ["x", "y"], "left_semi").select("key").distinct())
            if not keys.limit(1).count():
                break
            members = cut(members.join(keys, "key", "left_semi"))
    release(docs.sparkSession)  # those of the components
    rooted = nodes.select("node", F.col("rep.id").alias("rep")).join(found, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("rep").alias("component")))  # cut, so that Spark can split a large root's side of the join
    label = rooted.join(smallest, "root").select("node", "component")
    return all_docs.select("id", "n", "node").join(label, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
