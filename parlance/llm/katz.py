"""Language-model scores by Katz back-off: Good-Turing discounted counts with exactly normalised back-off weights.

Tokens are words and one end per text. The unigram model covers every word of the training texts and one class for all
others; the bigram model covers every pair of neighbours in them, the start of a text included. Every conditional
distribution sums to one.

All occurrences of training and scored texts are dealt once, in packed arrays, into a table in the shared folder, of which
each partition is counted, then discounted, then scored. Words are either common, with an id and figures that the driver
knows, or rare, known by hash to the part that the hash names; which are which never changes a result. Pairs of common
words are dealt by the hash of the pair, a rare word after a common one by the word, a common word after a rare one by
the history. A few hot pairs, of which any could fill a part, are summed for each document where they are read and
dealt with it. A pair of rare words goes first to the part of its word, which knows that word's count, and from there to
the part of its history, which knows the back-off weight. Only counts of counts and one row per common word come to the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cut, partitions, release
from .frequent import frequent

_U = np.uint64
#: Ids beside those of common words: the end of a text, its start (a history only), and a rare word.
END, START, OUTSIDE, RESERVED = 0, 1, 2, 3
#: Counts up to K are discounted.
K = 5
#: Kinds of dealt rows: a rare word after any history, two common ones, a common word after a rare one, two rare ones; the
#: scored rows' own ids and folds, by number; and hot pairs of common words, with how often each document has them.
WORD, BOTH, AFTER, RARE, ROWS, HOT = 0, 1, 2, 3, 4, 5
#: Hot pairs make up at least 1 / MOST_HOT of a partition's tokens; there are no more than so many.
MOST_HOT = 1000
#: Keys of counts that are no common word's: those of hot pairs lie below this.
HOT_KEYS = -1000
#: Types of the columns a, b, c of each kind: history's id, word's hash, history's hash (0 if common); history's and word's id;
#: word's id, history's hash; word's count, history's hash, word's hash; hot pair's place, occurrences.
TYPES = {WORD: (np.int32, _U, _U), BOTH: (np.int32, np.int32), AFTER: (np.int32, _U), RARE: (np.int64, _U, _U), HOT: (np.int32, np.uint32)}
#: Common words make up at least 1 / REPORT of a partition's tokens.
REPORT = 200_000
#: Occurrences that a worker packs at once.
PACKED = 1_000_000
#: Row numbers alike but for so many last bits make a range.
RANGE = 10


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = vec.LOWER[data]
    starts, ends, _ = vec.word_spans(low, offsets)
    return low, starts, ends


def good_turing(counts_of_counts: np.ndarray) -> np.ndarray:
    """Katz's discount factors of counts 0 .. K (0 is unused), from the numbers of things with count 1 .. K + 1.

    Factors outside (0, 1] mean too little data for the estimate; there an absolute discount takes their place."""
    n = np.append(0.0, counts_of_counts)
    out = np.ones(K + 1)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    fallback = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    fallback = min(max(fallback, 0.1), 0.9)
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else -1.0
        out[r] = d if 0 < d <= 1 else (r - fallback) / r
    return out


@dataclass
class Numbers:
    """What the driver knows of the training texts: totals, discounts, and the common words' own figures."""

    tokens: int
    distinct: int
    base: int
    unigram: np.ndarray
    bigram: np.ndarray
    unseen: float
    word_count: np.ndarray
    log_word: np.ndarray
    log_alpha: np.ndarray
    pair_base: np.ndarray
    hot: np.ndarray
    hot_count: np.ndarray

    def log_unigram(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of a word with this count; 0 is the class of unseen words."""
        d = self.unigram[np.minimum(count, K)] * (count <= K) + (count > K)
        return np.log10(np.where(count > 0, d * count / max(1, self.base), self.unseen))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts of pairs."""
        return (self.bigram[np.minimum(count, K)] * (count <= K) + (count > K)) * count


def weights(total: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What pairs' discounted counts are divided by, and log10 of the back-off weight, for histories with this count, this
    sum of discounted counts, and this unigram probability of all followers seen."""
    full = (total > 0) & (kept > total * (1 - 1e-12))  # only frequent followers, and nothing left: one more, unseen, thins their shares
    left = np.where(full, 1 / (total + 1), 1 - kept / np.maximum(total, 1))
    return total + full, np.log10(left / (1 - seen))


def _pack(parts: np.ndarray, count: int, doc: np.ndarray, columns: list[np.ndarray], ids: np.ndarray, held: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows of DEALT with the occurrences of each part in the order of their documents."""
    parts = parts.astype(np.uint16 if count < 65536 else np.int32)
    order = np.argsort(parts, kind="stable")
    border = np.searchsorted(parts[order], np.arange(count + 1))
    columns = [c.astype(t) for c, t in zip(columns, TYPES[kind], strict=True)]
    for p in range(count):
        at = order[border[p] : border[p + 1]]
        if len(at):
            own = doc[at]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(first, len(at)))
            row = own[first]
            press = lambda a: pa.compress(a.tobytes(), "zstd", asbytes=True)
            packed = [press(c[at]) for c in columns]
            yield p, kind, len(first), len(at), press(ids[row]), press(held[row]), press(size.astype(np.uint32)), *packed, *[None] * (3 - len(packed))


NAMES = ("part", "kind", "n_docs", "n", "docs", "held", "sizes", "a", "b", "c")
DEALT = "part int, kind int, n_docs int, n int, docs binary, held binary, sizes binary, a binary, b binary, c binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], _schema())


def _row_batch(b: pa.RecordBatch, count: int) -> pa.RecordBatch:
    """Numbers, folds and ids of a batch's rows, each range for a part that its number names."""
    own = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3)], ["row", "held_out", "id"])
    ranges = b.column(0).to_numpy() >> RANGE
    borders = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), b.num_rows]
    rows = []
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(own.slice(lo, hi - lo))
        part = int(vec.mix(ranges[lo : lo + 1].astype(_U))[0] % _U(count))
        rows.append((part, ROWS, hi - lo, 0, None, None, None, sink.getvalue().to_pybytes(), None, None))
    return _batch(rows)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of packed rows' ids."""
    for b in batches:
        for packed in b.column(0).to_pylist():
            first = pa.ipc.open_stream(packed).read_next_batch()["row"][0].as_py()
            yield pa.RecordBatch.from_pylist([{"range": first >> RANGE, "ids": packed}], pa.schema([("range", pa.int64()), ("ids", pa.binary())]))


def _tokens(b: pa.RecordBatch, column: int, index: vec.HashIndex, number: np.ndarray) -> Iterator[tuple]:
    """For blocks of a batch's texts: rows from and to, tokens of each text, and each token's id, hash, history and history's hash."""
    for lo, hi, data, offsets in vec.text_blocks(b.column(column)):
        low, starts, ends = _words(data, offsets)
        h = vec.span_hashes(low, starts, ends)
        found = index.find(h)
        per = np.diff(np.searchsorted(starts, offsets))
        ptr = np.append(0, np.cumsum(per + 1))
        own, full = np.full(int(ptr[-1]), END, np.int64), np.zeros(int(ptr[-1]), _U)
        at = vec.ragged(ptr[:-1], per)
        own[at], full[at] = np.where(found >= 0, number[found], OUTSIDE), h
        history, before = np.empty_like(own), np.empty_like(full)
        history[1:], before[1:] = own[:-1], full[:-1]
        history[ptr[:-1]], before[ptr[:-1]] = START, 0
        yield lo, hi, per + 1, own, full, history, before


def _codes(history: np.ndarray, own: np.ndarray) -> np.ndarray:
    return (history << 32) | own


def hot_pairs(texts: DataFrame, shared) -> np.ndarray:
    """Sorted codes of at most MOST_HOT pairs of common words: those with such a share of some partition, the most frequent first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            for *_, own, _, history, _ in _tokens(b, 0, *shared.value):
                total += len(own)
                k, c = np.unique(_codes(history, own)[(own != OUTSIDE) & (history != OUTSIDE)], return_counts=True)
                keep = c >= len(own) / (10 * MOST_HOT)  # what is rarer in every block cannot be hot
                keys, at = np.unique(np.concatenate([keys, k[keep]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, c[keep]]), len(keys)).astype(np.int64)
        keep = counts >= max(2, total / MOST_HOT)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(counts[keep])], ["code", "n"])

    sums = texts.mapInArrow(scan, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["code"] for r in sums.orderBy(F.desc("n"), "code").limit(MOST_HOT).collect()), np.int64)


def deal(docs: DataFrame, shared, hot: np.ndarray, count: int) -> DataFrame:
    """All occurrences of docs (row number, held, text, id), packed by part, and the rows' ids.

    Hot pairs are summed for each document of a chunk, and stay together at a part that the chunk's first row names."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number = shared.value
        kept: list[tuple] = []

        def flush() -> pa.RecordBatch | None:
            nonlocal kept
            if not kept:
                return None
            doc, history, own, before, h, ids, held = (np.concatenate([k[i] for k in kept]) for i in range(7))
            kept = []
            word, after = own == OUTSIDE, (own != OUTSIDE) & (history == OUTSIDE)
            both = np.flatnonzero(~(word | after))
            pair = _codes(history[both], own[both])
            rows = []
            if len(hot):
                place = np.minimum(np.searchsorted(hot, pair), len(hot) - 1)
                is_hot = hot[place] == pair
                at, times = np.unique(doc[both[is_hot]] * len(hot) + place[is_hot], return_counts=True)
                one = np.full(len(at), int(vec.mix(ids[:1].astype(_U))[0] % _U(count)))
                rows = list(_pack(one, count, at // len(hot), [at % len(hot), times], ids, held, HOT))
                both, pair = both[~is_hot], pair[~is_hot]
            rows += _pack(vec.mix(pair.astype(_U)) % _U(count), count, doc[both], [history[both], own[both]], ids, held, BOTH)
            rows += _pack(before[after] % _U(count), count, doc[after], [own[after], before[after]], ids, held, AFTER)
            rows += _pack(h[word] % _U(count), count, doc[word], [history[word], h[word], np.where(history[word] == OUTSIDE, before[word], _U(0))], ids, held, WORD)
            return _batch(rows)

        base = tokens = 0
        for b in batches:
            if b.num_rows:
                yield _row_batch(b, count)
            ids, held = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, per, own, full, history, before in _tokens(b, 2, index, number):
                kept.append((np.repeat(np.arange(hi - lo) + base, per), history, own, before, full, ids[lo:hi], held[lo:hi]))
                base += hi - lo
                tokens += len(own)
                if tokens >= PACKED:
                    yield flush()
                    base = tokens = 0
        if (last := flush()) is not None:
            yield last

    return docs.mapInArrow(scan, DEALT)


def _cross(count: int):
    """Rows of common words after rare ones as they are, and pairs of rare words with their words' counts, for the parts of their histories."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        base = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, base, held
            doc, c, history, word, ids, away = (np.concatenate([k[i] for k in kept]) for i in range(6))
            kept, base, held = [], 0, 0
            return _batch(list(_pack(history % _U(count), count, doc, [c, history, word], ids, away, RARE)))

        for rows in _per_part(batches):
            if after := [r for r in rows if r["kind"] == AFTER]:
                yield pa.RecordBatch.from_pylist(after, _schema())
            o = _read(rows, WORD)
            _, c, place = _counts(o.b, o.trained)
            at = np.flatnonzero(o.a == OUTSIDE)
            kept.append((o.doc[at] + base, c[place[at]], o.c[at], o.b[at], o.ids, o.held))
            base += len(o.ids)
            held += len(o.b)
            if held >= PACKED:
                yield flush()
        if kept:
            yield flush()

    return scan


def _schema() -> pa.Schema:
    return pa.schema([(n, pa.int32()) for n in ("part", "kind", "n_docs", "n")] + [(n, pa.binary()) for n in ("docs", "held", "sizes", "a", "b", "c")])


@dataclass
class Occurrences:
    """One part's occurrences of one kind: its columns, the places of their documents, and the documents."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray | None
    doc: np.ndarray
    ids: np.ndarray
    held: np.ndarray
    trained: np.ndarray


def _read(rows: list[dict], kind: int) -> Occurrences:
    parts = [r for r in rows if r["kind"] == kind]
    get = lambda r, name, n, t: np.frombuffer(pa.decompress(r[name], n * np.dtype(t).itemsize, "zstd", asbytes=True), t)
    cat = lambda arrays, t: np.concatenate(arrays) if arrays else np.zeros(0, t)
    ids = cat([get(r, "docs", r["n_docs"], np.int64) for r in parts], np.int64)
    held = cat([get(r, "held", r["n_docs"], bool) for r in parts], bool)
    size = cat([get(r, "sizes", r["n_docs"], np.uint32) for r in parts], np.uint32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), size)
    columns = [cat([get(r, name, r["n"], t) for r in parts], t) for name, t in zip("abc", TYPES[kind])]
    return Occurrences(*columns, *[None] * (3 - len(columns)), doc, ids, held, ~held[doc])


def _per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows part by part; they come sorted by part."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["part"] != now and rows:
                yield rows
                rows = []
            now = r["part"]
            rows.append(r)
    if rows:
        yield rows


def _counts(key: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each one's count among trained occurrences, and each occurrence's place."""
    distinct, place = np.unique(key, return_inverse=True)
    return distinct, np.bincount(place[trained], minlength=len(distinct)), place


def _hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return vec.mix(vec.mix(x.astype(_U)) + y.astype(_U))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: numbers of rare words by count (1 .. K + 1, and all), their tokens; and counts of common words and of hot pairs."""
    for rows in _per_part(batches):
        out, both, after, hot = (_read(rows, k) for k in (WORD, BOTH, AFTER, HOT))
        _, c, _ = _counts(out.b, out.trained)
        c = c[c > 0]
        own = np.bincount(np.append(both.b[both.trained], after.a[after.trained]), minlength=1)
        at = np.flatnonzero(own)
        pairs = np.bincount(hot.a[hot.trained], hot.b[hot.trained], 1).astype(np.int64)
        some = np.flatnonzero(pairs)
        key = [*(-r for r in range(1, K + 2)), -100, -101, *at.tolist(), *(HOT_KEYS - some).tolist()]
        value = [*(int((c == r).sum()) for r in range(1, K + 2)), len(c), int(c.sum()), *own[at].tolist(), *pairs[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(value, pa.int64())], ["key", "value"])


@dataclass
class Pairs:
    """Occurrences of pairs, complete for each of their pairs.

    For each occurrence its history (an id or a hash), its word's count and log10 unigram probability, the place of its pair,
    and its document; for each pair its count and the place of one occurrence."""

    history: np.ndarray
    word_count: np.ndarray
    log_word: np.ndarray
    place: np.ndarray
    count: np.ndarray
    one: np.ndarray
    doc: np.ndarray
    ids: np.ndarray
    held: np.ndarray
    trained: np.ndarray


def _pairs(history, key, word_count, log_word, doc, ids, held, trained) -> Pairs:
    _, count, place = _counts(key, trained)
    one = np.zeros(len(count), np.int64)
    one[place] = np.arange(len(place))
    return Pairs(history, word_count, log_word, place, count, one, doc, ids, held, trained)


def _after_common(m: Numbers, rows: list[dict]) -> Iterator[Pairs]:
    """Pairs whose histories are common words or the start: their words common, and rare."""
    o = _read(rows, BOTH)
    yield _pairs(o.a, (o.a.astype(np.int64) << 32) | o.b, m.word_count[o.b], m.log_word[o.b], o.doc, o.ids, o.held, o.trained)
    o = _read(rows, WORD)
    _, c, place = _counts(o.b, o.trained)
    at = np.flatnonzero(o.a != OUTSIDE)
    c = c[place[at]]
    yield _pairs(o.a[at], _hash(o.b[at], o.a[at]), c, m.log_unigram(c), o.doc[at], o.ids, o.held, o.trained[at])


def _after_rare(m: Numbers, rows: list[dict]) -> Pairs:
    """All pairs of a part's rare histories."""
    x, y = _read(rows, AFTER), _read(rows, RARE)
    both = lambda p, q: np.concatenate([p, q])
    return _pairs(
        both(x.b, y.b), both(_hash(x.b, x.a), _hash(y.b, y.c)), both(m.word_count[x.a], y.a), both(m.log_word[x.a], m.log_unigram(y.a)),
        both(x.doc, y.doc + len(x.ids)), both(x.ids, y.ids), both(x.held, y.held), both(x.trained, y.trained),
    )


def _count_pairs(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in _per_part(batches):
            for p in _after_common(m, rows):
                seen = p.count > 0
                c, one = p.count[seen], p.one[seen]
                h, at = np.unique(p.history[one], return_inverse=True)
                cols = {"history": h.astype(np.int64)}
                for r in range(1, K + 2):
                    cols[f"n{r}"] = np.bincount(at[c == r], minlength=len(h))
                cols["more"] = np.bincount(at, c * (c > K), len(h)).astype(np.int64)
                cols["seen"] = np.bincount(at, 10.0 ** p.log_word[one], len(h)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

    return scan


def _count_rare(shared):
    """Numbers of pairs by count, for all rare histories of a part together."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _per_part(batches):
            c = _after_rare(shared.value, rows).count
            cols = {"history": [OUTSIDE], **{f"n{r}": [int((c == r).sum())] for r in range(1, K + 2)}, "more": [0], "seen": [0.0]}
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

    return scan


PAIRS = "history long, " + ", ".join(f"n{r} long" for r in range(1, K + 2)) + ", more long, seen double"
#: Types of a document's partial sums; the sums of all documents of a range of row numbers travel as one row of packed arrays.
SUMMED_AS = {"n_tokens": np.uint32, "n_known": np.uint32, "base": np.float64, "score": np.float64}
SUMS = "range long, rows binary, " + ", ".join(f"{c} binary" for c in SUMMED_AS)


#: Documents' partial sums that a worker adds up before it hands them on.
SUMMED = 1_000_000


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row for each document of all parts: its number, and sums."""
    ids, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, at = np.unique(ids, return_inverse=True)
    return distinct, *(np.bincount(at, x, len(distinct)) for x in sums)


def _score(shared, rare: bool):
    """Sums of each document over the pairs of common histories, or of rare ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, parts, held = shared.value, [], 0

        def out() -> pa.RecordBatch:
            ids, *sums = _merged(parts)
            ranges = ids >> RANGE
            border = np.append(np.flatnonzero(np.append(True, np.diff(ranges) != 0)), len(ids))
            cuts = lambda x: [x[a:b].tobytes() for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
            packed = [pa.array(cuts(x.astype(t)), pa.binary()) for x, t in zip(sums, SUMMED_AS.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ranges[border[:-1]]), pa.array(cuts((ids & ((1 << RANGE) - 1)).astype(np.uint16)), pa.binary()), *packed], ["range", "rows", *SUMMED_AS])

        history, word = m.hot >> 32, m.hot & 0xFFFFFFFF
        with np.errstate(divide="ignore"):
            hot_value = np.where(m.hot_count > 0, np.log10(m.kept(m.hot_count) / np.maximum(m.pair_base[history], 1)), m.log_alpha[history] + m.log_word[word])
        hot_known, hot_base = m.word_count[word] > 0, np.log10(m.word_count[word] + 1.0)
        for rows in _per_part(batches):
            if not rare and len((o := _read(rows, HOT)).a):
                n, times = len(o.ids), o.b.astype(np.float64)
                per = lambda x: np.bincount(o.doc, x, n)
                parts.append((o.ids, per(times), per(times * hot_known[o.a]), per(times * hot_base[o.a]), per(times * hot_value[o.a])))
                held += n
            for p in [_after_rare(m, rows)] if rare else _after_common(m, rows):
                if not len(p.history):
                    continue
                if rare:
                    h, at = np.unique(p.history, return_inverse=True)
                    seen = p.count > 0
                    of, c = at[p.one[seen]], p.count[seen]
                    base, alpha = weights(np.bincount(at[p.trained], minlength=len(h)), np.bincount(of, m.kept(c), len(h)), np.bincount(of, 10.0 ** p.log_word[p.one[seen]], len(h)))
                else:
                    at, base, alpha = p.history, m.pair_base, m.log_alpha
                value = alpha[at] + p.log_word
                c = p.count[p.place]
                seen = np.flatnonzero(c)
                value[seen] = np.log10(m.kept(c[seen]) / base[at[seen]])
                n = len(p.ids)
                own = np.flatnonzero(some := np.bincount(p.doc, minlength=n))
                known, base_sum, sums = np.bincount(p.doc[p.word_count > 0], minlength=n), np.bincount(p.doc, np.log10(p.word_count + 1.0), n), np.bincount(p.doc, value, n)
                parts.append((p.ids[own], some[own], known[own], base_sum[own], sums[own]))
                held += len(own)
            if held > SUMMED:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > SUMMED // 2:
                    yield out()
                    parts, held = [], 0
        if parts:
            yield out()

    return scan


def _total(t: pa.Table) -> pa.Table:
    """One row for each document of a range: its id, fold, and sums."""
    ids = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in t["ids"].to_pylist() if x is not None)
    total = {c: np.zeros(1 << RANGE, np.float64 if kind is np.float64 else np.int64) for c, kind in SUMMED_AS.items()}
    for r in t.select(["rows", *SUMMED_AS]).to_pylist():
        if r["rows"] is not None:
            at = np.frombuffer(r["rows"], np.uint16)  # no document twice
            for c, kind in SUMMED_AS.items():
                total[c][at] += np.frombuffer(r[c], kind)
    own = ids["row"].to_numpy() & ((1 << RANGE) - 1)
    return pa.table({"id": ids["id"], "held_out": ids["held_out"], **{c: x[own] for c, x in total.items()}})


def fit(dealt: DataFrame, crossed: DataFrame, size: int, hot: np.ndarray) -> Numbers:
    """Totals, discounts and common words' back-off weights from the dealt occurrences of training texts."""
    spark = dealt.sparkSession
    got = {r["key"]: r["value"] for r in dealt.mapInArrow(_count_words, "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).collect()}
    count = np.zeros(size, np.int64)
    hot_count = np.array([got.get(HOT_KEYS - i, 0) for i in range(len(hot))], np.int64)
    for k, v in got.items():
        if k >= 0:
            count[k] = v
    np.add.at(count, hot & 0xFFFFFFFF, hot_count)
    inside = count[count > 0]
    of_counts = np.array([got.get(-r, 0) + int((inside == r).sum()) for r in range(1, K + 2)])
    tokens, distinct = got.get(-101, 0) + int(inside.sum()), got.get(-100, 0) + len(inside)
    d = good_turing(of_counts)
    spare = sum((1 - d[r]) * r * of_counts[r - 1] for r in range(1, K + 1)) / tokens if tokens else 1.0
    base = tokens
    if tokens and spare <= 0:  # no rare word to take from: one more token, unseen
        base, spare = tokens + 1, 1 / (tokens + 1)
    m = Numbers(tokens, distinct, base, d, np.ones(K + 1), spare, count, np.zeros(size), np.zeros(size), count.copy(), hot, hot_count)
    m.log_word = m.log_unigram(count)
    m.pair_base[START] = count[END]  # a text has one start, as it has one end
    shared = spark.sparkContext.broadcast(m)
    counted = dealt.mapInArrow(_count_pairs(shared), PAIRS).unionByName(crossed.mapInArrow(_count_rare(shared), PAIRS))
    rows = counted.groupBy("history").agg(*[F.sum(c).alias(c) for c in [f"n{r}" for r in range(1, K + 2)] + ["more", "seen"]]).toArrow()
    at = rows["history"].to_numpy()
    n, more, seen = np.zeros((K + 2, size), np.int64), np.zeros(size, np.int64), np.zeros(size)
    for r in range(1, K + 2):
        n[r, at] = rows[f"n{r}"].to_numpy()
    more[at], seen[at] = rows["more"].to_numpy(), rows["seen"].to_numpy()
    for code, c in zip(hot.tolist(), hot_count.tolist(), strict=True):
        if c:
            n[min(c, K + 1), code >> 32] += c <= K + 1
            more[code >> 32] += c * (c > K)
            seen[code >> 32] += 10.0 ** m.log_word[code & 0xFFFFFFFF]
    m.bigram = good_turing(n[1:].sum(axis=1))
    kept = more + sum(m.bigram[r] * r * n[r] for r in range(1, K + 1))
    own = np.flatnonzero((kept > 0) & (np.arange(size) != OUTSIDE))
    m.pair_base[own], m.log_alpha[own] = weights(m.pair_base[own], kept[own], seen[own])
    return m


def score(docs: DataFrame, *, common: int = 65000, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """Scores of every row of docs, with the rows whose held_col is false as training texts.

    Returns id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one unigrams) and
    score (log10 probability of the text under the back-off model). At most `common` words have their figures on the driver;
    how many, and which, changes no score, and nor does how the table is split.

    Rows are numbered as they are read. docs must give them in the same order if a lost task reads them again, as files
    do; write other tables first.

    Defined cases: a null or empty text is its end alone; texts of any length are scored whole; every row has its own row
    in the result, also where ids repeat or are null; ids may have any type; a row whose held_col is null is no training
    text; without training texts every token is of the one unseen class, with probability 1; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_col, F.lit(True))
    source = docs.select(F.monotonically_increasing_id().alias("row"), held.alias("held"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    top = [w for w, _ in frequent(source.where("not held").select("text"), lambda: _words, common, REPORT)]
    joined, ptr = np.frombuffer(b"".join(top), np.uint8), np.cumsum([0] + [len(w) for w in top])
    keys = vec.span_hashes(joined, ptr[:-1], ptr[1:])
    order = np.argsort(keys)
    table = vec.HashIndex(keys[order]), np.append(order + RESERVED, 0)
    few = max(4, partitions(spark) // 2)  # in proportion to the data; a document has sums in each that has a word of it
    words = spark.sparkContext.broadcast(table)
    hot = hot_pairs(source.select("text"), words)
    sort = lambda df: cut(df.repartition(few, "part").sortWithinPartitions("part"))
    dealt = sort(deal(source, words, hot, 8 * few))
    release(spark)
    rows = dealt.where(F.col("kind") == ROWS).select("a").mapInArrow(_read_rows, "range long, ids binary")
    dealt = dealt.where(F.col("kind") != ROWS)
    crossed = sort(dealt.where(F.col("kind").isin(WORD, AFTER)).mapInArrow(_cross(8 * few), DEALT))
    release(spark)
    m = spark.sparkContext.broadcast(fitted := fit(dealt, crossed, len(top) + RESERVED, hot))
    parts = dealt.mapInArrow(_score(m, False), SUMS).unionByName(crossed.mapInArrow(_score(m, True), SUMS))
    schema = source.select("id", F.col("held").alias("held_out")).schema
    for c, kind in SUMMED_AS.items():
        schema = schema.add(c, "double" if kind is np.float64 else "long")
    sums = parts.unionByName(rows, allowMissingColumns=True).groupBy("range").applyInArrow(_total, schema)
    norm = float(np.log10(fitted.tokens + fitted.distinct + 1))
    return sums.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score",
    )
