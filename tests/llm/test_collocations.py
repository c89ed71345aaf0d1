"""Collocations against plain Python; tries, their slices and merges by themselves."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import collocations as C


def plain(rows, min_count=10, top=2000, share=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) == 1 or a < min_count:
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((p, a, f[lang, p[:k]], f[lang, p[k:]], score))
    out = set()
    for lang, own in found.items():
        longer = [(q, b) for q, b, *_ in own if len(q) == 3]
        own = [c for c in own if not any(len(c[0]) == 2 and c[0] in (q[:2], q[1:]) and 100 * b >= share * c[1] for q, b in longer)]
        own.sort(key=lambda c: (-c[4], -c[1], " ".join(c[0]).encode()))
        out |= {(lang, i + 1, " ".join(p), a, left, right, n[lang], score) for i, (p, a, left, right, score) in enumerate(own[:top])}
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "House", "river", "é漢", "x#", "of", "bank", "a.b", "c,d", "zz", "😀"] + [f"w{i}" for i in range(40)]
    weights = [30, 10, 5, 5, 3, 3, 20, 5, 2, 2, 1, 1] + [1] * 40
    glue = [" ", "  ", "\t", " ", ". ", "\n", "\r\n", "!", "\x0b", "\xa0"]
    return [("".join(x for w in rng.choices(words, weights, k=rng.choice([0, 1, 30, 200])) for x in (w, rng.choices(glue, [20, 1, 1, 20, 1, 1, 1, 1, 1, 1])[0])), rng.choice(["en", "en", "de", None])) for _ in range(n)]


def test_phrases_equal_plain_python(spark):
    rows = [*corpus(120, 1), (None, "en"), ("", "fr"), ("only three words", "fr"), ("Same Words here. " * 3000, "de"), *[("hot phrase of copies", "en")] * 60]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(c) for c in ("n", "a", "w1", "part", "phrase")}).repartition(5)
    want = plain(rows)
    assert len(want) > 50
    for shard, size in ((10**6, 10**6), (500, 700), (2000, 150)):  # one range and many, also inside a word's and a pair's phrases
        got = C.collocations(docs, shard_words=shard, range_nodes=size)
        assert {tuple(r) for r in got.collect()} == want
    few = {tuple(r) for r in C.collocations(docs, min_count=3, top=7, share=80, shard_words=900, range_nodes=400).collect()}
    assert few == plain(rows, 3, 7, 80)
    assert C.collocations(docs.limit(0)).count() == 0


def trie_of(rows):
    made = C.Builder()
    for text, lang in rows:
        raw = (text or "").encode()
        made.add(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), [(lang or "und").encode()])
    return made.build()


def listed(trie):
    return [[(trie.key(k, i), int(trie.counts[k][i])) for i in range(len(trie.labels[k]))] for k in range(C.DEPTH + 1)]


def test_slices_of_a_trie_are_its_nodes(spark):
    rows = corpus(40, 2)
    trie = trie_of(rows)
    assert listed(C.Trie.of_bytes(trie.to_bytes())) == listed(trie) and all(x == sorted(x) for x in listed(trie))
    keys = sorted(k for level in listed(trie) for k, _ in level)
    rng = random.Random(1)
    borders = sorted({*rng.sample(keys, 15), (b"de",), (b"dd", b"x"), (b"en", b"the", b"zzzz"), (b"en", b"the", b"of", b""), (b"zz", b"a")})
    cuts = [None, *(trie.split(b) for b in borders), None]
    for lo, hi, a, b in zip(cuts, cuts[1:], [None, *borders], [*borders, None], strict=False):
        own = trie.slice(lo, hi)
        want = [[(k, n) for k, n in level if (a is None or k >= a or k == a[: len(k)]) and (b is None or k < b)] for level in listed(trie)]
        assert (listed(own) if own else [[]] * 4) == want
    halves = [trie_of(rows[:25]), trie_of(rows[25:])]
    assert listed(C.merge(halves)) == listed(trie)


def test_products_beyond_64_bits(spark):
    a = 4_000_000_000_000
    rows = [("en", 1, "x", None, None, 3 * a, 3 * a, None, 9 * a), ("en", 1, "y", None, None, 2 * a, 2 * a, None, 9 * a), ("en", 2, "x", "y", None, a, 3 * a, a, 9 * a)]
    got = C.candidates(spark.createDataFrame(rows, C.PHRASES)).collect()
    assert [(r.w1, r.w2, r.l, r.r, r.score) for r in got] == [("x", "y", 3 * a, 2 * a, 1000000 * a * a // (6 * a * a))]
