"""Vector best-fit packing against the library's ids, its capacities, and a piece-by-piece best fit."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import vector_fit
from parlance.llm.bpe import Codec
from parlance.llm.vector_fit import Capacities

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, limits, weights):
    """Bins of a best fit that takes every piece by itself, the longest first."""
    bins = []
    whole = (limits.tokens, limits.pieces, limits.cost)
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        fits = [b for b in bins if all(x >= y for x, y in zip(b, need, strict=True))]
        norm = lambda b: sum(w * ((x - y) / z) ** 2 for w, x, y, z in zip(weights, b, need, whole, strict=True))  # noqa: B023,E731
        if fits:
            b = min(fits, key=norm)
        else:
            bins.append(b := list(whole))
        for i in range(3):
            b[i] -= need[i]
    return len(bins)


@pytest.mark.parametrize("limits", [Capacities(100, 100, 10_000), Capacities(100, 3, 10_000), Capacities(100, 50, 3_000), Capacities(64, 1, 4096)])
def test_runs_of_bins_equal_single_bins(limits):
    rng = random.Random(limits.pieces)
    lengths = [min(limits.longest(), max(1, int(rng.expovariate(1 / 25)))) for _ in range(3000)]
    histogram = collections.Counter(lengths)
    for rule, weights in vector_fit.RULES:
        p = vector_fit.best_fit(histogram, limits, rule, weights)
        if rule == vector_fit.NORM:
            assert abs(p.total - one_by_one(lengths, limits, weights)) <= 2
        held = collections.defaultdict(list)
        for n, c in histogram.items():
            for b, o in zip(*(x.tolist() for x in p.place(np.full(c, n), np.arange(c))), strict=True):
                held[b].append((o, n))
        assert len(held) == p.total and set(held) == set(range(p.total))
        for own in held.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= limits.tokens and len(own) <= limits.pieces and sum(n * n for _, n in own) <= limits.cost


def test_no_room_is_refused():
    with pytest.raises(ValueError):
        Capacities(10, 0, 100).longest()
    assert Capacities(100, 9, 50).longest() == 7 and vector_fit.plan({}, Capacities(9, 9, 81)).total == 0


@pytest.mark.parametrize("limits", [{}, {"max_pieces": 2}, {"max_cost": 400_000}])
def test_pack_equals_the_library(spark, limits):
    rng = random.Random(5)
    words = ["house", "river", "the", " and", "é漢字", "12 345", "<|endoftext|>", "don't", "\n\n", "x" * 40]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 300, 900]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(made)] + [(100, None), (101, ""), (102, "ab " * 20_000), (None, "null id"), (3, made[3]), (3, made[3])] + [(500 + i, "same") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("piece", "length", "_rank", "_task", "ids")}).repartition(3)
    codec = Codec(docs, PATH, words=50)
    placed = vector_fit.pack(docs, codec, keep_ids=True, **limits)
    got = placed.collect()
    library = Tokenizer.from_file(PATH)
    longest = min(1024, math.isqrt(limits.get("max_cost", 1 << 20)))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % longest or longest
        cuts = [0, *range(head, len(ids) + 1, longest)]
        want += [(i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got], key=key) == sorted(want, key=key)
    held = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        held[r.sequence_id].append(r)
    for own in held.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(own) <= limits.get("max_pieces", 1024) and sum(r.length**2 for r in own) <= limits.get("max_cost", 1 << 20)
    if not limits:
        assert len(held) <= -(-sum(r.length for r in got) // 1024) + 1
    whole = {r.sequence_id: r for r in vector_fit.sequences(placed).collect()}
    for k, own in held.items():
        assert whole[k].ids == [x for r in sorted(own, key=lambda r: r.offset) for x in r.ids] and len(whole[k].pieces) == len(own)
    empty = docs.limit(0)
    assert vector_fit.pack(empty, codec).count() == 0
