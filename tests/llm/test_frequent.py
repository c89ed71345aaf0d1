"""Frequent strings from summaries that are merged in a tree."""

import collections
import random


from parlance.llm import frequent, vec


def test_summaries_are_merged_in_a_tree(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["é漢"]
    weights = [1000 // (i + 1) + 1 for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=400)),) for _ in range(240)] + [(None,), ("",)]
    want = collections.Counter(w for (t,) in rows for w in (t or "").split())
    split = lambda: lambda data, offsets: (data, *vec.word_spans(data, offsets)[:2])
    for parts in (1, 5, 90):  # one summary, one merge on the driver, and two levels below it
        docs = spark.createDataFrame(rows, "text string").repartition(parts)
        got = frequent.frequent(docs, split, 20, 100_000)
        assert len(got) == 20 and [c for _, c in got] == sorted((c for _, c in got), reverse=True)
        assert all(c <= want[w.decode()] for w, c in got)
        if parts < 90:  # whatever comes once in a block is not reported
            assert got == sorted(((w.encode(), c) for w, c in want.items()), key=lambda x: (-x[1], x[0]))[:20]
        assert {w for w, _ in got[:5]} == {f"w{i}".encode() for i in range(5)}
    assert frequent.frequent(docs.limit(0), split, 20, 100) == []


def test_summaries_round_trip():
    found = [(b"", 3), ("é".encode(), 1 << 40), (b"x" * 1000, 2)]
    assert frequent._unpacked(frequent._packed(found)) == found and frequent._unpacked(frequent._packed([])) == []
    assert frequent._merged([frequent._packed(found), frequent._packed([(b"", 4), (b"a", 7)])], 3) == [("é".encode(), 1 << 40), (b"", 7), (b"a", 7)]
