"""The filter audit against plain Python, over odd rows."""

import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import filter_audit, vec

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    rows = [(i, t or "", c or "") for i, t, c in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    found = collections.defaultdict(list)
    for i, t, c in rows:
        w = SPLIT.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        found[c].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = set()
    for c, docs in found.items():
        shapley = collections.Counter()
        steps = []
        for p in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(p):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                earlier = [d for d in docs if f in d[0] and d[0] & set(p[:k])]
                steps.append((f, (c, "".join(p), k + 1, len(left), len(gone), len(earlier), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out |= {(*s, shapley[f]) for f, s in steps}
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "House", "river", "é漢", "x#", "50%", "a|b", "plain", "word"] + [f"w{i}" for i in range(300)]
    made = [" ".join(rng.choice(words[: rng.choice([4, 9, 300])]) for _ in range(rng.choice([0, 3, 199, 200, 201, 400]))) for _ in range(n)]
    return [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(made)]


def test_audit_equals_plain_python(spark):
    rows = corpus(80, 1)
    rows += [(100 + i, rows[i % 7][1], "en") for i in range(30)] + [(200, None, "en"), (201, "", None), (202, None, "xx"), (None, rows[1][1], "en"), (None, None, None), (3, rows[3][1], "de"), (3, rows[3][1], rows[3][2]), (2, "x " * 250, "en")]
    rows.append((300, " ".join(f"n{i}" for i in range(200_000)), "en"))
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110, 2)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1), (7, None, None), (999, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("id", "part", "mask", "n", "_digest")}).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == plain(rows, labels)
    assert got.count() == 600 * 4
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_distinct_words_survive_equal_hashes():
    texts = [b"a b a c", b"", b"x x x", b"q w e r"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    starts, ends, first = vec.word_spans(data, offsets)
    assert filter_audit.distinct_words(data, starts, ends, first).tolist() == [3, 0, 1, 4]
    same = np.zeros(len(starts), np.uint64)
    assert filter_audit.distinct_words(data, starts, ends, first, same).tolist() == [3, 0, 1, 4]
