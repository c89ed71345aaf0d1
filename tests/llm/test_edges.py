"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from parlance.llm import ann, bpe, common, jaccard, katz, langid, packing, quality_rules, token_counts  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHES = ("n", "e", "key", "part", "node", "id", "row", "h", "_t", "_id", "held", "label", "bucket", "_rank", "source", "text_", "c", "s")


@pytest.fixture(scope="module")
def odd(spark):
    """Ids 1 to 5 are odd texts, 6 and 7 one row twice, 8 without id; extra columns have names that operators use inside."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 200_000), (5, "x" * 1_000_000), (6, "one two three four five six"), (6, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    return docs.withColumns({c: F.lit(1) for c in CLASHES})


def test_packing(spark, odd):
    rows = packing.pack(odd, max_len=1000, buckets=3, budget=5000).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {1: 1, 2: 1, 3: 1, 4: 200_001, 5: 2, 6: 14, 7: 7, None: 7} and packing.pack(odd.limit(0)).count() == 0


def test_codec_and_counts(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = bpe.Codec(odd, public_tokenizers.path("byte_bpe_50k.json"), words=50).digests(odd).collect()
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r.doc_id), count(r.text)) for r in odd.collect())
    tokens = token_counts.count_tokens(odd, MODEL, words=50).collect()
    assert len(tokens) == 9 and {r.doc_id: r.over_limit for r in tokens} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, None: False}
    assert token_counts.count_tokens(odd.limit(0), MODEL).count() == 0


def test_links(spark, odd):
    got = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.link(odd, k=4, num=85, den=100).collect()))
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "5"), ("6", 3, "6"), ("6", 3, "6"), ("7", 3, "6"), ("None", 3, "6")])


def test_one_key_of_many_members(spark):
    """A passage that most texts share makes them members of common keys; only those that are alike in the rest too are linked."""
    rng = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = []
    for i in range(1200):
        own = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 9, 10, 40])))
        texts += [f"{shared} {own}"] * (1 + (i % 100 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link(docs, k=4, num=85, den=100).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(frozenset(sets[i]), []).append(i)
    reps = [v[0] for v in groups.values()]
    root = {i: i for i in reps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    size = [len(s) for s in sets]
    for a in range(len(reps)):
        for b in range(a):
            x, y = reps[a], reps[b]
            if 100 * min(size[x], size[y]) >= 85 * max(size[x], size[y]):
                both = len(sets[x] & sets[y])
                if 100 * both >= 85 * (size[x] + size[y] - both):
                    p, q = top(x), top(y)
                    root[max(p, q)] = min(p, q)
    expected = {i: min(groups[frozenset(sets[j])][0] for j in [top(groups[frozenset(sets[i])][0])]) for i in range(len(texts))}
    assert got == expected


def test_language(spark, odd):
    rng = random.Random(2)
    stems = {"en": ["the", "and", "ing"], "de": ["der", "ung", "sch"]}
    rows = [(i, " ".join(rng.choice(stems[x]) for _ in range(40)), x) for i, x in enumerate(["en", "de"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == 9 and all(r["n"] == 1 and 0 <= r.score <= 1 for r in got)
    named = {r.doc_id: r for r in got}
    assert all(named[i].lang_pred == "und" and not named[i].accepted for i in (1, 2, 3)) and not named[5].accepted
    same = langid.train(spark.createDataFrame([(i, "aaa bbb", x) for i, x in enumerate(["en", "de"] * 60)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(odd.where("doc_id = 6").withColumn("text", F.lit("aaa bbb")), same).collect()} == {"de"}  # a tie: the first by name
    none = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(odd.limit(0), model).count() == 0


def test_rules(spark, odd):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(odd, quality_rules.train(odd, labels)).collect()
    named = {r.doc_id: r for r in got}
    assert len(got) == 9 and named[4].n_words == 200_000 and named[4].n_repeat_words == 200_000 and named[5].word_chars == 1_000_000
    assert all(r.base_failed and not r.kept for r in got) and quality_rules.judge(odd.limit(0), quality_rules.train(odd.limit(0), labels.limit(0))).count() == 0


def test_word_and_character_grams():
    block = quality_rules.read_block(np.frombuffer("a b c a b é漢😀x".encode(), np.uint8), np.array([0, len("a b c a b é漢😀x".encode())]))
    kinds = [len(p) for p, _ in quality_rules.buckets(block)]
    assert kinds == [6, 5, 4, 11]  # one, two and three words, four characters
    at, value = quality_rules.features(block)[0]
    assert abs(value.sum() - 4) < 1e-9 and len(set(at // (1 << quality_rules.BITS))) == 4


def test_katz_names(spark, odd):
    got = katz.score(odd.withColumn("held_out", F.lit(False))).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted([("1", 1), ("2", 1), ("3", 1), ("4", 200_001), ("5", 2), ("6", 7), ("6", 7), ("7", 7), ("None", 7)])


def neighbours(rows, k, asked):
    """Brute force over (id, vector) rows."""
    out = []
    for q, v in rows:
        if q is not None and q in asked:
            s = sorted(((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i is not None and i != q))[:k]
            out += [(q, n + 1, i) for n, (_, i) in enumerate(s)]
    return sorted(out)


def test_neighbour_ties_and_few(spark):
    vectors = [(i, [float(i % 3), 1.0, 2.0]) for i in range(1, 9)] + [(20, [1.0, 1.0, 2.0])]
    table = spark.createDataFrame([*vectors, (21, None), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("i", "v", "code", "score", "rank", "query_id")})
    for k in (3, 20):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, table.where("vec_id in (1, 20, 21)"), k=k).collect())
        assert got == neighbours(vectors, k, {1, 20})
    twice = ann.nearest(table.unionByName(table), table.where("vec_id = 1"), k=4).collect()
    assert [r.vec_id for r in sorted(twice, key=lambda r: r["rank"])] == [2, 2, 5, 5]


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding is not None}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    hit = {}
    for width in (3.0, float("inf")):
        got = {}
        for r in ann.nearest(table, table.where("vec_id % 20 = 0"), width=width).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = total = 0
        for q in ids[ids % 20 == 0]:
            s = m @ x[q]
            s[ids == q] = -np.inf
            want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
            hits, total = hits + len(want & got[q]), total + 20
        hit[width] = hits / total
    assert hit[float("inf")] == 1 and hit[3.0] >= 0.99


def test_shared_folder_rule(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())
