"""Perplexities against a plain Python Kneser-Ney model; limits, odd rows and names; held-out labels of the test tables."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import quality_kn, quality_rules

ORDER = quality_kn.ORDER


def symbols(text):
    out, before = [], " "
    for c in text or "":
        c = " " if c.isspace() else "0" if c.isdecimal() else "�" if c == "\0" else c
        if c != " " or before != " ":
            out.append(c)
        before = c
    return " " * (ORDER - 1) + "".join(out) + " " if out else ""


class Plain:
    def __init__(self, texts):
        counts = {ORDER: collections.Counter(s[i - ORDER + 1 : i + 1] for s in map(symbols, texts) for i in range(ORDER - 1, len(s)))}
        for k in range(ORDER - 1, 0, -1):
            counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        self.p, self.w, self.unseen = {}, {}, 0.0
        for k in range(1, ORDER + 1):
            n = [max(1, sum(1 for c in counts[k].values() if c == r)) for r in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(r + 1 - (r + 2) * y * n[r + 1] / n[r], 0.05), r + 0.95) for r in range(3)]
            off = {g: min(d[min(c, 3) - 1], c) for g, c in counts[k].items()}
            total, spare = collections.Counter(), collections.Counter()
            for g, c in counts[k].items():
                total[g[:-1]] += c
                spare[g[:-1]] += off[g]
            for h in total:
                weight = spare[h] / total[h]
                if h:
                    self.w[h] = weight
                else:
                    self.unseen = weight / (len(counts[1]) + 1)
            for g, c in counts[k].items():
                self.p[g] = (c - off[g]) / total[g[:-1]] + (spare[g[:-1]] / total[g[:-1]] * self.p[g[1:]] if k > 1 else self.unseen)

    def log_perplexity(self, text):
        s, value = symbols(text), 0.0
        for i in range(ORDER - 1, len(s)):
            for k in range(ORDER, 0, -1):
                if (g := s[i - k + 1 : i + 1]) in self.p:
                    value += math.log10(self.p[g])
                    break
                value += math.log10(max(self.w.get(s[i - k + 1 : i], 1.0), 1e-12)) if k > 1 else math.log10(self.unseen)
        return (-value / (len(s) - ORDER + 1), len(s) - ORDER + 1) if s else (0.0, 0)


def texts_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé 12\n漢😀") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_perplexity_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(quality_kn, "BLOCK", 500)  # many blocks
    learned, other = texts_of(60, 1), [*texts_of(60, 2), None, "", " \n", "zzzz qqqq", "a" * 3000, *["same text"] * 3, "x\0y"]
    top = quality_kn.count_grams(spark.createDataFrame([(t,) for t in learned], "text string"))
    table, unseen = quality_kn.interpolate(top)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(learned + other)], "id long, text string").coalesce(3)
    plain = Plain(learned)
    got = {r.id: r for r in quality_kn.score(docs, quality_kn.keyed(table), unseen, keep_text=True).collect()}
    assert len(got) == len(learned + other)
    for i, t in enumerate(learned + other):
        e, n = plain.log_perplexity(t)
        assert got[i].n == n and abs(got[i].e - e) < 1e-9 and got[i].text == t
    for context in ("abc", "   ", "b 0", "qqq", "é漢a"):  # every distribution sums to one, an unseen character included
        base = plain.log_perplexity
        mass = 0.0
        for c in [*{g for g in plain.p if len(g) == 1}, "q"]:
            value, s = 0.0, context + c
            for k in range(ORDER, 0, -1):
                if s[-k:] in plain.p:
                    value += math.log10(plain.p[s[-k:]])
                    break
                value += math.log10(plain.w.get(s[-k:-1], 1.0)) if k > 1 else math.log10(plain.unseen)
            mass += 10**value
        assert abs(mass - 1) < 1e-6 and base


def test_blocks_do_not_depend_on_batches(spark, monkeypatch, tmp_path):
    """Arrow's limits of rows and bytes, and the width of other columns, change no score."""
    monkeypatch.setattr(quality_kn, "BLOCK", 3000)
    learned, other = texts_of(60, 1), [*texts_of(300, 7), None, "", "ab" * 4000]
    top = quality_kn.count_grams(spark.createDataFrame([(t,) for t in learned], "text string"))
    table, unseen = quality_kn.interpolate(top)
    kept = quality_kn.keyed(table)
    common = quality_kn.common_grams(top, kept, 40)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(other)], "id long, text string").withColumn("wide", F.repeat(F.lit("x"), F.lit(5000))).coalesce(2).write.parquet(path)
    plain = Plain(learned)
    want = {i: plain.log_perplexity(t) for i, t in enumerate(other)}
    records, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(records), spark.conf.get(size)
    try:
        for rows, limit, columns, share in ((10000, "64m", ["id", "text"], None), (7, "64m", ["id", "text", "wide"], common), (10000, "30k", ["id", "text"], common), (10000, "7k", ["id", "text", "wide"], None)):
            spark.conf.set(records, rows)
            spark.conf.set(size, limit)
            got = {r.id: (r.e, r.n) for r in quality_kn.score(spark.read.parquet(path).select(*columns), kept, unseen, common=share).collect()}
            assert len(got) == len(want) and all(got[i][1] == n and abs(got[i][0] - e) < 1e-9 for i, (e, n) in want.items())
    finally:
        spark.conf.set(records, before[0])
        spark.conf.set(size, before[1])


def test_rows_in_another_order_are_noticed(spark):
    top = quality_kn.count_grams(spark.createDataFrame([(t,) for t in texts_of(20, 1)], "text string"))
    table, unseen = quality_kn.interpolate(top)
    shuffled = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(200, 3))], "id long, text string").coalesce(1).withColumn("k", F.rand()).sortWithinPartitions(F.expr("reflect('java.util.UUID', 'randomUUID')"))
    with pytest.raises(Exception, match="write docs to files first"):
        quality_kn.score(shuffled, quality_kn.keyed(table), unseen).collect()


def test_quantiles_are_order_statistics(spark):
    rng = random.Random(3)
    rows = [(c, round(rng.random(), 4)) for c in ["a"] * 101 + ["b"] * 7 + [""] for _ in range(1)]
    df = spark.createDataFrame(rows, "c string, v double")
    for q in (0.5, 0.9995, 0.1):
        got = quality_kn.quantiles(df, F.col("v"), q)
        for c in (None, "a", "b", ""):
            own = sorted(v for k, v in rows if c is None or k == c)
            assert got[c] == own[max(0, math.ceil(q * len(own)) - 1)]


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(4)
    make = lambda: " ".join(rng.choice(["the", "and", "word", "other", "house", "river"]) for _ in range(60))
    docs = spark.createDataFrame([(i, make(), "en") for i in range(120)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_odd_rows_and_names(spark, prose):
    docs, labels = prose
    model = quality_kn.train(docs, labels)
    good = docs.first().text
    long = " ".join(r.text for r in docs.collect()) * 30
    rows = [(1, good, "en", "k"), (1, good, "en", "k"), (2, good, None, "k"), (3, good, "xx", "k"), (4, None, "en", "k"), (5, " \n", "en", "k"), (6, "#$% " * 50, "en", "k"), (7, long, "en", "k"), (None, good, "en", "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string").withColumns({c: F.lit(c) for c in ("e", "n", "key", "block", "payload", "_0", "_text", "logp", "c")})
    got = quality_kn.classify(odd, model)
    assert got.columns == [*[c for c in odd.columns if c != "kept"], "perplexity", "kept"]
    seen = collections.defaultdict(list)
    for r in got.collect():
        assert (r["e"], r["n"], r["key"], r["_0"]) == ("e", "n", "key", "_0")
        seen[r.doc_id].append((r.kept, r.perplexity is None))
    assert seen[1] == [(True, False)] * 2 and seen[2] == seen[3] == seen[7] == seen[None] == [(True, False)]
    assert seen[4] == seen[5] == [(False, True)] and seen[6] == [(False, False)]
    assert quality_kn.classify(odd.limit(0), model).count() == 0
    assert quality_kn.train(docs, labels.limit(0)) is None and quality_kn.train(docs.limit(0), labels) is None
    free = {(r.doc_id, r.kept) for r in quality_kn.classify(odd, None).collect()}
    assert free >= {(1, True), (6, True), (4, False), (5, False)}
    nothing = labels.where("doc_id = 0")  # too few for a limit
    assert quality_kn.classify(docs.limit(1), quality_kn.train(docs, nothing)).count() == 1


def agreement(verdicts, labels, fitted):
    """Shares of held-out good and bad rows that the verdicts have right."""
    both = verdicts.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").where(~fitted)
    r = both.agg(*[F.avg(F.when(F.col("quality") == q, (F.col("kept") == (q == 1)).cast("int"))) for q in (1, 0)]).first()
    return r[0], r[1]


def test_held_out_labels(spark):
    """Both classifiers learn from three of four labelled rows; on the fourth they agree with the labels."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    fitted = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    good, bad = agreement(quality_kn.classify(docs, quality_kn.train(docs, labels.where(fitted)), keep_text=False).select("doc_id", "kept"), labels, fitted)
    assert good >= 0.93 and bad >= 0.8
    good, bad = agreement(quality_rules.judge(docs, quality_rules.train(docs, labels.where(fitted))).select("doc_id", "kept"), labels, fitted)
    assert good >= 0.93 and bad >= 0.8


def test_all_trusted_rows_are_used(spark, monkeypatch):
    n, seen = 3000, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.hex(F.col("id") * 7919)).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    count, quantiles = quality_kn.count_grams, quality_kn.quantiles
    monkeypatch.setattr(quality_kn, "count_grams", lambda texts: (seen.append(texts.count()), count(texts))[1])
    monkeypatch.setattr(quality_kn, "quantiles", lambda rows, *more: (seen.append(rows.count()), quantiles(rows, *more))[1])
    quality_kn.train(docs, labels)
    counted, limiting, again = seen
    assert counted + limiting == n and limiting == again and counted > 0.6 * n
