"""Languages, scores and limits against a plain Python Kneser-Ney model of characters."""

import collections
import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import langid
from parlance.llm.calibration import platt

ORDER = langid.ORDER


def symbols(text):
    out = []
    for c in text or "":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return " " * (ORDER - 1) + "".join(out) + " " if out else ""


class Plain:
    """One model for each class; the smallest share of a character is one in the number of all classes' characters and one."""

    def __init__(self, texts):
        self.counts = {}
        for c, own in texts.items():
            top = collections.Counter(s[i - ORDER + 1 : i + 1] for s in map(symbols, own) for i in range(ORDER - 1, len(s)))
            self.counts[c] = {ORDER: top}
            for k in range(ORDER - 1, 0, -1):
                self.counts[c][k] = collections.Counter(g[1:] for g in self.counts[c][k + 1])
        self.least = 1 / (len({g for c in self.counts for g in self.counts[c][1]}) + 1)
        self.off, self.total, self.spare = {}, {}, {}
        for c, levels in self.counts.items():
            for k, grams in levels.items():
                n = [max(1, sum(v == r for v in grams.values())) for r in (1, 2)]
                self.off[c, k] = n[0] / (n[0] + 2 * n[1])
                total, spare = collections.Counter(), collections.Counter()
                for g, v in grams.items():
                    total[g[:-1]] += v
                    spare[g[:-1]] += min(self.off[c, k], v)
                self.total[c, k], self.spare[c, k] = total, spare

    @functools.cache  # noqa: B019
    def p(self, c, g):
        k = len(g)
        below = self.p(c, g[1:]) if k > 1 else self.least
        total = self.total[c, k].get(g[:-1], 0)
        if not total:
            return below
        v = self.counts[c][k].get(g, 0)
        return (v - min(self.off[c, k], v)) / total + self.spare[c, k][g[:-1]] / total * below

    def entropies(self, text):
        s = symbols(text)
        n = max(0, len(s) - ORDER + 1)
        return {c: -sum(math.log10(self.p(c, s[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(s))) / n for c in self.counts} if n else {}


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdefg  é", "bb": "efghijk  ß", "cc": "xyzab漢  "}
    rows = [(i, "".join(rng.choice(alphabets[c]) for _ in range(rng.randint(1, 90))), c) for i, c in enumerate(random.Random(2).choices(list(alphabets), k=240))]
    rows += [(900, None, "aa"), (901, "no language", None), (902, "12 34", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    counted = collections.defaultdict(list)
    for i, t, c in rows:
        if c is not None and i not in held:
            counted[c].append(t)
    return rows, held, langid.train(docs), Plain(counted)


def margin(entropies, text):
    order = sorted(entropies, key=lambda c: (entropies[c], c))
    return order[0], (entropies[order[1]] - entropies[order[0]]) * math.sqrt(len(symbols(text)) - ORDER + 1), entropies[order[0]]


def test_calibration_and_limits(learned):
    rows, held, model, plain = learned
    got = [(margin(e, t), c) for i, t, c in rows if i in held and c is not None and (e := plain.entropies(t))]
    slope, shift = platt(np.array([m[1] for m, _ in got]), np.array([m[0] == c for m, c in got]))
    assert abs(model.slope - slope) < 0.01 * slope and abs(model.shift - shift) < 0.05
    for k, c in enumerate(model.chars.classes):
        own = [m[2] for m, truth in got if m[0] == c == truth]
        assert abs(model.limits[k] - (2 * np.quantile(own, 0.99) - np.quantile(own, 0.5))) < 1e-3


def test_predictions_equal_plain_python(spark, learned):
    rows, _, model, plain = learned
    texts = [t for _, t, _ in rows] + ["", None, "?!", "qqqq wwww", "Abc ABC éßß", "漢" * 5000, "ÀB\0c", "ǅ ŉ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(c) for c in ("score", "lang_pred", "_text")}).repartition(4)
    got = {r.doc_id: r for r in langid.identify(docs.drop("_text"), model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        entropies = plain.entropies(t)
        if not entropies:
            assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
            continue
        best, gap, least = margin(entropies, t)
        close = gap < 1e-3 * math.sqrt(len(symbols(t)))
        assert got[i].lang_pred == best or close
        assert abs(got[i].score - 1 / (1 + math.exp(-(model.slope * gap + model.shift)))) < 0.01
        limit = model.limits[model.chars.classes.index(best)]
        assert got[i].accepted == (least <= limit) or abs(least - limit) < 1e-3 or close


def test_every_distribution_sums_to_one(learned):
    _, _, _, plain = learned
    chars = {g for c in plain.counts for g in plain.counts[c][1]}
    for c in plain.counts:
        for context in ("   ", "abc", "qqq", "漢 x", "e"):
            mass = sum(plain.p(c, (context + x)[-ORDER:]) for x in chars) + plain.p(c, (context + "☃")[-ORDER:])
            assert abs(mass - 1) < 1e-9
