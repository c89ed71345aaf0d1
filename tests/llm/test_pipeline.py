"""Every stage and run() against plain Python, on a table with odd rows, near copies, junk and personal data."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from parlance.llm import langid, packing, quality_kn  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    stems = {"en": ["the", "and", "ing", "tion", "wh", "ould"], "de": ["der", "ung", "sch", "ein", "ch", "lich"]}
    prose = lambda lang: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(120))
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["en", "de"] * 100)]
    near = rows[10][1].split()
    near[60] = "changed"
    rows += [(300, rows[10][1], "en"), (301, " ".join(near), "en"), (302, rows[11][1], "de"), (302, rows[11][1], "de")]
    rows += [(310, rows[20][1] + " mail john.smith@mail.example.com or 4111 1111 1111 1111", "en")]
    rows += [(320 + i, "### $$$ %%% &&& !!! " * 40, "en") for i in range(3)] + [(330, None, "en"), (331, "", "de"), (332, " \n", None)]
    rows += [(340, " ".join(prose("en") for _ in range(30)), "en"), (341, prose("en"), None), (None, prose("en"), "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, f"s{i % 3}", len(r[1] or "")) for i, r in enumerate(rows)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(200)] + [(320, 0, 0), (321, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def first_of_groups(rows):
    """Rows left when one of each group of linked texts stays: the smallest id."""
    sets = [shingles(r[1]) if r[1] and r[1].split() else set() for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if None not in (rows[i][0], rows[j][0]) and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return sorted(least.values(), key=str)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    stage = dict(pipeline.STAGES)
    all_rows = read(docs)

    good = stage["quality"](spark, docs, folder)
    assert good.columns == COLUMNS
    kept = read(good)
    model = quality_kn.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    limit = lambda r: model.limits.get(r[2], model.limits[None])
    expected = []
    for r in quality_kn.score(docs, model.table, model.unseen, keep_text=True).select(*COLUMNS, "e", "n").collect():
        shrunk = (r.n * r.e + model.prior * model.medians.get(r.lang, model.medians[None])) / (r.n + model.prior)
        expected += [tuple(r)[:5]] * (r.n > 0 and shrunk <= limit(r[:5]))
    expected.sort(key=str)
    assert kept == expected and {r[0] for r in all_rows} - {r[0] for r in kept} >= {320, 321, 322, 330, 331, 332}
    assert sum(r[0] is not None and r[0] < 200 for r in kept) >= 190  # of few trusted rows, the largest that was kept out is the limit

    known = stage["language"](spark, spark.createDataFrame(kept, SCHEMA), folder)
    spoken = read(known)
    own = langid.train(spark.createDataFrame(kept, SCHEMA))
    want = []
    for r in kept:
        data = r[1].encode()
        best, _, fine = own.predict(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        want += [r] * bool(fine[0])
    assert known.columns == COLUMNS and spoken == want and len(spoken) >= len(kept) - 8

    single = stage["near_duplicates"](spark, spark.createDataFrame(spoken, SCHEMA), folder)
    left = read(single)
    assert single.columns == COLUMNS and left == first_of_groups(spoken) and not {300, 301, 302} & {r[0] for r in left}

    safe = stage["private"](spark, spark.createDataFrame(left, SCHEMA), folder)
    hidden = read(safe)
    assert safe.columns == COLUMNS and len(hidden) == len(left)
    changed = [(a, b) for a, b in zip(left, hidden, strict=True) if a != b]
    assert all(a[0] == 310 and len(a[1]) == len(b[1]) and "john.smith@" not in b[1] and "4111 1111" not in b[1] for a, b in changed)

    packed = read(stage["packed"](spark, spark.createDataFrame(hidden, SCHEMA), folder))
    assert sorted(str(r[0]) for r in packed) == sorted(str(r[0]) for r in hidden)  # no text here is longer than a piece
    words = {r[0]: len(r[1].split()) + 1 for r in hidden}
    assert all(words[r[0]] == r[2] <= r[4] for r in packed)
    bounds, padding = packing.optimal_bounds({n: list(words.values()).count(n) for n in words.values()}, 16)
    assert sum(r[4] - r[2] for r in packed) == padding and {r[4] for r in packed} <= set(bounds)

    assert {r[:5] for r in read(pipeline.run(spark, folder))} == {r[:5] for r in packed}


def test_stages_of_nothing(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
