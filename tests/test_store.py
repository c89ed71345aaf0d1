"""Translators and editors are asked once for each part, whatever is read, killed or run again."""

import os

import pytest

from parlance.plans import parts
from parlance.plans.store import Log, ReplyStore

DOCS = "run_id string, source_index int, kind string, content string"
SEEDS = "run_id string, ord int, source string, target string, notes string"


def counting(folder, fail_at=None):
    def translator(kind, body, terms):
        os.makedirs(folder, exist_ok=True)
        if fail_at is not None and len(terms) == fail_at:
            raise RuntimeError("the machine is gone")
        with open(f"{folder}/calls", "a") as f:
            f.write(f"t {len(terms)}\n")
        said = f"{len(terms)} terms"
        return (said if isinstance(body, str) else {k: said for k, _ in body}), [(f"n{len(terms)}", "x", None)]

    def editor(kind, source, translation, terms):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"e {len(terms)}\n")
        return ("" if isinstance(translation, str) else {}), [("low", f"saw {len(terms)}")]

    return translator, editor


def calls(folder):
    with open(f"{folder}/calls") as f:
        return sorted(f.read().split("\n")[:-1])


@pytest.fixture
def docs(spark):
    rows = [("a", i, "markdown", f"# t{i}\n\nbody {i}") for i in range(4)] + [("j", 0, "json", '{"k": "v"}')]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0, "Seed", "s", None)], SEEDS)


def test_one_call_for_each_part(spark, docs, tmp_path):
    folder = str(tmp_path / "c")
    made = parts.run(docs[0], *counting(folder), docs[1])
    for _ in range(2):
        assert {(r.run_id, r.source_index): r.content for r in made.documents.collect()}["a", 2] == "3 terms"
        assert sorted({(r.run_id, r.description) for r in made.issues().collect()}) == [("a", "saw 5"), ("j", "saw 1")]
        assert made.terms.count() == 6 and made.files().count() == 12
    assert calls(folder) == ["e 1", *["e 5"] * 4, "t 0", "t 1", "t 2", "t 3", "t 4"]


def test_a_killed_run_goes_on_where_it_was(spark, docs, tmp_path):
    folder, store = str(tmp_path / "c"), ReplyStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="the machine is gone"):
        parts.run(docs[0].where("run_id = 'a'"), *counting(folder, fail_at=3), docs[1], store=store)
    before = calls(folder)
    assert before == ["t 1", "t 2"]
    translator, editor = counting(folder)
    first = parts.run(docs[0], translator, editor, docs[1], store=store)
    assert calls(folder) == sorted([*before, "t 3", "t 4", "t 0", *["e 5"] * 4, "e 1"])
    again = parts.run(docs[0], translator, editor, docs[1], store=store)
    assert len(calls(folder)) == 10  # nothing is left to ask
    assert sorted(map(str, again.documents.collect())) == sorted(map(str, first.documents.collect()))
    parts.run(docs[0], translator, editor, docs[1], store=store, settings="fr")
    assert len(calls(folder)) == 20  # other settings, other replies
    more = docs[0].unionByName(spark.createDataFrame([("a", 9, "markdown", "# new\n\nlast")], DOCS))
    parts.run(more, translator, editor, docs[1], store=store)
    assert len(calls(folder)) == 20 + 1 + 5  # one new part; its term is in the glossary that all reviews of the run see


def test_equal_parts_of_two_runs_share_a_reply(spark, tmp_path):
    folder, store = str(tmp_path / "c"), ReplyStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(r, 0, "text", "same") for r in "xyz"] + [("n", 0, "text", None)], DOCS)
    seeds = spark.createDataFrame([], SEEDS)
    made = parts.run(docs, *counting(folder), seeds, store=store)
    assert made.documents.count() == 3 and sum(c.startswith("e") for c in calls(folder)) == 1
    assert parts.run(docs.limit(0), *counting(folder), seeds, store=store).documents.count() == 0


def test_plans_of_paged_documents(spark):
    rows = [("r", 0, "pdf", i) for i in range(3)] + [("r", 1, "pdf", 0), ("s", 0, "pdf", 0)]
    made = spark.createDataFrame([(r, s, k, i) for r, s, k, i in rows], "run_id string, source_index int, kind string, part_index int")
    ranges = spark.createDataFrame([("r", 0, "outline"), ("r", 0, "outline"), ("r", 1, "windows"), ("s", 0, "toc")], "run_id string, source_index int, plan string")
    assert {tuple(r) for r in parts.part_sources(made, ranges).collect()} == {("r", "multi-document:outline+headings,windows"), ("s", "toc")}


def test_files_and_glossaries_do_not_grow_with_each_part(spark, tmp_path):
    def brief(kind, body, terms):
        return "t", [(f"n{len(terms)} {'x' * 1000}", "x", None)]

    def editor(kind, source, translation, terms):
        return "", [("low", str(len(terms)))]

    root, n = tmp_path / "store", 60
    docs = spark.createDataFrame([(f"r{i % 3}", i, "text", f"body {i}") for i in range(3 * n)], DOCS)
    for _ in range(2):
        made = parts.run(docs, brief, editor, spark.createDataFrame([], SEEDS), store=ReplyStore(spark, str(root)))
        assert {r.description for r in made.issues().collect()} == {str(n)}
    files = [f for stage in ("translations", "reviews") for f in (root / stage).rglob("*.json")]
    assert 2 <= len(files) < n  # not one a reply
    assert sum(f.stat().st_size for f in files) < 2 * 3 * n * 1600  # replies alone, without the glossary of 60 KB before each
    assert len(list((root / "glossaries").rglob("*.json"))) == 1  # the runs end with equal ones


def test_replies_of_a_lost_attempt(tmp_path):
    uri = f"file://{tmp_path}/log"
    for attempt in (7, 8):
        with Log(uri, 1, attempt) as log:
            assert log.get("p", "g") == (["a"] if attempt == 8 else None) and log.get("q", "g") is None
            log.put("p", "g", ["a"])
            log.out.write(b'{"part_key": "q", "prior_k')  # it dies here
    assert Log(uri, 2, 9).get("p", "g") is None


def test_glossaries_are_not_copied_for_each_part(spark):
    def told(kind, body, terms):
        return f"{id(terms.terms)} {len(terms)} {','.join(t[0] for t in terms)}", [(f"n{len(terms)}", "x", None)]

    docs = spark.createDataFrame([("r", i, "text", f"body {i}") for i in range(5)], DOCS)
    rows = parts.translate(parts.make_parts(docs), told, spark.createDataFrame([], SEEDS)).orderBy("part_index").collect()
    assert len({r.translation.split(" ")[0] for r in rows}) == 1
    assert [r.translation.split(" ", 1)[1] for r in rows] == [f"{i} {','.join(f'n{k}' for k in range(i))}" for i in range(5)]


def test_a_glossary_stays_as_it_was():
    terms = [("a", "b", None)]
    seen = parts.Glossary(terms)
    terms.append(("c", "d", None))
    assert seen == [("a", "b", None)] and seen[-1] == seen[0] and seen[:5] == [("a", "b", None)] and len(seen) == 1
    with pytest.raises(IndexError):
        seen[1]


def test_nested_columns_there_and_back():
    rows = [[("a", "b"), ("c", None)], None, [], [("d", "é")]]
    column = parts._nested(rows, parts.ARROW_PAIRS)
    assert column.type == parts.ARROW_PAIRS and parts._listed(column, "translation") == rows
    assert parts._listed(column.slice(1, 2), "translation") == rows[1:3] and parts._nested([None], parts.ARROW_PAIRS).to_pylist() == [None]
