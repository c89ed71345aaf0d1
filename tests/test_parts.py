"""Runs of all kinds through parts, translation, review and assembly; contents pages; odd tables."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import discover, glossary, ranges, subtitles
from parlance.plans import parts

DOCS = "run_id string, source_index int, kind string, content string"


def test_runs_of_mixed_sources(spark):
    def silent(kind, body, terms):
        return ("" if isinstance(body, str) else {}), []

    def numbered(kind, body, terms):
        said = f"{len(terms)}:{','.join(t[0] for t in terms)}"
        return (said if isinstance(body, str) else {k: said for k, _ in body}), [("Word", "w", None), (f"n{len(terms)}", "x", "note")]

    rows = [
        ("t", 0, "text", "**bold** one"), ("t", 1, "text", None), ("t", 2, "markdown", "# two\n\nbody"), ("h", 0, "html", "<p title=\"a\">x</p>"), ("j", 0, "json", '{"k": "v"}'),
        ("s", 0, "srt", "1\n00:01 --> 00:02\nhi\n"), ("s", 1, "ass", "[Events]\nDialogue: 0,1,2,D,n,0,0,0,e,hi"), ("empty", 0, "json", "{}"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    made = parts.make_parts(docs)
    assert sorted((r.run_id, r.source_index, r.part_index) for r in made.collect()) == [("h", 0, 1), ("j", 0, 1), ("s", 0, 1), ("s", 1, 2), ("t", 0, 1), ("t", 2, 2)]
    same = {(r.run_id, r.source_index): r.content for r in parts.assemble(docs, parts.review(parts.translate(made, silent), None)).collect()}
    assert same == {
        ("t", 0): "bold one", ("t", 2): "# two\n\nbody", ("h", 0): '<p title="a">x</p>', ("j", 0): '{\n  "k": "v"\n}\n', ("s", 0): "1\n00:01 --> 00:02\nhi\n", ("s", 1): rows[6][3], ("empty", 0): "{}\n"
    }
    seeds = spark.createDataFrame([("t", 0, "word", "s", None)], "run_id string, ord int, source string, target string, notes string")
    told = parts.translate(made, numbered, seeds)
    assert {(r.run_id, r.part_index): r.translation for r in told.where("translation is not null").collect()} == {("t", 1): "1:word", ("t", 2): "2:word,n1"}
    final = {(r.run_id, r.source, r.origin) for r in parts.proposed_terms(told, seeds).collect()}
    assert final == {("t", "word", "seed"), ("t", "n1", "translator"), ("t", "n2", "translator")} | {(r, "Word", "translator") for r in "hjs"} | {(r, "n0", "translator") for r in "hjs"} | {("s", "n2", "translator")}
    assert parts.make_parts(docs.limit(0)).count() == 0


def test_two_replies_for_one_cue(spark):
    docs = spark.createDataFrame([(1, "1\n00:01 --> 00:02\nhi\n")], "doc_id long, raw string")
    replies = spark.createDataFrame([(1, "cue-1", "a", 0), (1, "cue-1", "b", 1), (1, None, "c", 2), (1, "cue-9", "d", 3)], "doc_id long, cue string, translation string, ord int")
    assert subtitles.rebuild_srt(docs, replies).first().raw == "1\n00:01 --> 00:02\nb\n"


def test_contents_that_do_not_fit(spark):
    page = lambda *titles: "\n".join(f"{t} .... {n}" for t, n in titles)
    rows = [
        (1, 1, page(("Alpha", 1), ("Beta", 3))), (1, 3, "alpha"), (1, 5, "beta"),  # two entries are no table
        (2, 1, page(("Alpha", 1), ("Beta", 3), ("Gamma", 5), ("alpha", 9))), (2, 3, "ALPHA"), (2, 5, "beta"), (2, 7, "other"),  # two of three confirmed
        (3, 1, page(("Alpha", 1), ("Beta", 3), ("Gamma", 5))), (3, 3, "alpha"), (3, 5, "x"), (3, 7, "y"),  # one of three
        (4, 1, None), (5, 1, page(("Alpha", 1), ("Beta", 30), ("Gamma", 50))), (5, 2, "alpha"),  # one start inside the document
    ]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    totals = spark.createDataFrame([(d, 8) for d in range(1, 6)], "doc_id long, total_pages int")
    got = sorted((r.doc_id, r.title, r.start_page) for r in ranges.find_toc_starts(pages, totals).collect())
    assert got == [(2, "Alpha", 3), (2, "Beta", 5), (2, "Gamma", 7)]


@pytest.mark.parametrize("count,n", [(8, 8), (8, 9), (8, 17), (3, 100), (1, 5)])
def test_even_samples(spark, count, n):
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"))
    got = sorted(r.ord for r in ranges.sample_evenly(rows, count, ["ord"]).collect())
    assert got == (list(range(n)) if n <= count else [int(i * (n / count)) for i in range(count)])


def test_no_projects_and_no_terms(spark):
    none = spark.createDataFrame([], "project string, path string")
    assert discover.discover_projects(none, none).count() == 0
    terms = spark.createDataFrame([], "path string, ord int, source string, target string, notes string, origin string")
    added = spark.createDataFrame([("a", 0, "x", "y", None)], "path string, ord int, source string, target string, notes string")
    assert [tuple(r) for r in glossary.append_terms(terms, added, "path").collect()] == [("a", 0, "x", "y", None, "translator")]
    assert glossary.append_terms(terms, added.limit(0), "path").count() == 0


@pytest.mark.parametrize("made", [parts.text_parts, parts.entry_parts])
def test_documents_of_one_file_are_dealt_before_the_work(spark, made):
    docs = spark.createDataFrame([("h", i, "html", f"<p>{i}</p>") for i in range(8)], DOCS).coalesce(1)
    plan = made(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= plan.count("MapInArrow") > 0 and "Join" not in plan
