import json

import pytest
from pyspark.sql import functions as F

from parlance.plans import prepare

RUNS = "run_id string, target string, output_path string"


def outputs(spark, sources, runs):
    return prepare.run_outputs(spark.createDataFrame(sources, "run_id string, ord int, path string"), spark.createDataFrame(runs, RUNS))


def test_outputs(spark):
    sources = [("a", 1, "x/d.md"), ("b", 1, "x/d.md"), ("b", 2, "y/d.md"), ("b", 3, "x/d.md"), ("b", 4, "e.md"), ("b", 5, None), ("c", 1, "s.srt"), ("z", 1, "q.md")]
    got = {(r.run_id, r.path): (r.source_index, r.kind, r.output_path, r.cache) for r in outputs(spark, sources, [("a", "pt BR", None), ("b", "fr", "out/"), ("c", "fr", "s2.srt"), ("none", "fr", None)]).collect()}
    assert got == {
        ("a", "x/d.md"): (0, "markdown", "translation/a/d.pt-br.md", None),
        ("b", "x/d.md"): (0, "markdown", "out/doc-001-d.fr.md", "doc-001-d"),
        ("b", "y/d.md"): (1, "markdown", "out/doc-002-d.fr.md", "doc-002-d"),
        ("b", "e.md"): (2, "markdown", "out/e.fr.md", "doc-003-e"),
        ("c", "s.srt"): (0, "srt", "s2.srt", None),
    }
    assert outputs(spark, [], [("a", "fr", None)]).count() == 0


def test_mixed_kinds_fail(spark):
    with pytest.raises(Exception, match="different kinds in run a"):
        outputs(spark, [("a", 1, "x.md"), ("a", 2, "x.srt")], [("a", "fr", None)]).collect()


def test_style_guide(spark):
    rows = spark.createDataFrame([(" a ", "b\n"), (None, "b"), ("", None)], "i string, f string").select(prepare.style_guide(F.col("i"), F.col("f")).alias("s")).collect()
    assert [r.s for r in rows] == ["a\n\nb", "b", ""]


def test_report_files(spark):
    out = outputs(spark, [("a", 1, "d.md")], [("a", "fr", None)])
    runs = spark.createDataFrame([("a", "fr", None, "headings", False), ("b", "de", "en", "single-part", True)], "run_id string, target string, source_language string, part_source string, skip_editor boolean")
    parts = spark.createDataFrame([("a", 2, 0, None, None, None, None, None), ("a", 1, 0, "t", 1, 3, None, 4)], "run_id string, part_index int, source_index int, title string, start_page int, end_page int, entry_count int, cue_count int")
    terms = spark.createDataFrame([("a",), ("a",)], "run_id string")
    issues = spark.createDataFrame([("a", 1, "low", "é")], "run_id string, part_index int, severity string, description string")
    got = {r.run_id: json.loads(r.content) for r in prepare.report_files(runs, out, parts, terms, issues).collect()}
    a, b = got["a"], got["b"]
    assert (a["partCount"], a["documentCount"], a["glossaryTermCount"], a["sourceLanguage"], a["kind"]) == (2, 1, 2, None, "markdown")
    assert a["outputs"] == [{"sourcePath": "d.md", "outputPath": "translation/a/d.fr.md"}] and a["issues"] == [{"partIndex": 1, "severity": "low", "description": "é"}]
    assert a["parts"][0] == {"index": 1, "sourceIndex": 0, "title": "t", "startPage": 1, "endPage": 3, "entryCount": None, "cueCount": 4} and a["parts"][1]["title"] is None
    assert (b["partCount"], b["parts"], b["issues"], b["kind"], b["glossaryTermCount"], b["skipEditor"]) == (0, [], [], None, 0, True)
