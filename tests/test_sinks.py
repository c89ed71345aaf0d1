"""Documents are computed once, and appear all or none; numbers and paths as their sources and locale have them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from parlance.operators import discover, structured
from parlance.sources import files, sinks


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_documents_are_computed_once(spark, tmp_path):
    counted, root = str(tmp_path / "calls"), str(tmp_path / "out")

    def slow(batches):
        for b in batches:
            with open(counted, "a") as f:
                f.write("x" * len(b))
            yield b

    docs = spark.createDataFrame([(f"d/{i % 7}/{i}.md", f"é {i}") for i in range(40)], "path string, content string").repartition(5).mapInPandas(slow, "path string, content string")
    wrote = sinks.write_documents(docs, root)
    for _ in range(2):
        assert {(r.path, r.length) for r in wrote.collect()} == {(f"d/{i % 7}/{i}.md", len(f"é {i}".encode())) for i in range(40)}
    assert os.path.getsize(counted) == 40 and len(tree(root)) == 40
    assert open(f"{root}/d/3/3.md", encoding="utf-8").read() == "é 3"


@pytest.mark.parametrize("bad", ["../out.md", None])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    root = str(tmp_path / "out")
    sinks.write_documents(spark.createDataFrame([("a.md", "old")], "path string, content string"), root)
    rows = [("a.md", "new"), *((f"{i}.md", "x") for i in range(20)), (bad, "y")]
    with pytest.raises(Exception, match="workspace|without a path"):
        sinks.write_documents(spark.createDataFrame(rows, "path string, content string").repartition(4), root)
    assert tree(root) == ["a.md"] and open(f"{root}/a.md").read() == "old" and os.listdir(root) == ["a.md"]


def test_odd_documents(spark, tmp_path):
    root = str(tmp_path / "out")
    none = spark.createDataFrame([], "path string, content string")
    assert sinks.write_documents(none, root).count() == 0 and os.listdir(root) == []
    twice = spark.createDataFrame([("a", "x"), ("./a", "x"), ("b/../c", None)], "path string, content string")
    assert sorted((r.path, r.length) for r in sinks.write_documents(twice, root).collect()) == [("./a", 1), ("a", 1), ("b/../c", 0)]
    assert tree(root) == ["a", "c"]


def test_numbers_keep_their_spelling(spark):
    raw = '{"b": 1.0, "10": 1e400, "a": [123456789012345678901234567890, -0.0, 1E+5, "t", null, true], "2": {}}'
    want = '{\n  "2": {},\n  "10": 1e400,\n  "b": 1.0,\n  "a": [\n    123456789012345678901234567890,\n    -0.0,\n    1E+5,\n    "T",\n    null,\n    true\n  ]\n}\n'
    assert structured.rebuild_json(raw, {"/a/3": "T"}) == want
    assert structured.rebuild_json("9" * 5000, {}) == "9" * 5000 + "\n" and structured.rebuild_json(want, {}) == want
    assert list(structured.walk_strings(structured.parse_json('[1, "1", 2.5]'))) == [("/1", "1")]
    with pytest.raises(ValueError):
        structured.parse_json("[NaN]")
    assert json.loads(structured.rebuild_json('"x"', {"": "y"})) == "y"


def test_paths_in_the_order_of_the_locale(spark, tmp_path):
    names = ["B.srt", "a.srt", "c.srt", "A.srt", "É.srt", "e.srt", "f.srt", "a-1.srt", "a1.srt"]
    rows = spark.createDataFrame([("p", n) for n in names], "project string, path string")
    got = discover.discover_projects(rows.select("project"), rows).first().source_paths
    assert got == ["a-1.srt", "a.srt", "A.srt", "a1.srt", "B.srt", "c.srt", "e.srt", "É.srt", "f.srt"]
    some = spark.createDataFrame([("p", n) for n in ("Z terms.md", "b terms.md", "a/glossary.csv", "B/glossary.csv")], "project string, path string")
    assert discover.pick_preferred(some, discover.GLOSSARY_NAMES).first().path == "B/glossary.csv"
    assert discover.pick_preferred(some.where("path like '%terms%'"), discover.GLOSSARY_NAMES).first().path == "b terms.md"
    for n in ("b.md", "A.md", "a.md"):
        (tmp_path / n).write_text("x")
    assert [r.path for r in files.list_tree(spark, str(tmp_path)).collect()] == ["a.md", "A.md", "b.md"]
    assert spark.createDataFrame([("x",)], "p string").select(discover.in_locale(F.col("p"))).count() == 1
