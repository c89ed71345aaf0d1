import json

import pytest
from pyspark.sql import functions as F

from parlance.operators import ranges
from parlance.plans import localize, prompts, replies
from parlance.sources import files, sinks


def test_paths_stay_inside():
    assert files.contained("/a/./b/../c.md") == "a/c.md" and files.contained("") == "."
    with pytest.raises(ValueError):
        files.contained("a/../../b")


def test_write_list_read(spark, tmp_path):
    root = str(tmp_path / "work")
    docs = spark.createDataFrame([("a [1].md", "é\n"), ("sub/b.pdf", "x"), (".git/c", "x"), ("sub/.d", None)], "path string, content string")
    assert {r.path: r.length for r in sinks.write_documents(docs, root).collect()} == {"a [1].md": 3, "sub/b.pdf": 1, ".git/c": 1, "sub/.d": 0}
    got = {r.path: (r.type, r.length, r.reason) for r in files.list_tree(spark, root).collect() if not r.path.endswith(".crc")}
    assert got == {"a [1].md": ("file", 3, None), "sub": ("directory", None, None), "sub/b.pdf": ("file", 1, None), ".git": ("directory", None, "skipped folder"), "sub/.d": ("file", 0, "hidden file")}
    read = {r.path: (r.kind, r.length, r.content) for r in files.read_documents(spark, root, ["a [1].md", "sub/b.pdf"]).collect()}
    assert read == {"a [1].md": ("markdown", 3, "é\n"), "sub/b.pdf": ("pdf", 1, None)}
    assert files.exists(spark, root, "sub", folder=True) and not files.exists(spark, root, "sub")
    assert files.read_bytes(spark, root, []).count() == 0
    with pytest.raises(FileNotFoundError):
        files.require(spark, root, "none.md", "source")
    with pytest.raises(ValueError):
        files.read_bytes(spark, root, ["_x.md"])
    assert "unreadable" in files.list_tree(spark, root, "nowhere").first().reason


def test_canonical_glossary(spark):
    rows = [(1, 0, 'a"b\\', "é\n", None, "seed"), (1, 1, "c", "d", "n", "translator")]
    terms = spark.createDataFrame(rows, "path int, ord int, source string, target string, notes string, origin string")
    made = sinks.canonical_glossaries(terms, "path")
    wanted = {"terms": [{"source": 'a"b\\', "target": "é\n", "origin": "seed"}, {"source": "c", "target": "d", "notes": "n", "origin": "translator"}]}
    assert made.first().content == json.dumps(wanted, indent=2, ensure_ascii=False) + "\n"
    assert [tuple(r) for r in files.canonical_terms(made).orderBy("ord").collect()] == rows
    assert files.canonical_terms(spark.createDataFrame([("x", sinks.EMPTY_GLOSSARY)], "path string, content string")).count() == 0
    with pytest.raises(Exception, match="not a canonical glossary"):
        files.canonical_terms(spark.createDataFrame([("x", '{"terms": 5}')], "path string, content string")).collect()


def test_page_selection(spark):
    pages = spark.createDataFrame([(d, p) for d, n in ((1, 5), (2, 2)) for p in range(1, n + 1)], "doc_id int, page_no int")
    chosen = lambda **k: sorted((r.doc_id, r.page_no) for r in ranges.select_pages(pages, **k).collect())
    assert chosen(wanted=[9, 2, 2]) == [(1, 2), (2, 2)] and chosen(wanted=[]) == []
    assert chosen(first=1) == [(1, 1), (2, 1)] and chosen(last=3) == [(1, 3), (1, 4), (1, 5), (2, 1), (2, 2)]
    assert chosen(first=2, last=3) == [(1, 2), (1, 3), (2, 2)] and len(chosen()) == 7


def test_replies(spark):
    def parsed(raw, shape):
        r = spark.createDataFrame([(raw,)], "raw string").select(replies.parse_reply(F.col("raw"), shape).alias("r")).first().r
        return r and r.asDict(recursive=True)

    assert parsed('{"translation": "x"}', "text_translation") == {"translation": "x", "newTerms": []}
    assert parsed('{"cues": [{"id": "1", "translation": "y"}], "newTerms": [{"source": "a", "target": "b"}]}', "cue_translation") == {"cues": [{"id": "1", "translation": "y"}], "newTerms": [{"source": "a", "target": "b", "notes": None}]}
    assert parsed('{"entries": [], "issues": [{"severity": "low", "description": "d"}]}', "entry_review") == {"entries": [], "issues": [{"severity": "low", "description": "d"}]}
    for raw in (None, "no json", "{}", '{"correctedTranslation": "x", "issues": [{"severity": "dire", "description": "d"}]}'):
        assert parsed(raw, "text_review") is None
    assert parsed('{"entries": [{"pointer": "/a"}]}', "entry_translation") is None


def test_review(spark):
    def editor(source, translation, terms):
        return ("" if source == "b" else translation + str(len(terms))), ([("low", "d")] if source == "a" else [])

    parts = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, "b", "B"), (2, 1, "c", "C")], "run_id int, part_index int, content string, translation string")
    terms = spark.createDataFrame([(1, 0, "s", "t", None)], "run_id int, ord int, source string, target string, notes string")
    reviewed = localize.review_parts(parts, terms, editor)
    assert {(r.run_id, r.part_index): r.translation for r in reviewed.collect()} == {(1, 1): "A1", (1, 2): "B", (2, 1): "C0"}
    assert [tuple(r) for r in localize.issues_of(reviewed).collect()] == [(1, 1, "low", "d")]
    assert localize.issues_of(localize.review_parts(parts, terms, None)).count() == 0


def test_prompts(spark):
    items = spark.createDataFrame([(1, 2, "/b", "y"), (1, 1, "/a", "x")], "doc_id int, ord int, pointer string, value string")
    body = prompts.entries_json(items, ["doc_id"], "ord", list(prompts.ENTRY_FIELDS["json"]))
    assert json.loads(body.first().body) == [{"pointer": "/a", "value": "x"}, {"pointer": "/b", "value": "y"}]
    got = body.select(prompts.translation_prompt("json", "fr", F.lit("H"), F.col("body")).alias("t"), prompts.review_prompt("text", "fr", F.lit("H"), F.lit("s"), F.lit("t")).alias("r")).first()
    assert got.t.startswith("H\n\nTranslate into fr.") and got.r.endswith("=== TRANSLATION ===\nt\n=== END OF TRANSLATION ===")
