"""Folders localized from end to end, and agents over a model that is a function."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parlance.plans import agents, project, prompts, samples
from parlance.plans.store import ReplyStore


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import tests


def model(prompt):
    """A stand-in for a language model: shouts, and names the first word as a term."""
    review = "Review the translation" in prompt
    word = "correctedTranslation" if review else "translation"
    body = prompt.split("=== TRANSLATION ===\n" if "=== TRANSLATION" in prompt else "=== SOURCE ===\n")[1].split("\n=== END OF")[0]
    extra = {"issues": [{"severity": "low", "description": f"{prompt.count('- ')} terms"}]} if review else {"newTerms": [{"source": body.strip("#[{ ").split()[0], "target": "x"}]}
    if body.startswith("["):
        rows = json.loads(body)
        key = "id" if "id" in rows[0] else "pointer"
        return json.dumps({("cues" if key == "id" else "entries"): [{key: r[key], word: (r.get("translation") or r.get("text") or r.get("value")).upper()} for r in rows]} | extra)
    return json.dumps({word: body.upper()} | extra)


def make(style):
    return agents.ModelTranslator(model, "fr", style=style), agents.ModelEditor(model, "fr", style=style)


def write(root, files):
    for path, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def read(root, path):
    with open(f"{root}/{path}", encoding="utf-8") as f:
        return f.read()


def test_subtitles_with_glossary_and_style(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"docs/b.srt": "1\n00:01 --> 00:02\nhi there\n", "docs/A.srt": "1\n00:01 --> 00:02\nbye\n", "glossary.csv": "source,target\nhi,salut\n", "style.md": "Be brief.", "other.json": "{}", "node_modules/x.srt": "no"})
    got = project.localize_project(spark, root, "fr", make, style="Own words.", store=ReplyStore(spark, f"{root}/.store"))
    assert got.notes == ["other_kinds_left_out"]
    assert read(root, "translation/run/b.fr.srt") == "1\n00:01 --> 00:02\nHI THERE\n" and read(root, "translation/run/A.fr.srt") == "1\n00:01 --> 00:02\nBYE\n"
    report = json.loads(read(root, "translation/run/report.json"))
    assert report["sourcePaths"] == ["docs/A.srt", "docs/b.srt"] and report["partSource"] == "multi-document:subtitle-cues" and report["partCount"] == 2 and report["parts"][0]["cueCount"] == 1
    terms = json.loads(read(root, "translation/run/glossary.json"))["terms"]
    assert terms[0] == {"source": "hi", "target": "salut", "origin": "seed"} and report["glossaryTermCount"] == len(terms) == 2
    assert {r.path for r in got.written.collect()} == {f"translation/run/{n}" for n in ("b.fr.srt", "A.fr.srt", "glossary.json", "report.json")}


@pytest.mark.parametrize("kind,name", [("pdf", "a.pdf"), ("rtf", "a.rtf"), ("markdown", "a.md")])
def test_one_document(spark, tmp_path, kind, name):
    root = str(tmp_path)
    content = samples.pdf_document([["one"], ["two"], ["three"], ["four"]], [("first", 1), ("second", 3)]) if kind == "pdf" else samples.rtf_document("x") if kind == "rtf" else "# one\n\ntwo"
    write(root, {f"in/{name}": content})
    got = project.localize_project(spark, root, "fr", make, folder="in", output_path="out/a.md")
    want = {"pdf": "ONE\n\nTWO\n\nTHREE\n\nFOUR", "markdown": "# ONE\n\nTWO"}.get(kind)
    assert read(root, "out/a.md") == want if want else read(root, "out/a.md").startswith("## ABOUT X\n\nHELLO")
    assert json.loads(read(root, "translation/run/report.json"))["partSource"] == {"pdf": "outline", "rtf": "office-single-part", "markdown": "single-part"}[kind]
    assert read(root, "translation/run/reviewed/part-001.md") == read(root, "translation/run/translated/part-001.md") and got.notes[0] == "no_glossary"


def test_missing_and_empty(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a/x.md": "x", "x.md": "x"})
    sources = lambda *p: spark.createDataFrame([(n,) for n in p], "path string")
    assert project.require_sources(spark, root, sources("a/x.md", "x.md")).count() == 2
    with pytest.raises(FileNotFoundError, match="a/y.md"):
        project.require_sources(spark, root, sources("a/x.md", "a/y.md"))
    os.makedirs(f"{root}/none")
    with pytest.raises(ValueError, match="no source documents"):
        project.localize_project(spark, root, "fr", make, folder="none")


def test_prompts_are_those_of_the_columns(spark):
    seen = []
    agents.ModelTranslator(lambda p: seen.append(p) or '{"translation": "t"}', "fr", "en", "Brief.")("markdown", "body", [("a", "b", "n"), ("c", "d", None)])
    agents.ModelEditor(lambda p: seen.append(p) or '{"correctedTranslation": "t"}', "fr")("text", "body", "done", [])
    head = agents.header("fr", "en", "Brief.", [("a", "b", "n"), ("c", "d", None)])
    assert head == "Target language: fr\nSource language: en\nStyle guide:\nBrief.\nGlossary:\n- a => b — n\n- c => d"
    row = spark.range(1).select(
        prompts.translation_prompt("text", "fr", F.lit(head), F.lit("body")).alias("t"), prompts.review_prompt("text", "fr", F.lit(agents.header("fr", None, "", [])), F.lit("body"), F.lit("done")).alias("r")
    ).first()
    assert seen == [row.t, row.r]


def test_replies():
    said = ["no JSON", "[]", '{"translation": 1}', '{"translation": "x", "newTerms": [{"source": "a"}]}', '{"translation": "x", "newTerms": [{"source": "a", "target": "b", "notes": 5}]}']
    prompts_ = []
    got = agents.ModelTranslator(lambda p: prompts_.append(p) or said[len(prompts_) - 1], "fr")("pdf", "b", [])
    assert got == ("x", [("a", "b", None)]) and "not valid: newTerms need source and target" in prompts_[4] and "not valid" not in prompts_[0]
    with pytest.raises(agents.NoReply):
        agents.ModelTranslator(lambda p: "{}", "fr")("text", "b", [])
    two = '{"entries": [{"pointer": "/a", "correctedTranslation": "1"}, {"pointer": "/a", "correctedTranslation": "2"}], "issues": [{"severity": "%s", "description": "d"}]}'
    assert agents.ModelEditor(lambda p: two % "high", "fr")("json", [("/a", "s")], [("/a", "t")], []) == ({"/a": "2"}, [("high", "d")])
    with pytest.raises(agents.NoReply):
        agents.ModelEditor(lambda p: two % "worst", "fr")("json", [("/a", "s")], [("/a", "t")], [])
