import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import chunk, discover, glossary, pack, ranges, structured, subtitles
from parlance.plans import localize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.js_trim(F.lit(" ﻿ a b  \n"))) == "a b"
    assert one(spark, T.utf16_length(F.lit("😀a"))) == 3
    assert one(spark, T.pad_index(F.lit(1234))) == "1234"
    assert one(spark, T.pointer_encode(F.lit("a/b~c"))) == "a~1b~0c"
    assert one(spark, T.language_slug(F.lit(" Português (BR) "))) == "portugu-s-br"
    assert one(spark, T.strip_markdown(F.lit("# T\n**b** and *i* [l](u)\n\n\n\n> q"))) == "T\nb and i l\nq"
    assert one(spark, T.detect_kind(F.lit("a/b.HTM"))) == "html"
    assert one(spark, T.detect_kind(F.lit("README"))) == "text" and one(spark, T.extension_of(F.lit("a.b/.json"))) == ""
    assert one(spark, T.strip_markdown(F.lit("a ```x\nb``` c\n   > q\n```\nd\n```"))) == "a ``x\nb`` c\nq\nd"


def greedy(costs, budget, cap=None):
    bins, total, size, k = [], 0, 0, 0
    for c in costs:
        if size and (total + c > budget or cap and size >= cap):
            total, size, k = 0, 0, k + 1
        total, size = total + c, size + 1
        bins.append(k)
    return bins


def test_fill_bins_is_the_greedy_walk():
    rng = random.Random(5)
    for _ in range(300):
        costs = [rng.randint(0, 30) for _ in range(rng.randint(0, 40))]
        budget, cap = rng.randint(1, 60), rng.choice([None, 1, 3])
        assert pack.fill_bins(np.array(costs, dtype=np.int64), budget, cap).tolist() == greedy(costs, budget, cap)


def test_chunking():
    assert chunk.chunk_text(" \n", 10) == []
    assert chunk.chunk_text(" a ", 10) == [(None, "a")]
    text = "pre\n# One\n" + "a" * 30 + "\n## Two\n" + "b" * 30 + "\n```\n# no\n```\n"
    parts = chunk.chunk_text(text, 60)
    assert [t for t, _ in parts] == ["One", "Two"] and parts[0][1].startswith("pre\n\n# One")
    long = "x" * 50
    assert chunk.chunk_text(f"{long}\ny\n{long}", 20) == [(None, long), (None, "y"), (None, long)]
    rng = random.Random(1)
    for _ in range(100):
        doc = "\n".join(rng.choice(["", "w" * rng.randint(1, 40), "# h", "### deep", "```"]) for _ in range(40))
        got = "".join(c for _, c in chunk.chunk_text(doc, 80))
        assert "".join(got.split()) == "".join(doc.split())


def test_json_round_trip(spark):
    raw = '{"b":"x","2":"two","1":"one","l":[" ",{"k/":"v"}],"n":1}'
    assert list(structured.walk_strings(json.loads(raw))) == [("/1", "one"), ("/2", "two"), ("/b", "x"), ("/l/1/k~1", "v")]
    assert json.loads(structured.rebuild_json(raw, {})) == json.loads(raw)
    assert json.loads(structured.rebuild_json(raw, {"/l/1/k~1": "V"}))["l"][1]["k/"] == "V"
    assert list(structured.walk_strings("root")) == [("", "root")]


def test_html():
    raw = '<p title="a &amp; b">x &copy; y</i>z<br><script>no</script><img alt=cat><meta name="description" content=\'d\'><code title="n">c</code> </p>tail'
    got = structured.walk_html(raw)
    assert got == [("a-1", "a & b"), ("t-1", "x © yz"), ("a-2", "cat"), ("a-3", "d"), ("t-2", "tail")]
    assert structured.rebuild_html(raw, {}) == raw
    assert 'title="q &quot;&amp;"' in structured.rebuild_html(raw, {"a-1": 'q "&'})
    assert "alt=two&#32;&quot;words&#39;>" in structured.rebuild_html(raw, {"a-2": "two \"words'"})
    assert structured.walk_html("<meta name=' description ' content=x>") == [("a-1", "x")]


def test_deep_bundles_and_odd_replies(spark):
    deep = '{"a":' * 3000 + '["x", null, {}]' + "}" * 3000
    pointer, value = next(structured.walk_strings(json.loads(deep)))
    built = structured.rebuild_json(deep, {pointer: "y"})
    assert value == "x" and built.count("{") == 3001 and '"y"' in built
    raw = '{"a": "x", "b": [], "c": {}, "d": null, "e": [1.5, true, ["é"]], "": "k"}'
    assert structured.rebuild_json(raw, {}) == json.dumps(json.loads(raw), ensure_ascii=False, indent=2) + "\n"
    docs = spark.createDataFrame([(1, '{"a": "x"}'), (2, None)], "doc_id long, raw string")
    odd = spark.createDataFrame([(1, None, "t", 1), (1, "/a", None, 2), (1, "/a", "y", 0)], "doc_id long, pointer string, translation string, ord int")
    assert {r.doc_id: r.raw for r in structured.rebuild_json_docs(docs, odd).collect()} == {1: '{\n  "a": "y"\n}\n', 2: None}


def test_srt(spark):
    raw = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\nyou\r\n\r\nnote\r\n\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nbye\r\n"
    docs = spark.createDataFrame([(1, raw)], "doc_id long, raw string")
    cues = subtitles.srt_cues(docs)
    assert [(r.cue, r.text, r.start) for r in cues.orderBy("ord").collect()] == [("cue-1", "hi\nyou", "00:00:01,000"), ("cue-3", "bye", "00:00:05,000")]
    built = subtitles.rebuild_srt(docs, spark.createDataFrame([(1, "cue-3", "tschüss")], "doc_id long, cue string, translation string")).first().raw
    assert built.endswith("tschüss\r\n") and "\r\nnote\r\n" in built and "2\r\n00:00:03" in built


def test_ass(spark):
    raw = "[Script Info]\nDialogue: no\n[Events]\nFormat: Start, Text\nDialogue: 0:01,a, b{\\i1}\nDialogue: 0:02,{\\p1}m 0\nComment: 0:03,c"
    docs = spark.createDataFrame([(1, raw)], "doc_id long, raw string")
    assert [(r.cue, r.text, r.start) for r in subtitles.ass_cues(docs).collect()] == [("line-4", "a, b{\\i1}", "0:01")]
    built = subtitles.rebuild_ass(docs, spark.createDataFrame([(1, "line-4", "x\ny")], "doc_id long, cue string, translation string")).first().raw
    assert built.split("\n")[4] == "Dialogue: 0:01,x\\Ny" and built.split("\n")[5:] == raw.split("\n")[5:]


def test_glossary(spark):
    assert glossary.parse_csv('Term;Translation;Notes\n"a ""q""";b;c\n# x\nd,e') == [('a "q"', "b", "c"), ("d", "e", None)]
    assert glossary.parse_csv("source;other\na;b") == []
    assert glossary.parse_text("- a -> b\n# c: d\ne = f: g\nnone") == [("a", "b", None), ("e", "f: g", None)]
    assert glossary.parse_markdown("| term | translation |\n|---|:--|\n| a | b |\n- c: d") == [("a", "b", None), ("c", "d", None)]
    assert glossary.parse_csv("a;b\x85c\x0cd;e") == [("a", "b\x85c\x0cd", "e")] and glossary.parse_markdown("|||a|b|\n||c|d|") == []
    assert glossary.parse_json('{"terms":[{"src":"a","to":"b"},{"src":" ","to":"c"}]}') == [("a", "b", None)]
    rows = [(1, 0, "A", "x", None, "translator"), (1, 1, "b", "y", None, "translator"), (1, 2, "a ", "z", None, "seed")]
    terms = spark.createDataFrame(rows, "run_id long, ord long, source string, target string, notes string, origin string")
    assert [(r.ord, r.target) for r in glossary.merge_terms(terms, ["run_id"]).orderBy("ord").collect()] == [(0, "z"), (1, "y")]


def test_ranges(spark):
    rows = [(1, "a", 1, 1), (1, "b", 2, 5), (1, "c", 6, 6), (2, "a", 1, 5), (2, "b", 6, 6), (3, None, 1, 1)]
    parts = spark.createDataFrame(rows, "doc_id long, title string, start_page int, end_page int")
    fold = lambda least, most: sorted((tuple(r) for r in ranges.merge_undersized(parts, least, most).collect()), key=str)
    assert fold(2, 6) == [(1, "a", 1, 6), (2, "a", 1, 6), (3, None, 1, 1)] and fold(2, 4) == [(1, "a", 1, 1), (1, "b", 2, 5), (1, "c", 6, 6), (2, "a", 1, 5), (2, "b", 6, 6), (3, None, 1, 1)]
    starts = spark.createDataFrame([(1, 0, "x", 3, 10), (1, 1, "y", 3, 10), (1, 2, "z", 99, 10)], "doc_id long, ord long, title string, start_page long, total_pages long")
    got = [(r.title, r.start_page, r.end_page) for r in ranges.ranges_from_starts(starts).orderBy("start_page").collect()]
    assert got == [("Front matter", 1, 2), ("x", 3, 9), ("z", 10, 10)]
    pages = spark.createDataFrame([(1, 1, "Intro ..... 1\nThe Long Way Home .... 4\nbad 3"), (1, 3, "Intro"), (1, 6, "the long way home")], "doc_id long, page_no int, text string")
    toc = ranges.toc_candidates(pages)
    assert [(r.title, r.printed_page) for r in toc.orderBy("ord").collect()] == [("Intro", 1), ("The Long Way Home", 4)]
    assert ranges.page_offset(toc, pages).first().page_offset == 2


def test_discover(spark):
    files = spark.createDataFrame([("p", x) for x in ("glossary.csv", "style.md", "a.srt", "b.srt", "c.html", ".git/x", "node_modules/y.md")], "project string, path string")
    got = {r.path: r.role for r in discover.classify_files(files).collect()}
    assert got["glossary.csv"] == "glossary" and got["style.md"] == "style" and got[".git/x"] == "skipped" and got["node_modules/y.md"] == "skipped"
    best = discover.pick_source_kind(discover.classify_files(files)).first()
    assert (best.kind, best.files) == ("srt", 2)


def test_translation_fold(spark):
    def shout(content, terms):
        return content.upper() + f" [{len(terms)}]", [(content, content.upper(), None)]

    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "run_id long, part_index int, content string")
    got = {(r.run_id, r.part_index): r.translation for r in localize.translate_parts(parts, shout).collect()}
    assert got == {(1, 1): "A [0]", (1, 2): "B [1]", (2, 1): "C [0]"}


@pytest.mark.parametrize("name", ["line_batches", "glossary_merge", "srt_cues", "json_entries"])
def test_queries_have_rows(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_section_at_the_budget_stays_whole():
    section = "## part\n\n" + "a\n\n" * 663 + "bc"
    for n in (1998, 1999, 2000):
        body = section[: n - 3] + "xyz"
        assert len(body) == n and [len(c) for _, c in chunk.chunk_text("# s\n\n" + body, 2000)] == [3, n]
