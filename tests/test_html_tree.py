"""Pages as browsers read them: what is one text, in which order, and how translations go back."""

import random

import pyarrow as pa
import pytest

from parlance.operators import structured
from parlance.operators.html_tree import Element, Text, Tree


def shape(raw):
    """The tree's body, as nested names and texts."""

    def said(x):
        if isinstance(x, Text):
            return "".join(raw[a:b] for a, b in x.runs)
        return (x.name, *map(said, x.children))

    body = next(x for x in next(x for x in Tree(raw).root.children if isinstance(x, Element) and x.name == "html").children if x.name == "body")
    return said(body)[1:]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("<b>1<i>2</b>3</i>4", (("b", "1", ("i", "2")), ("i", "3"), "4")),
        ("<b>x<p>y</b>z</p>", (("b", "x"), ("p", ("b", "y"), "z"))),
        ("<a>1<div>2<div>3</a>4</div>5</div>6", (("a", "1"), ("div", ("a", "2"), ("div", ("a", "3"), "4"), "5"), "6")),
        ("<p>1<b>2<i>3<p>4", (("p", "1", ("b", "2", ("i", "3"))), ("p", ("b", ("i", "4"))))),
        ("<p>one<p>two<div>three</p>four", (("p", "one"), ("p", "two"), ("div", "three", ("p",), "four"))),
        ("<table>a<tr><td>b</td>c</tr>d</table>e", ("acd", ("table", ("tbody", ("tr", ("td", "b")))), "e")),
        ("<table> <tr> <td>1<td>2<tr><th>3</table>", (("table", " ", ("tbody", ("tr", " ", ("td", "1"), ("td", "2")), ("tr", ("th", "3")))),)),
        ("<table><b>x<tr><td>y</table>z", (("b", "x"), ("table", ("tbody", ("tr", ("td", "y")))), ("b", "z"))),
        ("<table><caption>c<tr><td>d<table><tr><td>e</table>f</table>", (("table", ("caption", "c"), ("tbody", ("tr", ("td", "d", ("table", ("tbody", ("tr", ("td", "e")))), "f")))),)),
        ("<table><colgroup><col>x<tr></table>", ("x", ("table", ("colgroup", ("col",)), ("tbody", ("tr",))))),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", (("ul", ("li", "a"), ("li", "b", ("ul", ("li", "c")), "d")),)),
        ("<dl><dt>a<dd>b<dt>c</dl>", (("dl", ("dt", "a"), ("dd", "b"), ("dt", "c")),)),
        ("<select><option>a<option>b<b>c</b></select>d", (("select", ("option", "a"), ("option", "bc")), "d")),
        ("<button>a<button>b</button>c", (("button", "a"), ("button", "b"), "c")),
        ("<h1>a<h2>b</h1>c", (("h1", "a"), ("h2", "b"), "c")),
        ("<a>x<a>y</a>z", (("a", "x"), ("a", "y"), "z")),
        ("a</i>b</p>c", ("ab", ("p",), "c")),
        ("x<br>y</br>z", ("x", ("br",), "y", ("br",), "z")),
        ("<svg><g>in<p>out", (("svg", ("g", "in")), ("p", "out"))),
        ("<svg><title>t</title><foreignObject>f<p>g</p></foreignObject><g/>s</svg>e", (("svg", ("title", "t"), ("foreignobject", "f", ("p", "g")), ("g",), "s"), "e")),
        ("<textarea>\n<b>x</textarea>y", (("textarea", "<b>x"), "y")),
        ("<pre>\nx</pre><script>a</b></script><xmp><i></xmp>", (("pre", "x"), ("script", "a</b>"), ("xmp", "<i>"))),
        ("<template><td>t</template>x", ("x",)),
        ("</body>late<p>more</html>end", ("late", ("p", "moreend"))),
        ("a < b <3 </ x> c <", ("a < b <3 ", ("#comment",), " c <")),
        ("x<!-- a>b -->y<!>z<?p?>w<![CDATA[v]]>u", ("x", ("#comment",), "y", ("#comment",), "z", ("#comment",), "w", ("#comment",), "u")),
        ("<div<p>x</div <y>z", (("div<p", "xz"),)),
    ],
)
def test_trees(raw, want):
    assert shape(raw if not raw.startswith("<template") else "<!DOCTYPE html><body>" + raw)[-len(want) :] == want


def test_where_body_begins():
    page = "<!DOCTYPE html>\n<html lang=x>\n<head><title>T &amp; t</title><meta name=description content='about'>\n</head>\n<body title=no>  b<noscript><p title=x>no</noscript>"
    assert structured.walk_html(page) == [("t-1", "T & t"), ("a-1", "about"), ("a-2", "no"), ("t-2", "  b")]
    assert structured.walk_html("  <title>a</title> b") == [("t-1", "a"), ("t-2", "b")]
    assert structured.walk_html("") == structured.walk_html("<html>") == structured.walk_html("   ") == structured.walk_html("<p title='open") == []


def test_pointers_of_mended_pages():
    walk = structured.walk_html
    assert walk("<table>stray<tr><td>cell</table>") == [("t-1", "stray"), ("t-2", "cell")]
    assert walk("<p>a<p>b <b>c<i>d</b>e</i>") == [("t-1", "a"), ("t-2", "b "), ("t-3", "c"), ("t-4", "d"), ("t-5", "e")]
    assert walk("<p><b title=t>x</p><p>y") == [("a-1", "t"), ("t-1", "x"), ("a-2", "t"), ("t-2", "y")]
    assert walk('<meta name="twitter:title" content="T"><meta property="twitter:title" content="U">') == [("a-1", "U")]
    assert walk("<svg title=s><text>no</text></svg><code>no</code><math><mi>no</mi></math><template><p title=n>no</p></template>yes") == [("t-1", "yes")]
    assert walk("<img alt='a&amp;b&copy=1&copy;&copyx' title=\"\" alt=twice><input placeholder=p>") == [("a-1", "a&b&copy=1©&copyx"), ("a-2", "p")]
    assert walk("x&nbsp;y &am z\r\nw\0") == [("t-1", "x\xa0y &am z\nw")]


def test_translations_go_back():
    raw = '<table>one<tr><td title="t">cell</td></tr>two</table><p><b title=q>x</p>y a</i>b'
    entries = dict(structured.walk_html(raw))
    assert entries == {"t-1": "onetwo", "a-1": "t", "t-2": "cell", "a-2": "q", "t-3": "x", "a-3": "q", "t-4": "y ab"}
    assert structured.rebuild_html(raw, {}) == raw
    told = {k: f"<{v}>" for k, v in entries.items()}
    assert structured.rebuild_html(raw, told) == '<table>&lt;onetwo&gt;<tr><td title="<t>">&lt;cell&gt;</td></tr></table><p><b title=&lt;q&gt;>&lt;x&gt;</p>&lt;y ab&gt;'


def test_any_soup():
    """No input fails, entries lie in the source, and nothing changes without translations."""
    rng = random.Random(1)
    pieces = "<b> </b> <i title=t> </i> <p> </p> <table> </table> <tr> <td> </td> <a> </a> <div> </div> <svg> </svg> <select> <option> </select> <li> <ul> </ul> <template> </template> <script> </script> <caption> <col> <form> </form> <h1> </h1> <!--c--> <br> </br> <math> <mi> <button> <nobr> <font color=r> </body> </html> <head> <html> < & x y&amp; <textarea> </textarea>".split(" ")
    for _ in range(1500):
        raw = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        found = structured.locate(raw)
        assert all(0 <= a <= b <= len(raw) for _, _, runs, _ in found for a, b in runs), raw
        assert structured.rebuild_html(raw, {}) == raw
        structured.rebuild_html(raw, {p: "z" for p, *_ in found})
    deep = "<div>" * 3000 + "x" + "<b>" * 200 + "y"
    assert [v for _, v in structured.walk_html(deep)] == ["x", "y"]


def test_entries_come_in_bounded_batches(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, raw string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    scan = structured.flatten_html(docs)
    page = "".join(f"<p>t{i}</p>" for i in range(6000)) + f"<p>{'x' * 2_000_000}</p><p>end</p>"
    got = list(scan(iter([pa.record_batch({"doc_id": [7, 8, 9], "raw": [page, None, page]})])))
    assert max(b.num_rows for b in got) <= 4096
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)] == [(n, i, f"t-{i + 1}") for n in (7, 9) for i in range(6002)]


def test_references_that_are_cut():
    """Names of old need no semicolon, where a text was cut as well; shorter pieces of them are text."""
    page = "<title>token = &quot</title><h1>token = &quot</h1><p>a &quo b &am</p><p>c &amp"
    assert structured.walk_html(page) == [("t-1", 'token = "'), ("t-2", 'token = "'), ("t-3", "a &quo b &am"), ("t-4", "c &")]
