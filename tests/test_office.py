"""Office documents of all kinds to markdown; odd, damaged and locked ones have a reason."""

import io
import struct
import zipfile

import pytest

from parlance.plans import samples
from parlance.sources import office


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def book(*pages, package=None):
    items = "".join(f'<item id="p{i}" href="p{i}.html"/><itemref idref="p{i}"/>' for i in range(len(pages)))
    return zipped({"META-INF/container.xml": '<c><rootfile full-path="b.opf"/></c>', "b.opf": package or f"<p>{items}</p>"} | {f"p{i}.html": p for i, p in enumerate(pages)})


@pytest.mark.parametrize("kind", list(samples.MAKERS))
def test_the_same_document_in_every_kind(kind):
    want = "## About Zoë\n\nHello\n\n- one\n- two\n\n| a | b |\n|---|---|\n| Zoë | d\\|e |\n"
    assert office.to_markdown(samples.office_document(kind, "Zoë"), kind) == (want, None)


def test_books():
    read = lambda *p: office.to_markdown(book(*p), "epub")[0]
    assert read("<body><div>in a div <b>bold</b><p>para</p> tail</div></body>") == "in a div bold\n\npara\n\ntail\n"
    assert read("<p>a&nbsp;&copy;b&unknown;</p><p>unclosed <i>x<p>next") == "a\u00a0©b&unknown;\n\nunclosed x\n\nnext\n"
    assert read("<ul><li>a<ul><li>b</li><li><p>c</p></li></ul></li><li>d</li></ul>") == "- a\n  - b\n  - c\n- d\n"
    assert read("<pre>x\n  y</pre><p>one\n two<br/>three</p>") == "x\ny\n\none two\nthree\n"
    assert read("<script>no</script><style>no</style>", "<table><tr><th>h</th><td>a|b<p>c</p></td></tr></table>after") == "| h | a\\|b c |\n|---|---|\n\nafter\n"
    missing = book("<p>there</p>", package='<p><item id="a" href="gone.html"/><item id="b" href="p%30.html#x"/><itemref idref="a"/><itemref idref="b"/></p>')
    assert office.to_markdown(missing, "epub") == ("there\n", None)


def test_open_and_word_lists():
    odt = '<o xmlns:x="x"><body><x:list><x:list-item><x:p>a<x:s x:c="2"/>b</x:p><x:list><x:list-item><x:p>c</x:p></x:list-item></x:list></x:list-item></x:list><x:p>d<x:tab/>e<x:line-break/>f</x:p></body></o>'
    assert office.to_markdown(zipped({"content.xml": odt}), "odt")[0] == "- a b\n  - c\n\nd\te\nf\n"
    p = lambda t, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r>{t}</w:r></w:p>"
    body = p("<w:t>x</w:t>", '<w:numPr><w:ilvl w:val="1"/></w:numPr>') + p("<w:t>T</w:t>", '<w:pStyle w:val="Title"/>') + p("<w:delText>gone</w:delText><w:instrText>no</w:instrText><w:t>kept</w:t>")
    assert office.to_markdown(zipped({"word/document.xml": f'<w:d xmlns:w="w"><w:body>{body}</w:body></w:d>'}), "docx")[0] == "  - x\n\n# T\n\nkept\n"


def test_rich_text():
    read = lambda s: office.to_markdown(b"{\\rtf1\\ansi\\ansicpg1251" + s + b"}", "rtf")[0]
    assert read(rb"{\fonttbl{\f0\fcharset128 M;}{\f1\fcharset0 A;}}caf\'e9 \f0 \'82\'a0\f1 \'e9") == "cafй あé\n"
    assert read(rb"\u8364?\u-10179?\u-8704?\uc2 \u233 xxy{\uc0\u233 z}") == "€😀éyéz\n"
    assert read(rb"{\field{\*\fldinst HYPERLINK x}{\fldrslt link}} {\v hidden}{\*\unknown no}seen\line b\~c\emdash") == "link seen\nb\xa0c—\n"
    assert read(rb"{\stylesheet{\s7 Heading 3;}{\s8\outlinelevel0 Own;}}\pard\s7 three\par\pard\s8 one\par\pard\outlinelevel1 two\par\pard plain") == "### three\n\n# one\n\n## two\n\nplain\n"
    assert read(rb"\pard\ls2\ilvl1 deep\par\pard a\{b\}\\c{\pict\bin4 }}{}x}end") == "  - deep\n\na{b}\\cend\n"
    assert office.to_markdown(b"{\\rtf1 unclosed {\\b x", "rtf") == ("unclosed x\n", None)


def test_damaged_and_locked():
    doc = bytearray(samples.doc_document("x"))
    at = doc.index(struct.pack("<H", 0xA5EC))
    doc[at + 0x0B] |= 1
    assert office.to_markdown(bytes(doc), "doc") == (None, "encrypted")
    assert office.to_markdown(samples.compound_file({"Other": b"x"}), "doc") == (None, "damaged: no stream WordDocument")
    whole = samples.doc_document("x")
    for cut in (8, 100, 600, 2000, 5000):
        text, why = office.to_markdown(whole[:cut], "doc")
        assert (text is None) == (why is not None)
    assert office.to_markdown(b"PK junk", "docx")[1] == "not a zipped document"
    assert office.to_markdown(zipped({"x": "y"}), "docx")[1] == "damaged: KeyError"
    assert office.to_markdown(zipped({"word/document.xml": "<a"}), "docx")[1] == "damaged: ParseError"
    assert office.to_markdown(zipped({"word/document.xml": "<a/>"}), "docx")[1] == "no text"
    assert office.to_markdown(book(package="<p/>"), "epub")[1] == "no text"


def test_one_bad_file_fails_no_job(spark):
    rows = [("a", "docx", samples.office_document("docx", "n")), ("b", "docx", b"junk"), ("c", "doc", None), ("d", "txt", b"x"), ("e", None, b"x")]
    got = {r.path: (r.content is None, r.reason) for r in office.office_markdown(spark.createDataFrame(rows, "path string, kind string, content binary")).collect()}
    assert got == {"a": (False, None), "b": (True, "not a zipped document"), "c": (True, "no file"), "d": (True, "not an office kind: txt"), "e": (True, "not an office kind: None")}
    read = office.office_markdown(spark.createDataFrame(rows[:2], "path string, kind string, content binary"))
    with pytest.raises(Exception, match="no text to translate: b: not a zipped document"):
        office.required(read, read["path"]).collect()
