"""PDF files read, walked and cut; filters, fonts and broken files by hand."""

import base64
import zlib

import pytest

from parlance.plans.samples import pdf_document
from parlance.sources import pdf, pdf_text
from parlance.sources.pdf_objects import Lexer, Name, Pdf, Ref, Stream, Word, written, split
from parlance.sources.pdf_text import glyph

PAGES = [["Hello (world) é", "second line"], ["Page two"], [], ["Four \\ x"]]
TEXTS = ["Hello (world) é\nsecond line", "Page two", "", "Four \\ x"]


def one_page(content, font=None, resources=None, head=None):
    """A file of one page with this content, and perhaps its own font."""
    font = font or {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    own = {"Font": {"F1": font}} | (resources or {})
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Count": 1, "Kids": [Ref(3, 0)]},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Resources": own}, 4: Stream(head or {}, content),
    }
    return objects


def read(content, font=None, resources=None, more=None, head=None):
    return pdf.page_texts(written(one_page(content, font, resources, head) | (more or {}), 1))[0][0]


def test_values():
    lexer = Lexer(b"<</A[1 -2.5 (a\\(b\\)\\101\\n(in)) <48 6>]/B#20C 3 0 R/D true/E null>> % note\n--5 word")
    assert lexer.next() == {"A": [1, -2.5, b"a(b)A\n(in)", b"H`"], "B C": Ref(3, 0), "D": True, "E": None}
    assert lexer.next() == 5 and lexer.next() == Word("word") and lexer.next() is Lexer.END
    assert Lexer(b"[1 2").next() == [1, 2] and Lexer(b"(open").next() == b"open" and Lexer(b"<</A").next() == {}


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("wide", [False, True])
def test_pages_marks_and_parts(packed, wide):
    marks = [("One é", 1), ("Named", "p2"), ("Broken", 99), ("Nowhere", "p99"), ("Four", 4)]
    whole = pdf_document(PAGES, marks, packed=packed, wide=wide)
    assert pdf.page_texts(whole) == (TEXTS, None)
    assert pdf.outline_starts(whole) == (4, [("One é", 1), ("Named", 2), ("Four", 4)])
    assert pdf.outline_starts(pdf_document(PAGES, marks, packed=packed, nested=True)) == (4, [("One é", 1), ("Named", 2), ("Four", 4)])
    assert pdf.outline_starts(pdf_document(PAGES, packed=packed)) == (4, [])
    for first, last in ((1, 4), (2, 3), (4, 4), (1, 1)):
        part = split(Pdf(whole), first, last)
        texts, why = pdf.page_texts(part)
        assert texts == TEXTS[first - 1 : last] and (why is None) == any(texts)
        assert pdf.outline_starts(part) == (last - first + 1, []) and len(part) < len(whole) + 2000
    again = split(Pdf(split(Pdf(whole), 1, 4)), 2, 2)
    assert pdf.page_texts(again)[0] == ["Page two"]


def test_unreadable_files():
    whole = pdf_document(PAGES, [("One", 1)])
    assert pdf.page_texts(pdf_document(PAGES, locked=True)) == ([], "encrypted")
    assert pdf.page_texts(pdf_document([[], []])) == (["", ""], pdf.SCANNED)
    assert pdf.page_texts(b"junk") == pdf.page_texts(b"") == ([], "not a PDF document")
    assert pdf.page_texts(b"%PDF-1.4\nnothing")[1] == "damaged: no catalog"
    for packed in (False, True):  # tables that lead nowhere are made anew from the objects
        file = pdf_document(PAGES, [("One", 1), ("Two", "p2")], packed=packed)
        for bad in (file.replace(b"startxref\n", b"startxref\n1"), file[: file.rindex(b"startxref")], b"%PDF-1.4 shifted\n" + file, file.replace(b"\nxref\n", b"\nxrxx\n")):
            assert pdf.page_texts(bad) == (TEXTS, None), packed
            assert pdf.outline_starts(bad) == (4, [("One", 1), ("Two", 2)])
    for cut in range(0, len(whole), 97):
        texts, why = pdf.page_texts(whole[:cut])
        assert why is not None or any(texts)


def test_filters():
    said = b"BT /F1 12 Tf 10 10 Td (through filters) Tj ET"
    assert read(base64.a85encode(zlib.compress(said)) + b"~>", head={"Filter": [Name("ASCII85Decode"), Name("FlateDecode")]}) == "through filters"
    assert read(said.hex().encode() + b">", head={"Filter": Name("AHx")}) == "through filters"
    runs = bytes([len(said) - 1]) + said + bytes([128])
    assert read(runs, head={"Filter": Name("RunLengthDecode")}) == "through filters"
    assert read(zlib.compress(said)[:-6], head={"Filter": Name("FlateDecode")}) == "through filters"
    codes, width, out, have = [256, *said, 257], 9, 0, 0  # every byte its own code: no entry is used, but the width grows
    size, packed = 258, []
    for i, c in enumerate(codes):
        out, have = out << width | c, have + width
        if 0 < i:
            size += i > 1
        width = max(9, (size + 1).bit_length())
    packed = (out << -have % 8).to_bytes((have + 7) // 8, "big")
    assert read(packed, head={"Filter": Name("LZWDecode")}) == "through filters"
    for kind in range(5):  # one row filter each
        columns = 8
        rows = said + b" " * (-len(said) % columns)
        coded, before = bytearray(), bytes(columns)
        for at in range(0, len(rows), columns):
            row = rows[at : at + columns]
            coded.append(kind)
            for i, x in enumerate(row):
                a, b, c = (row[i - 1], before[i], before[i - 1]) if i else (0, before[i], 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                coded.append(x - (0, a, b, (a + b) // 2, paeth)[kind] & 255)
            before = row
        assert read(zlib.compress(bytes(coded)), head={"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 15, "Columns": columns}}) == "through filters"


def test_fonts_and_places():
    t = lambda body: read(b"BT /F1 10 Tf 50 700 Td " + body + b" ET")
    assert t(b"[(to)-50(geth)20(er)-400(apart)] TJ") == "together apart"
    assert t(b"(a) Tj 0 -12 Td (b) Tj T* (c) ' 1 2 (d) \"") == "a\nb c d"
    assert t(b"12 TL (a) Tj T* (b) Tj (c) '") == "a\nb\nc"
    assert t(b"(one) Tj 100 0 Td (far) Tj 1 0 0 1 50 650 Tm (below) Tj 5 Ts (up) Tj") == "one far\nbelowup"
    assert read(b"q 2 0 0 2 0 0 cm BT /F1 10 Tf (x) Tj ET Q BT /F1 10 Tf 0 300 Td (y) Tj ET BI /W 1 ID (no) EI BT /F1 9 Tf 0 200 Td (z) Tj ET") == "x\ny\nz"
    differing = {"Type": Name("Font"), "Subtype": Name("Type1"), "Encoding": {"Differences": [1, Name("eacute"), Name("uni20AC"), Name("fi"), Name("Scaron"), 65, Name("u1F600"), Name("g17")]}}
    assert read(b"BT /F1 9 Tf (\\001\\002\\003\\004AB`'C) Tj ET", differing) == "é€fiŠ😀 ‘’C"  # a glyph without a meaning leaves its gap
    assert [glyph(n) for n in ("A", "adieresis", "ccedilla", "uni00410042", "zero.oldstyle", "nonsense", "uD800")] == ["A", "ä", "ç", "AB", "0", "", ""]
    ranged = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <00790079>] endbfrange"
    mapped = {"Type": Name("Font"), "Subtype": Name("Type3"), "ToUnicode": Ref(9, 0)}
    assert read(b"BT /F1 9 Tf <1011122021> Tj ET", mapped, more={9: Stream({}, ranged)}) == "abcxyy"
    form = {7: Stream({"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 0, 50], "Resources": {"XObject": {"Again": Ref(7, 0)}}}, b"BT /F1 9 Tf (inside) Tj ET /Again Do")}
    assert read(b"/Fm Do", resources={"XObject": {"Fm": Ref(7, 0)}}, more=form) == ""  # its own resources have no font
    form[7].head.pop("Resources")
    assert read(b"/Fm Do", resources={"XObject": {"Fm": Ref(7, 0)}}, more=form) == "inside"


def test_trees_of_names_and_broken_lists():
    objects = one_page(b"BT /F1 9 Tf (x) Tj ET")
    objects[2]["Kids"] = [Ref(5, 0), Ref(3, 0), Ref(2, 0)]  # a branch, a page, and the root again
    objects[5] = {"Type": Name("Pages"), "Kids": [Ref(6, 0)], "Parent": Ref(2, 0)}
    objects[6] = {"Type": Name("Page"), "Parent": Ref(5, 0)}
    objects[1] |= {"Outlines": {"First": Ref(10, 0)}, "Names": {"Dests": Ref(20, 0)}, "Dests": {"old": [Ref(6, 0)]}}
    objects[20] = {"Kids": [Ref(21, 0), Ref(22, 0), Ref(20, 0)]}
    objects[21] = {"Limits": [b"a", b"m"], "Names": [b"a", [Ref(6, 0)], b"m", {"D": [Ref(3, 0)]}]}
    objects[22] = {"Limits": [b"n", b"z"], "Names": [b"z", [1]]}
    for i, (title, dest) in enumerate([(b" in tree ", b"m"), (b"old", Name("old")), (b"by index", b"z"), (b"none", b"q"), (None, b"a"), (b"odd", 7)]):
        objects[10 + i] = {"Title": title, "Dest": dest, "Next": Ref(11 + i, 0) if i < 5 else Ref(10, 0)}
    assert pdf.outline_starts(written(objects, 1)) == (2, [("in tree", 2), ("old", 1), ("by index", 2)])


def test_tables_of_files(spark):
    rows = [(1, "a/b.c.pdf", pdf_document(PAGES, [("One", 1), ("Two", 2)]), "k"), (2, "x.pdf", b"junk", "k"), (3, "y.pdf", None, "k"), (4, "z.pdf", pdf_document([[]]), "k"), (None, "n.pdf", pdf_document([["null id"]]), "k")]
    files = spark.createDataFrame(rows, "doc_id long, path string, content binary, text string").withColumnRenamed("text", "note")
    got = sorted(pdf.pdf_pages(files).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.page_no))
    assert [(r.doc_id, r.page_no, r.text, r.total_pages, r.reason, r.note) for r in got] == [
        *[(1, i + 1, t, 4, None, "k") for i, t in enumerate(TEXTS)], (2, None, None, None, "not a PDF document", "k"), (3, None, None, None, "no file", "k"), (4, None, None, 1, pdf.SCANNED, "k"), (None, 1, "null id", 1, None, "k")
    ]
    assert [(r.doc_id, r.ord, r.title, r.start_page) for r in pdf.pdf_outlines(files).orderBy("ord").collect()] == [(1, 0, "One", 1), (1, 1, "Two", 2)]
    assert {r.doc_id: (r.content, r.reason) for r in pdf.pdf_markdown(files).collect()}[1] == ("\n\n".join(t for t in TEXTS if t), None)
    ranges = spark.createDataFrame([(1, "b", 3, 9), (1, "a", 1, 2), (1, "none", 5, 6), (2, "c", 1, 1), (7, "d", 1, 1)], "doc_id long, title string, start_page int, end_page int")
    parts = {r.path: (r.part, r.title, r.start_page, r.end_page, pdf.page_texts(bytes(r.content))[0]) for r in pdf.split_files(files, ranges).collect()}
    assert parts == {"b.c.part-001.pdf": (1, "a", 1, 2, TEXTS[:2]), "b.c.part-002.pdf": (2, "b", 3, 4, TEXTS[2:])}
    assert pdf.pdf_pages(files.limit(0)).count() == 0


def test_work_grows_with_the_file(monkeypatch):
    """An object stream is opened once, pages are listed once, and a string's matrices are made once, not for each character."""
    opened, made = [], []
    monkeypatch.setattr(Pdf, "decoded", lambda self, s, f=Pdf.decoded: (opened.append(s.head.get("Type")), f(self, s))[1])
    monkeypatch.setattr(pdf_text, "_times", lambda a, b, f=pdf_text._times: (made.append(1), f(a, b))[1])
    pages = [[f"page {i} " + "x" * 500] for i in range(20)]
    content = pdf_document(pages, packed=True, wide=True)
    assert pdf.page_texts(content) == ([p[0] for p in pages], None)
    assert opened.count("ObjStm") == 1
    assert len(made) < 10 * len(pages)
    file = Pdf(content)
    assert file.pages() is file.pages()


def test_rise_and_spacing_still_part_text():
    """Strings whose codes do not follow one another at once are placed as before."""
    assert read(b"BT /F1 12 Tf (a) Tj 20 0 Td (b) Tj 0 -14 Td (c) Tj ET") == "a b\nc"
    assert read(b"BT /F1 12 Tf 5 Tc (ab) Tj ET") == "ab"
    assert read(b"BT /F1 12 Tf (ab) Tj [-300 (cd) -20 (e)] TJ ET") == "ab cde"


def test_page_counts(spark):
    rows = [(1, pdf_document(PAGES)), (2, pdf_document(PAGES, locked=True)), (3, pdf_document([[], []])), (4, b"no"), (5, None)]
    got = pdf.page_counts(spark.createDataFrame(rows, "doc_id long, content binary"))
    assert {r.doc_id: r.total_pages for r in got.collect()} == {1: 4, 2: None, 3: 2, 4: None, 5: None}
