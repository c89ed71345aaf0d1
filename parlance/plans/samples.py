"""Small documents of binary kinds, made from a name, for queries over tables that hold none."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from ..sources.pdf_objects import Name, Ref, Stream, said, written

ITEMS = ("one", "two")


def _rows(name: str) -> tuple[tuple[str, str], ...]:
    return (("a", "b"), (name, "d|e"))


def zipped_document(kind: str, name: str) -> bytes:
    """DOCX, ODT or EPUB: a heading, a paragraph, a list of two, and a table of two rows."""
    head, rows = f"About {name}", _rows(name)
    if kind == "docx":
        p = lambda text, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
        table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
        body = p(head, '<w:pStyle w:val="Heading2"/>') + p("Hello ") + "".join(p(i, "<w:numPr/>") for i in ITEMS) + f"<w:tbl>{table}</w:tbl>"
        files = {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}
    elif kind == "odt":
        table = "".join("<t:table-row>" + "".join(f"<t:table-cell><x:p>{c}</x:p></t:table-cell>" for c in r) + "</t:table-row>" for r in rows)
        items = "".join(f"<x:list-item><x:p>{i}</x:p></x:list-item>" for i in ITEMS)
        files = {"content.xml": f'<o xmlns:x="x" xmlns:t="t"><body><x:h x:outline-level="2">{head}</x:h><x:p>Hello</x:p><x:list>{items}</x:list><t:table>{table}</t:table></body></o>'}
    else:
        table = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
        items = "".join(f"<li>{i}</li>" for i in ITEMS)
        files = {
            "META-INF/container.xml": '<container><rootfile full-path="in/book.opf"/></container>',
            "in/book.opf": '<package><item id="b" href="page%20two.html#top"/><item id="a" href="one.html"/><itemref idref="a"/><itemref idref="b"/></package>',
            "in/one.html": f"<html><head><title>no</title></head><body><h2>{head}</h2><div>Hello&nbsp;</div></body></html>",
            "in/page two.html": f"<html><body><ul>{items}</ul><table>{table}</table></body></html>",
        }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, content in files.items():
            z.writestr(path, content)
    return out.getvalue()


def rtf_document(name: str) -> bytes:
    """The same document in RTF."""
    row = lambda cells: "\\trowd\\pard\\intbl " + "".join(f"{c}\\cell " for c in cells) + "\\row\n"
    items = "".join(f"{{\\listtext\\bullet\\tab}}\\pard\\ls1 {i}\\par\n" for i in ITEMS)
    return (
        "{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0\\fcharset0 Arial;}}{\\stylesheet{Normal;}{\\s2 heading 2;}}{\\*\\generator x;}\n"
        f"\\pard\\s2 About {name}\\par\n\\pard Hello\\par\n{items}{''.join(map(row, _rows(name)))}\\pard}}"
    ).encode("cp1252")


def doc_document(name: str) -> bytes:
    """The same document as DOC: its text in two pieces, one of single bytes and one of double ones."""
    paragraphs = [(f"About {name}\r", 2, b""), ("Hello\r", 0, b""), *((f"{i}\r", 0, struct.pack("<HH", 0x460B, 1)) for i in ITEMS)]
    inside = struct.pack("<HB", 0x2416, 1)
    for r in _rows(name):
        paragraphs += [(f"{c}\x07", 0, inside) for c in r] + [("\x07", 0, inside + struct.pack("<HB", 0x2417, 1))]
    text = "".join(p for p, _, _ in paragraphs)
    half = len(paragraphs[0][0])
    start = 0x400
    raw = text[:half].encode("cp1252") + text[half:].encode("utf-16-le")
    places = [start]
    for i, (p, _, _) in enumerate(paragraphs):
        places.append(places[-1] + (len(p) if i == 0 else 2 * len(p)))
    page = bytearray(512)
    struct.pack_into(f"<{len(places)}I", page, 0, *places)
    at = 510
    for i, (_, style, own) in enumerate(paragraphs):
        body = struct.pack("<H", style) + own
        body = bytes([(len(body) + 2) // 2]) + body if len(body) % 2 else bytes([0, len(body) // 2]) + body
        at = (at - len(body)) // 2 * 2
        page[at : at + len(body)] = body
        page[4 * len(places) + 13 * i] = at // 2
    page[511] = len(paragraphs)
    number = (start + len(raw) + 511) // 512
    main = bytearray(max(4096, number * 512 + 512))
    main[start : start + len(raw)] = raw
    main[number * 512 : number * 512 + 512] = page
    plc = struct.pack("<III", 0, half, len(text)) + struct.pack("<HIH", 0, start * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, start + half, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    bins = struct.pack("<III", places[0], places[-1], number)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<I", main, 0x4C, len(text))
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    struct.pack_into("<II", main, 0x102, len(clx), len(bins))
    return compound_file({"WordDocument": bytes(main), "1Table": clx + bins})


def compound_file(streams: dict[str, bytes]) -> bytes:
    """A compound file with these streams; those under 4096 bytes in small sectors."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    pad = lambda b, n: b + bytes(-len(b) % n)
    small, small_next, entries = b"", [], []
    large: list[tuple[str, bytes]] = []
    for name, data in streams.items():
        if len(data) < 4096:
            first, n = len(small) // 64, -(-len(data) // 64)
            small += pad(data, 64)
            small_next += [*range(first + 1, first + n), end]
            entries.append((name, 2, first, len(data)))
        else:
            large.append((name, data))
    sectors, chain = [b""], [0xFFFFFFFD]  # the first is the table itself

    def put(data: bytes) -> int:
        first, n = len(sectors), max(1, -(-len(data) // 512))
        data = data.ljust(n * 512, b"\0")
        sectors.extend(data[512 * i : 512 * i + 512] for i in range(n))
        chain.extend([*range(first + 1, first + n), end])
        return first

    entries += [(name, 2, put(data), len(data)) for name, data in large]
    entries.insert(0, ("Root Entry", 5, put(small), len(small)))
    first_small = put(struct.pack(f"<{len(small_next)}I", *small_next).ljust(512, b"\xff"))
    directory = b""
    for name, kind, first, size in entries:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, free, free, free) + bytes(36) + struct.pack("<IQ", first, size)
    first_dir = put(pad(directory, 512))
    sectors[0] = struct.pack(f"<{len(chain)}I", *chain).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, first_dir, 0, 4096, first_small, 1, end, 0)
    return head + struct.pack("<I", 0) + struct.pack("<I", free) * 108 + b"".join(sectors)


MAKERS = {"rtf": rtf_document, "doc": doc_document} | {k: (lambda name, k=k: zipped_document(k, name)) for k in ("docx", "odt", "epub")}


def office_document(kind: str, name: str) -> bytes:
    return MAKERS[kind](name)


# PDF


def _text_stream(lines: list[str], wide: bool) -> bytes:
    """A page's operators: one line of text after another. Wide text is in codes of two bytes that only a map explains."""
    shown = lambda s: b"<" + "".join(f"{ord(c) + 1:04x}" for c in s).encode() + b">" if wide else b"(" + s.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    return b"BT /F1 12 Tf 14 TL 72 720 Td " + b" T* ".join(shown(s) + b" Tj" for s in lines) + b" ET"


def _wide_font(pages: list[list[str]]) -> bytes:
    """A map from codes to characters, each its own number plus one."""
    chars = sorted({c for lines in pages for s in lines for c in s})
    pairs = "".join(f"<{ord(c) + 1:04x}> <{c.encode('utf-16-be').hex()}>\n" for c in chars)
    return f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(chars)} beginbfchar\n{pairs}endbfchar\n".encode()


def pdf_document(pages: list[list[str]], bookmarks: list[tuple[str, object]] | None = None, *, packed: bool = False, wide: bool = False, locked: bool = False, nested: bool = False) -> bytes:
    """A PDF of pages of lines. Bookmarks are (title, page number from 1, or a name such as "p3"); nested ones lie under a single one.

    packed: objects in a compressed stream, with a cross-reference stream; else a plain table and plain streams."""
    n = len(pages)
    page = lambda i: Ref(10 + 2 * i, 0)
    objects: dict[int, object] = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": Ref(4, 0), "Names": {"Dests": Ref(5, 0)}},
        2: {"Type": Name("Pages"), "Count": n, "Kids": [page(i) for i in range(n)], "Resources": {"Font": {"F1": Ref(3, 0)}}},
        3: {"Type": Name("Font"), "Subtype": Name("Type0" if wide else "Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("Identity-H" if wide else "WinAnsiEncoding")},
        4: {"Type": Name("Outlines")},
        5: {"Names": [x for i in sorted(range(n), key=lambda i: f"p{i + 1}") for x in (f"p{i + 1}".encode(), {"D": [page(i), Name("Fit")]})]},
    }
    if wide:
        objects[3] |= {"ToUnicode": Ref(6, 0), "DescendantFonts": [{"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "DW": 500}]}
        objects[6] = Stream({}, _wide_font(pages))
    for i, lines in enumerate(pages):
        raw = _text_stream(lines, wide) if lines else b"q 100 0 0 100 0 0 cm Q"
        objects[10 + 2 * i] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(11 + 2 * i, 0), "MediaBox": [0, 0, 612, 792]}
        objects[11 + 2 * i] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(raw)) if packed else Stream({}, raw)
    fresh = 10 + 2 * n
    above, at = 4, fresh
    if bookmarks and nested:
        objects[4] |= {"First": Ref(fresh, 0), "Last": Ref(fresh, 0)}
        objects[fresh] = {"Title": b"All", "Parent": Ref(4, 0)}
        above, at = fresh, fresh + 1
    for k, (title, target) in enumerate(bookmarks or []):
        dest = [page(target - 1), Name("Fit")] if isinstance(target, int) and 1 <= target <= n else [Ref(9999, 0), Name("Fit")] if isinstance(target, int) else target.encode()
        objects[at + k] = {"Title": b"\xfe\xff" + title.encode("utf-16-be"), "Parent": Ref(above, 0)} | ({"A": {"S": Name("GoTo"), "D": dest}} if k % 2 else {"Dest": dest})
        if k + 1 < len(bookmarks):
            objects[at + k]["Next"] = Ref(at + k + 1, 0)
    if bookmarks:
        objects[above] |= {"First": Ref(at, 0), "Last": Ref(at + len(bookmarks) - 1, 0)}
    plain = written(objects, 1)
    if locked:
        return plain.replace(b"trailer\n<<", b"trailer\n<</Encrypt <</Filter /Standard>> ")
    return _packed(objects) if packed else plain


def _packed(objects: dict[int, object]) -> bytes:
    inside = {k: v for k, v in objects.items() if not isinstance(v, Stream)}
    body, heads = b"", []
    for num, x in inside.items():
        heads.append(f"{num} {len(body)}")
        body += said(x) + b" "
    head = (" ".join(heads) + " ").encode()
    holder, table = max(objects) + 1, max(objects) + 2
    out, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 65535)} | {num: (2, holder, i) for i, num in enumerate(inside)}
    streams = {k: v for k, v in objects.items() if isinstance(v, Stream)}
    streams[holder] = Stream({"Type": Name("ObjStm"), "N": len(inside), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + body))
    for num, s in streams.items():
        rows[num] = (1, len(out), 0)
        out += b"%d 0 obj\n" % num + said(s.head | {"Length": len(s.raw)}) + b"\nstream\r\n" + s.raw + b"\nendstream\nendobj\n"
    rows[table] = (1, len(out), 0)
    width = 7
    raw = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (rows.get(i, (0, 0, 0)) for i in range(table + 1)))
    # with the predictor that most writers use: every row less the one before
    before, coded = bytes(width), bytearray()
    for i in range(0, len(raw), width):
        row = raw[i : i + width]
        coded += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))
        before = row
    packed = zlib.compress(bytes(coded))
    about = {"Type": Name("XRef"), "Size": table + 1, "W": [1, 4, 2], "Root": Ref(1, 0), "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": width}, "Length": len(packed)}
    at = len(out)
    out += b"%d 0 obj\n" % table + said(about) + b"\nstream\n" + packed + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)
