"""Office documents as markdown, read in the workers from the formats themselves: DOCX, ODT and EPUB (zipped XML), RTF and DOC.

A file that cannot be read has no text and a reason; it never fails the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .legacy_office import read_doc, read_rtf
from .markdown import Unreadable, Writer

READABLE = ("docx", "odt", "epub", "rtf", "doc")

Node = ElementTree.Element


def _name(node: Node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _attribute(node: Node | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _child(node: Node | None, *path: str) -> Node | None:
    for step in path:
        node = None if node is None else next((c for c in node if _name(c) == step), None)
    return node


def _number(value: str | None) -> int:
    return int(value) if value and value.isdigit() else 0


# DOCX


def _word_text(node: Node, out: Writer) -> None:
    """Runs of a paragraph; drawings' text boxes count once, and deleted text not at all."""
    for c in node:
        name = _name(c)
        if name == "t":
            out.text(c.text or "")
        elif name in ("tab", "br", "cr"):
            out.text("\t" if name == "tab" else "\n")
        elif name not in ("pPr", "rPr", "Fallback", "instrText", "delText"):
            _word_text(c, out)


def _word(node: Node, out: Writer) -> None:
    for c in node:
        name = _name(c)
        if name == "p":
            style = (_attribute(_child(c, "pPr", "pStyle"), "val") or "").lower().replace(" ", "")
            level = 1 if style == "title" else _number(style.removeprefix("heading")) if style.startswith("heading") else 0
            list_ = _child(c, "pPr", "numPr")
            out.start(level=level, item=None if list_ is None else _number(_attribute(_child(list_, "ilvl"), "val")))
            _word_text(c, out)
            out.end()
        elif name == "tr":
            out.row()
            for cell in c:
                if _name(cell) == "tc":
                    out.cell()
                    _word(cell, out)
            out.end_row()
        elif name != "sectPr":
            _word(c, out)


# ODT


def _open_text(node: Node, out: Writer) -> None:
    out.text(node.text or "")
    for c in node:
        name = _name(c)
        if name == "s":
            out.text(" " * max(1, _number(_attribute(c, "c"))))
        elif name in ("tab", "line-break"):
            out.text("\t" if name == "tab" else "\n")
        elif name not in ("annotation", "tracked-changes"):
            _open_text(c, out)
        out.text(c.tail or "")


def _open(node: Node, out: Writer, depth: int = -1, fresh: bool = False) -> None:
    """Blocks below a node; depth counts lists around it, and fresh says that an item has begun and has no text yet."""
    for c in node:
        name = _name(c)
        if name in ("p", "h"):
            out.start(level=max(1, _number(_attribute(c, "outline-level"))) if name == "h" else 0, item=depth if fresh else None)
            _open_text(c, out)
            out.end()
            fresh = False
        elif name == "list":
            _open(c, out, depth + 1)
        elif name == "list-item":
            _open(c, out, depth, True)
        elif name == "table-row":
            out.row()
            for cell in c:
                if _name(cell) == "table-cell":
                    out.cell()
                    _open(cell, out)
            out.end_row()
        elif name not in ("tracked-changes", "annotation", "forms", "sequence-decls"):
            _open(c, out, depth)


# EPUB

_BLOCKS = frozenset("p div section article aside main header footer nav blockquote pre figure figcaption dl dt dd body form fieldset address hr".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = frozenset("head script style template".split())


class _Page(HTMLParser):
    """A page of a book: forgiving about entities and tags, as pages in the wild need it."""

    def __init__(self, out: Writer):
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.unseen, self.kept = out, -1, 0, 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in _UNSEEN:
            self.unseen += 1
        elif tag in ("ul", "ol"):
            self.out.end()
            self.lists += 1
        elif tag == "li":
            self.out.start(item=max(0, self.lists))
        elif tag == "tr":
            self.out.row()
        elif tag in ("td", "th"):
            self.out.cell()
        elif tag in _HEADINGS:
            self.out.start(level=int(tag[1]))
        elif tag == "br":
            self.out.text("\n")
        elif tag in _BLOCKS:
            self.kept += tag == "pre"
            self.out.block()

    def handle_startendtag(self, tag: str, attrs: object) -> None:
        if tag == "br":
            self.out.text("\n")
        elif tag in _BLOCKS:
            self.out.block()

    def handle_endtag(self, tag: str) -> None:
        if tag in _UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag in ("ul", "ol"):
            self.out.end()
            self.lists = max(-1, self.lists - 1)
        elif tag in ("tr", "table"):
            self.out.end_row()
        elif tag == "li" or tag in _HEADINGS or tag in _BLOCKS:
            self.kept = max(0, self.kept - (tag == "pre"))
            self.out.end()

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.out.text(data if self.kept else _SPACE.sub(" ", data))


def _book(z: zipfile.ZipFile, out: Writer) -> None:
    """The pages of an EPUB in reading order; one that is not there is passed over."""
    parse = lambda path: ElementTree.fromstring(z.read(path))
    package = next((_attribute(x, "full-path") for x in parse("META-INF/container.xml").iter() if _name(x) == "rootfile"), None)
    if not package:
        raise Unreadable("no package file is named")
    root, base, there = parse(package), posixpath.dirname(package), set(z.namelist())
    files = {_attribute(x, "id"): _attribute(x, "href") for x in root.iter() if _name(x) == "item"}
    for x in root.iter():
        if _name(x) == "itemref" and (href := files.get(_attribute(x, "idref"))):
            names = [posixpath.normpath(posixpath.join(base, h)) for h in (href, unquote(href.partition("#")[0]))]
            if name := next((n for n in names if n in there), None):
                page = _Page(out)
                page.feed(z.read(name).decode("utf-8-sig", "replace"))
                page.close()
                out.end_row()
                out.end()


# all kinds


def to_markdown(content: bytes, kind: str) -> tuple[str | None, str | None]:
    """One document's markdown, and why there is none."""
    out = Writer()
    try:
        if kind == "rtf":
            read_rtf(content, out)
        elif kind == "doc":
            read_doc(content, out)
        elif kind in READABLE:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if kind == "epub":
                    _book(z, out)
                elif kind == "docx":
                    _word(ElementTree.fromstring(z.read("word/document.xml")), out)
                else:
                    body = ElementTree.fromstring(z.read("content.xml"))
                    _open(next((x for x in body.iter() if _name(x) == "body"), body), out)
        else:
            return None, f"not an office kind: {kind}"
    except Unreadable as e:
        return None, str(e)
    except zipfile.BadZipFile:
        return None, "not a zipped document"
    except (KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError, ValueError, IndexError, EOFError, RecursionError, struct.error) as e:
        return None, f"damaged: {type(e).__name__}"
    text = out.markdown()
    return (text, None) if text else (None, "no text")


def office_markdown(files: DataFrame) -> DataFrame:
    """files (kind, content as bytes, any other columns) with content as markdown, and reason: why a document has none, or null.

    Null bytes have no text; neither have kinds that are not office documents."""
    others = [c for c in files.columns if c not in ("kind", "content")]
    source = files.select("kind", "content", *others)
    schema = source.select(*others, "kind").schema.add("content", "string").add("reason", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 16):  # whole files are large
                s = b.slice(lo, 16)
                read = [(None, "no file") if c is None else to_markdown(c, k) for k, c in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True)]
                text, why = zip(*read, strict=True)
                yield pa.RecordBatch.from_arrays([*s.columns[2:], s.column(0), pa.array(text, pa.string()), pa.array(why, pa.string())], schema.names)

    return source.mapInArrow(scan, schema)


def required(documents: DataFrame, name: Column) -> DataFrame:
    """documents of office_markdown, for a run: one without text fails the job, which names it and the reason."""
    wrong = F.raise_error(F.concat_ws(": ", F.lit("no text to translate"), name.cast("string"), "reason"))
    return documents.withColumn("content", F.coalesce("content", wrong.cast("string"))).drop("reason")
