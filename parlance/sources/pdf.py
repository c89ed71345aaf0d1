"""PDF files: text by page, bookmarks, and the split into files of page ranges, read in the workers from the format itself.

Every result has a reason where a file gives nothing: it is no PDF, damaged, encrypted, or holds no text. None fails the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import pad_index
from .markdown import Unreadable
from .pdf_objects import Pdf, Ref, split
from .pdf_text import Page

#: What a damaged file may raise.
_DAMAGED = (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, struct.error, zlib.error)
SCANNED = "no text on any page: scanned, or made of images"


def page_texts(content: bytes) -> tuple[list[str], str | None]:
    """The text of every page, and why there is none."""
    try:
        pdf = Pdf(content)
        fonts: dict = {}
        texts = [Page(pdf, fonts).text(page) for _, page in pdf.pages()]
        if not texts:
            return [], "no pages"
        return (texts, None) if any(texts) else (texts, SCANNED)
    except Unreadable as e:
        return [], str(e)
    except _DAMAGED as e:
        return [], f"damaged: {type(e).__name__}"


# bookmarks


def _title(raw: object) -> str | None:
    if not isinstance(raw, bytes):
        return None
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")


def _named(pdf: Pdf, name: object) -> object:
    """What a name of a destination stands for: in the old dictionary, or in the tree of names."""
    key = name if isinstance(name, bytes) else str(name).encode("latin-1", "ignore")
    old = pdf.get(pdf.root.get("Dests"))
    if isinstance(old, dict) and (found := old.get(key.decode("latin-1"))) is not None:
        return pdf.get(found)
    names = pdf.get(pdf.root.get("Names"))
    todo, seen = [names.get("Dests")] if isinstance(names, dict) else [], set()
    while todo:
        ref = todo.pop()
        if isinstance(ref, Ref):
            if ref.num in seen:
                continue
            seen.add(ref.num)
        node = pdf.get(ref)
        if not isinstance(node, dict):
            continue
        limits = [pdf.get(x) for x in pdf.get(node.get("Limits")) or []]
        if len(limits) == 2 and all(isinstance(x, bytes) for x in limits) and not limits[0] <= key <= limits[1]:
            continue
        pairs = pdf.get(node.get("Names")) or []
        for k, v in zip(pairs[::2], pairs[1::2], strict=False):
            if pdf.get(k) == key:
                return pdf.get(v)
        todo += reversed(pdf.get(node.get("Kids")) or [])
    return None


def _page_of(pdf: Pdf, item: dict, numbers: dict[int, int]) -> int | None:
    """The page (from 1) that a bookmark leads to, whichever way it says so."""
    dest = pdf.get(item.get("Dest"))
    if dest is None and isinstance(action := pdf.get(item.get("A")), dict) and pdf.get(action.get("S")) == "GoTo":
        dest = pdf.get(action.get("D"))
    if isinstance(dest, (bytes, str)):
        dest = _named(pdf, dest)
    if isinstance(dest, dict):
        dest = pdf.get(dest.get("D"))
    if not isinstance(dest, list) or not dest:
        return None
    target = dest[0]
    if isinstance(target, Ref):
        return numbers.get(target.num)
    return target + 1 if isinstance(target, int) and not isinstance(target, bool) else None


def _items(pdf: Pdf, first: object) -> list[dict]:
    """A level of the outline: a linked list, which may be broken or bite its tail."""
    out, seen = [], set()
    while isinstance(first, Ref) and first.num not in seen and isinstance(item := pdf.get(first), dict):
        seen.add(first.num)
        out.append(item)
        first = item.get("Next")
    return out


def outline_starts(content: bytes) -> tuple[int, list[tuple[str, int]]]:
    """The number of pages, and (title, page) of the first level of bookmarks; of the second, if the first has fewer than two that lead
    somewhere and the second has more."""
    pdf = Pdf(content)
    pages = pdf.pages()
    numbers = {ref.num: i + 1 for i, (ref, _) in reversed(list(enumerate(pages))) if ref is not None}
    outline = pdf.get(pdf.root.get("Outlines"))
    top = _items(pdf, outline.get("First")) if isinstance(outline, dict) else []

    def starts(items: list[dict]) -> list[tuple[str, int]]:
        found = [(_title(pdf.get(x.get("Title"))), _page_of(pdf, x, numbers)) for x in items]
        return [(t.strip(), p) for t, p in found if t is not None and p is not None and 1 <= p <= len(pages)]

    own = starts(top)
    if len(own) < 2:
        deeper = starts([x for item in top for x in _items(pdf, item.get("First"))])
        own = deeper if len(deeper) > len(own) else own
    return len(pages), own


# tables


def _read(files: DataFrame, columns: str, make: Callable[[bytes | None], list[tuple]]) -> DataFrame:
    """files without content, and `columns` of the rows that make gives for each file."""
    others = [c for c in files.columns if c != "content"]
    added = StructType.fromDDL(columns)
    arrow = [pa.field(f.name, {"int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in added]
    schema = StructType([*files.select(*others).schema.fields, *added.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # whole files are large
                rows = make(b.column(len(others))[i].as_py())
                for lo in range(0, len(rows), 256):
                    part = rows[lo : lo + 256]
                    own = [c.take(pa.array([i] * len(part))) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in part], f.type) for k, f in enumerate(arrow))], schema.names)

    return files.select(*others, "content").mapInArrow(scan, schema)


def pdf_pages(files: DataFrame) -> DataFrame:
    """files (content as bytes, any other columns) by page: page_no, text, total_pages and reason.

    A file that gives no text has one row with a reason and no page; its total_pages is there if its pages could be counted."""

    def rows(content: bytes | None) -> list[tuple]:
        texts, why = ([], "no file") if content is None else page_texts(content)
        return [(None, None, len(texts) or None, why)] if why else [(i + 1, t, len(texts), None) for i, t in enumerate(texts)]

    return _read(files, "page_no int, text string, total_pages int, reason string", rows)


def page_counts(files: DataFrame) -> DataFrame:
    """files (content as bytes, any other columns) with total_pages for content; null where pages cannot be counted. No text is read."""

    def rows(content: bytes | None) -> list[tuple]:
        try:
            return [(len(Pdf(content).pages()) or None if content is not None else None,)]
        except (Unreadable, *_DAMAGED):
            return [(None,)]

    return _read(files, "total_pages int", rows)


def pdf_outlines(files: DataFrame) -> DataFrame:
    """files (content as bytes, any other columns) by bookmark: ord, title, start_page and total_pages. Files that cannot be read, or have
    no bookmarks that lead to a page, have no rows."""

    def rows(content: bytes | None) -> list[tuple]:
        try:
            total, starts = outline_starts(content) if content is not None else (0, [])
        except (Unreadable, *_DAMAGED):
            return []
        return [(i, t, p, total) for i, (t, p) in enumerate(starts)]

    return _read(files, "ord int, title string, start_page int, total_pages int", rows)


def pdf_markdown(files: DataFrame) -> DataFrame:
    """files (content as bytes, any other columns) with content as markdown, without a service: pages parted by blank lines; and reason."""
    others = [c for c in files.columns if c != "content"]
    texts = _read(files, "markdown string, reason string", lambda c: [_whole(c)])
    return texts.select(*others, F.col("markdown").alias("content"), "reason")


def _whole(content: bytes | None) -> tuple[str | None, str | None]:
    texts, why = ([], "no file") if content is None else page_texts(content)
    return (None, why) if why else ("\n\n".join(t for t in texts if t), None)


def split_files(files: DataFrame, ranges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, part (from 1), title, start_page, end_page, path and content: a PDF for every range (id, title, start_page, end_page) of files
    (id, path, content), for write_documents. A file that cannot be read has no rows.

    A part holds the objects that its pages reach; bookmarks and links to other parts stay behind. A document's ranges are
    cut where its bytes are: only ranges are gathered."""
    order = Window.partitionBy(id_col).orderBy("start_page", "end_page", "title")
    told = ranges.where("start_page <= end_page").select(id_col, "title", "start_page", "end_page", F.row_number().over(order).alias("part"))
    plan = told.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("part", "title", "start_page", "end_page"))).alias("ranges"))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*\z", "")
    source = files.select(id_col, base.alias("base"), "content").join(plan, id_col)
    schema = source.select(id_col).schema.add("part", "integer").add("title", "string").add("start_page", "integer").add("end_page", "integer").add("base", "string").add("content", "binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                id_, name, content, plan = (c[i] for c in b.columns)
                try:
                    pdf = Pdf(content.as_py() or b"")
                    total = len(pdf.pages())
                except (Unreadable, *_DAMAGED):
                    continue
                for r in plan.as_py():
                    if r["start_page"] > total:
                        continue
                    end = min(r["end_page"], total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in (
                            (id_.as_py(), id_.type), (r["part"], pa.int32()), (r["title"], pa.string()), (r["start_page"], pa.int32()), (end, pa.int32()),
                            (name.as_py(), pa.string()), (split(pdf, r["start_page"], end), pa.binary()))], schema.names
                    )

    cut = source.mapInArrow(scan, schema)
    return cut.select(id_col, "part", "title", "start_page", "end_page", F.concat("base", F.lit(".part-"), pad_index(F.col("part")), F.lit(".pdf")).alias("path"), "content")
