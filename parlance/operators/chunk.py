"""Documents to parts under a budget: headings first, then blank-line blocks, then lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim as text_trim
from .pack import fill_bins

HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*\Z")
FENCE = re.compile(r"\s*(?:```|~~~)")
#: What JavaScript's trim removes.
JS_WHITE = "\t\n\v\f\r                  　﻿"


def js_trim(text: str) -> str:
    return text.strip(JS_WHITE)


def js_length(text: str) -> int:
    """UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def bin_slices(costs: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Where each bin begins and ends."""
    edges = np.flatnonzero(np.diff(fill_bins(costs, budget), prepend=-1, append=-1)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, title) of the headings outside fenced code; an open fence hides all that follow."""
    out, fenced = [], False
    for i, line in enumerate(lines):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(line)):
            out.append((i, len(m[1]), m[2]))
    return out


def sections_at(lines: list[str], level: int, title: str | None = None) -> list[tuple[str | None, list[str]]]:
    """Sections that begin at headings of at most this level; those of blank lines only are left out."""
    starts = [(i, t) for i, lv, t in headings(lines) if lv <= level]
    cuts = [0, *[i for i, _ in starts], len(lines)]
    titles = [None, *[t for _, t in starts]]
    found = [(t, lines[a:b]) for t, a, b in zip(titles, cuts[:-1], cuts[1:], strict=True)]
    return [(t, part) for t, part in found if any(js_trim(x) for x in part)]


def text_blocks(text: str) -> list[str]:
    """Blocks between blank lines; a fenced block is one, and ends at its closing fence."""
    blocks, now, fenced = [], [], False
    for line in text.split("\n"):
        fence = bool(FENCE.match(line))
        if not fenced and not js_trim(line):
            blocks.append(now)
            now = []
            continue
        now.append(line)
        if fence:
            fenced = not fenced
            if not fenced:
                blocks.append(now)
                now = []
    return [js_trim("\n".join(b)) for b in [*blocks, now] if any(js_trim(x) for x in b)]


def split_lines(text: str, budget: int) -> list[str]:
    """Runs of lines within the budget; a longer line is a run of its own."""
    lines = text.split("\n")
    runs = ["\n".join(lines[a:b]) for a, b in bin_slices(np.array([js_length(x) + 1 for x in lines]), budget)]
    return [t for t in map(js_trim, runs) if t]


def pack_blocks(text: str, budget: int) -> list[str]:
    """Blocks joined by blank lines, each charged for one; a block over the budget is split by lines and stands alone."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            for a, b in bin_slices(np.array([js_length(b) + 2 for b in held]), budget):
                out.append("\n\n".join(held[a:b]))
            held.clear()

    for b in text_blocks(text):
        if js_length(b) > budget:
            flush()
            out.extend(split_lines(b, budget))
        else:
            held.append(b)
    flush()
    return out


def expand(title: str | None, lines: list[str], budget: int) -> list[tuple[str | None, str]]:
    """A section that fits as it is; else its subsections at the first deeper level that divides it; else packed blocks under its title."""
    text = js_trim("\n".join(lines))
    if not text:
        return []
    if js_length(text) <= budget:
        return [(title, text)]
    for level in sorted({lv for _, lv, _ in headings(lines) if lv >= 3}):
        parts = sections_at(lines, level)
        if len(parts) > 1:
            return [piece for t, part in parts for piece in expand(t, part, budget)]
    return [(title, js_trim(piece)) for piece in pack_blocks(text, budget)]


def chunk_text(content: str, budget: int) -> list[tuple[str | None, str]]:
    """(title, content) of a document's parts, in order. A blank document has none; one that fits is one untitled part."""
    text = content.replace("\r\n", "\n")
    if not js_trim(text):
        return []
    if js_length(text) <= budget:
        return [(None, js_trim(text))]
    lines = text.split("\n")
    top = max((lv for _, lv, _ in headings(lines) if lv <= 2), default=None)
    sections = [(None, lines)] if top is None else sections_at(lines, top)
    pieces = [p for t, part in sections for p in expand(t, part, budget)]
    if not pieces:
        return []
    out: list[tuple[str | None, str]] = []
    for a, b in bin_slices(np.array([js_length(x) + 2 for _, x in pieces]), budget + 2):
        own = pieces[a:b]
        out.append((next((t for t, _ in own if t), None), "\n\n".join(x for _, x in own)))
    return out


def chunk_documents(docs: DataFrame, budget: int, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """id, part_index (from 1), title, content, for every part of every document; a narrow map over Arrow batches."""
    schema = docs.select(id_col).schema.add("part_index", "integer").add("title", "string").add("content", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, titles, texts = [], [], [], []
            for i, content in enumerate(b.column(1).to_pylist()):
                for k, (title, text) in enumerate(chunk_text(content or "", budget), 1):
                    at.append(i)
                    index.append(k)
                    titles.append(title)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(titles, pa.string()), pa.array(texts, pa.string())], schema.names)

    return docs.select(id_col, F.col(content_col)).mapInArrow(scan, schema)


def paginated_pages(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """id, page, content of markdown whose pages begin with lines as {12}------; before the first such line is page 0. Blank pages are dropped."""
    mark = r"^[ \t]*\{(\d+)\}[ \t]*-{6,}[ \t]*\z"
    lines = docs.select(id_col, F.posexplode(F.split(F.replace(F.col(content_col), F.lit("\r\n"), F.lit("\n")), "\n")).alias("line_no", "line"))
    order = Window.partitionBy(id_col).orderBy("line_no")
    is_mark = F.col("line").rlike(mark)
    marked = lines.withColumn("page", F.coalesce(F.last(F.when(is_mark, F.regexp_extract("line", mark, 1).cast("int")), ignorenulls=True).over(order), F.lit(0))).withColumn("mark", is_mark)
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = marked.where("not mark").groupBy(id_col, "page").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content"))
    return text.withColumn("content", text_trim(F.col("content"))).where("content <> ''")
