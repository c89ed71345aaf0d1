"""Glossaries: four file formats to terms, merged so that seeds come first, and seen as of a part."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glossary_format, js_trim
from .chunk import js_trim as trim

#: Header names of the three columns.
ALIASES = {
    "source": ("source", "term", "src", "from", "key", "original", "en"),
    "target": ("target", "translation", "tgt", "to", "value", "translated"),
    "notes": ("notes", "note", "comment", "context", "description", "group"),
}
#: What parts a term from its translation on a plain line, the first that occurs in this order.
SEPARATORS = ("\t", "=>", "->", "=", "—", "–", ":", ";")

Term = tuple[str, str, str | None]


def make_term(source: object, target: object, notes: object = None) -> Term | None:
    if not isinstance(source, str) or not isinstance(target, str) or not trim(source) or not trim(target):
        return None
    return trim(source), trim(target), trim(notes) or None if isinstance(notes, str) else None


def _column(names: list[str], kind: str) -> int | None:
    return next((i for i, n in enumerate(names) if trim(n).lower() in ALIASES[kind]), None)


def parse_json(content: str) -> list[Term]:
    root = json.loads(content)
    records = root if isinstance(root, list) else root.get("terms") if isinstance(root, dict) and isinstance(root.get("terms"), list) else None
    if records is None:
        return [t for k, v in root.items() if (t := make_term(k, v))] if isinstance(root, dict) else []
    out = []
    for r in records:
        if isinstance(r, dict):
            keys = list(r)
            at = [_column(keys, kind) for kind in ("source", "target", "notes")]
            if (t := make_term(*(None if i is None else r[keys[i]] for i in at))) is not None:
                out.append(t)
    return out


def lines_of(content: str) -> list[str]:
    return re.split(r"\r?\n", content)


def split_csv(line: str) -> list[str]:
    """Fields of a line; commas and semicolons part them, quotes enclose them and double inside."""
    return [trim(m[1].replace('""', '"') if m[1] is not None else m[2]) for m in re.finditer(r'(?:^|[,;])\s*(?:"((?:[^"]|"")*)"[^,;]*|([^,;]*))', line)]


def parse_csv(content: str) -> list[Term]:
    rows = [split_csv(x) for x in lines_of(content) if trim(x) and not trim(x).startswith("#")]
    if not rows:
        return []
    at: list[int | None] = [0, 1, 2]
    if _column(rows[0], "source") is not None:
        at = [_column(rows.pop(0) if k == 2 else rows[0], kind) for k, kind in enumerate(("source", "target", "notes"))]
    pick = lambda row, i: row[i] if i is not None and i < len(row) else None
    return [t for row in rows if (t := make_term(*(pick(row, i) for i in at)))]


def parse_line(line: str) -> Term | None:
    text = re.sub(r"^[-*+]\s+", "", trim(line))
    if not text or text.startswith(("#", "//")):
        return None
    sep = next((s for s in SEPARATORS if s in text), None)
    return make_term(*text.split(sep, 1)) if sep else None


def parse_text(content: str) -> list[Term]:
    return [t for x in lines_of(content) if (t := parse_line(x))]


def parse_markdown(content: str) -> list[Term]:
    """Table rows first, then the other lines; rule rows and header rows are no terms."""
    rows, rest = [], []
    for line in map(trim, lines_of(content)):
        if not line.startswith("|"):
            rest.append(line)
            continue
        cells = [trim(c) for c in re.sub(r"^\||\|$", "", line).split("|")]
        if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells) and _column(cells, "source") is None and len(cells) > 1 and (t := make_term(*cells[:3])):
            rows.append(t)
    return rows + [t for x in rest if (t := parse_line(x))]


PARSERS = {"json": parse_json, "csv": parse_csv, "markdown": parse_markdown, "text": parse_text}


def parse_glossaries(files: DataFrame, id_col: str = "path", origin: str = "seed") -> DataFrame:
    """id, ord, source, target, notes, origin of the terms of files (id, format, content)."""
    schema = files.select(id_col).schema
    for name, kind in (("ord", "integer"), ("source", "string"), ("target", "string"), ("notes", "string")):
        schema = schema.add(name, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *t) for i, (f, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for k, t in enumerate(PARSERS[f](c or ""))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], schema.names)

    return files.select(id_col, "format", "content").mapInArrow(scan, schema).withColumn("origin", F.lit(origin))


def term_key(source: Column) -> Column:
    return F.lower(js_trim(source))


def merge_terms(terms: DataFrame, group: list[str], order: str = "ord") -> DataFrame:
    """One term for each key of a group: a seed before a translator's, the earlier before the later, at the place where the key first stood."""
    best = F.min_by(F.struct("source", "target", "notes", "origin"), F.struct((F.col("origin") != "seed").alias("a"), F.col(order).alias("b")))
    got = terms.withColumn("_key", term_key(F.col("source"))).groupBy(*group, "_key").agg(best.alias("t"), F.min(order).alias(order))
    return got.select(*group, order, "t.*")


def load_glossaries(files: DataFrame) -> DataFrame:
    """path, ord, source, target, notes, origin of the canonical glossary of each file (path, content), read by its extension's format."""
    return merge_terms(parse_glossaries(files.withColumn("format", glossary_format(F.col("path")))), ["path"])


def append_terms(known: DataFrame, added: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """known (group, ord, source, target, notes, origin) with the terms of `added` (group, ord, source, target, notes) as a translator's,
    after them; terms that are known stay as they are."""
    last = known.groupBy(group).agg(F.max(order).alias("_last"))
    new = added.join(last, group, "left").select(group, (F.col(order) + F.coalesce(F.col("_last") + 1, F.lit(0))).alias(order), "source", "target", "notes", F.lit("translator").alias("origin"))
    return merge_terms(known.select(group, order, "source", "target", "notes", "origin").unionByName(new), [group], order)


def term_counts(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """group, term_count and added_count: each glossary's terms after an addition, and how many of them are new."""
    n, m = (t.groupBy(group).agg(F.count("*").alias(c)) for t, c in ((after, "term_count"), (before, "_before")))
    return n.join(m, group, "left").select(group, "term_count", (F.col("term_count") - F.coalesce("_before", F.lit(0))).alias("added_count"))


def glossary_as_of(terms: DataFrame, parts: DataFrame, group: str, part: str = "part_index", order: str = "ord") -> DataFrame:
    """For each part, the merged terms that seeds and earlier parts have proposed; a seed's part is null.

    A term counts from the part after its own. Terms of a key are first reduced to where the answer changes: its best
    seed, or else its first proposal."""
    first = merge_terms_with_part(terms, group, part, order)
    return parts.select(group, part).join(first.withColumnRenamed(part, "_from"), group).where(F.col("_from").isNull() | (F.col("_from") < F.col(part))).drop("_from")


def merge_terms_with_part(terms: DataFrame, group: str, part: str, order: str) -> DataFrame:
    rank = Window.partitionBy(group, "_key").orderBy((F.col("origin") != "seed").cast("int"), F.col(part).asc_nulls_first(), F.col(order))
    return terms.withColumn("_key", term_key(F.col("source"))).withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(group, part, order, "source", "target", "notes", "origin")


def render(terms: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """A group's terms as lines for a prompt."""
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" => "), F.col("target"), F.coalesce(F.concat(F.lit(" — "), F.col("notes")), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s"))))
    return terms.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("glossary"))
