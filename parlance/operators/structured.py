"""JSON bundles and HTML pages: translatable strings out, translations back in."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk import js_trim
from .html_tree import Text, Tree, walk

#: Elements whose text and attributes are never translated.
SKIPPED = frozenset("script style noscript template code pre kbd samp var svg math".split())
#: Translated attributes.
ATTRIBUTES = frozenset("alt title placeholder aria-label aria-description aria-placeholder aria-roledescription aria-valuetext".split())
#: Meta elements whose content is translated, by name and by property.
META_NAMES = frozenset("description keywords author application-name".split())
META_PROPERTIES = frozenset("og:title og:description og:site_name twitter:title twitter:description twitter:label1 twitter:label2".split())


# JSON


def _ordered(node: dict) -> list[tuple[str, object]]:
    """Whole-number keys first, by value, then the others as they come: the order of a browser's objects."""
    index = [k for k in node if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 2**32 - 1]
    return [(k, node[k]) for k in sorted(index, key=int)] + [(k, v) for k, v in node.items() if k not in set(index)]


def walk_strings(node: object, pointer: str = "") -> Iterator[tuple[str, str]]:
    """(RFC 6901 pointer, value) of the string leaves that are not blank, depth first, without recursion."""
    stack = [(pointer, node)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, str):
            if js_trim(x) and not isinstance(x, Spelled):
                yield at, x
        elif isinstance(x, dict):
            stack.extend((f"{at}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(_ordered(x)))
        elif isinstance(x, list):
            stack.extend((f"{at}/{i}", x[i]) for i in range(len(x) - 1, -1, -1))


class Spelled(str):
    """A number as its source spells it."""

    __slots__ = ()


def _refused(word: str) -> None:
    raise ValueError(f"not JSON: {word}")


def parse_json(raw: str) -> object:
    """raw with its numbers kept as they are spelled, so that none loses digits or its form."""
    return json.loads(raw, parse_int=Spelled, parse_float=Spelled, parse_constant=_refused)


def rebuild_json(raw: str, translations: dict[str, str]) -> str:
    """raw written anew, indented by two, with the translated strings in place and numbers as they were. Without recursion, as bundles may be deep."""
    out: list[str] = []
    stack: list[tuple] = [("", "", "", parse_json(raw))]
    while stack:
        before, pointer, indent, x = stack.pop()
        out.append(before)
        if isinstance(x, Spelled):
            out.append(x)
        elif isinstance(x, str):
            out.append(json.dumps(translations.get(pointer, x) if js_trim(x) else x, ensure_ascii=False))
        elif isinstance(x, (dict, list)) and x:
            inner = indent + "  "
            if isinstance(x, dict):
                rows = [(f"{json.dumps(k, ensure_ascii=False)}: ", f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in _ordered(x)]
            else:
                rows = [("", f"{pointer}/{i}", v) for i, v in enumerate(x)]
            ends = "{}" if isinstance(x, dict) else "[]"
            out.append(f"{ends[0]}\n{inner}")
            stack.append((f"\n{indent}{ends[1]}", "", "", None))
            stack.extend((f",\n{inner}{key}" if n else key, at, inner, v) for n, (key, at, v) in reversed(list(enumerate(rows))))
        elif pointer or before == "" or x is not None:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out) + "\n"


def is_translatable(raw: str) -> bool:
    """Whether raw is a JSON object or list with a string that is not blank."""
    node = parse_json(raw)
    return isinstance(node, (dict, list)) and next(walk_strings(node), None) is not None


# HTML


#: An entry of a page: pointer, value, where it is in the source (one run of an attribute, one or more of a text), and an attribute's
#: quote, '' where it has none; None for texts.
Located = tuple[str, str, list[tuple[int, int]], str | None]


def locate(raw: str) -> list[Located]:
    """The texts and attributes to translate, in the order of the page's tree. Skipped elements give none, nor does what is in them."""
    found: list[Located] = []
    texts = attrs = skip = 0
    for x in walk(Tree(raw).root):
        if isinstance(x, tuple):
            skip -= x[0].name in SKIPPED
        elif isinstance(x, Text):
            if skip:
                continue
            value = "".join(html.unescape(raw[a:b]) for a, b in x.runs).replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
            if js_trim(value):
                texts += 1
                found.append((f"t-{texts}", value, x.runs, None))
        else:
            skip += x.name in SKIPPED
            # an element that overlapping marks have made anew has no place of its own in the source
            if skip or x.token is None or x.token.begin < 0:
                continue
            own = x.token.attrs
            named = lambda key: js_trim(own[key][0]).lower() if key in own else ""  # noqa: B023,E731
            meta = x.name == "meta" and (named("name") in META_NAMES or named("property") in META_PROPERTIES)
            for name, (value, begin, end, quote) in own.items():
                if (name in ATTRIBUTES or meta and name == "content") and begin >= 0 and js_trim(value):
                    attrs += 1
                    found.append((f"a-{attrs}", value, [(begin, end)], quote))
    return found


def walk_html(raw: str) -> list[tuple[str, str]]:
    return [(p, v) for p, v, *_ in locate(raw)]


def _escaped(value: str, quote: str | None) -> str:
    out = value.replace("&", "&amp;")
    if quote == '"':
        return out.replace('"', "&quot;")
    if quote == "'":
        return out.replace("'", "&#39;")
    out = out.replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"\s", "&#32;", out.replace('"', "&quot;").replace("'", "&#39;")) if quote == "" else out


def rebuild_html(raw: str, translations: dict[str, str]) -> str:
    """raw with the translated strings in place of their sources; everything else is byte for byte the same.

    A text that the tree puts together from several places is written at the first of them, and gone from the others. Of two
    entries at one place, as where a mark was opened again, the first counts."""
    pieces = []
    for pointer, _, runs, quote in locate(raw):
        if pointer in translations:
            pieces += [(a, b, "" if k else _escaped(translations[pointer], quote)) for k, (a, b) in enumerate(_joined(raw, runs))]
    out, at = [], 0
    for begin, end, text in sorted(pieces, key=lambda x: x[0]):
        if begin >= at:
            out += [raw[at:begin], text]
            at = end
    return "".join(out) + raw[at:]


def _joined(raw: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that follow one another, or have but a stray end tag between them, as one."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and out[-1][1] <= a and re.fullmatch(r"(?:</[A-Za-z][^>]*>)*", raw[out[-1][1] : a]):
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


# DataFrames


#: Entries, and characters in them, that a worker holds before it hands them on.
ENTRIES, CHARS = 4096, 1 << 20


def _entries(docs: DataFrame, walk: Callable[[str], Iterator[tuple[str, str]] | list[tuple[str, str]]], id_col: str, raw_col: str) -> DataFrame:
    schema = docs.select(id_col).schema.add("ord", "integer").add("pointer", "string").add("value", "string")

    def out(ids: pa.Array, rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
        at, order, pointer, value = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array(pointer, pa.string()), pa.array(value, pa.string())], schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):  # a document at a time: those of a batch, and all that is in them, are not held at once
                raw = b.column(1)[i].as_py()
                for k, (p, v) in enumerate(() if raw is None else walk(raw)):
                    rows.append((i, k, p, v))
                    held += len(v)
                    if len(rows) >= ENTRIES or held >= CHARS:
                        yield out(b.column(0), rows)
                        rows, held = [], 0
            if rows:
                yield out(b.column(0), rows)

    return docs.select(id_col, F.col(raw_col)).mapInArrow(scan, schema)


def flatten_json(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id, ord, pointer, value of every string that is not blank. Invalid JSON raises."""
    return _entries(docs, lambda raw: walk_strings(parse_json(raw)), id_col, raw_col)


def flatten_html(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id, ord, pointer (t-N for text, a-N for attributes, each from 1), value, in the order of the page."""
    return _entries(docs, walk_html, id_col, raw_col)


def _rebuilt(docs: DataFrame, translations: DataFrame, build: Callable[[str, dict[str, str]], str], id_col: str, raw_col: str) -> DataFrame:
    last = translations.where("pointer is not null and translation is not null").groupBy(id_col, "pointer").agg(F.max_by("translation", "ord").alias("translation"))
    by_doc = last.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pointer", "translation"))).alias("_t"))

    @F.pandas_udf("string")
    def rebuild(raw, words):
        import pandas as pd

        return pd.Series([None if r is None else build(r, dict(w) if w is not None else {}) for r, w in zip(raw, words, strict=True)], dtype=object)

    return docs.join(by_doc, id_col, "left").withColumn(raw_col, rebuild(F.col(raw_col), F.col("_t"))).drop("_t")


def rebuild_json_docs(docs: DataFrame, translations: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """docs with translations (id, pointer, translation, ord) in place; of several for a pointer the last holds. Unknown and null
    pointers and null translations are ignored."""
    return _rebuilt(docs, translations, rebuild_json, id_col, raw_col)


def rebuild_html_docs(docs: DataFrame, translations: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    return _rebuilt(docs, translations, rebuild_html, id_col, raw_col)


def translatable_json(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """id and translatable: whether the bundle has a string to translate. Invalid JSON raises."""

    @F.pandas_udf("boolean")
    def found(raw):
        return raw.map(lambda r: None if r is None else is_translatable(r))

    return docs.select(id_col, found(F.col(raw_col)).alias("translatable"))


def inspect_html(entries: DataFrame, id_col: str = "doc_id", sample: int = 8) -> DataFrame:
    """Counts of entries, texts and attributes of each page, and its first values."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda r: r["value"]), 1, sample)
    text = F.col("pointer").startswith("t-")
    return entries.groupBy(id_col).agg(F.count("*").alias("entry_count"), F.count_if(text).alias("text_count"), F.count_if(~text).alias("attribute_count"), first.alias("sample"))
