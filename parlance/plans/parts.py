"""The parts of a run, whatever the kind of its sources: made, translated in order, reviewed, and put back together.

A part is a row: run_id, source_index, part_index (from 1, through all sources of the run), kind, title, content (text kinds),
items (ord, key, value, of the kinds with entries or cues), start_page, end_page (page kinds).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import OFFICE_KINDS, SUBTITLE_KINDS, js_trim, pad_index, strip_markdown, strip_separators, utf16_length
from ..operators.chunk import chunk_documents
from ..operators.glossary import Term, merge_terms, trim
from ..operators.pack import greedy_pack
from ..operators.ranges import plan_parts, range_pages
from ..operators.structured import flatten_html, flatten_json, rebuild_html_docs, rebuild_json_docs
from ..operators.subtitles import cues_of, rebuild_subtitles
from ..sources.notes import Notes
from ..sources.pdf import pdf_outlines, pdf_pages
from .localize import ISSUES, TERMS, assemble_text
from .store import ReplyStore, digest, part_key

#: The default budget of a part in UTF-16 units, and the most entries and cues of one.
BUDGET, ENTRIES, CUES = 20_000, 100, 80
TEXT_KINDS = ("text", "markdown")
ITEMS = "array<struct<ord: int, key: string, value: string>>"
DOC = ("run_id", "source_index")
COLUMNS = (*DOC, "kind", "ord", "title", "content", "items", "start_page", "end_page")


class Glossary(Sequence[Term]):
    """The terms that a list begins with, as they were when this was made: the list may only grow. Nothing is copied, as a run has a glossary for each part."""

    __slots__ = ("terms", "n")

    def __init__(self, terms: list[Term]):
        self.terms, self.n = terms, len(terms)

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[Term]:
        return itertools.islice(self.terms, self.n)

    def __getitem__(self, at: int | slice) -> Term | list[Term]:
        found = range(self.n)[at]
        return [self.terms[i] for i in found] if isinstance(at, slice) else self.terms[found]

    def __eq__(self, other: object) -> bool:
        return list(self) == list(other) if isinstance(other, (list, Glossary)) else NotImplemented

    def __repr__(self) -> str:
        return repr(list(self))


#: (kind, content or items as (key, value), glossary so far) to (translation, or keys and translations; newly proposed terms).
Translator = Callable[[str, object, Sequence[Term]], tuple[object, list[Term]]]
#: (kind, source, translation, final glossary) to (corrected translation, issues as (severity, description)).
Editor = Callable[[str, object, object, Sequence[Term]], tuple[object, list[tuple[str, str]]]]


def _shaped(parts: DataFrame) -> DataFrame:
    """parts with all COLUMNS; what a kind has not is null."""
    types = {"title": "string", "content": "string", "items": ITEMS, "start_page": "int", "end_page": "int"}
    return parts.select(*[F.col(c).cast(types[c]) if c in parts.columns and c in types else F.col(c) if c in parts.columns else F.lit(None).cast(types[c]).alias(c) for c in COLUMNS])


def _doc() -> Column:
    return F.struct(*DOC).alias("doc")


def _with_kind(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """doc, which tells its kind too, and columns, dealt anew: rows of a small file may be much work."""
    return docs.select(F.struct(*DOC, "kind").alias("doc"), *columns).repartition("doc")


def text_parts(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Parts of docs (run_id, source_index, kind, content) by headings, blocks and lines."""
    pieces = chunk_documents(_with_kind(docs, "content"), budget, "doc")
    return _shaped(pieces.select("doc.*", F.col("part_index").alias("ord"), "title", "content"))


def _batched(items: DataFrame, budget: int, most: int) -> DataFrame:
    """Parts of items (doc, ord, key, value, cost)."""
    batch = greedy_pack(items, "doc", "ord", "cost", budget=budget, cap=most)
    rows = F.array_sort(F.collect_list(F.struct("ord", "key", "value")))
    return _shaped(batch.groupBy("doc", "batch").agg(rows.alias("items")).select("doc.*", F.col("batch").alias("ord"), "items"))


def entry_parts(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Parts of JSON bundles and web pages (run_id, source_index, kind, content): batches of entries."""
    raw = lambda kind: _with_kind(docs.where(F.col("kind") == kind), F.col("content").alias("raw"))
    found = flatten_json(raw("json"), "doc").unionByName(flatten_html(raw("html"), "doc"))
    items = found.select("doc", "ord", F.col("pointer").alias("key"), "value", (utf16_length(F.col("pointer")) + utf16_length(F.col("value"))).alias("cost"))
    return _batched(items, budget, ENTRIES)


def cue_parts(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Parts of subtitle files (run_id, source_index, kind, content): batches of cues."""
    found = cues_of(_with_kind(docs, F.col("content").alias("raw"), F.col("kind").alias("format")), "doc")
    items = found.select("doc", "ord", F.col("cue").alias("key"), F.col("text").alias("value"), utf16_length(F.col("text")).alias("cost"))
    return _batched(items, budget, CUES)


def page_parts(docs: DataFrame, pages: DataFrame, ranges: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Parts of paged documents: docs (run_id, source_index, kind), their pages (+ page_no, text) and ranges (+ title, start_page, end_page).

    The pages of a range are joined by blank lines and split under the budget; a piece without a heading has the range's title."""
    doc = F.struct(*DOC)
    own = lambda t: t.withColumn("doc", doc).drop(*DOC)
    placed = range_pages(own(ranges), own(pages), "doc")
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    text = placed.groupBy("doc", "part").agg(
        F.first("title").alias("range_title"), F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"),
        F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), "\n\n").alias("text"),
    ).withColumn("range", F.struct("doc", "part"))
    pieces = chunk_documents(text.select("range", strip_separators(F.col("text")).alias("content")), budget, "range")
    joined = pieces.join(text.select("range", "range_title", "start_page", "end_page"), "range").select(
        F.col("range.doc").alias("doc"), (F.col("range.part").cast("long") * (1 << 31) + F.col("part_index")).alias("ord"),
        F.coalesce("title", "range_title").alias("title"), "content", "start_page", "end_page",
    )
    return _shaped(joined.join(docs.select(_doc(), "kind"), "doc").select("doc.*", "kind", "ord", "title", "content", "start_page", "end_page"))


def pdf_ranges(files: DataFrame, least: int = 2, most: int = 20, scanned: int = 10) -> tuple[DataFrame, DataFrame]:
    """pages and ranges for make_parts, of PDF files (run_id, source_index, content as bytes): see plan_parts.

    A file that gives no text fails the job, which names it and the reason."""
    doc, store = files.select(_doc(), "content"), ReplyStore.temporary(files.sparkSession)
    wrong = F.raise_error(F.concat_ws(": ", F.lit("no text to translate"), F.col("doc.run_id").cast("string"), F.col("doc.source_index").cast("string"), "reason"))
    pages = pdf_pages(doc).select("doc", F.when(F.col("reason").isNull(), F.col("page_no")).otherwise(wrong.cast("int")).alias("page_no"), "text", "total_pages")
    pages = store.settled(pages, "pages")
    totals = pages.groupBy("doc").agg(F.max("total_pages").alias("total_pages"))
    ranges = plan_parts(pages.select("doc", "page_no", "text"), totals, pdf_outlines(doc).drop("total_pages"), least, most, scanned, "doc")
    return pages.select("doc.*", "page_no", "text"), store.settled(ranges, "ranges").select("doc.*", "title", "start_page", "end_page", "plan")


def make_parts(docs: DataFrame, budget: int = BUDGET, pages: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """All parts of docs (run_id, source_index, kind, content), each by its kind's own way, numbered through their run.

    Office documents come as the markdown that their conversion gave; paged kinds need pages and ranges."""
    of = lambda *kinds: docs.where(F.col("kind").isin(*kinds))
    found = text_parts(of(*TEXT_KINDS, *OFFICE_KINDS), budget).unionByName(entry_parts(of("json", "html"), budget)).unionByName(cue_parts(of(*SUBTITLE_KINDS), budget))
    if pages is not None and ranges is not None:
        found = found.unionByName(page_parts(of("pdf"), pages, ranges, budget))
    order = Window.partitionBy("run_id").orderBy("source_index", "ord")
    return found.withColumn("part_index", F.row_number().over(order).cast("int")).drop("ord")


def part_sources(parts: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """run_id and part_source: how each run's parts came about.

    Paged kinds need their ranges (run_id, source_index, plan), one row each: every document's plan is named, with
    ``+headings`` where it has more parts than ranges."""
    docs = parts.groupBy(*DOC).agg(F.first("kind").alias("kind"), F.count("*").alias("n")).withColumn("plan", F.lit(None).cast("string"))
    if ranges is not None:
        plans = ranges.groupBy(*DOC).agg(F.first("plan").alias("plan"), F.count("*").alias("ranges"))
        docs = docs.drop("plan").join(plans, list(DOC), "left").withColumn("plan", F.when(F.col("n") > F.col("ranges"), F.concat("plan", F.lit("+headings"))).otherwise(F.col("plan")))
    plan = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", "plan"))), lambda d: d["plan"]), ",")
    runs = docs.groupBy("run_id").agg(F.first("kind").alias("kind"), F.max("n").alias("n"), F.count("*").alias("docs"), F.nullif(plan, F.lit("")).alias("plan"))
    split = F.when(F.col("n") > 1, "headings").otherwise("single-part")
    name = (
        F.when(F.col("kind") == "json", "json-batches").when(F.col("kind") == "html", "html-batches").when(F.col("kind").isin(*SUBTITLE_KINDS), "subtitle-cues")
        .when(F.col("kind").isin(*OFFICE_KINDS), F.concat(F.lit("office-"), split)).otherwise(F.coalesce("plan", split))
    )
    return runs.select("run_id", F.concat(F.when(F.col("docs") > 1, "multi-document:").otherwise(""), name).alias("part_source"))


def part_files(parts: DataFrame, folder: str = "parts", content: str = "content") -> DataFrame:
    """path and content of a file for each text part, for write_documents: <run>/<folder>/part-NNN.md."""
    name = F.concat(F.col("run_id").cast("string"), F.lit(f"/{folder}/part-"), pad_index(F.col("part_index")), F.lit(".md"))
    return parts.where(F.col("content").isNotNull()).select(name.alias("path"), F.col(content).alias("content"))


PAIRS = "array<struct<key: string, translation: string>>"
ARROW_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("translation", pa.string())]))
ARROW_TERMS = pa.list_(pa.struct([(f.name, pa.string()) for f in TERMS.elementType]))
#: Fixed value: so many translated parts of a run lie in one batch.
BATCH = 4096


def _listed(column: pa.Array | pa.ChunkedArray, name: str = "value") -> list[list[tuple[str, str]] | None]:
    """key and a named field of each row's structs. Columns are read whole, as a struct at a time takes ten times as long."""
    out: list[list[tuple[str, str]] | None] = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        own = c.flatten()
        flat, at = list(zip(own.field("key").to_pylist(), own.field(name).to_pylist(), strict=True)), 0
        for n in pc.list_value_length(c).to_pylist():
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
    return out


def _nested(rows: Sequence[Sequence[tuple] | None], kind: pa.ListType) -> pa.Array:
    """Rows of structs, or null, as a column of that kind."""
    ends = list(itertools.accumulate(0 if r is None else len(r) for r in rows))
    begins = [None if r is None else end - len(r) for r, end in zip(rows, ends, strict=True)]
    fields = list(kind.value_type)
    columns = list(zip(*itertools.chain.from_iterable(r for r in rows if r), strict=True)) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([*begins, ends[-1] if ends else 0], pa.int32()), values)


def _glossaries(terms: DataFrame, name: str) -> DataFrame:
    return terms.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "target", "notes"))).alias(name))


def translate(parts: DataFrame, translator: Translator, seeds: DataFrame | None = None, store: ReplyStore | None = None, settings: str = "") -> DataFrame:
    """parts with translation (text) or pairs (key, translation), and proposed terms; a table that is written when this is called.

    Parts of a run go in order, each seeing the run's seed terms (run_id, ord, source, target, notes) and all that earlier
    parts proposed, so the fold is one group a run; runs are apart. An empty text, and an entry that is not returned, keep
    the source; keys that were not asked for are dropped.

    The translator is asked once for each part of a run under its glossary and `settings`, which stand for whatever else changes a
    reply. What the store had when this was called is not asked again, by this run or another; without a store this call has one
    of its own."""
    store = store or ReplyStore.temporary(parts.sparkSession)
    journal = store.journal("translations")
    schema = parts.select("run_id", "part_index").schema
    asked = parts.select("run_id", "part_index", "kind", "content", "items", part_key(settings, "kind", "content", "items").alias("part_key"))
    out = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, translation string, pairs {PAIRS}, proposed {TERMS.simpleString()}"

    def fold(run: pa.Table, known: pa.Table) -> pa.Table:
        told: dict[tuple[str, str], object] = {}
        seed: list[tuple] = []
        for n, source, target, notes, p, g, x in zip(*(known.column(c).to_pylist() for c in ("ord", "source", "target", "notes", "part_key", "prior_key", "reply")), strict=True):
            if x is None:
                seed.append((n, source, target, notes))
            else:
                told[p, g] = json.loads(x)
        seen: set[str] = set()
        terms: list[Term] = []
        prior = ""

        def add(t: Term) -> None:
            nonlocal prior
            if (key := trim(t[0]).lower()) not in seen:
                seen.add(key)
                terms.append(t)
                prior = digest(prior, t)

        for _, *t in sorted(seed, key=lambda s: [(x is not None, x) for x in s]):  # null first
            add(tuple(t))
        fields = run.schema.field("run_id"), run.schema.field("part_index"), pa.field("translation", pa.string()), pa.field("pairs", ARROW_PAIRS), pa.field("proposed", ARROW_TERMS)
        at, kinds, contents, keys = (run.column(c).to_pylist() for c in ("part_index", "kind", "content", "part_key"))
        items, ids, order = _listed(run.column("items")), run.column("run_id").slice(0, 1).to_pylist(), sorted(range(run.num_rows), key=at.__getitem__)
        batches = []
        with journal.open() as log:
            for first in range(0, len(order), BATCH):
                rows = []
                for i in order[first : first + BATCH]:
                    content, pairs, before = contents[i], items[i], prior
                    if (reply := told.get((keys[i], before), log.get(keys[i], before))) is None:
                        got, new = translator(kinds[i], content if pairs is None else list(pairs), Glossary(terms))
                        log.put(keys[i], before, reply := [got, [list(t) for t in new]])
                        told[keys[i], before] = reply
                    got, new = reply[0], [tuple(t) for t in reply[1]]
                    for t in new:
                        add(t)
                    if pairs is None:
                        rows.append((*ids, at[i], got or content, None, new))
                    else:
                        rows.append((*ids, at[i], None, [(k, v if (x := got.get(k)) is None else x) for k, v in pairs], new))
                *flat, pairs, proposed = zip(*rows, strict=True)
                columns = [*(pa.array(c, f.type) for c, f in zip(flat, fields, strict=False)), _nested(pairs, ARROW_PAIRS), _nested(proposed, ARROW_TERMS)]
                batches.append(pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)))
        return pa.Table.from_batches(batches, pa.schema(fields))

    known = _known(asked, seeds, store.replies("translations"))
    folded = asked.groupBy("run_id").cogroup(known.groupBy("run_id")).applyInArrow(fold, out)
    return store.settled(parts.join(folded, ["run_id", "part_index"]), "translated")


def _known(asked: DataFrame, seeds: DataFrame | None, replies: DataFrame | None) -> DataFrame:
    """What a run starts with, a row each: its seed terms, and replies that its parts' contents had earlier, under whatever glossary."""
    kind = asked.schema["run_id"].dataType
    terms, told = ("ord", "source", "target", "notes"), ("part_key", "prior_key", "reply")
    nothing = lambda *names: [F.lit(None).cast("long" if c == "ord" else "string").alias(c) for c in names]
    if seeds is None:
        seeds = asked.limit(0).select("run_id", *nothing(*terms))
    known = seeds.select(F.col("run_id").cast(kind).alias("run_id"), F.col("ord").cast("long").alias("ord"), *terms[1:], *nothing(*told))
    if replies is None:
        return known
    own = asked.select("run_id", "part_key").distinct().join(replies, "part_key")
    return known.unionByName(own.select("run_id", *nothing(*terms), *told))


REVIEW = "struct<text: string, pairs: map<string, string>, issues: array<struct<severity: string, description: string>>>"


#: Fixed value: into so many shares each run's parts go at most when they are reviewed.
SHARES = 16


def _noted(terms: DataFrame, notes: Notes, store: ReplyStore) -> DataFrame:
    """run_id and terms_key of each run's terms (run_id, ord, source, target, notes), which lie in a note of that name. One row a run is
    joined to its parts, not the glossary, which grows with them."""
    known = F.transform("terms", lambda t: F.array(t["source"], t["target"], t["notes"]))
    told = _glossaries(terms, "terms").select("run_id", known.alias("terms")).withColumn("terms_key", F.sha2(F.to_json("terms", {"ignoreNullFields": "false"}), 256))

    def note(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, rows in zip(b["terms_key"], b["terms"], strict=True):
                notes.put(key, [list(t) for t in rows])
            yield b[["run_id", "terms_key"]]

    return store.settled(told.mapInPandas(note, told.select("run_id", "terms_key").schema), "glossaries")


def review(translated: DataFrame, editor: Editor | None, terms: DataFrame | None = None, store: ReplyStore | None = None, settings: str = "") -> DataFrame:
    """translated with corrected texts and pairs in place, and issues, under each run's final terms (run_id, ord, source, target, notes).

    Parts are apart here. Those whose review under this translation, glossary and `settings` the store lacks are asked for once,
    when this is called; then all replies are joined. What the editor leaves out keeps its translation; without an
    editor all does, and nothing is an issue."""
    if editor is None:
        return translated.withColumn("issues", F.array().cast(ISSUES))
    store = store or ReplyStore.temporary(translated.sparkSession)
    earlier = store.replies("reviews")
    journal, final = store.journal("reviews"), store.notes("glossaries")
    keyed = translated.withColumn("part_key", part_key(settings, "kind", "content", "items")).withColumn("terms_key", F.lit(None).cast("string"))
    if terms is not None:
        keyed = keyed.drop("terms_key").join(_noted(terms, final, store), "run_id", "left")
    keys = ["part_key", "prior_key"]
    keyed = keyed.withColumn("prior_key", part_key(settings, "translation", "pairs", "terms_key"))
    todo = keyed.select(*keys, "terms_key", "kind", "content", "items", "translation", "pairs")
    if earlier is not None:
        todo = todo.join(earlier.select(*keys), keys, "left_anti")
    share = F.pmod(F.xxhash64(*keys), F.lit(SHARES)).alias("share")  # a run's parts lie in few tasks, each of which reads its glossary once
    todo = todo.select("*", share).repartition("terms_key", "share").sortWithinPartitions("terms_key", *keys)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, known = None, None, []
        with journal.open() as log:
            for b in batches:
                column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023,E731
                fields = [column(c).to_pylist() for c in (*keys, "terms_key", "kind", "content", "translation")]
                for part, prior, terms_key, kind, content, translation, items, given in zip(*fields, _listed(column("items")), _listed(column("pairs"), "translation"), strict=True):
                    if (part, prior) == last or log.get(part, prior) is not None:  # equal parts lie side by side; a task that runs again
                        continue
                    last = part, prior
                    if terms_key != at:
                        at, known = terms_key, [] if terms_key is None else [tuple(t) for t in final.get(terms_key)]
                    got, found = editor(kind, content if given is None else items, translation if given is None else given, Glossary(known))
                    issues = [{"severity": s, "description": d} for s, d in found]
                    log.put(part, prior, {"text": got, "issues": issues} if given is None else {"pairs": got, "issues": issues})
                yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["part_key"])

    todo.mapInArrow(ask, "part_key string").write.format("noop").mode("overwrite").save()
    replies = store.replies("reviews")
    replies = translated.limit(0).select(*[F.lit("").alias(c) for c in (*keys, "reply")]) if replies is None else replies
    replies = replies.select(*keys, F.from_json("reply", REVIEW).alias("_r"))
    kept = [c for c in translated.columns if c not in ("translation", "pairs")]
    text = F.coalesce(F.nullif(F.col("_r.text"), F.lit("")), F.col("translation"))
    pairs = F.transform("pairs", lambda p: F.struct(p["key"].alias("key"), F.coalesce(F.element_at("_r.pairs", p["key"]), p["translation"]).alias("translation")))
    checked = keyed.join(replies, keys).select(*kept, F.when(F.col("pairs").isNull(), text).alias("translation"), pairs.alias("pairs"), F.coalesce("_r.issues", F.array().cast(ISSUES)).alias("issues"))
    return store.settled(checked, "reviewed")


@dataclass
class Run:
    """What runs came to: every table is written, and none is computed again when it is read."""

    parts: DataFrame
    translated: DataFrame
    terms: DataFrame
    reviewed: DataFrame
    documents: DataFrame

    def issues(self) -> DataFrame:
        """run_id, part_index, severity and description."""
        return self.reviewed.select("run_id", "part_index", F.explode("issues").alias("i")).select("run_id", "part_index", "i.*")

    def files(self) -> DataFrame:
        """path and content of the files of all text parts: as made, translated and reviewed."""
        return part_files(self.parts).unionByName(part_files(self.translated, "translated", "translation")).unionByName(part_files(self.reviewed, "reviewed", "translation"))


def run(docs: DataFrame, translator: Translator, editor: Editor | None, seeds: DataFrame, *, parts: DataFrame | None = None, budget: int = BUDGET, pages: DataFrame | None = None, ranges: DataFrame | None = None, store: ReplyStore | None = None, settings: str = "") -> Run:
    """Whole runs over docs (run_id, source_index, kind, content): parts made and translated, reviewed under the final glossary, put together."""
    store = store or ReplyStore.temporary(docs.sparkSession)
    made = store.settled(make_parts(docs, budget, pages, ranges) if parts is None else parts, "parts")
    translated = translate(made, translator, seeds, store, settings)
    terms = store.settled(proposed_terms(translated, seeds), "terms")
    reviewed = review(translated, editor, terms, store, settings)
    return Run(made, translated, terms, reviewed, assemble(docs, reviewed))


def assemble(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """run_id, source_index, kind, content: each document put together from its translated or reviewed parts, by its kind's own way.

    Bundles, pages and subtitles are rebuilt from their sources (docs.content) with the translations in place; texts are
    their parts in order, plain for the text kind. A document's parts meet in one row by the nature of the result."""
    keyed = parts.withColumn("doc", F.struct(*DOC))
    words = keyed.where("pairs is not null").select("doc", "part_index", F.explode("pairs").alias("p"))
    words = words.select("doc", F.col("p.key").alias("key"), F.col("p.translation").alias("translation"), F.col("part_index").alias("ord"))
    of = lambda *kinds: docs.where(F.col("kind").isin(*kinds)).select(_doc(), F.col("content").alias("raw"), F.col("kind").alias("format"))
    by_pointer, by_cue = words.withColumnRenamed("key", "pointer"), words.withColumnRenamed("key", "cue")
    built = rebuild_json_docs(of("json"), by_pointer, "doc").unionByName(rebuild_html_docs(of("html"), by_pointer, "doc")).unionByName(rebuild_subtitles(of(*SUBTITLE_KINDS), by_cue, "doc"))
    text = assemble_text(keyed.where("translation is not null").select("doc", "kind", "part_index", "translation"), "doc", "translation")
    kinds = docs.select(_doc(), F.col("kind").alias("format"))
    texts = text.join(kinds, "doc").select("doc", F.when(F.col("format") == "text", strip_markdown(F.col("text"))).otherwise(F.col("text")).alias("raw"), "format")
    return built.select("doc", "raw", "format").unionByName(texts).select("doc.*", F.col("format").alias("kind"), F.col("raw").alias("content"))


def proposed_terms(translated: DataFrame, seeds: DataFrame) -> DataFrame:
    """run_id, ord, source, target, notes, origin: the final glossary of each run, seeds first, then what its parts proposed, in order."""
    found = translated.select("run_id", "part_index", F.posexplode("proposed").alias("n", "t"))
    order = (F.col("part_index").cast("long") + 1) * (1 << 31) + F.col("n")
    new = found.select("run_id", order.alias("ord"), "t.source", "t.target", "t.notes", F.lit("translator").alias("origin"))
    old = seeds.select("run_id", F.col("ord").cast("long").alias("ord"), "source", "target", "notes", F.lit("seed").alias("origin"))
    usable = (js_trim(F.col("source")) != "") & (js_trim(F.col("target")) != "")
    return merge_terms(old.unionByName(new).where(usable), ["run_id"])
