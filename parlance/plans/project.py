"""A folder localized from end to end: found, read, translated, reviewed, written and reported."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import OFFICE_KINDS
from ..operators import discover, glossary
from ..sources import files, office, sinks
from . import parts, prepare
from .store import ReplyStore

#: The style guide that holds, to translator and editor (None: no review).
Agents = Callable[[str], tuple[parts.Translator, parts.Editor | None]]


@dataclass
class Localized:
    """What a project came to: the run, and the files written for it (path, length)."""

    run: parts.Run
    written: DataFrame
    notes: list[str]


def require_sources(spark: SparkSession, root: str, sources: DataFrame) -> DataFrame:
    """sources (path), all of which are files under root; else the job fails and names one. Folders are listed once each."""
    folders = sorted({r["f"] for r in sources.select(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("f")).distinct().collect()})
    there = None
    for folder in folders:
        own = files.list_tree(spark, root, folder or ".", recursive=False).where("type = 'file'").select("path")
        there = own if there is None else there.unionByName(own)
    missing = sources if there is None else sources.join(there, "path", "left_anti")
    if (first := missing.select("path").orderBy("path").first()) is not None:
        raise FileNotFoundError(f"Source document not found: {first['path']!r} under {root!r}")
    return sources


def read_sources(spark: SparkSession, root: str, sources: DataFrame, kind: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """docs for a run (run_id, source_index, kind, content) of sources (run_id, source_index, path), and pages and ranges of paged ones."""
    paths = [r["path"] for r in sources.select("path").distinct().collect()]
    keyed = lambda read: sources.select("run_id", "source_index", "path").join(read, "path")
    if kind == "pdf":
        pages, ranges = parts.pdf_ranges(keyed(files.read_bytes(spark, root, paths)).select("run_id", "source_index", "content"))
        return sources.select("run_id", "source_index", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("content")), pages, ranges
    if kind in OFFICE_KINDS:
        read = office.office_markdown(keyed(files.read_bytes(spark, root, paths)).select("run_id", "source_index", "path", F.lit(kind).alias("kind"), "content"))
        read = office.required(read, F.col("path"))
    else:
        read = keyed(files.read_documents(spark, root, paths).select("path", F.lit(kind).alias("kind"), "content"))
    return read.select("run_id", "source_index", "kind", "content"), None, None


def localize_project(spark: SparkSession, root: str, target: str, agents: Agents, *, folder: str = ".", run_id: str = "run", source: str | None = None, style: str = "", output_path: str | None = None, budget: int = parts.BUDGET, store: ReplyStore | None = None) -> Localized:
    """Localizes the sources that discovery picks in a folder, with its glossary as seeds and its style guide after `style`.

    Writes the documents, the run's glossary, its parts as made, translated and reviewed, and a report, under the run's folder (or
    output_path, for documents). A project is small enough for the driver to list; its documents are read, translated and
    written by the workers. A run that was killed goes on from `store`. A folder without sources is an error."""
    listed = files.list_tree(spark, root, folder).where("type = 'file' and reason is null").select(F.lit(run_id).alias("project"), "path")
    found = discover.discover_projects(spark.createDataFrame([(run_id,)], "project string"), listed).first()
    if not found["source_paths"]:
        raise ValueError(f"no source documents in {folder!r}")
    kind = found["source_kind"]
    order = spark.createDataFrame([(run_id, i, p) for i, p in enumerate(found["source_paths"])], "run_id string, ord int, path string")
    runs = spark.createDataFrame([(run_id, target, output_path)], "run_id string, target string, output_path string")
    outputs = prepare.run_outputs(require_sources(spark, root, order), runs)
    docs, pages, ranges = read_sources(spark, root, outputs.select("run_id", "source_index", "path"), kind)
    guides = [found["style_path"]] if found["style_path"] else []
    told = {r["path"]: r["content"] for r in files.read_documents(spark, root, [*guides, *([found["glossary_path"]] if found["glossary_path"] else [])]).collect()}
    guide = "\n\n".join(x for x in (style.strip(), (told.get(found["style_path"]) or "").strip()) if x)
    own = spark.createDataFrame([(p, told[p]) for p in (found["glossary_path"],) if p], "path string, content string")
    seeds = glossary.load_glossaries(own).select(F.lit(run_id).alias("run_id"), "ord", "source", "target", "notes")
    translator, editor = agents(guide)
    settings = json.dumps([target, source, guide], ensure_ascii=False)
    run = parts.run(docs, translator, editor, seeds, budget=budget, pages=pages, ranges=ranges, store=store, settings=settings)
    base = f"{prepare.RUNS_FOLDER}/{run_id}"
    documents = run.documents.join(outputs.select("run_id", "source_index", "output_path"), ["run_id", "source_index"]).select(F.col("output_path").alias("path"), "content")
    terms = sinks.canonical_glossaries(run.terms, "run_id").select(F.lit(f"{base}/glossary.json").alias("path"), "content")
    about = parts.part_sources(run.parts, ranges).select("run_id", F.lit(target).alias("target"), F.lit(source).cast("string").alias("source_language"), "part_source", F.lit(editor is None).alias("skip_editor"))
    items = F.size("items")
    rows = run.parts.select("run_id", "part_index", "source_index", "title", "start_page", "end_page", F.when(F.col("kind").isin("json", "html"), items).alias("entry_count"), F.when(F.col("kind").isin("srt", "ass"), items).alias("cue_count"))
    report = prepare.report_files(about, outputs, rows, run.terms, run.issues()).select(F.lit(f"{base}/report.json").alias("path"), "content")
    text = run.files().select(F.concat(F.lit(f"{prepare.RUNS_FOLDER}/"), "path").alias("path"), "content")
    written = sinks.write_documents(documents.unionByName(terms).unionByName(report).unionByName(text), root)
    return Localized(run, written, list(found["notes"]))
