"""Before and after a run: its sources checked and named, its style guide put together, its report written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename_of, detect_kind, js_trim, output_format, output_name, pad_index

RUNS_FOLDER = "translation"


#: A run's settings where it names none.
DEFAULTS = {"max_part_chars": 20_000, "max_pages_per_part": 20, "min_pages_per_part": 2, "skip_editor": False}


def with_defaults(runs: DataFrame) -> DataFrame:
    """runs with every setting: the run's own, or the default."""
    own = lambda name, value: F.coalesce(F.col(name), F.lit(value)) if name in runs.columns else F.lit(value)
    return runs.withColumns({name: own(name, value) for name, value in DEFAULTS.items()})


def _first_of_each(sources: DataFrame, run_col: str, order: str) -> DataFrame:
    return sources.groupBy(run_col, "path").agg(F.min(order).alias("o"))


def run_outputs(sources: DataFrame, runs: DataFrame, run_col: str = "run_id", order: str = "ord") -> DataFrame:
    """sources (run, ord, path) under runs (run, target, output_path) to run, source_index, path, kind, format, output_path, cache.

    A path named twice counts once, at its first place. All sources of a run must be of one kind; otherwise the job fails
    and names the run. A single source is written to the run's output path, or under its own name in the run's folder.
    Several go into a folder, those of one name told apart by doc-NNN; only they have a cache folder each. Sources of a
    run that is not in runs, and runs without sources, have no rows; null paths are left out.
    """
    fmt, run = output_format(F.col("kind")), Window.partitionBy(run_col)
    named = (
        _first_of_each(sources.where("path is not null"), run_col, order).join(runs.select(run_col, "target", F.col("output_path").alias("wanted")), run_col)
        .withColumn("kind", detect_kind(F.col("path"))).withColumn("format", fmt).withColumn("name", output_name(F.col("path"), F.col("target"), F.col("format")))
    )
    placed = (
        named.withColumn("source_index", F.row_number().over(run.orderBy("o", "path")) - 1).withColumn("documents", F.count("*").over(run))
        .withColumn("kinds", F.array_sort(F.collect_set("kind").over(run))).withColumn("same", F.count("*").over(Window.partitionBy(run_col, "name")))
    )
    number = pad_index(F.col("source_index") + 1)
    folder = F.coalesce(F.regexp_replace("wanted", r"(?<=.)/+\z", ""), F.concat(F.lit(f"{RUNS_FOLDER}/"), F.col(run_col).cast("string")))
    unique = F.when(F.col("same") > 1, F.concat_ws("-", F.lit("doc"), number, "name")).otherwise(F.col("name"))
    target = F.when((F.col("documents") == 1) & F.col("wanted").isNotNull(), F.col("wanted")).otherwise(F.concat(folder, F.lit("/"), unique))
    mixed = F.raise_error(F.concat(F.lit("sources of different kinds in run "), F.col(run_col).cast("string"), F.lit(": "), F.array_join("kinds", ", ")))
    stem = F.regexp_replace(basename_of(F.col("path")), r"(?<=.)\.[^.]*\z", "")
    return placed.select(
        run_col, F.col("source_index").cast("int").alias("source_index"), "path", F.when(F.size("kinds") > 1, mixed.cast("string")).otherwise(F.col("kind")).alias("kind"),
        "format", target.alias("output_path"), F.when(F.col("documents") > 1, F.concat_ws("-", F.lit("doc"), number, stem)).alias("cache"),
    )


def style_guide(inline: Column, file: Column) -> Column:
    """Both trimmed, a blank line between them; nulls and blanks fall away."""
    parts = [F.nullif(js_trim(c), F.lit("")) for c in (inline, file)]
    return F.concat_ws("\n\n", *parts)


def report_files(runs: DataFrame, outputs: DataFrame, parts: DataFrame, terms: DataFrame, issues: DataFrame, run_col: str = "run_id") -> DataFrame:
    """run and content: each run's report as compact JSON, with nulls written out. A run without parts, terms or issues has empty lists and 0.

    A report lists all parts and issues of its run, so they meet in one row by its nature; other runs are apart from it.
    runs: run, target, source_language, part_source, skip_editor. outputs: as of run_outputs. parts: run, part_index,
    source_index, title, start_page, end_page, entry_count, cue_count. issues: run, part_index, severity, description.
    """
    listed = lambda t, key, cols, name: t.groupBy(run_col).agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in cols if c != key]))).alias(name))
    out = listed(outputs, "source_index", ["path", "output_path", "kind", "format"], "outputs")
    part = listed(parts, "part_index", ["source_index", "title", "start_page", "end_page", "entry_count", "cue_count"], "parts")
    found = listed(issues, "part_index", ["severity", "description"], "issues")
    terms = terms.groupBy(run_col).agg(F.count("*").alias("glossary_terms"))
    all_ = runs.join(out, run_col, "left").join(part, run_col, "left").join(found, run_col, "left").join(terms, run_col, "left")
    some = lambda name: F.coalesce(name, F.array().cast(all_.schema[name].dataType))
    shown = {
        "part_index": "index", "source_index": "sourceIndex", "title": "title", "start_page": "startPage", "end_page": "endPage", "entry_count": "entryCount", "cue_count": "cueCount",
    }
    body = F.struct(
        F.transform(some("outputs"), lambda o: o["path"]).alias("sourcePaths"),
        F.transform(some("outputs"), lambda o: F.struct(o["path"].alias("sourcePath"), o["output_path"].alias("outputPath"))).alias("outputs"),
        F.element_at(F.col("outputs"), 1)["kind"].alias("kind"), F.element_at(F.col("outputs"), 1)["format"].alias("outputFormat"),
        F.col("target").alias("targetLanguage"), F.col("source_language").alias("sourceLanguage"), F.col("skip_editor").alias("skipEditor"), F.col("part_source").alias("partSource"),
        F.size(some("parts")).alias("partCount"), F.size(some("outputs")).alias("documentCount"), F.coalesce("glossary_terms", F.lit(0)).alias("glossaryTermCount"),
        F.transform(some("issues"), lambda i: F.struct(i["part_index"].alias("partIndex"), i["severity"].alias("severity"), i["description"].alias("description"))).alias("issues"),
        F.transform(some("parts"), lambda p: F.struct(*[p[c].alias(name) for c, name in shown.items()])).alias("parts"),
    )
    return all_.select(run_col, F.to_json(body, {"ignoreNullFields": "false"}).alias("content"))
