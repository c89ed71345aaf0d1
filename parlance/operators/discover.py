"""Project discovery: which files are sources, glossaries and style guides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename_of, detect_kind, extension_of

#: Folders that are never entered.
SKIPPED_FOLDERS = ("translation", "localization", "node_modules", ".git", ".mastra")
#: Which kind wins among equally many files.
KIND_ORDER = ("pdf", "doc", "docx", "epub", "odt", "rtf", "srt", "ass", "html", "json", "markdown", "text")
#: Names that win among several glossaries, and among several style guides, best first.
GLOSSARY_NAMES = ("glossary.csv", "glossary.json", "glossary.md", "glossary.txt", "terms.csv", "terminology.csv", "terms.json")
STYLE_NAMES = (
    "guide.md", "guide.txt", "instruction.md", "instruction.txt", "style_guide.md", "style-guide.md", "style.md", "style.txt", "styleguide.md", "tone.md",
)
_GLOSSARY = r"(?i)(^|[-_. ])(glossary|terminology|terminologies|terms|vocab|vocabulary)([-_. ]|\z)"
_STYLE = r"(?i)(^|[-_. ])(style-guide|guide|instruction|styleguide|style|tone|voice)([-_. ]|\z)"


def is_hidden(path: Column) -> Column:
    """Inside a skipped or dotted folder, or a dotted file."""
    return F.exists(F.split(path, "/"), lambda s: s.isin(*SKIPPED_FOLDERS) | (s.startswith(".") & ~s.isin(".", "..")))


def is_glossary(path: Column) -> Column:
    return extension_of(path).isin("csv", "json", "md", "markdown", "txt") & basename_of(path).rlike(_GLOSSARY)


def is_style_guide(path: Column) -> Column:
    return ~is_glossary(path) & extension_of(path).isin("md", "markdown", "txt") & basename_of(path).rlike(_STYLE)


def in_locale(path: str | Column) -> Column:
    """A key that sorts paths as the root locale does: letters first, then case and accents."""
    return F.collate(F.col(path) if isinstance(path, str) else path, "UNICODE")


def listed_paths(path: str = "path") -> Column:
    """A group's paths in the locale's order; those that are equal to it, by bytes."""
    rows = F.array_sort(F.collect_list(F.struct(in_locale(path).alias("k"), F.col(path).alias("p"))))
    return F.transform(rows, lambda r: r["p"])


def pick_preferred(files: DataFrame, names: Sequence[str], group: str = "project") -> DataFrame:
    """One file of each group: the best ranked exact name (of one name, the last path), else the first path."""
    name = F.lower(basename_of(F.col("path")))
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    rank = F.when(rank > 0, rank)
    last = F.row_number().over(Window.partitionBy(group, "_rank").orderBy(in_locale("path").desc(), F.desc("path")))
    order = Window.partitionBy(group).orderBy(F.col("_rank").asc_nulls_last(), F.when(F.col("_rank").isNotNull(), F.col("_last")), in_locale("path"), "path")
    ranked = files.withColumn("_rank", rank).withColumn("_last", last).withColumn("_n", F.row_number().over(order))
    return ranked.where("_n = 1").select(group, "path")


def classify_files(files: DataFrame) -> DataFrame:
    """files (project, path) with role: skipped, glossary, style or source; and kind of the sources."""
    p = F.col("path")
    role = F.when(is_hidden(p), "skipped").when(is_glossary(p), "glossary").when(is_style_guide(p), "style").otherwise("source")
    return files.withColumn("role", role).withColumn("kind", F.when(F.col("role") == "source", detect_kind(p)))


def pick_source_kind(classified: DataFrame, group: str = "project") -> DataFrame:
    """Each project's kind with the most source files; KIND_ORDER breaks ties."""
    counts = classified.where("role = 'source'").groupBy(group, "kind").agg(F.count("*").alias("files"))
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    best = F.min_by(F.struct("kind", "files"), F.struct((-F.col("files")).alias("a"), order.alias("b")))
    return counts.groupBy(group).agg(best.alias("b")).select(group, "b.kind", "b.files")


def discover_projects(projects: DataFrame, files: DataFrame, group: str = "project") -> DataFrame:
    """What each project (projects: project) holds among its files (project, path): project, source_kind, source_paths, glossary_path,
    glossary_candidates, style_path, style_candidates, other_kinds (kind and number of files), notes (codes).

    Paths are in the order of the root locale. Notes: no_sources, other_kinds_left_out, no_glossary, several_glossaries, no_style_guide, several_style_guides.
    A project's listing is one row by its nature; files of all projects are classified where they are.
    """
    roles = classify_files(files)
    paths = lambda role, name: roles.where(F.col("role") == role).groupBy(group).agg(listed_paths().alias(name))
    best = lambda role, names, name: pick_preferred(roles.where(F.col("role") == role), names, group).withColumnRenamed("path", name)
    kinds = roles.where("role = 'source'").groupBy(group, "kind").agg(listed_paths().alias("p"))
    by_kind = kinds.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("kind", "p"))).alias("_kinds"))
    all_ = projects.select(group).distinct()
    for part in (
        pick_source_kind(roles, group).select(group, F.col("kind").alias("source_kind")), by_kind, paths("glossary", "glossary_candidates"), paths("style", "style_candidates"),
        best("glossary", GLOSSARY_NAMES, "glossary_path"), best("style", STYLE_NAMES, "style_path"),
    ):
        all_ = all_.join(part, group, "left")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    own = F.element_at(F.filter("_kinds", lambda k: k["kind"] == F.col("source_kind")), 1)["p"]
    kinds_or_none = F.coalesce("_kinds", F.array().cast("array<struct<kind: string, p: array<string>>>"))
    left_out = F.filter(kinds_or_none, lambda k: k["kind"] != F.col("source_kind"))
    others = F.transform(left_out, lambda k: F.struct(k["kind"].alias("kind"), F.size(k["p"]).alias("files")))
    got = all_.select(
        group, "source_kind", listed(own).alias("source_paths"), "glossary_path", listed(F.col("glossary_candidates")).alias("glossary_candidates"),
        "style_path", listed(F.col("style_candidates")).alias("style_candidates"), others.alias("other_kinds"),
    )
    notes = [
        (F.size("source_paths") == 0, "no_sources"), ((F.size("source_paths") > 0) & (F.size("other_kinds") > 0), "other_kinds_left_out"), (F.col("glossary_path").isNull(), "no_glossary"),
        (F.size("glossary_candidates") > 1, "several_glossaries"), (F.col("style_path").isNull(), "no_style_guide"), (F.size("style_candidates") > 1, "several_style_guides"),
    ]
    return got.withColumn("notes", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in notes])))
