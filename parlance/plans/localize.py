"""The localization run: parts are translated in order while the glossary grows, reviewed, and put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import js_trim, strip_markdown
from ..operators.glossary import Term, trim

TERMS = ArrayType(StructType([StructField(n, StringType()) for n in ("source", "target", "notes")]))
ISSUES = ArrayType(StructType([StructField(n, StringType()) for n in ("severity", "description")]))
#: (content, glossary so far) to (translation, newly proposed terms); must be importable by the workers.
Translator = Callable[[str, list[Term]], tuple[str, list[Term]]]
#: (source, translation, final glossary) to (corrected, issues as (severity, description)).
Editor = Callable[[str, str, list[Term]], tuple[str, list[tuple[str, str]]]]


def translate_parts(parts: DataFrame, translator: Translator, run_col: str = "run_id") -> DataFrame:
    """(run, part_index, content) to run, part_index, translation, proposed: in part order inside a run, each part seeing earlier parts' terms.

    Runs are independent, so the fold is one group a run; an empty translation falls back to the source."""
    schema = parts.select(run_col).schema.add("part_index", "integer").add("translation", "string").add("proposed", TERMS)

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, Term] = {}
        rows = []
        for r in run.sort_values("part_index").itertuples():
            text, new = translator(r.content, list(known.values()))
            for t in new:
                known.setdefault(trim(t[0]).lower(), t)
            rows.append((getattr(r, run_col), r.part_index, text or r.content, [{"source": s, "target": t, "notes": n} for s, t, n in new]))
        return pd.DataFrame(rows, columns=schema.names)

    return parts.select(run_col, F.col("part_index").cast("int"), "content").groupBy(run_col).applyInPandas(fold, schema)


def review_parts(translated: DataFrame, terms: DataFrame, editor: Editor | None, run_col: str = "run_id", order: str = "ord") -> DataFrame:
    """translated (run, part_index, content, translation) to run, part_index, translation, issues, under each run's final glossary.

    Parts are independent here, so they stay where they are; only a run's glossary, which one prompt must hold, is gathered
    and joined to them. An empty correction falls back to the translation; without an editor parts pass with no issues.
    """
    schema = translated.select(run_col).schema.add("part_index", "integer").add("translation", "string").add("issues", ISSUES)
    parts = translated.select(run_col, F.col("part_index").cast("int"), "content", "translation")
    if editor is None:
        return parts.select(run_col, "part_index", "translation", F.array().cast(ISSUES).alias("issues"))
    final = terms.groupBy(run_col).agg(F.array_sort(F.collect_list(F.struct(order, "source", "target", "notes"))).alias("terms"))

    def review(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for run, index, content, translation, known in b.itertuples(index=False):
                text, issues = editor(content, translation, [] if known is None else [(t["source"], t["target"], t["notes"]) for t in known])
                rows.append((run, index, text or translation, [{"severity": s, "description": d} for s, d in issues]))
            yield pd.DataFrame(rows, columns=schema.names)

    return parts.join(final, run_col, "left").select(*parts.columns, "terms").mapInPandas(review, schema)


def issues_of(reviewed: DataFrame, run_col: str = "run_id") -> DataFrame:
    """run, part_index, severity and description of every issue."""
    return reviewed.select(run_col, "part_index", F.explode("issues").alias("i")).select(run_col, "part_index", "i.*")


def with_fallback(entries: DataFrame, replies: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """entries with the last reply for each key as translation; without one, the source value. Unknown keys are ignored."""
    last = replies.groupBy(*keys).agg(F.max_by("translation", "ord").alias("translation"))
    return entries.join(last, keys, "left").withColumn("translation", F.coalesce("translation", value))


def assemble_text(parts: DataFrame, id_col: str = "doc_id", value: str = "content", plain: bool = False) -> DataFrame:
    """id and text: the trimmed parts that are not empty, in order, with blank lines between; as plain text on demand."""
    rows = F.array_sort(F.collect_list(F.struct("part_index", js_trim(F.col(value)).alias("s"))))
    text = F.array_join(F.filter(F.transform(rows, lambda r: r["s"]), lambda s: s != ""), "\n\n")
    return parts.groupBy(id_col).agg((strip_markdown(text) if plain else text).alias("text"))


def report(parts: DataFrame, terms: DataFrame, issues: DataFrame, run_col: str = "run_id") -> DataFrame:
    """One row a run: numbers of parts, documents, glossary terms and issues. Each side is summed before the joins."""
    p = parts.groupBy(run_col).agg(F.count("*").alias("part_count"), F.countDistinct("source_index").alias("document_count"))
    t = terms.groupBy(run_col).agg(F.count("*").alias("term_count"))
    i = issues.groupBy(run_col).agg(F.count("*").alias("issue_count"))
    return p.join(t, run_col, "left").join(i, run_col, "left").fillna(0, ["term_count", "issue_count"])


def prompt_header(parts: DataFrame, target: str, source: str | None = None, style: str = "", total: str = "total") -> DataFrame:
    """parts (part_index, total, title, glossary) with the header of their prompts."""
    line = [
        F.lit(f"Target language: {target}"), F.lit(f"Source language: {source or 'detect from the text'}"),
        F.concat(F.lit("Part "), F.col("part_index"), F.lit(" of "), F.col(total)), F.concat(F.lit("Title: "), F.col("title")),
        F.lit(f"Style guide:\n{style or 'Keep the tone of the source.'}"), F.concat(F.lit("Glossary:\n"), F.coalesce(F.nullif(F.col("glossary"), F.lit("")), F.lit("No terms yet."))),
    ]
    return parts.withColumn("header", F.concat_ws("\n", *line))
