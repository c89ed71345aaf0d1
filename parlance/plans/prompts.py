"""Prompts as Columns: a header, what to do, and the part itself between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What to mind for each kind of part; the wording is this engine's own.
RULES = {
    "text": "Keep headings, lists, links and code as they are marked.",
    "srt": "Answer every cue under its own id, in order. Keep a cue's line breaks and its inline tags. Stay short enough to be read in the cue's time.",
    "ass": "Answer every cue under its own id, in order. Copy each override block in braces unchanged, and write line breaks as \\N. Stay short enough to be read in the cue's time.",
    "json": "Answer every entry under its own pointer. Copy placeholders unchanged; leave codes and addresses as they are.",
    "html": "Answer every entry under its own pointer, as plain text without tags or entities. Keep white space at a value's ends. Adjacent entries may be one sentence.",
}
ENTRY_FIELDS = {"srt": ("id", "text", "start", "end"), "ass": ("id", "text", "start", "end", "style"), "json": ("pointer", "value"), "html": ("pointer", "value")}


def entries_json(items: DataFrame, group: list[str], order: str, fields: list[str]) -> DataFrame:
    """group and body: the JSON list of a batch's items in order. A batch is bounded by its packing."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*fields)).alias("s"))))
    return items.groupBy(*group).agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["s"]), ","), F.lit("]")).alias("body"))


def _block(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"=== {name} ===\n"), body, F.lit(f"\n=== END OF {name} ==="))


def translation_prompt(kind: str, target: str, header: Column, body: Column) -> Column:
    """Null where header or body is null."""
    return F.concat(header, F.lit(f"\n\nTranslate into {target}. {RULES[kind]} Report terms that will recur.\n\n"), _block("SOURCE", body))


def review_prompt(kind: str, target: str, header: Column, body: Column, translation: Column | None = None) -> Column:
    """For text, source and translation follow one another; entries carry their translations in body."""
    task = F.lit(f"\n\nReview the translation into {target} against its source and the final glossary. {RULES[kind]} List what was wrong.\n\n")
    blocks = [_block("SOURCE", body)] if translation is None else [_block("SOURCE", body), F.lit("\n\n"), _block("TRANSLATION", translation)]
    return F.concat(header, task, *blocks)
