"""Structured replies of models: six shapes, read by from_json, with absent lists as empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = "newTerms: array<struct<source: string, target: string, notes: string>>"
_ISSUES = "issues: array<struct<severity: string, description: string>>"
SEVERITIES = ("low", "medium", "high")
#: Fields of the six replies.
SHAPES = {
    "text_translation": f"struct<translation: string, {_TERMS}>",
    "text_review": f"struct<correctedTranslation: string, {_ISSUES}>",
    "entry_translation": f"struct<entries: array<struct<pointer: string, translation: string>>, {_TERMS}>",
    "entry_review": f"struct<entries: array<struct<pointer: string, correctedTranslation: string>>, {_ISSUES}>",
    "cue_translation": f"struct<cues: array<struct<id: string, translation: string>>, {_TERMS}>",
    "cue_review": f"struct<cues: array<struct<id: string, correctedTranslation: string>>, {_ISSUES}>",
}
#: Fields without which a reply or an element of its lists is not valid.
_REQUIRED = {"newTerms": ("source", "target"), "issues": ("severity", "description")}


def parse_reply(raw: Column, shape: str) -> Column:
    """The reply as a struct; null where raw is null, no JSON, or not of this shape."""
    got = F.from_json(raw, SHAPES[shape])
    fields = [f.split(":")[0] for f in SHAPES[shape].removeprefix("struct<").split(", ") if f.split(":")[0] in ("translation", "correctedTranslation", "entries", "cues")]
    main = fields[0]
    extra = "newTerms" if shape.endswith("translation") else "issues"
    valid = got[main].isNotNull()
    if main in ("entries", "cues"):
        names = ("pointer" if main == "entries" else "id", "translation" if shape.endswith("translation") else "correctedTranslation")
        valid &= F.forall(got[main], lambda e: e[names[0]].isNotNull() & e[names[1]].isNotNull())
    more = F.coalesce(got[extra], F.array().cast(_TERMS.split(": ", 1)[1] if extra == "newTerms" else _ISSUES.split(": ", 1)[1]))
    valid &= F.forall(more, lambda e: e[_REQUIRED[extra][0]].isNotNull() & e[_REQUIRED[extra][1]].isNotNull())
    if extra == "issues":
        valid &= F.forall(more, lambda e: e["severity"].isin(*SEVERITIES))
    return F.when(valid, F.struct(got[main].alias(main), more.alias(extra)))
