"""Translators and editors over a language model: what it is asked, and what counts as an answer.

The model is a function from a prompt to a reply that the caller hands in. A reply that is not of its shape is asked for
again, with what was wrong with it; a model that never gives one fails the part.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.text import OFFICE_KINDS
from ..operators.glossary import Term
from .prompts import RULES
from .replies import SEVERITIES

#: Fixed value: replies that are asked for at most.
ATTEMPTS = 20
Model = Callable[[str], str]


class NoReply(Exception):
    """The model gave no reply of the shape that was asked for."""


def rules_of(kind: str) -> str:
    """The kind whose rules hold; paged, office and markdown parts are text."""
    return "text" if kind in ("markdown", "text", "pdf", *OFFICE_KINDS) else kind


def header(target: str, source: str | None, style: str, terms: list[Term]) -> str:
    """What holds for every part: languages, style and the glossary so far."""
    lines = "\n".join(f"- {s} => {t}" + (f" — {n}" if n else "") for s, t, n in terms) or "No terms yet."
    return f"Target language: {target}\nSource language: {source or 'detect from the text'}\nStyle guide:\n{style or 'Keep the tone of the source.'}\nGlossary:\n{lines}"


def _block(name: str, body: str) -> str:
    return f"=== {name} ===\n{body}\n=== END OF {name} ==="


def read_reply(raw: str, kind: str, word: str, extra: str) -> tuple[object, list[dict]]:
    """The translation (text, or by key) and the list beside it. ValueError says what is wrong."""
    got = json.loads(raw)
    if not isinstance(got, dict):
        raise ValueError("not an object")
    name, key = {"text": (word, ""), "srt": ("cues", "id"), "ass": ("cues", "id")}.get(kind, ("entries", "pointer"))
    main, more = got.get(name), got.get(extra) or []
    if name == word:
        if not isinstance(main, str):
            raise ValueError(f"no text {word}")
    else:
        if not isinstance(main, list) or not all(isinstance(e, dict) and isinstance(e.get(key), str) and isinstance(e.get(word), str) for e in main):
            raise ValueError(f"{name} need {key} and {word}")
        main = {e[key]: e[word] for e in main}  # the last for a key counts
    fields = ("source", "target") if extra == "newTerms" else ("severity", "description")
    if not isinstance(more, list) or not all(isinstance(e, dict) and all(isinstance(e.get(f), str) for f in fields) for e in more):
        raise ValueError(f"{extra} need {' and '.join(fields)}")
    if extra == "issues" and any(e["severity"] not in SEVERITIES for e in more):
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
    return main, more


def asked(model: Model, prompt: str, kind: str, word: str, extra: str) -> tuple[object, list[dict]]:
    wrong = ""
    for _ in range(ATTEMPTS):
        try:
            return read_reply(model(prompt + wrong), kind, word, extra)
        except ValueError as e:
            wrong = f"\n\nThe last reply was not valid: {e}. Reply with one JSON object."
    raise NoReply(f"no valid reply in {ATTEMPTS} attempts")


@dataclass
class ModelTranslator:
    """A translator for parts.run: one prompt a part, with the glossary that the part sees."""

    model: Model
    target: str
    source: str | None = None
    style: str = ""

    def __call__(self, kind: str, body: object, terms: list[Term]) -> tuple[object, list[Term]]:
        kind = rules_of(kind)
        key = "id" if kind in ("srt", "ass") else "pointer"
        said = body if isinstance(body, str) else json.dumps([{key: k, "text" if key == "id" else "value": v} for k, v in body], ensure_ascii=False)
        prompt = f"{header(self.target, self.source, self.style, terms)}\n\nTranslate into {self.target}. {RULES[kind]} Report terms that will recur.\n\n{_block('SOURCE', said)}"
        got, new = asked(self.model, prompt, kind, "translation", "newTerms")
        return got, [(t["source"], t["target"], t["notes"] if isinstance(t.get("notes"), str) else None) for t in new]


@dataclass
class ModelEditor:
    """An editor for parts.run: source and translation under the final glossary."""

    model: Model
    target: str
    source: str | None = None
    style: str = ""

    def __call__(self, kind: str, source: object, translation: object, terms: list[Term]) -> tuple[object, list[tuple[str, str]]]:
        kind = rules_of(kind)
        key = "id" if kind in ("srt", "ass") else "pointer"
        if isinstance(translation, str):
            said = f"{_block('SOURCE', source)}\n\n{_block('TRANSLATION', translation)}"
        else:
            own = dict(source)
            said = _block("SOURCE", json.dumps([{key: k, "source": own.get(k), "translation": v} for k, v in translation], ensure_ascii=False))
        prompt = f"{header(self.target, self.source, self.style, terms)}\n\nReview the translation into {self.target} against its source and the final glossary. {RULES[kind]} List what was wrong.\n\n{said}"
        got, issues = asked(self.model, prompt, kind, "correctedTranslation", "issues")
        return got, [(i["severity"], i["description"]) for i in issues]
