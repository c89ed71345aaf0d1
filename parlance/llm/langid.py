"""Language identification by character models.

One interpolated Kneser-Ney model per language; the language with the lowest length-normalised cross-entropy wins. The
margin to the second is calibrated to a probability, and texts that no language explains can be rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import char_lm, vec
from .calibration import platt, probability

ORDER = 4
UNDETERMINED = "und"


@functools.cache
def letter_table() -> np.ndarray:
    """Letters to lower case, everything else to a space."""
    out = np.full(0x110000, char_lm.SPACE, np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@dataclass
class LanguageModel:
    chars: char_lm.CharModel
    slope: float
    shift: float
    limits: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the best class (-1: no letter), probability, and whether the text's cross-entropy is within that class's limit."""
        best, gap, entropy, _ = self.measure(data, offsets)
        p = np.where(best >= 0, probability(gap, self.slope, self.shift), 0.0)
        return best, p, (best >= 0) & (entropy <= self.limits[np.maximum(best, 0)])

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = char_lm.sequences(data, offsets, letter_table(), ORDER)
        n = s.lengths()
        entropy = -self.chars.scores(s) / np.maximum(n, 1)
        order = np.argsort(entropy, axis=0, kind="stable")
        first = np.take_along_axis(entropy, order[:1], 0)[0]
        second = np.take_along_axis(entropy, order[1:2], 0)[0] if len(entropy) > 1 else first + 1
        return np.where(n > 0, order[0], -1), (second - first) * np.sqrt(n), first, n


def train(docs: DataFrame, per_language: int = 1500, lang_col: str = "lang") -> LanguageModel:
    """Learns from about per_language documents of each non-null language of docs (doc_id, text, lang).

    A fifth of them, by a second hash of the id, is kept out of the counts and calibrates the probability and the limits."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang_col).alias("c"))
    rows = char_lm.stratified(rows, "c", per_language)
    held = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)) == 0
    tables = char_lm.count_grams(rows.where(~held), "c", letter_table, ORDER)
    if not tables:
        return LanguageModel(char_lm.CharModel([], ORDER, np.zeros(0)), 1.0, 0.0, np.zeros(1))
    chars = char_lm.build(tables, ORDER, np.zeros(0), modified=False)
    model = LanguageModel(chars, 1.0, 0.0, np.full(len(chars.classes), np.inf))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in vec.text_blocks(b.column(1)):
                best, gap, entropy, _ = shared.value.measure(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(best), pa.array(gap), pa.array(entropy)], ["c", "best", "gap", "entropy"])

    got = rows.where(held).select("c", "text").mapInArrow(measure, "c string, best long, gap double, entropy double").where("best >= 0").toArrow()
    if got.num_rows:
        truth = np.array(got["c"].to_pylist(), dtype=object)
        best, gap, entropy = (got[k].to_numpy() for k in ("best", "gap", "entropy"))
        right = np.array([chars.classes[i] for i in best], dtype=object) == truth
        model.slope, model.shift = platt(gap, right)
        for i in range(len(chars.classes)):
            own = entropy[(best == i) & right]
            if len(own):  # the upper end of what is usual, and as much again
                model.limits[i] = 2 * np.quantile(own, 0.99) - np.quantile(own, 0.5)
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without the text, unless keep_text) with lang_pred, score (0 to 1) and accepted.

    accepted is false for undetermined texts and for those whose cross-entropy lies beyond the limit of their language.

    Defined cases: a null text, and one without a letter, is "und" with score 0, as is every text when nothing was
    learned; of equal entropies the language first by name wins; very long texts are scored whole; repeated rows are
    scored each; an empty table gives an empty result; earlier columns named lang_pred, score or accepted are replaced.
    """
    added = ("lang_pred", "score", "accepted")
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text_col).alias("_text"), *kept)
    schema = source.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean") if kept else "lang_pred string, score double, accepted boolean"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.chars.classes, UNDETERMINED]
        for b in batches:
            parts = []
            for _, _, data, offsets in vec.text_blocks(b.column(0)):
                if names[:-1]:
                    parts.append(model.predict(data, offsets))
                else:
                    n = len(offsets) - 1
                    parts.append((np.full(n, -1), np.zeros(n), np.zeros(n, bool)))
            if parts:
                best, p, fine = (np.concatenate(x) for x in zip(*parts, strict=True))
                pred = pa.array([names[i] for i in best], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pred, pa.array(p), pa.array(fine)], [*b.schema.names[1:], *added])

    return source.mapInArrow(predict, schema)
