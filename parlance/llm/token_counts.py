"""Token counts under a SentencePiece model by a two-tier lookup on the map side.

No piece of the model has a space mark after another character, so a text's pieces are those of its parts, each a run of
spaces with what follows. Lengths of frequent parts are looked up in a broadcast hash table; other parts are encoded by the
library through a cache in each worker. No part is ever shuffled: to choose the table's parts, summaries of the partitions'
heaviest ones, of bounded size, are merged in a tree, and the choice changes no count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .frequent import frequent

#: Entries of a worker's cache of rare parts.
CACHE = 200_000
MARK = "▁"

OUT_COLUMNS = (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean"))


def parts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space put before each that is not empty (the library's dummy prefix), the parts' borders, and each text's first part."""
    sizes = np.diff(offsets)
    grown = np.zeros(len(offsets), np.int64)
    np.cumsum(sizes + (sizes > 0), out=grown[1:])
    out = np.full(int(grown[-1]), 0x20, np.uint8)
    out[vec.ragged(grown[:-1] + (sizes > 0), sizes)] = data
    space = out == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[grown[:-1][sizes > 0]] = True
    starts = np.flatnonzero(start)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, grown)


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out, starts, ends, _ = parts_of(data, offsets)
    return out, starts, ends


@functools.lru_cache(maxsize=2)
def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Raises if the model's pieces or settings do not allow texts to be cut at spaces."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    rule = proto.normalizer_spec
    if rule.name != "identity" or rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normalisation does not keep spaces")
    for p in proto.pieces:
        if p.type == p.USER_DEFINED or p.type == p.NORMAL and MARK in p.piece.lstrip(MARK):
            raise ValueError(f"a piece crosses parts: {p.piece!r}")


class PartCounter:
    """Both tiers inside one worker."""

    def __init__(self, model: bytes, table: tuple[vec.HashIndex, np.ndarray]):
        self.library, (self.index, self.lengths), self.cache = _library(model), table, {}

    def encode(self, parts: list[bytes]) -> list[int]:
        """Lengths by the library, which puts back the first space itself, though not before nothing: a lone space is one piece."""
        return [len(x) or 1 for x in self.library.encode([p[1:].decode("utf-8") for p in parts], num_threads=1)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if MARK.encode() in (raw := data.tobytes()):  # the mark in a text is a space to the library
            texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([len(self.library.encode(t, num_threads=1)) if t else 0 for t in texts], np.int64)
        out, starts, ends, first = parts_of(data, offsets)
        h = vec.span_hashes(out, starts, ends)
        found = self.index.find(h)
        n = np.where(found >= 0, self.lengths[found], 0).astype(np.int64)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            keys, one, which = np.unique(h[miss], return_index=True, return_inverse=True)
            got = np.zeros(len(keys), np.int64)
            todo = []
            for i, k in enumerate(keys.tolist()):
                if (c := self.cache.get(k)) is None:
                    todo.append(i)
                else:
                    got[i] = c
            if todo:
                at = miss[one[todo]]
                lengths = self.encode([out[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                got[todo] = lengths
                if len(self.cache) + len(todo) > CACHE:
                    self.cache = {}
                self.cache.update(zip(keys[todo].tolist(), lengths, strict=True))
            n[miss] = got[which]
        return vec.group_sums(n, first)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096, words: int = 65536, report: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) for every row.

    The `words` most frequent parts of all texts go into the broadcast table: 16 bytes each. They are found from counts of
    all parts, of which each partition reports at most `report`, in one summary.

    Defined cases: a null text counts as empty, and has no bytes and no tokens; texts of any length are counted whole;
    special strings inside a text are ordinary text, as the library has it; repeated rows are counted each; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        model = f.read()
    check_model(model)
    top = [w for w, _ in frequent(docs.select(F.col(text_col).alias("text")), lambda: _cut, words, report)]
    joined, ptr = np.frombuffer(b"".join(top), np.uint8), np.cumsum([0] + [len(w) for w in top])
    keys = vec.span_hashes(joined, ptr[:-1], ptr[1:])
    order = np.argsort(keys)
    none = vec.HashIndex(np.zeros(0, np.uint64)), np.zeros(1, np.int32)
    lengths = np.array(PartCounter(model, none).encode(top), np.int32)
    shared = spark.sparkContext.broadcast((model, (vec.HashIndex(keys[order]), np.append(lengths[order], 0))))
    source = docs.select(id_col, text_col)
    schema = source.select(id_col).schema
    for c in OUT_COLUMNS:
        schema = schema.add(*c)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PartCounter(*shared.value)
        for b in batches:
            for lo, hi, data, offsets in vec.text_blocks(b.column(1), 2 * vec.BLOCK):
                n = counter.counts(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], schema.names)

    return source.mapInArrow(scan, schema)
