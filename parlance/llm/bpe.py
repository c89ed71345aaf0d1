"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

The corpus's frequent words are compiled, with their token ids, into a minimal acyclic transducer that every worker maps
into memory. Words that it lacks are merged exactly. Decoding joins the tokens' bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import vec
from .common import share_file
from .frequent import frequent
from .lexicon import Lexicon

_U = np.uint64
_OTHER, _LETTER, _NUMBER, _SPACE, _SPECIAL = range(5)
_NEVER = np.int32(2**31 - 1)
#: What may follow an apostrophe in a contraction.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def character_classes() -> np.ndarray:
    """The tokenizer library's own view of letters, numbers and white space, by code point."""
    from tokenizers import Regex, pre_tokenizers

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = "".join(map(chr, points))
    where = np.array(points)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        inside = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        out[where[inside]] = kind
    return out


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and the byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteBPE:
    """Arrays of one vocabulary; small enough to broadcast (a few MB, fixed by the vocabulary)."""

    classes: np.ndarray
    byte_ids: np.ndarray
    pairs: vec.HashIndex
    ranks: np.ndarray
    merged: np.ndarray
    token_ptr: np.ndarray
    token_bytes: np.ndarray
    digit_ptr: np.ndarray
    digit_bytes: np.ndarray
    special: dict[bytes, int]

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], byte_characters()
        special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        byte_ids = np.zeros(256, np.int32)
        for ch, b in to_byte.items():
            byte_ids[b] = vocab[ch]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = vec.mix(np.array([vocab[a] for a, _ in merges], _U) << _U(32) | np.array([vocab[b] for _, b in merges], _U))
        order = np.argsort(key)
        texts = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in vocab.items()} | {i: t for t, i in special.items()}
        n = max(texts) + 1
        tokens, digits = [texts.get(i, b"") for i in range(n)], [b"%d," % i for i in range(n)]
        ptr = lambda parts: np.cumsum([0] + [len(p) for p in parts])
        flat = lambda parts: np.frombuffer(b"".join(parts), np.uint8)
        return cls(
            character_classes(), byte_ids, vec.HashIndex(key[order]), np.arange(len(merges), dtype=np.int32)[order], np.array([vocab[a + b] for a, b in merges], np.int32)[order],
            ptr(tokens), flat(tokens), ptr(digits), flat(digits), special,
        )

    def pre_tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte borders of the pre-tokens of all texts (one more at the end), each text's first, and the id of special ones (else -1)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[points]
        n = len(points)
        border = np.zeros(n + 1, bool)
        border[np.searchsorted(place, offsets)] = True
        marks = []
        if self.special:
            pattern = b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
            for m in re.finditer(pattern, raw):
                if np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end() - 1, "right"):
                    a, b = np.searchsorted(place, (m.start(), m.end()))
                    kind[a:b] = _SPECIAL
                    border[[a, b]] = True
                    marks.append((m.start(), self.special[m[0]]))
        border = border[:n]
        start = border.copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        after = np.zeros(n, bool)  # not white space, after white space of the same text
        after[1:] = space[:-1] & ~space[1:] & ~border[1:]
        at = np.flatnonzero(after)
        start[at - 1] = True
        start[at[points[at - 1] == 0x20]] = False
        for i in np.flatnonzero((points == 0x27) & start & (kind == _OTHER)).tolist():
            tail = ""
            for j in range(i + 1, min(i + 3, n)):
                if border[j]:
                    break
                tail += chr(points[j])
            hit = next((c for c in _CONTRACTIONS if tail.startswith(c)), None)
            if hit:
                start[i + 1] = False
                end = i + 1 + len(hit)
                start[i + 2 : end] = False
                if end < n:
                    # a space there begins its own token already; anything else starts one
                    start[end] = True
        borders = np.append(place[start], len(data))
        ids = np.full(len(borders) - 1, -1, np.int32)
        for a, i in marks:
            ids[np.searchsorted(borders, a)] = i
        return borders, np.searchsorted(borders[:-1], offsets), ids

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words, one word after another, and their borders: in each round every word merges its best pair."""
        sizes = ends - starts
        ids = self.byte_ids[data[vec.ragged(starts, sizes)]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = self._pair_ranks(ids, word)
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            open_ = best != _NEVER
            length = np.diff(np.append(first, len(ids)))
            if not open_.all():
                keep = np.repeat(open_, length)
                done.append((word[~keep], ids[~keep]))
                ids, word, rank, into, best, length = ids[keep], word[keep], rank[keep], into[keep], best[open_], length[open_]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, length)
            # of overlapping pairs, as in "aaa", the first, third ... of a run is merged
            twice = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(twice):
                at = np.flatnonzero(hit)
                run = np.flatnonzero(np.append(True, np.diff(at) != 1))
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                hit[at[nth % 2 == 1]] = False
            at = np.flatnonzero(hit)
            ids[at] = into[at]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            place = np.cumsum(~gone) - 1
            ids, word, rank, into = ids[~gone], word[~gone], rank[~gone], into[~gone]
            new = place[at]
            near = np.zeros(len(ids), bool)
            near[new] = near[np.maximum(new - 1, 0)] = True
            touched = np.flatnonzero(near)
            rank[touched], into[touched] = self._pair_ranks(ids, word, touched)
        words, all_ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(words, kind="stable")
        return all_ids[order].astype(np.int32), np.searchsorted(words[order], np.arange(len(sizes) + 1))

    def _pair_ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each place's pair with the next of its word, and the id that it makes."""
        at = np.arange(len(ids)) if at is None else at
        after = np.minimum(at + 1, max(len(ids) - 1, 0))
        found = self.pairs.find(vec.mix(ids[at].astype(_U) << _U(32) | ids[after].astype(_U)))
        good = (found >= 0) & (after > at) & (word[after] == word[at])
        return np.where(good, self.ranks[found], _NEVER), np.where(good, self.merged[found], -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts and each text's first."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        borders, first, special = self.pre_tokens(data, offsets)
        starts, ends = borders[:-1], borders[1:]
        number = lexicon.find(data, starts, ends) if lexicon is not None else np.full(len(starts), -1, np.int32)
        number[special >= 0] = -1
        miss = np.flatnonzero((number < 0) & (special < 0))
        _, one, which = np.unique(vec.span_hashes(data, starts[miss], ends[miss]), return_index=True, return_inverse=True)
        new_ids, new_ptr = self.merge(data, starts[miss[one]], ends[miss[one]])
        size = np.ones(len(starts), np.int64)
        hit = np.flatnonzero(number >= 0)
        if len(hit):
            size[hit] = lexicon.out_ptr[number[hit] + 1] - lexicon.out_ptr[number[hit]]
        size[miss] = np.diff(new_ptr)[which]
        ptr = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ptr[1:])
        out = np.empty(int(ptr[-1]), np.int32)
        if len(hit):
            out[vec.ragged(ptr[hit], size[hit])] = lexicon.out_ids[vec.ragged(lexicon.out_ptr[number[hit]].astype(np.int64), size[hit])]
        out[vec.ragged(ptr[miss], size[miss])] = new_ids[vec.ragged(new_ptr[which], size[miss])]
        marked = np.flatnonzero(special >= 0)
        out[ptr[marked]] = special[marked]
        return out, ptr[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of runs of ids: the tokens' bytes, with U+FFFD for what is not UTF-8. Unknown ids give nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.token_ptr) - 1), ids, -1)
        known = ids >= 0
        size = np.where(known, self.token_ptr[ids + 1] - self.token_ptr[ids], 0)
        raw = self.token_bytes[vec.ragged(self.token_ptr[ids], size)].tobytes()
        ptr = np.append(0, np.cumsum(size))[first].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ptr[:-1], ptr[1:], strict=True)]

    def id_lists(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, joined by commas."""
        size = self.digit_ptr[ids + 1] - self.digit_ptr[ids]
        raw = self.digit_bytes[vec.ragged(self.digit_ptr[ids], size)].tobytes()
        ptr = np.append(0, np.cumsum(size))[first].tolist()
        return [raw[a : b - 1] if b > a else b"" for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def _opened(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


class Codec:
    """A vocabulary with the lexicon compiled for a corpus; encodes and decodes DataFrames."""

    def __init__(self, docs: DataFrame, path: str, words: int = 65536, limit: int = 200_000):
        """Compiles the `words` most frequent pre-tokens of docs.text. `limit` bounds what each partition reports of its counts."""
        spark = docs.sparkSession
        self.bpe = ByteBPE.load(path)
        self.shared = shared = spark.sparkContext.broadcast(self.bpe)

        def split():
            bpe = shared.value

            def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                borders, _, special = bpe.pre_tokens(data, offsets)
                plain = special < 0
                return data, borders[:-1][plain], borders[1:][plain]

            return cut

        top = [w for w, _ in frequent(docs, split, words, limit)]
        joined, ptr = np.frombuffer(b"".join(top), np.uint8), np.cumsum([0] + [len(w) for w in top])
        ids, at = self.bpe.merge(joined, ptr[:-1], ptr[1:])
        self.lexicon = Lexicon.build({w: ids[at[i] : at[i + 1]].tolist() for i, w in enumerate(top)})
        self.name = share_file(spark, "lexicon", self.lexicon.to_bytes())

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id and ids (the token ids; none for a null or empty text), for every row."""
        return self._scan(docs.select(id_col, text_col), "ids array<int>", lambda bpe, ids, first: [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))])

    def decode(self, tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """id and text, for every row; null ids give a null text."""
        shared = self.shared
        source = tokens.select(id_col, F.col(ids_col).cast("array<int>").alias("ids"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                texts = shared.value.decode(ids, np.append(0, np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], [id_col, "text"])

        return source.mapInArrow(scan, source.select(id_col).schema.add("text", "string"))

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of what they decode to, for every row.

        Defined cases: a null text counts as empty, and has no tokens; texts of any length are encoded whole; special
        strings inside a text become their special ids, as the library does; repeated rows and ids are encoded each; an
        empty table gives an empty result; other columns are not read.
        """
        sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        return self._scan(
            docs.select(id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string",
            lambda bpe, ids, first: [pa.array(np.diff(first)), sha(bpe.id_lists(ids, first)), sha(t.encode() for t in bpe.decode(ids, first))],
        )

    def _scan(self, source: DataFrame, columns: str, make) -> DataFrame:
        shared, name = self.shared, self.name
        schema = source.select(source.columns[0]).schema
        for c in columns.split(", "):
            name_, kind = c.split(" ")
            schema = schema.add(name_, ArrayType(IntegerType()) if kind == "array<int>" else kind)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe, lexicon = shared.value, _opened(name)
            for b in batches:
                for lo, hi, data, offsets in vec.text_blocks(b.column(1), 2 * vec.BLOCK):
                    ids, first = bpe.encode(data, offsets, lexicon)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *make(bpe, ids, first)], schema.names)

        return source.mapInArrow(scan, schema)
