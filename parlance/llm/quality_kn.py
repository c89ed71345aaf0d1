"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

N-grams are of characters. Spark counts them over all trusted rows but those that set the limits, and interpolates the orders by
joins, so that the model is a table in hash shards. To score documents, they are packed into blocks; each block asks once for every
distinct n-gram that it holds, a sharded join answers with log probabilities and back-off weights, and the answers meet their
block again. The limits are quantiles for each language, over all trusted rows that were kept out of the counts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import char_lm, vec
from .common import cut, near_ids, release

ORDER = 4
#: Bytes of text in a block of documents; a longer text makes a block of its own.
BLOCK = 6 << 20
#: Log perplexities are binned for quantiles at so many digits.
_DIGITS = 4


@functools.cache
def symbol_table() -> np.ndarray:
    """White space to a space, decimal digits to 0, all else itself."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[0] = 0xFFFD
    for i in range(0x110000):
        ch = chr(i)
        if ch.isspace():
            out[i] = char_lm.SPACE
        elif ch.isdecimal():
            out[i] = ord("0")
    return out


# the model


def _sequences(data: np.ndarray, offsets: np.ndarray) -> char_lm.Sequences:
    return char_lm.sequences(data, offsets, symbol_table(), ORDER)


def _keys(s: char_lm.Sequences) -> np.ndarray:
    """The hashes of the n-grams of all orders that end at the scored places; lower orders are read off the distinct highest ones."""
    at = vec.ragged(s.first[:-1] + ORDER - 1, s.lengths())
    sums = char_lm.rolling(s.symbols, ORDER)
    top, one = np.unique(vec.mix(sums[-1][at] + char_lm.SALTS[ORDER]), return_index=True)
    return np.concatenate([top, *(np.unique(vec.mix(sums[k - 1][at[one]] + char_lm.SALTS[k])) for k in range(1, ORDER))])


def _pads() -> np.ndarray:
    """Hashes of the contexts before a text's first character, which no scored place ends."""
    return np.concatenate([char_lm.gram_keys(np.full((1, k), char_lm.SPACE, np.uint32)) for k in range(1, ORDER)])


def count_grams(texts: DataFrame) -> DataFrame:
    """gram (of ORDER characters) and n, over a column of texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in vec.text_blocks(b.column(0)):
                s = _sequences(data, offsets)
                at = vec.ragged(s.first[:-1] + ORDER - 1, s.lengths())
                if len(at):
                    _, one, n = np.unique(vec.mix(char_lm.rolling(s.symbols, ORDER)[-1][at] + char_lm.SALTS[ORDER]), return_index=True, return_counts=True)
                    grams = np.ascontiguousarray(s.symbols[at[one, None] + np.arange(1 - ORDER, 1)]).view(f"<U{ORDER}").ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(n)], ["gram", "n"])

    return texts.mapInArrow(scan, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """What is taken from counts of 0, 1, 2, and 3 or more: the modified discounts, from the numbers of grams with counts 1 to 4."""
    got = counts.agg(*[F.count_if(F.col("n") == k) for k in range(1, 5)]).first()
    n = [max(1, x) for x in got]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return [0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))]


def interpolate(top: DataFrame) -> tuple[DataFrame, float]:
    """From counts of the highest order (gram, n): gram, logp and logw of every gram and context of all orders, and the log10
    probability of a character never seen.

    Counts of lower orders are numbers of distinct characters to the left. A gram's probability is its discounted share of its
    context plus the context's spare mass times the probability of the gram without its first character."""
    levels = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.count("*").alias("n")))
    grams = contexts = lower = None
    unseen = 0.0
    for k in range(1, ORDER + 1):
        d = discounts(levels[k])
        off = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        own = levels[k].withColumn("off", F.least(off, F.col("n"))).withColumn("context", F.substring("gram", 1, k - 1))
        if k == 1:
            total, spare, kinds = own.agg(F.sum("n"), F.sum("off"), F.count("*")).first()
            weight = max((spare or 0) / total, 1e-12) if total else 1.0
            unseen = weight / ((kinds or 0) + 1)
            probs = own.select("gram", ((F.col("n") - F.col("off")) / F.lit(total or 1) + F.lit(unseen)).alias("p"))
        else:
            masses = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("spare"))
            masses = cut(masses.select("context", "total", (F.col("spare") / F.col("total")).alias("w")))
            mixed = own.join(masses, "context").join(lower.withColumnRenamed("gram", "rest").withColumnRenamed("p", "below"), F.substr("gram", F.lit(2)) == F.col("rest"))
            probs = mixed.select("gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("w") * F.col("below")).alias("p"))
            weights = masses.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), F.greatest("w", F.lit(1e-12)).alias("w"))
            contexts = weights if contexts is None else contexts.unionByName(weights)
        lower = cut(probs)
        told = lower.withColumn("w", F.lit(None).cast("double"))
        grams = told if grams is None else grams.unionByName(told)
    both = grams.unionByName(contexts).groupBy("gram").agg(F.max("p").alias("p"), F.max("w").alias("w"))
    return both.select("gram", F.log10("p").alias("logp"), F.log10("w").alias("logw")), float(np.log10(unseen)) if unseen else 0.0


def keyed(table: DataFrame) -> DataFrame:
    """key, logp, logw: the model's table under the hashes that blocks of documents ask for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(0).to_pylist()
            keys = np.zeros(len(grams), np.uint64)
            size = np.array([len(g) for g in grams])
            for k in set(size.tolist()):
                at = np.flatnonzero(size == k)
                keys[at] = char_lm.gram_keys(np.array([grams[i] for i in at], f"<U{k}").view(np.uint32).reshape(len(at), k))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(1), b.column(2)], ["key", "logp", "logw"])

    return table.mapInArrow(scan, "key long, logp double, logw double")


# scores


def row_blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first row, row after the last, bytes in the block so far, whether the block ends there), for texts after `size` bytes of a block.

    A block ends with the row that fills it. Where that is depends on the rows and their order alone, not on how they come in batches."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, done + BLOCK - size)) + 1
        full, hi = hi <= len(ends), min(hi, len(ends))
        size += int(ends[hi - 1]) - done
        yield lo, hi, size, full
        lo, done, size = hi, int(ends[hi - 1]), 0 if full else size


def _blocks(docs: DataFrame, text_col: str, payload: bool, common: Broadcast | None = None) -> DataFrame:
    """block, mark and payload (docs' rows, packed), or block, mark and keys (the distinct n-grams of all orders that its texts hold,
    but for common ones).

    Both come from scans of docs that give its rows in the same order. mark is a checksum of the block's texts, so that a block
    whose rows came in another order meets no answers, and is noticed."""
    kept = [c for c in docs.columns if c != text_col]
    source = docs.select(F.col(text_col).alias("_text"), *[F.col(c) for c in kept]) if payload else docs.select(F.col(text_col).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, marks, keys = TaskContext.get().partitionId() << 32, [], 0, (0, 0), []

        def out() -> pa.RecordBatch:
            mark = marks[0] << 31 ^ marks[1]
            if not payload:
                own = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                if common is not None:
                    own = own[common.value[0].find(own) < 0]
                own = np.union1d(own, _pads()).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))
                return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([mark]), lists], ["block", "mark", "keys"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for b in held:
                    stream.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([mark]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "mark", "payload"])

        for b in batches:
            for lo, hi, size, ends in row_blocks(b.column(0), size):
                held.append(b.slice(lo, hi - lo) if payload else None)
                for _, _, data, offsets in vec.text_blocks(b.column(0).slice(lo, hi - lo)):
                    marks = zlib.crc32(np.ascontiguousarray(data), marks[0]), zlib.crc32(np.diff(offsets).astype("<i8"), marks[1])
                    if not payload:
                        keys.append(_keys(_sequences(data, offsets)))
                        if len(keys) > 8:
                            keys = [np.unique(np.concatenate(keys))]
                if ends:
                    yield out()
                    block, held, size, marks, keys = block + 1, [], 0, (0, 0), []
                    vec.give_back()
        if held:
            yield out()

    return source.mapInArrow(scan, f"block long, mark long, {'payload binary' if payload else 'keys array<long>'}")


def common_grams(top: DataFrame, table: DataFrame, most: int = 20_000) -> Broadcast:
    """The model's rows for the `most` commonest grams of the highest order, and for all grams inside them: at most ten each.

    Nearly every block of documents would ask for them. A copy in every worker spares that, and changes no score."""
    spark = top.sparkSession
    grams = [r["gram"] for r in top.orderBy(F.desc("n"), "gram").limit(most).select("gram").collect()]
    inside = sorted({g[i:j] for g in grams for i in range(ORDER) for j in range(i + 1, ORDER + 1)})
    wanted = keyed(spark.createDataFrame([(g, 0.0, 0.0) for g in inside], "gram string, logp double, logw double")).select("key")
    got = table.join(F.broadcast(wanted), "key", "left_semi").toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = tuple(got[c].to_numpy(zero_copy_only=False).astype(np.float64)[order] for c in ("logp", "logw"))
    return spark.sparkContext.broadcast((vec.HashIndex(keys[order]), *values))


def score(docs: DataFrame, table: DataFrame, unseen: float, text_col: str = "text", keep_text: bool = False, common: Broadcast | None = None) -> DataFrame:
    """docs (without the text, unless keep_text) with e (log10 perplexity per character; 0 without text) and n (characters).

    docs must give its rows in the same order when it is read again, as files do, in batches of any size; write other tables
    first. A block whose rows came in another order fails the job."""
    kept = [c for c in docs.columns if c != text_col]
    asked = _blocks(docs, text_col, False, common).select("block", "mark", F.explode("keys").alias("key"))
    answers = asked.join(table.hint("merge"), "key").select("block", "mark", "key", "logp", "logw")
    schema = docs.select(*kept, *[text_col] * keep_text).schema.add("e", "double").add("n", "long")

    def measure(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        if rows.num_rows != 1 or not got.num_rows:
            raise RuntimeError("a block of documents came with other rows than when its n-grams were asked for: write docs to files first")
        keys = got["key"].to_numpy().view(np.uint64)
        values = [got[c].to_numpy().astype(np.float64) for c in ("logp", "logw")]
        if common is not None:
            index, *more = common.value
            keys, values = np.concatenate([keys, index.keys[:-1]]), [np.concatenate(x) for x in zip(values, more, strict=True)]
        keys, order = np.unique(keys, return_index=True)
        index = vec.HashIndex(keys)
        # log probabilities and weights; what has none is passed over, or weighs nothing
        logp, logw = (np.append(x[order], np.nan) for x in values)
        parts = []
        for b in pa.ipc.open_stream(rows["payload"][0].as_py()):
            for lo, hi, data, offsets in vec.text_blocks(b.column(0)):
                s = _sequences(data, offsets)
                n = s.lengths()
                at = vec.ragged(s.first[:-1] + ORDER - 1, n)
                sums = char_lm.rolling(s.symbols, ORDER)
                look = lambda values, k, places: values[index.find(vec.mix(sums[k - 1][places] + char_lm.SALTS[k]))]
                value, todo = np.zeros(len(at)), np.arange(len(at))
                for k in range(ORDER, 0, -1):
                    p = look(logp, k, at[todo])
                    hit = ~np.isnan(p)
                    value[todo[hit]] += p[hit]
                    todo = todo[~hit]
                    value[todo] += np.nan_to_num(look(logw, k - 1, at[todo] - 1)) if k > 1 else unseen
                ptr = np.append(0, np.cumsum(n))
                e = -vec.group_sums(value, ptr) / np.maximum(n, 1)
                own = b.slice(lo, hi - lo)
                parts.append(pa.Table.from_arrays([*own.columns[1:], *[own.column(0)] * keep_text, pa.array(e), pa.array(n)], schema.names))
        vec.give_back()
        return pa.concat_tables(parts) if parts else pa.table({f: [] for f in schema.names})

    texts = _blocks(docs, text_col, True)
    return texts.groupBy("block", "mark").cogroup(answers.groupBy("block", "mark")).applyInArrow(measure, schema)


# limits


@dataclass
class QualityModel:
    """The n-gram table, its commonest rows and the log probability of unseen characters; each language's median of log perplexity
    and its limit, those of all languages under None; and the prior's weight in characters."""

    table: DataFrame
    common: Broadcast
    unseen: float
    prior: float
    medians: dict[str | None, float]
    limits: dict[str | None, float]

    def by_language(self, values: dict[str | None, float], lang: Column) -> Column:
        known = {c: v for c, v in values.items() if c is not None}
        own = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[lang] if known else F.lit(None).cast("double")
        return F.coalesce(own, F.lit(values.get(None)).cast("double"))

    def shrunk(self, lang: Column) -> Column:
        """Log perplexity as if `prior` characters of the language's median had been read too: short texts say little."""
        return (F.col("n") * F.col("e") + self.prior * self.by_language(self.medians, lang)) / (F.col("n") + self.prior)


def quantiles(rows: DataFrame, value: Column, q: float) -> dict[str | None, float]:
    """Each language's quantile (rows: c) of a value, and that of all rows under None, from histograms of fixed bins."""
    got = rows.groupBy("c", F.round(value, _DIGITS).alias("v")).agg(F.count("*").alias("n")).toArrow()
    langs, v, n = np.array(got["c"].to_pylist(), dtype=object), got["v"].to_numpy(), got["n"].to_numpy()
    out = {}
    for c in [None, *sorted(set(langs))]:
        own = np.ones(len(v), bool) if c is None else langs == c
        order = np.argsort(v[own])
        below = np.cumsum(n[own][order])
        if len(below):
            out[c] = float(v[own][order][np.searchsorted(below, q * below[-1])])
    return out


def train(docs: DataFrame, labels: DataFrame, held: int = 3, quantile: float = 0.9995, prior: float = 800, lang_col: str = "lang", label_col: str = "quality") -> QualityModel | None:
    """Learns from trusted documents (rows of labels with label_col over 0); None without any.

    Every trusted row has a part: one of `held`, by the hash of its id, is kept out of the counts and sets the limits, and the n-grams of
    all others are counted. A language's limit is the quantile over all its rows that were kept out."""
    spark = docs.sparkSession
    trusted = labels.where(F.col(label_col) > 0).select(F.col("doc_id").alias("_id")).distinct()
    marked = docs.where(F.col("text").isNotNull()).select("doc_id", F.coalesce(F.col(lang_col), F.lit("")).alias("c"), "text")
    out = F.pmod(F.xxhash64("_id"), F.lit(held)) == 0
    counted, limiting = trusted.where(~out), trusted.where(out)
    near = lambda ids: near_ids(marked, ids.select(F.col("_id").alias("id")), "doc_id")
    top = cut(count_grams(near(counted).join(counted, F.col("doc_id") == F.col("_id"), "left_semi").select("text")))
    if not top.limit(1).count():
        return None
    table, unseen = interpolate(top)
    kept = cut(keyed(table))
    model = QualityModel(kept, common_grams(top, kept), unseen, prior, {None: 0.0}, {})
    measured = score(near(limiting), model.table, unseen, common=model.common)
    other = cut(measured.join(limiting, F.col("doc_id") == F.col("_id"), "left_semi").where("n > 0").select("c", "e", "n"))
    release(spark)  # the blocks' shuffle
    model.medians |= quantiles(other, F.col("e"), 0.5)
    model.limits = quantiles(other, model.shrunk(F.col("c")), quantile)
    return model


def classify(docs: DataFrame, model: QualityModel | None, lang_col: str = "lang", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without the text, unless keep_text) with perplexity (per character; null without text) and kept.

    kept is true while the perplexity, drawn to its language's median by the prior's weight, is at most the language's limit.

    Defined cases: a null text, and one of white space only, has no perplexity and is not kept; a null language, and
    one without trusted rows, gets the median and limit over all languages; without trusted rows every text is kept, and
    without any but those counted too; very long texts are read whole; repeated rows are judged each; an empty table gives an
    empty result; earlier columns named perplexity or kept are replaced, and others may have any names.
    """
    names = [c for c in docs.columns if c not in ("perplexity", "kept")]
    # plain names inside, so that no column of docs can clash
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    text = f"_{names.index(text_col)}"
    out = [F.col(f"_{i}").alias(c) for i, c in enumerate(names) if keep_text or c != text_col]
    if model is None:
        some = F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") != "", F.lit(False))
        return inner.select(*out, F.when(some, 1.0).alias("perplexity"), some.alias("kept"))
    lang = F.col(f"_{names.index(lang_col)}").cast("string") if lang_col in names else F.lit(None).cast("string")
    scored = score(inner, model.table, model.unseen, text, keep_text, model.common)
    fits = model.shrunk(lang) <= model.by_language(model.limits, lang) if model.limits else F.lit(True)
    return scored.select(*out, F.when(F.col("n") > 0, F.pow(F.lit(10.0), F.least("e", F.lit(300.0)))).alias("perplexity"), ((F.col("n") > 0) & fits).alias("kept"))
