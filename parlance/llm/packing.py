"""Packing by optimal length buckets.

A dynamic program over the global length histogram chooses the bucket boundaries that minimise padding;
inside each bucket sequences are dealt into batches under a token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def word_length(text: str = "text") -> Column:
    """Words of a text and one end token; 1 for a null or empty text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long") + 1


def optimal_bounds(histogram: dict[int, int], buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most `buckets` buckets with the least total padding, and that padding.

    Padding of a bucket is sum(count * (bound - length)). The cost of (i, j] is linear in the bound for a fixed i,
    so each row of the table is a lower envelope of lines, met in order of slope: O(buckets * lengths), in integers."""
    lengths = sorted(n for n, c in histogram.items() if c)
    if not lengths:
        return [], 0
    count, total = [0], [0]
    for n in lengths:
        count.append(count[-1] + histogram[n])
        total.append(total[-1] + n * histogram[n])
    m = len(lengths)
    best = [lengths[j - 1] * count[j] - total[j] if j else 0 for j in range(m + 1)]
    back = []
    for _ in range(min(buckets, m) - 1):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i: slopes fall
        at, now, come = 0, best[:], [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if i:
                s, b = -count[i], best[i] + total[i]
                while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - s) >= (b - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((s, b, i))
            if not hull:
                continue
            x = lengths[j - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            value = hull[at][0] * x + hull[at][1] + x * count[j] - total[j]
            if value < now[j]:
                now[j], come[j] = value, hull[at][2]
        best = now
        back.append(come)
    bounds, j = [], m
    for come in reversed(back):
        bounds.append(lengths[j - 1])
        j = come[j]
        if not j:
            break
    if j:
        bounds.append(lengths[j - 1])
    return bounds[::-1], best[m]


def pieces_of(docs: DataFrame, length: Column, max_len: int, id_col: str = "doc_id") -> DataFrame:
    """Consecutive pieces of at most max_len tokens: id, piece, n_tokens."""
    n = F.greatest(F.coalesce(length, F.lit(0)).cast("long"), F.lit(1).cast("long"))
    return (
        docs.select(F.col(id_col), n.alias("_n"))
        .select(id_col, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {max_len}"))).alias("piece"))
        .select(id_col, "piece", F.least(F.lit(max_len).cast("long"), F.col("_n") - F.col("piece") * max_len).alias("n_tokens"))
    )


def pack(docs: DataFrame, *, length: Column | None = None, id_col: str = "doc_id", max_len: int = 4096, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """Every document as pieces in token-budget batches of one length bucket each.

    Returns id, piece (from 0), n_tokens, bucket (from 0), bucket_len, batch_id, slot (from 0). A batch holds at most
    budget // bucket_len sequences of a bucket (one, if the budget is below the bound), each padded to bucket_len.
    Only the histogram comes to the driver; it has at most max_len rows. Ranks inside a bucket are running counts
    over shards of the pieces' own numbers in their checkpoint, so one length, or one id, that a third of all rows have is
    still numbered by many tasks.

    Defined cases: a null or empty text has one end token and makes one piece; a text longer than max_len is cut into
    pieces and none of its tokens is lost; a null id is a value like others; repeated rows and ids each get their own
    slots; an empty table gives an empty result; columns other than the id and those in `length` are not read.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, word_length() if length is None else length, max_len, id_col))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds, _ = optimal_bounds(histogram, buckets)
    shards = max(4 * partitions(spark), sum(histogram.values()) // 100_000)
    bucket = F.lit(None).cast("int")
    for k, bound in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(k)).otherwise(bucket)
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    dealt = pieces.withColumn("bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    before = (
        dealt.groupBy("bucket", "_shard").agg(F.count("*").alias("_c"))
        .withColumn("_before", F.sum("_c").over(Window.partitionBy("bucket").orderBy("_shard")) - F.col("_c")).drop("_c")
    )
    own = Window.partitionBy("bucket", "_shard").orderBy(id_col, "piece")
    rank = F.col("_before") + F.col("_own") - 1
    per = F.greatest(F.expr(f"{int(budget)} div bucket_len"), F.lit(1).cast("long"))
    return (
        dealt.withColumn("_own", F.row_number().over(own)).join(before, ["bucket", "_shard"])
        .withColumn("bucket_len", F.element_at(table, F.col("bucket") + 1))
        .withColumn("_rank", rank).withColumn("_per", per)
        .select(F.col(id_col), "piece", "n_tokens", "bucket", "bucket_len", F.expr("_rank div _per").alias("batch_id"), F.expr("_rank % _per").alias("slot"))
    )
