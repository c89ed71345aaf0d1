"""Greedy packing under a budget: one operator for every place that walks items in order and fills bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_bins(costs: np.ndarray, budget: int, cap: int | None = None) -> np.ndarray:
    """Bin of each item: a bin closes when the next item would exceed the budget or the cap; its first item always fits.

    Each bin is found by one binary search over the prefix sums."""
    total = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)])
    out = np.empty(len(costs), np.int32)
    at = bin_ = 0
    while at < len(costs):
        end = int(np.searchsorted(total, total[at] + budget, "right")) - 1
        end = max(at + 1, min(end, len(costs), at + cap if cap else len(costs)))
        out[at:end] = bin_
        at, bin_ = end, bin_ + 1
    return out


def pack_array(costs: Column, budget: int, cap: int | None = None) -> Column:
    """Bins of a row's own array of costs: no shuffle, one Arrow pass."""

    @F.pandas_udf("array<int>")
    def bins(s):
        return s.map(lambda c: None if c is None else fill_bins(np.asarray(c, dtype=np.int64), budget, cap))

    return bins(costs.cast("array<bigint>"))


def bin_totals(costs: Column, bins: Column) -> Column:
    """One struct (batch, items, cost) for each bin of a row's own arrays, as pack_array fills them: without taking the row apart."""
    begins = F.filter(F.sequence(F.lit(1), F.size(bins)), lambda i: (i == 1) | (F.element_at(bins, F.greatest(i - 1, F.lit(1))) != F.element_at(bins, i)))
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(bins) + 1))
    own = lambda z, i: F.struct(
        i.alias("batch"), (z["end"] - z["begin"]).cast("long").alias("items"),
        F.aggregate(F.slice(costs, z["begin"], z["end"] - z["begin"]), F.lit(0).cast("long"), lambda a, c: a + c).alias("cost"),
    )
    return F.when(F.size(bins) > 0, F.transform(F.arrays_zip(begins.alias("begin"), ends.alias("end")), own))


def greedy_pack(items: DataFrame, group: str, order: str, cost: str, *, budget: int, cap: int | None = None, out: str = "batch") -> DataFrame:
    """items with the number of each one's bin inside its group, from 0 in the items' order.

    A group is one document's items, already apart from one another; where they are still an array, use pack_array."""
    row = F.struct(F.col(order).alias("_o"), F.struct(*[c for c in items.columns if c != group]).alias("_r"))
    by_order = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)
    rows = F.array_sort(F.collect_list(row), by_order)
    grouped = items.groupBy(group).agg(rows.alias("rows"))
    packed = grouped.withColumn("bins", pack_array(F.transform("rows", lambda r: r["_r"][cost].cast("long")), budget, cap))
    return packed.select(group, F.explode(F.arrays_zip("rows", "bins")).alias("z")).select(group, "z.rows._r.*", F.col("z.bins").alias(out))
