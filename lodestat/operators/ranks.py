"""Exact nearest-rank percentiles from counted values: no group's values in one buffer or one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 16


def _bin(value: Column) -> Column:
    """Bins that keep the order of values, BINS_PER_OCTAVE for each doubling: at most some 2000 over all long integers."""
    x = value.cast("double")
    return (F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * BINS_PER_OCTAVE)).cast("int")


def nearest_ranks(counts: DataFrame, keys: list[str], value: str, n: str, percents: dict[str, int]) -> DataFrame:
    """(keys, a column for each name in `percents`): the least value that at least so many percent of the group's rows don't exceed.

    `counts` has a row for each (keys, value), with its rows in `n`, and is read twice: give it with its lineage cut.
    Null values don't count; null keys are a group; a group without values has no row, but without keys there is one
    row of nulls. Bins are summed first, and only the values of the bins that hold a rank are put in order.
    """
    rows = counts.where(F.col(value).isNotNull()).select(*keys, _bin(F.col(value)).alias("_bin"), F.col(value).alias("_x"), F.col(n).alias("_n"))
    whole, of = Window.partitionBy(*keys), F.col("_of")
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in"))
    bins = bins.withColumn("_upto", F.sum("_in").over(whole.orderBy("_bin"))).withColumn("_of", F.sum("_in").over(whole))  # over the bins of a group
    first = lambda upto, before, p: (upto * 100 >= of * p) & (before * 100 < of * p)
    holds = F.lit(False)
    for p in percents.values():
        holds = holds | first(F.col("_upto"), F.col("_upto") - F.col("_in"), p)
    held = bins.where(holds).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bin").alias("_held"), (F.col("_upto") - F.col("_in")).alias("_before"), "_of")
    same = F.col("_bin") == F.col("_held")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_x"))
    ranked = rows.join(held, same).withColumn("_upto", upto)
    return ranked.groupBy(*keys).agg(*(F.min(F.when(first(F.col("_upto"), F.col("_upto") - F.col("_n"), p), F.col("_x"))).alias(name) for name, p in percents.items()))
