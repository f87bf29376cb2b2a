"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are).
The exponent is bisected on a grid of 2**-20 to the largest one that meets the target: an entropy, as a part
of the most that is possible, and/or a limit on how often a source is repeated when the most plentiful one
is read `budget` times over. A round of bisection is one small aggregate over the sources' sums, which keeps
any number of sources off the driver.

Weights are realised in blocks. Block b of a source is a permutation of all its documents by a key of
(document, b). A source with a budget of e passes gets floor(e) whole blocks and, of the next block, the
documents from its start whose tokens come to no more than the rest of the budget. The place where a block is
cut is found by key ranges: token sums of ranges first, then within the one range where the budget ends.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and follow the
keys like other rows; rows with equal ids are taken or left together; a corpus without tokens is read as it
is; extra columns are passed on by `mix`, and ignored by `realised`; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import stable_key
from lodestat.sources.shared import cut_lineage

#: Grid of exponents.
STEPS = 1 << 20
#: Key ranges of a source: 2**RANGE_BITS at least, and so many more that one has about RANGE_ROWS of all rows at most.
RANGE_BITS, RANGE_ROWS, MOST_BITS = 12, 100_000, 24
_KEY_BITS = 60
#: Sources up to this number are broadcast (some 60 bytes each); more are joined by shuffling.
BROADCAST_SOURCES = 100_000


def _with_plan(rows: DataFrame, plan: DataFrame, condition: Column) -> DataFrame:
    """Rows joined with a table of one row per source: broadcast where it is proven small, so that a source with very many rows stays spread."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, condition)


def tokens(text: Column) -> Column:
    """Runs of characters that aren't white space ([\\x20\\x09-\\x0D])."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _least_good(good) -> int:
    """The least step from 0 to STEPS that is good, where all steps above a good one are good and STEPS is."""
    low, high = 0, STEPS
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle + 1, high)
    return low


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent of the weights, from (source, tokens) rows with tokens > 0.

    entropy: the weights' entropy is to be at least this part of log(number of sources), with the largest
    exponent that does it. repeats: no source is to be read more than so many times as often as the most
    plentiful one; where that asks for a larger exponent, it wins. Neither: 1.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if total.n < 2:
        return 1.0
    share, low = F.col("tokens") / F.lit(float(total.t)), STEPS

    def too_uneven(step: int) -> bool:
        powered = F.pow(share, F.lit(step / STEPS))
        sums = sources.agg(F.sum(powered).alias("z"), F.sum(powered * F.log(share)).alias("s")).first()
        return math.log(sums.z) - (step / STEPS) * sums.s / sums.z < entropy * math.log(total.n) - 1e-9

    if entropy is not None and too_uneven(STEPS):
        low = max(0, _least_good(too_uneven) - 1)
    if repeats is not None:
        floor = _least_good(lambda step: (total.most / total.least) ** (1 - step / STEPS) <= max(repeats, 1.0))
        low = max(low, floor) if entropy is not None else floor
    return low / STEPS


def source_plan(rows: DataFrame, entropy: float | None, repeats: float | None, budget: float = 1.0) -> DataFrame:
    """(source, tokens, weight, passes) of each source: its share of tokens, its target weight, how often it is read.

    `rows` has (source, tokens). The most plentiful source is read `budget` times, so that with a budget of 1
    no document is left out.
    """
    sums = cut_lineage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    some = sums.where("tokens > 0")
    at = exponent(some, entropy, repeats)
    total = some.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most")).first()
    if total.t is None:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(float(budget)).alias("passes"))
    norm = some.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total.t)), F.lit(at))).alias("z")).first().z
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total.t)), F.lit(at)) / F.lit(norm)).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, F.round(F.pow(F.lit(float(total.most)) / F.col("tokens"), F.lit(1.0 - at)) * F.lit(budget), 9)).otherwise(F.lit(float(budget)))
    return sums.select("source", "tokens", weight.alias("weight"), passes.alias("passes"))


def _block_key(block: Column) -> Column:
    return stable_key(F.col("__id"), block)


def _cut_keys(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, weight, passes, whole, cut): the block after the `whole` ones takes keys up to `cut`, or none where it is -1.

    `rows` has (__id, source, tokens).
    """
    bits = min(MOST_BITS, max(RANGE_BITS, (rows.count() // RANGE_ROWS).bit_length()))
    plan = plan.select("source", "weight", "passes", F.floor("passes").alias("whole"), F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("rest"))
    some = plan.where("rest > 0").select(F.col("source").alias("__s"), "whole", "rest")
    keyed = _with_plan(rows, some, F.col("source").eqNullSafe(F.col("__s"))).select("__s", "rest", "tokens", _block_key(F.col("whole")).alias("key"))
    keyed = keyed.withColumn("range", F.shiftright("key", _KEY_BITS - bits))
    sums = keyed.groupBy("__s", "rest", "range").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("__s").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = cut_lineage(sums.withColumn("after", F.sum("t").over(upto)))  # at most 2**bits rows a source
    full = ranges.where("after <= rest").groupBy("__s").agg(F.max("range").alias("full"))
    last = ranges.where("after > rest and after - t <= rest").groupBy(F.col("__s").alias("__r"), F.col("rest").alias("__rest")).agg(F.min("range").alias("open"), F.min(F.col("after") - F.col("t")).alias("spent"))
    inside = _with_plan(keyed, last, F.col("__s").eqNullSafe(F.col("__r")) & (F.col("range") == F.col("open")))
    by_key = inside.groupBy("__s", "rest", "spent", "key").agg(F.sum("tokens").alias("t"))
    so_far = Window.partitionBy("__s").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = by_key.withColumn("sum", F.col("spent") + F.sum("t").over(so_far)).where("sum <= rest").groupBy("__s").agg(F.max("key").alias("key"))
    # All of the ranges before the open one are taken, whether or not they have rows.
    ends = last.select(F.col("__r").alias("__s"), (F.shiftleft("open", _KEY_BITS - bits) - 1).alias("key")).unionByName(full.select("__s", (F.shiftleft(F.col("full") + 1, _KEY_BITS - bits) - 1).alias("key"))).unionByName(taken)
    cut = ends.groupBy("__s").agg(F.max("key").alias("cut"))
    return cut_lineage(plan.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "weight", "passes", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")))


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` with weight and block, one row for each block that takes the document."""
    plan = plan.select(F.col("source").alias("__p"), "weight", F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    joined = _with_plan(rows, plan, F.col("__source").eqNullSafe(F.col("__p")))
    taken = F.col("__whole") + F.when(F.col("__cut") >= _block_key(F.col("__whole")), 1).otherwise(0)
    return joined.withColumn("__taken", taken).where("__taken > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("__taken").cast("int") - 1)))


def _planned(docs: DataFrame, entropy: float | None, repeats: float | None, budget: float, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    sized = cut_lineage(docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), tokens(F.col(text_col)).alias("tokens")))
    return sized, _cut_keys(sized, source_plan(sized.select("source", "tokens"), entropy, repeats, budget))


def realised(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture, a row for each document of each block: id_col, source, tokens, weight, block and block_key (the order within the block)."""
    sized, plan = _planned(docs, entropy, repeats, budget, id_col, text_col, source_col)
    out = _copies(sized.withColumnRenamed("source", "__source"), plan)
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), "tokens", "weight", "block", _block_key(F.col("block")).alias("block_key"))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, as they were, each as often as the mixture reads it; texts are joined with the sources' plan only."""
    _, plan = _planned(docs, entropy, repeats, budget, id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), *(F.col(c).alias(f"__doc_{c}") for c in docs.columns))
    out = _copies(rows, plan)
    return out.select(*(F.col(f"__doc_{c}").alias(c) for c in docs.columns))
