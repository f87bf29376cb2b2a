"""Shards by jump consistent hashing: no ring table, and an added shard takes rows only into itself.

The key is a stable 60-bit number of the id, so a row's shard depends on its id and the shard count alone.
Places within a shard follow another such number, of the id and the text's checksum and size. To give them out
without one task per shard, equal rows are first counted together, by partial aggregates; the numbers are cut
into ranges; places are counted within (shard, range), and the sizes of the ranges before are added. So neither
one id with very many rows nor one row with very many copies makes a large range.

Defined cases: a null id is keyed like the empty string; a null text has no bytes; rows with equal ids go
to one shard and get places of their own, equal rows next to each other; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import crc32_of, stable_key
from lodestat.sources.shared import cut_lineage

#: Rows that one range of a shard has, about.
RANGE_ROWS = 50_000
_KEY_BITS = 60


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of each key, for all keys at once."""
    key, bucket, jump = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    open_ = np.flatnonzero(jump < shards)
    with np.errstate(over="ignore"):
        while len(open_):
            bucket[open_] = jump[open_]
            key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
            scale = float(1 << 31) / ((key[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            jump[open_] = ((bucket[open_] + 1) * scale).astype(np.int64)
            open_ = open_[jump[open_] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard, from 0, of a non-negative long."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of `docs`: id_col, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot (from 0, gapless) and grown_shard (the shard if there were one more)."""
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    rows = docs.select(F.col(id_col).alias("__id"), size.alias("size"), crc32_of(text).alias("text_crc32"))
    equal = rows.groupBy("__id", "size", "text_crc32").agg(F.count("*").alias("__n"))
    total = docs.select(F.lit(1)).count()
    bits = min(20, max(0, (total // (shards * range_rows)).bit_length()))
    key, place = stable_key(F.col("__id")), stable_key(F.col("__id"), F.col("text_crc32"), F.col("size"))
    # Written once: the places of a range are read beside the sizes of all ranges.
    equal = cut_lineage(
        equal.withColumn("shard", shard_of(key, shards))
        .withColumn("grown_shard", shard_of(key, shards + 1))
        .withColumn("__place", place)
        .withColumn("__range", F.shiftright("__place", _KEY_BITS - bits))
    )
    sizes = equal.groupBy("shard", "__range").agg(F.sum("__n").alias("__size"))  # shards x ranges rows
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__range").orderBy("__place", "__id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("__rank", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    out = ranked.join(starts, ["shard", "__range"]).withColumn("__copy", F.explode(F.expr("sequence(0L, __n - 1)")))
    slot = F.col("__start") + F.col("__rank") + F.col("__copy")
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")
