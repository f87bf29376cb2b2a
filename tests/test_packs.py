"""Packs of sessions in many pieces against one greedy pass, and how the work is dealt."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import packs

SCHEMA = "session_id string, id string, type string, seq long, time_created long, data string"


def greedy(sizes, rows, chars):
    out, pack, n, size = [], 0, 0, 0
    for c in sizes:
        if n and (n >= rows or size + c > chars):
            pack, n, size = pack + 1, 0, 0
        n, size = n + 1, size + c
        out.append(pack)
    return out


@pytest.mark.parametrize(("rows", "chars", "width"), [(5, 40, 8), (3, 10_000, 3), (200, 60, 256), (7, 0, 16), (1, 50, 1)])
def test_against_one_pass(spark, rows, chars, width):
    rng = random.Random(rows)
    sessions = {name: [rng.choice([0, 1, 5, 9, 30, 70]) for _ in range(n)] for name, n in (("a", 500), ("b", 8), ("c", 9), ("d", 1), (None, 333), ("e", 64))}
    data = [(s, f"{i:04}", "user", i, 0, json.dumps({"text": "x" * c})) for s, sizes in sessions.items() for i, c in enumerate(sizes)]
    rng.shuffle(data)
    got = {(r.session_id, r.id): r.pack for r in packs.pack_messages(spark.createDataFrame(data, SCHEMA), rows, chars, width).collect()}
    assert got == {(s, f"{i:04}"): p for s, sizes in sessions.items() for i, p in enumerate(greedy(sizes, rows, chars))}


def test_a_long_session_is_many_tasks(spark):
    n = 120_000
    msg = spark.range(n).select(F.lit("s").alias("session_id"), F.format_string("%07d", "id").alias("id"), F.lit("user").alias("type"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("time_created"), F.concat(F.lit('{"text":"'), F.repeat(F.lit("x"), (F.col("id") * 7919 % 3000).cast("int")), F.lit('"}')).alias("data"))
    made = packs.pack_messages(msg).cache()
    want = greedy([i * 7919 % 3000 for i in range(n)], packs.PACK_ROWS, packs.PACK_CHARS)
    assert [r.pack for r in made.orderBy("id").collect()] == want
    # rows of the last pass by task: pieces are dealt out, the session is not one task
    assert max(r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 0.6 * n


def test_no_messages(spark):
    assert packs.pack_messages(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="longest pack"):
        packs.pack_messages(spark.createDataFrame([], SCHEMA), rows=10, width=9)
