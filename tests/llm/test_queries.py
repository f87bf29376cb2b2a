"""The registered corpus queries: against their SQL on the smallest tables, and their held-out accuracy."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestat.llm import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in SF.glob("*.parquet"):
        con.sql(f"create view {table.stem} as select * from read_parquet('{table}')")
    mine = queries.queries()[name](spark, str(SF))
    columns = sorted(mine.columns)
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted([str(v) for v in r] for r in mine.select(*columns).collect()) == sorted([str(r[i]) for i in at] for r in found.fetchall())


def test_held_out_languages(spark):
    got = queries.op5_language(spark, str(SF)).where("held_out")
    docs = spark.read.parquet(str(SF / "documents.parquet")).select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_held_out_quality(spark):
    got = queries.op2_quality(spark, str(SF)).where("held_out")
    labels = spark.read.parquet(str(SF / "labels.parquet"))
    right = got.join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.85


def test_every_operator_has_a_query():
    assert [f"op{n}_" for n in range(1, 14)] == sorted((n.split("_")[0] + "_" for n in queries.queries()), key=lambda x: int(x[2:-1]))
