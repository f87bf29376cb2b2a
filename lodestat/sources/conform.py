"""Declared schemas of the five session tables, and readers that conform files to them.

Columns that old files lack read as null, and all others are cast; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "sessions": "id string, parent_id string, title string, model string, agent string, directory string, time_created long, time_updated long, idle_outcome string, cost double, tokens_input long, tokens_output long, tokens_reasoning long, tokens_cache_read long, tokens_cache_write long",
    "messages": "id string, session_id string, type string, seq long, time_created long, time_updated long, data string",
    "todos": "session_id string, content string, status string, priority string, position int, time_created long, time_updated long",
    "instruction_state": "session_id string, epoch_start long, current_values string",
    "instruction_blob": "hash string, value string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """A table with the declared columns and types; junk in a typed column reads as null."""
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)))


def read_table(spark: SparkSession, path: str, name: str, format: str = "parquet", **options: str) -> DataFrame:
    """One of the five tables from files of any format that Spark reads, or over JDBC."""
    return conform(spark.read.format(format).options(**options).load(path) if path else spark.read.format(format).options(**options).load(), name)
