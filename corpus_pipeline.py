"""A corpus from raw documents to shards: each stage is one operator over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import language, mixing, sharding
from lodestat.llm.common import table
from lodestat.llm.decontamination import decontaminate
from lodestat.llm.simhash import keep_representatives
from lodestat.sources.shared import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of which no language makes up half, go.

    Rows without a label aren't learnt from; where no row has one, no document is rejected. A null text, or one
    without a letter, goes; repeated rows are judged alike; an empty table gives no rows.
    """
    model = language.fit(docs.where(~language.held_out()))
    return language.keep_known(docs, model, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id.

    Rows are told apart by a number of their own: null and repeated ids cost no other row its place. Empty and
    null texts are one component; extra columns pass.
    """
    return keep_representatives(docs, distance=4, shingle=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go.

    Null and empty texts stay, and so do all where the benchmark is empty; repeated rows are judged alike.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scarce sources are repeated, up to half as often again as the most plentiful one; no document is left out.

    A null source is a source of its own; rows with equal ids are taken together; without any tokens all rows
    are read once.
    """
    return mixing.mix(docs, entropy=0.998, repeats=1.5)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in forty shards, by its id; rows with null or equal ids are in one shard, each in a place of its own."""
    return sharding.shard(docs, shards=40)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language likelihoods and XXH64 fingerprints have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out.select(*(F.col(c) for c in out.columns))
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
