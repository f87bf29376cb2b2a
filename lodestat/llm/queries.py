"""The registered query of each corpus operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import language, licenses, mixing, oracles, phrases, pii, quality, ranked, sharding, urls
from lodestat.llm.common import table
from lodestat.llm.decontamination import contamination
from lodestat.llm.exact_dedup import DigestIndex, deduplicate_all
from lodestat.llm.secrets import ADDED, BASE, BlobLedger, scan_all
from lodestat.llm.simhash import near_duplicates
from lodestat.sources.shared import shared_folder


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest_match"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.select("doc_id", "text"), labels.where(~quality.held_out()))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"), F.size("sentences").cast("long").alias("n_sentences"), "kind")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.DEFAULT_RULES))
    # Rules of words are the method's own; the column shows the listed host rules.
    return judged.withColumn("rule", F.when(~F.startswith("rule", F.lit("*")), F.col("rule")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    mark = lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in (*pii.KINDS, *pii.ADDED)]
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS)), mark), ",")
    all_ = F.array_join(F.transform("spans", mark), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), all_.alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.realised(table(spark, sf_dir, "documents"), entropy=0.998, repeats=2.0)
    return mixed.withColumn("weight", F.round("weight", 9))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in two batches to an index in the shared folder; the index goes when the result is written."""
    name = f"digest_index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, path=f"{shared_folder(spark)}/{name}")
    try:
        return deduplicate_all(table(spark, sf_dir, "documents"), index)
    finally:
        index.drop(files=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes to a ledger of its own, which goes when the result is written."""
    ledger = BlobLedger(spark, f"blob_ledger_{uuid.uuid4().hex}")
    try:
        found = scan_all(table(spark, sf_dir, "documents"), ledger)
    finally:
        ledger.drop(files=True)
    mark = lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE))), mark), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in (*BASE, *ADDED)]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", mark), ",").alias("spans"), "blob")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), longest=4, least=30, top=2000, explained=80)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_quality, op3_licenses, op4_urls, op5_language, op6_sharding, op7_pii, op8_mixing, op9_exact_dedup, op10_simhash, op11_secrets, op12_phrases, op13_search)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
