"""Secret scans by an incremental ledger of blobs.

Every version of every file is addressed by its content (SHA-256). The ledger is a table bucketed by that address: a
row for each scan of a blob, with the (rule, version) pairs it was scanned for and what they found. A scan of new
versions reduces them to one text per address, takes off the pairs that the ledger has for it, and runs just the
rules that are left, over the blobs that have any left. Findings are then joined to all rows (paths) that hold the
blob. A rule whose pattern changes gets a new version, and only that pair is run over the blobs that are known.

The ledger holds places, never the secrets. Only DataFrame functions.

Defined cases: a null text counts as empty; a null id is kept; rows that repeat a text share its blob, and each
gets its findings; matches of a rule don't overlap, those of several rules may; a scan that is repeated appends
nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.pii import _located
from lodestat.sources.shared import cut_lineage, remove_folder, shared_folder

#: Versions that a bucket of a new ledger is meant for at most.
BUCKET_ROWS = 1_000_000
_SPAN = "struct<kind:string,begin:int,stop:int>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if group `group` has at least `least` characters; `hint` is cheap and in every text with one."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: Column) -> Column:
        """Array of (kind, begin, stop) in code points, from left to right."""
        counts = lambda s: F.length(F.regexp_extract(s["value"], self.pattern, self.group)) >= self.least
        found = F.transform(F.filter(_located(text, F.lit(self.pattern), self.kind), counts), lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["stop"].alias("stop")))
        return F.when(text.rlike(self.hint), found).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_NAMES = _either_case("(password|passwd|secret|token|api_?key)")
_ASSIGNED = rf"""{_NAMES}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What any text must have by the contract of the base kinds.
BASE = (
    Rule("assign", 1, _ASSIGNED, rf"(?=[PpSsTtAa]){_NAMES}[\"']?\x20*[:=]", 2, 8),
    # Runs are matched whole, so that one which is too short has no longer one inside.
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, "[0-9a-f]{32,}", "[0-9a-f]{32}"),
)
#: Further kinds, by the published shapes of tokens.
ADDED = (
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10}"),
    Rule("key_block", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def address(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256)


class BlobLedger:
    """A table (blob, pairs, findings) of what was scanned for what.

    With a path a later session opens the ledger by the same name, path and bucket count. Without one it lies in the
    folder that driver and executors share. New texts are shuffled a second time where the session has another number
    of shuffle partitions than the ledger has buckets.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name = spark, name
        self.path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.buckets = buckets
        if spark.catalog.tableExists(name):
            about = {r.col_name: r.data_type for r in spark.sql(f"describe extended {name}").collect()}  # a row for each property
            self.buckets, self.path = int(about["Num Buckets"]), about["Location"]
        elif path and buckets:
            self._create()

    def _create(self) -> None:
        self.spark.sql(f"create table {self.name} (blob string, pairs array<string>, findings array<{_SPAN}>) using parquet clustered by (blob) sorted by (blob) into {self.buckets} buckets location '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self, files: bool = False) -> None:
        """Takes the table away, and its files if told."""
        self.spark.sql(f"drop table if exists {self.name}")
        if files:
            remove_folder(self.spark, self.path)

    def scanned(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """(blob, pairs, findings) of the blobs (blob, text) that lack some pair, for the pairs they lack."""
        had = self.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("had"))
        lacks = F.array_except(F.array(*(F.lit(r.pair) for r in rules)), F.coalesce("had", F.expr("cast(array() as array<string>)")))
        left = blobs.join(had.hint("merge"), "blob", "left").select("blob", "text", lacks.alias("pairs")).where(F.size("pairs") > 0)
        none = F.expr(f"cast(array() as array<{_SPAN}>)")
        found = F.concat(*(F.when(F.array_contains("pairs", r.pair), r.spans(F.col("text"))).otherwise(none) for r in rules))
        return left.select("blob", "pairs", found.alias("findings"))

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
        """Scans what of `versions` the ledger lacks, blob by blob and pair by pair, and appends it.

        Texts are shuffled once, one of each address by task.
        """
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        blobs = versions.select(address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        if not self.spark.catalog.tableExists(self.name):
            # as many as a shuffle has, so that texts which are grouped by blob lie with their buckets
            self.buckets = self.buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-versions.count() // BUCKET_ROWS))
            self._create()
        new = cut_lineage(self.scanned(blobs, rules))  # written before the ledger, which it reads, is appended to
        writer = new.repartition(self.buckets, "blob").write.format("parquet").mode("append").bucketBy(self.buckets, "blob").sortBy("blob")
        writer.option("path", self.path).saveAsTable(self.name)

    def findings(self, versions: DataFrame, rules: Sequence[Rule] = RULES, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """Per row of `versions`: the columns `keep`, blob, and spans (kind, begin, stop) that `rules` find, by begin, then as the rules stand."""
        place = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
        # of a rule's earlier versions nothing is told
        current = F.when(F.arrays_overlap("pairs", F.array(*(F.lit(r.pair) for r in rules))), F.col("findings"))
        valid = lambda s: F.array_contains("pairs", F.concat(s["kind"], F.lit("@"), F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(str(r.version))))), s["kind"])))
        told = self.read().select("blob", F.filter(current, valid).alias("f")).where(F.size("f") > 0).groupBy("blob").agg(F.flatten(F.collect_list("f")).alias("f"))
        ordered = F.array_sort(F.transform("f", lambda s: F.struct(s["begin"].alias("begin"), F.element_at(place, s["kind"]).alias("place"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
        spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["stop"].alias("stop")))
        # A table of its own, so that Spark can split a blob that very many rows hold.
        told = cut_lineage(told.select("blob", spans.alias("spans")))
        rows = versions.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), address(F.col(text_col)).alias("blob"))
        out = rows.join(told, "blob", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)")))
        return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "blob", "spans")


def scan_all(docs: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = RULES, first_rules: Sequence[Rule] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of all rows of `docs`, as history would bring them: half of the ids come under the first rules, then all come under all.

    The second scan runs the later rules over the blobs that are known, and all over the others. Written before it is returned, so that the ledger may go.
    """
    ledger.scan(docs.where(F.pmod(F.xxhash64(id_col), F.lit(2)) == 0), first_rules, text_col)
    ledger.scan(docs, rules, text_col)
    return cut_lineage(ledger.findings(docs, rules, (id_col,), text_col))
