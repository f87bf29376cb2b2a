"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, a log of the rows that stood for their texts when they came.
A batch of new data is reduced to one row per digest with partial aggregates and anti-joined with the index by
sort-merge (the index side is read as it lies, without a shuffle); what is left is appended in the same buckets.
Each row then finds the row that stays for it in the index. Texts are read once: only digests, ids and lengths
go on.

Equal texts are those whose digest agrees after white space ([\\x20\\x09-\\x0D]) is deleted. Of the equal texts
of one batch the row with most code points stays, then the one with the smallest id. Over batches there are two
rules: by default the row that is in the index stays before all that come later; with `replace` a later row that
would have stayed over it, had both come together, is appended and stands from then on.

Batches have names that the caller gives. A batch that is given again, after a job was lost, appends nothing and
gets the same answer as at first.

Defined cases: a null text counts as empty; a null id comes after all other ids; of rows that repeat an id
and a text one stays; extra columns are ignored; an empty table gives no rows and appends none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.sources.shared import cut_lineage, remove_folder

#: Digests that a bucket of a new index is meant for at most, some 100 bytes each.
BUCKET_ROWS = 1_000_000


def digest(text: Column) -> Column:
    """SHA-256, as hex, of the text without white space."""
    bare = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\x20\x09\x0a\x0b\x0c\x0d", "")
    return F.sha2(F.encode(bare, "UTF-8"), 256)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, id, length, copies): the distinct rows of `docs` by digest, id and code points, and how often each is there."""
    length = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))
    rows = docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id"), length.alias("length"))
    return cut_lineage(rows.groupBy("digest", "id", "length").agg(F.count("*").alias("copies")))


def standing(prefix: str = "") -> Column:
    """What orders rows of one text; the least stays: most code points, an id before none, the smallest id."""
    id_ = F.col(f"{prefix}id")
    return F.struct((-F.col(f"{prefix}length")).alias("l"), id_.isNull().alias("none"), id_.alias("i"))


class DigestIndex:
    """A bucketed table (digest, keep_id, keep_length, batch).

    Without a path the table is in the session's warehouse. With a path its files are there, and a later
    session opens them by the same name, path and bucket count. A new index has as many buckets as a shuffle of the
    session has partitions, more if its first batch asks for them, unless told; new rows are then shuffled once.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path
        if path and not self.exists():
            try:
                kind = spark.read.parquet(path).schema["keep_id"].dataType.simpleString()
            except AnalysisException:  # nothing is there yet
                return
            if buckets is None:
                raise ValueError("files of an index are opened with their number of buckets")
            self._create(kind)
        elif self.exists():
            self.buckets = int(spark.sql(f"describe extended {name}").where("col_name = 'Num Buckets'").first().data_type)

    def _create(self, kind: str) -> None:
        place = f" location '{self.path}'" if self.path else ""
        columns = f"digest string, keep_id {kind}, keep_length int, batch string"
        self.spark.sql(f"create table {self.name} ({columns}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets{place}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self, files: bool = False) -> None:
        """Takes the table away; files of an index with a path stay, unless told."""
        self.spark.sql(f"drop table if exists {self.name}")
        if files and self.path:
            remove_folder(self.spark, self.path)

    def append(self, rows: DataFrame) -> None:
        """Adds (digest, keep_id, keep_length, batch) rows; a task writes whole buckets."""
        writer = rows.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def unseen(self, best: DataFrame, replace: bool = False) -> DataFrame:
        """The rows of `best` (digest, id, length) that the index lacks, by a sort-merge anti-join; with `replace`, that none of its rows stands before or beside."""
        index = self.read().select("digest", F.col("keep_id").alias("kept_id"), F.col("keep_length").alias("kept_length"))
        same = best["digest"] == index["digest"]
        return best.join(index.hint("merge"), same & (standing("kept_") <= standing()) if replace else same, "left_anti")

    def ingest(self, rows: DataFrame, batch: str, replace: bool = False) -> None:
        """Appends what of `rows` (as `digested` gives them) is new."""
        if not self.exists():  # the first batch goes the way of all others
            # as many as a shuffle has, so that new rows which are grouped by digest lie with their buckets
            self.buckets = self.buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
            self._create(rows.schema["id"].dataType.simpleString())
        best = rows.groupBy("digest").agg(F.min(standing()).alias("k")).select("digest", F.col("k.i").alias("id"), (-F.col("k.l")).alias("length"))
        # Written before the index is appended to, which it reads.
        new = cut_lineage(self.unseen(best, replace))
        self.append(new.select("digest", F.col("id").alias("keep_id"), F.col("length").alias("keep_length"), F.lit(batch).alias("batch")))

    def stands(self, replace: bool = False) -> DataFrame:
        """(digest, keep_id, keep_length, batch): the row that stays for each digest; grouped in the buckets, without a shuffle."""
        if not replace:
            return self.read()
        row = F.struct("keep_id", "keep_length", "batch")
        order = F.struct((-F.col("keep_length")).alias("l"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("i"))
        return self.read().groupBy("digest").agg(F.min_by(row, order).alias("k")).select("digest", "k.*")

    def judged(self, rows: DataFrame, id_col: str = "doc_id", batch: str | None = None, replace: bool = False) -> DataFrame:
        """Per row that `digested` had: id_col, keep_id, group_size (rows of the same text in `rows`), kept, text_sha256.

        With a batch, only rows that it brought to the index are kept.
        """
        sizes = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
        # A table of its own, so that Spark can split a group of very many rows in the last join.
        found = cut_lineage(sizes.join(self.stands(replace).hint("merge"), "digest"))
        first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
        if batch is not None:
            first = first & (F.col("batch") == batch)
        out = rows.join(found, "digest").select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (first & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))

    def deduplicate(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends the texts of `docs` that are new, under the name `batch`; then each row's place, as `judged` tells it."""
        rows = digested(docs, id_col, text_col)
        self.ingest(rows, batch)
        return self.judged(rows, id_col, batch)


def deduplicate_all(docs: DataFrame, index: DigestIndex, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole of `docs`, dealt by a hash of the id over batches that come to `index` one after the other; as if all had come at once.

    The result is written before it is returned, so that the index may be dropped.
    """
    rows = digested(docs, id_col, text_col)
    turn = F.pmod(F.xxhash64("id"), F.lit(batches))
    for number in range(batches):
        index.ingest(rows.where(turn == number), f"{number + 1} of {batches}", replace=True)
    return cut_lineage(index.judged(rows, id_col, replace=True))
