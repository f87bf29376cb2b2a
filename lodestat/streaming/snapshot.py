"""A table of the newest row of each key, kept up by the micro-batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lodestat.sources.shared import names_in, remove_folder

#: Micro-batches whose rows lie beside the base before they are merged into it.
MOST_DELTAS = 8


class Snapshot:
    """Folders `base/<number>` and `delta/<number>`: the rows of all micro-batches up to a number, and those of each one after it.

    A micro-batch that comes again overwrites its own folder, or is left out where the base already has it, so that a
    restarted stream changes nothing. After `most_deltas` micro-batches base and deltas are merged by key into a new
    base; what it replaces goes once it is written whole, and a reader takes the newest whole base. A read therefore
    opens one base and at most that many deltas, however long the stream has run.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType, most_deltas: int = MOST_DELTAS):
        self.spark, self.folder, self.keys, self.most_deltas = spark, folder, keys, most_deltas
        self.columns, self.schema = schema.names, StructType([*schema.fields]).add("__batch", LongType())

    def _whole(self, kind: str) -> list[int]:
        found = [int(n) for n in names_in(self.spark, f"{self.folder}/{kind}") if n.isdigit()]
        return sorted(n for n in found if "_SUCCESS" in names_in(self.spark, f"{self.folder}/{kind}/{n}"))

    def parts(self) -> list[str]:
        """The folders that make up the table."""
        base = self._whole("base")[-1:]
        deltas = [n for n in self._whole("delta") if not base or n > base[0]]
        return [*(f"{self.folder}/base/{n}" for n in base), *(f"{self.folder}/delta/{n}" for n in deltas)]

    def _rows(self) -> DataFrame:
        """The newest row of each key, with the number of its micro-batch."""
        parts = self.parts()
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        rest = [c for c in self.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "__batch"), "__batch").alias("r"))
        return newest.select(*self.keys, *(F.col("r")[c].alias(c) for c in (*rest, "__batch")))

    def read(self) -> DataFrame:
        return self._rows().select(*self.columns)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes the rows of micro-batch `number`, each in place of what its key had."""
        base = self._whole("base")[-1:]
        if base and number <= base[0]:
            return
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/delta/{number}")
        if len(self.parts()) > self.most_deltas:
            self.compact()

    def compact(self) -> None:
        deltas = [n for n in self._whole("delta")]
        old = self._whole("base")
        if not deltas:
            return
        self._rows().write.mode("overwrite").parquet(f"{self.folder}/base/{deltas[-1]}")
        for kind, numbers in (("delta", deltas), ("base", [n for n in old if n != deltas[-1]])):
            for n in numbers:
                remove_folder(self.spark, f"{self.folder}/{kind}/{n}")
