"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder, since all its parts are on one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared checkpoint folder and read from there."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`df`, written once as files of a new folder in the shared one and read from there, and that folder.

    For tables of loops: a checkpoint keeps the size that its plan was estimated at, and that of a join is a product,
    so that after many joins the number itself fills the driver. Here the size is that of the files.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, on whatever store it is; none where there is no such folder."""
    path, store = _store(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, store = _store(spark, folder)
    store.delete(path, True)
