"""The shared folder, and tables written there so that a lost executor costs no more than a reread."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets one of its own, elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))


def filesystem(spark: SparkSession, path: str):  # noqa: ANN201
    """The path as the cluster's file system has it, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    at, files = filesystem(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a written table: its lineage ends here. The table goes when the driver ends, if discard() has not removed it before."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark)}/rows"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stored_bytes(table: DataFrame) -> int:
    """The size of a table that cut() wrote."""
    at, files = filesystem(table.sparkSession, _paths[table])
    return files.getContentSummary(at).getLength()


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            at, files = filesystem(table.sparkSession, path)
            files.delete(at, True)
