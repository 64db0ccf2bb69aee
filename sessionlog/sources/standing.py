"""Standing tables of sessions: sorted files of bounded size, named by a manifest that is swapped whole.

    <table>/data/<write>/part-*      rows, sorted by session_id and the table's order
    <table>/manifests/<name>/        file, low and high session_id, rows, bytes of every live file
    <table>/versions/<number>        one small file a version; it names its manifest

A write sorts its rows by ranges of (session_id, order) into as many files as their size
asks for, so a session of any size lies in many files and any number of tasks write.
Of the live files only those that hold a session to be replaced are written anew,
without it; manifest ranges and the files' session_id column tell which. The last act
is to put the next version in place, which fails if another writer was first; then the
write starts again from that writer's version. Until then readers see the old version,
and so they do for good if a job is stopped: what it wrote is named by no manifest.

Putting a version in place renames a filled file without overwriting, which must be
atomic: it is on local and distributed file systems, not on plain object stores.

The driver holds the manifest, a row a file; nothing that grows with rows or sessions.
Rows with a null session_id are kept and never replaced.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .store import cut, discard, filesystem, stored_bytes

FILE_BYTES = 256 << 20
ATTEMPTS = 8
_FILES = "file string, low string, high string, rows long, bytes long"


class Conflict(RuntimeError):
    """Other writers were first each time."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    at, files = filesystem(spark, f"{path}/versions")
    if not files.exists(at):
        return []
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit())


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[Row]]:
    """The latest version, or that asked for, and its live files; 0 and none where there is no table."""
    known = _versions(spark, path)
    if not known:
        return 0, []
    version = known[-1] if version is None else version
    name = spark.read.text(f"{path}/versions/{version:012d}").first()[0]
    return version, spark.read.schema(_FILES).parquet(f"{path}/manifests/{name}").orderBy("low", "file").collect()


def _put_in_place(spark: SparkSession, path: str, version: int, name: str) -> bool:
    """Make this manifest the version, unless there is one already."""
    target, files = filesystem(spark, f"{path}/versions/{version:012d}")
    beside, _ = filesystem(spark, f"{path}/versions/.{name}")
    out = files.create(beside, False)
    out.write(bytearray(name.encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # a local rename overwrites; a link doesn't
            local = lambda p: unquote(urlparse(p.toUri().toString()).path)
            try:
                os.link(local(beside), local(target))
            except FileExistsError:
                return False
            return True
        return files.rename(beside, target)
    finally:
        files.delete(beside, False)


def _meets(row: Row, low: str | None, high: str | None) -> bool:
    return None not in (row["low"], row["high"], low, high) and row["low"] <= high and row["high"] >= low


def _holding(spark: SparkSession, live: list[Row], sessions: DataFrame, fmt: str) -> list[Row]:
    """The live files that hold any of the sessions."""
    low, high = sessions.agg(F.min("session_id"), F.max("session_id")).first()
    near = [f for f in live if _meets(f, low, high)]
    if not near:
        return []
    held = spark.read.schema("session_id string").format(fmt).load([f["file"] for f in near]).select("session_id", F.col("_metadata.file_path").alias("file"))
    hit = {r["file"] for r in held.join(sessions, "session_id", "left_semi").select("file").distinct().collect()}  # no more than there are files
    return [f for f in near if f["file"] in hit]


def _written(rows: DataFrame, path: str, order: tuple[str, ...], fmt: str, n_files: int) -> DataFrame:
    """Write the rows into n_files of session ranges; what the manifest says of them."""
    spark = rows.sparkSession
    folder = f"{path}/data/{uuid.uuid4().hex}"
    keys = ["session_id", *order]
    placed = rows.repartitionByRange(n_files, *keys).sortWithinPartitions(*keys)
    placed.write.option("parquet.bloom.filter.enabled#session_id", "true").format(fmt).save(folder)
    held = spark.read.schema("session_id string").format(fmt).load(folder)
    return held.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("session_id").alias("low"), F.max("session_id").alias("high"), F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )


def _swap(spark: SparkSession, path: str, version: int, kept: list[Row], fresh: DataFrame) -> bool:
    name = uuid.uuid4().hex
    spark.createDataFrame(kept, _FILES).unionByName(fresh).coalesce(1).write.parquet(f"{path}/manifests/{name}")
    versions, files = filesystem(spark, f"{path}/versions")
    files.mkdirs(versions)
    return _put_in_place(spark, path, version + 1, name)


def replace(rows: DataFrame, path: str, order: tuple[str, ...] = (), fmt: str = "parquet", file_bytes: int = FILE_BYTES, only_new: bool = False) -> int:
    """Replace the sessions that rows hold, and no others; returns the new version.

    only_new: it is an error if the table has any of the sessions, and nothing is written.
    """
    spark = rows.sparkSession
    staged = cut(rows)
    sessions = cut(staged.select("session_id").distinct())
    try:
        for _ in range(ATTEMPTS):
            version, live = current(spark, path)
            touched = _holding(spark, live, sessions, fmt)
            if touched and only_new:
                raise FileExistsError(f"{path} has some of these sessions")
            whole = staged
            if touched:
                there = spark.read.schema(staged.schema).format(fmt).load([f["file"] for f in touched])
                whole = staged.unionByName(there.join(sessions, "session_id", "left_anti"))
            size = stored_bytes(staged) + sum(f["bytes"] for f in touched)
            gone = {f["file"] for f in touched}
            if _swap(spark, path, version, [f for f in live if f["file"] not in gone], _written(whole, path, order, fmt, max(1, -(-size // file_bytes)))):
                return version + 1
        raise Conflict(f"{path} changed {ATTEMPTS} times during a write")
    finally:
        discard(staged, sessions)


def merge_small(spark: SparkSession, path: str, schema: str, order: tuple[str, ...] = (), fmt: str = "parquet", file_bytes: int = FILE_BYTES) -> int:
    """Write the files of less than half of file_bytes anew, into as few as their size asks for; returns the version then."""
    for _ in range(ATTEMPTS):
        version, live = current(spark, path)
        small = [f for f in live if f["bytes"] < file_bytes // 2]
        if len(small) < 2:
            return version
        gone = {f["file"] for f in small}
        rows = spark.read.schema(schema).format(fmt).load(sorted(gone))
        n = max(1, -(-sum(f["bytes"] for f in small) // file_bytes))
        if _swap(spark, path, version, [f for f in live if f["file"] not in gone], _written(rows, path, order, fmt, n)):
            return version + 1
    raise Conflict(f"{path} changed {ATTEMPTS} times during a merge")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the last `keep` versions and remove writes that no kept version names; returns how many were removed. Not to be run beside a writer."""
    known = _versions(spark, path)
    for version in known[:-keep]:
        at, files = filesystem(spark, f"{path}/versions/{version:012d}")
        files.delete(at, False)
    live = {f["file"].rsplit("/", 2)[1] for v in known[-keep:] for f in current(spark, path, v)[1]}
    at, files = filesystem(spark, f"{path}/data")
    dead = [f.getPath() for f in files.listStatus(at) if f.getPath().getName() not in live] if files.exists(at) else []
    for folder in dead:
        files.delete(folder, True)
    return len(dead)


def read(spark: SparkSession, path: str, schema: str, sessions: list[str] | None = None, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The rows of a version. With a list of sessions only the files whose range holds one of them are opened, and of these the row groups that may."""
    _, live = current(spark, path, version)
    if sessions is not None:
        live = [f for f in live if any(_meets(f, s, s) for s in sessions)]
    if not live:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).format(fmt).load([f["file"] for f in live])
    return rows if sessions is None else rows.filter(F.col("session_id").isin(sessions))
