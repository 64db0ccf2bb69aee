"""File versions along a session, and the version current at a place in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_versions(snapshots: DataFrame) -> DataFrame:
    """The first place of each version of each file. snapshots: session_id, ix, tracked (JSON map of path to backup)."""
    backups = "map<string,struct<backupFileName:string,version:int,backupTime:string>>"
    each = snapshots.select("session_id", "ix", F.explode(F.from_json("tracked", backups)).alias("path", "b")).select("session_id", "ix", "path", "b.version", F.col("b.backupFileName").alias("blob"), F.col("b.backupTime").alias("backup_time"))
    return first_versions(each)


def first_versions(each: DataFrame) -> DataFrame:
    """The first record of each (session_id, path, version)."""
    kept = [c for c in each.columns if c not in ("session_id", "path", "version", "ix")]
    first = each.groupBy("session_id", "path", "version").agg(F.min_by(F.struct("ix", *kept), "ix").alias("f"))
    return first.select("session_id", "path", "version", "f.*")


def with_blobs(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """Versions with the size of their stored copy; blob and bytes are null where the listing lacks it. listing: session_id, blob, bytes."""
    own = listing.select("session_id", "blob", F.col("bytes").cast("long").alias("bytes")).dropDuplicates(["session_id", "blob"])
    return versions.join(own, ["session_id", "blob"], "left").withColumn("blob", F.when(F.col("bytes").isNotNull(), F.col("blob")))


#: A file's rows in so many consecutive entries of a session are ordered by one window.
SPAN = 65_536


def file_at(versions: DataFrame, requests: DataFrame, span: int = SPAN) -> DataFrame:
    """for each request (session_id, path, ix) the version current there: an as-of join.

    A file's places are dealt to ranges of `span` entries. A window finds the version
    within a range; where a range has none before a request, the last one of the
    ranges before it is carried over. So a file that is saved or asked for all along a
    huge session is spread over tasks; what one window sees of it whole is a row a range.

    status: ok, no blob (its copy isn't stored; only where versions have a blob
    column), too early (the file's first version comes later) or untracked. Of
    versions at one place the highest is current. Null keys equal each other; a
    null ix comes before all others.
    """
    blob = F.col("blob") if "blob" in versions.columns else F.lit("")
    seen_at = F.struct(F.col("version"), blob.cast("string").alias("blob"), F.col("ix").alias("at"))
    both = versions.select("session_id", "path", "ix", "version", F.lit(0).alias("asks"), seen_at.alias("own")).unionByName(requests.select("session_id", "path", "ix", F.lit(None).cast("int").alias("version"), F.lit(1).alias("asks")), allowMissingColumns=True)
    both = both.withColumn("range", F.floor(F.col("ix") / span))
    key = ["session_id", "path", "range"]
    # Of each range its last version; over a file's ranges the last before each, and whether any is tracked.
    last = F.max_by("own", F.when(F.col("asks") == 0, F.struct("ix", "version", "own.blob")))
    ranges = both.groupBy(*key).agg(last.alias("last"), F.count("version").alias("n"))
    file = Window.partitionBy("session_id", "path")
    before = F.last("last", ignorenulls=True).over(file.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*[F.col(k).alias(f"of_{k}") for k in key], before.alias("before"), (F.sum("n").over(file) > 0).alias("tracked"))
    order = Window.partitionBy(*key).orderBy("ix", "asks", "version", "own.blob").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("current", F.last("own", ignorenulls=True).over(order)).filter("asks = 1")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key])
    seen = seen.join(ranges, same).withColumn("current", F.coalesce("current", "before"))
    status = F.when(F.col("current").isNull(), F.when(F.col("tracked"), "too early").otherwise("untracked")).when(F.col("current.blob").isNull(), "no blob").otherwise("ok")
    return seen.select("session_id", "path", "ix", "current.version", status.alias("status"), F.nullif("current.blob", F.lit("")).alias("blob"))
