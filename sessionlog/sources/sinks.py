"""Where results go. Each sink is a standing table of sessions (see standing), not a file or folder a session; compacted sessions become logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.operators import compact

from . import jsonl, standing
from .store import cut, discard


def write_sessions(rows: DataFrame, path: str, order: tuple[str, ...] = (), fmt: str = "parquet", file_bytes: int = standing.FILE_BYTES) -> int:
    """Replace the sessions that rows hold, and no others; returns the table's new version."""
    return standing.replace(rows, path, order, fmt, file_bytes)


def read_sessions(spark: SparkSession, path: str, schema: str, sessions: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """What write_sessions wrote; of some sessions without opening the files of others."""
    return standing.read(spark, path, schema, sessions, fmt)


def claim(sessions: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """A new id for each session (column session_id), which no known session has and no other claim in this table: session_id, new_session_id.

    Ids are committed to the table before anything is written under them, so two
    jobs at once never hold the same one: the later commit starts anew with the
    other's ids known. A session that is claimed again gets another id.
    """
    spark = sessions.sparkSession
    wanted = cut(sessions.select("session_id").distinct())
    schema = "session_id string, source string"
    for _ in range(standing.ATTEMPTS):
        taken = standing.read(spark, path, schema).select("session_id")
        if known is not None:
            taken = taken.unionByName(known.select("session_id"))
        fresh = cut(compact.fresh_sessions(wanted, taken))
        try:
            standing.replace(fresh.select(F.col("new_session_id").alias("session_id"), F.col("session_id").alias("source")), path, only_new=True)
        except FileExistsError:
            discard(fresh)
            continue
        return fresh
    raise standing.Conflict(f"{path}: ids were taken {standing.ATTEMPTS} times")


def write_log(lines: DataFrame, path: str, apart: bool = False) -> None:
    """Lines (session, line_no, raw) as text, in the order of the parts' names; a long log has many parts.

    Logs lie together in a bundle, `<path>/<write>.logs`: files of as many lines as Spark
    gives a task, each line behind its log's name (see jsonl.read_lines), for a file a log
    costs more than the few lines in it. apart: each log in a folder `log=<session>.jsonl`.
    """
    name = F.replace(F.replace(F.replace("session", F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
    named = lines.select(F.concat("session" if apart else name, F.lit(".jsonl")).alias("log"), "line_no", "raw").repartitionByRange("log", "line_no").sortWithinPartitions("log", "line_no")
    if apart:
        named.select("log", "raw").write.mode("append").partitionBy("log").text(path)
    else:
        named.select(F.concat("log", F.lit(":"), "raw")).write.text(f"{path}/{uuid.uuid4().hex}.logs")


_DONE = "session_id string, folder string"


def write_compacted(rows: DataFrame, path: str) -> None:
    """Lines of compacted sessions in order, as logs <new id>.jsonl; never over a log that is there.

    rows: new_session_id, section, ix, raw, under ids that claim() gave. Every write has
    a folder of its own; the table `<path>/done` says which folder holds a log, once it is
    complete, so what a stopped job leaves is never read.
    """
    rows = cut(rows.select("new_session_id", "section", "ix", "raw"))
    spark, ids = rows.sparkSession, rows.select(F.col("new_session_id").alias("session_id")).distinct()
    if not standing.read(spark, f"{path}/done", _DONE).join(ids, "session_id", "left_semi").isEmpty():
        raise FileExistsError(f"{path} has some of these logs")
    folder = f"{path}/logs/{uuid.uuid4().hex}"
    write_log(rows.select(F.col("new_session_id").alias("session"), F.struct("section", "ix").alias("line_no"), "raw"), folder)
    standing.replace(ids.withColumn("folder", F.lit(folder)), f"{path}/done", only_new=True)
    discard(rows)


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all complete compacted logs."""
    folders = [r[0] for r in standing.read(spark, f"{path}/done", _DONE).select("folder").distinct().collect()]  # a row a write
    return jsonl.read_entries(spark, folders)
