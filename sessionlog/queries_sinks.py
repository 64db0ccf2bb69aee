"""Registered queries that write a sink, replace some of its sessions, and read it back; and ids sought in texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog import queries_rich as rich_queries
from sessionlog.jobs import compact_sessions as job
from sessionlog.operators import scan
from sessionlog.sources import jsonl, rich, sinks, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sink(name: str, of: str, order: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> None:
    """The rows of another query, written in an earlier state for half of the sessions, which are then replaced, and read back."""
    source, sql = rich_queries.QUERIES[of], rich_queries.ORACLE_SQL[of]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = store.cut(source(spark, d).select(*columns) if columns else source(spark, d))
        path = f"{store.fresh_folder(spark)}/table"
        late = F.pmod(F.xxhash64("session_id"), F.lit(2)) == 1
        others = [c for c in rows.columns if c != "session_id"]
        earlier = rows.select("session_id", *[F.when(late & (F.col(c).isNotNull()), None).otherwise(F.col(c)).alias(c) if c not in order else F.col(c) for c in others])
        sinks.write_sessions(earlier.unionByName(earlier.filter(late)), path, order)
        sinks.write_sessions(rows.filter(late), path, order)
        return sinks.read_sessions(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM ({sql})" if columns else sql


_sink("w1_condensed_logs", "c8_condensed_entries", ("ix",), ("session_id", "ix", "ref", "type", "content"))
_sink("w2_full_turns", "c13_stubbed_turns", ("ix",))
_sink("w3_snapshot_index", "c16_snapshot_index", ("ix",))
_sink("w4_artifacts", "n4_artifacts")
_sink("w6_briefs", "b7_whole_brief")


def compacted_logs(spark: SparkSession, d: str) -> DataFrame:
    """Every session compacted into a log of its own under a claimed id; the logs' lines, whether they are those that were written, and their ids."""
    entries = store.cut(rich.entries(spark, d))
    blocks = store.cut(jsonl.blocks(entries))
    path = f"{store.fresh_folder(spark)}/compacted"
    made = job.write_compacted_sessions(entries, blocks, path, at=rich_queries.GENERATED_AT)
    read = sinks.read_compacted(spark, path).select(F.col("session_id").alias("new_session_id"), "line_no", "uuid", "parent_uuid", "version", "git_branch", "cwd", F.col("raw").alias("line"))
    runs = made.select("session_id", "new_session_id", "section", "ix", F.col("raw").alias("sent"), F.floor(F.col("ix") / jsonl.RUN_LINES).alias("run"))
    sent = jsonl.numbered(runs, ["session_id", "new_session_id"], ["section", "run"], ["ix"], "n").select("session_id", "new_session_id", "n", "sent")
    both = read.join(sent.withColumn("line_no", (F.col("n") + 1).cast("long")), ["new_session_id", "line_no"], "full")
    return both.select("session_id", "new_session_id", F.col("line_no").cast("int").alias("line_no"), "uuid", "parent_uuid", "version", "git_branch", "cwd", F.coalesce(F.col("line") == F.col("sent"), F.lit(False)).alias("same"))


QUERIES["w5_compacted_logs"] = compacted_logs
_ENVELOPE = ", facts AS (SELECT session_id," + rich_queries._FACTS + " FROM x GROUP BY session_id)"
ORACLE_SQL["w5_compacted_logs"] = f"""WITH k AS ({rich_queries.ORACLE_SQL["k14_rewritten_ids"]}),
e AS (SELECT * FROM ({rich_queries.SQL} SELECT session_id, ix, k, CASE WHEN k NOT IN (10, 12) THEN '1.' || ix // 3 END AS version, CASE WHEN k NOT IN (10, 12) THEN 'b' || ix // 3 END AS git_branch, CASE WHEN k NOT IN (10, 12) THEN '/work/' || c END AS cwd FROM x)),
f AS (SELECT session_id, coalesce(arg_min(version, ix) FILTER (k NOT IN (7, 10, 12)), '') AS version, coalesce(arg_min(git_branch, ix) FILTER (k NOT IN (7, 10, 12)), '') AS git_branch, coalesce(arg_min(cwd, ix) FILTER (k NOT IN (7, 10, 12)), '') AS cwd FROM e GROUP BY 1),
o AS (SELECT session_id, max(own_session) AS new_session_id FROM k GROUP BY 1)
SELECT k.session_id, o.new_session_id, row_number() OVER (PARTITION BY k.session_id ORDER BY section, k.ix)::INT AS line_no, k.uuid, k.parent_uuid,
  CASE WHEN section = 0 THEN f.version WHEN e.k <> 7 THEN e.version END AS version, CASE WHEN section = 0 THEN f.git_branch WHEN e.k <> 7 THEN e.git_branch END AS git_branch, CASE WHEN section = 0 THEN f.cwd WHEN e.k <> 7 THEN e.cwd END AS cwd, true AS same
FROM k JOIN o USING (session_id) JOIN f USING (session_id) LEFT JOIN e ON e.session_id = k.session_id AND e.ix = k.ix"""


def known_ids(spark: SparkSession, d: str) -> DataFrame:
    """O2: pieces of benchmark passages, which overlap and hold blanks, wherever they stand in documents."""
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("location"), "text")
    ids = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.array(F.substring("text", 11, 14), F.substring("text", 15, 14), F.substring("text", 1, 5))).alias("id"))
    return scan.known_ids(texts, ids).groupBy("location", "id").agg(F.sum("places").alias("places"))


QUERIES["o2_known_ids"] = known_ids
# Places of an id that can overlap itself are counted one by one, those of others by what is left without them.
ORACLE_SQL["o2_known_ids"] = """WITH i AS (SELECT id, len(list_filter(range(1, length(id)), lambda n: left(id, n) = right(id, n))) > 0 AS folds FROM (SELECT DISTINCT unnest([substring(text, 11, 14), substring(text, 15, 14), substring(text, 1, 5)]) AS id FROM benchmark)),
h AS (SELECT concat_ws('/', source, doc_id) AS location, text, id, folds FROM documents JOIN i ON contains(text, id) WHERE id <> '')
SELECT location, id, sum(CASE WHEN folds THEN len(list_filter(range(1, length(text) - length(id) + 2), lambda p: substring(text, p, length(id)) = id)) ELSE (length(text) - length(replace(text, id, ''))) // length(id) END)::BIGINT AS places FROM h GROUP BY location, id"""
