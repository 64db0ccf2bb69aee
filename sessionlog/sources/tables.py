"""Event, conversation and document tables read as session logs.

Every frame has the columns of the JSONL route (sources.jsonl), so operators
don't know where their rows came from.

entries: session_id, parent_session_id, ix, type, uuid, parent_uuid, ts,
request_id, git_branch, model, input_tokens, output_tokens, cache_read,
cache_write, content_text, has_usage.
blocks: session_id, ix, block_ix, type, text, tool_id, tool_name, input (JSON),
file_path, command, tool_use_id, content, content_kind, is_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOOLS = {"view": "Read", "click": "Bash"}
PURCHASE_TOOLS = ("Write", "Edit", "MultiEdit")
COMMANDS = ("git status", "  npm test", "ls -la src", "git commit -m wip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def numbered_events(events: DataFrame) -> DataFrame:
    """Events with session_id, ix and what the mapping derives from them: one window by session."""
    session = Window.partitionBy("session_id").orderBy("ts", "event_id")
    kind, k = F.col("event_type"), F.col("k")
    e = events.select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("user_id").cast("string").alias("session_id"))
    e = e.withColumn("ix", (F.row_number().over(session) - 1).cast("int"))
    e = e.withColumn("calls", kind.isin("view", "click", "purchase"))
    e = e.withColumn("tool_id", F.when(F.col("calls"), F.concat(F.lit("toolu_"), "event_id")))
    earlier = F.last("tool_id", ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("tool_use_id", F.when(kind == "error", F.coalesce(earlier, F.concat(F.lit("toolu_missing_"), "event_id"))))
    e = e.withColumn("tool_name", F.when(kind == "view", "Read").when(kind == "click", "Bash").when(kind == "purchase", _pick(k, PURCHASE_TOOLS)))
    e = e.withColumn("file_path", F.when(kind.isin("view", "purchase"), F.concat(F.lit("/home/u"), "user_id", F.lit("/src/f"), (k % 10).cast("string"), F.lit(".ts"))))
    e = e.withColumn("command", F.when(kind == "click", _pick(k, COMMANDS)))
    human = F.when(k % 5 == 0, F.concat(F.lit("<system-reminder>note "), "event_id", F.lit("</system-reminder>"))).otherwise(F.concat(F.lit("please do task "), "event_id", F.lit("\nstep "), k.cast("string")))
    result = F.when(k % 3 == 0, F.concat(F.lit("Error: "), k.cast("string"), F.lit("\nat line "), "event_id")).when(k % 3 == 1, F.concat(F.lit("Found "), k.cast("string"), F.lit(" files"))).otherwise(F.concat(F.lit("[main abc1234] commit "), "event_id"))
    return e.withColumn("human", F.when(kind == "signup", human)).withColumn("result", F.when(kind == "error", result))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as entries."""
    e, k = numbered_events(table(spark, sf_dir, "events")), F.col("k")
    text = "string"
    usage = lambda c: F.when(F.col("calls"), c)
    return e.select(
        "session_id",
        F.lit(None).cast(text).alias("parent_session_id"),
        "ix",
        F.when(F.col("calls"), "assistant").otherwise("user").alias("type"),
        F.concat(F.lit("u"), "event_id").alias("uuid"),
        F.lag(F.concat(F.lit("u"), "event_id")).over(Window.partitionBy("session_id").orderBy("ts", "event_id")).alias("parent_uuid"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        F.when(F.col("calls"), F.concat(F.lit("req_"), "user_id", F.lit("_"), F.floor(F.col("ix") / 2).cast(text))).alias("request_id"),
        F.concat(F.lit("b"), (F.floor(F.col("ix") / 10) % 3).cast(text)).alias("git_branch"),
        usage(F.when(F.col("event_id") % 10 == 0, "<synthetic>").when(F.col("event_id") % 2 == 0, "model-a").otherwise("model-b")).alias("model"),
        usage(F.floor(F.col("value") * 10)).cast("long").alias("input_tokens"),
        usage(F.floor("value")).cast("long").alias("output_tokens"),
        usage(k).cast("long").alias("cache_read"),
        usage(F.nullif(k % 7, F.lit(0))).cast("long").alias("cache_write"),
        F.col("human").alias("content_text"),
        F.col("calls").alias("has_usage"),
    )


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as content blocks: one tool_use or tool_result an entry."""
    e, k = numbered_events(table(spark, sf_dir, "events")), F.col("k").cast("string")
    edit = lambda what: F.concat(F.lit(f',"{what}_string":"a\\nline '), k, F.lit(f" {what}\\nz\""))
    given = F.when(F.col("command").isNotNull(), F.concat(F.lit('{"command":"'), "command", F.lit('"}')))
    given = given.when(F.col("tool_name") == "Edit", F.concat(F.lit('{"file_path":"'), "file_path", F.lit('"'), edit("old"), edit("new"), F.lit("}")))
    given = given.when(F.col("file_path").isNotNull(), F.concat(F.lit('{"file_path":"'), "file_path", F.lit('"}')))
    return e.filter(F.col("calls") | F.col("tool_use_id").isNotNull()).select(
        "session_id",
        "ix",
        F.lit(0).alias("block_ix"),
        F.when(F.col("calls"), "tool_use").otherwise("tool_result").alias("type"),
        F.lit(None).cast("string").alias("text"),
        "tool_id",
        "tool_name",
        given.alias("input"),
        "file_path",
        "command",
        "tool_use_id",
        F.col("result").alias("content"),
        F.when(F.col("result").isNotNull(), "string").alias("content_kind"),
        F.when(F.col("tool_use_id").isNotNull(), F.col("k") % 2 == 0).alias("is_error"),
    )


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as entries with plain text content."""
    c = table(spark, sf_dir, "conversations")
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"),
        empty("parent_session_id", "string"),
        F.col("turn").cast("int").alias("ix"),
        F.col("role").alias("type"),
        *[empty(x, "string") for x in ("uuid", "parent_uuid", "ts", "request_id", "git_branch", "model")],
        *[empty(x, "long") for x in ("input_tokens", "output_tokens", "cache_read", "cache_write")],
        F.col("text").alias("content_text"),
        F.lit(False).alias("has_usage"),
    )


#: The same mapping in DuckDB: ev (numbered events), e (entries), b (blocks), c (conversation entries).
SQL = r"""
WITH ev0 AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(user_id AS VARCHAR) AS session_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS ix, event_type IN ('view', 'click', 'purchase') AS calls FROM events),
ev1 AS (SELECT *, CASE WHEN calls THEN 'toolu_' || event_id END AS tool_id FROM ev0),
ev AS (SELECT *, CASE WHEN event_type = 'error' THEN coalesce(last_value(tool_id IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'toolu_missing_' || event_id) END AS tool_use_id,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Bash' WHEN 'purchase' THEN (['Write', 'Edit', 'MultiEdit'])[k % 3 + 1] END AS tool_name,
  CASE WHEN event_type IN ('view', 'purchase') THEN '/home/u' || user_id || '/src/f' || (k % 10) || '.ts' END AS file_path,
  CASE WHEN event_type = 'click' THEN (['git status', '  npm test', 'ls -la src', 'git commit -m wip'])[k % 4 + 1] END AS command,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 5 = 0 THEN '<system-reminder>note ' || event_id || '</system-reminder>' ELSE 'please do task ' || event_id || chr(10) || 'step ' || k END END AS human,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'Error: ' || k || chr(10) || 'at line ' || event_id WHEN 1 THEN 'Found ' || k || ' files' ELSE '[main abc1234] commit ' || event_id END END AS result
  FROM ev1),
e AS (SELECT session_id, ix, CASE WHEN calls THEN 'assistant' ELSE 'user' END AS type, 'u' || event_id AS uuid, lag('u' || event_id) OVER (PARTITION BY session_id ORDER BY ix) AS parent_uuid,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, CASE WHEN calls THEN 'req_' || user_id || '_' || (ix // 2) END AS request_id, 'b' || ((ix // 10) % 3) AS git_branch,
  CASE WHEN calls THEN CASE WHEN event_id % 10 = 0 THEN '<synthetic>' WHEN event_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END END AS model,
  CASE WHEN calls THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens, CASE WHEN calls THEN CAST(floor(value) AS BIGINT) END AS output_tokens,
  CASE WHEN calls THEN CAST(k AS BIGINT) END AS cache_read, CASE WHEN calls THEN CAST(nullif(k % 7, 0) AS BIGINT) END AS cache_write, human AS content_text FROM ev),
b AS (SELECT session_id, ix, 0 AS block_ix, CASE WHEN calls THEN 'tool_use' ELSE 'tool_result' END AS type, tool_id, tool_name,
  CASE WHEN command IS NOT NULL THEN '{"command":"' || command || '"}' WHEN tool_name = 'Edit' THEN '{"file_path":"' || file_path || '","old_string":"a\nline ' || k || ' old\nz","new_string":"a\nline ' || k || ' new\nz"}'
    WHEN file_path IS NOT NULL THEN '{"file_path":"' || file_path || '"}' END AS input,
  file_path, command, tool_use_id, result AS content, CASE WHEN tool_use_id IS NOT NULL THEN k % 2 = 0 END AS is_error FROM ev WHERE calls OR tool_use_id IS NOT NULL),
c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS ix, role AS type, text AS content_text FROM conversations)
"""
