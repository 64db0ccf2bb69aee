"""Session logs in JSONL: one entry a line, many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ENVELOPE = "type string, uuid string, parentUuid string, timestamp string, requestId string, promptId string, gitBranch string, cwd string, version string, permissionMode string, isCompactSummary boolean, subtype string, attachment string, message struct<role:string,model:string,content:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>"


def placed(lines: DataFrame) -> DataFrame:
    """S3: lines with their session and parent session, by their path. A log is a file, or a folder of parts, named <session>.jsonl."""
    name = F.regexp_extract("path", r"([^/=]+)\.jsonl(?:/[^/]*)?$", 1)
    parent = F.nullif(F.regexp_extract("path", r"([^/]+)/subagents/agent-[^/]+\.jsonl(?:/[^/]*)?$", 1), F.lit(""))
    return lines.withColumn("parent_session_id", parent).withColumn("session_id", F.when(parent.isNotNull(), F.concat_ws("/", parent, name)).otherwise(name))


#: A line of a bundle: the log's name, a colon, the log's line.
_BUNDLED = r"^([^/:]+\.jsonl):(.*)$"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line with its log's path, session, parent session and place; the place (file, block, id) follows the file's order across splits.

    Files named *.logs, or in a folder named so, are bundles: lines of many logs, each
    behind its log's name. Such a log's path is the bundle's folder and that name.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    ).filter("value <> ''")
    bundle = F.regexp_extract("file", r"^(.*\.logs)(?:/[^/]*)?$", 1)
    bundled = (bundle != "") & F.col("value").rlike(_BUNDLED)
    own = F.when(bundled, F.concat(bundle, F.lit("/"), F.regexp_extract("value", _BUNDLED, 1))).otherwise(F.col("file"))
    return placed(lines.select(F.when(bundled, F.regexp_extract("value", _BUNDLED, 2)).otherwise(F.col("value")).alias("raw"), own.alias("path"), "file", "block", "id").filter("raw <> ''"))


def resolve(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted prefix with the sessions that it names: one, none (status unknown) or several (ambiguous). wanted: prefix.

    Paths join by equality; prefixes too, on as many characters of the session's id as the prefix has.
    """
    own, wanted = sessions.select("session_id", "path").distinct(), wanted.select("prefix").distinct()
    by_path = F.contains("prefix", F.lit("/")) | F.col("prefix").endswith(".jsonl")
    paths = wanted.filter(by_path).join(own.withColumnRenamed("path", "prefix"), "prefix")
    asked = wanted.filter(~by_path).withColumn("size", F.length("prefix"))
    heads = own.select("session_id").distinct().join(F.broadcast(asked.select("size").distinct()), F.length("session_id") >= F.col("size"))  # a row a length asked for
    heads = heads.withColumn("prefix", F.substring(F.col("session_id"), F.lit(1), F.col("size")))
    hits = paths.select("prefix", "session_id").unionByName(asked.join(heads, ["prefix", "size"]).select("prefix", "session_id"))
    found = wanted.join(hits, "prefix", "left").groupBy("prefix").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"))
    n = F.size("sessions")
    return found.select("prefix", "sessions", F.when(n == 1, "ok").when(n == 0, "unknown").otherwise("ambiguous").alias("status"))


def numbered(rows: DataFrame, keys: list[str], split: list[str], within: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 in the order of `split`, then `within`, for each of `keys`.

    Parallel prefix sums: rows are numbered inside a split, splits are counted, and a
    split's number begins where those before it end. No window holds more than one
    split's rows, or one key's splits.
    """
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *split).orderBy(*within)))
    sizes = rows.groupBy(*keys, *split).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_size")
    return local.join(starts, [*keys, *split]).withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_start", "_n")


#: Lines of a session that one window numbers.
RUN_LINES = 100_000


def collapse_rolls(entries: DataFrame, run_lines: int = RUN_LINES) -> DataFrame:
    """Of entries with one request id the last stays, where it stands; ix numbers what is left. entries: session_id, line_no, request_id."""
    roll = Window.partitionBy("session_id", F.coalesce("request_id", F.concat(F.lit("\0"), F.col("line_no").cast("string")))).orderBy(F.desc("line_no"))
    last = entries.withColumn("n", F.row_number().over(roll)).filter("n = 1").drop("n")
    runs = last.withColumn("run", F.floor(F.col("line_no") / run_lines))
    return numbered(runs, ["session_id"], ["run"], ["line_no"], "ix").withColumn("ix", F.col("ix").cast("int")).drop("run")


def _kind(value: str, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of all logs under a path; lines that aren't JSON are left out (see bad_lines). A log of many splits or parts is numbered by as many tasks."""
    lines = read_lines(spark, path).filter(F.try_parse_json("raw").isNotNull())
    lines = lines.withColumn("log", F.regexp_replace("path", r"(\.jsonl)/[^/]*$", "$1"))
    placed_lines = numbered(lines, ["log"], ["file", "block"], ["id"], "line_no")
    return parsed(placed_lines.withColumn("line_no", F.col("line_no") + 1).withColumn("path", F.col("log")).drop("log"))


def parsed(lines: DataFrame) -> DataFrame:
    """Entries of lines that are JSON: session_id, parent_session_id, path, line_no, raw."""
    lines = lines.withColumn("j", F.from_json("raw", _ENVELOPE))
    text = F.when(F.col("kind") == "STRING", F.col("j.message.content"))
    usage = lambda name: F.col(f"j.message.usage.{name}")
    flat = lines.withColumn("kind", _kind("raw", "$.message.content")).select(
        "session_id", "parent_session_id", "path", "line_no", F.col("j.type").alias("type"), F.col("j.uuid").alias("uuid"), F.col("j.parentUuid").alias("parent_uuid"), F.col("j.timestamp").alias("ts"),
        F.col("j.requestId").alias("request_id"), F.col("j.gitBranch").alias("git_branch"), F.col("j.cwd").alias("cwd"), F.col("j.version").alias("version"), F.col("j.permissionMode").alias("permission_mode"),
        F.get_json_object("j.attachment", "$.type").alias("attachment_type"), "j.attachment", (F.coalesce("j.isCompactSummary", F.lit(False)) | F.coalesce(F.col("j.subtype") == "compact_boundary", F.lit(False))).alias("is_boundary"),
        F.col("j.message.model").alias("model"), usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cache_read_input_tokens").alias("cache_read"), usage("cache_creation_input_tokens").alias("cache_write"),
        text.alias("content_text"), F.col("j.message.usage").isNotNull().alias("has_usage"), "raw",
    )
    return collapse_rolls(flat)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't JSON, for a table of their own."""
    return read_lines(spark, path).filter(F.try_parse_json("raw").isNull()).select("session_id", "path", "raw")


def blocks(entries: DataFrame) -> DataFrame:
    """The content blocks of entries, in order."""
    each = entries.select("session_id", "ix", F.posexplode(F.from_json(F.get_json_object("raw", "$.message.content"), "array<string>")).alias("block_ix", "block"))
    get = lambda path: F.get_json_object("block", path)
    string = lambda path: F.when(_kind("block", path) == "STRING", get(path))
    kind = _kind("block", "$.content")
    return each.select(
        "session_id", "ix", "block_ix", get("$.type").alias("type"), string("$.text").alias("text"), get("$.id").alias("tool_id"), get("$.name").alias("tool_name"), get("$.input").alias("input"),
        string("$.input.file_path").alias("file_path"), string("$.input.command").alias("command"), get("$.tool_use_id").alias("tool_use_id"), get("$.content").alias("content"),
        F.when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").alias("content_kind"),
        F.when(_kind("block", "$.is_error") == "BOOLEAN", get("$.is_error") == "true").alias("is_error"), "block",
    )
