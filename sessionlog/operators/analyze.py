"""What a session did: tokens, tools, files, commands, failures, subagents.

Every result is keyed by session_id first; partial aggregates combine hot keys in
each task, and lists are bounded by what one session holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.functions.text import trim_all

SYNTHETIC = "<synthetic>"
FILE_TOOLS = ("Read", "Edit", "MultiEdit", "NotebookEdit", "Write")
EDIT_TOOLS = FILE_TOOLS[1:4]
#: Attachments that record a hook or permission decision.
HOOK_ATTACHMENTS = ("hook_additional_context", "hook_success", "hook_system_message", "command_permissions")
COUNTERS = ("input_tokens", "output_tokens", "cache_read", "cache_write")


def _real(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("type") == "assistant") & (F.col("model") != SYNTHETIC))


def _is_real() -> Column:
    return (F.col("type") == "assistant") & F.coalesce(F.col("model") != SYNTHETIC, F.lit(False))


def _sums() -> list:
    return [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS]


def tokens_by_model(entries: DataFrame) -> DataFrame:
    """A1: token sums and messages of each session and model."""
    return _real(entries).groupBy("session_id", "model").agg(*_sums(), F.count(F.lit(1)).alias("message_count"))


def token_totals(entries: DataFrame) -> DataFrame:
    """A2: token sums of each session, zeros where no model answered."""
    return entries.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(_is_real(), F.col(c))), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def token_rollup(entries: DataFrame) -> DataFrame:
    """A1 and A2 in one pass: sums by model and, where model is null, by session."""
    return _real(entries).groupingSets([["session_id", "model"], ["session_id"]], "session_id", "model").agg(*_sums())


def tool_counts(blocks: DataFrame) -> DataFrame:
    """A3: calls of each tool."""
    return blocks.filter("type = 'tool_use'").groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("calls"))


def files_touched(blocks: DataFrame) -> DataFrame:
    """A4: reads, edits and writes of each file; other tools that name one give zeros."""
    own = lambda *tools: F.count_if(F.col("tool_name").isin(*tools))
    named = blocks.filter("type = 'tool_use' AND file_path <> ''")
    return named.groupBy("session_id", F.col("file_path").alias("path")).agg(own("Read").alias("reads"), own(*EDIT_TOOLS).alias("edits"), own("Write").alias("writes"))


def read_without_write(blocks: DataFrame) -> DataFrame:
    """A5: files that were read and never changed."""
    return files_touched(blocks).filter("reads > 0 AND edits = 0 AND writes = 0").select("session_id", "path")


def bash_clusters(blocks: DataFrame, examples: int = 5) -> DataFrame:
    """Commands by their first word, with the first places of each; position is by count, then first use."""
    calls = blocks.filter("type = 'tool_use' AND tool_name = 'Bash' AND command IS NOT NULL")
    calls = calls.withColumn("cluster", F.regexp_extract(trim_all(F.col("command")), r"^(\S+)", 1)).filter("cluster <> ''")
    each = calls.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "cluster").orderBy("ix", "block_ix")))
    found = each.groupBy("session_id", "cluster").agg(F.count(F.lit(1)).alias("calls"), F.min(F.struct("ix", "block_ix")).alias("first"), F.array_sort(F.collect_list(F.when(F.col("n") <= examples, F.col("ix")))).alias("example_ix"))
    order = Window.partitionBy("session_id").orderBy(F.desc("calls"), "first")
    return found.select("session_id", "cluster", "calls", "example_ix", F.row_number().over(order).alias("position"))


def file_churn(blocks: DataFrame) -> DataFrame:
    """The ordered calls on each file, an empty path included."""
    calls = blocks.filter((F.col("type") == "tool_use") & F.col("tool_name").isin(*FILE_TOOLS) & F.col("file_path").isNotNull())
    events = F.array_sort(F.collect_list(F.struct("ix", "block_ix", F.col("tool_name").alias("kind"))))
    return calls.groupBy("session_id", F.col("file_path").alias("path")).agg(F.transform(events, lambda e: F.struct(e["ix"].alias("ix"), e["kind"].alias("kind"))).alias("timeline"))


def tool_use_index(blocks: DataFrame) -> DataFrame:
    """The last call of each tool id."""
    last = F.max_by(F.struct("tool_name", "input", "ix"), F.struct("ix", "block_ix"))
    return blocks.filter("type = 'tool_use' AND tool_id IS NOT NULL").groupBy("session_id", "tool_id").agg(last.alias("u")).select("session_id", "tool_id", "u.tool_name", "u.input", F.col("u.ix").alias("call_ix"))


def tool_result_index(blocks: DataFrame) -> DataFrame:
    """The last result for each tool id."""
    last = F.max_by(F.struct("content", "content_kind", "is_error", "ix"), F.struct("ix", "block_ix"))
    return blocks.filter("type = 'tool_result' AND tool_use_id IS NOT NULL").groupBy("session_id", "tool_use_id").agg(last.alias("r")).select("session_id", "tool_use_id", "r.content", "r.content_kind", "r.is_error", F.col("r.ix").alias("result_ix"))


def failures(blocks: DataFrame) -> DataFrame:
    """Failed results with the call that each answers; of an array the error is its text blocks, a line each, else its JSON."""
    texts = F.transform(F.filter(F.from_json("content", "array<string>"), lambda x: F.get_json_object(x, "$.type") == "text"), lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.lit("")))
    error = F.when((F.col("content_kind") == "array") & (F.size(texts) > 0), F.array_join(texts, "\n")).otherwise(F.col("content"))
    failed = blocks.filter("type = 'tool_result' AND is_error = true").select("session_id", "ix", "block_ix", F.col("tool_use_id").alias("tool_id"), error.alias("error"))
    joined = failed.join(tool_use_index(blocks), ["session_id", "tool_id"], "left")
    return joined.select("session_id", "ix", "block_ix", F.col("tool_id").alias("tool_use_id"), F.coalesce("tool_name", F.lit("unknown")).alias("tool_name"), "input", "error")


def token_density(entries: DataFrame) -> DataFrame:
    """Tokens in and out along a session."""
    return _real(entries).select("session_id", "ix", (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))


def subagents(entries: DataFrame, task_calls: DataFrame) -> DataFrame:
    """A10: the n-th Task call of a session and its n-th subagent by first time.

    entries: those of subagents, with parent_session_id. task_calls: session_id,
    ix, block_ix.
    """
    subs = entries.filter("parent_session_id IS NOT NULL").groupBy("parent_session_id", "session_id").agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("ix"))).alias("first_ts"),
        F.count(F.lit(1)).alias("turn_count"),
        *[F.coalesce(F.sum(F.when(_is_real(), F.col(c))), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
    )
    subs = subs.withColumn("n", F.row_number().over(Window.partitionBy("parent_session_id").orderBy(F.col("first_ts").asc_nulls_last(), "session_id")))
    calls = task_calls.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("ix", "block_ix"))).select(F.col("session_id").alias("parent_session_id"), "n", F.col("ix").alias("parent_ix"))
    return subs.join(calls, ["parent_session_id", "n"], "left").select(F.col("parent_session_id").alias("session_id"), F.col("session_id").alias("subagent"), "parent_ix", "turn_count", *COUNTERS)


def spills(blocks: DataFrame) -> DataFrame:
    """Results stored in a file of their own, with path and size label."""
    stored = blocks.filter("type = 'tool_result' AND content_kind = 'string' AND startswith(content, '<persisted-output>')")
    part = lambda pattern: F.regexp_extract("content", pattern, 1)
    return stored.select("session_id", "ix", "tool_use_id", part(r"Full output saved to: ([^\n]+)").alias("path"), part(r"Output too large \(([^)]*)\)").alias("size_label")).filter("path <> ''")


def permission_events(entries: DataFrame) -> DataFrame:
    """Changes of permission mode and hook decisions, with their details as JSON. entries: with permission_mode, attachment_type and attachment."""
    mode, hook = F.col("type") == "permission-mode", (F.col("type") == "attachment") & F.col("attachment_type").isin(*HOOK_ATTACHMENTS)
    details = F.when(mode, F.to_json(F.struct(F.col("permission_mode").alias("mode")))).otherwise(F.col("attachment"))
    return entries.filter(mode | hook).select("session_id", "ix", F.when(mode, "permission_mode").otherwise(F.col("attachment_type")).alias("kind"), F.when(mode, F.col("permission_mode")).alias("mode"), details.alias("details"))


def compaction_phases(entries: DataFrame, boundary: str = "is_boundary") -> DataFrame:
    """Stretches between compaction boundaries, with the context size of the first answer in each."""
    session = Window.partitionBy("session_id").orderBy("ix")
    phased = entries.withColumn("phase", F.sum(F.when(F.col(boundary), 1).otherwise(0)).over(session.rowsBetween(Window.unboundedPreceding, 0)))
    size = sum((F.coalesce(c, F.lit(0)) for c in ("cache_read", "cache_write")), F.coalesce("input_tokens", F.lit(0)))
    real = (F.col("type") == "assistant") & (F.col("model") != SYNTHETIC)
    return phased.groupBy("session_id", "phase").agg(F.min("ix").alias("start_ix"), F.max("ix").alias("end_ix"), F.min_by(size, F.when(real, F.col("ix"))).alias("baseline_tokens"))


def usage_rollup(entries: DataFrame, by: str | None = None) -> DataFrame:
    """Token sums over all logs, or over those of each value of a column, such as their folder; null sums where there are no entries."""
    keys = [] if by is None else [by]
    per = entries.groupBy(*keys, "session_id").agg(*[F.coalesce(F.sum(F.when(_is_real(), F.col(c))), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    return per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count(F.lit(1)).alias("sessions"))


def result_tokens(messages: DataFrame) -> DataFrame:
    """Tokens of result messages: the sum over modelUsage if it names any model, else usage. messages: session_id, model_usage, usage (JSON)."""
    per = F.map_values(F.from_json("model_usage", "map<string,struct<inputTokens:long,outputTokens:long,cacheReadInputTokens:long,cacheCreationInputTokens:long>>"))
    top = F.from_json("usage", "struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>")
    fields = zip(COUNTERS, ("inputTokens", "outputTokens", "cacheReadInputTokens", "cacheCreationInputTokens"), ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"), strict=True)
    total = lambda name: F.aggregate(per, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[name], F.lit(0)))
    return messages.select("session_id", *[F.when(F.size(per) > 0, total(a)).otherwise(top[b]).alias(c) for c, a, b in fields])


def analyze(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a session, its eleven sections nested; a section without rows is an empty list."""
    def section(rows: DataFrame, name: str, order: tuple[str, ...]) -> DataFrame:
        columns = [*order, *(c for c in rows.columns if c not in ("session_id", *order))]
        return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    def has(columns: str) -> bool:
        return set(columns.split()) <= set(entries.columns)

    parts = {
        "tokens_by_model": (tokens_by_model(entries), ("model",)), "tools": (tool_counts(blocks), ("tool_name",)), "files": (files_touched(blocks), ("path",)), "read_without_write": (read_without_write(blocks), ("path",)),
        "bash": (bash_clusters(blocks), ("position",)), "churn": (file_churn(blocks), ("path",)), "failures": (failures(blocks), ("ix", "block_ix")), "density": (token_density(entries), ("ix",)), "spills": (spills(blocks), ("ix",)),
    }
    tasks = blocks.filter("type = 'tool_use' AND tool_name = 'Task'").select("session_id", "ix", "block_ix")
    parts["subagents"] = (subagents(entries, tasks), ("subagent",))
    if has("permission_mode attachment_type attachment"):
        parts["permissions"] = (permission_events(entries), ("ix",))
    if has("is_boundary"):
        parts["phases"] = (compaction_phases(entries), ("phase",))
    out = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"))
    for name, (rows, order) in parts.items():
        out = out.join(section(rows, name, order), "session_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out.join(token_totals(entries), "session_id", "left")
