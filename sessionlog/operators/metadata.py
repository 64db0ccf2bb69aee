"""When a session ran, how long, and how it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analyze import COUNTERS, token_totals, tokens_by_model


def _ms(ts: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.col(ts)))


def session_facts(entries: DataFrame, columns: list[str]) -> DataFrame:
    """The first value of each column that isn't null, by ix."""
    return entries.groupBy("session_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ix"))).alias(c) for c in columns])


def metadata(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """M1-M4: start and end by position, duration, turns, end state.

    A session is ongoing if its last assistant entry makes a call that no result
    in the session answers.
    """
    timed = F.when(F.col("ts").isNotNull(), F.col("ix"))
    spans = entries.groupBy("session_id").agg(
        F.min_by("ts", timed).alias("start_ts"), F.max_by("ts", timed).alias("end_ts"), F.count(F.lit(1)).alias("turn_count"),
        F.bool_or(F.col("type") == "assistant").alias("answered"), F.max(F.when(F.col("type") == "assistant", F.col("ix"))).alias("last_ix"),
    )
    results = blocks.filter("type = 'tool_result'").select("session_id", F.col("tool_use_id").alias("tool_id")).distinct()
    open_calls = blocks.filter("type = 'tool_use'").select("session_id", F.col("ix").alias("last_ix"), "tool_id").join(spans.select("session_id", "last_ix"), ["session_id", "last_ix"], "left_semi")
    ongoing = open_calls.join(results, ["session_id", "tool_id"], "left_anti").select("session_id").distinct().withColumn("ongoing", F.lit(True))
    state = F.when(F.col("ongoing"), "ongoing").when(F.col("answered"), "completed").otherwise("unknown")
    return spans.join(ongoing, "session_id", "left").select(
        "session_id", "start_ts", "end_ts", F.round((_ms("end_ts") - _ms("start_ts")) / 1000).cast("long").alias("duration_s"), "turn_count", state.alias("end_state")
    )


def query_targets(logs: DataFrame) -> DataFrame:
    """M5: where a session's own log and its subagents' are. logs: session_id, parent_session_id, sub_name, path."""
    name = F.when(F.col("parent_session_id").isNull(), "session.jsonl").otherwise(F.concat(F.lit("subagents/"), "sub_name", F.lit("/session.jsonl")))
    return logs.groupBy(F.coalesce("parent_session_id", "session_id").alias("session_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("name"), "path")))).alias("targets"))


FACTS = ("version", "cwd", "git_branch", "permission_mode")


def info(entries: DataFrame, blocks: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """M6: metadata with the facts first observed, token totals, tokens by model and, if logs are given, targets (see query_targets)."""
    own = [c for c in FACTS if c in entries.columns]
    models = tokens_by_model(entries).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("model", *COUNTERS, "message_count"))).alias("by_model"))
    out = metadata(entries, blocks).join(session_facts(entries, own), "session_id", "left").join(token_totals(entries), "session_id", "left").join(models, "session_id", "left")
    return out if logs is None else out.join(query_targets(logs), "session_id", "left")


def format_duration(seconds: Column) -> Column:
    """Xh Ym Zs, leaving out leading zeros; a negative one in seconds."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    text = lambda x: x.cast("string")
    parts = F.when(h > 0, F.concat(text(h), F.lit("h "), text(m), F.lit("m "), text(s), F.lit("s"))).when(m > 0, F.concat(text(m), F.lit("m "), text(s), F.lit("s")))
    return F.when(seconds < 0, F.concat(text(seconds), F.lit("s"))).otherwise(F.coalesce(parts, F.concat(text(s), F.lit("s"))))


#: The labels of an info text, each over a column; rows without a value are left out.
INFO_ROWS = (("session:", "session_id"), ("version:", "version"), ("cwd:", "cwd"), ("branch:", "git_branch"), ("permission:", "permission_mode"), ("turns:", "turns"), ("duration:", "duration"), ("started:", "start_ts"), ("ended:", "end_ts"))


def info_lines(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """M7: a session's information as text: facts, token totals, and a line a model by first use."""
    first = entries.filter("type = 'assistant'").groupBy("session_id", "model").agg(F.min("ix").alias("first"))
    used = tokens_by_model(entries).join(first, ["session_id", "model"])
    label = F.concat("model", F.lit(" ("), F.col("message_count").cast("string"), F.lit(" msgs)"))
    sums = F.concat_ws("  ", *[F.concat(F.lit(f"{name}="), F.col(c).cast("string")) for name, c in zip(("in", "out", "cache_read", "cache_write"), COUNTERS, strict=True)])
    models = used.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first", label.alias("label"), sums.alias("sums")))).alias("models"))
    out = info(entries, blocks).withColumn("sums", sums).join(models, "session_id", "left").withColumn("models", F.coalesce("models", F.array()))
    width = F.greatest(F.lit(len("totals")), F.coalesce(F.array_max(F.transform("models", lambda m: F.length(m["label"]))), F.lit(0)))
    out = out.withColumns({"width": width, "turns": F.concat(F.col("turn_count").cast("string"), F.lit(" ("), "end_state", F.lit(")")), "duration": format_duration(F.col("duration_s"))})
    facts = [F.concat(F.lit(f"{name:<11} "), F.nullif(F.col(c).cast("string"), F.lit(""))) for name, c in INFO_ROWS if c in out.columns]
    line = lambda name, sums: F.concat(F.lit("  "), F.rpad(name, F.col("width"), F.lit(" ")), F.lit("  "), sums)
    each = F.transform("models", lambda m: line(m["label"], m["sums"]))
    parts = F.concat(F.array_compact(F.array(*facts)), F.array(F.lit(""), F.lit("tokens:"), line(F.lit("totals"), F.col("sums"))), each, F.array(F.lit("")))
    return out.select("session_id", F.array_join(parts, "\n").alias("text"))
