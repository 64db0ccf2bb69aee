"""Finding calls, results, texts and fields in sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.jsonwalk import pretty


def _field(name: str) -> Column:
    return F.get_json_object("input", f"$.{name}")


def tool_uses(blocks: DataFrame, name: str | None = None) -> DataFrame:
    """Q1: a match for each call, of one tool if named, with a one-line summary."""
    calls = blocks.filter("type = 'tool_use'")
    if name is not None:
        calls = calls.filter(F.col("tool_name") == name)
    part = lambda label, value: F.concat(F.lit(f"{label}="), value)
    command = F.substring(F.substring_index("command", "\n", 1), 1, 80)
    summary = F.concat_ws("  ", "tool_name", part("file_path", F.col("file_path")), part("cmd", command), part("pattern", _field("pattern")), part("subagent_type", _field("subagent_type")))
    return calls.select("session_id", "ix", "block_ix", F.lit("tool_use").alias("kind"), summary.alias("summary"), "tool_id")


def tool_results(blocks: DataFrame, errors_only: bool = False, tool_use_id: str | None = None) -> DataFrame:
    """Q2: a match for each result."""
    found = blocks.filter("type = 'tool_result'")
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    if errors_only:
        found = found.filter(failed)
    if tool_use_id is not None:
        found = found.filter(F.col("tool_use_id") == tool_use_id)
    items = F.from_json("content", "array<struct<type:string,text:string>>")
    text = F.when(F.col("content_kind") == "string", F.col("content")).when(F.col("content_kind") == "array", F.get(F.filter(items, lambda x: (x["type"] == "text") & x["text"].isNotNull()), F.lit(0))["text"])
    head = F.nullif(F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, 80), F.lit(""))
    return found.select("session_id", "ix", "block_ix", F.lit("tool_result").alias("kind"), F.concat_ws("  ", "tool_use_id", F.when(failed, "[ERROR]"), head).alias("summary"), failed.alias("is_error"))


def searched_texts(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Q3: the text of each entry that is searched: a string, else its text blocks and, of a user, results that are strings, a line each."""
    part = F.when(F.col("type") == "text", F.col("text")).when((F.col("type") == "tool_result") & (F.col("content_kind") == "string"), F.col("content"))
    each = blocks.select("session_id", "ix", "block_ix", "type", part.alias("part")).filter("part IS NOT NULL")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["part"]), "\n")
    own = F.struct("block_ix", "part")
    whole = each.groupBy("session_id", "ix").agg(joined(own).alias("all"), joined(F.when(F.col("type") == "text", own)).alias("texts"))
    rows = entries.filter("type IN ('user', 'assistant')").join(whole, ["session_id", "ix"], "left")
    text = F.coalesce("content_text", F.when(F.col("type") == "user", F.col("all")).otherwise(F.col("texts")), F.lit(""))
    return rows.select("session_id", "ix", F.col("type").alias("role"), text.alias("text"))


def text_search(texts: DataFrame, needle: str, role: str | None = None, before: int = 20, after: int = 60) -> DataFrame:
    """Q3: entries whose text holds the needle, with a snippet. texts: session_id, ix, role, text."""
    found = texts.filter(F.contains("text", F.lit(needle)) & F.col("role").isin(*(("user", "assistant") if role is None else (role,))))
    at = F.instr("text", F.lit(needle)) - 1
    start, end = F.greatest(at - before, F.lit(0)), F.least(at + len(needle) + after, F.length("text"))
    snippet = F.concat(F.when(start > 0, "...").otherwise(""), F.replace(F.substring(F.col("text"), start + 1, end - start), F.lit("\n"), F.lit(" ")), F.when(end < F.length("text"), "...").otherwise(""))
    return found.select("session_id", "ix", F.col("role").alias("kind"), snippet.alias("summary"))


def show(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Q4: the entries asked for (session_id, ix); found is false where ix is out of range."""
    return wanted.join(entries.withColumn("found", F.lit(True)), ["session_id", "ix"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def field(rows: DataFrame, path: str, column: str = "raw") -> DataFrame:
    """Q5: a field by a path such as a.b[0].c, null where it is missing."""
    return rows.select("session_id", "ix", F.get_json_object(column, "$." + path).alias("value"))


def format_matches(matches: DataFrame, form: str = "compact") -> DataFrame:
    """Q7: a line for each match, or all of it as JSON (form json), or the number of matches of each session (form count)."""
    if form == "count":
        return matches.groupBy("session_id").agg(F.count(F.lit(1)).alias("matches"))
    if form == "json":
        return matches.select("session_id", "ix", F.to_json(F.struct(*[c for c in matches.columns if c != "session_id"])).alias("line"))
    return matches.select("session_id", "ix", F.concat_ws("  ", F.format_string("%5d", "ix"), "kind", "summary").alias("line"))


def render(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Q6: an entry as text: a header by its type, then its blocks in order; other entries as indented JSON."""
    c, kind = F.col("content"), F.col("content_kind")
    spill = lambda pattern: F.regexp_extract(c, pattern, 1)
    wrapped = F.concat(F.lit("[spilled to "), spill(r"Full output saved to: ([^\n]+)"), F.lit(" — "), spill(r"Output too large \(([^)]*)\)"), F.lit("]\n(Read the file above for full content; preview follows)\n\n"), spill(r"(?s)Preview \([^)]*\):\n(.*?)(?:\n</persisted-output>)?\s*$"))
    items = F.transform(F.from_json(c, "array<string>"), lambda x: F.coalesce(F.when(F.get_json_object(x, "$.type") == "text", F.get_json_object(x, "$.text")), F.get_json_object(x, "$.content"), x))
    flat = F.when(kind == "string", F.when(F.startswith(c, F.lit("<persisted-output>")), wrapped).otherwise(c)).when(kind == "array", F.array_join(items, "\n")).otherwise(F.coalesce(pretty(F.when(kind == "object", c)), F.lit("")))
    part = F.when(F.col("type") == "text", F.col("text")).when(F.col("type") == "tool_use", F.concat(F.lit("[tool_use: "), "tool_name", F.lit(" id="), "tool_id", F.lit("]\ninput: "), pretty(F.col("input"))))
    part = part.when(F.col("type") == "tool_result", F.concat(F.lit("tool_use_id: "), "tool_use_id", F.when(F.col("is_error"), "\nis_error: true").otherwise(""), F.lit("\ncontent:\n"), flat)).otherwise(F.concat(F.lit("["), F.coalesce("type", F.lit("unknown-block")), F.lit("] "), "block") if "block" in blocks.columns else F.concat(F.lit("["), "type", F.lit("]")))
    each = blocks.select("session_id", "ix", "block_ix", part.alias("part"), (F.col("type") == "tool_result").alias("answer"))
    body = each.groupBy("session_id", "ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "part"))), lambda x: x["part"]), "\n").alias("body"), F.bool_or("answer").alias("answers"))
    head = F.when(F.col("type") == "assistant", F.concat(F.lit("[assistant · "), "model", F.lit("]"))).when(F.coalesce("answers", F.lit(False)), "[user · tool_result]").otherwise("[user]")
    spoken = entries.filter("type IN ('assistant', 'user')").join(body, ["session_id", "ix"], "left")
    out = spoken.select("session_id", "ix", F.concat_ws("\n", head, F.coalesce("content_text", "body")).alias("text"))
    if "raw" not in entries.columns:  # tables of calls alone have no other entries
        return out
    others = entries.filter(~F.coalesce(F.col("type").isin("assistant", "user"), F.lit(False)))
    return out.unionByName(others.select("session_id", "ix", pretty(F.col("raw")).alias("text")))
