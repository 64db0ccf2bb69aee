"""Compacted logs: the last rounds as they were, a bundle of what came before."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.oneliners import one_liner, parsed_input, result_text
from sessionlog.functions.text import xml_attr, xml_text
from sessionlog.operators import compact, rounds
from sessionlog.operators.analyze import tool_use_index
from sessionlog.operators.metadata import session_facts
from sessionlog.sources import sinks
from sessionlog.sources.store import cut


def turn_parts(entries: DataFrame, blocks: DataFrame, selectors: tuple[str, ...] = (), most: int = compact.FIELD_BYTES, text_bytes: int = compact.TEXT_BYTES) -> DataFrame:
    """The XML parts of every entry: texts, calls, and a line for each result, or all of it where its tool is selected.

    session_id, ix, block_ix, answer, xml, stubbed, truncated, saved, user_tool.
    """
    zero = F.lit(0).cast("long")
    long = F.octet_length("text") > text_bytes
    texts = entries.filter("content_text IS NOT NULL").select("session_id", "ix", F.lit(-1).alias("block_ix"), F.col("content_text").alias("text")).unionByName(blocks.filter("type = 'text' AND text IS NOT NULL").select("session_id", "ix", "block_ix", "text"))
    texts = texts.withColumn("xml", compact.text_xml(F.col("text"), F.col("ix"), text_bytes))
    texts = texts.select("session_id", "ix", "block_ix", F.lit(False).alias("answer"), "xml", zero.alias("stubbed"), F.when(long, 1).otherwise(0).cast("long").alias("truncated"), F.when(long, F.greatest(F.lit(0), F.octet_length("text") - F.octet_length("xml"))).otherwise(0).cast("long").alias("saved"), F.lit(False).alias("user_tool"))
    calls = compact.tool_use_xml(blocks, most, selectors=selectors).select("session_id", "ix", "block_ix", F.lit(False).alias("answer"), "xml", zero.alias("stubbed"), F.col("truncated").cast("long").alias("truncated"), "saved", "user_tool")

    named = tool_use_index(blocks).select("session_id", F.col("tool_id").alias("tool_use_id"), F.col("tool_name").alias("called"), F.col("input").alias("given_json"))
    answers = blocks.filter("type = 'tool_result'").select("session_id", "ix", "block_ix", "tool_use_id", F.octet_length("content").alias("size"), "content_kind", result_text(F.col("content"), F.col("content_kind")).alias("body"), F.coalesce("is_error", F.lit(False)).alias("failed"))
    answers = answers.join(named, ["session_id", "tool_use_id"], "left").withColumn("called", F.coalesce("called", F.lit("unknown"))).withColumn("given_json", F.coalesce("given_json", F.lit("{}"))).withColumn("given", parsed_input("given_json"))
    user = compact.chosen(selectors, "tool", F.col("called"))
    line = xml_text(F.when(user, F.col("body")).otherwise(F.coalesce(one_liner(F.col("called"), F.col("given"), F.col("body"), F.col("failed")), F.lit(""))))
    head = F.concat(F.lit('<tool_result ix="'), F.col("ix").cast("string"), F.lit('" name="'), xml_attr(F.col("called")), F.lit('"'), F.when(F.col("failed"), ' error="true"').otherwise(""))
    answers = answers.withColumn("line", F.explode(F.array(line)))
    answers = answers.withColumn("xml", F.when(F.col("line") == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), "line", F.lit("</tool_result>"))))
    raw = F.when(F.col("content_kind").isin("string", "array"), F.col("size")).otherwise(0)
    results = answers.select("session_id", "ix", "block_ix", F.lit(True).alias("answer"), "xml", F.when(user, 0).otherwise(1).cast("long").alias("stubbed"), zero.alias("truncated"), F.when(user, 0).otherwise(F.greatest(F.lit(0), raw - F.octet_length("xml"))).cast("long").alias("saved"), user.alias("user_tool"))
    return texts.unionByName(calls).unionByName(results)


def bundles(classed: DataFrame, parts: DataFrame, start: DataFrame, stats: DataFrame, keep: int, selectors: tuple[str, ...] = ()) -> DataFrame:
    """session_id and the whole text of its bundle."""
    turns = compact.bundle_text(compact.turns(parts, classed))
    facts = start.join(stats, "session_id").select("session_id", "preserved_from", F.col("source").alias("entries"), ((F.col("passed") + F.col("user_types")) > 0).alias("tasks"), "user_tools", "user_types")
    return facts.join(turns, "session_id", "left").select("session_id", F.concat_ws("", compact.preamble(keep, selectors), F.concat("text", F.lit("\n"))).alias("text"))


def compact_sessions(
    entries: DataFrame, blocks: DataFrame, keep: int = 1, known: DataFrame | None = None, selectors: tuple[str, ...] = (), at: str | None = None, fresh: DataFrame | None = None
) -> DataFrame:
    """Lines of the new logs: session_id, new_session_id, section, ix, raw. Sections: 0 the bundle, 1 entries passed through, 2 the last rounds.

    at: the bundle's timestamp, by default now. fresh: ids that were claimed for the
    sessions; else they are ids that no known session has.
    """
    table = rounds.round_table(rounds.rounds(entries, rounds.human_texts(entries, blocks)))
    start = compact.preserved_from(table.select("session_id", "user_ix"), entries, keep)
    if fresh is None:
        fresh = compact.fresh_sessions(start, entries.select("session_id") if known is None else known)
    # Both are read several times, and the walk of long inputs is dear.
    classed = cut(compact.classes(entries, blocks, start, selectors))
    parts = cut(turn_parts(entries, blocks, selectors))
    dropped = entries.join(classed.filter("class = 'dropped'").select("session_id", "ix"), ["session_id", "ix"], "left_semi")
    text = bundles(classed, parts, start, compact.compact_stats(classed, parts, dropped), keep, selectors)
    section = F.when(F.col("class") == "tail", 2).when(F.col("class").isin("preserved", "user_type"), 1)
    kept = entries.join(classed.select("session_id", "ix", section.alias("section")).filter("section IS NOT NULL"), ["session_id", "ix"]).select("session_id", "section", "ix", "uuid", "raw")
    # Fixed here, so that a task that runs again writes the same line.
    now = F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z") if at is None else at)
    facts = session_facts(entries, ["version", "git_branch", "cwd"])
    known_of = lambda column, name: F.coalesce(column, F.lit("")).alias(name)
    text = text.join(facts, "session_id", "left")
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    entry = F.struct(F.lit("").alias("parentUuid"), F.lit(False).alias("isSidechain"), F.lit("").alias("promptId"), F.lit("external").alias("userType"), F.lit(False).alias("isMeta"), F.lit("user").alias("type"), message.alias("message"), F.lit("").alias("uuid"), now.alias("timestamp"), F.lit("").alias("sessionId"), known_of(F.col("version"), "version"), known_of(F.col("git_branch"), "gitBranch"), known_of(F.col("cwd"), "cwd"))
    first = text.select("session_id", F.lit(0).alias("section"), F.lit(-1).alias("ix"), F.lit("bundle").alias("uuid"), F.to_json(entry).alias("raw"))
    chained = compact.chain(first.unionByName(kept)).join(fresh, "session_id")
    return compact.rewrite(chained).select("session_id", "new_session_id", "section", "ix", "raw")


def write_compacted_sessions(entries: DataFrame, blocks: DataFrame, path: str, keep: int = 1, selectors: tuple[str, ...] = (), at: str | None = None) -> DataFrame:
    """Compact the sessions into logs `<new id>.jsonl` under a path; returns their lines as compact_sessions() gives them, stored.

    Their ids are claimed in `<path>/ids` before a line is written, so jobs that run
    at once share neither an id nor a log.
    """
    fresh = sinks.claim(entries.select("session_id"), f"{path}/ids", entries.select("session_id"))
    made = cut(compact_sessions(entries, blocks, keep, selectors=selectors, at=at, fresh=fresh))
    sinks.write_compacted(made, path)
    return made
