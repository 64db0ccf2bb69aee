"""Condensed sessions: large payloads become stubs, and what that saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.jsonwalk import condensed, unwalked
from sessionlog.functions.text import json_quote, stub, turn_ref

from .analyze import tool_use_index

MAX_INLINE = 2048


def condensed_texts(entries: DataFrame, most: int = MAX_INLINE) -> DataFrame:
    """C1 over plain contents: the text, or a stub of it where it is over `most` bytes."""
    cut = stub(F.col("content_text"), turn_ref(F.col("ix")), most)
    return entries.select("session_id", "ix", role(F.col("type")).alias("role"), F.when(cut.isNull(), F.col("content_text")).alias("content"), cut.alias("stub"))


def condensed_blocks(blocks: DataFrame, most: int = MAX_INLINE) -> DataFrame:
    """session_id, ix, block_ix, type, json (the condensed block), stubbed, orig and inlined (bytes before and after).

    Built-in functions condense what needs no walk (`unwalked`); the walk over the
    other blocks is one Python step in Arrow batches, in which the former are nulls.
    Results are exploded from an array of one, so that no column builds them anew.
    """
    names = ["session_id", "ix", "block_ix", "type", *(c for c in ("tool_name", "tool_use_id") if c in blocks.columns)]
    rows = blocks.select(*names, "block", F.explode(F.array(unwalked(F.col("block"), most))).alias("own"))
    own, size = F.col("own"), lambda c: F.octet_length(c).cast("long")
    walked = condensed(F.when(own.isNull(), F.col("block")), turn_ref(F.col("ix")), most)
    rows = rows.select(*names, "block", "own", F.explode(F.array(walked)).alias("cut"))
    own_values = {"json": own, "stubbed": F.lit(False), "orig": size("block"), "inlined": size(own)}
    return rows.select(*names, *[F.when(own.isNotNull(), v).otherwise(F.col("cut")[c]).alias(c) for c, v in own_values.items()])


def condensed_payloads(entries: DataFrame, most: int = MAX_INLINE) -> DataFrame:
    """Of entries that aren't messages, what isn't metadata: session_id, ix, type, json, stubbed, orig, inlined."""
    cut = F.array(condensed(F.col("raw"), turn_ref(F.col("ix")), most, whole_entry=True))
    others = entries.filter(~F.col("type").isin("user", "assistant"))
    return others.select("session_id", "ix", "type", F.explode(cut).alias("cut")).select("session_id", "ix", "type", "cut.*")


def _plain(entries: DataFrame, most: int) -> DataFrame:
    """User texts that are one string: session_id, ix, type, json, stubbed, orig, inlined."""
    text = F.col("content_text")
    cut = stub(text, turn_ref(F.col("ix")), most)
    rows = entries.filter("type = 'user' AND content_text IS NOT NULL").select("session_id", "ix", "type", F.when(cut.isNull(), json_quote(text)).otherwise(F.to_json(cut)).alias("json"), cut.isNotNull().alias("stubbed"), F.octet_length(text).cast("long").alias("orig"))
    return rows.withColumn("inlined", F.octet_length("json").cast("long"))


def role(kind: Column) -> Column:
    """S6."""
    return F.when(kind.isin("user", "assistant", "system", "summary", "attachment"), kind).otherwise("other")


def condensed_entries(entries: DataFrame, blocks: DataFrame, most: int = MAX_INLINE) -> DataFrame:
    """Every entry condensed: ref, parent_ix, role, type, ts, content (JSON), stubbed, tokens (C7), synthetic."""
    each = condensed_blocks(blocks, most).groupBy("session_id", "ix").agg(F.array_sort(F.collect_list(F.struct("block_ix", "json"))).alias("parts"), F.bool_or("stubbed").alias("stubbed"))
    lists = each.select("session_id", "ix", F.concat(F.lit("["), F.array_join(F.transform("parts", lambda x: x["json"]), ","), F.lit("]")).alias("content"), "stubbed")
    single = _plain(entries, most).unionByName(condensed_payloads(entries, most)).select("session_id", "ix", F.col("json").alias("content"), "stubbed")
    uses = F.when((F.col("type") == "assistant") & F.col("has_usage"), F.struct(F.col("input_tokens").alias("in"), F.col("output_tokens").alias("out"), "cache_read", "cache_write"))
    ref = F.when(F.coalesce("uuid", F.lit("")) != "", F.concat(F.lit("uuid:"), "uuid")).otherwise(F.concat(F.lit("ix:"), F.col("ix").cast("string")))
    head = entries.select("session_id", "ix", ref.alias("ref"), role(F.col("type")).alias("role"), "type", "ts", uses.alias("tokens"), F.coalesce((F.col("type") == "assistant") & (F.col("model") == "<synthetic>"), F.lit(False)).alias("synthetic"))
    out = head.join(parent_ix(entries), ["session_id", "ix"], "left").join(lists.unionByName(single), ["session_id", "ix"], "left")
    return out.withColumn("content", F.coalesce("content", F.lit("[]"))).withColumn("stubbed", F.coalesce("stubbed", F.lit(False)))


def condense_stats(entries: DataFrame, blocks: DataFrame, most: int = MAX_INLINE) -> DataFrame:
    """Per kind, and in all where kind is null: count, orig_bytes, inlined_bytes, truncated. Blocks inside a result aren't counted again."""
    names = tool_use_index(blocks).select("session_id", F.col("tool_id").alias("tool_use_id"), F.col("tool_name").alias("called"))
    t = F.col("type")
    own = F.when(t == "tool_use", F.concat(F.lit("tool_use:"), "tool_name")).when(t == "tool_result", F.concat(F.lit("tool_result:"), F.coalesce("called", F.lit("<unknown>"))))
    own = own.when(t.isin("text", "thinking", "image"), F.concat(F.lit("assistant:"), t)).otherwise(F.concat(F.lit("block:"), F.coalesce(t, F.lit("unknown"))))
    of_blocks = condensed_blocks(blocks, most).join(names, ["session_id", "tool_use_id"], "left").withColumn("kind", own)
    of_texts = _plain(entries, most).withColumn("kind", F.lit("user:text"))
    others = condensed_payloads(entries, most).withColumn("kind", F.concat(F.lit("other:"), t))
    numbers = ["session_id", "kind", "stubbed", "orig", "inlined"]
    rows = of_blocks.select(numbers).unionByName(of_texts.select(numbers)).unionByName(others.select(numbers))
    sums = [F.count(F.lit(1)).alias("count"), F.sum("orig").alias("orig_bytes"), F.sum("inlined").alias("inlined_bytes"), F.count_if("stubbed").alias("truncated")]
    return rows.groupingSets([["session_id", "kind"], ["session_id"]], "session_id", "kind").agg(*sums)


def kilobytes(n: Column) -> Column:
    """A size in KB: 0, one decimal below 10, else rounded."""
    k = n / 1024
    return F.when(n == 0, "0").when(k < 10, F.format_string("%.1f", k.cast("double"))).otherwise(F.floor(k + 0.5).cast("string"))


def stats_report(stats: DataFrame, title: str = "Condensation report") -> DataFrame:
    """C11: a table a session, largest kind first, its columns padded to their widest cell."""
    heads = ("Kind", "count", "orig KB", "inlined KB", "truncated")
    cells = F.array(F.coalesce("kind", F.lit("TOTAL")), F.col("count").cast("string"), kilobytes(F.col("orig_bytes")), kilobytes(F.col("inlined_bytes")), F.concat_ws("/", F.col("truncated").cast("string"), F.col("count").cast("string")))
    order = F.struct(F.col("kind").isNull().alias("total"), (-F.col("orig_bytes")).alias("size"), F.coalesce("kind", F.lit("")).alias("kind"))
    rows = stats.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), cells.alias("cells")))), lambda x: x["cells"]).alias("rows"))  # a row a kind
    widths = [F.greatest(F.lit(len(h)), F.array_max(F.transform("rows", lambda r: F.length(r[i])))) for i, h in enumerate(heads)]  # noqa: B023
    rows = rows.withColumn("widths", F.array(*widths))
    pad = lambda cell, i: F.rpad(cell, F.col("widths")[i], F.lit(" ")) if i == 0 else F.lpad(cell, F.col("widths")[i], F.lit(" "))
    line = lambda cells: F.concat_ws("  ", *[pad(cells[i], i) for i in range(len(heads))])
    rule = F.concat_ws("  ", F.transform("widths", lambda w: F.repeat(F.lit("─"), w)))
    body = F.transform("rows", line)
    n = F.size("rows")
    parts = F.concat(F.array(F.lit(title), line([F.lit(h) for h in heads]), rule), F.slice(body, F.lit(1), n - 1), F.array(rule), F.slice(body, n, F.lit(1)), F.array(F.lit("")))
    return rows.select("session_id", F.array_join(parts, "\n").alias("report"))


def truncated_ix(condensed: DataFrame) -> DataFrame:
    """Entries whose condensed content holds a stub."""
    return condensed.filter("stubbed" if "stubbed" in condensed.columns else "stub IS NOT NULL").select("session_id", "ix")


def full_turns(entries: DataFrame, truncated: DataFrame) -> DataFrame:
    """Whole entries behind the stubs."""
    return entries.join(truncated, ["session_id", "ix"], "left_semi")


def spill_sources(spills: DataFrame, listing: DataFrame, parents: DataFrame) -> DataFrame:
    """Each spill file of a session and its subagents once, copied if the listing has it. parents: session_id, root."""
    own = spills.join(parents, "session_id", "left").select(F.coalesce("root", "session_id").alias("session_id"), "path").dropDuplicates(["session_id", "path"])
    return own.join(listing.select("path").distinct().withColumn("copied", F.lit(True)), "path", "left").select("session_id", "path", F.coalesce("copied", F.lit(False)).alias("copied"))


def preview(value: Column, most: int) -> Column:
    """C17: a string as it is, an object with sorted keys; cut to `most` characters."""
    text = F.coalesce(F.to_json(F.try_parse_json(value)), value, F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" …[truncated]"))).otherwise(text)


def stage_summary(condensed: DataFrame, sources: DataFrame, subagents: DataFrame, stats: DataFrame) -> DataFrame:
    """Per session: the places of its cut entries in order, spills that were copied, subagents, and what condensing left in all.

    sources: spill_sources(), each file of a session and its subagents once; those
    that weren't there don't count. stats: condense_stats().
    """
    out = condensed.groupBy("session_id").agg(F.array_sort(F.collect_list(F.when(F.col("stubbed"), F.col("ix")))).alias("truncated"))
    for rows, name in ((sources.filter("copied"), "spills"), (subagents, "subagents")):
        out = out.join(rows.groupBy("session_id").agg(F.count(F.lit(1)).alias(name)), "session_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    whole = stats.filter("kind IS NULL").select("session_id", F.col("count").alias("parts"), "orig_bytes", "inlined_bytes", F.col("truncated").alias("stubbed_parts"))
    return out.join(whole, "session_id", "left")


def parent_ix(entries: DataFrame) -> DataFrame:
    """Where an entry's parent stands; of equal uuids the last counts."""
    at = entries.filter("uuid IS NOT NULL").groupBy("session_id", F.col("uuid").alias("parent_uuid")).agg(F.max("ix").alias("parent_ix"))
    return entries.select("session_id", "ix", "parent_uuid").join(at, ["session_id", "parent_uuid"], "left").select("session_id", "ix", "parent_ix")
