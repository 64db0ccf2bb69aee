"""Rounds: everything from one human message up to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.functions.oneliners import one_liner, parsed_input, result_text
from sessionlog.functions.text import est_tokens, trim_all, wrapper_only

from .analyze import tool_result_index


def human_texts(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """B1: what a person wrote in an entry; null for entries with tool results or without text."""
    parts = blocks.groupBy("session_id", "ix").agg(
        F.bool_or(F.col("type") == "tool_result").alias("answers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("block_ix", "text")))), lambda x: x["text"]), "\n").alias("joined"),
        F.count_if((F.col("type") == "text") & F.col("text").isNotNull()).alias("texts"),
    )
    users = entries.filter("type = 'user'").select("session_id", "ix", "content_text")
    text = F.coalesce("content_text", F.when(~F.col("answers") & (F.col("texts") > 0), F.col("joined")))
    return users.join(parts, ["session_id", "ix"], "left").select("session_id", "ix", text.alias("text"))


def rounds(entries: DataFrame, humans: DataFrame) -> DataFrame:
    """Each entry with the number of its round; entries before the first are left out. One window by session."""
    session = Window.partitionBy("session_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    marked = entries.join(humans.filter("text IS NOT NULL").withColumnRenamed("text", "human"), ["session_id", "ix"], "left")
    return marked.withColumn("round", F.sum(F.when(F.col("human").isNotNull(), 1).otherwise(0)).over(session).cast("int")).filter("round > 0")


def round_table(rounds_: DataFrame) -> DataFrame:
    """A row a round: where it opens, its text, its branch, and whether wrappers are all it has."""
    branch = F.when((F.col("git_branch") != "") & F.col("git_branch").isNotNull(), F.col("ix"))
    found = rounds_.groupBy("session_id", "round").agg(F.min("ix").alias("user_ix"), F.min_by("human", F.when(F.col("human").isNotNull(), F.col("ix"))).alias("human"), F.min_by("git_branch", branch).alias("branch"), F.count(F.lit(1)).alias("entries"))
    return found.withColumn("wrapper", wrapper_only(F.col("human")))


def rendered_rounds(found: DataFrame) -> DataFrame:
    """Rounds with words of a person, numbered anew, marked where the branch changes."""
    session = Window.partitionBy("session_id").orderBy("user_ix")
    shown = found.filter("NOT wrapper").withColumn("n", F.row_number().over(session))
    before = F.last("branch", ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, -1))
    return shown.withColumn("branch_change", F.when(F.col("branch").isNotNull() & ~F.col("branch").eqNullSafe(before), F.col("branch")))


def round_stream(rounds_: DataFrame, blocks: DataFrame) -> DataFrame:
    """Texts and one-line calls of each round in order, with stretches of calls numbered."""
    results = tool_result_index(blocks).withColumnRenamed("tool_use_id", "tool_id")
    lines = blocks.filter("type IN ('text', 'tool_use')").join(rounds_.filter("type = 'assistant'").select("session_id", "ix", "round"), ["session_id", "ix"])
    lines = lines.drop("content", "content_kind", "is_error").join(results, ["session_id", "tool_id"], "left").withColumn("answer", result_text(F.col("content"), F.col("content_kind")))
    lines = lines.withColumn("given", F.explode(F.array(parsed_input("input"))))
    line = F.when(F.col("type") == "text", trim_all(F.col("text"))).otherwise(one_liner(F.col("tool_name"), F.col("given"), F.col("answer"), F.coalesce("is_error", F.lit(False))))
    # An array of one, exploded: filters on the line stay above it and don't build the line anew.
    out = lines.select("session_id", "round", "ix", "block_ix", F.when(F.col("type") == "text", "text").otherwise("tool").alias("kind"), F.explode(F.array(line)).alias("line")).filter("line <> ''")
    order = Window.partitionBy("session_id", "round").orderBy("ix", "block_ix").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("stretch", F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(order))


def tool_groups(stream: DataFrame) -> DataFrame:
    """Each stretch of calls between texts, with its places and its lines in order (ix, block_ix, line)."""
    lines = F.array_sort(F.collect_list(F.struct("ix", "block_ix", "line")))
    return stream.filter("kind = 'tool'").groupBy("session_id", "round", "stretch").agg(F.min("ix").alias("from_ix"), F.max("ix").alias("to_ix"), lines.alias("lines"))


def brief(entries: DataFrame, blocks: DataFrame, humans: DataFrame, markdown: bool = False) -> DataFrame:
    """A session's rounds as tagged text or Markdown, one row a round: session_id, n, text; whole_brief() joins them."""
    rounds_ = rounds(entries, humans)
    shown, stream = rendered_rounds(round_table(rounds_)), round_stream(rounds_, blocks)
    text = lambda c: F.col(c).cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    span = F.when(F.col("from_ix") == F.col("to_ix"), text("from_ix")).otherwise(F.concat_ws("-", text("from_ix"), text("to_ix")))
    calls = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- ["), x["ix"].cast("string"), F.lit("] "), x["line"])), "\n")
    group = put("**Tools** `[ix ", span, "]`\n", calls, "\n") if markdown else put('<tools idx="', span, '">\n', calls, "\n</tools>")
    said = put("**Assistant** `[ix ", text("ix"), "]`\n\n", F.col("line"), "\n") if markdown else put('<assistant idx="', text("ix"), '">\n', F.col("line"), "\n</assistant>")
    # A stretch is numbered by the texts before it, so it follows the text of its own number.
    tools = tool_groups(stream).select("session_id", "round", "stretch", F.lit(1).alias("after"), group.alias("part"))
    texts = stream.filter("kind = 'text'").select("session_id", "round", "stretch", F.lit(0).alias("after"), said.alias("part"))
    parts = tools.unionByName(texts).groupBy("session_id", "round").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "after", "part"))), lambda x: x["part"]), "\n").alias("body"))
    human, branch = trim_all(F.col("human")), F.col("branch_change")
    if markdown:
        head = put("## Round ", text("n"), "\n\n**User** `[ix ", text("user_ix"), "]`\n\n> ", F.replace(human, F.lit("\n"), F.lit("\n> ")), "\n")
        whole = F.concat(F.concat_ws("\n", head, put("*on `", branch, "`*\n"), "body"), F.lit("\n"))
    else:
        head = put('<round n="', text("n"), '">\n<user idx="', text("user_ix"), '">\n', human, "\n</user>")
        whole = F.concat(F.concat_ws("\n", head, put('<git branch="', branch, '"/>'), "body", F.lit("</round>")), F.lit("\n"))
    return shown.join(parts, ["session_id", "round"], "left").select("session_id", "n", whole.alias("text"))


def whole_brief(texts: DataFrame, stats: DataFrame, markdown: bool = False) -> DataFrame:
    """A session's brief in one text, with a head: the last step, as one long session is one long cell. stats: those of brief_stats(), with source."""
    body = texts.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("body"))
    text = lambda c: F.col(c).cast("string")
    if markdown:
        head = F.concat(F.lit("# Session brief\n\n**Source:** `"), "source", F.lit("`\n**Rounds:** "), text("rounds"), F.lit("  •  **Assistant text:** ~"), text("text_tokens"), F.lit(" tok  •  **Tool uses:** "), text("tool_uses"), F.lit("\n\n---\n"))
    else:
        head = F.concat(F.lit('<session source="'), "source", F.lit('" rounds="'), text("rounds"), F.lit('" assistant_text_tokens="'), text("text_tokens"), F.lit('" tool_uses="'), text("tool_uses"), F.lit('">\n'))
    return stats.join(body, "session_id", "left").select("session_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("" if markdown else "</session>\n")).alias("text"))


def brief_stats(entries: DataFrame, blocks: DataFrame, humans: DataFrame) -> DataFrame:
    """Rounds shown and in all, calls, tokens of the assistant's texts, entries."""
    table = round_table(rounds(entries, humans)).groupBy("session_id").agg(F.count_if(~F.col("wrapper")).alias("rounds"), F.count(F.lit(1)).alias("raw_rounds"))
    own = blocks.groupBy("session_id").agg(F.count_if(F.col("type") == "tool_use").alias("tool_uses"), F.coalesce(F.sum(F.when(F.col("type") == "text", est_tokens(F.length("text")))), F.lit(0)).alias("text_tokens"))
    total = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("entry_count"))
    return total.join(table, "session_id", "left").join(own, "session_id", "left").select("session_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rounds", "raw_rounds", "tool_uses", "text_tokens", "entry_count")])
