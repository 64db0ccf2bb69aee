"""From session logs to artifacts: condense, analyse, check the narratives, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.operators import analyze, condense, metadata, narrative


def condensed_report(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """What condensing leaves of each session: entries with stubs, bytes before and after."""
    sums = condense.condense_stats(entries, blocks).filter("kind IS NULL").select("session_id", F.col("truncated").alias("stubbed_parts"), "orig_bytes", "inlined_bytes")
    cut = condense.truncated_ix(condense.condensed_entries(entries, blocks)).groupBy("session_id").agg(F.count(F.lit(1)).alias("stubbed_entries"))
    return sums.join(cut, "session_id", "left").withColumn("stubbed_entries", F.coalesce("stubbed_entries", F.lit(0)))


def distill(entries: DataFrame, blocks: DataFrame, generated_at: str, narratives: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts of the sessions whose narrative passes, and the faults of the others.

    Logs with their raw lines are condensed too; their artifacts say what that leaves.
    """
    turns = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"))
    narratives = narrative.placeholder(turns) if narratives is None else narratives
    faults = narrative.lint(narratives, turns)
    sound = narratives.join(faults.select("session_id").distinct(), "session_id", "left_anti")
    made = narrative.artifacts(metadata.metadata(entries, blocks), analyze.analyze(entries, blocks), sound, generated_at)
    if {"raw", "content_text"} <= set(entries.columns) and "block" in blocks.columns:
        report = condensed_report(entries, blocks)
        made = made.join(report.select("session_id", F.struct(*[c for c in report.columns if c != "session_id"]).alias("condensed")), "session_id", "left")
    return made, faults
