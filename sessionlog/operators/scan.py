"""Scans of text for secrets and personal data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.functions.matching import Finder

#: name, severity, pattern, and a text that every match holds: each pattern stands within a line.
CHECKS = (
    ("email", "warn", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    ("api-key", "fail", r"\bsk-[A-Za-z0-9]{16,}\b", "sk-"),
    ("cloud-key", "fail", r"\bAKIA[0-9A-Z]{16}\b", "AKIA"),
    ("ip-address", "warn", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "."),
)
MAX_BYTES = 2 * 1024 * 1024
LINE_CHARS = 140
PER_CHECK = 25


def scannable(texts: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """O3: texts that aren't too large, binary or skipped by location."""
    fine = (F.octet_length("text") <= MAX_BYTES) & ~F.contains(F.substring("text", 1, 8192), F.lit("\0"))
    return texts.filter(fine & ~F.col("location").isin(*skip) if skip else fine)


def distinct_contents(texts: DataFrame) -> DataFrame:
    """Each content once, with how many places hold it and the first of them; only digests are shuffled."""
    return texts.groupBy(F.sha2("text", 256).alias("content_id")).agg(F.count(F.lit(1)).alias("places"), F.min("location").alias("location"))


def scan(texts: DataFrame, checks: tuple = CHECKS) -> DataFrame:
    """O1: an issue for each match: location, 1-based line, check, severity, match and the line, trimmed and cut.

    One pass: a text is split only if it holds a match, a line is searched by all
    checks at once; patterns are tried only where the text that they need stands.
    """
    hits = reduce(lambda a, b: a | b, [F.contains("text", F.lit(needs)) & F.rlike("text", F.lit(p)) for _, _, p, needs in checks])
    lines = texts.filter(hits).select("location", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    matches = lambda p, needs: F.when(F.contains("line", F.lit(needs)), F.regexp_extract_all("line", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), matches(p, needs).alias("matches")) for name, severity, p, needs in checks])
    each = lines.select("location", (F.col("n") + 1).alias("line_no"), "line", F.explode(F.filter(found, lambda x: F.size(x["matches"]) > 0)).alias("f"))
    return each.select("location", "line_no", "f.check_name", "f.severity", F.explode("f.matches").alias("match"), F.substring(F.trim("line"), 1, LINE_CHARS).alias("line"))


def content_issues(texts: DataFrame, checks: tuple = CHECKS) -> DataFrame:
    """O1 over O4: the issues of each content once, at the first of its places: content_id, places, and the columns of scan().

    Texts are scanned where they lie; what is shuffled is digests, places and issues,
    whatever the texts' length. A place that is listed twice with one text gives its
    issues twice; a null text has none.
    """
    content = F.sha2("text", 256).alias("content_id")
    issues = scan(texts.select(F.struct(content, "location").alias("location"), "text"), checks)
    issues = issues.select("location.content_id", "location.location", *issues.columns[1:])
    return issues.join(distinct_contents(texts), ["content_id", "location"]).select("content_id", "places", *issues.columns[1:])


SESSION_ID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Fixed value: shorter names are too common to look for.
TOKEN_CHARS = 10


def known_tokens(texts: DataFrame, tokens: DataFrame, least: int = TOKEN_CHARS) -> DataFrame:
    """O2: whole tokens of at least `least` characters that a list (column token) names, by an equality join."""
    long = lambda c: F.length(c) >= least
    each = texts.select("location", F.explode(F.filter(F.array_distinct(F.split("text", r"[^a-zA-Z0-9-]+")), long)).alias("token"))
    return each.join(tokens.select("token").distinct(), "token")


def known_sessions(texts: DataFrame, sessions: DataFrame, pattern: str = SESSION_ID) -> DataFrame:
    """O2: session ids (column session_id) of a known shape wherever they stand in a text, by an equality join."""
    each = texts.select("location", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?={'(' + pattern + ')'})"), F.lit(1)))).alias("session_id"))
    return each.join(sessions.select("session_id").distinct(), "session_id")


#: Most bytes of ids that one scan looks for; a longer list is dealt to several scans.
LIST_BYTES = 64 << 20


def known_ids(texts: DataFrame, ids: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """O2: ids (column id) of any shape wherever they stand in a text: location, id, places. Overlapping ids and places count; empty ids stand nowhere.

    One scan of the texts for every list_bytes of ids: a scan's ids, whose size is so bounded, go to all tasks.
    """
    spark, own = texts.sparkSession, ids.select("id").filter("id <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("id").cast("long"))).first()[0] or 0
    parts = -(-size // list_bytes)
    found = None
    for part in range(parts):
        listed = [r["id"].encode() for r in own.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toLocalIterator()]
        finder = spark.sparkContext.broadcast(Finder(listed))

        def look(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            f = finder.value
            for batch in batches:
                rows = [(where, f.strings[i].decode(), n) for where, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text for i, n in f.counts(text.encode()).items()]
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["location", "id", "places"])

        hits = texts.select(F.col("location").cast("string"), F.col("text").cast("string")).mapInArrow(look, "location string, id string, places long")
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "location string, id string, places long") if found is None else found


def report(issues: DataFrame, most: int = PER_CHECK) -> DataFrame:
    """The first issues of each check, each once."""
    order = Window.partitionBy("severity", "check_name").orderBy("location", "line_no", "match")
    return issues.select("severity", "check_name", "location", "line_no", "match").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)


def totals(issues: DataFrame) -> DataFrame:
    """Distinct issues by severity and check."""
    return issues.select("severity", "check_name", "location", "line_no", "match").distinct().groupBy("severity", "check_name").agg(F.count(F.lit(1)).alias("issues"))
