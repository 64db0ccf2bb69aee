"""Audit of filters that overlap: what each one removes, in every order of applying them.

1. One scan computes the conditions that a document's own text decides (A to D).
2. E is an existential self-join: a left-semi join on the text's hash, the exact
   text and a smaller doc_id. Only texts whose hash stands in several documents
   take part. Its right side is aggregated to one row a text, each with its
   smallest doc_id; a hash of many documents is salted, and its right row is
   repeated once a salt, so a group of copies is spread over many tasks.
3. The ids of E are put under the failures of the other filters and summed to one
   bit mask a document; masks are counted by part, quality and toxicity.
4. All 120 orders are evaluated on those counts (at most 32 masks a part), not on
   documents.

Everything is DataFrame functions; nothing is collected.

Defined cases: a null text is empty, so A holds and B to D don't; an empty table
gives no rows; documents with a null doc_id have no label and take part in A to D,
but a comparison with null is never true, so they neither fail E nor make others
fail it; rows of equal doc_id and text don't make each other fail E; a repeated row
counts as often as it stands there; null and empty lang are one part; a doc_id
with several labels has the largest of each; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents of one hash that meet in a task before the hash is salted.
SALT_ROWS = 10_000


def own_failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the conditions A to D of a text that isn't null."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    held = (
        n < 200,
        F.size(F.array_distinct(words)) * 100 < n * 50,
        upper.cast("long") * 100 > F.length(text).cast("long") * 3,
        text.rlike(r"[#$%&*|]"),
    )
    bits = F.lit(0)
    for i, fails in enumerate(held):
        bits = bits + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def repeats(docs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """docs: doc_id long, part, hash, text. The (doc_id, part, hash) rows whose exact text stands at a smaller doc_id."""
    ids = docs.filter("doc_id IS NOT NULL")
    shared = ids.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = shared.filter("least < most").select("hash", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    held = ids.join(shared, "hash")
    first = held.groupBy("hash", "text").agg(F.min("doc_id").alias("first_id"), F.max("salts").alias("salts"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("hash", "text", "salt", "first_id")
    asked = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("l")
    same = F.expr("l.hash = r.hash AND l.salt = r.salt AND l.text = r.text AND r.first_id < l.doc_id")
    return asked.join(first.alias("r"), same, "left_semi").select("doc_id", "part", "hash")


def failure_counts(docs: DataFrame, labels: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(part, bits, n, good, toxic): documents by what they fail, with how many are labelled good and toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("hash"), text.alias("text"))
    own = rows.select("doc_id", "part", "hash", own_failures(F.col("text")).alias("bits"))
    marks = own.filter("doc_id IS NOT NULL").select("*", F.lit(0).alias("e"), F.lit(1).alias("n"))
    marks = marks.unionByName(repeats(rows, salt_rows).select("*", F.lit(0).alias("bits"), F.lit(16).alias("e"), F.lit(0).alias("n")))
    # Rows of one doc_id, text and part fail alike.
    each = marks.repartition("doc_id").groupBy("doc_id", "hash", "part").agg((F.max("bits") + F.max("e")).alias("bits"), F.sum("n").alias("n"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic"))
    )
    each = each.join(known, "doc_id", "left").select("part", "bits", "n", "quality", "toxic")
    nameless = own.filter("doc_id IS NULL").select("part", "bits", F.lit(1).cast("long").alias("n"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    labelled = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return each.unionByName(nameless).groupBy("part", "bits").agg(F.sum("n").alias("n"), labelled("quality").alias("good"), labelled("toxic").alias("toxic"))


def orders(filters: str = FILTERS) -> list[dict]:
    """Each step of each order: its filter's bit and the mask of the filters before it."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [
        {"filter_order": "".join(p), "step": i + 1, "own": bit[p[i]], "before": sum(bit[f] for f in p[:i])}
        for p in itertools.permutations(filters)
        for i in range(len(filters))
    ]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step, from the counts of failure_counts()."""
    steps = orders(filters)
    n_orders = len(steps) // len(filters)
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("masks"))  # at most 2 ** len(filters) a part
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = masks.withColumn("s", F.explode(plan)).select("part", "s.*", "masks")

    def total(field: str, holds) -> Column:  # noqa: ANN001
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m["bits"]), m[field]).otherwise(F.lit(0).cast("long")))

    own, before = F.col("own"), F.col("before")
    fails, seen = lambda b: b.bitwiseAND(own) != 0, lambda b: b.bitwiseAND(before) != 0
    here = lambda b: fails(b) & ~seen(b)
    # Of a document's m failures each comes first in one m-th of the orders.
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m["bits"]), m["n"] * F.floor(F.lit(n_orders) / F.bit_count(m["bits"]))).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda b: b.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda b: fails(b) & seen(b)).alias("redundant"),
        total("n", lambda b: b == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op13's contract over a documents and a labels table."""
    return audit(failure_counts(docs, labels))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
first AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
b AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first_id < doc_id THEN 16 ELSE 0 END) AS bits
  FROM w JOIN first USING (text)),
l AS (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT b.*, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS bad FROM b LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k)
  JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
m AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, bits),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
