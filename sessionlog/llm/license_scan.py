r"""License scans: phrases, and an exact set-similarity join with templates.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. The
base labels come from phrases whose words stand consecutively. The method then
finds every text block that holds at least CONTAINMENT of a template's distinct
words: a line, a sentence of one, or a sentence that goes on over line ends and
comment marks. It ends at a blank line, one without words. Template words are ordered by their
frequency in the whole corpus, rarest first. A block that meets the threshold
must hold one of a template's rarest words (its prefix): those select the
documents and are the join key. Blocks too short to meet it, or whose remaining
words after the matched position are too few, fall before the sets are compared.

Only DataFrame functions are used. Template words, a fixed set, are all that is
broadcast or collected.

Defined cases: a null text is empty: no words, no labels, score 0; repeated rows
are scanned each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "licensed under the creative commons attribution 4 0 international license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-release": "released under the mit license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
}
CONTAINMENT = 0.8

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Lines, and within them sentences.
_BLOCK_END = r"[\n\r]+|(?<=[.!?])[ \t]+"
_LINE_END = r"(?>\r\n|\n|\r)"
#: Blank lines, and between them sentences, whatever lines they take.
_WRAPPED_END = _LINE_END + r"[\x00-\x09\x0B\x0C\x0E-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + _LINE_END + r"|(?<=[.!?])[ \t\n\r]+"


def _standing(*phrases: str) -> str:
    """A pattern of the phrases as whole words, in either case of ASCII letters."""
    return rf"(?i)(?<!{_WORD})(?:" + "|".join((_SEPARATOR + "+").join(p.split()) for p in phrases) + rf")(?!{_WORD})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_order(held: DataFrame, known: list[str]) -> dict[str, int]:
    """Each template word's place in the global order, rarest first. held: known, a document's template words."""
    counts = {r["word"]: r["count"] for r in held.select(F.explode("known").alias("word")).groupBy("word").count().collect()}  # a row per template word at most
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """A row per document, and every matching block: (row, template, block, matched, score)."""
    spark = docs.sparkSession
    sets = {name: sorted(set(t.split())) for name, t in templates.items()}
    needs = {name: math.ceil(containment * len(t) - 1e-9) for name, t in sets.items()}
    known = sorted({w for t in [*sets.values(), *(p.split() for p in phrases)] for w in t})
    literal = lambda words: F.array(*map(F.lit, words))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    split = texts.withColumn("words", F.split(_lower(F.col("text")), _SEPARATOR + "+"))
    # Separators at the ends leave an empty word there.
    ends = F.when(F.element_at("words", 1) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    split = split.select("doc_id", "text", (F.size("words") - ends).cast("long").alias("n_words"), F.array_intersect("words", literal(known)).alias("known"))
    body, base = F.col("text"), _standing(*phrases)
    holds = lambda words, least: F.size(F.array_intersect("known", literal(words))) >= least
    either = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    n_base = F.when(either(holds(sorted(set(p.split())), len(set(p.split()))) for p in phrases), _count(body, base)).otherwise(0).cast("long")
    wrapped = F.filter(F.split(body, _WRAPPED_END), lambda x: F.regexp_like(x, F.lit(r"[\n\r]")))
    blocks = F.when(either(holds(t, needs[name]) for name, t in sets.items()), F.concat(F.split(body, _BLOCK_END), wrapped))
    split = split.withColumn("n_base", n_base)
    hit = F.col("n_base") > 0
    first = F.when(hit, _count(F.regexp_extract(body, r"(?s)^(.*?)" + base, 1), _WORD + "+"))
    last = F.when(hit, _count(F.regexp_extract(body, r"(?s)^(.*)" + base, 1), _WORD + "+"))
    labels = F.array_compact(F.array(*[F.when(hit & F.regexp_like(body, F.lit(_standing(p))), F.lit(x)) for p, x in phrases.items()]))
    scanned = cut(split.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "n_base", first.alias("first_word"), last.alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"), "known", blocks.alias("blocks")))

    place = word_order(scanned, known)
    rows = []
    for name, t in sets.items():
        words = sorted(t, key=place.get)
        rows += [(w, name, i, needs[name], words) for i, w in enumerate(words[: len(words) - needs[name] + 1])]
    prefix_table = spark.createDataFrame(rows, "key string, template string, position int, need int, words array<string>")
    held = scanned.filter("blocks IS NOT NULL").select("row", F.posexplode("blocks").alias("block", "line"))
    held = held.withColumn("words", F.array_distinct(F.split(_lower(F.col("line")), _SEPARATOR + "+")))
    # The block's template words, in global order.
    order = F.create_map(*[x for w, i in place.items() for x in (F.lit(w), F.lit(i))])
    own = F.array_intersect("words", literal(known))
    held = held.select("row", "block", F.size("words").alias("n"), own.alias("known")).filter(F.size("known") >= min(needs.values(), default=1))
    held = held.withColumn("known", F.transform(F.array_sort(F.transform("known", lambda w: F.struct(order[w].alias("i"), w.alias("w")))), lambda s: s["w"]))
    keys = held.select("row", "block", "n", "known", F.posexplode("known").alias("at", "key")).join(F.broadcast(prefix_table), "key")
    keys = keys.filter((F.col("n") >= F.col("need")) & (F.size("known") - F.col("at") >= F.col("need")) & (F.size("words") - F.col("position") >= F.col("need")))
    matches = keys.withColumn("matched", F.size(F.array_intersect("known", "words"))).filter("matched >= need")
    matches = matches.groupBy("row", "template", "block").agg(F.max("matched").alias("matched"), F.max(F.col("matched") / F.size("words")).alias("score"))
    return scanned.drop("blocks", "known"), matches


def op8(docs: DataFrame) -> DataFrame:
    """op8's contract over a documents table."""
    scanned, matches = scan(docs)
    own = matches.groupBy("row").agg(F.collect_set("template").alias("own"), F.max("score").alias("best"))  # as many as templates
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", nothing)))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return scanned.join(own, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
