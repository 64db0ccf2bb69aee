"""Summaries of sessions: checks, a placeholder, and the merged artifact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.text import trim_all

#: The parts of a narrative, and the words some fields may hold.
REQUIRED = ("summary", "main_tasks", "episodes", "decisions", "corrections", "verification", "friction_points", "wins", "unresolved")
SECTIONS = ("main_tasks", "episodes", "decisions", "corrections", "friction_points", "wins", "unresolved")
CHOICES = {
    ("main_tasks", "status"): ("completed", "partial", "abandoned", "verified"),
    ("episodes", "kind"): ("research", "planning", "implementation", "debugging", "review", "housekeeping", "other"),
    ("corrections", "kind"): ("self_correction", "user_correction", "subagent_error"),
}
#: The texts that each item of a section has.
TEXTS = {"title": ("main_tasks", "episodes"), "description": ("main_tasks", "decisions", "corrections", "friction_points", "wins", "unresolved"), "summary": ("episodes",), "rationale": ("decisions",)}
_NUMBER = "^(BIGINT|DECIMAL|DOUBLE)"


def _of(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _is(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def _place(value: Column) -> Column:
    """Whether a JSON value is a whole number that an entry of the session has."""
    n = F.try_variant_get(value, "$", "double")
    return F.coalesce(_is(value, _NUMBER) & (n == F.floor(n)) & (n >= 0) & (n < F.col("turn_count")), F.lit(False))


def _shown(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("undefined"))


def _ref_faults(value: Column, path: Column) -> Column:
    """Faults of a list of places, an array of strings."""
    refs = F.try_variant_get(value, "$.refs", "array<variant>")
    each = F.transform(refs, lambda x, i: F.when(~_place(x), F.concat(path, F.lit(".refs["), i.cast("string"), F.lit("] is not a valid ref (got "), _shown(x), F.lit(")"))))
    return F.when(_is(_of(value, "refs"), "^ARRAY"), F.array_compact(each)).otherwise(F.array(F.concat(path, F.lit(".refs must be an array of ix values"))))


def _item_faults(section: Column, item: Column, path: Column) -> Column:
    """Faults of one item of a section, an array of strings."""
    found = [F.when(section.isin(*sections) & ~_is(_of(item, name), "^STRING"), F.concat(path, F.lit(f".{name} must be a string"))) for name, sections in TEXTS.items()]
    for (own, name), choices in CHOICES.items():
        said = F.coalesce(_of(item, name, "string"), F.lit("undefined"))
        found.append(F.when((section == own) & ~said.isin(*choices), F.concat(path, F.lit(f".{name} must be one of {', '.join(choices)} (got \""), said, F.lit('")'))))
    by = _of(item, "attribution")
    found.append(F.when((section == "friction_points") & by.isNotNull() & ~_is(by, "^STRING"), F.concat(path, F.lit(".attribution must be a string when present"))))
    span = F.try_variant_get(item, "$.ix_range", "array<variant>")
    pair = _is(_of(item, "ix_range"), "^ARRAY") & (F.size(span) == 2)
    episode, ends = section == "episodes", [F.get(span, F.lit(i)) for i in (0, 1)]
    found.append(F.when(episode & ~F.coalesce(pair, F.lit(False)), F.concat(path, F.lit(".ix_range must be [start, end]"))))
    found += [F.when(episode & pair & ~_place(x), F.concat(path, F.lit(f".ix_range[{i}]="), _shown(x), F.lit(" is not a valid ix"))) for i, x in enumerate(ends)]
    inverted = _is(ends[0], _NUMBER) & _is(ends[1], _NUMBER) & (F.try_variant_get(ends[0], "$", "double") > F.try_variant_get(ends[1], "$", "double"))
    found.append(F.when(episode & pair & inverted, F.concat(path, F.lit(".ix_range is inverted: ["), _shown(ends[0]), F.lit(", "), _shown(ends[1]), F.lit("]"))))
    return F.concat(F.array_compact(F.array(*found)), _ref_faults(item, path))


def lint(narratives: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each fault: session_id, error. narratives: session_id, narrative (JSON); turns: session_id, turn_count.

    A narrative that isn't JSON, isn't an object or lacks a part is reported for that
    alone. One pass: sections are exploded together.
    """
    rows = narratives.join(turns, "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0))).withColumn("parsed", F.try_parse_json("narrative"))
    v = F.col("parsed")
    root = F.when(v.isNull(), "narrative is not valid JSON").when(~_is(v, "^OBJECT"), "narrative root is not an object")
    lacking = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(F.json_object_keys("narrative"), F.array().cast("array<string>"))), lambda k: F.concat(F.lit("narrative missing required field: "), k))
    rows = rows.withColumn("early", F.when(root.isNotNull(), F.array(root)).otherwise(lacking))
    whole = rows.filter(F.size("early") == 0)
    check = _of(v, "verification")
    blank = ~_is(_of(v, "summary"), "^STRING") | (trim_all(F.coalesce(_of(v, "summary", "string"), F.lit(""))) == "")
    single = F.array_compact(
        F.array(
            F.when(blank, "narrative.summary must be a non-empty string"),
            F.when(~_is(check, "^(OBJECT|ARRAY)"), "verification must be an object"),
            F.when(_is(check, "^(OBJECT|ARRAY)") & ~_is(_of(v, "verification.was_verified"), "^BOOLEAN"), "verification.was_verified must be a boolean"),
            F.when(_is(check, "^(OBJECT|ARRAY)") & ~_is(_of(v, "verification.how"), "^STRING"), "verification.how must be a string"),
            *[F.when(~_is(_of(v, s), "^ARRAY"), f"{s} must be an array") for s in SECTIONS],
        )
    )
    single = F.concat(single, F.when(_is(check, "^(OBJECT|ARRAY)"), _ref_faults(check, F.lit("verification"))).otherwise(F.array().cast("array<string>")))
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.try_variant_get(v, f"$.{s}", "array<variant>").alias("items")) for s in SECTIONS])
    items = whole.select("session_id", "turn_count", F.explode(sections).alias("s")).select("session_id", "turn_count", "s.section", F.posexplode("s.items").alias("n", "item"))
    path = F.concat("section", F.lit("["), F.col("n").cast("string"), F.lit("]"))
    of_item = F.when(~_is(F.col("item"), "^(OBJECT|ARRAY)"), F.array(F.concat(path, F.lit(" must be an object")))).otherwise(_item_faults(F.col("section"), F.col("item"), path))
    faults = [rows.select("session_id", F.explode("early").alias("error")), whole.select("session_id", F.explode(single).alias("error")), items.select("session_id", F.explode(of_item).alias("error"))]
    return reduce(DataFrame.unionByName, faults)


def placeholder(turns: DataFrame) -> DataFrame:
    """A narrative that stands in for a written one."""
    last = F.greatest(F.col("turn_count") - 1, F.lit(0)).cast("string")
    text = F.concat(
        F.lit('{"summary":"Session of '), F.col("turn_count").cast("string"), F.lit(' entries.","main_tasks":[{"title":"session","status":"partial","description":"","refs":[0]}],"episodes":[{"title":"all","kind":"other","ix_range":[0,'), last,
        F.lit('],"summary":"","refs":[0]}],"decisions":[],"corrections":[],"verification":{"was_verified":false,"how":"","refs":[]},"friction_points":[],"wins":[],"unresolved":[]}'),
    )
    return turns.select("session_id", text.alias("narrative"))


def artifacts(metadata: DataFrame, analysis: DataFrame, narratives: DataFrame, generated_at: str) -> DataFrame:
    """Metadata, analysis and narrative of each session in one row."""
    nest = lambda rows, name: rows.select("session_id", F.struct(*[c for c in rows.columns if c != "session_id"]).alias(name))
    out = nest(metadata, "metadata").join(nest(analysis, "deterministic"), "session_id").join(narratives.select("session_id", "narrative"), "session_id")
    return out.select(F.lit("1").alias("schema_version"), "session_id", F.lit(generated_at).alias("generated_at"), "metadata", "deterministic", "narrative")
