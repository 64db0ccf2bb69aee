r"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all document rates r in [0, 2] that
meet it, the mix takes those closest to one copy each in relative entropy; their
dual is convex in one multiplier per source, and r = min(2, exp(lambda * size /
scale)): an exponential tilt by size. The multipliers of all sources are found
together by safeguarded Newton steps, each one distributed aggregate over the
(source, size) histogram, whose sums are integers, so that reruns agree to the
last bit. Rates are rounded to whole copies by systematic sampling along size;
one document per source then takes part of a copy more or less, so that its
source meets its target, as far as that document has room.

Only DataFrame functions are used. Rows of a hot source are combined before
every exchange; the sampling windows are over (source, size class, bucket), and
sources are ordered by a sort that Spark divides. Every order and bucket hangs on
a row's own doc_id and text alone, so any layout of one table gives one result.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; a doc_id in several rows counts once per row,
and of rows alike in doc_id, source and text it is left open which one is taken
how often; a null doc_id is the first in order; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, discard

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"
#: About so many documents of a source and size class are sampled by one window.
BUCKET_ROWS = 250
#: A rate's fraction in units of 1 / 2**20; terms of the constraints in 1 / 2**10 words.
UNIT, TERM = 1 << 20, 1 << 10


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sizes: DataFrame) -> DataFrame:
    """The rows with source_no: their place by source in code points, null last. A sort by ranges, then places within each."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sizes.orderBy(order).withColumn("part", F.spark_partition_id()))
    many = parts.groupBy("part").agg(F.count(F.lit(1)).alias("many"))
    # As many rows as the sort had partitions.
    before = many.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("source_no", within - 1).join(before, "part").withColumn("source_no", (F.col("source_no") + F.col("before")).cast("long")).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) to the same with source_no, weight and target.

    Targets are weight * level; those above most * source_size stop there, and
    the excess goes to the others by weight until none is above.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = cut(numbered(sizes).withColumn("weight", cycle).withColumn("cap", most * F.col("source_size")))
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("cap")
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (share * (row["all"] or 0) - (row["capped"] or 0)) / row["open"] if row["open"] else level or 0.0
        if now == level or not row["open"]:
            break
        level = now
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.withColumn("target", target).select("source", "source_no", "source_size", "weight", "target")


def _rate(multiplier: str, x: str, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col(multiplier) * F.col(x), F.lit(50.0))))


def multipliers(histogram: DataFrame, goal: DataFrame, most: float = MOST_COPIES, rounds: int = 60) -> DataFrame:
    """Solve all sources' duals: source_no, scale, multiplier.

    histogram: source_no, size, n. goal: source_no, source_size, target.
    """
    scale = histogram.groupBy("source_no").agg((F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")) / F.sum(F.col("size") * F.col("n"))).cast("double").alias("scale"))
    state = goal.join(scale, "source_no").filter("source_size > 0").select(
        "source_no", "target", "scale", F.lit(0.0).alias("multiplier"), F.lit(-1e3).alias("low"), F.lit(1e6).alias("high"), (F.col("target") >= most * F.col("source_size") * (1 - 1e-9)).alias("full"), F.lit(False).alias("met")
    )
    state = cut(state.withColumn("multiplier", F.when(F.col("full"), F.col("high")).otherwise(F.col("multiplier"))))
    for _ in range(rounds):
        if state.filter(~(F.col("full") | F.col("met"))).isEmpty():
            break
        terms = histogram.join(state.filter(~(F.col("full") | F.col("met"))), "source_no").withColumn("x", F.col("size") / F.col("scale"))
        terms = terms.withColumn("r", _rate("multiplier", "x", most)).withColumn("term", F.col("n") * F.col("size") * F.col("r") * TERM)
        sums = terms.groupBy("source_no").agg(
            F.sum(F.round("term").cast("long")).alias("value"), F.sum(F.when(F.col("r") < most, F.round(F.col("term") * F.col("x")).cast("long")).otherwise(0)).alias("slope")
        )
        gap, at = F.col("value") / TERM - F.col("target"), F.col("multiplier")
        stored, state = state, state.join(sums, "source_no", "left").withColumn("gap", gap)
        state = state.withColumn("low", F.when(F.col("gap") < 0, at).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, at).otherwise(F.col("high")))
        step = at - F.col("gap") / (F.col("slope") / TERM)
        # A Newton step that leaves the bracket gives way to halving it, on a scale that widens with distance.
        half = F.when((F.col("high") - F.col("low") > 4) & (at >= 0) & (F.col("gap") < 0), F.least(2 * at + 1, (F.col("low") + F.col("high")) / 2)).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        met = F.col("met") | (F.abs("gap") <= F.greatest(1e-7 * F.col("target"), F.lit(0.05)))
        state = cut(
            state.withColumn("met", F.coalesce(met, F.col("met")))
            .withColumn("multiplier", F.when(F.col("gap").isNull() | F.col("met"), at).when(inside, step).otherwise(half))
            .select("source_no", "target", "scale", "multiplier", "low", "high", "full", "met")
        )
        discard(stored)
    return state.select("source_no", "scale", "multiplier")


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document's part in the mix: doc_id, source, size, source_size, target, rate, copies, taken.

    taken is copies * size but for at most one document of a source.
    """
    body = F.col(text).cast("string")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"), F.xxhash64(body).alias("tag")))
    histogram = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = cut(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    names = goal.select(F.col("source").alias("name"), "source_no")
    histogram = cut(histogram.join(names, histogram.source.eqNullSafe(F.col("name"))).select("source_no", "size", "n"))
    dual = multipliers(histogram, goal, most)
    # From here on rates are those of (source, size), so they are joined by the histogram's keys.
    solved = goal.join(dual, "source_no", "left")
    rated = sized.join(solved.withColumnRenamed("source", "name"), sized.source.eqNullSafe(F.col("name"))).drop("name")
    rated = rated.withColumn("x", F.col("size") / F.col("scale"))
    rated = rated.withColumn("rate", F.when((F.col("size") > 0) & F.col("scale").isNotNull(), _rate("multiplier", "x", most)).otherwise(0.0))
    rated = rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long"))
    # Size classes of an eighth of an octave, dealt to buckets where there are many documents.
    size_class = F.floor(8 * F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")
    many = cut(histogram.withColumn("class", size_class).groupBy("source_no", "class").agg((1 + F.sum("n") / bucket_rows).cast("long").alias("buckets")))
    rated = rated.withColumn("class", size_class).join(many, ["source_no", "class"])
    own = F.pmod(F.xxhash64("doc_id", "tag"), "buckets").cast("long")
    rated = cut(rated.withColumn("bucket", own).drop("x", "scale", "multiplier", "weight", "buckets"))
    discard(sized)
    # The sum of parts before a class, and before a bucket of it.
    groups = cut(rated.groupBy("source_no", "class", "bucket").agg(F.sum("part").alias("sum")))
    classes = groups.groupBy("source_no", "class").agg(F.sum("sum").alias("sum"))
    classes = classes.select("source_no", "class", (F.sum("sum").over(Window.partitionBy("source_no").orderBy("class")) - F.col("sum")).alias("earlier"))
    inside = F.sum("sum").over(Window.partitionBy("source_no", "class").orderBy("bucket")) - F.col("sum")
    before = cut(groups.withColumn("inside", inside).join(classes, ["source_no", "class"]).select("source_no", "class", "bucket", (F.col("earlier") + F.col("inside")).alias("before")))
    along = Window.partitionBy("source_no", "class", "bucket").orderBy("size", "doc_id", "tag")
    drawn = rated.withColumn("place", F.row_number().over(along)).withColumn("upto", F.sum("part").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    drawn = drawn.join(before, ["source_no", "class", "bucket"]).withColumn("upto", F.col("upto") + F.col("before") + UNIT // 2)
    drawn = drawn.withColumn("copies", F.col("whole") + F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("part")) / UNIT)).withColumn("taken", F.col("copies") * F.col("size"))
    drawn = cut(drawn.select("class", "bucket", "place", "doc_id", "tag", "source", "source_no", "size", "source_size", "target", "rate", "copies", "taken"))
    discard(rated, groups, before)
    # What rounding leaves: one document of the source, that with most room for it, takes it.
    key = ["class", "bucket", "place"]
    most_of = lambda x: F.max(F.struct(x.alias("room"), "doc_id", "tag", *key))
    rest = drawn.groupBy("source_no").agg(F.round(F.first("target") - F.sum("taken")).cast("long").alias("rest"), most_of(most * F.col("size") - F.col("taken")).alias("more"), most_of(F.col("taken")).alias("less"))
    rest = rest.withColumn("own", F.when(F.col("rest") > 0, F.col("more")).otherwise(F.col("less")))
    rest = rest.select("source_no", *[f"own.{k}" for k in key], F.when(F.col("rest") > 0, F.least("rest", "own.room")).otherwise(F.greatest("rest", -F.col("own.room"))).alias("change"))
    return drawn.join(rest, ["source_no", *key], "left").select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("taken") + F.coalesce("change", F.lit(0))).alias("taken"))


def op1(docs: DataFrame) -> DataFrame:
    """op1's contract over a documents table."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate")
