"""Stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads, the
columns of documents; the last returns its packing plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from sessionlog.llm._store import cut, discard, documents, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bitmaps of more bytes aren't broadcast. Spark's own hold 32,768 ids in 4 KB each.
BITMAP_BYTES, BUCKET_BYTES = 64 << 20, 4096


def by_row(docs: DataFrame, nulls_first: bool = False) -> DataFrame:
    """The documents with an id of each row, `row`, in the order of doc_id.

    It is doc_id itself where that is set and unique. Else rows are numbered in a
    stored table, so that every use of it sees the same numbers; equal doc_ids are
    told apart by a hash of the row.
    """
    own = F.col("doc_id").cast("long")
    if docs.groupBy(own.alias("own")).count().filter("own IS NULL OR count > 1").isEmpty():
        return docs.select(*COLUMNS, own.alias("row"))
    order = own.asc_nulls_first() if nulls_first else own.asc_nulls_last()
    placed = docs.select(COLUMNS).orderBy(order, F.xxhash64(*COLUMNS), F.monotonically_increasing_id())
    return cut(placed.withColumn("row", F.monotonically_increasing_id()))


def _as_doc_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("row")).drop("row")


def marked(rows: DataFrame, ids: DataFrame, name: str, most: int = BITMAP_BYTES) -> DataFrame:
    """Rows with a column `name`, whether their id `row` is among the ids.

    The ids are broadcast as bitmaps, so that no text is shuffled. Ids so far apart that
    their bitmaps pass `most` bytes are joined instead, texts and all.
    """
    ids = cut(ids.select("row"))
    buckets = ids.select(F.bitmap_bucket_number("row").alias("bucket"), F.bitmap_bit_position("row").alias("bit"))
    if buckets.select("bucket").distinct().count() * BUCKET_BYTES > most:
        return rows.join(ids.distinct().withColumn(name, F.lit(True)), "row", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    # Dealt by bucket first, so that one task fills a bitmap.
    bits = cut(buckets.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    discard(ids)
    at = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(byte, CAST(bit % 8 AS INT)) & 1 = 1")
    own = rows.withColumn("bucket", F.bitmap_bucket_number("row")).join(F.broadcast(bits), "bucket", "left").withColumn("byte", byte).withColumn("bit", at)
    return own.withColumn(name, F.coalesce(held, F.lit(False))).drop("bucket", "bits", "byte", "bit")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes what was found."""
    small_batches(spark)
    found = language_id.identify(docs, language_id.fit(docs), COLUMNS, "text", declared=F.col("lang"), host=F.col("source"))
    return found.filter("accepted").withColumn("lang", F.col("language")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each exact text, one with the largest doc_id; null is the least."""
    small_batches(spark)
    rows = by_row(docs, nulls_first=True)
    kept = exact_dedup.op10(_as_doc_id(rows)).filter("kept").select(F.col("doc_id").alias("row"))
    return marked(rows, kept, "kept").filter("kept").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the smallest doc_id, null the last; five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    rows = by_row(docs)
    groups = jaccard_join.jaccard_join(_as_doc_id(rows), shingle=5, percent=80)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("row"))
    return marked(rows, kept, "kept").filter("kept").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy the mix takes; where it takes part of a copy, the text's first words."""
    docs = by_row(docs)
    taken = cut(mixing.mix(_as_doc_id(docs)).filter("taken > 0").select(F.col("doc_id").alias("row"), "size", "taken"))
    rows, copies = docs, F.lit(0)
    for n in range(1, mixing.MOST_COPIES + 1):
        rows, copies = marked(rows, taken.filter(F.col("taken") >= n * F.col("size")), f"copy_{n}"), copies + F.col(f"copy_{n}").cast("int")
    # A row a source at most, stored so that its size is known.
    part = cut(taken.filter(F.col("taken") % F.col("size") > 0).select("row", (F.col("taken") % F.col("size")).cast("int").alias("first_words")))
    discard(taken)
    rows = rows.join(part, "row", "left").withColumn("copies", copies)
    all_copies = F.col("copies") + F.col("first_words").isNotNull().cast("int")
    rows = rows.filter(all_copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), all_copies)))
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    rows = rows.withColumn("text", F.when(F.col("copy") > F.col("copies"), F.array_join(F.slice(words, F.lit(1), F.col("first_words")), " ")).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the packed sequences."""
    small_batches(spark)
    return packing.op5(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The stages of language ID, mixing and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each reading what the one before wrote."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
