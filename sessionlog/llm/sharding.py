"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table, a
permutation drawn from a hash of its name. Shards take turns, as often as their
weight says, claiming their next free slot, until all are claimed; so loads are
even and a change of shards moves few slots. The table's size is a parameter,
never the data's, so it is broadcast, and a document's place is one lookup.

Defined cases: rows are placed by their key, so equal keys share a shard; a null
key is hashed as a value of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, at least a hundred times the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:05d}" for i in range(64))


def fill_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: tuple[int, ...] | None = None) -> np.ndarray:
    """The shard that holds each slot."""
    if not shards or len(shards) > slots:
        raise ValueError("there must be shards, and no more than slots")
    drawn = [hashlib.sha256(s.encode()).digest() for s in shards]
    start = [int.from_bytes(x[:8], "big") % slots for x in drawn]
    skip = [int.from_bytes(x[8:16], "big") % (slots - 1) + 1 for x in drawn]
    table, left = np.full(slots, -1, np.int32), slots
    place = list(start)
    turns = weights or (1,) * len(shards)
    while True:
        for i, times in enumerate(turns):
            for _ in range(times):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + skip[i]) % slots
                table[place[i]] = i
                left -= 1
                if not left:
                    return table


def shard_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: tuple[int, ...] | None = None) -> DataFrame:
    """(slot, shard_no, shard)."""
    table = fill_table(shards, slots, weights).tolist()
    return spark.createDataFrame([(i, s, shards[s]) for i, s in enumerate(table)], "slot int, shard_no int, shard string")


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: tuple[int, ...] | None = None) -> DataFrame:
    """The rows with slot, shard_no and shard."""
    table = shard_table(rows.sparkSession, shards, slots, weights)
    return rows.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).join(F.broadcast(table), "slot")


def op2(docs: DataFrame) -> DataFrame:
    """Every document's shard."""
    return place(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"))).select("doc_id", "n_bytes", "slot", "shard_no", "shard")
