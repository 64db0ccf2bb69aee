"""Exact dedup of incoming batches against an immutable snapshot.

freeze() prepares a snapshot once: its digests, combined by digest, are dealt to
shards by hash, and each shard is frozen into a static binary-fuse filter, stored
beside them. Each incoming batch is combined by digest on its own, and its digests
are looked up in their shard's filter. A negative is certainly new: it never
meets the snapshot. Positives join the snapshot's exact buckets by digest; what
joins, and the digests that either side holds more than once, are suspects: only
their texts leave the scan, and buckets are told apart by the bytes themselves.

Rows of one text are combined before every exchange (sizes and largest ids are
partial aggregates), so a text that fills a third of the table costs one row per
task. Filters are per shard. Suspects are recognised in the scan by a bitmap of
BITMAP_BITS at most, which lets the more others pass the fuller it is; a join with
the suspects follows.

Defined cases: a null text equals the empty one; repeated rows count each in
group_size, and those with the group's largest doc_id are all kept; a null doc_id
is never kept where its group has another; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import BITMAP_BITS, Screen
from ._store import cut, discard
from ._words import LOWER, chunks, mix, strings

#: Rows per filter: a shard of this many digests takes about 1.2 MB as a filter.
SHARD_KEYS = 1_000_000


# --- binary fuse filter -------------------------------------------------------
def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The three cells of each key, in consecutive segments, and its fingerprint."""
    h = mix(keys ^ np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    low, mask = mix(h + np.uint64(1)), np.uint64(segment - 1)
    at = [(first + i) * segment + (low >> np.uint64(20 * i) & mask).astype(np.int64) for i in range(3)]
    return *at, (h ^ (h >> np.uint64(29))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A static 8-bit three-way binary-fuse filter over distinct 64-bit keys: seed, segment length, segments, cells.

    Cells that only one key still uses are peeled round by round; assigning
    fingerprints in the reverse order makes the three cells of every key xor to
    its fingerprint.
    """
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(max(n, 4) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))) + 1
    for seed in range(1, 200):
        count = max(1, -(-size // segment) - 2)
        a, b, c, print_ = _places(keys, seed, segment, count)
        cells, order, alive = (count + 2) * segment, [], np.ones(n, bool)
        at = np.stack([a, b, c])
        uses = np.bincount(at.ravel(), minlength=cells)
        owner = np.zeros(cells, np.int64)  # xor of the keys of a cell
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        free = np.flatnonzero(uses == 1)
        while len(free):
            key, first = np.unique(owner[free], return_index=True)
            live = alive[key]
            key, cell = key[live], free[first][live]
            order.append((key, cell))
            alive[key] = False
            for row in at:
                np.subtract.at(uses, row[key], 1)
                np.bitwise_xor.at(owner, row[key], key)
            near = np.unique(at[:, key])
            free = near[uses[near] == 1]
        if not alive.any():
            table = np.zeros(cells, np.uint8)
            for key, cell in reversed(order):
                table[cell] = print_[key] ^ table[a[key]] ^ table[b[key]] ^ table[c[key]]
            return seed, segment, count, table.tobytes()
        size = int(size * 1.05) + 1
    raise ValueError("keys aren't distinct")


def in_filter(keys: np.ndarray, seed: int, segment: int, count: int, table: bytes) -> np.ndarray:
    """Whether each key may be among those of the filter; never false for one that is."""
    cells = np.frombuffer(table, np.uint8)
    a, b, c, print_ = _places(keys, seed, segment, count)
    return (cells[a] ^ cells[b] ^ cells[c]) == print_


# --- the operator -------------------------------------------------------------
def with_digest(df: DataFrame, text: str = "text", suspects: Screen | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, digest (sha256 of the text lower-cased in A-Z), check (another hash of it) and, if asked for, norm (that text).

    suspects: rows whose digest it doesn't hold are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "norm"):
                texts = strings(LOWER[data], offsets)
                digests = [hashlib.sha256(x).digest() for x in texts]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "digest", "norm"])
                if suspects is not None:
                    out = out.filter(pa.array(suspects(np.frombuffer(b"".join(x[:8] for x in digests), ">u8").astype(np.uint64))))
                yield out

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("norm"))
    out = source.mapInArrow(run, "doc_id long, digest binary, norm string").withColumn("check", F.xxhash64("norm"))
    return out if keep_text else out.drop("norm")


def _cell(digest: str) -> Column:
    """The first eight bytes of a digest as a number."""
    return F.conv(F.substring(F.hex(digest), 1, 16), 16, -10).cast("long")


def _shard(column: str, shards: int):  # noqa: ANN202
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


def _key64(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in values), np.uint64)


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """Static filters of distinct digests, one per shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        seed, segment, count, table = build_filter(np.unique(_key64(part["digest"])))
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [count], "cells": [table]})

    keys = digests.select("digest").withColumn("shard", _shard("digest", shards))
    return keys.groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, segments int, cells binary")


def screen(digests: DataFrame, filters: DataFrame, shards: int, task_keys: int = SHARD_KEYS) -> DataFrame:
    """Those of the distinct digests that their shard's filter doesn't rule out; a task looks up about task_keys of them."""

    def look(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(own):
            return part[["digest"]].iloc[:0]
        x = own.iloc[0]
        return part.loc[in_filter(_key64(part["digest"]), int(x.seed), int(x.segment), int(x.segments), x.cells), ["digest"]]

    splits = 1 + digests.count() // (shards * task_keys)
    keys = digests.select("digest").withColumn("shard", _shard("digest", shards)).withColumn("split", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(splits)).cast("int"))
    spread = filters.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return keys.groupBy("shard", "split").cogroup(spread.groupBy("shard", "split")).applyInPandas(look, "digest binary")


@dataclass
class Snapshot:
    """A frozen snapshot: its rows, their digests combined (digest, n), and the filters of its shards, all stored."""

    docs: DataFrame
    rows: DataFrame
    digests: DataFrame
    filters: DataFrame
    shards: int


def freeze(docs: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS) -> Snapshot:
    """Digest a snapshot and build its filters, once for all batches to come."""
    rows = cut(with_digest(docs, text))
    digests = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    shards = 1 + digests.count() // shard_keys
    return Snapshot(docs, rows, digests, cut(build_filters(digests, shards)), shards)


def _buckets(docs: DataFrame, text: str, screen_: Screen, suspects: DataFrame) -> DataFrame:
    """Exact buckets of the suspects' texts: the grouping key holds the bytes."""
    texts = with_digest(docs, text, screen_, keep_text=True).join(suspects, "digest", "left_semi")
    return texts.groupBy("digest", "check", "norm").agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("n"))


def exact_dedup(snapshot: DataFrame | Snapshot, incoming: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """One row per row of both tables: doc_id, digest, keep_id, group_size, kept, batch (whether incoming)."""
    old = snapshot if isinstance(snapshot, Snapshot) else freeze(snapshot, text, shard_keys)
    new = cut(with_digest(incoming, text))
    digests = cut(new.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    positive = screen(digests, old.filters, old.shards)
    met = old.digests.join(positive, "digest", "left_semi").select("digest")
    copied = old.digests.unionByName(digests).filter("n > 1").select("digest")
    suspects = cut(met.unionByName(copied).distinct())
    among = Screen(suspects.select(_cell("digest").alias("cell")), bitmap_bits)
    stored, batch = cut(_buckets(old.docs, text, among, suspects)), cut(_buckets(incoming, text, among, suspects))
    pairs = batch.alias("i").join(stored.alias("s"), (F.col("i.digest") == F.col("s.digest")) & (F.col("i.norm") == F.col("s.norm")), "full_outer")
    groups = pairs.select(F.coalesce("i.digest", "s.digest").alias("digest"), F.coalesce("i.check", "s.check").alias("check"), F.greatest("i.largest", "s.largest").alias("keep_id"), (F.coalesce("i.n", F.lit(0)) + F.coalesce("s.n", F.lit(0))).alias("group_size"))
    groups = cut(groups.filter("group_size > 1"))
    discard(stored, batch, digests, suspects)
    rows = old.rows.withColumn("batch", F.lit(False)).unionByName(new.withColumn("batch", F.lit(True)))
    out = rows.join(groups, ["digest", "check"], "left").withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
    return out.select("doc_id", "digest", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "batch")


def split_snapshot(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An earlier snapshot and a batch of about equal size, by a hash of doc_id."""
    first = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 0
    return docs.filter(first), docs.filter(~first)


def op10(docs: DataFrame) -> DataFrame:
    """op10's contract over a documents table."""
    return exact_dedup(*split_snapshot(docs)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
