r"""Substring dedup: words covered by windows that an earlier document holds.

A window is WINDOW consecutive words of one document. A document whose words are
those of an earlier one repeats it whole, and all its windows are the earlier
one's: such copies are found by a hash of their words and sit out what follows, as
long as their ids are few enough to be broadcast; else they take part like others,
with the same result.

First pass: every task folds its windows into a count-min sketch of DEPTH rows of
cells, and the tasks' sketches are merged by adding them block by block of cells.
A window's estimate is the least of its cells, never below its count. To fold
fewer, windows are sketched by their minimizer, the least hash among the GRAM-word
sequences inside: equal windows have equal ones, so its count is an overestimate of
theirs too. The rows grow with the text, by CELLS_A_BYTE, so the share of windows
that are overestimated stays the same at any size. Second pass: only windows
estimated at two or more are grouped, exactly, by 96 bits of hash of their words,
with the smallest doc_id of each; no repeated window is lost. The merged sketch is
broadcast, a bit a cell, while it has SCREEN_BYTES at most; a larger one stays a
table, which the windows' minimizers join, word of cells by word. Third: a
document's windows that a smaller doc_id holds cover the words to remove.

Frequent windows are combined before every exchange, or met in joins that Spark
splits; nothing of corpus size is broadcast or collected.

Defined cases: a null text has no words; a text shorter than a window keeps all
its words; a window repeated inside one document alone is kept; rows that share a
doc_id count as one document, each with its own text; a null doc_id is the last of
all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, discard
from ._words import Words, chunks, mix, windows

WINDOW = 13
GRAM = 8
#: Most ids of copies that are broadcast, 32 MB.
COPY_IDS = 4_000_000
#: What a null doc_id counts as: the last of all.
LAST = (1 << 63) - 1
#: Rows of the sketch; cells of a row to a byte of text; most bytes of a broadcast one.
DEPTH = 3
CELLS_A_BYTE = 1 / 8
SCREEN_BYTES = 64 << 20
#: A window's cells lie in one word of 64 in each row; this many words are merged at a time.
BLOCK_WORDS = 1 << 10
#: Minimizers that a task folds at once.
FOLD_KEYS = 4_000_000
_SALT = np.uint64(0xA24BAED4963EE407)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parts(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and of every window inside one text its first word, the text's number and its minimizer."""
    h = words.hashes()
    n = np.maximum(words.counts() - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n)
    if not len(at):
        return h, at, text, np.zeros(0, np.uint64)
    grams = windows(h, gram)
    low = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).min(axis=1)
    return h, at, text, low[at]


def copies(docs: DataFrame, text: str = "text", most: int = COPY_IDS) -> np.ndarray:
    """Sorted ids of documents whose words are those of one with a smaller doc_id; none if there are more than `most`."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                words = Words(data, offsets)
                h, at = words.hashes(), words.first.tolist()
                own = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["doc_id", "key"])

    rows = cut(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(keys, "doc_id long, key binary"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    alone = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    found = cut(rows.join(first, "key").filter((F.col("doc_id") > F.col("least")) & (F.col("doc_id") < LAST)).select("doc_id").join(alone, "doc_id", "left_semi"))
    few = found.count() <= most
    out = np.sort(found.toArrow().column("doc_id").to_numpy()) if few else np.zeros(0, np.int64)
    discard(rows, found)
    return out


def _is_copy(ids: np.ndarray, sorted_ids: np.ndarray) -> np.ndarray:
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    return sorted_ids[np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)] == ids


def _originals(batch: pa.RecordBatch, copied: np.ndarray) -> pa.RecordBatch:
    """A batch of (doc_id, text) without the copies."""
    gone = _is_copy(batch.column(0).to_numpy(zero_copy_only=False), copied)
    return batch.filter(pa.array(~gone)) if gone.any() else batch


def _source(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text and tag, a hash of it that tells rows of one doc_id apart."""
    body = F.col(text).cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tag"))


def words_for(docs: DataFrame, text: str = "text", cells_a_byte: float = CELLS_A_BYTE) -> int:
    """A power of two of words of 64 cells for a row of the sketch."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
    return max(BLOCK_WORDS, 1 << int(size * cells_a_byte / 64).bit_length())


def _cells(low: np.ndarray, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The word of each minimizer, and its cell in that word in each row."""
    h = mix(low)
    return (h & np.uint64(words - 1)).astype(np.int64), [(h >> np.uint64(58 - 6 * r) & np.uint64(63)).astype(np.int64) for r in range(DEPTH)]


def _stretches(low: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where stretches of windows begin that share a minimizer in one text."""
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    return np.flatnonzero(new)


def sketch(docs: DataFrame, words: int, text: str = "text", window: int = WINDOW, gram: int = GRAM, copied: Broadcast | None = None) -> DataFrame:
    """The merged count-min sketch: for every block of words the cells counted at least twice, a bit each: block, held."""

    def emit(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        low, counts = np.unique(np.concatenate(keys), return_counts=True)
        low = np.repeat(low, np.minimum(counts, 2))  # more than two is no news
        word, cells = _cells(low, words)
        order = np.argsort(word, kind="stable")
        block = word[order] // BLOCK_WORDS
        own = np.stack([(word % BLOCK_WORDS * 64 + c)[order] for c in cells]).astype(np.uint16)
        at = np.flatnonzero(np.diff(block, prepend=-1))
        parts = [np.ascontiguousarray(own[:, a:b]).tobytes() for a, b in zip(at, [*at[1:], len(block)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(parts, pa.binary())], ["block", "cells"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many = [], 0
        for batch in batches:
            for _, data, offsets in chunks(_originals(batch, copied.value) if copied else batch, "text"):
                _, _, owner, low = _parts(Words(data, offsets), window, gram)
                keys.append(low[_stretches(low, owner)])
                many += len(keys[-1])
                if many >= FOLD_KEYS:
                    yield from emit(keys)
                    keys, many = [], 0
        if many:
            yield from emit(keys)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((DEPTH, BLOCK_WORDS * 64), np.int64)
        for cells in part["cells"]:
            for row, own in zip(counts, np.frombuffer(cells, np.uint16).reshape(DEPTH, -1), strict=True):
                row += np.bincount(own, minlength=len(row))
        return pd.DataFrame({"block": [part["block"].iloc[0]], "held": [np.packbits(counts >= 2, axis=1, bitorder="little").tobytes()]})

    parts = _source(docs, text).mapInArrow(fold, "block long, cells binary")
    return parts.groupBy("block").applyInPandas(add, "block long, held binary")


def _as_words(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.uint64).reshape(DEPTH, BLOCK_WORDS)


def _repeated(table: np.ndarray, words: int, low: np.ndarray) -> np.ndarray:
    """Whether each minimizer's estimate, the least of its cells, is at least two. table: DEPTH x words."""
    word, cells = _cells(low, words)
    out = np.ones(len(low), bool)
    for row, cell in zip(table, cells, strict=True):
        out &= (row[word] >> cell.astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def _window_rows(part: pa.RecordBatch, words: Words, h: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> pa.RecordBatch:
    one, two = windows(h, window)[at], windows(mix(h ^ _SALT), window)[at]
    columns = [part.column(0).take(pa.array(owner)), part.column(part.schema.get_field_index("tag")).take(pa.array(owner))]
    return pa.RecordBatch.from_arrays([*columns, pa.array((at - words.first[owner]).astype(np.int32)), _long(one), pa.array(two.astype(np.uint32).view(np.int32))], ["doc_id", "tag", "start", "one", "two"])


_WINDOWS = "doc_id long, tag long, start int, one long, two int"


def candidates(docs: DataFrame, blocks: DataFrame, words: int, text: str = "text", window: int = WINDOW, gram: int = GRAM, screen_bytes: int = SCREEN_BYTES, copied: Broadcast | None = None) -> DataFrame:
    """Every window estimated at two or more: doc_id, tag, start (its first word), one and two (its hash). blocks: the stored sketch."""
    source = _source(docs, text)
    if DEPTH * words * 8 <= screen_bytes:
        table = np.zeros((DEPTH, words), np.uint64)
        for row in blocks.toLocalIterator():  # screen_bytes at most
            table[:, row["block"] * BLOCK_WORDS : (row["block"] + 1) * BLOCK_WORDS] = _as_words(row["held"])
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(_originals(batch, copied.value) if copied else batch, "text"):
                    own = Words(data, offsets)
                    h, at, owner, low = _parts(own, window, gram)
                    hit = np.flatnonzero(_repeated(shared.value, words, low))
                    yield _window_rows(part, own, h, at[hit], owner[hit], window)

        return source.mapInArrow(emit, _WINDOWS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _as_words(held)
                some = np.flatnonzero(rows.all(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK_WORDS + some), *[_long(r[some]) for r in rows]], ["word", *[f"row{r}" for r in range(DEPTH)]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(_originals(batch, copied.value) if copied else batch, "text"):
                own = Words(data, offsets)
                _, at, owner, low = _parts(own, window, gram)
                first = _stretches(low, owner)
                word, cells = _cells(low[first], words)
                take = pa.array(owner[first])
                many = np.diff([*first, len(low)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(2).take(take), pa.array((at[first] - own.first[owner[first]]).astype(np.int32)), pa.array(many), pa.array(word), pa.array(sum(c << 6 * r for r, c in enumerate(cells)).astype(np.int32))],
                    ["doc_id", "tag", "start", "many", "word", "cells"],
                )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                own, spans = Words(data, offsets), part.column(part.schema.get_field_index("spans")).to_pylist()
                h, n = own.hashes(), np.maximum(own.counts() - window + 1, 0)
                # A stretch may begin beyond a text that shares its doc_id and tag only by chance.
                pairs = [(k, own.first[k] + x["start"], min(x["many"], n[k] - x["start"])) for k, of in enumerate(spans) for x in of if x["start"] < n[k]]
                owner = np.repeat([p[0] for p in pairs], [p[2] for p in pairs]).astype(np.int64)
                at = np.concatenate([np.arange(a, a + m) for _, a, m in pairs] or [np.zeros(0, np.int64)]).astype(np.int64)
                yield _window_rows(part, own, h, at, owner, window)

    cells = cut(blocks.mapInArrow(split, "word long, " + ", ".join(f"row{r} long" for r in range(DEPTH))))
    asked = source.mapInArrow(ask, "doc_id long, tag long, start int, many int, word long, cells int")
    bit = lambda r: F.expr(f"shiftright(row{r}, shiftright(cells, {6 * r}) & 63) & 1 = 1")
    found = asked.join(cells, "word")
    for r in range(DEPTH):
        found = found.filter(bit(r))
    spans = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "many")).alias("spans"))  # at most the document's words
    return source.join(spans, ["doc_id", "tag"]).select("doc_id", "text", "tag", "spans").mapInArrow(rows_of, _WINDOWS)


def covered(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, screen_bytes: int = SCREEN_BYTES, copied: Broadcast | None = None) -> DataFrame:
    """(doc_id, tag, starts): the first words of a document's windows that a smaller doc_id holds."""
    words = words_for(docs, text)
    each = candidates(docs, cut(sketch(docs, words, text, window, gram, copied)), words, text, window, gram, screen_bytes, copied)
    least = each.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    # As a stored table it has an exchange of its own, so that Spark splits the join where a window is frequent.
    late = each.join(cut(least), ["one", "two"]).filter("doc_id > least")
    return late.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts"))  # at most the document's words


def remove_covered(docs: DataFrame, starts: DataFrame, text: str = "text", window: int = WINDOW, copied: Broadcast | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            gone_whole = _is_copy(batch.column(3).to_numpy(), copied.value) if copied else np.zeros(batch.num_rows, bool)
            for doc, body, at, whole in zip(*(c.to_pylist() for c in batch.columns[:3]), gone_whole.tolist(), strict=True):
                words = (body or "").encode().split()  # splits at space and 0x09-0x0D
                gone = np.zeros(len(words) + 1, np.int64)
                if at:
                    at = np.asarray(at)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + window, len(words)), -1)
                keep = np.cumsum(gone)[: len(words)] == 0
                if whole and len(words) >= window:
                    keep[:] = False
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                rows.append((doc, len(words), len(words) - int(keep.sum()), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names) if rows else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))))

    names = ["doc_id", "n_words", "n_removed", "kept_text"]
    body, key = F.col(text).cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), key, F.xxhash64(body).alias("tag")).join(starts.withColumnRenamed("doc_id", "key"), ["key", "tag"], "left")
    return joined.select("doc_id", "text", "starts", "key").mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, screen_bytes: int = SCREEN_BYTES, copy_ids: int = COPY_IDS) -> DataFrame:
    """Every document with its repeated passages removed: doc_id, n_words, n_removed, kept_text."""
    copied = docs.sparkSession.sparkContext.broadcast(copies(docs, text, copy_ids))
    return remove_covered(docs, covered(docs, text, window, gram, screen_bytes, copied), text, window, copied)


def op4(docs: DataFrame) -> DataFrame:
    """op4's contract over a documents table."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '[\x20\x09-\x0D]+') AS ws0, text FROM documents),
d AS (SELECT doc_id, CASE WHEN ws0 = [''] THEN [] ELSE ws0 END AS ws FROM w),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM p),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE doc_id > least) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
