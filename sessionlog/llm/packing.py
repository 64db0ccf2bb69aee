"""Packing token sequences by cutting-stock column generation.

Every text is tokenised whole and cut into pieces of the sequence length; the
tails are the items of a cutting-stock problem. Their length histogram, by
classes of a fixed width, is all that reaches the driver: at most
sequence / quantum numbers. A linear program over patterns (multisets of classes
that fit one sequence) is solved by column generation: an integer knapsack by
dynamic programming prices the next pattern. A pattern may leave a gap for cut
tails of one class: the gaps of all its sequences are one tape, on which these
tails lie end to end, cut where a gap ends. Such a column costs CUT_COST more, so
tails are cut only where whole ones leave more padding than that. Pattern counts
are rounded down; the few items left over, fewer than the basis holds, are packed
by first fit decreasing, or lie on a tape of their own where that saves
sequences. Then each class's documents are ranked, and a rank range lookup gives
each piece its pattern, its sequences and its cuts.

A tail is cut at multiples of the class width. Each stored tail carries the
CRC-32 of its ids up to every such multiple, so a cut piece's CRC-32 follows from
two of them and no text is tokenised again.

Ranks come from windows over (class, bucket) with bucket offsets, so that a
class holding a third of all pieces is spread over many tasks.

No order hangs on a physical row id, so any layout of one table gives one plan.

Defined cases: a null or empty text is the single end id; a doc_id that occurs
in several rows is packed once per row, a null one too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut
from ._words import Words, chunks

SEQUENCE = 2048
#: Width of a length class; a piece wastes less than this in its sequence.
QUANTUM = 16
#: A sequence that cuts a tail counts as so much more than one that doesn't.
CUT_COST = 0.01
END_ID = 1
#: Distinct words, and ids of them, that a worker remembers before it forgets those not met again.
MEMO_WORDS, MEMO_IDS = 500_000, 4_000_000
#: Bytes of text tokenised at once; each takes some forty bytes of arrays meanwhile.
CHUNK_BYTES = 512 << 10
#: About so many pieces of a class are ranked by one window.
BUCKET_ROWS = 2_000

#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_memo: dict[str, Any] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of words, each distinct word encoded once.

    The tokenizer ignores case and its pieces never span white space, nor a
    letter and a full stop or comma after it; so a text's ids are those of such
    parts in order. Texts with "<|" may hold special tokens, in which case
    counts: they keep it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted keys and their rows
        self.size, self.marks = np.zeros(1 << 14, np.uint32), np.zeros((1 << 14, 2), np.uint64)  # size and ends of each row's word
        self.met = np.zeros(1 << 14, bool)  # whether a later chunk had the word too
        self.ids, self.at, self.n = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), 0  # ids of row r: at[r]:at[r + 1]

    def forget(self) -> None:
        """Keep the words that were met again, and these only until the next time; none, if they are more than half of what is held."""
        kept = np.flatnonzero(self.met[self.row])
        rows = self.row[kept]
        sizes = self.at[rows + 1] - self.at[rows]
        if 2 * len(rows) > MEMO_WORDS or 2 * sizes.sum() > MEMO_IDS:
            return self.clear()
        ends, n = np.cumsum(sizes), len(rows)
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.at[rows] - (ends - sizes), sizes)]
        keys, size, marks = self.keys[kept], self.size[rows], self.marks[rows]
        self.clear()
        self._make_room(n, ids)
        self.keys, self.row, self.n = keys, np.arange(n, dtype=np.int32), n
        self.size[:n], self.marks[:n], self.at[1 : n + 1], self.ids[: len(ids)] = size, marks, ends, ids

    def _make_room(self, words: int, ids: np.ndarray) -> None:
        """Let the arrays hold so many words and the ids more."""
        if len(self.at) < self.n + words + 1:
            more = max(len(self.at) // 4, words + 1)
            self.at, self.size, self.met = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.at, self.size, self.met))
            self.marks = np.concatenate([self.marks, np.zeros((more, 2), np.uint64)])
        kind = np.promote_types(self.ids.dtype, np.min_scalar_type(ids.max(initial=0)))
        if len(self.ids) < self.at[self.n] + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 4, len(ids)), kind)])
        elif kind != self.ids.dtype:
            self.ids = self.ids.astype(kind)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ids, sizes = [], []
        for i in range(0, len(words), 1000):
            own = words[i : i + 1000]
            got = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in own)])
            of = np.searchsorted(starts, np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), "right") - 1
            ids.append(np.asarray(got.ids, np.uint32))
            sizes.append(np.bincount(of, minlength=len(own)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, words: list[bytes], marks: np.ndarray) -> np.ndarray:
        """Encode words; their new rows."""
        ids, sizes = self._encode([w.decode("utf-8", "replace") for w in words])
        ends, n = self.at[self.n] + np.cumsum(sizes), self.n
        self._make_room(len(words), ids)
        self.at[n + 1 : n + 1 + len(words)], self.size[n : n + len(words)], self.marks[n : n + len(words)] = ends, marks[:, 0], marks[:, 1:]
        self.ids[self.at[n] : ends[-1]] = ids
        self.n += len(words)
        return np.arange(n, self.n)

    @staticmethod
    def _marks(words: Words) -> np.ndarray:
        """Size, first and last eight bytes of every word: all of a word up to sixteen bytes."""
        size = words.ends - words.starts
        padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
        codes = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
        head = codes[words.starts] & _FIRST[np.minimum(size, 8)]
        return np.stack([size.astype(np.uint64), head, np.where(size < 8, head, codes[np.maximum(words.ends - 8, 0)])], axis=1)

    def _rows(self, words: Words) -> np.ndarray:
        """The row of each word. Words are remembered by their hash; where the marks of two words of one hash differ, the chunk's words are told apart by their bytes."""
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        marks, raw = self._marks(words), words.data.tobytes()
        spelt = lambda at: [raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
        where = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(where, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        old, held = self.row[where[known]], marks[first[known]]
        apart = (marks != marks[first][inverse]).any() or (self.size[old] != held[:, 0]).any() or (self.marks[old] != held[:, 1:]).any()
        if apart:
            every = spelt(np.arange(len(words.starts)))
            at = {w: i for i, w in enumerate(every)}
            rows = dict(zip(at, self._add(list(at), marks[list(at.values())]).tolist(), strict=True))
            return np.array([rows[w] for w in every])
        self.met[old] = True
        new = np.flatnonzero(~known)
        if len(new):
            rows, to = self._add(spelt(first[new]), marks[first[new]]), where[new]
            self.keys, self.row = np.insert(self.keys, to, keys[new]), np.insert(self.row, to, rows)
            where = np.searchsorted(self.keys, keys)
        return self.row[where][inverse]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a chunk and where each text's ids start, one more than texts."""
        words = Words(data, offsets, lower=not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        words.split_stops()
        if self.n > MEMO_WORDS or self.at[self.n] > MEMO_IDS:
            self.forget()
        row = self._rows(words)
        begin, size = self.at[row], self.at[row + 1] - self.at[row]
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.ids[take].astype(np.uint32), np.concatenate([[0], ends])[words.first]


def _marks_of(ids: np.ndarray, quantum: int) -> bytes:
    """The CRC-32 of the first quantum, 2 * quantum, ... ids, short of all of them: four bytes each, highest first."""
    raw, step, crc, marks = memoryview(ids).cast("B"), 4 * quantum, 0, []
    for at in range(step, len(raw), step):
        crc = zlib.crc32(raw[at - step : at], crc)
        marks.append(crc)
    return np.array(marks, ">u4").tobytes()


def pieces(docs: DataFrame, text: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, keep_ids: bool = False, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of every text: doc_id, copy, start, length, ids_crc32, doc_tokens, marks and, if asked for, ids.

    copy, a hash of the text, tells rows of one doc_id apart; rows alike in both are packed alike, each once.
    marks, of pieces shorter than a sequence, are what pack() needs to cut them at multiples of quantum.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _memo:
            _memo[path] = WordIds(path)
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK_BYTES):
                ids, first = _memo[path].of(data, offsets)
                rows: list[tuple] = []
                for doc, row, a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), first.tolist(), first[1:].tolist(), strict=False):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for i in range(0, len(own), sequence):
                        cut_ids = own[i : i + sequence]
                        marks = _marks_of(cut_ids, quantum) if len(cut_ids) < sequence else None
                        rows.append((doc, row, i, len(cut_ids), zlib.crc32(cut_ids.tobytes()), len(own), marks, cut_ids if keep_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 6 + [pa.binary()] + [pa.list_(pa.int64())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=False)], names)

    names = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "marks"] + ["ids"] * keep_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("copy"), F.col(text).cast("string").alias("text"))
    kind = {"ids": "array<long>", "marks": "binary"}
    return source.mapInArrow(run, ", ".join(f"{x} {kind.get(x, 'long')}" for x in names))


# --- the plan, from the histogram ----------------------------------------------
class Use(NamedTuple):
    """A pattern in use: `times` sequences hold its items; over the gaps they leave, of `gap` each, the tape's items lie end to end."""

    pattern: dict[int, int]
    times: int
    gap: int
    tape: dict[int, int]


def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded integer knapsack: the best worth within each room, and the item that reaches it last (-1: none)."""
    best, item = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = sizes <= w
        got = best[w - sizes[fits]] + values[fits]
        j = int(got.argmax()) if len(got) else -1
        best[w], item[w] = (got[j], np.flatnonzero(fits)[j]) if j >= 0 and got[j] > best[w - 1] else (best[w - 1], -1)
    return best, item


def _taken(item: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """The items of the best pattern within a room."""
    pattern: dict[int, int] = {}
    while room > 0:
        if item[room] < 0:
            room -= 1
        else:
            pattern[int(item[room])] = pattern.get(int(item[room]), 0) + 1
            room -= int(sizes[item[room]])
    return pattern


def plan_uses(sizes: np.ndarray, demand: np.ndarray, room: int, cut_cost: float = CUT_COST, rounds: int = 3000, tolerance: float = 1e-3) -> list[Use]:
    """Patterns with how often each is used; together they hold the demand exactly.

    The linear program stops within `tolerance` of its optimum. What rounding
    errors may cost is fill: counts are checked against the demand. An infinite
    cut_cost cuts nothing.
    """
    n = len(sizes)
    if not n:
        return []
    basis: list[tuple[dict[int, int], int, int]] = [({i: room // int(sizes[i])}, 0, 0) for i in range(n)]  # items, gap, the gap's class
    each = (room // sizes).astype(float)
    inverse, used, cost = np.diag(1 / each), demand / each, np.ones(n)
    for _ in range(rounds):
        prices = np.maximum(cost @ inverse, 0)  # duals of the demands
        best, item = _knapsack(prices, sizes, room)
        densest = int((prices / sizes).argmax())
        filled = best[:room] + (room - np.arange(room)) * prices[densest] / sizes[densest]
        w = int(filled.argmax())
        cuts = filled[w] - (1 + cut_cost) > best[room] - 1
        if (filled[w] / (1 + cut_cost) if cuts else best[room]) <= 1 + tolerance:
            break
        column = (_taken(item, sizes, w), room - w, densest) if cuts else (_taken(item, sizes, room), 0, 0)
        holds = np.zeros(n)
        for i, c in column[0].items():
            holds[i] += c
        holds[column[2]] += column[1] / sizes[column[2]]
        step = inverse @ holds
        rising = step > 1e-9
        ratio = np.where(rising, used / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        used = used - ratio[out] * step
        used[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        basis[out], cost[out] = column, 1 + cut_cost if cuts else 1.0
    left, plan = demand.astype(np.int64).copy(), []
    for (pattern, gap, of), x in sorted(zip(basis, used, strict=True), key=lambda p: -p[1]):
        times = min([int(x + 1e-6), *(left[i] // c for i, c in pattern.items())])
        if times > 0:
            for i, c in pattern.items():
                left[i] -= c * times
            fill = min(int(times * gap // sizes[of]), int(left[of])) if gap else 0
            left[of] -= fill
            if not pattern:  # nothing but tape: no more sequences than it fills
                times = -(-fill * int(sizes[of]) // gap)
            if times:
                plan.append(Use(pattern, int(times), gap if fill else 0, {of: fill} if fill else {}))
    return plan + _rest(sizes, left, room, cut_cost)


def _rest(sizes: np.ndarray, left: np.ndarray, room: int, cut_cost: float) -> list[Use]:
    """What rounding left over: by first fit decreasing, or end to end where that saves more than cuts cost."""
    whole = np.where(sizes == room, left, 0)  # full sequences have nothing to cut
    short, plan = left - whole, []
    while left.sum():
        free, pattern = room, {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            c = min(int(left[i]), free // int(sizes[i]))
            if c:
                pattern[i] = c
                free -= c * int(sizes[i])
        times = min(int(left[i] // c) for i, c in pattern.items())
        plan.append(Use(pattern, times, 0, {}))
        for i, c in pattern.items():
            left[i] -= c * times
    ends = -(-int((short * sizes).sum()) // room)
    if sum(u.times for u in plan) - int(whole.sum()) <= (1 + cut_cost) * ends:
        return plan
    full = [Use({int(i): 1}, int(whole[i]), 0, {}) for i in np.flatnonzero(whole)]
    return [*full, Use({}, ends, room, {int(i): int(short[i]) for i in np.flatnonzero(short)})]


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """The plan without cuts: patterns (item index to count) with how often each is used."""
    return [(use.pattern, use.times) for use in plan_uses(sizes, demand, room, cut_cost=np.inf)]


def _ranges(plan: list[Use], classes: np.ndarray) -> list[tuple[int, ...]]:
    """For each class the ranks [low, high) that a pattern takes: its first sequence, how many of them a sequence holds, or (gap > 0) where on the tape they begin."""
    ranges, first, taken = [], 0, {int(c): 0 for c in classes}
    for pattern, times, gap, tape in plan:
        for i, each in pattern.items():
            c = int(classes[i])
            ranges.append((c, taken[c], taken[c] + each * times, first, each, 0, 0))
            taken[c] += each * times
        base = 0
        for i, n in tape.items():
            c = int(classes[i])
            ranges.append((c, taken[c], taken[c] + n, first, 1, base, gap))
            taken[c] += n
            base += n * c
        first += times
    return ranges


def _shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each CRC-32 turns into behind `size` zero bytes, without its own start and end: a product of GF(2) matrices, one for each bit of size."""
    columns = np.array([zlib.crc32(b"\0", 0) ^ zlib.crc32(b"\0", 1 << i) for i in range(32)], np.uint64)  # one zero byte
    apply = lambda columns, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1), columns, np.uint64(0)), axis=1)
    bit = 0
    while (size >> bit).any():
        crc = np.where((size >> bit) & 1, apply(columns, crc), crc)
        columns, bit = apply(columns, columns), bit + 1
    return crc


def part_crc(upto: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the last `size` bytes of what has the CRC-32 `upto`, when all before them has `before`."""
    return (upto.astype(np.uint64) ^ _shift(before.astype(np.uint64), size.astype(np.int64))).astype(np.int64)


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE, quantum: int = QUANTUM, bucket_rows: int = BUCKET_ROWS, cut_cost: float = CUT_COST) -> DataFrame:
    """The pieces, some of them cut, with sequence_id and offset. The pieces must be stored, as they are read several times, and made with the same quantum."""
    spark = cut_pieces.sparkSession
    sized = cut_pieces.withColumn("class", F.ceil(F.col("length") / quantum).cast("int"))
    counts = {r["class"]: r["count"] for r in sized.groupBy("class").count().collect()}  # at most sequence / quantum rows
    classes = np.array(sorted(counts), np.int64)
    plan = plan_uses(classes, np.array([counts[int(c)] for c in classes], float), sequence // quantum, cut_cost)
    # Each class's ranges in rank order, as arrays: at most two entries per pattern.
    table = spark.createDataFrame(_ranges(plan, classes) or [(0, 0, 0, 0, 1, 0, 0)], "class int, low long, high long, first long, each long, base long, gap long")
    table = table.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "each", "base", "gap"))).alias("ranges"))
    # Rank within a class: rank in a bucket, after the sizes of the buckets before it.
    buckets = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, 1 + n // bucket_rows)] or [F.lit(0), F.lit(1)])
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "start"), buckets[F.col("class")]).cast("int"))
    before = sized.groupBy("class", "bucket").count().select("class", "bucket", (F.sum("count").over(Window.partitionBy("class").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "copy", "start")))
    ranked = ranked.join(before, ["class", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    own = F.element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 1)
    placed = ranked.join(F.broadcast(table), "class").withColumn("own", own)
    placed = _cut_at_gaps(placed, quantum).drop("class", "bucket", "rank", "before", "ranges", "own")
    # A sequence holds `sequence` pieces at most.
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "copy", "start")
    placed = placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return placed.withColumn("offset", F.coalesce("offset", F.lit(0)))


def _cut_at_gaps(placed: DataFrame, quantum: int) -> DataFrame:
    """Pieces with their sequence; those on a tape as the parts that its gaps hold."""
    nth, taped = F.col("rank") - F.col("own.low"), F.col("own.gap") > 0
    at = F.col("own.base") + nth * F.col("class")
    gaps = F.when(taped, F.sequence(F.expr("at div nullif(own.gap, 0)"), F.expr("(at + class - 1) div nullif(own.gap, 0)"))).otherwise(F.array(F.expr("(rank - own.low) div own.each")))
    parts = placed.withColumn("at", at).withColumn("nth", F.explode(gaps))
    edge = lambda n: F.least(F.greatest(n * F.col("own.gap") - F.col("at"), F.lit(0)) * quantum, F.col("length"))
    parts = parts.withColumn("a", F.when(taped, edge(F.col("nth"))).otherwise(0)).withColumn("b", F.when(taped, edge(F.col("nth") + 1)).otherwise(F.col("length")))
    mark = lambda n: F.conv(F.hex(F.substring(F.col("marks"), (F.expr(f"{n} div {quantum}") - 1).cast("int") * 4 + 1, F.lit(4))), 16, 10).cast("long")
    upto = F.when(F.col("b") == F.col("length"), F.col("ids_crc32")).otherwise(mark("b"))

    @F.pandas_udf("long")
    def crc(upto: pd.Series, before: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(part_crc(upto.to_numpy(), before.to_numpy(), size.to_numpy()))

    parts = parts.withColumn("ids_crc32", crc(upto, F.when(F.col("a") == 0, 0).otherwise(mark("a")), F.when(F.col("a") == 0, 0).otherwise((F.col("b") - F.col("a")) * 4)))
    if "ids" in parts.columns:
        parts = parts.withColumn("ids", F.slice("ids", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")))
    parts = parts.withColumn("sequence_id", F.col("own.first") + F.col("nth")).withColumn("start", F.col("start") + F.col("a")).withColumn("length", F.col("b") - F.col("a"))
    return parts.drop("at", "nth", "a", "b", "marks")


def op5(docs: DataFrame) -> DataFrame:
    """op5's contract over a documents table."""
    return pack(cut(pieces(docs))).drop("copy")
