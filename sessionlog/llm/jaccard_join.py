r"""N-gram Jaccard join in the metric space of shingle sets.

Two documents link when the Jaccard distance of their shingle sets is at most
EPS = 1 - PERCENT / 100. Documents with equal sets form one class; only classes
are joined, exactly:

1. Pivots. Almost all documents lie at distance near 1 from any given one, where
   the triangle inequality rules nothing out; so the first pivots are taken from
   real neighbourhoods, which a rendezvous finds. In the order of hashes, linked
   sets of n shingles share at least l of their first n - ceil(n * PERCENT / 100)
   + l. A class with fewer than l shingles there that any other class has is linked
   with nothing and leaves. Of these shared shingles each class drops its l - 1
   most frequent, whereupon two linked classes still have one in common; the
   smallest class of a shingle is the pivot of all its classes, which together
   are the pivot's neighbourhood.
2. Regions. Each neighbourhood is divided by its first pivot and others far from
   it: a class lives in the Voronoi region of its nearest pivot, at distance d. By
   the triangle inequality a linked class may live only in regions whose pivot is
   within d + 2 * EPS, and within the region's radius + EPS: those windows get a
   copy of it, unless it is in one component with all that live there already, for
   classes within EPS of a pivot are linked with it at once.
3. Recursion. A region whose classes are all in one component is finished; others
   are divided again by pivots of their own, down to a few classes, which are
   compared within the window of sizes that the threshold leaves, as are regions
   that pivots do not divide. Neighbourhoods that fit a task are divided inside it;
   larger ones are divided by Spark, and where pivots don't divide them they meet
   block by block.

Links that matter are kept, not all pairs, and components come of these. Hashes
of shingles have 64 bits, keys of classes 128.

Defined cases: a text with fewer words than a shingle has its whole sequence as
one; one without words has an empty set and is its own component; rows with
equal doc_id are one document in its component; a null doc_id makes no links, but
has the component of documents with an equal set, if there are any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bitmap import BITMAP_BITS, Screen
from ._store import cut, discard
from ._words import Words, chunks, mix, windows
from .components import components

SHINGLE = 4
PERCENT = 85
#: Share of a set, in percent, by which the rendezvous prefix is longer than needed.
EXTRA = 8
PIVOTS = 16
#: Regions of so few classes are compared directly.
LEAF = 8
#: Hashes that one neighbourhood inside a task may hold, and about those of a task's small ones together.
CELL_HASHES = 1 << 19
TASK_HASHES = 1 << 17
LEVELS = 6
_KEY = np.uint64(0x8CB92BA72F3D8DD7)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n * EXTRA // 100)


def _sets(words: Words, shingle: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h = words.hashes()
    all_ = windows(h, shingle)
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= shingle:
            yield np.unique(all_[a : b - shingle + 1])
        else:
            yield windows(h[a:b], b - a) if b > a else h[:0]


def _keys(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, the sums of two mixed hashes of its members."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ _KEY).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + _KEY).sum(dtype=np.uint64).astype(np.int64))


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def shingle_sets(docs: DataFrame, text: str, shingle: int, percent: int, what: str, screen: Screen | None = None, only: Screen | None = None) -> DataFrame:
    """what = 'keys': doc_id, n, k1, k2. 'prefix': doc_id, n, k1, hash for each of a set's first. 'hashes': hash alone of these. 'sets': keys and hashes.

    only: the documents whose doc_id it holds. screen: prefixes keep the hashes it holds, and
    those that hold too few for a link are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(only(_ids(batch.column(0)))))
            for part, data, offsets in chunks(batch, "text"):
                sets = list(_sets(Words(data, offsets, lower=True), shingle))
                n = np.array([len(s) for s in sets], np.int64)
                keys = [_keys(s) for s in sets]
                columns = [part.column(0), pa.array(n), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
                if what in ("prefix", "hashes"):
                    m = np.where(n > 0, np.minimum(n, n - _needed(n, percent) + _extra(n)), 0)
                    at, flat = np.repeat(np.arange(len(n)), m), np.concatenate([s[:k] for s, k in zip(sets, m.tolist(), strict=True)])
                    if screen is not None:
                        some = screen(flat)
                        some &= (np.bincount(at[some], minlength=len(n)) >= _extra(n))[at]
                        at, flat = at[some], flat[some]
                    columns = [c.take(pa.array(at)) for c in columns[: 3 * (what == "prefix")]] + [pa.array(flat.view(np.int64))]
                elif what == "sets":
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = {"keys": "doc_id long, n long, k1 long, k2 long", "prefix": "doc_id long, n long, k1 long, hash long", "hashes": "hash long", "sets": "doc_id long, n long, k1 long, k2 long, hashes array<long>"}[what]
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


class _Neighbourhood:
    """The classes of one neighbourhood, in memory: finds links that connect all its linked classes."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        order = np.lexsort((ids, [len(s) for s in sets]))
        self.ids, sets = ids[order], [sets[i] for i in order]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        universe, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        # The classes that hold each shingle.
        self.held = np.repeat(np.arange(len(self.n)), self.n)[np.argsort(self.flat, kind="stable")]
        self.df = np.bincount(self.flat, minlength=len(universe))
        self.held_from = np.cumsum(self.df) - self.df
        self.mark = np.zeros(len(universe), bool)
        self.percent, self.eps = percent, 1 - percent / 100
        self.root = np.arange(len(self.n))
        self.links: list[tuple[int, int, int]] = []

    def _shared(self, i: int, own: np.ndarray) -> np.ndarray:
        """How many shingles class i shares with each of own."""
        mine, n = self.flat[self.first[i] : self.first[i + 1]], self.n[own]
        if n.sum() > self.df[mine].sum():
            return np.bincount(self._holders(mine), minlength=len(self.n))[own]
        starts = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.first[own] - starts, n)
        self.mark[mine] = True
        out = np.add.reduceat(self.mark[self.flat[at]], starts, dtype=np.int64)
        self.mark[mine] = False
        return out

    def _holders(self, shingles: np.ndarray) -> np.ndarray:
        """The classes that hold each of the shingles, one after the other."""
        many = self.df[shingles]
        at = np.arange(int(many.sum())) + np.repeat(self.held_from[shingles] - (np.cumsum(many) - many), many)
        return self.held[at]

    def _may_link(self, i: int) -> np.ndarray:
        """Whether each class holds one of so many of i's rarest shingles that a linked one can't lack them all."""
        mine = self.flat[self.first[i] : self.first[i + 1]]
        rare = mine[np.argsort(self.df[mine], kind="stable")[: len(mine) - int(_needed(len(mine), self.percent)) + 1]]
        out = np.zeros(len(self.n), bool)
        out[self._holders(rare)] = True
        return out

    def _link(self, i: int, own: np.ndarray, shared: np.ndarray, level: int) -> np.ndarray:
        linked = 100 * shared >= self.percent * (self.n[i] + self.n[own] - shared)
        for j in own[linked].tolist():
            if self.root[j] != self.root[i]:
                self.root[self.root == self.root[j]] = self.root[i]
                self.links.append((int(self.ids[i]), int(self.ids[j]), level))
        return linked

    def _compare(self, own: np.ndarray, level: int, away: np.ndarray | None = None) -> None:
        """Every two of own, in order of size, within the windows that the threshold leaves and not yet in one component.

        The windows are of size and, given distances to pivots, of these: by the triangle
        inequality those of linked classes differ by EPS at most. What is left must hold
        some of the rarer shingles.
        """
        order = np.argsort(own, kind="stable")
        own, away = own[order], None if away is None else away[:, order]
        end = np.searchsorted(self.n[own] * self.percent, self.n[own] * 100, "right")
        for k, i in enumerate(own.tolist()):
            near = np.arange(k + 1, int(end[k]))
            near = near[self.root[own[near]] != self.root[i]]
            if away is not None and len(near):
                near = near[(np.abs(away[:, near] - away[:, [k]]) <= self.eps + 1e-9).all(axis=0)]
            if len(near):
                near = near[self._may_link(i)[own[near]]]
            if len(near):
                self._link(i, own[near], self._shared(i, own[near]), level)

    def join(self, own: np.ndarray, level: int = 0) -> None:
        """Divide own by pivots into Voronoi regions with their windows, and join each."""
        if (self.root[own] == self.root[own[0]]).all():
            return
        if len(own) <= LEAF:
            return self._compare(own, level)
        pivots, away, nearest = [int(own[self.ids[own].argmin()])], [], np.full(len(own), np.inf)
        while True:
            shared = self._shared(pivots[-1], own)
            self._link(pivots[-1], own, shared, level)
            away.append(1 - shared / (self.n[own] + self.n[pivots[-1]] - shared))
            nearest = np.minimum(nearest, away[-1])
            # The next pivot is the class farthest from all so far; one within EPS of them would divide nothing.
            k = int(nearest.argmax())
            if len(pivots) >= min(PIVOTS, 2 + len(own) // LEAF) or nearest[k] <= self.eps:
                break
            pivots.append(int(own[k]))
        d = np.array(away)
        home = d.argmin(axis=0)
        parts = []
        for p in range(len(pivots)):
            lives = home == p
            radius = d[p][lives].max(initial=0.0)
            window = d[p] <= np.minimum(nearest + 2 * self.eps, radius + self.eps) + 1e-9
            if (kind := np.unique(self.root[own[lives]])).size == 1:  # one component lives here: its own need no copy
                window &= self.root[own] != kind[0]
            if (lives | window).sum() > 1:
                parts.append(own[lives | window])
        if sum(map(len, parts)) > 3 * len(own) or max(map(len, parts), default=0) > 0.9 * len(own):
            return self._compare(own, level, d)
        for part in parts:
            self.join(part, level + 1)


def join_in_memory(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int, int]]:
    """Links (u, v, level of division) that connect all linked classes of one neighbourhood."""
    own = _Neighbourhood(ids, sets, percent)
    own.join(np.arange(len(ids)))
    return own.links


_LINKS = "u long, v long, level int"


def _leaves(members: DataFrame, percent: int, base: int = 0) -> DataFrame:
    """members: task, cell, sid, hashes. Links within cells, each of which a task can hold."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, own in part.groupby("cell", sort=False):
            if len(own) > 1:
                own = own.drop_duplicates("sid")
                found = join_in_memory(own["sid"].to_numpy(np.int64), [np.asarray(x, np.int64).view(np.uint64) for x in own["hashes"]], percent)
                out += [(u, v, base + level) for u, v, level in found]
        return pd.DataFrame(out, columns=["u", "v", "level"]).astype({"u": "int64", "v": "int64", "level": "int32"})

    return members.select("task", "cell", "sid", "hashes").groupBy("task").applyInPandas(run, _LINKS)


def _of(sets: DataFrame, sids: DataFrame) -> DataFrame:
    """The sets of these sids, stored, and by chance some more: they are told by a bitmap, so that the others aren't shuffled."""
    among = Screen(sids.select(F.col("sid").alias("cell")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(_ids(batch.column(0)))))

    return cut(sets.select("sid", "hashes").mapInArrow(run, "sid long, hashes array<long>"))


def _divided(members: DataFrame, found: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Classes of large cells in the Voronoi regions of pivots and in windows of others: cell, sid, n. And their links with pivots."""
    eps = 1 - percent / 100
    drawn = Window.partitionBy("cell").orderBy(F.xxhash64("sid", F.lit(level)), "sid")
    pivots = members.withColumn("pivot", F.row_number().over(drawn)).filter(F.col("pivot") <= PIVOTS).select("cell", "pivot", F.col("sid").alias("p"), F.col("n").alias("pn"), F.col("hashes").alias("ph"))
    pairs = members.join(cut(pivots), "cell").withColumn("shared", F.size(F.array_intersect("hashes", "ph")))
    pairs = pairs.withColumn("d", 1 - F.col("shared") / (F.col("n") + F.col("pn") - F.col("shared")))
    linked = 100 * F.col("shared") >= percent * (F.col("n") + F.col("pn") - F.col("shared"))
    pairs = cut(pairs.select("cell", "sid", "n", "pivot", "p", "d", linked.alias("linked")))
    links = pairs.filter("linked AND sid != p").select(F.col("sid").alias("u"), F.col("p").alias("v"), F.lit(level).alias("level"))
    links = cut(links)
    parts = cut(components(found.select("u", "v").unionByName(links.select("u", "v"))))
    pairs = pairs.join(parts.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("of", F.coalesce("component", "sid")).drop("component")
    homes = pairs.groupBy("cell", "sid").agg(F.min(F.struct("d", "pivot")).alias("home"))
    placed = cut(pairs.join(homes, ["cell", "sid"]))
    lives = placed.filter("pivot = home.pivot").groupBy("cell", "pivot").agg(F.max("d").alias("radius"), F.min("of").alias("a"), F.max("of").alias("b"))
    near = placed.join(lives, ["cell", "pivot"])
    # Where one component lives, its own need no copy.
    window = (F.col("d") <= F.least(F.col("home.d") + 2 * eps, F.col("radius") + eps) + 1e-9) & ~((F.col("a") == F.col("b")) & (F.col("of") == F.col("a")))
    near = near.filter((F.col("pivot") == F.col("home.pivot")) | window).withColumn("region", F.xxhash64("cell", "pivot", F.lit(level)))
    alive = near.groupBy("region").agg(F.min("of").alias("a"), F.max("of").alias("b")).filter("a < b").select("region")
    return near.join(alive, "region").select("cell", "sid", "n", "region"), links


def links_in_cells(cells: DataFrame, sets: DataFrame, percent: int, cell_hashes: int = CELL_HASHES, task_hashes: int = TASK_HASHES, levels: int = LEVELS) -> DataFrame:
    """cells: cell, sid, n. sets: sid, hashes, stored. Links (u, v, level) that connect all linked classes that share a cell."""
    spark = cells.sparkSession
    out = spark.createDataFrame([], _LINKS)
    keep_whole = spark.createDataFrame([], "cell long")
    stored: list[DataFrame] = []
    for level in range(levels + 1):
        sizes = cut(cells.groupBy("cell").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("many")).filter("many > 1"))
        small = sizes.filter(F.col("held") <= cell_hashes)
        tasks = 1 + (small.agg(F.sum("held")).first()[0] or 0) // task_hashes
        dealt = cells.join(small.select("cell", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int").alias("task")), "cell")
        out = out.unionByName(cut(_leaves(dealt.join(sets, "sid"), percent, level)))
        large = cut(sizes.filter(F.col("held") > cell_hashes).select("cell", "held"))
        if large.isEmpty():
            break
        # Only large cells go on, so only their sets are shuffled from here.
        sets = _of(sets, cells.join(large, "cell", "left_semi"))
        stored.append(sets)
        # Every two blocks of a cell that pivots don't divide meet in a task.
        whole = large if level == levels else large.join(keep_whole, "cell", "left_semi")
        if (level or not levels) and not whole.isEmpty():
            blocks = cells.join(whole.select("cell", F.ceil(2 * F.col("held") / cell_hashes).cast("int").alias("blocks")), "cell")
            blocks = blocks.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            met = blocks.withColumn("cell", F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")))
            met = met.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(1 << 20)).cast("int"))
            out = out.unionByName(cut(_leaves(met.join(sets, "sid"), percent, level)))
            large = cut(large.join(whole.select("cell"), "cell", "left_anti"))
        if level == levels or large.isEmpty():
            break
        members = cut(cells.join(large.select("cell"), "cell").join(sets, "sid").select("cell", "sid", "n", "hashes"))
        stored.append(members)
        parts, links = _divided(members, out, percent, level)
        parts = cut(parts)
        out = out.unionByName(links)
        # Where the windows take in nearly everything, or several times the cell, pivots don't divide it.
        grown = parts.groupBy("cell", "region").agg(F.sum("n").alias("held")).groupBy("cell").agg(F.sum("held").alias("all"), F.max("held").alias("most"))
        stuck = grown.join(large, "cell").filter((F.col("all") > 3 * F.col("held")) | (F.col("most") > 0.9 * F.col("held"))).select("cell")
        stuck = cut(stuck)
        undivided = cells.join(stuck, "cell", "left_semi")
        divided = parts.join(stuck, "cell", "left_anti").select(F.col("region").alias("cell"), "sid", "n")
        cells, keep_whole = cut(divided.unionByName(undivided.select("cell", "sid", "n"))), stuck
    discard(*stored)
    return out


def jaccard_join(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, cell_hashes: int = CELL_HASHES, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (smallest doc_id of the equal sets), component_id."""
    rows = cut(shingle_sets(docs, text, shingle, percent, "keys"))
    known, real = docs.filter("doc_id IS NOT NULL"), rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("sid"), F.max("n").alias("n")))
    # Where doc_ids are unique they alone go with the hashes, else a key of the set too.
    unique = real.groupBy("doc_id").count().filter("count > 1").isEmpty()
    own = ["doc_id"] if unique else ["doc_id", "k1"]
    firsts = Screen(classes.select(F.col("sid").alias("cell")), bitmap_bits)
    # Shingles of the prefixes that at least two different sets have. A class counts once, by its smallest document, or a few times more where the bitmap lets others pass.
    if unique:
        shared = shingle_sets(known, text, shingle, percent, "hashes", only=firsts).groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    else:
        prefix = shingle_sets(known, text, shingle, percent, "prefix", only=firsts).groupBy("hash").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.count(F.lit(1)).alias("df"))
        shared = prefix.filter("a != b").select("hash", "df")
    shared = cut(shared)
    # As stored tables what is joined has exchanges of its own, so that Spark splits the joins where a shingle is frequent.
    held = shingle_sets(known, text, shingle, percent, "prefix", Screen(shared.select(F.col("hash").alias("cell")), bitmap_bits), firsts).select(*own, "hash").join(shared, "hash")
    held = held.repartition("doc_id").groupBy(*own).agg(F.collect_set(F.struct("df", "hash")).alias("held"))  # part of one set
    held = held.join(classes.select(F.col("sid").alias("doc_id"), "k1", "n"), own)
    extra = F.greatest(F.lit(1), F.floor(F.col("n") * EXTRA / 100)).cast("int")
    held = held.filter(F.size("held") >= extra)
    kept = F.transform(F.slice(F.array_sort("held"), F.lit(1), F.size("held") - extra + 1), lambda x: x["hash"])
    anchors = cut(held.select("doc_id", "k1", "n", kept.alias("anchor")))
    each = anchors.select(F.col("doc_id").alias("sid"), "n", F.explode("anchor").alias("hash"))
    pivot = cut(each.groupBy("hash").agg(F.min("sid").alias("cell"), F.max("sid").alias("last")).filter("cell < last").drop("last"))
    cells = cut(each.join(pivot, "hash").groupBy("cell", "sid").agg(F.max("n").alias("n")))
    needed = cut(cells.select(F.col("sid").alias("doc_id")).distinct())
    sets = shingle_sets(known, text, shingle, percent, "sets", only=Screen(needed.select(F.col("doc_id").alias("cell")), bitmap_bits))
    if not unique:
        sets = sets.join(anchors.select("doc_id", "k1").distinct(), ["doc_id", "k1"], "left_semi").dropDuplicates(["doc_id", "k1"])
    sets = cut(sets.select(F.col("doc_id").alias("sid"), "hashes"))
    discard(shared, anchors, pivot, needed)
    found = components(links_in_cells(cells, sets, percent, cell_hashes))
    classes = classes.join(found, classes.sid == found.node, "left").select("k1", "k2", "sid", F.coalesce("component", "sid").alias("component"))
    out = rows.join(cut(classes), ["k1", "k2"], "left")
    discard(cells, sets)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("sid", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def op7(docs: DataFrame) -> DataFrame:
    """op7's contract over a documents table."""
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")
