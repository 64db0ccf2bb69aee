"""Approximate nearest neighbours by balanced posting lists.

1. Lists. A bounded sample (SAMPLE_BYTES of vectors, by the order of a hash) is halved
   again and again across its widest direction, always in the middle, so lists are
   balanced where the data is dense; the means, brought to norm M, are the centroids.
2. Graph. Centroids are linked to near ones that no other link already leads to (the
   relative neighbourhood rule). A best-first walk over this graph, in memory and for
   many vectors at once, finds the centroids of a vector.
3. Postings. Every vector of the table goes to its nearest list and, when it lies at
   a boundary, to others whose distance is within (1 + CLOSURE) of the nearest one's and
   which are not on the far side of one already taken.
4. Search. A query's lists are those within (1 + PRUNE) of its nearest centroid's
   distance. Neighbouring lists lie together in groups of bounded size, a longer list
   in blocks; a task holds one of them and a block of queries. A query's own group is
   searched first, and its kth score there is the floor for what others return. A
   query that finds fewer than k rows in its lists meets all lists, so that it gets k.

Inner products become distances by one more component, sqrt(M^2 - |v|^2), M being the
largest norm; queries are scaled to norm M and get 0 there. Scores are sums of products
of the original components from left to right in double precision, so they don't
depend on how rows are dealt out.

Bounds: the broadcast centroids and links take at most MODEL_BYTES, so there are
at most that many lists and beyond it lists grow longer (in blocks), not the model.
The index holds every row. The measured recall is in the README.

Defined cases: vectors that are null, all zero, or hold null or non-finite components
take no part, nor do rows with a null id; vectors of different lengths are
compared only with their equals in length, each length has an index of its own; of
equal vectors a list needs, and keeps, the k + 1 smallest ids only; repeated rows
count once; a repeated vec_id is a candidate with each of its scores, none
of them for a query of that id, and asks with its least vector; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

K = 20
QUERY_EVERY = 20
#: Vectors of a list, on average, before replication.
LIST_ROWS = 128
SAMPLE_BYTES = 32 << 20
MODEL_BYTES = 16 << 20
#: Links of a centroid.
LINKS = 16
#: Lists that a vector is put into at most, and how much farther than the nearest they may be.
COPIES, CLOSURE = 3, 0.05
#: Lists that a query looks into are at most this much farther than the nearest; so many of them at most.
PRUNE, PROBES = 0.25, 256
#: Rows of a group of neighbouring lists, and queries that meet it at once.
GROUP_ROWS, BLOCK_QUERIES = 8192, 1024


def halved(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids of balanced lists: parts are halved until there are `lists` of them, the largest first by generations."""
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        out = []
        for i, own in enumerate(parts):
            if len(own) < 2 or len(out) + len(parts) - i >= lists:
                out.append(own)
                continue
            v = x[own]
            a = v[0]
            b = v[((v - a) ** 2).sum(axis=1).argmax()]
            half = len(own) // 2
            for _ in range(rounds):
                order = np.argsort(v @ (b - a), kind="stable")
                a, b = v[order[:half]].mean(axis=0), v[order[half:]].mean(axis=0)
            out += [own[order[:half]], own[order[half:]]]
        if len(out) == len(parts):
            break
        parts = out
    return np.stack([x[own].mean(axis=0) for own in parts])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def linked(c: np.ndarray, links: int = LINKS, near: int = 64) -> np.ndarray:
    """For each centroid the numbers of those it is linked to; -1 fills up. A chain over all keeps the graph in one piece."""
    n = len(c)
    out = np.full((n, links + 2), -1, np.int64)
    for a in range(0, n, 1024):
        d = distances(c[a : a + 1024], c)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        close = np.argsort(d, axis=1, kind="stable")[:, : min(near, n - 1)]
        for i, row in enumerate(close):
            between = distances(c[row], c[row])
            taken: list[int] = []
            for j in range(len(row)):
                # One that lies nearer to a taken link than to this centroid is reached through it.
                if len(taken) < links and not any(between[j, t] < d[i, row[j]] for t in taken):
                    taken.append(j)
            taken += [j for j in range(len(row)) if j not in taken][: links - len(taken)]
            out[a + i, : len(taken)] = row[taken]
    out[:, links] = (np.arange(n) + 1) % n
    out[:, links + 1] = (np.arange(n) - 1) % n
    return out


class Lists:
    """Centroids in memory, with the graph that finds them."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        self.radius = radius
        means = halved(raised(sample, radius), lists)
        length = np.sqrt((means * means).sum(axis=1))[:, None]
        # Vectors lie on a sphere, and so do the centroids, lest those of wide lists seem near to everything.
        self.centroids = np.where(length > 0, means * (radius / np.where(length > 0, length, 1)), means)
        self.links = linked(self.centroids)
        self.norms = (self.centroids**2).sum(axis=1)

    def nearest(self, x: np.ndarray, width: int, reach: float = np.inf, starts: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the `width` nearest centroids of each row, nearest first; none is opened that is farther than 1 + reach times the nearest."""
        n, c = len(x), len(self.centroids)
        width = min(width, c)
        own = (x * x).sum(axis=1)
        at = np.unique(np.linspace(0, c - 1, min(c, max(starts, width))).astype(np.int64))
        found = np.broadcast_to(at, (n, len(at)))
        dist = own[:, None] + self.norms[at] - 2 * x @ self.centroids[at].T
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        found, dist = np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)
        seen, rows = np.zeros((n, c), bool), np.arange(n)
        seen[:, at] = True
        opened = np.zeros(found.shape, bool)
        live = rows
        while len(live):
            # The nearest centroid of each row that isn't opened yet, until none is left among its `width` nearest.
            waiting = np.where(opened[live], np.inf, dist[live])
            pick = waiting.argmin(axis=1)
            far = waiting[np.arange(len(live)), pick]
            on = np.isfinite(far) & (far <= (1 + reach) ** 2 * np.maximum(dist[live, 0], 0) + 1e-12)
            live, pick = live[on], pick[on]
            if not len(live):
                break
            opened[live, pick] = True
            new = self.links[found[live, pick]]
            fresh = (new >= 0) & ~seen[live[:, None], new]
            fresh &= ~(np.triu(new[:, :, None] == new[:, None, :], 1) & fresh[:, :, None]).any(axis=1)
            seen[live[:, None], np.where(fresh, new, found[live, pick][:, None])] = True
            far = np.where(fresh, own[live, None] + self.norms[new] - 2 * np.einsum("nd,nkd->nk", x[live], self.centroids[new]), np.inf)
            both = np.concatenate([dist[live], far], axis=1)
            order = np.argsort(both, axis=1, kind="stable")[:, :width] if found.shape[1] >= width else np.argsort(both, axis=1, kind="stable")
            if order.shape[1] > found.shape[1]:
                grow = order.shape[1] - found.shape[1]
                found = np.concatenate([found, np.zeros((n, grow), np.int64)], axis=1)
                dist = np.concatenate([dist, np.full((n, grow), np.inf)], axis=1)
                opened = np.concatenate([opened, np.ones((n, grow), bool)], axis=1)
            names = np.take_along_axis(np.concatenate([found[live][:, : both.shape[1] - new.shape[1]], new], axis=1), order, 1)
            states = np.take_along_axis(np.concatenate([opened[live][:, : both.shape[1] - new.shape[1]], ~fresh], axis=1), order, 1)
            found[live], dist[live], opened[live] = names, np.take_along_axis(both, order, 1), states
        return found, np.sqrt(np.maximum(dist, 0))

    def postings(self, v: np.ndarray, copies: int, closure: float) -> list[list[int]]:
        """The lists of each vector: the nearest, and others at whose boundary it lies."""
        found, dist = self.nearest(raised(v, self.radius), max(16, 4 * copies))
        out = []
        for names, far in zip(found, dist, strict=True):
            near = far <= (1 + closure) * far[0] + 1e-12
            taken: list[int] = []
            for j, d in zip(names[near], far[near], strict=True):
                if len(taken) < copies and all(((self.centroids[j] - self.centroids[t]) ** 2).sum() > 0.5 * d * d for t in taken):
                    taken.append(int(j))
            out.append(taken)
        return out

    def probes(self, q: np.ndarray, prune: float, most: int) -> list[list[int]]:
        """The lists that each query looks into."""
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        found, dist = self.nearest(np.concatenate([q * (self.radius / length), np.zeros((len(q), 1))], axis=1), most, prune + 0.02)
        return [[int(j) for j in names[far <= (1 + prune) * far[0] + 1e-12]] for names, far in zip(found, dist, strict=True)]


def raised(v: np.ndarray, radius: float) -> np.ndarray:
    """Vectors with the component that brings them to norm `radius`."""
    return np.concatenate([v, np.sqrt(np.maximum(0, radius * radius - (v * v).sum(axis=1)))[:, None]], axis=1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from left to right."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * v[:, i]
    return out


def _search(k: int):  # noqa: ANN202
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The best k rows of each query in its lists of this group, those that reach its floor."""
        out = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(rows) or not len(asked):
            return out
        rows = rows.sort_values("list", kind="stable")
        ids, v = rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy())
        names, q = asked["query_id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy())
        floor = asked["least"].fillna(-np.inf).to_numpy(float)
        # Rounding can't exchange scores that differ by more than this.
        slack = 2e-13 * q.shape[1] * np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max())
        who = np.repeat(np.arange(len(asked)), asked["lists"].map(len))
        wanted = np.concatenate(asked["lists"].to_list())
        by_list = np.argsort(wanted, kind="stable")
        who, wanted = who[by_list], wanted[by_list]
        held, first = np.unique(rows["list"].to_numpy(), return_index=True)
        found = []
        for n, a, b in zip(held, first, [*first[1:], len(rows)], strict=True):
            own = who[np.searchsorted(wanted, n) : np.searchsorted(wanted, n, "right")]
            scores = q[own] @ v[a:b].T
            scores[names[own][:, None] == ids[None, a:b]] = -np.inf
            least = floor[own]
            if b - a > k:
                least = np.maximum(least, np.partition(scores, b - a - k, axis=1)[:, b - a - k])
            i, j = np.nonzero((scores >= (least - slack[own])[:, None]) & np.isfinite(scores))
            found.append((own[i], a + j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        best = pd.DataFrame({"query_id": names[i], "vec_id": ids[j], "score": products(q[i], v[j])})
        best = best[best["score"].to_numpy() >= floor[i]].drop_duplicates()
        best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return best[best.groupby("query_id").cumcount() < k]

    return run


def _block(name: str, size: Column) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(7)), size).cast("int")


def _searched(postings: DataFrame, asked: DataFrame, k: int, group_rows: int, block_queries: int) -> DataFrame:
    """postings: part, list, vec_id, v; asked: part, lists, query_id, v, least. Each group of lists, in blocks of rows if a list is long, is met by blocks of its queries."""
    sizes = postings.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / (2 * group_rows)).cast("int").alias("row_blocks"))
    wanted = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("query_blocks"))
    sizes = F.broadcast(cut(sizes.join(wanted, "part")))  # no more rows than lists, whose number MODEL_BYTES bounds
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = postings.join(sizes, "part").withColumn("rb", _block("vec_id", F.col("row_blocks"))).withColumn("qb", each("query_blocks")).select("part", "rb", "qb", "list", "vec_id", "v")
    qs = asked.join(sizes, "part").withColumn("qb", _block("query_id", F.col("query_blocks"))).withColumn("rb", each("row_blocks")).select("part", "rb", "qb", "query_id", "v", "lists", "least")
    keys = ["part", "rb", "qb"]
    return rows.groupBy(*keys).cogroup(qs.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query; replicas of a row count once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fitted(vectors: DataFrame, dim: int, n: int, radius: float, list_rows: int) -> Lists:
    """The lists of all vectors of one length, from a sample of at most SAMPLE_BYTES."""
    rows = max(1, min(n, SAMPLE_BYTES // (8 * dim)))
    sample = vectors.select("v").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(rows).toPandas()
    most = max(1, MODEL_BYTES // (8 * (dim + 2 + LINKS + 2)))
    return Lists(np.stack(sample["v"].to_numpy()).astype(float), max(1, min(math.ceil(n / list_rows), most, len(sample))), radius)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, list_rows: int = LIST_ROWS, copies: int = COPIES, closure: float = CLOSURE,
    prune: float = PRUNE, probes: int = PROBES, group_rows: int = GROUP_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """vectors: vec_id, v array<double>, finite; queries: query_id, v. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "v").distinct()
    alike = Window.partitionBy("v").orderBy("vec_id")  # all but k + 1 leave before the exchange
    rows = cut(rows.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).select("vec_id", "v", F.size("v").alias("dim")))
    queries = cut(queries.groupBy("query_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    found = None
    for dim, n, radius in rows.groupBy("dim").agg(F.count(F.lit(1)), F.max(norm)).orderBy("dim").collect():  # a row a length of vectors
        own, asked = rows.filter(F.col("dim") == dim).select("vec_id", "v"), queries.filter(F.col("dim") == dim).select("query_id", "v")
        model = spark.sparkContext.broadcast(fitted(own, dim, n, radius, list_rows))

        def post(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for part in _small(batches):
                lists = model.value.postings(np.stack(part["v"].to_numpy()), copies, closure)
                out = part.loc[part.index.repeat([len(x) for x in lists])]
                yield out.assign(list=np.concatenate([np.asarray(x, np.int32) for x in lists]))

        postings = cut(own.mapInPandas(post, "vec_id long, v array<double>, list int"))
        # Neighbouring lists go into groups of about group_rows rows; there are no more of them than MODEL_BYTES lets.
        counts = np.zeros(len(model.value.centroids), np.int64)
        for row in postings.groupBy("list").count().collect():
            counts[row["list"]] = row["count"]
        group_of = ((np.cumsum(counts) - counts) // group_rows).astype(np.int32)
        groups = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(counts), dtype=np.int32), "part": group_of}), "list int, part int"))
        postings = postings.join(groups, "list")

        def look(batches: Iterator[pd.DataFrame], every: bool, model=model, group_of=group_of) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for part in _small(batches):
                ids, v = part["query_id"].to_numpy(), part["v"].to_numpy()
                lists = [list(range(len(group_of)))] * len(part) if every else model.value.probes(np.stack(v), prune, probes)
                out = []
                for i, own_lists in enumerate(lists):
                    own_lists = np.asarray(own_lists, np.int32)
                    for p in np.unique(group_of[own_lists]):
                        out.append((ids[i], v[i], p, own_lists[group_of[own_lists] == p], p == group_of[own_lists[0]]))
                yield pd.DataFrame(out, columns=["query_id", "v", "part", "lists", "home"])

        schema, tasks = "query_id long, v array<double>, part int, lists array<int>, home boolean", spark.sparkContext.defaultParallelism
        looked = cut(asked.repartition(tasks, "query_id").mapInPandas(lambda b, look=look: look(b, False), schema))
        # A query's own group first: its kth score there is a floor for what other groups return.
        none = F.lit(None).cast("double").alias("least")
        first = cut(_searched(postings, looked.filter("home").select("*", none), k, group_rows, block_queries))
        floor = _best(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        others = looked.filter("NOT home").join(floor, "query_id", "left")
        hits = cut(_best(first.unionByName(_searched(postings, others, k, group_rows, block_queries)), k))

        copies_of = own.groupBy(F.col("vec_id").alias("query_id")).agg(F.count(F.lit(1)).alias("own"))
        got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
        short = asked.join(copies_of, "query_id", "left").join(got, "query_id", "left")
        short = cut(short.filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.coalesce("own", F.lit(0)))).select("query_id", "v"))
        if not short.isEmpty():
            every = short.mapInPandas(lambda b, look=look: look(b, True), schema).select("*", none)
            again = _best(_searched(postings, cut(every), k, group_rows, block_queries), k)
            hits = hits.join(short, "query_id", "left_anti").unionByName(again)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return found.select("query_id", "rank", "vec_id", "score")


def _small(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows].reset_index(drop=True)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): finite vectors that aren't zero, in double precision."""
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0), F.lit(False))
    return rows.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def op12(embeddings: DataFrame) -> DataFrame:
    """op12's contract over an embeddings table."""
    vectors = cut(usable(embeddings))
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id"))
