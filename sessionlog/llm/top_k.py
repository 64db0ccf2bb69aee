"""Exact top-k search by ball trees, one per shard of the vectors.

Vectors are dealt to shards by a hash of their id. A shard's ball tree is built
once and stored; a block of queries goes down it together, each to the nodes whose
upper bound on the inner product (centre's product plus radius times the query's norm)
isn't below its current kth score, and leaves meet them by matrix products. That score is
shared: a first pass searches each query's home shard only, and its kth score, a
lower bound of the final one, goes with the query to all other shards.

Queries meet shards in blocks: a task holds one shard's tree and one block of
queries, both of bounded size. Equal vectors are collapsed within a shard to
their k + 1 smallest ids, which is all that ties can ask for.

Components are floor(levels * x) as integers, so scores are exact; where products
could pass 2**62, which 64-bit sums don't hold, the search stops with an error.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; neither do rows with a null id; vectors of different lengths are
compared only with their equals in length; a repeated vec_id counts as one
candidate per distinct vector, none of them for a query of that id, and asks as one
query, with its least vector; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

LEVELS = 256
K = 5
QUERY_EVERY = 50
SHARD_ROWS = 20_000
BLOCK_QUERIES = 2_000
LEAF = 64
#: Below every score.
NONE = np.iinfo(np.int64).min


class BallTree:
    """A ball tree over integer vectors; nodes are ranges of a permutation."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        if len(vectors) and float(np.abs(vectors.astype(np.float64)).max()) ** 2 * vectors.shape[1] >= 2.0**62:
            raise OverflowError("components are too large for exact scores of 64 bits")
        self.order, self.nodes = np.arange(len(vectors)), []
        x = vectors.astype(np.float64)
        stack = [(0, len(vectors), -1)] if len(vectors) else []
        while stack:
            a, b, parent = stack.pop()
            own = self.order[a:b]
            centre = x[own].mean(axis=0)
            away = ((x[own] - centre) ** 2).sum(axis=1)
            node = len(self.nodes)
            far_off = float(np.sqrt(away.max()))
            self.nodes.append([centre, far_off + 1e-6 + 1e-9 * far_off, a, b, []])
            if parent >= 0:
                self.nodes[parent][4].append(node)
            if b - a <= leaf or away.max() == 0:
                continue
            one = x[own[away.argmax()]]
            far = ((x[own] - one) ** 2).sum(axis=1)
            two = x[own[far.argmax()]]
            side = x[own] @ (two - one)
            half = np.argsort(side, kind="stable")
            self.order[a:b] = own[half]
            stack += [(a, (a + b) // 2, node), ((a + b) // 2, b, node)]
        self.vectors = vectors

    def search(self, queries: np.ndarray, self_ids: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the k best scores >= least, and their ids, best first, ties to the smaller id; NONE where there are fewer.

        Queries go down the tree together. Each first scores the leaf that it comes to by
        the child with the higher bound, which raises its kth score; then nodes are visited
        with those queries whose bound isn't below theirs, and a leaf meets them in one product.
        """
        m = len(queries)
        best, found, least = np.full((m, k), NONE), np.full((m, k), NONE), least.astype(np.int64)
        if not m or not self.nodes:
            return best, found
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        largest = float(np.abs(self.vectors.astype(np.float64)).max())
        # Products in doubles are exact below 2**53; beyond that whole numbers are multiplied.
        exact = largest * float(np.abs(q).max()) * q.shape[1] < 2.0**53
        left, right = (self.vectors.astype(np.float64), q) if exact else (self.vectors, queries.astype(np.int64))
        # Rounding of the bound is covered by a margin far above it.
        rounding = 1e-3 + 1e-12 * norms * largest * q.shape[1]
        bounds = lambda i, own: q[own] @ self.nodes[i][0] + self.nodes[i][1] * norms[own] + rounding[own]

        def score(i: int, own: np.ndarray) -> None:
            members = self.order[self.nodes[i][2] : self.nodes[i][3]]
            scores, names = (right[own] @ left[members].T).astype(np.int64), ids[members]
            scores[names[None, :] == self_ids[own][:, None]] = NONE
            better = np.flatnonzero(scores.max(axis=1) >= least[own])
            own, scores = own[better], scores[better]
            scores[scores < least[own][:, None]] = NONE
            scores, names = np.hstack([best[own], scores]), np.hstack([found[own], np.broadcast_to(names, scores.shape)])
            # ~ turns the order round without overflow.
            first = np.lexsort((names, ~scores), axis=-1)[:, :k]
            best[own], found[own] = np.take_along_axis(scores, first, 1), np.take_along_axis(names, first, 1)
            least[own] = np.maximum(least[own], best[own, k - 1])

        seeds, stack = np.zeros(m, np.int64), [(0, np.arange(m))]
        while stack:
            i, own = stack.pop()
            if not self.nodes[i][4]:
                seeds[own] = i
                score(i, own)
                continue
            one, two = self.nodes[i][4]
            nearer = bounds(one, own) >= bounds(two, own)
            stack += [(j, part) for j, part in ((one, own[nearer]), (two, own[~nearer])) if len(part)]
        stack = [(0, np.arange(m))]
        while stack:
            i, own = stack.pop()
            own = own[(bounds(i, own) >= least[own]) & (seeds[own] != i)]
            if not len(own):
                continue
            below = self.nodes[i][4]
            if below:
                stack += [(j, own) for j in sorted(below, key=lambda j: bounds(j, own).mean())]
            else:
                score(i, own)
        found[best == NONE] = NONE
        return best, found


def _trees(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, shard, tree): the ball tree of each shard with its ids, pickled."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.int64)
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        # Of equal vectors, the k + 1 smallest ids, each once.
        _, same = np.unique(x, axis=0, return_inverse=True)
        own = pd.DataFrame({"same": same.ravel(), "id": ids})
        own = own[~own.duplicated()]
        own = own[own.groupby("same").cumcount() <= k]
        ids, x = ids[own.index], x[own.index]
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "shard": [part["shard"].iloc[0]], "tree": [pickle.dumps((ids, BallTree(x)), protocol=5)]})

    return vectors.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")


def _search_shard(k: int):  # noqa: ANN202
    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(trees) and len(queries):
            ids, tree = pickle.loads(trees["tree"].iloc[0])
            names, q = queries["query_id"].to_numpy(np.int64), np.stack(queries["v"].to_numpy()).astype(np.int64)
            if float(np.abs(q.astype(np.float64)).max()) * float(np.abs(tree.vectors.astype(np.float64)).max()) * q.shape[1] >= 2.0**62:
                raise OverflowError("components are too large for exact scores of 64 bits")
            best, found = tree.search(q, names, ids, k, queries["least"].to_numpy(np.int64))
            asked, at = np.nonzero(best != NONE)
            return pd.DataFrame({"query_id": names[asked], "vec_id": found[asked, at], "score": best[asked, at]})
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """vectors: vec_id, v array<long>; queries: query_id, v. Returns query_id, rank, vec_id, score."""
    queries = cut(queries.filter(F.size("v") > 0).groupBy("query_id").agg(F.min("v").alias("v")))
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_queries))
    deal = lambda column, parts: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    trees = cut(_trees(vectors.filter(F.size("v") > 0).withColumn("dim", F.size("v")).withColumn("shard", deal("vec_id", shards)), k))
    queries = queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("home", deal("query_id", shards))
    keys, schema = ["dim", "shard", "block"], "query_id long, vec_id long, score long"

    def searched(asked: DataFrame) -> DataFrame:
        spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search_shard(k), schema)

    first = cut(searched(queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(int(NONE)))))
    if shards > 1:
        floor = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        away = queries.join(floor, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(int(NONE)))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != home")
        first = first.unionByName(searched(away))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a shard at most
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(rows: DataFrame, vector: str = "embedding", levels: int = LEVELS) -> DataFrame:
    """(vec_id, v): components as floor(levels * x), rows without a finite vector left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    # Beyond 62 bits a component stands for one that the search refuses.
    most = float(1 << 62)
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * levels, F.lit(most)), F.lit(-most))).cast("long"))
    return rows.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def op9(embeddings: DataFrame) -> DataFrame:
    """op9's contract over an embeddings table."""
    vectors = cut(quantised(embeddings))
    return top_k(vectors, cut(vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id")))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
