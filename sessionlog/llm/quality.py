"""Quality scores by nearest-neighbour voting among labelled documents.

Documents become latent-semantic vectors: counts of byte trigrams in hashed
features, dampened and weighted by rarity, projected on the leading singular
directions of the labelled sample, at unit length. The sample, TRAIN_ROWS
labelled documents at most (those least by a hash), is fitted on the driver and
its vectors are broadcast: both have the bound of that parameter. Every document
is then compared with all of them, in blocks of exact cosine products; its
NEIGHBOURS nearest vote with their labels, weighted by similarity.

Defined cases: a null or empty text has no neighbours and gets the share of label
1 in the sample; without labelled rows that share is 0.5; labels that are null, or
without a document, don't count; repeated rows are scored each; ties among
neighbours go to the first of the sample; an empty table gives an empty result;
extra columns are ignored. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import chunks

TRAIN_ROWS = 4_000
FEATURES = 1 << 12
RANK = 64
NEIGHBOURS = 25
#: A neighbour's weight is its similarity, if positive, to this power.
SHARPNESS = 4
THRESHOLD = 0.3


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dampened trigram counts of each text: texts x FEATURES."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, FEATURES), np.float32)
    d = data.astype(np.uint32)
    code = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
    code = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(20)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    got = np.bincount(owner[:-2][inside] * FEATURES + code[inside], minlength=n * FEATURES)
    return np.log1p(got.reshape(n, FEATURES)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, rank: int = RANK) -> dict[str, np.ndarray]:
    """labelled: text and label (0 or 1). The model of the labelled sample."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                x = counts(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["label", "x"])

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(features, "label int, x binary").limit(train_rows).toArrow()
    y = rows.column("label").to_numpy().astype(np.float32)
    if not len(y):
        return {"weight": np.ones(FEATURES, np.float32), "axes": np.zeros((FEATURES, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": y}
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(len(y), FEATURES).astype(np.float32)
    order = np.lexsort(x[:, :64].T)  # the sample's order does not depend on how Spark delivers it
    x, y = x[order], y[order]
    weight = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(x * weight)
    draw = np.random.default_rng(7).standard_normal((FEATURES, min(rank + 16, len(y)))).astype(np.float32)
    q = draw
    for _ in range(3):  # randomised singular value decomposition
        q = np.linalg.qr(x.T @ (x @ q))[0]
    small = x @ q
    _, _, right = np.linalg.svd(small, full_matrices=False)
    axes = np.ascontiguousarray((q @ right.T)[:, :rank]).astype(np.float32)
    return {"weight": weight, "axes": axes, "vectors": _unit(x @ axes), "labels": y}


def score(docs: DataFrame, model: dict[str, np.ndarray], columns: list[str], text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """The columns, with score: the weighted share of label 1 among the nearest labelled documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    k = min(neighbours, len(model["labels"]))
    base = float(model["labels"].mean()) if k else 0.5

    def vote(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        m = shared.value
        out = np.full(len(offsets) - 1, base)
        z = (counts(data, offsets) * m["weight"]) @ m["axes"]
        some = np.flatnonzero((z * z).sum(axis=1) > 0)
        if not k or not len(some):
            return out
        near = _unit(z[some]) @ m["vectors"].T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        out[some] = np.where(total > 0, (weight * m["labels"][top]).sum(axis=1) / np.maximum(total, 1e-300), base)
        return np.clip(out, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "_text"):
                got = [vote(data[offsets[i] : offsets[min(i + 500, len(offsets) - 1)]], offsets[i : i + 501] - offsets[i]) for i in range(0, len(offsets) - 1, 500)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.concatenate(got))], [*columns, "score"])

    source = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", score double"
    return source.mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Texts and labels of at most train_rows labelled documents."""
    ids = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def _held_out(column: str = "doc_id"):  # noqa: ANN202
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op3's contract over documents and labels tables."""
    model = fit(sample(docs, labels.filter(~_held_out())))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "text")
    return score(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
