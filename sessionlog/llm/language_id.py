r"""Language identification by fusing evidence in one posterior.

A document's evidence is its text (byte trigrams under a naive Bayes model), the
language its markup declares, the language its address names in a path segment, and
its host. Host priors are smoothed in levels: a grouped aggregate of the documents'
own posteriors gives each host's counts, drawn towards its domain's, drawn towards
those of its address suffix (such as a country's), drawn towards all documents'.
Missing evidence says nothing.

The text model is fitted on TRAIN_ROWS distinct labelled texts of each language at
most, those least by a hash; all else is over all rows, and every language that any
row is labelled with takes part (the model has 64 KB for each). A document adds its
posterior to its host's counts, in units of 1 / 2**20, without shares below LITTLE.
Counts of hosts are combined before the exchange; hosts are joined, not broadcast.

Defined cases: a null, empty or very short text has no text evidence; a document
with no text evidence, or whose best language has a posterior below LEAST, is not
accepted; null hosts share one prior; repeated rows are identified each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, discard
from ._words import LOWER, chunks

TRAIN_ROWS = 1_000
#: Most chosen texts that are broadcast, by two numbers each.
CHOSEN = 1_000_000
FEATURES = 1 << 14
#: The text counts as this many independent trigrams at most.
EVIDENCE = 60
DECLARED_TRUST, PATH_TRUST, HOST_WEIGHT, LEAST = 0.9, 0.8, 20.0, 0.5
UNIT, LITTLE = 1 << 20, 0.001


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each trigram of lower-cased bytes, and where each text's begin."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    d = LOWER[data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(n)])
    code = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
    code = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int64)
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # those that would cross into the next text
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(code))]] = False
    return code[inside], np.concatenate([[0], np.cumsum(n)])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each trigram feature in each."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(FEATURES, np.int64)
        for t in part["text"]:
            raw = np.frombuffer(t.encode(), np.uint8)
            total += np.bincount(_trigrams(raw, np.array([0, len(raw)]))[0], minlength=FEATURES)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [total.tobytes()]})

    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("tag", F.xxhash64("text"))
    texts = cut(rows.groupBy("lang", "tag").agg(F.count(F.lit(1)).alias("many")))
    most = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
    # A row a language, fewer bytes than the model has for it, is broadcast. A hash threshold leaves about twice what is wanted, so that no language's texts all meet.
    hashed = texts.select("lang", "tag").join(F.broadcast(most), "lang").filter(F.pmod(F.xxhash64("tag"), F.lit(1 << 30)) * F.col("many") < 2 * train_rows * (1 << 30))
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("tag"), "tag")
    chosen = cut(hashed.withColumn("i", F.row_number().over(drawn)).filter(F.col("i") <= train_rows).select("lang", "tag"))
    few = chosen.count() <= CHOSEN  # else a join as Spark sees fit
    sample = rows.join(F.broadcast(chosen) if few else chosen, ["lang", "tag"]).groupBy("lang", "tag").agg(F.max("text").alias("text"))
    found = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in sample.groupBy("lang").applyInPandas(count, "lang string, counts binary").collect()}
    names = sorted(found)
    smooth = [np.log((found[x] + 0.5) / (found[x].sum() + 0.5 * FEATURES)) for x in names]
    discard(texts, chosen)
    return names, np.array(smooth, np.float32).reshape(len(names), FEATURES)


def text_evidence(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str], text: str = "text") -> DataFrame:
    """The columns, with n_trigrams and evidence, the text's log-likelihood in each language."""
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))  # 64 KB a language
    most = max(1 << 16, (4 << 20) // max(4, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, text, most):
                code, first = _trigrams(data, offsets)
                n = np.diff(first)
                out = np.zeros((len(n), len(names)))
                if len(code):
                    some = n > 0
                    out[some] = np.add.reduceat(shared.value[code], first[:-1][some], axis=0, dtype=np.float64)
                out *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                at = pa.array((np.arange(len(n) + 1) * len(names)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(n), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], [*columns, "n_trigrams", "evidence"])

    source = docs.withColumn(text, F.col(text).cast("string")).select(*dict.fromkeys([*columns, text]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(columns)]) + ", n_trigrams long, evidence array<double>"
    return source.mapInArrow(run, schema)


def _said(column: Column, names: list[str], trust: float) -> Column:
    """Log-likelihoods of a language that markup or address names, one a language; nothing where it is unknown."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, names)), column), F.lit(0))
    rest = float(np.log((1 - trust) / max(1, len(names) - 1)))
    return F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.when(place == 0, 0.0).when(place == i, float(np.log(trust))).otherwise(rest))


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for x in arrays[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def _posterior(logs: Column) -> Column:
    top = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda a, b: a + b))


LEVELS = ("_suffix", "_domain", "_host")


def _smoothed(counts: DataFrame, languages: int) -> DataFrame:
    """(LEVELS, prior): log priors of each host, drawn towards its domain's, its suffix's and all documents'. counts: LEVELS, i, own."""
    total = {r["i"]: r["own"] / UNIT for r in counts.groupBy("i").agg(F.sum("own").alias("own")).collect()}  # a number a language
    every = sum(total.values())
    prior = F.array(*[F.lit((total.get(i, 0.0) + 1) / (every + languages)) for i in range(languages)])
    out, keys = None, []
    for level in LEVELS:
        keys = [*keys, level]
        own = counts.groupBy(*keys, "i").agg((F.sum("own") / UNIT).alias("own")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "own"))).alias("own"), F.sum("own").alias("all"))  # a language an entry
        rows = own.withColumn("above", prior) if out is None else own.join(out.withColumnRenamed("prior", "above"), keys[:-1])
        drawn = F.transform("above", lambda p, i: (F.coalesce(F.element_at("own", i), F.lit(0.0)) + HOST_WEIGHT * p) / (F.col("all") + HOST_WEIGHT))
        out = rows.select(*keys, drawn.alias("prior"))
    return out.withColumn("prior", F.transform("prior", lambda p: F.log(p)))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str], text: str, declared: Column | None = None, path: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """The columns, with language, confidence, n_trigrams and accepted."""
    names, nothing = model[0], F.lit(None).cast("string")
    if not names:
        return docs.select(*columns, nothing.alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted"))
    said = [F.coalesce(nothing if c is None else c.cast("string"), F.lit("")).alias(k) for k, c in (("_declared", declared), ("_path", path), ("_suffix", suffix), ("_domain", domain), ("_host", host))]
    docs = docs.select(*columns, *said, *[] if text in columns else [text])
    seen = text_evidence(docs, model, [*columns, "_declared", "_path", *LEVELS], text)
    seen = seen.withColumn("logs", _add(F.col("evidence"), _said(F.col("_declared"), names, DECLARED_TRUST), _said(F.col("_path"), names, PATH_TRUST)))
    seen = seen.drop("evidence", "_declared", "_path").withColumn("own", _posterior(F.col("logs")))
    if text not in columns:  # else texts are read again, which costs less than as much disk as the input
        seen = cut(seen)
    # Counts by host and language; a host's rows are combined in each task.
    each = seen.filter("n_trigrams > 0").select(*LEVELS, F.posexplode("own").alias("i", "p")).filter(F.col("p") >= LITTLE)
    counts = cut(each.groupBy(*LEVELS, "i").agg(F.sum(F.round(F.col("p") * UNIT).cast("long")).alias("own")))
    fused = seen.join(cut(_smoothed(counts, len(names))), list(LEVELS), "left").withColumn("prior", F.coalesce("prior", F.array_repeat(F.lit(0.0), len(names))))
    fused = fused.withColumn("posterior", _posterior(_add(F.col("logs"), F.col("prior")))).withColumn("confidence", F.array_max("posterior"))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("posterior", F.col("confidence")).cast("int"))
    return fused.select(*columns, F.when(F.col("n_trigrams") > 0, best).alias("language"), "confidence", "n_trigrams", ((F.col("n_trigrams") > 0) & (F.col("confidence") >= LEAST)).alias("accepted"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: their lang column is what they declare, their source is their host."""
    return identify(docs, fit(docs), ["doc_id"], "text", declared=F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Web pages: declared by <html lang>, path segment, host, its domain and its suffix; labelled documents give the text model."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    path = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:/|$)", 1))
    return identify(pages.withColumn("_body", body), fit(labelled), ["page_id", "url"], "_body", declared, path, host, domain, suffix)


def op6(docs: DataFrame) -> DataFrame:
    """Every document's language."""
    return identify_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"))
