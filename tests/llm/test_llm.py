"""The training-data operators against plain versions, on small tables with hard cases."""

from __future__ import annotations

import os
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from sessionlog.llm import _bitmap, _words, components, exact_dedup, jaccard_join, language_id, license_scan, mixing, packing, quality, sharding, substring_dedup, top_k  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, cell string, n string, row string, score string, hash string"
BODY = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", " \t\n", "one", "One", "ONE two\tthree", BODY, BODY.upper(), BODY, BODY + " tail", "head " + BODY, BODY.replace("w30", "x30"), "é É ﬁ Σας naïve",
    "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. CC-BY cc by\r\ncc  BY", "xcc by mit licenses mit license", "permission is hereby granted free charge to any person obtaining a copy of this software",
    "a b c d " * 40, " ".join(f"q{i}" for i in range(20_000)), "<|endoftext|>. foo<|ENDOFTEXT|>, it's 12.5...", "a\x0bb\x0cc\x1cd\x85e f", "w1 w2 w3", "w1 w2 w3",
    "\U0001F600\U0001F600 \U0001F680 a b MIT License x mit license",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 101, t, (None, "en", "fr")[i % 3], (None, "src1", "src2", "src3")[i % 4], None, "x", "x", "x", "x", "x", "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_doc(rows):
    return {r["doc_id"]: r for r in rows.collect()}


# --- words ------------------------------------------------------------------------
def test_words_are_those_of_the_contract():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    found = []
    for _, data, offsets in _words.chunks(batch, "text", 40):
        w = _words.Words(data, offsets)
        found += [[data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first, w.first[1:], strict=False)]
    assert found == [brute.words(t) for t in TEXTS]


def test_hashes_depend_on_words_alone():
    both = b"alpha beta alpha gamma beta alpha"
    w = _words.Words(np.frombuffer(both, np.uint8), np.array([0, len(both)]))
    h = w.hashes()
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3
    pairs = _words.windows(h, 2)
    assert pairs[1] == pairs[4] and len(set(pairs.tolist())) == 4


def test_bitmap_holds_all(spark):
    cells = [int(x) for x in np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)]
    table = _bitmap.bitmap(spark.createDataFrame([(c,) for c in cells], "cell long"), 1 << 20)
    assert _bitmap.held(table, 1 << 20, np.array(cells).view(np.uint64)).all()
    assert _bitmap.held(table, 1 << 20, np.arange(1 << 20, dtype=np.uint64)).sum() <= 500


# --- op1 -----------------------------------------------------------------------------
def check_mix(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:  # reshare the excess until no target is above its bound
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
        assert all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)


def test_op1_meets_targets(spark, docs, real, empty):
    for d in (docs, real):
        rows = mixing.mix(d).collect()
        check_mix(rows)
        assert {r["doc_id"]: r["size"] for r in rows} == {r["doc_id"]: len(brute.words(r["text"])) for r in d.collect()}
        assert sum(r["taken"] % r["size"] > 0 for r in rows if r["size"]) <= len({r["source"] for r in rows})
    again = mixing.op1(real)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.op1(real.repartition(5)).collect()))
    assert mixing.op1(empty).count() == 0


@pytest.mark.parametrize("bucket_rows", [5, mixing.BUCKET_ROWS])
def test_op1_reruns_agree_for_any_layout(spark, bucket_rows):
    r = np.random.default_rng(4)
    rows = [(int(i) if i % 11 else None, " ".join(f"t{i % 37}-{j}" for j in range(40 + int(r.integers(5)))), f"s{i % 3}" if i % 3 else None) for i in range(300)]
    rows += [(7, rows[8][1], "s2")] * 4 + [(7, rows[9][1], "s2"), (7, None, "s2"), (8, "", "s1")]  # a doc_id with rows alike and not
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = lambda d: sorted(map(tuple, mixing.mix(d, bucket_rows=bucket_rows).select("doc_id", "source", "size", "taken", "rate").collect()), key=str)
    first = of(frame.coalesce(1))
    assert len(first) == len(rows) and first == of(frame.repartition(3)) == of(frame.orderBy(F.desc("text")).repartition(7, "text"))
    check_mix(mixing.mix(frame, bucket_rows=bucket_rows).collect())


def test_op1_rates_solve_the_dual(real):
    rows = mixing.mix(real).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        want = brute.source_rates([r["size"] for r in own], own[0]["target"])
        assert [r["rate"] for r in own] == pytest.approx(want, abs=2e-3)
        assert all(abs(r["copies"] - r["rate"]) < 1 + 1e-6 for r in own)


# --- op2 -----------------------------------------------------------------------------
def test_op2_table_and_placement(docs, empty):
    table = sharding.fill_table(("a", "b", "c"), 1009)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.fill_table(("a", "b"), 1009)
    assert ((table == fewer) | (table == 2)).mean() > 0.7  # most slots stay
    heavy = np.bincount(sharding.fill_table(("a", "b"), 1009, (3, 1)))
    assert heavy[0] > 2.9 * heavy[1]
    rows = sharding.op2(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["shard"] == sharding.SHARDS[r["shard_no"]] for r in rows)
    assert sharding.op2(empty).count() == 0
    for weights in (None, (3, 1, 2)):
        assert sharding.fill_table(("a", "b", "c"), 211, weights).tolist() == brute.slot_table(("a", "b", "c"), 211, weights)


def test_op2_places_as_a_plain_lookup_does(spark, docs):
    import struct

    import xxhash

    own = spark.createDataFrame([(3, "x"), (3, None), (None, "y"), (None, "y"), (-5, ""), (1 << 60, "z")], "doc_id long, text string")
    table = brute.slot_table(sharding.SHARDS, sharding.SLOTS)
    for d in (own, docs):
        got = sharding.op2(d).collect()
        assert len(got) == d.count()
        for r in got:
            h = 42 if r["doc_id"] is None else xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest()
            slot = (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS
            assert (r["slot"], r["shard_no"]) == (slot, table[slot])
    assert sharding.place(own.withColumnRenamed("text", "slot")).count() == own.count()  # a clashing name


# --- op3 -----------------------------------------------------------------------------
def test_op3_finds_held_out_quality(spark, real, docs, empty, sf_dir):
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    many = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = quality.op3(many, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 30 and right / len(rows) > 0.85
    scored = {r["doc_id"]: r["score"] for r in quality.op3(docs, labels).collect()}
    assert len(scored) == docs.count() and all(0 <= x <= 1 for x in scored.values())
    nothing = {scored[i * 7 % 101] for i in (0, 1)}  # null and empty texts: the share of label 1
    assert len(nothing) == 1
    assert {r["score"] for r in quality.op3(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.op3(empty, labels).count() == 0


def test_op3_votes_are_exact(spark, real):
    labelled = real.select("text", (F.col("doc_id") % 2).alias("label"))
    model = quality.fit(labelled, 50)
    got = quality.score(real.limit(40), model, ["doc_id", "text"]).collect()
    for r in got:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        z = (quality.counts(raw, np.array([0, len(raw)])) * model["weight"]) @ model["axes"]
        near = (z / np.sqrt((z * z).sum())) @ model["vectors"].T
        top = np.argsort(-near[0])[: quality.NEIGHBOURS]
        w = np.maximum(near[0][top], 0) ** quality.SHARPNESS
        assert r["score"] == pytest.approx(float((w * model["labels"][top]).sum() / w.sum()), abs=1e-3)


# --- op4 -----------------------------------------------------------------------------
@pytest.mark.parametrize("limits", [{}, {"copy_ids": 0}, {"copy_ids": 0, "screen_bytes": 8}])
def test_op4_same_as_plain(docs, plain, limits):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs, **limits).collect()}
    assert got == brute.substring_dedup(plain)


@pytest.mark.parametrize("limits", [{}, {"copy_ids": 0}])
@pytest.mark.parametrize("none", ["alone here", BODY, "head " + BODY])
def test_op4_null_doc_id_beside_copies(spark, limits, none):
    last = (1 << 63) - 1
    rows = [(3, BODY), (8, BODY), (5, BODY + " tail"), (9, BODY), (None, none), (11, "other words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {last if r["doc_id"] is None else r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(frame, **limits).collect()}
    assert got == brute.substring_dedup([(last if i is None else i, t) for i, t in rows])


def test_op4_repeated_doc_ids(spark):
    rows = [(3, BODY), (3, "other " + " ".join(f"k{i}" for i in range(30))), (8, BODY + " tail"), (8, "head k1 k2 " + BODY), (None, BODY), (None, " ".join(f"k{i}" for i in range(30)))]
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    for limits in ({}, {"screen_bytes": 8}):
        got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(frame, **limits).collect()}
        assert got == {(3, 60, 0), (3, 31, 0), (8, 61, 60), (8, 63, 60), (None, 60, 60), (None, 30, 30)}


def test_op4_sketch_never_underestimates(real):
    words = substring_dedup.words_for(real)
    table = np.zeros((substring_dedup.DEPTH, words), np.uint64)
    for r in substring_dedup.sketch(real, words).collect():
        table[:, r["block"] * substring_dedup.BLOCK_WORDS : (r["block"] + 1) * substring_dedup.BLOCK_WORDS] = substring_dedup._as_words(r["held"])
    counts = {}
    for r in real.collect():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        _, _, owner, low = substring_dedup._parts(_words.Words(raw, np.array([0, len(raw)])), 13, 8)
        for x in low[substring_dedup._stretches(low, owner)].tolist():
            counts[x] = counts.get(x, 0) + 1
    low = np.array(list(counts), np.uint64)
    many = np.array(list(counts.values())) >= 2
    said = substring_dedup._repeated(table, words, low)
    assert said[many].all() and said[~many].mean() < 0.05 and many.any()


def test_op4_real_and_empty(real, empty):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    want = {i: (n, k, brute.sha(t)) for i, (n, k, t) in brute.substring_dedup(rows).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op4(real).collect()} == want
    assert substring_dedup.op4(empty).count() == 0


# --- op5 -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_packed(rows, texts, tokenizer):
    # Pieces may be cut anywhere: each holds the ids that stand there, and together they hold each id once.
    text_of, ends = dict(texts), {}
    assert len(text_of) == len(texts)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == ends.get(r["doc_id"], 0) and r["length"] > 0
        assert (r["ids_crc32"], r["doc_tokens"]) == brute.token_crc(text_of[r["doc_id"]], tokenizer, r["start"], r["length"])
        ends[r["doc_id"]] = r["start"] + r["length"]
    assert ends == {i: sum(p[1] for p in brute.token_pieces(t, tokenizer)) for i, t in texts}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values(), default=0) <= 2048
    return sum(sequences.values()) / (2048 * max(1, len(sequences)))


def test_op5_pieces_and_sequences(docs, plain, real, empty, tokenizer):
    check_packed(packing.op5(docs).collect(), plain, tokenizer)
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    assert check_packed(packing.op5(real).collect(), rows, tokenizer) > 0.95
    assert packing.op5(empty).count() == 0


def test_op5_same_for_any_layout(spark, tokenizer):
    rows = [(i % 40 if i % 9 else None, " ".join(f"word{i % 23}" for _ in range(i * 13 % 900))) for i in range(160)] + [(3, "same")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda d: sorted(map(tuple, packing.op5(d).collect()), key=str)
    first = packing.op5(frame.coalesce(1)).collect()
    assert sorted(map(tuple, first), key=str) == of(frame.repartition(3)) == of(frame.repartition(7, "text"))
    sequences = {}
    for r in sorted(first, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 2048 and sum(r["length"] for r in first) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_op5_cuts_tails_that_do_not_mix(spark, tokenizer):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 10}" for j in range(540 + i % 12))) for i in range(400)]
    assert all(1000 < sum(p[1] for p in brute.token_pieces(t, tokenizer)) < 1200 for _, t in rows[:12])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.op5(frame.repartition(5)).collect()
    assert check_packed(packed, rows, tokenizer) > 0.98
    assert sorted(map(tuple, packed)) == sorted(map(tuple, packing.op5(frame.coalesce(1)).collect()))
    stored = packing.cut(packing.pieces(frame, keep_ids=True))
    parts = packing.pack(stored).filter("doc_id < 40").collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in parts)
    assert any(r["start"] % 2048 for r in parts)
    whole = packing.pack(stored, cut_cost=float("inf"))
    assert whole.filter("start % 2048 <> 0").count() == 0
    assert whole.agg({"sequence_id": "max"}).first()[0] > 1.5 * max(r["sequence_id"] for r in packed)


@pytest.mark.parametrize("sizes", [[69], [127], [65, 66, 70], [43, 44, 128], list(range(1, 129)), [100, 128], [1]])
def test_op5_cut_plans_meet_demand_and_fill(sizes):
    r = np.random.default_rng(len(sizes))
    sizes = np.array(sizes)
    for most in (3, 400, 2_000_000):
        demand = r.integers(1, most, len(sizes)).astype(float)
        used, total = np.zeros(len(sizes)), 0
        for use in packing.plan_uses(sizes, demand, 128):
            held = sum(int(sizes[i]) * c for i, c in use.pattern.items())
            assert held + use.gap <= 128 and sum(int(sizes[i]) * c for i, c in use.tape.items()) <= use.gap * use.times
            for i, c in use.pattern.items():
                used[i] += c * use.times
            for i, c in use.tape.items():
                used[i] += c
            total += use.times
        assert (used == demand).all()
        assert total <= 1.015 * (sizes * demand).sum() / 128 + 2


def test_op5_crc_of_a_part():
    r = np.random.default_rng(4)
    whole = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 2, 5, 64, 1000, 8192, 70_000)]
    cuts = [(x, int(r.integers(0, len(x) + 1))) for x in whole for _ in range(5)]
    got = packing.part_crc(*(np.array(c) for c in zip(*[(zlib.crc32(x), zlib.crc32(x[:at]), len(x) - at) for x, at in cuts], strict=True)))
    assert got.tolist() == [zlib.crc32(x[at:]) for x, at in cuts]


def test_op5_plan_meets_demand():
    r = np.random.default_rng(3)
    sizes, demand = np.arange(1, 61), r.integers(0, 500, 60).astype(float)
    plan = packing.plan_patterns(sizes, demand, 128)
    used = np.zeros(60)
    for pattern, times in plan:
        assert sum(int(sizes[i]) * c for i, c in pattern.items()) <= 128
        for i, c in pattern.items():
            used[i] += c * times
    assert (used == demand).all()
    assert sum(t for _, t in plan) <= 1.01 * (sizes * demand).sum() / 128 + 2


# --- op6 -----------------------------------------------------------------------------
def test_op6_finds_languages(real, docs, empty, spark, sf_dir):
    rows = language_id.op6(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in rows) / len(rows) > 0.97 and all(r["accepted"] for r in rows)
    model = language_id.fit(real)
    alone = language_id.identify(real, model, ["doc_id", "lang"], "text").collect()  # text is all it has
    assert sum(r["language"] == r["lang"] for r in alone) / len(alone) > 0.95
    rejected = {r["doc_id"] for r in language_id.op6(docs).filter("NOT accepted").collect()}
    assert {0, 7} <= rejected  # null and empty texts
    assert language_id.op6(empty).count() == 0


def _evidence(text, model):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    code, _ = language_id._trigrams(raw, np.array([0, len(raw)]))
    return [float(x) for x in model[1][:, code].astype(np.float64).sum(axis=1) * min(len(code), language_id.EVIDENCE) / len(code)] if len(code) else None


def _compare(got, rows, model, key):
    want = brute.languages([x[1:] for x in rows], model[0], None, language_id.DECLARED_TRUST, language_id.PATH_TRUST, language_id.HOST_WEIGHT, language_id.LITTLE)
    want = sorted((x[0], lang, round(p, 4)) for x, (lang, p) in zip(rows, want, strict=True))
    have = sorted((r[key], r["language"], round(r["confidence"], 4)) for r in got)
    assert [x[:2] for x in have] == [x[:2] for x in want] and [x[2] for x in have] == pytest.approx([x[2] for x in want], abs=2e-3)
    assert all(r["accepted"] == (r["n_trigrams"] > 0 and r["confidence"] >= language_id.LEAST) for r in got)


def test_op6_same_as_plain(real, docs):
    model = language_id.fit(real)
    for d in (real, docs):
        rows = [(r["doc_id"], r["lang"] or "", "", "", "", r["source"] or "", _evidence(r["text"], model)) for r in d.collect()]
        got = language_id.identify(d, model, ["doc_id"], "text", declared=F.col("lang"), host=F.col("source")).collect()
        _compare(got, rows, model, "doc_id")


def test_op6_held_out_texts_alone(spark, real):
    model = language_id.fit(real.filter("doc_id % 2 = 0"))
    rest = language_id.identify(real.filter("doc_id % 2 = 1"), model, ["doc_id", "lang"], "text").collect()
    assert len(rest) > 50 and sum(r["language"] == r["lang"] for r in rest) / len(rest) > 0.95


def test_op6_keeps_every_language(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" * 30, f"l{i:03d}") for i in range(160)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == [f"l{i:03d}" for i in range(160)]


def test_pages_same_as_plain(spark, real, sf_dir, empty):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = [(9001, None, None), (9002, "http://x.fr/de/a", ""), (9002, "http://x.fr/de/a", ""), (9003, "nonsense", "<html lang='xx'>" + "der die das und " * 9), (9004, "https://a.b.co.uk/", "<script>x</script><p>" + "le la les et de " * 9)]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    model = language_id.fit(real)
    bare = re.compile(r"<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", re.I | re.S)
    first = lambda p, x: (re.search(p, x or "") or ["", ""])[1]
    rows = []
    for r in pages.collect():
        host = first(r"^[a-zA-Z]+://([^/:?#]+)", r["url"]).lower()
        body = None if r["html"] is None else bare.sub(" ", r["html"])
        rows.append((r["page_id"], first(r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", r["html"]).lower(), first(r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:/|$)", r["url"]).lower(), first(r"\.([^.]+)$", host), first(r"([^.]+\.[^.]+)$", host), host, _evidence(body, model)))
    got = language_id.identify_pages(pages, real)
    _compare(got.collect(), rows, model, "page_id")
    assert language_id.identify_pages(pages.limit(0), real).count() == 0 and language_id.identify_pages(pages, empty).filter("accepted").count() == 0


# --- op7 -----------------------------------------------------------------------------
def test_op7_same_as_plain(docs, plain, real, empty):
    want = brute.jaccard_components(plain)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op7(docs).collect()} == want
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op7(real).collect()} == brute.jaccard_components(rows)
    assert jaccard_join.op7(empty).count() == 0


def test_op7_regions_lose_no_link(spark):
    r = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for i in range(90):  # near copies at many distances
        own = list(base)
        for j in r.choice(120, int(r.integers(0, 6)), replace=False):
            own[j] = f"z{r.integers(3)}"
        texts.append((i, " ".join(own)))
    for i in range(90, 250):  # a long chain: each differs from the one before by a word, every tenth by ten
        for j in range(10 if i % 10 == 0 else 1):
            base[(i * 7 + j * 11) % 120] = f"y{i}-{j}"
        texts.append((i, " ".join(base)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute.jaccard_components(texts).items()}
    sets = jaccard_join.shingle_sets(frame, "text", 4, 85, "sets").select(F.col("doc_id").alias("sid"), "n", "hashes").cache()
    cells = sets.select(F.lit(0).cast("long").alias("cell"), "sid", "n")
    for limit, levels, deepest in ((1 << 30, 6, 1), (4000, 6, 1), (4000, 0, 0)):  # regions inside a task; regions by Spark; blocks alone
        links = jaccard_join.links_in_cells(cells, sets.drop("n"), 85, limit, levels=levels)
        got = {r["node"]: r["component"] for r in components.components(links.select("u", "v")).collect()}
        assert {i: got.get(i, i) for i in want} == want
        assert max(r["level"] for r in links.collect()) >= deepest


def test_op7_only_sets_of_large_cells_go_on(spark, monkeypatch):
    texts = [(i, " ".join(f"z{i}" if j == i % 50 else f"v{j}" for j in range(120))) for i in range(40)]  # one neighbourhood
    texts += [(100 + i, " ".join(f"u{i // 2}-{j}" for j in range(60 + i % 2))) for i in range(60)]  # pairs
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    sets = jaccard_join.shingle_sets(frame, "text", 4, 85, "sets").select(F.col("doc_id").alias("sid"), "n", "hashes").cache()
    cells = sets.select(F.when(F.col("sid") < 100, 0).otherwise(F.floor(F.col("sid") / 2)).cast("long").alias("cell"), "sid", "n")
    stored, cut = [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: (out := cut(df), "hashes" in out.columns and stored.append(out.count()))[0])
    links = jaccard_join.links_in_cells(cells, sets.drop("n"), 85, 2000)
    got = {r["node"]: r["component"] for r in components.components(links.select("u", "v")).collect()}
    assert {i: got.get(i, i) for i, _ in texts} == {i: c for i, (_, c) in brute.jaccard_components(texts).items()}
    assert stored and max(stored) == 40


def test_op7_copies_and_keys_arent_shuffled(spark, monkeypatch):
    rows = [(i, BODY) for i in range(30)] + [(30, BODY.replace("w59", "x")), (31, "lone words of its own")]
    seen, sets = [], jaccard_join.shingle_sets
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda *a, **b: (out := sets(*a, **b), seen.append((a[4], out)))[0])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 31: 31}
    what, first = seen[1]
    assert what == "hashes" and first.columns == ["hash"]
    assert first.count() == sets(spark.createDataFrame(rows[29:], "doc_id long, text string"), "text", 4, 85, "hashes").count()


def test_op7_regions_are_entered(real, monkeypatch):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    sets = [(i, np.unique(np.array([hash(x) & ((1 << 62) - 1) for x in brute.shingles(t)], np.uint64))) for i, t in rows if brute.words(t)]
    own = jaccard_join._Neighbourhood(np.array([i for i, _ in sets]), [s for _, s in sets], 85)
    entered = []
    join = own.join
    monkeypatch.setattr(own, "join", lambda part, level=0: (entered.append((level, len(part))), join(part, level))[1])
    own.join(np.arange(len(sets)))
    want = {i: c for i, (_, c) in brute.jaccard_components(rows).items() if brute.words(dict(rows)[i])}
    got = {int(i): int(own.ids[own.root == own.root[k]].min()) for k, i in enumerate(own.ids)}
    assert got == want and len(entered) > 0


def test_op7_null_and_repeated_doc_ids(spark):
    near = BODY.replace("w59", "x")
    rows = [(4, BODY), (4, "something else here now"), (6, near), (None, BODY), (None, "lone words"), (9, "something else here now"), (2, None), (2, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(4, 57, 4), (4, 1, 4), (6, 57, 4), (None, 57, 4), (None, 1, None), (9, 1, 4), (2, 0, 2), (2, 0, 2)], key=str)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(41)}


# --- op8 -----------------------------------------------------------------------------
def test_op8_same_as_plain(docs, real, empty):
    for d in (docs, real):
        texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
        for r in license_scan.op8(d).collect():
            n, k, a, z, base = brute.phrases(texts[r["doc_id"]])
            own, best = brute.licence_blocks(texts[r["doc_id"]], license_scan.TEMPLATES, license_scan.CONTAINMENT)
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, k, a, z, base)
            assert r["labels"] == ",".join(sorted(own | set(filter(None, base.split(","))))) and r["score"] == pytest.approx(max(best, float(k > 0)))
    assert license_scan.op8(empty).count() == 0


def test_op8_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software"
    gpl = "This work is licensed under the GNU General Public\nLicense version 3"
    cases = [
        (bsd, "bsd-notice"), (bsd.replace("\n", "\r\n"), "bsd-notice"), (bsd.replace("\n", "\r"), "bsd-notice"), (mit, "mit-notice"), (gpl, "gpl,gpl-3.0"),
        ("# " + bsd.replace("\n", "\n# ").replace(" in ", "\n#   in "), "bsd-notice"), ("/*\n * " + mit.replace("\n", "\n * ") + ".\n */\nint x;", "mit-notice"),
        ("Foo 1.0\n\n" + mit + ".\n" + bsd, "bsd-notice,mit-notice"), (mit.replace(" ", "\n"), "mit-notice"),
        (bsd.replace("\n", "\n\n"), ""), (bsd.replace("\n", "\r\n\r\n"), ""), ("# " + bsd.replace("\n", "\n#\n# "), ""), (bsd.replace("\n", ".\n"), ""),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.op8(frame).collect()} == {i: x for i, (_, x) in enumerate(cases)}


# --- op9 -----------------------------------------------------------------------------
def test_op9_exact_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(0, 0.1, 8)]) for i in range(400)]
    vectors += [(400 + i, [0.5] * 8) for i in range(60)]  # one vector many times
    bad = [(900, None), (901, [float("nan")] * 8), (902, [None] + [0.1] * 7), (903, [float("inf")] * 8)]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, top_k.op9(frame).collect())) == sorted(want)
    v = top_k.quantised(frame).cache()
    queries = spark.createDataFrame([(i, [int(x) for x in whole[i]]) for i in whole if i % 50 == 0], "query_id long, v array<long>")
    assert sorted(map(tuple, top_k.top_k(v, queries, shard_rows=90, block_queries=3).collect())) == sorted(want)
    assert top_k.op9(frame.limit(0)).count() == 0


def test_op9_repeated_ids_and_large_components(spark):
    rows = [(50, [0.5, 0.25])] * 10 + [(i, [0.5, 0.25]) for i in (61, 60, 62)] + [(70, [0.1, 0.1])] * 3 + [(71, [0.1, 0.0]), (72, []), (None, [0.1, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k.op9(frame).orderBy("rank").collect()]
    same, tenth = 128 * 128 + 64 * 64, 25 * (128 + 64)
    assert got == [(50, 1, 60, same), (50, 2, 61, same), (50, 3, 62, same), (50, 4, 70, tenth), (50, 5, 71, 25 * 128)]
    for large in (1e9, 1e300):
        with pytest.raises(Exception, match="too large"):
            top_k.op9(spark.createDataFrame([(0, [large] * 8), (1, [large] * 8)], "vec_id long, embedding array<double>")).collect()


def test_op9_blocks_of_queries_share_their_products():
    """Random directions, which no bound divides: a query's work is a product, not a walk of its own."""
    r = np.random.default_rng(9)
    x = r.normal(0, 40, (6000, 64)).astype(np.int64)
    ids, tree = np.arange(len(x)) * 3, top_k.BallTree(x)
    asked = np.arange(0, len(x), 10)
    began = time.process_time()
    best, found = tree.search(x[asked], ids[asked], ids, 5, np.full(len(asked), top_k.NONE))
    assert time.process_time() - began < 3
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = top_k.NONE
    order = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=-1)[:, :5]
    assert (ids[order] == found).all() and (np.take_along_axis(scores, order, 1) == best).all()
    huge = np.array([[1 << 29, 1], [1 << 29, 2], [1 << 29, 3]])  # scores beyond 2**53 that differ in their last digits
    assert top_k.BallTree(huge).search(huge[:1], np.array([9]), np.arange(3), 2, np.array([top_k.NONE]))[1].tolist() == [[2, 1]]


# --- op10 ----------------------------------------------------------------------------
def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.lower(t), []).append(i)
    return {i: (max(own), len(own), i == max(own), brute.sha(t)) for t, own in groups.items() for i in own}


def test_op10_same_as_plain(docs, plain, real, empty):
    for d, rows in ((docs, plain), (real, [tuple(r) for r in real.select("doc_id", "text").collect()])):
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.op10(d).collect()} == expected_groups(rows)
    joined = exact_dedup.exact_dedup(*exact_dedup.split_snapshot(docs), bitmap_bits=8, shard_keys=3)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in joined.collect()} == {i: v[:3] for i, v in expected_groups(plain).items()}
    assert exact_dedup.op10(empty).count() == 0


def test_op10_null_and_repeated_doc_ids(spark):
    rows = [(3, "A"), (3, "a"), (5, "a"), (None, "a"), (None, "b"), (None, None), (7, ""), (9, "c"), (9, "c"), (9, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.op10(frame).collect()), key=str)
    want = [(3, 5, 4, False)] * 2 + [(5, 5, 4, True), (None, 5, 4, False), (None, None, 1, True), (None, 7, 2, False), (7, 7, 2, True), (9, 9, 2, True), (9, 9, 2, True), (9, 9, 1, True)]
    assert got == sorted(want, key=str)


def test_op10_filters_screen_and_are_reused(spark, monkeypatch):
    old = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    stored = exact_dedup.freeze(old, shard_keys=100)
    assert stored.filters.count() == stored.shards > 1
    for first in (300, 390):  # two batches against one snapshot
        new = spark.createDataFrame([(1000 + i, f"TEXT {i}") for i in range(first, first + 200)], "doc_id long, text string")
        digests = exact_dedup.with_digest(new).groupBy("digest").count()
        positive = {bytes(r["digest"]) for r in exact_dedup.screen(digests, stored.filters, stored.shards).collect()}
        held = {bytes(r["digest"]) for r in stored.digests.collect()}
        assert {bytes(r["digest"]) for r in digests.collect()} & held <= positive and len(positive) < 400 - first + 30
        monkeypatch.setattr(exact_dedup, "build_filters", None)  # the stored ones are used
        got = exact_dedup.exact_dedup(stored, new).filter("batch").collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {1000 + i: (1000 + i, 2 if i < 400 else 1, True) for i in range(first, first + 200)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter_never_misses(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    seed, segment, count, table = exact_dedup.build_filter(keys)
    assert exact_dedup.in_filter(keys, seed, segment, count, table).all()
    other = np.random.default_rng(n + 1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert exact_dedup.in_filter(other, seed, segment, count, table).mean() < 0.01
    assert len(table) < 1.35 * n + 200


# --- pipeline -------------------------------------------------------------------------
def test_pipeline_stages(spark, real, sf_dir):
    import corpus_pipeline as p

    docs = real
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.cut(stage(spark, docs, sf_dir))
        assert docs.columns == before.columns, name
        if name == "exact dedup":
            texts = [brute.lower(r["text"]) for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({brute.lower(r["text"]) for r in before.collect()})
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count() and docs.count() > 100


def test_pipeline_marks_ids_without_shuffling_texts(spark, real, sf_dir):
    import corpus_pipeline as p

    ids = [-(1 << 40), -32768, -32767, -9, -1, 0, 1, 7, 8, 32768, 32769, 65536, 1 << 45]
    rows = spark.createDataFrame([(i + d, "text") for i in ids for d in (0, 2)], "row long, text string")
    among = spark.createDataFrame([(i,) for i in ids] * 2, "row long")
    for most in (p.BITMAP_BYTES, 0):
        got = sorted((r["row"], r["kept"]) for r in p.marked(rows, among, "kept", most).collect())
        assert got == sorted((i + d, i + d in ids) for i in ids for d in (0, 2)), most
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids were many
    try:
        for stage in (p.drop_copies, p.drop_near_copies):
            plan = stage(spark, p.cut(real), sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pipeline_language_stage_stores_no_texts(spark, real, sf_dir, monkeypatch):
    import corpus_pipeline as p

    stored, cut = [], language_id.cut
    monkeypatch.setattr(language_id, "cut", lambda df: (stored.append(df.columns), cut(df))[1])
    assert p.identify_language(spark, real, sf_dir).count() > 100
    assert stored and not any("text" in columns for columns in stored)


def test_pipeline_null_and_repeated_doc_ids(spark, sf_dir):
    import corpus_pipeline as p

    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    def run(stage, rows):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return [(r["doc_id"], r["text"]) for r in stage(spark, p.cut(frame.repartition(3)), sf_dir).collect()]

    def order(rows):
        return sorted(rows, key=str)

    # Null doc_ids with texts of their own, rows repeated whole, one doc_id with several texts.
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (4, text("c"))] + [(7, text("d"))] * 5 + [(8, text("d")), (8, text("e")), (9, text("e")), (9, text("f"))]
    exact = [(None, text("a")), (None, text("b")), (4, text("c")), (8, text("d")), (9, text("e")), (9, text("f"))]
    assert order(run(p.drop_copies, rows)) == order(exact)
    assert order(run(p.drop_copies, [(7, text("d"))] * 5 + [(None, text("g"))] * 2)) == order([(7, text("d")), (None, text("g"))])
    near = [(None, text("a")), (None, text("b") + " x"), (6, text("b")), (5, text("c")), (5, text("c") + " x"), (5, text("d"))] + [(2, text("e"))] * 3
    found = run(p.drop_near_copies, near)
    assert len(found) == 5 and {(None, text("a")), (6, text("b")), (5, text("d")), (2, text("e"))} < set(found)
    assert len({(5, text("c")), (5, text("c") + " x")} & set(found)) == 1
    mixed = run(p.mix_sources, rows)
    assert sum(len(t.split()) for _, t in mixed) == 1.5 * 40 * len(rows)  # one source: its target
    assert max(mixed.count(x) for x in set(mixed)) <= 2 * 5 and any(i is None for i, _ in mixed)
    known = run(p.identify_language, [(None, text("a"))] * 3 + [(None, text("b"))])
    assert len(known) == 4


# --- words that defeat polynomial hashes, and very long texts ---------------------
def thue_morse(bytes_: int, letters: str = "ab") -> str:
    return "".join(letters[i.bit_count() & 1] for i in range(bytes_))


@pytest.mark.parametrize("size", [16, 32, 64, 1_024, 2_048, 4_096])
def test_words_on_the_thue_morse_sequence_are_told_apart(spark, size):
    one, two = thue_morse(size), thue_morse(size, "ba")
    batch = pa.RecordBatch.from_arrays([pa.array([f"{one} {two} {one} x"])], ["text"])
    (_, data, offsets), = _words.chunks(batch, "text")
    a, b, c, _ = _words.Words(data, offsets).hashes().tolist()
    assert a == c != b
    tail = " ".join(f"t{i}" for i in range(14))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, " ".join([one] * 4)), (4, " ".join([two] * 4)), (5, one), (6, two)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.op4(table).collect()} == {1: 0, 2: 14, 3: 0, 4: 0, 5: 0, 6: 0}
    assert all(r["doc_id"] == r["component_id"] for r in jaccard_join.op7(table.filter("doc_id > 2")).collect())
    ids = packing.WordIds(packing.default_tokenizer())
    for word in (one, two):
        got, _ = ids.of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        assert got.tolist() == ids.tokenizer.encode(word, add_special_tokens=False).ids


def test_a_text_of_many_segments_hashes_like_its_parts():
    words = [f"w{i % 9_973}" for i in range(200_000)] + ["y" * 700_000, "z"]
    whole = pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], ["text"])
    (_, data, offsets), = _words.chunks(whole, "text")
    h = _words.Words(data, offsets).hashes()
    alone = {}
    for w in (words[0], words[9_972], words[-2], words[-1]):
        alone[w] = _words.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hashes()[0]
    assert [h[0], h[9_972], h[-2], h[-1]] == list(alone.values())
    own = _words.windows(h, 13)
    assert len(own) == len(words) - 12 and own[0] == own[9_973] == _words.windows(h[:13], 13)[0] and own[-1] == _words.windows(h[-13:], 13)[0]
    cut = _words.SEGMENT - 13
    assert (own[cut - 20 : cut] == _words.windows(h[cut - 20 : cut + 12], 13)).all() if cut < len(own) else True


def test_components_that_are_not_complete_are_an_error(spark):
    chain = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)


def test_one_text_of_five_megabytes(spark):
    """Its last words repeat an earlier document's, and a copy of it is found."""
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"v{i}" for i in range(620_000))
    rows = spark.createDataFrame([(1, passage), (2, "")], "doc_id long, text string").unionByName(
        spark.range(3, 5).selectExpr("id AS doc_id", f"concat(array_join(transform(sequence(0, 619999), i -> concat('v', i)), ' '), ' {passage}') AS text")
    )
    assert len(long) > 4_000_000
    found = by_doc(substring_dedup.op4(rows))
    n = 620_000 + 30
    assert [(found[i]["n_words"], found[i]["n_removed"]) for i in (1, 2, 3, 4)] == [(30, 0), (0, 0), (n, 30), (n, n)]
    joined = by_doc(jaccard_join.op7(rows))
    assert joined[3]["component_id"] == joined[4]["component_id"] == 3 and joined[3]["n_shingles"] == n - 3
    pieces = packing.pieces(rows).filter("doc_id >= 3").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == 2 and all(r["n"] == r["t"] for r in pieces)


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    ids = packing.WordIds(packing.default_tokenizer())
    texts = ["alpha beta, alpha gamma. x", "beta x alpha delta", " ".join(f"w{i}" for i in range(500))]
    monkeypatch.setattr(_words.Words, "hashes", lambda self: np.full(len(self.starts), 7, np.uint64))
    for text in texts * 2:
        got, _ = ids.of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert got.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokenizing_remembers_words_met_again_in_little_memory(monkeypatch):
    ids = packing.WordIds(packing.default_tokenizer())
    monkeypatch.setattr(packing, "MEMO_WORDS", 2_000)
    monkeypatch.setattr(packing, "MEMO_IDS", 20_000, raising=False)
    held = lambda: sum(x.nbytes for x in vars(ids).values() if isinstance(x, np.ndarray))
    common = " ".join(f"common{i}" for i in range(100))
    texts = [f"{common} " + " ".join(f"Word{i}x{j}, é{j}" for j in range(400)) for i in range(12)] + ["q7" * 30_000, common]
    for text in texts:
        raw = text.encode()
        got, first = ids.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert got.dtype == np.uint32 and first.tolist() == [0, len(got)]
        assert got.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.n < 3_500
    assert ids.at[ids.n] < 20_000  # the word of 60,000 letters went
    assert held() < 1_500_000
    ids.clear()
    small = held()
    raw = " ".join(f"w{i}" for i in range(400_000)).encode()
    ids.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert held() - small < 60 * ids.n  # before, 75
