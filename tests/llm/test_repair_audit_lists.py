"""Conversation repair, filter audit and posting lists against plain versions, on small tables with hard cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from sessionlog.llm import conversation_repair, filter_audit, posting_lists

SPACE = " \t\n\x0b\x0c\r"


# --- conversation repair ----------------------------------------------------------
def damaged(rows):
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        for _ in range(2 if h == 3 else 1):
            yield conv, turn, role, text


def cheapest(rows):
    """Forward over the rows with the least (cost, audit, lines) of each state."""
    follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def better(into, state, option):
        if state not in into or option[:2] < into[state][:2]:
            into[state] = option

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                role = follow[s]
                better(out, role[0], (cost + 3, audit + "I", (*lines, f"{role}:")))
        return out

    for role, text, fault in rows:
        step: dict = {}
        for base in (best, inserted(best)):
            for s, (cost, audit, lines) in base.items():
                better(step, s, (cost + 4, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 3 if fault == "truncated" else 0
                if role and (s + role[:1]) in ("s", "u", "su", "ua", "au"):
                    better(step, role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                better(step, follow[s][0], (cost + extra + 3, audit + "R", (*lines, f"{follow[s]}:{text}")))
        best = step
    return min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])


def plain_repair(table):
    out = {}
    rows = list(damaged(table))
    for conv in {r[0] for r in table}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            stripped = text.rstrip(SPACE)
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role, text, fault))
        cost, audit, lines = cheapest(faults)
        turns = {r[1] for r in own if r[1] is not None}
        count = lambda name: sum(f[2] == name for f in faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n_conv=60, longest=40):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n_conv)]:
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Yes.", "No", "Why?", None, "", " \t", "a b c.\n", "Well! ", "héllo…", f"turn {turn}.", "."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), role, text))
    rng.shuffle(rows)
    return rows


REPAIR = "conv_id long, turn long, role string, text string, at string, letter string, fault string, part string"


def repaired(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], REPAIR).repartition(3)
    found = conversation_repair.op11(table, **kw).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("segment_rows", [1, 3, 4096])
def test_repair_equals_plain_version_over_segments(spark, segment_rows):
    rows = conversations(segment_rows)
    assert repaired(spark, rows, segment_rows=segment_rows) == plain_repair(rows)


def test_one_long_conversation_lies_in_many_partitions_and_segments(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "same.", ""])) for i in range(3_000)] + [(2, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = conversation_repair.placed(conversation_repair.damaged(table))
        assert len({r["at"] >> 33 for r in placed.filter("conv_id = 1").collect()}) > 1
        assert repaired(spark, rows, segment_rows=64) == plain_repair(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_least_audit_of_equal_costs_on_all_short_conversations(spark):
    rows, conv = [], 0
    for roles in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(1, 6)):
        conv += 1
        rows += [(conv, i, {"s": "system", "u": "user", "a": "assistant"}[r], f"{i}.") for i, r in enumerate(roles)]
    assert repaired(spark, rows, segment_rows=2) == plain_repair(rows)


def test_repair_of_nothing_and_of_a_very_long_text(spark):
    assert repaired(spark, []) == {}
    gone = [(c, 0, "user", "Hi.") for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows = [*gone, (7_000, 1, "user", "word " * 400_000 + "."), (7_000, 2, "assistant", "x" * 2_000_000)]
    found = repaired(spark, rows)
    assert found == plain_repair(rows)
    assert found[gone[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_text_conversation_ids(spark):
    rows = [("b", 0, "user", "Hi."), ("a", 0, "assistant", "Yo."), (None, 1, "user", "Hm")] * 3
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.op11(table, segment_rows=1).collect()} == plain_repair(rows)


def test_tables_of_segments_compose_like_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        letters = "".join(rng.choice("suaoSUA14") for _ in range(rng.randint(1, 12)))
        at = rng.randint(0, len(letters))
        whole = conversation_repair.forward(letters, conversation_repair.entering(0))
        a, b = conversation_repair.forward(letters[:at], conversation_repair.entering(0)), conversation_repair.table(letters[at:])
        least, vector = conversation_repair.through(a[1], *b)
        end = conversation_repair.crossing(vector, conversation_repair.ENDS)
        assert end == conversation_repair.crossing(whole[1], conversation_repair.ENDS)
        assert a[0] + least + vector[0][end] == whole[0] + whole[1][0][end]


# --- filter audit -----------------------------------------------------------------
DOCS = "doc_id long, text string, lang string, bits string, hash string, part string, n string, e string, quality int, toxic int"


def plain_audit(docs, labels):
    fails = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs):
            f += "E"
        own = [(q, t) for d, q, t in labels if d is not None and d == doc_id]
        fails.append((lang or "", f, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for i, name in enumerate(order):
                here = [f for f in own if name in f[0] and not set(order[:i]) & set(f[0])]
                shapley[name] += len(here)
                out[part, order, i + 1] = [
                    sum(not set(order[: i + 1]) & set(f[0]) for f in own), len(here), sum(name in f[0] and bool(set(order[:i]) & set(f[0])) for f in own),
                    sum(f[0] == name for f in own), sum(f[1] for f in here), sum(f[2] for f in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    table = spark.createDataFrame([(*d, "x", "x", "x", "x", "x", 1, 1) for d in docs], DOCS).repartition(3)
    found = filter_audit.op13(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found.collect()}


def test_audit_equals_plain_version(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t", "A", "a#b", long, long + " $", "SHOUT " * 300, long.upper(), "é\x0b\x1cx" * 100, "same same " * 150, long + "\n", "|" + long, "x" * 300_000, "q " * 50_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(200)]
    docs += docs[:20]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_a_hot_group_of_copies_is_salted(spark):
    docs = spark.createDataFrame([(i, "p", 7, "copy" if i % 3 else "other text") for i in range(600)], "doc_id long, part string, hash long, text string")
    whole = sorted(map(tuple, filter_audit.repeats(docs).collect()))
    assert sorted(map(tuple, filter_audit.repeats(docs, 50).collect())) == whole
    assert [r[0] for r in whole] == list(range(2, 600))[:1] + list(range(3, 600))


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, None, None)], [])) == 600


# --- posting lists ----------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, v string, dim int, score string, list string, n int"


def found_of(spark, rows, **kw):
    table = posting_lists.usable(spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in rows], VECTORS).repartition(3))
    asked = table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    out = {}
    for r in posting_lists.nearest(table, asked, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def plain_nearest(rows, k=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in {i for i, _ in good if i % 20 == 0}:
        q = min(v for j, v in good if j == i)
        scored = []
        for j, v in good:
            if j != i and len(v) == len(q):
                total = 0.0
                for a, b in zip(q, v, strict=True):
                    total += a * b
                scored.append((-total, j))
        if scored:
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def vectors(n, dim, seed, scale=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(10, dim))[rng.integers(0, 10, n)]
    x /= np.linalg.norm(x, axis=1)[:, None] * np.exp(scale * rng.normal(size=(n, 1)))
    return [(i, [float(a) for a in row]) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("scale", [0.0, 0.3])
def test_recall_of_lists_and_exact_scores(spark, scale):
    rows = vectors(3_000, 24, 1, scale)
    got, want = found_of(spark, rows, list_rows=40), plain_nearest(rows)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    by_id = {q: {j: s for j, s in plain_nearest(rows, 3_000)[q]} for q in list(want)[:5]}
    assert all(by_id[q][j] == s for q in by_id for j, s in got[q])
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_nearest_of_hard_cases_equals_plain_version_where_all_lists_are_met(spark):
    rows = vectors(200, 4, 2) + [(1_000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)]  # many equal vectors
    rows += [(2_000, None), (2_020, []), (2_040, [0.0, 0.0, 0.0, 0.0]), (2_060, [1.0, None, 0.0, 0.0]), (2_080, [1.0, float("nan"), 0.0, 0.0]), (2_100, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    rows += [(3_000, [1.0, 2.0]), (3_001, [2.0, 1.0]), (3_020, [5.0])]  # other lengths, too few of them
    rows += rows[:10] + [(0, [0.5, 0.5, 0.5, 0.5])]  # repeated rows, a second vector of one id
    assert found_of(spark, rows, list_rows=10, prune=9.0) == plain_nearest(rows)
    assert found_of(spark, rows, list_rows=10, prune=9.0, group_rows=7, block_queries=2) == plain_nearest(rows)


def test_queries_with_too_few_rows_in_their_lists_meet_all(spark):
    rows = vectors(100, 8, 3)
    got = found_of(spark, rows, list_rows=3, copies=1, prune=0.0)
    assert got == plain_nearest(rows)


def test_nearest_of_nothing(spark):
    assert found_of(spark, []) == {}
    assert found_of(spark, [(0, [1.0, 2.0])]) == {}


def test_graph_finds_what_a_scan_of_centroids_finds():
    x = np.array([v for _, v in vectors(4_000, 16, 4)])
    lists = posting_lists.Lists(x, 300, 1.0)
    found, dist = lists.nearest(posting_lists.raised(x[:200], 1.0), 32)
    true = np.argsort(posting_lists.distances(posting_lists.raised(x[:200], 1.0), lists.centroids), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b[:8])) / 8 for a, b in zip(true.tolist(), found.tolist(), strict=True)]) > 0.95
    assert (np.diff(dist, axis=1) >= 0).all()
    sizes = np.bincount([p[0] for p in lists.postings(x, 1, 0.0)], minlength=300)
    assert sizes.max() < 20 * len(x) / 300
