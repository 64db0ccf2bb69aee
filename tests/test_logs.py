"""The JSONL route: real log lines of several sessions, read and analysed together."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionlog.functions import matching
from sessionlog.operators import analyze, compact, condense, filehistory, metadata, narrative, rounds, scan, search
from sessionlog.sources import jsonl, sinks, standing


def user(text, uuid, ts="2026-01-01T00:00:00.000Z", **more):
    return {"type": "user", "uuid": uuid, "timestamp": ts, "message": {"role": "user", "content": text}, **more}


def assistant(content, uuid, request, model="sonnet", ts="2026-01-01T00:01:00.000Z", usage=(100, 50, 10)):
    own = {"input_tokens": usage[0], "output_tokens": usage[1], "cache_read_input_tokens": usage[2]}
    return {"type": "assistant", "uuid": uuid, "requestId": request, "timestamp": ts, "message": {"role": "assistant", "model": model, "content": content, "usage": own}}


def call(id_, name, **given):
    return {"type": "tool_use", "id": id_, "name": name, "input": given}


def result(id_, content, error=None):
    return {"type": "tool_result", "tool_use_id": id_, "content": content} | ({} if error is None else {"is_error": error})


SPILL = "<persisted-output>\nOutput too large (51.3KB). Full output saved to: /t/spill-1.txt\n\nPreview (first 2KB):\nx"
ONE = [
    user("please start", "a0", gitBranch="main"),
    assistant([{"type": "text", "text": "partial"}], "a1", "r1"),
    assistant([{"type": "text", "text": "Sure."}, call("t1", "Read", file_path="/root/p/a.ts"), call("t2", "Bash", command=" npm test\n")], "a2", "r1"),
    user([result("t1", "l1\nl2"), result("t2", [{"type": "text", "text": "bad"}], True)], "a3"),
    {"type": "permission-mode", "permissionMode": "plan"},
    user("<system-reminder>x</system-reminder>", "a4"),
    assistant([call("t1", "Edit", file_path="/root/p/a.ts", old_string="a", new_string="b")], "a5", "r2", "opus", usage=(500, 300, 0)),
    user([result("t1", SPILL, "true")], "a6", ts="2026-01-01T00:02:30.000Z"),
]
TWO = [user("hi", "b0"), assistant([{"type": "text", "text": "x"}], "b1", "q1", "<synthetic>")]
SUB = [user("sub", "c0"), assistant([{"type": "text", "text": "y"}], "c1", "s1")]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "one" / "subagents").mkdir(parents=True)
    for path, rows in (("one.jsonl", ONE), ("two.jsonl", TWO), ("one/subagents/agent-7.jsonl", SUB)):
        (root / path).write_text("".join(json.dumps(r) + "\n" for r in rows) + ("not json\n" if path == "two.jsonl" else ""))
    entries = jsonl.read_entries(spark, str(root)).cache()
    return str(root), entries, jsonl.blocks(entries).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_order_dedupe_and_sessions(logs):
    _, entries, _ = logs
    one = [r["uuid"] for r in entries.filter("session_id = 'one'").orderBy("ix").collect()]
    assert one == ["a0", "a2", "a3", None, "a4", "a5", "a6"]  # the partial roll is gone
    assert {r[0] for r in entries.select("session_id").collect()} == {"one", "two", "one/agent-7"}


def test_bad_lines_are_kept_apart(spark, logs):
    assert [r["raw"] for r in jsonl.bad_lines(spark, logs[0]).collect()] == ["not json"]


def test_order_across_splits(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"type": "user", "uuid": str(i), "message": {"content": "x" * 50}}) + "\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [r["uuid"] for r in jsonl.read_entries(spark, str(tmp_path)).orderBy("ix").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [str(i) for i in range(400)]


def test_resolve(spark, logs):
    known = spark.createDataFrame([("0f8fad5b-d9cb-469f-a165-70867728950e",)], "session_id string")
    texts = spark.createDataFrame([("a", "see x0f8fad5b-d9cb-469f-a165-70867728950ez"), ("b", "0f8fad5b-d9cb-469f-a165-70867728950f")], "location string, text string")
    assert rows(scan.known_sessions(texts, known), "location") == [("a",)]
    wanted = spark.createDataFrame([("tw",), ("o",), ("zz",)], "prefix string")
    assert rows(jsonl.resolve(logs[1], wanted), "prefix", "status") == [("o", "ambiguous"), ("tw", "ok"), ("zz", "unknown")]


def test_tokens(logs):
    assert rows(analyze.tokens_by_model(logs[1]).filter("session_id = 'one'"), "model", "input_tokens", "output_tokens", "cache_read", "message_count") == [("opus", 500, 300, 0, 1), ("sonnet", 100, 50, 10, 1)]
    assert rows(analyze.token_totals(logs[1]), "session_id", "input_tokens") == [("one", 600), ("one/agent-7", 100), ("two", 0)]


def test_failures_take_the_last_call_of_an_id(logs):
    assert rows(analyze.failures(logs[2]), "session_id", "ix", "tool_name") == [("one", 2, "Bash")]  # "true" is no boolean


def test_files_clusters_spills_permissions(logs):
    _, entries, blocks = logs
    assert rows(analyze.files_touched(blocks), "path", "reads", "edits", "writes") == [("/root/p/a.ts", 1, 1, 0)]
    assert rows(analyze.bash_clusters(blocks), "cluster", "calls", "position") == [("npm", 1, 1)]
    assert rows(analyze.spills(blocks), "path", "size_label") == [("/t/spill-1.txt", "51.3KB")]
    assert rows(analyze.permission_events(entries), "ix", "kind", "mode") == [(3, "permission_mode", "plan")]


def test_metadata(logs):
    assert rows(metadata.metadata(logs[1], logs[2]), "session_id", "duration_s", "turn_count", "end_state") == [("one", 150, 7, "completed"), ("one/agent-7", 60, 2, "completed"), ("two", 60, 2, "completed")]


def test_rounds_and_brief(logs):
    _, entries, blocks = logs
    humans = rounds.human_texts(entries, blocks)
    assert rows(humans.filter("session_id = 'one' AND text IS NOT NULL"), "ix", "text") == [(0, "please start"), (4, "<system-reminder>x</system-reminder>")]
    assert rows(rounds.brief_stats(entries, blocks, humans).filter("session_id = 'one'"), "rounds", "raw_rounds", "tool_uses", "entry_count") == [(1, 2, 3, 7)]
    stats = rounds.brief_stats(entries, blocks, humans).withColumn("source", F.lit("one.jsonl"))
    text = rounds.whole_brief(rounds.brief(entries, blocks, humans), stats).filter("session_id = 'one'").first()["text"]
    assert text == (
        '<session source="one.jsonl" rounds="1" assistant_text_tokens="1" tool_uses="3">\n<round n="1">\n<user idx="0">\nplease start\n</user>\n<git branch="main"/>\n<assistant idx="1">\nSure.\n</assistant>\n'
        '<tools idx="1">\n- [1] Read a.ts — 5 lines, ~27 tokens\n- [1] Bash ` npm test ⏎ ` — ~1 tok out [error]\n</tools>\n</round>\n</session>\n'
    )
    marked = rounds.whole_brief(rounds.brief(entries, blocks, humans, markdown=True), stats, markdown=True).filter("session_id = 'one'").first()["text"]
    assert marked.startswith("# Session brief\n\n**Source:** `one.jsonl`\n**Rounds:** 1") and "> please start\n\n*on `main`*\n\n**Assistant** `[ix 1]`\n\nSure.\n\n**Tools** `[ix 1]`\n- [1] Read" in marked


def test_search(logs):
    found = rows(search.tool_uses(logs[2], "Read"), "session_id", "ix", "summary")
    assert found == [("one", 1, "Read  file_path=/root/p/a.ts")]
    assert rows(search.tool_results(logs[2], errors_only=True), "ix", "summary") == [(2, "t2  [ERROR]  bad")]


def test_condensed_blocks(logs):
    out = condense.condensed_blocks(logs[2], 60)
    (spilled,) = out.filter("tool_use_id = 't1' AND ix = 6").collect()
    stub = json.loads(spilled["json"])["result"]
    assert stub["ref"] == "spill/spill-1.txt" and stub["truncated"] and stub["preview"] == "x" and spilled["stubbed"]


def test_file_history(spark):
    snaps = spark.createDataFrame([("s", ix, json.dumps({"src/foo.ts": {"backupFileName": f"b{v}", "version": v, "backupTime": "t"}})) for ix, v in ((5, 1), (9, 1), (12, 2), (30, 3))], "session_id string, ix int, tracked string")
    versions = filehistory.file_versions(snaps)
    assert rows(versions, "version", "ix") == [(1, 5), (2, 12), (3, 30)]
    asked = spark.createDataFrame([("s", "src/foo.ts", 15), ("s", "src/foo.ts", 999), ("s", "src/foo.ts", 0), ("s", "other", 3)], "session_id string, path string, ix int")
    stored = spark.createDataFrame([("s", "b1", 7), ("s", "b2", 8)], "session_id string, blob string, bytes long")
    seen = filehistory.file_at(filehistory.with_blobs(versions, stored), asked)
    assert {(r["ix"], r["version"], r["status"], r["blob"]) for r in seen.collect()} == {(15, 2, "ok", "b2"), (999, 3, "no blob", None), (0, None, "too early", None), (3, None, "untracked", None)}
    got = filehistory.file_at(versions, asked).select("ix", "version", "status").collect()
    assert {tuple(r) for r in got} == {(15, 2, "ok"), (999, 3, "ok"), (0, None, "too early"), (3, None, "untracked")}


@pytest.mark.parametrize("span", [1, 7, 100, filehistory.SPAN])
def test_file_at_of_a_hot_file(spark, span):
    """One file holds most rows; ties, repeated requests, null keys and files without versions are among them."""
    r = random.Random(5)
    path = lambda: r.choice(["hot"] * 8 + ["cold", "other", None])
    place = lambda: (r.choice(["s", "s", "s", None]), path(), r.choice([None, *range(400)]))
    saved = [(*place(), r.choice([None, *range(1, 6)]), r.choice([None, "b1", "b2"])) for _ in range(250)]
    asked = [place() for _ in range(500)] + [("s", "unseen", 3)] * 2
    low = lambda *xs: tuple((x is not None, x if x is not None else 0) for x in xs[:2]) + tuple((x is not None, x or "") for x in xs[2:])

    def plain(s, p, ix):
        own = [v for v in saved if v[:2] == (s, p)]
        old = [v for v in own if v[2] is None or (ix is not None and v[2] <= ix)]
        if not old:
            return (s, p, ix, None, "too early" if any(v[3] is not None for v in own) else "untracked", None)
        v = max(old, key=lambda v: low(v[2], v[3], v[4]))
        return (s, p, ix, v[3], "ok" if v[4] is not None else "no blob", v[4])

    versions = spark.createDataFrame(saved, "session_id string, path string, ix int, version int, blob string")
    got = filehistory.file_at(versions, spark.createDataFrame(asked, "session_id string, path string, ix int"), span)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(*a) for a in asked), key=str)
    empty = versions.limit(0)
    assert filehistory.file_at(empty, empty.select("session_id", "path", "ix"), span).count() == 0


def test_file_at_deals_a_hot_file_to_ranges(spark):
    """No window over rows of a whole file: each that orders them is partitioned by range too."""
    rows = spark.range(4000).select(F.lit("s").alias("session_id"), F.lit("hot").alias("path"), F.col("id").cast("int").alias("ix"), F.col("id").cast("int").alias("version"))
    seen = filehistory.file_at(rows, rows.select("session_id", "path", "ix"), span=100)
    assert seen.filter("version = ix").count() == 4000
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "asks" in line]
    assert windows and all("range#" in line for line in windows)


def test_selectors_and_result_tokens(spark):
    calls = spark.createDataFrame([("mcp__x", "assistant"), ("Read", "user")], "tool_name string, type string")
    assert calls.filter(compact.selector("tool:mcp__*")).count() == 1 and calls.filter(compact.selector("type:user")).count() == 1
    with pytest.raises(ValueError):
        compact.selector("nothing")
    messages = spark.createDataFrame([("a", '{"m":{"inputTokens":3},"n":{"inputTokens":4,"outputTokens":1}}', None), ("b", "{}", '{"input_tokens":7,"output_tokens":2}')], "session_id string, model_usage string, usage string")
    assert rows(analyze.result_tokens(messages).filter("session_id = 'a'"), "input_tokens", "output_tokens", "cache_read") == [(7, 1, 0)]
    assert analyze.result_tokens(messages).filter("session_id = 'b'").first()["cache_read"] is None


def test_lint_reports_missing_parts_alone(spark):
    turns = spark.createDataFrame([("s", 3)], "session_id string, turn_count long")
    bad = spark.createDataFrame([("s", '{"summary":""}')], "session_id string, narrative string")
    assert narrative.lint(bad, turns).filter("error LIKE 'narrative missing required field:%'").count() == narrative.lint(bad, turns).count() == 8
    assert narrative.lint(narrative.placeholder(turns), turns).count() == 0


SESSION_ROWS = "session_id string, ix int, v int"


def table_of(spark, *parts):
    """Rows of (session, number of rows, value)."""
    return spark.createDataFrame([(s, i, v) for s, n, v in parts for i in range(n)], SESSION_ROWS)


def test_sinks_keep_other_sessions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_sessions(table_of(spark, ("a", 2, 1), ("b", 2, 1), ("c", 1, 1)), path, ("ix",)) == 1
    assert sinks.write_sessions(table_of(spark, ("b", 1, 2), ("d", 1, 2)), path, ("ix",)) == 2
    got = sinks.read_sessions(spark, path, SESSION_ROWS)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 1), ("a", 1, 1), ("b", 0, 2), ("c", 0, 1), ("d", 0, 2)]
    assert standing.read(spark, path, SESSION_ROWS, version=1).count() == 5  # an earlier version can still be read
    assert sinks.write_sessions(table_of(spark), path) == 3 and got.count() == 5
    assert sinks.write_sessions(table_of(spark), str(tmp_path / "none")) == 1 and sinks.read_sessions(spark, str(tmp_path / "none"), SESSION_ROWS).count() == 0


def test_files_grow_with_the_data_and_only_those_of_a_session_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_sessions(table_of(spark, *((f"s{i:03}", 40, 1) for i in range(100)), ("s500", 4_000, 1)), path, ("ix",), file_bytes=2_000)
    _, before = standing.current(spark, path)
    assert len(before) > 8 and sum(f["rows"] for f in before) == 8_000
    assert sum(f["low"] <= "s500" <= f["high"] for f in before) > 1  # a long session lies in several files
    sinks.write_sessions(table_of(spark, ("s007", 3, 2)), path, ("ix",), file_bytes=2_000)
    _, after = standing.current(spark, path)
    left = {f["file"] for f in before} & {f["file"] for f in after}
    assert len(before) - len(left) <= 2
    assert rows(sinks.read_sessions(spark, path, SESSION_ROWS, ["s007"]), "ix", "v") == [(0, 2), (1, 2), (2, 2)]
    # One entry is found without opening files of other sessions.
    opened = sinks.read_sessions(spark, path, SESSION_ROWS, ["s007"]).inputFiles()
    assert 1 <= len(opened) <= 2 < len(after)
    plan = sinks.read_sessions(spark, path, SESSION_ROWS, ["s007"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "s007" in plan
    assert standing.merge_small(spark, path, SESSION_ROWS, ("ix",), file_bytes=1 << 20) == 3
    assert len(standing.current(spark, path)[1]) == 1 and sinks.read_sessions(spark, path, SESSION_ROWS).count() == 7_963
    assert standing.vacuum(spark, path, keep=1) == 2 and sinks.read_sessions(spark, path, SESSION_ROWS).count() == 7_963


def test_a_stopped_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.write_sessions(table_of(spark, ("a", 1, 1)), path)

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(standing, "_put_in_place", stopped)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_sessions(table_of(spark, ("a", 1, 2)), path)
    assert rows(sinks.read_sessions(spark, path, SESSION_ROWS), "v") == [(1,)]
    sinks.write_sessions(table_of(spark, ("a", 1, 3)), path)
    assert rows(sinks.read_sessions(spark, path, SESSION_ROWS), "v") == [(3,)]


def test_writers_at_once_lose_nothing_and_share_no_id(spark, tmp_path, monkeypatch):
    path, put, others = str(tmp_path / "t"), standing._put_in_place, []

    def late(*args):
        if not others:  # another writer commits first
            others.append(1)
            standing.replace(table_of(spark, ("b", 1, 1), ("a", 1, 1)), path)
        return put(*args)

    with monkeypatch.context() as m:
        m.setattr(standing, "_put_in_place", late)
        assert standing.replace(table_of(spark, ("a", 1, 2), ("c", 1, 2)), path) == 2
    assert sorted(map(tuple, standing.read(spark, path, SESSION_ROWS).collect())) == [("a", 0, 2), ("b", 0, 1), ("c", 0, 2)]
    with pytest.raises(FileExistsError):
        standing.replace(table_of(spark, ("c", 1, 3)), path, only_new=True)

    ids, others, wanted = str(tmp_path / "ids"), [], spark.createDataFrame([("x",), ("y",)], "session_id string")
    real = standing.replace

    def raced(*args, **more):
        if not others:
            others.append(0)
            others[0] = rows(sinks.claim(wanted.filter("session_id = 'x'"), ids), "new_session_id")[0][0]
        return real(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(standing, "replace", raced)
        got = dict(rows(sinks.claim(wanted, ids), "session_id", "new_session_id"))
    assert len({others[0], *got.values()}) == 3


def test_numbers_of_one_log_of_many_splits(spark):
    found = jsonl.numbered(spark.range(1_000).selectExpr("concat('one', id DIV 1000) AS session_id", "id DIV 37 AS split", "id"), ["session_id"], ["split"], ["id"], "n")
    assert {r["id"] == r["n"] for r in found.collect()} == {True}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(session_id#\d+, split#", plan)
    entries = spark.range(500).selectExpr("'one' AS session_id", "id AS line_no", "CASE WHEN id % 5 = 0 THEN 'r' || id DIV 10 END AS request_id")
    whole, short = (rows(jsonl.collapse_rolls(entries, n), "line_no", "ix") for n in (100_000, 7))
    assert whole == short and [ix for _, ix in whole] == list(range(len(whole)))


def test_ids_of_any_shape_are_found_in_one_pass(spark):
    rng = random.Random(4)
    strings = {b"a", b"ab", b"aba", b"session-0000001", b"session-00000012", b"\xc3\xa9t\xc3\xa9", b"x" * 40, b"x" * 9}
    strings |= {bytes(rng.choice(b"abx-") for _ in range(rng.randint(1, 14))) for _ in range(300)}
    text = b"session-0000001234 ababa " + "été".encode() + b"x" * 45 + bytes(rng.choice(b"abx- ") for _ in range(3_000))
    finder = matching.Finder(list(strings))
    want = {s: sum(text.startswith(s, i) for i in range(len(text))) for s in strings}
    assert {finder.strings[i]: n for i, n in finder.counts(text).items()} == {s: n for s, n in want.items() if n}
    assert matching.Finder([]).counts(text) == {} and finder.counts(b"") == {}
    texts = spark.createDataFrame([("p", "see id-1 and id-12"), ("q", None), ("r", ""), ("s", "Id-1")], "location string, text string")
    ids = spark.createDataFrame([("id-1",), ("id-12",), ("",), (None,), ("id-1",)], "id string")
    for most in (1 << 20, 5):
        assert rows(scan.known_ids(texts, ids, most), "location", "id", "places") == [("p", "id-1", 2), ("p", "id-12", 1)]
    assert scan.known_ids(texts, ids.filter("false")).count() == 0


def test_a_hundred_thousand_ids(spark):
    ids = spark.range(100_000).selectExpr("'session-' || sha2(string(id), 256) AS id")
    texts = spark.range(200).selectExpr("string(id) AS location", "repeat('text session-0 ', 50) || 'session-' || sha2(string(id * 500), 256) AS text")
    assert scan.known_ids(texts, ids).count() == 200


def test_plan_stays_in_the_engine(spark, sf_dir):
    from sessionlog import queries

    for name in ("a1_tokens_by_model", "a8_failures", "b5_round_stream", "f1_file_at"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan and F


def test_compacted_logs(spark, logs, tmp_path):
    from sessionlog.jobs.compact_sessions import compact_sessions

    out = compact_sessions(logs[1], logs[2], keep=1)
    lines = [json.loads(r["raw"]) for r in out.filter("session_id = 'one'").orderBy("section", "ix").collect()]
    assert [x["type"] for x in lines] == ["user", "user", "assistant", "user"]  # the bundle, then the last round
    assert '<turn ix="0" kind="user">\nplease start\n</turn>' in lines[0]["message"]["content"] and 'error="true"' in lines[0]["message"]["content"]
    assert lines[0]["parentUuid"] is None and [x.get("parentUuid", lines[i - 1]["uuid"]) for i, x in enumerate(lines) if i] == [x["uuid"] for x in lines[:-1]]
    assert len({x.get("sessionId") for x in lines if "sessionId" in x}) == 1
    assert lines[0]["version"] == "" and lines[0]["timestamp"].endswith("Z") and {"cwd", "gitBranch"} <= lines[0].keys()
    sinks.write_compacted(out, str(tmp_path / "c"))
    read = sinks.read_compacted(spark, str(tmp_path / "c"))
    sent = out.orderBy("new_session_id", "section", "ix").collect()
    assert [r["raw"] for r in read.orderBy("session_id", "line_no").collect()] == [r["raw"] for r in sent]
    with pytest.raises(Exception, match="(?i)some of these"):
        sinks.write_compacted(out, str(tmp_path / "c"))


def test_compacting_returns_the_lines_that_it_wrote(spark, logs, tmp_path):
    from sessionlog.jobs.compact_sessions import write_compacted_sessions

    made = write_compacted_sessions(logs[1], logs[2], str(tmp_path / "c"), at="2026-01-01T00:00:00Z")
    read = sinks.read_compacted(spark, str(tmp_path / "c")).orderBy("session_id", "line_no").collect()
    assert [(r["session_id"], r["raw"]) for r in read] == [(r["new_session_id"], r["raw"]) for r in made.orderBy("new_session_id", "section", "ix").collect()]
    assert {r["session_id"] for r in made.collect()} == {"one", "two", "one/agent-7"} and not list((tmp_path / "c").rglob("log=*"))


def test_an_image_over_the_cap_is_a_stub_among_stubbed_entries(spark, tmp_path):
    """n4_artifacts counts such an entry (kind 5 of sources.rich); its SQL leaves that kind out."""
    from sessionlog.jobs.distill import condensed_report

    image = lambda n: {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "x" * n}}
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(assistant([image(n)], f"u{n}", f"r{n}")) + "\n" for n in (2048, 2049)))
    entries = jsonl.read_entries(spark, str(tmp_path))
    assert rows(condensed_report(entries, jsonl.blocks(entries)), "stubbed_entries", "stubbed_parts") == [(1, 1)]


def test_many_logs_lie_in_few_files(spark, tmp_path):
    lines = [(f"s{n}", ix, json.dumps({"type": "user", "uuid": f"{n}-{ix}", "message": {"role": "user", "content": "a.jsonl:b"}})) for n in range(60) for ix in range(12)]
    frame = spark.createDataFrame(lines, "session string, line_no int, raw string").repartition(7)
    want = sorted((s, ix, json.loads(raw)["uuid"]) for s, ix, raw in lines)
    for apart in (False, True):
        root = tmp_path / str(apart)
        sinks.write_log(frame, str(root), apart)
        read = jsonl.read_entries(spark, str(root))
        assert sorted((r["session_id"], r["ix"], r["uuid"]) for r in read.collect()) == want
        assert (len(list(root.rglob("part-*"))) < 60) is not apart
        assert read.select("session_id", "path").distinct().count() == 60
    # A log in a bundle is in order over many splits and files.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert [r["uuid"] for r in jsonl.read_entries(spark, str(tmp_path / "False")).filter("session_id = 's7'").orderBy("ix").collect()] == [f"7-{i}" for i in range(12)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_entries_that_are_no_messages_are_rendered_as_json(spark, tmp_path):
    log = [user("hi", "u1"), {"type": "attachment", "attachment": {"type": "note", "é": [1, {}]}}, {"type": "summary", "summary": "s"}, assistant([{"type": "thinking", "thinking": "hm"}], "u2", "r1")]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in log))
    entries = jsonl.read_entries(spark, str(tmp_path))
    text = dict(rows(search.render(entries, jsonl.blocks(entries)), "ix", "text"))
    assert text[1] == json.dumps(log[1], ensure_ascii=False, indent=2) and text[2] == json.dumps(log[2], indent=2)
    assert text[3] == '[assistant · sonnet]\n[thinking] {"type":"thinking","thinking":"hm"}' and len(text) == 4


def test_copied_spills_count_once_over_a_session_and_its_subagents(spark):
    spills = spark.createDataFrame([("s", "/a"), ("s", "/a"), ("s/agent-1", "/a"), ("s/agent-1", "/b"), ("s", "/gone")], "session_id string, path string")
    parents = spark.createDataFrame([("s", "s"), ("s/agent-1", "s")], "session_id string, root string")
    sources = condense.spill_sources(spills, spark.createDataFrame([("/a",), ("/b",)], "path string"), parents)
    condensed = spark.createDataFrame([("s", 0, True), ("s", 1, False), ("s", 2, True)], "session_id string, ix int, stubbed boolean")
    stats = spark.createDataFrame([("s", None, 3, 90, 40, 2), ("s", "user:text", 3, 90, 40, 2)], "session_id string, kind string, count int, orig_bytes int, inlined_bytes int, truncated int")
    subs = spark.createDataFrame([("s", "s/agent-1")], "session_id string, sub string")
    assert [tuple(r) for r in condense.stage_summary(condensed, sources, subs, stats).collect()] == [("s", [0, 2], 2, 1, 3, 90, 40, 2)]


def test_issues_of_contents(spark):
    texts = spark.createDataFrame([("b/2", "mail a@b.org\nand c@d.org"), ("a/1", "mail a@b.org\nand c@d.org"), ("a/3", "x e@f.org"), ("a/3", "nothing"), ("a/4", None), ("a/5", "")], "location string, text string")
    found = scan.content_issues(texts)
    assert sorted((r["places"], r["location"], r["line_no"], r["match"]) for r in found.collect()) == [(1, "a/3", 1, "e@f.org"), (2, "a/1", 1, "a@b.org"), (2, "a/1", 2, "c@d.org")]
    assert scan.content_issues(texts.limit(0)).count() == 0
    exchanges = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert exchanges and not any("any_value" in line or "first(text" in line for line in exchanges)
