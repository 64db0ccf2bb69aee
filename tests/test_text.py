"""Text functions and one-line forms, value by value."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlog.functions import text as T
from sessionlog.functions.jsonwalk import condensed, pretty, sweep, unwalked, with_ids
from sessionlog.functions.oneliners import one_liner, parsed_input, result_text


def value(spark, column, **columns):
    rows = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return rows.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("old", "new", "added", "deleted"),
    [("a\nb\nc", "a\nX\nc", 1, 1), ("a", "a", 0, 0), ("a\nb", "a\nb\nc\nd", 2, 0), ("a\nb\nc", "c", 0, 2), ("", "x", 1, 1), ("a\na", "a", 0, 1), ("x\ny", "p\nq\nr", 3, 2)],
)
def test_diff_stat(spark, old, new, added, deleted):
    assert tuple(value(spark, T.diff_stat(F.col("a"), F.col("b")), a=old, b=new)) == (added, deleted)


@pytest.mark.parametrize(
    ("path", "short"), [("/root/proj/src/a.ts", "src/a.ts"), ("/home/me/x.py", "x.py"), ("/Users/me/a/b", "a/b"), ("/var/log/x", "/var/log/x"), ("/home/me", "/home/me"), ("rel/x", "rel/x")]
)
def test_short_path(spark, path, short):
    assert value(spark, T.short_path(F.col("p")), p=path) == short


@pytest.mark.parametrize(
    ("text", "hash_", "subject"),
    [("[main abc1234] fix: a thing\n 1 file", "abc1234", "fix: a thing"), ("x\n[dev 0123456789ab (root-commit)] start", "0123456", "start"), ("nothing here", None, None), ("[main zzz] no", None, None)],
)
def test_commit(spark, text, hash_, subject):
    assert value(spark, F.struct(T.commit_hash(F.col("t")), T.commit_subject(F.col("t"))), t=text) == (hash_, subject)


@pytest.mark.parametrize(
    ("text", "bare"),
    [("<system-reminder>a\nb</system-reminder>", True), (" <command-name>x</command-name>\n<command-args></command-args> ", True), ("<command-name>x</command-name> do it", False), ("hello", False), ("", True), ("</foo-bar>", True)],
)
def test_wrapper_only(spark, text, bare):
    assert value(spark, T.wrapper_only(F.col("t")), t=text) is bare


def test_shorten_quote_and_escape(spark):
    assert value(spark, T.shorten(F.col("t"), 5), t="abcdefg") == "abcd…"
    assert value(spark, T.shorten(F.col("t"), 50), t="a\nb") == "a ⏎ b"
    assert value(spark, T.json_quote(F.col("t")), t='a"b\nc') == '"a\\"b\\nc"'
    assert value(spark, T.xml_attr(F.col("t")), t='<a & "b">\x01') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert value(spark, T.trim_all(F.col("t")), t=" \n x \t") == "x"


LINES = [
    ("Read", {"file_path": "/root/p/a.ts"}, "1\tabcd\n2\tefgh\n", False, "Read a.ts — 2 lines, ~3 tokens"),
    ("Read", {"file_path": "/root/p/a.ts", "offset": 5}, "", False, "Read a.ts (offset=5, limit=?) — 0 lines, ~0 tokens"),
    ("Read", {}, "boom\nmore", True, "Read <no path> → [error: boom]"),
    ("Edit", {"file_path": "x", "old_string": "a\nb", "new_string": "a\nc\nd", "replace_all": True}, "", False, "Edit x (replace_all) +2 -1"),
    ("Write", {"file_path": "x", "content": "ab\ncd"}, "ok", False, "Write x — 2 lines, ~1 tokens"),
    ("Grep", {"pattern": "foo", "path": "/home/me/src"}, "Found 12 files\na", False, 'Grep "foo" in src — 12 matches'),
    ("Grep", {"pattern": "foo"}, "a\n\nb\n", False, 'Grep "foo" — 2 matches'),
    ("Glob", {"pattern": "*.ts"}, "a\nb", False, 'Glob "*.ts" — 2 matches'),
    ("Bash", {"command": "git commit", "description": "Commit"}, "[main abc1234] msg", False, 'Bash `git commit` (Commit) — ~5 tok out  → commit abc1234 "msg"'),
    ("Bash", {"command": "ls"}, "", True, "Bash `ls` — ~0 tok out [error]"),
    ("Task", {"subagent_type": "rev", "description": "look"}, "abcdefgh", False, 'Task → rev: "look" — returned ~2 tok'),
    ("TaskUpdate", {"taskId": "3", "status": "done"}, "", False, "TaskUpdate #3 [done]"),
    ("mcp__plugin_playwright_playwright__click", {"z": "q", "ref": "e1"}, "", False, 'click(ref="e1")'),
    ("Other", {"list": [1], "n": 5, "s": "x"}, "", False, 'Other n="5"'),
    ("Other", {}, "", True, "Other [error]"),
]


@pytest.mark.parametrize(("name", "given", "result", "failed", "line"), LINES)
def test_one_liner(spark, name, given, result, failed, line):
    rows = spark.createDataFrame([(name, json.dumps(given), result)], "name string, input string, result string").withColumn("given", parsed_input("input"))
    assert rows.select(one_liner(F.col("name"), F.col("given"), F.col("result"), F.lit(failed)).alias("v")).first()["v"] == line


def test_result_text(spark):
    form = lambda kind: result_text(F.col("c"), F.lit(kind))
    assert value(spark, form("array"), c='[{"type":"text","text":"a"},{"content":"b"},{"x":1}]') == "a\nb"
    assert value(spark, form("string"), c="plain") == "plain"
    assert value(spark, form("object"), c=None) == ""


def test_json_walks_keep_order_and_cap(spark):
    text = json.dumps({"z": "x" * 9, "a": {"b": "y" * 9}, "n": 1}, separators=(",", ":"))
    ref = F.lit("turns/00001.json")
    deep = json.loads(value(spark, condensed(F.col("t"), ref, 8)["json"], t=text))
    assert list(deep) == ["z", "a", "n"] and deep["a"]["b"]["bytes"] == 9 and deep["z"]["truncated"]
    call = json.dumps({"type": "tool_use", "id": "i", "name": "X", "input": json.loads(text)}, separators=(",", ":"))
    top = json.loads(value(spark, condensed(F.col("t"), ref, 8)["json"], t=call))["input"]  # strings at the top alone
    assert top["a"]["b"] == "y" * 9 and top["z"]["ref"] == "turns/00001.json"
    assert value(spark, condensed(F.col("t"), ref, 9)["json"], t=text) == text  # a value at the cap stays
    assert not value(spark, condensed(F.col("t"), ref, 9)["stubbed"], t=text)
    assert "[truncated: 9 bytes; preview: yyy" in value(spark, sweep(F.col("t"), 8), t=text)
    assert value(spark, pretty(F.col("t")), t='{"b":1,"a":[]}') == '{\n  "b": 1,\n  "a": []\n}'
    assert value(spark, with_ids(F.col("t"), F.create_map(F.lit("uuid"), F.lit("n"), F.lit("other"), F.lit("m"))), t='{"b":1,"uuid":"o"}') == '{"b":1,"uuid":"n"}'


def test_ids_of_many_rows_of_a_batch(spark):
    rows = spark.range(0, 1203, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('{"uuid":"o","n":'), F.col("id").cast("string"), F.lit("}"))).alias("t"))
    got = rows.select("id", with_ids(F.col("t"), F.create_map(F.lit("uuid"), F.col("id").cast("string"))).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == [f'{{"uuid":"{i}","n":{i}}}' if i % 7 else None for i in range(1203)]


def _some_json(r: random.Random, depth: int):
    kind = r.randrange(7 if depth else 5)
    if kind == 0:
        return "".join(r.choice('ab ,:{}[]"\\\n\t\x01\x0b\x7fé😀') for _ in range(r.randrange(9)))
    if kind < 5:
        return (None, r.choice([0, -7, 12345678901, True, False]), r.choice([0.5, -0.25, 1e-7, 1e20, 3.0, 0.0001, -0.0]), "plain", None)[kind]
    inner = [_some_json(r, depth - 1) for _ in range(r.randrange(4))]
    return inner if kind == 5 else {r.choice(["a", "b", 'q"', "long key"]) + str(i): v for i, v in enumerate(inner)}


def _some_block(r: random.Random) -> str:
    given = {f"k{i}": _some_json(r, 3) for i in range(r.randrange(4))}
    word = _some_json(r, 0)
    block = r.choice([
        {"type": "text", "text": word}, {"type": "thinking", "thinking": "x", "signature": word}, {"type": "tool_use", "id": "i", "name": "N", "input": given}, {"type": "strange"} | given, given,
        {"type": "tool_result", "tool_use_id": "i", "content": word, "is_error": r.choice([True, False, None])}, {"tool_use_id": "i", "type": "tool_result", "content": [{"type": "text", "text": "y"}, {"type": "image", "source": {"type": "b", "media_type": "m", "data": "d"}}]},
        {"type": "image", "source": {"type": "b", "media_type": "m", "data": word}}, {"type": "tool_result", "tool_use_id": "i", "content": [given, word]},
    ])
    return json.dumps(block, ensure_ascii=r.random() < 0.2, separators=r.choice([(",", ":")] * 5 + [(", ", ": ")]))


def test_unwalked_blocks_are_as_walked(spark):
    r = random.Random(5)
    own = [
        '{"type":"tool_use","id":"i","name":"N","input":{"a":1,"b":2,"a":3}}', '{"type":"tool_use","id":"i","name":"N","input":{"a":{"x":1,"x":{"y":[]}}}}', '{"type":"text","text":"a","text":"b"}', '{"type":"strange","type":"text","text":"b"}',
        '{"type":"tool_use","id":"i","name":"N","input":{"foo,":1,":y":1,"k":"x,",":y":2}}', '{"type":"text","text":"\\u00e9"}', '{"type":"text","text":"a\\/b"}', '{"type":"text","text":"\\u0009"}', '{"type":"tool_use","id":"i","name":"N","input":{"n":1.0,"m":1.50,"o":-0,"p":1e3,"q":0.00001}}',
        '{"type":"tool_result","tool_use_id":"i","content":"<persisted-output>\\nOutput too large (1KB). Full output saved to: /s/x.txt\\n\\nPreview (a):\\nhead"}', '{"type":"tool_result","tool_use_id":"i","content":"x","is_error":true,"is_error":false}', '{"type":"strange","l":[[[[1]]]]}', '{"type":"text","text":"' + "x" * 300 + '"}',
        '{"type":"tool_use","id":"i","name":"N","input":{}}', '{"type":"tool_use","id":"i","name":"N","input":{"edits":[{"a":"x","b":"y"},{"a":"z","b":"w"}]}}', '{"type":"tool_use","id":"i","name":"N","input":[]}', '{"type":"text"}',
    ]
    blocks = own + [_some_block(r) for _ in range(1500)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)] + [(-1, None)], "ix int, block string").repartition(4)
    walked = rows.select("ix", "block", F.explode(F.array(condensed(F.col("block"), F.lit("r"), 200))).alias("w"), unwalked(F.col("block"), 200).alias("own"))
    found = walked.select("ix", "block", "w.*", "own").collect()
    for row in found:
        assert row["own"] is None or (row["own"] == row["json"] and not row["stubbed"] and row["orig"] == len(row["block"].encode())), row
    plain = {row["ix"] for row in found if row["own"] is not None}
    assert len(plain) > 500 and {13, 14} <= plain and not plain & {-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16}


def test_unwalked_takes_long_lists(spark):
    listed = json.dumps({"type": "tool_use", "id": "i", "name": "N", "input": {"l": list(range(1, 900)), "s": "\n" * 100}}, separators=(",", ":"))
    keys = json.dumps({"type": "tool_use", "id": "i", "name": "N", "input": {f"k{i}": 1 for i in range(300)}}, separators=(",", ":"))
    for block in (listed, keys):
        assert value(spark, unwalked(F.col("t"), 4096), t=block) == block
