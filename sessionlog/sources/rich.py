"""The conversations table as full log lines: thirteen kinds of entries, in turn.

Every kind is a template of JSON, with what condensing makes of it beside it; the
same templates give the column expressions and the SQL that checks them. Marks:
<t> the turn's text as JSON, <T> the same, or its stub where it is long, <c> the
conversation, <ix> the entry's place, <ex> the place before, <p> the parent's uuid
as JSON, <ts> the time, <ref> the file of the full entry.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlog.functions.text import json_quote

INLINE = 500
ENVELOPE = '"uuid":"u-<c>-<ix>","parentUuid":<p>,"sessionId":"<c>","timestamp":"<ts>","cwd":"/work/<c>","gitBranch":"b<b>","version":"1.<b>"'
SPILL = "<persisted-output>\\nOutput too large (51.3KB). Full output saved to: /spill/<c>/r<ix>.txt\\n\\nPreview (first 2KB):\\nhead of it"


def _call(own: str, name: str, given: str) -> str:
    return '{"type":"tool_use","id":"tool-<c>-<ix>-' + own + '","name":"' + name + '","input":{' + given + "}}"


def _result(own: str, key: str, content: str, error: bool = False) -> str:
    return '{"type":"tool_result","tool_use_id":"tool-<c>-<ex>-' + own + '","' + key + '":' + content + (',"is_error":true' if error else "") + "}"


def _image(data: str) -> str:
    return '{"type":"image","source":{"type":"base64","media_type":"image/png","data":' + data + "}}"


#: Content blocks of each kind of message: as logged, as condensed, and the kind that statistics count them under.
BLOCKS: dict[int, list[tuple[str, str, str]]] = {
    1: [
        ('{"type":"thinking","thinking":<t>,"signature":"s<ix>"}', '{"type":"thinking","thinking":<T>,"signature":"s<ix>"}', "assistant:thinking"),
        ('{"type":"text","text":<t>}', '{"type":"text","text":<T>}', "assistant:text"),
        (_call("a", "Bash", '"command":<t>,"description":"try it","timeout":5'), _call("a", "Bash", '"command":<T>,"description":"try it","timeout":5'), "tool_use:Bash"),
    ],
    2: [(_result("a", "content", "<t>", True), _result("a", "result", "<T>", True), "tool_result:Bash")],
    3: [
        (_call("a", "Grep", '"pattern":"x","path":"/work","-n":true,"head_limit":5'), _call("a", "Grep", '"pattern":"x","path":"/work","-n":true,"head_limit":5'), "tool_use:Grep"),
        (_call("b", "TodoWrite", '"todos":[{"content":<t>,"status":"done"}]'), _call("b", "TodoWrite", '"todos":[{"content":<t>,"status":"done"}]'), "tool_use:TodoWrite"),
    ],
    4: [
        ('{"type":"text","text":<t>}', '{"type":"text","text":<T>}', "assistant:text"),
        (_result("b", "content", '[{"type":"text","text":<t>},' + _image("<t>") + "]", True), _result("b", "result", '[{"type":"text","text":<T>},' + _image("<T>") + "]", True), "tool_result:TodoWrite"),
    ],
    5: [
        (_call("a", "MultiEdit", '"file_path":"/work/f.ts","edits":[{"old_string":<t>,"new_string":"x"}]'), _call("a", "MultiEdit", '"file_path":"/work/f.ts","edits":[{"old_string":<t>,"new_string":"x"}]'), "tool_use:MultiEdit"),
        (_image("<t>"), _image("<T>"), "assistant:image"),
    ],
    6: [(_result("a", "content", f'"{SPILL}"'), _result("a", "result", '{"truncated":true,"ref":"spill/r<ix>.txt","bytes":<spilled>,"tokens_est":<spilled4>,"preview":"head of it"}'), "tool_result:MultiEdit")],
    8: [
        ('{"type":"text","text":<t>}', '{"type":"text","text":<T>}', "assistant:text"),
        (_call("a", "Task", '"subagent_type":"explorer","description":"look","prompt":<t>'), _call("a", "Task", '"subagent_type":"explorer","description":"look","prompt":<T>'), "tool_use:Task"),
        (_call("b", "TaskCreate", '"subject":<t>'), _call("b", "TaskCreate", '"subject":<T>'), "tool_use:TaskCreate"),
    ],
    9: [(_result("b", "content", "<t>"), _result("b", "result", "<T>"), "tool_result:TaskCreate")],
    11: [
        (_call("a", "mcp__demo__send", '"chat":5,"text":<t>,"opts":{"deep":<t>},"none":null'), _call("a", "mcp__demo__send", '"chat":5,"text":<T>,"opts":{"deep":<t>},"none":null'), "tool_use:mcp__demo__send"),
        ('{"type":"other_kind","body":{"deep":[<t>]}}', '{"type":"other_kind","body":{"deep":[<T>]}}', "block:other_kind"),
    ],
}
#: Entries that aren't messages: type, payload as logged and as condensed.
PAYLOADS: dict[int, tuple[str, str, str]] = {
    7: ("attachment", '"attachment":{"type":"hook_success","content":<t>}', '"attachment":{"type":"hook_success","content":<T>}'),
    10: ("permission-mode", '"permissionMode":"plan"', '"permissionMode":"plan"'),
    12: ("file-history-snapshot", '"messageId":"m<ix>","snapshot":{"trackedFileBackups":{"/work/f.ts":{"backupFileName":"f@v<ix>","version":<ix>,"backupTime":"<ts>"}}}', '"messageId":"m<ix>","snapshot":{"trackedFileBackups":{"/work/f.ts":{"backupFileName":"f@v<ix>","version":<ix>,"backupTime":"<ts>"}}}'),
}
MODELS = {1: "model-a", 3: "model-a", 5: "model-b", 8: "model-b", 11: "<synthetic>"}


def _line(k: int) -> str:
    if k in PAYLOADS:
        kind, payload, _ = PAYLOADS[k]
        # Without an id of their own, as structural entries are.
        return '{"type":"' + kind + '","sessionId":"<c>",' + ('"uuid":"u-<c>-<ix>",' if k == 7 else "") + payload + "}"
    if k == 0:
        return '{"type":"user",' + ENVELOPE + ',"promptId":"p<ix>","message":{"role":"user","content":<t>}}'
    content = "[" + ",".join(raw for raw, _, _ in BLOCKS[k]) + "]"
    if k in MODELS:
        usage = '"usage":{"input_tokens":<ix>,"output_tokens":<len>' + (',"cache_read_input_tokens":7' if k in (1, 11) else "") + "}"
        return '{"type":"assistant",' + ENVELOPE + ',"requestId":"req-<c>-<ix>","message":{"id":"msg-<ix>","role":"assistant","model":"' + MODELS[k] + '","content":' + content + "," + usage + "}}"
    return '{"type":"user",' + ENVELOPE + ',"message":{"role":"user","content":' + content + "}}"


LINES = {k: _line(k) for k in range(13)}


def condensed_content(k: int) -> str:
    """The template of an entry's condensed content."""
    if k in PAYLOADS:
        return "{" + PAYLOADS[k][2] + "}"
    return "<T>" if k == 0 else "[" + ",".join(c for _, c, _ in BLOCKS[k]) + "]"


def _parts(template: str) -> list[str]:
    return [x for x in re.split(r"(<(?:t|T|c|ix|ex|p|ts|b|len|ref|spilled|spilled4|X|X100|bytes)>)", template) if x]


_MARK = re.compile(r"^<(\w+)>$")
_SPILLED = f"({len(re.sub(r'<(c|ix)>', '', SPILL).replace(chr(92) + 'n', ' '))} + strlen(CAST(c AS VARCHAR)) + strlen(CAST(ix AS VARCHAR)))"
SQL_MARKS = {
    "t": "CAST(to_json(t) AS VARCHAR)", "c": "CAST(c AS VARCHAR)", "ix": "CAST(ix AS VARCHAR)", "ex": "CAST(ix - 1 AS VARCHAR)", "b": "CAST(ix // 3 AS VARCHAR)", "len": "CAST(length(t) AS VARCHAR)",
    "p": "CASE WHEN ix = 0 THEN 'null' ELSE '\"u-' || c || '-' || (ix - 1) || '\"' END", "ts": "'2026-01-01T00:' || lpad(CAST(ix // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ix % 60 AS VARCHAR), 2, '0') || '.000Z'",
    "ref": "'turns/' || lpad(CAST(ix AS VARCHAR), 5, '0') || '.json'",
    "T": f"CASE WHEN strlen(t) > {INLINE} THEN CAST(to_json({{'truncated': true, 'ref': 'turns/' || lpad(CAST(ix AS VARCHAR), 5, '0') || '.json', 'bytes': strlen(t), 'tokens_est': (strlen(t) + 2) // 4, 'preview': left(t, 500)}}) AS VARCHAR) ELSE CAST(to_json(t) AS VARCHAR) END",
    "spilled": f"CAST({_SPILLED} AS VARCHAR)", "spilled4": f"CAST(({_SPILLED} + 2) // 4 AS VARCHAR)",
    "X": "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "X100": "replace(replace(replace(left(t, 100), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "bytes": "CAST(strlen(t) AS VARCHAR)",
}


def sql(template: str) -> str:
    """A template as a DuckDB expression over x."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "(" + " || ".join(f"({SQL_MARKS[m[1]]})" if (m := _MARK.match(p)) else quoted(p) for p in _parts(template)) + ")"


def expression(template: str) -> Column:
    """A template as a column over rows()."""
    c, ix, t = F.col("c"), F.col("ix"), F.col("t")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    marks = {
        "t": json_quote(t), "c": c.cast("string"), "ix": ix.cast("string"), "ex": (ix - 1).cast("string"), "b": F.floor(ix / 3).cast("string"), "len": F.length(t).cast("string"),
        "p": F.when(ix == 0, "null").otherwise(F.concat(F.lit('"u-'), c.cast("string"), F.lit("-"), (ix - 1).cast("string"), F.lit('"'))), "ts": F.concat(F.lit("2026-01-01T00:"), two(F.floor(ix / 60) % 60), F.lit(":"), two(ix % 60), F.lit(".000Z")),
    }
    return F.concat(*[marks[m[1]] if (m := _MARK.match(p)) else F.lit(p) for p in _parts(template)])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with c, ix, t and the kind k of each entry."""
    e = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("c"), "turn", F.col("text").alias("t"))
    e = e.withColumn("ix", (F.row_number().over(Window.partitionBy("c").orderBy("turn")) - 1).cast("int"))
    k = (F.col("c") * 5 + F.col("ix")) % 12
    return e.withColumn("k", F.when((k == 10) & (F.col("c") % 2 == 1), 12).otherwise(k).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: path, line_no, raw. Every fifth conversation is a subagent's of the one before."""
    e, raw = rows(spark, sf_dir), None
    for k, template in LINES.items():
        raw = F.when(F.col("k") == k, expression(template)) if raw is None else raw.when(F.col("k") == k, expression(template))
    c = F.col("c").cast("string")
    own = F.concat(F.lit("/logs/"), F.when(F.col("c") % 5 == 4, F.concat((F.col("c") - 1).cast("string"), F.lit("/subagents/agent-"), c)).otherwise(c), F.lit(".jsonl"))
    return e.select(own.alias("path"), F.col("ix").alias("line_no"), raw.alias("raw"))


_CASES = " ".join(f"WHEN {k} THEN {sql(template)}" for k, template in LINES.items())
_CONTENTS = " ".join(f"WHEN {k} THEN {sql(condensed_content(k))}" for k in LINES)
_TYPES = " ".join(f"WHEN {k} THEN '{PAYLOADS[k][0] if k in PAYLOADS else 'assistant' if k in MODELS else 'user'}'" for k in LINES)
_EACH = " UNION ALL ".join(f"SELECT session_id, ix, k, c, t, type, {j} AS block_ix, {sql(raw)} AS block, {sql(cut)} AS condensed, '{kind}' AS kind FROM x WHERE k = {k}" for k, own in BLOCKS.items() for j, (raw, cut, kind) in enumerate(own))
#: The same in DuckDB: x (entries), xb (blocks).
SQL = f"""WITH x0 AS (SELECT conv_id AS c, text AS t, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ix FROM conversations),
x1 AS (SELECT *, CASE WHEN (c * 5 + ix) % 12 = 10 AND c % 2 = 1 THEN 12 ELSE (c * 5 + ix) % 12 END AS k, CASE WHEN c % 5 = 4 THEN CAST(c - 1 AS VARCHAR) END AS parent_session_id, CASE WHEN c % 5 = 4 THEN (c - 1) || '/agent-' || c ELSE CAST(c AS VARCHAR) END AS session_id FROM x0),
x AS (SELECT *, CASE k {_TYPES} END AS type, CASE k {_CASES} END AS raw, CASE k {_CONTENTS} END AS condensed FROM x1),
xb0 AS ({_EACH}),
xb AS (SELECT session_id, ix, k, c, t, type, block_ix, block, condensed, CASE WHEN kind LIKE 'tool_result:%' AND ix = 0 THEN 'tool_result:<unknown>' ELSE kind END AS kind, strlen(block) AS orig, strlen(condensed) AS inlined, contains(condensed, '"truncated":true') AS cut FROM xb0)
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as entries."""
    from .jsonl import parsed, placed

    return parsed(placed(lines(spark, sf_dir)))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jsonl import blocks as blocks_of

    return blocks_of(entries(spark, sf_dir))
