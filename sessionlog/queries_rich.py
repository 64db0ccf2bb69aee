"""Registered queries over conversations as full log lines (sources.rich), and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.functions.oneliners import result_text
from sessionlog.jobs import compact_sessions as job
from sessionlog.jobs.distill import distill
from sessionlog.operators import analyze, compact, condense, filehistory, metadata, rounds, search
from sessionlog.sources import jsonl, rich, sinks, store
from sessionlog.sources.rich import INLINE, SQL, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
GENERATED_AT = "2026-01-01T00:00:00Z"
COUNTERS = analyze.COUNTERS


def _of(name: str, function: Callable, *sources: Callable, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, d: function(*[s(spark, d) for s in sources])) if sources else function
    if sql is not None:
        ORACLE_SQL[name] = sql


def _stored(function: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Of entries and blocks that are stored first."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        entries = store.cut(rich.entries(spark, d))
        return function(entries, store.cut(jsonl.blocks(entries)))

    return run


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.placed(rich.lines(spark, d))


# --- reading ---------------------------------------------------------------------
_USED = ", assistant AS (SELECT *, CASE k WHEN 1 THEN 'model-a' WHEN 3 THEN 'model-a' WHEN 5 THEN 'model-b' WHEN 8 THEN 'model-b' WHEN 11 THEN '<synthetic>' END AS model, CAST(ix AS BIGINT) AS input_tokens, CAST(length(t) AS BIGINT) AS output_tokens, CASE WHEN k IN (1, 11) THEN CAST(7 AS BIGINT) END AS cache_read, CAST(NULL AS BIGINT) AS cache_write FROM x WHERE type = 'assistant')"
_TOTALS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (model <> '<synthetic>'), 0) AS BIGINT) AS {c}" for c in COUNTERS)


def _written(spark: SparkSession, d: str) -> DataFrame:
    """The main logs written as JSONL and read back."""
    folder = f"{store.fresh_folder(spark)}/logs"
    sinks.write_log(_lines(spark, d).filter("parent_session_id IS NULL").select(F.col("session_id").alias("session"), "line_no", "raw"), folder)
    return jsonl.read_entries(spark, folder).select("session_id", "ix", "type", "uuid", "model", "output_tokens", "content_text")


_of("s1_read_logs", lambda e: e, _written, sql=SQL + _USED + " SELECT x.session_id, x.ix, x.type, CASE WHEN x.k NOT IN (10, 12) THEN 'u-' || x.c || '-' || x.ix END AS uuid, a.model, a.output_tokens, CASE WHEN x.k = 0 THEN x.t END AS content_text FROM x LEFT JOIN assistant a USING (session_id, ix) WHERE x.parent_session_id IS NULL")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    heads = lines.select(F.substring("session_id", 1, 2).alias("prefix")).unionByName(lines.filter("session_id LIKE '1%'").select(F.col("path").alias("prefix"))).distinct()
    return heads.unionByName(spark.createDataFrame([("no-such",), ("/no/such.jsonl",)], "prefix string"))


_of("s2_resolved", lambda s, w: jsonl.resolve(s, w).withColumn("sessions", F.array_join("sessions", " ")), _lines, _asked, sql=SQL + """, s AS (SELECT DISTINCT session_id, '/logs/' || replace(session_id, '/', '/subagents/') || '.jsonl' AS path FROM x),
w AS (SELECT DISTINCT left(session_id, 2) AS prefix FROM s UNION SELECT path FROM s WHERE session_id LIKE '1%' UNION SELECT unnest(['no-such', '/no/such.jsonl'])),
h AS (SELECT w.prefix, s.session_id FROM w JOIN s ON CASE WHEN contains(prefix, '/') THEN path = prefix ELSE starts_with(session_id, prefix) END)
SELECT w.prefix, coalesce(string_agg(session_id, ' ' ORDER BY session_id), '') AS sessions, CASE count(session_id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM w LEFT JOIN h USING (prefix) GROUP BY w.prefix""")
_of("s3_subagent_logs", lambda s: s.select("session_id", "parent_session_id", "path").distinct(), _lines, sql=SQL + " SELECT DISTINCT session_id, parent_session_id, '/logs/' || replace(session_id, '/', '/subagents/') || '.jsonl' AS path FROM x")
_of("s7_blocks", lambda b: b.select("session_id", "ix", "block_ix", "type", "text", "tool_id", "tool_name", "tool_use_id", "content_kind", "is_error", "block"), rich.blocks, sql=SQL + """ SELECT session_id, ix, block_ix, json_extract_string(block, '$.type') AS type, json_extract_string(block, '$.text') AS text, json_extract_string(block, '$.id') AS tool_id, json_extract_string(block, '$.name') AS tool_name,
json_extract_string(block, '$.tool_use_id') AS tool_use_id, CASE json_type(block, '$.content') WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS content_kind, CAST(json_extract(block, '$.is_error') AS BOOLEAN) AS is_error, block FROM xb""")
_FACTS = " coalesce(arg_min('1.' || ix // 3, ix) FILTER (k NOT IN (7, 10, 12)), NULL) AS version, arg_min('/work/' || c, ix) FILTER (k NOT IN (7, 10, 12)) AS cwd, arg_min('b' || ix // 3, ix) FILTER (k NOT IN (7, 10, 12)) AS git_branch, arg_min('plan', ix) FILTER (k = 10) AS permission_mode"
_of("s11_facts", lambda e: metadata.session_facts(e, list(metadata.FACTS)), rich.entries, sql=SQL + f" SELECT session_id, {_FACTS} FROM x GROUP BY session_id")

# --- metadata ----------------------------------------------------------------------
_TARGETS = """, s AS (SELECT DISTINCT coalesce(parent_session_id, session_id) AS session_id, CASE WHEN parent_session_id IS NULL THEN 'session.jsonl' ELSE 'subagents/agent-' || c || '/session.jsonl' END AS name, '/logs/' || replace(session_id, '/', '/subagents/') || '.jsonl' AS path FROM x),
targets AS (SELECT session_id, '{' || string_agg('"' || name || '":"' || path || '"', ',' ORDER BY name) || '}' AS targets FROM s GROUP BY session_id)"""


def _logs(lines: DataFrame) -> DataFrame:
    return lines.select("session_id", "parent_session_id", F.regexp_extract("path", r"subagents/([^/]+)\.jsonl$", 1).alias("sub_name"), "path").distinct()


_of(
    "m5_query_targets",
    lambda s: metadata.query_targets(_logs(s)).select("session_id", F.to_json("targets").alias("targets")),
    _lines,
    sql=SQL + _TARGETS + " SELECT * FROM targets",
)
_META = _USED + f""", calls AS (SELECT session_id, ix, json_extract_string(block, '$.id') AS id FROM xb WHERE json_extract_string(block, '$.type') = 'tool_use'),
open_calls AS (SELECT DISTINCT calls.session_id FROM calls JOIN (SELECT session_id, max(ix) AS ix FROM x WHERE type = 'assistant' GROUP BY 1) l USING (session_id, ix) WHERE NOT EXISTS (SELECT 1 FROM xb r WHERE r.session_id = calls.session_id AND json_extract_string(r.block, '$.tool_use_id') = calls.id)),
timed AS (SELECT *, {sql("<ts>")} AS ts FROM x WHERE k NOT IN (7, 10, 12)),
m AS (SELECT x.session_id, count(*) AS turn_count, {_FACTS}, CASE WHEN x.session_id IN (FROM open_calls) THEN 'ongoing' WHEN bool_or(type = 'assistant') THEN 'completed' ELSE 'unknown' END AS end_state,
  (SELECT min(ts) FROM timed s WHERE s.session_id = x.session_id) AS start_ts, (SELECT max(ts) FROM timed s WHERE s.session_id = x.session_id) AS end_ts,
  (SELECT CAST(max(ix) - min(ix) AS BIGINT) FROM timed s WHERE s.session_id = x.session_id) AS duration_s FROM x GROUP BY x.session_id),
totals AS (SELECT session_id, {_TOTALS} FROM (SELECT session_id, model, {", ".join(COUNTERS)} FROM assistant UNION ALL SELECT DISTINCT session_id, NULL, NULL, NULL, NULL, NULL FROM x) GROUP BY 1),
models AS (SELECT session_id, model, min(ix) AS first, count(*) AS message_count, {", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in COUNTERS)} FROM assistant WHERE model <> '<synthetic>' GROUP BY ALL)"""
_SUMS = "'in=' || input_tokens || '  out=' || output_tokens || '  cache_read=' || cache_read || '  cache_write=' || cache_write"

_of(
    "m6_session_info",
    lambda e, b, s: metadata.info(e, b, _logs(s)).withColumns({"by_model": F.to_json(F.coalesce("by_model", F.array())), "targets": F.to_json("targets")}),
    rich.entries,
    rich.blocks,
    _lines,
    sql=SQL + _META + _TARGETS + f""", by_model AS (SELECT session_id, '[' || string_agg('{{"model":"' || model || '",{",".join(f'"{c}":\' || {c} || \'' for c in COUNTERS)},"message_count":' || message_count || '}}', ',' ORDER BY model) || ']' AS by_model FROM models GROUP BY 1)
SELECT m.*, {', '.join('totals.' + c for c in COUNTERS)}, coalesce(by_model, '[]') AS by_model, targets FROM m JOIN totals USING (session_id) LEFT JOIN by_model USING (session_id) LEFT JOIN targets USING (session_id)""",
)
_of("m7_info_text", metadata.info_lines, rich.entries, rich.blocks, sql=SQL + _META + f""", lines AS (SELECT session_id, first, model || ' (' || message_count || ' msgs)' AS label, {_SUMS} AS sums FROM models UNION ALL SELECT session_id, -1, 'totals', {_SUMS} FROM totals),
wide AS (SELECT session_id, max(length(label)) AS w FROM lines GROUP BY 1), tokens AS (SELECT session_id, string_agg('  ' || rpad(label, CAST(w AS INTEGER), ' ') || '  ' || sums, chr(10) ORDER BY first) AS lines FROM lines JOIN wide USING (session_id) GROUP BY 1)
SELECT session_id, concat_ws(chr(10), 'session:    ' || session_id, 'version:    ' || version, 'cwd:        ' || cwd, 'branch:     ' || git_branch, 'permission: ' || permission_mode, 'turns:      ' || turn_count || ' (' || end_state || ')',
  'duration:   ' || CASE WHEN duration_s >= 60 THEN duration_s // 60 || 'm ' ELSE '' END || duration_s % 60 || 's', 'started:    ' || start_ts, 'ended:      ' || end_ts, '', 'tokens:', lines, '') AS text FROM m JOIN tokens USING (session_id)""")

# --- analysis -------------------------------------------------------------------------
_FAILED = """, failed AS (SELECT r.session_id, r.ix, r.block_ix, json_extract_string(r.block, '$.tool_use_id') AS tool_use_id, r.t AS error FROM xb r WHERE r.kind LIKE 'tool_result:%' AND r.k IN (2, 4)),
named AS (SELECT session_id, json_extract_string(block, '$.id') AS id, json_extract_string(block, '$.name') AS name FROM xb WHERE json_extract_string(block, '$.type') = 'tool_use')"""
_of("a8_failed_results", lambda b: analyze.failures(b).drop("input"), rich.blocks, sql=SQL + _FAILED + " SELECT f.session_id, f.ix, f.block_ix, tool_use_id, coalesce(name, 'unknown') AS tool_name, error FROM failed f LEFT JOIN named n ON n.session_id = f.session_id AND n.id = f.tool_use_id")
_of("a11_spills", analyze.spills, rich.blocks, sql=SQL + " SELECT session_id, ix, json_extract_string(block, '$.tool_use_id') AS tool_use_id, '/spill/' || c || '/r' || ix || '.txt' AS path, '51.3KB' AS size_label FROM xb WHERE k = 6")
_of("a12_permissions", analyze.permission_events, rich.entries, sql=SQL + " SELECT session_id, ix, CASE k WHEN 10 THEN 'permission_mode' ELSE 'hook_success' END AS kind, CASE k WHEN 10 THEN 'plan' END AS mode, CASE k WHEN 10 THEN '{\"mode\":\"plan\"}' ELSE CAST(json_extract(raw, '$.attachment') AS VARCHAR) END AS details FROM x WHERE k IN (7, 10)")
_of(
    "a14_analysis",
    _stored(lambda e, b: analyze.analyze(e, b).select("session_id", "turn_count", *COUNTERS, *[F.size(c).alias(f"n_{c}") for c in ("tokens_by_model", "tools", "files", "read_without_write", "bash", "churn", "failures", "density", "spills", "permissions", "phases", "subagents")])),
    sql=SQL + _META + """, counted AS (SELECT session_id, count(DISTINCT json_extract_string(block, '$.name')) FILTER (json_extract_string(block, '$.type') = 'tool_use') AS tools, count(DISTINCT json_extract_string(block, '$.input.file_path')) AS files, count(DISTINCT regexp_extract(ltrim(json_extract_string(block, '$.input.command'), ' ' || chr(9) || chr(10) || chr(13)), '^\\S+')) FILTER (json_extract_string(block, '$.name') = 'Bash' AND trim(json_extract_string(block, '$.input.command'), ' ' || chr(9) || chr(10) || chr(13)) <> '') AS bash, count(*) FILTER (kind LIKE 'tool_result:%' AND k IN (2, 4)) AS failures, count(*) FILTER (k = 6) AS spills FROM xb GROUP BY 1)
SELECT m.session_id, turn_count, """ + ", ".join("totals." + c for c in COUNTERS) + """, CAST((SELECT count(*) FROM models WHERE models.session_id = m.session_id) AS INTEGER) AS n_tokens_by_model, CAST(coalesce(tools, 0) AS INTEGER) AS n_tools, CAST(coalesce(files, 0) AS INTEGER) AS n_files, 0 AS n_read_without_write, CAST(coalesce(bash, 0) AS INTEGER) AS n_bash, CAST(coalesce(files, 0) AS INTEGER) AS n_churn,
CAST(coalesce(failures, 0) AS INTEGER) AS n_failures, CAST((SELECT count(*) FROM assistant a WHERE a.session_id = m.session_id AND model <> '<synthetic>') AS INTEGER) AS n_density, CAST(coalesce(spills, 0) AS INTEGER) AS n_spills, CAST((SELECT count(*) FROM x WHERE x.session_id = m.session_id AND k IN (7, 10)) AS INTEGER) AS n_permissions, 1 AS n_phases,
CAST((SELECT count(DISTINCT session_id) FROM x WHERE x.parent_session_id = m.session_id) AS INTEGER) AS n_subagents FROM m JOIN totals USING (session_id) LEFT JOIN counted USING (session_id)""",
)
_of("a15_usage_by_folder", lambda e: analyze.usage_rollup(e.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "folder"), rich.entries, sql=SQL + _META + f", f AS (SELECT DISTINCT session_id, CASE WHEN parent_session_id IS NULL THEN '/logs' ELSE '/logs/' || parent_session_id || '/subagents' END AS folder FROM x) SELECT folder, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)}, count(*) AS sessions FROM f JOIN totals USING (session_id) GROUP BY folder")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Result messages of events: by model where k is odd, else in all."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").alias("k"))
    by = F.when(F.col("k").cast("int") % 2 == 1, F.concat(F.lit('{"a":{"inputTokens":'), "k", F.lit(',"outputTokens":2},"b":{"inputTokens":1,"cacheReadInputTokens":'), "k", F.lit("}}")))
    return e.select("session_id", F.coalesce(by, F.lit("{}")).alias("model_usage"), F.concat(F.lit('{"input_tokens":'), "k", F.lit(',"output_tokens":3}')).alias("usage"))


_of("a16_result_tokens", analyze.result_tokens, _messages, sql="WITH e AS (SELECT CAST(event_id AS VARCHAR) AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT session_id, CASE k % 2 WHEN 1 THEN k + 1 ELSE k END AS input_tokens, CASE k % 2 WHEN 1 THEN CAST(2 AS BIGINT) ELSE 3 END AS output_tokens, CASE k % 2 WHEN 1 THEN k END AS cache_read, CASE k % 2 WHEN 1 THEN CAST(0 AS BIGINT) END AS cache_write FROM e")

# --- condensing ----------------------------------------------------------------------------
_of("c2_condensed_blocks", lambda b: condense.condensed_blocks(b, INLINE).select("session_id", "ix", "block_ix", "json", "stubbed", "orig", "inlined"), rich.blocks, sql=SQL + " SELECT session_id, ix, block_ix, condensed AS json, cut AS stubbed, orig, inlined FROM xb")
_of("c3_condensed_blocks", lambda b: condense.condensed_blocks(b.filter("type = 'tool_result'"), INLINE).select("session_id", "ix", "block_ix", F.get_json_object("json", "$.result").alias("result"), "stubbed"), rich.blocks, sql=SQL + " SELECT session_id, ix, block_ix, coalesce(json_extract_string(condensed, '$.result'), CAST(json_extract(condensed, '$.result') AS VARCHAR)) AS result, cut AS stubbed FROM xb WHERE kind LIKE 'tool_result:%'")
_of("c5_payloads", lambda e: condense.condensed_payloads(e, INLINE).select("session_id", "ix", "type", "json", "stubbed"), rich.entries, sql=SQL + """ SELECT session_id, ix, type, condensed AS json, contains(condensed, '"truncated":true') AS stubbed FROM x WHERE k IN (7, 10, 12)""")
_CONDENSED = """, parents AS (SELECT session_id, ix, 'u-' || c || '-' || ix AS uuid FROM x WHERE k NOT IN (10, 12)),
ce AS (SELECT x.session_id, x.ix, CASE WHEN k IN (10, 12) THEN 'ix:' || x.ix ELSE 'uuid:u-' || x.c || '-' || x.ix END AS ref, p.ix AS parent_ix, CASE WHEN k IN (10, 12) THEN 'other' ELSE type END AS role, type, condensed AS content, contains(condensed, '"truncated":true') AS stubbed, k = 11 AS synthetic
FROM x LEFT JOIN parents p ON p.session_id = x.session_id AND k NOT IN (7, 10, 12) AND p.uuid = 'u-' || x.c || '-' || (x.ix - 1))"""
_of("c8_condensed_entries", _stored(lambda e, b: condense.condensed_entries(e, b, INLINE).select("session_id", "ix", "ref", "parent_ix", "role", "type", "content", "stubbed", "synthetic", F.col("tokens.in").alias("tokens_in"), F.col("tokens.out").alias("tokens_out"), F.col("tokens.cache_read").alias("cache_read"))), sql=SQL + _USED + _CONDENSED + " SELECT ce.*, a.input_tokens AS tokens_in, a.output_tokens AS tokens_out, a.cache_read FROM ce LEFT JOIN assistant a USING (session_id, ix)")
_STATS = """, counted AS (SELECT session_id, kind, orig, inlined, cut FROM xb UNION ALL SELECT session_id, 'user:text', strlen(t), strlen(condensed), contains(condensed, '"truncated":true') FROM x WHERE k = 0
UNION ALL SELECT session_id, 'other:' || type, strlen(CASE k WHEN 7 THEN '{"attachment":{"type":"hook_success","content":' || CAST(to_json(t) AS VARCHAR) || '}}' ELSE condensed END), strlen(condensed), contains(condensed, '"truncated":true') FROM x WHERE k IN (7, 10, 12)),
st AS (SELECT session_id, kind, count(*) AS count, CAST(sum(orig) AS BIGINT) AS orig_bytes, CAST(sum(inlined) AS BIGINT) AS inlined_bytes, count(*) FILTER (cut) AS truncated FROM counted GROUP BY GROUPING SETS ((session_id, kind), (session_id)))"""
_of("c9_condense_stats", _stored(lambda e, b: condense.condense_stats(e, b, INLINE)), sql=SQL + _STATS + " SELECT * FROM st")
_KB = "CASE WHEN {0} = 0 THEN '0' WHEN {0} / 1024.0 < 10 THEN printf('%.1f', floor({0} / 1024.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor({0} / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) END"
_of("c11_stats_report", _stored(lambda e, b: condense.stats_report(condense.condense_stats(e, b, INLINE))), sql=SQL + _STATS + f""", cells AS (SELECT session_id, CASE WHEN kind IS NULL THEN 1 ELSE 0 END AS total, orig_bytes, coalesce(kind, 'TOTAL') AS a, CAST(count AS VARCHAR) AS b, {_KB.format("orig_bytes")} AS d, {_KB.format("inlined_bytes")} AS e, truncated || '/' || count AS f FROM st),
w AS (SELECT session_id, CAST(greatest(4, max(length(a))) AS INTEGER) AS wa, CAST(greatest(5, max(length(b))) AS INTEGER) AS wb, CAST(greatest(7, max(length(d))) AS INTEGER) AS wd, CAST(greatest(10, max(length(e))) AS INTEGER) AS we, CAST(greatest(9, max(length(f))) AS INTEGER) AS wf FROM cells GROUP BY 1),
l AS (SELECT session_id, total, orig_bytes, a, rpad(a, wa, ' ') || '  ' || lpad(b, wb, ' ') || '  ' || lpad(d, wd, ' ') || '  ' || lpad(e, we, ' ') || '  ' || lpad(f, wf, ' ') AS line FROM cells JOIN w USING (session_id)),
h AS (SELECT session_id, rpad('Kind', wa, ' ') || '  ' || lpad('count', wb, ' ') || '  ' || lpad('orig KB', wd, ' ') || '  ' || lpad('inlined KB', we, ' ') || '  ' || lpad('truncated', wf, ' ') AS head, repeat('─', wa) || '  ' || repeat('─', wb) || '  ' || repeat('─', wd) || '  ' || repeat('─', we) || '  ' || repeat('─', wf) AS rule FROM w)
SELECT h.session_id, concat_ws(chr(10), 'Condensation report', head, rule, (SELECT string_agg(line, chr(10) ORDER BY orig_bytes DESC, a) FROM l WHERE l.session_id = h.session_id AND total = 0), rule, (SELECT line FROM l WHERE l.session_id = h.session_id AND total = 1), '') AS report FROM h""")
_CUT = """ SELECT session_id, ix FROM x WHERE contains(condensed, '"truncated":true')"""
_of("c12_stubbed_entries", _stored(lambda e, b: condense.truncated_ix(condense.condensed_entries(e, b, INLINE))), sql=SQL + _CUT)
_of("c13_stubbed_turns", _stored(lambda e, b: condense.full_turns(e, condense.truncated_ix(condense.condensed_entries(e, b, INLINE))).select("session_id", "ix", "raw")), sql=SQL + """ SELECT session_id, ix, raw FROM x WHERE contains(condensed, '"truncated":true')""")
_of("c14_condensed_subagents", _stored(lambda e, b: condense.condensed_entries(e.filter("parent_session_id IS NOT NULL"), b.filter("contains(session_id, '/')"), INLINE).select("session_id", "ix", "content")), sql=SQL + " SELECT session_id, ix, condensed AS content FROM x WHERE parent_session_id IS NOT NULL")


def _spill_sources(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """C15, with copies of the spills of even conversations."""
    found = analyze.spills(blocks)
    roots = entries.select("session_id", F.coalesce("parent_session_id", "session_id").alias("root")).distinct()
    listing = found.filter(F.regexp_extract("path", r"/spill/(\d+)/", 1).cast("int") % 2 == 0).select("path")
    return condense.spill_sources(found, listing, roots)


_of("c15_spill_sources", _stored(_spill_sources), sql=SQL + " SELECT DISTINCT coalesce(parent_session_id, session_id) AS session_id, '/spill/' || c || '/r' || ix || '.txt' AS path, c % 2 = 0 AS copied FROM x WHERE k = 6")


def _snapshots(entries: DataFrame) -> DataFrame:
    return entries.filter("type = 'file-history-snapshot'").select("session_id", "ix", F.get_json_object("raw", "$.snapshot.trackedFileBackups").alias("tracked"))


def _blobs(versions: DataFrame) -> DataFrame:
    """A listing that lacks every third blob."""
    return versions.filter("version % 3 > 0").select("session_id", "blob", (F.col("version") * 10).alias("bytes"))


_of("c16_snapshot_index", lambda e: filehistory.with_blobs(v := filehistory.file_versions(_snapshots(e)), _blobs(v)), rich.entries, sql=SQL + f" SELECT session_id, '/work/f.ts' AS path, ix AS version, ix, {sql('<ts>')} AS backup_time, CASE WHEN ix % 3 > 0 THEN 'f@v' || ix END AS blob, CASE WHEN ix % 3 > 0 THEN CAST(ix * 10 AS BIGINT) END AS bytes FROM x WHERE k = 12")


def _file_requests(e: DataFrame) -> DataFrame:
    """what every entry sees of the file."""
    v = filehistory.file_versions(_snapshots(e))
    return filehistory.file_at(filehistory.with_blobs(v, _blobs(v)), e.select("session_id", F.lit("/work/f.ts").alias("path"), "ix"))


_of("f1_file_with_blob", _file_requests, rich.entries, sql=SQL + """, v AS (SELECT session_id, ix AS version, ix FROM x WHERE k = 12), q AS (SELECT x.session_id, x.ix, (SELECT max(version) FROM v WHERE v.session_id = x.session_id AND v.ix <= x.ix) AS version, EXISTS (SELECT 1 FROM v WHERE v.session_id = x.session_id) AS tracked FROM x)
SELECT session_id, '/work/f.ts' AS path, ix, version, CASE WHEN version IS NULL THEN CASE WHEN tracked THEN 'too early' ELSE 'untracked' END WHEN version % 3 = 0 THEN 'no blob' ELSE 'ok' END AS status, CASE WHEN version % 3 > 0 THEN 'f@v' || version END AS blob FROM q""")


def _summary(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """C18, with subagents' spills counted to their main session."""
    subs = entries.filter("parent_session_id IS NOT NULL").select(F.col("parent_session_id").alias("session_id"), F.col("session_id").alias("sub")).distinct()
    made = condense.stage_summary(condense.condensed_entries(entries, blocks, INLINE), _spill_sources(entries, blocks), subs, condense.condense_stats(entries, blocks, INLINE))
    return made.withColumn("truncated", F.array_join("truncated", " "))


_of("c18_stage_summary", _stored(_summary), sql=SQL + _STATS + """, sp AS (SELECT coalesce(parent_session_id, session_id) AS session_id, count(DISTINCT '/spill/' || c || '/r' || ix || '.txt') AS spills FROM x WHERE k = 6 AND c % 2 = 0 GROUP BY 1),
cs AS (SELECT session_id, coalesce(string_agg(CASE WHEN contains(condensed, '"truncated":true') THEN ix::VARCHAR END, ' ' ORDER BY ix), '') AS truncated, (SELECT count(DISTINCT s.session_id) FROM x s WHERE s.parent_session_id = x.session_id) AS subagents FROM x GROUP BY session_id)
SELECT cs.*, coalesce(spills, 0) AS spills, st.count AS parts, st.orig_bytes, st.inlined_bytes, st.truncated AS stubbed_parts FROM cs LEFT JOIN sp USING (session_id) LEFT JOIN st ON st.session_id = cs.session_id AND st.kind IS NULL""")
_of("q6_other_entries", lambda e, b: search.render(e, b).join(e.filter("type NOT IN ('user', 'assistant')").select("session_id", "ix"), ["session_id", "ix"], "left_semi").select("session_id", "ix", F.size(F.split("text", "\n")).alias("lines"), F.replace(F.regexp_replace("text", r"\n *", ""), F.lit('": '), F.lit('":')).alias("flat")), rich.entries, rich.blocks,
    sql=SQL + """ SELECT session_id, ix, (2 + len(json_keys(raw)) + CASE k WHEN 7 THEN 3 WHEN 12 THEN 8 ELSE 0 END)::INT AS lines, raw AS flat FROM x WHERE type NOT IN ('user', 'assistant')""")

# --- search ----------------------------------------------------------------------------------
_TEXTS = ", tx AS (SELECT session_id, ix, type AS role, CASE k WHEN 1 THEN t WHEN 4 THEN t WHEN 8 THEN t WHEN 6 THEN json_extract_string(raw, '$.message.content[0].content') WHEN 3 THEN '' WHEN 5 THEN '' WHEN 11 THEN '' ELSE t END AS text FROM x WHERE type IN ('user', 'assistant'))"
_of("q3_searched_texts", search.searched_texts, rich.entries, rich.blocks, sql=SQL + _TEXTS + " SELECT * FROM tx")
_of("q3_found", lambda e, b: search.text_search(search.searched_texts(e, b), "the", "assistant"), rich.entries, rich.blocks, sql=SQL + _TEXTS + """, s AS (SELECT *, instr(text, 'the') - 1 AS pos FROM tx WHERE role = 'assistant' AND contains(text, 'the'))
SELECT session_id, ix, role AS kind, (CASE WHEN pos > 20 THEN '...' ELSE '' END) || replace(substr(text, greatest(pos - 20, 0) + 1, least(pos + 63, length(text)) - greatest(pos - 20, 0)), chr(10), ' ') || (CASE WHEN pos + 63 < length(text) THEN '...' ELSE '' END) AS summary FROM s""")
_of("q7_match_counts", lambda b: search.format_matches(search.tool_uses(b), "count"), rich.blocks, sql=SQL + " SELECT session_id, count(*) AS matches FROM xb WHERE kind LIKE 'tool_use:%' GROUP BY 1")
_of("q7_match_json", lambda b: search.format_matches(search.tool_uses(b, "Grep"), "json"), rich.blocks, sql=SQL + """ SELECT session_id, ix, '{"ix":' || ix || ',"block_ix":0,"kind":"tool_use","summary":"Grep  pattern=x","tool_id":"tool-' || c || '-' || ix || '-a"}' AS line FROM x WHERE k = 3""")

# --- rounds ------------------------------------------------------------------------------------
_of("b1_human_texts", rounds.human_texts, rich.entries, rich.blocks, sql=SQL + " SELECT session_id, ix, CASE WHEN k = 0 THEN t END AS text FROM x WHERE type = 'user'")
_of("b9_result_texts", lambda b: b.filter("type = 'tool_result'").select("session_id", "ix", result_text(F.col("content"), F.col("content_kind")).alias("text")), rich.blocks, sql=SQL + " SELECT session_id, ix, CASE WHEN k = 6 THEN json_extract_string(block, '$.content') ELSE t END AS text FROM xb WHERE kind LIKE 'tool_result:%'")

_STREAM = r""", r0 AS (SELECT *, CAST(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ix) AS INTEGER) AS round FROM x),
short AS (SELECT session_id, ix, replace(t, chr(10), ' ⏎ ') AS s, CAST(floor(length(t) / 4.0 + 0.5) AS BIGINT) AS tok FROM x),
answered AS (SELECT session_id, ix - 1 AS ix FROM x WHERE k = 2),
stream AS (SELECT r.session_id, round, r.ix, 0 AS b, 'text' AS kind, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM r0 r WHERE k IN (1, 8) AND round > 0 UNION ALL
SELECT r.session_id, round, r.ix, 2, 'tool', 'Bash `' || CASE WHEN length(s) > 70 THEN left(s, 69) || '…' ELSE s END || '` (try it) — ~' || CASE WHEN a.ix IS NULL THEN '0 tok out' ELSE (SELECT tok FROM short n WHERE n.session_id = r.session_id AND n.ix = r.ix + 1) || ' tok out [error]' END FROM r0 r JOIN short USING (session_id, ix) LEFT JOIN answered a ON a.session_id = r.session_id AND a.ix = r.ix WHERE k = 1 AND round > 0 UNION ALL
SELECT session_id, round, ix, 0, 'tool', 'Grep "x" in /work — 0 matches' FROM r0 WHERE k = 3 AND round > 0 UNION ALL SELECT session_id, round, ix, 1, 'tool', 'TodoWrite' FROM r0 WHERE k = 3 AND round > 0 UNION ALL
SELECT session_id, round, ix, 0, 'tool', 'MultiEdit file_path="/work/f.ts"' FROM r0 WHERE k = 5 AND round > 0 UNION ALL SELECT session_id, round, ix, 1, 'tool', 'Task → explorer: "look" — returned ~0 tok' FROM r0 WHERE k = 8 AND round > 0 UNION ALL
SELECT session_id, round, ix, 2, 'tool', 'TaskCreate ' || CASE WHEN length(s) > 70 THEN left(s, 69) || '…' ELSE s END FROM r0 JOIN short USING (session_id, ix) WHERE k = 8 AND round > 0 UNION ALL
SELECT session_id, round, ix, 0, 'tool', 'mcp__demo__send chat="5"' FROM r0 WHERE k = 11 AND round > 0),
st AS (SELECT *, sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, round ORDER BY ix, b) AS stretch FROM stream),
rt AS (SELECT session_id, round, min(ix) AS user_ix, arg_min(t, ix) AS human, arg_min('b' || ix // 3, ix) FILTER (k NOT IN (7, 10, 12)) AS branch FROM r0 WHERE round > 0 GROUP BY ALL),
ch AS (SELECT *, CASE WHEN branch IS DISTINCT FROM lag(branch) OVER (PARTITION BY session_id ORDER BY round) THEN branch END AS changed FROM rt)"""


def _brief_sql(markdown: bool) -> str:
    nl = "chr(10)"
    span = "CASE WHEN min(ix) = max(ix) THEN min(ix) || '' ELSE min(ix) || '-' || max(ix) END"
    calls = f"string_agg('- [' || ix || '] ' || line, {nl} ORDER BY ix, b)"
    if markdown:
        group = f"'**Tools** `[ix ' || {span} || ']`' || {nl} || {calls} || {nl}"
        said = f"'**Assistant** `[ix ' || ix || ']`' || {nl} || {nl} || line || {nl}"
        whole = f"concat_ws({nl}, '## Round ' || round || {nl} || {nl} || '**User** `[ix ' || user_ix || ']`' || {nl} || {nl} || '> ' || replace(trim(human, ' ' || chr(9) || {nl} || chr(13)), {nl}, {nl} || '> ') || {nl}, '*on `' || changed || '`*' || {nl}, body) || {nl}"
    else:
        group = f"'<tools idx=\"' || {span} || '\">' || {nl} || {calls} || {nl} || '</tools>'"
        said = f"'<assistant idx=\"' || ix || '\">' || {nl} || line || {nl} || '</assistant>'"
        whole = f"concat_ws({nl}, '<round n=\"' || round || '\">' || {nl} || '<user idx=\"' || user_ix || '\">' || {nl} || trim(human, ' ' || chr(9) || {nl} || chr(13)) || {nl} || '</user>', '<git branch=\"' || changed || '\"/>', body, '</round>') || {nl}"
    return f""", pt AS (SELECT session_id, round, stretch, 1 AS late, {group} AS part FROM st WHERE kind = 'tool' GROUP BY session_id, round, stretch UNION ALL SELECT session_id, round, stretch, 0, {said} FROM st WHERE kind = 'text'),
bd AS (SELECT session_id, round, string_agg(part, {nl} ORDER BY stretch, late) AS body FROM pt GROUP BY ALL),
br AS (SELECT session_id, round AS n, {whole} AS text FROM ch LEFT JOIN bd USING (session_id, round))"""


def _brief(markdown: bool) -> Callable:
    return _stored(lambda e, b: rounds.brief(e, b, rounds.human_texts(e, b), markdown))


def _whole(markdown: bool) -> Callable:
    def run(entries: DataFrame, blocks: DataFrame) -> DataFrame:
        humans = rounds.human_texts(entries, blocks)
        stats = rounds.brief_stats(entries, blocks, humans).join(entries.groupBy("session_id").agg(F.min("path").alias("source")), "session_id")
        return rounds.whole_brief(rounds.brief(entries, blocks, humans, markdown), stats, markdown)

    return _stored(run)


_BRIEF_STATS = """, bs AS (SELECT session_id, count(*) FILTER (k = 0) AS rounds, CAST(coalesce(sum(CASE WHEN k IN (1, 4, 8) THEN floor(length(t) / 4.0 + 0.5) END), 0) AS BIGINT) AS tok, (SELECT count(*) FROM xb WHERE xb.session_id = x.session_id AND kind LIKE 'tool_use:%') AS uses, '/logs/' || replace(session_id, '/', '/subagents/') || '.jsonl' AS source FROM x GROUP BY session_id)"""
_of("b7_brief", _brief(False), sql=SQL + _STREAM + _brief_sql(False) + " SELECT * FROM br")
_of("b7_brief_markdown", _brief(True), sql=SQL + _STREAM + _brief_sql(True) + " SELECT * FROM br")
_WHOLE = SQL + _STREAM + "{0}" + _BRIEF_STATS + " SELECT session_id, {1} || coalesce((SELECT string_agg(text, '' ORDER BY n) FROM br WHERE br.session_id = bs.session_id), '') || {2} AS text FROM bs"
_of("b7_whole_brief", _whole(False), sql=_WHOLE.replace("{0}", _brief_sql(False)).replace("{1}", """'<session source="' || source || '" rounds="' || rounds || '" assistant_text_tokens="' || tok || '" tool_uses="' || uses || '">' || chr(10)""").replace("{2}", "'</session>' || chr(10)"))
_of("b7_whole_markdown", _whole(True), sql=_WHOLE.replace("{0}", _brief_sql(True)).replace("{1}", "'# Session brief' || chr(10) || chr(10) || '**Source:** `' || source || '`' || chr(10) || '**Rounds:** ' || rounds || '  •  **Assistant text:** ~' || tok || ' tok  •  **Tool uses:** ' || uses || chr(10) || chr(10) || '---' || chr(10)").replace("{2}", "''"))
_of("b8_text_tokens", _stored(lambda e, b: rounds.brief_stats(e, b, rounds.human_texts(e, b))), sql=SQL + _BRIEF_STATS + " SELECT session_id, rounds, rounds AS raw_rounds, uses AS tool_uses, tok AS text_tokens, (SELECT count(*) FROM x WHERE x.session_id = bs.session_id) AS entry_count FROM bs")

# --- compacting ----------------------------------------------------------------------------
SELECTORS = ("type:attach*", "tool:mcp__*")
_CUT_T = "CASE WHEN strlen(t) > 500 THEN left(t, 100) ELSE t END"
_LONG = "CASE WHEN strlen(t) > 500 THEN strlen(t) END"
_SWEPT = "CAST(to_json(CASE WHEN strlen(t) > 500 THEN '[truncated: ' || strlen(t) || ' bytes; preview: ' || left(t, 100) || '…]' ELSE t END) AS VARCHAR)"
_JSON_T = "CAST(to_json(t) AS VARCHAR)"
#: Kind, block, and of each field kept its name, value and bytes if cut.
_FIELDS = [
    (1, 2, [("command", _CUT_T, _LONG), ("description", "'try it'", ""), ("timeout", "'5'", "")]),
    (3, 0, [("pattern", "'x'", ""), ("path", "'/work'", ""), ("-n", "'true'", ""), ("head_limit", "'5'", "")]),
    (3, 1, [("todos", "'[{\"content\":' || " + _JSON_T + " || ',\"status\":\"done\"}]'", "")]),
    (5, 0, [("file_path", "'/work/f.ts'", ""), ("edits", "'[{\"old_string\":' || " + _SWEPT + " || ',\"new_string\":\"x\"}]'", "")]),
    (8, 1, [("subagent_type", "'explorer'", ""), ("description", "'look'", ""), ("prompt", _CUT_T, _LONG)]),
    (8, 2, [("subject", "t", "")]),
    (11, 0, [("chat", "'5'", ""), ("text", _CUT_T, _LONG), ("opts", "'{\"deep\":' || " + _SWEPT + " || '}'", ""), ("none", "NULL", "")]),
]
_FS = ", fs AS (" + " UNION ALL ".join(f"SELECT session_id, ix, k, {j} AS block_ix, {n} AS n, '{name}' AS name, {value} AS value, {cut or 'CAST(NULL AS BIGINT)'} AS bytes FROM x WHERE k = {k}" for k, j, own in _FIELDS for n, (name, value, cut) in enumerate(own)) + ")"
_of("k4_rich_fields", lambda b: compact.tool_fields(b).withColumn("bytes", F.col("bytes").cast("long")), rich.blocks, sql=SQL + _FS + " SELECT session_id, ix, block_ix, n, name, value, CAST(bytes AS BIGINT) AS bytes FROM fs")
_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_XML = _FS + f""", fx AS (SELECT *, CASE name WHEN '-n' THEN '_-n' ELSE name END AS tag FROM fs),
ux AS (SELECT b.session_id, b.ix, b.k, b.block_ix, '<tool_use name="' || json_extract_string(any_value(b.block), '$.name') || '" ix="' || b.ix || '">' || chr(10) || string_agg(CASE WHEN bytes IS NOT NULL THEN '<' || tag || ' truncated="' || bytes || '">' || {_ESC.format("value")} || '…</' || tag || '>' WHEN value IS NULL THEN '<' || tag || '/>' ELSE '<' || tag || '>' || {_ESC.format("value")} || '</' || tag || '>' END, chr(10) ORDER BY n) || chr(10) || '</tool_use>' AS xml,
  count(bytes) AS truncated, least(coalesce(sum(greatest(0, bytes - length(value) - 32)) FILTER (bytes IS NOT NULL), 0), strlen(CAST(json_extract(any_value(b.block), '$.input') AS VARCHAR))) AS saved FROM fx f JOIN xb b USING (session_id, ix, block_ix) GROUP BY b.session_id, b.ix, b.k, b.block_ix)"""
_of("k7_tool_use_xml", lambda b: compact.tool_use_xml(b).drop("user_tool"), rich.blocks, sql=SQL + _XML + " SELECT session_id, ix, block_ix, xml, CAST(truncated AS INTEGER) AS truncated, CAST(saved AS BIGINT) AS saved FROM ux")


def _start(entries: DataFrame, blocks: DataFrame, keep: int = 1) -> DataFrame:
    table = rounds.round_table(rounds.rounds(entries, rounds.human_texts(entries, blocks)))
    return compact.preserved_from(table.select("session_id", "user_ix"), entries, keep)


_CLASSES = """, pf AS (SELECT session_id, CAST(coalesce(max(ix) FILTER (k = 0), count(*)) AS INTEGER) AS preserved_from, count(*) AS entries FROM x GROUP BY 1),
cl AS (SELECT x.session_id, x.ix, x.type, x.k, x.t, x.raw, CASE WHEN x.ix >= preserved_from THEN 'tail' WHEN {0} THEN 'user_type' WHEN k = 12 THEN 'dropped' WHEN k = 8 OR k = 9 AND ix > 0 THEN 'preserved' WHEN type IN ('user', 'assistant') THEN 'bundled' ELSE 'skipped' END AS class FROM x JOIN pf USING (session_id))"""
_SELECTED = _CLASSES.replace("{0}", "k = 7")
_of("k3_entry_classes", _stored(lambda e, b: compact.classes(e, b, _start(e, b), SELECTORS)), sql=SQL + _SELECTED + " SELECT session_id, ix, type, class, class = 'preserved' AND k = 8 AS mixed FROM cl")
_PARTS = _XML + _SELECTED + f""", tx AS (SELECT session_id, ix, -1 AS b, 0 AS late, {_ESC.format("t")} AS xml, 0 AS stubbed, 0 AS truncated, 0 AS saved, 0 AS chosen FROM x WHERE k = 0 UNION ALL SELECT session_id, ix, CASE k WHEN 1 THEN 1 ELSE 0 END, 0, {_ESC.format("t")}, 0, 0, 0, 0 FROM x WHERE k IN (1, 4, 8)),
rl AS (SELECT session_id, ix, k, block_ix AS b, CASE WHEN ix = 0 THEN 'unknown' WHEN k = 2 THEN 'Bash' WHEN k = 4 THEN 'TodoWrite' WHEN k = 6 THEN 'MultiEdit' ELSE 'TaskCreate' END AS called,
  CASE WHEN ix = 0 THEN 'unknown' || CASE WHEN k IN (2, 4) THEN ' [error]' ELSE '' END WHEN k = 2 THEN 'Bash `' || (SELECT CASE WHEN length(replace(p.t, chr(10), ' ⏎ ')) > 70 THEN left(replace(p.t, chr(10), ' ⏎ '), 69) || '…' ELSE replace(p.t, chr(10), ' ⏎ ') END FROM x p WHERE p.session_id = xb.session_id AND p.ix = xb.ix - 1) || '` (try it) — ~' || CAST(floor(length(t) / 4.0 + 0.5) AS BIGINT) || ' tok out [error]'
  WHEN k = 4 THEN 'TodoWrite' WHEN k = 6 THEN 'MultiEdit file_path="/work/f.ts"' ELSE 'TaskCreate ' || (SELECT CASE WHEN length(replace(p.t, chr(10), ' ⏎ ')) > 70 THEN left(replace(p.t, chr(10), ' ⏎ '), 69) || '…' ELSE replace(p.t, chr(10), ' ⏎ ') END FROM x p WHERE p.session_id = xb.session_id AND p.ix = xb.ix - 1) END AS line,
  strlen(CASE WHEN k = 4 THEN CAST(json_extract(block, '$.content') AS VARCHAR) ELSE json_extract_string(block, '$.content') END) AS size FROM xb WHERE kind LIKE 'tool_result:%'),
rx AS (SELECT session_id, ix, b, 1 AS late, '<tool_result ix="' || ix || '" name="' || called || '"' || CASE WHEN k IN (2, 4) THEN ' error="true"' ELSE '' END || '>' || {_ESC.format("line")} || '</tool_result>' AS xml, size FROM rl),
cx AS (SELECT session_id, ix, block_ix AS b, 0 AS late, CASE WHEN k = 11 THEN '<tool_use name="mcp__demo__send" ix="' || ix || '">' || chr(10) || '<chat>5</chat>' || chr(10) || '<text>' || {_ESC.format("t")} || '</text>' || chr(10) || '<opts>' || {_ESC.format("'{\"deep\":' || " + _JSON_T + " || '}'")} || '</opts>' || chr(10) || '<none/>' || chr(10) || '</tool_use>' ELSE xml END AS xml,
  0 AS stubbed, CASE WHEN k = 11 THEN 0 ELSE truncated END AS truncated, CASE WHEN k = 11 THEN 0 ELSE saved END AS saved, CASE WHEN k = 11 THEN 1 ELSE 0 END AS chosen FROM ux JOIN x USING (session_id, ix, k)),
parts AS (SELECT * FROM tx UNION ALL SELECT session_id, ix, b, late, xml, 1, 0, greatest(0, size - strlen(xml)), 0 FROM rx UNION ALL SELECT * FROM cx),
tn AS (SELECT cl.session_id, ix, '<turn ix="' || ix || '" kind="' || CASE WHEN type = 'user' AND min(late) = 1 THEN 'tool_result' ELSE type END || '">' || chr(10) || string_agg(xml, chr(10) ORDER BY CASE WHEN type = 'user' THEN late ELSE 0 END, b) || chr(10) || '</turn>' AS body FROM cl JOIN parts USING (session_id, ix) WHERE class = 'bundled' GROUP BY cl.session_id, ix, type),
sts AS (SELECT session_id, count(*) AS source, count(*) FILTER (class = 'tail') AS preserved, count(*) FILTER (class = 'dropped') AS dropped, count(*) FILTER (class = 'bundled') AS bundled, count(*) FILTER (class = 'preserved' AND k = 8) AS mixed, count(*) FILTER (class = 'preserved') AS passed, count(*) FILTER (class = 'user_type') AS user_types, CAST(coalesce(sum(strlen(raw)) FILTER (class = 'dropped'), 0) AS BIGINT) AS gone FROM cl GROUP BY 1),
made AS (SELECT cl.session_id, sum(stubbed) AS stubbed, sum(truncated) AS truncated, sum(chosen) AS user_tools, sum(saved) AS saved FROM cl JOIN parts USING (session_id, ix) WHERE class = 'bundled' GROUP BY 1)"""


def _compacted(want: str) -> Callable:
    def run(entries: DataFrame, blocks: DataFrame) -> DataFrame:
        start = _start(entries, blocks)
        classed, parts = compact.classes(entries, blocks, start, SELECTORS), job.turn_parts(entries, blocks, SELECTORS)
        if want == "turns":
            return compact.turns(parts, classed)
        stats = compact.compact_stats(classed, parts, entries.join(classed.filter("class = 'dropped'").select("session_id", "ix"), ["session_id", "ix"], "left_semi"))
        return stats if want == "stats" else job.bundles(classed, parts, start, stats, 1, SELECTORS)

    return _stored(run)


_of("k8_turns", _compacted("turns"), sql=SQL + _PARTS + " SELECT * FROM tn")
_of("k17_compact_stats", _compacted("stats"), sql=SQL + _PARTS + " SELECT session_id, source, preserved, dropped, bundled, mixed, passed, CAST(coalesce(stubbed, 0) AS BIGINT) AS stubbed, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(user_tools, 0) AS BIGINT) AS user_tools, user_types, CAST(coalesce(saved, 0) AS BIGINT) + gone AS bytes_saved FROM sts LEFT JOIN made USING (session_id)")
_of("k12_bundle_text", _compacted("text"), sql=SQL + _PARTS + """ SELECT pf.session_id, concat_ws(chr(10), '<compacted>' || chr(10) || 'This session goes on from ' || pf.session_id || '.' || chr(10),
CASE WHEN preserved_from > 0 THEN 'Entries 0–' || (preserved_from - 1) || ' are condensed in <turns> below, one <turn> an entry; the command `show ' || pf.session_id || ' N` gives entry N as it was.' || chr(10) || 'A field with truncated="bytes" holds only its start and how many bytes it had.' || chr(10) END,
CASE WHEN passed + user_types > 0 THEN 'Calls that manage tasks follow as entries of their own, as they were.' || chr(10) END, 'Kept whole, as selected:' || chr(10) || '  - type:attach*' || chr(10) || '  - tool:mcp__*' || chr(10) || coalesce(user_tools, 0) || ' calls and results, ' || user_types || ' entries.' || chr(10),
CASE WHEN preserved_from < entries THEN 'Entries ' || preserved_from || '–' || (entries - 1) || ' follow at the end as they were: the last 1 round.' || chr(10) END, 'Turns are summaries: don''t guess what they leave out, look it up.' || chr(10) || '</compacted>' || chr(10)) ||
coalesce((SELECT '<turns>' || chr(10) || string_agg(body, chr(10) ORDER BY ix) || chr(10) || '</turns>' || chr(10) FROM tn WHERE tn.session_id = pf.session_id), '') AS text FROM pf JOIN sts USING (session_id) LEFT JOIN made USING (session_id)""")


def _new_id(parts: str) -> str:
    h = f"sha256({parts})"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _rewritten(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The ids in the lines of compacted logs."""
    out = job.compact_sessions(entries, blocks, known=entries.select("session_id").filter("false"))
    get = lambda name, path: F.get_json_object("raw", path).alias(name)
    return out.select("session_id", "section", "ix", get("uuid", "$.uuid"), get("parent_uuid", "$.parentUuid"), get("own_session", "$.sessionId"), get("prompt_id", "$.promptId"), get("request_id", "$.requestId"), get("message_id", "$.message.id"))


_KEY = "session_id || '|' || section || '|' || ix"
_ROUTED = lambda name: f"substr(replace({_new_id(_KEY + chr(32) + chr(124) * 2 + chr(39) + chr(124) + name + chr(39))}, '-', ''), 1, 22)"
_of(
    "k14_rewritten_ids",
    _stored(_rewritten),
    sql=SQL + _CLASSES.replace("{0}", "false") + f""", em AS (SELECT session_id, 0 AS section, -1 AS ix, 99 AS k FROM pf UNION ALL SELECT session_id, CASE class WHEN 'tail' THEN 2 ELSE 1 END, ix, k FROM cl WHERE class IN ('tail', 'preserved')),
ids AS (SELECT *, CASE WHEN k NOT IN (10, 12) THEN {_new_id(_KEY)} END AS uuid FROM em),
lk AS (SELECT *, last_value(uuid IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY section, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ids)
SELECT session_id, section, ix, uuid, CASE WHEN k NOT IN (7, 10, 12) THEN before END AS parent_uuid, {_new_id("session_id || '|0'")} AS own_session, CASE WHEN k IN (0, 99) THEN {_new_id(_KEY + " || '|prompt'")} END AS prompt_id,
CASE WHEN k IN (1, 3, 5, 8, 11) THEN 'req_' || {_ROUTED("request")} END AS request_id, CASE WHEN k IN (1, 3, 5, 8, 11) THEN 'msg_' || {_ROUTED("message")} END AS message_id FROM lk""",
)

# --- narratives ----------------------------------------------------------------------------


def _artifacts(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Artifacts of the whole job, a few fields of each part."""
    made, faults = distill(entries, blocks, GENERATED_AT)
    return made.select("schema_version", "session_id", "generated_at", "metadata.turn_count", "metadata.end_state", F.size("deterministic.tools").alias("n_tools"), "deterministic.output_tokens", F.length("narrative").alias("narrative_chars"), "condensed.stubbed_entries", "condensed.orig_bytes")


_of("n4_artifacts", _stored(_artifacts), sql=SQL + _META + _STATS.replace("counted AS", "cnt AS").replace("FROM counted", "FROM cnt") + """, big AS (SELECT session_id, count(*) FILTER (strlen(t) > 2048 AND k NOT IN (3, 5, 10, 12) OR k = 6) AS cuts FROM x GROUP BY 1), uses AS (SELECT session_id, count(DISTINCT json_extract_string(block, '$.name')) AS tools FROM xb WHERE kind LIKE 'tool_use:%' GROUP BY 1)
SELECT '1' AS schema_version, m.session_id, '2026-01-01T00:00:00Z' AS generated_at, m.turn_count, m.end_state, CAST(coalesce(uses.tools, 0) AS INTEGER) AS n_tools, totals.output_tokens, CAST(336 + length(m.turn_count || '') + length(greatest(m.turn_count - 1, 0) || '') AS INTEGER) AS narrative_chars, big.cuts AS stubbed_entries,
(SELECT orig_bytes FROM st WHERE st.session_id = m.session_id AND kind IS NULL) AS orig_bytes FROM m JOIN totals USING (session_id) JOIN big USING (session_id) LEFT JOIN uses USING (session_id)""")
