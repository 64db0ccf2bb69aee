"""The registered queries over session logs, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlog.functions import text as T
from sessionlog.functions.oneliners import one_liner, parsed_input
from sessionlog.operators import analyze, compact, condense, filehistory, metadata, narrative, rounds, scan, search
from sessionlog.sources import tables
from sessionlog.sources.tables import SQL, conversation_entries, event_blocks, event_entries, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
GENERATED_AT = "2026-01-01T00:00:00Z"
COUNTERS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in analyze.COUNTERS)
ZEROED = ", ".join(f"CAST(coalesce(sum({c}) FILTER (type = 'assistant' AND model <> '<synthetic>'), 0) AS BIGINT) AS {c}" for c in analyze.COUNTERS)


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _of(name: str, function: Callable, *sources: Callable, sql: str | None = None) -> None:
    _query(name, sql)(lambda spark, d: function(*[s(spark, d) for s in sources]))


def _event_humans(spark: SparkSession, d: str) -> DataFrame:
    return event_entries(spark, d).filter("content_text IS NOT NULL").select("session_id", "ix", F.col("content_text").alias("text"))


def _conversation_humans(spark: SparkSession, d: str) -> DataFrame:
    return conversation_entries(spark, d).filter("type = 'user'").select("session_id", "ix", F.col("content_text").alias("text"))


# --- normalising ---------------------------------------------------------------
@_query("s4_final_rolls", SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(request_id, 'ix' || ix) ORDER BY ix DESC) AS n FROM e) SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ix) - 1 AS INTEGER) AS ix, ix AS line_no, uuid FROM r WHERE n = 1")
def final_rolls(spark: SparkSession, d: str) -> DataFrame:
    """The last of entries with one request id, numbered anew."""
    from sessionlog.sources.jsonl import collapse_rolls

    return collapse_rolls(event_entries(spark, d).withColumnRenamed("ix", "line_no")).select("session_id", "ix", "line_no", "uuid")


_of("s8_parent_ix", condense.parent_ix, event_entries, sql=SQL + " SELECT e.session_id, e.ix, p.ix AS parent_ix FROM e LEFT JOIN e p ON e.session_id = p.session_id AND e.parent_uuid = p.uuid")
_of("s9_tool_uses_by_id", analyze.tool_use_index, event_blocks, sql=SQL + " SELECT session_id, tool_id, tool_name, input, ix AS call_ix FROM b WHERE type = 'tool_use'")
_of("s10_results_by_id", lambda b: analyze.tool_result_index(b).drop("content_kind"), event_blocks, sql=SQL + " SELECT session_id, tool_use_id, arg_max(content, ix) AS content, arg_max(is_error, ix) AS is_error, max(ix) AS result_ix FROM b WHERE type = 'tool_result' GROUP BY ALL")
_of("s11_session_facts", lambda e: metadata.session_facts(e, ["git_branch", "model", "request_id"]), event_entries, sql=SQL + " SELECT session_id, arg_min(git_branch, ix) AS git_branch, arg_min(model, ix) FILTER (model IS NOT NULL) AS model, arg_min(request_id, ix) FILTER (request_id IS NOT NULL) AS request_id FROM e GROUP BY session_id")

# --- metadata --------------------------------------------------------------------
_META = SQL + """, o AS (SELECT DISTINCT e.session_id FROM (SELECT session_id, max(ix) AS ix FROM e WHERE type = 'assistant' GROUP BY 1) l JOIN b e USING (session_id, ix)
  WHERE NOT EXISTS (SELECT 1 FROM b r WHERE r.session_id = e.session_id AND r.tool_use_id = e.tool_id)),
m AS (SELECT session_id, arg_min(ts, ix) AS start_ts, arg_max(ts, ix) AS end_ts, CAST(round(epoch_ms(CAST(arg_max(ts, ix) AS TIMESTAMP) ) / 1000.0 - epoch_ms(CAST(arg_min(ts, ix) AS TIMESTAMP)) / 1000.0) AS BIGINT) AS duration_s,
  count(*) AS turn_count, CASE WHEN session_id IN (SELECT session_id FROM o) THEN 'ongoing' WHEN bool_or(type = 'assistant') THEN 'completed' ELSE 'unknown' END AS end_state FROM e GROUP BY session_id)"""
_of("m1_metadata", metadata.metadata, event_entries, event_blocks, sql=_META + " SELECT * FROM m")
_of("m6_info", lambda e, b: metadata.info(e, b).drop("by_model", "git_branch"), event_entries, event_blocks, sql=_META + f", t AS (SELECT session_id, {ZEROED} FROM e GROUP BY 1) SELECT * FROM m JOIN t USING (session_id)")

# --- analysis ----------------------------------------------------------------------
_A1 = f"SELECT session_id, model, {COUNTERS}, count(*) AS message_count FROM e WHERE type = 'assistant' AND model <> '<synthetic>' GROUP BY ALL"
_of("a1_tokens_by_model", analyze.tokens_by_model, event_entries, sql=SQL + _A1)
_of("a2_token_totals", analyze.token_totals, event_entries, sql=SQL + f"SELECT session_id, {ZEROED} FROM e GROUP BY session_id")
_of("a2_token_rollup", analyze.token_rollup, event_entries, sql=SQL + f"SELECT session_id, model, {COUNTERS} FROM e WHERE type = 'assistant' AND model <> '<synthetic>' GROUP BY GROUPING SETS ((session_id, model), (session_id))")
_of("a3_tool_counts", analyze.tool_counts, event_blocks, sql=SQL + "SELECT session_id, tool_name, count(*) AS calls FROM b WHERE type = 'tool_use' GROUP BY ALL")
_A4 = "SELECT session_id, file_path AS path, count(*) FILTER (tool_name = 'Read') AS reads, count(*) FILTER (tool_name IN ('Edit', 'MultiEdit', 'NotebookEdit')) AS edits, count(*) FILTER (tool_name = 'Write') AS writes FROM b WHERE type = 'tool_use' AND file_path <> '' GROUP BY ALL"
_of("a4_files_touched", analyze.files_touched, event_blocks, sql=SQL + _A4)
_of("a5_read_without_write", analyze.read_without_write, event_blocks, sql=SQL + f", f AS ({_A4}) SELECT session_id, path FROM f WHERE reads > 0 AND edits = 0 AND writes = 0")
_of("a6_bash_clusters", lambda b: analyze.bash_clusters(b).withColumn("example_ix", F.array_join(F.col("example_ix").cast("array<string>"), ",")), event_blocks, sql=SQL + r""", w AS (SELECT session_id, ix, regexp_extract(command, '^\s*(\S+)', 1) AS cluster, row_number() OVER (PARTITION BY session_id, regexp_extract(command, '^\s*(\S+)', 1) ORDER BY ix) AS n FROM b WHERE tool_name = 'Bash'),
g AS (SELECT session_id, cluster, count(*) AS calls, min(ix) AS first, string_agg(ix, ',' ORDER BY ix) FILTER (n <= 5) AS example_ix FROM w GROUP BY ALL)
SELECT session_id, cluster, calls, example_ix, CAST(row_number() OVER (PARTITION BY session_id ORDER BY calls DESC, first) AS INTEGER) AS position FROM g""")
_of("a7_file_churn", lambda b: analyze.file_churn(b).select("session_id", "path", F.array_join(F.transform("timeline", lambda e: F.concat(e["ix"].cast("string"), F.lit(" "), e["kind"])), ",").alias("timeline")), event_blocks, sql=SQL + "SELECT session_id, file_path AS path, string_agg(ix || ' ' || tool_name, ',' ORDER BY ix) AS timeline FROM b WHERE file_path IS NOT NULL GROUP BY ALL")
_of("a8_failures", analyze.failures, event_blocks, sql=SQL + "SELECT r.session_id, r.ix, r.block_ix, r.tool_use_id, coalesce(u.tool_name, 'unknown') AS tool_name, u.input, r.content AS error FROM b r LEFT JOIN b u ON r.session_id = u.session_id AND r.tool_use_id = u.tool_id WHERE r.type = 'tool_result' AND r.is_error")
_of("a9_token_density", analyze.token_density, event_entries, sql=SQL + "SELECT session_id, ix, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens FROM e WHERE type = 'assistant' AND model <> '<synthetic>'")


@_query("a10_subagents", SQL + f""", s AS (SELECT *, CASE WHEN CAST(session_id AS BIGINT) % 3 = 2 THEN CAST(CAST(session_id AS BIGINT) - 1 AS VARCHAR) END AS parent FROM e),
p AS (SELECT session_id, ix AS parent_ix, row_number() OVER (PARTITION BY session_id ORDER BY ix) AS n FROM b WHERE tool_name = 'Read'),
t AS (SELECT parent, session_id AS subagent, arg_min(ts, ix) AS first_ts, count(*) AS turn_count, {ZEROED} FROM s WHERE parent IS NOT NULL GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY first_ts, subagent) AS n FROM t)
SELECT parent AS session_id, subagent, parent_ix, turn_count, {", ".join(analyze.COUNTERS)} FROM q LEFT JOIN p ON p.session_id = q.parent AND p.n = q.n""")
def subagents(spark: SparkSession, d: str) -> DataFrame:
    """A10: every third user's log is a subagent's of the user before; Read calls stand for Task calls."""
    own = F.col("session_id").cast("long")
    entries = event_entries(spark, d).withColumn("parent_session_id", F.when(own % 3 == 2, (own - 1).cast("string")))
    return analyze.subagents(entries, event_blocks(spark, d).filter("tool_name = 'Read'").select("session_id", "ix", "block_ix"))


@_query("a13_phases", SQL + """, p AS (SELECT *, sum(CASE WHEN ix > 0 AND ix % 25 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ix) AS phase FROM e)
SELECT session_id, CAST(phase AS BIGINT) AS phase, min(ix) AS start_ix, max(ix) AS end_ix, arg_min(coalesce(input_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0), ix) FILTER (type = 'assistant' AND model <> '<synthetic>') AS baseline_tokens FROM p GROUP BY ALL""")
def phases(spark: SparkSession, d: str) -> DataFrame:
    """A13 with a boundary at each 25th entry."""
    return analyze.compaction_phases(event_entries(spark, d).withColumn("is_boundary", (F.col("ix") > 0) & (F.col("ix") % 25 == 0)))


_of("a15_usage_rollup", analyze.usage_rollup, event_entries, sql=SQL + f", t AS (SELECT session_id, {ZEROED} FROM e GROUP BY 1) SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in analyze.COUNTERS)}, count(*) AS sessions FROM t")


# --- search ---------------------------------------------------------------------------
_of("q1_tool_uses", search.tool_uses, event_blocks, sql=SQL + "SELECT session_id, ix, block_ix, 'tool_use' AS kind, concat_ws('  ', tool_name, 'file_path=' || file_path, 'cmd=' || left(command, 80)) AS summary, tool_id FROM b WHERE type = 'tool_use'")
_of("q2_tool_results", search.tool_results, event_blocks, sql=SQL + "SELECT session_id, ix, block_ix, 'tool_result' AS kind, concat_ws('  ', tool_use_id, CASE WHEN is_error THEN '[ERROR]' END, left(replace(content, chr(10), ' '), 80)) AS summary, is_error FROM b WHERE type = 'tool_result'")
_Q3 = """, x AS (SELECT session_id, ix, type AS kind, content_text AS t, instr(content_text, 'the') - 1 AS pos FROM c WHERE type IN ('user', 'assistant') AND contains(content_text, 'the')),
s AS (SELECT session_id, ix, kind, (CASE WHEN pos > 20 THEN '...' ELSE '' END) || replace(substr(t, greatest(pos - 20, 0) + 1, least(pos + 63, length(t)) - greatest(pos - 20, 0)), chr(10), ' ') || (CASE WHEN pos + 63 < length(t) THEN '...' ELSE '' END) AS summary FROM x)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    texts = conversation_entries(spark, d).select("session_id", "ix", F.col("type").alias("role"), F.col("content_text").alias("text"))
    return search.text_search(texts, "the")


_of("q3_text_search", lambda m: m, _found, sql=SQL + _Q3 + " SELECT session_id, ix, kind, summary FROM s")
_of("q7_match_lines", search.format_matches, _found, sql=SQL + _Q3 + " SELECT session_id, ix, format('{:>5}', ix) || '  ' || kind || '  ' || summary AS line FROM s")


@_query("q4_show", SQL + ", w AS (SELECT DISTINCT session_id, unnest([3, 70, 10000]) AS ix FROM e) SELECT w.session_id, w.ix, e.uuid, e.type, e.uuid IS NOT NULL AS found FROM w LEFT JOIN e USING (session_id, ix)")
def show(spark: SparkSession, d: str) -> DataFrame:
    """Q4 for three places of every session."""
    entries = event_entries(spark, d)
    wanted = entries.select("session_id").distinct().withColumn("ix", F.explode(F.array(*map(F.lit, (3, 70, 10000)))))
    return search.show(entries, wanted).select("session_id", "ix", "uuid", "type", "found")


@_query("q5_field", "SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ix, json_extract_string(props, '$.k') AS value FROM events")
def field(spark: SparkSession, d: str) -> DataFrame:
    """Q5 over the events' own JSON."""
    return search.field(table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ix"), F.col("props").alias("raw")), "k")


# --- rounds and briefs ---------------------------------------------------------------
_ROUNDS = SQL + r""", r0 AS (SELECT e.*, CAST(sum(CASE WHEN content_text IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ix) AS INTEGER) AS round FROM e),
r1 AS (SELECT session_id, round, min(ix) AS user_ix, arg_min(content_text, ix) FILTER (content_text IS NOT NULL) AS human, arg_min(git_branch, ix) AS branch, count(*) AS entries FROM r0 WHERE round > 0 GROUP BY ALL),
r AS (SELECT *, regexp_matches(human, '^(\s*<(local-command-caveat|command-name|command-message|command-args|command-stdout|system-reminder|local-command-stdout)>[^<]*</[a-z-]+>)*\s*$') AS wrapper FROM r1)"""
_of("b3_rounds", lambda e, h: rounds.round_table(rounds.rounds(e, h)), event_entries, _event_humans, sql=_ROUNDS + " SELECT session_id, round, user_ix, human, branch, entries, wrapper FROM r")
_of("b4_branch_changes", lambda e, h: rounds.rendered_rounds(rounds.round_table(rounds.rounds(e, h))).select("session_id", "n", "user_ix", "branch_change"), event_entries, _event_humans, sql=_ROUNDS + """, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY user_ix) AS INTEGER) AS n, lag(branch) OVER (PARTITION BY session_id ORDER BY user_ix) AS before FROM r WHERE NOT wrapper)
SELECT session_id, n, user_ix, CASE WHEN branch IS DISTINCT FROM before THEN branch END AS branch_change FROM s""")
_STREAM = _ROUNDS + r""", l AS (SELECT session_id, tool_use_id, arg_max(content, ix) AS content, arg_max(is_error, ix) AS is_error FROM b WHERE type = 'tool_result' GROUP BY ALL),
st AS (SELECT b.session_id, r0.round, b.ix, b.block_ix, 'tool' AS kind, coalesce(l.is_error, false) AS failed, coalesce(l.content, '') AS res, regexp_replace(b.file_path, '^/home/[^/]+/', '') AS p, b.tool_name, b.command
  FROM b JOIN r0 USING (session_id, ix) LEFT JOIN l ON l.session_id = b.session_id AND l.tool_use_id = b.tool_id WHERE b.type = 'tool_use' AND r0.round > 0),
lines AS (SELECT session_id, round, ix, block_ix, kind, CASE tool_name
  WHEN 'Read' THEN 'Read ' || p || CASE WHEN failed THEN ' → [error: ' || left(split_part(res, chr(10), 1), 80) || ']' ELSE ' — ' || CASE WHEN res = '' THEN 0 ELSE len(string_split(res, chr(10))) END || ' lines, ~' || CAST(round(length(res) / 4.0) AS BIGINT) || ' tokens' END
  WHEN 'Write' THEN 'Write ' || p || CASE WHEN failed THEN ' → [error: ' || left(split_part(res, chr(10), 1), 80) || ']' ELSE ' — 0 lines, ~0 tokens' END
  WHEN 'Edit' THEN 'Edit ' || p || CASE WHEN failed THEN ' → [error: ' || left(split_part(res, chr(10), 1), 80) || ']' ELSE ' +1 -1' END
  ELSE '' END AS line, failed, res, p, tool_name, command FROM st)"""
_of("b5_round_stream", lambda e, b, h: rounds.round_stream(rounds.rounds(e, h), b).filter("line LIKE 'Read %' OR line LIKE 'Write %' OR line LIKE 'Edit %'").select("session_id", "round", "ix", "line"), event_entries, event_blocks, _event_humans, sql=_STREAM + " SELECT session_id, round, ix, line FROM lines WHERE tool_name IN ('Read', 'Write', 'Edit')")
_of("b6_tool_groups", lambda e, b, h: rounds.tool_groups(rounds.round_stream(rounds.rounds(e, h), b)).select("session_id", "round", "from_ix", "to_ix", F.size("lines").alias("calls")), event_entries, event_blocks, _event_humans, sql=_STREAM + " SELECT session_id, round, min(ix) AS from_ix, max(ix) AS to_ix, CAST(count(*) AS INTEGER) AS calls FROM st GROUP BY ALL")
_of("b8_brief_stats", rounds.brief_stats, event_entries, event_blocks, _event_humans, sql=_ROUNDS + """ SELECT t.session_id, coalesce(n.rounds, 0) AS rounds, coalesce(n.raw_rounds, 0) AS raw_rounds, coalesce(u.tool_uses, 0) AS tool_uses, CAST(0 AS BIGINT) AS text_tokens, t.entry_count
FROM (SELECT session_id, count(*) AS entry_count FROM e GROUP BY 1) t LEFT JOIN (SELECT session_id, count(*) FILTER (NOT wrapper) AS rounds, count(*) AS raw_rounds FROM r GROUP BY 1) n USING (session_id)
LEFT JOIN (SELECT session_id, count(*) FILTER (type = 'tool_use') AS tool_uses FROM b GROUP BY 1) u USING (session_id)""")


@_query("b10_text_functions", "SELECT doc_id, CAST(round(length(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN length(replace(text, chr(10), ' ⏎ ')) > 80 THEN left(replace(text, chr(10), ' ⏎ '), 79) || '…' ELSE replace(text, chr(10), ' ⏎ ') END AS short FROM documents")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """B10 over documents."""
    return table(spark, d, "documents").select("doc_id", T.est_tokens(F.length("text")).alias("tokens"), T.shorten(F.col("text"), 80).alias("short"))


@_query("b12_commits", SQL + r"SELECT session_id, ix, 'abc1234' AS hash, 'commit ' || split_part(content, ' ', 4) AS subject FROM b WHERE content LIKE '[main%'")
def commits(spark: SparkSession, d: str) -> DataFrame:
    """B12 over results."""
    found = event_blocks(spark, d).filter("type = 'tool_result'").select("session_id", "ix", T.commit_hash(F.col("content")).alias("hash"), T.commit_subject(F.col("content")).alias("subject"))
    return found.filter("hash IS NOT NULL")


_CALL_LINES = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, replace(coalesce(text, ''), '. ', '.' || chr(10)) AS out, '/home/u/' || coalesce(source, '') || '/' || doc_id || '.txt' AS path, doc_id % 11 = 0 AS failed FROM documents),
f AS (SELECT *, regexp_replace(path, '^/(?:root|home|tmp|Users|users)/[^/]+/(.+)$', '\1') AS p, len(list_filter(string_split(out, chr(10)), lambda s: regexp_matches(s, '[^\s\p{Z}\x{0B}\x{85}]'))) AS filled,
  replace(t, chr(10), ' ⏎ ') AS flat FROM d),
b AS (SELECT page_id, page_id % 7 = 0 AS failed, CASE page_id % 6 WHEN 0 THEN ['url', url] WHEN 1 THEN ['element', 'Link ' || url] WHEN 2 THEN ['name', url] WHEN 3 THEN ['key', ''] WHEN 5 THEN ['selector', html] END AS arg FROM pages)
SELECT 'glob' AS call, doc_id AS id, 'Glob ' || to_json(CASE WHEN length(flat) > 60 THEN substring(flat, 1, 59) || '…' ELSE flat END)::VARCHAR || CASE WHEN failed THEN ' → [error]' ELSE ' — ' || filled || ' matches' END AS line FROM f
UNION ALL SELECT 'grep', doc_id, 'Grep ' || to_json(CASE WHEN length(flat) > 50 THEN substring(flat, 1, 49) || '…' ELSE flat END)::VARCHAR || ' in ' || p || CASE WHEN failed THEN ' → [error]' ELSE ' — ' || CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE filled END || ' matches' END FROM f
UNION ALL SELECT 'write', doc_id, 'Write ' || p || CASE WHEN failed THEN ' → [error: ' || substring(string_split(out, chr(10))[1], 1, 80) || ']' ELSE ' — ' || CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END || ' lines, ~' || CAST(round(length(t) / 4.0) AS BIGINT) || ' tokens' END FROM f
UNION ALL SELECT 'browser', page_id, 'browser_' || page_id % 3 || '(' || coalesce(arg[1] || '=' || to_json(CASE WHEN length(replace(arg[2], chr(10), ' ⏎ ')) > 40 THEN substring(replace(arg[2], chr(10), ' ⏎ '), 1, 39) || '…' ELSE replace(arg[2], chr(10), ' ⏎ ') END)::VARCHAR, '') || ')' || CASE WHEN failed THEN ' → [error]' ELSE '' END FROM b"""


@_query("b17_call_lines", _CALL_LINES)
def call_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of file searches and writes over documents, with results of many lines, and of browser calls over pages, whose input names a known field, another one or none."""
    docs, pages = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pages.parquet")
    text, number, page = F.coalesce("text", F.lit("")), F.col("doc_id"), F.col("page_id")
    out = F.replace(text, F.lit(". "), F.lit(".\n"))
    found = F.when(number % 3 == 0, F.concat(F.lit("Found "), number.cast("string"), F.lit(" files\n"), out)).otherwise(out)
    path = F.concat(F.lit("/home/u/"), F.coalesce("source", F.lit("")), F.lit("/"), number.cast("string"), F.lit(".txt"))
    call = lambda kind, tool, result, **given: F.struct(F.lit(kind).alias("call"), F.lit(tool).alias("tool_name"), F.to_json(F.struct(*[x.alias(k) for k, x in given.items()])).alias("input"), result.alias("content"))
    calls = F.explode(F.array(call("glob", "Glob", out, pattern=text), call("grep", "Grep", found, pattern=text, path=path), call("write", "Write", out, file_path=path, content=text)))
    files = docs.select(number.alias("id"), (number % 11 == 0).alias("failed"), calls.alias("c")).select("id", "failed", "c.*")
    of = lambda n, x: F.when(page % 6 == n, x)
    given = {"n": of(2, page), "name": F.when((page % 6).isin(2, 3), F.col("url")), "ref": of(1, page.cast("string")), "element": of(1, F.concat(F.lit("Link "), "url")), "url": of(0, F.col("url")), "key": of(3, F.lit("")), "selector": of(5, F.col("html"))}
    browser = pages.select(page.alias("id"), (page % 7 == 0).alias("failed"), F.lit("browser").alias("call"), F.concat(F.lit("mcp__plugin_playwright_playwright__browser_"), (page % 3).cast("string")).alias("tool_name"), F.to_json(F.struct(*[x.alias(k) for k, x in given.items()])).alias("input"), F.lit("").alias("content"))
    every = files.unionByName(browser).withColumn("given", parsed_input("input"))
    return every.select("call", "id", one_liner(F.col("tool_name"), F.col("given"), F.col("content"), F.col("failed")).alias("line"))


@_query("b18_bash_lines", SQL + r""", l AS (SELECT session_id, tool_use_id, arg_max(content, ix) AS content, arg_max(is_error, ix) AS is_error FROM b WHERE type = 'tool_result' GROUP BY ALL)
SELECT b.session_id, b.ix, rtrim('Bash `' || b.command || '` — ~' || CAST(round(length(coalesce(l.content, '')) / 4.0) AS BIGINT) || ' tok out ' || CASE WHEN coalesce(l.is_error, false) THEN '[error]' WHEN l.content LIKE '[main%' THEN ' → commit abc1234 "commit ' || split_part(l.content, ' ', 4) || '"' ELSE '' END) AS line
FROM b LEFT JOIN l ON l.session_id = b.session_id AND l.tool_use_id = b.tool_id WHERE b.tool_name = 'Bash'""")
def bash_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every command with its result."""
    blocks = event_blocks(spark, d)
    results = analyze.tool_result_index(blocks).withColumnRenamed("tool_use_id", "tool_id")
    calls = blocks.filter("tool_name = 'Bash'").drop("content", "content_kind", "is_error").withColumn("given", parsed_input("input")).join(results, ["session_id", "tool_id"], "left")
    return calls.select("session_id", "ix", one_liner(F.col("tool_name"), F.col("given"), F.col("content"), F.coalesce("is_error", F.lit(False))).alias("line"))


# --- condensing ------------------------------------------------------------------------
_STUB = "strlen(content_text) > 500"


@_query("c1_condensed", SQL + f"SELECT session_id, ix, CASE WHEN type IN ('user', 'assistant', 'system') THEN type ELSE 'other' END AS role, CASE WHEN NOT ({_STUB}) THEN content_text END AS content, CASE WHEN {_STUB} THEN 'turns/' || lpad(CAST(ix AS VARCHAR), 5, '0') || '.json' END AS ref, CASE WHEN {_STUB} THEN strlen(content_text) END AS bytes, CASE WHEN {_STUB} THEN left(content_text, 500) END AS preview FROM c")
def condensed(spark: SparkSession, d: str) -> DataFrame:
    """C1, C8 over conversations, cut at 500 bytes."""
    return condense.condensed_texts(conversation_entries(spark, d), 500).select("session_id", "ix", "role", "content", "stub.ref", "stub.bytes", "stub.preview")


_of("c12_truncated_ix", lambda c: condense.truncated_ix(condense.condensed_texts(c, 500)), conversation_entries, sql=SQL + f"SELECT session_id, ix FROM c WHERE {_STUB}")
_of("c13_full_turns", lambda c: condense.full_turns(c, condense.truncated_ix(condense.condensed_texts(c, 500))).select("session_id", "ix", "content_text"), conversation_entries, sql=SQL + f"SELECT session_id, ix, content_text FROM c WHERE {_STUB}")


@_query("c17_previews", "SELECT event_id, CASE WHEN length(props) > 5 THEN left(replace(props, ' ', ''), 5) || ' …[truncated]' ELSE replace(props, ' ', '') END AS preview FROM events")
def previews(spark: SparkSession, d: str) -> DataFrame:
    """C17 over the events' JSON."""
    return table(spark, d, "events").select("event_id", condense.preview(F.col("props"), 5).alias("preview"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    e = tables.numbered_events(table(spark, d, "events")).filter("event_type = 'purchase'")
    return e.select("session_id", F.col("file_path").alias("path"), F.row_number().over(Window.partitionBy("session_id", "file_path").orderBy("ix")).alias("version"), "ix")


_VERSIONS = SQL + ", v AS (SELECT session_id, file_path AS path, CAST(row_number() OVER (PARTITION BY session_id, file_path ORDER BY ix) AS INTEGER) AS version, ix FROM ev WHERE event_type = 'purchase')"
_of("c16_file_versions", filehistory.first_versions, _versions, sql=_VERSIONS + " SELECT * FROM v")


@_query("f1_file_at", _VERSIONS + """, q AS (SELECT session_id, file_path AS path, ix FROM ev WHERE event_type = 'view')
SELECT q.session_id, q.path, q.ix, v.version, CASE WHEN v.version IS NOT NULL THEN 'ok' WHEN EXISTS (SELECT 1 FROM v w WHERE w.session_id = q.session_id AND w.path = q.path) THEN 'too early' ELSE 'untracked' END AS status
FROM q ASOF LEFT JOIN v ON v.session_id = q.session_id AND v.path = q.path AND q.ix >= v.ix""")
def file_at(spark: SparkSession, d: str) -> DataFrame:
    """the version that each Read sees."""
    reads = event_blocks(spark, d).filter("tool_name = 'Read'").select("session_id", F.col("file_path").alias("path"), "ix")
    return filehistory.file_at(_versions(spark, d), reads).drop("blob")


# --- compacting --------------------------------------------------------------------------
def _start(spark: SparkSession, d: str, keep: int = 2) -> DataFrame:
    return compact.preserved_from(_conversation_humans(spark, d).select("session_id", F.col("ix").alias("user_ix")), conversation_entries(spark, d), keep)


_START = SQL + """, f AS (SELECT session_id, ix, row_number() OVER (PARTITION BY session_id ORDER BY ix DESC) AS n FROM c WHERE type = 'user'),
p AS (SELECT session_id, CAST(coalesce((SELECT min(ix) FROM f WHERE f.session_id = t.session_id AND n <= 2), cnt) AS INTEGER) AS preserved_from FROM (SELECT session_id, count(*) AS cnt FROM c GROUP BY 1) t),
g AS (SELECT c.session_id, CASE WHEN ix >= preserved_from THEN 2 WHEN type IN ('user', 'assistant') THEN 0 ELSE 1 END AS section, ix, type, content_text FROM c JOIN p USING (session_id))"""
_of("k1_preserved_from", lambda s: s, _start, sql=_START + " SELECT * FROM p")
_of("k11_bundle", compact.bundle, conversation_entries, _start, sql=_START + r""" SELECT session_id, section, ix, type, CASE WHEN section > 0 THEN content_text ELSE '<turn ix="' || ix || '" kind="' || type || '">' || chr(10) ||
CASE WHEN content_text = '' THEN '(empty)' ELSE replace(replace(replace(content_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END || chr(10) || '</turn>' END AS body FROM g""")


@_query("k10_text_blocks", r"""SELECT doc_id, CASE WHEN strlen(text) > 16384 THEN '<truncated_text bytes="' || strlen(text) || '" ix="' || doc_id || '">' || replace(replace(replace(left(text, 100), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '…</truncated_text>' ELSE replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS xml FROM documents""")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """K9, K10 over documents."""
    return table(spark, d, "documents").select("doc_id", compact.text_xml(F.col("text"), F.col("doc_id")).alias("xml"))


_of("k7_event_xml", lambda b: compact.tool_use_xml(b).select("session_id", "ix", "block_ix", "xml"), event_blocks, sql=SQL + r"""SELECT session_id, ix, block_ix, '<tool_use name="' || tool_name || '" ix="' || ix || '">' || coalesce(chr(10) || '<file_path>' || file_path || '</file_path>', '') || coalesce(chr(10) || '<command>' || command || '</command>', '') ||
CASE WHEN tool_name = 'Edit' THEN chr(10) || '<old_string>' || json_extract_string(input, '$.old_string') || '</old_string>' || chr(10) || '<new_string>' || json_extract_string(input, '$.new_string') || '</new_string>' ELSE '' END || chr(10) || '</tool_use>' AS xml FROM b WHERE type = 'tool_use'""")
_of("k4_tool_fields", compact.tool_fields, event_blocks, sql=SQL + r""", x AS (SELECT session_id, ix, block_ix, CASE WHEN command IS NOT NULL THEN [{'n': 0, 'name': 'command', 'value': command}]
WHEN tool_name = 'Edit' THEN [{'n': 0, 'name': 'file_path', 'value': file_path}, {'n': 1, 'name': 'old_string', 'value': json_extract_string(input, '$.old_string')}, {'n': 2, 'name': 'new_string', 'value': json_extract_string(input, '$.new_string')}]
ELSE [{'n': 0, 'name': 'file_path', 'value': file_path}] END AS fs FROM b WHERE type = 'tool_use') SELECT session_id, ix, block_ix, f.n AS n, f.name AS name, f.value AS value, CAST(NULL AS INTEGER) AS bytes FROM x, unnest(fs) AS u(f)""")
_of("k3_classes", lambda b: compact.classify(b, ("Write",)), event_blocks, sql=SQL + " SELECT b.session_id, b.ix, coalesce(b.tool_name = 'Write', false) OR coalesce(u.tool_name = 'Write', false) AS preserved, false AS mixed FROM b LEFT JOIN b u ON u.session_id = b.session_id AND u.tool_id = b.tool_use_id")
_of("q6_rendered", search.render, event_entries, event_blocks, sql=SQL + r""" SELECT e.session_id, e.ix, CASE WHEN e.type = 'assistant' THEN '[assistant · ' || e.model || ']' || chr(10) || '[tool_use: ' || b.tool_name || ' id=' || b.tool_id || ']' || chr(10) || 'input: {' || chr(10) || '  ' ||
replace(replace(replace(replace(b.input[2:-2], '":"', '": "'), '","', '",' || chr(10) || '  "'), '{', ''), '}', '') || chr(10) || '}'
WHEN b.ix IS NOT NULL THEN '[user · tool_result]' || chr(10) || 'tool_use_id: ' || b.tool_use_id || CASE WHEN b.is_error THEN chr(10) || 'is_error: true' ELSE '' END || chr(10) || 'content:' || chr(10) || b.content
ELSE '[user]' || chr(10) || e.content_text END AS text FROM e LEFT JOIN b USING (session_id, ix)""")
_ID = "sha256({0})"


def _id_sql(parts: str) -> str:
    h = _ID.format(parts)
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@_query("k15_id_chain", SQL + f""", n AS (SELECT session_id, ix, CASE WHEN type = 'assistant' THEN 1 ELSE 0 END AS section, CASE WHEN ix % 4 > 0 THEN uuid END AS uuid FROM e),
m AS (SELECT *, CASE WHEN uuid IS NOT NULL THEN {_id_sql("session_id || '|' || section || '|' || ix")} END AS new_uuid FROM n)
SELECT session_id, section, ix, new_uuid, last_value(new_uuid IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY section, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new_parent_uuid FROM m""")
def id_chain(spark: SparkSession, d: str) -> DataFrame:
    """K14, K15 with every fourth entry lacking an id."""
    e = event_entries(spark, d).select("session_id", "ix", F.when(F.col("type") == "assistant", 1).otherwise(0).alias("section"), F.when(F.col("ix") % 4 > 0, F.col("uuid")).alias("uuid"))
    return compact.chain(e).select("session_id", "section", "ix", "new_uuid", "new_parent_uuid")


@_query("k16_fresh_sessions", SQL + f", s AS (SELECT DISTINCT session_id FROM c) SELECT session_id, {_id_sql(chr(39).join(['session_id || ', '|0', '']))} AS new_session_id FROM s")
def fresh_sessions(spark: SparkSession, d: str) -> DataFrame:
    """K16 against the sessions that there are."""
    sessions = conversation_entries(spark, d).select("session_id").distinct()
    return compact.fresh_sessions(sessions, sessions)


# --- narratives ------------------------------------------------------------------------------
def _turns(spark: SparkSession, d: str) -> DataFrame:
    return conversation_entries(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"))


_KINDS = "research, planning, implementation, debugging, review, housekeeping, other"


@_query("n1_lint", SQL + f""", t AS (SELECT session_id, count(*) AS n, CAST(session_id AS BIGINT) % 7 AS k FROM c GROUP BY 1) SELECT session_id, x AS error FROM (
SELECT session_id, CASE k WHEN 0 THEN ['narrative.summary must be a non-empty string'] WHEN 1 THEN ['main_tasks[0].refs[0] is not a valid ref (got ' || (n + 5) || ')']
WHEN 2 THEN ['main_tasks[0].title must be a string', 'main_tasks[0].status must be one of completed, partial, abandoned, verified (got "done")', 'decisions[0] must be an object']
WHEN 3 THEN ['verification.was_verified must be a boolean', 'episodes[0].ix_range is inverted: [9999, 0]', 'episodes[0].ix_range[0]=9999 is not a valid ix', 'episodes[0].kind must be one of {_KINDS} (got "nap")']
WHEN 4 THEN ['narrative root is not an object'] WHEN 5 THEN ['narrative missing required field: wins', 'narrative missing required field: unresolved'] ELSE [] END AS xs FROM t), unnest(xs) u(x)""")
def lint(spark: SparkSession, d: str) -> DataFrame:
    """N1 over placeholders, six of seven spoilt in a way of their own."""
    turns, k = _turns(spark, d), F.col("session_id").cast("long") % 7
    text, put = F.col("narrative"), lambda x, a, b: F.replace(x, F.lit(a), b if not isinstance(b, str) else F.lit(b))
    far = F.concat(F.lit('"refs":['), (F.col("turn_count") + 5).cast("string"), F.lit(']}],"episodes"'))
    spoilt = F.when(k == 0, F.regexp_replace(text, r'"summary":"Session[^"]*"', '"summary":" "')).when(k == 1, put(text, '"refs":[0]}],"episodes"', far))
    spoilt = spoilt.when(k == 2, put(put(put(text, '"title":"session"', '"title":5'), '"partial"', '"done"'), '"decisions":[]', '"decisions":["x"]'))
    spoilt = spoilt.when(k == 3, put(put(F.regexp_replace(text, r'"ix_range":\[0,\d+\]', '"ix_range":[9999,0]'), '"was_verified":false', '"was_verified":"no"'), '"kind":"other"', '"kind":"nap"'))
    spoilt = spoilt.when(k == 4, F.concat(F.lit("["), text, F.lit("]"))).when(k == 5, put(text, ',"wins":[],"unresolved":[]', "")).otherwise(text)
    return narrative.lint(narrative.placeholder(turns).join(turns, "session_id").select("session_id", spoilt.alias("narrative")), turns)


_of("n2_placeholder", narrative.placeholder, _turns, sql=SQL + """, t AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1) SELECT session_id, '{"summary":"Session of ' || n || ' entries.","main_tasks":[{"title":"session","status":"partial","description":"","refs":[0]}],"episodes":[{"title":"all","kind":"other","ix_range":[0,' || greatest(n - 1, 0) || '],"summary":"","refs":[0]}],"decisions":[],"corrections":[],"verification":{"was_verified":false,"how":"","refs":[]},"friction_points":[],"wins":[],"unresolved":[]}' AS narrative FROM t""")


# --- scans ---------------------------------------------------------------------------------
def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("location"), "text")


_ISSUES = "WITH t AS (SELECT source || '/' || doc_id AS location, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT location, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM t), i AS (" + " UNION ALL ".join(
    f"SELECT location, line_no, '{n}' AS check_name, '{s}' AS severity, unnest(regexp_extract_all(line, '{p}')) AS match, left(trim(line, ' '), 140) AS line FROM l" for n, s, p, _ in scan.CHECKS) + "), u AS (SELECT DISTINCT severity, check_name, location, line_no, match FROM i)"
_of("o1_scan", lambda t: scan.scan(scan.scannable(t)), _texts, sql=_ISSUES + " SELECT location, CAST(line_no AS INTEGER) AS line_no, check_name, severity, match, line FROM i")
_of("o4_distinct_contents", scan.distinct_contents, _texts, sql="SELECT sha256(text) AS content_id, count(*) AS places, min(source || '/' || doc_id) AS location FROM documents GROUP BY 1")
_of("o4_content_issues", lambda t: scan.content_issues(scan.scannable(t)), _texts, sql=_ISSUES + ", d AS (SELECT sha256(text) AS content_id, count(*) AS places, min(source || '/' || doc_id) AS location FROM documents GROUP BY 1) SELECT content_id, places, location, CAST(line_no AS INTEGER) AS line_no, check_name, severity, match, line FROM d JOIN i USING (location)")
_of("o5_report", lambda t: scan.report(scan.scan(t)).drop("n"), _texts, sql=_ISSUES + " SELECT severity, check_name, location, CAST(line_no AS INTEGER) AS line_no, match FROM u QUALIFY row_number() OVER (PARTITION BY severity, check_name ORDER BY location, line_no, match) <= 25")
_of("o5_totals", lambda t: scan.totals(scan.scan(t)), _texts, sql=_ISSUES + " SELECT severity, check_name, count(*) AS issues FROM u GROUP BY ALL")


@_query("o2_known_tokens", "WITH k AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)/', 1) AS host FROM pages), s AS (SELECT DISTINCT unnest(string_split(host, '.')) AS token FROM k), t AS (SELECT DISTINCT source || '/' || doc_id AS location, unnest(string_split_regex(text, '[^a-zA-Z0-9-]+')) AS token FROM documents) SELECT location, token FROM t JOIN s USING (token) WHERE length(token) >= 4")
def known_tokens(spark: SparkSession, d: str) -> DataFrame:
    """O2: parts of known host names in documents."""
    hosts = table(spark, d, "pages").select(F.explode(F.split(F.regexp_extract("url", "://([^/]+)/", 1), r"\.")).alias("token"))
    return scan.known_tokens(_texts(spark, d), hosts, 4)


from sessionlog import queries_rich, queries_sinks  # noqa: E402

QUERIES |= queries_rich.QUERIES | queries_sinks.QUERIES
ORACLE_SQL |= queries_rich.ORACLE_SQL | queries_sinks.ORACLE_SQL
