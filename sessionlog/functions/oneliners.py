"""One line for a tool call and its result, as column expressions.

Each function takes the call's input (see parsed_input), the result's text and
whether it failed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import commit_hash, commit_subject, diff_stat, est_tokens, first_line, json_quote, short_path, shorten

BROWSER_PREFIX = "mcp__plugin_playwright_playwright__"
BROWSER_FIELDS = ("url", "element", "ref", "text", "key", "selector")
TASK_LISTS = ("TodoWrite", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet")


#: Fields of inputs that some line shows.
STRINGS = ("file_path", "old_string", "new_string", "content", "pattern", "path", "glob", "command", "description", "prompt", "subagent_type", "taskId", "id", "subject", "title", "status", *(x for x in BROWSER_FIELDS))
OTHERS = ("offset", "limit", "replace_all")


def parsed_input(column: str) -> Column:
    """An input's JSON text with the fields that lines need, taken out once; a column of its own before any line is built."""
    of = lambda name, kind: f"try_variant_get(v, '$.{name}', '{kind}')"
    strings = [f"'{x}', if(schema_of_variant({of(x, 'variant')}) = 'STRING', {of(x, 'string')}, null)" for x in STRINGS]
    others = [f"'{x}', {of(x, 'string')}" for x in OTHERS]
    flag = f"'flag', schema_of_variant({of('replace_all', 'variant')}) = 'BOOLEAN'"
    return F.expr(f"element_at(transform(array(try_parse_json({column})), v -> named_struct('json', {column}, {', '.join([*strings, *others, flag])})), 1)")


def string_field(given: Column, name: str) -> Column:
    """A field of the input if it is a string and not empty, else null."""
    return F.nullif(given[name], F.lit(""))


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _text(x: Column) -> Column:
    return x.cast("string")


def _path(given: Column) -> Column:
    return F.coalesce(short_path(string_field(given, "file_path")), F.lit("<no path>"))


def _line_count(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.size(F.split(x, "\n")))


def _error(result: Column) -> Column:
    return F.concat(F.lit(" → [error: "), first_line(result, 80), F.lit("]"))


def read_line(given: Column, result: Column, failed: Column) -> Column:
    """B13."""
    offset, limit = given["offset"], given["limit"]
    window = F.when(offset.isNotNull() | limit.isNotNull(), F.concat(F.lit(" (offset="), F.coalesce(offset, F.lit("0")), F.lit(", limit="), F.coalesce(limit, F.lit("?")), F.lit(")"))).otherwise("")
    lines = F.when(result == "", 0).otherwise(F.size(F.split(result, "\n")) - F.when(result.endswith("\n"), 1).otherwise(0))
    tokens = est_tokens(F.length(F.regexp_replace(result, r"(?m)^\s*\d+\s*\t", "")))
    return F.concat(F.lit("Read "), _path(given), window, F.when(failed, _error(result)).otherwise(F.concat(F.lit(" — "), _text(lines), F.lit(" lines, ~"), _text(tokens), F.lit(" tokens"))))


def edit_line(given: Column, result: Column, failed: Column) -> Column:
    """B14."""
    stat = diff_stat(_or_empty(string_field(given, "old_string")), _or_empty(string_field(given, "new_string")))
    every = F.when(given["flag"] & (given["replace_all"] == "true"), " (replace_all)").otherwise("")
    return F.concat(F.lit("Edit "), _path(given), F.when(failed, _error(result)).otherwise(F.concat(every, F.lit(" +"), _text(stat["added"]), F.lit(" -"), _text(stat["deleted"]))))


def write_line(given: Column, result: Column, failed: Column) -> Column:
    """B15."""
    content = _or_empty(string_field(given, "content"))
    return F.concat(F.lit("Write "), _path(given), F.when(failed, _error(result)).otherwise(F.concat(F.lit(" — "), _text(_line_count(content)), F.lit(" lines, ~"), _text(est_tokens(F.length(content))), F.lit(" tokens"))))


def _filled_lines(x: Column) -> Column:
    return F.size(F.filter(F.split(x, "\n"), lambda s: F.regexp_like(s, F.lit(r"(?U)\S"))))


def grep_line(given: Column, result: Column, failed: Column) -> Column:
    """B16."""
    scope = F.coalesce(string_field(given, "path"), string_field(given, "glob"))
    found = F.nullif(F.regexp_extract(result, r"Found (\d+) (?:file|match|line)", 1), F.lit(""))
    end = F.when(failed, F.lit(" → [error]")).otherwise(F.concat(F.lit(" — "), F.coalesce(_text(found.cast("long")), _text(_filled_lines(result))), F.lit(" matches")))
    return F.concat(F.lit("Grep "), json_quote(shorten(_or_empty(string_field(given, "pattern")), 50)), _or_empty(F.concat(F.lit(" in "), short_path(scope))), end)


def glob_line(given: Column, result: Column, failed: Column) -> Column:
    """B17."""
    end = F.when(failed, F.lit(" → [error]")).otherwise(F.concat(F.lit(" — "), _text(_filled_lines(result)), F.lit(" matches")))
    return F.concat(F.lit("Glob "), json_quote(shorten(_or_empty(string_field(given, "pattern")), 60)), end)


def bash_line(given: Column, result: Column, failed: Column) -> Column:
    """B18."""
    about = string_field(given, "description")
    commit = F.when(~failed, F.concat(F.lit(" → commit "), commit_hash(result), F.lit(" "), json_quote(shorten(commit_subject(result), 50))))
    head = F.concat(F.lit("Bash `"), shorten(_or_empty(string_field(given, "command")), 70), F.lit("`"), _or_empty(F.when(F.length(about) < 40, F.concat(F.lit(" ("), about, F.lit(")")))))
    return F.rtrim(F.concat(head, F.lit(" — ~"), _text(est_tokens(F.length(result))), F.lit(" tok out "), F.when(failed, "[error]").otherwise(""), _or_empty(commit)))


def task_line(given: Column, result: Column, failed: Column) -> Column:
    """B19."""
    head = json_quote(shorten(_or_empty(F.coalesce(string_field(given, "description"), string_field(given, "prompt"))), 70))
    end = F.when(failed, F.lit(" → [error]")).otherwise(F.concat(F.lit(" — returned ~"), _text(est_tokens(F.length(result))), F.lit(" tok")))
    return F.concat(F.lit("Task → "), F.coalesce(string_field(given, "subagent_type"), F.lit("?")), F.lit(": "), head, end)


def task_list_line(name: Column, given: Column) -> Column:
    """B20."""
    first = lambda *names: F.coalesce(*[string_field(given, x) for x in names])
    return F.concat_ws(" ", name, F.concat(F.lit("#"), first("taskId", "id")), shorten(first("subject", "description", "title"), 70), F.concat(F.lit("["), first("status"), F.lit("]")))


def _first_scalar(given: Column, numbers: bool) -> Column:
    """name="value" of the first field that is a string, or any scalar, in order of the input."""
    fields = F.map_entries(F.from_json(given["json"], "map<string,string>"))
    kinds = F.from_json(given["json"], "map<string,variant>")
    allowed = ["STRING", "BOOLEAN", "BIGINT", "DOUBLE"] if numbers else ["STRING"]

    def fits(e: Column) -> Column:
        kind = F.schema_of_variant(kinds[e["key"]])
        return kind.isin(*allowed) | (kind.startswith("DECIMAL") if numbers else F.lit(False))

    first = F.get(F.filter(fields, fits), F.lit(0))
    return F.concat(first["key"], F.lit("="), json_quote(shorten(first["value"], 40)))


def browser_line(name: Column, given: Column, failed: Column) -> Column:
    """B21."""
    named = [F.when(given[x].isNotNull(), F.concat(F.lit(f"{x}="), json_quote(shorten(given[x], 40)))) for x in BROWSER_FIELDS]
    return F.concat(F.replace(name, F.lit(BROWSER_PREFIX), F.lit("")), F.lit("("), _or_empty(F.coalesce(*named, _first_scalar(given, False))), F.lit(")"), F.when(failed, " → [error]").otherwise(""))


def generic_line(name: Column, given: Column, failed: Column) -> Column:
    """B22."""
    return F.concat(name, _or_empty(F.concat(F.lit(" "), _first_scalar(given, True))), F.when(failed, " [error]").otherwise(""))


def one_liner(name: Column, given: Column, result: Column, failed: Column) -> Column:
    """The line of any tool."""
    result = _or_empty(result)
    return (
        F.when(name == "Read", read_line(given, result, failed))
        .when(name.isin("Edit", "NotebookEdit"), edit_line(given, result, failed))
        .when(name == "Write", write_line(given, result, failed))
        .when(name == "Grep", grep_line(given, result, failed))
        .when(name == "Glob", glob_line(given, result, failed))
        .when(name == "Bash", bash_line(given, result, failed))
        .when(name.isin("Task", "Agent"), task_line(given, result, failed))
        .when(name.isin(*TASK_LISTS), task_list_line(name, given))
        .when(name.startswith(BROWSER_PREFIX), browser_line(name, given, failed))
        .otherwise(generic_line(name, given, failed))
    )


def result_text(content: Column, kind: Column) -> Column:
    """A result's content as one text."""
    items = F.from_json(content, "array<struct<text:string,content:string>>")
    joined = F.array_join(F.filter(F.transform(items, lambda x: F.coalesce(x["text"], x["content"])), lambda x: x.isNotNull()), "\n")
    return F.coalesce(F.when(kind == "array", joined).otherwise(content), F.lit(""))
