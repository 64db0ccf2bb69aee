"""Compacted sessions: the last rounds as they are, what comes before in one bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlog.functions.jsonwalk import sweep, with_ids
from sessionlog.functions.text import xml_attr, xml_text

from .analyze import tool_use_index

#: A bundled text block is kept whole up to this size; input fields up to FIELD_BYTES.
TEXT_BYTES = 16 * 1024
FIELD_BYTES, FIELD_PREVIEW = 500, 100
#: Calls that stay as they are, so that a resumed session can replay them.
TASK_TOOLS = ("TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskOutput", "TaskStop")
#: The fields kept of each tool's input, in order; those after the bar are cut when long.
TOOL_FIELDS = {
    ("Read",): "file_path offset limit pages |",
    ("Edit", "NotebookEdit"): "file_path replace_all | old_string new_string",
    ("MultiEdit",): "file_path edits |",
    ("Write",): "file_path | content",
    ("Bash",): "| command : description timeout run_in_background",
    ("Grep",): "pattern path glob type output_mode -n -i -A -B -C context head_limit offset multiline |",
    ("Glob",): "pattern path |",
    ("Task", "Agent"): "subagent_type description model isolation run_in_background | prompt",
    ("TodoWrite",): "todos |",
}


def preserved_from(rounds: DataFrame, entries: DataFrame, keep: int) -> DataFrame:
    """K1: the first entry kept as it is: where the keep-th last round opens; the entry count if there is none. rounds: session_id, user_ix."""
    total = entries.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("entries"))
    last = rounds.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("user_ix")))).filter(F.col("n") <= keep)
    first = last.groupBy("session_id").agg(F.min("user_ix").alias("first"))
    return total.join(first, "session_id", "left").select("session_id", F.coalesce("first", "entries").alias("preserved_from"))


def selector(text: str, column: Column | None = None) -> Column:
    """K2: tool:<glob> or type:<glob> as a condition over tool_name or type, or another column; anchored, case counts."""
    kind, _, glob = text.partition(":")
    if kind not in ("tool", "type") or not glob:
        raise ValueError(f"not a selector: {text!r}; use tool:<glob> or type:<glob>")
    pattern = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c != "_" else c for c in glob)
    return F.coalesce(F.rlike(F.col("tool_name" if kind == "tool" else "type") if column is None else column, F.lit(f"^{pattern}$")), F.lit(False))


def text_xml(text: Column, ix: Column, most: int = TEXT_BYTES, preview: int = FIELD_PREVIEW) -> Column:
    """A text as XML, whole up to `most` bytes, else its size, its place and how it starts."""
    start = F.concat(xml_text(F.substring(text, 1, preview)), F.lit("…")) if preview else F.lit("")
    big = F.concat(F.lit('<truncated_text bytes="'), F.octet_length(text).cast("string"), F.lit('" ix="'), ix.cast("string"), F.lit('">'), start, F.lit("</truncated_text>"))
    return F.when(F.octet_length(text) > most, big).otherwise(xml_text(text))


def chosen(selectors: tuple[str, ...], kind: str, column: Column | None = None) -> Column:
    """Whether any selector of that kind (tool or type) names the row."""
    found = F.lit(False)
    for one in selectors:
        if one.startswith(kind + ":"):
            found = found | selector(one, column)
    return found


def with_fields(blocks: DataFrame, most: int = FIELD_BYTES, preview: int = FIELD_PREVIEW, selectors: tuple[str, ...] = ()) -> DataFrame:
    """K4-K6: calls with `fields`, what is kept of their input, in order: name, value, and bytes where the value was cut.

    Nested values of MultiEdit and of tools without a list of their own have their
    long strings swept; preserved and selected tools keep all fields whole.
    """
    calls = blocks.filter("type = 'tool_use'")
    swept = F.explode(F.array(sweep(F.col("input"), most, preview)))  # from an array of one, so that it is swept once
    calls = calls.withColumn("swept_json", swept).withColumns({"given": F.from_json("input", "map<string,string>"), "kinds": F.from_json("input", "map<string,variant>"), "swept": F.from_json("swept_json", "map<string,string>")})
    kind = lambda key: F.schema_of_variant(F.col("kinds")[key])

    def item(name: Column, cuts: Column | bool, sweeps: bool) -> Column:
        value, cuts = F.col("given")[name], cuts if isinstance(cuts, Column) else F.lit(cuts)
        size, long = F.octet_length(value), cuts & (kind(name) == "STRING") & (F.octet_length(value) > most)
        nested = kind(name).rlike("^(ARRAY|OBJECT)") if sweeps else F.lit(False)
        shown = F.when(long, F.substring(value, 1, preview)).when(F.coalesce(nested, F.lit(False)), F.col("swept")[name]).otherwise(value)
        return F.struct(name.alias("name"), shown.alias("value"), F.when(long, size).alias("bytes"))

    keys = F.map_keys("given")
    whole = F.transform(keys, lambda k: item(k, False, False))
    fields = F.when(F.col("tool_name").isin(*TASK_TOOLS) | chosen(selectors, "tool"), whole)
    for tools, rule in TOOL_FIELDS.items():
        kept, _, cut = rule.partition("|")
        cut, _, after = cut.partition(":")
        listed = [(x, False) for x in kept.split()] + [(x, True) for x in cut.split()] + [(x, False) for x in after.split()]
        own = F.filter(F.array(*[item(F.lit(x), c, tools == ("MultiEdit",)) for x, c in listed]), lambda f: F.map_contains_key("given", f["name"]))
        fields = fields.when(F.col("tool_name").isin(*tools), own)
    fields = fields.otherwise(F.transform(keys, lambda k: item(k, F.lit(True), True)))
    return calls.withColumn("fields", F.coalesce(fields, F.array())).drop("given", "kinds", "swept", "swept_json")


def tool_fields(blocks: DataFrame, most: int = FIELD_BYTES, preview: int = FIELD_PREVIEW) -> DataFrame:
    """K4-K6, a row a field: name, value, and bytes where the value was cut."""
    return with_fields(blocks, most, preview).select("session_id", "ix", "block_ix", F.posexplode("fields").alias("n", "f")).select("session_id", "ix", "block_ix", "n", "f.*")


def field_xml(f: Column) -> Column:
    """K7: a field as an element; a cut one with its size, a null one empty."""
    tag = F.regexp_replace(f["name"], r"[^A-Za-z0-9_.-]", "_")
    tag = F.when(tag == "", "field").when(tag.rlike("^[0-9-]"), F.concat(F.lit("_"), tag)).otherwise(tag)
    cut = F.concat(F.lit("<"), tag, F.lit(' truncated="'), f["bytes"].cast("string"), F.lit('">'), F.when(f["value"] == "", "").otherwise(F.concat(xml_text(f["value"]), F.lit("…"))), F.lit("</"), tag, F.lit(">"))
    whole = F.concat(F.lit("<"), tag, F.lit(">"), xml_text(f["value"]), F.lit("</"), tag, F.lit(">"))
    return F.when(f["bytes"].isNotNull(), cut).when(f["value"].isNull(), F.concat(F.lit("<"), tag, F.lit("/>"))).otherwise(whole)


def tool_use_xml(blocks: DataFrame, most: int = FIELD_BYTES, preview: int = FIELD_PREVIEW, selectors: tuple[str, ...] = ()) -> DataFrame:
    """K7: each call as XML with the fields that K4 keeps; how many were cut, and about how many bytes that saves."""
    calls = with_fields(blocks, most, preview, selectors)
    head = F.concat(F.lit('<tool_use name="'), xml_attr(F.col("tool_name")), F.lit('" ix="'), F.col("ix").cast("string"), F.lit('"'))
    xml = F.when(F.size("fields") == 0, F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), F.array_join(F.transform("fields", field_xml), "\n"), F.lit("\n</tool_use>")))
    cut = F.filter("fields", lambda f: f["bytes"].isNotNull())
    # A tag around a cut field counts as 32 bytes.
    saved = F.aggregate(cut, F.lit(0).cast("long"), lambda a, f: a + F.greatest(F.lit(0), f["bytes"] - F.length(f["value"]) - 32))
    user = chosen(selectors, "tool")
    return calls.select("session_id", "ix", "block_ix", xml.alias("xml"), F.when(user, 0).otherwise(F.size(cut)).alias("truncated"), F.when(user, 0).otherwise(F.least(saved, F.octet_length("input"))).cast("long").alias("saved"), user.alias("user_tool"))


def classify(blocks: DataFrame, preserve: tuple[str, ...] = TASK_TOOLS) -> DataFrame:
    """K3, by blocks: entries that hold a preserved call or its result, and whether other calls, results or a person's text are mixed in."""
    names = tool_use_index(blocks).select("session_id", F.col("tool_id").alias("tool_use_id"), F.col("tool_name").alias("called"))
    each = blocks.join(names, ["session_id", "tool_use_id"], "left")
    name = F.when(F.col("type") == "tool_use", F.col("tool_name")).when(F.col("type") == "tool_result", F.col("called"))
    kept = F.coalesce(name.isin(*preserve), F.lit(False))
    flags = each.groupBy("session_id", "ix").agg(
        F.bool_or(kept).alias("preserved"), F.bool_or(F.col("type").isin("tool_use", "tool_result") & ~kept).alias("other"), F.bool_or(F.col("type") == "text").alias("texts"), F.bool_or(F.col("type") == "tool_result").alias("answers")
    )
    return flags.select("session_id", "ix", "preserved", (F.col("preserved") & (F.col("other") | (F.col("texts") & F.col("answers")))).alias("mixed"))


#: Entries that a compacted log has no use for.
DROPPED = ("file-history-snapshot",)


def classes(entries: DataFrame, blocks: DataFrame, start: DataFrame, selectors: tuple[str, ...] = ()) -> DataFrame:
    """K3: the class of every entry, and whether it is mixed: tail (kept from preserved_from on), user_type (a selector names its type), dropped, preserved (task calls and results), bundled, skipped."""
    own = entries.join(start, "session_id").join(classify(blocks), ["session_id", "ix"], "left")
    kind = F.col("type")
    name = F.when(F.col("ix") >= F.col("preserved_from"), "tail").when(chosen(selectors, "type", kind), "user_type").when(kind.isin(*DROPPED), "dropped").when(F.coalesce("preserved", F.lit(False)), "preserved")
    name = name.when(kind.isin("user", "assistant"), "bundled").otherwise("skipped")
    return own.select("session_id", "ix", "type", name.alias("class"), (F.coalesce("mixed", F.lit(False)) & (name == "preserved")).alias("mixed"))


def bundle(entries: DataFrame, start: DataFrame) -> DataFrame:
    """K11-K13 for plain texts: a row an entry with its section: 0 bundled, 1 passed through, 2 preserved; and its XML if bundled."""
    placed = entries.join(start, "session_id")
    section = F.when(F.col("ix") >= F.col("preserved_from"), 2).when(F.col("type").isin("user", "assistant"), 0).otherwise(1)
    body = F.when(F.col("content_text") == "", "(empty)").otherwise(text_xml(F.col("content_text"), F.col("ix")))
    return placed.withColumn("section", section).select("session_id", "section", "ix", "type", F.when(F.col("section") == 0, turn_xml(F.col("ix"), F.col("type"), body)).otherwise(F.col("content_text")).alias("body"))


def turn_xml(ix: Column, kind: Column, body: Column) -> Column:
    return F.concat(F.lit('<turn ix="'), ix.cast("string"), F.lit('" kind="'), kind, F.lit('">\n'), body, F.lit("\n</turn>"))


def turns(parts: DataFrame, classed: DataFrame) -> DataFrame:
    """The bundled turns: session_id, ix, body. parts: session_id, ix, block_ix, answer (whether of a result), xml. Texts of a user's turn stand before its results."""
    own = classed.filter("class = 'bundled'").select("session_id", "ix", "type").join(parts, ["session_id", "ix"], "left")
    order = F.when(F.col("type") == "user", F.col("answer")).otherwise(F.lit(False))
    each = own.groupBy("session_id", "ix", "type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("xml").isNotNull(), F.struct(order.alias("late"), "block_ix", "xml")))), lambda x: x["xml"]), "\n").alias("body"),
        F.bool_and("answer").alias("answers"), F.count("xml").alias("n"),
    )
    kind = F.when((F.col("type") == "user") & F.coalesce("answers", F.lit(False)), "tool_result").otherwise(F.col("type"))
    return each.select("session_id", "ix", turn_xml(F.col("ix"), kind, F.when((F.col("n") == 0) & (F.col("type") == "assistant"), "(empty)").otherwise(F.col("body"))).alias("body"))


def preamble(keep: int, selectors: tuple[str, ...] = (), command: str = "show") -> Column:
    """What a bundle says of itself, over session_id, preserved_from, entries, tasks (whether any entry passes through), user_tools and user_types."""
    text = lambda c: F.col(c).cast("string")
    from_, last = text("preserved_from"), (F.col("entries") - 1).cast("string")
    condensed = F.concat(
        F.lit("Entries 0–"), (F.col("preserved_from") - 1).cast("string"), F.lit(" are condensed in <turns> below, one <turn> an entry; the command `"), F.lit(command + " "), "session_id",
        F.lit(" N` gives entry N as it was.\nA field with truncated=\"bytes\" holds only its start and how many bytes it had.\n"),
    )
    names = "".join(f"  - {s}\n" for s in selectors)
    selected = F.concat(F.lit(f"Kept whole, as selected:\n{names}"), text("user_tools"), F.lit(" calls and results, "), text("user_types"), F.lit(" entries.\n"))
    kept = F.concat(F.lit("Entries "), from_, F.lit("–"), last, F.lit(f" follow at the end as they were: the last {keep} round{'' if keep == 1 else 's'}.\n"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<compacted>\nThis session goes on from "), "session_id", F.lit(".\n")),
        F.when(F.col("preserved_from") > 0, condensed),
        F.when(F.col("tasks"), F.lit("Calls that manage tasks follow as entries of their own, as they were.\n")),
        *([selected] if selectors else []),
        F.when(F.col("preserved_from") < F.col("entries"), kept),
        F.lit("Turns are summaries: don't guess what they leave out, look it up.\n</compacted>\n"),
    )


def bundle_text(bundled: DataFrame) -> DataFrame:
    """The bundled turns of a session as one text."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "body"))), lambda x: x["body"]), "\n")
    rows = bundled.filter("section = 0") if "section" in bundled.columns else bundled
    return rows.groupBy("session_id").agg(F.concat(F.lit("<turns>\n"), each, F.lit("\n</turns>")).alias("text"), F.count(F.lit(1)).alias("turns"))


def new_id(*parts: Column) -> Column:
    """An id like a random one, yet the same in every attempt."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    at = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("4"), at(14, 3)), F.concat(F.lit("a"), at(18, 3)), at(21, 12))


def chain(emitted: DataFrame) -> DataFrame:
    """New ids, each entry's parent being the entry before it that has one. emitted: session_id, section, ix, uuid."""
    order = Window.partitionBy("session_id").orderBy("section", "ix").rowsBetween(Window.unboundedPreceding, -1)
    own = emitted.withColumn("new_uuid", F.when(F.col("uuid").isNotNull(), new_id(F.col("session_id"), F.col("section").cast("string"), F.col("ix").cast("string"))))
    return own.withColumn("new_parent_uuid", F.last("new_uuid", ignorenulls=True).over(order))


def rewrite(chained: DataFrame) -> DataFrame:
    """The JSON of emitted entries with their new ids, those that route requests too."""
    own = lambda name: F.substring(F.replace(new_id(F.col("session_id"), F.col("section").cast("string"), F.col("ix").cast("string"), F.lit(name)), F.lit("-")), 1, 22)
    prompt = new_id(F.col("session_id"), F.col("section").cast("string"), F.col("ix").cast("string"), F.lit("prompt"))
    ids = {"uuid": F.col("new_uuid"), "parentUuid": F.col("new_parent_uuid"), "sessionId": F.col("new_session_id"), "promptId": prompt, "requestId": F.concat(F.lit("req_"), own("request")), "message.id": F.concat(F.lit("msg_"), own("message"))}
    return chained.withColumn("raw", with_ids(F.col("raw"), F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), v)])))


def fresh_sessions(sessions: DataFrame, known: DataFrame, salts: int = 4) -> DataFrame:
    """A new id for each session that no known session has: the first of some salted hashes that is free; an error where none is."""
    each = sessions.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).withColumn("new_session_id", new_id(F.col("session_id"), F.col("salt").cast("string")))
    taken = known.select(F.col("session_id").alias("new_session_id")).distinct().withColumn("taken", F.lit(True))
    free = each.join(taken, "new_session_id", "left").groupBy("session_id").agg(F.min_by("new_session_id", F.when(F.col("taken").isNull(), F.col("salt"))).alias("new_session_id"), F.count_if(F.col("taken").isNull()).alias("free"))
    none = F.raise_error(F.concat(F.lit("no free id for session "), "session_id"))
    return free.select("session_id", F.when(F.col("free") > 0, F.col("new_session_id")).otherwise(none).alias("new_session_id"))


def compact_stats(classed: DataFrame, parts: DataFrame, dropped: DataFrame) -> DataFrame:
    """Entries of each class, results told in a line, fields and texts cut, and bytes saved.

    parts: session_id, ix, stubbed, truncated, saved, user_tool of every part of the
    bundled turns. dropped: session_id, ix, raw of dropped entries.
    """
    own = lambda name: F.count_if(F.col("class") == name)
    counts = classed.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("source"), own("tail").alias("preserved"), own("dropped").alias("dropped"), own("bundled").alias("bundled"), F.count_if("mixed").alias("mixed"), own("user_type").alias("user_types"), own("preserved").alias("passed")
    )
    bundled = parts.join(classed.filter("class = 'bundled'").select("session_id", "ix"), ["session_id", "ix"], "left_semi")
    made = bundled.groupBy("session_id").agg(F.sum("stubbed").alias("stubbed"), F.sum("truncated").alias("truncated"), F.count_if("user_tool").alias("user_tools"), F.sum("saved").alias("saved"))
    gone = dropped.groupBy("session_id").agg(F.sum(F.octet_length("raw").cast("long")).alias("gone"))
    out = counts.join(made, "session_id", "left").join(gone, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("session_id", "source", "preserved", "dropped", "bundled", "mixed", "passed", zero("stubbed").alias("stubbed"), zero("truncated").alias("truncated"), zero("user_tools").alias("user_tools"), "user_types", (zero("saved") + zero("gone")).alias("bytes_saved"))
