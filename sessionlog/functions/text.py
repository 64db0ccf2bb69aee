"""Column functions over text: trims, sizes, previews, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags whose bodies a harness, not a person, writes.
WRAPPER_TAGS = ("local-command-caveat", "command-name", "command-message", "command-args", "command-stdout", "system-reminder", "local-command-stdout")
#: Fixed value: the line that a commit command reports.
COMMIT_LINE = r"(?m)^\[\S+\s+([a-f0-9]{7,40})(?:\s*\([^)]+\))?\]\s*(.*?)$"


def trim_all(x: Column) -> Column:
    """Trim every Unicode blank and line end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def est_tokens(chars: Column) -> Column:
    """A quarter of the characters, rounded half up."""
    return F.round(chars / 4).cast("long")


def shorten(x: Column, most: int) -> Column:
    """Line ends as a visible sign; beyond `most` characters, one less and an ellipsis."""
    flat = F.replace(x, F.lit("\n"), F.lit(" ⏎ "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def short_path(x: Column) -> Column:
    """A path without its leading home or project folder."""
    return F.regexp_replace(x, r"^/(?:root|home|tmp|Users|users)/[^/]+/(?=.)", "")


def wrapper_only(x: Column) -> Column:
    """Whether nothing but harness tags and blanks is left of a human text."""
    tags = "|".join(WRAPPER_TAGS)
    bare = F.regexp_replace(F.regexp_replace(x, rf"(?is)<({tags})>.*?</\1>", ""), r"</?[a-zA-Z-]+>", "")
    return trim_all(bare) == ""


def first_line(x: Column, most: int) -> Column:
    return F.substring(F.substring_index(x, "\n", 1), 1, most)


def json_quote(x: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def xml_safe(x: Column) -> Column:
    """Without the control characters that XML 1.0 has no place for."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")


def xml_text(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(xml_safe(x) if a == "&" else x, F.lit(a), F.lit(b))
    return x


def xml_attr(x: Column) -> Column:
    return F.replace(xml_text(x), F.lit('"'), F.lit("&quot;"))


def stub(x: Column, ref: Column, most: int, preview: int = 500) -> Column:
    """A stub of a text of more than `most` bytes, else null."""
    n = F.octet_length(x)
    return F.when(n > most, F.struct(F.lit(True).alias("truncated"), ref.alias("ref"), n.alias("bytes"), F.round(n / 4).cast("int").alias("tokens_est"), F.substring(x, 1, preview).alias("preview")))


def turn_ref(ix: Column) -> Column:
    """Where an entry's full text is stored: turns/<ix, five digits at least>.json."""
    digits = ix.cast("string")
    return F.concat(F.lit("turns/"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits), F.lit(".json"))


def diff_stat(old: Column, new: Column) -> Column:
    """Lines added and deleted between two texts, without their common head and tail."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    both = F.least(F.size(a), F.size(b))
    same = lambda x, y, n: F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p == q), F.lit(False)), F.lit(0)) - 1, n.cast("long"))
    head = same(a, b, both)
    rest = (both - head).cast("int")
    tail = same(F.reverse(a), F.reverse(b), rest)
    return F.struct((F.size(b) - head - tail).cast("int").alias("added"), (F.size(a) - head - tail).cast("int").alias("deleted"))


def commit_hash(x: Column) -> Column:
    """The first seven digits of the hash in a commit's report, else null."""
    return F.nullif(F.substring(F.regexp_extract(x, COMMIT_LINE, 1), 1, 7), F.lit(""))


def commit_subject(x: Column) -> Column:
    """The subject in a commit's report, else null."""
    return F.when(commit_hash(x).isNotNull(), trim_all(F.regexp_extract(x, COMMIT_LINE, 2)))
