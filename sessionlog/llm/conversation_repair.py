r"""Repair of conversations whose turns were lost, doubled, emptied, cut or given to the wrong role.

The cheapest edits that make the roles read `(s?(ua)+)?` are a shortest path through
four states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3
may end. From each state only one role may be inserted or reroled to, so a state and
an edit give the next state, and a path is its audit string.

Hirschberg's divide and conquer finds the path. Costs of the four states run forward
to the middle and backward from the end; the middle is crossed at the state of the
least sum. Each forward vector also carries the order of its states' audits: no
audit of a state is the beginning of another's (each ends with the edit of the
same row), so of crossings that cost the same that order picks the least audit of
all. Both halves are then solved alike, in space that is linear in the rows.

Conversations may be of any length. Rows are sorted by range, not by conversation,
so a long one lies in many partitions, each cut into segments of SEGMENT_ROWS.
A segment is a 4 x 4 table of costs and orders; these compose, first to one table a
partition, then over partitions, which gives the crossing states at every segment's
ends; each segment is then solved for itself. Conversations of one segment skip this.
Only one thing is sequential by definition: the SHA-256 of a whole repaired
conversation, which a sorted stream feeds row by row, in bounded memory. A
conversation's audit is one cell, as the contract wants, a byte an edit.

Damage for tests and evaluation is done by `damaged`.

Defined cases: null conv_id is a conversation of its own; null turns come first and
count for no gap; null role or text is one space, so such a role fits no state and
the row is reroled or deleted, and such a text is blank; rows of equal turn are in
the order of role, first 64 characters of text, SHA-256 of text; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

SEGMENT_ROWS = 4096
INF = float("inf")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The role that follows a state when it is inserted or reroled to, and the state then.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: The state after keeping a role's initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Cost and edits from each state to the end, after the last row.
END = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
#: A row is one letter: of s, u, a or o (another role); capital when truncated, a digit when it must be deleted.
DELETED = dict(zip("1234", "suao", strict=True))
#: A state that costs this much more than another lies on no cheapest path: from any state the rest costs at most 10 more than from any other.
SLACK = 10


def _role(letter: str) -> str:
    return DELETED.get(letter) or letter.lower()


@lru_cache(maxsize=None)
def edits(state: int, letter: str) -> tuple[tuple[int, str, int], ...]:
    """Every (cost, edits, next state) for a row: at most one insertion, then the row's own edit."""
    out = []
    for before, cost, s in (("", 0, state), ("I", INSERT, NEXT[state][1])):
        out.append((cost + DELETE, before + "D", s))
        if letter not in DELETED:
            extra = cost + (TRUNCATED if letter.isupper() else 0)
            if (s, _role(letter)) in KEPT:
                out.append((extra + KEEP, before + "K", KEPT[s, _role(letter)]))
            out.append((extra + REROLE, before + "R", NEXT[s][1]))
    return tuple(out)


Vector = tuple[tuple[float, ...], tuple[int, ...]]


def entering(state: int) -> Vector:
    return tuple(0.0 if s == state else INF for s in range(4)), (0, 0, 0, 0)


def _ranked(best: dict[int, tuple[float, int, object]]) -> tuple[float, Vector]:
    """The least cost, and costs above it with the order of the audits."""
    least = min(v[0] for v in best.values())
    best = {s: v for s, v in best.items() if v[0] - least <= SLACK}
    order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:]))}
    return least, (tuple(best[s][0] - least if s in best else INF for s in range(4)), tuple(order.get(s, 0) for s in range(4)))


@lru_cache(maxsize=65_536)
def _forward(vector: Vector, letter: str) -> tuple[float, Vector]:
    costs, ranks = vector
    best: dict[int, tuple[float, int, object]] = {}
    for s in range(4):
        if costs[s] < INF:
            for cost, text, after in edits(s, letter):
                option = (costs[s] + cost, ranks[s], text)
                if after not in best or option < best[after]:
                    best[after] = option
    return _ranked(best)


@lru_cache(maxsize=65_536)
def _backward(costs: tuple[float, ...], letter: str) -> tuple[float, tuple[float, ...]]:
    out = [min(cost + costs[after] for cost, _, after in edits(s, letter)) for s in range(4)]
    least = min(out)
    return least, tuple(c - least for c in out)


def forward(letters: str, vector: Vector) -> tuple[float, Vector]:
    total = 0.0
    for letter in letters:
        least, vector = _forward(vector, letter)
        total += least
    return total, vector


def backward(letters: str, costs: tuple[float, ...]) -> tuple[float, tuple[float, ...]]:
    total = 0.0
    for letter in reversed(letters):
        least, costs = _backward(costs, letter)
        total += least
    return total, costs


def crossing(vector: Vector, costs: tuple[float, ...]) -> int:
    """The state of the least sum; of equal ones, that with the least audit so far."""
    return min((vector[0][s] + costs[s], vector[1][s], s) for s in range(4) if vector[0][s] + costs[s] < INF)[2]


def solve(letters: str, enter: int, leave: int) -> str:
    """The audit of the cheapest edits from one state to another, the least of them."""
    if not letters:
        return ""
    if len(letters) == 1:
        return min((cost, text) for cost, text, after in edits(enter, letters) if after == leave)[1]
    half = len(letters) // 2
    middle = crossing(forward(letters[:half], entering(enter))[1], backward(letters[half:], tuple(0.0 if s == leave else INF for s in range(4)))[1])
    return solve(letters[:half], enter, middle) + solve(letters[half:], middle, leave)


ENDS = tuple(float(END[s][0]) for s in range(4))


def table(letters: str) -> tuple[list[float], list[int]]:
    """Costs and orders from each state to each, 16 of both."""
    costs, ranks = [], []
    for s in range(4):
        total, (c, r) = forward(letters, entering(s))
        costs += [total + x for x in c]
        ranks += r
    return costs, ranks


def through(vector: Vector, costs: list[float], ranks: list[int]) -> tuple[float, Vector]:
    """A forward vector after a table."""
    best: dict[int, tuple[float, int, object]] = {}
    for s, after in itertools.product(range(4), range(4)):
        if (c := vector[0][s] + costs[4 * s + after]) < INF:
            option = (c, vector[1][s], ranks[4 * s + after])
            if after not in best or option < best[after]:
                best[after] = option
    return _ranked(best)


def before(costs: list[float], ends: tuple[float, ...]) -> tuple[float, ...]:
    """A backward vector before a table."""
    out = [min(costs[4 * s + after] + ends[after] for after in range(4)) for s in range(4)]
    least = min(out)
    return tuple(c - least for c in out)


def crossings(tables: list[tuple[list[float], list[int]]], enter: int, ends: tuple[float, ...]) -> list[int]:
    """The state after each of a row of tables, on the cheapest path of the least audit."""
    back = [ends]
    for costs, _ in reversed(tables[1:]):
        back.append(before(costs, back[-1]))
    vector, out = entering(enter), []
    for (costs, ranks), end in zip(tables, reversed(back), strict=True):
        vector = through(vector, costs, ranks)[1]
        out.append(crossing(vector, end))
    return out


def composed(tables: list[tuple[list[float], list[int]]]) -> tuple[list[float], list[int]]:
    costs, ranks = [], []
    for s in range(4):
        total, vector = 0.0, entering(s)
        for t in tables:
            least, vector = through(vector, *t)
            total += least
        costs += [total + x for x in vector[0]]
        ranks += vector[1]
    return costs, ranks


def plan(audit: str, letters: str, enter: int) -> tuple[list[str], list[str | None], str]:
    """For each row the lines inserted before it and its role ("" its own, else a new one, None for deleted); and the lines after the last."""
    above: list[str] = []
    roles: list[str | None] = []
    lines, state = "", enter
    for edit in audit:
        if edit == "I":
            role, state = NEXT[state]
            lines += f"{role}:\n"
            continue
        if edit == "D":
            roles.append(None)
        elif edit == "R":
            role, state = NEXT[state]
            roles.append(role)
        else:
            state = KEPT[state, _role(letters[len(roles)])]
            roles.append("")
        above.append(lines)
        lines = ""
    return above, roles, lines


def cost_of(audit: str, letters: str) -> int:
    kept = (letter for edit, letter in zip(audit.replace("I", ""), letters, strict=True) if edit != "D")
    return REROLE * audit.count("R") + DELETE * audit.count("D") + INSERT * audit.count("I") + TRUNCATED * sum(x.isupper() for x in kept)


LEGAL = {"su", "ua", "au"}

def _table_of(letters: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([table(x) for x in letters], columns=["costs", "ranks"])


def _solved(letters: str, enter: float, leave: float, last: bool | None) -> tuple:
    """A segment between its crossing states; a whole conversation has none of them."""
    start = 0 if pd.isna(enter) else int(enter)
    end = crossing(forward(letters, entering(start))[1], ENDS) if pd.isna(leave) else int(leave)
    audit = solve(letters, start, end)
    cost = cost_of(audit, letters)
    if last is None or last:
        audit, cost = audit + END[end][1], cost + END[end][0]
    above, roles, tail = plan(audit, letters, start)
    own = "".join(map(_role, letters))
    return audit, cost, sum(a + b not in LEGAL for a, b in itertools.pairwise(own)), above, roles, tail


def _solution(letters: pd.Series, enter: pd.Series, leave: pd.Series, last: pd.Series) -> pd.DataFrame:
    rows = [_solved(*row) for row in zip(letters, enter, leave, last, strict=True)]
    return pd.DataFrame(rows, columns=["audit", "cost", "illegal", "above", "roles", "tail"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults planted by a hash of conversation and turn; a null role or text becomes one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"), (F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.filter("h <> 0").withColumn("text", text).withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def placed(rows: DataFrame) -> DataFrame:
    """The rows, stored, each with its place `at` in the order of conversation and turn; the upper bits are its partition.

    Partitions are ranges of that order, whatever conversation they fall in; equal rows may part, for they are interchangeable.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.sha2("text", 256), F.col("given")]
    given = rows.withColumn("given", F.monotonically_increasing_id())
    return cut(given.repartitionByRange(*order).sortWithinPartitions(*order).drop("given").withColumn("at", F.monotonically_increasing_id()))


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, at, fault, letter): the first fault of each placed row (blank, duplicate, truncated or null) and its letter."""
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv_id", "at", (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("open"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("kind"),
    )
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    letter = F.when(F.col("fault").isNull(), F.col("kind")).when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.translate("kind", "suao", "1234"))
    return narrow.join(first, "at", "left").withColumn("fault", fault).select("conv_id", "at", "fault", letter.alias("letter"))


def segments(faults: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, part, first_at, letters, ats): the rows of a conversation that lie in one run of segment_rows places."""
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    keyed = faults.withColumn("part", F.shiftright("at", 33)).withColumn("segment", F.floor(place / segment_rows))
    found = keyed.groupBy("conv_id", "part", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("rows"))  # segment_rows at most
    return found.select("conv_id", "part", F.col("rows")[0]["at"].alias("first_at"), F.array_join(F.col("rows.letter"), "").alias("letters"), F.col("rows.at").alias("ats"))


def _tables(group: pd.DataFrame) -> list[tuple[list[float], list[int]]]:
    return [(list(c), list(r)) for c, r in zip(group["costs"], group["ranks"], strict=True)]


def _compose(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first_at")
    costs, ranks = composed(_tables(group))
    return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "part": group["part"].iloc[:1], "costs": [costs], "ranks": [ranks]})


def _cross_parts(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    leave = crossings(_tables(group), 0, ENDS)
    return pd.DataFrame({"conv_id": group["conv_id"], "part": group["part"], "p_enter": [0, *leave[:-1]], "p_leave": leave, "p_last": [False] * (len(leave) - 1) + [True]})


def _cross_segments(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first_at")
    enter, leave, last = int(group["p_enter"].iloc[0]), int(group["p_leave"].iloc[0]), bool(group["p_last"].iloc[0])
    out = crossings(_tables(group), enter, tuple(0.0 if s == leave else INF for s in range(4)))
    return pd.DataFrame({"first_at": group["first_at"], "enter": [enter, *out[:-1]], "leave": out, "last": [False] * (len(out) - 1) + [last]})


def crossing_states(long: DataFrame) -> DataFrame:
    """(first_at, enter, leave, last) for every segment of conversations that have several. A group holds a partition's segments, or a conversation's partitions."""
    table_of = F.pandas_udf(_table_of, "costs array<double>, ranks array<int>")
    tables = cut(long.select("conv_id", "part", "first_at", table_of("letters").alias("t")).select("conv_id", "part", "first_at", "t.*"))
    kind = long.schema["conv_id"].dataType.simpleString()
    parts = tables.groupBy("conv_id", "part").applyInPandas(_compose, f"conv_id {kind}, part long, costs array<double>, ranks array<int>")
    ends = parts.groupBy("conv_id").applyInPandas(_cross_parts, f"conv_id {kind}, part long, p_enter int, p_leave int, p_last boolean")
    ends = ends.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")
    both = tables.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    return both.groupBy("conv_id", "part").applyInPandas(_cross_segments, "first_at long, enter int, leave int, last boolean")


def seams(long: DataFrame) -> DataFrame:
    """(conv_id, illegal): neighbours over the ends of segments whose roles may not follow one another, one row a seam."""
    own = lambda c: F.lower(F.translate(c, "1234", "suao"))
    rows = long.select("conv_id", "part", "first_at", own(F.substring("letters", 1, 1)).alias("head"), own(F.substring("letters", -1, 1)).alias("foot"))
    inner = rows.withColumn("pair", F.concat(F.lag("foot").over(Window.partitionBy("conv_id", "part").orderBy("first_at")), "head"))
    outer = rows.groupBy("conv_id", "part").agg(F.min_by("head", "first_at").alias("head"), F.max_by("foot", "first_at").alias("foot"))
    outer = outer.withColumn("pair", F.concat(F.lag("foot").over(Window.partitionBy("conv_id").orderBy("part")), "head"))
    both = inner.select("conv_id", "pair").unionByName(outer.select("conv_id", "pair")).filter("pair IS NOT NULL")
    return both.select("conv_id", (~F.col("pair").isin(*LEGAL)).cast("long").alias("illegal"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired lines, from a stream in order."""
    key, digest, begun, kind = None, None, False, pa.int64()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "kind", "above", "role", "text")]
        for conv, step, above, role, text in zip(*columns, strict=True):
            if digest is None or conv != key:
                if digest is not None:
                    yield done()
                key, digest, begun, new_role = conv, hashlib.sha256(), False, None
            if step != 1:  # what is inserted, and what becomes of the row that follows
                for line in (above or "").split("\n")[:-1]:
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
                new_role = role
            elif new_role is not None:
                digest.update((b"\n" if begun else b"") + f"{new_role or role}:".encode() + text.encode())
                begun = True
    if digest is not None:
        yield done()


def repaired(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """conversations: conv_id, turn, role, text, neither role nor text null. Faults and the cheapest repair of each conversation."""
    rows = placed(conversations)
    faults = cut(faulted(rows))
    cuts = cut(segments(faults, segment_rows))
    several = cuts.groupBy(F.col("conv_id").alias("c")).count().filter("count > 1").select("c")
    long = cuts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    solution = F.pandas_udf(_solution, "audit string, cost long, illegal long, above array<string>, roles array<string>, tail string")
    solved = cuts.join(crossing_states(long), "first_at", "left").withColumn("s", solution("letters", "enter", "leave", "last"))
    solved = cut(solved.select("conv_id", "first_at", "ats", "s.*"))

    steps = solved.select("conv_id", F.explode(F.arrays_zip("ats", "above", "roles")).alias("e")).select("conv_id", F.col("e.ats").alias("at"), F.lit(0).alias("kind"), F.col("e.above").alias("above"), F.col("e.roles").alias("role"), F.lit("").alias("text"))
    tails = solved.filter("tail <> ''").select("conv_id", F.element_at("ats", -1).alias("at"), F.lit(2).alias("kind"), F.col("tail").alias("above"), F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    lines = rows.select("conv_id", "at", F.lit(1).alias("kind"), F.lit("").alias("above"), "role", "text").unionByName(steps).unionByName(tails)
    kind = rows.schema["conv_id"].dataType.simpleString()
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")

    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    audits = solved.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "audit"))), lambda x: x["audit"]), "").alias("audit"),  # one string a segment
        F.sum("cost").alias("cost"),
    )
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long")).alias(fault)
    counts = faults.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"))
    illegal = solved.select("conv_id", "illegal").unionByName(seams(long)).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    out = hashes
    for part in (turns, audits, counts, illegal):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in NUMBERS + ["audit", "repaired_sha256"]))


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op11(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """op11's contract: conversations are damaged, then repaired; every original conv_id has a row."""
    every = conversations.select("conv_id").distinct()
    found = every.unionByName(repaired(damaged(conversations), segment_rows), allowMissingColumns=True)
    best: list[Column] = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in NUMBERS]
    nothing = hashlib.sha256(b"").hexdigest()
    best += [F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256")]
    return found.groupBy("conv_id").agg(*best)


ORACLE = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(regexp_extract_all(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '.'), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), sha256(text), copy) AS n,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
  coalesce(lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substring(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS odd, max(n) OVER (PARTITION BY conv_id) AS size FROM n),
e(s, edit, initial, cost, t, line) AS (VALUES (0, 'D', '', 4, 0, ''), (1, 'D', '', 4, 1, ''), (2, 'D', '', 4, 2, ''), (3, 'D', '', 4, 3, ''),
  (0, 'K', 's', 0, 1, ''), (0, 'K', 'u', 0, 2, ''), (1, 'K', 'u', 0, 2, ''), (3, 'K', 'u', 0, 2, ''), (2, 'K', 'a', 0, 3, ''),
  (0, 'R', '', 3, 2, 'user'), (1, 'R', '', 3, 2, 'user'), (3, 'R', '', 3, 2, 'user'), (2, 'R', '', 3, 3, 'assistant'),
  (0, 'I', '', 3, 2, 'user'), (1, 'I', '', 3, 2, 'user'), (3, 'I', '', 3, 2, 'user'), (2, 'I', '', 3, 3, 'assistant')),
o AS (SELECT s, edit AS edits, initial, cost, t, NULL::VARCHAR AS above, line FROM e WHERE edit <> 'I' UNION ALL
  SELECT i.s, 'I' || x.edit, x.initial, i.cost + x.cost, x.t, i.line, x.line FROM e i JOIN e x ON x.s = i.t WHERE i.edit = 'I' AND x.edit <> 'I'),
p AS (SELECT conv_id, 0::BIGINT AS n, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT p.conv_id, f.n, o.t, p.cost + o.cost + CASE WHEN f.fault = 'truncated' AND right(o.edits, 1) <> 'D' THEN 3 ELSE 0 END, p.audit || o.edits,
    p.lines || CASE WHEN o.above IS NULL THEN [] ELSE [o.above || ':'] END
      || CASE right(o.edits, 1) WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [o.line || ':' || f.text] END
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1 JOIN o ON o.s = p.s AND (o.initial = '' OR o.initial = substring(f.role, 1, 1))
  WHERE coalesce(f.fault, '') NOT IN ('blank', 'duplicate') OR right(o.edits, 1) = 'D'
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, o.t ORDER BY p.cost + o.cost + CASE WHEN f.fault = 'truncated' AND right(o.edits, 1) <> 'D' THEN 3 ELSE 0 END, p.audit || o.edits) = 1),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, max(size) AS size FROM f GROUP BY conv_id),
z(s, cost, edits, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', [])),
best AS (SELECT p.conv_id, p.cost + z.cost AS cost, p.audit || z.edits AS audit, p.lines || z.lines AS lines FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.size = p.n JOIN z USING (s)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + z.cost, p.audit || z.edits) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
