"""The one helper for JSON of unknown depth: walks that keep the order of keys."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _walk(value: Any, change: Callable[[str], Any]) -> Any:
    if isinstance(value, str):
        return change(value)
    if isinstance(value, dict):
        return {k: _walk(v, change) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, change) for v in value]
    return value


def _stub(text: str, ref: str, most: int, preview: int) -> Any:
    n = len(text.encode())
    if n <= most:
        return text
    return {"truncated": True, "ref": ref, "bytes": n, "tokens_est": (n + 2) // 4, "preview": text[:preview]}


#: Keys of an entry that are not part of its payload.
ENTRY_KEYS = ("uuid", "parentUuid", "timestamp", "sessionId", "type", "cwd", "gitBranch", "version", "isSidechain", "userType", "agentId")
_CONDENSED = "struct<json:string,stubbed:boolean,orig:long,inlined:long>"
_SPILLED = re.compile(r"<persisted-output>\nOutput too large \(([^)]*)\)\. Full output saved to: ([^\n]+)\n\nPreview \([^)]*\):\n(.*)", re.DOTALL)


class _Condenser:
    """Condenses one JSON value; stubs tells whether it put in any."""

    def __init__(self, ref: str, most: int, preview: int):
        self.ref, self.most, self.preview, self.stubs = ref, most, preview, False

    def text(self, s: Any) -> Any:
        out = _stub(s, self.ref, self.most, self.preview) if isinstance(s, str) else s
        self.stubs |= out is not s
        return out

    def deep(self, value: Any) -> Any:
        return _walk(value, self.text)

    def result(self, content: Any) -> Any:
        if isinstance(content, str) and (spilled := _SPILLED.match(content)):
            n, self.stubs = len(content.encode()), True
            return {"truncated": True, "ref": "spill/" + spilled[2].rsplit("/", 1)[-1], "bytes": n, "tokens_est": (n + 2) // 4, "preview": spilled[3].removesuffix("\n</persisted-output>")}
        if isinstance(content, list):
            return [self.block(b) for b in content]
        return self.deep(content)

    def block(self, b: Any) -> Any:
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "tool_use":
            given = b.get("input")
            cut = {k: self.text(v) for k, v in given.items()} if isinstance(given, dict) else given
            return {"type": kind, "id": b.get("id"), "name": b.get("name"), "input": cut}
        if kind == "tool_result":
            return {"type": kind, "tool_use_id": b.get("tool_use_id"), "result": self.result(b.get("content"))} | ({"is_error": True} if b.get("is_error") else {})
        if kind in ("text", "thinking"):
            return {"type": kind, kind: self.text(b.get(kind))} | ({"signature": self.text(b["signature"])} if kind == "thinking" and "signature" in b else {})
        if kind == "image":
            source = b.get("source")
            kept = {k: source[k] for k in ("type", "media_type") if k in source} | {"data": self.deep(source.get("data"))} if source else None
            return {"type": kind} | ({"source": kept} if source else {})
        return self.deep(b)


#: JSON that a walk would write as it stands: no blanks, escapes only where they must be, whole numbers or short decimals.
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\["\\nrtbf]|\\u00(?:0[0-7bef]|1[0-9a-f]))*+"'
_SCALAR = rf"(?:{_STRING}|-?[1-9]\d*+(?![.\deE])|0(?![.\deE])|-?(?:0|[1-9]\d{{0,8}})\.(?:\d{{0,3}}[1-9]|0)(?![\deE])|true|false|null)"
#: How deep lists and objects may lie within a block that isn't walked.
_DEPTH = 3


def _listed(one: str, opens: str, closes: str) -> str:
    """Any number of `one` between commas; possessive, so that long lists take no stack."""
    return rf"\{opens}(?:{one}(?:,(?!\{closes})|(?=\{closes})))*+\{closes}"


def _loose(depth: int) -> str:
    """A value, whose objects may repeat a key."""
    if depth == 0:
        return _SCALAR
    one = _loose(depth - 1)
    return f"(?:{_SCALAR}|{_listed(one, '[', ']')}|{_listed(f'{_STRING}:{one}', '{', '}')})"


def _object(depth: int, names: Iterator[int]) -> str:
    """An object in which no key stands twice: a walk would keep the last of them alone."""
    key, one = f"k{next(names)}", _loose(depth - 1)
    again = rf"(?!{one}(?:,{_STRING}:{one})*?,\k<{key}>:)"
    return _listed(f"(?<{key}>{_STRING}):{again}{_value(depth - 1, names)}", "{", "}")


def _value(depth: int, names: Iterator[int]) -> str:
    if depth == 0:
        return _SCALAR
    return f"(?:{_SCALAR}|{_listed(_value(depth - 1, names), '[', ']')}|{_object(depth, names)})"


def _same_after_walk() -> tuple[str, str]:
    """Blocks without a long string that condensing leaves as they are, and contents of results of which that holds."""
    names = count()
    image = rf'\{{"type":"image","source":\{{"type":{_STRING},"media_type":{_STRING},"data":{_STRING}\}}\}}'
    text = rf'\{{"type":"text","text":{_STRING}\}}'
    thinking = rf'\{{"type":"thinking","thinking":{_STRING}(?:,"signature":{_STRING})?\}}'
    call = rf'\{{"type":"tool_use","id":{_STRING},"name":{_STRING},"input":{_object(_DEPTH, names)}\}}'
    other = rf'(?=\{{"type":"(?!(?:text|thinking|tool_use|tool_result|image)")){_object(_DEPTH, names)}'
    return rf"\A(?:{text}|{thinking}|{call}|{image}|{other})\z", rf"(?:{_STRING}|{_listed(f'(?:{text}|{image})', '[', ']')})"


_SAME, _CONTENT = _same_after_walk()
_RESULT = rf'\A\{{(?:"type":"tool_result","tool_use_id":({_STRING})|"tool_use_id":({_STRING}),"type":"tool_result"),"content":({_CONTENT})(?:(,"is_error":true)|,"is_error":false)?\}}\z'
#: Longer blocks are walked whatever the cap is, so patterns stay cheap.
_PATTERN_BYTES = 4096


def unwalked(block: Column, most: int) -> Column:
    """C2-C4 by built-in functions: a block's condensed JSON where it can hold neither a string over `most` bytes nor a note of a spill and is written as a walk would write it; else null."""
    small = (F.octet_length(block) <= min(most, _PATTERN_BYTES)) & ~F.contains(block, F.lit("<persisted-output>"))
    result = F.regexp_replace(block, F.lit(_RESULT), F.lit('{"type":"tool_result","tool_use_id":$1$2,"result":$3$4}'))
    return F.when(small, F.when(F.contains(block, F.lit('"type":"tool_result"')) & F.rlike(block, F.lit(_RESULT)), result).when(F.rlike(block, F.lit(_SAME)), block))


def condensed(value: Column, ref: Column, most: int, whole_entry: bool = False, preview: int = 500) -> Column:
    """A content block, or an entry's payload, as condensed JSON: json, whether it holds a stub, bytes before and after; nulls of null."""

    @F.pandas_udf(_CONDENSED)
    def cut(values: pd.Series, refs: pd.Series) -> pd.DataFrame:
        out = []
        for text, where in zip(values, refs, strict=True):
            if text is None:
                out.append((None, None, None, None))
                continue
            given, c = json.loads(text), _Condenser(where, most, preview)
            if whole_entry:
                given = {k: v for k, v in given.items() if k not in ENTRY_KEYS}
            done = _dump(c.deep(given) if whole_entry else c.block(given))
            out.append((done, c.stubs, len(_dump(given).encode()), len(done.encode())))
        return pd.DataFrame(out, columns=["json", "stubbed", "orig", "inlined"], dtype=object)

    return cut(value, ref)


def sweep(value: Column, most: int, preview: int = 100) -> Column:
    """K6: JSON text with every string over `most` bytes as a short note of its size and start."""

    @F.pandas_udf("string")
    def cut(values: pd.Series) -> pd.Series:
        def note(s: str) -> str:
            n = len(s.encode())
            return s if n <= most else f"[truncated: {n} bytes; preview: {s[:preview]}…]"

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else _dump(_walk(json.loads(text), note))
            except ValueError:
                return text

        return values.map(one)

    long = F.octet_length(value) > most
    return F.when(long, cut(F.when(long, value))).otherwise(value)


def pretty(value: Column) -> Column:
    """JSON text indented by two blanks; other text stays."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, indent=2)
            except ValueError:
                return text

        return values.map(one)

    return form(value)


#: Rows of an Arrow batch that are Python objects at once: pandas would hold a list of pairs for each row of it.
_ROWS = 500


def with_ids(raw: Column, ids: Column) -> Column:
    """A JSON entry with those of its top-level keys replaced that ids, a map, names, and its message's id by `message.id`.

    Absent keys stay absent; of promptId, requestId and message.id only strings are replaced.
    """

    def one(text: str | None, given: list | None) -> str | None:
        if text is None:
            return None
        own, entry = dict(given or {}), json.loads(text)
        routing = {k: own.pop(k) for k in ("promptId", "requestId", "message.id") if k in own}
        entry |= {k: own[k] for k in entry.keys() & own.keys()}
        entry |= {k: routing[k] for k in entry.keys() & routing.keys() if isinstance(entry[k], str)}
        message = entry.get("message")
        if "message.id" in routing and isinstance(message, dict) and isinstance(message.get("id"), str):
            message["id"] = routing["message.id"]
        return _dump(entry)

    @F.arrow_udf("string")
    def put(texts: pa.Array, new: pa.Array) -> pa.Array:
        def part(at: int) -> pa.Array:
            pairs = zip(texts.slice(at, _ROWS).to_pylist(), new.slice(at, _ROWS).to_pylist(), strict=True)
            return pa.array([one(t, n) for t, n in pairs], pa.string())

        return pa.concat_arrays([part(at) for at in range(0, len(texts), _ROWS)]) if len(texts) else pa.array([], pa.string())

    return put(raw, ids)
