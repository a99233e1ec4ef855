"""JSON functions over text."""

from __future__ import annotations

from tidewater.errors import SqlError
from tidewater.functions.base import Typed, fn, quote, string
from tidewater.tsql import types as t


def path_of(path: Typed | None) -> str:
    if path is None:
        return "$"
    if not isinstance(path.literal, str):
        raise SqlError("A JSON path must be a literal.", 13607)
    text = path.literal.strip()
    for mode in ("lax ", "strict "):
        text = text.removeprefix(mode).strip()
    if not text.startswith("$"):
        raise SqlError(f"JSON path is not properly formatted: {text}", 13607)
    return text


@fn("json_value")
def _json_value(b, j, path):
    return Typed(f"get_json_object({string(j)}, {quote(path_of(path))})", t.NVARCHAR)


def node(j: str, path: str) -> str:
    """The JSON text of a node, strings in quotes."""
    return f"to_json(try_variant_get(try_parse_json({j}), {quote(path)}, 'variant'))"


def quoted(text: str) -> str:
    """Text as a JSON string."""
    return f"to_json(CAST({text} AS VARIANT))"


@fn("json_query")
def _json_query(b, j, path=None):
    return Typed(node(string(j), path_of(path)), t.NVARCHAR)


@fn("isjson")
def _isjson(b, j):
    return Typed(f"IF({j} IS NULL, CAST(NULL AS BOOLEAN), try_parse_json({string(j)}) IS NOT NULL)", t.BIT)


@fn("json_path_exists")
def _json_path_exists(b, j, path):
    return Typed(f"IF({j} IS NULL, CAST(NULL AS BOOLEAN), {node(string(j), path_of(path))} IS NOT NULL)", t.BIT)


@fn("json_array_length")
def _json_array_length(b, j, path=None):
    return Typed(f"json_array_length({string(j) if path is None else node(string(j), path_of(path))})", t.INT)


@fn("json_keys")
def _json_keys(b, j, path=None):
    return Typed(f"to_json(json_object_keys({string(j) if path is None else node(string(j), path_of(path))}))", t.NVARCHAR)


@fn("json_modify")
def _json_modify(b, j, path, value):
    """Sets a member of the top object or of nested ones; the text is rebuilt from its members, in their order."""
    steps = [s for s in path_of(path).removeprefix("$").split(".") if s]
    if any("[" in s for s in steps) or not steps:
        return Typed(f"{b.session.udf('json_modify')}({string(j)}, {quote(path_of(path))}, {string(value)})", t.NVARCHAR)
    if value.type.is_string:
        new = f"coalesce(IF(try_parse_json({string(value)}) IS NULL, NULL, {string(value)}), {quoted(string(value))}, 'null')"
    elif value.type.name == "null":
        new = "'null'"
    else:
        new = f"coalesce({f'CAST({value} AS STRING)' if value.type.name == 'bit' else string(value)}, 'null')"

    def put(text: str, at: int) -> str:
        key = quote(steps[at])
        inner = new if at == len(steps) - 1 else put(f"coalesce({node(text, '$.' + steps[at])}, '{{}}')", at + 1)
        members = f"from_json({text}, 'map<string,string>')"
        values = f"try_variant_get(try_parse_json({text}), '$', 'map<string,variant>')"
        kept = f"transform(map_entries({members}), e -> concat({quoted('e.key')}, ':', IF(e.key = {key}, {inner}, coalesce(to_json(element_at({values}, e.key)), 'null'))))"
        more = f"IF(map_contains_key({members}, {key}), CAST(array() AS ARRAY<STRING>), array(concat({quoted(key)}, ':', {inner})))"
        return f"IF({text} IS NULL, NULL, concat('{{', array_join(concat({kept}, {more}), ','), '}}'))"

    return Typed(put(string(j), 0), t.NVARCHAR)
