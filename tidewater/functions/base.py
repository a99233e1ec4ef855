"""Typed SQL and the register of functions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from tidewater.tsql import types as t
from tidewater.tsql.types import Type


@dataclass(frozen=True)
class Typed:
    sql: str
    type: Type
    literal: object = None  # the value of a string or integer literal

    def __str__(self) -> str:
        return self.sql


FUNCTIONS: dict = {}
#: Functions that get the tree of their first argument (a date part), not its SQL.
RAW: set[str] = set()


def fn(*names: str, raw: bool = False):
    def register(handler):
        for name in names:
            FUNCTIONS[name] = handler
            if raw:
                RAW.add(name)
        return handler

    return register


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def string(x: Typed) -> str:
    """x as text, the way T-SQL writes it."""
    if x.type.is_string or x.type.name in ("uniqueidentifier", "xml", "datetimeoffset", "time", "sql_variant"):
        return x.sql
    if x.type.name == "bit":
        return f"CAST(CAST({x} AS INT) AS STRING)"
    if x.type.name == "vector":
        return f"to_json({x})"
    if x.type.name in ("binary", "varbinary"):
        return f"decode({x}, 'UTF-8')"
    return f"CAST({x} AS STRING)"


def number(x: Typed) -> str:
    return f"CAST({x} AS INT)" if x.type.name == "bit" else f"CAST({x} AS DOUBLE)" if x.type.is_string else x.sql


def double(x: Typed) -> str:
    return f"CAST({number(x)} AS DOUBLE)"


def integer(x: Typed) -> str:
    return x.sql if x.type.name == "int" else f"CAST({x} AS INT)"


def boolean(x: Typed) -> str:
    """x as a condition."""
    if x.type.name == "bit":
        return x.sql
    if x.type.name == "null":
        return "CAST(NULL AS BOOLEAN)"
    return f"({number(x)} <> 0)"


def literal(value, type_: Type | None = None) -> Typed:
    """SQL for a Python value."""
    if value is None:
        kind = type_ or t.NULL
        return Typed("NULL" if kind.name == "null" else f"CAST(NULL AS {kind.spark()})", kind)
    if isinstance(value, bool):
        return Typed("TRUE" if value else "FALSE", t.BIT, value)
    if isinstance(value, int):
        kind = type_ if type_ and (type_.is_integer) else (t.INT if -(2**31) <= value < 2**31 else t.BIGINT)
        if type_ and type_.name == "bit":
            return Typed("TRUE" if value else "FALSE", t.BIT, bool(value))
        if type_ and not type_.is_integer:
            return Typed(f"CAST({value} AS {type_.spark()})", type_)
        return Typed(str(value) if kind.name == "int" else f"CAST({value} AS {kind.spark()})", kind, value)
    if isinstance(value, float):
        return Typed(f"CAST({value!r} AS DOUBLE)", t.FLOAT) if value == value and abs(value) != float("inf") else Typed(f"CAST('{value}' AS DOUBLE)", t.FLOAT)
    if isinstance(value, Decimal):
        digits = value.as_tuple()
        scale = max(0, -digits.exponent)
        kind = type_ if type_ and type_.is_exact else t.decimal(max(len(digits.digits), scale + 1), scale)
        return Typed(f"CAST('{value:f}' AS {kind.spark()})", kind)
    if isinstance(value, dt.datetime):
        return Typed(f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'", t.DATETIME)
    if isinstance(value, dt.date):
        return Typed(f"DATE'{value.isoformat()}'", t.DATE)
    if isinstance(value, (bytes, bytearray)):
        return Typed(f"X'{bytes(value).hex()}'", t.BINARY)
    if isinstance(value, list):
        return Typed(f"CAST(array({', '.join(repr(float(x)) for x in value)}) AS ARRAY<FLOAT>)", Type("vector", len(value)))
    return Typed(quote(str(value)), type_ if type_ and type_.spark() == "STRING" else t.NVARCHAR, str(value))
