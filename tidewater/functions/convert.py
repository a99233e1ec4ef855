"""CAST and CONVERT."""

from __future__ import annotations

import datetime as dt
import re

from tidewater.errors import BAD_CONVERSION, SqlError
from tidewater.functions.base import Typed, literal, quote, string
from tidewater.tsql import types as t
from tidewater.tsql.types import Type

#: Date styles and Spark's patterns.
STYLES = {
    0: "MMM dd yyyy hh:mma", 100: "MMM dd yyyy hh:mma", 1: "MM/dd/yyyy", 2: "yy.MM.dd", 3: "dd/MM/yy", 4: "dd.MM.yy", 5: "dd-MM-yy", 6: "dd MMM yy", 7: "MMM dd, yy",
    8: "HH:mm:ss", 108: "HH:mm:ss", 9: "MMM dd yyyy hh:mm:ss:SSSSSSSSSa", 109: "MMM dd yyyy hh:mm:ss:SSSSSSSSSa", 10: "MM-dd-yy", 11: "yy/MM/dd", 12: "yyMMdd",
    13: "dd MMM yyyy HH:mm:ss:SSSSSSSSS", 113: "dd MMM yyyy HH:mm:ss:SSSSSSSSS", 130: "dd MMM yyyy HH:mm:ss:SSSSSSSSS", 14: "HH:mm:ss:SSSSSSSSS", 114: "HH:mm:ss:SSSSSSSSS",
    20: "yyyy-MM-dd HH:mm:ss", 120: "yyyy-MM-dd HH:mm:ss", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy", 106: "dd MMM yyyy",
    107: "MMM dd, yyyy", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 131: "dd/MM/yyyy HH:mm:ss:SSSSSSSSS",
}
#: Styles that show a date as ISO text, with a T or a blank before the time.
ISO = {21: " ", 25: " ", 121: " ", 126: "T", 127: "T"}
#: Styles under which a DATE has a form of its own; others show ISO dates.
DATE_STYLES = {1: "MM/dd/yyyy", 101: "MM/dd/yyyy", 103: "dd/MM/yyyy"}
ORDERS = {"mdy": ("%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y"), "dmy": ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y"), "ymd": ("%Y/%m/%d", "%Y.%m.%d")}
CLOCKS = ("", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f", "T%H:%M:%S", "T%H:%M:%S.%f", " %I:%M%p", " %I:%M:%S%p", " %I:%M %p")


def parse_moment(text: str, order: str) -> dt.datetime | None:
    """A date and time as T-SQL text writes it."""
    text = re.sub(r"(\.\d{6})\d+", r"\1", text.strip().removesuffix("Z"))
    for date in ("%Y-%m-%d", "%Y%m%d", *ORDERS.get(order, ORDERS["mdy"]), "%Y/%m/%d", "%b %d %Y", "%B %d, %Y", "%d %b %Y"):
        for clock in CLOCKS:
            try:
                return dt.datetime.strptime(text, date + clock)
            except ValueError:
                continue
    for clock in ("%H:%M:%S", "%H:%M", "%H:%M:%S.%f"):
        try:
            return dt.datetime.combine(dt.date(1900, 1, 1), dt.datetime.strptime(text, clock).time())
        except ValueError:
            continue
    return None


def cut(sql: str, to: Type) -> str:
    """Text to its declared length; CHAR is padded."""
    if not to.length:
        return sql
    short = f"left({sql}, {to.length})"
    return f"rpad({short}, {to.length}, ' ')" if to.name in ("char", "nchar") else short


def cast(b, x: Typed, to: Type, safe: bool = False) -> Typed:
    word = "try_cast" if safe else "CAST"
    kind = x.type
    if kind.name == "null":
        return literal(None, to)
    if to.is_string:
        if kind.name == "datetime":
            return Typed(cut(f"CAST({x} AS STRING)", to), to)
        return Typed(cut(string(x), to), to, x.literal if isinstance(x.literal, str) and not to.length else None)
    if kind == to:
        return x
    if to.is_time and isinstance(x.literal, str):
        found = parse_moment(x.literal, b.session.options["dateformat"])
        if found is None:
            if safe:
                return literal(None, to)
            if to.name in ("datetimeoffset",):
                return Typed(x.sql, to)
            raise SqlError(f"Conversion failed when converting '{x.literal}' to {to.name}.", BAD_CONVERSION)
        if to.name == "date":
            return literal(found.date())
        if to.name == "datetime":
            return literal(found)
        if to.name == "time":
            return Typed(quote(found.time().isoformat()), t.TIME)
        return Typed(x.sql, to)
    if to.name == "bit":
        if kind.is_string:
            yes = f"lower({x}) = 'true' OR try_cast({x} AS DOUBLE) <> 0"
            known = f"lower({x}) IN ('true', 'false') OR try_cast({x} AS DOUBLE) IS NOT NULL"
            other = "NULL" if safe else f"CAST({x} AS BOOLEAN)"
            return Typed(f"CASE WHEN {x} IS NULL THEN NULL WHEN {known} THEN coalesce({yes}, FALSE) ELSE {other} END", t.BIT)
        return Typed(f"({x} <> 0)", t.BIT)
    if to.name == "tinyint":
        small = f"{word}({x if kind.name != 'bit' else f'CAST({x} AS INT)'} AS SMALLINT)"
        if kind.name in ("bit", "tinyint"):
            return Typed(small, t.TINYINT)
        out = "CAST(NULL AS SMALLINT)" if safe else "CAST(raise_error('Arithmetic overflow error for data type tinyint.') AS SMALLINT)"
        return Typed(f"IF({small} NOT BETWEEN 0 AND 255, {out}, {small})", t.TINYINT)
    if to.is_integer and kind.is_string:
        return Typed(f"{word}(trim({x}) AS {to.spark()})", to)
    if to.is_number and kind.name == "datetime":
        days = f"(timestampdiff(SECOND, TIMESTAMP_NTZ'1900-01-01 00:00:00', {x}) / 86400.0D)"
        return Typed(f"CAST({days} AS {to.spark()})", to)
    if to.is_number and kind.name == "bit":
        return Typed(f"CAST(CAST({x} AS INT) AS {to.spark()})", to)
    if to.name == "datetime" and kind.is_number:
        return Typed(f"timestampadd(SECOND, CAST({x} * 86400 AS INT), TIMESTAMP_NTZ'1900-01-01 00:00:00')", to)
    if to.name == "time":
        if kind.name == "datetime":
            return Typed(f"date_format({x}, 'HH:mm:ss.SSSSSS')", to)
        return Typed(string(x), to)
    if to.name == "date" and kind.is_string:
        return Typed(f"{word}({word}({x} AS TIMESTAMP_NTZ) AS DATE)", to)
    if to.name == "datetimeoffset":
        return Typed(string(x) if not kind.is_time else f"concat(CAST({x} AS STRING), ' +00:00')", to)
    if to.name == "uniqueidentifier":
        return Typed(f"lower({string(x)})", to)
    if to.name in ("sql_variant", "xml"):
        return Typed(string(x), to)
    if to.name == "vector":
        if kind.is_string:
            parsed = f"from_json({x}, 'array<float>')"
            if to.length:
                wrong = "CAST(NULL AS ARRAY<FLOAT>)" if safe else f"CAST(raise_error('The vector dimensions do not match.') AS ARRAY<FLOAT>)"
                parsed = f"IF(size({parsed}) <> {to.length}, {wrong}, {parsed})"
            return Typed(parsed, to)
        return Typed(f"{word}({x} AS ARRAY<FLOAT>)", to)
    if to.name in ("binary", "varbinary"):
        if kind.is_string:
            return Typed(f"encode({x}, 'UTF-8')", to)
        if kind.is_integer or kind.name == "bit":
            # the number's own bytes, the highest first; BINARY(n) has n of them, VARBINARY(n) n at most
            own = {"bit": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.name]
            size = (to.length or 30) if to.name == "binary" else min(own, to.length or 30)
            whole = f"lpad(hex(CAST({x} AS BIGINT)), 16, '0')"
            return Typed(f"unhex(lpad(right({whole}, {2 * min(own, size)}), {2 * size}, '0'))", to)
        return Typed(f"{word}({x} AS BINARY)", to)
    if kind.name in ("binary", "varbinary") and to.is_integer:
        return Typed(f"CAST(conv(hex({x}), 16, 10) AS {to.spark()})", to)
    return Typed(f"{word}({x} AS {to.spark()})", to)


def convert(b, x: Typed, to: Type, style: int | None, safe: bool) -> Typed:
    if style is None or not isinstance(style, int):
        return cast(b, x, to, safe)
    if to.is_string and x.type.name in ("datetime", "date"):
        if x.type.name == "date":
            return Typed(cut(f"date_format({x}, '{DATE_STYLES.get(style, 'yyyy-MM-dd')}')", to), to)
        if style in STYLES:
            return Typed(cut(f"date_format({x}, '{STYLES[style]}')", to), to)
        iso = f"CAST({x} AS STRING)"
        return Typed(cut(f"replace({iso}, ' ', 'T')" if ISO.get(style) == "T" else iso, to), to)
    if to.is_string and x.type.name in ("binary", "varbinary") and style in (1, 2):
        return Typed(cut(f"concat('0x', hex({x}))" if style == 1 else f"hex({x})", to), to)
    if to.name in ("binary", "varbinary") and x.type.is_string and style in (1, 2):
        return Typed(f"unhex(regexp_replace({x}, '^0[xX]', ''))", to)
    if to.name in ("date", "datetime") and x.type.is_string and style in STYLES:
        read = f"{'try_' if safe else ''}to_timestamp({x}, '{STYLES[style]}')"
        return Typed(f"CAST({read} AS {to.spark()})", to)
    return cast(b, x, to, safe)
