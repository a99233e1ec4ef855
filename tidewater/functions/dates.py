"""Date and time functions."""

from __future__ import annotations

from tidewater.errors import SqlError
from tidewater.functions.base import Typed, fn, integer, literal, string
from tidewater.tsql import types as t

#: T-SQL's names of date parts.
PARTS = {
    "year": ("year", "yy", "yyyy"),
    "quarter": ("quarter", "qq", "q"),
    "month": ("month", "mm", "m"),
    "dayofyear": ("dayofyear", "dy", "y"),
    "day": ("day", "dd", "d"),
    "week": ("week", "wk", "ww"),
    "weekday": ("weekday", "dw", "w", "dayofweek"),
    "hour": ("hour", "hh"),
    "minute": ("minute", "mi", "n"),
    "second": ("second", "ss", "s"),
    "millisecond": ("millisecond", "ms"),
    "microsecond": ("microsecond", "mcs"),
    "nanosecond": ("nanosecond", "ns"),
    "iso_week": ("iso_week", "isowk", "isoww"),
}
NAMES = {alias: part for part, aliases in PARTS.items() for alias in aliases}


def part_of(node) -> str:
    word = (node.parts[-1] if node.parts else str(node.value)).lower()
    if word not in NAMES:
        raise SqlError(f"'{word}' is not a recognized date part.", 155)
    return NAMES[word]


def moment(x: Typed) -> str:
    """x as a timestamp without zone."""
    if x.type.name == "datetime":
        return x.sql
    return f"CAST({x} AS TIMESTAMP_NTZ)"


for _name in ("getdate", "current_timestamp", "sysdatetime", "getutcdate", "sysutcdatetime"):
    fn(_name)(lambda b: literal(b.session.now()))
fn("sysdatetimeoffset")(lambda b: Typed(f"'{b.session.now().isoformat(sep=' ')} +00:00'", t.Type("datetimeoffset")))
fn("current_date")(lambda b: literal(b.session.now().date()))
fn("current_time")(lambda b: Typed(f"'{b.session.now().time().isoformat()}'", t.TIME))


@fn("dateadd", raw=True)
def _dateadd(b, part, n, d):
    p, count = part_of(part), integer(n)
    unit = {"dayofyear": "DAY", "weekday": "DAY", "iso_week": "WEEK"}.get(p, p.upper())
    if p in ("millisecond", "microsecond", "nanosecond"):
        scale = {"millisecond": "MILLISECOND", "microsecond": "MICROSECOND", "nanosecond": "MICROSECOND"}[p]
        return Typed(f"timestampadd({scale}, {count}{' div 1000' if p == 'nanosecond' else ''}, {moment(d)})", t.DATETIME)
    added = f"timestampadd({unit}, {count}, {moment(d)})"
    return Typed(f"CAST({added} AS DATE)", t.DATE) if d.type.name == "date" else Typed(added, t.DATETIME)


def boundaries(p: str, x: str, y: str) -> str:
    """How many boundaries of a part lie between two timestamps."""
    days = f"CAST(datediff(CAST({y} AS DATE), CAST({x} AS DATE)) AS BIGINT)"
    hours = f"({days} * 24 + hour({y}) - hour({x}))"
    minutes = f"({hours} * 60 + minute({y}) - minute({x}))"
    seconds = f"({minutes} * 60 + second({y}) - second({x}))"
    micros = f"(({seconds}) * 1000000 + CAST(date_format({y}, 'SSSSSS') AS BIGINT) - CAST(date_format({x}, 'SSSSSS') AS BIGINT))"
    return {
        "year": f"CAST(year({y}) - year({x}) AS BIGINT)",
        "quarter": f"CAST((year({y}) - year({x})) * 4 + quarter({y}) - quarter({x}) AS BIGINT)",
        "month": f"CAST((year({y}) - year({x})) * 12 + month({y}) - month({x}) AS BIGINT)",
        "week": f"((datediff(CAST({y} AS DATE), DATE'1899-12-31') div 7) - (datediff(CAST({x} AS DATE), DATE'1899-12-31') div 7))",
        "hour": hours,
        "minute": minutes,
        "second": seconds,
        "millisecond": f"({micros} div 1000)",
        "microsecond": micros,
        "nanosecond": f"({micros} * 1000)",
    }.get(p, days)


@fn("datediff", raw=True)
def _datediff(b, part, x, y):
    return Typed(f"CAST({boundaries(part_of(part), moment(x), moment(y))} AS INT)", t.INT)


@fn("datediff_big", raw=True)
def _datediff_big(b, part, x, y):
    return Typed(boundaries(part_of(part), moment(x), moment(y)), t.BIGINT)


@fn("datepart", raw=True)
def _datepart(b, part, d):
    p, x = part_of(part), moment(d)
    first = b.session.options["datefirst"]
    sql = {
        "dayofyear": f"dayofyear({x})",
        "weekday": f"(pmod(dayofweek({x}) - 1 - {first}, 7) + 1)",
        "week": f"(((dayofyear({x}) - 1 + pmod(dayofweek(trunc(CAST({x} AS DATE), 'YEAR')) - 1 - {first}, 7)) div 7) + 1)",
        "iso_week": f"weekofyear({x})",
        "second": f"CAST(floor(second({x})) AS INT)",
        "millisecond": f"CAST(date_format({x}, 'SSS') AS INT)",
        "microsecond": f"CAST(date_format({x}, 'SSSSSS') AS INT)",
        "nanosecond": f"CAST(date_format({x}, 'SSSSSS') AS INT) * 1000",
    }.get(p, f"{p}({x})")
    return Typed(f"CAST({sql} AS INT)", t.INT)


@fn("datename", raw=True)
def _datename(b, part, d):
    p = part_of(part)
    if p in ("month", "weekday"):
        return Typed(f"date_format({moment(d)}, '{'MMMM' if p == 'month' else 'EEEE'}')", t.NVARCHAR)
    return Typed(f"CAST({_datepart(b, part, d)} AS STRING)", t.NVARCHAR)


for _name in ("year", "month", "day"):
    fn(_name)(lambda b, d, _f=_name: Typed(f"{_f}({d if d.type.is_time else f'try_cast({d} AS TIMESTAMP_NTZ)'})", t.INT))


@fn("eomonth")
def _eomonth(b, d, n=None):
    x = f"CAST({d} AS DATE)"
    return Typed(f"last_day({f'add_months({x}, {integer(n)})' if n else x})", t.DATE)


@fn("isdate")
def _isdate(b, s):
    return Typed(f"CAST(coalesce(try_cast({string(s)} AS TIMESTAMP_NTZ) IS NOT NULL, FALSE) AS INT)", t.INT)


@fn("datefromparts")
def _datefromparts(b, y, m, d):
    return Typed(f"make_date({y}, {m}, {d})", t.DATE)
