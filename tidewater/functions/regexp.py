"""Regular expressions, and text distance."""

from __future__ import annotations

from tidewater.errors import SqlError
from tidewater.functions.base import Typed, fn, integer, string
from tidewater.tsql import types as t


def pattern(p: Typed, flags: Typed | None) -> str:
    if flags is None:
        return string(p)
    if not isinstance(flags.literal, str) or set(flags.literal) - set("icmsx"):
        raise SqlError("Invalid regular expression flags.", 19300)
    on = "".join(sorted(set(flags.literal) & set("imsx")))
    return f"concat('(?{on})', {string(p)})" if on else string(p)


def tail(s: Typed, start: Typed | None) -> str:
    return string(s) if start is None or start.literal == 1 else f"substring({string(s)}, {integer(start)})"


@fn("regexp_like")
def _like(b, s, p, flags=None):
    return Typed(f"regexp_like({string(s)}, {pattern(p, flags)})", t.BIT)


@fn("regexp_replace")
def _replace(b, s, p, new=None, flags=None):
    return Typed(f"regexp_replace({string(s)}, {pattern(p, flags)}, {string(new) if new else quote_empty()})", t.NVARCHAR)


def quote_empty() -> str:
    return "''"


@fn("regexp_substr")
def _substr(b, s, p, start=None, nth=None, flags=None):
    found = f"regexp_extract_all({tail(s, start)}, {pattern(p, flags)}, 0)"
    return Typed(f"try_element_at({found}, {integer(nth) if nth else 1})", t.NVARCHAR)


@fn("regexp_count")
def _count(b, s, p, start=None, flags=None):
    return Typed(f"regexp_count({tail(s, start)}, {pattern(p, flags)})", t.INT)


@fn("regexp_instr")
def _instr(b, s, p, start=None, nth=None, ends=None, flags=None):
    """The nth match begins behind the text that the pieces between matches and the matches before it fill."""
    text, pat = tail(s, start), pattern(p, flags)
    n = integer(nth) if nth else "1"
    found = f"regexp_extract_all({text}, {pat}, 0)"
    pieces = f"split({text}, {pat}, -1)"
    # what the first n matches and the n pieces before them take
    before = f"(aggregate(slice({pieces}, 1, {n}), 0, (a, x) -> a + length(x)) + aggregate(slice({found}, 1, {n} - 1), 0, (a, x) -> a + length(x)))"
    if not nth or nth.literal == 1:
        first = f"regexp_instr({text}, {pat})"
        before = f"({first} - 1)"
    offset = f" + {integer(start)} - 1" if start is not None and start.literal != 1 else ""
    end = f" + IF({integer(ends)} = 1, length(try_element_at({found}, {n})), 0)" if ends is not None and ends.literal != 0 else ""
    return Typed(f"CASE WHEN {text} IS NULL THEN NULL WHEN size({found}) < {n} THEN 0 ELSE {before} + 1{offset}{end} END", t.INT)
