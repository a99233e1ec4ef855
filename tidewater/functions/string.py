"""String functions."""

from __future__ import annotations

from tidewater.errors import SqlError
from tidewater.functions.base import Typed, fn, integer, quote, string
from tidewater.tsql import types as t

#: What T-SQL's trimming and LEN take for white space.
BLANKS = "' \\t\\n\\r'"


def text(sql: str) -> Typed:
    return Typed(sql, t.NVARCHAR)


@fn("len")
def _len(b, s):
    return Typed(f"length(rtrim({string(s)}))", t.INT)


@fn("datalength")
def _datalength(b, x):
    fixed = {"bit": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 8, "money": 8, "smallmoney": 4, "date": 3, "time": 5, "datetime": 8, "decimal": 17, "uniqueidentifier": 16, "datetimeoffset": 10}
    if x.type.name == "vector":
        return Typed(f"(size({x}) * 4)", t.INT)
    if x.type.name in fixed:
        return Typed(f"IF({x} IS NULL, CAST(NULL AS INT), {fixed[x.type.name]})", t.INT)
    wide = " * 2" if x.type.name in ("nchar", "nvarchar", "ntext", "sysname") else ""
    if wide:
        return Typed(f"length({x}){wide}", t.INT)
    return Typed(f"octet_length({x if x.type.name in ('binary', 'varbinary') else string(x)})", t.INT)


@fn("substring")
def _substring(b, s, start, length):
    return text(f"substring({string(s)}, greatest({integer(start)}, 1), {integer(length)})")


for _name in ("upper", "lower", "reverse"):
    fn(_name)(lambda b, s, _f=_name: text(f"{_f}({string(s)})"))




fn("ltrim")(lambda b, s: text(f"ltrim({BLANKS}, {string(s)})"))
fn("rtrim")(lambda b, s: text(f"rtrim({BLANKS}, {string(s)})"))
fn("trim")(lambda b, s: text(f"btrim({string(s)}, {BLANKS})"))


@fn("replace")
def _replace(b, s, find, to):
    return text(f"replace({string(s)}, {string(find)}, {string(to)})")




fn("left")(lambda b, s, n: text(f"left({string(s)}, {integer(n)})"))
fn("right")(lambda b, s, n: text(f"right({string(s)}, {integer(n)})"))


@fn("ascii")
def _ascii(b, s):
    return Typed(f"ascii(nullif({string(s)}, ''))", t.INT)


@fn("unicode")
def _unicode(b, s):
    return Typed(f"ascii({string(s)})", t.INT)


@fn("char", "nchar")
def _char(b, n):
    wide = integer(n)
    return text(f"IF({wide} BETWEEN 0 AND 255, char({wide}), decode(unhex(lpad(hex({wide}), 8, '0')), 'UTF-32'))")


@fn("charindex")
def _charindex(b, find, s, start=None):
    return Typed(f"locate({string(find)}, {string(s)}, {f'greatest({integer(start)}, 1)' if start else 1})", t.INT)


@fn("patindex")
def _patindex(b, pattern, s):
    return Typed(f"locate(replace({string(pattern)}, '%', ''), {string(s)})", t.INT)


@fn("soundex")
def _soundex(b, s):
    return text(f"coalesce(nullif(soundex({string(s)}), ''), IF({string(s)} IS NULL, NULL, '0000'))")


@fn("difference")
def _difference(b, x, y):
    one, two = _soundex(b, x), _soundex(b, y)
    same = " + ".join(f"CAST(substring({one}, {i}, 1) = substring({two}, {i}, 1) AS INT)" for i in range(1, 5))
    return Typed(f"({same})", t.INT)


@fn("concat")
def _concat(b, *args):
    if len(args) < 2:
        raise SqlError("The concat function requires 2 to 254 arguments.", 189)
    return text(f"concat_ws('', {', '.join(string(a) for a in args)})")


@fn("concat_ws")
def _concat_ws(b, sep, *args):
    return text(f"concat_ws({string(sep)}, {', '.join(string(a) for a in args)})")


#: T-SQL letters of date formats and Spark's.
DATE_LETTERS = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "E", "dd": "dd", "d": "d", "HH": "HH", "hh": "hh", "H": "H", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "fff": "SSS", "tt": "a"}
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "E", "%j": "DDD"}


def date_pattern(pattern: str) -> str:
    """A .NET or strftime date pattern as Spark's."""
    out, i, letters = "", 0, STRFTIME if "%" in pattern else DATE_LETTERS
    while i < len(pattern):
        for k in sorted(letters, key=len, reverse=True):
            if pattern.startswith(k, i):
                out, i = out + letters[k], i + len(k)
                break
        else:
            out, i = out + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return out


@fn("format")
def _format(b, value, pattern, culture=None):
    if not isinstance(pattern.literal, str):
        raise SqlError("FORMAT needs a literal pattern.", 8116)
    p = pattern.literal
    if value.type.is_time or value.type.is_string:
        return text(f"date_format({value}, {quote(date_pattern(p))})")
    kind, places = p[:1].upper(), p[1:]
    if kind in ("N", "C", "P", "F") and (not places or places.isdigit()):
        n = int(places) if places else 2
        shown = f"format_number({value}{' * 100' if kind == 'P' else ''}, {n})"
        return text({"N": shown, "C": f"concat(IF({value} < 0, '-$', '$'), format_number(abs({value}), {n}))", "P": f"concat({shown}, ' %')", "F": f"replace({shown}, ',', '')"}[kind])
    if kind == "D" and (not places or places.isdigit()):
        return text(f"lpad(CAST({value} AS STRING), greatest({places or 1}, length(CAST({value} AS STRING))), '0')")
    return text(f"format_number({value}, {quote(p)})")


@fn("str")
def _str(b, value, length=None, places=None):
    n, d = (length.literal if length else 10), (places.literal if places else 0)
    if not isinstance(n, int) or not isinstance(d, int):
        raise SqlError("STR needs literal sizes.", 8116)
    shown = f"format_string('%.{d}f', CAST({value} AS DOUBLE))"
    return text(f"IF(length({shown}) > {n}, repeat('*', {n}), lpad({shown}, {n}, ' '))")


fn("replicate")(lambda b, s, n: text(f"IF({integer(n)} < 0, NULL, repeat({string(s)}, {integer(n)}))"))
fn("space")(lambda b, n: text(f"repeat(' ', {integer(n)})"))


@fn("stuff")
def _stuff(b, s, start, length, new):
    s_, at, n = string(s), integer(start), integer(length)
    inside = f"overlay({s_} PLACING coalesce({string(new)}, '') FROM {at} FOR {n})"
    return text(f"IF({at} < 1 OR {at} > length({s_}) OR {n} < 0, NULL, {inside})")


@fn("translate")
def _translate(b, s, find, to):
    if isinstance(find.literal, str) and isinstance(to.literal, str) and len(find.literal) != len(to.literal):
        raise SqlError("The second and third arguments of the TRANSLATE built-in function must contain an equal number of characters.", 9828)
    return text(f"translate({string(s)}, {string(find)}, {string(to)})")


@fn("unistr")
def _unistr(b, s):
    """JSON's escapes are UNISTR's four-digit ones; a backslash without u is written \\0041 in T-SQL."""
    held = f"regexp_replace(regexp_replace({string(s)}, '(?<!\\\\\\\\)\\\\\\\\([0-9A-Fa-f]{{4}})', '\\\\\\\\u$1'), '\"', '\\\\\\\\\"')"
    return text(f"get_json_object(concat('{{\"v\":\"', {held}, '\"}}'), '$.v')")


@fn("string_escape")
def _string_escape(b, s, kind):
    kinds = {
        "json": [("\\", "\\\\"), ('"', '\\"'), ("/", "\\/"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")],
        "html": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")],
        "csv": [('"', '""')],
    }
    kinds["xml"] = kinds["html"]
    pairs = kinds.get(str(kind.literal).lower())
    if pairs is None:
        raise SqlError("An invalid type was given to STRING_ESCAPE.", 8116)
    out = string(s)
    for a, z in pairs:
        out = f"replace({out}, {quote(a) if a != chr(9) else quote(a)}, {quote(z)})"
    if str(kind.literal).lower() == "csv":
        out = f"IF({string(s)} RLIKE '[\",\\n\\r]', concat('\"', {out}, '\"'), {string(s)})"
    return text(out)


@fn("quotename")
def _quotename(b, s, mark=None):
    m = mark.literal if mark else "["
    left, right = {"[": "[]", "]": "[]", "'": "''", '"': '""', "(": "()", ")": "()", "<": "<>", ">": "<>", "{": "{}", "}": "{}"}.get(m, (None, None))
    if left is None:
        return Typed("CAST(NULL AS STRING)", t.NVARCHAR)
    return text(f"concat({quote(left)}, replace({string(s)}, {quote(right)}, {quote(right * 2)}), {quote(right)})")


@fn("parsename")
def _parsename(b, s, part):
    pieces = f"transform(split({string(s)}, '\\\\.'), x -> regexp_replace(x, '^\\\\[|\\\\]$', ''))"
    return text(f"IF(size({pieces}) > 4, NULL, try_element_at({pieces}, -{integer(part)}))")
