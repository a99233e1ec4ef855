"""The engine's types: what a T-SQL expression is, and the Spark type that carries it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    name: str
    length: int | None = None  # of strings and binaries; precision of decimals; dimensions of vectors
    scale: int = 0

    @property
    def is_string(self) -> bool:
        return self.name in STRINGS

    @property
    def is_integer(self) -> bool:
        return self.name in ("tinyint", "smallint", "int", "bigint")

    @property
    def is_exact(self) -> bool:
        return self.name in ("decimal", "money", "smallmoney")

    @property
    def is_number(self) -> bool:
        return self.is_integer or self.is_exact or self.name == "float"

    @property
    def is_time(self) -> bool:
        return self.name in ("date", "time", "datetime", "datetimeoffset")

    def spark(self) -> str:
        if self.is_string or self.name in ("uniqueidentifier", "xml", "datetimeoffset"):
            return "STRING"
        if self.name == "decimal":
            return f"DECIMAL({self.length or 18},{self.scale})"
        return SPARK[self.name]

    def declared(self) -> str:
        """As T-SQL writes it."""
        if self.name == "decimal":
            return f"decimal({self.length or 18},{self.scale})"
        if self.name == "vector":
            return f"vector({self.length})"
        if self.length and (self.is_string or self.name in ("binary", "varbinary")):
            return f"{self.name}({self.length})"
        return self.name


STRINGS = ("char", "varchar", "nchar", "nvarchar", "text", "ntext", "sysname")
#: The Spark type that carries each T-SQL type.
SPARK = {
    "bit": "BOOLEAN",
    "tinyint": "SMALLINT",
    "smallint": "SMALLINT",
    "int": "INT",
    "bigint": "BIGINT",
    "float": "DOUBLE",
    "money": "DECIMAL(19,4)",
    "smallmoney": "DECIMAL(10,4)",
    "binary": "BINARY",
    "varbinary": "BINARY",
    "date": "DATE",
    "time": "STRING",
    "datetime": "TIMESTAMP_NTZ",
    "vector": "ARRAY<FLOAT>",
    "sql_variant": "STRING",
    "null": "VOID",
    "array": "ARRAY<STRING>",
}
#: Other names of types.
ALIASES = {
    "integer": "int",
    "double": "float",
    "real": "float",
    "double precision": "float",
    "numeric": "decimal",
    "dec": "decimal",
    "datetime2": "datetime",
    "smalldatetime": "datetime",
    "timestamp": "binary",
    "rowversion": "binary",
    "image": "varbinary",
    "boolean": "bit",
    "character": "char",
    "sql_variant": "sql_variant",
}
BIT, TINYINT, SMALLINT, INT, BIGINT = (Type(x) for x in ("bit", "tinyint", "smallint", "int", "bigint"))
FLOAT, MONEY, DATE, TIME, DATETIME = (Type(x) for x in ("float", "money", "date", "time", "datetime"))
VARCHAR, NVARCHAR, BINARY, NULL, VECTOR = (Type(x) for x in ("varchar", "nvarchar", "varbinary", "null", "vector"))
RANK = ["null", "bit", "tinyint", "smallint", "int", "bigint", "smallmoney", "money", "decimal", "float"]


def decimal(precision: int, scale: int) -> Type:
    return Type("decimal", min(38, precision), min(scale, 38))


def named(name: str, args: list[int | None] = ()) -> Type:
    """The type that a declaration names; an unknown name is a string, as for user-defined types."""
    name = ALIASES.get(name.lower(), name.lower())
    length = args[0] if args else None
    if name == "decimal":
        return decimal(length or 18, (args[1] or 0) if len(args) > 1 else 0)
    if name in ("char", "nchar", "binary") and length is None:
        length = 1
    if name in SPARK or name in STRINGS or name in ("uniqueidentifier", "xml", "datetimeoffset"):
        return Type(name, length if name in (*STRINGS, "binary", "varbinary", "vector") else None)
    return Type("varchar", 255)


def of_spark(kind: T.DataType) -> Type:
    if isinstance(kind, T.DecimalType):
        return decimal(kind.precision, kind.scale)
    if isinstance(kind, T.ArrayType):
        return VECTOR if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else Type("array")
    simple = {
        T.BooleanType: BIT,
        T.ByteType: SMALLINT,
        T.ShortType: SMALLINT,
        T.IntegerType: INT,
        T.LongType: BIGINT,
        T.FloatType: FLOAT,
        T.DoubleType: FLOAT,
        T.DateType: DATE,
        T.TimestampType: DATETIME,
        T.TimestampNTZType: DATETIME,
        T.BinaryType: BINARY,
        T.NullType: NULL,
    }
    return simple.get(type(kind), NVARCHAR)


def common(a: Type, b: Type) -> Type:
    """The type of a column that takes values of both."""
    if a.name == "null":
        return b
    if b.name == "null" or a == b:
        return a
    if a.is_string and b.is_string:
        n = max(a.length, b.length) if a.length and b.length else None
        return Type("nvarchar" if "n" in (a.name[0], b.name[0]) else "varchar", n)
    if a.name in RANK and b.name in RANK:
        top = max((a, b), key=lambda t: RANK.index(t.name))
        if top.name == "decimal":
            pa, sa = digits(a)
            pb, sb = digits(b)
            scale = max(sa, sb)
            return decimal(max(pa - sa, pb - sb) + scale, scale)
        return top
    if a.is_string:
        return b
    if b.is_string:
        return a
    if {a.name, b.name} == {"date", "datetime"}:
        return DATETIME
    return a


def digits(t: Type) -> tuple[int, int]:
    """Precision and scale of an exact number."""
    fixed = {"bit": (1, 0), "tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0), "money": (19, 4), "smallmoney": (10, 4)}
    return (t.length or 18, t.scale) if t.name == "decimal" else fixed.get(t.name, (38, 6))


def unbounded(t: Type) -> Type:
    return replace(t, length=None) if t.is_string else t
