"""What a database holds: tables as versions of DataFrames, views, routines and the rest."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tidewater.errors import BAD_OBJECT, DUPLICATE_OBJECT, SqlError
from tidewater.tsql.ast import Node
from tidewater.tsql.types import Type, of_spark

_ids = itertools.count(245575913)


@dataclass
class Column:
    name: str
    type: Type
    nullable: bool = True
    identity: tuple[int, int] | None = None
    default: Node | None = None
    default_name: str | None = None
    computed: Node | None = None


@dataclass
class Constraint:
    name: str
    type: str  # primary, unique, check, foreign
    columns: list[str] = field(default_factory=list)
    expr: Node | None = None
    text: str = ""
    table: tuple[str, str] | None = None
    target: list[str] = field(default_factory=list)
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass
class Table:
    """A version of a table. Changing it puts a new version into the catalog; `view` names the DataFrame in Spark."""

    schema: str
    name: str
    columns: list[Column]
    df: DataFrame
    view: str
    constraints: list[Constraint] = field(default_factory=list)
    indexes: list[Node] = field(default_factory=list)
    next_identity: int | None = None
    id: int = field(default_factory=lambda: next(_ids))
    version: int = 0
    external: bool = False
    readonly: bool = False

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"Invalid column name '{name}'.", 207)

    def with_(self, **changes) -> "Table":
        return replace(self, version=self.version + 1, **changes)


@dataclass
class View:
    schema: str
    name: str
    query: Node
    text: str
    columns: list[str] | None = None
    id: int = field(default_factory=lambda: next(_ids))


@dataclass
class Routine:
    schema: str
    name: str
    node: Node
    id: int = field(default_factory=lambda: next(_ids))


@dataclass
class Sequence:
    schema: str
    name: str
    start: int
    step: int
    current: int | None = None
    id: int = field(default_factory=lambda: next(_ids))


class Catalog:
    """Names are case-insensitive; keys are (schema, name) in lower case."""

    def __init__(self):
        self.schemas = {"dbo": 1, "sys": 4, "information_schema": 3}
        self.tables: dict[tuple[str, str], Table] = {}
        self.views: dict[tuple[str, str], View] = {}
        self.procedures: dict[tuple[str, str], Routine] = {}
        self.functions: dict[tuple[str, str], Routine] = {}
        self.triggers: dict[tuple[str, str], Routine] = {}
        self.sequences: dict[tuple[str, str], Sequence] = {}
        self.synonyms: dict[tuple[str, str], list[str]] = {}
        self.types: dict[tuple[str, str], Node] = {}

    def kinds(self) -> dict[str, dict]:
        return {"table": self.tables, "view": self.views, "procedure": self.procedures, "function": self.functions, "trigger": self.triggers, "sequence": self.sequences, "synonym": self.synonyms, "type": self.types}

    def copy(self) -> "Catalog":
        """A private version: definitions and DataFrames are shared, the maps aren't."""
        out = Catalog()
        out.schemas = dict(self.schemas)
        for name, held in self.kinds().items():
            setattr(out, name + "s" if name != "type" else "types", dict(held))
        out.sequences = {k: replace(v) for k, v in self.sequences.items()}
        return out

    @staticmethod
    def key(parts: list[str]) -> tuple[str, str]:
        schema = parts[-2] if len(parts) > 1 and parts[-2] else "dbo"
        return schema.lower(), parts[-1].lower()

    def resolve(self, parts: list[str]) -> tuple[str, str]:
        """The key that a name leads to through synonyms."""
        for _ in range(16):
            key = self.key(parts)
            if key not in self.synonyms:
                return key
            parts = self.synonyms[key]
        raise SqlError(f"The synonym chain of '{parts[-1]}' is too long.", 470)

    def table(self, parts: list[str]) -> Table:
        key = self.resolve(parts)
        if key not in self.tables:
            raise SqlError(f"Invalid object name '{'.'.join(parts)}'.", BAD_OBJECT)
        return self.tables[key]

    def free(self, key: tuple[str, str]) -> None:
        """Raises if the name is taken or its schema isn't there."""
        if key[0] not in self.schemas:
            raise SqlError(f"The specified schema name '{key[0]}' does not exist.", 2760)
        for name in ("table", "view", "procedure", "function", "sequence", "synonym"):
            if key in self.kinds()[name]:
                raise SqlError(f"There is already an object named '{key[1]}' in the database.", DUPLICATE_OBJECT)


def columns_of(df: DataFrame) -> list[Column]:
    return [Column(f.name, of_spark(f.dataType), f.nullable) for f in df.schema]
