"""INFORMATION_SCHEMA and sys views, made from the session's catalog when a query names one."""

from __future__ import annotations

from tidewater.catalog import Column, Table
from tidewater.metadata.views import VIEWS
from tidewater.tsql import types as t

KINDS = {"s": t.NVARCHAR, "i": t.INT, "l": t.BIGINT, "b": t.BIT, "d": t.DATETIME}


def system_view(session, key: tuple[str, str]) -> Table | None:
    """The view as a small table, or None if there is no such view."""
    made = VIEWS.get(key)
    if made is None and key[0] == "dbo":
        made = VIEWS.get(("sys", key[1])) if key[1].startswith("sys") else None
    if made is None:
        return None
    spec, rows = made
    fields = [c.split(":") for c in spec.split()]
    columns = [Column(n, KINDS[k]) for n, k in fields]
    schema = ", ".join(f"`{c.name}` {c.type.spark()}" for c in columns)
    return session.make_table(key[0], key[1], columns, session.spark.createDataFrame(list(rows(session)), schema))
