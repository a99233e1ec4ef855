"""Scalar functions: each name gives typed Spark SQL for typed arguments."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from tidewater.errors import SqlError
from tidewater.functions.base import FUNCTIONS, RAW, Typed

for _part in ("string", "dates", "math", "logic", "json", "regexp", "fuzzy", "vector", "system"):
    import_module(f"tidewater.functions.{_part}")

__all__ = ["FUNCTIONS", "RAW", "Typed", "call"]


def call(binder, name: str, args: list, arity_error: str = "") -> Typed:
    handler: Callable = FUNCTIONS[name]
    try:
        return handler(binder, *args)
    except TypeError as wrong:
        if "positional argument" in str(wrong):
            raise SqlError(f"The {name.upper()} function has the wrong number of arguments.", 174) from None
        raise
