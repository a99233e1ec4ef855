"""Vector functions."""

from __future__ import annotations

from tidewater.errors import SqlError
from tidewater.functions.base import Typed, fn
from tidewater.tsql import types as t


def vector(x: Typed) -> str:
    return f"from_json({x}, 'array<float>')" if x.type.is_string else x.sql


def total(a: str, b: str, term: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> {term}), 0.0D, (s, v) -> s + v)"


@fn("vector_distance")
def _distance(binder, metric, x, y):
    a, b = vector(x), vector(y)
    x_, y_ = "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)"
    dot = total(a, b, f"{x_} * {y_}")
    kind = str(metric.literal).lower()
    if kind == "euclidean":
        out = f"sqrt({total(a, b, f'({x_} - {y_}) * ({x_} - {y_})')})"
    elif kind == "dot":
        out = f"(- {dot})"
    elif kind == "cosine":
        norms = f"(sqrt({total(a, a, f'{x_} * {y_}')}) * sqrt({total(b, b, f'{x_} * {y_}')}))"
        out = f"IF({norms} = 0, IF({a} = {b}, 0.0D, 1.0D), 1 - {dot} / {norms})"
    else:
        raise SqlError(f"Unknown distance metric '{metric.literal}'.", 42204)
    return Typed(f"IF(size({a}) <> size({b}), CAST(raise_error('The vector dimensions do not match.') AS DOUBLE), {out})", t.FLOAT)
