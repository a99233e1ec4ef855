"""Text distance."""

from __future__ import annotations

from tidewater.functions.base import Typed, fn, string
from tidewater.tsql import types as t

RATIO = t.decimal(18, 9)


@fn("edit_distance")
def _distance(b, x, y, most=None):
    return Typed(f"levenshtein({string(x)}, {string(y)})", t.INT)


@fn("edit_distance_similarity")
def _similarity(b, x, y):
    longest = f"greatest(length({string(x)}), length({string(y)}))"
    return Typed(f"CAST(IF({longest} = 0, 1.0D, 1 - levenshtein({string(x)}, {string(y)}) / CAST({longest} AS DOUBLE)) AS DECIMAL(18,9))", RATIO)


def jaro_winkler(x: str, y: str) -> str:
    """Jaro-Winkler similarity from higher-order functions.

    Letters are matched from left to right, each with the first free equal letter within the window; the
    state is the places of the second text that are taken, in the order of the first text's letters.
    """
    window = f"greatest(greatest(length({x}), length({y})) div 2 - 1, 0)"
    place = (
        f"get(filter(sequence(greatest(i - {window}, 0), least(i + {window}, length({y}) - 1)), "
        f"j -> substring({y}, CAST(j AS INT) + 1, 1) = substring({x}, CAST(i AS INT) + 1, 1) AND NOT array_contains(m.b, CAST(j AS INT))), 0)"
    )
    step = f"IF(greatest(i - {window}, 0) > length({y}) - 1, CAST(NULL AS INT), CAST({place} AS INT))"
    pairs = (
        f"aggregate(sequence(0, length({x}) - 1), named_struct('a', CAST(array() AS ARRAY<INT>), 'b', CAST(array() AS ARRAY<INT>)), "
        f"(m, i) -> get(transform(array({step}), p -> IF(p IS NULL, m, named_struct('a', concat(m.a, array(CAST(i AS INT))), 'b', concat(m.b, array(p))))), 0))"
    )
    turned = (
        f"size(filter(arrays_zip(transform(p.a, i -> substring({x}, i + 1, 1)), transform(array_sort(p.b), j -> substring({y}, j + 1, 1))), z -> z['0'] <> z['1']))"
    )
    jaro = f"IF(size(p.a) = 0, 0.0D, (size(p.a) / CAST(length({x}) AS DOUBLE) + size(p.a) / CAST(length({y}) AS DOUBLE) + (size(p.a) - ({turned} div 2)) / CAST(size(p.a) AS DOUBLE)) / 3)"
    prefix = f"(CAST(substring({x}, 1, 1) = substring({y}, 1, 1) AS INT) * (1 + CAST(length({x}) > 1 AND length({y}) > 1 AND substring({x}, 1, 2) = substring({y}, 1, 2) AS INT) + CAST(length({x}) > 2 AND length({y}) > 2 AND substring({x}, 1, 3) = substring({y}, 1, 3) AS INT) + CAST(length({x}) > 3 AND length({y}) > 3 AND substring({x}, 1, 4) = substring({y}, 1, 4) AS INT)))"
    whole = f"get(transform(array({pairs}), p -> get(transform(array({jaro}), s -> s + {prefix} * 0.1D * (1 - s)), 0)), 0)"
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {x} = {y} THEN 1.0D WHEN length({x}) = 0 OR length({y}) = 0 THEN 0.0D ELSE {whole} END"


@fn("jaro_winkler_similarity")
def _jaro(b, x, y):
    return Typed(f"CAST({jaro_winkler(string(x), string(y))} AS DECIMAL(18,9))", RATIO)


@fn("jaro_winkler_distance")
def _jaro_distance(b, x, y):
    return Typed(f"CAST(1 - ({jaro_winkler(string(x), string(y))}) AS DECIMAL(18,9))", RATIO)
