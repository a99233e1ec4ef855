"""Vectorised kernels over the UTF-8 bytes of many texts at once (numpy only)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
#: An odd base has powers and inverse powers modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets into them (null: no bytes)."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    held = _tables.get("powers")
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), BASE, U64)
        held[0] = 1
        _tables["powers"] = held = np.cumprod(held, dtype=U64)
    return held[:n]


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """BASE**-i for each index i, from two tables of 2**12 steps."""
    inverse = pow(BASE, -1, 1 << 64)
    low = _tables.get("low")
    if low is None:
        low = np.full(1 << 12, inverse, U64)
        low[0] = 1
        _tables["low"] = low = np.cumprod(low, dtype=U64)
    top = int(at.max()) >> 12 if len(at) else 0
    high = _tables.get("high")
    if high is None or len(high) <= top:
        high = np.full(max(top + 1, 1 << 10), pow(inverse, 1 << 12, 1 << 64), U64)
        high[0] = 1
        _tables["high"] = high = np.cumprod(high, dtype=U64)
    return low[at & 0xFFF] * high[at >> 12]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p[i]: the sum of (byte j + 1) * BASE**j over j < i."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * inverse_powers(start) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For sorted starts: how many stand before each row's offset (one more than rows)."""
    return np.searchsorted(starts, offsets)


#: The white space that the contracts split at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
