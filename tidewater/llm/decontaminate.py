"""Benchmark decontamination: seeds by the pigeonhole principle, q-gram counts, exact edit verification.

Texts and items are normalised alike: A-Z lower-cased, runs of anything but letters, digits and bytes
over 127 become one blank. A document holds an item if some stretch of it is within RATE * length edits;
an item of fewer than SHORTEST bytes (normalised) must stand there verbatim, as whole words.

1. An item that may take d edits is cut into d + 1 pieces, of which d edits leave one as it was. The first
   bytes of each piece are looked up at every byte of a text, whatever its script or blanks; where they
   stand, they say where the item would begin.
2. A stretch within d edits of an item of m bytes shares m - Q + 1 - Q d of its Q-grams, so candidates
   whose surroundings hold fewer of this very item's Q-grams are left out.
3. Each candidate that remains is verified by the exact edit distance between the item and the best
   stretch there.

Neither of the first two steps loses a match, at any length of item. Items are read in blocks of bounded
size, so what travels to the workers doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytes_np as B
from tidewater.llm.common import CHUNK_BYTES, mapped

U64 = np.uint64
RATE, Q, GRAM_BITS = 0.1, 6, 22
#: Bytes of a piece that are looked up, at most, and how many candidates are held at once.
PIECE, HELD = 9, 1 << 20
#: Items of a block: about so many bytes at most.
BLOCK_BYTES, SHORTEST = 1 << 21, 24
OUT = "doc_id long, item_id long, distance int, item_bytes int, start_byte long, end_byte long"


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, where each byte stood in its text)."""
    data, offsets = B.text_buffer(column)
    table = np.full(256, 32, np.uint8)
    for part in (range(48, 58), range(97, 123), range(128, 256)):
        table[part.start : part.stop] = part
    table[65:91] = np.arange(97, 123)
    data = table[data]
    keep = data != 32
    blank = ~keep
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if len(data):
        # a blank stays behind a word of the same text
        keep[1:] |= blank[1:] & (data[:-1] != 32) & ~first[1:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    return data[keep], total[offsets], (np.arange(len(data)) - row_start)[keep]


def gram_keys(data: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """For each size a key of each run of so many bytes (from here on)."""
    out, h = {}, np.zeros(len(data), U64)
    for k in range(max(sizes, default=0)):
        h = h[: max(0, len(data) - k)] * U64(0x9E3779B97F4A7C15) + data[k:].astype(U64) + U64(1)
        if k + 1 in sizes:
            out[k + 1] = B.mix(h)
    return out


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(64 - GRAM_BITS)).astype(np.int32)


@dataclass
class Items:
    ids: list[int]
    texts: list[bytes]
    slots: list[np.ndarray]  # of each item's Q-grams
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by bytes looked up: slots taken; sorted keys, their items and places there
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by bytes, of items under SHORTEST: sorted keys, their items


def edits(length: int) -> int:
    return int(RATE * length)


def index(ids: list[int], texts: list[str | None]) -> Items:
    data, offsets, _ = normalised(pa.array(texts, pa.string()))
    plain = [data[a:b].tobytes().rstrip(b" ") for a, b in zip(offsets[:-1], offsets[1:])]
    used = [i for i, t in enumerate(plain) if t]
    used.sort(key=lambda i: (len(plain[i]), i))
    ids, plain = [ids[i] for i in used], [plain[i] for i in used]
    slots, seeds, words = [], {}, {}
    for i, t in enumerate(plain):
        if len(t) < SHORTEST:
            slots.append(np.zeros(0, np.int32))
            words.setdefault(len(t), []).append((gram_keys(np.frombuffer(t, np.uint8), {len(t)})[len(t)][0], i))
            continue
        count = edits(len(t)) + 1
        size = min(PIECE, len(t) // count)
        keys = gram_keys(np.frombuffer(t, np.uint8), {Q, size})
        slots.append(slots_of(keys[Q]))
        places = np.arange(count) * len(t) // count
        seeds.setdefault(size, []).append((keys[size][places], np.full(count, i), places))
    pieces = {}
    for size, found in seeds.items():
        keys, who, places = (np.concatenate(x) for x in zip(*found))
        taken = np.zeros(1 << GRAM_BITS, bool)
        taken[slots_of(keys)] = True
        order = np.argsort(keys, kind="stable")
        pieces[size] = (taken, keys[order], who[order], places[order])
    short = {size: (np.array([k for k, _ in sorted(found)], U64), np.array([i for _, i in sorted(found)])) for size, found in words.items()}
    return Items(ids, plain, slots, pieces, short)


def word_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word may begin or end before each byte (and behind the last): at rows' ends, at blanks, and
    on both sides of a character of three bytes or more, as scripts of such characters have few blanks."""
    out = np.zeros(len(data) + 1, bool)
    out[offsets] = True
    out[:-1] |= (data == 32) | (data >= 0xE0)
    out[1:] |= data == 32
    inner = (data & 0xC0) == 0x80
    out[2:-1] |= inner[1:-1] & inner[:-2] & ~inner[2:]
    return out


def verbatim(data: np.ndarray, keys: dict[int, np.ndarray], offsets: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(row, item, first byte) of the first place of each row for each short item that it holds as whole words."""
    out: list[tuple[int, int, int]] = []
    if not items.short:
        return out
    edge = word_edges(data, offsets)
    starts = np.flatnonzero(edge[:-1] & (data != 32))
    for size, (known, who) in items.short.items():
        at = starts[starts <= len(data) - size]
        at = at[edge[at + size]]
        row = np.searchsorted(offsets, at, side="right") - 1
        at = at[at + size <= offsets[row + 1]]
        low = np.searchsorted(known, keys[size][at], side="left")
        count = np.searchsorted(known, keys[size][at], side="right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        item = who[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        letters = np.frombuffer(b"".join(items.texts[i] for i in who), np.uint8).reshape(-1, size)
        same = (data[at[:, None] + np.arange(size)] == letters[np.argsort(who)[np.searchsorted(np.sort(who), item)]]).all(1)
        at, item = at[same], item[same]
        row = np.searchsorted(offsets, at, side="right") - 1
        _, first = np.unique(item * len(offsets) + row, return_index=True)
        out += zip(row[first].tolist(), item[first].tolist(), at[first].tolist())
    return out


def letter_bits(item: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for c in set(item):
        out[c] = int(bytes(48 + (x == c) for x in reversed(item)), 2)
    return out


def scores(bits: dict[int, int], m: int, text: bytes, anchored: bool) -> list[int]:
    """Edits between the item and the best stretch that ends behind each byte of text, or (anchored) all of text up to there.

    Myers' bit vectors: a column of the table of edits is two numbers of m bits.
    """
    full, top, edge = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, score, out = full, 0, m, []
    for c in text:
        same = bits.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        same |= down
        more, less = (more << 1 | edge) & full, (less << 1) & full
        up, down = less | (full & ~(same | more)), more & same
        out.append(score)
    return out


def distances(item: np.ndarray, regions: np.ndarray, real: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edit distance between the item and the best stretch of each region, where that stretch begins and ends).

    Regions are rows of bytes, of which the first `real` count. Of the stretches of least distance it is
    the one that ends first, then the longest; the beginning is looked for where the distance is at most `most`.
    """
    text, m = item.tobytes(), len(item)
    ahead, back = letter_bits(text), letter_bits(text[::-1])
    got, spans = np.full(len(regions), m, np.int64), np.zeros((len(regions), 2), np.int64)
    for i, n in enumerate(real.tolist()):
        region = regions[i, :n].tobytes()
        found = scores(ahead, m, region, False)
        got[i] = min(found, default=m)
        if got[i] <= most and found:
            end = found.index(got[i]) + 1
            before = scores(back, m, region[max(0, end - m - most) : end][::-1], True)
            spans[i] = end - 1 - max(j for j, x in enumerate(before) if x == got[i]), end
    return got, spans


def candidates(keys: dict[int, np.ndarray], offsets: np.ndarray, items: Items) -> np.ndarray:
    """(item, row, place) for each place of a row where an item may begin, sorted.

    Places are counted in steps of step(edits) bytes, the first of them `edits` bytes before the row.
    """
    size = np.array([len(t) for t in items.texts], np.int64)
    most = np.array([edits(len(t)) for t in items.texts], np.int64)
    wide = int(np.diff(offsets).max() + 2 * most.max(initial=0)) + 1
    rows, codes = len(offsets) - 1, [np.zeros(0, np.int64)]
    for length, (taken, known, who, places) in items.pieces.items():
        at = np.flatnonzero(taken[slots_of(keys[length])])
        low = np.searchsorted(known, keys[length][at], side="left")
        count = np.searchsorted(known, keys[length][at], side="right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        part = np.cumsum(count) // HELD
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
            n = count[cut]
            pick = np.repeat(low[cut] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, begin = who[pick], np.repeat(at[cut], n) - places[pick]
            row = np.repeat(np.searchsorted(offsets, at[cut], side="right") - 1, n)
            d = most[item]
            fits = (begin >= offsets[row] - d) & (begin + size[item] <= offsets[row + 1] + d)
            place = (begin - offsets[row] + d) // step(d)
            codes.append(np.unique(((item * rows + row) * wide + place)[fits]))
    code = np.unique(np.concatenate(codes))
    return np.stack([code // wide // rows, code // wide % rows, code % wide], 1)


def step(d):
    """Candidates whose beginnings are this near are verified together."""
    return np.maximum(d, 1)


def matches(column: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first byte, end) of the best stretch of each row for each item it holds."""
    data, offsets, stood = normalised(column)
    if not len(data) or not items.ids:
        return []
    keys = gram_keys(data, {Q, *items.pieces, *items.short})
    found, slots, mine_only = candidates(keys, offsets, items), slots_of(keys[Q]), np.zeros(1 << GRAM_BITS, bool)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep_best(r: int, item: int, distance: int, begin: int, end: int) -> None:
        new = (distance, int(stood[begin]), int(stood[end - 1]) + 1)
        if (r, item) not in best or new < best[r, item]:
            best[r, item] = new

    def shares_grams(begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, need: int) -> np.ndarray:
        """Whether the bytes there hold as many of these Q-grams as a match must."""
        mine_only[wanted] = True
        reach = np.arange(int((end - begin).max()) - Q + 1)
        out = [np.zeros(0, bool)]
        for part in np.array_split(np.arange(len(begin)), 1 + len(begin) * len(reach) // HELD):
            cells = begin[part, None] + reach
            there = cells <= end[part, None] - Q
            out.append((mine_only[slots[np.minimum(cells, len(slots) - 1)]] & there).sum(1) >= need)
        mine_only[wanted] = False
        return np.concatenate(out)

    for r, item, at in verbatim(data, keys, offsets, items):
        keep_best(r, item, 0, at, at + len(items.texts[item]))
    for group in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else []:
        item, rows = int(group[0, 0]), group[:, 1]
        text = np.frombuffer(items.texts[item], np.uint8)
        m, d = len(text), edits(len(text))
        lead = offsets[rows] - d + group[:, 2] * step(d)
        # a stretch begins within d bytes of one of the step(d) places from lead on
        begin = np.maximum(lead - d, offsets[rows])
        end = np.minimum(lead + step(d) - 1 + m + d, offsets[rows + 1])
        near = np.flatnonzero(shares_grams(begin, end, items.slots[item], m - Q + 1 - Q * d))
        rows, begin, end = rows[near], begin[near], end[near]
        # a verbatim stretch is as good as can be: the first one of a row settles it
        for r, a, b in zip(rows.tolist(), begin.tolist(), end.tolist()):
            if (r, item) not in best and (at := data[a:b].tobytes().find(items.texts[item])) >= 0:
                keep_best(r, item, 0, a + at, a + at + m)
        left = np.flatnonzero([(r, item) not in best for r in rows.tolist()])
        if not len(left):
            continue
        for some in np.array_split(left, 1 + len(left) * (m + 4 * d) // HELD):
            cells = begin[some, None] + np.arange(int((end - begin)[some].max()))
            regions = data[np.minimum(cells, len(data) - 1)]
            got, spans = distances(text, regions, end[some] - begin[some], d)
            for i in np.flatnonzero(got <= d).tolist():
                keep_best(int(rows[some[i]]), item, int(got[i]), *(int(begin[some[i]]) + spans[i]).tolist())
    return sorted((r, item, *found) for (r, item), found in best.items())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes, start_byte, end_byte) for each document and item that it holds.

    docs has doc_id and text, benchmark item_id and text. One row a document row and item: the stretch
    of least distance, then the earliest; bytes are those of the document's text. Null and empty texts
    hold nothing, items without letters or digits are held by nothing. Repeated documents or items give
    repeated rows. Other columns are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(items: Items) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = matches(batch.column("text"), items)
            doc = batch.column("doc_id").to_pylist()
            columns = [[doc[r] for r, *_ in rows], [items.ids[i] for _, i, *_ in rows], [x[2] for x in rows], [len(items.texts[x[1]]) for x in rows], [x[3] for x in rows], [x[4] for x in rows]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in OUT.split(", ")])

        return mapped(docs, OUT, run, limit=2 * CHUNK_BYTES)

    return reduce(DataFrame.unionAll, [search(items) for items in blocks(benchmark)])


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, so many bytes at a time; an empty benchmark is one empty block."""
    ids, texts, held, count = [], [], 0, 0
    for item in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(item.item_id)
        texts.append(item.text)
        held += len((item.text or "").encode())
        if held >= BLOCK_BYTES:
            yield index(ids, texts)
            ids, texts, held, count = [], [], 0, count + 1
    if ids or not count:
        yield index(ids, texts)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item, each judged by its own text, whether it has a doc_id or not.

    Null and empty texts stay, very long ones are searched whole, each of several equal rows is judged
    alike. Columns may have any names; empty tables of either kind take nothing away. All blocks of
    items are looked for in one scan.
    """

    def clean(docs: DataFrame, items: Items) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in matches(batch.column("text"), items)]] = False
            return batch.filter(pa.array(keep))

        return mapped(docs, docs.schema, run, limit=2 * CHUNK_BYTES)

    return reduce(clean, blocks(benchmark), docs)
