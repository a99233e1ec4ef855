"""Exact removal of repeated strings across documents by suffix arrays.

A byte goes if a SPAN-byte string that covers it also starts in a document of smaller doc_id.

1. Each window of SPAN bytes has an anchor: the K-gram in it of least hash, the leftmost of equals. Equal
   windows have equal anchors, so only anchors that stand in two documents matter. A row carries the
   anchors of a chunk of texts that fall into one bucket, packed; documents of one chunk that share an
   anchor are reduced to one of them before anything moves.
2. Around each shared anchor the run of windows that it stands for is cut out. Equal cut-outs of a bucket
   of documents are reduced to one, with the least doc_id. The cut-outs of an anchor that differ are put
   end to end (lanes of bounded length) and their suffix array is built by linear grouping (gsaca.py);
   neighbours in it that agree in SPAN bytes are equal windows, and the least document owns them. Lanes
   of one anchor are merged by their sorted windows.
3. Windows owned by a smaller document are marked, and their bytes removed.

Every step works on buckets whose number follows the size of the table, and ends in a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytes_np as B
from tidewater.llm.common import Scratch, bucket_count, chunks, small_batches
from tidewater.llm.gsaca import ragged, suffix_arrays

U64 = np.uint64
SPAN, K = 50, 20
#: Text bytes of a bucket, letters of a lane, and letters of all lanes sorted at once.
BUCKET_BYTES, LANE, LANES = 8 << 20, 1024, 1 << 20
#: A packed row: `at` is where it goes; the rest are arrays as bytes.
PACKED = "at int, kind int, source int, docs binary, counts binary, a binary, b binary, c binary, d binary"
FIELDS = [f.split() for f in PACKED.split(", ")]
SCHEMA = pa.schema([(name, pa.int32() if kind == "int" else pa.binary()) for name, kind in FIELDS])
FOUND, OWNED = 0, 1


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all lowest ones first: high bytes of small numbers lie together and shrink to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def numbers(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], SCHEMA.field(i).type) for i in range(len(SCHEMA))], schema=SCHEMA)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each anchor's run of windows, in the order of the text."""
    n = len(data) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none.astype(U64), none, none
    prefix = B.prefix_hash(data)
    at = np.arange(len(data) - K + 1)
    value = B.mix((prefix[K:] - prefix[:-K]) * B.inverse_powers(at))
    least, where, width = value, at.astype(np.int32), 1
    size = SPAN - K + 1
    while width < size:
        step = min(width, size - width)
        later = least[step:] < least[:-step]
        where = np.where(later, where[step:], where[:-step])
        least = np.where(later, least[step:], least[:-step])
        width += step
    valid = np.ones(n, bool)
    ends = offsets[1:-1]
    # windows that run into the next text
    for back in range(1, SPAN):
        cut = ends - back
        valid[cut[(cut >= 0) & (cut < n)]] = False
    valid &= np.arange(n) < offsets[-1] - SPAN + 1
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (where[1:n] != where[: n - 1])
    first = np.flatnonzero(begin)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (where[1:n] != where[: n - 1])
    return value[where[first]], first, np.flatnonzero(stop) + 1 - first


def spread(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1, by chunk of texts: a packed row for each bucket of anchors."""
    for batch in batches:
        for part in chunks(batch):
            data, offsets = B.text_buffer(part.column("text"))
            value, first, count = anchors(data, offsets)
            row = np.searchsorted(offsets, first, side="right") - 1
            doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            at = (first - offsets[:-1][row]).astype(np.uint32)
            bucket = (value % U64(buckets)).astype(np.int64)
            order = np.lexsort((doc[row], value))
            lead = np.ones(len(order), bool)
            lead[1:] = value[order[1:]] != value[order[:-1]]
            group = np.cumsum(lead) - 1
            least = doc[row[order[lead]]][group] if len(order) else doc[:0]
            # anchors that documents of this chunk share: only the least document's go on to be compared
            other = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
            other[group[doc[row[order]] != least]] = True
            shared = np.zeros(len(order), bool)
            shared[order] = other[group]
            goes = np.zeros(len(order), bool)
            goes[order] = doc[row[order]] == least
            key = (value // U64(buckets)).astype(U64)
            rows = []
            for chosen, kind in ((np.flatnonzero(goes), FOUND), (np.flatnonzero(shared), OWNED)):
                by = chosen[np.argsort(bucket[chosen], kind="stable")]
                edges = np.flatnonzero(np.diff(bucket[by])) + 1
                for some in np.split(by, edges):
                    if len(some):
                        r, start, n = np.unique(row[some], return_index=True, return_counts=True)
                        low = np.ascontiguousarray(key[some].view(np.uint8).reshape(-1, 8)[:, :5])
                        rows.append((int(bucket[some[0]]), kind, 0, planes(doc[r]), planes(n.astype(np.int32)), low.tobytes(), planes(at[some]), count[some].astype(np.uint8).tobytes(), b""))
            if rows:
                yield pack(rows)


def unpack(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(doc, key, place, windows) of all entries of packed rows."""
    docs, keys, at, count = [], [], [], []
    for r in rows:
        docs.append(np.repeat(numbers(r["docs"], np.int64), numbers(r["counts"], np.int32)))
        five = np.frombuffer(r["a"], np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        keys.append(wide.view(U64).ravel())
        at.append(numbers(r["b"], np.uint32))
        count.append(np.frombuffer(r["c"], np.uint8))
    join = lambda x, empty: np.concatenate(x) if x else empty
    return join(docs, np.zeros(0, np.int64)), join(keys, np.zeros(0, U64)), join(at, np.zeros(0, np.uint32)), join(count, np.zeros(0, np.uint8))


def by_place(batches: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by `at`: calls handle(at, rows) once for each."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["at"] != now:
                if rows:
                    yield from handle(now, rows)
                now, rows = r["at"], []
            rows.append(r)
    if rows:
        yield from handle(now, rows)


def place_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return (B.mix(doc.view(U64) + U64(0x632BE59BD9B4E019)) % U64(buckets)).astype(np.int64)


def compare(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1, by bucket of anchors: the anchors that stand in two documents, sent to the documents' buckets."""

    def handle(at: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, keys, place, count = unpack([r for r in rows if r["kind"] == FOUND])
        order = np.lexsort((docs, keys))
        lead = np.ones(len(order), bool)
        lead[1:] = keys[order[1:]] != keys[order[:-1]]
        group = np.cumsum(lead) - 1
        who = docs[order]
        several = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
        several[group[who != who[lead][group]]] = True
        chosen = np.sort(order[several[group]])
        more = unpack([r for r in rows if r["kind"] == OWNED])
        docs, keys, place, count = (np.concatenate([x[chosen], y]) for x, y in zip((docs, keys, place, count), more))
        if not len(docs):
            return
        goes = place_of(docs, buckets)
        order = np.lexsort((place, docs, goes))
        out = []
        for some in np.split(order, np.flatnonzero(np.diff(goes[order])) + 1):
            own = docs[some]
            new = np.ones(len(some), bool)
            new[1:] = own[1:] != own[:-1]
            heads = np.flatnonzero(new)
            low = np.ascontiguousarray(keys[some].view(np.uint8).reshape(-1, 8)[:, :5])
            out.append((int(goes[some[0]]), FOUND, at, planes(own[heads]), planes(np.diff(np.append(heads, len(some))).astype(np.int32)), low.tobytes(), planes(place[some]), count[some].tobytes(), b""))
        yield pack(out)

    yield from by_place(batches, handle)


def cut_outs(texts: pa.Table, rows: list[dict]):
    """The different cut-outs of a bucket of documents, in an order that depends on the bucket alone.

    (bytes, offsets, anchor bucket, key, least doc, greatest doc) of each, then for every cut-out place
    its number, the document row and the first window; last the texts' bytes, offsets and the row order.
    """
    column = texts.column("text").combine_chunks() if isinstance(texts.column("text"), pa.ChunkedArray) else texts.column("text")
    data, offsets = B.text_buffer(column)
    doc = texts.column("doc_id").to_numpy().astype(np.int64)
    docs, keys, place, count = unpack(rows)
    source = np.repeat(np.array([r["source"] for r in rows], np.int64), [len(r["c"]) for r in rows])
    # every row of a doc_id takes part: a cut-out that another text of the same id named holds true windows all the same
    order = np.argsort(doc, kind="stable")
    low, high = np.searchsorted(doc[order], docs, "left"), np.searchsorted(doc[order], docs, "right")
    times = high - low
    pick = np.repeat(np.arange(len(docs)), times)
    row = order[ragged(low, times)] if len(pick) else np.zeros(0, np.int64)
    inside = place[pick].astype(np.int64) + count[pick] + SPAN - 1 <= np.diff(offsets)[row]
    pick, row = pick[inside], row[inside]
    key, src, at, windows = keys[pick], source[pick], place[pick].astype(np.int64), count[pick].astype(np.int64)
    size = windows + SPAN - 1
    begin = offsets[:-1][row] + at
    prefix = B.prefix_hash(data)
    content = B.span_hash(prefix, begin, begin + size) if len(begin) else np.zeros(0, U64)
    order2 = np.lexsort((row, at, doc[row], content, key, src))
    same = np.zeros(len(order2), bool)
    a, b = order2[1:], order2[:-1]
    same[1:] = (src[a] == src[b]) & (key[a] == key[b]) & (content[a] == content[b]) & (size[a] == size[b])
    # a place can be named twice: by its chunk and by its bucket
    number = np.cumsum(~same) - 1
    heads = order2[~same]
    owners = doc[row[order2]]
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(owners, starts) if len(starts) else owners
    most = np.maximum.reduceat(owners, starts) if len(starts) else owners
    return (begin[heads], size[heads], src[heads], key[heads], least, most), (number, row[order2], at[order2]), (data, offsets, doc)


def split_table(texts: pa.Table, rows: pa.Table) -> tuple[pa.Table, list[dict], list[dict]]:
    every = sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["source"], r["docs"], r["b"]))
    return texts, [r for r in every if r["kind"] == FOUND], [r for r in every if r["kind"] == OWNED]


def send_cut_outs(key, texts: pa.Table, rows: pa.Table) -> pa.Table:
    """Step 2, by bucket of documents: its different cut-outs, to the buckets of their anchors."""
    texts, found, _ = split_table(texts, rows)
    out = []
    if found and texts.num_rows:
        (begin, size, src, keys, least, most), _, (data, _, _) = cut_outs(texts, found)
        at = key[0].as_py()
        for some in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(src)) + 1):
            if len(some):
                low = np.ascontiguousarray(keys[some].view(np.uint8).reshape(-1, 8)[:, :5])
                spots = pa.compress(data[ragged(begin[some], size[some])].tobytes(), codec="zstd", asbytes=True)
                out.append((int(src[some[0]]), FOUND, at, planes(least[some]), planes(some.astype(np.int32)), low.tobytes(), planes(most[some]), size[some].astype(np.uint8).tobytes(), spots))
    return pa.Table.from_batches([pack(out)], SCHEMA) if out else SCHEMA.empty_table()


def owners_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of every cut-out (in order): the least document that has it. group: cut-outs of one anchor, ascending."""
    windows = size - SPAN + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(least, windows)
    # lanes: cut-outs of one group end to end, a separator behind each, a least letter at the end
    grown = np.cumsum(size + 1)
    group_start = np.ones(len(group), bool)
    group_start[1:] = group[1:] != group[:-1]
    base = (grown - size - 1)[group_start][np.cumsum(group_start) - 1]
    piece = (grown - size - 1 - base) // LANE
    lane_start = group_start.copy()
    lane_start[1:] |= piece[1:] != piece[:-1]
    lane = np.cumsum(lane_start) - 1
    lane_first = np.append(np.flatnonzero(lane_start), len(size))
    lane_size = np.add.reduceat(size + 1, lane_first[:-1]) + 1
    keys, values, places = [], [], []
    order = np.argsort(lane_size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(lane_size[order]) // LANES)) + 1):
        if not len(part):
            continue
        cut = ragged(lane_first[part], lane_first[part + 1] - lane_first[part])
        width = size[cut] + 1
        lane_of = np.repeat(np.arange(len(part)), lane_first[part + 1] - lane_first[part])
        offsets = np.concatenate([[0], np.cumsum(lane_size[part])])
        stands = np.cumsum(width) - width + lane_of  # a final letter for each lane before
        letters = np.zeros(int(offsets[-1]), np.int64)
        inner = ragged(stands, size[cut])
        letters[inner] = data[ragged(begin[cut], size[cut])].astype(np.int64) + 2
        letters[stands + size[cut]] = 1
        ranked = suffix_arrays(letters, offsets)
        window = np.full(len(letters), -1, np.int64)
        window[ragged(stands, windows[cut])] = ragged(first[cut], windows[cut])
        ranked = ranked[window[ranked] >= 0]
        rank_lane = np.searchsorted(offsets, ranked, side="right") - 1
        byte = (letters - 2).astype(np.uint8)
        equal = np.zeros(len(ranked), bool)
        for block in range(1, len(ranked), 1 << 16):
            i = np.arange(block, min(len(ranked), block + (1 << 16)))
            span = np.arange(SPAN)
            equal[i] = (rank_lane[i] == rank_lane[i - 1]) & (byte[ranked[i][:, None] + span] == byte[ranked[i - 1][:, None] + span]).all(1)
        heads = np.flatnonzero(~equal)
        run = np.cumsum(~equal) - 1
        mine = window[ranked]
        got = np.minimum.reduceat(owner[mine], heads) if len(heads) else owner[:0]
        owner[mine] = got[run]
        # an anchor with several lanes: equal windows of different lanes are found among the runs
        wide = np.zeros(len(part), bool)
        g = group[lane_first[part]]
        wide[:] = np.isin(g, split_groups(group, lane_start, group_start))
        head_lane = rank_lane[heads]
        for h in heads[wide[head_lane]].tolist():
            keys.append(int(g[rank_lane[h]]).to_bytes(8, "big") + byte[ranked[h] : ranked[h] + SPAN].tobytes())
        chosen = wide[rank_lane]
        values.append(got[wide[head_lane]])
        renumber = np.cumsum(wide[head_lane]) - 1
        places.append((mine[chosen], renumber[run[chosen]] + sum(len(v) for v in values[:-1])))
    if keys:
        merged: dict[bytes, int] = {}
        every = np.concatenate(values)
        for k, v in zip(keys, every.tolist()):
            if v < merged.get(k, v + 1):
                merged[k] = v
        best = np.array([merged[k] for k in keys], np.int64)
        for mine, run in places:
            owner[mine] = best[run]
    return owner


def split_groups(group: np.ndarray, lane_start: np.ndarray, group_start: np.ndarray) -> np.ndarray:
    """Groups that take more than one lane."""
    return np.unique(group[lane_start & ~group_start])


def find_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, by bucket of anchors: the owners of windows that are not the bucket of documents' own."""

    def handle(at: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r["source"])
        n = [len(r["c"]) for r in rows]
        back = np.repeat([r["source"] for r in rows], n)
        local = np.concatenate([numbers(r["counts"], np.int32) for r in rows])
        smallest = np.concatenate([numbers(r["docs"], np.int64) for r in rows])
        greatest = np.concatenate([numbers(r["b"], np.int64) for r in rows])
        keys = np.zeros((len(local), 8), np.uint8)
        keys[:, :5] = np.concatenate([np.frombuffer(r["a"], np.uint8).reshape(-1, 5) for r in rows])
        keys = keys.view(U64).ravel()
        size = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in rows]).astype(np.int64)
        data = np.frombuffer(b"".join(pa.decompress(r["d"], int(np.frombuffer(r["c"], np.uint8).sum(dtype=np.int64)), codec="zstd", asbytes=True) for r in rows), np.uint8)
        begin = np.cumsum(size) - size
        content = B.span_hash(B.prefix_hash(data), begin, begin + size)
        order = np.lexsort((size, content, keys))
        a, b = order[1:], order[:-1]
        new = np.ones(len(order), bool)
        new[1:] = (keys[a] != keys[b]) | (content[a] != content[b]) | (size[a] != size[b])
        heads = order[new]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(smallest[order], np.flatnonzero(new))
        group = np.cumsum(np.concatenate([[True], keys[heads][1:] != keys[heads][:-1]])) - 1
        windows = size[heads] - SPAN + 1
        first = np.concatenate([[0], np.cumsum(windows)])
        owner = np.repeat(least, windows)
        alone = np.bincount(group)[group] == 1
        mixed = np.flatnonzero(~alone)
        if len(mixed):
            owner[ragged(first[mixed], windows[mixed])] = owners_of(data, begin[heads[mixed]], size[heads[mixed]], group[mixed], least[mixed])
        # runs of windows with one owner, for each cut-out of each bucket of documents that holds a greater document
        change = np.ones(len(owner), bool)
        change[1:] = owner[1:] != owner[:-1]
        change[first[:-1]] = True
        run_at = np.flatnonzero(change)
        run_end = np.append(run_at[1:], len(owner))
        run_first = np.searchsorted(run_at, first)
        times = np.diff(run_first)[kind]
        which = np.repeat(np.arange(len(kind)), times)
        run = ragged(run_first[kind], times)
        useful = owner[run_at[run]] < greatest[which]
        which, run = which[useful], run[useful]
        start = run_at[run] - first[kind[which]]
        stop = run_end[run] - first[kind[which]]
        out = []
        for some in np.split(np.arange(len(which)), np.flatnonzero(np.diff(back[which])) + 1):
            if len(some):
                out.append((int(back[which[some[0]]]), OWNED, at, b"", planes(local[which[some]].astype(np.int32)), planes(owner[run_at[run[some]]].astype(np.int64)), start[some].astype(np.uint8).tobytes(), stop[some].astype(np.uint8).tobytes(), b""))
        if out:
            yield pack(out)

    yield from by_place(batches, handle)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal(texts: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, docs, whether each byte goes) of a bucket of documents."""
    texts, found, owned = split_table(texts, rows)
    if not found:
        column = texts.column("text").combine_chunks() if isinstance(texts.column("text"), pa.ChunkedArray) else texts.column("text")
        data, offsets = B.text_buffer(column)
        return data, offsets, texts.column("doc_id").to_numpy().astype(np.int64), np.zeros(len(data), bool)
    _, (number, row, at), (data, offsets, doc) = cut_outs(texts, found)
    depth = np.zeros(len(data) + 1, np.int32)
    if owned:
        local = np.concatenate([numbers(r["counts"], np.int32) for r in owned]).astype(np.int64)
        owner = np.concatenate([numbers(r["a"], np.int64) for r in owned])
        start = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in owned]).astype(np.int64)
        stop = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in owned]).astype(np.int64)
        first = np.searchsorted(number, np.arange(int(number[-1]) + 2))
        times = np.diff(first)[local]
        which = np.repeat(np.arange(len(local)), times)
        place = ragged(first[local], times)
        hit = owner[which] < doc[row[place]]
        which, place = which[hit], place[hit]
        begin = offsets[:-1][row[place]] + at[place]
        np.add.at(depth, begin + start[which], 1)
        np.add.at(depth, begin + stop[which] + SPAN - 1, -1)
    return data, offsets, doc, np.cumsum(depth[:-1]) > 0


def digest(key, texts: pa.Table, rows: pa.Table) -> pa.Table:
    """Step 3, by bucket of documents."""
    data, offsets, doc, gone = removal(texts, rows)
    total = np.concatenate([[0], np.cumsum(gone)])
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edge = offsets[:-1][offsets[:-1] < len(gone)]
    begin[edge] = gone[edge]
    spans = np.concatenate([[0], np.cumsum(begin)])
    kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(total[offsets]), pa.int64()), "n_spans": pa.array(np.diff(spans[offsets]), pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


def trimmed(key, texts: pa.Table, rows: pa.Table) -> pa.Table:
    data, offsets, doc, gone = removal(texts, rows)
    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.table({"doc_id": texts.column("doc_id"), "kept": pa.array(kept, pa.binary())})


def _by_document(docs: DataFrame, function, schema: str) -> DataFrame:
    """Runs the steps and applies `function` to every bucket of documents and what is known about it."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    buckets = bucket_count(docs, BUCKET_BYTES)
    arrange = lambda df: df.repartition(buckets, "at").sortWithinPartitions("at")
    shared = scratch.cut(arrange(docs.mapInArrow(lambda it: spread(it, buckets), PACKED)).mapInArrow(lambda it: compare(it, buckets), PACKED))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place_of(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["at", *batch.schema.names])

    def texts():
        return docs.mapInArrow(placed, "at int, doc_id long, text string").repartition(buckets, "at").groupBy("at")
    owned = scratch.cut(arrange(texts().cogroup(shared.repartition(buckets, "at").groupBy("at")).applyInArrow(send_cut_outs, PACKED)).mapInArrow(find_owners, PACKED))
    known = shared.unionAll(owned)
    return texts().cogroup(known.repartition(buckets, "at").groupBy("at")).applyInArrow(function, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text).

    Texts are UTF-8 bytes (null: empty); matches never cross documents and are judged on the input; rows
    of one doc_id are no smaller than each other, so none removes from another. Rows without doc_id
    neither match nor lose anything. Other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    unnamed = docs.where("doc_id is null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")
    )
    return _by_document(docs, digest, RESULT).unionAll(unnamed)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): each document's bytes without the repeated ones (a character may be cut, so they are binary)."""
    return _by_document(docs, trimmed, "doc_id long, kept binary").unionAll(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")))
