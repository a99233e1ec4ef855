"""Near-duplicate groups by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of COLLECTION half-keys are made, each half-key from HALF minhashes; a table key
combines one half-key of either collection. So 2 * 10 * 3 = 60 minhashes give 10 * 10 tables of
6 minhashes each, where separate tables would need 600. A pair of similarity s shares a key with
probability (1 - (1 - s**3)**10)**2: 0.9985 at 0.8, 0.9999 at 0.85, 0.006 at 0.2.

1. One pass over the texts makes each document's set size, set fingerprint and keys. Among some 10,000
   documents at a time, copies and documents that share a key are reduced to one before anything moves:
   so the rows of a hot key are few, whatever share of the documents have it.
2. Documents that share a key are candidates for a link to the key's least document, its leader. Each
   candidate is compared with its leaders exactly, on full sets; a leader's candidates are dealt to
   parts of bounded size.
3. Clusters that candidates join but no link does make families, which are compared as a whole: what is
   outside of a family's largest cluster with all of the family, block by block of bounded size,
   exactly, by an inverted index. Nothing is capped, and no pairs are written out, only the links that
   a spanning forest needs.
4. Confirmed links and equal fingerprints give the final components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import bytes_np as B
from tidewater.llm.common import Scratch, chunks, small_batches
from tidewater.llm.graph import components
from tidewater.llm.shingles import shingle_sets

U64 = np.uint64
COLLECTION, HALF = 10, 3
#: A block of a family holds about so many shingles and documents at most.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 18, 512
#: Keys that are combined before anything moves: those of some 10,000 documents.
HELD = 1 << 20
SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, copy_of long, links array<long>, keys array<long>"


def tensored_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of COLLECTION**2 table keys for each (non-empty) set; starts: where each set begins."""
    count = 2 * COLLECTION * HALF
    seeds = B.mix(np.arange(1, 2 * count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    halves = np.zeros((2 * COLLECTION, len(starts)), U64)
    for i in range(count):
        least = np.minimum.reduceat(hashes * (seeds[i] | U64(1)) + seeds[count + i], starts)
        halves[i // HALF] = B.mix(halves[i // HALF] * U64(0x9FB21C651E98DF25) + least)
    left, right = halves[:COLLECTION], halves[COLLECTION:]
    table = np.arange(COLLECTION * COLLECTION, dtype=U64).reshape(COLLECTION, COLLECTION, 1)
    keys = left[:, None, :] * U64(0xC2B2AE3D27D4EB4F) + right[None, :, :] * U64(0x165667B19E3779F9) + table
    return B.mix(keys.reshape(COLLECTION * COLLECTION, len(starts)).T.copy())


def sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Sizes, fingerprints and keys of a partition's rows, about HELD keys at a time.

    Among these, copies go on as their least document alone, and of documents that share a key only the
    least keeps it; the others say whom they share it with. So a hot key or fingerprint is a row for
    each HELD keys of the table.
    """
    held, count = [], 0
    for batch in batches:
        for part in chunks(batch):
            hashes, offsets = shingle_sets(part.column("text"), words)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            fp = np.zeros((2, len(sizes)), U64)
            keys = np.zeros((len(sizes), COLLECTION * COLLECTION), U64)
            if len(full):
                starts = offsets[:-1][full]
                fp[0, full] = B.mix(np.add.reduceat(B.mix(hashes), starts) + sizes[full].astype(U64))
                fp[1, full] = np.add.reduceat(B.mix(hashes ^ U64(0x5851F42D4C957F2D)), starts)
                keys[full] = tensored_keys(hashes, starts)
            held.append((part.column("doc_id"), sizes, fp, keys))
            count += keys.size
            if count >= HELD:
                yield combined(held)
                held, count = [], 0
    if held:
        yield combined(held)


def combined(held: list[tuple]) -> pa.RecordBatch:
    ids = pa.concat_arrays([x[0] for x in held]).cast(pa.int64())
    sizes, fp, keys = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held], 1), np.concatenate([x[3] for x in held])
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
    nodes = np.flatnonzero((sizes > 0) & np.asarray(ids.is_valid()))
    # copies: only the least document goes on
    order = nodes[np.lexsort((doc[nodes], fp[1, nodes], fp[0, nodes]))]
    lead = np.ones(len(order), bool)
    lead[1:] = (fp[0, order[1:]] != fp[0, order[:-1]]) | (fp[1, order[1:]] != fp[1, order[:-1]])
    copy_of, known = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    copy_of[order] = doc[order[lead]][np.cumsum(lead) - 1]
    known[order] = True
    own = np.sort(order[lead])
    flat, who = keys[own].ravel(), np.repeat(own, keys.shape[1])
    o = np.lexsort((doc[who], flat))
    first = np.ones(len(o), bool)
    first[1:] = flat[o[1:]] != flat[o[:-1]]
    leader = doc[who[o[first]]][np.cumsum(first) - 1]
    same = o[~first]
    pairs = np.unique(np.stack([who[same], leader[~first]], 1), axis=0)
    pairs = pairs[doc[pairs[:, 0]] != pairs[:, 1]]
    stays = np.ones(len(flat), bool)
    stays[same] = False

    def lists(rows: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32()), pa.array(values, pa.int64()))

    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes, pa.int64()),
            pa.array(fp[0].view(np.int64)),
            pa.array(fp[1].view(np.int64)),
            pa.array(copy_of, pa.int64(), mask=~known),
            lists(pairs[:, 0], pairs[:, 1]),
            lists(who[stays], flat[stays].view(np.int64)),
        ],
        ["doc_id", "n_shingles", "fp1", "fp2", "copy_of", "links", "keys"],
    )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have 100 * intersection >= percent * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], percent: int, clusters: list | None = None, outside: list[bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: 100 * intersection >= percent * union.

    clusters: sets of one are known to be connected; outside: only links of these sets are looked for.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        return [(0, 1)] if similar(sets[0], sets[1], percent) else []
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    ranked, owner_ranked = every[order], owner[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    run_start = np.flatnonzero(new)
    run_of = np.empty(len(every), np.int64)
    run_of[order] = np.cumsum(new) - 1
    run_len = np.diff(np.append(run_start, len(ranked)))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    first: dict = {}
    for x, c in enumerate(clusters or []):
        parent[x] = first.setdefault(c, x)
    out, apart = [], len(set(clusters)) if clusters else len(sets)
    for x in range(len(sets)):
        if apart == 1:
            break
        if outside is not None and not outside[x]:
            continue
        runs = run_of[begin[x] : begin[x + 1]]
        runs = runs[run_len[runs] > 1]
        lengths = run_len[runs]
        if not len(runs):
            continue
        at = np.repeat(run_start[runs] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner_ranked[at], minlength=len(sets))
        for y in np.flatnonzero(100 * common >= percent * (sizes[x] + sizes - common)).tolist():
            if y != x and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
                apart -= 1
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def texts_of(batches: Iterator[pa.RecordBatch], words: int, names: tuple[str, ...]) -> Iterator[tuple]:
    """(the columns of these names, the shingle set) of each row, a bounded number of text bytes at a time."""
    for batch in batches:
        for part in chunks(batch):
            hashes, offsets = shingle_sets(part.column("text"), words)
            for r, row in enumerate(zip(*(part.column(c).to_pylist() for c in names))):
                yield row, hashes[offsets[r] : offsets[r + 1]]


def confirm_stars(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leader, part), the leader's own first: each other one is compared with it."""
    group, held, out = None, [], []
    for (doc, leader, part), found in texts_of(batches, words, ("doc_id", "leader", "part")):
        if (leader, part) != group:
            group, held = (leader, part), []
        if doc == leader:  # of several texts, any counts
            held.append(found.copy())
        elif any(similar(x, found, percent) for x in held):
            out.append((doc, leader))
            if len(out) == 1 << 14:
                yield _link_batch(out)
                out = []
    yield _link_batch(out)


def confirm_blocks(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (family, i, j): two blocks of a family at a time."""
    group, docs, clusters, outside, sets = None, [], [], [], []
    for (doc, cluster, out, *name), found in texts_of(batches, words, ("doc_id", "cluster", "outside", "family", "i", "j")):
        if name != group:
            if len(docs) > 1:
                yield _link_batch([(docs[x], docs[y]) for x, y in linked(sets, percent, clusters, outside)])
            group, docs, clusters, outside, sets = name, [], [], [], []
        docs.append(doc)
        clusters.append(cluster)
        outside.append(out)
        sets.append(found.copy())
    if len(docs) > 1:
        yield _link_batch([(docs[x], docs[y]) for x, y in linked(sets, percent, clusters, outside)])


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=LINKS)


def near_dup_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Links join documents whose sets of distinct `words`-word shingles have 100 * intersection >=
    percent * union. component_id is the least doc_id that links reach, kept says it is the row's own.
    Null or empty texts and texts without words have 0 shingles and are linked with nothing; a very long
    text is compared whole. Rows that repeat a doc_id are one document. Rows without doc_id are linked
    with nothing: their component_id is null and they are kept. An empty table gives an empty one; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    sketches = scratch.cut(docs.mapInArrow(lambda it: sketch(it, words), SKETCH))
    leads = sketches.where("copy_of = doc_id")

    def least_of(rows: DataFrame, key: list[str]) -> DataFrame:
        """(a, b): each row's document and the least one of its key, where that is another. A task holds one row at a time."""
        so_far = Window.partitionBy(*key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(F.col("doc_id").alias("a"), F.min("doc_id").over(so_far).alias("b")).where("a <> b")

    copies = sketches.where("copy_of <> doc_id").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b")).unionAll(least_of(leads.select("doc_id", "fp1", "fp2"), ["fp1", "fp2"]))
    shared = least_of(leads.select("doc_id", F.explode("keys").alias("key")), ["key"])
    candidates = scratch.cut(shared.unionAll(leads.select(F.col("doc_id").alias("a"), F.explode("links").alias("b"))).distinct())
    members = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # equal rows once; a join by doc_id and this need one exchange. Joined in one way at every size: who is a candidate has no bound
    texts = scratch.cut(docs.join(members.hint("merge"), "doc_id").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash"))
    stars = scratch.cut(_stars(texts, candidates, words, percent))
    clusters = scratch.cut(components(scratch, stars.unionAll(copies)))
    found = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    cluster = lambda end: found.select(F.col("doc_id").alias(end), F.col("component_id").alias(f"of_{end}"))
    apart = candidates.join(cluster("a"), "a", "left").join(cluster("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    apart = scratch.cut(apart.where("a <> b").distinct())
    if not apart.isEmpty():
        rest = scratch.cut(_unsettled(members, found, leads, components(scratch, apart)))
        edges = clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(scratch.cut(_blocks(texts, rest, words, percent)))
        found = components(scratch, edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
        scratch.drop(rest)
    for done in (texts, candidates, stars, apart):
        scratch.drop(done)
    out = sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _stars(texts: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """The candidates (a, b) that are links. A leader stands with at most about BLOCK_DOCS candidates in a part."""
    parts = candidates.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    roles = candidates.join(parts, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("leader"), part.alias("part"))
    own = parts.select(F.col("b").alias("doc_id"), F.col("b").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = texts.join(roles.unionAll(own).hint("merge"), "doc_id").repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("doc_id") != F.col("leader"))
    return rows.mapInArrow(lambda it: confirm_stars(it, words, percent), "a long, b long")


def _unsettled(members: DataFrame, found: DataFrame, leads: DataFrame, families: DataFrame) -> DataFrame:
    """(doc_id, family, cluster, outside, block, n_out, n_in) of families, which are clusters that candidates join.

    outside: not of the family's largest cluster. Either kind of document is dealt to blocks of its own.
    """
    named = members.join(found, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("cluster"))
    named = named.join(families.select(F.col("node").alias("cluster"), F.col("component").alias("family")), "cluster").join(leads.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]), "doc_id")
    sizes = named.groupBy("family", "cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = lambda n, shingles: F.greatest(F.lit(1), F.ceil(n / BLOCK_DOCS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    largest = F.max(F.struct("n", F.negative("cluster").alias("least"), "shingles"))
    whole = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), largest.alias("main"))
    plan = whole.select("family", F.negative("main.least").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("n_out"), blocks(F.col("main.n"), F.col("main.shingles")).alias("n_in"))
    outside = F.col("cluster") != F.col("main")
    block = F.pmod(F.xxhash64("doc_id"), F.when(outside, F.col("n_out")).otherwise(F.col("n_in"))).cast("int")
    return named.join(plan, "family").select("doc_id", "family", "cluster", outside.alias("outside"), block.alias("block"), "n_out", "n_in")


def _blocks(texts: DataFrame, rest: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of the documents outside of largest clusters. Pair (i, j) of blocks holds the outer block i and
    the inner block j, or, from n_in on, the outer block j - n_in; each pair of blocks meets once."""
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = rest.where("not outside").withColumn("i", F.explode(every("n_out"))).withColumn("j", F.col("block"))
    outer = rest.where("outside").withColumn("i", F.col("block")).withColumn("j", F.explode(every("n_in")))
    other = rest.where("outside").withColumn("_at", F.explode(every("n_out"))).where("_at <> block").withColumn("i", F.least("block", "_at")).withColumn("j", F.col("n_in") + F.greatest("block", "_at")).drop("_at")
    rows = texts.join(inner.unionByName(outer).unionByName(other).drop("block", "n_out", "n_in"), "doc_id")
    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lambda it: confirm_blocks(it, words, percent), "a long, b long")


def without_near_dups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the one of the least doc_id (rows without doc_id all stay).

    Rows that share a doc_id are told apart by a number of their own and compared like any others; of
    those in one group the least doc_id, then the least hash of a text stays. Null and empty texts stay,
    very long ones are compared whole. Columns may have any names; an empty table gives an empty one.
    """
    own = F.col("doc_id").cast("long")
    if docs.where(own.isNotNull()).groupBy(own).count().where("count > 1").isEmpty():
        gone = near_dup_groups(docs, words, percent).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    # written with their numbers, which stay the same however often the rows are read
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    rows = Scratch(docs.sparkSession).cut(docs.select(F.monotonically_increasing_id().alias("row"), document))
    known = rows.where("document.doc_id is not null")
    groups = near_dup_groups(known.select(F.col("row").alias("doc_id"), "document.text"), words, percent).select(F.col("doc_id").alias("row"), "component_id")
    places = known.select("row", F.struct(F.col("document.doc_id").cast("long").alias("doc"), F.xxhash64("document.text").alias("text"), "row").alias("place"))
    kept = groups.join(places, "row").groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
    return known.join(kept, "row", "left_semi").unionByName(rows.where("document.doc_id is null")).select("document.*")
