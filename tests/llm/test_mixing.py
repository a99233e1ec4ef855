import hashlib
import heapq

import numpy as np
import pytest

from tidewater.llm.mixing import apportion, mix, mixed, targets

SCHEMA = "doc_id long, text string, source string, size string"


def wanted(sizes, share=1.5, cap=2.0):
    weights = np.array([[3, 1, 2][i % 3] for i in range(len(sizes))], float)
    sizes, fixed = np.array(sizes, float), np.zeros(len(sizes), bool)
    while True:
        left = sizes.sum() * share - cap * sizes[fixed].sum()
        t = np.where(fixed, cap * sizes, left * weights / max(weights[~fixed].sum(), 1e-9))
        over = (t > cap * sizes + 1e-9) & ~fixed
        if not over.any():
            return t
        fixed |= over


def corpus():
    rows = [(i, "w " * (i % 37), f"s{i % 7}", "x") for i in range(900)]
    rows += [(1000 + i, "hot word here " * 9, "hot", "x") for i in range(600)] + [(2000 + i, "a b c", None, None) for i in range(30)]
    return rows + [(3000, None, "s1", None), (3001, "", "é", None), (3002, "one", "", None), (7, "again again", "s0", None), (None, "no id", "s2", None)]


def test_targets_and_taken(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, wanted([sizes[s] for s in order])))
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), s
    again = mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and key
    assert mix(df.limit(0)).count() == 0


def test_mixed_keeps_columns(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = mixed(df)
    assert out.columns == df.columns and out.schema["size"].dataType.simpleString() == "string"
    assert 900 < out.count() < 4000


def test_quotas_are_those_of_highest_quotients(spark):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate((5, 40, 1000, 333, 7, 90))], "source string, source_size long")
    rows = apportion(targets(df, 1.5, 2.0), 7).collect()
    total = sum(r.target for r in rows)
    block = rows[0].block
    for shard in range(1, 8):
        house = int(total / block + 0.5) * shard // 7
        seats, heap = {r["at"]: 0 for r in rows}, [(-r.target, r["at"], r.target) for r in rows]
        heapq.heapify(heap)
        for _ in range(house):
            _, at, t = heapq.heappop(heap)
            seats[at] += 1
            heapq.heappush(heap, (-t / (2 * seats[at] + 1), at, t))
        assert {r["at"]: sum(r.shard_quotas[:shard]) for r in rows} == seats


def by_hand(rows, shards=16, seed=20):
    """(words of each row that each shard takes, source targets), by walking through every block: no closed forms."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    target = dict(zip(order, wanted([sizes[s] for s in order])))
    block = max(1, int(min(t for t in target.values() if t > 0) // 256))
    seats = int(sum(target.values()) / block + 0.5)
    owner, held = [], dict.fromkeys(order, 0)
    heap = [(-t, i, s) for i, (s, t) in enumerate(target.items()) if t > 0]
    heapq.heapify(heap)
    for seat in range(seats):
        _, i, s = heapq.heappop(heap)
        owner.append((next(h for h in range(shards) if seat < seats * (h + 1) // shards), s))
        held[s] += 1
        heapq.heappush(heap, (-target[s] / (2 * held[s] + 1), i, s))
    taken = [[0] * shards for _ in rows]
    for source in order:
        mine = sorted((i for i, r in enumerate(rows) if r[2] == source), key=lambda i: hashlib.md5(f"{seed}|{'' if rows[i][0] is None else rows[i][0]}|{rows[i][1] or ''}".encode()).hexdigest())
        words = [i for i in mine for _ in (rows[i][1] or "").split()]
        blocks = [words[a : a + block] for a in range(0, len(words), block)] or [[]]
        at = 0
        for shard, s in owner:
            if s == source:
                for i in blocks[at % len(blocks)]:
                    taken[i][shard] += 1
                at += 1
    return taken, target


def test_taken_matches_a_walk_through_all_blocks(spark):
    rows = [r[:3] for r in corpus() if r[0] not in (7, 3000)] + [(5000, "long " * 20000, "hot")]
    rows = list(dict.fromkeys(rows))
    taken, _ = by_hand(rows)
    got = mix(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)).collect()
    want = sorted((str(r[0]), str(r[2]), len((r[1] or "").split()), t) for r, t in zip(rows, taken))
    assert sorted((str(r.doc_id), str(r.source), r["size"], r.shard_taken) for r in got) == want
    assert all(sum(r.shard_taken) == r.taken for r in got)


def test_mixed_comes_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 41), f"s{i % 5}", "x") for i in range(4000)] + [(9000 + i, "long " * 3000, "s1", "x") for i in range(3)]
    out = mixed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    _, target = by_hand([r[:3] for r in rows])
    got, longest = dict.fromkeys(target, 0), dict.fromkeys(target, 0)
    for r in out:
        got[r.source] += len(r.text.split())
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    for s, t in target.items():
        assert abs(got[s] - t) <= max(0.01 * t, longest[s] / 2 + 0.005 * t), s
    assert max(sum(r.doc_id == d for r in out) for d in (0, 1, 2, 3, 4, 9000)) <= 2


def test_columns_of_any_name_are_kept(spark):
    names = ["block", "quota", "_key", "_run", "_s", "_n", "_before", "_start", "target", "_times", "_document", "a.b"]
    df = spark.createDataFrame([(i, "one two", "s", *[str(i)] * 12) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixed(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in df.collect()}
    assert mix(df).where("taken < 2").count() == 0
