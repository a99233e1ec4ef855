import math
import zlib

import numpy as np

from tidewater.llm import sharding
from tidewater.llm.sharding import assign, draw, matrix, sharded

SCHEMA = "doc_id long, text string, shard string"


def test_matrix_sums_are_exact():
    parts = [0, 17, 1000, 3, 250, 1]
    m = matrix(parts, 8, 5)
    assert m.sum(1).tolist() == parts and (m >= 0).all()
    assert m.sum(0).max() - m.sum(0).min() <= 1
    assert (matrix(parts, 8, 5) == m).all() and (matrix(parts, 8, 6) != m).any()


def test_matrix_has_the_law_of_a_uniform_shuffle():
    draws = np.array([matrix([6, 4], 2, seed)[0, 0] for seed in range(3000)])
    # how many of 6 marked rows among 10 fall into the first 5
    want = {k: v / 252 for k, v in {1: 6, 2: 60, 3: 120, 4: 60, 5: 6}.items()}
    for k, p in want.items():
        assert abs((draws == k).mean() - p) < 0.04


def test_rows_law(spark):
    rows = [(i, f"text {i % 50} é", "old") for i in range(997)] + [(None, None, None), (5, "text 5 é", "old"), (5, "text 5 é", "old"), (9999, "y" * 300000, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = assign(df, 40).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(40)) and {len(v) for v in slots.values()} <= {25, 26}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {d: t or "" for d, t, _ in rows}
    for r in got:
        t = texts[r.doc_id].encode()
        assert r["size"] == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
    key = lambda x: sorted(map(str, x))
    assert key(assign(df.repartition(3), 40).collect()) == key(got)
    whole = sharded(df, 40)
    assert whole.columns == ["doc_id", "text", "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in whole.collect()) == sorted((r.shard, r.slot) for r in got)
    assert assign(df.limit(0), 40).count() == 0 and sharded(df.limit(0), 40).count() == 0


def test_draws_from_large_populations_have_the_law():
    rng = np.random.default_rng(3)
    got = np.bincount([draw(rng, 10, 10**9, 5 * 10**7) for _ in range(4000)], minlength=11) / 4000
    want = [math.comb(10, k) * 0.05**k * 0.95 ** (10 - k) for k in range(11)]  # as good as binomial there
    assert np.abs(got - want).max() < 0.03
    many = np.array([draw(rng, 25 * 10**6, 10**9, 1 << 18) for _ in range(2000)])
    mean = (1 << 18) * 25 / 1025
    assert abs(many.mean() - mean) < 8 and abs(many.std() - (mean * 1000 / 1025) ** 0.5) < 5


def test_matrix_of_split_populations_has_the_law(monkeypatch):
    monkeypatch.setattr(sharding, "LIMIT", 4)
    many = [matrix([3, 2, 4, 1], 2, seed) for seed in range(3000)]
    assert all(m.sum(1).tolist() == [3, 2, 4, 1] and m.sum(0).tolist() == [5, 5] for m in many)
    got = np.array([m[0, 0] + m[2, 0] for m in many])  # how many of 7 marked rows among 10 fall into the first 5
    for k in range(2, 6):
        assert abs((got == k).mean() - math.comb(7, k) * math.comb(3, 5 - k) / 252) < 0.04
    got = np.array([m[1, 1] for m in many])
    for k in range(3):
        assert abs((got == k).mean() - math.comb(2, k) * math.comb(8, 5 - k) / 252) < 0.04


def test_places_are_uniform_over_seeds(spark):
    """Every row is as likely in every shard, and neighbours are not kept together."""
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    first, together = np.zeros(40), 0
    for seed in range(30):
        shard = {r.doc_id: r.shard for r in assign(df, 4, seed).collect()}
        first += [shard[i] == 0 for i in range(40)]
        together += sum(shard[i] == shard[i + 1] for i in range(39))
    assert first.sum() == 300 and first.max() <= 18
    assert abs(together / (30 * 39) - 9 / 39) < 0.06


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", i, i, i, i, "s") for i in range(9)], "doc_id long, text string, _row int, _other int, _twin int, _document int, `a.b` string")
    out = sharded(df, 4)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert sorted(r[:7] for r in out.collect()) == sorted(map(tuple, df.collect()))
