import hashlib
import random

import numpy as np
import pytest

from tidewater.llm import suffix_dedup
from tidewater.llm.gsaca import suffix_arrays
from tidewater.llm.suffix_dedup import repeated_spans, without_repeats


def test_suffix_arrays_of_many_lanes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lanes = []
        for _ in range(rng.integers(1, 7)):
            x = rng.integers(1, rng.integers(2, 6), rng.integers(0, 50))
            if rng.random() < 0.3:
                x = np.tile(x[: rng.integers(1, 5)], 12)
            lanes.append(np.append(x, 0))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lanes])])
        got = suffix_arrays(np.concatenate(lanes), offsets)
        for i, x in enumerate(lanes):
            want = sorted(range(len(x)), key=lambda j: x[j:].tolist())
            assert (got[offsets[i] : offsets[i + 1]] - offsets[i]).tolist() == want
    assert len(suffix_arrays(np.zeros(0, np.int64), np.zeros(1, np.int64))) == 0


def brute(rows):
    starts = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            starts[w] = min(starts.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if starts[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(rng.randint(8, 40)) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 20) :], say(rng.randint(0, 12))]
        rows.append((rng.randrange(10**12), "".join(parts)))
    rows += [(10**13 + i, rows[i][1]) for i in range(12)] + [(10**13 + 50 + i, rows[20][1][: 200 + i] + "x" + rows[20][1][201 + i :]) for i in range(12)]
    rows += [(-5, "ab" * 200), (-4, "ab" * 300), (-3, "a" * 49), (-2, "a" * 50), (-1, "a" * 500), (0, None), (1, ""), (2, passages[0]), (2, passages[0] + " twice the id " + passages[1])]
    rows += [(10**14 + i, say(6) + passages[1] + say(6)) for i in range(120)]  # a hot passage in many different surroundings
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_spans_match_brute_force(spark, monkeypatch, small):
    if small:  # many buckets, and anchors whose cut-outs take several lanes
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 13)
        monkeypatch.setattr(suffix_dedup, "LANE", 200)
        monkeypatch.setattr(suffix_dedup, "LANES", 1 << 12)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = sorted(tuple(r) for r in repeated_spans(df).collect())
    assert got == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "q" * 80), (None, "q" * 80), (1, "q" * 80)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in repeated_spans(df).collect()) == [("1", 0), ("None", 0), ("None", 0)]
    assert repeated_spans(df.limit(0)).count() == 0
    held = {r.doc_id: bytes(r.kept) for r in without_repeats(spark.createDataFrame([(1, "x" * 60), (2, "abc" + "x" * 60)], "doc_id long, text string")).collect()}
    assert held == {1: b"x" * 60, 2: b"abc"}
