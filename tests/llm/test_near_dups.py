import random
import re

import numpy as np
import pytest

from tidewater.llm import near_dups
from tidewater.llm.common import Scratch
from tidewater.llm.graph import components
from tidewater.llm.near_dups import linked, near_dup_groups, without_near_dups

SCHEMA = "doc_id long, text string, source string, kept string, component_id int"


def sets_of(rows, words):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def brute(rows, words, percent):
    sets, parent = sets_of(rows, words), {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in docs}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    base = [rng.choice(words) for _ in range(80)]
    for i in range(40, 100):  # a family at every distance from its base
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[i][1].upper()) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "ONE\ttwo"), (205, "naïve É x y z"), (206, "naïve é x y z"), (207, "z " * 3000)]
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_groups_match_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 16)  # families of several blocks
    rows = corpus()
    df = spark.createDataFrame([(d, t, "s", "k", 7) for d, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup_groups(df, words, 80).collect()}
    assert got == brute(rows, words, 80)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None)], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup_groups(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("3", "1", False), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in without_near_dups(df).collect()) == ["1", "None"]
    assert near_dup_groups(df.limit(0)).count() == 0
    assert without_near_dups(df).columns == df.columns


def test_linked_finds_a_spanning_forest():
    sets = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [9, 10], [1, 2, 3, 4, 5], [9, 10, 11])]
    assert {frozenset(x) for x in linked(sets, 60)} == {frozenset((0, 1)), frozenset((0, 3)), frozenset((2, 4))}
    assert linked(sets[:2], 80) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 3), (200, 201), (5, 5), (201, 200)]
    got = {r.node: r.component for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_compared_by_themselves(spark):
    one, two, three = "a b c d e f", "g h i j k l", "m n o p q r"
    df = spark.createDataFrame([(7, one, "x", None, 1), (7, two, "y", None, 2), (3, two, "z", None, 3), (9, one, "w", None, 4), (9, three, "v", None, 5), (9, three, "v", None, 5)], SCHEMA).repartition(4)
    left = without_near_dups(df)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, two), (7, one), (9, three)] and left.columns == df.columns


def test_chains_and_strangers_of_a_family(spark, monkeypatch):
    """Documents that only their neighbours link, and families in which the leader is linked with few."""
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):  # each differs from the one before a little, from far ones a lot
        base = list(base)
        base[rng.randrange(60)] = rng.choice(words)
        rows.append((i * 7 % 120, " ".join(base)))
    core = [rng.choice(words) for _ in range(45)]
    for i in range(200, 240):  # half in common with all, more with a partner
        own = random.Random(i // 2)
        rows.append((i, " ".join([*core, *(own.choice(words) for _ in range(25)), *(rng.choice(words) for _ in range(2))])))
    df = spark.createDataFrame([(d, t, "s", "k", 7) for d, t in rows], SCHEMA).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup_groups(df, 5, 80).collect()}
    assert got == brute(rows, 5, 80)


def test_linked_outside_of_a_cluster():
    sets = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4, 7], [1, 2, 3, 4, 5])]
    assert linked(sets, 60, [0, 0, 0, 3], [False, False, False, True]) in ([(3, 0)], [(3, 1)], [(3, 2)])
    assert linked(sets, 60, [0, 0, 0, 0], [False] * 4) == []


def test_columns_of_any_name_are_kept(spark):
    names = ["_row", "row", "document", "place", "_once", "component_id", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    for ids in ((1, 2, 3), (1, 1, None)):
        df = spark.createDataFrame([(d, t, *range(7)) for d, t in zip(ids, ("a b c d e f", "A b c d e f", "x y"))], schema)
        out = without_near_dups(df)
        assert out.columns == df.columns and [r[2:] for r in out.collect()] == [tuple(range(7))] * 2
