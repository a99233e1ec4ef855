import collections
import random
import re

from tidewater.llm.rules import BIT, POLICIES, ablations, apply_policy, ledger, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a a a a a", "a b c a b c", "x\nx\n\nx \nx", "é #*$%&|<> z", "w " * 20000]
    texts += ["".join(rng.choice(["ab ", "c ", "d\n", "e\t", "#", "f"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules(df.limit(0)).count() == 0


def test_policies_and_ablations_read_the_ledger_alone(spark):
    rows = [(1, 0), (2, BIT["few_words"]), (3, BIT["few_words"] | BIT["symbols"]), (4, BIT["symbols"]), (5, BIT["long_words"])]
    held = spark.createDataFrame(rows, "doc_id long, failed int")
    assert [r.kept for r in apply_policy(held, "v2").orderBy("doc_id").collect()] == [True, False, False, False, True]
    got = {r.rule: (r.failing, r.only) for r in ablations(held, "v2").collect()}
    assert got["few_words"] == (2, 1) and got["symbols"] == (2, 1) and got["duplicate_lines"] == (0, 0)
    assert POLICIES["v1"] & POLICIES["v3"] == POLICIES["v1"]


def test_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.99
    assert ledger(spark.read.parquet(f"{folder}/documents.parquet")).columns[-1] == "failed"
