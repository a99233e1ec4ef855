import hashlib

from tidewater.llm.chat import digests, fold, format_chats, log_of
from tidewater.llm.queries import TRICKY

TEXTS = ["plain", "", None, TRICKY, "<|turn|>user<|say|>x<|end|>", "a\\b\\\\<|", "<", "<|", "|>", "[[INST]\\[/INST]", "é\n\n\t<s></s>", "\\", "x" * 5000]


def test_round_trip(spark):
    rows = [(i, j, role, text) for i, text in enumerate(TEXTS) for j, role in enumerate(("user", "assistant", None, "a<|say|>b"))]
    df = spark.createDataFrame(rows + [(None, 0, "user", "no conversation")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_chats(log_of(df)).collect()}
    for i, text in enumerate(TEXTS):
        want = [(role or "", text or "", role == "assistant") for role in ("user", "assistant", None, "a<|say|>b")]
        assert [tuple(t) for t in got[i].turns] == want
        inner = got[i].formatted.replace("<|turn|>", "").replace("<|say|>", "").replace("<|end|>", "")
        assert not any(c in inner for c in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))
    assert [tuple(t) for t in got[None].turns] == [("user", "no conversation", False)]


def test_digests(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 1, "assistant", "two"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    row = digests(format_chats(log_of(df))).first()
    said = "user\none\nassistant\ntwo\nassistant\ntwo\nassistant\n\n"
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (4, hashlib.sha256(said.encode()).hexdigest(), 6, hashlib.sha256(b"twotwo").hexdigest())


def test_fold_applies_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "delta", 0, "user", "he"), (1, 1, "delta", 0, "user", "llo"), (1, 2, "delta", 1, "assistant", "bad"), (1, 3, "delta", 2, "user", "later"),
        (1, 4, "regenerate", 1, "assistant", ""), (1, 5, "delta", 1, "assistant", "go"), (1, 6, "delta", 1, "assistant", "od"), (1, 7, "edit", 0, "user", "bye"), (1, 8, None, 0, "user", "!"),
        (2, 0, "delta", 5, "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string").repartition(3)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in fold(df).collect()}
    assert got == {1: [("user", "bye!"), ("assistant", "good")], 2: [("user", "")]}
    assert fold(df.limit(0)).count() == 0


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y")], "conv_id long, turn long, role string, text string, formatted string")
    assert format_chats(log_of(df)).count() == 1
    assert digests(format_chats(log_of(df.limit(0)))).count() == 0
