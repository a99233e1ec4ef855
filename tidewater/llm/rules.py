"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once. A row of the ledger keeps the measurements and one failure bit a rule, so
a policy is a mask: applying another version of it, or asking what one rule alone removes, reads the
ledger and no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.chat import let
from tidewater.llm.common import WORD

#: Rule bits, lowest first: name and the measurement that fails it.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the rules that remove a document.
POLICIES = {"v1": BASE, "v2": BASE | BIT["symbols"] | BIT["duplicate_lines"], "v3": sum(BIT.values())}


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more in the text.

    Windows are compared by a 64-bit hash. Sorted by hash, equal windows are neighbours; their places,
    sorted again, cover three words each, or as many as stand before the next place.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            return F.array_sort(F.transform(again, lambda e: e["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))), F.lit(0), lambda a, x: a + x
            )

        return let(let(ranked, places), total)

    none = F.lit(0)
    return F.when(F.size(words) < 4, none).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def measure(docs: DataFrame) -> DataFrame:
    """Every measurement, once a text (null: empty); columns that clash are replaced."""
    text = F.coalesce("text", F.lit(""))
    bare = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    facts = let(
        words,
        lambda w: let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                bare.cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
            ),
        ),
    )
    # a generated row is computed once: no filter or projection above can pull the measuring into itself
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.array(facts)))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed: the bits of the rules that the text fails) for each row of docs."""
    measured = measure(docs)
    bits = F.lit(0)
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed and kept: whether none of the policy's bits are set."""
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, failing, only): rows that fail each rule of a policy, and those that would be kept without it."""
    mask = POLICIES[policy]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    counts = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    tests = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask))
    return (
        counts.select("hit", "n", F.explode(tests).alias("t"))
        .groupBy(F.col("t.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(F.col("t.bit")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
            F.coalesce(F.sum(F.when(F.col("hit") == F.col("t.bit"), F.col("n"))), F.lit(0)).alias("only"),
        )
    )


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with a policy's verdict for each row of docs (doc_id, text).

    A null text has no words and fails few_words. Repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty one.
    """
    return apply_policy(ledger(docs), policy)
