"""Language by rank-order profiles: the out-of-place distance between a text's most frequent
n-grams and each language's.

N-grams are the letters, letter pairs and letter triples of lower-cased words, with a blank at either
end of a word. A profile is the RANKS most frequent of them; an n-gram that a language's profile lacks
is RANKS places out. Ties in frequency rank the smaller n-gram (by code points) first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import mapped
from tidewater.llm.labelled import held_out, sample_below

RANKS = 300
#: The profiles are made from about so many texts of each language at most.
PER_LANGUAGE = 3000
SHIFT = np.uint64(21)


def letters_only(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased words of all texts, a blank before each text and between words; where each text begins."""
    lowered = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    is_letter = letter_table()[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        is_letter[at] = chr(points[at]).isalpha()
    blank = ~is_letter
    keep = is_letter.copy()
    keep[1:] |= blank[1:] & is_letter[:-1]
    keep[begin[:-1]] = True
    points = np.where(is_letter, points, 32)
    return points[keep].astype(np.uint64), np.concatenate([[0], np.cumsum(keep)])[begin]


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000))
    return _letters[0]


def grams(points: np.ndarray) -> np.ndarray:
    """All n-grams of one text as numbers that hold up to three code points."""
    real = points != 32
    pair = (points[:-1] << SHIFT) | points[1:]
    three = (pair[:-1] << SHIFT) | points[2:]
    return np.concatenate([points[real], pair[real[:-1] | real[1:]], three[real[1:-1]]])


def ranked(points: np.ndarray) -> np.ndarray:
    found, counts = np.unique(grams(points), return_counts=True)
    if len(found) > 4 * RANKS:
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.argsort(-counts, kind="stable")][:RANKS]


def count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
    points, first = letters_only(texts)
    name, gram, n = [], [], []
    for lang in sorted(set(langs.tolist())):
        every = [grams(points[first[i] : first[i + 1]]) for i in np.flatnonzero(langs == lang)]
        found, counts = np.unique(np.concatenate(every), return_counts=True)
        name += [lang] * len(found)
        gram.append(found.astype(np.int64))
        n.append(counts)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(np.concatenate(gram) if gram else np.zeros(0, np.int64)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, mod: int, remainder: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, sorted n-grams of all profiles, the rank of each in each language's profile, or RANKS)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(mod, remainder)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = docs.where(F.col("lang").isNotNull() & ~held_out(mod, remainder)).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"))
    # as few rows as there are languages, and fewer than the profiles below, which are collected
    sample = known.join(F.broadcast(sizes), "lang").where(sample_below("n", PER_LANGUAGE) | F.col("doc_id").isNull()).select("lang", "text")
    counts = mapped(sample, "lang string, gram long, n long", count_grams).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= RANKS).select("lang", "gram", "place").toPandas()
    languages = sorted(top["lang"].unique().tolist())
    vocabulary = np.unique(top["gram"].to_numpy(np.int64)).astype(np.uint64)
    table = np.full((len(vocabulary), len(languages)), RANKS, np.int32)
    table[np.searchsorted(vocabulary, top["gram"].to_numpy(np.int64).astype(np.uint64)), [languages.index(x) for x in top["lang"]]] = top["place"].to_numpy() - 1
    return languages, vocabulary, table


def closest(texts: list[str | None], languages: list[str], vocabulary: np.ndarray, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    points, first = letters_only(texts)
    names, scores = [], np.zeros(len(texts))
    places = np.arange(RANKS)
    for i in range(len(texts)):
        own = points[first[i] : first[i + 1]]
        if not languages or not (own != 32).any():
            names.append("und")
            continue
        top = ranked(own)
        at = np.minimum(np.searchsorted(vocabulary, top), len(vocabulary) - 1)
        hit = vocabulary[at] == top
        there = table[at[hit]]
        out = np.where(there < RANKS, np.abs(there - places[: len(top)][hit][:, None]), RANKS).sum(0) + RANKS * int((~hit).sum())
        best = int(out.argmin())
        names.append(languages[best])
        rest = np.delete(out, best)
        scores[i] = 1.0 if not len(rest) else float(rest.min() / max(1, rest.min() + out[best]))
    return names, scores


def identify(docs: DataFrame, mod: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Profiles are learned from the rows that aren't held out and have a lang. A text that is null or has
    no letter is `und` with score 0, as is every text when there is nothing to learn from. The score is
    the second-best distance's share of the two best ones (1 if only one language is known); equal
    distances go to the language that sorts first. Repeated rows are treated alike; other columns are
    ignored; an empty table gives an empty one. Profiles have RANKS n-grams a language, so they travel
    with the function.
    """
    languages, vocabulary, table = learn_profiles(docs, mod, remainder)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = closest(batch.column("text").to_pylist(), languages, vocabulary, table)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, remainder).alias("held_out"), "text"), "doc_id long, held_out boolean, lang_pred string, score double", run)
