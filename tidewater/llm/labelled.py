"""Bounded training samples of labelled documents, and what the trained scorers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(mod: int, remainder: int):
    """Whether crc32(doc_id as text) mod `mod` is `remainder` (rows without doc_id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == remainder, F.lit(False))


def sample_below(count_column: str, bound: int):
    """True for about `bound` of the rows that count_column says there are, by a hash of doc_id."""
    return F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * bound / F.greatest(F.col(count_column), F.lit(1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, per_class: int) -> DataFrame:
    """(doc_id, text, lang, y): about `per_class` labelled texts of each class, each whole.

    Rows that are held out, lack a label, a text or an id take no part; a document labelled twice
    counts with its larger label. The sampled labels are bounded by per_class, so they are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(mod, remainder)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = known.groupBy("y").agg(F.count("*").alias("n"))
    chosen = known.join(F.broadcast(counts), "y").where(sample_below("n", per_class)).select("doc_id", "y")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id")


class Adam:
    """The usual first- and second-moment steps on a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.weights[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 on these rows is largest (midway between neighbouring scores)."""
    order = np.argsort(-scores)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    below = scores[order[i + 1]] if i + 1 < len(y) else 0.0
    return float(np.clip((scores[order[i]] + below) / 2, 0.02, 0.98))
