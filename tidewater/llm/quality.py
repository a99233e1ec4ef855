"""Quality: a byte-level convolutional network in numpy.

A text is covered from end to end by chunks of 256 bytes that overlap by half. Filters over 5 bytes
are learned as one table of bytes for each tap; a chunk's filter outputs are max-pooled, a hidden
layer turns them into chunk features, and these are max-pooled over the whole text and combined into
one probability. All weights start at random.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytes_np as B
from tidewater.llm.common import mapped
from tidewater.llm.labelled import Adam, best_threshold, held_out, sigmoid, training_rows

HALF, TAPS, FILTERS, HIDDEN = 128, 5, 16, 12
#: The training sample: at most about so many labelled texts of each class, each whole.
PER_CLASS = 1500
STEPS, BATCH, RATE, DECAY = 800, 32, 0.01, 1e-3
#: Half-chunks whose filters are held at once, whatever the length of a text.
SLAB = 1 << 8
CUT = 0.3


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    shift: float


def halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded with zeros so that every text fills whole half-chunks, half-chunks before each text).

    A text ends in TAPS - 1 zeros at least, so that peaks() can keep its filters from the next one.
    """
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.where(sizes > 0, -(-(sizes + TAPS - 1) // HALF), 0))])
    out = np.zeros(int(first[-1]) * HALF + TAPS, np.uint8)
    for at, begin, size in zip((first * HALF).tolist(), offsets.tolist(), sizes.tolist()):
        out[at : at + size] = data[begin : begin + size]
    return out, first


def peaks(padded: np.ndarray, first: np.ndarray, w: dict[str, np.ndarray], places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(largest output, if asked for where in the half-chunk it stands) of every filter in every half-chunk."""
    count, ends = int(first[-1]), first[1:][np.diff(first) > 0] - 1
    top, at = np.zeros((count, FILTERS), np.float32), np.zeros((count if places else 0, FILTERS), np.int64)
    # for many bytes, neighbouring taps share a table of byte pairs
    paired = not places and count > SLAB // 4
    tables = [(w["taps"][k][:, None] + w["taps"][k + 1]).reshape(-1, FILTERS) for k in range(0, TAPS - 1, 2)] if paired else []
    tables += [w["taps"][k] for k in range(2 * len(tables), TAPS)]
    for a in range(0, count, SLAB):
        n = min(SLAB, count - a) * HALF
        byte = padded[a * HALF : a * HALF + n + TAPS].astype(np.intp)
        both = byte[:-1] * 256 + byte[1:] if paired else byte
        z, one = np.zeros((n, FILTERS), w["taps"].dtype), np.empty((n, FILTERS), w["taps"].dtype)
        k = 0
        for table in tables:
            z += np.take(table, (both if len(table) > 256 else byte)[k : k + n], axis=0, out=one, mode="clip")
            k += 2 if len(table) > 256 else 1
        cubes = z.reshape(-1, HALF, FILTERS)
        # what begins in the zeros behind a text has no byte of it
        cubes[ends[(ends >= a) & (ends < a + len(cubes))] - a, HALF - TAPS + 1 :] = 0
        if places:
            at[a : a + len(cubes)] = cubes.argmax(1)
        while cubes.shape[1] > 1:  # HALF is a power of two
            middle = cubes.shape[1] // 2
            cubes = np.maximum(cubes[:, :middle], cubes[:, middle:])
        top[a : a + len(cubes)] = cubes[:, 0]
    return np.maximum(top, 0), at


def chunks_of(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filters of every chunk: a half-chunk and its successor, if it is in the same text; the successor; whether it has one)."""
    follow = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
    pair = np.ones(len(top), bool)
    pair[first[1:][np.diff(first) > 0] - 1] = False
    return np.where(pair[:, None], np.maximum(top, top[follow]), top), follow, pair


def pooled_parts(inputs: np.ndarray, w: dict[str, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every text, none where it has no chunk; features of every chunk)."""
    hidden = np.tanh(inputs @ w["in"] + w["in_bias"])
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, HIDDEN), hidden.dtype)
    if len(some):
        out[some] = np.maximum.reduceat(hidden, first[:-1][some], axis=0)
    return out, hidden


def logits(data: np.ndarray, offsets: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    padded, first = halves(data, offsets)
    inputs, _, _ = chunks_of(peaks(padded, first, w, places=False)[0], first)
    return pooled_parts(inputs, w, first)[0] @ w["out"] + w["bias"][0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def train(texts: list[bytes], y: np.ndarray, seed: int = 5, steps: int = STEPS) -> Model:
    """Every fifth text calibrates the threshold that 0.3 stands for and takes no part in the fit."""
    rng = np.random.default_rng(seed)
    w = {
        "taps": rng.normal(0, 0.1, (TAPS, 256, FILTERS)).astype(np.float32),
        "in": rng.normal(0, 0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "in_bias": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    w["taps"][:, 0] = 0
    use = np.arange(len(texts)) % 5 != 4
    usable = [np.flatnonzero(use & (y == c)) for c in (0, 1)]
    if all(len(u) for u in usable):
        opt = Adam(w, RATE)
        for step in range(steps):
            picked = np.concatenate([rng.choice(u, BATCH // 2) for u in usable])
            opt.rate = RATE * (1 - 0.9 * step / steps)
            opt.step(gradients(*joined([texts[i] for i in picked]), y[picked].astype(np.float32), w))
    held = np.flatnonzero(~use)
    shift = 0.0
    if len(held) and y[held].any() and not y[held].all():
        p = sigmoid(np.array([logits(*joined([texts[i]]), w)[0] for i in held]))
        # the threshold finds the rarer class; scores keep their order
        bad = 1 - y[held]
        t = 1 - best_threshold(1 - p, bad) if bad.sum() < y[held].sum() else best_threshold(p, y[held])
        shift = float(np.log(CUT / (1 - CUT)) - np.log(t / (1 - t)))
    return Model(w, shift)


def gradients(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of these texts and the weights' decay. Maxima pass theirs on to where they stand alone."""
    padded, first = halves(data, offsets)
    top, at = peaks(padded, first, w)
    inputs, follow, pair = chunks_of(top, first)
    pooled, hidden = pooled_parts(inputs, w, first)
    d = (sigmoid(pooled @ w["out"] + w["bias"][0]) - y) / len(y)
    grads = {"out": pooled.T @ d + DECAY * w["out"], "bias": np.array([d.sum()], w["bias"].dtype)}
    text = np.repeat(np.arange(len(y)), np.diff(first))
    back = np.where(hidden == pooled[text], (d[:, None] * w["out"])[text], 0) * (1 - hidden**2)
    grads["in"] = inputs.T @ back + DECAY * w["in"]
    grads["in_bias"] = back.sum(0)
    g = back @ w["in"].T
    # a half-chunk is part of its own chunk and of the one before it
    own = ~pair[:, None] | (top >= top[follow])
    g_top = np.where(own, g, 0)
    np.add.at(g_top, follow[pair], np.where(own, 0, g)[pair])
    half, filter_ = np.nonzero((top > 0) & (g_top != 0))
    place = half * HALF + at[half, filter_]
    taps = np.zeros_like(w["taps"])
    for k in range(TAPS):
        np.add.at(taps[k], (padded[place + k], filter_), g_top[half, filter_])
    taps[:, 0] = 0
    grads["taps"] = taps + DECAY * w["taps"]
    return grads


def score(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = B.text_buffer(column)
    return sigmoid(logits(data, offsets, model.weights) + model.shift)


def fit(docs: DataFrame, labels: DataFrame, mod: int, remainder: int) -> Model:
    rows = training_rows(docs, labels, "quality", mod, remainder, PER_CLASS).select("doc_id", "text", "y").toPandas().sort_values("doc_id", kind="stable")
    return train([x.encode() for x in rows["text"]], rows["y"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); predicted: score >= 0.3.

    Learns from labels (doc_id, quality) of rows that aren't held out; without rows of both classes
    the network stays as it is initialised. Null and empty texts have no chunk and get the score of
    the bias alone; a very long text is scored whole, SLAB half-chunks at a time. Repeated rows are
    scored alike, other columns are ignored, an empty table gives an empty one. The network has a fixed
    size, so it is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(vars(fit(docs, labels, mod, remainder)).values()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score(Model(*held.value), batch.column("text")), pa.float64())], ["doc_id", "held_out", "score"])

    scored = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, remainder).alias("held_out"), "text"), "doc_id long, held_out boolean, score double", run)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
