"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

Words (runs of ASCII letters and bytes over 127, A-Z lower-cased) are hashed to 2**22 slots; the
ROWS slots that most training texts hold have embeddings, all others share one of zeros. Filters over
1, 2 and 3 neighbouring words are max-pooled over the whole text and combined into one probability.
All weights start at random; training leaves out half of a text's words at each look, so that no
single rare word settles a text. A language, guessed from the same words, chooses the threshold
calibrated for it, and the score is shifted so that 0.3 stands for that threshold.
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

U64 = np.uint64
SLOT_BITS, ROWS, DIM, FILTERS, WIDTHS = 22, 1 << 15, 8, 8, (1, 2, 3)
#: The training sample: at most about so many labelled texts of each class, each whole.
PER_CLASS = 4000
STEPS, BATCH, LEFT_OUT, RATE, DECAY = 600, 64, 0.5, 0.005, 2e-3
#: Words whose filters are held at once, whatever the length of a text.
SLAB = 1 << 17
CUT = 0.3
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    slots: np.ndarray  # slot -> row of the embeddings; 0: all others
    weights: dict[str, np.ndarray]
    languages: np.ndarray  # row -> log-probability of each language
    offsets: np.ndarray  # by language (the last: none known), in logits


def word_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all words, row offsets into them)."""
    data, offsets = B.text_buffer(column)
    starts, ends = B.word_spans(LETTER[data], offsets)
    hashes = B.span_hash(B.prefix_hash(B.lower_ascii()[data]), starts, ends)
    return (hashes >> U64(64 - SLOT_BITS)).astype(np.int64), B.rows_of(starts, offsets)


def peaks(rows: np.ndarray, first: np.ndarray, w: dict[str, np.ndarray], places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(largest output, if asked for where its window begins) of every filter in every text; -inf where no window fits.

    rows: of the embeddings, for all texts' words end to end; first: where each text begins. Filters
    stand in the order of their widths.
    """
    total, n = FILTERS * len(WIDTHS), len(rows)
    top, at = np.full((len(first) - 1, total), -np.inf, np.float32), np.zeros((len(first) - 1, total), np.int64)
    for a in range(0, n, SLAB):
        b = min(n, a + SLAB)
        x = w["emb"][rows[a : b + WIDTHS[-1] - 1]]
        starts = np.unique(np.concatenate([[a], first[(first > a) & (first < b)]]))
        text = np.searchsorted(first, starts, side="right") - 1
        sizes = np.diff(np.append(starts, b))
        left = np.repeat(first[text + 1], sizes) - np.arange(a, b)
        # every tap of every filter at once; a window adds those of its words
        taps = x @ np.concatenate([w[f"f{width}"][k] for k in range(WIDTHS[-1]) for width in WIDTHS if k < width], 1)
        z = taps[: b - a, :total] + np.concatenate([w[f"b{width}"] for width in WIDTHS])
        done = total
        for k in range(1, WIDTHS[-1]):
            more = FILTERS * (len(WIDTHS) - k)  # those of widths above k
            behind = taps[k : b - a + k, done : done + more]
            z[: len(behind), total - more :] += behind
            z[left <= k, total - more :] = -np.inf  # windows must not run into the next text
            done += more
        best = np.maximum.reduceat(z, starts - a, axis=0)
        if places:
            place = np.where(z == np.repeat(best, sizes, axis=0), np.arange(a, b)[:, None], n)
            place = np.minimum.reduceat(place, starts - a, axis=0)
            at[text] = np.where(best > top[text], place, at[text])
        top[text] = np.maximum(best, top[text])
    return top, at


def logits(top: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum(top, 0) @ w["out"] + w["bias"][0]


def gradients(rows: np.ndarray, first: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of these texts. Each filter's goes to the words of its best window alone."""
    top, at = peaks(rows, first, w)
    d = ((sigmoid(logits(top, w)) - y) / len(y)).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"], grads["bias"] = np.maximum(top, 0).T @ d, np.array([d.sum()], w["bias"].dtype)
    back = d[:, None] * w["out"] * (top > 0)
    for j, width in enumerate(WIDTHS):
        own = slice(j * FILTERS, (j + 1) * FILTERS)
        grads[f"b{width}"] = back[:, own].sum(0)
        for k in range(width):
            word = rows[np.minimum(at[:, own] + k, len(rows) - 1)]
            grads[f"f{width}"][k] = np.einsum("tf,tfd->df", back[:, own], w["emb"][word])
            np.add.at(grads["emb"], word.ravel(), (back[:, own, None] * w[f"f{width}"][k].T).reshape(-1, DIM))
    grads["emb"][0] = 0
    return grads


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *texts]), np.cumsum([0, *map(len, texts)])


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], seed: int = 7, steps: int = STEPS) -> Model:
    """texts: the slots of each text's words. Every fifth text calibrates and takes no part in the fit."""
    rng = np.random.default_rng(seed)
    slots = np.zeros(1 << SLOT_BITS, np.uint16)
    names = sorted({x for x in langs if x})
    fit = np.arange(len(texts)) % 5 != 4
    # texts that hold a slot; those seen in three or more can have a row
    seen = np.zeros(1 << SLOT_BITS, np.int32)
    for t, use in zip(texts, fit):
        if use:
            seen[np.unique(t)] += 1
    known = np.flatnonzero(seen >= 3)
    known = known[np.argsort(-seen[known], kind="stable")][: ROWS - 1]
    slots[known] = np.arange(1, len(known) + 1)
    w = {"emb": rng.normal(0, 0.05, (len(known) + 1, DIM)), "out": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "bias": np.zeros(1)}
    w["emb"][0] = 0
    for width in WIDTHS:
        w[f"f{width}"] = rng.normal(0, 0.5 / np.sqrt(width), (width, DIM, FILTERS))
        w[f"b{width}"] = np.zeros(FILTERS)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    rows = [slots[t].astype(np.int64) for t in texts]
    usable = [np.flatnonzero(fit & (y == c)) for c in (0, 1)]
    if all(len(u) for u in usable):
        opt = Adam(w, RATE)
        for step in range(steps):
            picked = np.concatenate([rng.choice(u, BATCH // 2) for u in usable])
            words, first = joined([rows[i] for i in picked])
            grads = gradients(np.where(rng.random(len(words)) < LEFT_OUT, 0, words), first, y[picked], w)
            opt.rate = RATE * (1 - 0.9 * step / steps)
            opt.step({k: g + DECAY * w[k] for k, g in grads.items()})
    language = np.full((len(known) + 1, len(names)), 1.0)
    for r, name in zip(rows, langs):
        if name:
            np.add.at(language[:, names.index(name)], r, 1)
    language = np.log(language / language.sum(0))
    language[0] = 0
    model = Model(slots, w, language.astype(np.float32), np.zeros(len(names) + 1))
    # thresholds: one for all, and one for each language with some rows of both classes, drawn towards it
    held = np.flatnonzero(~fit)
    p = sigmoid(logits(peaks(*joined([rows[i] for i in held]), w)[0], w))
    yc = y[held]
    common = best_threshold(p, yc) if len(held) and yc.any() and not yc.all() else 0.5
    for k, name in enumerate([*names, None]):
        mine = np.array([langs[i] == name for i in held], bool)
        t = common
        if name and yc[mine].sum() >= 5 and (1 - yc[mine]).sum() >= 5:
            share = yc[mine].sum() / (yc[mine].sum() + 20)
            t = share * best_threshold(p[mine], yc[mine]) + (1 - share) * common
        model.offsets[k] = np.log(CUT / (1 - CUT)) - np.log(t / (1 - t))
    return model


def score(model: Model, column: pa.Array) -> np.ndarray:
    """The calibrated score of each text; one without words counts as nothing but the bias."""
    slots, first = word_slots(column)
    rows = model.slots[slots].astype(np.int64)
    found = logits(peaks(rows, first, model.weights, places=False)[0], model.weights)
    guess = np.full(len(found), len(model.offsets) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some) and model.languages.shape[1]:
        known = np.stack([np.add.reduceat(of[rows], first[:-1][some]) for of in model.languages.T], 1)
        told = np.add.reduceat((rows > 0).astype(np.int64), first[:-1][some]) > 0
        guess[some[told]] = known[told].argmax(1)
    return sigmoid(found + model.offsets[guess])


def fit(docs: DataFrame, labels: DataFrame, mod: int, remainder: int) -> Model:
    rows = training_rows(docs, labels, "toxic", mod, remainder, PER_CLASS)
    slots = mapped(rows, "doc_id long, lang string, y int, slots binary", _slots_of).toPandas().sort_values("doc_id", kind="stable")
    return train([np.frombuffer(x, np.int32).astype(np.int64) for x in slots["slots"]], slots["y"].to_numpy(), [x if isinstance(x, str) else None for x in slots["lang"]])


def _slots_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    slots, first = word_slots(batch.column("text"))
    packed = [slots[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), batch.column("y").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "lang", "y", "slots"])


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); predicted: score >= 0.3.

    Learns from labels (doc_id, toxic) of rows that aren't held out; without any such rows of both
    classes the network stays as it is initialised. Null and empty texts get the score of a text
    without words; a very long text is scored whole, SLAB words at a time. Repeated rows are scored
    alike, other columns are ignored, an empty table gives an empty one. The model's size is fixed, so
    it is broadcast.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tuple(vars(fit(docs, labels, mod, remainder)).values()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score(Model(*held.value), batch.column("text")), pa.float64())], ["doc_id", "held_out", "score"])

    scored = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, remainder).alias("held_out"), "text"), "doc_id long, held_out boolean, score double", run)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2) -> DataFrame:
    """docs without the rows whose score reaches 0.3; columns, whatever their names, and other rows stay as they are.

    Scores are those of toxicity(): null and empty texts count as texts without words, each of several
    equal rows is judged alike, rows without doc_id are scored like others, an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(vars(fit(docs, labels, mod, remainder)).values()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(Model(*held.value), batch.column("text")) < CUT))

    return mapped(docs, fields, run)
