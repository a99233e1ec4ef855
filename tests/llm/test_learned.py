import re

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import language, quality, toxicity
from tidewater.llm.labelled import best_threshold, held_out

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def odd(spark):
    rows = [(1, None, "en", "s", 0.5), (2, "", "en", "s", 0.5), (3, "x", None, "s", 0.5), (3, "x", None, "s", 0.5), (None, "the idiot", "en", None, None), (4, "wörd " * 60000, "de", "s", 1.0), (5, "12 !!", "en", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def hits(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    return np.array(held)


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pairs = hits(rows, labels, "toxic")
    assert (pairs[:, 0] == pairs[:, 1]).mean() > 0.88
    out = {str(r.doc_id): r for r in toxicity.toxicity(odd(spark), labels).collect()}
    assert out["None"].held_out is False and out["1"].score == out["2"].score
    assert toxicity.without_toxic(odd(spark), labels).columns == odd(spark).columns
    assert toxicity.toxicity(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_scores_do_not_depend_on_neighbours(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, 4, 2)
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "one", "one two", "x" * 9]
    whole = toxicity.score(model, pa.array(texts))
    alone = np.concatenate([toxicity.score(model, pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)


def plain_toxic_logit(model, slots):
    """The network by plain loops, from its definition."""
    w, rows = model.weights, [int(model.slots[s]) for s in slots]
    total = float(w["bias"][0])
    for j, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(rows) - width + 1):
                out = float(w[f"b{width}"][f])
                for k in range(width):
                    out += sum(float(a) * float(b) for a, b in zip(w["emb"][rows[i + k]], w[f"f{width}"][k, :, f]))
                best = max(best, out)
            total += best * float(w["out"][j * toxicity.FILTERS + f])
    return total


def test_toxicity_against_plain_loops(spark, tables, monkeypatch):
    docs, labels = tables
    model = toxicity.fit(docs, labels, 4, 2)
    texts = [r.text for r in docs.where("length(text) < 900").orderBy("doc_id").limit(12).collect()] + ["", None, "one", "one two"]
    offsets = set(np.round(model.offsets, 6).tolist())
    for slab in (toxicity.SLAB, 7):  # long texts are looked at a slab at a time
        monkeypatch.setattr(toxicity, "SLAB", slab)
        scores = toxicity.score(model, pa.array(texts))
        slots, first = toxicity.word_slots(pa.array(texts))
        for i, p in enumerate(scores):
            assert first[i + 1] - first[i] == len(re.findall(rb"[A-Za-z\x80-\xff]+", (texts[i] or "").encode()))
            shift = np.log(p / (1 - p)) - plain_toxic_logit(model, slots[first[i] : first[i + 1]])
            assert min(abs(shift - x) for x in offsets) < 1e-4


def test_toxicity_gradients():
    rng = np.random.default_rng(3)
    rows, first, y = rng.integers(0, 30, 60), np.array([0, 25, 25, 26, 28, 60]), np.array([1.0, 0, 1, 0, 1])
    w = {"emb": rng.normal(0, 1, (30, toxicity.DIM)), "out": rng.normal(0, 1, 3 * toxicity.FILTERS), "bias": np.zeros(1)}
    w["emb"][0] = 0
    for width in toxicity.WIDTHS:
        w |= {f"f{width}": rng.normal(0, 1, (width, toxicity.DIM, toxicity.FILTERS)), f"b{width}": rng.normal(0, 0.1, toxicity.FILTERS)}

    def loss():
        p = 1 / (1 + np.exp(-np.array([plain_toxic_logit(toxicity.Model(np.arange(30), w, None, None), rows[a:b]) for a, b in zip(first, first[1:])])))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = toxicity.gradients(rows, first, y, w)
    for name, at in (("out", (1,)), ("out", (20,)), ("bias", (0,)), ("f1", (0, 2, 3)), ("f2", (1, 0, 4)), ("f3", (2, 5, 1)), ("b3", (2,)), ("emb", (int(rows[3]) or 1, 2)), ("emb", (int(rows[40]) or 1, 6))):
        was = w[name][at]
        w[name][at] = was + 1e-4
        high = loss()
        w[name][at] = was - 1e-4
        low = loss()
        w[name][at] = was
        assert grads[name][at] == pytest.approx((high - low) / 2e-4, abs=2e-4)


def accuracy_of(module, docs, labels, column, mod, remainder, steps):
    """(accuracy, balanced accuracy) on rows that are held out."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(module, "train", lambda *a, f=module.train, **k: f(*a, **k, steps=steps))
        model = module.fit(docs, labels, mod, remainder)
    rows = docs.join(labels, "doc_id").where(held_out(mod, remainder)).select("text", column).collect()
    p, y = module.score(model, pa.array([r.text for r in rows])) >= module.CUT, np.array([r[column] for r in rows])
    return (p == y).mean(), ((p[y == 1] == 1).mean() + (p[y == 0] == 0).mean()) / 2


def test_training_earns_the_scores(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for module, column, mod, remainder, least in ((toxicity, "toxic", 4, 2, 0.96), (quality, "quality", 5, 0, 0.98)):
        plain, trained = (accuracy_of(module, docs, labels, column, mod, remainder, steps) for steps in (0, module.STEPS))
        assert trained[0] > least and trained[1] > plain[1] + 0.2, (module.__name__, plain, trained)


def plain_quality_logit(w, text):
    """The network by plain loops, from its definition: chunks of two half-chunks, maxima over the chunk and over the text."""
    padded = text + bytes(quality.TAPS - 1 + quality.HALF)
    halves = -(-(len(text) + quality.TAPS - 1) // quality.HALF) if text else 0
    tops = []
    for h in range(halves):
        outs = []
        for f in range(quality.FILTERS):
            best = 0.0
            for i in range(h * quality.HALF, (h + 1) * quality.HALF):
                best = max(best, sum(float(w["taps"][k, padded[i + k], f]) for k in range(quality.TAPS) if i + k < len(padded)))
            outs.append(best)
        tops.append(outs)
    features = [0.0] * quality.HIDDEN
    for h in range(halves):
        chunk = [max(a, b) for a, b in zip(tops[h], tops[h + 1])] if h + 1 < halves else tops[h]
        for j in range(quality.HIDDEN):
            v = float(np.tanh(sum(c * float(w["in"][f, j]) for f, c in enumerate(chunk)) + float(w["in_bias"][j])))
            features[j] = v if h == 0 else max(features[j], v)
    return sum(a * float(b) for a, b in zip(features, w["out"])) + float(w["bias"][0])


def test_quality_against_plain_loops(spark, tables, monkeypatch):
    docs, labels = tables
    model = quality.fit(docs, labels, 5, 0)
    texts = [r.text for r in docs.where("length(text) < 600").orderBy("doc_id").limit(8).collect()] + ["", None, "one", "x" * 128, "y" * 256, "z" * 125]
    for slab in (quality.SLAB, 2):
        monkeypatch.setattr(quality, "SLAB", slab)
        for text, p in zip(texts, quality.score(model, pa.array(texts))):
            assert np.log(p / (1 - p)) == pytest.approx(plain_quality_logit(model.weights, (text or "").encode()) + model.shift, abs=1e-4)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    rows = quality.quality(docs, labels).collect()
    pairs = hits(rows, labels, "quality")
    assert len(rows) == docs.count() and (pairs[:, 0] == pairs[:, 1]).mean() > 0.93
    assert quality.quality(odd(spark), labels).count() == 7
    assert quality.quality(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (300, 20, 500, 128)]
    data, offsets, y = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.array([1.0, 0, 1, 0])
    w = {"taps": rng.normal(0, 0.3, (quality.TAPS, 256, quality.FILTERS)), "in": rng.normal(0, 0.3, (quality.FILTERS, quality.HIDDEN)), "in_bias": rng.normal(0, 0.1, quality.HIDDEN), "out": rng.normal(0, 0.3, quality.HIDDEN), "bias": np.zeros(1)}
    w["taps"][:, 0] = 0

    def loss():
        p = 1 / (1 + np.exp(-quality.logits(data, offsets, w)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality.gradients(data, offsets, y, w)
    for name, at in (("out", (3,)), ("out", (10,)), ("in", (2, 4)), ("in", (12, 1)), ("in", (15, 3)), ("in_bias", (5,)), ("taps", (2, 99, 3)), ("taps", (0, 101, 0))):
        was = w[name][at]
        w[name][at] = was + 1e-5
        high = loss()
        w[name][at] = was - 1e-5
        low = loss()
        w[name][at] = was
        decay = 0 if name == "in_bias" else quality.DECAY * was
        assert grads[name][at] - decay == pytest.approx((high - low) / 2e-5, abs=2e-5)


def test_language_on_held_out_rows(spark, tables):
    docs, _ = tables
    rows = language.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    out = {str(r.doc_id): (r.lang_pred, r.score) for r in language.identify(odd(spark).unionByName(docs.select("doc_id", "text", "lang", "source").selectExpr("*", "cast(null as double) score"))).where("doc_id is null or doc_id <= 5").collect()}
    empty = {str(r.doc_id): (r.lang_pred, r.score) for r in language.identify(odd(spark).limit(0)).collect()}
    assert empty == {} and out
    und = {r.doc_id: r.lang_pred for r in language.identify(odd(spark)).collect()}
    assert und[1] == und[2] == und[5] == "und"


def test_language_distances_against_plain_counts(spark, tables):
    docs, _ = tables
    languages, vocabulary, table_ = language.learn_profiles(docs, 3, 1)
    profile = [{int(g): int(p) for g, p in zip(vocabulary, table_[:, i]) if p < language.RANKS} for i in range(len(languages))]
    assert all(sorted(p.values()) == list(range(len(p))) and len(p) == language.RANKS for p in profile)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["a", "Zwölf Boxkämpfer, 3 jagen!", "\U00020000 é" * 3, "x " * 4000, "12", "", None]
    names, scores = language.closest(texts, languages, vocabulary, table_)
    for text, name, score in zip(texts, names, scores):
        counts = {}
        blank = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        line = [32 if c == " " else ord(c) for c in re.sub(" +", " ", blank)]
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                gram = line[i : i + n]
                if (gram[1] != 32 if n == 3 else any(c != 32 for c in gram)):
                    key = sum(c << 21 * (n - 1 - k) for k, c in enumerate(gram))
                    counts[key] = counts.get(key, 0) + 1
        if not counts:
            assert (name, score) == ("und", 0)
            continue
        top = sorted(counts, key=lambda g: (-counts[g], g))[: language.RANKS]
        far = [sum(abs(p[g] - i) if g in p else language.RANKS for i, g in enumerate(top)) for p in profile]
        near, second = sorted(far)[:2]
        assert name == languages[far.index(near)] and score == pytest.approx(second / max(1, second + near))


def test_language_profiles_by_hand():
    points, first = language.letters_only(["Ab, ab!", None, "É1x"])
    assert "".join(map(chr, points[first[0] : first[1]])) == " ab ab " and "".join(map(chr, points[first[2] : first[3]])) == " é x "
    top = language.ranked(points[first[0] : first[1]])
    a, b, s = 97, 98, 32
    assert set(top.tolist()) == {a, b, s << 21 | a, a << 21 | b, b << 21 | s, (s << 21 | a) << 21 | b, (a << 21 | b) << 21 | s}


def test_best_threshold():
    assert 0.4 < best_threshold(np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0])) < 0.8
