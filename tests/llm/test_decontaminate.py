import random
import re

import numpy as np
import pyarrow as pa

from tidewater.llm.decontaminate import RATE, contaminated, distances, index, matches, without_contaminated


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sellers(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def plain(t):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).strip()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_distances_are_exact():
    rng = random.Random(2)
    for _ in range(60):
        item = words(rng, 6).encode()
        text = bytearray(item)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(b"xyz ")
        text = words(rng, 1).encode()[:4] + bytes(text) + words(rng, 1).encode()[:3]
        got, _ = distances(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)[None], np.array([len(text)]), 8)
        want = sellers(item, text)
        assert int(got[0]) == want if want <= 8 else int(got[0]) > 8


def test_recall_and_no_false_alarm():
    rng = random.Random(5)
    items = [words(rng, rng.randint(14, 50)) for _ in range(60)]
    held = index(list(range(60)), items)
    texts, truth = [], []
    for i, item in enumerate(items):
        t = list(item)
        for _ in range(int(0.06 * len(t))):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        texts += [words(rng, 40) + " " + item.upper().replace(" ", ",\n") + " " + words(rng, 40), words(rng, 30) + " " + "".join(t) + " " + words(rng, 30), words(rng, 120)]
        truth += [(3 * i, i), (3 * i + 1, i)]
    found = matches(pa.array(texts), held)
    got = {(r, held.ids[i]) for r, i, *_ in found}  # an index keeps its items by length
    assert {(r, i) for r, i in truth if r % 3 == 0} <= got
    assert len(got & set(truth)) >= 0.95 * len(truth)
    for r, i, d, begin, end in found:
        assert (r, held.ids[i]) in truth
        assert d == sellers(held.texts[i], plain(texts[r]).encode()) <= RATE * len(held.texts[i])


def test_rows(spark):
    rng = random.Random(7)
    item, other = words(rng, 30), words(rng, 25)
    docs = spark.createDataFrame(
        [(1, f"{words(rng, 9)} {item}", "a"), (1, f"{words(rng, 9)} {item}", "a"), (2, words(rng, 200), "b"), (3, None, None), (4, "", None), (None, item, None), (5, f"{words(rng, 30000)} {other} {item}", "c")], "doc_id long, text string, item_id string"
    )
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "short"), (None, words(rng, 20))], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in contaminated(docs, bench).collect())
    assert got == [("1", 10, 0), ("1", 10, 0), ("5", 10, 0), ("5", 11, 0), ("None", 10, 0)]
    left = without_contaminated(docs, bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4"] and left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in without_contaminated(docs, bench.limit(0)).collect()) == sorted(str(r.doc_id) for r in docs.collect())
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    row = contaminated(docs.where("doc_id = 5"), bench.where("item_id = 10")).first()
    text = docs.where("doc_id = 5").first().text.encode()
    assert text[row.start_byte : row.end_byte].decode() == item


def edited(rng, item, places):
    """The item with a letter replaced, put in or left out at each place; words stay words."""
    t = list(item)
    for p in sorted(places, reverse=True):
        kind = rng.randrange(3)
        if kind == 0 and t[p] != " ":
            t[p] = "z"
        elif kind == 1 and t[p - 1 : p + 2].count(" ") == 0:
            del t[p]
        else:
            t.insert(p, "z")
    return "".join(t)


def sized(rng, length):
    return words(rng, length)[:length].rstrip().ljust(length, "q")


def test_edited_rows_are_found_at_every_length():
    rng = random.Random(11)
    items = [sized(rng, n) for n, count in ((100, 12), (200, 12), (400, 12), (800, 8), (1600, 6), (3200, 4)) for _ in range(count)]
    held = index(list(range(len(items))), items)
    texts = [f"{words(rng, 20)} {edited(rng, x, rng.sample(range(len(x)), int(RATE * len(x))))} {words(rng, 20)}" for x in items]
    found = matches(pa.array(texts), held)
    assert sorted((r, held.ids[i]) for r, i, *_ in found) == [(i, i) for i in range(len(items))]
    for r, i, d, begin, end in found:
        assert d <= RATE * len(held.texts[i])
        assert len(held.texts[i]) > 400 or d == levenshtein(held.texts[i], texts[r].encode()[begin:end])


def test_edits_at_every_step_of_the_allowance():
    rng = random.Random(13)
    items = [sized(rng, n) for n in range(24, 100)]
    held, texts = index(list(range(len(items))), items), []
    for x in items:
        d = int(RATE * len(x))
        t = list(x)
        for k in range(d):  # evenly spread, so that as few q-grams as can be are left
            t[(2 * k + 1) * len(x) // (2 * d)] = "z"
        texts.append(f"{words(rng, 20)} {''.join(t)} {words(rng, 20)}")
    found = matches(pa.array(texts), held)
    assert sorted((r, held.ids[i]) for r, i, *_ in found) == [(i, i) for i in range(len(items))]


def test_a_tenth_of_an_item_may_be_edited():
    rng = random.Random(17)
    item = sized(rng, 200)
    held, texts = index([0], [item]), []
    for n in (17, 20, 21):
        t = list(item)
        for k in range(n):
            t[5 + 9 * k] = "z"
        texts.append(f"{words(rng, 20)} {''.join(t)} {words(rng, 20)}")
    assert [(r, d) for r, _, d, *_ in matches(pa.array(texts), held)] == [(0, 17), (1, 20)]


def test_items_within_scripts_without_blanks():
    rng = random.Random(19)
    items = ["".join(chr(rng.randrange(first, first + 80)) for _ in range(40)) for first in (0x4E00, 0x3041, 0x0E01)]
    before, behind = ("".join(chr(0x4E00 + rng.randrange(900)) for _ in range(300)) for _ in range(2))
    texts = [f"{before}{x}{behind}" for x in items] + [f"{before}{x[:20]}\u3002{x[21:]}{behind}" for x in items] + [before + behind]
    held = index([0, 1, 2], items)
    found = sorted((r, held.ids[i], d == 0, texts[r].encode()[begin:end].decode()) for r, i, d, begin, end in matches(pa.array(texts), held))
    assert [x[:3] for x in found] == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 0, False), (4, 1, False), (5, 2, False)]
    assert [x[3] for x in found[:3]] == items


def test_short_items_are_found_verbatim_as_whole_words():
    items = ["Who wrote Hamlet?", "\u8c01\u5199\u4e86\u7ea2\u697c\u68a6", "caf\u00e9", "who wrote hamlet", "?!", None]
    held = index(list(range(len(items))), items)
    texts = ["He asked: who wrote\n HAMLET? Who wrote Hamlet!", "who wrote hamlets", "xwho wrote hamlet", "\u8bf7\u95ee\u8c01\u5199\u4e86\u7ea2\u697c\u68a6\u5417", "a caf\u00e9", "caf\u00e9s \u00e9caf\u00e9", "who wrote", "hamlet", None, "who wrote hamlet"]
    found = sorted((r, held.ids[i], d, texts[r].encode()[begin:end].decode()) for r, i, d, begin, end in matches(pa.array(texts), held))
    first = "who wrote\n HAMLET"
    assert found == [(0, 0, 0, first), (0, 3, 0, first), (3, 1, 0, items[1]), (4, 2, 0, items[2]), (9, 0, 0, items[3]), (9, 3, 0, items[3])]


def test_rows_that_share_an_id_are_dropped_by_themselves(spark):
    rng = random.Random(23)
    item, clean = words(rng, 30), words(rng, 60)
    docs = spark.createDataFrame([(1, f"{clean} {item}", "a"), (1, clean, "b"), (2, item, None), (2, None, "c")], "doc_id long, text string, source string")
    left = without_contaminated(docs, spark.createDataFrame([(10, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.text, r.source) for r in left.collect()) == [(1, clean, "b"), (2, None, "c")]


def test_rows_without_id_are_judged_like_others(spark):
    rng = random.Random(29)
    item, clean = words(rng, 30), words(rng, 60)
    docs = spark.createDataFrame([(None, f"{clean} {item}", 1), (None, clean, 2), (None, None, 3)], "doc_id long, text string, keep int")
    left = without_contaminated(docs, spark.createDataFrame([(10, item)], "item_id long, text string"))
    assert sorted(r.keep for r in left.collect()) == [2, 3]
