"""Decontamination against a plain alignment of every document with every item."""

import random
import re

import numpy as np

from quernstone.llm import decontaminate
from quernstone.llm.decontaminate import align, contaminated, keep_clean

DOC, ITEM = "doc_id long, text string, score string", "item_id long, text string, doc_id long"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def plain(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_align_against_plain():
    rng = np.random.default_rng(0)
    items, texts = rng.integers(2, 6, (30, 9)).astype(np.uint64), rng.integers(2, 6, (30, 25)).astype(np.uint64)
    lengths = rng.integers(1, 10, 30)
    best, _ = align(items, lengths, texts)
    assert best.tolist() == [plain(a[:n].tolist(), t.tolist()) for a, n, t in zip(items, lengths, texts)]


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["É", "naïve"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([2, 20, 40]))) + ".", 9) for i in range(25)] + [(90, None, 1), (91, " ?! ", 1), (3, "again the same number", 1)]
    rows = []
    for d in range(150):
        w = rnd.choices(vocab, k=rnd.choice([5, 100, 400]))
        if d % 3 == 0:
            copy = words(items[d % 25][1])
            for _ in range(rnd.choice([0, 0, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in copy]
        rows.append((d, " ".join(w), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "w " * 100_000 + items[1][1], "x"), (None, items[2][1], "x")]
    docs, bench = spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(items, ITEM)
    want = set()
    for d, t, _ in rows:
        tw = words(t)[-60:] if d == 902 else words(t)
        for i, x, _ in items:
            iw = words(x)
            if iw and plain(iw, tw) >= 0.5 * 2 * len(iw):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want == got
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 700)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == got


def test_empty(spark):
    none, some = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c d", "x")], DOC)
    assert contaminated(none, spark.createDataFrame([(1, "a b c d", 1)], ITEM)).count() == 0
    assert contaminated(some, spark.createDataFrame([], ITEM)).count() == 0
    assert [r.doc_id for r in contaminated(some, spark.createDataFrame([(1, "A, b; c d", 1)], ITEM)).collect()] == [1]


def test_copies_without_a_run_of_three_words(spark):
    """By the alignment's score alone, whatever stretch of the item is left whole."""
    item = [f"w{k}" for k in range(40)]
    copies = {
        1: [x for k, w in enumerate(item) for x in ([w, f"in{k}"] if k % 3 == 2 else [w])],
        2: [f"other{k}" if k % 4 == 3 else w for k, w in enumerate(item)],
        3: [w for k, w in enumerate(item) if k % 4 != 3],
        4: [x for k, w in enumerate(item) for x in ([w, f"in{k}"] if k % 2 else [w])],
        5: [x for k, w in enumerate(item) for x in (w, f"in{k}")],
        6: [f"other{k}" if k % 2 else w for k, w in enumerate(item)],
        7: item[:20],
    }
    rnd = random.Random(1)
    vocab = item[:12] + [f"v{k}" for k in range(60)]
    copies |= {100 + d: [w if rnd.random() < 0.75 else rnd.choice(vocab) for w in item for _ in range(rnd.choice([1, 1, 1, 2]))] for d in range(60)}
    rows = [(d, " ".join(rnd.choices(vocab, k=70) + c + rnd.choices(vocab, k=70)), "x") for d, c in copies.items()]
    want = {d: round(plain(item, words(t)) / 80, 9) for d, t, _ in rows if plain(item, words(t)) >= 40}
    assert {1, 2, 3, 4, 5, 7} <= want.keys() and 6 not in want
    found = contaminated(spark.createDataFrame(rows, DOC).repartition(2), spark.createDataFrame([(1, " ".join(item), 0)], ITEM)).collect()
    assert {r.doc_id: round(r.score, 9) for r in found} == want


def test_rows_go_for_their_own_text(spark):
    schema = "doc_id long, text string, row_id string, row_key string, gone_id string, gone_key string, text_key int, item_id int"
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"before {item} after", *"abcd", 1, 1), (1, "clean text of the same number", *"abcd", 2, 2), (None, item, *"abcd", 3, 3), (None, "clean", *"abcd", 4, 4), (None, None, *"abcd", 5, 5), (2, "", *"abcd", 6, 6)]
    df = spark.createDataFrame(rows, schema)
    kept = keep_clean(df, spark.createDataFrame([(1, item, 1), (1, item, 1)], ITEM))
    assert kept.columns == df.columns and sorted(r.text_key for r in kept.collect()) == [2, 4, 5, 6]
    assert keep_clean(df, spark.createDataFrame([], ITEM)).count() == len(rows)


def test_recall_on_edited_copies(spark):
    """Each kind of edit, planted in longer texts: all that a plain alignment scores over the threshold is found, and nothing else."""
    rnd = random.Random(12)
    vocab = [f"v{k}" for k in range(900)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([8, 30, 60]))), 0) for i in range(12)]
    rows, want = [], set()
    for i, x, _ in items:
        w = x.split()
        for n, step in enumerate([3, 4, 5, 6]):
            edits = [
                [rnd.choice(vocab) if k % step == 0 else y for k, y in enumerate(w)],
                [y for k, y in enumerate(w) if k % step],
                [z for k, y in enumerate(w) for z in ([y, "extra"] if k % step == 0 else [y])],
                [*w[step:], *w[:step]],
                [w[k ^ 1] if k ^ 1 < len(w) and k % (2 * step) < 2 else y for k, y in enumerate(w)],
            ]
            for m, edit in enumerate(edits):
                d = 1000 * i + 10 * n + m
                text = rnd.choices(vocab, k=40) + edit + rnd.choices(vocab, k=40)
                rows.append((d, " ".join(text), "x"))
                want |= {(d, j) for j, y, _ in items if plain(y.split(), text) >= len(y.split())}
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(items, ITEM)).collect()}
    assert len(want) > 200 and got == want


def test_very_long_item(spark):
    item = " ".join(f"w{k}" for k in range(3000))
    docs = spark.createDataFrame([(1, item, "x"), (2, " ".join(item.split()[:1400]), "x"), (3, " ".join(item.split()[700:2600]), "x")], DOC)
    assert sorted(r.doc_id for r in contaminated(docs, spark.createDataFrame([(1, item, 0)], ITEM)).collect()) == [1, 3]
