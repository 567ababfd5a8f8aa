"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from quernstone.llm.components import connected_components
from quernstone.llm.neardup import keep_near, min_max, near_groups

DOC = "doc_id long, text string, kept string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_groups(spark, k):
    rnd = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(40):
        base = rnd.choices(vocab, k=rnd.choice([3, 12, 60, 200]))
        for edits in [0, 0, 1, 2, 4, 8, 16][: rnd.randint(1, 7)]:
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((i, rnd.choice([" ", "\t", "  "]).join(w).upper() if rnd.random() < 0.3 else " ".join(w), "x", 1))
            i += 1
    chain = rnd.choices(vocab, k=120)  # drifts: ends far from where it began, linked in steps
    for step in range(12):
        chain = chain[:]
        chain[step * 9] = f"new{step}"
        rows.append((i, " ".join(chain), None, None))
        i += 1
    rows += [(i, "", "x", 1), (i + 1, None, "x", 1), (i + 2, " \n\t ", "x", 1), (i + 3, "long " * 30_000, "x", 1), (i + 4, "long " * 29_000, "x", 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(rows, DOC).repartition(4), k).collect()}
    want = brute(rows, k)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_empty_and_null_ids(spark):
    assert near_groups(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1)]
    out = near_groups(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("1", "1", True), ("1", "1", True), ("None", "None", True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = min_max(np.concatenate([both, a])), min_max(np.concatenate([both, b]))
    assert abs((x == y).mean() - 0.8) < 0.08


def test_repeated_ids_keep_every_link_and_row(spark):
    """Id 5 holds two texts: one a near copy of 3, the other with a near copy of its own, or none."""
    rnd = random.Random(8)
    a, b, c = (rnd.choices([f"w{i}" for i in range(500)], k=30) for _ in range(3))
    rows = [(3, " ".join(a), "x", 1), (5, " ".join([*a, "more"]), "x", 2), (5, " ".join(b), "x", 3), (8, " ".join([*b, "tail"]), "x", 4), (9, " ".join(c), "x", 5), (3, " ".join([*c, "end"]), "x", 6)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, DOC).repartition(3)
        got = sorted((r.doc_id, r.component_id, r.kept) for r in near_groups(df).collect())
        assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (8, 5, False), (9, 3, False)]
        assert sorted(r.n for r in keep_near(df).collect()) == [1, 3, 6]


def test_templates_that_nearly_reach_the_threshold(spark):
    """Documents of one template, most of them in common buckets and in different components: exact all the same."""
    rnd = random.Random(2)
    stem = rnd.choices([f"w{i}" for i in range(300)], k=90)
    rows = []
    for i in range(150):
        own = [f"own{i // 2 if i % 10 < 2 else i}x{j}" for j in range(16 + i % 5)]
        rows.append((i, " ".join([*stem, *own]), "x", i))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(rows, DOC).repartition(4)).collect()}
    assert got == brute(rows, 5)


def test_kept_rows_have_all_columns_whatever_their_names(spark):
    schema = "doc_id long, text string, row_id string, row_key string, gone_id string, gone_key string, component_id int, rep int, key int, set_id int, comp int"
    text = "one two three four five six seven eight"
    rows = [(i, text if i % 2 else f"{text} {i} a b c d e f", "a", "b", "c", "d", i, 1, 2, 3, 4) for i in range(6)] + [(None, text, *"abcd", 1, 1, 1, 1, 1), (9, None, *"abcd", 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    kept = keep_near(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "4", "9", "None"]
    assert all(r.row_id == "a" and r.gone_key == "d" for r in kept.collect())
