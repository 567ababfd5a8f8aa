"""Exact dedup against brute force."""

import random

from quernstone.llm import exact
from quernstone.llm.exact import PatriciaTrie, exact_groups, keep_exact

DOC = "doc_id long, text string, kept string, group_size int"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    return sorted(
        (str(i), str(max(g, key=lambda x: -1 if x is None else x)), len(g))
        for g in groups.values()
        for i in g
    )


def test_trie_against_dict():
    rnd = random.Random(5)
    trie, seen = PatriciaTrie(), {}
    for _ in range(3000):
        key = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9)))
        node = trie.find_or_add(key)
        node[2] = (node[2] or 0) + 1
        seen[key] = seen.get(key, 0) + 1
    assert sorted(n[2] for n in trie.terminals()) == sorted(seen.values())


def test_groups(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["Same", "same", "SAME ", "É", "é", "", None, "x" * 200_000, "hot", "hot", "hot", f"u{i}"]), "clash", 1) for i in range(600)]
    rows += [(7, "twice", "c", 1), (7, "twice", "c", 1), (None, "hot", None, None)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    out = exact_groups(df).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    kept = keep_exact(df)
    assert kept.columns == df.columns
    got = sorted((r.text or "").encode().lower() for r in kept.collect())
    assert got == sorted({(t or "").encode().lower() for _, t, *_ in rows})
    assert {r.doc_id for r in kept.collect()} == {r.keep_id for r in out}


OWN = ["bytes", "hash", "rows", "salt"]


def local(texts, monkeypatch, held, per_batch=10):
    import pyarrow as pa

    monkeypatch.setattr(exact, "HELD", held)
    batches = [pa.record_batch([pa.array(range(at, at + len(part))), pa.array(part)], ["doc_id", "text"]) for at in range(0, len(texts), per_batch) if (part := texts[at : at + per_batch])]
    return pa.Table.from_batches(list(exact._local(True, OWN)(iter(batches))))


def test_subtrees_are_spilled(monkeypatch):
    rnd = random.Random(6)
    texts = [rnd.choice("abcdefgh") + str(rnd.randrange(400)) * 20 for _ in range(5000)]
    out = local(texts, monkeypatch, 20_000, 700)
    assert sum(out.column("rows").to_pylist()) == 5000
    by_text = {}
    for text, i, n in zip(*(out.column(c).to_pylist() for c in ("text", "doc_id", "rows"))):
        was = by_text.get(text, (-1, 0))
        by_text[text] = (max(was[0], i), was[1] + n)
    assert by_text == {t: (max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    assert len(by_text) < out.num_rows < 5000  # some texts left in parts


def test_one_repeated_text_holds_no_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    before = pa.total_allocated_bytes()
    peak = 0

    def batches():
        nonlocal peak
        for k in range(60):
            peak = max(peak, pa.total_allocated_bytes() - before)
            yield pa.record_batch([pa.array([k]), pa.array(["x" * 1_000_000])], ["doc_id", "text"])

    monkeypatch.setattr(exact, "HELD", 8 << 20)
    tracemalloc.start()
    out = pa.Table.from_batches(list(exact._local(True, OWN)(batches())))
    tracemalloc.stop()
    assert out.column("rows").to_pylist() == [60] and out.column("doc_id").to_pylist() == [59]
    assert peak < 24 << 20


def test_hot_texts_take_their_own_way(spark):
    schema = "doc_id long, text string, text_bytes string, text_hash string, text_rows string, text_salt int, key string, Text_Bytes_ string"
    rows = [(i, "Hot One" if i % 3 == 0 else "hot two" if i % 3 == 1 else f"cold {i}", "a", "b", "c", 1, "d", "e") for i in range(6000)]
    df = spark.createDataFrame(rows, schema).repartition(7)
    assert len(exact.hot_keys(df)) == 2
    out = exact_groups(df).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == brute(rows)
    kept = keep_exact(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.keep_id for r in out})
    assert {(r.text_bytes, r.text_salt, r.Text_Bytes_) for r in kept.collect()} == {("a", 1, "e")}


def test_empty(spark):
    empty = spark.createDataFrame([], DOC)
    assert exact_groups(empty).count() == 0 and keep_exact(empty).count() == 0
