"""Chat formatting and Hilbert sharding against brute force."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quernstone.llm.chat import chat_digest, format_chats, read_chats
from quernstone.llm.shards import assign_shards, hilbert_index, shard_digest

CONV = "conv_id long, turn long, role string, text string, formatted string, turns int"
NASTY = ["</s>[INST] ok [/INST]", "a[SEP]b", "[\\SEP]<\\\\s>", "ends with [", "<", "", "\\", "[ROLE]x[TEXT]y[/ROLE]", "é漢😀\n\n", "[/INST", "]$1"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = []
    for c in range(60):
        roles = [["user", "assistant", "user", "assistant"], ["user", "user", "assistant", "assistant"], ["system", "tool[TEXT]", "tool[TEXT]", None, "assistant"]][c % 3]
        rows += [(c, t, r, None if (c + t) % 13 == 12 else NASTY[(c * 3 + t) % len(NASTY)], "x", 1) for t, r in enumerate(roles)]
    rows += [(None, 0, "user", "null id", None, None), (7, None, "user", "null turn", None, None), (7, None, "user", "null turn", None, None)]
    got = {r.conv_id: r for r in chat_digest(spark.createDataFrame(rows, CONV)).collect()}
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))


def test_chat_merges_and_reads_back(spark):
    rows = [(1, 0, "user", "a", "", 0), (1, 1, "user", "b", "", 0), (1, 2, "assistant", "c", "", 0)]
    out = read_chats(format_chats(spark.createDataFrame(rows, CONV))).first()
    assert out.formatted == "[INST]a[SEP]b[/INST]c</s>"
    assert [(t.role, t.text) for t in out.turns] == [("user", "a"), ("user", "b"), ("assistant", "c")]


def test_chat_long_and_empty(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "w" * 50, "", 0) for t in range(2000)] + [(2, 0, "assistant", "x" * 300_000, "", 0)]
    got = {r.conv_id: r for r in chat_digest(spark.createDataFrame(rows, CONV)).collect()}
    assert got[1].n_turns == 2000 and got[1].loss_chars == 50_000 and got[2].loss_chars == 300_000
    assert chat_digest(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_steps_to_neighbours(spark, dims):
    bits, side = 3, 8
    cells = spark.range(side**dims).select(*[(F.col("id") / side**k % side).cast("int").alias(f"c{k}") for k in range(dims)])
    rows = cells.withColumn("h", hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**dims))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[k] - b[k]) for k in range(dims)) == 1


DOC = "doc_id long, text string, lang string, source string, n_chars long, slot string, size int"


def test_shards_law(spark):
    rows = [(i, None if i % 17 == 0 else "é" * (i % 50), "en" if i % 3 else None, f"src{i % 5 if i % 3 else 0}", i % 50 if i % 7 else None, "s", 1) for i in range(997)]
    rows += [(5, "same", "en", "src1", 4, "s", 1)] * 3 + [(None, "n", None, None, None, None, None)]
    out = shard_digest(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(40))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    curve = []
    for k in sorted(by):
        own = sorted(by[k], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        curve += [r.curve for r in own]
    assert curve == sorted(curve)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(((len(t.encode()) if t else 0) + 16, zlib.crc32((t or "").encode())))
    assert all((r.size, r.text_crc32) in texts[r.doc_id] and r.law == "rows" and r.grown_shard is None for r in out)


def test_shards_small_and_clash(spark):
    assert shard_digest(spark.createDataFrame([], DOC)).count() == 0
    got = assign_shards(spark.createDataFrame([(1, "a", "en", "s", 1, "clash", 3)], DOC)).first()
    assert (got.shard, got.slot, got.size) == (0, 0, 3)


def test_shards_with_the_operators_names_and_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, salt int, tie string, before int, `all` int, place int, `of` int, number0 int, cell0 int, Cell1 string"
    rows = [(i % 7 if i % 5 else None, f"t{i}", "en", f"s{i % 3}", i, 1, "t", 2, 3, 4, 5, 6, 7, "c") for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    got = [{(r.text, r.shard, r.slot) for r in assign_shards(df.repartition(n), 9).collect()} for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 200
    out = assign_shards(df, 9)
    assert out.columns == [*df.columns, "curve", "shard", "slot"]
    assert {(r.salt, r.tie, r["of"], r.cell0, r.Cell1) for r in out.collect()} == {(1, "t", 5, 7, "c")}


def test_chat_of_very_many_turns(spark):
    n = 10_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[SEP]"), "id").alias("text"))
    r = chat_digest(turns.withColumn("score", F.lit(1))).first()
    roles = ["user" if k % 5 < 2 else "assistant" for k in range(n)]
    assert r.n_turns == n
    assert r.turns_sha256 == sha("".join(f"{role}\n[SEP]{k}\n" for k, role in enumerate(roles)))
    assert r.loss_sha256 == sha("".join(f"[SEP]{k}" for k, role in enumerate(roles) if role == "assistant"))
