"""Every query with SQL against that SQL, and the operators that SQL does not express against brute force."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quernstone.operators import graph, interval, relational, text
from quernstone.plans import catalogue, estate_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chunks_hold_the_whole_text():
    for body in ("", "a" * 9001, "p one.\n\np two.\n\n" * 700, "line\n" * 3000, "s. " * 5000, "x" * 5000 + "\n\n" + "y" * 10):
        pieces = text.cut_section(body)
        assert "".join(pieces) == body and all(len(p) <= text.CHUNK for p in pieces)


def test_interval_joins_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    a = [(i, rnd.randint(0, 2), lo := rnd.randint(0, 300), lo + rnd.randint(1, 90)) for i in range(120)]
    df = spark.createDataFrame(a, "id int, k int, lo long, hi long")
    got = {(r.id, r.r_id) for r in interval.overlap_join(df, df, ["k"], "lo", "hi", 16).collect()}
    assert got == {(x[0], y[0]) for x in a for y in a if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    p = spark.createDataFrame([(i, i % 3, i * 2) for i in range(200)], "n int, k int, at long")
    got = {(r.n, r.id) for r in interval.point_join(p, df, ["k"], "at", "lo", "hi", 16).collect()}
    assert got == {(i, x[0]) for i in range(200) for x in a if x[1] == i % 3 and x[2] <= i * 2 < x[3]}
    got = sorted((r.n, r.r_n) for r in interval.band_join(p, p, ["k"], "at", 9).collect())
    assert got == sorted((i, j) for i in range(200) for j in range(200) if i % 3 == j % 3 and abs(i * 2 - j * 2) <= 9)


def test_ancestors_and_cycles(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 3)], "node long, parent long")
    got = {(r.node, r.ancestor, r.distance) for r in graph.ancestors(tree).collect()}
    assert {(5, 1, 3), (4, 4, 0), (3, 1, 2)} <= got and len(got) == 1 + 2 + 3 + 4 + 4
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    root = spark.createDataFrame([(1,)], "node long")
    assert graph.closure(loop, root).count() == 3 and graph.bounded_reach(loop, root, 1).count() == 2


def test_mentions_with_short_terms(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five yy"), (2, "short term"), (3, None)], "d long, text string")
    terms = spark.createDataFrame([(10, "one two three four five"), (11, "term"), (12, "one two three four six")], "t long, text string")
    assert sorted((r.d, r.t) for r in text.mentions(docs, "d", terms, "t").collect()) == [(1, 10), (2, 11)]


def test_budget_is_the_same_in_parts(spark):
    df = spark.createDataFrame([(k, i, (i * 7) % 50 + 1) for k in range(3) for i in range(200)], "k int, i int, n int")
    got = {(r.k, r.i) for r in relational.prefix_within_budget(df, ["k"], "n", ["i"], 300).collect()}
    want = set()
    for k in range(3):
        total = 0
        for n, i in sorted(((i * 7) % 50 + 1, i) for i in range(200)):
            total += n
            if total > 300:
                break
            want.add((k, i))
    assert got == want


def test_stream_without_repeats(spark, tmp_path):
    from quernstone.streaming import deduplicated

    rows = [(k % 7, f"2024-01-01 00:0{k % 6}:00") for k in range(60)]
    spark.createDataFrame(rows, "k int, at string").selectExpr("k", "cast(at as timestamp) as at").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
    run = deduplicated(stream, ["k"], "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))


def test_fetch_list(spark):
    from quernstone.operators import recovery

    needed = spark.createDataFrame([("L1", "A", "P"), ("L1", "B", "P"), ("L1", "B", "Q"), ("L2", "C", "Q")], "dataset string, copybook string, program string")
    held = spark.createDataFrame([("L2", "C"), ("L1", "A")], "dataset string, copybook string")
    assert [tuple(r) for r in recovery.fetch_list(needed, held).collect()] == [("L1", "B", "P,Q", 1)]
