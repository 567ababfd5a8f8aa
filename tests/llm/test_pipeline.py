"""The pipeline against a brute-force version of its stages, and its behaviour on odd tables."""

import re

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import Window
from pyspark.sql import functions as F
from tests.llm.test_neardup import brute as near_brute

from quernstone.llm.pieces import MODEL

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def plain(a, b):
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            new[j + 1] = max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, new[j] - 1)
        best, h = max(best, max(new)), new
    return best


def contaminated(text, items):
    tw = words(text)
    return any(2 * len(set(iw) & set(tw)) and plain(iw, tw) >= len(iw) for iw in items if len([x for x in iw if x in set(tw)]) * 2 >= len(iw))


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    owner = {}
    for i, t in kept:
        key = t.encode().lower()
        owner[key] = max(owner.get(key, -1), i)
    kept = [(i, t) for i, t in kept if owner[t.encode().lower()] == i]
    groups = near_brute(kept, 5)
    kept = [(i, t) for i, t in kept if groups[i][1] == i or not groups[i][0]]
    kept = [(i, t) for i, t in kept if not contaminated(t, items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in kept)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(got[i].ids == sp.encode(t) and got[i].round_trip for i, t in kept)


@pytest.mark.parametrize("k", range(5))
def test_odd_tables(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row_id int, gone_key string, text_hash string, text_key string"
    base = [(i, f"the quick brown fox number {i} went with them over there", "en", "s", 1, "x", 1, "y", "z", "w") for i in range(30)]
    odd = [(100, None, None, None, None, None, None, None, None, None), (101, "", "en", "s", 1, "x", 1, "y", "z", "w"), (102, "1234", "en", "s", 1, "x", 1, "y", "z", "w"), (None, "the null id with letters", "en", "s", 1, "x", 1, "y", "z", "w")]
    odd += [base[3], base[3], (103, "word " * 50_000, "en", "s", 1, "x", 1, "y", "z", "w")]
    stage = corpus_pipeline.STAGES[k][1]
    docs = spark.createDataFrame(base + odd, schema)
    out = stage(spark, docs, SF)
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    if k < 4:
        assert out.dtypes == docs.dtypes
    assert {"103", "None"} <= set(ids)
    if k < 4:  # columns with the names that operators use come out as they went in
        assert {(r.score, r.row_id, r.gone_key, r.text_hash, r.text_key) for r in out.collect()} <= {("x", 1, "y", "z", "w"), (None,) * 5}
    if k == 0:
        assert len(ids) == len(base + odd) - 3
    if k == 1:
        assert len(ids) == len(set(ids)) == 34
    assert stage(spark, docs.filter(F.lit(False)), SF).count() == 0


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(4).withColumn("doc_id", F.monotonically_increasing_id() + 10**9)
    foreign = F.element_at(F.array(*[F.lit(x) for x in ("обычный текст на другом языке", "这是一个普通的文本", "qqq jjj zzzx kkk vvv", "12 34")]), (F.row_number().over(Window.orderBy("doc_id"))).cast("int"))
    more = more.withColumn("text", foreign).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs.union(more), SF)
    assert kept.filter("doc_id >= 1000000000").count() == 0
    assert kept.count() > 0.99 * docs.filter("text rlike '[a-z]'").count()


def test_rows_that_repeat_an_id_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    a, b = ("one two three four five six seven eight nine ten eleven twelve", "quite another text that nothing else in here is anything like at all")
    rows = spark.createDataFrame([(3, a, "en", "s", 1), (5, a + " more", "en", "s", 1), (5, b, "en", "s", 1)], docs.schema)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near(spark, rows, SF).collect()) == [(3, a), (5, b)]
