"""Language identification and toxicity: held-out accuracy and defined results."""

import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import language, toxicity

DATA = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, lang_pred string, score string"


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1, -1)
    w = language.linear_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.language_predictions(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    rows = out.filter("held_out and n_chars > 40").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and out.count() == docs.count()


def test_language_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a = language.language_predictions(docs)
    held = language.fold("doc_id", 4) == 2
    b = language.language_predictions(docs.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit("x")))
    assert a.exceptAll(b).count() == 0


def test_language_edges(spark):
    en, de = "the weather was fine that day and they went with others ", "und der die das ist nicht mit einem schönen wetter "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de", "x", "y") for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", "en", None, None), (102, "12 !? ²", None, None, None), (103, "漢字", None, None, None), (104, en * 20_000, None, None, None), (None, de, "de", None, None), (3, en, "en", "x", "y")]
    out = language.identify(df := spark.createDataFrame(rows, DOC), language.fit(df))
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] in ("en", "de") and got[104][0] == "en" and got[None][0] == "de" and got[1][0] == "en"
    none = language.language_predictions(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.language_predictions(spark.createDataFrame([], DOC)).count() == 0


def plain_trigrams(text):
    """Counts of hashed trigrams, one by one."""
    raw = [c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
    raw += [32] * (3 - len(raw)) if raw else []
    out = {}
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if (a, b, c) != (32, 32, 32):
            h = ((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language.BITS
            out[h] = out.get(h, 0) + 1
    return out


def test_language_against_a_plain_version(spark):
    """Family first, then the votes of pairs within it, and the likeness, by loops over dicts."""
    rnd = random.Random(3)
    langs = {"en": "the of and weather", "de": "der und wetter schön", "nl": "het van weer mooi", "fr": "le temps était beau", "es": "el tiempo era bueno", "it": "il tempo era bello", "xx": "zorp blik fnord"}
    rows = [(i, " ".join(rnd.choices(words.split(), k=rnd.choice([1, 6, 30]))), lang) for i in range(60) for lang, words in langs.items()]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)] + [(900, "Ärger, über ALLES! 12", None), (901, "Wo", None), (902, "это по-русски", None), (903, "qqq jjj", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert [sorted(f) for f in model.families] == [["de", "en", "nl"], ["xx"], ["es", "fr", "it"]]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    kept = {r.doc_id for r in language.keep_identified(df, model).collect()}
    names = [x for f in model.families for x in f]
    for i, text, _ in rows:
        n = plain_trigrams(text)
        size = sum(n.values())
        x = {h: (c / size) ** 0.5 for h, c in n.items()}
        margin = [sum(v * float(model.weights[h, k]) for h, v in x.items()) + float(model.weights[-1, k]) for k in range(model.weights.shape[1])]
        f = [np.exp(language.SHARP * m) for m in margin[: len(model.families)]]
        top = int(np.argmax(f))
        votes = dict.fromkeys(model.families[top], 0.0)
        for col, (k, a, b) in enumerate(model.pairs(), len(model.families)):
            if k == top:
                p = 1 / (1 + np.exp(-language.SHARP * margin[col]))
                votes[model.families[top][a]] += p
                votes[model.families[top][b]] += 1 - p
        best = max(votes, key=votes.get)
        score = f[top] / sum(f) * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1)
        assert got[i][0] == best and abs(got[i][1] - score) < 1e-3, text
        like = sum(c / size * float(model.shares[h, names.index(best)]) for h, c in n.items())
        assert abs(like) < 1e-4 or (i in kept) == (like > 0), text
    assert not {902, 903} & kept and {0, 1, 2} <= kept
    only = language.keep_identified(df, model, ["fr", "xx"]).collect()
    assert {r.lang for r in only if r.lang} == {"fr", "xx"}


def test_svm_reaches_the_optimum():
    """The dual's solution against plain gradient descent on the primal objective."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 60) > 0.3, 1, -1)
    c = 2.0
    share = {s: int((y == s).sum()) for s in (-1, 1)}
    weight = np.array([c * len(y) / (2 * share[s]) for s in y])
    full = np.concatenate([x, np.full((60, 1), 0.3)], axis=1)

    def loss(w):
        return w @ w / 2 + (weight * np.maximum(0, 1 - y * (full @ w)) ** 2).sum() / 1

    best = np.zeros(5)
    for step in range(20000):
        slack = np.maximum(0, 1 - y * (full @ best))
        best -= 0.0005 * (best - 2 * full.T @ (weight * y * slack))
    w = language.linear_svm(x, y, c, epochs=400).astype(float)
    w[-1] /= 0.3
    assert loss(w) < loss(best) * 1.02 + 1e-6


def test_toxicity_held_out(spark):
    """At sf0.1, since sf0.01 has six toxic documents among its held-out labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_predictions(docs, labels).cache()
    assert out.count() == docs.count() == out.filter("score between 0 and 1 and predicted = cast(score >= 0.5 as int)").count()
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    positive, negative = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert len(positive) >= 90 and len(negative) >= 600
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in negative] for p in positive])
    assert auc > 0.93 and np.mean([p >= 0.5 for p in positive]) > 0.75 and np.mean([n >= 0.5 for n in negative]) < 0.03, auc


def sparse(x):
    return toxicity.Rows(np.arange(len(x) + 1) * x.shape[1], np.tile(np.arange(x.shape[1]), len(x)), x.reshape(-1))


def test_risk_and_gradient_against_a_plain_version():
    rng = np.random.default_rng(7)
    states = set()
    for trial in range(40):
        xp, xu, w, prior = rng.normal(size=(9, 4)), rng.normal(size=(13, 4)) - trial % 2, rng.normal(size=5) * 2, rng.uniform(0.05, 0.9)

        def parts(w, xp=xp, xu=xu, prior=prior):
            loss = lambda z: np.log1p(np.exp(-z))
            score = lambda x: [float(sum(a * b for a, b in zip(row, w[:-1])) + w[-1]) for row in x]
            positive = prior * np.mean([loss(z) for z in score(xp)])
            negative = np.mean([loss(-z) for z in score(xu)]) - prior * np.mean([loss(-z) for z in score(xp)])
            return positive, negative

        positive, negative = parts(w)
        value, clipped, grad = toxicity.risk(w, sparse(xp), sparse(xu), prior)
        assert abs(value - positive - max(0, negative)) < 1e-9 and clipped == (negative < 0)
        states.add(clipped)
        for k in range(5):
            step = np.eye(5)[k] * 1e-6
            (p1, n1), (p0, n0) = parts(w + step), parts(w - step)
            slope = -(n1 - n0) / 2e-6 if clipped else (p1 + n1 - p0 - n0) / 2e-6
            assert abs(slope - grad[k]) < 1e-6
    assert states == {True, False}


def test_feature_counts_and_scores_against_plain_versions(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(5)
    words = ["Vile", "vilest", "good", "morning", "ümlaut", "a", "x" * 30]
    texts = [None if i == 3 else " ".join(rnd.choices(words, k=rnd.randint(0, 12))) for i in range(300)]
    positive = [i % 4 == 0 for i in range(300)]
    monkeypatch.setattr(toxicity, "FLUSH", 20)
    batches = [pa.record_batch([pa.array(texts[a : a + 50]), pa.array(positive[a : a + 50])], ["text", "p"]) for a in range(0, 300, 50)]
    got: dict = {}
    for b in toxicity._frequencies(iter(batches)):
        for h, p, u in zip(*(c.to_pylist() for c in b.columns)):
            was = got.get(h, (0, 0))
            got[h] = (was[0] + p, was[1] + u)
    got.pop(0, None)

    def features(t):
        out = []
        for w in (t or "").lower().split():
            raw = w.encode()
            out += [("word", raw), *[(n, raw[:n]) for n in toxicity.PREFIXES if len(raw) > n]]
        return out

    want: dict = {}
    for t, p in zip(texts, positive):
        for f in set(features(t)):
            was = want.get(f, (0, 0))
            want[f] = (was[0] + p, was[1] + 1)
    assert sorted(got.values()) == sorted(want.values())
    known = np.sort(np.array(list(got), np.int64).view(np.uint64))
    weights = np.random.default_rng(1).normal(size=len(known))
    model = toxicity.ToxicityModel(known, weights, -0.5)
    got_scores = model.logits(pa.array(texts, pa.string()))
    # each word's own feature hashes, from texts of that word alone
    of = {w: [int(h) for f in toxicity._features(pa.array([w]))[0] for h in f if h] for w in {w for t in texts for w in (t or "").split()}}
    place = {int(h): k for k, h in enumerate(known)}
    for t, s in zip(texts, got_scores):
        n: dict = {}
        for w in (t or "").split():
            for h in of[w]:
                n[h] = n.get(h, 0) + 1
        assert abs(s - (-0.5 + sum((1 + np.log(c)) * weights[place[h]] for h, c in n.items()))) < 1e-9


def test_toxicity_uses_positive_labels_of_training_rows_only(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = language.fold("doc_id", 5) == 0
    a = toxicity.toxicity_predictions(docs, labels)
    b = toxicity.toxicity_predictions(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert a.exceptAll(b).count() == 0


def test_toxicity_edges(spark):
    rnd = random.Random(2)
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choices(words, k=30) + (["Vile!"] if i % 4 == 0 else [])), "en", "x", "y") for i in range(400)]
    rows += [(500, None, None, None, None), (501, "", None, None, None), (502, "vile " * 50_000, None, None, None), (None, "vile", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(200)] + [(0, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, toxic int, score int")
    got = {r.doc_id: r for r in toxicity.toxicity_predictions(docs, labels).collect()}
    assert len(got) == len(rows) and got[500].score == got[501].score < 0.5 < got[502].score
    right = [got[i].predicted == (i % 4 == 0) for i in range(200, 400)]
    assert sum(right) / len(right) > 0.95
    none = toxicity.toxicity_predictions(docs, labels.filter("toxic = 0")).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity_predictions(spark.createDataFrame([], DOC), labels).count() == 0
