"""Base scores against brute force, the model's probabilities against a plain forward pass."""

import copy
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import lm
from quernstone.llm.lm import Slice, Tokenizer, corpus_scores, train

DOC = "doc_id long, text string, score string, n_tokens int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\0end"]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    c = Counter(w for i, t, *_ in rows if i is not None and not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(
        (str(i), i is not None and held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6))
        for i, t, *_ in rows
    )


def check(spark, rows):
    out = corpus_scores(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    return out


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 100)
    full = train
    monkeypatch.setattr(lm, "train", lambda sample, counts: full(sample, counts, steps=60))


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 50)
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text, "x", 1) for r in source]
    rows += [(9000, None, None, None), (9001, "", "x", 1), (9002, "Same same\tSAME\n é\x0b\x1f x", "x", 1), (9003, "long Word " * 30_000, "x", 1), (9004, "x" * 100_000, "x", 1)]
    rows += [rows[5], rows[5], (None, "some words", "x", 1)]
    check(spark, rows)


def test_small_tables(spark):
    assert corpus_scores(spark.createDataFrame([], DOC)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    out = check(spark, [(held, "a b", "x", 1)])
    assert out[0].train_tokens == 0 and out[0].base_score == 0


def test_subword_ids_per_text():
    t = Tokenizer.load()
    texts = ["Ab cd", None, "", "cd  ab\nzz", "É", "cd"]
    ids, n = Slice(pa.array(texts)).stream(t)
    want = [[*[x for w in words(s)[:-1] for x in t.ids([w])[0].tolist()], t.end] for s in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_attention_against_a_plain_pass():
    rng = np.random.default_rng(0)
    sample = [rng.integers(0, 60, k).astype(np.int32) for k in (5, 40, 16, 100, 33)]
    counts = np.bincount(np.concatenate(sample), minlength=64).astype(float)
    model = lm.train(sample, counts)
    texts = [rng.integers(0, 64, k).astype(np.int32) for k in (1, 15, 16, 17, 90)]
    got = model.log_prob(np.concatenate(texts), np.array([len(x) for x in texts]))
    d, step = lm.WIDTH, lm.STEP
    for ids, value in zip(texts, got):
        inputs, total = [len(counts), *ids[:-1].tolist()], 0.0
        for t in range(len(ids)):
            lo, place = max(0, t // step * step - step), t % step
            x = model.table[inputs[lo : t + 1]].astype(float)
            weight = np.exp(x[-1, :d] @ x[:, d : 2 * d].T + [model.bias[place, step + place - (t - j)] for j in range(lo, t + 1)])
            h = np.concatenate([(weight @ x[:, 2 * d : 3 * d]) / weight.sum(), x[-1, 3 * d :]])
            logits = h @ model.out
            total += logits[model.class_of[ids[t]]] - np.log(np.exp(logits).sum()) + model.log_share[ids[t]]
        assert abs(total - value) < 1e-3 * len(ids)
    shares = np.bincount(model.class_of, np.exp(model.log_share))
    assert np.allclose(shares[shares > 0], 1, atol=1e-4)


def test_training_beats_the_unigram():
    rng = np.random.default_rng(1)
    follow = rng.integers(0, 50, 50)
    sample = []
    for _ in range(60):
        ids = [int(rng.integers(50))]
        for _ in range(120):
            ids.append(int(follow[ids[-1]]) if rng.random() < 0.8 else int(rng.integers(50)))
        sample.append(np.array(ids, np.int32))
    counts = np.bincount(np.concatenate(sample[:40]), minlength=50).astype(float)
    model = train(sample[:40], counts, steps=400)
    test = np.concatenate(sample[40:])
    unigram = np.log((counts + 1) / (counts.sum() + 50))[test].sum()
    assert model.log_prob(test, np.array([len(x) for x in sample[40:]])).sum() > 0.75 * unigram


@pytest.mark.parametrize("common", [0, 40, 200_000])
def test_pairs_of_all_training_rows_count(spark, monkeypatch, common):
    """Whatever the sample, each id's probability holds the counts of all training rows."""
    monkeypatch.setattr(lm, "SAMPLE", 5)
    monkeypatch.setattr(lm, "COMMON_PAIRS", common, raising=False)
    models, quick = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: models.append(quick(*a)) or models[-1])
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 30)), "x", 1) for i in range(60)] + [(60, None, "x", 1), (None, "w1 w2 zebra", "x", 1)]
    out = {r.doc_id: r.score for r in corpus_scores(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    t = Tokenizer.load()
    texts = {i: Slice(pa.array([text], pa.string())).stream(t)[0] for i, text, *_ in rows}
    pairs = Counter(p for i, ids in texts.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for p in zip([t.end, *ids[:-1].tolist()], ids.tolist()))
    follow, kinds = Counter(), Counter(a for a, _ in pairs)
    for (a, _), n in pairs.items():
        follow[a] += n
    for i, ids in texts.items():
        want = 0.0
        for a, b, log_p in zip([t.end, *ids[:-1].tolist()], ids.tolist(), models[0].each(ids, np.array([len(ids)])).tolist()):
            want += math.log10((pairs[a, b] + (follow[a] + kinds[a]) * math.exp(log_p)) / (2 * follow[a] + kinds[a]) if follow[a] else math.exp(log_p))
        assert abs(want - out[i]) < 1e-4 * len(ids)


def test_every_id_of_every_text_is_a_target_once(monkeypatch):
    """One task's changes are those of a plain pass over all its ids, a long text and odd rows too."""
    t = Tokenizer.load()
    texts = ["alpha beta gamma " * 40, None, "", "long words of one text " * 9000, "end"] * 2
    streams = [Slice(pa.array([x], pa.string())).stream(t)[0] for x in texts]
    counts = np.bincount(np.concatenate(streams), minlength=t.size).astype(float)
    start = train(streams[:1], counts, steps=5).fit
    taken, full = [], lm.Fit.step
    monkeypatch.setattr(lm.Fit, "step", lambda self, x, y, *a, **k: taken.append(np.stack([x[:, lm.STEP :], y])) or full(self, x, y, *a, **k))
    (out,) = lm._learn(start, t)(iter([pa.record_batch([pa.array(texts)], ["text"])]))
    got = Counter((a, b) for part in taken for a, b in zip(part[0].ravel().tolist(), part[1].ravel().tolist()) if b != t.size + 1)
    assert got == Counter(p for ids in streams for p in zip([t.size, *ids[:-1].tolist()], ids.tolist()))
    rows = dict(zip(out.column("row").to_pylist(), out.column("n").to_pylist()))
    assert rows[t.size + 2] == counts.sum() and set(np.flatnonzero(counts[: t.end])) <= set(rows) | {t.end}


def test_the_model_learns_from_rows_outside_the_sample(spark, monkeypatch):
    """The vectors of words that no document of the sample holds move, and the text they make becomes likelier."""
    monkeypatch.setattr(lm, "SAMPLE", 3)
    starts, models, quick = [], [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: models.append(quick(*a)) or starts.append(copy.deepcopy(models[-1])) or models[-1])
    drawn, full = [], lm.smallest_hashes
    monkeypatch.setattr(lm, "smallest_hashes", lambda *a: drawn.extend(full(*a)) or drawn)
    line = "quiet river under heavy morning fog moves slowly past sleeping villages"
    ids = spark.range(400).selectExpr("id as doc_id")
    sample = set(full(ids.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"), 3, 8))
    rows = [(i, "other plain text" if i in sample else " ".join([line] * 6), "x", 1) for i in range(400)]
    assert corpus_scores(spark.createDataFrame(rows, DOC).repartition(2)).count() == 400 and set(drawn) == sample
    t = Tokenizer.load()
    stream, n = Slice(pa.array([line])).stream(t)
    model = models[0]
    only = np.setdiff1d(stream, Slice(pa.array(["other plain text"])).stream(t)[0])
    assert (model.table[only] != starts[0].table[only]).any(axis=1).all()
    assert model.log_prob(stream, n)[0] > starts[0].log_prob(stream, n)[0] + 1


def test_classes_come_from_pairs_of_all_rows():
    """Ids that the sample never shows are grouped by their neighbours in the counts."""
    rng = np.random.default_rng(4)
    counts = np.sort(rng.integers(50, 5000, 2000))[::-1].astype(float)
    middle, common = lm.Counts.grouped(counts)
    kind = rng.integers(0, 2, len(middle))
    before, after = common[np.where(kind, 3, 7)], middle
    class_of = train([], lm.Counts(counts, before, after, counts[middle])).class_of
    assert not set(class_of[middle[kind == 0]]) & set(class_of[middle[kind == 1]])
    assert class_of[middle].max() < lm.SINGLES + lm.SHARED - lm.BINS


def test_a_run_of_blocks_learns_what_its_windows_do():
    """Several blocks at once, padding and texts' borders among them, change all weights as one window per block does."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 60, k).astype(np.int32) for k in (5, 40, 16, 100, 33, 1, 250)]
    start = train(texts, np.bincount(np.concatenate(texts), minlength=64).astype(float), steps=30).fit
    inputs, stream, scored = lm._windows(texts, 64)
    lack = np.full((lm.STEP - len(stream)) % (4 * lm.STEP), 65, np.int32)
    inputs, stream = np.append(inputs, lack), np.append(stream, lack)
    whole, single = start.copy(), start.copy()
    for fit, starts, blocks in ((whole, np.arange(lm.STEP, len(stream), 4 * lm.STEP), 4), (single, scored, 1)):
        rows = starts[:, None]
        for _ in range(3):
            fit.step(inputs[rows + np.arange(-lm.STEP, blocks * lm.STEP)], stream[rows + np.arange(blocks * lm.STEP)], 0.01)
    for name in start.w:
        assert np.allclose(whole.w[name], single.w[name], atol=1e-4)
        assert not np.allclose(whole.w[name], start.w[name], atol=1e-3)


def test_neighbouring_targets_share_their_context(monkeypatch):
    """Training looks up little more than one vector per target, though every window is twice its targets."""
    t = Tokenizer.load()
    texts = ["alpha beta gamma delta " * 400, "other words of one text " * 300]
    counts = np.bincount(Slice(pa.array(texts)).stream(t)[0], minlength=t.size).astype(float)
    start = train([], counts, steps=5).fit
    taken, full = [], lm.Fit.step
    monkeypatch.setattr(lm.Fit, "step", lambda self, x, y, *a, **k: taken.append((x.size, int((y != t.size + 1).sum()))) or full(self, x, y, *a, **k))
    list(lm._learn(start, t)(iter([pa.record_batch([pa.array(texts)], ["text"])])))
    looked_up, targets = np.sum(taken, axis=0)
    assert targets == counts.sum() and looked_up < 1.5 * targets
