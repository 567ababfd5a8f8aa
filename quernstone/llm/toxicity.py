"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic rows carry a label in training; all other text is unlabelled. The risk estimator is the
non-negative one: ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` with the logistic loss, minimised in numpy by
Adam with the ascent step of the method whenever the second part is negative. ``MEMBERS`` linear classifiers, each on its
own half of the unlabelled sample, are averaged.

Features are the lower-cased words and the beginnings of words (``PREFIXES`` bytes long), by their counts (1+log n). The
``FEATURES`` used are chosen by how much more often they occur in positive than in unlabelled documents, counted by Spark
over all training rows and whole texts (added up within a task before anything is shuffled); of positive documents that
are copies of each other one counts, or else all words of a much copied document would pass for toxic ones. The gradient fit alone is on
a bounded sample: at most ``POSITIVE`` positive and ``UNLABELLED`` unlabelled documents, those with the smallest hashes
of doc_id; their ids are broadcast (7,000 numbers at most). Ids of positive rows are broadcast where there are ``SENT`` or
fewer, else texts and labels are joined by a shuffle.

The class prior is the share of toxic rows among all labelled training rows unless it is given.

Defined results: null and empty text score by the bias alone; with no positive rows all scores are 0; repeated labels
of a document count as toxic when any of them is; null labels or ids teach nothing; all columns but doc_id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import wordhash, worker
from quernstone.llm.sampling import smallest_hashes
from quernstone.session import cut

POSITIVE, UNLABELLED, FEATURES, MEMBERS = 3000, 4000, 10_000, 3
SENT, FLUSH = 1_000_000, 600_000
EVIDENCE = 6.0  # half the G statistic that a feature must reach (by chance one feature in two thousand does)
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)


@dataclass
class ToxicityModel:
    known: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, text: pa.Array) -> np.ndarray:
        rows, cols, n = occurrences(text, self.known)
        return np.bincount(rows, (1 + np.log(n)) * self.weights[cols], minlength=len(text)) + self.bias


def _features(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Families of hashes, one entry per word each (0: none), and the word offsets of the documents."""
    raw, offsets = wordhash.column(pc.utf8_lower(text.cast(pa.string())))
    starts, at = wordhash.word_starts(raw, offsets, wordhash.PUNCT)
    whole = wordhash.word_hashes(raw, starts, wordhash.PUNCT, lower=False)
    return [whole, *wordhash.prefix_hashes(raw, starts, wordhash.PUNCT, PREFIXES)], at


def occurrences(text: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index into known, count) of the known features of a batch."""
    cells = [np.zeros(0, np.int64)]
    if len(known):
        sieve = np.zeros(1 << 16, bool)
        sieve[(known >> np.uint64(48)).astype(np.int64)] = True
        families, at = _features(text)
        for h in families:
            word = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, h[word]), len(known) - 1)
            ok = known[place] == h[word]
            cells.append((np.searchsorted(at, word[ok], "right") - 1) * len(known) + place[ok])
    cell, n = np.unique(np.concatenate(cells), return_counts=True)
    width = max(1, len(known))
    return cell // width, cell % width, n


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of each text's runs of four words, which copies have in common, edited or not."""
    worker.release()
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            least = [s[:1] if len(s) else np.zeros(1, np.uint64) for s in wordhash.shingle_sets(batch.column("text"), 4)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0, np.uint64), *least]).view(np.int64))], ["doc_id", "signature"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of each feature among positive rows and among all."""
    worker.release()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, inverse = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
        return hashes, *(np.bincount(inverse, np.concatenate([h[k] for h in held]), minlength=len(hashes)).astype(np.int64) for k in (1, 2))

    def rows(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found[0]), 100_000):
            h, p, u = (x[at : at + 100_000] for x in found)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(p), pa.array(u)], ["feature", "p", "u"])

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            families, bounds = _features(batch.column("text"))
            positive = np.array(batch.column("p").to_pylist(), bool)
            seen = [np.unique(np.concatenate([h[a:b] for h in families])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            every = np.concatenate(seen)
            hashes, inverse = np.unique(every, return_inverse=True)
            marked = positive[np.repeat(np.arange(len(seen)), [len(x) for x in seen])]
            held.append((hashes, np.bincount(inverse, marked, minlength=len(hashes)), np.bincount(inverse, minlength=len(hashes))))
            size += len(hashes)
            if size > 2 * FLUSH:
                held = [added()]
                size = len(held[0][0])
                if size > FLUSH:
                    yield from rows(held[0])
                    held, size = [], 0
    if held:
        yield from rows(added())


def _vectors(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, cols, n = occurrences(batch.column("text"), known)
                cut_at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                each = [(cols[a:b].astype(np.uint16).tobytes(), n[a:b].astype(np.float32).tobytes()) for a, b in zip(cut_at[:-1], cut_at[1:])]
                yield pa.record_batch(
                    [batch.column("p"), batch.column("u"), pa.array([x[0] for x in each], pa.binary()), pa.array([x[1] for x in each], pa.binary())],
                    ["p", "u", "cols", "n"],
                )

    return run


@dataclass
class Rows:
    """Sparse rows: the cells of row k are those from start[k] to start[k+1]."""

    start: np.ndarray
    cols: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, rows: np.ndarray) -> Rows:
        n = self.start[rows + 1] - self.start[rows]
        end = np.cumsum(n)
        cells = np.repeat(self.start[rows] - (end - n), n) + np.arange(int(n.sum()))
        return Rows(np.append(0, end), self.cols[cells], self.values[cells])

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.start)), w[self.cols] * self.values, minlength=len(self))

    def weighted(self, d: np.ndarray, width: int) -> np.ndarray:
        """The sum of the rows, each times its weight."""
        return np.bincount(self.cols, np.repeat(d, np.diff(self.start)) * self.values, minlength=width)


def risk(w: np.ndarray, xp: Rows, xu: Rows, prior: float) -> tuple[float, bool, np.ndarray]:
    """(risk, whether its second part is clipped, gradient to follow): the ascent step on that part where it is negative."""
    gp, gu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
    sp, su = 1 / (1 + np.exp(-np.clip(gp, -40, 40))), 1 / (1 + np.exp(-np.clip(gu, -40, 40)))
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    clipped = bool(negative < 0)
    if clipped:
        dp, du = prior * sp / len(xp), -su / len(xu)
    else:
        dp, du = prior * (sp - 1) / len(xp) - prior * sp / len(xp), su / len(xu)
    grad = np.append(xp.weighted(dp, len(w) - 1) + xu.weighted(du, len(w) - 1), dp.sum() + du.sum())
    return float(prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)), clipped, grad


def nnpu(xp: Rows, xu: Rows, width: int, prior: float, seed: int, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear classifier minimising the non-negative PU risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p, u = xp[rng.integers(0, len(xp), min(len(xp), 512))], xu[rng.integers(0, len(xu), min(len(xu), 1024))]
        grad = risk(w, p, u, prior)[2]
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, prior: float | None = None) -> ToxicityModel:
    """``train``: a condition on doc_id; no other row's label or text is used."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    if not prior:
        return none
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    toxic = known.filter("toxic = 1").select("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(train & F.col("doc_id").isNotNull())
    few = toxic.count() <= SENT
    small = lambda ids: F.broadcast(ids) if few else ids
    signed = texts.join(small(toxic), "doc_id").mapInArrow(_signatures, "doc_id bigint, signature bigint")
    flags = cut(signed.groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("p")))
    flagged = texts.join(small(flags), "doc_id", "left").select("text", F.coalesce("p", F.lit(False)).alias("p"))
    a, b = (max(1, x or 0) for x in flagged.agg(F.sum(F.col("p").cast("int")), F.count(F.lit(1))).first())
    pool = (F.col("p") + F.col("u")) / (a + b)
    gain = F.col("p") * F.log(F.col("p") / a / pool) + F.col("u") * F.log(F.col("u") / b / pool)
    best = (
        flagged.mapInArrow(_frequencies, "feature bigint, p bigint, u bigint")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .filter((F.col("feature") != 0) & (F.col("p") >= 5) & (F.col("p") / a > F.col("u") / b) & (gain >= EVIDENCE))
        .orderBy(gain.desc(), "feature")
        .limit(FEATURES)
        .select("feature")
        .collect()
    )
    positive, unlabelled = set(smallest_hashes(toxic, POSITIVE, 9)), set(smallest_hashes(texts, UNLABELLED, 9))
    wanted = docs.sparkSession.createDataFrame([(i, i in positive, i in unlabelled) for i in sorted(positive | unlabelled)], "doc_id long, p boolean, u boolean")
    # of rows that repeat an id one stands for all, so that no more than the bound reaches the driver
    sample = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("p").alias("p"), F.max("u").alias("u")).select("text", "p", "u")
    chosen = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))
    vectors = sample.mapInArrow(_vectors(chosen), "p boolean, u boolean, cols binary, n binary").collect()
    cols, n = [np.frombuffer(r.cols, np.uint16) for r in vectors], [np.frombuffer(r.n, np.float32) for r in vectors]
    flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (cols, n)]
    every = Rows(np.cumsum([0, *map(len, cols)]), flat[0].astype(np.int64), 1 + np.log(flat[1]))
    xp, xu = (every[np.flatnonzero([r[k] for r in vectors])] for k in ("p", "u"))
    if not len(xp) or not len(xu):
        return none
    half = [xu[np.arange(k % 2, len(xu), 2)] if len(xu) > 1 else xu for k in range(MEMBERS)]
    fits = [nnpu(xp, own, len(chosen), prior, k) for k, own in enumerate(half)]
    return ToxicityModel(chosen, np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits])))


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                score = 1 / (1 + np.exp(-np.clip(model.logits(batch.column("text")), -40, 40)))
                yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_score(model), "doc_id bigint, score double, predicted int")


def toxicity_predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 of 5 teach nothing."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, labels, rest != 0)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")
