"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the lower-cased text (all that is not a letter counts as a space), square-rooted
and scaled to length one, over whole texts. One linear SVM per family (one against the rest) picks the family; within
it one linear SVM per pair of languages votes by its margin. SVMs are fitted in numpy by dual coordinate descent on a
bounded sample: at most ``PER_LANGUAGE`` labelled documents of each language, the ones with the smallest hash of doc_id.
Everything else (languages present, their counts, predictions) covers all rows. More than ``MOST_LANGUAGES`` different
labels are refused, since one row and one model part per label stands at the driver.

:func:`keep_identified` rejects documents of no learned language, in which no classifier of differences can say so: a
text's likeness is the mean over its trigrams of log(share of the trigram in the language / share if all were equally
common). Where it isn't above 0 the text is no more like the language found than like chance, whatever its length.

Defined results: null text or text without a letter is ``und`` with score 0; with no labelled rows every text is
``und``; null labels teach nothing; the sample ignores rows without doc_id; repeated rows get one prediction each; all
other columns are kept, but for a column named like a result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import wordhash, worker

BITS = 12
PER_LANGUAGE, MOST_LANGUAGES = 300, 2000
SHARP = 6.0
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = range(97, 123)
_CLASS[65:91] = range(97, 123)
_CLASS[128:] = range(128, 256)

_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn mr ne pa gu si",
    "iranian": "fa ps ku tg",
    "celtic": "ga cy gd br",
    "dravidian": "ta te ml kn",
    "austronesian": "id ms tl jv su mg",
    "cjk": "zh ja ko",
}
FAMILY_OF = {lang: family for family, langs in _FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"of {lang}")


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2**BITS) feature rows and whether each text has a letter. Call with few texts at a time: rows are dense."""
    raw, offsets = wordhash.column(pc.utf8_lower(text.cast(pa.string())))
    n = len(offsets) - 1
    counts = np.zeros((n, 1 << BITS), np.float32)
    b = _CLASS[raw]
    letters = np.concatenate([[0], np.cumsum(_ASCII[raw])])
    lettered = letters[offsets[1:]] > letters[offsets[:-1]]
    for k in np.flatnonzero(~lettered & (offsets[1:] > offsets[:-1])).tolist():
        lettered[k] = bool(_LETTER.search(bytes(raw[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")))
    for k in range(n):
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        for at in range(lo, hi, 1 << 20):
            x = b[max(lo, at - 2) : min(hi, at + (1 << 20))]
            if len(x) < 3:
                x = np.concatenate([x, np.full(3 - len(x), 32, np.uint32)])
            packed = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
            packed = packed[packed != 0x202020]
            h = (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            counts[k] += np.bincount(h, minlength=1 << BITS)
    np.sqrt(counts, out=counts)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    counts /= np.maximum(norm, 1e-9)
    return counts, lettered


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, epochs: int = 25, seed: int = 0) -> np.ndarray:
    """L2-loss linear SVM by dual coordinate descent; y in {-1, 1}; the last weight is the bias. Classes weigh the same."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([x, np.full((len(x), 1), 0.3, np.float32)], axis=1)
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    soft = np.array([share[s] * 2 / (c * len(y)) for s in y]) / 2
    q = (x * x).sum(axis=1) + soft
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + soft[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    w[-1] *= 0.3
    return w


@dataclass
class LanguageModel:
    families: list[list[str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(((1 << BITS) + 1, 0), np.float32))
    shares: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))  # log share of each trigram, against chance

    def likeness(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of each text to the language found for it; squares of features are the shares of a text's trigrams."""
        return ((x * x) @ self.shares)[np.arange(len(x)), best]

    def pairs(self) -> list[tuple[int, int, int]]:
        return [(f, a, b) for f, langs in enumerate(self.families) for a in range(len(langs)) for b in range(a + 1, len(langs))]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Index of the language and score for each feature row, and the names."""
        names = [lang for langs in self.families for lang in langs]
        m = x @ self.weights[:-1] + self.weights[-1]
        nf = len(self.families)
        f = np.exp(SHARP * (m[:, :nf] - m[:, :nf].max(axis=1, keepdims=True)))
        f /= f.sum(axis=1, keepdims=True)
        within = [np.zeros((len(x), len(langs))) for langs in self.families]
        for col, (k, a, b) in enumerate(self.pairs(), nf):
            p = 1 / (1 + np.exp(-np.clip(SHARP * m[:, col], -50, 50)))
            within[k][:, a] += p
            within[k][:, b] += 1 - p
        best, score, first = np.zeros(len(x), np.int64), np.zeros(len(x)), 0
        top = f.argmax(axis=1)
        for k, langs in enumerate(self.families):
            rows = np.flatnonzero(top == k)
            votes = within[k][rows] / max(1, len(langs) - 1) if len(langs) > 1 else np.ones((len(rows), 1))
            pick = votes.argmax(axis=1) if len(rows) else np.zeros(0, np.int64)
            best[rows] = first + pick
            score[rows] = np.clip(f[rows, k] * votes[np.arange(len(rows)), pick], 0, 1)
            first += len(langs)
        return best, score, names


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.release()
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            x, lettered = features(batch.column("text"))
            spots = [np.flatnonzero(row).astype(np.uint16) for row in x]
            keep = pa.array(lettered)
            out = pa.record_batch(
                [
                    batch.column("lang"),
                    batch.column("order"),
                    pa.array([s.tobytes() for s in spots], pa.binary()),
                    pa.array([row[s].astype(np.float16).tobytes() for row, s in zip(x, spots)], pa.binary()),
                ],
                ["lang", "order", "at", "value"],
            )
            yield out.filter(keep)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from (doc_id, text, lang); at most ``per_language`` documents of each language reach the driver."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null and doc_id is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return LanguageModel()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} different labels, more than {MOST_LANGUAGES}")
    order = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int(min(1.0, (1.3 * per_language + 30) / n) * (1 << 40)))])
    picked = rows.withColumn("order", order).filter(F.col("order") < F.element_at(share, F.col("lang")))
    sample: dict[str, list] = {}
    for r in sorted(picked.select("lang", "order", "text").mapInArrow(_sparse, "lang string, order bigint, at binary, value binary").collect(), key=lambda r: (r.lang, r.order)):
        own = sample.setdefault(r.lang, [])
        if len(own) < per_language:
            own.append(r)
    by_family: dict[str, list[str]] = {}
    for lang in sorted(sample):
        by_family.setdefault(family(lang), []).append(lang)
    families = [by_family[f] for f in sorted(by_family)]
    if not families:
        return LanguageModel()
    langs = [lang for own in families for lang in own]
    dense = {}
    for lang in langs:
        x = np.zeros((len(sample[lang]), 1 << BITS), np.float32)
        for k, r in enumerate(sample[lang]):
            x[k, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value, np.float16)
        dense[lang] = x
    model, columns = LanguageModel(families), []
    for own in families:
        if len(families) == 1:
            columns.append(np.zeros((1 << BITS) + 1, np.float32))
            continue
        rest = [lang for lang in langs if lang not in own]
        columns.append(_between([dense[x] for x in own], [dense[x] for x in rest]))
    for f, a, b in model.pairs():
        columns.append(_between([dense[families[f][a]]], [dense[families[f][b]]]))
    model.weights = np.stack(columns, axis=1)
    shares = [(dense[lang] ** 2).mean(axis=0) + 0.1 / (1 << BITS) for lang in langs]
    model.shares = np.stack([np.log((1 << BITS) * s / s.sum()) for s in shares], axis=1).astype(np.float32)
    return model


def _between(yes: list[np.ndarray], no: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate([*yes, *no])
    y = np.concatenate([np.ones(sum(map(len, yes)), np.int64), -np.ones(sum(map(len, no)), np.int64)])
    return linear_svm(x, y)


def _predict(model: LanguageModel, names_out: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                x, lettered = features(batch.column("text"))
                names = ["und"] * batch.num_rows
                scores = np.zeros(batch.num_rows)
                if model.families:
                    best, score, known = model.predict(x)
                    names = [known[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
                    scores = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, *names_out])

    return run


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns, with the language and its score under the given names."""
    docs = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(_predict(model, names), f"{schema}, `{names[0]}` string, `{names[1]}` double")


def keep_identified(docs: DataFrame, model: LanguageModel, languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows in whose text a learned language is found (one of ``languages``, if given), with all their columns.

    Rejected are texts that are null or have no letter, and those whose likeness is not above ``least``. With no learned
    language nothing can be told, and all texts with a letter stay.
    """
    wanted = None if languages is None else set(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                x, keep = features(batch.column("text").cast(pa.string()))
                if model.families and len(x):
                    best, _, known = model.predict(x)
                    keep = keep & (model.likeness(x, best) > least)
                    if wanted is not None:
                        keep &= np.array([known[b] in wanted for b in best.tolist()], bool)
                yield batch.filter(pa.array(keep))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, schema)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of fold 2 of 4 teach nothing."""
    out = fold("doc_id", 4) == 2
    model = fit(docs.filter(~F.coalesce(out, F.lit(True))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
