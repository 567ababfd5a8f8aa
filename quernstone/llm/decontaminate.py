"""Benchmark decontamination: rare word seeds, counted in windows, then local alignment.

1. Words are runs of letters, digits and non-ASCII characters, lower-cased. How often each word of the test items occurs
   in the corpus is counted.
2. A pair's score is that of a Smith-Waterman alignment (match 2, mismatch and gap -1) divided by that of a perfect copy;
   pairs of ``threshold`` or more are contaminated. Such an alignment matches ``least = threshold * L`` or more of the
   item's L words and spans at most ``(3 - 2 * threshold) * L`` words of the text. So of the item's ``L - least + need``
   rarest words at least ``need`` stand in that span: these words are the seeds. Longer seeds would not do, since a copy
   with a word put in after each of its own still scores 0.5 and shares no two neighbouring words with the item.
   Between matches that are not neighbours in both there is at least one edit, so matches and matched pairs of
   neighbours together are at least the score less 1, and of the seeds no more can be missing than of all words.
3. Seeds, and pairs of neighbours of the item, are counted in cells as long as the span. Wherever two neighbouring cells
   hold enough of them, document and item are aligned over these cells, in numpy batches. Every pair that an alignment of whole texts finds is found, with
   the same score; rarity decides only how many places are tried in vain.

The items are the small side: their size is measured, and they are taken in groups of about ``GROUP_BYTES`` of text
(by a hash of id and text), each group one pass with its seeds sent along; nothing of the corpus is collected but the
counts of the items' own words. Alignments are done ``CELLS`` cells at a time, at least one, so an item or a text of any
length takes memory in proportion to the stretch that is aligned.

Defined results: null or empty text and items without words take part in nothing; repeated documents or items each give
their row; null ids are carried; other columns are ignored, whatever their names; an empty table on either side gives an
empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import wordhash, worker
from quernstone.llm.names import spare

THRESHOLD = 0.5
GROUP_BYTES = 4 << 20
EXPANDED = 4_000_000
CELLS = 1_000_000
MATCH, MISS = 2, 1


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the word offsets of its documents."""
    raw, offsets = wordhash.column(pc.utf8_lower(text.cast(pa.string())))
    starts, at = wordhash.word_starts(raw, offsets, wordhash.PUNCT)
    return wordhash.word_hashes(raw, starts, wordhash.PUNCT, lower=False), at


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _count_words(known: np.ndarray):
    """How often each of the given words (sorted) occurs, per batch stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        totals, sieve = np.zeros(len(known), np.int64), _sieve(known)
        for batch in _slices(batches):
            words, _ = _words(batch.column("text"))
            totals += np.bincount(_hits(words, known, sieve)[1], minlength=len(known))
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(known[some].view(np.int64)), pa.array(totals[some])], ["word", "rows"])

    return run


_SIEVE_BITS = 20


def _sieve(known: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _SIEVE_BITS, bool)
    bits[(known >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return bits


def _hits(words: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that are known, and their indexes into known."""
    place = np.flatnonzero(sieve[(words >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
    found = np.minimum(np.searchsorted(known, words[place]), len(known) - 1)
    same = known[found] == words[place]
    return place[same], found[same]


@dataclass
class Index:
    """Hashes (sorted); the items of hash k are owner[start[k]:start[k+1]]."""

    known: np.ndarray
    start: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, found: set[tuple[int, int]]) -> Index:
        ordered = sorted(found)
        known, start = np.unique(np.array([x for x, _ in ordered], np.uint64), return_index=True)
        return cls(known, np.append(start, len(ordered)), np.array([i for _, i in ordered], np.int64))

    def cells(self, place: np.ndarray, found: np.ndarray, at: np.ndarray, span: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells, numbered through documents and items, in which the hits lie, and how many in each."""
        n = self.start[found + 1] - self.start[found]
        item = self.owner[np.repeat(self.start[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        doc = np.searchsorted(at, place, "right") - 1
        return np.unique((np.repeat(doc, n) * len(span) + item) * cells + 1 + np.repeat(place - at[doc], n) // span[item], return_counts=True)


def _beside(begin: np.ndarray, some: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Hits in each cell of begin and the one after it."""
    total = np.zeros(len(begin), np.int64)
    for cell in (begin, begin + 1) if len(some) else ():
        at = np.minimum(np.searchsorted(some, cell), len(some) - 1)
        total += np.where(some[at] == cell, times[at], 0)
    return total


@dataclass
class Seeds:
    """Seed words of the items and pairs of neighbouring words; how many seeds, and seeds and pairs, an item needs."""

    known: Index
    pairs: Index
    need: np.ndarray
    both: np.ndarray
    span: np.ndarray

    @classmethod
    def choose(cls, items: list[np.ndarray], often: dict[int, int], threshold: float) -> Seeds:
        lengths = np.array([len(w) for w in items], np.int64)
        least = np.maximum(1, np.ceil(threshold * lengths - 1e-9).astype(np.int64))
        need = np.maximum(1, least // 4)
        known, pairs = set(), set()
        for item, (w, k) in enumerate(zip(items, (lengths - least + need).tolist())):
            known.update((x, item) for x in sorted(w.tolist(), key=lambda x: (often.get(x, 0), x))[:k])
            pairs.update((x, item) for x in (wordhash.windows(w, 2).tolist() if len(w) > 1 else ()))
        both = np.ceil(2 * threshold * lengths - 1 - 1e-9).astype(np.int64) - least + need
        span = np.maximum(1, np.floor((3 - 2 * threshold) * lengths + 1e-9).astype(np.int64))
        return cls(Index.of(known), Index.of(pairs), need, both, span)

    def places(self, words: np.ndarray, at: np.ndarray, sieves: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, first and last word) of every stretch that may hold a copy."""
        place, found = _hits(words, self.known.known, sieves[0])
        two, pair = _hits(wordhash.windows(words, 2), self.pairs.known, sieves[1]) if len(words) > 1 and len(self.pairs.known) else (place[:0], found[:0])
        inside = two + 1 < at[np.searchsorted(at, two, "right")]
        two, pair = two[inside], pair[inside]
        total = np.cumsum(self.known.start[found + 1] - self.known.start[found])
        cells = int((at[1:] - at[:-1]).max(initial=0)) + 2
        a = 0
        while a < len(place):  # whole documents, about EXPANDED seeds at a time
            b = int(np.searchsorted(total, total[a] + EXPANDED, "right"))
            lo, hi = at[np.searchsorted(at, place[a], "right") - 1], at[np.searchsorted(at, place[max(a, b - 1)], "right")]
            b = int(np.searchsorted(place, hi))
            some, times = self.known.cells(place[a:b], found[a:b], at, self.span, cells)
            begin = np.union1d(some, some - 1)
            seeds = _beside(begin, some, times)
            item = begin // cells % len(self.need)
            ok = (seeds >= self.need[item]) & (begin % cells > 0)
            begin, seeds, item = begin[ok], seeds[ok], item[ok]
            c, d = np.searchsorted(two, (lo, hi))
            seeds += _beside(begin, *self.pairs.cells(two[c:d], pair[c:d], at, self.span, cells))
            ok = seeds >= self.both[item]
            begin, item = begin[ok], item[ok]
            doc, first = begin // cells // len(self.need), begin % cells - 1
            yield doc, item, at[doc] + first * self.span[item], np.minimum(at[doc + 1], at[doc] + (first + 2) * self.span[item])
            a = b


def align(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over a batch: (B, I) items against (B, T) texts; the best score and the text position it ends at.

    0 pads items, 1 pads texts, neither a word. Gaps along the text are closed by a running maximum of h + position,
    which is exact for a linear gap cost.
    """
    rows, width = texts.shape
    h = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32) * MISS
    each = np.arange(rows)
    for i in range(items.shape[1]):
        same = np.where(texts == items[:, i : i + 1], MATCH, -MISS).astype(np.int32)
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + same, h[:, 1:] - MISS), 0)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        new[i >= lengths] = 0
        top = new.argmax(axis=1)
        value = new[each, top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        h = new
    return best, end


def _search(items: list[tuple[int | None, np.ndarray]], seeds: Seeds, threshold: float):
    lengths = np.array([len(w) for _, w in items], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        sieves = _sieve(seeds.known.known), _sieve(seeds.pairs.known)
        for batch in _slices(batches):
            words, at = _words(batch.column("text"))
            found_pairs: dict[tuple[int, int], tuple[float, int]] = {}
            for spots in seeds.places(words, at, sieves):
                order = np.lexsort((spots[3] - spots[2], lengths[spots[1]]))
                wide = np.maximum.accumulate((spots[3] - spots[2])[order])
                begin = 0
                while begin < len(order):
                    stop = begin + 1
                    while stop < min(len(order), begin + 256) and (stop + 1 - begin) * wide[stop] <= CELLS:
                        stop += 1
                    doc, item, lo, hi = (x[order[begin:stop]] for x in spots)
                    begin = stop
                    own = lengths[item]
                    a, t = np.zeros((len(doc), int(own.max())), np.uint64), np.ones((len(doc), int((hi - lo).max())), np.uint64)
                    for row, (i, x, y) in enumerate(zip(item.tolist(), lo.tolist(), hi.tolist())):
                        a[row, : own[row]] = items[i][1]
                        t[row, : y - x] = words[x:y]
                    scores, ends = align(a, own, t)
                    share = scores / (MATCH * own)
                    for row in np.flatnonzero(share >= threshold).tolist():
                        key = (int(doc[row]), int(item[row]))
                        found_pairs[key] = max(found_pairs.get(key, (0.0, 0)), (float(share[row]), int(lo[row] + ends[row] - at[key[0]])))
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            out = [(ids[d], items[i][0], s, e, keys[d]) for (d, i), (s, e) in sorted(found_pairs.items())]
            yield pa.record_batch(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                ["doc_id", "item_id", "score", "end_word", "text_key"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, end_word, text_key): every document that holds a copy of an item, edited or not, and how well.

    ``text_key`` is the text's xxhash64, which tells rows of one doc_id apart.
    """
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    results = []
    for g in range(groups):
        rows = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect() if groups > 1 else tests.collect()
        words, at = _words(pa.array([r.text for r in rows], pa.string()))
        items = [(r.item_id, words[a:b].copy()) for r, a, b in zip(rows, at[:-1].tolist(), at[1:].tolist()) if b > a]
        if not items:
            continue
        every = np.unique(np.concatenate([w for _, w in items]))
        counted = narrow.select("text").mapInArrow(_count_words(every), "word bigint, rows bigint").groupBy("word").agg(F.sum("rows").alias("rows"))
        often = {r.word & (1 << 64) - 1: r.rows for r in counted.collect()}  # at most the number of words of this group of items
        seeds = Seeds.choose([w for _, w in items], often, threshold)
        results.append(narrow.mapInArrow(_search(items, seeds, threshold), _FOUND))
    return functools.reduce(DataFrame.unionByName, results) if results else docs.sparkSession.createDataFrame([], _FOUND)


_FOUND = "doc_id bigint, item_id bigint, score double, end_word bigint, text_key bigint"


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that hold no copy of any item, with all their columns; rows are told apart by doc_id and text."""
    id_, key, d, t = spare(docs, "row_id", "row_key", "gone_id", "gone_key")
    gone = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), key: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(gone, F.col(id_).eqNullSafe(F.col(d)) & (F.col(key) == F.col(t)), "left_anti").drop(id_, key)
