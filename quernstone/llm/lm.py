"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a unigram base.

Words are lower-cased runs without white space (the contract's), each as the subword ids of a public tokenizer, and one
end id per text. The model predicts the class of the next id (the commonest ids are classes of their own, the others
share classes by frequency) and multiplies by the id's share of its class, so that the ids' probabilities sum to one:

* one layer of masked self-attention with a learned bias per distance, whose queries, keys and values are tables by id;
* windows of ``2*STEP`` ids that overlap by half: every id is scored once, in the second half of its window, with
  ``STEP`` to ``2*STEP-1`` ids before it in view; all windows of a batch are one batched product with one mask;
* trained over all training rows, every id of every text being a target once: tasks go on from the same weights over their
  own rows, by Adam and Adagrad, and their changes are averaged, in ``ROUNDS`` rounds of different rows. The first round
  begins with weights from ``SAMPLE`` training documents, those with the smallest hashes of doc_id, of each a run of at
  most ``LONGEST`` ids that begins at a place told by its hash (so no text of any length meets the driver whole); a start
  is all they give. Classes are chosen by neighbours in all training rows.

Beside it stand pairs of neighbouring ids, counted over all training rows: an id that followed
the one before it n times scores ``(n + w*p) / (c + w)``, where p is the attention model's probability, c how often that
id was followed, T by how many different ones, and w = c + T, so that half the weight or more is the attention's. The end id stands before a text's first.

All counts cover all training rows: ids for their shares, pairs of ids, and words for the base. Words are counted as
64-bit hashes. Counts of the ``COMMON`` commonest words and ``COMMON_PAIRS`` commonest pairs are sent to the tasks (1.6
and 3.2 MB, a proven bound); a text's other words and pairs are joined with the table of counts, which grows with the
corpus and stays distributed.

Defined results: null and empty texts have one token, the end; repeated rows and null doc_ids are scored row by row, a
null doc_id counts as held out of training but its ``held_out`` is false; with no training rows the base counts are 0 and
every id is equally likely; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import wordhash, worker
from quernstone.llm.sampling import smallest_hashes
from quernstone.session import cut

COMMON, SAMPLE, STEP, WIDTH, SINGLES, SHARED, BINS = 100_000, 1200, 16, 16, 160, 48, 4
COMMON_PAIRS = 200_000
ROUNDS, BATCH, RATE = 2, 64, 0.004
#: Neighbouring blocks that are trained together, a batch still being BATCH blocks; rows of a softmax at one time.
SPAN, PART = 4, 512
SLICE, RUN = 6 << 20, 400_000
FLUSH, REMEMBER, LONGEST = 600_000, 900_000, 20_000
#: Where the tokenizer's model file lies unless the session names another in ``MODEL_CONF``.
MODEL, MODEL_CONF = "/opt/tokenizers/piece_bpe_32k.model", "spark.quernstone.pieceModel"
_PROCESSORS: dict[str, object] = {}


def _processor(raw: bytes, key: str):
    if key not in _PROCESSORS:
        import sentencepiece

        _PROCESSORS[key] = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return _PROCESSORS[key]


@dataclass
class Tokenizer:
    """A public tokenizer's model file, sent along with the tasks (0.5 MB)."""

    raw: bytes
    size: int
    end: int
    key: str

    @classmethod
    def load(cls, path: str = MODEL) -> Tokenizer:
        raw = open(path, "rb").read()
        key = hashlib.sha256(raw).hexdigest()
        sp = _processor(raw, key)
        return cls(raw, sp.vocab_size(), sp.eos_id(), key)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and how many each word has."""
        rows = _processor(self.raw, self.key).encode(words, num_threads=1)
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(n.sum())), n


class Memory:
    """Ids of the first ``REMEMBER`` distinct words that a worker meets (all common ones among them), about 30 MB."""

    def __init__(self) -> None:
        self.hashes, self.begin, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return place, self.hashes[place] == hashes

    def add(self, hashes: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > REMEMBER or len(self.flat) + len(flat) > 8 * REMEMBER:
            return
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")  # two sorted runs
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.hashes, self.begin, self.n = every[order], begin[order], np.concatenate([self.n, n])[order]
        self.flat = np.concatenate([self.flat, flat])


class Slice:
    """Words of a few texts: hashes, and their distinct words with subword ids."""

    def __init__(self, text: pa.Array) -> None:
        raw, offsets = wordhash.column(text)
        self.raw = wordhash.LOWER[raw]
        self.starts, self.at = wordhash.word_starts(raw, offsets, wordhash.SPACE)
        self.words = wordhash.word_hashes(self.raw, self.starts, wordhash.SPACE, lower=False)
        self.distinct, self.first, self.inverse = np.unique(self.words, return_index=True, return_inverse=True)

    def ids(self, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words, and how many each has; words seen before come from the worker's memory."""
        memory = worker.keep(f"lm {tokenizer.key}", Memory)
        place, known = memory.find(self.distinct)
        new = np.flatnonzero(~known)
        fresh, fresh_n = tokenizer.ids(self._strings(new)) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        n = np.empty(len(self.distinct), np.int64)
        n[new], n[known] = fresh_n, memory.n[place[known]]
        begin = np.empty(len(self.distinct), np.int64)  # in the memory's ids followed by the new ones
        begin[new], begin[known] = len(memory.flat) + np.cumsum(fresh_n) - fresh_n, memory.begin[place[known]]
        total = np.cumsum(n)
        pool = np.concatenate([memory.flat, fresh])
        flat = pool[np.repeat(begin - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        memory.add(self.distinct[new], fresh, fresh_n)
        return flat, n

    def _strings(self, which: np.ndarray) -> list[str]:
        space = wordhash.SPACE[self.raw]
        gaps = np.flatnonzero(np.append(space, True))
        begin = self.starts[self.first[which]]
        end = gaps[np.searchsorted(gaps, begin)]
        # a text that ends without a space runs into the next one's first word
        next_word = np.append(self.starts, len(self.raw))[self.first[which] + 1]
        data = self.raw.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), np.minimum(end, next_word).tolist())]

    def stream(self, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with its end id; and how many each text has."""
        flat, n = self.ids(tokenizer)
        offset = np.cumsum(n) - n
        per_word = n[self.inverse]
        total = np.concatenate([[0], np.cumsum(per_word)])
        out = flat[np.repeat(offset[self.inverse] - total[:-1], per_word) + np.arange(total[-1])]
        per_text = total[self.at[1:]] - total[self.at[:-1]] + 1
        ids = np.full(int(per_text.sum()), tokenizer.end, np.int32)
        text_of = np.repeat(np.arange(len(per_text)), per_text - 1)
        ids[np.arange(len(out)) + text_of] = out
        return ids, per_text


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE bytes of text, at least one row."""
    for whole in batches:
        column = whole.column("text")
        _, offsets = wordhash.column(column)
        at = 0
        while at < whole.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield whole.slice(at, stop - at)
            at = stop


# ---- counts ------------------------------------------------------------------------------------------------------


def _pairs(ids: np.ndarray, tokenizer: Tokenizer) -> np.ndarray:
    """A number for each id with the one before it, for texts in a row with their ends."""
    pairs = np.empty(len(ids), np.int64)
    pairs[:1], pairs[1:] = tokenizer.end, ids[:-1]
    pairs *= tokenizer.size
    pairs += ids
    return pairs


def _count(tokenizer: Tokenizer):
    """(kind, key, n): words as hashes (0), subword ids (1), pairs of ids (2); added up within the task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 2: []}
        pieces = np.zeros(tokenizer.size, np.int64)

        def flush(kind: int) -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([h[0] for h in held[kind]]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([h[1] for h in held[kind]])).astype(np.int64)
            held[kind] = []
            return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for batch in _slices(batches):
            own = Slice(batch.column("text"))
            held[0].append((own.distinct, np.bincount(own.inverse, minlength=len(own.distinct))))
            ids, per_text = own.stream(tokenizer)
            pieces += np.bincount(ids, minlength=tokenizer.size)
            held[2].append(np.unique(_pairs(ids, tokenizer), return_counts=True))
            for kind, parts in held.items():
                if sum(len(h[0]) for h in parts) > FLUSH * 2:
                    yield flush(kind)
        for kind, parts in held.items():
            if parts:
                yield flush(kind)
        some = np.flatnonzero(pieces)
        yield pa.record_batch([pa.array(np.ones(len(some), np.int32)), pa.array(some), pa.array(pieces[some])], ["kind", "key", "n"])

    return run


def _sample(tokenizer: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, n = Slice(batch.column("text")).stream(tokenizer)
            ends = np.cumsum(n).tolist()
            runs = []
            for doc, end, size in zip(batch.column("doc_id").to_pylist(), ends, n.tolist()):
                begin = end - size + (doc * 0x9E3779B97F4A7C15 >> 20) % (size - LONGEST + 1) if size > LONGEST else end - size
                runs.append(ids[begin : min(end, begin + LONGEST)].tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(runs, pa.binary())], ["doc_id", "ids"])

    return run


# ---- the model ---------------------------------------------------------------------------------------------------


def _runs(per_text: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of whole texts of about RUN ids: first and last text, first and last id."""
    ends, first = np.cumsum(per_text), 0
    while first < len(per_text):
        begin = int(ends[first] - per_text[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + RUN, "right")))
        yield first, last, begin, int(ends[last - 1])
        first = last


@dataclass
class AttentionModel:
    table: np.ndarray  # (ids+2, 4*WIDTH): query, key, value, own vector of each id, of BOS and of padding
    bias: np.ndarray  # (STEP, 2*STEP), -1e9 where masked
    out: np.ndarray  # (2*WIDTH, classes); row WIDTH-1 is the bias
    class_of: np.ndarray  # per id
    log_share: np.ndarray  # per id: log of its share of its class
    fit: Fit | None = None  # the weights that the tables are made of

    def log_prob(self, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Natural log of each text's probability; ids of all texts in a row."""
        return np.bincount(np.repeat(np.arange(len(per_text)), per_text), self.each(ids, per_text), minlength=len(per_text))

    def each(self, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Natural log of each id's probability."""
        return np.concatenate([np.zeros(0), *(self._run(ids[a:b], per_text[i:j]) for i, j, a, b in _runs(per_text))])

    def _run(self, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        bos, pad = len(self.class_of), len(self.class_of) + 1
        blocks = -(-per_text // STEP)
        begin = (np.cumsum(blocks + 1) - blocks - 1) * STEP  # every text has a block of padding before it
        size = int((blocks + 1).sum()) * STEP
        start = np.cumsum(per_text) - per_text
        place = np.arange(len(ids)) + np.repeat(begin + STEP - start, per_text)
        stream, target = np.full(size, pad, np.int32), np.zeros(size, np.int32)
        stream[place[1:]] = ids[:-1]  # the input at a place is the id before it, or BOS at a text's first
        stream[begin + STEP] = bos
        target[place] = self.class_of[ids]
        score = np.zeros(size // STEP * STEP, np.float32)
        rows, many = size // STEP, PART // STEP
        shown = np.exp(self.bias)
        room = np.empty((PART, self.out.shape[1]), np.float32)
        for a in range(0, rows, many):
            lo, hi = max(0, a - 1), min(rows, a + many)
            score[a * STEP : hi * STEP] = self._blocks(stream, target[a * STEP : hi * STEP], lo, a, hi, shown, room)
        return score[place].astype(np.float64) + self.log_share[ids]

    def _blocks(self, stream: np.ndarray, target: np.ndarray, lo: int, a: int, hi: int, shown: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Log-probability of the class of each target of blocks a..hi; block lo is context only; shown is exp of the bias.

        A value's last number is 1, so that the product with the weights also holds their sum; divided by it, it is the
        constant that the output bias is multiplied by.
        """
        d, n = WIDTH, hi - a
        if lo == a:  # the first block of all has no block before it
            x = np.concatenate([np.broadcast_to(self.table[-1], (STEP, 4 * d)), np.take(self.table, stream[a * STEP : hi * STEP], axis=0)])
        else:
            x = np.take(self.table, stream[lo * STEP : hi * STEP], axis=0)
        row, late = x.strides[0], x[STEP:].reshape(n, STEP, 4 * d)
        both = np.lib.stride_tricks.as_strided(x, (n, 2 * STEP, 4 * d), (STEP * row, row, 4))
        weight = late[:, :, :d] @ both[:, :, d : 2 * d].transpose(0, 2, 1)
        np.exp(weight, out=weight)
        weight *= shown
        h = np.empty((n * STEP, 2 * d), np.float32)
        seen = (weight @ both[:, :, 2 * d : 3 * d]).reshape(-1, d)
        np.divide(seen, np.maximum(seen[:, d - 1 :], 1e-30), out=h[:, :d])
        h[:, d:] = late[:, :, 3 * d :].reshape(-1, d)
        logits = np.matmul(h, self.out, out=room[: len(h)])
        got = logits[np.arange(len(logits)), target]
        total = _exp(logits)[1]
        if total is None:  # too large or too small for exp as they are
            logits = h @ self.out
            most = logits.max(axis=1)
            got -= most
            total = _exp(logits - most[:, None])[1]
        return got - np.log(total)


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """exp in place, and the sum of each row; no sums if any has left the range in which they are exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
    return logits, total if 1e-20 < total.min(initial=1) and total.max(initial=1) < 1e30 else None


@dataclass
class Counts:
    """How often each id occurs, and pairs of neighbouring ids with their numbers, over all training rows."""

    ids: np.ndarray
    before: np.ndarray
    after: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray | Counts, stream: np.ndarray) -> Counts:
        """Counts as they are; with those of the ids alone, the pairs of a stream."""
        return counts if isinstance(counts, Counts) else cls(counts, stream[:-1], stream[1:], np.ones(max(0, len(stream) - 1)))

    @staticmethod
    def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that are grouped by their neighbours, and the common ids that are looked at as neighbours."""
        order = np.argsort(-ids, kind="stable")
        return order[SINGLES : 9 * SINGLES], order[:256]


def _groups(counts: Counts, ids: np.ndarray, common: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k-means of ids by the company they keep: which common ids stand before and after them."""
    rng = np.random.default_rng(seed)
    row, col = np.full(len(counts.ids), -1), np.full(len(counts.ids), -1)
    row[ids], col[common] = np.arange(len(ids)), np.arange(len(common))
    near = np.zeros((len(ids), 2 * len(common)), np.float32)
    for side, (own, other) in enumerate(((counts.after, counts.before), (counts.before, counts.after))):
        ok = (row[own] >= 0) & (col[other] >= 0)
        np.add.at(near, (row[own[ok]], col[other[ok]] + side * len(common)), counts.n[ok])
    mass = near.sum(axis=1)
    near = np.sqrt(near / np.maximum(near.sum(axis=0), 1))
    near /= np.maximum(np.sqrt((near * near).sum(axis=1, keepdims=True)), 1e-9)
    chance = mass / max(1.0, mass.sum())
    centre = near[rng.choice(len(ids), k, replace=False, p=chance)] if (mass > 0).sum() >= k else near[rng.choice(len(ids), k)]
    for _ in range(12):
        group = (near @ centre.T).argmax(axis=1)
        for j in range(k):
            own = group == j
            if own.any():
                mean = (near[own] * np.sqrt(mass[own])[:, None]).sum(axis=0)
                centre[j] = mean / max(float(np.sqrt(mean @ mean)), 1e-9)
    return np.where(mass > 0, group, -1)


def _classes(company: Counts) -> tuple[np.ndarray, np.ndarray, int]:
    """Class of each id and log of its share (add-one over all ids of a class).

    The commonest ids are classes of their own, the next are grouped by their neighbours, the rest by frequency.
    """
    counts = company.ids
    order = np.argsort(-counts, kind="stable")
    class_of = np.empty(len(counts), np.int32)
    singles = min(SINGLES, len(counts))
    class_of[order[:singles]] = np.arange(singles)
    middle, common = Counts.grouped(counts)
    group = _groups(company, middle, common, SHARED - BINS) if len(middle) > SHARED and len(company.n) else np.full(len(middle), -1)
    class_of[middle] = singles + group
    rest = np.concatenate([middle[group < 0], order[9 * SINGLES :]])
    mass = np.cumsum(counts[rest] + 1.0)
    if len(rest):
        class_of[rest] = singles + SHARED - BINS + np.minimum(mass * BINS / mass[-1], BINS - 1).astype(np.int32)
    total = np.bincount(class_of, counts + 1.0, minlength=singles + SHARED)
    return class_of, np.log((counts + 1.0) / total[class_of]), singles + SHARED


def _windows(texts: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in blocks of STEP ids, a block of padding before each: inputs (the id before, BOS first), targets, and where blocks with targets begin."""
    bos, pad = vocabulary, vocabulary + 1
    blocks = [STEP + -(-len(ids) // STEP) * STEP for ids in texts]
    stream = np.full(sum(blocks), pad, np.int32)
    first = np.cumsum(blocks) - blocks + STEP if texts else np.zeros(0, np.int64)
    for at, ids in zip(first.tolist(), texts):
        stream[at : at + len(ids)] = ids
    inputs = np.append(np.int32(pad), stream[:-1]) if len(stream) else stream
    inputs[first - STEP] = pad
    inputs[first] = bos
    scored = np.flatnonzero((stream.reshape(-1, STEP) != pad).any(axis=1)) * STEP
    return inputs, stream, scored


def _overlapping(x: np.ndarray, blocks: int) -> np.ndarray:
    """Of runs of blocks+1 blocks of STEP rows each block with the one before it: (B, (blocks+1)*STEP, d) as (B, blocks, 2*STEP, d), nothing copied."""
    run, row, number = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), blocks, 2 * STEP, x.shape[2]), (run, STEP * row, row, number))


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values`` with each row as one item, which numpy copies several times as fast."""
    whole = np.dtype((np.void, table.strides[0]))
    table.view(whole)[rows, 0] = values.view(whole)[:, 0]


#: All weights but the ids' vectors.
LAYERS = ("q", "k", "v", "bias", "out", "b")


class Fit:
    """Weights, and what Adam (all but the ids' vectors) and Adagrad (these) remember of their gradients."""

    def __init__(self, w: dict[str, np.ndarray], class_of: np.ndarray, log_share: np.ndarray, u: dict[str, np.ndarray] | None = None) -> None:
        self.w, self.class_of, self.log_share = w, class_of, log_share
        size = sum(w[k].size for k in LAYERS)
        self.u = u or {"e": np.zeros_like(w["e"]), "rest": np.zeros(size, np.float32)}  # rest: LAYERS in a row
        self.m = np.zeros(size, np.float32)
        self.steps = 0
        self.causal = np.tril(np.ones((STEP, 2 * STEP), np.float32), STEP)

    def copy(self) -> Fit:
        return Fit({k: x.copy() for k, x in self.w.items()}, self.class_of, self.log_share, {k: x.copy() for k, x in self.u.items()})

    def step(self, x_ids: np.ndarray, y: np.ndarray, now: float, warm: bool = False) -> np.ndarray:
        """One step down the gradient of a batch of B runs of n blocks, (B, (n+1)*STEP) inputs, the first STEP for context, and (B, n*STEP) targets; the ids whose vectors moved.

        Each block sees itself and the block before it. Keys meet queries and values meet the output in products of their
        matrices, so that no key or value is ever made: attention is between vectors of ids, and what it gathers are such
        vectors.

        ``warm``: the second moments are those of many steps before and need no correction for their beginning.
        """
        w, d = self.w, WIDTH
        batch, blocks, pad = len(x_ids), y.shape[1] // STEP, len(self.class_of) + 1
        real = (y != pad).reshape(-1)
        goal = self.class_of[np.minimum(y, len(self.class_of) - 1)].reshape(-1)
        x = np.take(w["e"], x_ids, axis=0)
        late, both = x[:, STEP:].reshape(-1, d), _overlapping(x, blocks)
        scale = np.float32(1 / np.sqrt(d - 1))
        match = w["q"] @ w["k"].T * scale
        q = (late @ match).reshape(batch, blocks, STEP, d)
        att = q @ both.transpose(0, 1, 3, 2)
        att += w["bias"]
        np.clip(att, -50, 50, out=att)  # stays in the range of exp
        np.exp(att, out=att)
        att *= self.causal
        hidden = x_ids == pad
        some = np.flatnonzero(hidden.any(axis=1))
        att[some] *= ~_overlapping(hidden[some, :, None], blocks)[:, :, None, :, 0]
        total = att @ np.ones(2 * STEP, np.float32)
        att /= np.maximum(total, 1e-30, out=total)[..., None]  # padding may see nothing
        h = np.empty((len(late), 2 * d + 1), np.float32)
        h[:, :d], h[:, d : 2 * d], h[:, 2 * d] = (att @ both).reshape(-1, d), late, 1
        g_out, dh = self._softmax(h, goal, real)
        seen = np.ascontiguousarray(dh[:, :d]).reshape(batch, blocks, STEP, d)
        datt = seen @ both.transpose(0, 1, 3, 2)
        datt -= np.einsum("abij,abij->abi", datt, att)[..., None]
        datt *= att
        dq = (datt @ both).reshape(-1, d)
        g_match = late.T @ dq * scale
        g = {"q": g_match @ w["k"], "k": g_match.T @ w["q"], "v": g_out[:d] @ w["out"][: d - 1].T, "bias": datt.sum(axis=(0, 1))}
        g["out"], g["b"] = np.concatenate([w["v"].T @ g_out[:d], g_out[d : 2 * d]]), g_out[2 * d]
        dx = np.empty((batch, blocks + 1, STEP, d), np.float32)
        own = dq @ match.T
        own += dh[:, d:]
        dx[:, :1], dx[:, 1:] = 0, own.reshape(batch, blocks, STEP, d)
        looked = att.transpose(0, 1, 3, 2) @ seen
        looked += datt.transpose(0, 1, 3, 2) @ q
        dx[:, :-1] += looked[:, :, :STEP]
        dx[:, 1:] += looked[:, :, STEP:]
        self._adam(np.concatenate([g[k].reshape(-1) for k in LAYERS]), now, warm)
        return self._adagrad(x_ids.reshape(-1), dx.reshape(-1), now)

    def _softmax(self, h: np.ndarray, goal: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the matrix that h meets and of h (but its last number), in parts that stay in the cache."""
        w, d = self.w, WIDTH
        out = np.concatenate([w["v"] @ w["out"][: d - 1], w["out"][d - 1 :], w["b"][None]])
        back = out[:-1].T
        g_out, dh = np.zeros(out.T.shape, np.float32), np.empty((len(h), 2 * d), np.float32)
        room = np.empty((min(PART, len(h)), out.shape[1]), np.float32)
        each, rows = real / np.float32(max(1, int(real.sum()))), np.arange(len(room)) * out.shape[1]
        for a in range(0, len(h), PART):
            part = h[a : a + PART]
            p, total = _exp(np.matmul(part, out, out=room[: len(part)]))
            if total is None:
                p = part @ out
                p, total = _exp(p - p.max(axis=1, keepdims=True))
            p.reshape(-1)[rows[: len(p)] + goal[a : a + PART]] -= total
            share = (each[a : a + PART] / total)[:, None]
            g_out += p.T @ (part * share)
            np.multiply(p @ back, share, out=dh[a : a + PART])
        return g_out.T, dh

    def _adam(self, grad: np.ndarray, now: float, warm: bool) -> None:
        m, u, at = self.m, self.u["rest"], 0
        self.steps += 1
        m += np.float32(0.1) * (grad - m)
        grad *= grad
        grad -= u
        u += np.float32(0.01) * grad
        square = np.sqrt(u if warm else u / np.float32(1 - 0.99**self.steps))
        change = np.float32(now / (1 - 0.9**self.steps)) * m / (square + np.float32(1e-8))
        for k in LAYERS:
            self.w[k] -= change[at : at + self.w[k].size].reshape(self.w[k].shape)
            at += self.w[k].size

    def _adagrad(self, ids: np.ndarray, dx: np.ndarray, now: float) -> np.ndarray:
        """The vectors of the ids that occur: Adagrad, so that rare ids move as far as common ones."""
        order = np.argsort(ids.astype(np.uint16) if len(self.class_of) + 1 < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        new = np.append(True, ids[1:] != ids[:-1])
        moved, place = ids[new], np.empty(len(ids), np.int64)
        place[order] = np.cumsum(new) * WIDTH - WIDTH
        grad = np.bincount((place[:, None] + np.arange(WIDTH)).reshape(-1), dx).astype(np.float32).reshape(-1, WIDTH)
        square = np.take(self.u["e"], moved, axis=0)
        square += grad * grad
        _put(self.u["e"], moved, square)
        np.sqrt(square, out=square)
        square += np.float32(1e-8)
        grad *= np.float32(5 * now)
        grad /= square
        vectors = np.take(self.w["e"], moved, axis=0)
        vectors -= grad
        _put(self.w["e"], moved, vectors)
        return moved

    def model(self) -> AttentionModel:
        """The weights as tables by id."""
        w, d, pad = self.w, WIDTH, len(self.class_of) + 1
        table = np.zeros((pad + 1, 4 * d), np.float32)
        query, key = w["e"] @ w["q"] * np.float32(1 / np.sqrt(d - 1)), w["e"] @ w["k"]
        largest = float(np.sqrt((query * query).sum(axis=1).max()) * np.sqrt((key * key).sum(axis=1).max()))
        if largest > 50:  # no product may leave the range of exp
            key *= 50 / largest
        table[:, : d - 1] = query
        table[:, d - 1] = 1  # meets the key's last number, which hides padding
        table[:, d : 2 * d - 1] = key
        table[pad, d:] = 0
        table[pad, 2 * d - 1] = -1e4
        table[:, 2 * d : 3 * d - 1] = w["e"] @ w["v"]
        table[:, 3 * d - 1] = 1
        table[:, 3 * d :] = w["e"]
        table[pad, 2 * d :] = 0  # padding sees nothing but itself and is never scored
        bias = np.where(self.causal > 0, np.clip(w["bias"], -20, 20), -1e9).astype(np.float32)
        out = np.concatenate([w["out"][: d - 1], w["b"][None], w["out"][d - 1 :]])
        return AttentionModel(table, bias, out.astype(np.float32), self.class_of, self.log_share.astype(np.float32), self)


def train(sample: list[np.ndarray], counts: np.ndarray | Counts, steps: int = 2000, batch: int = 96, rate: float = 0.02, seed: int = 3) -> AttentionModel:
    """Fit by Adam on windows drawn from the sample: where :func:`fit_rows` begins; ids that the sample never shows keep small random vectors."""
    rng = np.random.default_rng(seed)
    company = Counts.of(counts, np.concatenate(sample) if sample else np.zeros(0, np.int32))
    counts = company.ids
    class_of, log_share, classes = _classes(company)
    d = WIDTH
    inputs, stream, scored = _windows(sample, len(counts))
    w = {
        "e": rng.normal(0, 0.3, (len(counts) + 2, d)).astype(np.float32),
        "q": rng.normal(0, 0.3, (d, d - 1)).astype(np.float32),
        "k": rng.normal(0, 0.3, (d, d - 1)).astype(np.float32),
        "v": rng.normal(0, 0.3, (d, d - 1)).astype(np.float32),
        "bias": np.zeros((STEP, 2 * STEP), np.float32),
        "out": np.zeros((2 * d - 1, classes), np.float32),
        "b": np.log((np.bincount(class_of, counts + 1.0, minlength=classes) + 1e-3) / (counts.sum() + len(counts))).astype(np.float32),
    }
    fit = Fit(w, class_of, log_share)
    for step in range(1, steps + 1) if len(scored) else ():
        rows = rng.choice(scored, batch)[:, None]
        now = rate * min(1.0, step / 50) * (1 - 0.9 * step / steps)
        fit.step(inputs[rows + np.arange(-STEP, STEP)], stream[rows + np.arange(STEP)], now)
    return fit.model()


# ---- the fit over all training rows ------------------------------------------------------------------------------

def _learn(start: Fit, tokenizer: Tokenizer):
    """Every id of every text is a target once. (row, n, d0...): of each row of the weights its change times n, what it saw.

    Rows are the ids' vectors and, after these, all other weights in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, rng = start.copy(), np.random.default_rng(11)
        seen, targets = np.zeros(len(fit.w["e"]), np.int64), 0
        for batch in _slices(batches):
            ids, per_text = Slice(batch.column("text")).stream(tokenizer)
            for first, last, begin, end in _runs(per_text):
                inputs, stream, _ = _windows(np.split(ids[begin:end], np.cumsum(per_text[first : last - 1])), tokenizer.size)
                # the runs lie side by side over all blocks, those of padding too, whose targets count for nothing
                lack = (STEP - len(stream)) % (SPAN * STEP)
                inputs, stream = (np.append(z, np.full(lack, tokenizer.size + 1, np.int32)) for z in (inputs, stream))
                starts = rng.permutation(np.arange(STEP, len(stream), SPAN * STEP))
                for a in range(0, len(starts), BATCH // SPAN):
                    rows = starts[a : a + BATCH // SPAN, None]
                    fit.step(inputs[rows + np.arange(-STEP, SPAN * STEP)], stream[rows + np.arange(SPAN * STEP)], RATE, warm=True)
                seen += np.bincount(inputs, minlength=len(seen))
                targets += end - begin
        if targets:
            some = np.flatnonzero(seen)
            change = fit.w["e"][some].astype(np.float64) - start.w["e"][some]
            rest = np.concatenate([(fit.w[k].astype(np.float64) - start.w[k]).reshape(-1) for k in LAYERS])
            rest = np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)
            n = np.concatenate([seen[some], np.full(len(rest), targets)])
            change = np.concatenate([change, rest]) * n[:, None]
            row = np.concatenate([some, len(seen) + np.arange(len(rest))])
            yield pa.record_batch([pa.array(row), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in change.T)], ["row", "n", *(f"d{k}" for k in range(WIDTH))])

    return run


def fit_rows(model: AttentionModel, docs: DataFrame, tokenizer: Tokenizer) -> None:
    """Go on from the model's weights over every row of ``docs`` (a column text), in place.

    Rows are dealt to ROUNDS rounds by hash. In each, every task begins with the same weights and learns from all its rows;
    the changes are averaged, of an id's vector by how often a task saw the id, of other weights by its number of ids. What
    is shuffled is one row per task and id, what meets the driver one per id.
    """
    schema = "row bigint, n bigint, " + ", ".join(f"d{k} double" for k in range(WIDTH))
    fit = model.fit
    for turn in range(ROUNDS):
        part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn).select("text")
        changes = part.mapInArrow(_learn(fit, tokenizer), schema)
        total = changes.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(WIDTH))).toPandas()
        row = total.row.to_numpy(np.int64)
        mean = np.zeros((len(fit.w["e"]) + -(-sum(fit.w[k].size for k in LAYERS) // WIDTH), WIDTH))
        mean[row] = total[[f"d{k}" for k in range(WIDTH)]].to_numpy(np.float64) / total.n.to_numpy(np.float64)[:, None]
        fit.w["e"] += mean[: len(fit.w["e"])].astype(np.float32)
        rest, at = mean[len(fit.w["e"]) :].reshape(-1), 0
        for k in LAYERS:
            fit.w[k] += rest[at : at + fit.w[k].size].reshape(fit.w[k].shape).astype(np.float32)
            at += fit.w[k].size
    model.__dict__.update(fit.model().__dict__)


# ---- scoring -----------------------------------------------------------------------------------------------------


#: score: of a text's own row the log of its ids' probabilities, of an open pair the attention model's part of it.
FIELDS = ["row", "kind", "word", "times", "doc_id", "n_tokens", "n_known", "sum_log", "score", "share"]


@dataclass
class Pairs:
    """Counts over all training rows: of the commonest pairs (sorted), and of what follows each id; the attention's weight there."""

    common: np.ndarray
    n: np.ndarray
    followed: np.ndarray
    weight: np.ndarray

    def slots(self) -> np.ndarray:
        """For each slot of a hash table a pair that falls there."""
        slots = np.zeros(1 << 21, np.int32)
        slots[self._slot(self.common)] = np.arange(len(self.common))
        return slots

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)

    def find(self, pairs: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's count, and whether it is common."""
        if not len(self.common):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        place = slots[self._slot(pairs)]
        known = self.common[place] == pairs
        rest = np.flatnonzero(~known)  # others of the same slot
        place[rest] = np.minimum(np.searchsorted(self.common, pairs[rest]), len(self.common) - 1)
        known[rest] = self.common[place[rest]] == pairs[rest]
        return np.where(known, self.n[place], 0), known


def _score(model: AttentionModel, tokenizer: Tokenizer, common: np.ndarray, common_log: np.ndarray, pairs: Pairs):
    """One row per text with its own sums, one per distinct word that is not common, one per id whose pair is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = pairs.slots()
        for batch in _slices(batches):
            own = Slice(batch.column("text"))
            place = np.minimum(np.searchsorted(common, own.distinct), max(0, len(common) - 1))
            known = (common[place] == own.distinct) if len(common) else np.zeros(len(own.distinct), bool)
            log_of = np.where(known, common_log[place], 0.0) if len(common) else np.zeros(len(own.distinct))
            n = len(own.at) - 1
            doc = np.repeat(np.arange(n), np.diff(own.at))
            known_word = known[own.inverse]
            sums = np.bincount(doc, log_of[own.inverse], minlength=n)
            n_known = np.bincount(doc, known_word, minlength=n).astype(np.int64)
            ids, per_text = own.stream(tokenizer)
            score, opened = np.zeros(n), []
            for first, last, begin, end in _runs(per_text):
                each = np.exp(model._run(ids[begin:end], per_text[first:last]))
                pair = _pairs(ids[begin:end], tokenizer)
                seen, sure = pairs.find(pair, slots)
                before = pair // tokenizer.size
                weight = pairs.weight[before]
                share = 1.0 / np.maximum(1, pairs.followed[before] + weight)
                each *= np.where(weight > 0, weight * share, 1)
                text_of = np.repeat(np.arange(first, last), per_text[first:last])
                later = np.flatnonzero(~sure & (weight > 0))
                opened.append((text_of[later], pair[later], each[later], share[later]))
                each += seen * share
                each[later] = 1
                score[first:last] = np.bincount(text_of - first, np.log10(each), minlength=last - first)
            del ids
            p_doc, p_pair, p_each, p_share = (np.concatenate(x) for x in zip(*opened))
            rare = np.flatnonzero(~known_word)
            cell, times = np.unique(doc[rare] * (len(own.distinct) or 1) + own.inverse[rare], return_counts=True)
            r_doc, r_word = cell // (len(own.distinct) or 1), own.distinct[cell % (len(own.distinct) or 1)] if len(cell) else np.zeros(0, np.uint64)
            rows = batch.column("row").to_numpy()
            for a in range(0, len(p_doc), 100_000):
                part = slice(a, a + 100_000)
                k = len(p_doc[part])
                none = [pa.nulls(k, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
                yield pa.record_batch(
                    [pa.array(rows[p_doc[part]]), pa.array(np.full(k, 2, np.int32)), pa.array(p_pair[part]), pa.array(np.ones(k, np.int32)), *none, pa.array(p_each[part]), pa.array(p_share[part])],
                    FIELDS,
                )
            for a in range(0, max(1, len(r_doc)), 100_000):
                part = slice(a, a + 100_000)
                head = a == 0
                k = n if head else 0
                empty = len(r_doc[part])
                none = pa.nulls(empty, pa.int64())

                def col(values: np.ndarray, kind: pa.DataType, k: int = k, empty: int = empty) -> pa.Array:
                    return pa.concat_arrays([pa.array(values[:k]).cast(kind), pa.nulls(empty, kind)])

                ids_column = pa.concat_arrays([batch.column("doc_id").cast(pa.int64()).slice(0, k), none])
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([rows[:k], rows[r_doc[part]]])),
                        pa.array(np.zeros(k + empty, np.int32)),
                        # a text's own row is joined under a number of its row, so that they do not meet in one task
                        pa.array(np.concatenate([rows[:k], r_word[part].view(np.int64)])),
                        pa.array(np.concatenate([np.zeros(k, np.int32), times[part].astype(np.int32)])),
                        ids_column,
                        col(np.diff(own.at) + 1, pa.int64()),
                        col(n_known, pa.int64()),
                        col(sums, pa.float64()),
                        col(score, pa.float64()),
                        pa.nulls(k + empty, pa.float64()),
                    ],
                    FIELDS,
                )

    return run


def corpus_counts(docs: DataFrame, train_rows: Column, tokenizer: Tokenizer) -> DataFrame:
    """(kind, key, n) over all training rows: words by hash, subword ids, and pairs of ids."""
    texts = docs.filter(train_rows).select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count(tokenizer), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _commonest(words: DataFrame, most: int) -> DataFrame:
    """The commonest words, at most ``most``: all above a count that a histogram of some hundred bins tells."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    bins = sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r.level)
    total, least = 0, None
    for r in bins:
        total += r.rows
        if total > most:
            break
        least = r.level
    return words.filter(level >= least if least is not None else F.lit(False)).select("key", "n")


def _sorted(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    top = counts.toPandas()
    order = np.argsort(top.key.to_numpy(np.int64))
    return top.key.to_numpy(np.int64)[order], top.n.to_numpy(np.int64)[order]


def score_texts(docs: DataFrame, train_rows: Column, tokenizer: Tokenizer | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    tokenizer = tokenizer or Tokenizer.load(docs.sparkSession.conf.get(MODEL_CONF, MODEL))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = F.coalesce(train_rows, F.lit(False))
    n_train = narrow.filter(usable).count()
    counts = cut(corpus_counts(narrow, usable, tokenizer))
    words = counts.filter("kind = 0")
    distinct, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = tokens + n_train, distinct + (1 if n_train else 0)
    pieces = np.zeros(tokenizer.size, np.float64)
    for r in counts.filter("kind = 1").collect():  # at most the size of the vocabulary
        pieces[r.key] = r.n
    top = _commonest(words, COMMON).toPandas()
    order = np.argsort(top.key.to_numpy(np.int64).view(np.uint64))
    common = top.key.to_numpy(np.int64).view(np.uint64)[order]
    common_log = np.log10(top.n.to_numpy(np.float64)[order] + 1)
    both = counts.filter("kind = 2")
    pairs = Pairs(*_sorted(_commonest(both, COMMON_PAIRS)), np.zeros(tokenizer.size, np.int64), np.zeros(tokenizer.size, np.int64))
    by_first = both.groupBy(F.expr(f"key div {tokenizer.size}").alias("id")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    for r in by_first.collect():  # at most the size of the vocabulary
        pairs.followed[r.id], pairs.weight[r.id] = r.n, r.n + r.kinds
    chosen = docs.sparkSession.createDataFrame([(i,) for i in smallest_hashes(narrow.filter(usable), SAMPLE, 8)], "doc_id long")
    drawn = narrow.join(F.broadcast(chosen), "doc_id").mapInArrow(_sample(tokenizer), "doc_id bigint, ids binary")
    sample = drawn.groupBy("doc_id").agg(F.max("ids").alias("ids")).collect()  # of rows that repeat an id one stands for all
    middle, near = (x.tolist() for x in Counts.grouped(pieces))
    first, second = F.expr(f"key div {tokenizer.size}"), F.col("key") % tokenizer.size
    # pairs of the 1,280 ids that are grouped with the 256 common ones, so two thirds of a million at most
    company, times = _sorted(both.filter((first.isin(middle) & second.isin(near)) | (first.isin(near) & second.isin(middle))))
    model = train([np.frombuffer(r.ids, np.int32) for r in sorted(sample, key=lambda r: (r.doc_id, r.ids))], Counts(pieces, company // tokenizer.size, company % tokenizer.size, times))
    if n_train:
        fit_rows(model, narrow.filter(usable), tokenizer)
    schema = "row bigint, kind int, word bigint, times int, doc_id bigint, n_tokens bigint, n_known bigint, sum_log double, score double, share double"
    parts = narrow.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(model, tokenizer, common, common_log, pairs), schema)
    rare = counts.filter("kind <> 1").select("kind", F.col("key").alias("word"), F.col("n").alias("count"))
    end_known, end_log = int(n_train > 0), float(np.log10(n_train + 1))
    joined = parts.join(rare, ["kind", "word"], "left")
    is_pair, is_rare = F.col("kind") == 2, F.col("times") > 0
    per_row = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_pair, 0).when(is_rare, F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0)).otherwise(F.col("n_known") + end_known)).cast("long").alias("n_known"),
        F.sum(F.when(is_pair, 0.0).when(is_rare, F.col("times") * F.log10(F.coalesce(F.col("count"), F.lit(0)) + 1)).otherwise(F.col("sum_log") + end_log)).alias("sum_log"),
        F.sum(F.when(is_pair, F.log10(F.col("score") + F.coalesce(F.col("count"), F.lit(0)) * F.col("share"))).otherwise(F.col("score"))).alias("score"),
    )
    return per_row.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum_log") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        "score",
    )


def corpus_scores(docs: DataFrame) -> DataFrame:
    """The query's columns; rows of fold 2 of 7 teach nothing."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(docs, ~held).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
