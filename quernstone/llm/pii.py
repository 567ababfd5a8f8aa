"""Personal data: exact base patterns, and a linear-chain CRF over word-shape features that adds spans.

Base kinds (email, ip, card, phone) are the contract's patterns, leftmost and non-overlapping per kind, with their
checks; a match that fails its check is dropped and not tried again. Each is searched from where it must begin (an
``@``, a run's first digit, a plus sign), so no text takes quadratic time.

The CRF labels every token of every text: outside, or begin/inside of one of ``KINDS``. A token's features are its shape
(classes of characters in it, number of digits, length, first and last class, few marker words) and those of its
neighbours. It is trained in numpy by gradient ascent of the conditional likelihood on the small labelled table
:func:`labelled_table`, and decoded by Viterbi for whole batches of sentences at once, all sentences of similar length in
one array. A sentence ends at a line break or after a token ending in ``.``, ``!`` or ``?``. Spans of the CRF are added
where they overlap no base span; base spans always stay.

Defined results: null and empty texts have no spans; repeated rows are read each; very long sentences are decoded
whole; other columns are ignored by :func:`find_pii`.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import worker

BASE = ("email", "ip", "card", "phone")
KINDS = ("secret", "email", "ip", "card", "phone", "iban")
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", re.ASCII)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", re.ASCII)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++", re.ASCII)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]", re.ASCII)
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- word shapes -------------------------------------------------------------------------------------------------

_CLASSES = 12
_CLASS = np.full(128, 9, np.uint8)  # other punctuation
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-_", "+", "()[]", "=:\"'", ",;!?", "/\\#&*%$|")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k if _k < 9 else (9 if _k == 9 else 10)
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Words that often stand before personal data, by hash bucket of their letters.
_CUES = ("token", "secret", "key", "password", "apikey", "email", "mail", "phone", "tel", "call", "card", "visa", "iban", "ip", "host", "at", "dot")
#: Number of values of each feature of a token.
_SIZES = (1 << _CLASSES, 8, 9, _CLASSES, _CLASSES, 4, len(_CUES) + 1)
_FIELDS = len(_SIZES)
_START = np.cumsum([0, *_SIZES[:-1]])
_TOTAL = sum(_SIZES)
#: Neighbours repeat all but the set of classes.
_NEAR = np.array([1, 2, 3, 4, 5, 6])


class Tokens:
    """All tokens of a batch of texts, as arrays over the concatenated code points."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(code, 127)
        space = _SPACE[low] & (code < 128)
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        self.start, self.end = starts, ends
        lengths = np.array([len(t) for t in texts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.doc = np.searchsorted(self.base, starts, "right") - 1
        n = len(starts)
        if not n:
            self.features, self.sentence = np.zeros((0, _FIELDS), np.int32), np.zeros(0, np.int64)
            return
        cls = _CLASS[low]
        cls[code >= 128] = 11
        bits = np.where(space, 0, np.left_shift(1, cls.astype(np.int32)))
        mask = np.bitwise_or.reduceat(bits, starts)
        digits = np.add.reduceat((cls == 2) & ~space, starts, dtype=np.int32)
        hexed = np.add.reduceat(_HEX[low] & (code < 128), starts, dtype=np.int32)
        dots = np.add.reduceat((cls == 4) & ~space, starts, dtype=np.int32)
        length = (ends - starts).astype(np.int32)
        f = np.empty((n, _FIELDS), np.int32)
        f[:, 0] = mask
        f[:, 1] = np.searchsorted([1, 2, 4, 7, 12, 20, 33], length)
        f[:, 2] = np.searchsorted([1, 2, 3, 5, 9, 13, 20, 33], digits)
        f[:, 3] = cls[starts]
        f[:, 4] = cls[ends - 1]
        f[:, 5] = np.where((hexed * 10 >= length * 9) & (length >= 16), 1, 0) + 2 * (dots >= 2)
        f[:, 6] = self._cues(code, starts, ends, mask, length)
        self.features = f + _START.astype(np.int32)[None, :]
        # sentences: a new one after a break of line or text, or after a final mark
        final = np.isin(code[ends - 1], [46, 33, 63])
        breaks = np.concatenate([[0], np.cumsum(code == 10)])
        new = np.ones(n, bool)
        new[1:] = final[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
        self.sentence = np.flatnonzero(new)

    @staticmethod
    def _cues(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int32)
        padded = np.concatenate([code, np.zeros(10, np.uint32)])
        for k, word in enumerate(_CUES):
            first = padded[starts] | 32
            rows = np.flatnonzero((first == ord(word[0])) & (length >= len(word)) & (length <= len(word) + 2))
            for j in range(1, len(word)):
                rows = rows[(padded[starts[rows] + j] | 32) == ord(word[j])]
            after = padded[starts[rows] + len(word)]
            letters = ((after | 32) >= 97) & ((after | 32) <= 122)
            out[rows[(length[rows] == len(word)) | ~letters]] = k + 1
        return out


def _emissions(features: np.ndarray, weights: dict[str, np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(n, labels): a token's own features and those of its two neighbours within the sentence."""
    e = weights["own"][features].sum(axis=1)
    near = features[:, _NEAR]
    before, after = weights["before"][near].sum(axis=1), weights["after"][near].sum(axis=1)
    e[1:] += np.where(first[1:, None], 0, before[:-1])
    e[:-1] += np.where(last[:-1, None], 0, after[1:])
    return e


def _edges(n: int, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[sentence] = True
    last[np.append(sentence[1:], n) - 1] = True
    return first, last


def viterbi(emission: np.ndarray, sentence: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of every token; sentences are sorted by length, so that step k runs over those longer than k only."""
    n, labels = emission.shape
    lengths = np.diff(np.append(sentence, n))
    order = np.argsort(-lengths, kind="stable")
    begin, size = sentence[order], lengths[order]
    score = emission[begin] + first
    best = np.zeros(n, np.int16)
    back = np.zeros((n, labels), np.int8)
    ended_at = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # sentences of at least k+1 tokens
    final = np.empty(len(begin), np.int16)
    for k in range(1, int(size[0]) + 1):
        alive = int(ended_at[k]) if k < len(ended_at) else 0
        final[alive : len(score)] = score[alive:].argmax(axis=1)
        score = score[:alive]
        if not alive:
            break
        total = score[:, None, :] + transition.T[None, :, :]  # (sentence, to, from)
        choice = total.argmax(axis=2)
        at = begin[:alive] + k
        back[at] = choice
        score = np.take_along_axis(total, choice[:, :, None], 2)[:, :, 0] + emission[at]
    here = final.astype(np.int64)
    for k in range(int(size[0]) - 1, -1, -1):
        alive = int(ended_at[k])
        at = begin[:alive] + k
        best[at] = here[:alive]
        if k:
            here[:alive] = back[at, here[:alive]]
    return best


# ---- training ----------------------------------------------------------------------------------------------------


def labelled_table(rows: int = 700, seed: int = 13) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences as (token, label) lists, written from a few patterns with invented values."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "ka lo mi ter en re sol an der vi une al pro con in ta mo ru".split()

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 7))))
        if rng.random() < 0.3:
            w = w[: len(w) // 2] + pick("éèñüßçöäêóí") + w[len(w) // 2 :]
        return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.05 else w

    def digits(n: int) -> str:
        return "".join(str(int(x)) for x in rng.integers(0, 10, n))

    def noise() -> str:
        return pick([word, word, word, lambda: word() + ",", lambda: digits(int(rng.integers(1, 5))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
                     lambda: f"{digits(2)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: "$" + digits(3), lambda: "http://" + word().lower() + ".org/" + word(),
                     lambda: word() + "###", lambda: word() + "!!", lambda: "|", lambda: "=", lambda: f"({word()})", lambda: "#" + digits(3), lambda: f"§{digits(2)}", lambda: word() + "-" + word(), lambda: digits(6)])()

    def private() -> list[tuple[str, str]]:
        kind = pick(KINDS)
        tail = pick(["", "", ".", ",", "###"])
        hexes = "".join(pick("0123456789abcdef") for _ in range(pick([24, 32, 40, 48, 64])))
        mixed = "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(pick([20, 28, 36, 40])))
        user, host = word().lower(), word().lower()
        if kind == "secret":
            value = pick([f'"{hexes}"', hexes, f'"{mixed}"', f"sk-{mixed}", f"ghp_{mixed}", "AKIA" + mixed.upper()[:16]]) + tail
            cue = pick([["token", "="], ["key:"], ["secret", "="], ["password", "="], ["api_key", "="], []])
            words = [(c, "O") for c in cue] + [(value, "B-secret")]
        elif kind == "email":
            words = pick([[(f"{user}{digits(2)}@{host}.example.com{tail}", "B-email")],
                          [(user + "[at]" + host + "[dot]org" + tail, "B-email")], [(user, "B-email"), ("(at)", "I-email"), (host + ".com" + tail, "I-email")]])
        elif kind == "ip":
            words = [(".".join(str(int(x)) for x in rng.integers(1, 255, 4)) + tail, "B-ip")]
        elif kind == "card":
            groups = [digits(4) for _ in range(4)]
            words = pick([[(groups[0], "B-card"), *[(g, "I-card") for g in groups[1:]]], [("-".join(groups) + tail, "B-card")], [("".join(groups) + tail, "B-card")]])
        elif kind == "phone":
            words = pick([[("+" + digits(1), "B-phone"), (f"({digits(3)})", "I-phone"), (f"{digits(3)}-{digits(4)}{tail}", "I-phone")], [(f"({digits(3)})", "B-phone"), (f"{digits(3)}-{digits(4)}{tail}", "I-phone")],
                          [(f"+{digits(11)}{tail}", "B-phone")], [(f"{digits(3)}-{digits(3)}-{digits(4)}{tail}", "B-phone")], [("tel:", "O"), (f"{digits(3)}.{digits(3)}.{digits(4)}{tail}", "B-phone")]])
        else:
            words = [(pick(["DE", "FR", "ES", "GB"]) + digits(20) + tail, "B-iban")]
        return words

    def prose() -> list[tuple[str, str]]:
        words = [pick([word, word, word, word, lambda: word() + ",", lambda: pick(["at", "key", "call", "mail", "card", "host", "dot", "a", "I", "the"]), noise])() for _ in range(int(rng.integers(1, 14)))]
        return [(x, "O") for x in [words[0].capitalize(), *words[1:-1], words[-1].rstrip(",") + pick([".", ".", "!", "?", "", "###", "$$$", "!!"])]] if len(words) > 1 else [(words[0] + pick([".", ""]), "O")]

    table = [prose() for _ in range(rows // 2)]
    for _ in range(rows // 2):
        sentence: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(0, 3))):
            sentence += [(noise(), "O") for _ in range(int(rng.integers(1, 7)))] + private()
        sentence += [(noise(), "O") for _ in range(int(rng.integers(1, 8)))]
        table.append(sentence)
    return table


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(x: np.ndarray, gold: np.ndarray, there: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Log of the labels' conditional probability, summed over sentences, and its gradient, by the forward-backward recursions.

    x: features of all places, sentence by sentence; gold and there: (sentences, places), the labels and which places exist.
    """
    (n, width), size = gold.shape, w["x"].shape[1]
    rows, lengths, at = np.arange(n), there.sum(axis=1), np.nonzero(there)
    e = (x @ w["x"]).reshape(n, width, size).astype(np.float64)
    alpha, beta = np.zeros((n, width, size)), np.zeros((n, width, size))
    alpha[:, 0] = e[:, 0] + w["first"]
    for t in range(1, width):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + w["trans"], 1) + e[:, t]
    for t in range(width - 2, -1, -1):
        step_back = _log_sum(w["trans"][None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(there[:, t + 1, None], step_back, 0)
    z = _log_sum(alpha[rows, lengths - 1], 1)
    value = float((np.take_along_axis(e, gold[:, :, None], 2)[:, :, 0] * there).sum() + w["first"][gold[:, 0]].sum() - z.sum())
    diff = -np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * there[:, :, None]
    diff[at[0], at[1], gold[there]] += 1
    grad = {"x": x.T @ diff.reshape(n * width, size).astype(x.dtype), "first": diff[:, 0].sum(axis=0), "trans": np.zeros((size, size))}
    for t in range(1, width):
        live = np.flatnonzero(there[:, t])
        pair = alpha[live, t - 1, :, None] + w["trans"] + (e[live, t] + beta[live, t])[:, None, :] - z[live, None, None]
        grad["trans"] -= np.exp(np.minimum(pair, 0)).sum(axis=0)
        np.add.at(grad["trans"], (gold[live, t - 1], gold[live, t]), 1)
        value += float(w["trans"][gold[live, t - 1], gold[live, t]].sum())
    return value, grad


@functools.lru_cache(maxsize=1)
def train(steps: int = 70, rate: float = 0.15, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """CRF weights: emission tables own/before/after, transitions and first-token scores; float32, about 0.4 MB."""
    table = labelled_table()
    width = max(map(len, table))
    labels = {x: k for k, x in enumerate(LABELS)}
    n, size = len(table), len(LABELS)
    features, gold, there = np.zeros((n, width, _FIELDS), np.int32), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for k, sentence in enumerate(table):
        own = Tokens([" ".join(t for t, _ in sentence)])
        features[k, : len(sentence)], there[k, : len(sentence)] = own.features, True
        gold[k, : len(sentence)] = [labels[x] for _, x in sentence]
    w = {"own": np.zeros((_TOTAL, size)), "before": np.zeros((_TOTAL, size)), "after": np.zeros((_TOTAL, size)), "trans": np.zeros((size, size)), "first": np.zeros(size)}
    for k, a in enumerate(LABELS):  # I-x only after B-x or I-x
        if a.startswith("I-"):
            w["first"][k] = -20
            for j, b in enumerate(LABELS):
                if b[2:] != a[2:]:
                    w["trans"][j, k] = -20
    used, spot = np.unique(features[there], return_inverse=True)  # few of the possible values occur
    hot = np.zeros((n, width, len(used)), np.float32)
    at = np.nonzero(there)
    for f in range(_FIELDS):
        hot[at[0], at[1], spot.reshape(-1, _FIELDS)[:, f]] = 1
    mask = np.zeros_like(hot[0, 0])
    mask[used >= _START[1]] = 1
    left, right = np.zeros_like(hot), np.zeros_like(hot)
    left[:, 1:], right[:, :-1] = hot[:, :-1] * mask, hot[:, 1:] * mask
    x = np.concatenate([hot, left, right], axis=2).reshape(n * width, -1)
    small = {"x": np.zeros((x.shape[1], size), np.float32), "trans": w["trans"], "first": w["first"]}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in small.items()}
    for step in range(1, steps + 1):
        _, grad = likelihood(x, gold, there, small)
        for k, v in small.items():
            g = grad[k] / n - decay * v
            m, u = moment[k]
            m[:] = 0.9 * m + 0.1 * g
            u[:] = 0.99 * u + 0.01 * g * g
            v += (rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-6) * (np.abs(g) > 1e-9)).astype(v.dtype)
    for k, name in enumerate(("own", "before", "after")):
        w[name][used] = small["x"][k * len(used) : (k + 1) * len(used)]
    return {k: v.astype(np.float32) for k, v in w.items()}


# ---- spans -------------------------------------------------------------------------------------------------------

_LEAD, _TAIL = "\"'([{<#&*%$|", "\"')]}>.,;:!?#&*%$|"


def model_spans(texts: list[str], weights: dict[str, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """Spans of the CRF for each text, trimmed of punctuation around them."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    tokens = Tokens(texts)
    n = len(tokens.start)
    if not n:
        return out
    first, last = _edges(n, tokens.sentence)
    emission = _emissions(tokens.features, weights, first, last)
    label = viterbi(emission, tokens.sentence, weights["trans"], weights["first"])
    k, marked = 0, np.flatnonzero(label)
    while k < len(marked):
        t = int(marked[k])
        kind, stop = (int(label[t]) - 1) // 2, t
        while k + 1 < len(marked) and marked[k + 1] == stop + 1 and int(label[stop + 1]) == 2 * kind + 2 and not first[stop + 1]:
            k, stop = k + 1, stop + 1
        d = int(tokens.doc[t])
        a, b = int(tokens.start[t] - tokens.base[d]), int(tokens.end[stop] - tokens.base[d])
        text = texts[d]
        while a < b and text[a] in _LEAD:
            a += 1
        while b > a and text[b - 1] in _TAIL:
            b -= 1
        if b > a:
            out[d].append((KINDS[kind], a, b))
        k += 1
    return out


def all_spans(texts: list[str], weights: dict[str, np.ndarray]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans and all its spans, both by kind as listed, then start."""
    place = {k: n for n, k in enumerate((*BASE, *[x for x in KINDS if x not in BASE]))}
    result = []
    for text, extra in zip(texts, model_spans(texts, weights)):
        base = base_spans(text)
        added = [s for s in extra if all(s[2] <= b or e <= s[1] for _, b, e in base)]
        result.append((base, sorted(base + added, key=lambda s: (place[s[0]], s[1], s[2]))))
    return result


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # about a million characters at a time, at least one text
                stop, size = at, 0
                column = whole.column("text")
                while stop < whole.num_rows and (stop == at or size < 1_000_000):
                    size += len(column[stop].as_py() or "")
                    stop += 1
                batch = whole.slice(at, stop - at)
                found = all_spans([t or "" for t in batch.column("text").to_pylist()], weights)
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in BASE]
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                        pa.array([_joined(every) for _, every in found], pa.string()),
                        pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                        pa.array([len(every) for _, every in found], pa.int64()),
                    ],
                    ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added", "n_spans"],
                )
                at = stop

    return run


def find_pii(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, base counts, digest of the base spans, all spans as kind:start:end (code points), how many the CRF added, and how many there are."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"
    return narrow.mapInArrow(_find(weights or train()), schema)


def redact(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """All rows and columns, each span of ``text`` replaced by its kind in angle brackets."""
    weights = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = []
            for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], weights)):
                out, at = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
                    if a >= at:
                        out += [text[at:a], f"<{kind}>"]
                    at = max(at, b)
                new.append(None if text is None else "".join([*out, text[at:]]))
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(new, pa.string()))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, schema)
