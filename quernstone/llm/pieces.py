"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search runs over the lattice of all pieces. A unigram model takes the path of the largest sum of scores. For a
merge-rank (BPE) model the path that merging would give is the only one in which every two neighbouring pieces are what
merging makes of their two texts, so that edges are allowed or not, each position has one survivor, and the same search
gives the ids of the reference encoder exactly.

Only a window is held: positions further back than the longest piece cannot be reached by a new edge, and whenever the
back pointers of all positions within that distance meet at one boundary, everything before it is final, is written out
and dropped. A character of no piece (a line break, say) is such a boundary by itself and becomes its UTF-8 bytes.

No piece holds a space after another character, so the same is true before every run of spaces: the segments between
such boundaries are encoded on their own and remembered (two generations of at most ``REMEMBER`` segments each, a
bound on memory that leaves results alone).

Text U+2581 itself, which the model uses for a space, is written as bytes, so that decoding gives back every text.

Defined results: null and empty texts have no ids and decode to the empty text; unpaired surrogates do not occur in
Spark strings; repeated rows are encoded each; all other columns are kept, but for one named like a result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import wordhash, worker

REMEMBER, SEGMENT, SLICE = 280_000, 40, 2 << 20
META = "▁"
#: Where the model file lies unless the session names another in ``MODEL_CONF``.
MODEL, MODEL_CONF = "/opt/tokenizers/piece_bpe_32k.model", "spark.quernstone.pieceModel"


@dataclass
class PieceModel:
    """Plain tables, sent to the executors with the task (the size of the vocabulary, about 1 MB)."""

    bpe: bool
    ids: dict[str, int]  # spaces instead of U+2581; only pieces that the search may use
    scores: dict[str, float]
    surface: list[bytes]
    byte_ids: list[int]
    unknown: int
    prefix: bool  # a space is put before the text
    longest: int
    rank: dict[str, int] = field(default_factory=dict)
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)
    key: str = ""


def _merge_to_two(piece: str, rank: dict[str, int]) -> tuple[str, ...]:
    """Merge by rank, leftmost first, until two parts or none that merge are left."""
    parts = list(piece)
    while len(parts) > 2:
        best, at = None, -1
        for k in range(len(parts) - 1):
            r = rank.get(parts[k] + parts[k + 1])
            if r is not None and (best is None or r < best):
                best, at = r, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def load_model(path: str = MODEL) -> PieceModel:
    """Read a model file of a public tokenizer; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    raw = open(path, "rb").read()
    spec = proto.ModelProto()
    spec.ParseFromString(raw)
    if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave texts as they are can be decoded exactly")
    kinds = proto.ModelProto.SentencePiece
    ids, scores, surface, byte_ids, unknown = {}, {}, [], [0] * 256, 0
    for k, p in enumerate(spec.pieces):
        text = p.piece.replace(META, " ")
        if p.type == kinds.BYTE:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte] = k
            surface.append(bytes([byte]))
        elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            ids[text], scores[text] = k, p.score
            surface.append(text.encode())
        else:
            unknown = k if p.type == kinds.UNKNOWN else unknown
            surface.append(b"")
    bpe = spec.trainer_spec.model_type == spec.trainer_spec.BPE
    model = PieceModel(
        bpe, ids, scores, surface, byte_ids if any(byte_ids) else [], unknown, spec.normalizer_spec.add_dummy_prefix, max(map(len, ids)), key=hashlib.sha256(raw).hexdigest()
    )
    if bpe:
        order = sorted((t for t in ids if len(t) > 1), key=lambda t: (-scores[t], ids[t]))
        merged = {t: n for n, t in enumerate(order)}
        for t in order:
            halves = _merge_to_two(t, merged)
            if len(halves) == 2:
                model.halves[t] = halves
        # a piece that merging never makes is no edge
        model.ids = {t: k for t, k in ids.items() if len(t) == 1 or t in model.halves}
        model.rank = {t: n for t, n in merged.items()}
    return model


class Encoder:
    """Streaming Viterbi over one model; ``remembered`` segments make repeated words cheap."""

    def __init__(self, model: PieceModel) -> None:
        self.m = model
        self.valid: dict[int, bool] = {}  # pair of ids -> whether merging leaves it as it is
        self.names = {k: t for t, k in model.ids.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split = re.compile(r"\n| *[^ \n]+| +")

    def _check(self, a: str, b: str) -> bool:
        """Whether merging the text a+b gives exactly (a, b).

        Undo the later of the two last merges again and again; the pair is broken up if, at any time, the parts that
        touch at the border would have merged before the merge that was undone.
        """
        rank, halves = self.m.rank, self.m.halves
        # a merge at the border comes before a merge inside a or b if its rank is lower; at equal rank (one piece twice)
        # the one further left comes first: the border before b's, a's before the border
        limit: tuple[float, int] = (float("inf"), 0)
        while True:
            both = rank.get(a + b)
            if both is not None and (both, 1) < limit:
                return False
            ra, rb = (rank[x] if x in halves else -1 for x in (a, b))
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = (ra, 0), halves[a][1]
            else:
                limit, b = (rb, 2), halves[b][0]

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that arrives in chunks, in runs that are final; spaces as in the text, no prefix added."""
        m = self.m
        held, back, cost = "", [0], [0.0]  # held text; for each position the start of the survivor's last piece
        for chunk in chunks:
            for ch in chunk:
                if ch == META or ch not in m.ids:
                    if held:
                        yield self._path(held, back, len(held))
                    yield [m.byte_ids[x] for x in ch.encode("utf-8", "replace")] if m.byte_ids else [m.unknown]
                    held, back, cost = "", [0], [0.0]
                    continue
                held += ch
                self._extend(held, back, cost)
                if len(held) >= 4 * m.longest:
                    final = self._meeting(back)
                    if final:
                        yield self._path(held, back, final)
                        held = held[final:]
                        back = [0, *[x - final for x in back[final + 1 :]]]
                        cost = cost[final:]
        if held:
            yield self._path(held, back, len(held))

    def _extend(self, held: str, back: list[int], cost: list[float]) -> None:
        """The survivor at the new end of the window."""
        ids, end = self.m.ids, len(held)
        if self.m.bpe:
            for start in range(max(0, end - self.m.longest), end):
                piece = held[start:end]
                if piece in ids and (start == 0 or self._check(held[back[start] : start], piece)):
                    back.append(start)
                    cost.append(0.0)
                    return
            raise AssertionError(f"no path to {held!r}")
        best, at = None, end - 1
        for start in range(max(0, end - self.m.longest), end):
            piece = held[start:end]
            if piece in ids and (best is None or cost[start] + self.m.scores[piece] > best):
                best, at = cost[start] + self.m.scores[piece], start
        back.append(at)
        cost.append(best)

    def _meeting(self, back: list[int]) -> int:
        """The last boundary on the paths to every position that a new piece can begin at; 0 if there is none."""
        ends = set(range(max(0, len(back) - self.m.longest), len(back)))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(back[top])
        # the window's first piece must stay whole in later checks of a pair, so one piece before the meeting is kept
        return back[ends.pop()]

    def _path(self, held: str, back: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(self.m.ids[held[back[end] : end]])
            end = back[end]
        return out[::-1]

    def _streamed(self, text: str) -> bytes:
        return array("i", [x for run in self.stream([text]) for x in run]).tobytes()

    def search(self, segments: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct segment with its ids as int32 bytes.

        The search goes from left to right, so segments are taken in sorted order and each keeps the lattice of the
        prefix that it shares with the one before. Segments longer than a window, or with a character of no piece, go
        through :meth:`stream`.
        """
        ids, longest, valid, names = self.m.ids, self.m.longest, self.valid, self.names
        if not self.m.bpe:
            for text in segments:
                yield text, self._streamed(text)
            return
        held, last, back = "", [-1], [0]
        for text in sorted(segments):
            size, same = len(text), 0
            for x, y in zip(text, held):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], back[same + 1 :]
            held = text[:same]
            if size > 4 * longest or META in text:
                yield text, self._streamed(text)
                continue
            for end in range(same + 1, size + 1):
                for start in range(end - longest if end > longest else 0, end):
                    piece = ids.get(text[start:end])
                    if piece is not None:
                        if not start:
                            break
                        key = last[start] << 20 | piece
                        fits = valid.get(key)
                        if fits is None:
                            fits = valid[key] = self._check(names[last[start]], names[piece])
                        if fits:
                            break
                else:
                    break
                last.append(piece)
                back.append(start)
            if len(back) <= size:
                held = text[: len(back) - 1]
                yield text, self._streamed(text)
                continue
            held, out, end = text, [], size
            while end:
                out.append(last[end])
                end = back[end]
            out.reverse()
            yield text, array("i", out).tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split, prefix = self.split.findall, " " if self.m.prefix else ""
        parts = [split(prefix + t) if t else [] for t in texts]
        known, old = self.young, self.old
        fresh: dict[str, bytes] = {}
        unseen = {s for own in parts for s in own}.difference(known)
        for s in [s for s in unseen if s in old]:
            fresh[s] = old[s]
            unseen.discard(s)
        fresh.update(self.search(unseen))
        known.update(fresh)
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), "<i4") for own in parts]
        for s in fresh:
            if len(s) > SEGMENT:
                del known[s]
        if len(known) > REMEMBER:
            self.young, self.old = {}, known
        if len(self.valid) > 2 * REMEMBER:
            self.valid.clear()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.m.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def encoder(model: PieceModel) -> Encoder:
    """One encoder per worker process and model, so that its memory of segments outlives a task."""
    return worker.keep(f"pieces {model.key}", lambda: Encoder(model))


def session_model(df: DataFrame) -> PieceModel:
    return load_model(df.sparkSession.conf.get(MODEL_CONF, MODEL))


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE bytes of text, at least one row: their segments are Python strings at one time."""
    _, offsets = wordhash.column(whole.column("text"))
    at = 0
    while at < whole.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield whole.slice(at, stop - at)
        at = stop


def _encode(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for whole in batches:
            for batch in _slices(whole):
                texts = batch.column("text").to_pylist()
                rows = own.encode_all(texts)
                same = [own.decode(r.tolist()) == (t or "") for r, t in zip(rows, texts)]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(same)], [*batch.schema.names, "ids", "n_ids", "round_trip"]
                )

    return run


def encode_pieces(docs: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """All columns and rows, with ``ids`` array<int>, ``n_ids`` and ``round_trip`` (decoding gave back the text)."""
    docs = docs.drop("ids", "n_ids", "round_trip").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(_encode(model or session_model(docs)), f"{schema}, ids array<int>, n_ids bigint, round_trip boolean")


def _decode(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [own.decode(r or []) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def decode_pieces(encoded: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """All columns and rows, with ``text`` decoded from ``ids`` (a column of that name is replaced)."""
    rest = encoded.drop("text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    return rest.mapInArrow(_decode(model or session_model(encoded)), f"{schema}, text string")
