"""Streaming piece search: equal to the library's encoder, exact round trip, bounded window."""

import itertools
import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece

from quernstone.llm import pieces
from quernstone.llm.pieces import MODEL, Encoder, PieceModel, decode_pieces, encode_pieces, load_model

DOC = "doc_id long, text string, ids string, n_ids int"


@pytest.fixture(scope="module")
def model():
    return load_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n, seed=0):
    rnd = random.Random(seed)
    out = ["", " ", "Hello  world\n\t ok <s> </s> é 漢😀", "ha" * 300, "=" * 500, "0" * 99, "\n" * 9, "x" + " " * 70 + "y"]
    return out + ["".join(rnd.choice("ab the in er   \n\tAé1234漢😀—<>!!aaa") for _ in range(rnd.randint(1, 80))) for _ in range(n)]


def test_equals_the_library_and_round_trips(model, library):
    own = Encoder(model)
    for t, ids in zip(texts(3000), own.encode_all(texts(3000))):
        assert ids.tolist() == library.encode(t)
        assert own.decode(ids.tolist()) == t


def test_whole_corpus(model, library, spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in Encoder(model).encode_all(rows)] == library.encode(rows)


def test_meta_symbol_survives(model):
    own = Encoder(model)
    assert own.decode(own.encode("a▁b ▁").tolist()) == "a▁b ▁"


def test_stream_in_chunks_commits_early(model, library):
    text = "".join(random.Random(3).choices("the and ing er on tion".split(), k=4000))
    own = Encoder(model)
    for size in (1, 7, 1000):
        runs = list(own.stream(text[i : i + size] for i in range(0, len(text), size)))
        assert list(itertools.chain(*runs)) == library.encode("\n" + text)[2:]
        assert max(map(len, runs)) < 200 and len(runs) > 50


def test_memory_of_segments_is_bounded(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 20)
    own = Encoder(model)
    for t in texts(300, 5):
        assert own.encode(t).tolist() == library.encode(t)
        assert len(own.young) + len(own.old) < 100


def test_unigram_takes_the_best_path():
    scores = {"a": -1.0, "b": -1.5, "ab": -2.2, "ba": -3.0, "aba": -2.9, " ": -1.0}
    m = PieceModel(False, {t: k for k, t in enumerate(scores)}, scores, [t.encode() for t in scores], [], 99, False, 3, key="u")

    def best(t):
        found = []
        for cuts in itertools.product(["", "|"], repeat=len(t) - 1):
            path = "".join(c + x for c, x in zip(t, [*cuts, ""])).split("|")
            if all(p in scores for p in path):
                found.append(sum(scores[p] for p in path))
        return max(found)

    own = Encoder(m)
    for n in range(1, 9):
        for t in map("".join, itertools.product("ab", repeat=n)):
            path = [list(scores)[k] for k in own.encode(t)]
            assert "".join(path) == t and abs(sum(scores[p] for p in path) - best(t)) < 1e-9


def test_operator(spark, model, library):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts(50))] + [(900, None, None, None), (901, "long word " * 40_000, "x", 1), (3, "twice", "x", 1), (None, "é", "x", 1)]
    out = encode_pieces(spark.createDataFrame(rows, DOC), model)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), library.encode(t or "")) for i, t, *_ in rows)
    back = decode_pieces(out, model)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert encode_pieces(spark.createDataFrame([], DOC), model).count() == 0


def test_texts_at_one_time_are_bounded_in_bytes(model, library, monkeypatch):
    """A batch of few long texts is taken in runs of rows of about SLICE bytes, whole and in order."""
    rows = ["some words of a text " * 1000 + str(i) for i in range(400)] + [None, "", "é" * 3_000_000, "end"]
    taken, full = [], Encoder.encode_all
    monkeypatch.setattr(Encoder, "encode_all", lambda self, some: taken.append(sum(len((t or "").encode()) for t in some)) or full(self, some))
    out = list(pieces._encode(model)(iter([pa.record_batch([pa.array(rows)], ["text"])])))
    assert sorted(taken)[-2] <= pieces.SLICE and len(taken) > 4
    assert [x for b in out for x in b.column("ids").to_pylist()] == [library.encode(t or "") for t in rows]
    assert all(x for b in out for x in b.column("round_trip").to_pylist())


def test_memory_goes_back_when_another_operator_begins():
    """Small objects that the operator before kept are no longer held by the process."""
    code = """
import re
from quernstone.llm import worker
def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
pins = []
def make():
    kept = []
    for k in range(300_000):  # what later tasks keep lies between, so that the top of the heap stays in use
        kept.append(bytes(600))
        if k % 1000 == 0:
            pins.append(bytes(600))
    return kept
worker.keep("one", make)
full = held()
worker.release()
assert full - held() > 100, (full, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
