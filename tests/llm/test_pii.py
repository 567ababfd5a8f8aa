"""Base patterns against the contract's regular expressions; the CRF on held-out rows of its table and on prose."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quernstone.llm import pii

DOC = "doc_id long, text string, spans string, n_email int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    return sum(sum(divmod(int(x) * 2, 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def weights():
    return pii.train()


def test_base_spans_against_the_contract():
    rnd = random.Random(8)
    parts = ["a@b.c", "@", ".", "x.y-z%@", "d-.e..f", "1.2.3.4", "255.256.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111111111111112", "-", " ", "+1 (743) 555-3824", "+", "(", "é", "12", "٣", "1.2.3.4.5", "+1+2 345678901", "\n", "0" * 30]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 7)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + " (" * 150_000, "a@" * 150_000, "a@b" * 100_000, "+1 " * 100_000):
        pii.base_spans(text)


def brute(emission, transition, first):
    paths = itertools.product(range(emission.shape[1]), repeat=len(emission))
    return max(paths, key=lambda p: first[p[0]] + sum(emission[t, x] for t, x in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:])))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    emission, transition, first = rng.normal(size=(23, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    sentence = np.array([0, 1, 7, 8, 13, 21])
    got = pii.viterbi(emission, sentence, transition, first)
    for a, b in zip(sentence, [*sentence[1:], 23]):
        assert tuple(got[a:b]) == brute(emission[a:b], transition, first)


def test_crf_on_held_out_rows(weights):
    hit = gold = found = 0
    for row in pii.labelled_table(200, seed=77):
        text, at, want = "", 0, []
        for token, label in row:
            at = len(text) + bool(text)
            text = f"{text} {token}" if text else token
            if label.startswith("B-"):
                want.append([label[2:], at, len(text)])
            elif label.startswith("I-"):
                want[-1][2] = len(text)
        spans = pii.model_spans([text], weights)[0]
        gold, found = gold + len(want), found + len(spans)
        hit += sum(any(k == w[0] and a < w[2] and w[1] < b for k, a, b in spans) for w in want)
    assert hit / gold > 0.93 and hit / found > 0.93


def test_operator(spark, weights):
    secret = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"
    rows = [(1, f'é token = "{secret}" end', "x", 1), (2, None, None, None), (3, "", "x", 1), (4, "word " * 60_000 + "me@host.org", "x", 1), (5, "Plain prose, nothing to see here. At all!\nNext line.", "x", 1), (5, "Plain prose.", "x", 1), (None, "9.9.9.9 + 1", "x", 1)]
    got = {(r.doc_id, r.n_ip): r for r in pii.find_pii(spark.createDataFrame(rows, DOC), weights).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1, 0].spans == f"secret:{11}:{11 + len(secret)}" and got[1, 0].base_sha256 == empty and got[1, 0].n_added == 1
    assert (got[2, 0].spans, got[3, 0].spans, got[5, 0].spans) == ("", "", "")
    assert got[4, 0].spans == "email:300000:300011" and got[4, 0].base_sha256 == hashlib.sha256(b"email:300000:300011").hexdigest()
    assert got[None, 1].spans == "ip:0:7"
    assert pii.find_pii(spark.createDataFrame([], DOC), weights).count() == 0
    assert [r.text for r in pii.redact(spark.createDataFrame(rows[:1], DOC), weights).collect()] == ['é token = "<secret>" end']


def test_operator_over_the_table(spark, weights):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = pii.find_pii(docs, weights).collect()
    assert len(out) == len(texts)
    for r in out:
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))or not base


def test_likelihood_and_gradient_against_plain_versions():
    """All label paths added up, and slopes by small steps."""
    rng = np.random.default_rng(5)
    n, width, size, features = 4, 5, 3, 6
    there = np.arange(width)[None] < np.array([5, 3, 1, 4])[:, None]
    x, gold = rng.normal(size=(n * width, features)) * there.reshape(-1, 1), rng.integers(0, size, (n, width))
    w = {"x": rng.normal(size=(features, size)), "trans": rng.normal(size=(size, size)), "first": rng.normal(size=size)}

    def plain_value(w):
        total = 0.0
        for k in range(n):
            e = (x @ w["x"]).reshape(n, width, size)[k, : there[k].sum()]
            score = lambda p, e=e: w["first"][p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(w["trans"][a, b] for a, b in zip(p, p[1:]))
            total += score(gold[k, : len(e)]) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(size), repeat=len(e))))
        return total

    value, grad = pii.likelihood(x, gold, there, w)
    assert abs(value - plain_value(w)) < 1e-8
    for name, own in w.items():
        for at in np.ndindex(own.shape):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((plain_value(up) - plain_value(down)) / 2e-5 - grad[name][at]) < 1e-5


SECRET = re.compile(r"(?:token|secret|password|api_key)\s*=\s*\"?([0-9a-f]{16,})")


def test_secrets_of_documents_that_the_table_did_not_write(spark, weights):
    """Assignments of long hexadecimal values in the given documents, told by a plain pattern."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    found = missed = wrong = clean = 0
    for text, (base, every) in zip(texts, (r for at in range(0, len(texts), 200) for r in pii.all_spans(texts[at : at + 200], weights))):
        added = [s for s in every if s not in base]
        planted = [m.span(1) for m in SECRET.finditer(text)]
        for a, b in planted:
            hit = any(x <= a and b <= y for _, x, y in every) or any(x < b and a < y for k, x, y in added if k == "secret")
            found, missed = found + hit, missed + (not hit)
        if not planted and not base and not re.search(r"[0-9]{4}|@", text):
            clean += 1
            wrong += bool(added)
    assert found + missed > 100 and found >= 0.95 * (found + missed), (found, missed)
    assert wrong <= 0.02 * clean, (wrong, clean)
