"""Personal data: the base against plain regular expressions, the field against brute force, and odd rows."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import _kernels as K
from millrace.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        odd = digits[::-1]
        return 12 <= len(digits) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), P.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0]))


def base(texts):
    cps, off = K.codepoints(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for s, e, k in P.base_spans(cps, off):
        row = int(np.searchsorted(off, s, "right")) - 1
        out[row].append((s - int(off[row]), P.KINDS.index(k), e - int(off[row])))
    return [sorted(x) for x in out]


def numbered(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = n(15)
    card += next(d for d in "0123456789" if P.luhn(card + d))
    return rng.choice([card, " ".join(card[i : i + 4] for i in (0, 4, 8, 12)), f"+{n(2)} ({n(3)}) {n(3)}-{n(4)}", f"{n(2)}.{n(2)}.{n(1)}.{n(3)}", f"a.b{n(1)}@c-d.ef.{n(2)}", "x@y", "a@b.c@d.e", n(5), "@", "+", ".", "é@ü.de", "0009.1.2.3", "x@a..b.c"])


@pytest.mark.parametrize("seed", range(4))
def test_base_against_plain_expressions(seed):
    rng = random.Random(seed)
    texts = [None, ""] + ["".join(rng.choice([numbered(rng), rng.choice("ab1. -+()@\n\té%_0")]) for _ in range(rng.randrange(30))) for _ in range(400)]
    want = [brute(t) for t in texts]
    assert {k for w in want for _, k, _ in w} == {0, 1, 2, 3}
    assert base(texts) == want


def test_base_in_characters_only():
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1@.-+ ()") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert base(texts) == [brute(t) for t in texts]


def test_long_stretches_take_linear_time():
    text = "a" * 200_000 + "@" + "b" * 200_000 + " " + "@a" * 50_000 + "1 " * 100_000
    assert base([text])[0] == []


@pytest.fixture(scope="module")
def model():
    return P.fit(P.labelled())


def path_score(scores, after, labels):
    return sum(scores[i, c] for i, c in enumerate(labels)) + sum(after[b, a] for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    sizes, after = [4, 1, 3, 5, 2, 4], rng.normal(size=(3, 3))
    ends = np.cumsum(sizes)
    scores = rng.normal(size=(ends[-1], 3))
    got = P.viterbi(scores, ends - sizes, ends, after)
    for s, e in zip(ends - sizes, ends, strict=True):
        best = max(product(range(3), repeat=e - s), key=lambda y: path_score(scores[s:e], after, y))
        assert tuple(got[s:e]) == best


def test_likelihood_and_gradients_against_all_paths():
    rng = np.random.default_rng(4)
    sizes, after = np.array([3, 1, 4]), rng.normal(size=(3, 3))
    ends = np.cumsum(sizes)
    scores, labels = rng.normal(size=(8, 3)), rng.integers(0, 3, 8)

    def loss(scores, after):
        total = 0.0
        for s, e in zip(ends - sizes, ends, strict=True):
            total += np.log(sum(np.exp(path_score(scores[s:e], after, y)) for y in product(range(3), repeat=e - s))) - path_score(scores[s:e], after, labels[s:e])
        return total

    got, grad, step = P._likelihood(scores, labels, ends - sizes, ends, after)
    assert abs(got - loss(scores, after)) < 1e-9
    for g, at, of in ((grad, (5, 1), 0), (grad, (3, 2), 0), (step, (1, 2), 1), (step, (0, 0), 1)):
        moved = [scores.copy(), after.copy()]
        moved[of][at] += 1e-6
        assert abs((loss(*moved) - got) / 1e-6 - g[at]) < 1e-4


def test_sequences_left_out_change_nothing(model):
    texts = [P.filled(t, random.Random(7))[0] for t in P.MARKED + P.PLAIN] + ["plain words only here"] * 5
    cps, off = K.codepoints(pa.array(texts))
    tokens = P.Tokens(cps, off)
    scores = model.emissions(tokens)
    scores[:, 0] += model.caution
    first = np.flatnonzero(np.concatenate(([True], tokens.seq[1:] != tokens.seq[:-1])))
    whole = P.viterbi(scores, first, np.append(first[1:], len(tokens.s)), model.after.astype(np.float32))
    assert (P.decode(model, tokens) == whole).all() and whole.any()


def test_held_out_sentences(model):
    rows = P.labelled(4, seed=99)
    cps, off = K.codepoints(pa.array([t for t, _ in rows]))
    tokens = P.Tokens(cps, off)
    got, want = P.decode(model, tokens), np.zeros(len(tokens.s), int)
    for r, (_, spans) in enumerate(rows):
        for s, e, k in spans:
            want[(tokens.row == r) & (tokens.s - off[r] < e) & (tokens.e - off[r] > s)] = 1 + P.KINDS.index(k)
    right = ((got > 0) & (got == want)).sum()
    assert right / (got > 0).sum() >= 0.97 and right / (want > 0).sum() >= 0.7


def test_fitting_twice_gives_one_model():
    rows = P.labelled(1)
    a, b = P.fit(rows, 5), P.fit(rows, 5)
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights) and (a.after == b.after).all()


def test_result_rows(spark, model):
    texts = [None, "", "nothing here", "write to a.b@c.de or +1 (234) 567-8901 now", 'x token = "0123456789abcdef0123456789abcdef01234567" y', "4539 1488 0343 6467", "a" * 300_000, "write to a.b@c.de or +1 (234) 567-8901 now"]
    docs = spark.createDataFrame([(i % 7, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, spans int, key int")
    rows = P.find(docs, model).collect()
    assert len(rows) == len(texts)
    by = {r["spans"]: r for r in rows}
    assert "email:9:17,phone:21:38" in by and by["email:9:17,phone:21:38"]["n_email"] == 1
    assert "secret:11:51" in by and by["secret:11:51"]["n_added"] == 1
    assert "card:0:19" in by and by[""]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert P.find(docs.limit(0), model).count() == 0


def test_query_against_plain_expressions(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = P.op11_personal_data(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        text = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.BASE] == [sum(x[1] == i for x in want) for i in range(4)]
        spans = [(int(s), P.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans) and set(want) <= set(spans) and len(spans) == len(want) + r["n_added"]
        assert not any(s < e2 and s2 < e for s, k, e in set(spans) - set(want) for s2, _, e2 in want)
