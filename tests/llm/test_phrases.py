"""Phrase mining against brute force, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string"


def brute(docs, least, top):
    count, total = {}, Counter()
    for _, text, lang in docs:
        c = count.setdefault(lang if lang is not None else "und", Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang if lang is not None else "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    c[tuple(w[i : i + m])] += 1
    out = []
    for lang, c in count.items():
        big = {p: n for p, n in c.items() if n >= least and len(p) > 1}

        def inside(p):
            return any(n >= big[p] for o, n in big.items() if len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1)))

        rows = []
        for p, a in big.items():
            if inside(p):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def result(spark, docs, least=3, top=50, schema=SCHEMA):
    return sorted(tuple(r) for r in P.phrases(spark.createDataFrame(docs, schema), least, top).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["Aa", "b", "c", "É", "ß x", "d\x01", "the", "THE", "of", "\x00", "10.5"]
    passages = [" ".join(rng.choice(words) for _ in range(k)) for k in (3, 6, 9)]
    text = lambda: "".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(passages)]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", ""]) for _ in range(rng.randrange(40)))
    return [(rng.choice([None, i]), rng.choice([None, "", text(), text(), text()]), rng.choice(["en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute(docs, 3, 50)
    assert len(want) > 20 and max(len(w[2].split(" ")) for w in want) == 5
    assert result(spark, docs) == want


def test_top_and_ties(spark):
    docs = [(i, "x y. p q. m n. m n", "en") for i in range(4)]
    assert result(spark, docs, 3, 2) == brute(docs, 3, 2)
    assert [r[2] for r in result(spark, docs, 3, 2)] == ["p q", "x y"]


def test_overlaps_count(spark):
    docs = [(1, "a a a a a a a", "en")]
    assert result(spark, docs, 3) == brute(docs, 3, 50)


def test_empty_tables_and_texts(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, None), (2, "", "en"), (3, ". , ", "en"), (4, "one", "en")], 1) == []


def test_a_rare_language_and_long_text(spark):
    docs = [(i, "u v w", "rare" if i < 2 else "en") for i in range(6)] + [(9, "u v w z " * 30_000, "long")]
    assert result(spark, docs, 3) == brute(docs, 3, 50)


def test_clashing_columns(spark):
    docs = corpus(7, 30)
    odd = [(*d, 1, 2, 3, "x") for d in docs]
    assert result(spark, odd, schema=SCHEMA + ", n int, phrase int, w1 int, rank string") == brute(docs, 3, 50)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_growth_does_not_depend_on_batches(size):
    rng = random.Random(size)
    rows = Counter(("en", *(rng.choice("ab") for _ in range(rng.choice([3, 3, 4, 5])))) for _ in range(300))
    rows = sorted(((k + (None,) * (6 - len(k)), n) for k, n in rows.items()), key=lambda r: tuple((x is not None, x or "") for x in r[0]))
    batches = [pa.RecordBatch.from_pydict({c: pa.array([r[0][i] for r in rows[a : a + size]], pa.string()) for i, c in enumerate(["lang", "w1", "w2", "w3", "w4", "w5"])} | {"n": pa.array([r[1] for r in rows[a : a + size]], pa.int64())}) for a in range(0, len(rows), size)]
    want = Counter()
    for path, n in rows:
        words = [w for w in path if w is not None]
        for d in range(4, len(words) + 1):
            want[" ".join(words[1:d])] += n
    got = [(p, n) for b in P.grow(iter(batches), 12) for p, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist(), strict=True)]
    assert len(got) == len(dict(got)) and dict(got) == {p: n for p, n in want.items() if n >= 12}


def test_rare_words_that_pass_the_bitmap_change_nothing(spark, monkeypatch):
    docs = corpus(11)
    full = P.Known(np.arange(P.BITS >> 6), np.full(P.BITS >> 6, (1 << 64) - 1, np.uint64))
    monkeypatch.setattr(P, "known", lambda pairs: full)
    assert result(spark, docs) == brute(docs, 3, 50)


def test_products_beyond_64_bits(spark):
    n = 4_000_000_000_000
    frequent = spark.createDataFrame([("en", "a", 3 * n), ("en", "b", 2 * n), ("en", "a b", n)], "lang string, phrase string, n long")
    row = P.scored(frequent, spark.createDataFrame([("en", 9 * n)], "lang string, n long")).first()
    assert row["score"] == 1000 * n * 9 * n // (3 * n * 2 * n)


def test_only_extensions_by_one_word_need_be_looked_at(spark):
    docs = [(i, "k l m n o", "en") for i in range(3)] + [(9, "l m", "en")]
    got = {r[2] for r in result(spark, docs)}
    assert got == {"k l m n o", "l m"} == {r[2] for r in brute(docs, 3, 50)}


def test_query_equals_its_sql(compare):
    compare(P.op13_phrases, P.ORACLE_SQL)


def test_known_holds_what_it_was_given(spark):
    known = P.known(spark.createDataFrame([("en", f"w{i} x{i % 7}") for i in range(500)], "lang string, phrase string"))
    one = P.Words(pa.array([" ".join(f"w{i} x{i % 7}," for i in range(500))]), pa.array(["en"]))
    assert known(one.pairs()).all() and not known(one.pairs() + np.uint64(1)).any()
