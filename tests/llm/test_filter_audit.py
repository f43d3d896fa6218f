"""The filter audit against brute force over every order, and on odd rows."""

import random
from itertools import permutations

import pytest

from millrace.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, extra int"
LABELS = "doc_id long, quality int, toxic int"


def fails(doc, docs):
    text = doc[1] or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    out = ""
    out += "A" * (len(words) < 200)
    out += "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
    out += "D" * any(c in "#$%&*|" for c in text)
    return out + "E" * (doc[0] is not None and any(o[0] is not None and o[0] < doc[0] and (o[1] or "") == text for o in docs))


def brute(docs, labels):
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    out = {}
    for part in {d[2] or "" for d in docs}:
        mine = [(d, fails(d, docs)) for d in docs if (d[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for i, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                out[part, order, i + 1] = [len(left), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == c for _, f in mine), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone)]
        for order in map("".join, permutations("ABCDE")):
            for i, c in enumerate(order):
                out[part, order, i + 1].append(total[c])
    return out


def result(spark, docs, labels):
    rows = A.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["aa", "bb", "Cc", "d" + str(rng.randrange(k)), "x#"][: rng.choice([2, 3, 4, 5])]) for _ in range(rng.choice([3, 150, 260]))) for k in [3, 400] * 8]
    texts += ["", None, " ".join(f"w{i}" for i in range(300)), "é   ü " * 120]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), 0) for _ in range(n)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs, labels = corpus(seed)
    assert result(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert result(spark, [], []) == {}
    assert result(spark, [(1, None, None, 0)], []) == brute([(1, None, None, 0)], [])


def test_one_text_and_one_key_many_times(spark):
    docs = [(i % 50 if i % 3 else 7, "same words here", "en", 0) for i in range(300)] + [(7, "another", "en", 0)] * 100
    labels = [(7, 1, 0)] * 20 + [(7, None, 1)]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_sums_invert(spark):
    counts = spark.createDataFrame([("p", False, False, m, m * m + 1) for m in range(32)] + [("p", True, False, 5, 9)], "part string, good boolean, toxic boolean, mask int, n long")
    sums = A.parity_sums(counts)
    assert {r["label"]: r["sums"][0] for r in sums.collect()} == {"all": sum(m * m + 1 for m in range(32)) + 9, "good": 9}
    row = A.cells(sums).first()
    assert row["all"] == [m * m + 1 + 9 * (m == 5) for m in range(32)] and row["good"] == [9 * (m == 5) for m in range(32)] and row["toxic"] == [0] * 32


def test_clashing_and_extra_columns(spark):
    docs, labels = corpus(5, 40)
    plain = result(spark, docs, labels)
    odd = spark.createDataFrame([(d[0], d[1], d[2], 1, 2, 3, 4, 5, 6, 7) for d in docs], "doc_id long, text string, lang string, m int, t int, n int, words int, part int, digest int, mask int")
    more = spark.createDataFrame([(*r, 1, 2, 3) for r in labels], LABELS + ", good int, k int, key int")
    rows = A.audit(odd, more).collect()
    assert {(r["part"], r["filter_order"], r["step"]): r["shapley"] for r in rows} == {k: v[-1] for k, v in plain.items()}


def test_query_equals_its_sql(compare):
    compare(A.op12_filter_audit, A.ORACLE_SQL)
