"""Words counted by slices: as many rows are shuffled as a slice has different words, and the result is that of plain counts."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.grouped import whole_groups
from millrace.operators import counts as C
from millrace.operators import index as I
from millrace.operators import postings as P


def test_whole_groups():
    rows = [(k, 1) for k in "aabbbbcdddd"]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows[i : i + 2]], pa.string()), "m": [r[1] for r in rows[i : i + 2]]}) for i in range(0, len(rows), 2)]
    for most in (1, 3, 100):
        got = [[b.column("k")[int(i)].as_py() for i in at] for b, at in whole_groups(iter(batches), ["k"], "m", most)]
        assert [k for g in got for k in g] == ["a", "b", "c", "d"]
        assert sum(b.num_rows for b, _ in whole_groups(iter(batches), ["k"], "m", most)) == len(rows)
    assert not list(whole_groups(iter([]), ["k"], "m", 1))


@pytest.mark.parametrize(("slice_", "at_once"), [(1 << 20, 1 << 18), (7, 3)])
def test_bigrams_by_slices(spark, monkeypatch, slice_, at_once):
    monkeypatch.setattr(C, "BIGRAMS", slice_)
    monkeypatch.setattr(C, "AT_ONCE", at_once)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "sea", "Ship,", "42", "é", "a" * 9, "zoé", "x" + str(rng.randrange(9)) + "y"]) for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    lines = spark.createDataFrame([(t,) for t in [*texts, None, "", "alone", " \t"]], "line string").repartition(3)
    norm = lambda t: [w for w in ("".join(p).strip("0123456789,.é") for p in t.lower().split()) if w]
    plain = Counter(p for t in texts for p in zip(norm(t), norm(t)[1:]))  # noqa: B905
    assert {(r["w1"], r["w2"]): r["n"] for r in C.bigrams(lines).collect()} == plain
    stripes = defaultdict(dict)
    for (a, b), n in plain.items():
        stripes[a][b] = n
    got = C.bigram_stripes_of(lines).withColumn("keys", F.map_keys("stripe")).collect()
    assert len(got) == len(stripes)
    for r in got:
        of = stripes[r["w1"]]
        assert r["total"] == sum(of.values()) and r["keys"] == sorted(of) and r["stripe"] == {w: n / r["total"] for w, n in of.items()}


def test_a_slice_shuffles_a_row_a_word(spark):
    lines = spark.createDataFrame([("the sea the ship " * 20,)] * 300, "line string").coalesce(1)
    rows = C.bigram_stripes_of(lines)
    held = rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r["w1"]: r["total"] for r in rows.collect()} == {"the": 40 * 300, "sea": 20 * 300, "ship": 20 * 300 - 300}
    assert "Generate" not in held and "Aggregate" not in held  # no place of a word is a row


@pytest.mark.parametrize(("slice_", "block"), [(1 << 21, 1 << 20), (9, 10)])
def test_posting_lists_by_runs(spark, monkeypatch, slice_, block):
    """Those of plain counts, also of numbers that stand twice, negative ones, texts that are null and documents without a number."""
    monkeypatch.setattr(P, "SLICE", slice_)
    monkeypatch.setattr(P, "TOKENS", slice_)
    rng = random.Random(4)
    docs = [(rng.randrange(-30, 300), " ".join(rng.choice(["the", "sea", "Ship,", "42", "x" + str(rng.randrange(9)) + "y"]) for _ in range(rng.randrange(0, 12)))) for _ in range(200)]
    docs = spark.createDataFrame([*docs, (7, None), (None, "the the sea"), (5, "")], "doc_id long, text string").repartition(3)
    plain, got = I.posting_lists(I.postings(docs), block), P.lists(docs, block=block)
    assert got.dtypes == plain.dtypes
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(plain)
