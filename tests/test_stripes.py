"""Merged stripes against counting pairs one by one."""

import random
import tracemalloc
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from millrace.operators import counts as C
from millrace.operators import stripes as S


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in "xyz"]
    return [" ".join(rng.choice(words[: rng.choice([3, 10, 24])]) for _ in range(rng.choice([0, 1, 2, 5, 12, 40]))) for _ in range(n)]


def brute(lines):
    got = Counter()
    for line in lines:
        got.update(permutations(sorted(set(line.split()[:100])), 2))
    return got


@pytest.mark.parametrize("seed, most", [(1, 1), (2, 50), (3, 1 << 20)])
def test_vectors_against_counting(seed, most, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "SPAN_BITS", 2)
    monkeypatch.setattr(S, "SPAN", 4)
    ids = [0, 1, 2, 3, 5, 8, 9, 1 << 33, (1 << 33) + 1, (1 << 33) + 6]
    lines = [rng.sample(ids, rng.randrange(len(ids))) for _ in range(60)]
    want = Counter(p for line in lines for p in permutations(line, 2))
    batches = [pa.RecordBatch.from_pydict({"ids": pa.array(lines[i : i + 7], pa.list_(pa.int64()))}) for i in range(0, 60, 7)]
    vectors = [b for b in S.count_slices(iter(batches), most)]
    flat = sorted(((x, r, y, n) for b in vectors for x, r, y, n in zip(*(b.column(c).to_pylist() for c in ("x", "range", "ys", "ns")), strict=True)), key=lambda v: v[:2])
    columns = list(zip(*flat, strict=True))
    for size in (1, 3, 1000):
        sorted_ = [pa.RecordBatch.from_arrays([pa.array(columns[0][i : i + size], pa.int64()), pa.array(columns[1][i : i + size], pa.int64()), pa.array(columns[2][i : i + size], pa.binary()), pa.array(columns[3][i : i + size], pa.binary())], ["x", "range", "ys", "ns"]) for i in range(0, len(flat), size)]
        merged = list(S.merge(iter(sorted_)))
        got, keys = {}, []
        for b in merged:
            keys += list(zip(b.column("x").to_pylist(), b.column("range").to_pylist(), strict=True))
            _, x, y, n = S._triples(b)
            got |= dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True))
        assert got == dict(want) and len(keys) == len(set(keys)) and keys == sorted(keys)


def test_pairs_and_profile(spark):
    lines = corpus(4)
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    want, freq = brute(lines), Counter(w for line in lines for w in set(line.split()))
    pairs = {(r["x"], r["y"]): (r["n"], r["pmi"]) for r in C.pmi_pairs(df).collect()}
    assert {k: v[0] for k, v in pairs.items()} == dict(want)
    assert all(abs(v[1] - np.log10(v[0] * len(lines) / (freq[x] * freq[y]))) < 1e-12 for (x, y), v in pairs.items())
    assert {(r["x"], r["y"]): r["n"] for r in C.cooccurrence(df, min_count=3).collect()} == {k: n for k, n in want.items() if k[0] < k[1] and n >= 3}
    for r in C.pmi_profile(df).collect():
        mine = [v for (x, _), v in pairs.items() if x == r["x"]]
        assert (r["partners"], r["together"]) == (len(mine), sum(n for n, _ in mine))
        assert abs(r["highest"] - max(p for _, p in mine)) < 1e-12 and abs(r["lowest"] - min(p for _, p in mine)) < 1e-12


def test_numbers_follow_frequency(spark):
    words = spark.createDataFrame([(f"w{i}", 1 + i % 5) for i in range(200)], "word string, n long")
    got = sorted(S.numbered(words).collect(), key=lambda r: r["id"])
    assert [r["n"] for r in got] == sorted((r["n"] for r in got), reverse=True) and len({r["id"] for r in got}) == 200
    first, n = S.steps(S.numbered(words))
    assert n.tolist() == [5, 4, 3, 2, 1] and (np.diff(first) > 0).all()


def test_lines_without_pairs(spark):
    df = spark.createDataFrame([("",), ("one",), ("one one",)], "line string")
    assert C.pmi_pairs(df).count() == 0 and C.pmi_profile(df).count() == 0 and C.cooccurrence(df.limit(0)).count() == 0


def test_vectors_hold_what_they_are_given():
    rng = np.random.default_rng(5)
    x, y = np.divmod(np.sort(rng.choice(9 << 18, 5000, replace=False)), 1 << 18)  # ranges 0 to 3
    n = rng.choice([1, 2, 254, 255, 256, 70_000, 2**32 - 1], 5000)
    got = S._stripes(x, y, n)
    for part in (got, got.slice(3, 9)):
        row, a, b, c = S._triples(part)
        keep = np.isin(np.cumsum(np.concatenate(([0], (x[1:] != x[:-1]) | (y[1:] >> 16 != y[:-1] >> 16)))), np.arange(len(got)) if part is got else np.arange(3, 12))
        assert (a == x[keep]).all() and (b == y[keep]).all() and (c == n[keep]).all()


def test_pairs_of_a_slice_are_written_once_and_merged_over_batches():
    lines = [[j for j in range(40) if (i * j) % 7 < 4] for i in range(300)]
    batches = [pa.RecordBatch.from_pydict({"ids": pa.array(lines[i : i + 10], pa.list_(pa.int64()))}) for i in range(0, 300, 10)]
    out = list(S.count_slices(iter(batches), mirrored=False))
    want = Counter(p for line in lines for p in permutations(line, 2) if p[0] < p[1])
    triples = [t for b in out for t in zip(*(v.tolist() for v in S._triples(b)[1:]), strict=True)]
    assert {(x, y): n for x, y, n in triples} == want and len(triples) == len(want)  # thirty batches are one slice


def test_rare_words_take_no_part_in_listings(spark):
    df = spark.createDataFrame([("a b c",)] * 3 + [("a b d",)], "line string")
    words = S.numbered(C.line_frequency(df))
    kept = S.lines_of_ids(df, words, least=3).collect()
    assert sorted(len(r["ids"]) for r in kept) == [2, 3, 3, 3]  # d stands on one line
    assert sorted((r["x"], r["y"], r["n"]) for r in C.cooccurrence(df, min_count=3).collect()) == [("a", "b", 4), ("a", "c", 3), ("b", "c", 3)]


def test_memory_of_a_task_follows_the_pairs_it_holds():
    rng = np.random.default_rng(3)
    lines = pa.ListArray.from_arrays(pa.array(np.arange(0, 220_001, 100), pa.int32()), pa.array(rng.integers(0, 50_000, 220_000)))
    batch = pa.RecordBatch.from_arrays([lines], ["ids"])
    tracemalloc.start()
    try:
        n = sum(int(pa.compute.sum(pa.compute.binary_length(b.column("ys"))).as_py()) for b in S.count_slices(iter([batch]), mirrored=False))
        assert n > 2 * 10_000_000 and tracemalloc.get_traced_memory()[1] < 400e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("rounds", [1, 3, 100])
def test_slices_of_rounds(rounds, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 30)
    rng = random.Random(7)
    lines = [sorted(rng.sample(range(23), rng.randrange(15))) for _ in range(90)]
    want, got = Counter(p for line in lines for p in permutations(line, 2) if p[0] < p[1]), Counter()
    for turn in range(rounds):
        held = S._Slice(40, 5, rounds, turn)
        for i in range(0, 90, 9):
            off = np.cumsum([0, *map(len, lines[i : i + 9])])
            for b in held.add(np.array([v for line in lines[i : i + 9] for v in line], np.int64), off):
                got.update({(x, y): n for x, y, n in zip(*(v.tolist() for v in S._triples(b)[1:]), strict=True)})
        for b in held.flush():
            got.update({(x, y): n for x, y, n in zip(*(v.tolist() for v in S._triples(b)[1:]), strict=True)})
    assert got == want


def test_rounds_count_every_pair_once(spark, monkeypatch):
    for name, value in (("ROUND", 60), ("ROUNDS", 3), ("PAIRS", 50), ("WORDS", 40), ("MERGED", 64)):
        monkeypatch.setattr(S, name, value)
    lines = [*corpus(6, 40), *["ax by cz"] * 30]
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "line string").repartition(3)
    want, freq = brute(lines), Counter(w for line in lines for w in set(line.split()))
    keep = {k: (n, np.log10(n * (len(lines) + 1) / (freq[k[0]] * freq[k[1]]))) for k, n in want.items() if n >= 3}
    got = {(r["x"], r["y"]): (r["n"], r["pmi"]) for r in C.pmi_pairs(df, min_count=3).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in keep.items()} and all(abs(got[k][1] - v[1]) < 1e-12 for k, v in keep.items())
    stripes = C.pmi_stripes_of(df, min_count=3).collect()
    assert {(r["x"], y): v for r in stripes for y, v in r["stripe"].items()} == {k: v[1] for k, v in got.items()} and len(stripes) == len({x for x, _ in keep})


def test_lines_are_split_once(spark):
    """Counting words and pairs reads the lines once, and no more than one row a slice and word is shuffled."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a b c",)] * 50, "line string").mapInArrow(tell, "line string")
    assert C.pmi_pairs(df).count() == 6 and seen.value == 50
