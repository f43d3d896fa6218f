import math
from collections import Counter
from itertools import permutations

from millrace.operators import counts as C
from millrace import registry

LINES = ["the quick brown fox the", "the lazy dog", "", "fox fox quick", "a dog and the fox"]


def test_pairs_and_stripes_run_over_documents(spark, tmp_path):
    """All lines of all documents; pairs in fewer than MIN_COUNT lines are left out."""
    docs = [(1, "\n".join(LINES)), (2, "the fox\nlazy dog"), (3, None), (4, "\n".join(["the fox"] * 7 + ["a lazy dog"] * 9))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = [set(x.split()) for _, t in docs if t is not None for x in t.split("\n")]
    n = Counter(w for s in sets for w in s)
    pair = {p: c for p, c in Counter(p for s in sets for p in permutations(s, 2)).items() if c >= registry.MIN_COUNT}
    assert pair
    pmi = {(x, y): round(math.log10(c * len(sets) / (n[x] * n[y])), 6) for (x, y), c in pair.items()}
    got = {name: registry.QUERIES[name](spark, str(tmp_path)).collect() for name in ("line_counts", "cooccurrence_pairs", "pmi_pairs", "pmi_stripes")}
    assert {r["word"]: r["n"] for r in got["line_counts"]} == {**n, "*": len(sets)}
    assert {(r["x"], r["y"]): r["n"] for r in got["cooccurrence_pairs"]} == {p: c for p, c in pair.items() if p[0] < p[1]}
    assert {(r["x"], r["y"]): (r["n"], round(r["pmi"], 6)) for r in got["pmi_pairs"]} == {p: (c, pmi[p]) for p, c in pair.items()}
    for r in got["pmi_stripes"]:
        mine = {y: v for (x, y), v in pmi.items() if x == r["x"]}
        assert (r["size"], r["words"].split(), r["highest"], r["lowest"]) == (len(mine), sorted(mine), max(mine.values()), min(mine.values()))
    assert {r["x"] for r in got["pmi_stripes"]} == {x for x, _ in pair}


def test_bigrams_are_counted_once(spark):
    """Rows of lines are read once, whatever reads their bigrams."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = spark.createDataFrame([("a b c a b",), ("b a",), ("",)], "line string").mapInArrow(tell, "line string")
    got = {(r["w1"], r["w2"]): r["value"] for r in C.bigram_pairs(C.bigrams(lines)).collect()}
    assert got == {("a", "b"): 1.0, ("b", "c"): 0.5, ("b", "a"): 0.5, ("c", "a"): 1.0, ("a", "*"): 2.0, ("b", "*"): 2.0, ("c", "*"): 1.0}
    assert seen.value == 3
