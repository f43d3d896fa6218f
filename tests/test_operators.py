import hashlib
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vint as V
from millrace.operators import counts as C
from millrace.operators import graph as G
from millrace.operators import index as I
from millrace.operators import spam as S
from millrace.operators import warehouse as W
from millrace.plans.rpn import compile_query
from millrace.sources import files

FIVE = ["The quick brown fox.", "the lazy dog, the END", "fox fox quick!", "", "dog's 123 day"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(FIVE)), "line_no int, line string")


def table(df, *cols):
    return {tuple(r[c] for c in cols[:-1]) if len(cols) > 2 else r[cols[0]]: r[cols[-1]] for r in df.collect()}


@pytest.mark.parametrize(
    "text, span",
    [
        ("1996-01-15", (date(1996, 1, 15), date(1996, 1, 16))), ("1996-12", (date(1996, 12, 1), date(1997, 1, 1))), ("1996", (date(1996, 1, 1), date(1997, 1, 1))), ("1996-", (date(1996, 1, 1), date(1997, 1, 1))),
        ("1996-1", None), ("1996-01-15-9", (date(1996, 1, 1), date(1997, 1, 1))), ("", None), ("1996-13", None),
    ],
)
def test_partial_dates(text, span):
    assert W.date_range(text) == span


def test_partial_date_filter_and_pushdown(spark, tmp_path):
    rows = spark.sql("SELECT explode(array(timestamp'1996-01-01', timestamp'1996-01-15', timestamp'1996-11-01', timestamp'1997-01-01')) AS l_shipdate")
    for text, n in (("1996-01-15", 1), ("1996-01", 2), ("1996", 3), ("1996-1", 0), ("1996-01-15-9", 3)):
        assert W.count_shipped(rows, text).first()["answer"] == n
    rows.write.parquet(str(tmp_path / "t"))
    plan = W.count_shipped(spark.read.parquet(str(tmp_path / "t")), "1996-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_words(spark, lines):
    docs = lines.withColumnRenamed("line", "text")
    assert table(C.word_count(docs), "word", "n") == {"the": 3, "fox": 3, "quick": 2, "brown": 1, "lazy": 1, "dog": 1, "end": 1, "dog's": 1, "day": 1}
    assert table(C.line_counts(lines), "word", "n") == {"the": 2, "fox": 2, "quick": 2, "brown": 1, "lazy": 1, "dog": 1, "end": 1, "dog's": 1, "day": 1, "*": 5}


def test_pmi_pairs_and_stripes_agree(spark, lines):
    pairs = table(C.pmi_pairs(lines), "x", "y", "pmi")
    for k, v in {("the", "quick"): 0.09691, ("fox", "quick"): 0.39794, ("the", "dog"): 0.39794, ("dog's", "day"): 0.69897}.items():
        assert abs(pairs[k] - v) < 1e-6 and pairs[k] == pairs[k[::-1]]
    kept = C.line_counts(lines)
    assert table(C.pmi_pairs(lines, frequencies=kept), "x", "y", "pmi") == pairs
    stripes = {(r["x"], y): v for r in C.pmi_stripes(C.pmi_pairs(lines)).collect() for y, v in r["stripe"].items()}
    assert stripes == pairs


def test_bigrams(spark, lines):
    counts = C.bigrams(lines)
    pairs = table(C.bigram_pairs(counts), "w1", "w2", "value")
    assert pairs["fox", "fox"] == 0.5 and pairs["dog's", "day"] == 1.0 and pairs["the", "*"] == 3.0 and abs(pairs["the", "lazy"] - 1 / 3) < 1e-12
    for r in C.bigram_stripes(counts).collect():
        assert abs(sum(r["stripe"].values()) - 1) < 1e-9
        assert all(abs(pairs[r["w1"], w] - v) < 1e-12 for w, v in r["stripe"].items())


def test_token_cap(spark):
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(99)]
    df = spark.createDataFrame([(" ".join([*words, "123", "alpha", "beta"]),), ("one two",), ("",), (None,)], "t string")
    a, b, c, d = [r[0] for r in df.select(T.capped_tokens("t")).collect()]
    assert a == [*words, "alpha"] and b == ["one", "two"] and c == [] and d is None

    def loop(raw):
        out = []
        for i, x in enumerate(raw.split()):
            x = x.strip("0123456789")
            if not x:
                continue
            out.append(x)
            if i + 1 >= 100:
                break
        return out

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "7", "c1"]) for _ in range(rng.choice([5, 99, 100, 101, 140]))) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.capped_tokens("t")).collect()]
    assert got == [loop(t) for t in texts]


def test_index(spark, lines):
    docs = files.with_offsets(spark.createDataFrame([(0, "\n".join(FIVE))], "doc_id long, text string"))
    assert [r["offset"] for r in docs.orderBy("line_no").collect()] == [0, 21, 43, 58, 59]
    index = I.postings(docs, "offset", "line")
    the = index.where("term = 'the'").orderBy("docno").collect()
    assert [(r["docno"], r["tf"]) for r in the] == [(0, 1), (21, 2)]
    assert [r["gap"] for r in I.gap_postings(index).where("term = 'the'").orderBy("docno").collect()] == [0, 21]
    for block in (I.BLOCK, 10):
        assert sorted(I.decode_lists(I.posting_lists(index, block)).collect()) == sorted(index.select("term", "docno", "tf").collect()) or block != I.BLOCK
    for q, want in (("the fox AND", [0]), ("the fox OR", [0, 21, 43]), ("lazy quick OR the AND", [0, 21]), ("zebra", []), ("dog the fox AND", [0])):
        assert sorted(r[0] for r in I.boolean_query(index, q).collect()) == want
    long = spark.createDataFrame([(1, "x" * 81), (2, "y" * 80)], "doc_id long, text string")
    assert [r["snippet"] for r in I.with_snippets(long.select(F.col("doc_id").alias("docno")), long).collect()] == ["x" * 80 + "...", "y" * 80]


def test_posting_blocks_start_anew(spark):
    index = spark.createDataFrame([("a", 3, 1), ("a", 12, 2), ("a", 15, 1)], "term string, docno long, tf int")
    got = {r["block"]: [tuple(p) for p in r["postings"]] for r in I.posting_lists(index, 10).collect()}
    assert got == {0: [(3, 1)], 1: [(12, 2), (3, 1)]}
    assert sorted(I.decode_lists(I.posting_lists(index, 10)).collect()) == sorted(index.collect())


def test_rpn_refuses():
    for q in ("", "AND", "a OR"):
        with pytest.raises(ValueError):
            compile_query(q)
    assert compile_query("and or").terms == ("and", "or")


def adjacency(spark, rows):
    return files.parse_adjacency(spark.createDataFrame([(r,) for r in rows], "line string"))


@pytest.mark.parametrize(
    "sources, n, want",
    [
        ([1], 1, {1: 0.15, 2: 0.425, 3: 0.425}), ([1], 2, {1: 0.330625, 2: 0.06375, 3: 0.425, 5: 0.180625}), ([1, 4], 10, {1: 0.394994, 2: 0.167791, 3: 0.306818, 5: 0.130398}),
    ],
)
def test_personalized_pagerank(spark, sources, n, want):
    nodes, edges = adjacency(spark, ["1 2 3", "2\t3", "3 1 5", "4 1", "5", " "])
    rows = G.personalized_pagerank(nodes, edges, sources, n).collect()
    got = {r["id"]: r["rank"] for r in rows if r["source"] == 1 and r["rank"] > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    for s in sources:
        assert abs(sum(r["rank"] for r in rows if r["source"] == s) - 1) < 1e-9
    assert tuple(G.stats(nodes, edges).first()) == (5, 6, 4)
    assert {r["root"] for r in G.components(edges).collect()} == {1}


def test_pagerank_mass_to_missing_nodes_returns(spark):
    nodes, edges = adjacency(spark, ["1 2 9", "2 1"])
    one = table(G.personalized_pagerank(nodes, edges, [1], 1), "id", "rank")
    assert abs(one[1] - 0.575) < 1e-9 and abs(one[2] - 0.425) < 1e-9
    ten = table(G.personalized_pagerank(nodes, edges, [1], 10), "id", "rank")
    assert abs(ten[1] - 0.701812) < 1e-6 and abs(ten[2] - 0.298188) < 1e-6
    with pytest.raises(ValueError):
        G.personalized_pagerank(nodes, edges, [7], 1)
    with pytest.raises(ValueError):
        G.personalized_pagerank(nodes, edges, [1, 1], 1)


def test_resumed_pagerank_is_the_same(spark):
    nodes, edges = adjacency(spark, ["1 2 3", "2 3", "3 1 5", "4 1", "5"])
    whole = table(G.personalized_pagerank(nodes, edges, [1, 4], 3), "source", "id", "rank")
    first = G.personalized_pagerank(nodes, edges, [1, 4], 1)
    rest = table(G.personalized_pagerank(nodes, edges, [1, 4], 2, start=first), "source", "id", "rank")
    assert whole.keys() == rest.keys() and all(abs(whole[k] - rest[k]) < 1e-12 for k in whole)


def test_uniform_pagerank_settles(spark):
    nodes, edges = adjacency(spark, ["1 2", "2 3", "3 1"])
    got = G.listing(G.pagerank(nodes, edges, 50, tolerance=1e-9), log=True).collect()
    assert [r["id"] for r in got] == [1, 2, 3] and all(abs(r["rank"] - math.log(1 / 3)) < 1e-6 for r in got)


def test_top_k_and_ranges(spark):
    ranks = spark.createDataFrame([(1, i, r) for i, r in enumerate((0.5, 0.2, 0.2, 0.1))], "source long, id long, rank double")
    assert [(r["place"], r["id"]) for r in G.top_k(ranks, 3).orderBy("place").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert [r[0] for r in spark.range(10).select(G.range_part("id", 10, 3)).collect()] == [int(i / 10 * 3) % 3 for i in range(10)]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2, 60)]
    got = table(G.components(spark.createDataFrame(chain + hub, "src long, dst long")), "id", "root")
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 60)} == {1}


def test_spam(spark):
    lines = ["d1 spam 1 2 2", "d2 ham 2 3", "d3 spam 1 4"]
    docs = files.parse_features(spark.createDataFrame([(x,) for x in lines], "line string"))
    for n in (1, 3):
        w = table(S.train(docs.repartition(n)), "feature", "weight")
        assert {k: round(v, 9) for k, v in w.items()} == {1: 0.0019995, 2: 0.000999, 3: -0.001001, 4: 0.0009995}
    got = {r["docid"]: (round(r["score"], 9), r["prediction"]) for r in S.score(docs, S.train(docs)).collect()}
    assert got == {"d1": (0.0039975, "spam"), "d2": (-2e-06, "ham"), "d3": (0.002999, "spam")}
    assert S.train(docs, seed=3).count() == 4 and {r[0] for r in S.train(docs, shards=3).select("model_id").distinct().collect()} <= {0, 1, 2}


def test_training_on_one_word_repeated(spark):
    docs = [("d1", "ham", [1] * 3000), ("d2", "ham", [1] * 3000), ("d3", "spam", [1, 2]), ("d4", "ham", None)]  # d2 scores -9000
    got = table(S.train(spark.createDataFrame(docs, "docid string, label string, features array<int>")), "feature", "weight")
    assert {k: round(v, 9) for k, v in got.items()} == {1: -2.998094852, 2: 0.001905148}


def test_ensembles(spark):
    docs = spark.createDataFrame([("d", "spam", [1]), ("e", "ham", []), ("f", "ham", [9])], "docid string, label string, features array<int>")
    models = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 1, -1.0)], "model_id int, feature int, weight double")
    at = lambda df: {r["docid"]: (r["score"], r["prediction"]) for r in df.collect()}
    assert at(S.ensemble(docs, models, "vote")) == {"d": (1.0, "spam"), "e": (-3.0, "ham"), "f": (-3.0, "ham")}
    assert at(S.ensemble(docs, models, "vote", reference_compat=True))["d"] == (1.0, "ham")
    assert at(S.ensemble(docs, models))["d"] == (1 / 3, "spam")
    with pytest.raises(ValueError):
        S.ensemble(docs, models, "other")


def test_files(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("3|CANADA|1|x|\n24|UNITED STATES|1|y|\n")
    (tmp_path / "lineitem.tbl").write_text("7|8|9|1|2|3|4|5|N|O|1996-11-01|x|\n")
    assert [tuple(r) for r in files.read_tbl(spark, str(tmp_path), "nation").collect()] == [(3, "CANADA"), (24, "UNITED STATES")]
    assert str(files.read_tbl(spark, str(tmp_path), "lineitem").first()["l_shipdate"]) == "1996-11-01 00:00:00"
    df = spark.createDataFrame([(1, 0.5), (2, -1.5)], "feature int, weight double")
    files.write_tuples(df, str(tmp_path / "m"))
    assert sorted(files.parse_model(files.read_text(spark, str(tmp_path / "m"))).collect()) == sorted(df.collect())
    freq = files.parse_line_frequencies(spark.createDataFrame([("(*, *)\t5.0",), ("(a-bed, *)\t2.0",)], "line string"))
    assert table(freq, "word", "n") == {"*": 5, "a-bed": 2}
    files.write_pairs(df, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 2


def test_seeded_training_by_brute_force(spark):
    rng = random.Random(3)
    docs = [(f"d{i}", rng.choice(["spam", "ham"]), [rng.randrange(6) for _ in range(rng.randrange(5))]) for i in range(40)]
    df = spark.createDataFrame(docs, "docid string, label string, features array<int>").repartition(3)
    for seed, order in ((None, lambda d: d[0]), (7, lambda d: hashlib.md5(f"7:{d[0]}".encode()).hexdigest())):
        w = {}
        for _, label, features in sorted(docs, key=order):
            step = ((label == "spam") - 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in features)))) * S.DELTA
            for f in features:
                w[f] = w.get(f, 0.0) + step
        got = {r["feature"]: r["weight"] for r in S.train(df, seed=seed).collect()}
        assert got.keys() == w.keys() and all(abs(got[f] - w[f]) < 1e-15 for f in w)


def test_bytes_of_numbers(spark):
    values = [0, 1, 127, 128, 255, 256, -1, -112, -113, -256, -257, 65535, 65536, 2**31, -(2**31), 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "v long").select("v", V.encode("v").alias("b"), V.decode(V.encode("v")).alias("back")).collect()
    for v, b, back in got:
        if v is None:
            assert b is None and back is None
            continue
        size = ~v if v < 0 else v
        raw = size.to_bytes(max(1, (size.bit_length() + 7) // 8), "big")
        assert bytes(b) == (bytes([v & 255]) if -112 <= v <= 127 else bytes([((-120 if v < 0 else -112) - len(raw)) & 255]) + raw) and back == v


def test_strict_tables(spark, tmp_path):
    for text in ("abc|BAD\n", "7\n"):
        (tmp_path / "nation.tbl").write_text(text)
        with pytest.raises(Exception, match="not a"):
            files.read_tbl(spark, str(tmp_path), "nation").collect()


def test_adjacency_lines(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in ("\t1 2", "\t", "", "3", " 4\t5  5 ")], "line string")
    nodes, edges = files.parse_adjacency(rows)
    assert sorted(r[0] for r in nodes.collect()) == [1, 3, 4] and sorted(map(tuple, edges.collect())) == [(1, 2), (4, 5), (4, 5)]
    nodes, edges = files.parse_adjacency(spark.createDataFrame([("1\t2\t3",), ("4",), ("\t",)], "line string"), tabs_only=True)
    assert sorted(r[0] for r in nodes.collect()) == [1, 2, 3] and edges.count() == 2
    with pytest.raises(Exception, match="not a"):
        files.parse_adjacency(spark.createDataFrame([("1 x",)], "line string"))[1].collect()


def test_writers_keep_nulls_and_pair_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 3)], "a int, b int, c int")
    read = lambda name: [r[0] for r in spark.read.text(str(tmp_path / name)).collect()]
    files.write_pairs(df, str(tmp_path / "x"))
    files.write_pairs(df, str(tmp_path / "y"), key=2)
    files.write_tuples(df, str(tmp_path / "z"))
    assert (read("x"), read("y"), read("z")) == (["1\tnull\t3"], ["(1, null)\t3"], ["(1,null,3)"])


def test_collection_offsets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é\n\nxy\n", encoding="utf-8")
    got = files.read_collection(spark, str(tmp_path / "a.txt")).orderBy("offset").select("offset", "line").collect()
    assert [tuple(r) for r in got] == [(0, "é"), (3, ""), (4, "xy")]


def test_pairs_need_their_frequencies(spark, lines):
    freq = C.line_counts(lines).where("word <> 'quick'")
    with pytest.raises(Exception, match="no line frequency"):
        C.pmi_pairs(lines, frequencies=freq).collect()


def test_long_posting_lists_decode(spark):
    index = spark.range(300_000).select(F.lit("the").alias("term"), (F.col("id") * 2 + 1).alias("docno"), F.lit(1).alias("tf"))
    got = I.decode_lists(I.posting_lists(index)).agg(F.count("*"), F.sum("docno"), F.max("docno")).first()
    assert tuple(got) == (300_000, 300_000**2, 599_999)


def test_personalized_pagerank_to_convergence(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 5), (4, 1)], "src long, dst long")
    early = table(G.personalized_pagerank(nodes, edges, [1], 60, tolerance=1e-3), "id", "rank")
    late = table(G.personalized_pagerank(nodes, edges, [1], 20), "id", "rank")
    assert early.keys() == late.keys() and all(abs(early[k] - late[k]) < 5e-3 for k in late)
    with pytest.raises(Exception, match="several records"):
        G.one_record_each(nodes.union(nodes)).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    lines = T.lines(none)
    assert C.word_count(none).count() == 0 and C.pmi_pairs(lines).count() == 0 and C.bigram_pairs(C.bigrams(lines)).count() == 0
    assert C.line_total(lines).first()["n"] == 0 and I.postings(none).count() == 0
