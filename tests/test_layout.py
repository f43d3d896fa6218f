"""The graph's layout on storage: what a round's plan moves, resumed runs, hubs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import layout as L
from millrace.plans.lineage import committed, remove, settings


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(50)) for _ in range(300)] + [(3, i) for i in range(45)]
    return spark.createDataFrame([(i,) for i in range(45)], "id long"), spark.createDataFrame(edges, "src long, dst long"), edges


def brute(edges, source, rounds, alpha=G.ALPHA):
    deg = {s: sum(a == s for a, _ in edges) for s in range(45)}
    rank = {source: 1.0}
    for _ in range(rounds):
        came = {}
        for a, b in edges:
            if a in rank and b < 45:
                came[b] = came.get(b, 0.0) + rank[a] / deg[a]
        rank = {k: (1 - alpha) * v for k, v in came.items()}
        rank[source] = rank.get(source, 0.0) + alpha + (1 - alpha) * (1 - sum(came.values()))
    return rank


def ranks(df, source):
    return {r["id"]: r["rank"] for r in df.collect() if r["source"] == source}


def close(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in b)


def test_against_brute_force(graph):
    nodes, edges, raw = graph
    got = G.personalized_pagerank(nodes, edges, [3, 7], 4, buckets=3)
    assert close(ranks(got, 3), brute(raw, 3, 4)) and close(ranks(got, 7), brute(raw, 7, 4))


def test_a_round_moves_no_edges(spark, graph, tmp_path):
    nodes, edges, _ = graph
    at = L.store(nodes, edges, str(tmp_path / "g"), buckets=4)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        rounds = G.personalized_rounds(at, [3], durable=False)
        facts = [next(rounds) for _ in range(2)][-1]
        with settings(spark, at.settings()):
            plan = L.step(at, G._ranks_of(at, facts), ["m0"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange", plan)) == 1 and "hashpartitioning(id" in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") >= 3
    sorts = re.findall(r"Sort \[(\w+)#", plan)
    assert sorts == ["id"]  # of the sums that arrive, by which they meet the nodes
    at.close(delete=True)
    assert not L.stored(spark, str(tmp_path / "g"))


def test_every_bucket_is_one_file(spark, graph, tmp_path):
    nodes, edges, _ = graph
    at = L.store(nodes, edges, str(tmp_path / "g"), buckets=3)
    assert (at.n_nodes, at.n_edges, at.n_active) == (45, 345, len({r[0] for r in edges.select("src").distinct().collect()}))
    files = spark.read.parquet(str(tmp_path / "g" / "edges")).select(F.input_file_name().alias("f"), "src").distinct()
    assert files.groupBy("src").count().agg(F.max("count")).first()[0] == 1
    assert {len(re.findall(r"_\d{5}\.c", r[0])) for r in files.select("f").distinct().collect()} == {1} and files.select("f").distinct().count() <= 3
    at.close()


def test_a_run_that_broke_off_goes_on(spark, graph, tmp_path, monkeypatch):
    nodes, edges, _ = graph
    path = str(tmp_path / "g")
    whole = G.personalized_pagerank(nodes, edges, [3, 7], 4)
    real, calls = L.Layout.write, []

    def breaks(self, df, name, key):
        calls.append(name)
        if name == "state-2" and calls.count(name) == 1:
            df.write.parquet(f"{self.path}/{name}")  # a state that was never committed
            raise RuntimeError("driver lost")
        return real(self, df, name, key)

    monkeypatch.setattr(L.Layout, "write", breaks)
    with pytest.raises(RuntimeError):
        G.personalized_pagerank(nodes, edges, [3, 7], 4, path=path)
    assert committed(spark, f"{path}/round-1")["round"] == 1 and committed(spark, f"{path}/round-2") is None
    none = spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")
    got = G.personalized_pagerank(*none, [3, 7], 4, path=path)  # the layout is there: nodes and edges aren't read again
    assert calls == ["state-0", "state-1", "state-2", "state-2", "state-3"]
    assert all(close(ranks(got, s), ranks(whole, s)) for s in (3, 7))
    with pytest.raises(ValueError, match="other sources"):
        G.personalized_pagerank(nodes, edges, [3], 5, path=path)
    remove(spark, path)


def test_uniform_runs_resume(spark, graph, tmp_path):
    nodes, edges, _ = graph
    path = str(tmp_path / "g")
    table = lambda df: {r["id"]: r["rank"] for r in df.collect()}
    G.pagerank(nodes, edges, 2, path=path)
    assert close(table(G.pagerank(nodes, edges, 4, path=path)), table(G.pagerank(nodes, edges, 4)))
    assert abs(sum(table(G.pagerank(nodes, edges, 4)).values()) - 1) < 1e-12
    with pytest.raises(ValueError, match="other sources"):
        G.personalized_pagerank(nodes, edges, [3], 3, path=path)


def test_hubs_lie_apart(spark, graph, tmp_path, monkeypatch):
    nodes, edges, raw = graph
    monkeypatch.setattr(L, "HUB", 20)
    at = L.store(nodes, edges, str(tmp_path / "g"), hub=20)
    assert at.n_hub_edges == sum(a == 3 for a, _ in raw) and at.edges.where("src = 3").count() == 0
    at.close()
    got = G.personalized_pagerank(nodes, edges, [3, 7], 3, path=str(tmp_path / "g"))
    assert close(ranks(got, 3), brute(raw, 3, 3)) and close(ranks(got, 7), brute(raw, 7, 3))


def test_counters_of_a_round(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 9), (3, 8), (3, 1)], "src long, dst long")
    assert tuple(G.message_stats(nodes, edges).first()) == (5, 2, 2)


def test_no_tables_are_left(spark, graph):
    nodes, edges, _ = graph
    G.personalized_pagerank(nodes, edges, [3], 2)
    G.pagerank(nodes, edges, 2)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("millrace_")]


def test_empty_graphs(spark):
    nodes, edges = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in G.personalized_pagerank(nodes, edges, [1], 2).collect()] == [(1, 1, 1.0)]
    assert [tuple(r) for r in G.pagerank(nodes, edges, 2).collect()] == [(1, 1.0)]
    assert G.pagerank(nodes.limit(0), edges, 2).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    raw = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(30)]
    root = {v: v for e in raw for v in e}
    for _ in range(300):
        for a, b in raw:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in G.components(spark.createDataFrame(raw, "src long, dst long")).collect()}
    assert got == root


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from millrace.plans.lineage import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="names no folder"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_push_equals_the_power_iteration(graph):
    nodes, edges, raw = graph
    told = []
    got = G.personalized_push(nodes, edges, [3, 7], alpha=0.5, tolerance=1e-9, buckets=2, told=told)
    for s in (3, 7):
        want = brute(raw, s, 80, alpha=0.5)
        mine = ranks(got, s)
        assert sum(abs(mine.get(k, 0.0) - want.get(k, 0.0)) for k in mine.keys() | want.keys()) <= 1e-9
        assert abs(sum(mine.values()) - 1) < 1e-12
    assert told[0]["frontier"] == 2 and told[-1]["frontier"] == 0
    degree = {v: sum(a == v for a, _ in raw) for v in range(45)}
    assert told[1]["messages"] <= degree[3] + degree[7]  # the two sources' edges and no others


def test_push_reads_only_the_frontiers_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100 + i, 200) for i in range(300)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 400)]], "id long")
    told = []
    got = ranks(G.personalized_push(nodes, edges, [40], told=told, buckets=2), 40)
    assert [f["frontier"] for f in told] == [1] * 21 + [0] and [f["messages"] for f in told] == [0] + [1] * 20 + [0]
    assert set(got) == set(range(40, 61)) and abs(got[41] / got[40] - (1 - G.ALPHA)) < 1e-12


def test_logarithms_and_printed_rows(spark):
    import math

    from millrace.functions.numbers import log_add, logistic
    from millrace.functions.printed import printed, printed_groups

    rows = spark.createDataFrame([(-800.0, -801.0), (None, -1.0), (-2.0, None), (None, None), (0.0, 0.0)], "a double, b double").select(log_add("a", "b").alias("x"), logistic("a").alias("p")).collect()
    assert abs(rows[0]["x"] - (-800 + math.log1p(math.exp(-1)))) < 1e-12 and (rows[1]["x"], rows[2]["x"], rows[3]["x"]) == (-1.0, -2.0, None)
    assert abs(rows[4]["x"] - math.log(2)) < 1e-12 and rows[4]["p"] == 0.5
    df = spark.createDataFrame([(24, "b", 1), (3, "c", 2), (3, "a", None), (9, "z", 9)], "k int, m string, n int")
    assert [tuple(r) for r in printed(df, ["m", "n"], ["m"]).orderBy("place").collect()] == [(1, "(a,null)"), (2, "(b,1)"), (3, "(c,2)"), (4, "(z,9)")]
    assert [r["line"] for r in printed_groups(df, "k", {3: "CANADA", 24: "USA"}, ["m", "n"], ["m"]).orderBy("place").collect()] == ["CANADA", "(a,null)", "(c,2)", "USA", "(b,1)"]


@pytest.mark.parametrize("at_once", [20])
def test_components_by_rounds_of_contraction(spark, monkeypatch, at_once):
    monkeypatch.setattr(G, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    raw = [(i, i + 1) for i in range(100, 160)] + [(i, 900) for i in range(200, 260)] + [(7, 7), (5, None)] + [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(70)] + [(i, i + 7) for i in range(1000, 1100)]
    rng.shuffle(raw)
    root = {x: x for e in raw if None not in e for x in e}
    while any(root[x] != root[y] for x, y in raw if y is not None):
        for x, y in raw:
            if y is not None:
                root[x] = root[y] = min(root[x], root[y])
    got = G.components(spark.createDataFrame(raw, "src long, dst long").repartition(3)).collect()
    assert {r["id"]: r["root"] for r in got} == root and len(got) == len(root)


def test_few_links_are_united_in_few_shuffles(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None).size()
    edges, before = spark.range(0, 300, 1, 3).selectExpr("id AS src", "id + 1 AS dst"), stages()
    assert G.components(edges).agg(F.max("root"), F.count("*")).first()[:] == (0, 301)
    assert stages() - before < 12


def test_kept_edges_are_not_written_again(spark, tmp_path, monkeypatch):
    """Edges that lie in storage are laid out from there; ids that stand twice, that are null or that no edge names keep their degrees."""
    nodes = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,)], "id long")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (None, 2)], "src long, dst long")
    edges.write.parquet(str(tmp_path / "edges"))
    monkeypatch.setattr(L, "cut", lambda df: pytest.fail("written again"))
    at = L.store(nodes, spark.read.parquet(str(tmp_path / "edges")), str(tmp_path / "graph"), kept=True)
    try:
        assert sorted(map(tuple, at.nodes.collect()), key=str) == [(1, 2), (2, 1), (4, 0), (None, 0)]
        assert (at.n_nodes, at.n_active, at.n_edges) == (4, 2, 5)
    finally:
        at.close(delete=True)
    at = L.store(None, spark.read.parquet(str(tmp_path / "edges")), str(tmp_path / "named"), kept=True)
    try:
        assert sorted(map(tuple, at.nodes.collect()), key=str) == [(1, 2), (2, 1), (3, 1), (None, 0)]
    finally:
        at.close(delete=True)
