"""Graphs as tables: nodes(id), edges(src, dst). Ranks are kept for nodes that have any, as (source, id, rank).

Iterations run over a layout on storage (``layout``): edges lie bucketed and sorted by source and stay there; a round reads them beside the
ranks, which lie alike, and shuffles only the sums that arrive at each node, combined in every task before. What a round loses and how many
messages it sends is counted while its rows are written, and told to the next round as a number; no further job is run for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import layout as L
from millrace.plans.lineage import commit, cut, fresh_path, settings

ALPHA = 0.15
SALTS = 8
#: Links that a task unites at once.
AT_ONCE = 1 << 20


def with_degree(edges: DataFrame) -> DataFrame:
    """(src, dst, deg): every edge with its source's out-degree; parallel edges count each."""
    return edges.join(edges.groupBy("src").agg(F.count("*").alias("deg")), "src")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_active (nodes with an out-edge)."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_active"))
    return n.crossJoin(e)  # one row each


def message_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on the messages of an iteration in which every node has rank: mass_messages (one an edge), mass_messages_received
    (nodes some arrive at), missing_structure (destinations without a record, whose mass is lost and returns to the sources).
    They are counted by a round of ``pagerank`` as it runs."""
    at = L.store(nodes, edges, fresh_path(nodes.sparkSession, "graph"))
    try:
        facts = next(_uniform(at, ALPHA, None))
    finally:
        at.close(delete=True)
    names = ("mass_messages", "mass_messages_received", "missing_structure")
    return nodes.sparkSession.createDataFrame([tuple(facts[k] for k in names)], ", ".join(f"{k} long" for k in names))


def one_record_each(nodes: DataFrame) -> DataFrame:
    """``nodes``, checked while they are read: an id with several records fails the query."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("several records of node "), F.col("id").cast("string"))).cast("long")).alias("id"))


def _sources(nodes: DataFrame, sources: list[int]) -> DataFrame:
    if len(set(sources)) != len(sources):
        raise ValueError("sources must be distinct")
    found = {r["id"] for r in nodes.where(F.col("id").isin(*sources)).select("id").distinct().collect()}  # at most one row a source
    if missing := sorted(set(sources) - found):
        raise ValueError(f"no such node: {missing}")
    return nodes.sparkSession.createDataFrame([(s,) for s in sources], "source long")


def initial_ranks(nodes: DataFrame, sources: list[int]) -> DataFrame:
    """(source, id, rank) of every node: 1 at the source itself, else 0."""
    of = _sources(nodes, sources)
    return nodes.crossJoin(F.broadcast(of)).select("source", "id", F.when(F.col("id") == F.col("source"), 1.0).otherwise(0.0).alias("rank"))  # times the number of sources named


def _round(at: L.Layout, number: int, came: DataFrame, columns: list[str], facts: dict, durable: bool) -> dict:
    """Write a round's state, count it meanwhile, and commit it if it is to outlive the run; returns the facts of the round."""
    held = came.select("id", "deg", *columns, "n")
    seen = Observation()
    counted = held.observe(seen, *[c.alias(k) for k, c in L.counters(columns).items()]).where("deg IS NOT NULL").select("id", "deg", *columns)
    at.write(counted, f"state-{number}", "id")
    got = facts | {"round": number, "schema": at.schemas[f"state-{number}"]} | {k: v or 0 for k, v in seen.get.items()}
    if durable:
        commit(at.spark, f"{at.path}/round-{number}", got)
    return got


def _state(at: L.Layout, facts: dict) -> DataFrame:
    name = facts.get("name") or f"state-{facts['round']}"
    at.schemas[name] = facts["schema"]
    return at.read(name)


def _columns(sources: list[int]) -> list[str]:
    return [f"m{i}" for i in range(len(sources))]


def _ranks_of(at: L.Layout, facts: dict) -> DataFrame:
    """(id, deg, m0, m1, ..): ranks by source, out of what arrived: ``alpha`` and all that was lost is added at the source itself."""
    alpha = facts["alpha"]
    if facts["round"] < 0:
        return _state(at, facts)
    return _state(at, facts).select("id", "deg", *[((1 - alpha) * F.col(c) + F.when(F.col("id") == s, alpha + (1 - alpha) * max(0.0, 1 - facts[f"mass_{c}"])).otherwise(0.0)).alias(c) for c, s in zip(_columns(facts["sources"]), facts["sources"], strict=True)])


def _long(ranks: DataFrame, sources: list[int]) -> DataFrame:
    """(source, id, rank) of (id, m0, m1, ..), where there is any rank."""
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("source"), F.col(c).alias("rank")) for s, c in zip(sources, _columns(sources), strict=True)])).alias("e")
    return ranks.select("id", each).select("e.source", "id", "e.rank").where("rank > 0")


def personalized_rounds(at: L.Layout, sources: list[int], alpha: float = ALPHA, start: DataFrame | None = None, done: dict | None = None, durable: bool = True) -> Iterator[dict]:
    """The facts of one round after the other, without end: state's schema, mass that arrived for each source, counters.
    ``done``: the facts of the round to go on from."""
    spark, columns = at.spark, _columns(sources)
    zeros = spark.createDataFrame([(s, *([0.0] * len(columns))) for s in sources], ", ".join(["id long", *[f"{c} double" for c in columns]]))
    facts = done or {"round": -1, "sources": list(sources), "alpha": alpha}
    while True:
        if facts["round"] >= 0:
            ranks = _ranks_of(at, facts)
        else:
            first = spark.createDataFrame([(s, *[float(s == t) for t in sources]) for s in sources], zeros.schema) if start is None else start.groupBy("id").agg(*[F.sum(F.when(F.col("source") == s, F.col("rank")).otherwise(0.0)).alias(c) for s, c in zip(sources, columns, strict=True)])
            ranks = first.join(at.nodes, "id").select("id", "deg", *columns)
        with settings(spark, at.settings()):
            came = L.step(at, ranks, columns, also=zeros)
            facts = _round(at, facts["round"] + 1, came, columns, {"sources": list(sources), "alpha": alpha}, durable)
        yield facts


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, sources: list[int], iterations: int, alpha: float = ALPHA, start: DataFrame | None = None, tolerance: float | None = None, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """(source, id, rank) of nodes with any rank after a number of iterations, for all sources at once; fewer, if no source's
    ranks change by more than ``tolerance`` in all.

    A node hands its rank to its out-edges in equal parts. What doesn't arrive, from nodes without out-edges or at
    nodes without a record, returns to the source, which also gets ``alpha``. start: ranks to begin from.

    path: where layout and rounds are kept. A run that broke off goes on after its last committed round, and one that is to have more rounds
    than are there adds those; sources and alpha must be those of the rounds that are there. Without it all of it goes once the ranks are written.
    """
    spark = nodes.sparkSession
    keep = path is not None
    path = path or fresh_path(spark, "graph")
    at = L.open_layout(spark, path) if L.stored(spark, path) else L.store(nodes, edges, path, buckets)
    try:
        _sources(at.nodes, sources)
        done = L.last_round(at)
        if done and (done["sources"] != list(sources) or done["alpha"] != alpha):
            raise ValueError(f"{path} holds rounds of other sources or another alpha")
        facts, before = done or {"round": -1, "sources": list(sources), "alpha": alpha}, None
        rounds = personalized_rounds(at, sources, alpha, start, done, keep)
        while facts["round"] + 1 < iterations:
            before, facts = facts, next(rounds)
            if tolerance is not None and before["round"] >= 0 and _largest_change(_long(_ranks_of(at, before), sources), _long(_ranks_of(at, facts), sources)) <= tolerance:
                break
            if not keep and before["round"] >= 0:
                at.forget(f"state-{before['round']}", delete=True)
        if facts["round"] < 0:
            return start if start is not None else spark.createDataFrame([(s, s, 1.0) for s in sources], "source long, id long, rank double")
        return cut(_long(_ranks_of(at, facts), sources))
    finally:
        at.close(delete=not keep)


def push_rounds(at: L.Layout, sources: list[int], alpha: float, least: float) -> Iterator[dict]:
    """The facts of one round of residual push after the other: round, the state's schema, ``frontier`` (nodes that push next), ``messages``.

    A node's residual is weight that has come to it and that it hasn't handed on. Each round the nodes with more than ``least`` hand on
    1 - alpha of theirs; what they held stays on record in the state it was read from. The others wait. Only the frontier's edges are read
    into the round, and only what the frontier sends is shuffled; those who wait lie in the buckets that the sums come to.
    """
    spark, columns = at.spark, _columns(sources)
    large = F.greatest(F.lit(0.0), *map(F.col, columns)) > least
    facts = None
    while True:
        with settings(spark, at.settings()):
            if facts is None:
                first = spark.createDataFrame([(s, *[float(s == t) for t in sources], 0) for s in sources], ", ".join(["id long", *[f"{c} double" for c in columns], "n long"]))
                came = first.join(at.nodes, "id").select("id", "deg", *columns, "n")
            else:
                before = _state(at, facts)
                push = before.where(large).select("id", "deg", *[F.when(F.col(c) > least, (1 - alpha) * F.col(c)).otherwise(0.0).alias(c) for c in columns])
                sent = L.step(at, push, columns).where("deg IS NOT NULL")
                wait = before.select("id", F.col("deg").alias("d"), *[F.when(F.col(c) > least, 0.0).otherwise(F.col(c)).alias(f"w_{c}") for c in columns]).where(F.greatest(F.lit(0.0), *[F.col(f"w_{c}") for c in columns]) > 0)
                came = sent.join(wait, "id", "full").select("id", F.coalesce("deg", "d").alias("deg"), *[(F.coalesce(c, F.lit(0.0)) + F.coalesce(f"w_{c}", F.lit(0.0))).alias(c) for c in columns], F.coalesce("n", F.lit(0)).alias("n"))
            seen, number = Observation(), 0 if facts is None else facts["round"] + 1
            held = came.observe(seen, F.count(F.when(large, 1)).alias("frontier"), F.sum("n").alias("messages")).select("id", "deg", *columns)
            at.write(held, f"push-{number}", "id")
        facts = {"round": number, "schema": at.schemas[f"push-{number}"], "name": f"push-{number}"} | {k: v or 0 for k, v in seen.get.items()}
        yield facts


def personalized_push(nodes: DataFrame, edges: DataFrame, sources: list[int], alpha: float = ALPHA, tolerance: float = 1e-9, buckets: int | None = None, told: list | None = None) -> DataFrame:
    """(source, id, rank): what ``personalized_pagerank`` converges to, within ``tolerance`` summed over a source's nodes, by residual push.

    Weight that gets lost needn't be sent back to its source: returned or not, all of it has begun at the source, so ranks are only out by one
    factor, and they sum to 1. A residual that waits is worth 1 / alpha of itself at most; with n nodes, none above alpha * tolerance / (2 n)
    leaves an error below the tolerance. told: gets the facts of every round.
    """
    spark = nodes.sparkSession
    at = L.store(nodes, edges, fresh_path(spark, "graph"), buckets)
    try:
        _sources(at.nodes, sources)
        columns, least = _columns(sources), alpha * tolerance / (2 * max(at.n_nodes, 1))
        states = []
        for facts in push_rounds(at, sources, alpha, least):
            states.append(_state(at, facts))
            if told is not None:
                told.append(facts)
            if not facts["frontier"]:
                break
        kept = [F.when(F.col(c) > least, F.col(c)).otherwise(0.0).alias(c) for c in columns]
        every = reduce(DataFrame.unionByName, [s.select("id", *kept) for s in states])
        weight = cut(every.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]))
        whole = weight.agg(*[F.sum(c).alias(c) for c in columns]).first()
        return cut(_long(weight.select("id", *[(F.col(c) / F.lit(whole[c] or 1.0)).alias(c) for c in columns]), sources))
    finally:
        at.close(delete=True)


def _largest_change(old: DataFrame, new: DataFrame) -> float:
    """Of the sources, the largest sum of absolute differences of rank."""
    both = old.select("source", "id", F.col("rank").alias("d")).unionByName(new.select("source", "id", (-F.col("rank")).alias("d")))
    each = both.groupBy("source", "id").agg(F.abs(F.sum("d")).alias("d")).groupBy("source").agg(F.sum("d").alias("d"))
    return each.agg(F.max("d")).first()[0] or 0.0


def _uniform(at: L.Layout, alpha: float, done: dict | None, durable: bool = False) -> Iterator[dict]:
    """As personalized_rounds, with a uniform jump."""
    facts = done
    while True:
        ranks = at.nodes.withColumn("m0", F.lit(1.0 / max(at.n_nodes, 1))) if facts is None else _uniform_ranks(at, facts)
        with settings(at.spark, at.settings()):
            came = L.step(at, ranks, ["m0"], keep_all=True)
            facts = _round(at, 0 if facts is None else facts["round"] + 1, came, ["m0"], {"alpha": alpha, "sources": None}, durable)
        yield facts


def _uniform_ranks(at: L.Layout, facts: dict) -> DataFrame:
    n, alpha = max(at.n_nodes, 1), facts["alpha"]
    return _state(at, facts).select("id", "deg", (alpha / n + (1 - alpha) * (F.col("m0") + max(0.0, 1 - facts["mass_m0"]) / n)).alias("m0"))


def pagerank(nodes: DataFrame | None, edges: DataFrame, iterations: int = 20, alpha: float = ALPHA, tolerance: float | None = None, path: str | None = None, buckets: int | None = None, kept: bool = False) -> DataFrame:
    """(id, rank) with a uniform jump; rank of nodes without out-edges is spread evenly. Stops early once the ranks' total change is
    at most ``tolerance``, if given. path: as for personalized_pagerank; nodes None, kept: as for ``layout.store``."""
    spark = edges.sparkSession
    keep = path is not None
    path = path or fresh_path(spark, "graph")
    at = L.open_layout(spark, path) if L.stored(spark, path) else L.store(nodes, edges, path, buckets, kept=kept)
    try:
        facts = L.last_round(at)
        if facts and (facts["sources"] is not None or facts["alpha"] != alpha):
            raise ValueError(f"{path} holds rounds of another kind")
        rounds = _uniform(at, alpha, facts, keep)
        while (facts["round"] if facts else -1) + 1 < iterations:
            before, facts = facts, next(rounds)
            if before and tolerance is not None:
                old = _uniform_ranks(at, before).select("id", F.col("m0").alias("old"))
                if (_uniform_ranks(at, facts).join(old, "id").agg(F.sum(F.abs(F.col("m0") - F.col("old")))).first()[0] or 0.0) <= tolerance:
                    break
            if before and not keep:
                at.forget(f"state-{before['round']}", delete=True)
        if facts is None:
            return cut(at.nodes.select("id", F.lit(1.0 / max(at.n_nodes, 1)).alias("rank")))
        return cut(_uniform_ranks(at, facts).select("id", F.col("m0").alias("rank")))
    finally:
        at.close(delete=not keep)


def listing(ranks: DataFrame, log: bool = False) -> DataFrame:
    """All ranks in descending order, or their natural logarithms."""
    value: Column = F.log("rank") if log else F.col("rank")
    return ranks.orderBy(F.desc("rank"), "id").withColumn("rank", value)


def top_k(ranks: DataFrame, k: int = 100) -> DataFrame:
    """(source, place, id, rank): the k highest of each source, ties to the smaller id. Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy("source").orderBy(F.desc("rank"), "id")
    return ranks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("source", "place", "id", "rank")


def top_k_lines(top: DataFrame) -> DataFrame:
    """(source, place, line) of top_k in print order: 'Source:', tab, id; then rank to five places, tab, id; then a blank line."""
    rows = top.select("source", "place", F.concat(F.format_string("%.5f", F.col("rank")), F.lit("\t"), F.col("id").cast("string")).alias("line"))
    head = top.groupBy("source").agg(F.max("place").alias("n"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("Source:\t"), F.col("source").cast("string")).alias("line")), F.struct((F.col("n") + 1).alias("place"), F.lit("").alias("line")))).alias("e")
    return rows.unionByName(head.select("source", ends).select("source", "e.place", "e.line")).orderBy("source", "place")


def range_part(column: str, n_nodes: int, parts: int) -> Column:
    """The block of consecutive ids that an id falls in, of ``parts``."""
    return F.pmod(F.floor(F.col(column) / F.lit(float(n_nodes)) * parts), F.lit(parts)).cast("int")


def partitioned(nodes: DataFrame, parts: int) -> DataFrame:
    """Nodes laid out by ranges of ids."""
    return nodes.repartitionByRange(parts, "id")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links beside which the given ones say nothing more: each vertex with its component's smallest, a vertex on its own with itself."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(names))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        for at in (root[x], root[y], x, y):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(names))
    own |= ~own & (np.bincount(root, minlength=len(names)) == 1)
    return names[own], names[root[own]]


def spanning(links: DataFrame) -> DataFrame:
    """(a, b), b <= a: in place of every AT_ONCE links (a, b) of a task, the fewest that keep the same vertices together."""
    most = AT_ONCE

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            a, b = _stars(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()

    return links.mapInArrow(go, "a long, b long")


def _replaced(rows: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its root in ``label`` (id, root), where it has one. However many rows name one id: they are dealt over SALTS keys."""
    wanted = rows.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("_n"))  # summed before it is shuffled, which a semi-join would undo
    to = label.join(wanted, "id").select(F.col("id").alias(column), F.col("root").alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    others = [c for c in rows.columns if c != column]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    return salted.join(to, [column, "_salt"], "left").select(*others, F.coalesce("_to", column).alias(column))


def components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex of ``edges``, direction ignored: root is the smallest id of its component.

    A round makes the graph smaller: each vertex goes with its smallest neighbour, and with that one's, up to a vertex that has no smaller one; the links
    are then drawn between those, and each task leaves out the links that its others imply. At last the names of all rounds are looked up in turn.
    Once AT_ONCE links or fewer are left, one task unites them. A hub of any degree is summed before it is shuffled.
    """
    links = cut(spanning(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")))
    names = []
    for _ in range(rounds):
        if links.limit(AT_ONCE + 1).count() <= AT_ONCE:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        for _ in range(rounds):
            far = cut(_replaced(label.withColumn("old", F.col("root")), "root", label))
            settled = not far.where("old <> root").limit(1).count()
            label = far.select("id", "root")
            if settled:
                break
        names.append(label)
        drawn = links.join(label, links["a"] == label["id"]).select(F.col("root").alias("a"), "b")
        links = cut(spanning(_replaced(drawn, "b", label)).where("a <> b"))  # a vertex on its own is named by now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    last = cut(spanning(links.coalesce(1)))
    out = last.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(last.where("a <> b").select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    for label in reversed(names):
        out = _replaced(label, "root", out)
    return out.select("id", "root")
