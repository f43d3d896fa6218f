"""A graph laid out on storage, so that an iteration moves ranks and never edges.

Nodes and edges are bucketed tables: the same hash deals nodes by id and edges by source to as many buckets, one sorted file each.
A round's state is written in the same buckets. So a round reads edges and state side by side, without a shuffle or a sort of either; what
is shuffled is one partial sum for each destination and task. The layout outlives the session: its folder holds what is needed to open it again.

    PATH/layout              committed facts: buckets, numbers of nodes and edges, schemas
    PATH/nodes, PATH/edges   (id, deg) of every node that has a record; (src, dst)
    PATH/hub_edges           (src, dst) of sources with more than HUB out-edges
    PATH/state-N, PATH/round-N   a round's state, and its committed facts, written once the state is whole

A source of more than HUB edges would be one task's work in its bucket. Its edges lie apart, not bucketed, and are joined with
the few ranks of such sources; Spark broadcasts those if they measure small, and otherwise splits the hubs' partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.plans.lineage import commit, committed, cut, exists, remove, settings

HUB = 1 << 20
#: Edges of a bucket: as many buckets as give each the first number, but not more than Spark's shuffle partitions until each would have the second.
FEW, MANY = 1 << 18, 1 << 26
#: Files of a bucket are sorted; Spark relies on that only when told so.
SORTED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


@dataclass
class Layout:
    spark: SparkSession
    path: str
    buckets: int
    n_nodes: int
    n_edges: int
    n_active: int
    n_hub_edges: int
    hub: int
    schemas: dict[str, list[str]]
    tables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.nodes = self.read("nodes")
        self.edges = self.read("edges")
        self.hub_edges = self.spark.read.parquet(f"{self.path}/hub_edges") if self.n_hub_edges else None

    def read(self, name: str) -> DataFrame:
        """A table of the layout, with its buckets and their order."""
        key, schema = self.schemas[name]
        if name not in self.tables:
            self.tables[name] = f"millrace_{uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def settings(self) -> dict[str, str]:
        """What the jobs of a round run under: sums are dealt to as many partitions as there are buckets."""
        return SORTED | {"spark.sql.shuffle.partitions": str(self.buckets)}

    def write(self, df: DataFrame, name: str, key: str) -> None:
        """Write ``df`` as the table ``name``, in buckets by ``key``."""
        self.forget(name)
        self.tables[name] = _write(df, self.path, name, key, self.buckets, self.settings())
        self.schemas[name] = [key, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)]

    def forget(self, name: str, delete: bool = False) -> None:
        """Drop a table's name; ``delete`` its files too."""
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        if delete:
            remove(self.spark, f"{self.path}/{name}")

    def close(self, delete: bool = False) -> None:
        """Forget the tables; ``delete`` their files too."""
        for name in list(self.tables):
            self.forget(name)
        if delete:
            remove(self.spark, self.path)


def _write(df: DataFrame, path: str, name: str, key: str, buckets: int, conf: dict[str, str]) -> str:
    """Write ``df`` in buckets; returns the name of its table."""
    spark, table = df.sparkSession, f"millrace_{uuid4().hex}"
    remove(spark, f"{path}/{name}")  # what a run that broke off has left
    with settings(spark, conf):
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}").saveAsTable(table)
    return table


def _seen(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with metrics over its rows, to be read once it is written. Rows are counted in the stage that writes them, whose tasks count
    once each, however often one is run."""
    seen = Observation()
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def store(nodes: DataFrame | None, edges: DataFrame, path: str, buckets: int | None = None, hub: int | None = None, kept: bool = False) -> Layout:
    """Lay a graph of nodes(id) and edges(src, dst) out in ``path``. Parallel edges count each; ids that stand twice are one node.
    nodes None: all ids that edges name, found while their degrees are counted. kept: ``edges`` are written somewhere, so they are read from there several times and not written once more before."""
    spark, hub = edges.sparkSession, HUB if hub is None else hub
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    edges = edges if kept else cut(edges)
    if buckets is None:
        e = edges.count()
        buckets = max(1, -(-e // MANY), min(-(-e // FEW), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    conf = SORTED | {"spark.sql.shuffle.partitions": str(buckets)}
    row = lambda df, id_, deg, record: df.select(F.col(id_).cast("long").alias("id"), deg.cast("long").alias("deg"), F.lit(record).alias("record"))
    out = row(edges, "src", F.when(F.col("src").isNotNull(), 1).otherwise(0), nodes is None)
    records = row(edges, "dst", F.lit(0), True) if nodes is None else row(nodes, "id", F.lit(0), True)
    held = records.unionByName(out).groupBy("id").agg(F.sum("deg").alias("deg"), F.max("record").alias("record")).where("record").select("id", "deg")  # summed before it is shuffled, and once for both
    deg = F.col("deg")
    held, seen = _seen(held, {"n_nodes": F.count("*"), "n_active": F.count(F.when(deg > 0, 1)), "hubs": F.count(F.when(deg > hub, 1))})
    tables = {"nodes": _write(held, path, "nodes", "id", buckets, conf)}
    facts, apart = seen.get, 0
    if facts.pop("hubs"):
        large = spark.table(tables["nodes"]).where(deg > hub).select(F.col("id").alias("src"))
        far, seen = _seen(edges.join(large, "src", "left_semi"), {"n": F.count("*")})
        far.write.mode("overwrite").parquet(f"{path}/hub_edges")
        apart, edges = seen.get["n"], edges.join(large, "src", "left_anti")
    near, seen = _seen(edges.repartition(buckets, "src"), {"n": F.count("*")})
    tables["edges"] = _write(near, path, "edges", "src", buckets, conf)
    facts |= {"n_edges": seen.get["n"] + apart, "n_hub_edges": apart, "buckets": buckets, "hub": hub, "schemas": {"nodes": ["id", "id bigint, deg bigint"], "edges": ["src", "src bigint, dst bigint"]}}
    commit(spark, f"{path}/layout", facts)
    return Layout(spark, path, **facts, tables=tables)


def open_layout(spark: SparkSession, path: str) -> Layout:
    """A layout that ``store`` has finished, in this session or another."""
    facts = committed(spark, f"{path}/layout")
    if facts is None:
        raise ValueError(f"no layout in {path}")
    return Layout(spark, path, **facts)


def stored(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/layout/_SUCCESS")


def last_round(layout: Layout) -> dict | None:
    """The facts of the last committed round, if any. Rounds are committed in order."""
    n, got = 0, None
    while (facts := committed(layout.spark, f"{layout.path}/round-{n}")) is not None:
        n, got = n + 1, facts
    return got


def meet(layout: Layout, state: DataFrame) -> DataFrame:
    """The columns of ``state`` (id, deg, ..) with ``dst``, for every out-edge of its nodes. Edges stay where they are."""
    got = state.join(layout.edges, state["id"] == layout.edges["src"]).drop("src")
    if layout.hub_edges is None:
        return got
    hubs = state.where(F.col("deg") > layout.hub)
    return got.unionByName(hubs.join(layout.hub_edges, hubs["id"] == layout.hub_edges["src"]).drop("src"))


def step(layout: Layout, ranks: DataFrame, columns: list[str], also: DataFrame | None = None, keep_all: bool = False) -> DataFrame:
    """(id, deg, *columns, n): what arrives at every node if each node of ``ranks`` (id, deg, *columns) hands its columns to its out-edges in
    equal parts, and in how many messages. deg is null for a destination without a record. ``also``: more rows (id, *columns), that count as
    no message; keep_all: nodes that nothing arrives at have a row as well.
    """
    out = meet(layout, ranks).select(F.col("dst").alias("id"), *[(F.col(c) / F.col("deg")).alias(c) for c in columns], F.lit(1).alias("n"))
    if also is not None:
        out = out.unionByName(also.select("id", *columns, F.lit(0).alias("n")))
    came = out.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns], F.sum("n").alias("n"))
    got = came.join(layout.nodes, "id", "full" if keep_all else "left")
    return got.select("id", "deg", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns], F.coalesce("n", F.lit(0)).alias("n"))


def counters(columns: list[str]) -> dict[str, Column]:
    """Metrics of ``step``: messages, nodes that some arrived at, destinations without a record, and each column's sum over nodes with one."""
    here = F.col("deg").isNotNull()
    counts = {"mass_messages": F.sum("n"), "mass_messages_received": F.count(F.when(here & (F.col("n") > 0), 1)), "missing_structure": F.count(F.when(~here, 1))}
    return counts | {f"mass_{c}": F.sum(F.when(here, F.col(c))) for c in columns}
