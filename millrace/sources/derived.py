"""A graph out of the star schema: customer -> part bought -> supplier of it -> nation. Nations have no out-edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.lineage import cut
from millrace.sources.tables import table

SUPPLIER, CUSTOMER, NATION = 10_000_000_000, 20_000_000_000, 30_000_000_000


def trade_graph(spark: SparkSession, sf_dir: str, parallel: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(src, dst), distinct ones unless ``parallel``: then one for every line item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") + CUSTOMER).alias("src"), F.col("l_partkey").alias("dst"))
    made = items.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst"))
    if not parallel:
        bought, made = bought.distinct(), made.distinct()
    home = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("src"), (F.col("s_nationkey").cast("long") + NATION).alias("dst"))
    edges = cut(bought.unionByName(made).unionByName(home))  # read three times by most: for sources, destinations and themselves
    return edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "id"), edges
