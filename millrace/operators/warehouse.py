"""Star-schema queries. Dates are given as a year, a month or a day and become half-open ranges, which reach
the Parquet scan. Joins carry no broadcast hint: Spark broadcasts a side by its measured size, and beyond
that sorts and merges, with AQE splitting skewed partitions."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_range(text: str) -> tuple[date, date] | None:
    """Half-open range of a partial date; None matches nothing.

    Three parts name a day, two a month, any other number the year alone. Components are compared as written,
    so an unpadded one (``1996-1``) matches nothing. A trailing ``-`` is ignored.
    """
    parts = text.rstrip("-").split("-")
    use = parts if len(parts) in (2, 3) else parts[:1]
    if not all(re.fullmatch(r"[0-9]{4}" if i == 0 else r"[0-9]{2}", p) for i, p in enumerate(use)):
        return None
    try:
        lo = date(*(int(p) for p in use), *[1] * (3 - len(use)))
        hi = {1: lambda: date(lo.year + 1, 1, 1), 2: lambda: date(lo.year + lo.month // 12, lo.month % 12 + 1, 1), 3: lambda: lo + timedelta(days=1)}[len(use)]()
    except (ValueError, OverflowError):
        return None
    return lo, hi


def on_date(column: str, text: str) -> Column:
    """Predicate for ``column`` falling on a partial date."""
    span = date_range(text)
    if span is None:
        return F.lit(False)
    return (F.col(column) >= F.lit(span[0]).cast("timestamp")) & (F.col(column) < F.lit(span[1]).cast("timestamp"))


def count_shipped(lineitem: DataFrame, when: str) -> DataFrame:
    return lineitem.where(on_date("l_shipdate", when)).agg(F.count("*").alias("answer"))


def order_lookup(lineitem: DataFrame, orders: DataFrame, when: str, field: str = "o_orderpriority", k: int = 20) -> DataFrame:
    """The first k (field, order key) of line items shipped on a date, by order key."""
    hit = lineitem.where(on_date("l_shipdate", when)).select("l_orderkey")
    return hit.join(orders.select("o_orderkey", field), F.col("l_orderkey") == F.col("o_orderkey")).select(field, "o_orderkey").orderBy("o_orderkey", field).limit(k)


def part_supplier(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, when: str, k: int = 20) -> DataFrame:
    """The first k (order key, part name, supplier name) shipped on a date."""
    hit = lineitem.where(on_date("l_shipdate", when)).select("l_orderkey", "l_partkey", "l_suppkey")
    return (
        hit.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "p_name", "s_name")
        .orderBy("l_orderkey", "p_name", "s_name")
        .limit(k)
    )


def nation_counts(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, when: str) -> DataFrame:
    """Line items shipped on a date, counted by the customer's nation."""
    hit = lineitem.where(on_date("l_shipdate", when)).select("l_orderkey")
    return (
        hit.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("cnt"))
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_nationkey", "n_name", "cnt")
        .orderBy("n_nationkey", "n_name")
    )


def monthly_by_nation(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nations: tuple[int, ...] = (3, 24)) -> DataFrame:
    """Line items by ship month for customers of given nations."""
    own = customer.where(F.col("c_nationkey").isin(*nations)).select("c_custkey", "c_nationkey")
    of = orders.select("o_orderkey", "o_custkey").join(own, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        lineitem.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("ym"))
        .join(of, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("ym", "c_nationkey")
        .agg(F.count("*").alias("cnt"))
        .orderBy("ym", "c_nationkey")
    )


def last_of_each(build: DataFrame, key: str) -> DataFrame:
    """``build`` with one row per key, for a join in which the last of equal build keys wins: the largest, by the other columns in order.
    One aggregate with map-side combining."""
    rest = [c for c in build.columns if c != key]
    return build.groupBy(key).agg(F.max(F.struct(*rest)).alias("_last")).select(*[F.col(key) if c == key else F.col(f"_last.{c}") for c in build.columns])
