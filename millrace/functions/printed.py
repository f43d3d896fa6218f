"""Rows as printed lines, for small results: those of a top-k, or a row for each value of a small dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_of(*columns: str) -> Column:
    """'(a,b,...)'; null is printed as null."""
    return F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), F.lit(")"))


def printed(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(place, line): rows in order, from 1."""
    return rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), line_of(*columns).alias("line"))


def printed_groups(rows: DataFrame, group: str, titles: dict[int, str], columns: list[str], order: list[str]) -> DataFrame:
    """(place, line): for each group of ``titles`` its title, then its rows in order."""
    spark = rows.sparkSession
    heads = spark.createDataFrame([(i, t) for i, t in enumerate(titles.values())], "part long, line string").select("part", F.lit(None).cast("string").alias("o"), "line")
    part = F.lit(None).cast("long")
    for i, k in enumerate(titles):
        part = F.when(F.col(group) == k, i).otherwise(part)
    body = rows.select(part.cast("long").alias("part"), F.concat_ws("\x00", *order).alias("o"), line_of(*columns).alias("line")).where("part IS NOT NULL")
    place = F.row_number().over(Window.orderBy("part", F.asc_nulls_first("o")))
    return heads.unionByName(body).select(place.cast("long").alias("place"), "line")
