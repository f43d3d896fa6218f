"""Readers and writers of plain-text formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import lines
from millrace.sources.offsets import RANGE, TASKS, read_lines

#: Positions and types of the columns that the queries use, in '|'-separated table files.
TBL = {
    "lineitem": {0: "l_orderkey long", 1: "l_partkey long", 2: "l_suppkey long", 10: "l_shipdate timestamp"},
    "orders": {0: "o_orderkey long", 1: "o_custkey long", 6: "o_clerk string"},
    "customer": {0: "c_custkey long", 3: "c_nationkey int"},
    "nation": {0: "n_nationkey int", 1: "n_name string"},
    "part": {0: "p_partkey long", 1: "p_name string"},
    "supplier": {0: "s_suppkey long", 1: "s_name string"},
}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(line): one row per line."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_collection(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, offset, line) of a plain collection: the byte at which each line starts in its file. Ranges of files are read side by side, small ones
    several a task."""
    return read_lines(spark, path, range_bytes, TASKS * spark.sparkContext.defaultParallelism)


def strict(field: Column, kind: str) -> Column:
    """``field`` as ``kind``; one that is absent or doesn't parse fails the query."""
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce(field, F.lit("(absent)"))))
    return F.coalesce(field.try_cast(kind), bad.cast(kind))


def read_tbl(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The used columns of ``folder``/``name``.tbl; a field that is absent or doesn't parse fails the read."""
    t = F.split("line", "[|]", -1)
    used = [(i, *c.split()) for i, c in TBL[name].items()]
    return read_text(spark, f"{folder}/{name}.tbl").select(*[strict(F.get(t, F.lit(i)), kind).alias(c) for i, c, kind in used])


def with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, offset, line): the byte at which each line starts in its own document."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines(docs, key, text).select(key, "line_no", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)).alias("offset"), "line")


def parse_adjacency(rows: DataFrame, line: str = "line", tabs_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(src, dst) of lines 'src dst dst ...', separated by any white space; a lone id is a node without out-edges;
    blank lines are skipped; repeated destinations are parallel edges.

    tabs_only: fields are separated by tabs, and a line with one field adds no node; nodes are those that have an edge."""
    bare = F.regexp_replace(F.col(line), "^\\s+|\\s+$", "")
    split = F.filter(F.split(F.col(line), "\t"), lambda x: F.trim(x) != "") if tabs_only else F.split(bare, "\\s+")
    t = rows.where(bare != "").select(split.alias("f")).select(F.transform("f", lambda x: strict(F.trim(x), "long")).alias("t"))
    edges = t.select(F.element_at("t", 1).alias("src"), F.explode(F.slice("t", 2, F.size("t"))).alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct() if tabs_only else t.select(F.element_at("t", 1).alias("id"))
    return nodes, edges


def parse_features(rows: DataFrame, line: str = "line") -> DataFrame:
    """(docid, label, features) of lines 'docid label f f ...'."""
    t = F.split(F.col(line), " ")
    return rows.select(t[0].alias("docid"), t[1].alias("label"), F.slice(t, 3, F.greatest(F.size(t), F.lit(1))).cast("array<int>").alias("features"))


def parse_model(rows: DataFrame, line: str = "line") -> DataFrame:
    """(feature, weight) of lines '(feature,weight)'."""
    t = F.split(F.regexp_replace(F.col(line), "[()]", ""), ",")
    return rows.select(strict(F.get(t, F.lit(0)), "int").alias("feature"), strict(F.get(t, F.lit(1)), "double").alias("weight"))


def read_models(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model_id, feature, weight) of several model files, numbered in the order given."""
    each = [parse_model(read_text(spark, p)).select(F.lit(i).alias("model_id"), "feature", "weight") for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each)


def parse_line_frequencies(rows: DataFrame, line: str = "line") -> DataFrame:
    """(word, n) of lines '(word, *)<tab>count', the total being '(*, *)'."""
    c = F.col(line)
    return rows.select(F.regexp_extract(c, r"^\((.*), \*\)\t", 1).alias("word"), F.regexp_extract(c, r"\t(.*)$", 1).cast("double").cast("long").alias("n"))


def _shown(df: DataFrame, columns: list[str]) -> list[Column]:
    """Fields as text; a null one is written 'null', so that no field vanishes."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]


def write_pairs(df: DataFrame, path: str, key: int = 1) -> None:
    """Overwrite a folder of text lines, a row's fields separated by tabs. The first ``key`` columns are the key: of two or more
    it is written '(a, b)'."""
    names = df.columns
    first = F.concat(F.lit("("), F.concat_ws(", ", *_shown(df, names[:key])), F.lit(")")) if key > 1 else _shown(df, names[:1])[0]
    df.select(F.concat_ws("\t", first, *_shown(df, names[key:]))).write.mode("overwrite").text(path)


def write_tuples(df: DataFrame, path: str) -> None:
    """Overwrite a folder of text lines '(a,b,...)'."""
    df.select(F.concat(F.lit("("), F.concat_ws(",", *_shown(df, df.columns)), F.lit(")"))).write.mode("overwrite").text(path)


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Overwrite a folder of adjacency lines, a node's destinations separated by tabs; a node without out-edges is a line of its own."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("dst")).cast("array<string>"), "\t").alias("to"))
    nodes.select("id").distinct().join(out, "id", "left").select(F.concat_ws("\t", F.col("id").cast("string"), "to")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table."""
    df.write.mode("overwrite").parquet(path)
