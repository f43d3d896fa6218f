"""An inverted index as a table (term, docno, tf), posting lists cut into blocks, and boolean retrieval.

The long table is the index: a term of any frequency is as many rows as it has documents, spread as they come. Lists are built per block of
document numbers, so no list is longer than a block. A query reads only its own terms' rows and decides each document in one aggregate.
``postings`` (the module) stores an index and reads it by need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.plans.rpn import compile_query

BLOCK = 1 << 20


def postings(docs: DataFrame, docno: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, docno, tf)."""
    return T.each(docs.withColumn("docno", F.col(docno)), T.tokens(text), "term", "docno").groupBy("term", "docno").agg(F.count("*").cast("int").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def gap_postings(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, docno, tf, gap): the distance to the term's document before, within a block; a block's first counts from 0."""
    w = Window.partitionBy("term", "block").orderBy("docno")
    held = index.withColumn("block", F.floor(F.col("docno") / block))
    return held.select("term", "docno", "tf", (F.col("docno") - F.lag("docno", 1, 0).over(w)).alias("gap"))


def posting_lists(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block, postings): arrays of (gap, tf) in document order, one per block."""
    held = index.withColumn("block", F.floor(F.col("docno") / block)).groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("docno", "tf"))).alias("p"))
    gap = lambda e, i: F.struct((e["docno"] - F.when(i > 0, F.element_at("p", F.greatest(i, F.lit(1)))["docno"]).otherwise(0)).alias("gap"), e["tf"].alias("tf"))
    return held.select("term", "block", F.transform("p", gap).alias("postings"))


def decode_lists(lists: DataFrame) -> DataFrame:
    """(term, docno, tf) back from posting lists: running sums of the gaps, per block."""
    flat = lists.select("term", "block", F.posexplode("postings").alias("i", "p")).select("term", "block", "i", "p.gap", "p.tf")
    upto = Window.partitionBy("term", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return flat.select("term", F.sum("gap").over(upto).alias("docno"), "tf")


def boolean_query(index: DataFrame, query: str) -> DataFrame:
    """(docno) of the documents that meet an RPN query, each once. A term no document has matches none."""
    plan = compile_query(query)
    flags = [F.max(F.col("term") == t).alias(f"f{i}") for i, t in enumerate(plan.terms)]
    each = index.where(F.col("term").isin(*plan.terms)).groupBy("docno").agg(*flags)
    return each.where(plan.predicate({t: F.col(f"f{i}") for i, t in enumerate(plan.terms)})).select("docno")


def with_snippets(hits: DataFrame, docs: DataFrame, docno: str = "doc_id", text: str = "text") -> DataFrame:
    """(docno, snippet) in ascending document order."""
    return hits.join(docs.select(F.col(docno).alias("docno"), T.snippet(text).alias("snippet")), "docno").orderBy("docno")
