"""A corpus pipeline over ``documents``: STAGES run in order, each on all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. run() writes every stage as Parquet under the cluster's shared folder and reads it again.

Null texts pass every filter and are encoded as null; documents with a null key are never taken for a keyed one's copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, mixing, piece_codec, substring_dedup, toxicity
from millrace.llm._spark import crc_mod, cut, free
from millrace.plans.lineage import fresh_path, remove

#: Of the tokens that reach the mixing stage, what its sample keeps.
SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't reject. Learned from the labels of four fifths of the keys."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group, that with the smallest key; the others go, known by key and text, as keys may repeat.
    Of a group's rows with a null key one stays as well. Rows alike in key and text are one."""
    key, tie, mark = free(docs, "key", "gone", "tie")
    gone = cut(jaccard_join.rows(docs.select("doc_id", "text")).where("NOT stays").select(F.col("doc_id").alias(key), F.col("tie").alias(tie)).distinct())
    tagged = docs.withColumn(mark, jaccard_join.tie_of("text"))
    kept = tagged.join(gone, tagged["doc_id"].eqNullSafe(gone[key]) & (tagged[mark] == gone[tie]), "left_anti")
    return kept.dropDuplicates(["doc_id", mark]).drop(mark)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    out = substring_dedup.dedup(docs.select("doc_id", "text", F.struct("*").alias("_row")))
    n_chars = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns])


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of SHARE of the tokens, as near to the target weights as they allow; scarce cells are kept whole."""
    cells = mixing.with_cells(docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("_row")))
    return mixing.mix(cells, mixing.TARGETS, share=SHARE).where("sampled").select("_row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_pieces."""
    out = piece_codec.encode(docs, piece_codec.load())
    return out.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("mixing", sample_mix),
    ("piece_codec", encode_pieces),
]

#: No SQL: stages with learned weights and signatures aren't expressible; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again. A stage's folder is removed once its successor is written; the last one's is the result's."""
    folder = fresh_path(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
