"""What the operators share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._kernels import CHUNK, chunks
from millrace.plans.lineage import cut

__all__ = ["crc_mod", "cut", "free", "map_chunks", "parts", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text", size: int = CHUNK) -> DataFrame:
    """``fn`` on slices of whole rows of ``df``, bounded by the bytes of ``column``; it returns a dict of columns.

    The plan stays a narrow stage: no shuffle, nothing held beyond a slice.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, size):
                yield pa.RecordBatch.from_pydict(fn(part))

    return df.mapInArrow(go, schema)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, of which ``df`` has none in either case: ``names`` behind as many underscores as that takes."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def crc_mod(column: str, n: int):
    """crc32 of a key as text, modulo n; null keys count as 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
