"""Cutting lineage for iterations, and the folder that driver and executors share."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a query's shuffle files when it ends, not when the driver happens to collect garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``; where none is named, the
    warehouse's, but only if one machine runs it all: else there is none, and that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder and all that is below it."""
    files, where = _at(spark, path)
    files.delete(where, True)


def commit(spark: SparkSession, path: str, facts: dict) -> None:
    """Write ``facts`` to ``path`` as JSON. The folder has its ``_SUCCESS`` only once it is whole, which is what ``committed`` asks for."""
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(path)


def committed(spark: SparkSession, path: str) -> dict | None:
    """What was committed to ``path``, or None."""
    return json.loads(spark.read.text(path).first()[0]) if exists(spark, f"{path}/_SUCCESS") else None


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """SQL settings that hold for the jobs run inside, and are put back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with its lineage cut there, so a lost executor costs no iteration. The shuffles that led to
    it go as soon as it is written, since nothing reads them again."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with settings(df.sparkSession, FREED):
        return df.select("*").checkpoint()
