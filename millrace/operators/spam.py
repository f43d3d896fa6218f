"""A linear spam classifier: online logistic regression, scores of one model, and ensembles.

Documents are (docid, label 'spam' or other, features array<int>); a model is (feature, weight), an ensemble has model_id as well.
"""

from __future__ import annotations

from collections import defaultdict
from math import exp

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

DELTA = 0.002
SPACE = 1 << 20


def hashed_features(text: str | Column) -> Column:
    """Tokens as numbers below SPACE, from the first 20 bits of their md5, in text order and with repeats."""
    return F.transform(T.tokens(text), lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 5), 16, 10).cast("int"))


def label_of(flag: str | Column) -> Column:
    return F.when((F.col(flag) if isinstance(flag, str) else flag) == 1, "spam").otherwise("ham")


def shuffle_key(seed: int, docid: str = "docid") -> Column:
    """What a seeded shuffle sorts by: the md5 of seed and document id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(docid).cast("string")).cast("binary"))


def _probability(score: float) -> float:
    """1 / (1 + exp(-score)); 0 where exp(-score) is beyond a double, as it is at scores below some -709.78."""
    return 1.0 / (1.0 + exp(-score)) if score > -709.78 else 0.0


def train(documents: DataFrame, shards: int = 1, seed: int | None = None, delta: float = DELTA) -> DataFrame:
    """(model_id, feature, weight): one pass of online logistic regression a shard, documents in order of docid, or, with a
    seed, in the order of a seeded hash.

    For each document p = 1 / (1 + exp(-score)) is fixed, then each feature occurrence adds (y - p) * delta. The pass depends on its
    order, so one shard is one sequential task; it streams, holding only the weights (SPACE at most). Several shards, dealt by a hash of
    docid, train side by side and make an ensemble, which is how training is spread over a cluster.
    """
    order = F.col("docid") if seed is None else shuffle_key(seed)
    rows = documents.select(F.pmod(F.xxhash64("docid"), F.lit(shards)).cast("int").alias("shard"), order.alias("o"), "docid", (F.col("label") == "spam").cast("double").alias("y"), "features")

    def go(batches):
        models: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for batch in batches:
            lists = batch.column("features")
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (shard, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "y")), strict=True)):
                w, features = models[shard], flat[off[i] : off[i + 1]].tolist()  # one document's at a time: a batch of long texts would take gigabytes
                step = (y - _probability(sum(map(w.__getitem__, features)))) * delta
                for f in features:
                    w[f] += step
        for shard, w in models.items():
            yield pa.RecordBatch.from_pydict({"model_id": pa.array([shard] * len(w), pa.int32()), "feature": pa.array(list(w), pa.int32()), "weight": pa.array(list(w.values()), pa.float64())})

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "o", "docid").mapInArrow(go, "model_id int, feature int, weight double")


def score(documents: DataFrame, model: DataFrame) -> DataFrame:
    """(docid, label, score, prediction): the sum of the weights of all feature occurrences, 0 for unknown ones; spam above 0."""
    hits = T.each(documents, F.col("features"), "feature", "docid").join(model.select("feature", "weight"), "feature").groupBy("docid").agg(F.sum("weight").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    return documents.select("docid", "label").join(hits, "docid", "left").select("docid", "label", s.alias("score"), verdict(s).alias("prediction"))


def verdict(s: Column) -> Column:
    return F.when(s > 0, "spam").otherwise("ham")


def ensemble(documents: DataFrame, models: DataFrame, method: str = "average", model_ids: tuple[int, ...] = (0, 1, 2), reference_compat: bool = False) -> DataFrame:
    """(docid, label, score, prediction) of several models: the mean score, or the votes for spam less those against.

    reference_compat: the vote's label is turned round (spam when fewer than half say so), as in the behaviour to be matched;
    its score is the same either way.
    """
    if method not in ("average", "vote"):
        raise ValueError(f"no such method: {method}")
    exploded = T.each(documents, F.col("features"), "feature", "docid")
    parts = exploded.join(models.select("model_id", "feature", "weight"), "feature").groupBy("docid").agg(*[F.sum(F.when(F.col("model_id") == i, F.col("weight"))).alias(f"s{i}") for i in model_ids])
    each = [F.coalesce(f"s{i}", F.lit(0.0)) for i in model_ids]
    joined = documents.select("docid", "label").join(parts, "docid", "left")
    if method == "average":
        s = sum(each[1:], each[0]) / len(each)
        return joined.select("docid", "label", s.alias("score"), verdict(s).alias("prediction"))
    votes = sum((F.when(e > 0, 1).otherwise(-1) for e in each[1:]), F.when(each[0] > 0, 1).otherwise(-1))
    yes = votes < 0 if reference_compat else votes > 0
    return joined.select("docid", "label", votes.cast("double").alias("score"), F.when(yes, "spam").otherwise("ham").alias("prediction"))
