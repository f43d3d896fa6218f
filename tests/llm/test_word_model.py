import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import perplexity
from millrace.llm import word_model as W
from millrace.plans.lineage import cut


def words(text):
    out = []
    for part in text.lower().split():
        run = ""
        for c in part:
            if c.isalnum():
                run += c
                continue
            out += [run, c] if run else [c]
            run = ""
        out += [run] if run else []
    return out


def test_words_and_rings():
    texts = ["Ab, ab!  cd", None, "", "x", " \n", "É1 é1"]
    h, off = W.words(pa.array(texts))
    assert list(np.diff(off)) == [5, 0, 0, 1, 0, 2] and h[0] == h[2] and h[1] != h[3] and h[-1] == h[-2]
    v, w, upto = W.pairs(pa.array(texts))
    assert list(np.diff(upto)) == [6, 0, 0, 2, 0, 3] and v[0] == w[5] == W.EDGE and list(w[:5]) == list(v[1:6]) == list(h[:5])


@pytest.mark.parametrize(("hot", "hot_words", "tokens"), [(1 << 12, 1 << 16, 2 << 20), (0, 0, 50), (1, 3, 50)])
def test_word_model_by_brute_force(spark, monkeypatch, hot, hot_words, tokens):
    """However much of the model all tasks know, and however texts are sliced, each text has the loss that plain counts give."""
    monkeypatch.setattr(W, "HOT", hot)
    monkeypatch.setattr(W, "HOT_WORDS", hot_words)
    monkeypatch.setattr(W, "TOKENS", tokens)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "of", "Sea", "sea", "ship,", "a", "é", "x" + str(rng.randrange(40))]) for _ in range(n))
    texts = [say(rng.randrange(1, 30)) for _ in range(80)]
    asked = [*texts[:20], *[say(9) for _ in range(20)], "never seen words", None, "", "sea " * 300]
    pairs = Counter(p for t in texts for r in [["", *words(t), ""]] for p in zip(r[:-1], r[1:], strict=True))
    kinds = lambda c: [sum(n == i for n in c) for i in (1, 2, 3, 4)]
    d, follows = W.discounts(*kinds(pairs.values())), Counter(w for _, w in pairs)
    e, types = W.discounts(*kinds(follows.values())), len(pairs)
    left = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0
    lower = lambda w: max(left(follows[w], e), 0) / types + sum(n - left(n, e) for n in follows.values()) / types / (len(follows) + 1)

    def loss(text):
        r, out = ["", *words(text), ""], 0.0
        for v, w in zip(r[:-1], r[1:], strict=True):
            under = [n for (a, _), n in pairs.items() if a == v]
            free = sum(n - left(n, d) for n in under) / sum(under) if under else 1.0
            out -= math.log((left(pairs[v, w], d) / sum(under) if under else 0.0) + free * lower(w))
        return out / (len(r) - 1)

    shards, facts = W.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    rows = spark.createDataFrame([(str(i), "x", i % 2 == 0, t) for i, t in enumerate(asked)], "key string, lang string, held boolean, text string").repartition(3)
    got = {r["key"]: r for r in W.score(rows, shards, facts).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        r = got[str(i)]
        assert r["held"] == (i % 2 == 0) and r["n_symbols"] == (len(words(t)) + 1 if t else 0)
        assert r["loss"] == (pytest.approx(loss(t), abs=2e-3) if t else None)


def test_op1_knows_words(spark, sf):
    """A text that swaps letters for others of the same class is the same to a model of classes, not to one of words."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    good = labels.where("quality = 1").select("doc_id")
    other = docs.join(good, "doc_id").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.regexp_replace("text", "([a-z])([a-z]+)", "$2$1").alias("text"), "lang")
    got = perplexity.classify_by_words(docs.select("doc_id", "text", "lang").unionByName(other), good)
    seen = got.groupBy((F.col("doc_id") >= 10_000_000).alias("other")).agg(F.expr("percentile(ln(perplexity), 0.5)").alias("loss")).collect()
    loss = {r["other"]: r["loss"] for r in seen}
    assert loss[True] > loss[False] + 1


def test_op1_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two", None), (3, "one two", None), (None, "a null key", "x"), (5, "The ship sailed on. " * 9000, "x")], "doc_id long, text string, lang string")
    for keys, kept in ((spark.createDataFrame([(5,), (5,), (3,), (None,)], "doc_id long"), {3, 5}), (spark.createDataFrame([], "doc_id long"), {3, 5, None})):
        got = perplexity.classify_by_words(docs, keys).collect()
        assert len(got) == 6 and [r["perplexity"] for r in got if r["doc_id"] in (1, 2)] == [None, None]
        assert {r["doc_id"] for r in got if r["kept"]} >= kept
    assert perplexity.classify_by_words(docs.limit(0), keys).count() == 0


def test_slices_that_ask_have_few_texts(spark, monkeypatch):
    """A slice numbers its texts in few bits beside the keys, so it ends at so many texts, however few words they have."""
    monkeypatch.setattr(W, "HOT", 0)
    texts = [f"w{i % 7} w{i % 5} w{i}" for i in range(50)]
    shards, facts = W.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = spark.createDataFrame([(i, "x", True, t) for i, t in enumerate(texts)], "key long, lang string, held boolean, text string").coalesce(1)
    many = {r["key"]: r["loss"] for r in W.score(rows, shards, facts).collect()}
    monkeypatch.setattr(W, "TEXTS", 8)
    assert len(many) == 50 and many == {r["key"]: r["loss"] for r in W.score(rows, shards, facts).collect()}


def test_a_cut_leaves_no_shuffle_behind(spark):
    """What led to a checkpoint is deleted with it: op1 has a dozen shuffles, of which the disk is to hold those of one step."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they are deleted in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and kept.count() == 7
