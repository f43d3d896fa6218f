"""Quality classifier: an interpolated modified Kneser-Ney model, trained on trusted text, and perplexity thresholds by language.

The query's model is one of words (``word_model``, ``classify_by_words``). A smaller one, of character classes (``classify``), predicts a text's symbols from the ORDER - 1 before them. Characters are folded to SYMBOLS classes (letters keep their
identity, capitals, digits, marks and line breaks have classes of their own), so the counts have a proven size,
SYMBOLS ** ORDER at most, while they cover every text trained on. Each slice of text counts its own n-grams, and counts are summed by
n-gram. From them come the continuation counts of the lower orders, the three discounts of each order (Chen and Goodman), and one table of
log-probabilities, which is broadcast, as its size is bounded. (The README says why the counts aren't joined by shard.)

A document's perplexity is the exponential of its mean negative log-probability per symbol. Of the trusted texts, one in HELD_OUT, by a
hash of the text, so that copies stay together, is not trained on: the thresholds of each language are the LOW and HIGH quantiles of
the mean among its held-out trusted documents. A document of n symbols is not kept if its mean is beyond them
by more than MARGIN / sqrt(n), since the mean of a short text scatters. Quantiles come
from a histogram in steps of STEP. A language with fewer than ENOUGH held-out documents has no 0.5 % quantile to speak of: there all its
trusted documents count.

Defined results: a null or empty text has no symbol, a null perplexity, and isn't kept; a language without trusted documents
uses the thresholds of all; with no trusted text at all the model is uniform and every text with a symbol is kept; a null language is one
of its own; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _kernels as K
from millrace.llm import word_model as W
from millrace.llm._spark import cut, map_chunks, table

SYMBOLS, ORDER = 48, 4
LOW, HIGH, MARGIN, STEP = 0.005, 0.99, 1.5, 0.001
HELD_OUT, ENOUGH = 5, 100
#: Spark filters the larger side of the join by a Bloom filter of the smaller one's keys, whatever the sizes measured.
FILTERED = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g", "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@cache
def symbols() -> np.ndarray:
    """The class of every code point. 0 stands before a text's first symbol."""
    low, cat = K.lower_map(), K.categories()
    every = np.arange(len(low))
    out = np.full(len(low), 47, np.int64)
    out[cat == ord("Z")] = 1
    out[cat == ord("N")] = 3
    out[cat == ord("P")] = 7
    out[cat == ord("S")] = 5
    letter = cat == ord("L")
    out[letter] = 34 + low[letter] % 8
    plain = letter & (low >= 97) & (low <= 122)
    out[plain] = 8 + low[plain] - 97
    capital = letter & (low != every)
    out[capital] = 42 + low[capital] % 5
    for chars, c in ((" \t", 1), ("\n\r", 2), (".,", 4), ("#*$%&|<>", 5), ("!?", 6)):
        out[[ord(x) for x in chars]] = c
    return out


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram ending at every symbol, as a number, and the symbols' offset per row."""
    cps, off = K.codepoints(text)
    n = np.diff(off)
    pad = off[:-1] + np.arange(len(n)) * (ORDER - 1)
    sym = np.zeros(len(cps) + len(n) * (ORDER - 1), np.int64)
    at = np.arange(len(cps)) + np.repeat(pad + (ORDER - 1) - off[:-1], n)
    sym[at] = symbols()[cps]
    out = np.zeros(len(cps), np.int64)
    for j in range(ORDER - 1, -1, -1):
        out = out * SYMBOLS + sym[at - j]
    return out, off


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts: each slice adds up its own, Spark adds the slices."""

    def go(part: pa.RecordBatch) -> dict:
        found, n = np.unique(grams(part.column("text"))[0], return_counts=True)
        return {"gram": pa.array(found.astype(np.int32)), "n": pa.array(n)}

    return map_chunks(docs.select(F.col(text).alias("text")).where("text IS NOT NULL"), go, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (float((counts == i).sum()) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return max(0.0, 1 - 2 * y * n2 / n1), max(0.0, 2 - 3 * y * n3 / n2), max(0.0, 3 - 4 * y * n4 / n3)


def train(counts: np.ndarray) -> np.ndarray:
    """Log-probability of every ORDER-gram's last symbol, from counts of all SYMBOLS ** ORDER of them.

    The highest order uses the counts, the lower ones the number of distinct symbols before an n-gram; the lowest is interpolated
    with the uniform distribution over the SYMBOLS - 1 classes that can occur."""
    levels = [counts.reshape(-1, SYMBOLS).astype(np.float64)]
    types = counts > 0
    for _ in range(ORDER - 1):
        types = types.reshape(SYMBOLS, -1)
        levels.append(types.sum(axis=0).reshape(-1, SYMBOLS).astype(np.float64))
        types = types.any(axis=0)
    p = np.full((1, SYMBOLS), 1 / (SYMBOLS - 1))
    p[0, 0] = 0
    for c in reversed(levels):  # contexts x symbols, the shortest context first
        d = discounts(c)
        total = c.sum(axis=1, keepdims=True)
        taken = sum(di * ((c == i) if i < 3 else (c >= 3)).sum(axis=1, keepdims=True) for i, di in zip((1, 2, 3), d, strict=True))
        cut_ = np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])
        lower = np.tile(p, (max(1, len(c) // len(p)), 1)) if len(c) > 1 else p
        seen = total > 0
        p = np.where(seen, (np.maximum(c - cut_, 0) + taken * lower) / np.where(seen, total, 1), lower)
    return np.log(np.maximum(p, 1e-12)).astype(np.float32).ravel()


def fit(trusted: DataFrame, text: str = "text") -> np.ndarray:
    """The table of log-probabilities. What reaches the driver is one count per distinct n-gram: SYMBOLS ** ORDER at most."""
    got = count(trusted, text).toArrow()
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return train(counts)


def score(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(key, lang, n_symbols, loss: mean negative log-probability per symbol, held: held_out) of (key, lang, text). One narrow pass."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def go(part: pa.RecordBatch) -> dict:
        g, off = grams(part.column("text"))
        n = np.diff(off)
        loss = -K.segment_sums(shared.value[g].astype(np.float64), off) / np.maximum(n, 1)
        return {"key": part.column("key"), "lang": part.column("lang"), "n_symbols": pa.array(n), "loss": pa.array(loss, mask=n == 0), "held": part.column("held")}

    kind = rows.schema["key"].dataType.simpleString()
    return map_chunks(rows.select("key", "lang", "text", F.coalesce(held_out("text"), F.lit(False)).alias("held")), go, f"key {kind}, lang string, n_symbols long, loss double, held boolean")


def held_out(text: str) -> Column:
    """Whether a trusted text serves for thresholds and not for training."""
    return F.pmod(F.xxhash64(F.col(text), F.lit(41)), F.lit(HELD_OUT)) == 0


def thresholds(losses: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(lang, low, high) from (lang, loss, held): quantiles of the loss by language, as the lowest step at or above which a share of the
    documents lies. They are those of held-out documents where there are ENOUGH, and otherwise of all."""
    two = losses.where("loss IS NOT NULL").select("lang", "loss", F.explode(F.when(F.col("held"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("held"))
    steps = two.groupBy("lang", "held", F.round(F.col("loss") / STEP).cast("int").alias("b")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang", "held")  # the steps of one language: as many as its losses span
    upto = steps.withColumns({"all": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy("b"))})
    at = lambda share: (F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("b"))) * F.lit(STEP)).cast("double")
    each = upto.groupBy("lang", "held").agg(F.max("all").alias("n"), at(low).alias("low"), at(high - 1e-12).alias("high"))
    best = each.where(~F.col("held") | (F.col("n") >= ENOUGH)).groupBy("lang").agg(F.max(F.struct("held", "low", "high")).alias("t"))
    return best.select("lang", "t.low", "t.high")


def _trusted(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    # at every size the same plan: rows are dealt by key once, and only keys are held to look them up
    return docs.join(keys.hint("shuffle_hash"), docs[key] == keys["_k"], "left_semi")


def classify(docs: DataFrame, trusted_keys: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, n_symbols, perplexity, low, high: the language's bounds of perplexity, kept) of every document, by the model of character classes.
    trusted_keys: a column of the same name, the keys of the trusted documents."""
    keys = trusted_keys.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct()
    model = fit(_trusted(docs, keys, key).select(F.col(text).alias("text")).where(~held_out("text")))
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return _verdicts(cut(score(rows, model)), keys, key, lang)


def classify_by_words(docs: DataFrame, trusted_keys: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """As ``classify``, by the model of words (``word_model``): a symbol is a word or a text's end. Held-out texts are left out and, by a filter of bounded
    size that Spark makes of the keys, most others that aren't trusted, before texts are dealt by key."""
    keys = trusted_keys.select(F.col(key).alias("_k")).where("_k IS NOT NULL")
    texts = _trusted(docs.where(~held_out(text)), keys, key).select(F.col(text).alias("text"))
    shards, facts = W.learn(texts, FILTERED)
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.coalesce(held_out(text), F.lit(False)).alias("held"), F.col(text).alias("text"))
    return _verdicts(cut(W.score(rows, shards, facts)), keys.distinct(), key, lang, low_of_all=True)


def _verdicts(scored: DataFrame, keys: DataFrame, key: str, lang: str, low_of_all: bool = False) -> DataFrame:
    """low_of_all: the low bound is that of all trusted documents. A model of words knows those it was trained on, and their copies, better than any other text."""
    trusted = _trusted(scored, keys, "key").select("lang", "loss", "held")
    whole = trusted.select(F.lit("").alias("lang"), "loss", "held")
    by, every = thresholds(trusted), thresholds(whole).first()
    low_, high_ = (every["low"], every["high"]) if every else (0.0, float("inf"))
    limits = by.select(F.col("lang").alias("_lang"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    if low_of_all and every:
        each = thresholds(trusted.withColumn("held", F.lit(False))).select(F.col("lang").alias("_of"), F.col("low").alias("_all"))
        limits = limits.join(each, F.col("_lang").eqNullSafe(F.col("_of"))).select("_lang", F.col("_all").alias("_low"), "_high")
        low_ = thresholds(whole.withColumn("held", F.lit(False))).first()["low"]
    out = scored.join(limits, scored["lang"].eqNullSafe(limits["_lang"]), "left")  # Spark broadcasts the languages' rows as far as they are few
    low, high = F.coalesce("_low", F.lit(low_)), F.coalesce("_high", F.lit(high_))
    slack = MARGIN / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    kept = F.coalesce((F.col("loss") >= low - slack) & (F.col("loss") <= high + slack), F.lit(False))
    return out.select(F.col("key").alias(key), scored["lang"].alias(lang), "n_symbols", F.exp("loss").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"), kept.alias("kept"))


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return classify_by_words(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)
