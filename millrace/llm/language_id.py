"""Language ID by multilingual mixture inference.

Learning counts hashed character trigrams of words per language; each word of a text then has one
likelihood per language. A text is a mixture: expectation-maximisation finds the proportions of the
languages in it, and languages are admitted to its set one by one, by share, as long as the
penalised log-likelihood (half of log n for each added language) rises.

Defined results: a null text or one without a letter is ``und`` with score 0; a language that is null
teaches nothing; with nothing learned, all texts are ``und``; repeated rows are scored alike; other
columns of the input are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import crc_mod, map_chunks, table

SYMBOLS = 64
GRAMS = SYMBOLS**3
LANGS = 64


@cache
def _symbols() -> np.ndarray:
    """Of every code point. 0: no letter; 1-26: a-z in either case; 27-63: other letters, by lower case."""
    low = K.lower_map()
    out = (27 + low % 37).astype(np.int32)
    ascii_ = (low >= 97) & (low <= 122)
    out[ascii_] = low[ascii_] - 96
    out[~K.letter_mask()] = 0
    return out


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of every word (one space on either side): gram ids, grams' offset per word, words' offset per row."""
    cps, off = K.codepoints(text)
    sym = _symbols()[cps]
    before, after = np.zeros_like(sym), np.zeros_like(sym)
    before[1:], after[:-1] = sym[:-1], sym[1:]
    edge = off[1:-1]
    before[edge[edge < len(sym)]] = 0
    after[edge[edge > 0] - 1] = 0
    letter = sym > 0
    s, e, words = K.runs(letter, off)
    at = np.concatenate([[0], np.cumsum(e - s)])
    return ((before * SYMBOLS + sym) * SYMBOLS + after)[letter], at, words


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.05) -> tuple[list[str], np.ndarray]:
    """The languages, and log-probabilities of every gram in each.

    Counted over all rows of ``docs``: each slice adds up its grams, slices are summed by Spark. What
    reaches the driver is at most one number per language and gram (``GRAMS`` a language), whatever the
    size of the corpus. More than LANGS languages are refused: the column doesn't hold languages then.
    """

    def count(part: pa.RecordBatch) -> dict:
        langs = part.column("lang").dictionary_encode()
        g, at, words = grams(part.column("text"))
        row = np.repeat(np.arange(part.num_rows), np.diff(at[words]))
        code = np.asarray(langs.indices)[row] * GRAMS + g
        found, n = np.unique(code, return_counts=True)
        return {"lang": langs.dictionary.take(pa.array(found // GRAMS)), "gram": pa.array((found % GRAMS).astype(np.int32)), "n": pa.array(n.astype(np.int64))}

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if rows.select("lang").distinct().limit(LANGS + 1).count() > LANGS:
        raise ValueError(f"more than {LANGS} languages in {lang}")
    got = map_chunks(rows, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    langs = got.column("lang").combine_chunks().dictionary_encode()
    seen = langs.dictionary.to_pylist()  # LANGS at most
    names = sorted(seen)
    place = np.array([names.index(x) for x in seen], np.int64)
    codes, gram, n = place[langs.indices.to_numpy()] if names else np.zeros(0, np.int64), got.column("gram").to_numpy(), got.column("n").to_numpy()
    out = np.empty((len(names), GRAMS), np.float32)
    for i in range(len(names)):  # a language at a time
        one = np.full(GRAMS, alpha)
        one[gram[codes == i]] += n[codes == i]
        out[i] = np.log(one / one.sum())
    return names, out


def mixture(loglik: np.ndarray, words: np.ndarray, rounds: int = 10, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per row by expectation-maximisation, and the log-likelihood at the last of them.

    loglik: languages x words; allowed and the proportions: languages x rows (the set each row may use; all, if not given).
    """
    k, rows, n = len(loglik), len(words) - 1, np.diff(words)
    top = loglik.max(axis=0)
    like = np.exp(loglik - top)
    pi = np.full((k, rows), 1.0 / k, np.float32) if allowed is None else (allowed / np.maximum(allowed.sum(axis=0), 1)).astype(np.float32)
    share = np.float32(1) / np.maximum(n, 1).astype(np.float32)
    for _ in range(rounds + 1):
        part = [x * np.repeat(p, n) for x, p in zip(like, pi, strict=True)]
        total = np.maximum(sum(part), np.float32(1e-30))
        if _ == rounds:
            break
        pi = np.stack([K.segment_sums(p / total, words) * share for p in part])
    return pi, K.segment_sums((np.log(total) + top).astype(np.float64), words)


def infer(text: pa.Array, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions, languages x rows (languages outside a row's set have 0), and whether the row has a letter."""
    k = len(table_)
    g, at, words = grams(text)
    rows, n = len(words) - 1, np.diff(words)
    out = np.zeros((k, rows))
    if not k:
        return out, n > 0
    loglik = np.stack([K.segment_sums(t[g], at) for t in table_])
    alone = np.stack([K.segment_sums(x.astype(np.float64), words) for x in loglik])
    best = alone.argmax(axis=0)
    out[best, np.arange(rows)] = n > 0
    score = alone[best, np.arange(rows)]
    penalty = 0.5 * np.log(np.maximum(n, 2))
    going = (n > 0) & (k > 1)
    pi, full = mixture(loglik, words)
    order = np.argsort(-pi, axis=0, kind="stable")
    going &= full - penalty > score  # no set can fit better than the full one does
    for size in range(2, k + 1):
        at_ = np.flatnonzero(going)
        if not len(at_):
            break
        pick = np.zeros((k, len(at_)), np.float32)
        np.put_along_axis(pick, order[:size, at_], 1.0, axis=0)
        sub = np.concatenate([[0], np.cumsum(n[at_])])
        take = np.arange(sub[-1]) + np.repeat(words[at_] - sub[:-1], n[at_])
        p, fit = mixture(loglik[:, take], sub, allowed=pick)
        gain = fit - penalty[at_] > score[at_]
        out[:, at_[gain]], score[at_[gain]] = p[:, gain], fit[gain] - penalty[at_][gain]
        going[at_[~gain]] = False
    return out, n > 0


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred (the language of the largest share), score (that share), and
    langs, a map of every language in the text's set to its share. One narrow pass over whole texts."""
    names, values = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, values))  # languages x GRAMS floats, bounded by the number of languages

    def go(part: pa.RecordBatch) -> dict:
        names, values = shared.value
        share, letters = infer(part.column("text"), values)
        known = letters & bool(names)
        best = share.argmax(axis=0) if names else np.zeros(part.num_rows, int)
        pred = [names[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
        score = np.where(known, share[best, np.arange(len(best))] if names else 0.0, 0.0)
        share = share.T
        at = np.argwhere(share > 0)
        maps = pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((share > 0).sum(axis=1))]).astype(np.int32)), pa.array([names[j] for _, j in at], pa.string()), pa.array(share[share > 0], pa.float64()))
        return {"key": part.column("key"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.clip(score, 0, 1)), "langs": maps}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = max(1 << 16, K.CHUNK * 8 // max(8, len(names)))  # a slice has numbers for each of its words and each language
    return map_chunks(rows, go, f"key {kind}, lang_pred string, score double, langs map<string,double>", size=size).withColumnRenamed("key", key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(crc_mod("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("langs").alias("n_langs"))
