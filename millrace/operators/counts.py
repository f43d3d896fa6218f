"""Counts over words, lines and neighbouring words.

Tokens are projected once, as a column of their own, wherever an expression reads them more than once. Every count is an aggregate with map-side combining, so a frequent word is summed before it is shuffled. Totals come back by
equi-join, never by a window over one word's rows, so a frequent word's rows can be split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import planes
from millrace.functions import text as T
from millrace.functions.grouped import whole_groups
from millrace.operators import stripes as S
from millrace.plans.lineage import cut

TOTAL = "*"
#: Different pairs that the batches of a slice of lines hold, or are summed, at once; pairs of a batch that is written.
BIGRAMS, AT_ONCE = 4 << 20, 1 << 18


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of every normalised token."""
    return T.each(docs, T.tokens(text), "word").groupBy("word").agg(F.count("*").alias("n"))


def _sets(lines: DataFrame, line: str) -> DataFrame:
    return lines.select(F.array_distinct(T.capped_tokens(line)).alias("t"))


def line_frequency(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word, n): lines that hold the word among their capped tokens."""
    return T.each(_sets(lines, line), F.col("t"), "word").groupBy("word").agg(F.count("*").alias("n"))


def line_total(lines: DataFrame) -> DataFrame:
    """One row (word '*', n): all lines, blank ones included."""
    return lines.agg(F.count("*").alias("n")).select(F.lit(TOTAL).alias("word"), "n")


def line_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Line frequencies with the total as row '*'."""
    return line_frequency(lines, line).unionByName(line_total(lines))


def _vectors(slices: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """Vectors of the pairs of words that share min_count lines or more, each pair once."""
    return S.counted(S.blocks(slices, words, min_count), lambda vectors: S.kept(vectors, min_count))


def _pairs(slices: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(x, nx, y, ny, n) of the pairs of words that share min_count lines or more, each pair once."""
    return T.each(S.named(_vectors(slices, words, min_count), words), F.col("with_"), "p", "x", "nx").select("x", "nx", "p.y", "p.ny", "p.n")


def cooccurrence(lines: DataFrame, line: str = "line", min_count: int = 1) -> DataFrame:
    """(x, y, n) for x < y: lines that hold both, of pairs that share min_count lines or more. The other order has the same count and
    is added where it is asked for."""
    slices = S.sliced(lines, line)
    return _pairs(slices, S.numbered(S.frequency(slices)), min_count).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n")


def pmi_pairs(lines: DataFrame, line: str = "line", frequencies: DataFrame | None = None, min_count: int = 1) -> DataFrame:
    """(x, y, n, pmi) for both orders of every pair of words that share a line: log10 of n * lines / (n(x) * n(y)).

    frequencies: line_counts of the same lines, if they were kept; a word of the lines that isn't in it fails the query.
    min_count: pairs that share fewer lines are left out.
    """
    slices = S.sliced(lines, line)
    words = S.numbered(S.frequency(slices) if frequencies is None else frequencies.where(F.col("word") != TOTAL))
    total = slices.agg(F.sum("lines").alias("total_lines")) if frequencies is None else frequencies.where(F.col("word") == TOTAL).agg(F.max("n").alias("total_lines"))
    got = _pairs(slices, words, min_count).crossJoin(F.broadcast(total))  # one row
    pmi = F.log10(F.col("n") * F.col("total_lines") / (F.col("nx") * F.col("ny")))
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return T.each(got.select(both.alias("both"), "n", pmi.alias("pmi")), F.col("both"), "o", "n", "pmi").select("o.x", "o.y", "n", "pmi")


def pmi_profile(lines: DataFrame, line: str = "line") -> DataFrame:
    """(x, partners, together, highest, lowest): each word's stripe of all its partners, summed up."""
    slices = S.sliced(lines, line)
    words = S.numbered(S.frequency(slices))
    return S.profile(S.blocks(slices, words), words, slices.agg(F.sum("lines")).first()[0] or 0)


def pmi_stripes(pairs: DataFrame) -> DataFrame:
    """(x, stripe): a map of each partner to its pmi. A stripe is as long as the word's vocabulary of partners."""
    return pairs.groupBy("x").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "pmi")))).alias("stripe"))


def pmi_stripes_of(lines: DataFrame, line: str = "line", min_count: int = 1) -> DataFrame:
    """``pmi_stripes`` of lines. A word's partners meet as numbers, and are named there."""
    slices = S.sliced(lines, line)
    words = S.numbered(S.frequency(slices))
    got = S.named(S.mirrored(_vectors(slices, words, min_count)), words).crossJoin(F.broadcast(slices.agg(F.sum("lines").alias("total_lines"))))  # one row
    pmi = F.transform("with_", lambda p: F.struct(p["y"], F.log10(p["n"] * F.col("total_lines") / (F.col("nx") * p["ny"]))))
    return got.select("x", F.map_from_entries(pmi).alias("stripe"))


def _slices_of_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, x, y, n) of slices of lines (t: tokens): how often one word, by its place in ``words``, follows another in their lines, in order of (x, y)."""

    def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[at], np.add.reduceat(n[order], at)

    def of_slice(held: list) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        chunks = pa.chunked_array([c for h in held for c in h[:2]]).unify_dictionaries().chunks
        x, y = (np.concatenate([c.indices.to_numpy() for c in chunks[i::2]]).astype(np.int64) for i in (0, 1))
        words = chunks[0].dictionary
        key, n = summed(x * len(words) + y, np.concatenate([h[2] for h in held]))
        return words, *np.divmod(key, len(words)), n

    held, size = [], 0
    for batch in batches:
        lists = batch.column("t")
        off = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        if len(words) < 2:
            continue
        code, of = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        follows = np.ones(len(code), bool)
        follows[(off[1:] - off[0])[np.diff(off) > 0] - 1] = False  # a line's last word
        at = np.flatnonzero(follows)
        key, n = np.unique(code[at] * of + code[at + 1], return_counts=True)
        if len(key):
            held.append((*(pa.DictionaryArray.from_arrays(pa.array(c.astype(np.int32)), words.dictionary) for c in np.divmod(key, of)), n))
            size += len(key)
        if size >= BIGRAMS:
            yield of_slice(held)
            held, size = [], 0
    if held:
        yield of_slice(held)


def _tokens_of(lines: DataFrame, line: str) -> DataFrame:
    return lines.where(F.col(line).isNotNull()).select(T.tokens(line).alias("t"))


def bigrams(lines: DataFrame, line: str = "line") -> DataFrame:
    """(w1, w2, n): adjacent tokens within a line. Slices of lines are counted in arrays, so that a pair is a row once a slice and not once a place."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, x, y, n in _slices_of_bigrams(batches):
            for lo in range(0, len(n), AT_ONCE):
                yield pa.RecordBatch.from_pydict({"w1": words.take(pa.array(x[lo : lo + AT_ONCE])), "w2": words.take(pa.array(y[lo : lo + AT_ONCE])), "n": pa.array(n[lo : lo + AT_ONCE])})

    return _tokens_of(lines, line).mapInArrow(go, "w1 string, w2 string, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def bigram_marginals(counts: DataFrame) -> DataFrame:
    """(w1, total): tokens that another follows in their line."""
    return counts.groupBy("w1").agg(F.sum("n").alias("total"))


def bigram_pairs(counts: DataFrame, with_marginals: bool = True) -> DataFrame:
    """(w1, w2, value, is_marginal): relative frequency of w2 after w1; marginal rows hold the count itself, with w2 '*'."""
    counts = cut(counts)  # written once: the totals and the pairs would each count the lines' bigrams
    total = bigram_marginals(counts)
    ratio: Column = F.col("n") / F.col("total")
    out = counts.join(total, "w1").select("w1", "w2", ratio.alias("value"), F.lit(False).alias("is_marginal"))
    if not with_marginals:
        return out
    return out.unionByName(total.select("w1", F.lit(TOTAL).alias("w2"), F.col("total").cast("double").alias("value"), F.lit(True).alias("is_marginal")))


def bigram_stripes(counts: DataFrame) -> DataFrame:
    """(w1, total, stripe): a map of each following word to its relative frequency."""
    got = counts.groupBy("w1").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("w2", "n"))).alias("s"))
    return got.select("w1", "total", F.map_from_entries(F.transform("s", lambda e: F.struct(e["w2"], e["n"] / F.col("total")))).alias("stripe"))


def bigram_stripes_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """``bigram_stripes`` of lines. A slice of lines writes for each word those that follow it, as one row; a word's rows meet once and are summed there."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, x, y, n in _slices_of_bigrams(batches):
            for lo, hi in S._cuts(x, AT_ONCE):
                off = np.concatenate(([0], np.flatnonzero(np.diff(x[lo:hi])) + 1, [hi - lo])).astype(np.int64)
                w2 = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), words.take(pa.array(y[lo:hi])))
                yield pa.RecordBatch.from_pydict({"w1": words.take(pa.array(x[lo:hi][off[:-1]])), "m": pa.array(np.diff(off)), "w2": pc.binary_join(w2, " "), "ns": planes.pack(n[lo:hi], off)})  # no token holds a space

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["w1"], "m", BIGRAMS):
            m = batch.column("m").to_numpy()
            words = pc.split_pattern(batch.column("w2"), " ").flatten().dictionary_encode()
            by_name = pc.sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(by_name), np.int64)
            place[by_name] = np.arange(len(by_name))
            group = np.repeat(np.cumsum(np.bincount(starts, minlength=len(m))) - 1, m)
            key = group * len(place) + place[words.indices.to_numpy()]
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.add.reduceat(planes.unpack(batch.column("ns"), m)[order], at)
            group, name = np.divmod(key[at], len(place))
            off = np.searchsorted(group, np.arange(len(starts) + 1))
            total = np.add.reduceat(n, off[:-1])
            stripe = pa.MapArray.from_arrays(pa.array(off.astype(np.int32)), words.dictionary.take(pa.array(by_name[name])), pa.array(n / total[group]))
            yield pa.RecordBatch.from_pydict({"w1": batch.column("w1").take(pa.array(starts)), "total": pa.array(total), "stripe": stripe})

    vectors = _tokens_of(lines, line).mapInArrow(go, "w1 string, m long, w2 string, ns binary")
    return vectors.repartition("w1").sortWithinPartitions("w1").mapInArrow(merge, "w1 string, total long, stripe map<string, double>")
