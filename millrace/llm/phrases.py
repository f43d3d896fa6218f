"""Phrase collocations by contiguous pattern growth.

Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words between spaces and tabs. Candidates are
phrases of two to five words that a language holds LEAST times or more. They are grown from the left, as in PrefixSpan, and each
length only over what the length before has left alive:

* Roots: words and pairs of words are counted as Spark aggregates: each slice of texts sums up its own, and each task its slices', before
  they are shuffled, so a pair of any frequency is one row a task.
* Projection: the occurrences of frequent pairs are pointers into a slice's array of words. A pointer whose next pair is frequent too
  goes on to the right, up to five words; pointers with equal words to their right are one row with a count. These rows go to the task of
  their prefix of three words.
* Growth: a task has its prefixes' rows in order, and so every prefix's pointers side by side. It descends depth first: an interval is
  cut where the next word changes, each frequent part is a phrase, and is cut again. An interval that goes on in the next batch leaves behind
  only its sum, so a prefix of any number of rows is never held.

Which pairs are frequent is told to the slices by a bitmap of BITS bits, whatever the table's size. It may let a rare pair
pass, never loses a frequent one, and the sums decide; filled up by an endless number of pairs it would only let more rows pass.

A candidate is scored at its weakest cut (``scored``), goes if a longer one stands at all its places (a longer candidate with its count
implies one that is longer by a word at one of its ends, so only those are looked at), and each language's best K are kept.

Defined results: a null text is empty; a null language is ``und``, together with rows that say so; a row that occurs twice counts
twice; an empty table gives no row; other columns are ignored. Scores are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _kernels as K
from millrace.llm._spark import cut, map_chunks, table

LEAST, LONGEST, TOP = 100, 5, 2000
BITS = 1 << 26
SLICE = 1 << 20
BREAKS = ".,;:!?\n\x0b\x0c\r"
_U = np.uint64


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: lower case, whether it ends a piece, whether it belongs to a word."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    breaks = np.isin(low, np.frombuffer(BREAKS.encode(), np.uint8))
    return low, breaks, ~breaks & (low != 32) & (low != 9)


def _raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and each row's offset."""
    o = K.offsets(arr) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[o[0] : o[-1]] if len(arr) and arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, o - o[0]


def _strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The spans [s, e) of ``data`` as a string column."""
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=at[1:])
    index = np.repeat(s - at[:-1], e - s) + np.arange(at[-1])
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[index]))).cast(pa.string())


def _pair(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return K.mix(h * _U(0xC2B2AE3D27D4EB4F) + g)


class Words:
    """The words of a slice: row, digest h (of language and word), next (the word after it is in its piece), and data, s and e:
    the words as bytes with one space between them, so that a phrase is one span."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        low, breaks, word = _bytes()
        data, off = _raw(text)
        data = low[data]
        s, e, first = K.runs(word[data], off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        ldata, loff = _raw(lang)
        of_lang = K.span_hashes(ldata.astype(np.uint32), loff[:-1], loff[1:], seed=1)
        self.h = _pair(of_lang[self.row], K.span_hashes(data.astype(np.uint32), s, e))
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum(breaks[data], out=ends[1:])
        self.next = np.zeros(len(s), bool)
        self.next[:-1] = (self.row[1:] == self.row[:-1]) & (ends[s[1:]] == ends[e[:-1]])
        n = e - s
        self.s = np.cumsum(n + 1) - (n + 1)
        self.e = self.s + n
        self.data = np.full(int(n.sum()) + len(n), 32, np.uint8)
        self.data[np.repeat(self.s - s, n) + np.flatnonzero(word[data])] = data[word[data]]
        self.lang = lang

    def pairs(self) -> np.ndarray:
        """Digests of the pairs at ``next``."""
        at = np.flatnonzero(self.next)
        return _pair(self.h[at], self.h[at + 1])

    def rows(self, at: np.ndarray, words: np.ndarray | int, key: np.ndarray) -> dict:
        """Phrases of ``words`` words that begin at the words ``at``, those of equal ``key`` summed up."""
        _, once, n = np.unique(key, return_index=True, return_counts=True)
        i = at[once]
        k = words if isinstance(words, int) else words[once]
        return {"lang": self.lang.take(pa.array(self.row[i])), "phrase": _strings(self.data, self.s[i], self.e[i + k - 1]), "n": pa.array(n)}


class Known:
    """A bitmap of digests."""

    def __init__(self, index: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(BITS >> 6, _U)
        self.words[index] = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bit = h & _U(BITS - 1)
        return (self.words[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1


def known(pairs: DataFrame) -> Known:
    """The bitmap of (lang, phrase) rows of two words, put together by Spark: at most BITS / 64 numbers reach the driver."""

    def go(part: pa.RecordBatch) -> dict:
        bit = Words(part.column("phrase"), part.column("lang")).pairs() & _U(BITS - 1)
        return {"i": pa.array((bit >> _U(6)).view(np.int64)), "bits": pa.array((_U(1) << (bit & _U(63))).view(np.int64))}

    got = map_chunks(pairs.select("lang", "phrase"), go, "i long, bits long", "phrase").groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow()
    return Known(got.column("i").to_numpy(), got.column("bits").to_numpy().view(_U))


def roots_of(w: Words) -> dict:
    """A slice's words and pairs, and the number of words of each language (phrase null)."""
    row, n = np.unique(w.row, return_counts=True)
    total = {"lang": w.lang.take(pa.array(row)), "phrase": pa.nulls(len(row), pa.string()), "n": pa.array(n)}
    return joined(w.rows(np.arange(len(w.h)), 1, w.h), w.rows(np.flatnonzero(w.next), 2, w.pairs()), total)


def paths_of(w: Words, held: Known, longest: int = LONGEST) -> dict:
    """A slice's projection: at every held pair that another follows, the words to the right as far as pairs are held."""
    n = len(w.h)
    alive = np.zeros(n + longest, bool)
    alive[np.flatnonzero(w.next)[held(w.pairs())]] = True
    at = np.flatnonzero(alive[:n] & alive[1 : n + 1])
    size, key, going = np.full(len(at), 3), _pair(_pair(w.h[at], w.h[at + 1]), w.h[at + 2]), np.ones(len(at), bool)
    for k in range(3, longest):
        going &= alive[at + k - 1]
        key[going] = _pair(key[going], w.h[at[going] + k])
        size[going] = k + 1
    return w.rows(at, size, key)


def joined(*parts: dict) -> dict:
    return {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]}


def _counted(docs: DataFrame, fn) -> DataFrame:
    """(lang, phrase, n) by slices."""
    return map_chunks(docs, lambda part: fn(Words(part.column("text"), part.column("lang"))), "lang string, phrase string, n long", size=SLICE)


def grow(batches: Iterator[pa.RecordBatch], least: int, longest: int = LONGEST) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the phrases of three words or more that occur ``least`` times, from rows (lang, w1 .. w5, n) in order."""
    names = ["lang", *(f"w{i}" for i in range(1, longest + 1))]
    open_: dict[int, tuple[tuple, int]] = {}  # by depth, the interval that the last batch ended in: its words and its sum

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([f[0][0] for f in found], pa.string()), "phrase": pa.array([" ".join(f[0][1:]) for f in found], pa.string()), "n": pa.array([f[1] for f in found], pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).dictionary_encode() for c in names]
        codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
        upto = np.zeros(batch.num_rows + 1, np.int64)
        np.cumsum(batch.column("n").to_numpy(), out=upto[1:])
        path = lambda i, d: tuple(c[i].as_py() for c in columns[: d + 1])
        before, open_, found = open_, {}, []
        for d, (words, n) in sorted(before.items()):  # intervals that don't go on in this batch are done
            if path(0, d) != words:
                if n >= least:
                    found.append((words, n))
                del before[d]

        def extend(a: int, b: int, d: int) -> None:
            """The pointers [a, b) agree in d - 1 words: cut where word d changes, and go on within each part."""
            code = codes[d][a:b]
            starts = a + np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            ends = np.append(starts[1:], b)
            n = upto[ends] - upto[starts]
            if a == 0 and d in before:
                n[0] += before[d][1]
            worth = (codes[d][starts] >= 0) & ((n >= least) | (starts == 0) | (ends == batch.num_rows))
            for s, e, c in zip(starts[worth].tolist(), ends[worth].tolist(), n[worth].tolist(), strict=True):
                if e == batch.num_rows:
                    open_[d] = (path(s, d), c)
                elif c >= least:
                    found.append((path(s, d), c))
                if d < longest:
                    extend(s, e, d + 1)

        head = np.zeros(batch.num_rows, bool)
        head[0] = True
        for c in codes[:3]:
            head[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(head)
        for a, b in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
            extend(a, b, 3)
        if found:
            yield batch_of(found)
    if rest := [x for x in open_.values() if x[1] >= least]:
        yield batch_of(rest)


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of frequent phrases of one word or more, and (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    roots = cut(_counted(docs, roots_of).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least)))
    frequent, totals = roots.where("phrase IS NOT NULL"), roots.where("phrase IS NULL").select("lang", "n")
    held = docs.sparkSession.sparkContext.broadcast(known(frequent.where("phrase LIKE '% %'")))
    rows = _counted(docs, lambda w: paths_of(w, held.value, longest))
    dealt = rows.repartition("lang", F.substring_index("phrase", " ", 3)).withColumn("t", F.split("phrase", " "))
    words = [f"w{i + 1}" for i in range(longest)]
    ordered = dealt.select("lang", *[F.get("t", F.lit(i)).alias(w) for i, w in enumerate(words)], "n").sortWithinPartitions("lang", *words)
    grown = ordered.mapInArrow(lambda batches: grow(batches, least, longest), "lang string, phrase string, n long")
    return cut(frequent.unionByName(grown)), totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one stands for, at their weakest cut: floor(1000 a n / (l r)), of
    equal cuts the first."""
    t = F.split("phrase", " ")
    held = frequent.select("lang", "phrase", F.col("n").alias("a"), t.alias("t"), F.size(t).alias("m")).where("m > 1")
    inner = F.explode(F.array(F.slice("t", 1, F.col("m") - 1), F.slice("t", 2, F.col("m") - 1)))
    longer = held.where("m > 2").select("lang", inner.alias("inner"), "a").groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    held = held.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    cuts = held.select("lang", "phrase", "a", "t", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("t", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("t", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("right"))
    side = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: f"cast({c} AS decimal(38, 0))"
    score = F.expr(f"({big(1000)} * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "phrase", "a", "n").agg(least.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases. Spark limits each task's rows before they meet."""
    got = scored(*candidates(docs, least, lang=lang, text=text))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


_AZ = "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_AZ.upper()}', '{_AZ}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, m, array_to_string(w[j:j + m - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM w, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM g WHERE m > 1 AND a >= {LEAST}),
q AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
k AS (SELECT *, string_split(phrase, ' ') AS t, unnest(range(1, m)) AS k FROM q),
s AS (SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM k JOIN n ON n.lang = k.lang
  JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(t[1:k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(t[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {TOP}
"""
