"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of symbols and rewritten by five transducers, composed with one another:

* *insult* reads the characters of a word. It accepts a learned word whole, or a learned stem of 4 to 8 letters with any ending, and
  writes ``insult`` with the lexeme's weight; any other word is written as the class that GRAMMAR_WORDS gives it, or ``word``.
* *target* comes in two parts, as an insult may stand on either side of the person it is aimed at. ``address`` reads a clause from its
  end and marks insults that a person follows within TARGET_REACH words; ``aimed`` reads it from its start and gives TARGET_FACTOR to those
  marked and to those that follow a person within as many.
* *threat* reads a verb and then its object: a person within THREAT_REACH words after the verb, or an object pronoun that stands as far
  before it ("te", "dich"). "He beat the egg" has no object that is a person, "you burn it" none after the verb.
* *negation* gives NEGATED to a hit within NEGATION_REACH words after a negation; *report* gives REPORTED to one after a verb of saying, or
  between quotation marks.

The composed machine gives every hit a factor; a clause scores the sum of factor times weight (of a threat THREAT_WEIGHT), a text the
sum of its clauses. The probability is a logistic curve over log(1 + score), so it grows with every clause.

The insult lexemes and their weights are learned from labelled rows: a lexeme enters if most labelled rows that hold it are toxic, more than
chance would make any of so many, and it explains toxic rows that no lexeme before it explains, one in 500 at least, so words
that merely stand beside an insult don't enter, and there can't be more than 500; and then words in hardly a clean row, as common as a
quarter of the usual one of these. The curve is fitted on the same rows. Fitting uses a sample of at most about SAMPLE_ROWS labelled
rows, drawn by hash, and one row of those that are near copies; scoring covers all rows and whole texts. Words are the same runs of
letters, marks and numbers in learning and in scoring.

Defined results: a null or empty text has no clause and gets the score of an empty clause; with no labels, or no toxic one, the
lexicon is empty and the curve is a given one, by which a plain threat scores 0.5; labels that are null are left out; several labels of one key count as
their maximum; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import crc_mod, cut, map_chunks, table
from millrace.llm.jaccard_join import shingles

SAMPLE_ROWS = 30_000
STEMS = (4, 5, 6, 7, 8)
CHANCE = 100
TARGET_REACH, TARGET_FACTOR = 4, 1.5
THREAT_REACH, THREAT_WEIGHT = 3, 1.0
NEGATION_REACH, NEGATED, REPORTED = 5, 0.25, 0.5

#: The closed classes of the grammar, in four languages; a caller may give others.
GRAMMAR_WORDS = {
    "person": "you your yours yourself yourselves u him her them himself herself themselves du dir dein deine ihr ihm ihnen tu toi ton tes votre lui eux tú usted ustedes vosotros",
    "object": "dich euch ihn te vous os",
    "negation": "not no never none nobody without isn aren wasn don doesn nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun nunca ni sin jamás",
    "report": "said says say saying told tells wrote writes claimed claims called quoted reported sagte sagt schrieb behauptete nannte dit disait écrit affirme déclare dijo dice escribió afirma declaró",
    "verb": "kill hurt destroy beat punch stab shoot burn töten umbringen verprügeln erschießen tuer frapper égorger matar golpear apuñalar",
}


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over token classes; step: (state, symbol) -> (state, symbol, factor)."""

    start: object
    step: dict
    symbols: tuple

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads. Factors multiply."""
        start, step, todo = (self.start, other.start), {}, deque()
        seen = {start}
        todo.append(start)
        while todo:
            a, b = state = todo.popleft()
            for x in self.symbols:
                a2, y, w = self.step[a, x]
                b2, z, v = other.step[b, y]
                step[state, x] = ((a2, b2), z, w * v)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, step, self.symbols)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """What is written for each symbol, and its factor."""
        state, out = self.start, []
        for x in symbols:
            state, y, w = self.step[state, x]
            out.append((y, w))
        return out


SYMBOLS = ("word", "insult", "addressed", "threat", "person", "object", "negation", "report", "verb", "quote")
HITS = ("insult", "addressed", "threat")
PEOPLE = ("person", "object")


def address(reach: int = TARGET_REACH) -> Transducer:
    """From the end of a clause to its start: an insult that a person follows is written ``addressed``."""
    step = {}
    for left in range(reach + 1):
        for x in SYMBOLS:
            step[left, x] = (reach if x in PEOPLE else max(0, left - 1), "addressed" if x == "insult" and left else x, 1.0)
    return Transducer(0, step, SYMBOLS)


def threat(reach: int = THREAT_REACH) -> Transducer:
    """A verb and the person after it, or the object pronoun before it: the later of the two is written ``threat``. A verb makes one at most."""
    step = {}
    for verb in range(reach + 1):
        for before in range(reach + 1):
            for x in SYMBOLS:
                y = "threat" if (x in PEOPLE and verb) or (x == "verb" and before) else x
                after = 0 if y == "threat" else reach if x == "verb" else max(0, verb - 1)
                step[(verb, before), x] = ((after, 0 if y == "threat" else reach if x == "object" else max(0, before - 1)), y, 1.0)
    return Transducer((0, 0), step, SYMBOLS)


def negation(reach: int = NEGATION_REACH, factor: float = NEGATED) -> Transducer:
    step = {}
    for left in range(reach + 1):
        for x in SYMBOLS:
            step[left, x] = (reach if x == "negation" else max(0, left - 1), x, factor if x in HITS and left else 1.0)
    return Transducer(0, step, SYMBOLS)


def report(factor: float = REPORTED) -> Transducer:
    step = {}
    for said in (0, 1):
        for quoted in (0, 1):
            for x in SYMBOLS:
                step[(said, quoted), x] = ((said or int(x == "report"), quoted ^ (x == "quote")), x, factor if x in HITS and (said or quoted) else 1.0)
    return Transducer((0, 0), step, SYMBOLS)


def aimed(reach: int = TARGET_REACH, factor: float = TARGET_FACTOR) -> Transducer:
    step = {}
    for left in range(reach + 1):
        for x in SYMBOLS:
            step[left, x] = (reach if x in PEOPLE else max(0, left - 1), x, factor if x == "addressed" or (x == "insult" and left) else 1.0)
    return Transducer(0, step, SYMBOLS)


ADDRESS = address()
GRAMMAR = aimed().then(threat()).then(negation()).then(report())
ENDS, QUOTES = ".!?;:\n", "\"“”«»"


def clause_score(symbols: list[str], weights: list[float]) -> float:
    """Of one clause: the composed machine over it, from its end and then from its start."""
    marked = [y for y, _ in ADDRESS.run(symbols[::-1])][::-1]
    return sum(f * (THREAT_WEIGHT if y == "threat" else w) for (y, f), w in zip(GRAMMAR.run(marked), weights, strict=True) if y in HITS)


@dataclass
class Model:
    """Weights of words and of stems (those end in ``*``), and the curve; by the one given here a score of 1 has probability 0.5."""

    words: dict[str, float]
    slope: float = 4 / math.log(2)
    bias: float = -4.0
    grammar: dict[str, str] = field(default_factory=lambda: GRAMMAR_WORDS)

    def read(self, word: str) -> tuple[str, float]:
        """The insult transducer: a word's characters one by one, to its symbol and weight. A whole word goes before a stem, a short stem
        before a longer one."""
        found, prefix = None, ""
        for c in word.lower():
            prefix += c
            if found is None and len(prefix) in STEMS:
                found = self.words.get(prefix + "*")
        weight = self.words.get(prefix, found)
        if weight is not None:
            return "insult", weight
        return next((s for s, words in self.grammar.items() if prefix in words.split()), "word"), 0.0

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(score), -30, 30)))


def _lexemes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, lexeme hash) of a slice, with a span to read the lexeme from: row, hash, start, end, cps."""
    cps, off = K.codepoints(part.column("text"))
    low = K.lower_map()[cps]
    s, e, words = K.runs(K.word_mask()[cps], off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(words))
    spans = [(row, s, e, K.span_hashes(low, s, e))]
    for n in STEMS:
        long = e - s >= n
        spans.append((row[long], s[long], s[long] + n, K.span_hashes(low, s[long], s[long] + n, seed=n)))
    r, a, b, h = (np.concatenate(x) for x in zip(*spans, strict=True))
    _, first = np.unique(K.mix(h ^ K.mix(r.astype(np.uint64))), return_index=True)
    kind = np.repeat([0, *STEMS], [len(x[0]) for x in spans])
    return r[first], h[first], a[first], b[first], kind[first], low


def sample_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y) of labelled documents: a hash draws at most about ``rows`` of them, so the sampled labels have a
    proven size and are broadcast."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = max(labels.count(), 1)
    if n > rows:
        one = one.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(one), "id")


def one_of_copies(sample: DataFrame) -> DataFrame:
    """Of sampled rows whose texts share their smallest five-word shingle, as near copies mostly do, the one with the smallest id: a text
    that was copied is one observation, not many."""

    def go(part: pa.RecordBatch) -> dict:
        w, off = shingles(part.column("text"))
        least = np.zeros(part.num_rows, np.uint64)
        full = np.diff(off) > 0
        least[full] = w[off[:-1][full]]
        return {c: part.column(c) for c in ("id", "text", "y")} | {"twin": pa.array(least.view(np.int64))}

    kind = sample.schema["id"].dataType.simpleString()
    tagged = map_chunks(sample, go, f"id {kind}, text string, y int, twin long")
    return tagged.groupBy("twin").agg(F.min(F.struct("id", "text", "y")).alias("r")).select("r.*")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexemes, their weights and the curve. All that reaches the driver comes from the bounded sample: counts of
    lexemes that at least 1 in 500 toxic rows hold, and which toxic rows hold them."""
    spark = docs.sparkSession
    sample = cut(one_of_copies(sample_labelled(docs, labels, key, text, label, rows)))
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad = total.get(1, 0)
    if not bad:
        return Model({})

    def positive(part: pa.RecordBatch) -> dict:
        r, h, a, b, kind, low = _lexemes(part)
        ids = K.span_hashes(*_whole(part)).view(np.int64)
        names = [low[x:y].tobytes().decode("utf-32-le", "replace") + ("*" if k else "") for x, y, k in zip(a, b, kind, strict=True)]
        return {"row": pa.array(ids[r]), "h": pa.array(h.view(np.int64)), "name": pa.array(names, pa.string())}

    toxic = sample.where("y = 1").select("text")
    held = map_chunks(toxic, positive, "row long, h long, name string", size=K.CHUNK // 4).distinct()
    least = max(4, bad // 500)
    common = held.groupBy("h").agg(F.count("*").alias("pos"), F.min("name").alias("name")).where(F.col("pos") >= least)
    cand = common.toPandas().sort_values("name", kind="stable").reset_index(drop=True)
    if cand.empty:
        return Model({})
    hashes = np.sort(cand["h"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(hashes)

    def negative(part: pa.RecordBatch) -> dict:
        _, h, *_ = _lexemes(part)
        h = h[_isin(h, shared.value)]
        found, n = np.unique(h, return_counts=True)
        return {"h": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))}

    neg = map_chunks(sample.where("y = 0").select("text"), negative, "h long, n long", size=K.CHUNK // 2).groupBy("h").agg(F.sum("n").alias("neg"))
    cand = cand.merge(neg.toPandas(), on="h", how="left").fillna({"neg": 0}).sort_values("name", kind="stable").reset_index(drop=True)
    cand = cand[(cand["pos"] >= 3 * cand["neg"]) & _beyond_chance(cand["pos"].to_numpy(), cand["neg"].to_numpy(), bad / sum(total.values()))].reset_index(drop=True)
    if cand.empty:
        return Model({})
    pure = np.sort(cand["h"].to_numpy().view(np.uint64))
    shared2 = spark.sparkContext.broadcast(pure)
    hold = map_chunks(toxic, lambda part: _held(part, shared2.value), "row long, h long", size=K.CHUNK // 2).distinct().toPandas()
    chosen = _cover(hold, cand, least)
    words = {}
    for i in chosen:
        p = (cand["pos"][i] + 0.5) / (cand["pos"][i] + cand["neg"][i] + 3.5)  # shrunk: few rows prove little
        words[cand["name"][i]] = float(2 * p - 1)
    model = Model(words)
    scored = score(sample.select("text", "y"), model, key="y", raw=True).groupBy("y", F.round("raw", 2).alias("raw")).agg(F.count("*").alias("n")).toPandas()
    model.bias, model.slope = _logistic(np.log1p(scored["raw"].to_numpy()), scored["y"].to_numpy(), scored["n"].to_numpy())
    return model


def _beyond_chance(pos: np.ndarray, neg: np.ndarray, rate: float) -> np.ndarray:
    """Whether so many toxic rows are no accident among as many lexemes: by Chernoff's bound, less than one in CHANCE of such a set would
    hold even one lexeme like it, if rows were toxic at ``rate`` whatever they hold."""
    n = pos + neg
    q, rate = pos / n, min(max(rate, 1e-9), 1 - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = q * np.log(q / rate) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - rate)), 0.0)
    return (q > rate) & (n * bits > np.log(CHANCE * len(pos)))


def _whole(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cps, off = K.codepoints(part.column("text"))
    return cps, off[:-1], off[1:]


def _isin(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h if len(among) else np.zeros(len(h), bool)


def _held(part: pa.RecordBatch, among: np.ndarray) -> dict:
    r, h, *_ = _lexemes(part)
    ids = K.span_hashes(*_whole(part))
    ok = _isin(h, among)
    return {"row": pa.array(ids[r[ok]].view(np.int64)), "h": pa.array(h[ok].view(np.int64))}


def _cover(hold, cand, least: int) -> list[int]:
    """Lexemes in the order of toxic rows newly explained (counted down by the share of clean rows), until fewer than ``least``
    are; ties go to whole words, then longer stems. Then the words that stand in many toxic rows, a quarter of the usual number
    of a lexeme chosen so far, and in hardly a clean one: rows that hold several insults explain each of them."""
    rows = np.unique(hold["row"].to_numpy(), return_inverse=True)[1]
    place = {h: i for i, h in enumerate(cand["h"])}
    lex = np.array([place[h] for h in hold["h"]])
    rank = np.array([(len(n) if n[-1] == "*" else 100 + len(n)) for n in cand["name"]])
    pos, neg = cand["pos"].to_numpy(), cand["neg"].to_numpy()
    pure = (pos + 0.5) / (pos + neg + 1)
    left, out = np.ones(len(rows), bool), []
    while True:  # each explains ``least`` rows that none before it does, so there are few
        new = np.bincount(lex[left], minlength=len(cand))
        gain = np.where(new >= least, new * pure, 0)
        if not gain.any():
            break
        ties = np.flatnonzero(gain >= gain.max() * 0.98)
        best = int(ties[np.argmax(rank[ties])])
        out.append(best)
        left &= ~np.isin(rows, rows[lex == best])
    if out:
        sure = (pos >= max(least, 0.25 * np.median(pos[out]))) & (100 * neg <= pos) & (rank > 100)
        out += [int(i) for i in np.flatnonzero(sure) if i not in set(out)]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic regression with a small ridge, by Newton steps."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + 1e-2 * w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


class Scorer:
    """Clause scores of texts. Every word's symbol comes from hashes of the word and its beginnings, for all texts of a slice at once; only
    clauses with an insult, or a verb that may threaten, are run through the machine."""

    def __init__(self, model: Model) -> None:
        self.model = model
        entries: dict[int, dict[int, tuple[int, float]]] = {n: {} for n in (0, *STEMS)}
        for symbol, words in model.grammar.items():
            for w in reversed(words.split()):
                entries[0].setdefault(int(self._hash(w)), (SYMBOLS.index(symbol), 0.0))
        for w, weight in model.words.items():
            entries[len(w) - 1 if w.endswith("*") else 0][int(self._hash(w))] = (SYMBOLS.index("insult"), weight)
        self.tables = {}
        for n, table_ in entries.items():
            known = np.array(sorted(table_), np.uint64)
            if len(known):
                bits = np.zeros(1 << 20, bool)
                bits[self._low(known)] = True
                self.tables[n] = (bits, known, np.array([table_[int(h)][0] for h in known]), np.array([table_[int(h)][1] for h in known]))

    @staticmethod
    def _hash(w: str) -> np.uint64:
        cps = np.frombuffer(w.rstrip("*").encode("utf-32-le"), np.uint32)
        return K.span_hashes(cps, np.array([0]), np.array([len(cps)]), seed=len(w) - 1 if w.endswith("*") else 0)[0]

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).astype(np.int64)

    def symbols(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol (its place in SYMBOLS) and weight of each word, as Model.read gives them."""
        symbol, weight = np.zeros(len(s), np.int64), np.zeros(len(s))
        insult = SYMBOLS.index("insult")
        for n in (*STEMS[::-1], 0):
            if n not in self.tables:
                continue
            bits, known, which, w = self.tables[n]
            at = np.flatnonzero(e - s >= max(n, 1))
            h = K.span_hashes(low, s[at], s[at] + n if n else e[at], seed=n)
            at, h = at[bits[self._low(h)]], h[bits[self._low(h)]]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = (known[place] == h) & ((which[place] == insult) | (symbol[at] != insult))
            symbol[at[ok]], weight[at[ok]] = which[place[ok]], w[place[ok]]
        return symbol, weight

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """The sum of every row, and (start, end, score) of its clauses that score."""
        cps, off = K.codepoints(text)
        rows = len(off) - 1
        raw, found = np.zeros(rows), [[] for _ in range(rows)]
        if not len(cps):
            return raw, found
        s, e, _ = K.runs(K.word_mask()[cps], off)
        symbol, weight = self.symbols(K.lower_map()[cps], s, e)
        ends = np.zeros(len(cps) + 1, bool)  # a clause starts behind each end, and with each row
        ends[1:] = K.among(cps, ENDS)
        ends[off] = True
        start = np.flatnonzero(ends)
        clause = np.cumsum(ends[:-1]) - 1
        live = np.isin(symbol, (SYMBOLS.index("insult"), SYMBOLS.index("verb")))
        asked = np.zeros(len(start) + 1, bool)
        asked[clause[s[live]]] = True
        quote = np.flatnonzero(K.among(cps, QUOTES))
        own, quote = np.flatnonzero(asked[clause[s]]), quote[asked[clause[quote]]]
        at = np.concatenate([s[own], quote])
        order = np.argsort(at, kind="stable")
        kinds = np.concatenate([symbol[own], np.full(len(quote), SYMBOLS.index("quote"))])[order]
        weights = np.concatenate([weight[own], np.zeros(len(quote))])[order]
        of = clause[at[order]]
        bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for i, j in pairwise(bounds.tolist()):
            total = clause_score([SYMBOLS[k] for k in kinds[i:j]], weights[i:j].tolist())
            if total > 0:
                a = int(start[of[i]])
                r = int(np.searchsorted(off, a, "right")) - 1
                b = int(start[of[i] + 1])
                b -= int(b < off[r + 1] or cps[b - 1] in self._ends)  # without the mark that ends it
                found[r].append((a - int(off[r]), b - int(off[r]), float(total)))
                raw[r] += total
        return raw, found

    _ends = frozenset(map(ord, ENDS))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", raw: bool = False) -> DataFrame:
    """One row per document: key, score (probability), n_clauses, spans of the matched clauses; with raw, also the plain sum.

    One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model))

    def go(part: pa.RecordBatch) -> dict:
        raw_, found = shared.value(part.column("text"))
        p = shared.value.model.probability(raw_)
        spans = pa.array([[{"start": a, "end": b, "score": w} for a, b, w in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
        out = {"key": part.column("key"), "score": pa.array(p), "n_clauses": pa.array([len(f) for f in found], pa.int32()), "spans": spans}
        return out | ({"raw": pa.array(raw_)} if raw else {})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = map_chunks(rows, go, f"key {kind}, score double, n_clauses int, spans array<struct<start:int,end:int,score:double>>" + ", raw double" * raw)
    return out.withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, in one narrow pass: texts are scored in place and rows filtered
    where they are read, so nothing is joined or shuffled."""
    rest = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    at = f"c{rest.index(text)}"
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))

    def go(batches):
        for batch in batches:
            for part in K.chunks(batch, at):
                raw, _ = shared.value(part.column(at))
                yield part.filter(pa.array(shared.value.model.probability(raw) < limit))

    return rows.mapInArrow(go, kinds).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
