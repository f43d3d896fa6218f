"""Mixing sources to target weights by iterative proportional fitting.

The tokens of every (source, language, topic) cell are counted; raking scales the cells until their margins over source, language
and topic meet the targets; a document is then kept with the probability of its cell, fitted weight times budget over the cell's
tokens, by a hash of its key, so a rerun keeps the same documents. Values that no target names share one cell value,
OTHER, with the weight the named targets leave over, so the number of cells is bounded by the targets, not by the data:
the cell table may reach the driver and be broadcast. Raking takes ROUNDS rounds; if a margin is then missed by more than TOLERANCE, as
no weights of the cells that occur may meet all targets, a warning says so. By default the budget is the largest at which every probability is at most 1.
With a larger one, cells at 1 stay there and the others take up what they can't. ``share`` states the budget as a share of all
tokens: scarce cells are then kept whole, so one that holds few tokens doesn't set the size of the sample.

There is no topic column in the documents: the query takes a text's length class as its topic (note, article, long read).

Defined results: null source, language and topic are OTHER; a null or empty text has 0 tokens and is kept with the probability of its
cell (with ``share``, 1 in a cell without tokens, unless a target there is 0); targets of values that don't occur are shared out in proportion; repeated rows are kept or left out together; a null key hashes
as 'null'; extra columns pass through, but for those named as outputs, which are replaced.
"""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._spark import free, table

OTHER = "other"
ROUNDS, TOLERANCE = 40, 1e-3
SOURCES = {f"src{i}": 0.049 for i in range(20)}
LANGS = {"en": 0.4, "de": 0.19, "fr": 0.19, "es": 0.19}
TOPICS = {"note": 0.03, "article": 0.47, "long_read": 0.5}
TARGETS = {"source": SOURCES, "lang": LANGS, "topic": TOPICS}


def tokens(text: str | Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``, counted as the places where one starts."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_class(n: Column) -> Column:
    return F.when(n < 100, "note").when(n < 1000, "article").otherwise("long_read")


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of md5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(counts: np.ndarray, margins: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights (sum 1) in proportion to ``counts`` within, with the given margins on each axis (renormalised over what occurs)."""
    w = counts / max(counts.sum(), 1)
    axes = range(counts.ndim)
    for _ in range(rounds):
        for k in axes:
            have = w.sum(axis=tuple(j for j in axes if j != k))
            want = np.where(have > 0, margins[k], 0.0)
            scale = np.divide(want / max(want.sum(), 1e-300), have, out=np.zeros_like(have), where=have > 0)
            w = w * scale.reshape([-1 if j == k else 1 for j in axes])
    return w


def largest_gap(w: np.ndarray, margins: list[np.ndarray]) -> float:
    """How far the cell weights are from the margins, renormalised over what occurs: the largest difference on any axis."""
    gaps = []
    for k, m in enumerate(margins):
        have = w.sum(axis=tuple(j for j in range(w.ndim) if j != k))
        want = np.where(have > 0, m, 0.0)
        gaps.append(np.abs(have - want / max(want.sum(), 1e-300)).max())
    return float(max(gaps)) if w.sum() > 0 else 0.0


def probabilities(counts: np.ndarray, w: np.ndarray, budget: float | None) -> np.ndarray:
    """Of each cell. Without a budget, the largest that keeps all within 1."""
    ratio = np.divide(w, counts, out=np.zeros_like(w), where=counts > 0)
    if budget is None:
        return ratio / max(ratio.max(), 1e-300)
    full = np.zeros(counts.shape, bool)
    for _ in range(counts.size + 1):
        left = budget - counts[full].sum()
        free = w[~full].sum()
        p = np.where(full, 1.0, ratio * max(left, 0) / max(free, 1e-300))
        if (p <= 1).all():
            break
        full |= p >= 1
    return np.minimum(p, 1.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], key: str = "doc_id", weight: str = "n_tokens", budget: float | None = None, seed: int = 11, share: float | None = None) -> DataFrame:
    """``docs`` with probability (of its cell) and sampled (whether its hash falls below it). The columns named in ``targets`` give the cells.
    share: the budget as a share of all tokens, instead of ``budget``."""
    docs = docs.drop("probability", "sampled")
    values = {c: sorted(t) for c, t in targets.items()}
    cell = {c: F.when(F.col(c).isin(*v), F.col(c)).otherwise(OTHER) for c, v in values.items()}
    axes = {c: [*v, OTHER] for c, v in values.items()}
    place = {c: {v: i for i, v in enumerate(a)} for c, a in axes.items()}
    counts = np.zeros([len(a) for a in axes.values()])
    own = dict(zip(axes, free(docs, *axes), strict=True))  # the cell's values beside the user's columns
    keyed = docs.groupBy(*[e.alias(own[c]) for c, e in cell.items()]).agg(F.sum(weight).alias("n"))
    for r in keyed.collect():  # at most one row per combination of named targets
        counts[tuple(place[c][r[own[c]]] for c in axes)] = float(r["n"] or 0)
    margins = [np.array([targets[c].get(v, 0.0) if v != OTHER else max(0.0, 1 - sum(targets[c].values())) for v in a]) for c, a in axes.items()]
    w = rake(counts, margins)
    if (gap := largest_gap(w, margins)) > TOLERANCE:
        warnings.warn(f"after {ROUNDS} rounds the weights miss a target by {gap:.4f}: the targets can't all be met by the cells that occur", stacklevel=2)
    p = probabilities(counts, w, budget if share is None else share * counts.sum())
    if share is not None:
        p = np.where((counts == 0) & (reduce(np.multiply.outer, margins) > 0), 1.0, p)
    known = [(*vs, float(p[tuple(place[c][v] for c, v in zip(axes, vs, strict=True))])) for vs in product(*axes.values())]
    cells = docs.sparkSession.createDataFrame(known, ", ".join(f"`{own[c]}` string" for c in axes) + ", probability double")
    tagged = docs.withColumns({own[c]: e for c, e in cell.items()})
    out = tagged.join(F.broadcast(cells), list(own.values()), "left").drop(*own.values())
    return out.withColumn("sampled", uniform(key, seed) < F.col("probability"))


def with_cells(docs: DataFrame) -> DataFrame:
    """Token count and topic of each document."""
    return docs.withColumn("n_tokens", tokens("text")).withColumn("topic", length_class(F.col("n_tokens")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_cells(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return mix(docs, TARGETS).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def _oracle() -> str:
    def named(c: str) -> str:
        return f"CASE WHEN {c} IN ({', '.join(repr(v) for v in TARGETS[c])}) THEN {c} ELSE '{OTHER}' END AS c_{c}"

    t = "CASE WHEN n < 100 THEN 'note' WHEN n < 1000 THEN 'article' ELSE 'long_read' END"
    out = [rf"WITH RECURSIVE d AS MATERIALIZED (SELECT *, {t} AS topic FROM (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents))"]
    out.append(f"e AS MATERIALIZED (SELECT *, {named('source')}, {named('lang')}, {named('topic')} FROM d)")
    out.append("r0 AS MATERIALIZED (SELECT c_source, c_lang, c_topic, sum(n)::DOUBLE AS n, sum(n)::DOUBLE / (SELECT sum(n) FROM e) AS w FROM e GROUP BY 1, 2, 3)")
    for c, t in TARGETS.items():
        rows = ", ".join(f"('{v}', {x!r}::DOUBLE)" for v, x in [*t.items(), (OTHER, max(0.0, 1 - sum(t.values())))])
        out.append(f"t_{c} AS MATERIALIZED (SELECT v, x / sum(x) OVER () AS x FROM (VALUES {rows}) AS s(v, x) WHERE v IN (SELECT c_{c} FROM r0 WHERE n > 0))")
    k = 0
    for _ in range(ROUNDS):
        for c in TARGETS:
            rows = f"(SELECT *, sum(w) OVER (PARTITION BY c_{c}) AS h FROM r{k}) LEFT JOIN t_{c} ON v = c_{c}"
            out.append(f"r{k + 1} AS MATERIALIZED (SELECT c_source, c_lang, c_topic, n, CASE WHEN h > 0 THEN w * x / h ELSE 0 END AS w FROM {rows})")
            k += 1
    out.append(f"p AS (SELECT c_source, c_lang, c_topic, CASE WHEN n > 0 THEN w / n ELSE 0 END / (SELECT max(w / n) FROM r{k} WHERE n > 0) AS p FROM r{k})")
    u = "('0x' || substr(md5('11:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return ", ".join(out) + f" SELECT doc_id, source, lang, topic, n AS n_tokens, round(p, 6) AS probability, {u} < p AS sampled FROM e JOIN p USING (c_source, c_lang, c_topic)"


ORACLE_SQL = _oracle()
