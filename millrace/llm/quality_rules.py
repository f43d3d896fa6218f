"""Quality rules by line-first cleaning.

Every line that holds a word is judged by itself: *punctuation* (more than one symbol or exclamation per two
words, or mostly capitals, from MIN_WORDS words on), *navigation* (two or more separators standing alone, at
least a third of the line's words) and *boilerplate* (many texts hold the same line). Failing lines are removed, and
a document that loses more than MAX_LOSS_PERCENT of its word characters is rejected. The base counts and their
thresholds come first; they look at the whole text, as words of ``[^\\x20\\x09-\\x0D]+``.

Boilerplate is learned from the table itself, in whatever language: a line, without the white space around it, is boilerplate if it occurs in
MIN_CONTEXTS contexts or more and in SHARE of the table's number of lines or more. A context is the pair of the lines before and after it, so
that a text copied a thousand times doesn't make its lines boilerplate: they have one context. Contexts are counted over all
lines, by digest, with map-side combining; as each of them is a line, at most 1 / SHARE digests can reach the driver and be broadcast.

Defined results: a null or empty text has no words, so all counts are 0 and it fails the base; repeated rows
are judged alike; lines end at ``\\n`` only; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import cut, map_chunks, table

MIN_WORDS = 3
MAX_LOSS_PERCENT = 40
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
SEPARATORS = "|/\\>»›•·"
MIN_CONTEXTS, SHARE = 20, 1e-4


def _upper() -> np.ndarray:
    return K.lower_map() != np.arange(len(K.lower_map()))


def _total(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _lines(word: np.ndarray, cps: np.ndarray, off: np.ndarray, ws: np.ndarray, we: np.ndarray) -> dict:
    """Lines that hold a word: row, s and e (code points), a and b (words), h (digest of what stands from its first word to its last)."""
    s, e, lines = K.runs(cps != 10, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(lines))
    a, b = np.searchsorted(ws, s), np.searchsorted(ws, e)
    full = b > a
    s, e, row, a, b = s[full], e[full], row[full], a[full], b[full]
    return {"s": s, "e": e, "row": row, "a": a, "b": b, "h": K.span_hashes(cps, ws[a], we[b - 1])}


def contexts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of each line that holds a word, and of the pair of lines around it."""
    cps, off = K.codepoints(text)
    word = K.nonspace_mask()[cps]
    ws, we, _ = K.runs(word, off)
    x = _lines(word, cps, off, ws, we)
    h, row = x["h"], x["row"]
    before, after = np.zeros_like(h), np.zeros_like(h)
    if len(h):
        same = row[1:] == row[:-1]
        before[1:][same], after[:-1][same] = h[:-1][same], h[1:][same]
    return h, K.mix(before + np.uint64(1)) ^ K.mix(K.mix(after + np.uint64(2)))


def boilerplate(docs: DataFrame, text: str = "text", least: int = MIN_CONTEXTS, share: float = SHARE) -> np.ndarray:
    """Sorted digests of the lines that are boilerplate in ``docs``: at most 1 / share of them."""

    def go(part: pa.RecordBatch) -> dict:
        h, c = contexts(part.column("text"))
        _, once, n = np.unique(K.mix(h ^ K.mix(c)), return_index=True, return_counts=True)
        return {"h": pa.array(h[once].view(np.int64)), "c": pa.array(c[once].view(np.int64)), "n": pa.array(n)}

    each = map_chunks(docs.select(F.col(text).alias("text")).where("text IS NOT NULL"), go, "h long, c long, n long").groupBy("h", "c").agg(F.sum("n").alias("n"))
    count = cut(each.groupBy("h").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")))
    total = count.agg(F.sum("n").alias("n")).first()["n"] or 0
    got = count.where(F.col("contexts") >= max(least, share * total)).select("h").toArrow().column("h").to_numpy()
    return np.sort(got.view(np.uint64))


def measure(text: pa.Array, common: np.ndarray) -> dict:
    """Counts and verdicts of every row, and ``bad``, (row, start, end) of each removed line in code points. common: digests of boilerplate."""
    cps, off = K.codepoints(text)
    rows = len(off) - 1
    word = K.nonspace_mask()[cps]
    ws, we, words = K.runs(word, off)
    n_words = np.diff(words)
    chars, symbols = _total(word), K.among(cps, SYMBOLS)

    lines = _lines(word, cps, off, ws, we)
    ls, le, row, a, b = (lines[k] for k in ("s", "e", "row", "a", "b"))
    n = b - a
    h = K.span_hashes(cps, ls, le)
    key = K.mix(h ^ K.mix(row.astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(key, return_index=True)
    dup = np.bincount(row, minlength=rows) - np.bincount(row[once], minlength=rows)

    w5, wrow, first = K.window_hashes(K.span_hashes(cps, ws, we), words, 5)
    wkey = K.mix(w5 ^ K.mix(wrow.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(wkey)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = wkey[order][1:] == wkey[order][:-1]
    found = first[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(ws) + 6, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + 5, -1)
    repeat = K.row_sums(np.cumsum(cover)[: len(ws)] > 0, words)

    def per_line(mask: np.ndarray) -> np.ndarray:
        t = _total(mask)
        return t[le] - t[ls]

    lone = _total((we - ws == 1) & K.among(cps[ws], SEPARATORS))
    seps = lone[b] - lone[a]
    loud = per_line(symbols) + per_line(K.among(cps, MARKS))
    capital = 2 * per_line(_upper()[cps]) > per_line(K.letter_mask()[cps])
    punctuation = (n >= MIN_WORDS) & ((2 * loud > n) | capital)
    navigation = (seps >= 2) & (3 * seps >= n)
    found_ = lines["h"]
    boiler = common[np.minimum(np.searchsorted(common, found_), len(common) - 1)] == found_ if len(common) else np.zeros(len(ls), bool)
    bad = punctuation | navigation | boiler
    word_chars = chars[off[1:]] - chars[off[:-1]]
    lost = np.zeros(rows, np.int64)
    np.add.at(lost, row[bad], chars[le[bad]] - chars[ls[bad]])
    base = (n_words < 10) | (100 * repeat > 20 * n_words)
    count = lambda m: np.bincount(row[m], minlength=rows)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": K.row_sums(symbols, off), "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base,
        "kept": ~base & (100 * lost <= MAX_LOSS_PERCENT * word_chars), "chars_removed": lost, "lines_punctuation": count(punctuation), "lines_navigation": count(navigation), "lines_boilerplate": count(boiler),
        "bad": (row[bad], ls[bad] - off[row[bad]], le[bad] - off[row[bad]]),
    }


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, common: np.ndarray | None = None) -> DataFrame:
    """One row per document: key, base counts, base_failed, kept, chars_removed, failed lines by rule, and (with_text)
    clean_text: the text without the lines that failed. common: boilerplate learned elsewhere; otherwise it is learned from ``docs``.
    One narrow pass beside the learning; no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(boilerplate(docs, text) if common is None else common)
    kind = docs.schema[key].dataType.simpleString()

    def go(part: pa.RecordBatch) -> dict:
        out = measure(part.column("text"), shared.value)
        row, s, e = out.pop("bad")
        got = {"key": part.column("key")} | {k: pa.array(v) for k, v in out.items()}
        if with_text:
            texts = part.column("text").to_pylist()
            for r in np.unique(row):
                cut = set(zip(s[row == r], e[row == r], strict=True))
                at, keep = 0, []
                for line in texts[r].split("\n"):
                    if (at, at + len(line)) not in cut:
                        keep.append(line)
                    at += len(line) + 1
                texts[r] = "\n".join(keep)
            got["clean_text"] = pa.array(texts, pa.string())
        return got

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_removed long, lines_punctuation long, lines_navigation long, lines_boilerplate long"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_chunks(rows, go, f"key {kind}, {counts}" + ", clean_text string" * with_text).withColumnRenamed("key", key)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


_W = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2) GROUP BY 1),
l0 AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)),
l1 AS (SELECT doc_id, i, x, regexp_extract_all(x, {_W}) AS w FROM l0),
l2 AS MATERIALIZED (SELECT doc_id, i, x, len(w) AS n, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) + length(regexp_replace(x, '[^!?]', '', 'g')) AS loud,
  length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS letters,
  len(list_filter(w, lambda y: y IN ('|', '/', '\', '>', '»', '›', '•', '·'))) AS seps,
  regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS y FROM l1 WHERE len(w) > 0),
c AS (SELECT y, lag(y, 1, '') OVER o AS p, lead(y, 1, '') OVER o AS q FROM l2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
bp AS (SELECT y AS common FROM (SELECT y, count(*) AS k FROM (SELECT DISTINCT y, p, q FROM c) GROUP BY 1) WHERE k >= greatest({MIN_CONTEXTS}, {SHARE} * (SELECT count(*) FROM l2))),
l3 AS (SELECT l2.*, common IS NOT NULL AS boiler, n >= {MIN_WORDS} AND (2 * loud > n OR 2 * up > letters) AS punct, seps >= 2 AND 3 * seps >= n AS nav FROM l2 LEFT JOIN bp ON y = common),
l4 AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, sum(CASE WHEN punct OR nav OR boiler THEN chars ELSE 0 END) AS lost, count(*) FILTER (WHERE punct) AS lp, count(*) FILTER (WHERE nav) AS ln, count(*) FILTER (WHERE boiler) AS lb FROM l3 GROUP BY 1),
a AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS chars_removed, coalesce(lp, 0) AS lines_punctuation, coalesce(ln, 0) AS lines_navigation, coalesce(lb, 0) AS lines_boilerplate
  FROM d LEFT JOIN l4 USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * chars_removed <= {MAX_LOSS_PERCENT} * word_chars AS kept, chars_removed::BIGINT AS chars_removed, lines_punctuation::BIGINT AS lines_punctuation, lines_navigation::BIGINT AS lines_navigation, lines_boilerplate::BIGINT AS lines_boilerplate FROM b
"""
