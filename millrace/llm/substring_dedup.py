"""Substring dedup by hashing lines and what stands inside them.

Units are normalised (lower-cased runs of letters, marks and numbers) and digested to 128 bits; digests are grouped over all
documents, and the earliest occurrence, by the ranking columns and then by position, is kept; the others are removed, with their
offsets in the original text retained.

* A *line* that an earlier one equals is removed whatever its length.
* Passages also repeat inside lines, with other text around them. A line is therefore read as sentences, up to terminal punctuation;
  where a sentence holds a capitalised word after its first, its *tail* from there on is hashed as well, as a passage that
  begins within someone else's sentence begins with a tail. Consecutive repeated sentences (the first of them may be a tail), over line ends too, form a
  run, and one of RUN_WORDS words or more is removed. A shorter run that isn't a whole line stays: that two texts share "Yes." doesn't
  make it a passage. A repeated line of RUN_WORDS words or more is such a run, so only shorter lines have digests of their own.

What isn't found: the part of a passage before its first and after its last sentence end or capitalised word, and so a passage inside a line
that has neither.

Only digests are grouped, with map-side combining, so a unit that a third of all documents share is summed before it is shuffled;
what returns to a document is the list of units it is the first to hold. Nothing is joined on a digest.

Defined results: null and empty texts come back as they are; rows that agree in key and text are one row to the ranking and are
cut alike; null keys rank first; an emptied document stays as a row with an empty text; extra columns pass through, but for one named
as the output, which is replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import map_chunks, table

RUN_WORDS = 8
_LINE = 1 << 30  # places of lines are written as place - _LINE, beside those of sentences
STOPS = ".!?。！？\n"


@cache
def _upper() -> np.ndarray:
    return K.lower_map() != np.arange(len(K.lower_map()))


def units(text: pa.Array) -> dict:
    """Sentences, tails and short lines of every row. start: first word of each unit, counted over the slice; end: word after it;
    kind: 0 a sentence, 1 a tail, 2 a line; row; d1, d2: its digests; tail_of, line_of: the sentence a tail is in, or a line starts with.
    Words: ws, we (code points), per row; off: rows."""
    cps, off = K.codepoints(text)
    low = K.lower_map()[cps]
    ws, we, words = K.runs(K.word_mask()[cps], off)
    h = K.span_hashes(low, ws, we)
    stops = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(K.among(cps, STOPS), out=stops[1:])
    new = np.zeros(len(ws) + 1, bool)
    new[words] = True
    new = new[:-1]
    new[1:] |= stops[ws[1:]] > stops[we[:-1]]
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    last = np.append(first[1:], len(ws))
    tail = np.flatnonzero(~new & _upper()[cps[ws]])
    breaks = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(cps == 10, out=breaks[1:])
    begins = new.copy()
    begins[1:] &= breaks[ws[1:]] > breaks[we[:-1]]
    begins[words[:-1][np.diff(words) > 0]] = True
    line = np.flatnonzero(begins)
    line_end = np.append(line[1:], len(ws))
    short = line_end - line < RUN_WORDS
    line, line_end = line[short], line_end[short]
    start = np.concatenate([first, tail, line])
    end = np.concatenate([last, last[of[tail]], line_end])
    kind = np.repeat([0, 1, 2], [len(first), len(tail), len(line)])

    def digest(seed: int) -> np.ndarray:
        out = K.span_hashes(h, start, end, seed=seed)
        out[kind == 2] = K.mix(out[kind == 2] ^ np.uint64(0x5851F42D4C957F2D))  # a line isn't a sentence of the same words
        return out

    return {
        "start": start, "end": end, "kind": kind, "row": np.searchsorted(words, start, "right") - 1, "tail_of": of[tail], "line_of": of[line],
        "d1": digest(1), "d2": digest(2), "ws": ws, "we": we, "words": words, "off": off,
    }


def _digests(part: pa.RecordBatch) -> dict:
    u = units(part.column("text"))
    row = pa.array(u["row"])
    return {"d1": pa.array(u["d1"].view(np.int64)), "d2": pa.array(u["d2"].view(np.int64)), "key": part.column("key").take(row), "tie": part.column("tie").take(row), "at": pa.array((u["start"] - u["words"][u["row"]] - _LINE * (u["kind"] == 2)).astype(np.int32))}


def removals(text: pa.Array, firsts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Per row, (start, end, words) of each run to remove, in code points of the original text."""
    u = units(text)
    rows = len(text)
    won, won_line = np.zeros(len(u["ws"]) + 1, bool), np.zeros(len(u["ws"]) + 1, bool)
    size = np.diff(K.offsets_of(firsts))
    flat = firsts.flatten().to_numpy()
    base = np.repeat(u["words"][:-1], size)
    won[(flat + base)[flat >= 0]] = True
    won_line[(flat + _LINE + base)[flat < 0]] = True
    n = int((u["kind"] == 0).sum())
    first, last, row = u["start"][:n], u["end"][:n], u["row"][:n]
    line = u["kind"] == 2
    whole = np.zeros(n + 1, np.int64)  # sentences of repeated short lines
    again = ~won_line[u["start"][line]]
    np.add.at(whole, u["line_of"][again], 1)
    np.add.at(whole, np.searchsorted(first, u["end"][line][again]), -1)
    whole = np.cumsum(whole) > 0
    dup = ~won[first]
    lead = first.copy()  # where the removed part of a sentence starts: at its first word, or at its longest repeated tail
    tails = u["start"][u["kind"] == 1]
    again = ~won[tails] & ~dup[u["tail_of"]]
    has_tail = np.zeros(n, bool)
    for s, t in zip(u["tail_of"][again][::-1], tails[again][::-1], strict=True):
        lead[s], has_tail[s] = t, True
    part = dup | has_tail
    start_run = part & (has_tail | (np.arange(n) == 0))
    start_run[1:] |= part[1:] & (~part[:-1] | (row[1:] != row[:-1]))
    begin = np.flatnonzero(start_run)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    run = np.cumsum(start_run) - 1
    ends = np.zeros(len(begin), np.int64)
    np.maximum.at(ends, run[part], np.flatnonzero(part))
    for b, e in zip(begin, ends, strict=True):
        if last[e] - lead[b] >= RUN_WORDS:
            parts = [(b, e)]
        else:
            at = np.flatnonzero(whole[b : e + 1]) + b
            cut = np.flatnonzero(np.diff(at) > 1)
            parts = list(zip(at[np.append(0, cut + 1)], at[np.append(cut, -1)], strict=True)) if len(at) else []
        for x, y in parts:
            r = row[x]
            base = u["off"][r]
            stop = u["ws"][last[y]] if last[y] < u["words"][r + 1] else u["off"][r + 1]
            out[r].append((int(u["ws"][lead[x]] - base), int(stop - base), int(last[y] - lead[x])))
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its text column cut, and removed: array of (start, end, words) in the original text. The smallest key ranks first."""
    kind = docs.schema[key].dataType.simpleString()
    rank = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")).where("text IS NOT NULL")
    every = map_chunks(rank, _digests, f"d1 long, d2 long, key {kind}, tie long, at int")
    winner = every.groupBy("d1", "d2").agg(F.min(F.struct("key", "tie", "at")).alias("w")).select("w.*")
    firsts = winner.groupBy("key", "tie").agg(F.collect_list("at").alias("_firsts")).withColumnRenamed("key", "_key").withColumnRenamed("tie", "_tie")
    rest = [c for c in docs.columns if c not in (text, "removed")]
    whole = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(text).alias("tie"))
    both = whole.join(firsts, whole["key"].eqNullSafe(firsts["_key"]) & (whole["tie"] == firsts["_tie"]), "left")
    both = both.select(*[f"c{i}" for i in range(len(rest))], "text", F.coalesce("_firsts", F.array().cast("array<int>")).alias("firsts"))

    def go(part: pa.RecordBatch) -> dict:
        texts = part.column("text").to_pylist()
        gone = removals(part.column("text"), part.column("firsts"))
        for i, runs in enumerate(gone):
            if runs:
                at, keep = 0, []
                for a, b, _ in runs:
                    keep.append(texts[i][at:a])
                    at = b
                texts[i] = "".join(keep) + texts[i][at:]
        spans = pa.array([[{"start": a, "end": b, "words": w} for a, b, w in runs] for runs in gone], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])))
        return {f"c{i}": part.column(f"c{i}") for i in range(len(rest))} | {"text": pa.array(texts, pa.string()), "removed": spans}

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    out = map_chunks(both, go, f"{kinds}, text string, removed array<struct<start:int,end:int,words:int>>")
    names = {c: f"c{i}" for i, c in enumerate(rest)} | {text: "text"}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns if c in names], "removed")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ";")
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    return out.select("doc_id", "text", F.size("removed").alias("n_removed"), total.alias("chars_removed"), spans.alias("removed_spans"))
