"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Every segmentation of a text into vocabulary pieces is a path through its piece lattice, weighted by the product of its pieces'
probabilities. Forward filtering sums the weights of all paths to each position; backward sampling then draws a path from
the end, each piece with its exact posterior probability. The numbers drawn depend on the row's key, the seed and the position
alone, so a row has one segmentation whatever batch, task or cluster reads it. With ``alpha`` the weights are sharpened (large) or
levelled (towards 0).

The vocabulary is a given SentencePiece model; a piece's probability follows the rank it has there (1 / (rank + 2)). A
space is the piece mark; a mark that stands in the text itself, and any character that no piece holds, is spelled in byte pieces, so
decoding returns every text exactly.

The lattice falls apart at every place that no piece of the vocabulary spans, so filtering works on the parts between such places, which are short
in any script, with or without spaces. Where no piece holds a space behind another character (load checks it), texts are first
cut at spaces, and equal words of a slice are matched and filtered once and sampled for each occurrence. Parts are filtered side by
side, character by character; only a text in which pieces overlap without end, such as one letter repeated, makes a long part.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; repeated rows are encoded alike; a null key
seeds as 'null'; ids that no piece has are refused by decode; other columns pass through, but for one
named as the output, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import map_chunks, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
FALLBACK = 1  # marks a character without a piece, in the lattice only
FALLBACK_LOG = -22.0


@dataclass
class Vocabulary:
    """What a task needs of a model: the trie of its pieces as a hash table, their weights and their bytes."""

    key: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    logp: np.ndarray
    reach: int
    byte0: int
    pool: np.ndarray
    at: np.ndarray
    words: bool  # no piece holds a space or a line break behind another character, but for runs of spaces


def load(path: str = MODEL) -> Vocabulary:
    """Read a model on the driver; a path without a file is refused."""
    import os

    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}; name one with load(path)")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    byte0 = m.piece_to_id("<0x00>")
    plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    text = {i: m.id_to_piece(i).replace(MARK, " ") for i in plain}
    logp = np.full(n, -np.inf)
    for rank, i in enumerate(plain):
        logp[i] = -np.log(rank + 2)
    logp[FALLBACK] = FALLBACK_LOG
    nodes, leaf = {}, [0]
    for i, t in text.items():
        at = 0
        for c in t:
            if (at, ord(c)) not in nodes:
                nodes[at, ord(c)] = len(leaf)
                leaf.append(0)
            at = nodes[at, ord(c)]
        leaf[at] = i
    bits = max(4, (2 * len(nodes)).bit_length())
    key, child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    for (a, c), b in nodes.items():
        k = a << 21 | c
        h = ((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - bits)
        while key[h] >= 0:
            h = (h + 1) & ((1 << bits) - 1)
        key[h], child[h] = k, b
    spelled = [bytes([i - byte0]) if m.is_byte(i) else text.get(i, "").encode() for i in range(n)]
    words = not any(" " in t.lstrip(" ") or "\n" in t[:-1] or "\n" in t[1:] for t in text.values())
    return Vocabulary(key, child, np.array(leaf, np.int32), logp, max(map(len, text.values())), byte0, np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])]), words)


def _step(v: Vocabulary, node: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """The child of each node by a code point, or -1."""
    k = node.astype(np.int64) << 21 | cp
    bits = len(v.key).bit_length() - 1
    h = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    got = v.key[h]
    out = np.where(got == k, v.child[h], -1)
    again = np.flatnonzero((got != k) & (got >= 0))
    while len(again):
        h[again] = (h[again] + 1) & (len(v.key) - 1)
        got = v.key[h[again]]
        same = got == k[again]
        out[again[same]] = v.child[h[again[same]]]
        again = again[~same & (got >= 0)]
    return out


def segments(cps: np.ndarray, off: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of rows, or of the words in them: spaces and the characters after them; a line break is its own part."""
    cut = np.zeros(len(cps) + 1, bool)
    if words:
        space, line = cps == 32, cps == 10
        cut[:-1] |= line
        cut[1:] |= line
        cut[1:-1] |= space[1:] & ~space[:-1]
    cut[off] = True
    cut[-1] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def match(v: Vocabulary, chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts laid end to end, the piece of each length that ends at each character (0: none; FALLBACK: a single character without one), and
    the starts of the parts that remain when they are cut wherever no piece spans."""
    piece = np.zeros((len(chars), v.reach), np.uint16 if len(v.logp) <= 1 << 16 else np.int32)
    spanned = np.zeros(len(chars) + 1, np.int32)
    room = np.repeat(off[1:], np.diff(off)) - np.arange(len(chars))
    alive, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
    for n in range(v.reach):
        ok = room[alive] > n
        alive, node = alive[ok], node[ok]
        node = _step(v, node, chars[alive + n])
        ok = node >= 0
        alive, node = alive[ok], node[ok]
        if not len(alive):
            break
        found = v.leaf[node]
        piece[alive + n, n] = found
        if n:
            start = alive[found > 0]
            spanned += np.bincount(start + 1, minlength=len(spanned))
            spanned -= np.bincount(start + n + 1, minlength=len(spanned))
    piece[piece[:, 0] == 0, 0] = FALLBACK
    cut = np.cumsum(spanned)[:-1] == 0
    cut[off[:-1]] = True
    return piece, np.flatnonzero(cut)


def filter_forward(v: Vocabulary, piece: np.ndarray, start: np.ndarray, size: np.ndarray, alpha: float) -> np.ndarray:
    """Per character and length, the posterior probability that the piece ending there has that length or a shorter one: the weights of all
    paths through each part, summed from its start, for all parts side by side."""
    order = np.argsort(-size, kind="stable")
    at, longest = start[order], int(size.max()) if len(size) else 0
    active = np.searchsorted(-size[order], -np.arange(1, longest + 1), "right")  # parts with more than k characters
    weight = (v.logp * alpha).astype(np.float32)
    weight[0] = -np.inf
    total = np.zeros(len(piece))
    upto = np.ones(piece.shape, np.float32)
    for k in range(longest):
        here = at[: active[k]] + k
        reach = min(v.reach, k + 1)
        score = weight[piece[here, :reach]].astype(np.float64)
        for n in range(1, min(reach, k) + 1):
            score[:, n - 1] += total[here - n]
        top = score.max(axis=1)
        p = np.exp((score - top[:, None]).astype(np.float32))
        np.cumsum(p, axis=1, out=p)
        total[here] = top + np.log(p[:, -1])
        upto[here, :reach] = p / p[:, -1:]
    return upto


def _draw(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from the row's seed and the position in its text."""
    return (K.mix(seed + at.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def encode_array(v: Vocabulary, text: pa.Array, seed: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and their offset per row."""
    plain, off0 = K.codepoints(text)
    full = np.diff(off0) > 0
    cps = np.insert(plain, off0[:-1][full], 32)
    off = off0 + np.concatenate([[0], np.cumsum(full)])
    s, e = segments(cps, off, v.words) if len(cps) else (np.zeros(0, np.int64),) * 2
    row = np.searchsorted(off, s, "right") - 1
    _, one, of = np.unique(K.span_hashes(cps, s, e), return_index=True, return_inverse=True)
    size = (e - s)[one]
    laid = np.concatenate([[0], np.cumsum(size)])
    chars = cps[np.repeat(s[one] - laid[:-1], size) + np.arange(laid[-1])]
    piece, start = match(v, chars, laid)
    size = np.diff(np.append(start, len(chars)))
    upto = filter_forward(v, piece, start, size, alpha)
    first = np.searchsorted(start, laid)  # the parts of each distinct word, and then of each of its occurrences
    each = np.diff(first)[of]
    word = np.repeat(np.arange(len(s)), each)
    part = np.repeat(first[:-1][of] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    key, begin, place = seed[row[word]], start[part], (s - off[row])[word] + start[part] - laid[:-1][of[word]]
    got, count, k = [], np.zeros(len(part), np.int64), size[part]
    left = k.copy()
    for low, high in ((0, 4), (4, 8), (8, len(chars))):  # short parts ask for few lengths
        occ, reach, j = np.flatnonzero((k > low) & (k <= high)), min(v.reach, high), 0
        while len(occ):
            at = left[occ]
            here = begin[occ] + at - 1
            n = np.minimum((upto[here, :reach] <= _draw(key[occ], place[occ] + at)[:, None]).sum(axis=1), np.minimum(v.reach, at) - 1)
            ids = piece[here, n].astype(np.int64)
            bare = ids == FALLBACK
            ids[bare] = -chars[here[bare]].astype(np.int64) - 1
            got.append((j, occ, ids))
            count[occ] += 1
            j += 1
            left[occ] -= n + 1
            occ = occ[left[occ] > 0]
    end = np.cumsum(count)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    for j, o, ids in got:
        out[end[o] - 1 - j] = ids
    per = np.concatenate([[0], end])[np.searchsorted(np.searchsorted(off, s, "right")[word] - 1, np.arange(len(off)))]
    return _spell(v, out, per)


def _spell(v: Vocabulary, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece (negative) become their UTF-8 bytes."""
    bare = ids < 0
    if not bare.any():
        return ids.astype(np.int32), per
    cp = -ids - 1
    n = np.where(bare, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(np.where(bare, 0, ids), n)
    j = np.arange(len(out)) - np.repeat(start[:-1], n)
    c, size, b = np.repeat(cp, n), np.repeat(n, n), np.repeat(bare, n)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] | c >> 6 * (size - 1)
    byte = np.where(j == 0, lead, 0x80 | c >> 6 * (size - 1 - j) & 0x3F)
    out[b] = v.byte0 + byte[b]
    return out.astype(np.int32), start[per]


def decode_array(v: Vocabulary, ids: np.ndarray, per: np.ndarray) -> pa.Array:
    """Texts of rows of ids; the first space of a row, which encoding put there, is taken off."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(v.at) - 1):
        raise ValueError("an id that the vocabulary doesn't have")
    if not len(ids):
        return pa.array([""] * (len(per) - 1), pa.string())
    n = v.at[ids + 1] - v.at[ids]
    end = np.concatenate([[0], np.cumsum(n)])
    data = v.pool[np.repeat(v.at[ids] - end[:-1], n) + np.arange(end[-1])]
    off = end[per]
    lead = off[:-1][(np.diff(off) > 0)]
    lead = lead[data[lead] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    return pa.Array.from_buffers(pa.string(), len(per) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[keep].tobytes())])


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", seed: int = 7, alpha: float = 1.0) -> DataFrame:
    """``docs`` with ids, a sampled segmentation of the text. One narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the size of the vocabulary file
    rest = [c for c in docs.columns if c != "ids"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(seed)).alias("seed"))
    at = f"c{rest.index(text)}"

    def go(part: pa.RecordBatch) -> dict:
        texts = part.column(at)
        ids, per = encode_array(shared.value, texts, part.column("seed").to_numpy().view(np.uint64), alpha)
        lists = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(ids), mask=texts.is_null() if texts.null_count else None)
        return {f"c{i}": part.column(f"c{i}") for i in range(len(rest))} | {"ids": lists}

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    out = map_chunks(rows, go, f"{kinds}, ids array<int>", at, K.CHUNK // 4)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the text its ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    at = f"c{rest.index(ids)}"

    def go(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(at)
                none = lists.is_null()
                solid = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
                text = decode_array(shared.value, solid.flatten().to_numpy(), K.offsets_of(solid))
                if lists.null_count:
                    text = pa.array([None if x else t for x, t in zip(none.to_pylist(), text.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict({f"c{i}": part.column(f"c{i}") for i in range(len(rest))} | {"decoded": text})

    kinds = ", ".join(f"c{i} {encoded.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    return rows.mapInArrow(go, f"{kinds}, decoded string").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "decoded")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = load()
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return out.select("doc_id", "ids", F.size("ids").alias("n_pieces"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))
