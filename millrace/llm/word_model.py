"""An interpolated modified Kneser-Ney model over pairs of words, learned and asked in shards.

Words are runs of letters, marks and numbers in lower case; any other visible character is a word of its own. A text is read as a ring
through EDGE, so every word is predicted once and follows once. A word goes by 48 bits of its hash, a key by 48 of another: with 10^8
keys in the model one request in three million for a key that it lacks is answered by another's value.

    p(w | v) = max(n(v, w) - d, 0) / n(v) + free(v) * p(w)      free(v): what the discounts leave over
    p(w)     = max(t(w) - d, 0) / T + free * 1 / (words + 1)    t(w): how many different words w follows, T: their sum

Learning: slices of texts count their pairs and pack them, one row for each of V_SHARDS of the first words; a shard's rows meet in one task, which sums
them as they come and writes them as one. Continuation counts are summed by word. The discounts of both orders (Chen and Goodman) are four numbers each.

The logarithm of p(w | v) adds up from three parts: that of a word never seen, the same everywhere; one of w and of v by themselves (WORD: log p(w) +
log free(w), as w is predicted once and followed once); and, if (v, w) has been seen, one of the pair (log of 1 + discounted share / (free(v) p(w))). So the model
is one table of keys and values, in STEPS of a nat, dealt to SHARDS by key. Asking: a slice of texts sends each shard its different keys with the
texts that hold them; the shard sends back one sum for each such text. The texts' own rows go the same way, so that texts are read once. Two things are known to all slices, of stated size: the HOT keys of each shard that
were counted most, so that no key is asked for by everyone, and a bit for every 2^-BITS of the keys, by which most keys that no shard has aren't sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import planes
from millrace.llm import _kernels as K
from millrace.plans.lineage import cut, settings

EDGE, CODE_BITS, KEY_BITS = 0, 48, 48
#: Words of a slice that is counted, of one that asks half as many keys as it sends; shards; keys of each shard, and words, that all tasks know; bits that tell which keys there are.
TOKENS, V_SHARDS, SHARDS, HOT, HOT_WORDS, BITS = 2 << 20, 1024, 256, 1 << 12, 1 << 16, 27
STEPS, LEAST = 1024, 1e-6
#: Texts of a slice that asks, whose numbers stand behind the keys in 64 bits; pieces that a slice's rows are packed in, since packing takes several times their memory.
PLACE_BITS, PIECES = 64 - KEY_BITS, 8
TEXTS = 1 << PLACE_BITS
_U = np.uint64
#: Of a key, the bits behind its shard.
INNER = KEY_BITS - 8
_LOW = (1 << INNER) - 1
PAIRS = "shard int, m long, vs binary, sizes binary, n long, ws binary, ns binary"
PART = "shard int, n long, keys binary, vals binary, often binary"


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words, and their offset per row."""
    cps, off = K.codepoints(text)
    low, inner = K.lower_map()[cps], K.word_mask()[cps]
    s, e, _ = K.runs(inner, off)
    alone = np.flatnonzero(K.nonspace_mask()[cps] & ~inner)
    s, e = np.concatenate([s, alone]), np.concatenate([e, alone + 1])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    h = (K.span_hashes(low, s, e) >> _U(64 - CODE_BITS)).astype(np.int64)
    return np.maximum(h, EDGE + 1), np.searchsorted(s, off)


def pairs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w) of every place in the rings of all rows, and their offset per row; a row without a word has none."""
    h, off = words(text)
    n = np.diff(off)
    upto = np.concatenate(([0], np.cumsum(n + (n > 0))))
    at = np.arange(len(h)) + np.repeat(upto[:-1] - off[:-1], n)
    v, w = np.full(upto[-1], EDGE, np.int64), np.full(upto[-1], EDGE, np.int64)
    w[at], v[at + 1] = h, h
    return v, w, upto


def word_keys(w: np.ndarray) -> np.ndarray:
    return K.mix(w.astype(_U) + _U(0x9E3779B97F4A7C15)) >> _U(64 - KEY_BITS)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(v.astype(_U) + _U(0xD1B54A32D192ED03)) * _U(0xC2B2AE3D27D4EB4F) + w.astype(_U)) >> _U(64 - KEY_BITS)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are alike in all columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _gaps(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each row's first number, then the distances to the one before."""
    gap = np.diff(values, prepend=0)
    gap[off[:-1]] = values[off[:-1]]
    return gap


def _upto(gap: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers out of ``_gaps``."""
    total = np.cumsum(gap)
    first = np.cumsum(n) - n
    return total - np.repeat(total[first] - gap[first], n)


# Learning --------------------------------------------------------------------------------------------------------------


def _summed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    at = _starts(v, w)
    return v[at], w[at], np.add.reduceat(n[order], at) if len(at) else n


def _rows(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows PAIRS of triples in order: of each shard its first words, how many pairs each has, and those."""
    at = _starts(v)
    of = _starts(v[at] // ((1 << CODE_BITS) // V_SHARDS))
    off, far = np.append(of, len(at)), np.append(at[of], len(v))
    each = np.append(at, len(v))
    shard = (v[at[of]] // ((1 << CODE_BITS) // V_SHARDS)).astype(np.int32)
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard), "m": pa.array(np.diff(off)), "vs": planes.pack(_gaps(v[at], off), off), "sizes": planes.pack(np.diff(each), off), "n": pa.array(np.diff(far)), "ws": planes.pack(w, far), "ns": planes.pack(n, far)})


def _triples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, n) of rows PAIRS, those of a first word side by side."""
    m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
    v = np.repeat(_upto(planes.unpack(batch.column("vs"), m), m), planes.unpack(batch.column("sizes"), m))
    return v, planes.unpack(batch.column("ws"), n), planes.unpack(batch.column("ns"), n)


def count_pairs(texts: DataFrame) -> DataFrame:
    """Rows PAIRS of texts (text), one a slice and shard."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (p for b in batches for p in K.chunks(b)):
            v, w, _ = pairs(part.column("text"))
            held.append((v, w))
            size += len(v)
            if size >= TOKENS:
                yield from of_slice(held)
                held, size = [], 0
        if size:
            yield from of_slice(held)

    def of_slice(held: list) -> Iterator[pa.RecordBatch]:
        v, w = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        v, w, n = _summed(v, w, np.ones(len(v), np.int64))
        ends = np.searchsorted(v, np.arange(1, PIECES) * ((1 << CODE_BITS) // PIECES))
        for lo, hi in zip([0, *ends], [*ends, len(v)], strict=True):
            if lo < hi:
                yield _rows(v[lo:hi], w[lo:hi], n[lo:hi])

    return texts.select("text").where("text IS NOT NULL").mapInArrow(go, PAIRS)


def merged(counted: DataFrame) -> DataFrame:
    """Rows PAIRS, one a shard."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wait, shard = (np.zeros(0, np.int64),) * 3, [], None

        def all_of() -> tuple[np.ndarray, ...]:
            return _summed(*map(np.concatenate, zip(held, *wait, strict=True)))

        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            number = row.column("shard")[0].as_py()
            if shard is not None and number != shard:
                yield _rows(*all_of())
                held, wait = (np.zeros(0, np.int64),) * 3, []
            shard = number
            wait.append(_triples(row))
            if sum(len(x[0]) for x in wait) > max(TOKENS, len(held[0])):
                held, wait = all_of(), []
        if shard is not None:
            yield _rows(*all_of())

    return counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(go, PAIRS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, by how many counts are 1, 2, 3 and 4."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return max(0.0, 1 - 2 * y * n2 / n1), max(0.0, 2 - 3 * y * n3 / n2), max(0.0, 3 - 4 * y * n4 / n3)


def _left(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.select([n == 0, n == 1, n == 2], [0.0, d[0], d[1]], d[2]), 0.0)


def _kinds(c: str) -> list[Column]:
    return [F.count(F.when(F.col(c) == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]


def _parts(keys: np.ndarray, vals: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    """Rows PART: keys by shard, in order, with their values in STEPS and how often they were counted."""
    order = np.argsort(keys)
    keys = keys[order]
    shard = (keys >> _U(INNER)).astype(np.int32)
    at = _starts(shard)
    off = np.append(at, len(keys))
    inner = (keys & _U(_LOW)).astype(np.int64)
    steps = np.rint(vals[order] * STEPS).astype(np.int64)
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard[at]), "n": pa.array(np.diff(off)), "keys": planes.pack(_gaps(inner, off), off), "vals": planes.pack((steps << 1) ^ (steps >> 63), off), "often": planes.pack(np.minimum(often[order], 1 << 30), off)})


def _signed(v: np.ndarray) -> np.ndarray:
    return (v >> 1) ^ -(v & 1)


def _in_slices(go, least: int = TOKENS):
    """``go`` on the concatenated arrays that batches give, ``least`` of them or so at once."""

    def run(held: list) -> pa.RecordBatch:
        return _parts(*map(np.concatenate, zip(*held, strict=True)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            got = go(batch)
            if len(got[0]):
                held.append(got)
                size += len(got[0])
            if size >= least:
                yield run(held)
                held, size = [], 0
        if held:
            yield run(held)

    return each


def learn(texts: DataFrame, conf: dict | None = None) -> tuple[DataFrame, dict]:
    """conf: SQL settings under which ``texts`` are read. Returns the model's shards (shard, n, keys, vals, bits, hot_keys, hot_vals), and its facts: ``base``, the log of p of a word never seen."""
    spark = texts.sparkSession
    with settings(spark, conf or {}):
        ctx = cut(merged(count_pairs(texts)))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = _triples(b)[2]
            yield pa.RecordBatch.from_pydict({f"n{i}": pa.array([int((n == i).sum())]) for i in (1, 2, 3, 4)} | {"pairs": pa.array([len(n)])})

    two = ctx.mapInArrow(kinds, "n1 long, n2 long, n3 long, n4 long, pairs long").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "pairs")]).first()
    if not two["pairs"]:
        return spark.createDataFrame([], "shard int, n long, keys binary, vals binary, bits binary, hot_keys binary, hot_vals binary"), {"base": 0.0}
    d = discounts(two["n1"], two["n2"], two["n3"], two["n4"])

    def free_of(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each first word begins, how often it stands, and what is left over of it."""
        at = _starts(v)
        total = np.add.reduceat(n, at)
        return at, total, np.maximum(np.add.reduceat(n - _left(n, d), at) / total, LEAST)

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, w, n = _triples(b)
                at, _, free = free_of(v, n)
                found, code = np.unique(w, return_inverse=True)
                zero = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_pydict({"w": pa.array(np.concatenate([found, v[at]])), "t": pa.array(np.concatenate([np.bincount(code), zero])), "c": pa.array(np.concatenate([np.bincount(code, weights=n).astype(np.int64), zero])), "free": pa.array(np.concatenate([np.zeros(len(found)), free]))})

    vocabulary = cut(ctx.mapInArrow(by_word, "w long, t long, c long, free double").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("free").alias("free")))
    one = vocabulary.agg(F.sum("t").alias("all"), F.count(F.when(F.col("t") > 0, 1)).alias("words"), F.count(F.when(F.col("t") >= 3, 1)).alias("more"), *_kinds("t")).first()
    e = discounts(one["n1"], one["n2"], one["n3"], one["n4"])
    unseen = max((e[0] * one["n1"] + e[1] * one["n2"] + e[2] * one["more"]) / one["all"], LEAST) / (one["words"] + 1)
    p_of = lambda t: _left(t, e) / one["all"] + unseen

    steps = vocabulary.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("t")).collect()  # sqrt(2 x pairs) rows at most
    upto = np.cumsum([r["n"] for r in steps])
    fits = int(np.searchsorted(upto, HOT_WORDS, "right"))
    known = vocabulary.where(F.col("t") >= (steps[fits - 1]["t"] if fits else steps[0]["t"] + 1)).select("w", "t").toArrow()  # HOT_WORDS rows at most
    known = spark.sparkContext.broadcast(tuple(c[np.argsort(known.column("w").to_numpy())] for c in (known.column("w").to_numpy(), known.column("t").to_numpy())))

    def shares(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        v, w, n = _triples(b)
        at, total, free = free_of(v, n)
        return v, w, n, _left(n, d) / np.repeat(total * free, np.diff(np.append(at, len(v))))

    def is_known(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ws, ts = known.value
        at = np.minimum(np.searchsorted(ws, w), max(len(ws) - 1, 0))
        return (ws[at] == w, ts[at]) if len(ws) else (np.zeros(len(w), bool), w)

    def near(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        v, w, n, share = shares(b)
        here, t = is_known(w)
        return pair_keys(v, w)[here], np.log1p(share / p_of(t))[here], n[here]

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, w, n, share = shares(b)
                away = ~is_known(w)[0]
                yield pa.RecordBatch.from_pydict({"w": pa.array(w[away]), "key": pa.array(pair_keys(v, w)[away].view(np.int64)), "share": pa.array(share[away]), "n": pa.array(n[away])})

    def alone(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        free = b.column("free").to_numpy()
        return word_keys(b.column("w").to_numpy()), np.log(p_of(b.column("t").to_numpy()) / unseen) + np.log(np.where(free > 0, free, 1.0)), b.column("c").to_numpy()

    def joined(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return b.column("key").to_numpy().view(np.uint64), np.log1p(b.column("share").to_numpy() / p_of(b.column("t").to_numpy())), b.column("n").to_numpy()

    rest = ctx.mapInArrow(far, "w long, key long, share double, n long").join(vocabulary.select("w", "t"), "w")
    parts = ctx.mapInArrow(_in_slices(near), PART).unionByName(vocabulary.mapInArrow(_in_slices(alone), PART)).unionByName(rest.mapInArrow(_in_slices(joined), PART))

    def shard(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        n = b.column("n").to_numpy()
        keys = _upto(planes.unpack(b.column("keys"), n), n)
        order = np.argsort(keys, kind="stable")
        keys, vals, often = keys[order], planes.unpack(b.column("vals"), n)[order], planes.unpack(b.column("often"), n)[order]
        at = _starts(keys)
        keys, vals, often = keys[at], vals[at], often[at]
        bits = np.zeros((1 << BITS) // SHARDS, bool)
        bits[keys >> (KEY_BITS - BITS)] = True
        hot = np.sort(np.argsort(-often, kind="stable")[:HOT])
        whole = np.array([0, len(keys)])
        return pa.table({"shard": pa.array([b.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "keys": planes.pack(_gaps(keys, whole), whole), "vals": planes.pack(vals, whole), "bits": pa.array([np.packbits(bits).tobytes()]), "hot_keys": pa.array([keys[hot].tobytes()]), "hot_vals": pa.array([_signed(vals[hot]).tobytes()])})

    return cut(parts.groupBy("shard").applyInArrow(shard, "shard int, n long, keys binary, vals binary, bits binary, hot_keys binary, hot_vals binary")), {"base": float(np.log(unseen))}


# Asking ----------------------------------------------------------------------------------------------------------------


def _known(shards: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What all tasks know: keys and values of the hot ones, and the bits."""
    got = shards.select("shard", "bits", "hot_keys", "hot_vals").toArrow().sort_by("shard")  # SHARDS rows of stated size
    bits = np.zeros((SHARDS, (1 << BITS) // SHARDS // 8), np.uint8)
    keys, vals = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in got.to_pylist():
        bits[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
        keys.append(np.frombuffer(r["hot_keys"], np.uint64) | _U(r["shard"] << INNER))
        vals.append(np.frombuffer(r["hot_vals"], np.int64))
    return np.concatenate(keys), np.concatenate(vals), bits.ravel()


def score(rows: DataFrame, shards: DataFrame, facts: dict) -> DataFrame:
    """(key, lang, held, n_symbols: words and the text's end, loss: mean negative log-probability of them) of rows (key, lang, held, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(_known(shards))
    base, kind = facts["base"], rows.schema["key"].dataType.simpleString()
    ask = f"slice long, shard int, place int, key {kind}, lang string, held boolean, size long, sum long, n long, keys binary, texts binary, e long, places binary, times binary"
    names = [f.split()[0] for f in ask.split(", ")]

    def filled(rows_: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows_, f.type)) for f in schema], schema=schema)

    def requests_of(wait: list, schema: pa.Schema, number: int) -> Iterator[pa.RecordBatch]:
        packed = np.concatenate(wait)
        wait.clear()
        packed.sort()
        ends = np.searchsorted(packed, np.arange(SHARDS // PIECES, SHARDS, SHARDS // PIECES).astype(_U) << _U(INNER + PLACE_BITS))
        for lo, hi in zip([0, *ends], [*ends, len(packed)], strict=True):
            if lo == hi:
                continue
            at = _starts(packed[lo:hi])
            times = np.diff(np.append(at, hi - lo))
            some = packed[lo:hi][at]
            keys, place = some >> _U(PLACE_BITS), (some & _U(TEXTS - 1)).astype(np.int64)
            one = _starts(keys)  # of each key its first text
            texts = np.diff(np.append(one, len(keys)))
            key = keys[one]
            shard = (key >> _U(INNER)).astype(np.int32)
            of = _starts(shard)
            off, far = np.append(of, len(key)), np.append(one[of], len(keys))
            yield filled(len(of), schema, slice=pa.array([number] * len(of), pa.int64()), shard=pa.array(shard[of]), n=pa.array(np.diff(off)), keys=planes.pack(_gaps((key & _U(_LOW)).astype(np.int64), off), off), texts=planes.pack(texts, off), e=pa.array(np.diff(far)), places=planes.pack(place, far), times=planes.pack(times, far))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_vals, bits = shared.value
        wait, size, first, schema, number = [], 0, 0, None, TaskContext.get().partitionId() << 24  # the same if a task is run again
        for part in (p.slice(i, TEXTS) for b in batches for p in K.chunks(b) for i in range(0, p.num_rows, TEXTS)):
            if schema is None:
                types = {"slice": pa.int64(), "shard": pa.int32(), "place": pa.int32(), "key": part.column("key").type, "lang": part.column("lang").type, "held": pa.bool_(), "size": pa.int64(), "sum": pa.int64(), "n": pa.int64(), "e": pa.int64()}
                schema = pa.schema([(c, types.get(c, pa.binary())) for c in names])
            rows_ = part.num_rows
            if size >= 2 * TOKENS or first + rows_ > TEXTS:
                yield from requests_of(wait, schema, number)
                size, first, number = 0, 0, number + 1
            v, w, off = pairs(part.column("text"))
            n = np.diff(off)
            place, sums = np.repeat(np.arange(rows_), n), np.zeros(rows_, np.int64)
            for keys in (word_keys(w), pair_keys(v, w)):
                at = np.minimum(np.searchsorted(hot_keys, keys), max(len(hot_keys) - 1, 0))
                hot = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
                if hot.any():
                    sums += np.bincount(place[hot], weights=hot_vals[at[hot]], minlength=rows_).astype(np.int64)
                spot = (keys >> _U(KEY_BITS - BITS)).astype(np.int64)
                maybe = ~hot & ((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(bool)
                wait.append((keys[maybe] << _U(PLACE_BITS)) | (place[maybe] + first).astype(_U))
                size += len(wait[-1])
            at = np.arange(first, first + rows_)
            yield filled(rows_, schema, slice=pa.array([number] * rows_, pa.int64()), shard=pa.array(((at + (number >> 24)) % SHARDS).astype(np.int32)), place=pa.array(at.astype(np.int32)), key=part.column("key"), lang=part.column("lang"), held=part.column("held"), size=pa.array(n), sum=pa.array(sums))
            first += rows_
        if wait:
            yield from requests_of(wait, schema, number)

    asked = rows.select("key", "lang", "held", "text").mapInArrow(go, ask)

    kept = ("slice", "place", "key", "lang", "held", "size", "sum")

    def reply(b: pa.RecordBatch) -> pa.Schema:
        types = {"slice": pa.int64(), "is_text": pa.bool_(), "e": pa.int64(), "places": pa.binary(), "sums": pa.binary()}
        return pa.schema([*types.items(), *[(c, b.schema.field(c).type) for c in kept[1:]]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, vals = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found, is_text = [], batch.column("place").is_valid()
            t = batch.filter(is_text)
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([True] * t.num_rows) if f.name == "is_text" else t.column(f.name) if f.name in kept else pa.nulls(t.num_rows, f.type) for f in reply(t)], schema=reply(t))
            batch = batch.filter(pc.invert(is_text))
            for i, (shard, model) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("model").to_pylist(), strict=True)):
                r = batch.slice(i, 1)
                n = r.column("n").to_numpy()
                if model:
                    at, keys, vals = shard, np.cumsum(planes.unpack(r.column("keys"), n)), _signed(planes.unpack(r.column("vals"), n))
                elif at == shard:
                    want = np.cumsum(planes.unpack(r.column("keys"), n))
                    spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    got = np.where(keys[spot] == want, vals[spot], 0)
                    e = r.column("e").to_numpy()
                    got = np.repeat(got, planes.unpack(r.column("texts"), n)) * planes.unpack(r.column("times"), e)
                    sums = np.bincount(planes.unpack(r.column("places"), e), weights=got).astype(np.int64)
                    hit = np.flatnonzero(sums)
                    if len(hit):
                        found.append((r.column("slice")[0].as_py(), hit, sums[hit]))
            if found:
                off = np.concatenate(([0], np.cumsum([len(f[1]) for f in found])))
                places, sums = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                yield filled(len(found), reply(batch), slice=pa.array([f[0] for f in found], pa.int64()), is_text=pa.array([False] * len(found)), e=pa.array(np.diff(off)), places=planes.pack(places, off), sums=planes.pack((sums << 1) ^ (sums >> 63), off))

    requests = asked.withColumn("model", F.lit(False)).withColumn("vals", F.lit(None).cast("binary"))
    both = requests.unionByName(shards.select("shard", "n", "keys", "vals", F.lit(True).alias("model")), allowMissingColumns=True)
    answers = both.repartition("shard").sortWithinPartitions("shard", F.desc("model")).mapInArrow(answer, f"slice long, is_text boolean, e long, places binary, sums binary, place int, key {kind}, lang string, held boolean, size long, sum long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, np.int64)
        for batch in batches:
            number, is_text = batch.column("slice").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
            for lo, hi in zip(s := _starts(number, is_text), np.append(s[1:], batch.num_rows), strict=True):
                if number[lo] != at:
                    at, total = number[lo], np.zeros(0, np.int64)
                part = batch.slice(lo, hi - lo)
                if not is_text[lo]:
                    e = part.column("e").to_numpy()
                    place, sums = planes.unpack(part.column("places"), e), _signed(planes.unpack(part.column("sums"), e))
                    new = np.bincount(place, weights=sums, minlength=len(total)).astype(np.int64)
                    new[: len(total)] += total
                    total = new
                    continue
                place, n = part.column("place").to_numpy(), part.column("size").to_numpy()
                more = np.where(place < len(total), np.append(total, 0)[np.minimum(place, len(total))], 0)
                loss = -(base + (part.column("sum").to_numpy() + more) / STEPS / np.maximum(n, 1))
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "lang": part.column("lang"), "n_symbols": pa.array(n), "loss": pa.array(loss, mask=n == 0), "held": part.column("held")})

    return answers.repartition("slice").sortWithinPartitions("slice", "is_text").mapInArrow(add, f"key {kind}, lang string, n_symbols long, loss double, held boolean")
