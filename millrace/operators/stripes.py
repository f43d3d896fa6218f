"""Co-occurrence stripes: for each word the counts of its partners, as sorted sparse vectors that are merged where they meet.

Words are numbered by falling frequency (``numbered``), so that pairs are pairs of numbers and no hash can clash. A text's lines are split into words once:
slices of lines keep their words' places in a list of the slice's different words (``sliced``), the slices' lists are joined with the dictionary, and lines of numbers
are written in blocks (``blocks``). A task counts pairs of its lines in arrays and writes, for each word and range of SPAN partners, one vector: the
partners' places in the range, in order, and their counts. Vectors of one word and range meet in one task and are merged as they come; each is
SPAN long at most, however common its word. So what is shuffled is some three bytes for a partner, in place of a row for a pair. Queries write a pair
once, under its smaller number, and mirror it behind the merge.

Pairs are counted in rounds, by the smaller number's remainder. A task holds PAIRS different pairs at most, and in a round these come from so many more lines that
most of a pair's lines meet in it: fewer vectors are shuffled in all, and a round's shuffle goes before the next one's. So the disk holds a
round's vectors, not the input's.

As numbers follow frequency, a number's frequency is read off a table of steps, one for each frequency that occurs: there are at most
sqrt(2 x words in lines) of them, which is what the tasks are sent. Names are joined last, to what is left of the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.lineage import cut, settings

SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
#: Different pairs that a task holds, and pairs that are generated and sorted at once.
PAIRS, AT_ONCE = 8 << 20, 1 << 20
#: Words of lines in a slice.
WORDS = 1 << 20
#: Pairs that a task counts in a round; more rounds than ROUNDS read the lines too often.
ROUND, ROUNDS = 32 << 20, 64
#: Bits of a number in a packed pair, if no one says how many there are.
CODE_BITS = 20
#: Counts from here on take four bytes more.
LARGE = 255
#: Partners that are merged, or summed up by partner, at once.
MERGED = 1 << 20
STRIPE = "x long, range long, ys binary, ns binary"
#: Rows of Spark go to Python some so many bytes at once, as a row is a block of lines or a long vector.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64) if n else np.zeros(0, np.int64)


def numbered(single: DataFrame) -> DataFrame:
    """(word, id, n) of (word, n): ids rise from 0, without gaps, as frequency falls."""
    ordered = single.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    got = cut(ordered.select("word", F.monotonically_increasing_id().alias("id"), F.col("n").cast("long").alias("n")))  # written, as a second run might number otherwise
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    size = {r["part"]: r["size"] for r in got.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}  # a row a task
    before = np.cumsum([0, *(size.get(k, 0) for k in range(max(size, default=0)))]).tolist()
    return got.select("word", (F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), part.cast("int") + 1) + place).alias("id"), "n")


def sliced(lines: DataFrame, line: str = "line") -> DataFrame:
    """(slice, lines, rows, size, words, ns, sizes, codes) of slices of lines, some WORDS words long: how many lines, lines with words, and words of lines; the different
    words and on how many lines each stands; each line's number of different words among its capped tokens, and these words' places in ``words``."""

    def of_slice(nth: int, held: list[tuple[np.ndarray, pa.DictionaryArray]], rows: int) -> pa.RecordBatch:
        chunks = pa.chunked_array([h[1] for h in held], pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().chunks
        words = chunks[0].dictionary if chunks else pa.array([], pa.string())
        codes = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in chunks)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(h[0] for h in held)])
        whole = pa.array([0, len(words)], pa.int32())
        columns = [[(TaskContext.get().partitionId() << 32) + nth], [rows], [len(sizes)], [len(codes)], pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, pa.array(np.bincount(codes, minlength=len(words)).astype(np.int32))), [_packed(sizes)], [_packed(codes)]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["slice", "lines", "rows", "size", "words", "ns", "sizes", "codes"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, nth = [], 0, 0, 0
        for batch in batches:
            lists = batch.column("t")
            off = lists.offsets.to_numpy().astype(np.int64)
            n = np.diff(off)
            held.append((n[n > 0], lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()))
            rows, size = rows + len(n), size + int(off[-1] - off[0])
            if size >= WORDS:
                yield of_slice(nth, held, rows)
                held, rows, size, nth = [], 0, 0, nth + 1
        if held:
            yield of_slice(nth, held, rows)

    t = F.coalesce(F.array_distinct(T.capped_tokens(line)), F.array().cast("array<string>"))
    return cut(lines.select(t.alias("t")).mapInArrow(go, "slice long, lines long, rows long, size long, words array<string>, ns array<int>, sizes binary, codes binary"))


def frequency(slices: DataFrame) -> DataFrame:
    """(word, n): lines that hold the word."""
    return T.each(slices, F.arrays_zip("words", "ns"), "w").select("w.words", "w.ns").groupBy(F.col("words").alias("word")).agg(F.sum("ns").alias("n"))


def blocks(slices: DataFrame, words: DataFrame, least: int = 1) -> DataFrame:
    """(size, rows, pairs, last, sizes, ids) of blocks of lines, one for each slice: how many words, lines and pairs, and the largest number; each line's number of different words and these, by number, in
    order; a word that ``words`` lacks fails the query. Words on fewer than ``least`` lines are left out: none of their pairs can share as many."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, rows, sizes, codes = (batch.column(c)[row].as_py() for c in ("size", "rows", "sizes", "codes"))
                found = batch.column("found")[row].values
                code, number = (found.field(k).to_numpy() for k in (0, 1))
                of = np.full(len(code), -1, np.int64)
                of[code] = number
                ids = of[_unpacked(codes, size)]
                line = np.repeat(np.arange(rows), _unpacked(sizes, rows))
                ids, line = ids[ids >= 0], line[ids >= 0]
                ids = np.sort((line << 32) + ids) & 0xFFFFFFFF
                n = np.bincount(line)
                n = n[n > 0]
                yield pa.RecordBatch.from_pydict({"size": pa.array([len(ids)]), "rows": pa.array([len(n)]), "pairs": pa.array([int((n * (n - 1) // 2).sum())]), "last": pa.array([int(ids.max(initial=0))]), "sizes": [_packed(n)], "ids": [_packed(ids)]})

    each = slices.select("slice", F.posexplode(F.col("words")).alias("code", "word")).join(words.select("word", F.when(F.col("n") >= least, F.col("id")).otherwise(-1).alias("id")), "word", "left")
    known = F.coalesce("id", F.raise_error(F.concat(F.lit("a word of the lines has no line frequency: "), F.col("word"))).cast("long"))
    found = each.groupBy("slice").agg(F.collect_list(F.struct("code", known.alias("id"))).alias("found"))
    with settings(slices.sparkSession, SMALL):
        return cut(slices.select("slice", "size", "rows", "sizes", "codes").join(found, "slice").drop("slice").mapInArrow(go, "size long, rows long, pairs long, last long, sizes binary, ids binary"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, bounds of lines) of each block."""
    for batch in batches:
        for size, rows, sizes, ids in zip(*(batch.column(c).to_pylist() for c in ("size", "rows", "sizes", "ids")), strict=True):
            yield _unpacked(ids, size), np.concatenate(([0], np.cumsum(_unpacked(sizes, rows))))


def lines_of_ids(lines: DataFrame, words: DataFrame, line: str = "line", least: int = 1) -> DataFrame:
    """(ids): the lines of ``blocks``, a row each."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, off in _lines(batches):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))], ["ids"])

    return blocks(sliced(lines, line), words, least).mapInArrow(go, "ids array<long>")


def _stripes(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Vectors of triples in order of (x, y), no pair twice. ys: the partners' high bytes, then their low ones; ns: a byte for each count, then
    those of LARGE or more in four bytes. So bytes that are alike stand together, and Spark's compression finds them."""
    span = y >> SPAN_BITS
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (span[1:] != span[:-1])))) if len(x) else np.zeros(0, np.int64)
    ends = np.append(new, len(x)).astype(np.int64)

    size = np.diff(ends)
    row, first = np.repeat(np.arange(len(new)), size), np.repeat(new, size)
    place = np.arange(len(x)) - first
    ys = np.empty(2 * len(x), np.uint8)
    ys[2 * first + place] = (y & (SPAN - 1)) >> 8
    ys[2 * first + size[row] + place] = y & (SPAN - 1) & 0xFF
    large = np.flatnonzero(n >= LARGE)
    before = np.zeros(len(new) + 1, np.int64)  # large counts before each vector
    np.cumsum(np.bincount(row[large], minlength=len(new)), out=before[1:])
    ns = np.empty(len(x) + 4 * len(large), np.uint8)
    ns[np.arange(len(x)) + 4 * before[row]] = np.minimum(n, LARGE)
    at = ends[row[large] + 1] + 4 * np.arange(len(large))
    ns[(at[:, None] + np.arange(4)).ravel()] = n[large].astype("<u4").view(np.uint8)

    def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])

    return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(span[new]), binary(ys, 2 * ends), binary(ns, ends + 4 * before)], ["x", "range", "ys", "ns"])


def _summed(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Packed (pair, count), a count having ``bits``, in order, each pair once. Empties ``parts``."""
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    pair = keys >> bits
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    del pair
    n = np.add.reduceat(keys & ((1 << bits) - 1), first)
    keys = keys[first]
    keys >>= bits
    keys <<= bits
    keys += n
    return keys


class _Slice:
    """The pairs of lines whose smaller number leaves ``turn`` when divided by ``rounds``, up to ``most`` different ones."""

    def __init__(self, most: int, width: int, rounds: int = 1, turn: int = 0, known: np.ndarray | None = None, mirrored: bool = False):
        self.most, self.width, self.rounds, self.turn, self.known, self.mirrored = most, width, rounds, turn, known, mirrored
        self.bits = 63 - width - max(0, width - rounds.bit_length() + 1)  # of a count
        self.parts: list[np.ndarray] = []  # the first is the sum so far
        self.lines = 0

    def add(self, ids: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lines of numbers in order; vectors of what no longer has room."""
        at = np.flatnonzero(ids % self.rounds == self.turn) if self.rounds > 1 else np.arange(len(ids))
        line = np.searchsorted(off, at, "right")
        times = off[line] - at - 1  # every place meets those behind it
        upto = np.concatenate(([0], np.cumsum(times)))
        low, high = ids << self.bits, ((ids[at] // self.rounds) << (self.width + self.bits)) + 1
        lo, room = 0, (1 << self.bits) - 1
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1)
            if self.lines + line[hi - 1] - line[lo] >= room:  # a count can't be larger than the number of lines
                yield from self.flush()
                hi = lo + max(1, int(np.searchsorted(line[lo:hi], line[lo] + room - 1)))
            self.lines += int(line[hi - 1] - line[lo]) + 1
            some = times[lo:hi]
            keys = np.repeat(at[lo:hi] + 1 - upto[lo:hi] + upto[lo], some)
            keys += np.arange(len(keys))
            keys = low[keys]
            keys += np.repeat(high[lo:hi], some)
            if len(keys):
                keys.sort()
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                self.parts.append(keys[first] + (np.diff(first, append=len(keys)) - 1))
                del keys
                new = sum(map(len, self.parts[1:]))
                if new >= max(4 * AT_ONCE, len(self.parts[0]) // 2) or len(self.parts[0]) + new > self.most:
                    self.parts.append(_summed(self.parts, self.bits))
                    if len(self.parts[0]) > self.most * 3 // 4:
                        yield from self.flush()
            lo = hi

    def flush(self) -> Iterator[pa.RecordBatch]:
        packed = _summed(self.parts, self.bits) if self.parts else np.zeros(0, np.int64)
        self.parts, self.lines = [], 0
        at, above = 0, self.width + self.bits
        while at < len(packed):
            to = at + MERGED  # which parts no word's partners, unless one has more
            to = len(packed) if to >= len(packed) else int(np.searchsorted(packed, packed[to] >> above << above))
            to = int(np.searchsorted(packed, (packed[at] >> above) + 1 << above)) if to <= at else to
            part = packed[at:to]
            x, y, n = (part >> above) * self.rounds + self.turn, part >> self.bits & ((1 << self.width) - 1), part & ((1 << self.bits) - 1)
            if self.known is not None:
                x, y = self.known[x], self.known[y]
            yield _stripes(x, y, n)
            if self.mirrored:
                order = np.lexsort((x, y))
                yield _stripes(y[order], x[order], n[order])
            at = to


def count_slices(batches: Iterator[pa.RecordBatch], most: int = PAIRS, mirrored: bool = True) -> Iterator[pa.RecordBatch]:
    """Vectors of lines (ids), of ``most`` different pairs at once, over the bounds of batches; both orders of a pair, or only that with the smaller number first."""
    plain = _Slice(most, CODE_BITS, mirrored=mirrored)
    for batch in batches:
        lists = batch.column("ids")
        off = lists.offsets.to_numpy().astype(np.int64)
        ids, off = lists.values.to_numpy()[off[0] : off[-1]], off - off[0]
        ids = ids[np.lexsort((ids, np.repeat(np.arange(len(off) - 1), np.diff(off))))]
        if not len(ids) or ids.max() < 1 << CODE_BITS:
            yield from plain.add(ids, off)
            continue
        known, ids = np.unique(ids, return_inverse=True)
        own = _Slice(most, len(known).bit_length(), known=known, mirrored=mirrored)
        yield from own.add(ids, off)
        yield from own.flush()
    yield from plain.flush()


def _cuts(x: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of some ``most`` of sorted values, which part no value's run."""
    at = 0
    while at < len(x):
        to = at + most
        to = len(x) if to >= len(x) else int(np.searchsorted(x, x[to], "left"))
        if to <= at:
            to = int(np.searchsorted(x, x[at], "right"))
        yield at, to
        at = to


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of vectors in slices of some MERGED partners, one vector at least."""
    ends = np.frombuffer(batch.column("ys").buffers()[1], np.int32, batch.num_rows + 1, batch.column("ys").offset * 4)
    at = 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + 2 * MERGED, "right")) - 1), batch.num_rows, at + (1 << 14))
        yield batch.slice(at, to - at)
        at = to


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vector for each (x, range), of rows in that order: vectors of one key are summed up as they come. Only the last key's is kept
    from slice to slice."""
    held = (np.zeros(0, np.int64),) * 3  # of the key that may go on: x, y, n

    for batch in (part for whole in batches if whole.num_rows for part in _slices(whole)):
        row, x, y, n = _triples(batch)
        key, span = batch.column("x").to_numpy(), batch.column("range").to_numpy()
        group = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]) | (span[1:] != span[:-1]))))  # rows of a key, from 1
        if len(held[0]) and (held[0][0], held[1][0] >> SPAN_BITS) != (key[0], span[0]):
            yield _stripes(*held)
            held = (np.zeros(0, np.int64),) * 3
        at = np.concatenate([np.ones(len(held[0]), np.int64), group[row]])
        place = np.concatenate([held[1], y]) & (SPAN - 1)
        packed = np.sort((((at << SPAN_BITS) + place) << 32) + np.concatenate([held[2], n]))  # 15 + 16 + 32 bits
        spot = packed >> 32
        first = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
        n = np.add.reduceat(packed & 0xFFFFFFFF, first)
        of = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[(spot[first] >> SPAN_BITS) - 1]
        x, y = key[of], (span[of] << SPAN_BITS) + (spot[first] & (SPAN - 1))
        done = int(np.searchsorted(spot[first] >> SPAN_BITS, group[-1]))
        held = (x[done:], y[done:], n[done:])
        if done:
            yield _stripes(x[:done], y[:done], n[:done])
    if len(held[0]):
        yield _stripes(*held)


def counted(blocks: DataFrame, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``then`` of (x, range, ys, ns), the merged vectors of ``blocks``, each pair once, under its smaller number: rows of all rounds."""
    spark = blocks.sparkSession
    pairs, size = blocks.agg(F.sum("pairs"), F.max("last")).first()
    if not pairs:
        return then(spark.createDataFrame([], STRIPE))
    tasks = 2 * spark.sparkContext.defaultParallelism
    rounds, width = min(ROUNDS, -(-pairs // (tasks * ROUND))), int(size).bit_length()

    def vectors(turn: int) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Slice(PAIRS, width, rounds, turn)
            for ids, off in _lines(batches):
                yield from held.add(ids, off)
            yield from held.flush()

        return blocks.coalesce(tasks).mapInArrow(go, STRIPE).repartition("x", "range").sortWithinPartitions("x", "range").mapInArrow(merge, STRIPE)

    with settings(spark, SMALL):
        return reduce(DataFrame.unionAll, [cut(then(vectors(turn))) for turn in range(rounds)])


def _triples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y, n) of a batch of vectors."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        return ends, np.frombuffer(column.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)

    (oy, ys), (on, ns) = flat(batch.column("ys")), flat(batch.column("ns"))
    size = np.diff(oy) // 2
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    y = (ys[oy[row] + place].astype(np.int64) << 8) + ys[oy[row] + size[row] + place]
    n = ns[on[row] + place].astype(np.int64)
    large = np.flatnonzero(n == LARGE)
    if len(large):
        nth = np.arange(len(large)) - np.searchsorted(row[large], row[large], "left")  # among its vector's large counts
        at = on[row[large]] + size[row[large]] + 4 * nth
        n[large] = ns[(at[:, None] + np.arange(4)).ravel()].view("<u4")
    return row, batch.column("x").to_numpy()[row], y + (batch.column("range").to_numpy()[row] << SPAN_BITS), n


def kept(vectors: DataFrame, least: int) -> DataFrame:
    """The vectors with those of their partners that have ``least`` or more."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in _slices(whole)):
            _, *triples = _triples(batch)
            keep = triples[2] >= least
            yield _stripes(*(v[keep] for v in triples))

    return vectors.mapInArrow(go, STRIPE) if least > 1 else vectors


def mirrored(vectors: DataFrame) -> DataFrame:
    """The vectors of both orders of each pair, a word's in one task and in order."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in _slices(whole)):
            _, x, y, n = _triples(batch)
            x, y, n = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([n, n])
            order = np.lexsort((y, x))
            yield _stripes(x[order], y[order], n[order])

    with settings(vectors.sparkSession, SMALL):
        return cut(vectors.mapInArrow(go, STRIPE).repartition("x").sortWithinPartitions("x", "range").mapInArrow(merge, STRIPE))


def named(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """(x, nx, with_: its partners y in order, their frequencies ny, and the counts n) of vectors, by name. Slices of vectors ask the dictionary for their different words; a word
    whose vectors lie in one task and in order has one row."""

    def of_slice(nth: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        known = np.unique(np.concatenate([x, y]))
        ids = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(known))
        return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + nth]), pa.array([len(x)]), ids, *(pa.array([_packed(v)]) for v in (np.searchsorted(known, x), np.searchsorted(known, y), n))], ["slice", "size", "ids", "xs", "ys", "ns"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0
        for batch in (part for whole in batches if whole.num_rows for part in _slices(whole)):
            held.append(_triples(batch)[1:])
            size += len(held[-1][0])
            if size >= MERGED and held[0][0][0] != held[-1][0][-1]:
                x, y, n = map(np.concatenate, zip(*held, strict=True))
                last = int(np.flatnonzero(x != x[-1])[-1]) + 1
                yield of_slice(nth, x[:last], y[:last], n[:last])
                held, size, nth = [(x[last:], y[last:], n[last:])], len(x) - last, nth + 1
        if size:
            yield of_slice(nth, *map(np.concatenate, zip(*held, strict=True)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column("found")[row].values
                names = pa.RecordBatch.from_struct_array(found).sort_by("code")
                word, freq = names.column("word"), names.column("n")
                by_name = pc.sort_indices(word).to_numpy()
                place = np.empty(len(by_name), np.int64)
                place[by_name] = np.arange(len(by_name))
                x, y, n = (_unpacked(batch.column(c)[row].as_py(), batch.column("size")[row].as_py()) for c in ("xs", "ys", "ns"))
                order = np.lexsort((place[y], x))
                x, y, n = x[order], y[order], n[order]
                for lo, hi in _cuts(x, MERGED // 8):
                    off = np.concatenate(([0], np.flatnonzero(np.diff(x[lo:hi])) + 1, [hi - lo]))
                    of = pa.array(x[lo:hi][off[:-1]])
                    to = pa.array(y[lo:hi])
                    pairs = pa.StructArray.from_arrays([word.take(to), freq.take(to), pa.array(n[lo:hi])], ["y", "ny", "n"])
                    yield pa.RecordBatch.from_arrays([word.take(of), freq.take(of), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pairs)], ["x", "nx", "with_"])

    parts = cut(vectors.mapInArrow(slices, "slice long, size long, ids array<long>, xs binary, ys binary, ns binary"))
    asked = parts.select("slice", F.posexplode("ids").alias("code", "id")).join(words.select("id", "word", "n"), "id")
    found = asked.groupBy("slice").agg(F.collect_list(F.struct("code", "word", "n")).alias("found"))
    return parts.drop("ids").join(found, "slice").drop("slice").mapInArrow(go, "x string, nx long, with_ array<struct<y: string, ny: long, n: long>>")


def steps(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least number of each frequency that occurs, in order, and that frequency."""
    got = words.groupBy("n").agg(F.min("id").alias("id")).toArrow()  # sqrt(2 x words in lines) rows at most
    ids, n = got.column("id").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(ids)
    return ids[order], n[order]


def profile(blocks: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(x, partners, together, highest, lowest): of each word over all its partners, how many, the lines shared, and the highest
    and lowest log10 of n * total / (n(x) * n(y)). A pair stands once in the vectors and counts for both its words."""
    shared = blocks.sparkSession.sparkContext.broadcast(steps(words))

    def summed(key: np.ndarray, one: np.ndarray, n: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(key, kind="stable")
        key, one, n, high, low = (v[order] for v in (key, one, n, high, low))
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[at], np.add.reduceat(one, at), np.add.reduceat(n, at), np.maximum.reduceat(high, at), np.minimum.reduceat(low, at)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n_of = shared.value
        of = lambda v: n_of[np.searchsorted(first, v, "right") - 1]
        held: list[tuple[np.ndarray, ...]] = []  # sums by word
        for batch in (part for whole in batches if whole.num_rows for part in _slices(whole)):
            _, x, y, n = _triples(batch)
            ratio = n * float(total) / (of(x).astype(float) * of(y))
            one = np.ones(len(n), np.int64)
            held += [summed(key, one, n, ratio, ratio) for key in (x, y)]
            if sum(len(h[0]) for h in held) > MERGED:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > MERGED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in held.pop()], NAMES)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in summed(*map(np.concatenate, zip(*held, strict=True)))], NAMES)

    NAMES = ["id", "partners", "together", "high", "low"]
    whole = lambda df: df.groupBy("id").agg(F.sum("partners").alias("partners"), F.sum("together").alias("together"), F.max("high").alias("high"), F.min("low").alias("low"))
    each = counted(blocks, lambda vectors: whole(vectors.mapInArrow(go, "id long, partners long, together long, high double, low double")))
    return whole(each).join(words.select("id", F.col("word").alias("x")), "id").select("x", "partners", "together", F.log10("high").alias("highest"), F.log10("low").alias("lowest"))
