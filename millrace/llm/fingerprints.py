"""Document fingerprints as Merkle trees over sections, paragraphs and leaves.

Paragraphs are lines with their line break; a section ends with its blank lines (spaces and control characters). A paragraph is cut into leaves where its content says so:
before one character in LEAF, as the hash of the WINDOW characters of the paragraph before it says, so an edit moves the cuts beside it and
no other, wherever the paragraph stands and in whatever script; what is longer than MOST characters without a cut is cut every MOST. A leaf's digest covers its characters, a paragraph's its leaves'
digests, a section's its paragraphs', the root its sections' and the length of the text: equal roots mean equal texts.

The fingerprint is the root (128 bits), a colon, and the tree in order, seven characters a branch: ``|`` and the section's digest, ``/`` and
the paragraph's, or a length code and the leaf's, each digest shortened to 36 bits. So differing branches locate an edit: ``edits``
descends where digests differ and aligns branches by digest.

Likeness is the share of text two trees have in common, 2 * common / (all of both), by descent: sections with equal digests are common
as a whole, in the others paragraphs with equal digests, and in the rest leaves; each branch is matched once, and counts as its
length. It is 1 for equal texts, also for two empty ones.

Trees of thousands of texts are built at once with array operations. Memory follows the slice of rows, or one row where that is longer.

Defined results: a null text counts as empty; repeated rows have equal fingerprints; neighbours are in descending key order, null keys
last, equal keys by descending hash of their text; a lone row is its own neighbour; keys may be of any type that sorts; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm import _kernels as K
from millrace.llm._spark import parts, table

LEAF, WINDOW = 16, 4
CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+-"
MOST = 63
RANGES, SAMPLED = 4096, 20  # ranges of keys at most, and rows sampled for each
_CODE = np.frombuffer(CODES.encode(), np.uint8)
_VALUE = np.zeros(256, np.int64)
_VALUE[_CODE] = np.arange(64)


class Forest:
    """The trees of many texts. Of each level (0 sections, 1 paragraphs, 2 leaves): digest (36 bits), weight, and up: the branch of the level
    above it (of sections: the text)."""

    def __init__(self, rows: int, digest: list, weight: list, up: list) -> None:
        self.rows, self.digest, self.weight, self.up = rows, digest, weight, up

    def take(self, which: np.ndarray) -> Forest:
        """The trees of the texts ``which``, in that order."""
        up, digest, weight, kept, n = [], [], [], np.asarray(which), self.rows
        for level in range(3):
            off = np.searchsorted(self.up[level], np.arange(n + 1))
            size = np.diff(off)[kept]
            at = np.repeat(off[:-1][kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            up.append(np.repeat(np.arange(len(kept)), size))
            digest.append(self.digest[level][at])
            weight.append(self.weight[level][at])
            kept, n = at, len(self.digest[level])
        return Forest(len(which), digest, weight, up)


def _cuts(cps: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Places of content cuts; line: the start of the line of each code point."""
    h, c = np.zeros(len(cps), np.uint32), cps * np.uint32(0x9E3779B1)
    c ^= c >> np.uint32(15)
    for j in range(1, min(WINDOW, len(cps) - 1) + 1):
        h[j:] += c[:-j] * np.uint32(0x85EBCA77 * (2 * j + 1) & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    at = np.flatnonzero(h < np.uint32((1 << 32) // LEAF))
    out = np.zeros(len(cps), bool)
    out[at[at - line[at] >= WINDOW]] = True
    return out


def plant(text: pa.Array) -> tuple[Forest, list[str]]:
    """Trees and roots of texts."""
    cps, off = K.codepoints(text)
    rows, n = len(off) - 1, len(cps)
    first = np.zeros(n + 1, bool)  # of a line
    first[1:] = cps == 10
    first[off] = True
    ls = np.flatnonzero(first[:n])
    le = np.append(ls[1:], n) if n else ls
    of = np.cumsum(first[:n]) - 1
    row = np.searchsorted(off, ls, "right") - 1
    solid = np.zeros(n + 1, np.int64)
    np.cumsum(cps > 32, out=solid[1:])
    blank = solid[le] == solid[ls]
    opens = np.ones(len(ls), bool)
    opens[1:] = (row[1:] != row[:-1]) | (blank[:-1] & ~blank[1:])
    ss = np.flatnonzero(opens)
    leaf = np.flatnonzero(first[:n] | _cuts(cps, ls[of])) if n else ls
    pieces = -(-np.diff(np.append(leaf, n)) // MOST)
    leaf = np.repeat(leaf - MOST * (np.cumsum(pieces) - pieces), pieces) + MOST * np.arange(pieces.sum())
    size = np.diff(np.append(leaf, n))
    starts = [np.searchsorted(row[ss], np.arange(rows + 1)), np.append(ss, len(ls)), np.searchsorted(of[leaf], np.arange(len(ls) + 1))]
    root, leaves = [], K.span_hashes(cps, leaf, leaf + size)
    for seed in (0, 1):
        h = [None, None, leaves]
        for level in (1, 0):
            at = starts[level + 1]
            h[level] = K.span_hashes(h[level + 1], at[:-1], at[1:], seed + 2)
        root.append(K.mix(K.span_hashes(h[0], starts[0][:-1], starts[0][1:], seed + 4) + np.diff(off).astype(np.uint64)))
        digest = digest if seed else h
    weight: list = [None, None, size]
    for level in (1, 0):
        weight[level] = K.segment_sums(weight[level + 1], starts[level + 1])
    short = [(x >> np.uint64(28)).astype(np.int64) for x in digest]
    up = [np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in starts]
    return Forest(rows, short, weight, up), [f"{a:016x}{b:016x}" for a, b in zip(*(x.tolist() for x in root), strict=True)]


def write(f: Forest, roots: list[str]) -> list[str]:
    """Fingerprints of planted texts."""
    one = [np.searchsorted(f.up[2], np.searchsorted(f.up[1], np.arange(len(f.digest[0])))), np.searchsorted(f.up[2], np.arange(len(f.digest[1]))), np.arange(len(f.digest[2]))]
    order = np.argsort(np.concatenate([3 * at + level for level, at in enumerate(one)]), kind="stable")
    body = np.zeros((len(order), 7), np.uint8)
    body[:, 0] = np.concatenate([np.full(len(one[0]), ord("|")), np.full(len(one[1]), ord("/")), _CODE[f.weight[2]]])[order]
    value = np.concatenate(f.digest)[order]
    for j in range(6):
        body[:, 6 - j] = _CODE[value >> 6 * j & 63]
    text = body.tobytes().decode()
    per = np.bincount(f.up[0], minlength=f.rows) + np.bincount(f.up[0][f.up[1]], minlength=f.rows) + np.bincount(f.up[0][f.up[1][f.up[2]]], minlength=f.rows)
    end = 7 * np.cumsum(per)
    return [f"{r}:{text[a:b]}" for r, a, b in zip(roots, (end - 7 * per).tolist(), end.tolist(), strict=True)]


def read(fingerprints: list[str]) -> tuple[Forest, list[str]]:
    """Trees and roots as fingerprints tell them."""
    bodies = [x.partition(":")[2].encode() for x in fingerprints]
    flat = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 7)
    text = np.repeat(np.arange(len(bodies)), [len(x) // 7 for x in bodies])
    value = np.zeros(len(flat), np.int64)
    for j in range(1, 7):
        value = value << 6 | _VALUE[flat[:, j]]
    level = np.select([flat[:, 0] == ord("|"), flat[:, 0] == ord("/")], [0, 1], 2)
    up = [text[level == 0], (np.cumsum(level == 0) - 1)[level == 1], (np.cumsum(level == 1) - 1)[level == 2]]
    weight: list = [None, None, _VALUE[flat[level == 2, 0]]]
    for k in (1, 0):
        weight[k] = np.bincount(up[k + 1], weight[k + 1], minlength=int((level == k).sum())).astype(np.int64)
    return Forest(len(bodies), [value[level == k] for k in range(3)], weight, up), [x.partition(":")[0] for x in fingerprints]


def fingerprint(text: str | None) -> str:
    """root:tree of one text."""
    return write(*plant(pa.array([text], pa.large_string())))[0]


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of two lists' keys is matched by one of the other's, each matching one."""
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = int(code.max()) + 1 if len(code) else 0
    out = []
    for mine, other in ((code[: len(a)], code[len(a) :]), (code[len(a) :], code[: len(a)])):
        order = np.argsort(mine, kind="stable")
        start = np.searchsorted(mine[order], mine[order])
        nth = np.empty(len(mine), np.int64)
        nth[order] = np.arange(len(mine)) - start
        out.append(nth < np.bincount(other, minlength=n)[mine])
    return out[0], out[1]


def alike(a: Forest, b: Forest, same: np.ndarray) -> np.ndarray:
    """The likeness of each text of ``a`` to that of ``b`` in its place. same: whether their roots are equal."""
    total = np.bincount(a.up[0], a.weight[0], minlength=a.rows) + np.bincount(b.up[0], b.weight[0], minlength=a.rows)
    common = np.zeros(a.rows)
    text = [a.up[0], b.up[0]]
    left = [np.ones(len(x), bool) for x in text]
    for level in range(3):
        if level:
            text = [t[f.up[level]] for t, f in zip(text, (a, b), strict=True)]
            left = [x[f.up[level]] for x, f in zip(left, (a, b), strict=True)]
        at = [np.flatnonzero(x) for x in left]
        key = [K.mix(f.digest[level][i].astype(np.uint64)) ^ K.mix(t[i].astype(np.uint64) + np.uint64(1)) for f, t, i in zip((a, b), text, at, strict=True)]
        hit = _matched(*key)
        common += np.bincount(text[0][at[0][hit[0]]], a.weight[level][at[0][hit[0]]], minlength=a.rows)
        for x, i, h in zip(left, at, hit, strict=True):
            x[i[h]] = False
    return np.where(same, 1.0, np.divide(2 * common, total, out=np.zeros(a.rows), where=total > 0))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    (x, p), (y, q) = read([a]), read([b])
    return float(alike(x, y, np.array([p == q]))[0])


def _changes(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """Ranges of ``a`` and of ``b`` between the branches that two lists have in common, in order."""
    return [(i, j, k, n) for op, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places, in ``a``'s order, whose branches differ between two fingerprints. Sections are aligned by digest, and
    within what differs paragraphs are, so what only moved along is the same; one that ``a`` lacks is told by the place in ``a``
    it would have taken."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    (x, _), (y, _) = read([a]), read([b])
    inner = [[f.digest[1][f.up[1] == s].tolist() for s in range(len(f.digest[0]))] for f in (x, y)]
    out = []
    for i, j, k, n in _changes(x.digest[0].tolist(), y.digest[0].tolist()):
        at = [((s, p), t) for s in range(i, j) for p, t in enumerate(inner[0][s])]
        end = (j - 1, at[-1][0][1] + 1) if at else (i, 0)
        places = [*(place for place, _ in at), end]
        for v, w, _, _ in _changes([t for _, t in at], [t for s in inner[1][k:n] for t in s]):
            out += places[v : max(w, v + 1)]
    return list(dict.fromkeys(out))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many, or all, of the next one's."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, fn, schema: str, key: str = "doc_id", text: str = "text", size: int = K.CHUNK // 4) -> DataFrame:
    """``fn(texts, next texts)`` -> dict of columns, on slices of rows, beside the key. Order: descending key, then descending hash of the
    text; after the last comes the first.

    One shuffle of the texts. A sample of about RANGES * SAMPLED rows at most, drawn by hash, gives the places that cut the order into
    ranges, several for each task and dealt to them in turn. They are places of rows, so it is known which row leads a range: it is sent to the range before it
    as well. Rows of one key are cut by their texts' hashes; only rows alike in key and text share a range whatever their number.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = min(8 * parts(spark), RANGES)
    place = lambda k, t: (k is not None, k if k is not None else 0, t)
    every = max(1, docs.count() // (n * SAMPLED))
    drawn = rows.select("key", "tie").where(F.pmod(F.xxhash64("key", "tie", F.lit(29)), F.lit(every)) == 0).distinct().collect()
    top = rows.agg(F.max(F.struct("key", "tie")).alias("top")).first()["top"]
    if top is None:
        return spark.createDataFrame([], f"{key} {kind}, {schema}")
    seen = sorted({place(*r) for r in drawn})
    top = place(*top)
    cuts = sorted({seen[len(seen) * i // n] for i in range(1, n)} - {top})  # ascending; range i holds what is below i of them

    @F.arrow_udf("struct<p:int,leads:boolean>")
    def ranged(key: pa.Array, tie: pa.Array) -> pa.Array:
        at = [place(k, t) for k, t in zip(key.to_pylist(), tie.to_pylist(), strict=True)]
        low = [bisect_left(cuts, x) for x in at]
        p = [len(cuts) - i for i in low]
        leads = [x == top or (i < len(cuts) and cuts[i] == x) for x, i in zip(at, low, strict=True)]
        return pa.StructArray.from_arrays([pa.array(p, pa.int32()), pa.array(leads, pa.bool_())], ["p", "leads"])

    tagged = rows.withColumn("r", ranged("key", "tie"))
    before = F.pmod(F.col("r.p") - 1, F.lit(len(cuts) + 1))
    both = tagged.withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("r.p").alias("p"), F.lit(0).alias("after")), F.when(F.col("r.leads"), F.struct(before.alias("p"), F.lit(1).alias("after")))))))
    dealt = both.select("to.p", "to.after", "key", "tie", "text").repartitionById(parts(spark), F.col("p") % parts(spark)).sortWithinPartitions("p", "after", F.desc_nulls_last("key"), F.desc("tie"))
    names = dealt.columns

    def go(batches):
        held = None  # (p, key, text) awaiting its next
        keys, texts, following, room = [], [], [], 0

        def flush():
            out = {"key": pa.array(keys, full["key"])} | fn(texts, following)
            return pa.RecordBatch.from_pydict({c: x if isinstance(x, pa.Array) else pa.array(x, full[c]) for c, x in out.items()})

        for batch in batches:
            for p, after, k, _, t in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and held[0] == p:
                    keys.append(held[1]), texts.append(held[2]), following.append(t)
                    room += len(held[2])
                    if room >= size:
                        yield flush()
                        keys, texts, following, room = [], [], [], 0
                held = None if after else (p, k, t)  # of several followers alike only the first counts
        if keys:
            yield flush()

    shape = spark.createDataFrame([], f"key {kind}, {schema}").schema
    full = {f.name: to_arrow_type(f.dataType) for f in shape}
    return dealt.mapInArrow(go, shape).withColumnRenamed("key", key)


def compare(texts: list[str], following: list[str]) -> dict:
    """What op9 returns of each text beside its key. A following text that is the next row's is planted once."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    more = [f for f, t in zip(following, [*texts[1:], None], strict=True) if f is not t]
    forest, roots = plant(pa.array([*texts, *more], pa.large_string()))
    n, place = len(texts), np.arange(1, len(texts) + 1)
    other = np.array([f is not t for f, t in zip(following, [*texts[1:], None], strict=True)])
    place[other] = n + np.arange(len(more))
    mine, next_ = forest.take(np.arange(n)), forest.take(place)
    own, root = plant(pa.array(new, pa.large_string()))
    same = lambda x: np.array([a == b for a, b in zip(roots[:n], x, strict=True)])
    return {
        "n_chars": [len(t) for t in texts], "edited_sha256": [sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new], "fingerprint": write(mine, roots[:n]), "edited_fingerprint": write(own, root),
        "near_edited": alike(mine, own, same(root)).tolist(), "near_next": alike(mine, next_, same([roots[i] for i in place])).tolist(),
    }


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs, compare, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
