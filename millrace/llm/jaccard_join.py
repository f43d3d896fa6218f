"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles (lower-cased runs of letters, marks and numbers; a text of one to four words
has one shingle, all its words). Equal sets form a *class*, and one representative of each goes on.

* Forest: TREES prefix tries of DEPTH MinHash values each. ``prefix_depth`` is how far a matched prefix may be shortened, the longest at which
  the predicted recall of a pair at the threshold reaches RECALL; the members that share it are a *node*, and any two of them meet.
* A node's smallest member is its *head*. Rows whose signature agrees with the head's (``floor_of``) are linked to it, and two such rows
  aren't compared again; so a group writes at most one link a row. A row that doesn't agree with the head is compared with all
  others of its node. Nodes of more than REACH rows are dealt to pairs of blocks, so that no task holds a whole one. Links only gather candidates, and a row's links to several heads are drawn together before components
  are found: each row keeps the smallest, and heads are linked among themselves.
* A gathering of more than one block is looked at more closely before it is verified: its members get signatures of LEVELS[1] values, and are
  matched and gathered once more by these. Families that are only loosely alike, which agree with one another by chance in 120 values, fall apart;
  pairs at the threshold stay together.
* Verification: the members of one connected gathering are compared all with all on whole shingle sets, by exact Jaccard
  similarity. A gathering is dealt into blocks of at most BLOCK members and about BLOCK_SHINGLES shingles, and each pair of blocks is one
  group, so no task holds more than two blocks; a set is sent as often as its gathering has blocks. Each class gets its number of
  links, and verified links make the final classes.

Defined results: null and empty texts have no shingle, hence no link, and are their own class; repeated rows and equal texts
are one class and link to each other; null keys take part but never name a class unless the class has no other; extra columns
are ignored. A row is known by its key and its text's hash, so a key may repeat with other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import cut, map_chunks, table
from millrace.operators.graph import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 6
RECALL = 0.99999
#: Values of a signature, the first TREES * DEPTH of which make the trees. Gatherings of more than a block are drawn again by the next.
LEVELS = (TREES * DEPTH, 480)
DEVIATIONS = 4.9  # of a signature's agreement: a pair at THRESHOLD falls so far below it one time in two million
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Rows of a block of a node; larger nodes are dealt to pairs of blocks.
REACH = 2048


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in one tree at least, with the recall asked for."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def floor_of(values: int) -> float:
    """The share of a signature's values in which a pair at THRESHOLD agrees at least: 0.62 of 120, 0.71 of 480."""
    return THRESHOLD - DEVIATIONS * (THRESHOLD * (1 - THRESHOLD) / values) ** 0.5


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and their offset per row."""
    cps, off = K.codepoints(text)
    low = K.lower_map()[cps]
    s, e, words = K.runs(K.word_mask()[cps], off)
    h = K.span_hashes(low, s, e)
    n = np.diff(words)
    w, row, _ = K.window_hashes(h, words, WORDS)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        code = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            has = n[short] > j
            code[has] = K.mix(code[has] * np.uint64(0x9FB21C651E98DF25) + h[words[short[has]] + j] + np.uint64(j + 1))
        w, row = np.concatenate([w, code]), np.concatenate([row, short])
    order = np.lexsort((w, row))
    w, row = w[order], row[order]
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
    w, row = w[keep], row[keep]
    return w, np.searchsorted(row, np.arange(len(off)))


def digests(w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    n = np.diff(off).astype(np.uint64)
    one = K.mix(K.segment_sums(K.mix(w + np.uint64(0x51)), off) + n)
    return one.view(np.int64), K.mix(K.segment_sums(K.mix(w ^ np.uint64(0xABCDEF)), off) + n).view(np.int64)


def _coefficients(values: int) -> np.ndarray:
    return K.mix(np.arange(1, values + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(w: np.ndarray, off: np.ndarray, values: int = LEVELS[0]) -> np.ndarray:
    """MinHash values, rows x ``values``, of non-empty rows (zeros for empty ones)."""
    out = np.zeros((len(off) - 1, values), np.uint32)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        at = off[:-1][full]
        for j, a in enumerate(_coefficients(values)):
            x = ((w * a) >> np.uint64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(x, at)
    return out


def tree_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit key per row and tree: the tree and its first ``depth`` values."""
    out = np.zeros((len(sig), TREES), np.uint64)
    for t in range(TREES):
        k = np.full(len(sig), t + 1, np.uint64)
        for j in range(depth):
            k = K.mix(k * np.uint64(0x9FB21C651E98DF25) + sig[:, t * DEPTH + j].astype(np.uint64))
        out[:, t] = k
    return out.view(np.int64)


def _low_bytes(sig: np.ndarray) -> pa.Array:
    """The low byte of every value, a row's as one binary value."""
    low = np.ascontiguousarray((sig & 0xFF).astype(np.uint8))
    at = np.arange(len(sig) + 1, dtype=np.int32) * sig.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(at), pa.py_buffer(low.tobytes())])


def tie_of(text: str) -> Column:
    """What tells rows of one key apart."""
    return F.xxhash64(F.col(text))


def _first() -> Column:
    """Of rows with key and tie: the smallest, null keys last."""
    return F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tie"))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tie: the text's hash, d1, d2, n_shingles, sig: the low byte of every MinHash value, keys: one per tree). One narrow pass."""
    depth = prefix_depth()

    def go(part: pa.RecordBatch) -> dict:
        w, off = shingles(part.column("text"))
        one, two = digests(w, off)
        sig = signatures(w, off)
        keys = tree_keys(sig, depth)
        size = np.arange(len(sig) + 1, dtype=np.int32)
        return {
            "key": part.column("key"), "tie": part.column("tie"), "d1": pa.array(one), "d2": pa.array(two), "n": pa.array(np.diff(off).astype(np.int64)),
            "sig": _low_bytes(sig),
            "keys": pa.ListArray.from_arrays(pa.array(size * TREES), pa.array(keys.ravel())),
        }

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), tie_of(text).alias("tie"))
    return map_chunks(rows, go, f"key {kind}, tie long, d1 long, d2 long, n long, sig binary, keys array<long>", size=K.CHUNK // 2)


def dealt(df: DataFrame, group: str, member: str, blocks: str) -> DataFrame:
    """Rows of each group, dealt to pairs of its blocks (bi <= bj; side 0: block bi, 1: block bj) so that every two members meet
    once or, within one block, in that block's own group. Adds bi, bj, side."""
    b = F.pmod(F.xxhash64(F.col(member), F.lit(5)), F.col(blocks)).cast("int")
    return (
        df.withColumn("_b", b)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("bi", F.least("_b", "_o"))
        .withColumn("bj", F.greatest("_b", "_o"))
        .withColumn("side", (F.col("_b") > F.col("_o")).cast("int"))
        .drop("_b", "_o")
    )


def by_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` on each group of rows (bounded by two blocks), streamed through sorted partitions; fn gets a Table and yields dicts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                t = pa.Table.from_batches(kept).combine_chunks()
                kept.clear()
                yield pa.RecordBatch.from_pydict(fn(t))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            new[0] = first != last
            last = tuple(c[-1] for c in cols)
            starts = [*np.flatnonzero(new), batch.num_rows]
            if not new[0]:
                kept.append(batch.slice(0, starts[0]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from flush()
                kept.append(batch.slice(a, b - a))
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, schema)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links a-b: each member beside its component's smallest member."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def _near(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether signatures agree as far as pairs at THRESHOLD do, row by row."""
    return (sig == other).sum(axis=1) >= floor_of(sig.shape[1]) * sig.shape[1]


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows."""
    o = K.offsets(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]].reshape(len(column), -1)


def _match(tree: np.ndarray, ids: np.ndarray, sig: np.ndarray, head: np.ndarray, head_sig: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smaller member) between rows in order of their nodes: to heads, and for what no head accounts for between any two rows of a
    node, where blocks of it are dealt between those of different sides."""
    n = len(ids)
    first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if n else np.zeros(0, np.int64)
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    node = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    to_head = _near(sig, head_sig)
    a, b = [np.flatnonzero(to_head)], [n + node[to_head]]  # heads are vertices of their own, after the rows
    for i in np.flatnonzero(~to_head):  # two rows that agree with the head are gathered by it
        start = first[node[i]]
        ask = np.concatenate([start + np.flatnonzero(to_head[start:i]), np.arange(i + 1, end[i])])  # others before it have asked
        ask = ask if side is None or side[i] < 0 else ask[side[ask] != side[i]]
        hit = ask[_near(sig[ask], sig[i])]
        a.append(hit), b.append(np.full(len(hit), i))
    a, b = np.concatenate(a), np.concatenate(b)
    name = np.concatenate([ids, head[first]])
    order = np.argsort(name, kind="stable")  # the spanning set hangs each member on its component's smallest id
    rank = np.empty(len(name), np.int64)
    rank[order] = np.arange(len(name))
    x, y = _spanning(len(name), rank[a], rank[b])
    x, y = name[order[x]], name[order[y]]
    return x[x != y], y[x != y]


def forest(reps: DataFrame) -> DataFrame:
    """(a, b), b < a: links that gather the candidates among classes (id, keys: one per tree, sig)."""
    flat = reps.select("id", F.posexplode("keys").alias("t", "tree"))
    nodes = flat.groupBy("tree").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1")
    nodes = nodes.withColumn("blocks", F.ceil(F.col("size") / REACH)).join(reps.select(F.col("id").alias("head"), F.col("sig").alias("head_sig")), "head")
    rows = flat.join(nodes, "tree").select("tree", "id", "head", "head_sig", "blocks").join(reps.select("id", "sig"), "id")
    # a node of more than REACH rows is dealt to pairs of its blocks, so that all its rows meet and no task holds more than two
    rows = dealt(rows, "tree", "id", "blocks").select("tree", "bi", "bj", F.when(F.col("bi") == F.col("bj"), -1).otherwise(F.col("side")).alias("side"), "id", "sig", "head", "head_sig")
    keys = ["tree", "bi", "bj"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last group, which may go on

        def links(t: pa.RecordBatch) -> pa.RecordBatch:
            new = _changes(t, keys)
            x, y = _match(np.cumsum(new), t.column("id").to_numpy(), _bytes(t.column("sig")), t.column("head").to_numpy(), _bytes(t.column("head_sig")), t.column("side").to_numpy())
            return pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_changes(t, keys))[-1])
            if last:
                yield links(t.slice(0, last))
            held = [t.slice(last)]
        if held:
            yield links(held[0])

    return drawn_together(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, "a long, b long"))


def _changes(t: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; the first one's do."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return new


def drawn_together(links: DataFrame) -> DataFrame:
    """The same components from fewer links: each a beside its smallest b only, and those b beside one another."""
    links = cut(links.distinct())
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    among = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    return low.select("a", F.col("low").alias("b")).unionByName(among)


def _verify(t: pa.Table) -> dict:
    """Exact links within one group: per member the weight of its partners, and a spanning link (itself, where it has none)."""
    ids, weight, side = (t.column(c).to_numpy() for c in ("id", "weight", "side"))
    _, once = np.unique(ids, return_index=True)  # a key that repeats may have brought a class twice
    ids, weight, side = ids[once], weight[once], side[once]
    col = t.column("set").combine_chunks() if isinstance(t.column("set"), pa.ChunkedArray) else t.column("set")
    sets = [np.frombuffer(col[int(i)].as_buffer(), np.uint64) for i in once]
    n = np.array([len(x) for x in sets])
    across = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
    both = np.zeros((len(sets), len(sets)), np.float32)
    u, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[code] > 1
    place = np.cumsum(count > 1) - 1
    row, code, width = row[shared], place[code[shared]], int((count > 1).sum())
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(code, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        m[row[i:j], code[i:j] - lo] = 1
        both += m @ m.T
    hit = np.zeros(both.shape, bool)
    for lo in range(0, len(sets), 256):
        strip = both[lo : lo + 256].astype(np.float64)
        hit[lo : lo + 256] = strip >= THRESHOLD * (n[lo : lo + 256, None] + n[None, :] - strip) - 1e-9
    np.fill_diagonal(hit, False)
    if across:
        hit &= side[:, None] != side[None, :]
    links = hit @ weight
    a, b = np.nonzero(hit)
    x, y = _spanning(len(sets), a, b)
    to = np.arange(len(sets))
    to[x] = y
    some = links > 0
    return {"a": pa.array(ids[some]), "b": pa.array(ids[to[some]]), "links": pa.array(links[some].astype(np.int64))}


def gathered(reps: DataFrame, facts: DataFrame) -> DataFrame:
    """The columns of ``facts`` with root (of the gathering of candidates that a class belongs to) and blocks (of that gathering). Classes
    without a candidate are left out."""
    comp = cut(components(forest(reps), "a", "b").join(facts, "id"))
    size = comp.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    return comp.join(size, "root")


def of_text(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (rep, tie, ..) with the text of each one's representative."""
    return texts.join(classes, texts["rep"].eqNullSafe(classes["rep"]) & (texts["tie"] == classes["tie"])).drop(texts["rep"], texts["tie"])


def gatherings(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, rep, tie, weight, n, d1, d2, root, blocks) of the classes that have a candidate: which gathering each belongs to. One that is more
    than a block is drawn again by longer signatures."""
    facts = reps.select("id", "rep", "tie", "weight", "n", "d1", "d2")
    comp = gathered(reps, facts)
    for values in LEVELS[1:]:
        large = cut(comp.where("blocks > 1").select("id", "rep", "tie", "d1", "d2"))
        if not large.limit(1).count():
            break

        def longer(part: pa.RecordBatch, values: int = values) -> dict:
            w, off = shingles(part.column("text"))
            one, two = digests(w, off)
            same = np.flatnonzero((one == part.column("d1").to_numpy()) & (two == part.column("d2").to_numpy()))
            return {"id": part.column("id").take(pa.array(same)), "sig": _low_bytes(signatures(w, off, values)[same])}

        again = map_chunks(of_text(texts, large).select("text", "id", "d1", "d2"), longer, "id long, sig binary", size=K.CHUNK // 2)
        again = cut(again.dropDuplicates(["id"]).join(reps.select("id", "keys"), "id"))  # a key that repeats brings a class twice
        comp = comp.where("blocks = 1").unionByName(gathered(again, facts))
    return comp


def rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of join(), tie (tie_of the text) and stays: whether key and tie are those of the one row that stands for the
    class, the smallest of its keyed rows. Of a class's rows with a null key one stays as well, since no key says whose copy
    they are. Rows without a shingle all stay."""
    sk = cut(sketch(docs, key, text))
    ident = F.xxhash64("d1", "d2")
    whole = sk.where("n > 0").groupBy("d1", "d2").agg(_first().alias("top"), F.min(F.when(F.col("key").isNull(), F.col("tie"))).alias("null_tie"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    reps = cut(whole.withColumns({"id": ident, "rep": F.col("top.key"), "tie": F.col("top.tie")}).drop("top"))
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"), tie_of(text).alias("tie"))
    placed = gatherings(texts, reps).select("id", "rep", "tie", "weight", "d1", "d2", "root", "blocks")

    def sets(part: pa.RecordBatch) -> dict:
        w, off = shingles(part.column("text"))
        one, two = digests(w, off)
        same = (one == part.column("d1").to_numpy()) & (two == part.column("d2").to_numpy())
        rows = np.flatnonzero(same)
        n = np.diff(off)
        data = w.tobytes()
        return {c: part.column(c).take(pa.array(rows)) for c in ("id", "weight", "root", "blocks")} | {"set": pa.array([data[8 * off[r] : 8 * off[r] + 8 * n[r]] for r in rows], pa.binary())}

    found = of_text(texts, placed).select("text", "id", "weight", "root", "d1", "d2", "blocks")
    ready = map_chunks(found, sets, "id long, weight long, root long, blocks long, set binary", size=K.CHUNK // 2)
    ready = dealt(ready, "root", "id", "blocks").select("root", "bi", "bj", "side", "id", "weight", "set")
    links = cut(by_group(ready, ["root", "bi", "bj"], _verify, "a long, b long, links long"))
    final = components(drawn_together(links.where("b < a").select("a", "b")), "a", "b")
    n_links = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = final.join(reps.select("id", F.col("rep").alias("key"), "tie", "null_tie"), "id").groupBy("root").agg(F.min("key").alias("class_id"), _first()["tie"].alias("class_tie"), F.min("null_tie").alias("class_null"))
    of = final.join(named, "root").select("id", "class_id", "class_tie", "class_null")
    info = reps.select("id", "d1", "d2", "rep", "tie", "null_tie", "weight").join(of, "id", "left").join(n_links, "id", "left")
    info = info.select("d1", "d2", F.col("rep").alias("copy_of"), F.least(F.col("rep"), "class_id").alias("class_id"), F.coalesce("class_tie", "tie").alias("top_tie"), F.coalesce("class_null", "null_tie").alias("null_tie"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    stays = F.when(F.col("key").isNull(), F.col("tie") == F.col("null_tie")).otherwise((F.col("key") == F.col("class_id")) & (F.col("tie") == F.col("top_tie")))
    own = sk.where("n > 0").select("key", "tie", "d1", "d2", F.col("n").alias("n_shingles")).join(info, ["d1", "d2"]).select("key", "class_id", "copy_of", "n_links", "n_shingles", "tie", stays.alias("stays"))
    none = sk.where("n = 0").select("key", F.col("key").alias("class_id"), F.col("key").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), "tie", F.lit(True).alias("stays"))
    return own.unionByName(none).withColumnRenamed("key", key)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (the smallest key of its verified near-duplicate group), copy_of (the smallest key
    with the same shingle set), n_links (other documents at THRESHOLD or more, copies included), n_shingles."""
    return rows(docs, key, text).drop("tie", "stays")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, link.b FROM reach r JOIN link ON r.b = link.a)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS class_id, least(d.doc_id, (SELECT min(b) FROM link WHERE a = d.doc_id AND same)) AS copy_of,
  (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links, coalesce((SELECT n FROM n WHERE n.doc_id = d.doc_id), 0) AS n_shingles FROM documents d
"""
