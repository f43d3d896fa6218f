"""A stored inverted index: posting lists in packed blocks, opened by bucket, decoded by need, and updated by segments.

A block is the postings of one term whose document numbers agree but for their last ``shift`` bits: gaps and counts as bytes, with the
first and last number and their count beside them. A term's shift follows its frequency, so that its blocks hold PER_BLOCK postings or so, and a
document's block is its number without those bits: that is how a list is skipped in. Blocks are a table bucketed by term. A lookup
opens its terms' buckets only; a term in more than HOT blocks is written by several tasks, into as many files of its bucket.

AND decodes the rarer side first and, of the other side, the blocks that its documents fall in. OR decodes both.

An index is a folder of segments in the order of their arrival. A document belongs to the last segment that has it; ``add`` writes one more
segment, ``compact`` makes one of all. The manifest names the segments; it is replaced as the last act of either, so a reader sees the index as
it was or as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions import planes, vint
from millrace.functions import text as T
from millrace.functions.grouped import whole_groups
from millrace.operators.index import BLOCK, posting_lists, postings
from millrace.plans.lineage import commit, committed, exists, remove
from millrace.plans.rpn import AND, compile_query

PER_BLOCK, HOT = 128, 1 << 14
MOST_SHIFT = 62
#: Words that are counted, and postings that are sorted, at once.
TOKENS, SLICE = 1 << 20, 1 << 21
RUNS = "term string, first long, n long, gaps binary, tfs binary"
BLOCKS = "term string, shift int, block long, first long, last long, n int, gaps binary, tfs binary"
TERMS = "term string, df long, shift int, blocks long"


def _shift(df: np.ndarray, documents: int) -> np.ndarray:
    """The least shift by which the blocks of a term in ``df`` of so many documents hold PER_BLOCK postings, if its documents stand evenly."""
    return np.minimum(np.ceil(np.log2(np.maximum(1.0, float(PER_BLOCK * max(documents, 1)) / df))), MOST_SHIFT).astype(np.int64)


def _sorted(code: np.ndarray, docno: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same postings by code and document."""
    same = code[1:] == code[:-1]
    if ((code[1:] > code[:-1]) | (same & (docno[1:] > docno[:-1]))).all():
        return code, docno, tf
    order = np.lexsort((docno, code))
    return code[order], docno[order], tf[order]


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are alike in all columns begin, and the end."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new)).astype(np.int64)


def _gaps(docno: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Distances to the document before; 0 for the first of a row, which stands beside them."""
    gap = np.diff(docno, prepend=0)
    gap[off[:-1]] = 0
    return gap


def _docnos(first: np.ndarray, gap: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Documents out of ``_gaps`` and each row's first one."""
    upto = np.cumsum(gap)
    return upto + np.repeat(first - upto[np.cumsum(n) - n], n)


def _run_batch(terms: pa.Array, code: np.ndarray, docno: np.ndarray, tf: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Runs of postings in order, terms given by their place in ``terms``; a run ends where its term, or what ``more`` says, does."""
    off = _bounds(code, *more)
    at = off[:-1]
    return pa.RecordBatch.from_pydict({"term": terms.take(pa.array(code[at])), "first": pa.array(docno[at]), "n": pa.array(np.diff(off)), "gaps": planes.pack(_gaps(docno, off), off), "tfs": planes.pack(tf, off)})


def runs(docs: DataFrame) -> DataFrame:
    """The postings of documents (docno, text) of different numbers, as runs: a slice of documents counts its words and writes, for each, the numbers of
    the documents that hold it, in order, as distances, and how often they do. So a term is sent once a slice, and a posting is some two bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def of_slice() -> pa.RecordBatch:
            words = pa.chunked_array([h[0] for h in held]).unify_dictionaries()
            code = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
            return _run_batch(words.chunk(0).dictionary, *_sorted(code, *(np.concatenate([h[i] for h in held]) for i in (1, 2))))

        for batch in batches:
            lists = batch.column("t")
            off = lists.offsets.to_numpy().astype(np.int64)
            docno = batch.column("docno").to_numpy()
            lo = 0
            while lo < len(docno):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + TOKENS, "right")) - 1)
                words = lists.values.slice(off[lo], off[hi] - off[lo]).dictionary_encode()
                if len(words):
                    at = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
                    key, tf = np.unique(at * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
                    row, code = np.divmod(key, len(words.dictionary))
                    held.append((pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), words.dictionary), docno[lo:hi][row], tf))
                    size += len(key)
                lo = hi
                if size >= SLICE:
                    yield of_slice()
                    held, size = [], 0
        if held:
            yield of_slice()

    return docs.select("docno", T.tokens("text").alias("t")).mapInArrow(go, RUNS)


def runs_of(index: DataFrame) -> DataFrame:
    """Runs of postings (term, docno, tf), none of which stands twice."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = batch.column("term").dictionary_encode()
                got = _sorted(words.indices.to_numpy().astype(np.int64), batch.column("docno").to_numpy(), batch.column("tf").to_numpy().astype(np.int64))
                yield _run_batch(words.dictionary, *got)

    return index.select("term", F.col("docno").cast("long").alias("docno"), "tf").mapInArrow(go, RUNS)


def _postings_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n of each run, and docno and tf of every posting."""
    n = batch.column("n").to_numpy()
    return n, _docnos(batch.column("first").to_numpy(), planes.unpack(batch.column("gaps"), n), n), planes.unpack(batch.column("tfs"), n)


def lists(docs: DataFrame, docno: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``posting_lists`` of documents, by their runs: a slice of documents sends a term and block once, and those of one meet in one task, which sums the
    counts of a number that stands twice. Documents without a number go by ``posting_lists``; no more than the file's statistics are read where there are none."""
    numbered = docs.select(F.col(docno).cast("long").alias("docno"), F.col(text).alias("text"))

    def cut_at_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, at, tf = _postings_of(batch)
                row = np.repeat(np.arange(len(n)), n)
                got = _run_batch(batch.column("term"), row, at, tf, at // block)
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(got.column("first").to_numpy() // block)], names=[*got.schema.names, "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["term", "block"], "n", SLICE):
            n, at, tf = _postings_of(batch)
            key, at, tf = _sorted(np.repeat(np.cumsum(np.bincount(starts, minlength=len(n))) - 1, n), at, tf)
            one = _bounds(key, at)
            key, at, tf = key[one[:-1]], at[one[:-1]], np.add.reduceat(tf, one[:-1])
            off = np.searchsorted(key, np.arange(len(starts) + 1))
            gap = np.diff(at, prepend=0)
            gap[off[:-1]] = at[off[:-1]]
            got = pa.StructArray.from_arrays([pa.array(gap), pa.array(tf.astype(np.int32))], ["gap", "tf"])
            yield pa.RecordBatch.from_pydict({"term": batch.column("term").take(pa.array(starts)), "block": batch.column("block").take(pa.array(starts)), "postings": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), got)})

    cut_ = runs(numbered.where("docno IS NOT NULL")).mapInArrow(cut_at_blocks, f"{RUNS}, block long")
    dealt = cut_.repartition("term", "block").sortWithinPartitions("term", "block", "first")
    got = dealt.mapInArrow(merge, "term string, block long, postings array<struct<gap: long, tf: int>>")
    return got.unionByName(posting_lists(postings(numbered.where("docno IS NULL"), "docno"), block))


def _cut_hot(found: DataFrame, hot: dict[str, int], documents: int) -> DataFrame:
    """Runs with ``piece``: those of hot terms cut into pieces of whole blocks, the others (piece -1) as they are."""
    blocks = max(1, HOT >> 8)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, docno, tf = _postings_of(batch)
            row = np.repeat(np.arange(len(n)), n)
            shift = _shift(np.array([hot[t] for t in batch.column("term").to_pylist()]), documents)
            piece = (docno >> shift[row]) // blocks
            got = _run_batch(batch.column("term"), row, docno, tf, piece)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(piece[_bounds(row, piece)[:-1]])], names=[*got.schema.names, "piece"])

    cold = found.withColumn("piece", F.lit(-1).cast("long"))
    if not hot:
        return cold
    is_hot = F.col("term").isin(*hot)
    return cold.where(~is_hot).unionByName(found.where(is_hot).mapInArrow(go, f"{RUNS}, piece long"))


def pack(dealt: DataFrame, hot: dict[str, int], documents: int) -> DataFrame:
    """Blocks of runs that lie in order of (term, piece), all those of one in one task."""

    def blocks(t: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        n, docno, tf = _postings_of(t)
        key = np.repeat(np.cumsum(np.bincount(starts, minlength=len(n))) - 1, n)
        df = np.bincount(key, minlength=len(starts))
        terms = t.column("term").take(pa.array(starts))
        if hot:
            df = np.array([hot.get(w, d) for w, d in zip(terms.to_pylist(), df, strict=True)])
        shift = _shift(df, documents)
        key, docno, tf = _sorted(key, docno, tf)
        block = docno >> shift[key]
        off = _bounds(key, block)
        at = off[:-1]
        return pa.RecordBatch.from_pydict({
            "term": terms.take(pa.array(key[at])), "shift": pa.array(shift[key[at]].astype(np.int32)), "block": pa.array(block[at]),
            "first": pa.array(docno[at]), "last": pa.array(docno[off[1:] - 1]), "n": pa.array(np.diff(off).astype(np.int32)), "gaps": vint.pack(_gaps(docno, off), off), "tfs": vint.pack(tf, off),
        })

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last term and piece, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and _starts(held[-1].slice(held[-1].num_rows - 1), batch).tolist() == [0]:
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            starts = _starts(t)
            upto = np.concatenate(([0], np.cumsum(t.column("n").to_numpy())))
            lo = 0
            while lo < len(starts) - 1:  # terms of SLICE postings or so at once
                hi = max(lo + 1, min(len(starts) - 1, int(np.searchsorted(upto[starts], upto[starts[lo]] + SLICE, "right")) - 1))
                yield blocks(t.slice(starts[lo], starts[hi] - starts[lo]), starts[lo:hi] - starts[lo])
                lo = hi
            held = [t.slice(starts[-1])]
        if held:
            yield blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0], np.zeros(1, np.int64))

    return dealt.mapInArrow(go, BLOCKS)


def _starts(*batches: pa.RecordBatch) -> np.ndarray:
    """Where rows of another term or piece begin; the first one does."""
    term = pa.concat_arrays([b.column("term") for b in batches])
    piece = np.concatenate([b.column("piece").to_numpy() for b in batches])
    other = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False).astype(bool) | (piece[1:] != piece[:-1])
    return np.concatenate(([0], np.flatnonzero(other) + 1))


def unpack(blocks: DataFrame) -> DataFrame:
    """(term, docno, tf) of blocks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(np.int64)
            off = np.concatenate(([0], np.cumsum(n)))
            gap, tf = vint.unpack(batch.column("gaps")), vint.unpack(batch.column("tfs"))
            upto = np.cumsum(gap)
            docno = upto - np.repeat(upto[off[:-1]], n) + np.repeat(batch.column("first").to_numpy(), n)
            yield pa.RecordBatch.from_pydict({"term": batch.column("term").take(pa.array(np.repeat(np.arange(len(n)), n))), "docno": pa.array(docno), "tf": pa.array(tf.astype(np.int32))})

    return blocks.select("term", "first", "n", "gaps", "tfs").mapInArrow(go, "term string, docno long, tf int")


def write_segment(found: DataFrame, documents: int, path: str, buckets: int) -> None:
    """Write runs of postings as a segment's lists. Runs are written once and dealt once: a term's go to one task, which learns from them how many
    documents it is in; only terms of more than HOT blocks, of which there are few, are known before and dealt in pieces."""
    spark = found.sparkSession
    found.write.parquet(f"{path}/runs")
    found = spark.read.schema(RUNS).parquet(f"{path}/runs")
    often = found.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") > HOT * PER_BLOCK)
    hot = {r["term"]: r["df"] for r in often.collect()}  # a row for two million postings at most

    def at(df: DataFrame, name: str, *order: str) -> None:
        table = f"millrace_{uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, "term").sortBy(*order).option("path", f"{path}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")

    salt = F.when(F.col("piece") >= 0, F.pmod(F.xxhash64("piece"), F.lit(buckets))).otherwise(-1)
    dealt = _cut_hot(found, hot, documents).repartition(buckets, F.pmod(F.hash("term"), F.lit(buckets)), salt).sortWithinPartitions("term", "piece", "first")
    at(pack(dealt, hot, documents), "blocks", "term", "first")
    remove(spark, f"{path}/runs")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.first("shift").alias("shift"), F.count("*").alias("blocks"))
    at(blocks.repartition(buckets, "term"), "terms", "term")


def write_documents(docs: DataFrame, path: str) -> tuple[int, int]:
    """Write the numbers that ``docs`` (docno) has, each once; returns how many there are, and how many stand more than once."""
    seen = Observation()
    each = docs.groupBy("docno").agg(F.count("*").alias("n")).observe(seen, F.count("*").alias("n"), F.count(F.when(F.col("n") > 1, 1)).alias("again"))
    each.select("docno").write.parquet(f"{path}/documents")
    return seen.get["n"], seen.get["again"]


@dataclass
class Index:
    """A stored index as its manifest has it now."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.facts = _manifest(self.spark, self.path)
        if self.facts is None:
            raise ValueError(f"no index in {self.path}")

    @property
    def segments(self) -> list[str]:
        return self.facts["segments"]

    def table(self, segment: str, name: str) -> DataFrame:
        name_, schema = f"millrace_{uuid4().hex}", BLOCKS if name == "blocks" else TERMS
        self.spark.sql(f"CREATE TABLE {name_} ({schema}) USING parquet CLUSTERED BY (term) INTO {self.facts['buckets']} BUCKETS LOCATION '{self.path}/{segment}/{name}'")
        got = self.spark.table(name_)  # resolved by now: the files and their buckets, which stay when the name goes
        self.spark.sql(f"DROP TABLE {name_}")
        return got

    def blocks(self, segment: str, *terms: str) -> DataFrame:
        """The blocks of terms in a segment; of other buckets no file is opened."""
        return self.table(segment, "blocks").where(F.col("term").isin(*terms))

    def current(self, hits: DataFrame, i: int) -> DataFrame:
        """``hits`` (docno, ..) of segment i, without the documents that a later segment has."""
        for later in self.segments[i + 1 :]:
            hits = hits.join(self.spark.read.schema("docno long").parquet(f"{self.path}/{later}/documents"), "docno", "left_anti")
        return hits

    def postings(self, *terms: str) -> DataFrame:
        """(term, docno, tf) of terms, or of all; the last segment that has a document has its word."""
        out = None
        for i, s in enumerate(self.segments):
            got = self.current(unpack(self.blocks(s, *terms) if terms else self.table(s, "blocks")), i).select("term", "docno", "tf")
            out = got if out is None else out.unionByName(got)
        return out

    def query(self, query: str, decoded: list | None = None) -> DataFrame:
        """(docno) of the documents that meet an RPN query, each once. decoded: gets (segment, term, blocks that are decoded) for each read of a list."""
        plan = compile_query(query)
        out = None
        for i, s in enumerate(self.segments):
            facts = {r["term"]: r for r in self.table(s, "terms").where(F.col("term").isin(*plan.terms)).collect()}  # a row a term of the query
            got = self.current(self._docs(s, plan.tree, facts, None, decoded), i).select("docno")
            out = got if out is None else out.unionByName(got)
        return out

    def _docs(self, segment: str, tree, facts: dict, among: DataFrame | None, decoded: list | None) -> DataFrame:
        """(docno) of a part of a query in a segment. ``among``: only these documents matter; blocks without one of them aren't decoded."""
        if isinstance(tree, str):
            blocks = self.blocks(segment, tree)
            if tree not in facts:
                blocks = blocks.where(F.lit(False))
            elif among is not None:
                blocks = blocks.join(among.select(F.shiftright("docno", facts[tree]["shift"]).alias("block")).distinct(), "block", "left_semi")
            if decoded is not None:
                decoded.append((segment, tree, blocks.select("block")))
            return unpack(blocks).select("docno")
        op, left, right = tree
        if op == AND:
            first, second = sorted((left, right), key=lambda t: _size(t, facts))
            rare = self._docs(segment, first, facts, among, decoded)
            return rare.join(self._docs(segment, second, facts, rare, decoded), "docno", "left_semi")
        return self._docs(segment, left, facts, among, decoded).union(self._docs(segment, right, facts, among, decoded)).distinct()

    def reads(self, query: str) -> DataFrame:
        """(segment, term, blocks, decoded): for each list that a query reads, its blocks and how many of them are decoded."""
        got: list = []
        self.query(query, got)
        out = None
        for i, (segment, term, blocks) in enumerate(got):
            row = self.blocks(segment, term).agg(F.count("*").alias("blocks")).crossJoin(blocks.agg(F.count("*").alias("decoded")))  # one row each
            row = row.select(F.lit(i).alias("read"), F.lit(segment).alias("segment"), F.lit(term).alias("term"), "blocks", "decoded")
            out = row if out is None else out.unionByName(row)
        return out


def _size(tree, facts: dict) -> int:
    """How many documents a part of a query has at most."""
    if isinstance(tree, str):
        return facts[tree]["df"] if tree in facts else 0
    sizes = [_size(t, facts) for t in tree[1:]]
    return min(sizes) if tree[0] == AND else sum(sizes)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    n, got = 0, None
    if exists(spark, f"{path}/manifests"):
        while (facts := committed(spark, f"{path}/manifests/{n}")) is not None:
            n, got = n + 1, facts | {"number": n}
    return got


def create(docs: DataFrame, path: str, buckets: int | None = None, docno: str = "doc_id", text: str = "text") -> Index:
    """Make an index of ``docs`` in ``path``, in place of whatever is there."""
    spark = docs.sparkSession
    remove(spark, path)
    return _append(spark, docs, path, {"segments": [], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "number": -1}, docno, text)


def add(index: Index, docs: DataFrame, docno: str = "doc_id", text: str = "text") -> Index:
    """One more segment: ``docs`` are new, or replace those of their number."""
    return _append(index.spark, docs, index.path, index.facts, docno, text)


def _append(spark: SparkSession, docs: DataFrame, path: str, facts: dict, docno: str, text: str) -> Index:
    docs = docs.select(F.col(docno).cast("long").alias("docno"), F.col(text).alias("text")).where("docno IS NOT NULL")
    name = f"segment-{uuid4().hex}"
    n, again = write_documents(docs, f"{path}/{name}")
    found = runs(docs)
    if again:  # documents of one number are one: their words are summed
        several = docs.groupBy("docno").agg(F.count("*").alias("n")).where("n > 1").select("docno")
        found = runs(docs.join(several, "docno", "left_anti")).unionByName(runs_of(postings(docs.join(several, "docno", "left_semi"), "docno", "text")))
    write_segment(found, n, f"{path}/{name}", facts["buckets"])
    return _publish(spark, path, facts, [*facts["segments"], name])


def _publish(spark: SparkSession, path: str, facts: dict, segments: list[str]) -> Index:
    number = facts["number"] + 1
    if committed(spark, f"{path}/manifests/{number}") is not None:
        raise RuntimeError("the index has changed meanwhile")
    commit(spark, f"{path}/manifests/{number}", {"segments": segments, "buckets": facts["buckets"]})
    return Index(spark, path)


def compact(index: Index) -> Index:
    """One segment of all; the old ones go once no manifest of before is read any more (``vacuum``)."""
    spark, name = index.spark, f"segment-{uuid4().hex}"
    documents = None
    for s in index.segments:
        got = spark.read.schema("docno long").parquet(f"{index.path}/{s}/documents")
        documents = got if documents is None else documents.unionByName(got)
    n, _ = write_documents(documents, f"{index.path}/{name}")
    write_segment(runs_of(index.postings()), n, f"{index.path}/{name}", index.facts["buckets"])
    return _publish(spark, index.path, index.facts, [name])


def vacuum(index: Index, before: list[str]) -> None:
    """Delete segments named ``before`` that the index no longer has."""
    for s in set(before) - set(index.segments):
        remove(index.spark, f"{index.path}/{s}")
