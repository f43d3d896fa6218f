"""The stored index: what is opened and decoded, updates against rebuilding, packed numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import planes
from millrace.functions import vint as V
from millrace.operators import index as I
from millrace.operators import postings as P

WORDS = ["the", "of", "fox", "dog", "owl", "bee", "ant"]


def corpus(seed, n=400, start=0):
    rng = random.Random(seed)
    return [(start + i * rng.choice([1, 3]) if i < 50 else start + 1000 + i, " ".join(rng.choice(WORDS[: rng.choice([2, 4, 7])]) for _ in range(rng.randrange(5)))) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(list({d: (d, t) for d, t in docs}.values()), "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


QUERIES = ["fox", "the fox AND", "fox dog OR", "owl bee AND ant OR", "the of AND fox dog OR AND", "zebra", "zebra fox AND", "zebra fox OR", "fox fox AND"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = frame(spark, corpus(1))
    return docs, P.create(docs, str(tmp_path_factory.mktemp("index") / "i"), buckets=4)


@pytest.mark.parametrize("query", QUERIES)
def test_queries_equal_the_long_table(stored, query):
    docs, index = stored
    assert rows(index.query(query)) == rows(I.boolean_query(I.postings(docs), query))


def test_postings_come_back(stored):
    docs, index = stored
    want = rows(I.postings(docs).select("term", "docno", "tf"))
    assert rows(index.postings()) == want and rows(index.postings("owl")) == [r for r in want if r[0] == "owl"]


def test_one_term_opens_one_bucket(spark, tmp_path):
    index = P.create(frame(spark, corpus(1)), str(tmp_path / "i"), buckets=4)
    segment = tmp_path / "i" / index.segments[0] / "blocks"
    files = sorted(segment.glob("*.parquet"))
    mine = {t: index.blocks(index.segments[0], t).select(F.input_file_name()).distinct().collect() for t in WORDS}
    assert len(files) > 1 and all(len(f) == 1 for f in mine.values())
    the = mine["the"][0][0].rsplit("/", 1)[1]
    other = next(t for t in WORDS if mine[t][0][0].rsplit("/", 1)[1] != the)
    want = rows(index.postings("the"))
    for f in files:
        if f.name != the:
            f.write_bytes(b"not to be opened")
            (segment / f".{f.name}.crc").unlink(missing_ok=True)
    assert rows(P.Index(spark, index.path).postings("the")) == want
    with pytest.raises(Exception, match="parquet|Parquet|FAILED_READ_FILE"):
        P.Index(spark, index.path).postings(other).collect()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term" in index.blocks(index.segments[0], "the")._jdf.queryExecution().executedPlan().toString()


def test_and_decodes_only_blocks_that_meet(spark, tmp_path):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(5, 6, 30_000), "common rare").otherwise("common").alias("text"))
    index = P.create(docs, str(tmp_path / "i"), buckets=2)
    got = {r["term"]: (r["blocks"], r["decoded"]) for r in index.reads("common rare AND").collect()}
    assert got["rare"] == (1, 1) and got["common"][1] == 2 and got["common"][0] == -(-40_000 // 128)
    assert rows(index.query("common rare AND")) == [(5,), (6,), (30_000,)]


def test_a_hot_term_is_several_files_of_its_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "HOT", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.expr("chr(97 + id % 26)")).alias("text"))
    index = P.create(docs, str(tmp_path / "i"), buckets=3)
    hits = index.blocks(index.segments[0], "common")
    assert hits.select(F.input_file_name()).distinct().count() > 1 and len({f[0].rsplit("_", 1)[1] for f in hits.select(F.input_file_name()).distinct().collect()}) == 1
    assert index.query("common").count() == 3000 and index.query("common wc AND").count() == len(range(2, 3000, 26))


def test_updates_equal_a_rebuild(spark, tmp_path):
    first, second, third = corpus(2, 120), corpus(3, 60), corpus(4, 40, start=5000)
    path = str(tmp_path / "i")
    index = P.create(frame(spark, first), path, buckets=3)
    for more in (second, third):
        old, index = index, P.add(index, frame(spark, more))
    merged = {d: t for docs in (first, second, third) for d, t in docs}
    rebuilt = I.postings(spark.createDataFrame(list(merged.items()), "doc_id long, text string")).select("term", "docno", "tf")
    assert len(index.segments) == 3 and len(old.segments) == 2
    for state in (index, P.compact(index)):
        assert rows(state.postings()) == rows(rebuilt)
        for q in QUERIES:
            assert rows(state.query(q)) == rows(I.boolean_query(rebuilt, q))
    one = P.Index(spark, path)
    assert len(one.segments) == 1 and rows(old.query("fox")) == rows(I.boolean_query(I.postings(spark.createDataFrame(list({d: t for docs in (first, second) for d, t in docs}.items()), "doc_id long, text string")), "fox"))
    P.vacuum(one, index.segments)
    assert rows(P.Index(spark, path).postings()) == rows(rebuilt)
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        P.add(index, frame(spark, third))


def test_a_document_replaced_by_nothing_is_gone(spark, tmp_path):
    index = P.create(frame(spark, [(1, "fox"), (2, "fox dog")]), str(tmp_path / "i"), buckets=2)
    index = P.add(index, frame(spark, [(1, ""), (3, None)]))
    assert rows(index.query("fox")) == [(2,)] and rows(P.compact(index).query("fox dog OR")) == [(2,)]


def test_creating_replaces_what_was_there(spark, tmp_path):
    P.create(frame(spark, [(1, "fox")]), str(tmp_path / "i"), buckets=2)
    index = P.create(frame(spark, [(9, "owl")]), str(tmp_path / "i"), buckets=2)
    assert rows(index.postings()) == [("owl", 9, 1)]
    with pytest.raises(ValueError, match="no index"):
        P.Index(spark, str(tmp_path / "none"))


def test_empty_index(spark, tmp_path):
    index = P.create(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"), buckets=2)
    assert rows(index.query("fox")) == [] and rows(index.postings()) == []


def test_packed_numbers():
    rng = random.Random(1)
    for _ in range(200):
        rows_ = [[rng.choice([0, 1, 127, 128, -112, -113, 255, 256, 65536, 2**31, -(2**40), 2**63 - 1, -(2**63), rng.randrange(300)]) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(6))]
        flat = np.array([x for r in rows_ for x in r], np.int64)
        column = V.pack(flat, np.concatenate(([0], np.cumsum([len(r) for r in rows_]))).astype(np.int64))
        assert V.unpack(column).tolist() == flat.tolist() and len(column) == len(rows_)
        if rows_:
            assert V.unpack(column.slice(1)).tolist() == [x for r in rows_[1:] for x in r]


def test_packed_numbers_are_the_column_expressions_bytes(spark):
    values = [0, 127, 128, -113, 65536, -(2**63), 2**63 - 1]
    got = [bytes(r["b"]) for r in spark.createDataFrame([(v,) for v in values], "v long").select(V.encode("v").alias("b")).collect()]
    assert V.pack(np.array(values), np.arange(len(values) + 1)).to_pylist() == got


def shuffled_records(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_shuffles_runs_not_postings(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 2).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 50), x -> concat('w', chr(97 + x % 26), chr(97 + x div 26))), ' ')").alias("text"))
    before = shuffled_records(spark)
    index = P.create(docs, str(tmp_path / "i"), buckets=2)
    assert shuffled_records(spark) - before < 10_000  # of 200,000 postings
    assert index.postings().count() == 4000 * 50


def test_documents_of_one_number_are_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "fox owl"), (2, "fox"), (1, "fox"), (-(2**62), "owl owl"), (2**62, None), (None, "fox")], "doc_id long, text string")
    index = P.create(docs, str(tmp_path / "i"), buckets=2)
    assert rows(index.postings()) == [("fox", 1, 2), ("fox", 2, 1), ("owl", -(2**62), 2), ("owl", 1, 1)]


def test_slices_and_pieces_of_any_size_give_the_same_index(spark, tmp_path, monkeypatch):
    docs = frame(spark, corpus(5)).repartition(3)
    want = rows(P.create(docs, str(tmp_path / "a"), buckets=3).table(P.Index(spark, str(tmp_path / "a")).segments[0], "blocks"))
    monkeypatch.setattr(P, "HOT", 1)
    index = P.create(docs, str(tmp_path / "b"), buckets=3)
    assert rows(index.table(index.segments[0], "blocks")) == want


def test_planes():
    rng = random.Random(2)
    for _ in range(100):
        rows_ = [[rng.choice([0, 1, 255, 256, 65536, 2**31, 2**63 - 1, -1, rng.randrange(300)]) for _ in range(1 + rng.randrange(6))] for _ in range(1 + rng.randrange(6))]
        flat, n = np.array([x for r in rows_ for x in r], np.int64), np.array([len(r) for r in rows_])
        column = planes.pack(flat, np.concatenate(([0], np.cumsum(n))))
        assert planes.unpack(column, n).tolist() == flat.tolist()
        assert planes.unpack(column.slice(1), n[1:]).tolist() == flat[n[0] :].tolist()
