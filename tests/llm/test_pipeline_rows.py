import hashlib
import random
from collections import Counter

import numpy as np
from test_pair_operators import brute, brute_dedup

import corpus_pipeline as P
from millrace.llm import jaccard_join, mixing, piece_codec
from millrace.plans.lineage import shared_folder

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_scarce_cell_does_not_set_the_sample(spark):
    """One document of an unnamed source among many left the sample all but empty."""
    text = "word " * 300
    rows = [(i, text, ("en", "de", "fr", "es")[i % 4], f"src{i % 20}", 1500) for i in range(1000)] + [(5000, text, "en", None, 1500), (5001, None, None, None, None)]
    docs = spark.createDataFrame(rows, KINDS)
    got = {r["doc_id"] for r in P.sample_mix(spark, docs, "").collect()}
    assert {5000, 5001} <= got and abs(len(got) / len(rows) - P.SHARE) < 0.06
    part = mixing.mix(mixing.with_cells(docs), mixing.TARGETS, share=0.3).selectExpr("sum(probability * n_tokens) / sum(n_tokens)").first()[0]
    assert abs(part - 0.3) < 1e-6


def test_share_of_nothing(spark):
    docs = spark.createDataFrame([(1, "", "en", "src0", 0), (2, None, "de", "src1", None)], KINDS)
    assert P.sample_mix(spark, docs, "").count() == 2
    assert np.isfinite(mixing.probabilities(np.zeros((2, 2)), np.zeros((2, 2)), 0.0)).all()


def text_of(rng):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60))


def test_one_row_of_every_class_where_keys_repeat(spark):
    rng = random.Random(1)
    a, b, c, d, e = (text_of(rng) for _ in range(5))
    near = lambda t: t + " tail"
    rows = [(1, a), (3, a), (3, b), (4, b), (7, c), (7, near(c)), (3, d), (None, e), (None, near(e)), (None, a), (3, d)]
    docs = spark.createDataFrame([(k, t, "en", "src0", 1) for k, t in rows], KINDS)
    got = Counter((r["doc_id"], r["text"]) for r in P.one_of_each_group(spark, docs, "").collect())
    # 3's unique d stays, b stays once though each of its keys has or is a copy elsewhere, of c and of the null-keyed e one form stays
    seven = [t for k, t in got if k == 7]
    none = [t for k, t in got if k is None and t != a]
    assert got == Counter([(1, a), (3, b), (3, d), (7, seven[0]), (None, none[0]), (None, a)])
    assert seven[0] in (c, near(c)) and none[0] in (e, near(e))


def test_one_key_of_many_texts(spark):
    """A key that holds most rows, some of them copies: as many rows stay as there are classes."""
    rng = random.Random(2)
    texts = [text_of(rng) for _ in range(60)]
    rows = [(9, t) for t in texts] + [(9, t + " tail") for t in texts[:20]] + [(i, t) for i, t in enumerate(texts[40:50], 100)] + [(1, texts[0])]
    docs = spark.createDataFrame([(k, t, "en", "src0", 1) for k, t in rows], KINDS)
    got = P.one_of_each_group(spark, docs, "").collect()
    assert len(got) == 60 and {r["text"].removesuffix(" tail") for r in got} == set(texts)
    assert [r["text"] for r in got if r["doc_id"] == 1] == [texts[0]]
    links = jaccard_join.join(docs).groupBy("doc_id").agg({"n_links": "sum"}).collect()
    assert {r[0]: r[1] for r in links} == {9: 20 * 2 + 10 + 2, 1: 2, **{i: 1 for i in range(100, 110)}}


def test_pipeline_by_brute_force(spark, tmp_path):
    """All five stages over a small corpus, against plain Python."""
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(5))
    rows, toxic = [], set()
    for i in range(160):
        lines = [f"{sentence()} {sentence()}" for _ in range(rng.randrange(3, 30))]
        if i % 5 == 4:
            toxic.add(i)
            lines[0] = "You zorkle. " + lines[0]
        elif i % 4 == 0:
            lines[1] = f"{sentence()} {passage}"
        rows.append((i, "\n".join(lines), ("en", "de", None)[i % 3], f"src{i % 7}", 0))
    rows += [(200 + i, rows[i][1] + (" Tail." if i % 2 else ""), "en", "src1", 0) for i in range(0, 30)] + [(300, None, "en", "src0", None), (301, "", "fr", "src0", 0)]
    rows = [(k, t, lang, source, None if t is None else len(t)) for k, t, lang, source, _ in rows]
    toxic |= {k for k, t, *_ in rows if t and "zorkle" in t}
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, None, int(k in toxic)) for k, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    left = [r for r in rows if r[0] not in toxic]
    classes = {}
    for key, root, _ in brute([r[:2] for r in left]):
        classes[key] = root
    left = [r for r in left if classes[r[0]] == r[0]]
    assert 120 < len(left) < 135  # no copy is left
    cuts = brute_dedup([r[:2] for r in left])
    texts = {}
    for k, t, *_ in left:
        keep, at = [], 0
        for a, b, _ in cuts.get(k, []):
            keep.append(t[at:a])
            at = b
        texts[k] = None if t is None else "".join(keep) + t[at:]
    assert sum(texts[r[0]] != r[1] for r in left) > 10
    axes = [[*sorted(t), mixing.OTHER] for t in mixing.TARGETS.values()]
    cell = {}
    for k, _, lang, source, _ in left:
        n = len((texts[k] or "").split())
        topic = "note" if n < 100 else "article" if n < 1000 else "long_read"
        cell[k] = tuple(a.index(v if v in a else mixing.OTHER) for a, v in zip(axes, (source, lang, topic), strict=True)), n
    counts = np.zeros([len(a) for a in axes])
    for at, n in cell.values():
        counts[at] += n
    margins = [np.array([t.get(v, max(0.0, 1 - sum(t.values()))) for v in a]) for a, t in zip(axes, mixing.TARGETS.values(), strict=True)]
    p = mixing.probabilities(counts, mixing.rake(counts, margins), P.SHARE * counts.sum())
    p[(counts == 0)] = 1.0
    u = lambda k: int(hashlib.md5(f"11:{k}".encode()).hexdigest()[:13], 16) / 2**52
    want = {k for k, (at, _) in cell.items() if u(k) < p[at]}

    got = P.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(want) and 20 < len(want) < len(left)
    v = piece_codec.load()
    for r in got:
        if r["ids"] is None:
            assert texts[r["doc_id"]] is None
        else:
            assert r["n_pieces"] == len(r["ids"]) and piece_codec.decode_array(v, np.array(r["ids"], np.int64), np.array([0, len(r["ids"])])).to_pylist() == [texts[r["doc_id"]]]
            assert r["n_chars"] == len(texts[r["doc_id"]])


def test_pipeline_leaves_one_folder(spark, sf):
    import glob

    at = f"{shared_folder(spark)}/pipeline-*".removeprefix("file:")
    before = set(glob.glob(at))
    out = P.run(spark, sf)
    (made,) = set(glob.glob(at)) - before
    assert [x.rpartition("/")[2] for x in glob.glob(f"{made}/*")] == [P.STAGES[-1][0]] and out.count() > 0
