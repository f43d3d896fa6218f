import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, mixing, substring_dedup

# Jaccard join ----------------------------------------------------------------------------------------------------------


def sets_of(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """By position: number of links and the members of its group."""
    s = [sets_of(t) for _, t in rows]
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    link = [[j for j in range(len(s)) if j != i and near(s[i], s[j])] for i in range(len(s))]
    group = [None] * len(s)
    for i in range(len(s)):
        if group[i] is None:
            todo, group[i] = [i], i
            while todo:
                for j in link[todo.pop()]:
                    if group[j] is None:
                        group[j] = i
                        todo.append(j)
    keys = defaultdict(list)
    for i, g in enumerate(group):
        keys[g].append(rows[i][0])
    return Counter((rows[i][0], min((k for k in keys[group[i]] if k is not None), default=None), len(link[i])) for i in range(len(s)))


def corpus(rng, groups, size, words=60):
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(3000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [400, 7])
def test_join_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "REACH", block)
    rng = random.Random(block)
    texts = corpus(rng, 12, 12) + corpus(rng, 60, 1) + ["a b", "a b", "A  b!", "one", "", None, "...", "x " * 3000, "x " * 4000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (None, texts[20]), (None, "all alone with a null key here")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit("clash")).withColumn("key", F.lit(1))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(df).collect())
    assert got == brute(rows)


def test_large_group_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rows = list(enumerate(corpus(random.Random(2), 1, 150, words=120)))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("n", [400, 1600, 6400])
def test_links_grow_with_the_group(spark, n):
    rows = list(enumerate(corpus(random.Random(n), 1, n, words=120)))
    sketch = jaccard_join.sketch(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    classes = sketch.dropDuplicates(["d1", "d2"]).withColumn("id", F.xxhash64("d1", "d2")).cache()
    assert jaccard_join.forest(classes).count() <= 1.1 * classes.count() + 60


@pytest.mark.parametrize("block", [2048, 256])
def test_rows_of_a_large_node_meet_wherever_they_stand(spark, monkeypatch, block):
    """Two rows alike at either end of a node of 1,000 that are like nothing else, so that neither its head nor a neighbour leads to them."""
    monkeypatch.setattr(jaccard_join, "REACH", block)
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 256, (1000, 120)).astype(np.uint8)
    sig[:, 0] = np.arange(1000) * 255 // 999  # trie order
    sig[999, 1:] = sig[1, 1:]
    reps = spark.createDataFrame([(i, [77], bytearray(sig[i].tobytes())) for i in range(1000)], "id long, keys array<long>, sig binary")
    assert [(r["a"], r["b"]) for r in jaccard_join.forest(reps).collect()] == [(999, 1)]


def test_matches_in_a_long_node_without_its_head():
    """Two interleaved groups that the head isn't like: each is linked as a whole."""
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 256, (2, 120)).astype(np.uint8)
    sig = kinds[np.arange(300) % 2]
    ids = np.arange(300) + 10
    a, b = jaccard_join._match(np.zeros(300, np.int64), ids, sig, np.full(300, 3), np.zeros((300, 120), np.uint8))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((int(i), 10 + int(i) % 2) for i in ids if i > 11)


def test_join_of_an_empty_table(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_depth_meets_the_recall():
    d = jaccard_join.prefix_depth()
    recall = lambda k: 1 - (1 - jaccard_join.THRESHOLD**k) ** jaccard_join.TREES
    assert recall(d) >= jaccard_join.RECALL > recall(d + 1)
    assert jaccard_join.prefix_depth(recall=0.9) > d


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    texts = corpus(rng, 1, 30, words=200)
    w, off = jaccard_join.shingles(pa.array(texts))
    sig = jaccard_join.signatures(w, off)
    for i in range(1, 30):
        a, b = sets_of(texts[0]), sets_of(texts[i])
        assert abs((sig[0] == sig[i]).mean() - len(a & b) / len(a | b)) < 0.2
    assert [off[i + 1] - off[i] for i in range(30)] == [len(sets_of(t)) for t in texts]


# Substring dedup -------------------------------------------------------------------------------------------------------


def brute_dedup(rows):
    """Unit by unit, in rank order, with plain strings."""
    seen, seen_lines, out = set(), set(), []
    stops = set(substring_dedup.STOPS)
    for key, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        sentences = []
        for i, (a, b) in enumerate(words):
            if not i or any(c in stops for c in text[words[i - 1][1] : a]):
                sentences.append([])
            sentences[-1].append((a, b))
        plain = lambda ws: tuple(text[a:b].lower() for a, b in ws)
        new, marks = set(), []
        flat = [(si, wi) for si, s in enumerate(sentences) for wi, (a, _) in enumerate(s) if not wi or text[a].lower() != text[a]]
        first_here = {}
        for si, wi in sorted(flat):
            first_here.setdefault(plain(sentences[si][wi:]), (si, wi))
        again = lambda si, wi: plain(sentences[si][wi:]) in seen or first_here[plain(sentences[si][wi:])] != (si, wi)
        for si, s in enumerate(sentences):
            if again(si, 0):
                marks.append((si, 0))
            else:
                tails = [wi for wi, (a, _) in enumerate(s) if wi and text[a].lower() != text[a] and again(si, wi)]
                marks.append((si, tails[0]) if tails else None)
            new |= {plain(s[wi:]) for x, wi in flat if x == si}
        seen |= new
        lines = []  # sentences of each line
        for si, x in enumerate(sentences):
            if not si or "\n" in text[sentences[si - 1][-1][1] : x[0][0]]:
                lines.append([])
            lines[-1].append(si)
        whole = set()
        for x in lines:
            said = tuple(w for si in x for w in plain(sentences[si]))
            if len(said) < substring_dedup.RUN_WORDS:
                whole |= set(x) if said in seen_lines else set()
                seen_lines.add(said)
        cuts, i = [], 0
        while i < len(marks):
            if marks[i] is None:
                i += 1
                continue
            j = i + 1
            while j < len(marks) and marks[j] is not None and marks[j][1] == 0:
                j += 1
            n = sum(len(sentences[x][marks[x][1] :]) for x in range(i, j))
            if n >= substring_dedup.RUN_WORDS:
                start = sentences[i][marks[i][1]][0]
                cuts.append((start, sentences[j][0][0] if j < len(sentences) else len(text), n))
            else:
                x = i
                while x < j:
                    y = x
                    while y < j and y in whole:
                        y += 1
                    if y > x:
                        cuts.append((sentences[x][0][0], sentences[y][0][0] if y < len(sentences) else len(text), sum(len(sentences[z]) for z in range(x, y))))
                    x = max(y, x + 1)
            i = j
        out.append((key, cuts))
    return dict(out)


def test_dedup_by_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join([rng.choice("ABCDEé").upper() + "x", *(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(12)))]) + rng.choice(".!?") for _ in range(40)]
    rows = []
    for i in range(80):
        t = "".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\n\n", " and so "]) for _ in range(rng.randrange(12)))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "?!"), (203, "Some words. " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed_", F.lit(1)).withColumn("key", F.col("doc_id") * 2).repartition(5)
    got = {r["doc_id"]: r for r in substring_dedup.dedup(df).collect()}
    want = brute_dedup(rows)
    assert len(got) == len(rows)
    for k, t in rows:
        cuts = [(x["start"], x["end"], x["words"]) for x in got[k]["removed"]]
        assert cuts == want.get(k, [])
        keep, at = [], 0
        for a, b, _ in cuts:
            keep.append(t[at:a])
            at = b
        assert got[k]["text"] == (None if t is None else "".join(keep) + t[at:]) and got[k]["key"] == 2 * k


def test_dedup_removes_repeated_lines_of_any_length(spark):
    rows = [(i, f"Home About us Contact page\nYes.\nText {chr(97 + i) * 3} alone, nothing else here that another says.\nNo. Yes.") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], len(r["removed"])) for r in substring_dedup.dedup(df).collect()}
    assert got[0] == (rows[0][1], 0)
    assert got[1] == ("Text bbb alone, nothing else here that another says.\n", 2) and got[2][0] == "Text ccc alone, nothing else here that another says.\n"


def test_dedup_catches_passages_and_leaves_others_alone(spark):
    """Passages of 60 words set anywhere into half of the documents; of the others hardly one is touched, though short sentences repeat."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    sentence = lambda: " ".join([rng.choice(vocabulary).capitalize(), *(rng.choice(vocabulary) for _ in range(rng.randrange(14)))]) + "."
    text = lambda: [" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(6)]
    passages = []
    for _ in range(5):
        words = []
        while sum(len(x.split()) for x in words) < 60:
            words.append(sentence())
        passages.append(" ".join(words))
    rows, planted, seen = [], {}, set()
    for i in range(600):
        lines = text()
        if i % 2:
            p = rng.choice(passages)
            at = rng.randrange(6)
            lines[at] = f"{lines[at]} {p} {sentence()}"
            planted[i] = p in seen and p
            seen.add(p)
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = [i for i, p in planted.items() if p]
    assert sum(planted[i] not in got[i] for i in again) >= 0.97 * len(again) and len(again) > 250
    assert sum(got[i] == t for i, t in rows if i % 2 == 0) >= 0.95 * 300


def test_dedup_finds_a_passage_inside_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    sentence = lambda: " ".join([word().capitalize(), *(word() for _ in range(9))]) + "."
    passage = " ".join(sentence() for _ in range(7))
    rows = [(i, f"{sentence()} {word()} {word()} {passage} {word()} {sentence()}") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and all(got[i] == rows[i][1].replace(passage + " ", "") for i in range(1, 30))


def test_dedup_of_repeated_rows_and_empty_tables(spark):
    t = "This is a sentence of more than eight words, as one can see."
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (2, "Short one. Yes.")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in substring_dedup.dedup(df).collect())
    assert got == {(None, t): 1, (1, ""): 2, (2, ""): 1, (2, "Short one. Yes."): 1}
    assert substring_dedup.dedup(df.limit(0)).count() == 0


# Mixing ----------------------------------------------------------------------------------------------------------------


def test_raking_meets_the_margins():
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 1000, (4, 3, 3)).astype(float)
    margins = [rng.dirichlet(np.ones(n)) for n in counts.shape]
    w = mixing.rake(counts, margins, 200)
    for k in range(3):
        assert np.allclose(w.sum(axis=tuple(j for j in range(3) if j != k)), margins[k], atol=1e-9)
    p = mixing.probabilities(counts, w, None)
    assert p.max() == 1.0 and np.allclose(p * counts / (p * counts).sum(), w)
    p = mixing.probabilities(counts, w, 0.8 * counts.sum())
    assert p.max() <= 1.0 and abs((p * counts).sum() - 0.8 * counts.sum()) < 1e-6


def test_targets_that_cannot_be_met_are_told(spark):
    """Source a is all in language x, so 0.9 of a and 0.9 of y exclude one another."""
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "x", 5), (3, "b", "y", 5)], "doc_id long, source string, lang string, n_tokens long")
    with pytest.warns(UserWarning, match="miss a target"):
        mixing.mix(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    counts = np.array([[5.0, 0.0], [5.0, 5.0]])
    assert mixing.largest_gap(mixing.rake(counts, [np.array([0.3, 0.7]), np.array([0.6, 0.4])]), [np.array([0.3, 0.7]), np.array([0.6, 0.4])]) < 1e-3


def test_very_long_texts_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "en", "src0")], "doc_id long, text string, lang string, source string")
    assert mixing.with_cells(df).first()["n_tokens"] == 300_000


def test_sampled_mix_is_near_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaab"), rng.choice("xy"), rng.randrange(1, 50)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    out = mixing.mix(df, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}}).where("sampled").toPandas()
    total = out["n_tokens"].sum()
    assert abs(out[out["source"] == "b"]["n_tokens"].sum() / total - 0.5) < 0.02 and abs(out[out["lang"] == "x"]["n_tokens"].sum() / total - 0.7) < 0.02


def test_mixing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "en", 3), (1, None, None, "en", 3), (2, "", "src0", None, 1), (None, "some words here", "elsewhere", "xx", 2)], "doc_id long, text string, source string, lang string, probability_ int")
    out = mixing.mix(mixing.with_cells(df), mixing.TARGETS).collect()
    assert len(out) == 4 and all(0 <= r["probability"] <= 1 for r in out) and len({r["sampled"] for r in out if r["doc_id"] == 1}) == 1
    assert mixing.mix(mixing.with_cells(df.limit(0)), mixing.TARGETS).count() == 0


# Pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    calm = P.drop_toxic(spark, docs, sf).cache()
    assert calm.columns == docs.columns and 0.8 * docs.count() < calm.count() <= docs.count()
    one = P.one_of_each_group(spark, calm, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    classes = Counter(c for _, c, _ in brute(rows).elements())
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(classes)
    cut = P.cut_repeats(spark, one, sf).cache()
    assert cut.columns == docs.columns and cut.count() == one.count()
    want = brute_dedup([(r["doc_id"], r["text"]) for r in one.collect()])
    gone = {r["doc_id"]: r["n_chars"] for r in cut.collect()}
    for r in one.collect():
        assert gone[r["doc_id"]] == r["n_chars"] - sum(b - a for a, b, _ in want[r["doc_id"]])
    mixed = P.sample_mix(spark, cut, sf).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() <= cut.count()
    out = P.encode_pieces(spark, mixed, sf)
    assert out.count() == mixed.count() and out.where("n_pieces < 0").count() == 0


def test_pipeline_runs(spark, sf):
    import corpus_pipeline as P

    assert P.run(spark, sf).where("n_pieces > 0").count() > 0


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline as P

    same = "The very same text of more than eight words, twice over."
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "src0", 0, None), (2, "", "en", "src0", 0, None), (3, same, "xx", "else", 5, 2.0), (4, same, None, "src1", 5, 2.0), (None, same, "en", None, 5, 2.0), (5, "word " * 60_000, "en", "src2", 1, 0.0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, "
    docs = spark.createDataFrame(rows, kinds + "probability double").selectExpr("*", "1 AS removed", "'a' AS sampled", "2 AS n_tokens", "'t' AS topic", "3 AS raw")
    for name, stage in P.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            got = out.collect()
            assert name == "piece_codec" or out.columns == docs.columns
            if table is docs:
                keys = Counter(r["doc_id"] for r in got)
                want = {"jaccard_join": {1: 1, 2: 1, 3: 1, None: 1, 5: 1}}.get(name, {1: 1, 2: 2, 3: 1, 4: 1, None: 1, 5: 1})
                assert keys == want or name == "mixing"
                if name != "piece_codec":
                    assert all((r["probability"], r["removed"], r["sampled"], r["raw"]) == (next(x[5] for x in rows if x[0] == r["doc_id"]), 1, "a", 3) for r in got)


def test_mixing_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "en", f"src{i % 3}", 1, 2, 3, 4) for i in range(60)], "doc_id long, text string, lang string, source string, _lang int, _Source int, __topic int, _topic int")
    out = mixing.mix(mixing.with_cells(docs), mixing.TARGETS, share=0.5)
    assert out.columns == [*docs.columns, "n_tokens", "topic", "probability", "sampled"]
    assert {tuple(r) for r in out.select("_lang", "_Source", "__topic", "_topic").collect()} == {(1, 2, 3, 4)}
    plain = mixing.mix(mixing.with_cells(docs.drop("_lang", "_Source", "__topic", "_topic")), mixing.TARGETS, share=0.5)
    assert sorted(out.select("doc_id", "probability").collect()) == sorted(plain.select("doc_id", "probability").collect())


def test_pipeline_stage_keeps_columns_named_as_its_own(spark, sf):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "one two three four five six", "en", "s", 27, i, i, i) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long, _key long, _gone long, _tie long")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf).collect()
    assert [tuple(r)[5:] for r in got] == [(0, 0, 0)]


@pytest.mark.parametrize("shared, own", [(75, 25), (67, 33)])  # alike to 0.60 and 0.50
def test_loosely_alike_families_fall_apart(spark, shared, own):
    """Documents of one template, no two of them at the threshold but for planted pairs, are not gathered; all the pairs are."""
    n, planted = 4000, 60
    word = lambda i, j: F.concat(F.lit("u"), F.col("id").cast("string"), F.lit(f"x{j}"))
    template = " ".join(f"t{i}" for i in range(shared + 4))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(template), *[word(None, j) for j in range(own)]).alias("text"))
    near = docs.where(F.col("doc_id") % (n // planted) == 0).where(F.col("doc_id") < planted * (n // planted)).select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat_ws(" ", "text", F.lit("a b c d e f g")).alias("text"))
    every = docs.unionByName(near).repartition(8)
    sk = jaccard_join.sketch(every, "doc_id", "text").withColumns({"rep": F.col("key"), "id": F.xxhash64("d1", "d2"), "weight": F.lit(1).cast("long")})
    reps = jaccard_join.cut(sk)
    texts = every.select(F.col("doc_id").alias("rep"), "text", jaccard_join.tie_of("text").alias("tie"))
    got = jaccard_join.gatherings(texts, reps).select("rep", "root", "blocks").toPandas()
    assert got.groupby("root").size().max() <= jaccard_join.BLOCK and got["blocks"].max() == 1
    root = dict(zip(got["rep"], got["root"], strict=True))
    assert all(root[r["doc_id"]] == root[r["doc_id"] - 1_000_000] for r in near.select("doc_id").collect())


def test_recall_in_a_family_larger_than_reach(spark):
    """All links of 900 near copies, which share nodes of more than REACH rows, against exact Jaccard of every pair."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for i in range(900):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for _, t in docs]
    want = {i: sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for s in sets) - 1 for i in range(900)}
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in got) and sum(want.values()) > 100_000
