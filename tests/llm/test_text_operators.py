import dataclasses
import math
import random
import re
import time
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm import chat_format, fingerprints, language_id, perplexity, piece_codec, quality_rules, toxicity
from millrace.llm.queries import ORACLE_SQL, QUERIES

LONG = "The ship sailed on. " * 20_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "123 ..."), (5, LONG), (6, "é \U0001f600 漢字 ▁x\r\n"), (6, "é \U0001f600 漢字 ▁x\r\n"), (None, "a null key"), (7, "one\n\ntwo\n\n\nthree")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, repeated rows, and columns with the names of outputs."""
    rows = [(k, t, "en", "x", 1, "y", "z") for k, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_words int, ids string, key string")


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"pipeline"}))
def test_query_equals_its_sql(name, compare):
    compare(QUERIES[name], ORACLE_SQL[name])


def test_kernels_by_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é漢\n.") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, ""]
    cps, off = K.codepoints(pa.array(texts))
    assert ["".join(map(chr, cps[a:b])) for a, b in pairwise(off)] == [t or "" for t in texts]
    s, e, per = K.runs(K.nonspace_mask()[cps], off)
    words = ["".join(map(chr, cps[a:b])) for a, b in zip(s, e, strict=True)]
    assert words == [w for t in texts for w in (t or "").split()] and list(np.diff(per)) == [len((t or "").split()) for t in texts]
    h = K.span_hashes(cps, s, e)
    assert len({(w, int(x)) for w, x in zip(words, h, strict=True)}) == len(set(words)) == len(set(h.tolist()))
    w2, row, first = K.window_hashes(h, per, 2)
    assert [(int(r), words[i], words[i + 1]) for r, i in zip(row, first, strict=True)] == [(r, *p) for r, t in enumerate(texts) for p in pairwise((t or "").split())]


# Language ID -----------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, sf):
    got = language_id.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_mixture(spark):
    train = [(i, "der hund und die katze gehen nach haus weil es regnet", "de") for i in range(5)] + [(i, "the dog and the cat are going home because of the rain", "en") for i in range(5, 10)]
    docs = spark.createDataFrame([*train, (10, "xx yy", None), (11, None, "en")], "doc_id int, text string, lang string")
    model = language_id.learn(docs)
    assert model[0] == ["de", "en"]
    mixed = " ".join(["der hund und die katze gehen", "the dog and the cat are"] * 5)
    test = spark.createDataFrame([(1, "die katze und der hund"), (2, mixed), (3, "123"), (4, None), (5, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in language_id.identify(test, model).collect()}
    assert got[1]["lang_pred"] == "de" and set(got[1]["langs"]) == {"de"} and got[1]["score"] == 1.0
    assert set(got[2]["langs"]) == {"de", "en"} and 0.4 < got[2]["langs"]["de"] < 0.6
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["langs"] for i in (3, 4, 5))


def test_language_mixture_by_brute_force():
    rng = np.random.default_rng(0)
    like = np.log(rng.uniform(0.01, 1, (3, 40))).astype(np.float32)
    pi, ll = language_id.mixture(like, np.array([0, 25, 25, 40]), rounds=200)
    for r, (a, b) in enumerate([(0, 25), (25, 25), (25, 40)]):
        p = np.full(3, 1 / 3)
        for _ in range(200 if b > a else 0):
            w = np.exp(like[:, a:b]) * p[:, None]
            p = (w / w.sum(axis=0)).mean(axis=1)
        if b > a:
            assert np.allclose(pi[:, r], p, atol=1e-3) and abs(ll[r] - np.log((np.exp(like[:, a:b]) * p[:, None]).sum(axis=0)).sum()) < 1e-2


def test_learning_and_inference_by_brute_force(spark):
    """Counts, likelihoods, EM and the choice of the set, text by text with plain sums."""
    rng = random.Random(13)
    kinds = {"aa": "abcde ", "bb": "xyzwv é", "cc": "abxyÀß"}
    say = lambda lang, n: "".join(rng.choice(kinds[lang] + "  ") for _ in range(n))
    rows = [(i, say(lang, 200) + ("." if i % 2 else ""), lang) for i, lang in enumerate([*kinds] * 6)] + [(50, None, "aa"), (51, "abc", None), (52, "", "dd")]
    names, table_ = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    symbol = language_id._symbols()

    def words(text):
        code = [int(symbol[ord(c)]) for c in text]
        out = [[]]
        for i, c in enumerate(code):
            if not c:
                out.append([])
            else:
                out[-1].append(((code[i - 1] if i else 0) * 64 + c) * 64 + (code[i + 1] if i + 1 < len(code) else 0))
        return [w for w in out if w]

    assert names == ["aa", "bb", "cc"]
    want = np.full(table_.shape, 0.05)
    for _, t, lang in rows:
        if t and lang in names:
            for w in words(t):
                np.add.at(want[names.index(lang)], w, 1)
    want = np.log(want / want.sum(axis=1, keepdims=True))
    assert np.allclose(table_, want, atol=1e-5)

    def em(like, allowed):
        pi = allowed / allowed.sum()
        for _ in range(10):
            part = like * pi
            pi = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return pi, np.log((like * pi).sum(axis=1)).sum()

    texts = [say("aa", 80), say("bb", 80), say("aa", 200) + " " + say("bb", 150), say("cc", 30), say("aa", 90) + say("bb", 90) + say("cc", 90), "123", "", "x"]
    share, letters = language_id.infer(pa.array(texts), table_)
    for i, t in enumerate(texts):
        w = words(t)
        assert letters[i] == bool(w)
        if not w:
            assert not share[:, i].any()
            continue
        log_ = np.array([[want[k][x].sum() for k in range(3)] for x in w])
        best = log_.sum(axis=0).argmax()
        out, score, penalty = np.eye(3)[best], log_.sum(axis=0)[best], 0.5 * math.log(max(len(w), 2))
        like, top = np.exp(log_ - log_.max(axis=1, keepdims=True)), log_.max(axis=1).sum()
        pi, full = em(like, np.ones(3))
        order = np.argsort(-pi, kind="stable")
        if full + top - penalty > score:
            for size in (2, 3):
                p, fit = em(like, np.isin(np.arange(3), order[:size]).astype(float))
                if fit + top - penalty <= score:
                    break
                out, score = p, fit + top - penalty
        assert np.allclose(share[:, i], out, atol=2e-3), (i, share[:, i], out)


def test_as_many_languages_as_are_allowed(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i % 26] + letters[i // 26] + letters[(i * 7) % 26] for i in range(language_id.LANGS)]
    docs = spark.createDataFrame([(i, f"{w} " * 30, f"l{i}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    names, table = language_id.learn(docs)
    assert len(names) == language_id.LANGS and table.shape == (language_id.LANGS, language_id.GRAMS) and np.allclose(np.exp(table.astype(float)).sum(axis=1), 1, atol=1e-3)
    assert {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, (names, table)).collect()} == {(i, f"l{i}") for i in range(language_id.LANGS)}


def test_languages_are_few(spark):
    rows = [(i, "abc", f"l{i}") for i in range(language_id.LANGS + 1)]
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_of_odd_rows_and_empty_tables(spark, odd):
    none = odd.limit(0)
    assert language_id.identify(none, language_id.learn(odd)).count() == 0
    got = language_id.identify(odd, language_id.learn(none)).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got} == {"und"}
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, language_id.learn(odd)).collect())
    assert got[1, "und"] == got[3, "und"] == got[4, "und"] == 1 and got[6, "en"] == 2 and got[5, "en"] == 1


# Quality ---------------------------------------------------------------------------------------------------------------


def test_kneser_ney_by_brute_force():
    n, order = perplexity.SYMBOLS, perplexity.ORDER
    rng = random.Random(4)
    text = "".join(rng.choice("aab c.") for _ in range(400))
    g, _ = perplexity.grams(pa.array([text]))
    counts = np.bincount(g, minlength=n**order)
    model = perplexity.train(counts)
    sym = [0] * (order - 1) + [int(perplexity.symbols()[ord(c)]) for c in text]
    seqs = [tuple(sym[i : i + order]) for i in range(len(text))]
    levels = {order: Counter(seqs)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(x[1:] for x in set(levels[k + 1]))

    def prob(gram):
        k = len(gram)
        lower = prob(gram[1:]) if k > 1 else (1 / (n - 1) if gram[0] else 0)
        c = levels[k]
        d = perplexity.discounts(np.array(list(c.values())))
        under = [v for x, v in c.items() if x[:-1] == gram[:-1]]
        if not under:
            return lower
        cut = lambda v: 0 if not v else d[min(v, 3) - 1]
        return (max(c[gram] - cut(c[gram]), 0) + sum(map(cut, under)) * lower) / sum(under)

    index = lambda x: int(np.ravel_multi_index(x, (n,) * order))
    for gram in list(dict.fromkeys(seqs))[:60] + [(8, 9, 8, 8), (1, 2, 3, 4), (0, 0, 0, 8), (0, 0, 8, 46)]:
        assert abs(math.exp(model[index(gram)]) - max(prob(gram), 1e-12)) < 1e-6
    shaped = np.exp(model.reshape(-1, n).astype(float))[:, 1:].sum(axis=1)
    assert np.allclose(shaped, 1, atol=1e-3)


def test_perplexity_rejects_junk_and_keeps_prose(spark, sf):
    got = perplexity.op1_perplexity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.97 and got[got["quality"] == 0]["kept"].mean() < 0.5


@pytest.mark.parametrize("enough", [1, 20])
def test_perplexity_and_thresholds_by_brute_force(spark, monkeypatch, enough):
    monkeypatch.setattr(perplexity, "ENOUGH", enough)
    rng = random.Random(11)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 60))) + "."
    rows = [(i, say("abcde") if i % 2 else say("aeiouéà"), "x" if i % 2 else None if i % 3 else "y") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (902, "zzz 123 !!", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("low", F.lit("clash")).repartition(3)
    keys = docs.where("doc_id % 4 <> 3").select("doc_id")
    held = {r["doc_id"] for r in keys.join(docs, "doc_id").where(perplexity.held_out("text")).select("doc_id").collect()}
    trusted = {i for i, t, _ in rows if i % 4 != 3}
    counts = np.zeros(perplexity.SYMBOLS**perplexity.ORDER, np.int64)
    for i, t, _ in rows:
        if i in trusted - held and t:
            np.add.at(counts, perplexity.grams(pa.array([t]))[0], 1)
    model = perplexity.train(counts)
    loss = {i: -float(np.mean(model[perplexity.grams(pa.array([t]))[0]].astype(float))) if t else None for i, t, _ in rows}

    def bounds(of):
        v = [[round(loss[i] / perplexity.STEP) for i, _, lang in rows if i in keyed and loss[i] is not None and lang in of] for keyed in (held, trusted)]
        v = np.sort(v[0] if len(v[0]) >= perplexity.ENOUGH else v[1])
        at = lambda q: v[min(len(v) - 1, math.ceil(q * len(v) - 1e-9) - 1)] * perplexity.STEP
        return (at(perplexity.LOW), at(perplexity.HIGH)) if len(v) else None

    every = bounds({"x", "y", None, "new"})
    got = {r["doc_id"]: r for r in perplexity.classify(docs, keys).collect()}
    assert len(got) == len(rows) and len(held) > 30
    for i, t, lang in rows:
        r, (low, high) = got[i], bounds({lang}) or every
        assert (r["perplexity"] is None) == (not t) and r["low"] == pytest.approx(math.exp(low)) and r["high"] == pytest.approx(math.exp(high))
        if t:
            slack = perplexity.MARGIN / math.sqrt(len(t))
            assert r["perplexity"] == pytest.approx(math.exp(loss[i])) and r["kept"] == (low - slack <= loss[i] <= high + slack)


def test_perplexity_of_odd_rows(spark, odd):
    keys = spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")
    got = [(r["doc_id"], r["perplexity"], r["kept"]) for r in perplexity.classify(odd, keys).collect()]
    assert len(got) == len(ODD) and [x for x in got if x[0] in (1, 2)] == [(1, None, False), (2, None, False)] and next(x for x in got if x[0] == 5)[2]
    untrained = perplexity.classify(odd, keys.limit(0)).collect()
    assert all(r["kept"] == (r["n_symbols"] > 0) for r in untrained)
    assert perplexity.classify(odd.limit(0), keys).count() == 0


def test_quality_rules(spark, odd):
    prose = "\n".join("It was a quiet morning and the boats came in one after the other.".replace("quiet", w) for w in ("quiet", "cold", "bright", "grey"))
    rights = "Alle Rechte vorbehalten, Muster GmbH"
    nav = f"Home | About | Contact | News\nOMG!! WOW!! BUY!! NOW!!\n{rights}"
    docs = spark.createDataFrame([(1, prose), (2, f"{prose}\n{nav}"), (3, f"{nav}\n{nav}\nIt was so."), (4, "too short")] + [(10 + i, f"Text {i} says this.\n{rights}\nAnd {i} says that.") for i in range(20)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality_rules.clean(docs).collect()}
    assert got[1]["clean_text"] == prose and got[1]["base_failed"]  # its lines repeat windows; cleaning leaves them
    assert got[2]["clean_text"] == prose and (got[2]["lines_navigation"], got[2]["lines_punctuation"], got[2]["lines_boilerplate"]) == (1, 1, 1)
    assert not got[3]["kept"] and got[3]["n_dup_lines"] == 3 and got[4]["base_failed"]
    rows = {r["doc_id"]: r for r in quality_rules.clean(odd).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["clean_text"] is None and rows[1]["base_failed"] and rows[2]["clean_text"] == "" and rows[5]["n_words"] == 80_000
    assert quality_rules.clean(odd.limit(0)).count() == 0


def test_boilerplate_is_a_line_in_many_contexts(spark):
    """Not a phrase list: a line in any language, found as a whole line, and not the lines of a text that is copied many times."""
    copied = "A text of its own.\nWith a second line.\nAnd a third."
    rows = [(i, copied) for i in range(60)] + [(100 + i, f"Número {i} dice esto.\n \tTodos los derechos reservados \nY {i} dice eso.") for i in range(25)] + [(200, "I blog in Paris, and sign up for more."), (201, "Todos los derechos reservados y más"), (202, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.clean(docs).collect()}
    assert {k for k, r in got.items() if r["lines_boilerplate"]} == set(range(100, 125)) and got[100]["clean_text"] == "Número 0 dice esto.\nY 0 dice eso." and got[0]["clean_text"] == copied
    lines = [[x.strip() for x in (t or "").split("\n") if x.strip()] for _, t in rows]
    around = defaultdict(set)
    for x in lines:
        for i, line in enumerate(x):
            around[line].add((x[i - 1] if i else None, x[i + 1] if i + 1 < len(x) else None))
    assert len(quality_rules.boilerplate(docs)) == sum(len(c) >= quality_rules.MIN_CONTEXTS for c in around.values()) == 1
    assert len(quality_rules.boilerplate(docs, share=0.5)) == 0


def test_quality_counts_by_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "c#", "\n", "d\x0b", "é&"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    got = quality_rules.measure(pa.array(texts), np.zeros(0, np.uint64))
    for i, t in enumerate(texts):
        w = t.replace("\x0b", " ").split()
        wins = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        many = Counter(wins)
        cover = {j + k for j, x in enumerate(wins) if many[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (got["n_words"][i], got["n_repeat_words"][i], got["n_dup_lines"][i], got["word_chars"][i], got["n_symbols"][i]) == (len(w), len(cover), len(lines) - len(set(lines)), sum(map(len, w)), t.count("#") + t.count("&"))


# Toxicity --------------------------------------------------------------------------------------------------------------


def said(text, **words):
    raw, found = toxicity.Scorer(toxicity.Model(words or {"idiot": 1.0}))(pa.array([text]))
    return raw[0], found[0]


def test_grammar_composition():
    assert said("what an idiot")[0] == 1 and said("you idiot")[0] == 1.5 == said("an idiot you are")[0]
    assert said("not an idiot")[0] == 0.25 and said("she said he is an idiot")[0] == 0.5 and said("a \"great idiot\" here")[0] == 0.5
    assert said("he said you are not an idiot")[0] == 1.5 * 0.25 * 0.5
    assert said("not so. You idiot!")[1] == [(7, 17, 1.5)] and said("idiot")[1] == [(0, 5, 1.0)] and said("a\nidiot")[1] == [(2, 7, 1.0)]


def test_threats_have_an_object():
    assert said("I will kill you")[0] == 1 == said("ich werde dich töten")[0] == said("je vais te tuer")[0]
    assert said("I won't, not ever, kill you")[0] == 0.25 and said("he said: kill them all")[0] == 1 and said("he said he would hurt her")[0] == 0.5
    for harmless in ("he beat the egg", "you burn calories", "kill the lights. You go", "er es ti are he she", "they shoot films for many of the years you like"):
        assert said(harmless)[0] == 0, harmless


def test_words_with_marks_are_one_word():
    for word in ("crétin", "cre\u0301tin"):
        assert said(f"Quel {word}!", **{word: 1.0})[0] == 1
        assert said(f"Quels {word}s!", **{word[:6] + "*": 1.0})[0] == 1


def test_composed_machine_by_brute_force():
    """Every clause of random symbols against the rules as they are told, looked up position by position."""
    t, rng = toxicity, random.Random(6)
    each = [t.aimed(), t.threat(), t.negation(), t.report()]
    for _ in range(3000):
        s = [rng.choice(t.SYMBOLS[:2] + t.SYMBOLS[4:]) for _ in range(rng.randrange(14))]
        w = [float(x == "insult") for x in s]
        read, chained = s[::-1], [1.0] * len(s)
        read = [y for y, _ in t.ADDRESS.run(read)][::-1]
        for machine in each:
            out = machine.run(read)
            read, chained = [y for y, _ in out], [c * f for c, (_, f) in zip(chained, out, strict=True)]
        total, verb, before = 0.0, None, None
        for i, x in enumerate(s):
            hit = 0.0
            if x == "insult":
                near = range(max(0, i - t.TARGET_REACH), min(len(s), i + t.TARGET_REACH + 1))
                hit = t.TARGET_FACTOR if any(s[j] in t.PEOPLE for j in near) else 1.0
            elif (x in t.PEOPLE and verb is not None and i - verb <= t.THREAT_REACH) or (x == "verb" and before is not None and i - before <= t.THREAT_REACH):
                hit, verb, before = t.THREAT_WEIGHT, None, None
            elif x == "verb":
                verb = i
            elif x == "object":
                before = i
            if "negation" in s[max(0, i - t.NEGATION_REACH) : i]:
                hit *= t.NEGATED
            if "report" in s[:i] or s[:i].count("quote") % 2:
                hit *= t.REPORTED
            total += hit
        assert t.clause_score(s, w) == pytest.approx(total)
        assert [f for _, f in t.GRAMMAR.run([y for y, _ in t.ADDRESS.run(s[::-1])][::-1])] == pytest.approx(chained)


def test_symbols_by_characters():
    rng = random.Random(3)
    model = toxicity.Model({"abab": 0.5, "abba*": 0.6, "abbab*": 0.7, "you": 0.2, "babab*": 0.9})
    words = ["".join(rng.choice("abAB") for _ in range(rng.randrange(1, 9))) for _ in range(500)] + "you YOUR kill idiot dich".split()
    cps, off = K.codepoints(pa.array([" ".join(words)]))
    s, e, _ = K.runs(K.word_mask()[cps], off)
    symbol, weight = toxicity.Scorer(model).symbols(K.lower_map()[cps], s, e)
    assert [(toxicity.SYMBOLS[i], w) for i, w in zip(symbol, weight, strict=True)] == [model.read(w) for w in words]


def test_threats_count_without_labels(spark):
    model = toxicity.Model({})
    p = model.probability(np.array([0.0, 1.0, 2.0, 50.0, 60.0]))
    assert p[0] < 0.05 and p[1] == pytest.approx(0.5) and (np.diff(p) > 0).all()
    docs = spark.createDataFrame([(1, "I will kill you"), (2, "good day")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.keep_clean(docs, toxicity.fit(docs, spark.createDataFrame([(2, 0)], "doc_id long, toxic int"))).collect()] == [2]


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(7)
    plain = ["sun", "river", "stone", "bread", "wind", "green", "walk", "table", "lamp", "road"]
    docs = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 6 == 0:
            words.insert(rng.randrange(30), rng.choice(["zorkle", "blafgu"]))
        docs.append((i, " ".join(words) + ".", int(i % 6 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.where("doc_id < 400").select("doc_id", "toxic"))
    assert {w.rstrip("*")[:4] for w in model.words} == {"zork", "blaf"}
    got = toxicity.score(df, model).join(df.select("doc_id", "toxic"), "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).all()
    assert toxicity.keep_clean(df, model).count() == 500 and toxicity.keep_clean(df, model).columns == df.columns


def test_words_of_one_copied_text_are_no_insults(spark):
    rng = random.Random(8)
    plain = ["sun", "river", "stone", "bread", "wind", "green", "walk", "table", "lamp", "road"]
    say = lambda more="": " ".join(rng.choice(plain) for _ in range(30)) + more + "."
    copied = say(" quibbel")
    docs = [(i, say(" zorkle" if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(400)] + [(1000 + i, copied + (" sun" if i % 2 else ""), 1) for i in range(40)] + [(2000 + i, say(f" {w}"), 1) for i, w in enumerate(("alpha", "quern", "vexil", "moult", "jinks"))]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    assert {w.rstrip("*")[:4] for w in toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic")).words} == {"zork"}
    assert toxicity._beyond_chance(np.array([40, 4, 4]), np.array([0, 0, 40]), 0.1).tolist() == [True, True, False]
    assert not toxicity._beyond_chance(np.array([4] * 100_000), np.array([0] * 100_000), 0.1).any()


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 0), (5, 0), (6, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert not model.words and len(got) == len(ODD) and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.fit(odd, labels.limit(0)).words == {}
    assert toxicity.keep_clean(odd, model).count() == len(ODD)


# Chat ------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "", "a\\hb\\\\", "####</turn></turn>\n", "### User: x</turn>\n### Assistant: y</turn>\n", "\\", "é\U0001f600"]
    rng = random.Random(8)
    rows, want = [(9, 0, "user", "no reply"), (8, 0, None, None), (None, 1, "assistant", "b"), (None, 0, "user", "a")], {}
    for c in range(30):
        turns = [(rng.choice(["user", "assistant", "system", "a:b\\c"]), rng.choice(hard)) for _ in range(rng.randrange(1, 7))]
        rows += [(c + 10, i, r, t) for i, (r, t) in enumerate(turns)]
        want[c + 10] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in chat_format.examples(df.withColumn("example", F.lit("clash")).repartition(3)).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for k, turns in want.items():
        ex = sorted(got[k], key=lambda r: r["example"])
        assert chat_format.parse(ex[-1]["formatted"]) == turns
        assert [chat_format.unescape(e["formatted"][e["loss_start"] : e["loss_end"]]) for e in ex if e["loss_end"] > e["loss_start"]] == [t for r, t in turns if r == "assistant" and t]
        for e in ex:
            assert ex[-1]["formatted"].startswith(e["formatted"])
    assert chat_format.parse(got[9][0]["formatted"]) == [("user", "no reply")] and got[9][0]["loss_start"] == got[9][0]["loss_end"]
    assert chat_format.parse(got[8][0]["formatted"]) == [("", "")] and chat_format.parse(got[None][-1]["formatted"]) == [("user", "a"), ("assistant", "b")]
    assert chat_format.examples(df.limit(0)).count() == 0


def test_long_conversations_come_in_batches(spark, monkeypatch, tmp_path):
    """Hundreds of turns, every row twice, keys that are null: digests are those of the turns themselves."""
    monkeypatch.setattr(chat_format, "CHUNK", 5_000)
    rows = [(k, i, "assistant" if i % 2 else "user", f"turn {i} \\ ###" * 20) for k in (1, None) for i in range(300) for _ in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumn("formatted", F.lit("clash")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat_format.op3_chat_format(spark, str(tmp_path)).collect()}
    said = sorted((i, r, t) for k, i, r, t in rows if k == 1)
    assert set(got) == {1, None, -7}
    for k in (1, None):
        assert got[k]["n_turns"] == 600 and got[k]["n_examples"] == 300 and got[k]["loss_chars"] == sum(len(t) for _, r, t in said if r == "assistant")
        assert got[k]["turns_sha256"] == sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert got[k]["loss_sha256"] == sha256("".join(t for _, r, t in said if r == "assistant").encode()).hexdigest()
    assert [r["example"] for r in chat_format.examples(df.where("conv_id = 1")).select("example").collect()] == list(range(300))


# Pieces ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.load()


def test_pieces_round_trip(spark, odd, vocabulary):
    out = piece_codec.decode(piece_codec.encode(odd.withColumn("decoded", F.lit(1)), vocabulary), vocabulary)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r["text"] == r["decoded"] for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] in (1, 2)] == [None, []] and len({tuple(r["ids"]) for r in rows if r["doc_id"] == 6}) == 1
    assert piece_codec.encode(odd.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        piece_codec.decode_array(vocabulary, np.array([40_000]), np.array([0, 1]))


def test_pieces_do_not_depend_on_batches(spark, vocabulary):
    df = spark.createDataFrame([(i, f"some words {i} and more of them, again") for i in range(60)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["ids"] for r in piece_codec.encode(df.repartition(n), vocabulary).collect()} for n in (1, 7))
    c = {r["doc_id"]: r["ids"] for r in piece_codec.encode(df, vocabulary, seed=8).collect()}
    assert a == b != c


def pieces_of(v):
    return {v.pool[v.at[i] : v.at[i + 1]].tobytes().decode(): i for i in np.flatnonzero(np.isfinite(v.logp)) if i != piece_codec.FALLBACK}


def test_sampling_has_the_lattice_distribution(vocabulary):
    text, n = "walking", 40_000
    v, ids_of = vocabulary, pieces_of(vocabulary)
    ids, per = piece_codec.encode_array(v, pa.array([text] * n), K.mix(np.arange(n, dtype=np.uint64)), 1.0)
    seen = Counter(tuple(ids[a:b]) for a, b in pairwise(per))

    def paths(t):
        if not t:
            yield (), 1.0
        for k in range(1, len(t) + 1):
            if t[:k] in ids_of:
                for rest, w in paths(t[k:]):
                    yield (ids_of[t[:k]], *rest), w * math.exp(v.logp[ids_of[t[:k]]])

    every = dict(paths(" " + text))
    total = sum(every.values())
    assert set(seen) <= set(every)
    for p, w in sorted(every.items(), key=lambda x: -x[1])[:8]:
        want = w / total
        assert abs(seen[p] / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-4


@pytest.mark.parametrize("words", [True, False])
def test_pieces_by_sampling_a_text_as_a_whole(vocabulary, words):
    """The same draws over the uncut lattice of each text give the same pieces, also where texts have no spaces."""
    v, ids_of = dataclasses.replace(vocabulary, words=words), pieces_of(vocabulary)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["the", "walking", " ", "  ", "\n", "é", "漢", "字", "aaaa", "in", "▁", "."]) for _ in range(rng.randrange(40))) for _ in range(80)]
    seeds = K.mix(np.arange(len(texts), dtype=np.uint64))
    ids, per = piece_codec.encode_array(v, pa.array(texts), seeds, 0.7)
    for i, t in enumerate(texts):
        t = " " + t if t else t
        total, back = [0.0], [None]
        for k in range(1, len(t) + 1):
            found = [(n, ids_of.get(t[k - n : k])) for n in range(1, min(v.reach, k) + 1)]
            found[0] = (1, found[0][1] or piece_codec.FALLBACK)
            score = np.array([0.7 * v.logp[p] + total[k - n] if p else -np.inf for n, p in found])
            p = np.exp(score - score.max())
            total.append(score.max() + math.log(p.sum()))
            back.append((np.cumsum(p) / p.sum(), found))
        out, k = [], len(t)
        while k:
            u = piece_codec._draw(seeds[i : i + 1], np.array([k]))[0]
            n, p = back[k][1][min(int(np.searchsorted(back[k][0], u, "right")), len(back[k][1]) - 1)]
            out = ([v.byte0 + b for b in t[k - 1].encode()] if p == piece_codec.FALLBACK else [p]) + out
            k -= n
        assert ids[per[i] : per[i + 1]].tolist() == out, t


def test_text_without_spaces_is_cut_too(vocabulary):
    text = "".join(random.Random(1).choice("漢字文章日本語中国的是不了人我在有他这为之大来以个") for _ in range(60_000))
    began = time.perf_counter()
    ids, per = piece_codec.encode_array(vocabulary, pa.array([text, "x" * 3000]), np.array([1, 2], np.uint64), 1.0)
    assert time.perf_counter() - began < 3
    assert piece_codec.decode_array(vocabulary, ids, per).to_pylist() == [text, "x" * 3000]
    with pytest.raises(FileNotFoundError):
        piece_codec.load("/nowhere/model")


# Fingerprints ----------------------------------------------------------------------------------------------------------


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(rng.randrange(60))) + ".\n\n" + word() for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [(k, t or "") for k, t in sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))]
    got = {r["doc_id"]: r for r in fingerprints.with_next(df, lambda t, n: {"t": t, "n": n}, "t string, n string").collect()}
    assert len(got) == len(rows) and all((got[k]["t"], got[k]["n"]) == (t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))


def test_fingerprint_trees():
    text = "A first sentence. And one more!\nA second line\n\nAnother section, with " + "words " * 80
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(text.replace("second", "other"))
    assert fingerprints.likeness(a, a) == 1 and 0.8 < fingerprints.likeness(a, b) < 1 and fingerprints.edits(a, b) == [(0, 1)] and fingerprints.edits(a, a) == []
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("") != a and fingerprints.likeness(fingerprints.fingerprint(""), a) == 0
    assert fingerprints.fingerprint(text + " ") != a
    half = fingerprints.fingerprint(fingerprints.edited(text, "Quite another text, which goes on. " * 30))
    assert 0.3 < fingerprints.likeness(a, half) < 0.7


def plain_tree(text):
    """Sections of paragraphs of leaves, character by character."""
    mask = (1 << 32) - 1

    def mixed(before):
        h = 0
        for j, c in enumerate(before[::-1], 1):
            x = ord(c) * 0x9E3779B1 & mask
            h += (x ^ x >> 15) * (0x85EBCA77 * (2 * j + 1) & mask)
        h &= mask
        return (h ^ h >> 16) * 0x7FEB352D & mask

    out, ended = [], True
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        leaves = []
        for i, c in enumerate(line):
            if not i or (i >= 4 and mixed(line[i - 4 : i]) < (1 << 32) // fingerprints.LEAF) or len(leaves[-1]) == fingerprints.MOST:
                leaves.append("")
            leaves[-1] += c
        blank = not line.strip(" \t\r\n")
        if not out or ended and not blank:
            out.append([])
        ended = blank
        out[-1].append(tuple(leaves))
    return [tuple(s) for s in out]


def plain_likeness(a, b):
    both, common = len(a) + len(b), 0
    left = [plain_tree(a), plain_tree(b)]
    size = lambda x: len(x) if isinstance(x, str) else sum(map(size, x))
    for _ in range(3):
        x, y = map(Counter, left)
        common += sum(size(k) * n for k, n in (x & y).items())
        left = [[c for k, n in d.items() for _ in range(n) for c in k] for d in (x - y, y - x)]
    return 1.0 if a == b else 2 * common / both if both else 0.0


def test_trees_and_likeness_by_brute_force():
    rng = random.Random(12)
    pieces = ["some words here ", "a", "é", "漢字かな", "x" * 150, "\n", "\n\n", " \t\n", "Another. ", "".join(rng.choice("abcdef ") for _ in range(90))]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(120)] + ["", "\n", "\n\n", "x"]
    other = texts[1:] + texts[:1]
    forest, roots = fingerprints.plant(pa.array(texts))
    for i, t in enumerate(texts):
        tree = plain_tree(t)
        assert "".join(x for s in tree for p in s for x in p) == t
        at = np.flatnonzero(forest.up[0] == i)
        assert [[forest.weight[2][forest.up[2] == p].tolist() for p in np.flatnonzero(forest.up[1] == s)] for s in at] == [[[len(x) for x in p] for p in s] for s in tree]
    shown = fingerprints.write(forest, roots)
    back, again = fingerprints.read(shown)
    assert again == roots and all((x == y).all() for k in ("digest", "weight", "up") for x, y in zip(getattr(back, k), getattr(forest, k), strict=True))
    got = fingerprints.compare(texts, other)
    assert got["fingerprint"] == shown == [fingerprints.fingerprint(t) for t in texts]
    for i, (a, b) in enumerate(zip(texts, other, strict=True)):
        assert got["near_next"][i] == pytest.approx(plain_likeness(a, b)) == fingerprints.likeness(shown[i], fingerprints.fingerprint(b))
        assert got["near_edited"][i] == pytest.approx(plain_likeness(a, fingerprints.edited(a, b)))
        assert (shown[i] == fingerprints.fingerprint(b)) == (a == b)


def test_fingerprints_of_odd_tables(spark):
    """Keys that are text, extra columns with the outputs' names, a key with many texts, a very long text."""
    rows = [("b", "x " * 300_000, 1, 2), ("a", "y", 1, 2), (None, "z", 1, 2)] + [("same", f"text {i}", 1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string, fingerprint int, n_chars int")
    got = fingerprints.with_next(df, lambda t, n: {"t": t, "n": n}, "t string, n string").collect()
    follows = {r["t"]: r["n"] for r in got}
    at, seen = follows["z"], []  # after the last comes the first: the key "same"
    while at not in seen:
        seen.append(at)
        at = follows[at]
    assert len(seen) == len(rows) and set(seen[:200]) == {f"text {i}" for i in range(200)} and seen[200:] == ["x " * 300_000, "y", "z"]


def test_fingerprints_of_ties_and_single_rows(spark):
    fn = lambda t, n: {"t": t, "n": n}
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprints.with_next(one, fn, "t string, n string").collect()] == [(1, "x", "x")]
    tie = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, None)], "doc_id long, text string")
    got = fingerprints.with_next(tie, fn, "t string, n string").collect()
    assert Counter(r["t"] for r in got) == {"x": 2, "y": 1, "": 1} == Counter(r["n"] for r in got)
    assert fingerprints.with_next(one.limit(0), fn, "t string, n string").count() == 0


def test_edited_text_digest(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.op9_fingerprints(spark, sf).collect()}
    for i, r in enumerate(docs):
        t, n = r["text"], docs[(i + 1) % len(docs)]["text"]
        want = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[r["doc_id"]]["edited_sha256"] == sha256(want.encode()).hexdigest() and got[r["doc_id"]]["n_chars"] == len(t)
    assert sum(g["near_edited"] > g["near_next"] for g in got.values()) > 0.95 * len(got)
