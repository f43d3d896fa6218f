"""Filter interaction audit: which of five filters removes what, in every order, without running any order.

A document's failures are a mask of five bits. For every part and label class the documents are summed up in 32 signed sums, one for each
set of filters: a document counts +1 or -1 as its mask holds an even or odd number of the set's filters. That is the
Walsh-Hadamard transform of the histogram of masks; as its matrix is its own inverse but for a factor of 32, the number of documents of every
mask comes back exactly. All else is arithmetic on 32 cells a part: a filter at a place of an order removes the masks that hold it and none of
those before it. Summed over all 120 orders, a document that fails f filters is removed 120 / f times by each of them, as each
comes first equally often.

Filters: A fewer than MIN_WORDS words; B fewer different words than half of them; C more than 3 % capitals of A to Z; D any of
``#$%&*|``; E the text of a smaller key.

All of it is column expressions. Texts are read once, in a narrow stage that leaves a digest and four bits; what is shuffled is these rows.
E needs the smallest key of each text: rows are first summed by text, part, labels and key, so that a text copied a billion times is a few
rows a task before the shuffle.

Defined results: a null text is the empty text; a null part is the empty string; a null key is no one's smaller key and has none, so its
row doesn't fail E; rows with equal key and text count each, and neither is the other's copy; a key with several rows of labels is good
or toxic if one of them says so, and neither without a row; an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._spark import table

FILTERS = "ABCDE"
MIN_WORDS = 200
SPACE = r"[\x20\x09-\x0D]+"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CLASSES = ("all", "good", "toxic")


def failures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep``, the text's digest, and the failures of A to D as bits of an int, ``m``."""
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select(*keep, "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"))  # a column of its own, so that the text is split once
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < MIN_WORDS, 100 * different.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.length("t").cast("long"), F.col("t").rlike("[#$%&*|]"))
    return t.select(*keep, F.sha2("t", 256).alias("digest"), sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).alias("m"))


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, good, toxic, mask, n): documents by part, labels and the filters they fail. ``labels`` has the key, quality and toxic."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = failures(rows, "key", "part").groupBy("key", "part", "digest", "m").agg(F.count("*").alias("n"))
    flags = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Null keys have no label; each text of theirs gets a key of its own, so that they don't meet in one task.
    rows = rows.withColumn("k", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("null "), "digest"))).join(flags, "k", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    texts = rows.groupBy("digest", "part", "m", no("good"), no("toxic")).agg(F.sum("n").alias("n"), F.min("key").alias("low"), F.min_by("n", "key").alias("n_low"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    held = texts.withColumn("first", F.min("low").over(Window.partitionBy("digest")))  # a text has a few rows by now: one a part and label
    original = F.col("n_null") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("m").alias("mask"), original.alias("n")), F.struct((F.col("m") + 16).alias("mask"), (F.col("n") - original).alias("n")))).alias("e")
    return held.select("part", "good", "toxic", both).where("e.n > 0").groupBy("part", "good", "toxic", "e.mask").agg(F.sum("e.n").alias("n"))


def parity_sums(counts: DataFrame) -> DataFrame:
    """(part, label, sums): for every set of filters, the documents whose masks hold an even number of them less those with an odd number."""
    label = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))), lambda x: x.isNotNull())).alias("label")
    signed = [F.sum(F.col("n") * (1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2))).alias(f"s{s}") for s in range(CELLS)]
    return counts.select("part", label, "mask", "n").groupBy("part", "label").agg(*signed).select("part", "label", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): the number of documents of each mask, by inverting the sums; label classes without a document are zeros."""

    def at(m: Column) -> Column:
        signed = F.transform("sums", lambda x, s: x * (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)))
        return (F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x) / CELLS).cast("long")

    back = sums.select("part", "label", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), at).alias("cells"))
    zeros = F.array_repeat(F.lit(0).cast("long"), CELLS)
    return back.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == c, F.col("cells"))), zeros).alias(c) for c in CLASSES])


def orders(cell: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    step = "struct<filter_order: string, step: int, bit: int, before: int>"
    steps = [(o, i + 1, 1 << FILTERS.index(c), sum(1 << FILTERS.index(x) for x in o[:i])) for o in ORDERS for i, c in enumerate(o)]
    all_steps = F.from_json(F.lit("[" + ",".join('{"filter_order":"%s","step":%d,"bit":%d,"before":%d}' % s for s in steps) + "]"), f"array<{step}>")

    def over(of: str, weight) -> Column:
        """The sum over masks of the cell times its weight."""
        return F.aggregate(F.transform(of, lambda n, m: n * weight(m)), F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda m, bits: m.bitwiseAND(F.col(bits)) != 0
    one = lambda c: F.when(c, 1).otherwise(0)
    removed = lambda m: one(has(m, "bit") & ~has(m, "before"))
    share = F.array(*[F.lit(len(ORDERS) // max(1, m.bit_count())) for m in range(CELLS)])
    return cell.withColumn("s", F.explode(all_steps)).select("part", *CLASSES, "s.*").select(
        "part", "filter_order", "step",
        over("all", lambda m: one(~has(m, "bit") & ~has(m, "before"))).alias("kept"),
        over("all", removed).alias("removed"),
        over("all", lambda m: one(has(m, "bit") & has(m, "before"))).alias("redundant"),
        over("all", lambda m: one(m == F.col("bit"))).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("all", lambda m: F.when(has(m, "bit"), F.get(share, m)).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The whole audit: 600 rows a part."""
    return orders(cells(parity_sums(mask_counts(docs, labels, key, text, part))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


_LETTERS = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
d AS MATERIALIZED (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS fe FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
x AS (SELECT *, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END, CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS fails FROM d),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM {_LETTERS} a(c), {_LETTERS} b(c), {_LETTERS} c(c), {_LETTERS} d(c), {_LETTERS} e(c) WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
k AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM x GROUP BY ALL),
y AS (SELECT *, substr(filter_order, step, 1) AS f, CASE WHEN fails = '' THEN 9 ELSE (SELECT min(i) FROM unnest(range(1, 6)) u(i) WHERE contains(fails, substr(filter_order, i, 1))) END AS hit FROM k, s),
r AS (SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (WHERE hit > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE hit < step AND contains(fails, f)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE hit = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE hit = step AND toxic), 0)::BIGINT AS toxic_lost FROM y GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
