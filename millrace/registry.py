"""The registered queries over the driver's tables, and the SQL to hold each against."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vint as V
from millrace.functions.numbers import log_add, logistic
from millrace.functions.printed import printed, printed_groups
from millrace.operators import counts as C
from millrace.operators import graph as G
from millrace.operators import index as I
from millrace.operators import layout as L
from millrace.operators import postings as P
from millrace.operators import spam as S
from millrace.operators import warehouse as W
from millrace.plans.lineage import cut, fresh_path, remove
from millrace.sources import files
from millrace.sources.derived import CUSTOMER, NATION, SUPPLIER, trade_graph
from millrace.sources.files import with_offsets
from millrace.sources.offsets import lines_at
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _of(fn, *names, **more) -> Query:
    return lambda spark, d: fn(*(table(spark, d, n) for n in names), **more)


# Star schema -----------------------------------------------------------------------------------------------------------

_NOV = "l_shipdate >= TIMESTAMP '1996-11-01' AND l_shipdate < TIMESTAMP '1996-12-01'"
register("q1_count_by_day", _of(W.count_shipped, "lineitem", when="1996-11-01"), "SELECT count(*) AS answer FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-11-01' AND l_shipdate < TIMESTAMP '1996-11-02'")
register("q1_count_by_month", _of(W.count_shipped, "lineitem", when="1996-11"), f"SELECT count(*) AS answer FROM lineitem WHERE {_NOV}")
register("q1_count_by_year", _of(W.count_shipped, "lineitem", when="1996"), "SELECT count(*) AS answer FROM lineitem WHERE year(l_shipdate) = 1996")
register("q2_order_lookup_top20", _of(W.order_lookup, "lineitem", "orders", when="1996-11"), f"SELECT o_orderpriority, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_NOV} ORDER BY o_orderkey, o_orderpriority LIMIT 20")
register("q3_part_supplier_top20", _of(W.part_supplier, "lineitem", "part", "supplier", when="1996-11"), f"SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE {_NOV} ORDER BY 1, 2, 3 LIMIT 20")
register("q4_nation_counts", _of(W.nation_counts, "lineitem", "orders", "customer", "nation", when="1996-11"), f"SELECT n_nationkey, n_name, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {_NOV} GROUP BY 1, 2 ORDER BY 1, 2")
register("q5_monthly_two_nations", _of(W.monthly_by_nation, "lineitem", "orders", "customer"), "SELECT strftime(l_shipdate, '%Y-%m') AS ym, c_nationkey, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 24) GROUP BY 1, 2 ORDER BY 1, 2")

register(
    "orders_last_item",
    lambda spark, d: W.last_of_each(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS i FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE i = 1",
)


def _top(sql: str, line: str, order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS place, {line} AS line FROM ({sql})"


register("q2_printed", lambda spark, d: printed(QUERIES["q2_order_lookup_top20"](spark, d), ["o_orderpriority", "o_orderkey"], ["o_orderkey", "o_orderpriority"]), _top(ORACLE_SQL["q2_order_lookup_top20"], "'(' || o_orderpriority || ',' || o_orderkey || ')'", "o_orderkey, o_orderpriority"))
register("q3_printed", lambda spark, d: printed(QUERIES["q3_part_supplier_top20"](spark, d), ["l_orderkey", "p_name", "s_name"], ["l_orderkey", "p_name", "s_name"]), _top(ORACLE_SQL["q3_part_supplier_top20"], "'(' || l_orderkey || ',' || p_name || ',' || s_name || ')'", "l_orderkey, p_name, s_name"))
register("q4_printed", lambda spark, d: printed(QUERIES["q4_nation_counts"](spark, d), ["n_nationkey", "n_name", "cnt"], ["n_nationkey", "n_name"]), _top(ORACLE_SQL["q4_nation_counts"], "'(' || n_nationkey || ',' || n_name || ',' || cnt || ')'", "n_nationkey, n_name"))
register(
    "q5_printed",
    lambda spark, d: printed_groups(QUERIES["q5_monthly_two_nations"](spark, d), "c_nationkey", {3: "CANADA", 24: "USA"}, ["ym", "cnt"], ["ym"]),
    f"WITH q AS ({ORACLE_SQL['q5_monthly_two_nations']}), x AS (SELECT 0 AS part, '' AS ym, 'CANADA' AS line UNION ALL SELECT 1, '', 'USA' UNION ALL SELECT (c_nationkey = 24)::INTEGER, ym, '(' || ym || ',' || cnt || ')' FROM q) SELECT row_number() OVER (ORDER BY part, ym) AS place, line FROM x",
)

# Words and lines -------------------------------------------------------------------------------------------------------


def _lines(name: str, key: str, fn) -> Query:
    return lambda spark, d: fn(T.lines(table(spark, d, name), key))


def _norm(t: str) -> str:
    return rf"list_transform(list_filter(string_split_regex(lower({t}), '[ \t\n\r\f]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '(^[^a-z]+|[^a-z]+$)', '', 'g'))"


def _tok(t: str) -> str:
    return f"list_filter({_norm(t)}, lambda x: x <> '')"


def _sql_lines(name: str, key: str) -> str:
    return f"l AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line FROM {name} WHERE text IS NOT NULL)"


def _sql_sets(name: str, key: str) -> str:
    cap = "list_filter(list_concat(t[1:99], list_filter(t[100:], lambda x: x <> '')[1:1]), lambda x: x <> '')"
    return f"{_sql_lines(name, key)}, s AS MATERIALIZED (SELECT row_number() OVER () AS i, list_distinct({cap}) AS t FROM (SELECT {_norm('line')} AS t FROM l)), w AS (SELECT i, unnest(t) AS word FROM s)"


_FREQ = "f AS (SELECT word, count(*) AS n FROM w GROUP BY 1)"
_PAIRS = "p AS (SELECT a.word AS x, b.word AS y, count(*) AS n FROM w a JOIN w b ON a.i = b.i AND a.word <> b.word GROUP BY 1, 2), pmi AS (SELECT x, y, p.n, log10(p.n * (SELECT count(*) FROM l) / (a.n * b.n)) AS pmi FROM p JOIN f a ON a.word = x JOIN f b ON b.word = y)"
register("word_count", _of(C.word_count, "documents"), f"SELECT word, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS word FROM documents) GROUP BY 1")
register("line_frequency", _lines("documents", "doc_id", C.line_frequency), f"WITH {_sql_sets('documents', 'doc_id')}, {_FREQ} SELECT * FROM f")
register("line_total", _lines("documents", "doc_id", C.line_total), f"WITH {_sql_lines('documents', 'doc_id')} SELECT '*' AS word, count(*) AS n FROM l")
register("line_counts", _lines("documents", "doc_id", C.line_counts), f"WITH {_sql_sets('documents', 'doc_id')}, {_FREQ} SELECT * FROM f UNION ALL SELECT '*', count(*) FROM l")
#: Pairs that share fewer lines are left out of the listings below; pmi_profile sums up all of them.
MIN_COUNT = 10


def _pmi(lines: DataFrame) -> DataFrame:
    return C.pmi_pairs(lines, min_count=MIN_COUNT)


register("cooccurrence_pairs", _lines("documents", "doc_id", lambda l: C.cooccurrence(l, min_count=MIN_COUNT)), f"WITH {_sql_sets('documents', 'doc_id')}, {_FREQ}, {_PAIRS} SELECT x, y, n FROM p WHERE x < y AND n >= {MIN_COUNT}")
register("pmi_pairs", _lines("documents", "doc_id", lambda l: _pmi(l).withColumn("pmi", F.round("pmi", 6))), f"WITH {_sql_sets('documents', 'doc_id')}, {_FREQ}, {_PAIRS} SELECT x, y, n, round(pmi, 6) AS pmi FROM pmi WHERE n >= {MIN_COUNT}")


def _stripe_view(df: DataFrame, key: str, *more: str) -> DataFrame:
    v = F.map_values("stripe")
    return df.select(key, *more, F.size("stripe").cast("long").alias("size"), F.array_join(F.array_sort(F.map_keys("stripe")), " ").alias("words"), F.round(F.array_max(v), 6).alias("highest"), F.round(F.array_min(v), 6).alias("lowest"))


register(
    "pmi_stripes",
    _lines("documents", "doc_id", lambda l: _stripe_view(C.pmi_stripes_of(l, min_count=MIN_COUNT), "x")),
    f"WITH {_sql_sets('documents', 'doc_id')}, {_FREQ}, {_PAIRS} SELECT x, count(*) AS size, string_agg(y, ' ' ORDER BY y) AS words, round(max(pmi), 6) AS highest, round(min(pmi), 6) AS lowest FROM pmi WHERE n >= {MIN_COUNT} GROUP BY 1",
)
register(
    "pmi_profile",
    _lines("documents", "doc_id", lambda l: C.pmi_profile(l).withColumns({c: F.round(c, 6) for c in ("highest", "lowest")})),
    f"WITH {_sql_sets('documents', 'doc_id')}, {_FREQ}, {_PAIRS} SELECT x, count(*) AS partners, sum(n)::BIGINT AS together, round(max(pmi), 6) AS highest, round(min(pmi), 6) AS lowest FROM pmi GROUP BY 1",
)
_BIG = f"{_sql_lines('documents', 'doc_id')}, t AS (SELECT {_tok('line')} AS t FROM l), g AS (SELECT t[i] AS w1, t[i + 1] AS w2 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t)), b AS (SELECT w1, w2, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT w1, sum(n)::BIGINT AS total FROM b GROUP BY 1)"
register("bigram_counts", _lines("documents", "doc_id", C.bigrams), f"WITH {_BIG} SELECT * FROM b")
register("bigram_marginals", _lines("documents", "doc_id", lambda l: C.bigram_marginals(C.bigrams(l))), f"WITH {_BIG} SELECT * FROM m")
register(
    "bigram_pairs",
    _lines("documents", "doc_id", lambda l: C.bigram_pairs(C.bigrams(l)).withColumn("value", F.round("value", 6))),
    f"WITH {_BIG} SELECT w1, w2, round(n / total, 6) AS value, false AS is_marginal FROM b JOIN m USING (w1) UNION ALL SELECT w1, '*', total::DOUBLE, true FROM m",
)
register(
    "bigram_stripes",
    _lines("documents", "doc_id", lambda l: _stripe_view(C.bigram_stripes_of(l), "w1", "total")),
    f"WITH {_BIG} SELECT w1, total, count(*) AS size, string_agg(w2, ' ' ORDER BY w2) AS words, round(max(n / total), 6) AS highest, round(min(n / total), 6) AS lowest FROM b JOIN m USING (w1) GROUP BY 1, 2",
)
register(
    "line_offsets",
    lambda spark, d: with_offsets(table(spark, d, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("offset").cast("long").alias("offset")),
    "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)) "
    "SELECT doc_id, line_no::BIGINT AS line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM l",
)

# Index -----------------------------------------------------------------------------------------------------------------


def _index(fn) -> Query:
    return lambda spark, d: fn(I.postings(table(spark, d, "documents")))


_POST = f"i AS (SELECT term, docno, count(*)::INTEGER AS tf FROM (SELECT doc_id AS docno, unnest({_tok('text')}) AS term FROM documents) GROUP BY 1, 2)"
register("postings", _index(lambda i: i), f"WITH {_POST} SELECT * FROM i")
register("term_df", _index(I.document_frequency), f"WITH {_POST} SELECT term, count(*) AS df FROM i GROUP BY 1")
register("gap_postings", _index(I.gap_postings), f"WITH {_POST} SELECT term, docno, tf, docno - lag(docno, 1, 0) OVER (PARTITION BY term, docno // {I.BLOCK} ORDER BY docno) AS gap FROM i")
register(
    "gap_bytes",
    _index(lambda i: V.with_number(V.with_bytes(I.gap_postings(i).select("term", "docno", F.col("gap").alias("g")), "g", "b"), "b", "gap").select("term", "docno", F.hex("b").alias("bytes"), "gap")),
    f"WITH {_POST}, g AS (SELECT term, docno, docno - lag(docno, 1, 0) OVER (PARTITION BY term, docno // {I.BLOCK} ORDER BY docno) AS gap FROM i) SELECT term, docno, CASE WHEN gap <= 127 THEN printf('%02X', gap) WHEN gap <= 255 THEN '8F' || printf('%02X', gap) WHEN gap <= 65535 THEN '8E' || printf('%04X', gap) ELSE '8D' || printf('%06X', gap) END AS bytes, gap FROM g",
)
register("gap_roundtrip", lambda spark, d: I.decode_lists(P.lists(table(spark, d, "documents"))), f"WITH {_POST} SELECT * FROM i")
register(
    "posting_lists",
    lambda spark, d: P.lists(table(spark, d, "documents")).select("term", "block", F.array_join(F.transform("postings", lambda e: F.concat_ws(":", e["gap"], e["tf"])), " ").alias("postings")),
    f"WITH {_POST}, g AS (SELECT *, docno // {I.BLOCK} AS block, docno - lag(docno, 1, 0) OVER (PARTITION BY term, docno // {I.BLOCK} ORDER BY docno) AS gap FROM i) SELECT term, block, string_agg(gap || ':' || tf, ' ' ORDER BY docno) AS postings FROM g GROUP BY 1, 2",
)


def _flag(term: str) -> str:
    return f"list_contains(t, '{term}')"


#: By session and data folder, the index that its boolean queries share. It goes when the interpreter ends.
_INDEXES: dict[tuple[str, str], str] = {}


def _stored_index(spark: SparkSession, d: str) -> P.Index:
    """The stored index of the documents: written by the first query that asks for it, read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = fresh_path(spark, "index")
        P.create(table(spark, d, "documents"), path)
        _INDEXES[key] = path
        atexit.register(_forget, spark, path)
    return P.Index(spark, _INDEXES[key])


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended before, and can't reach its folders any more
        with suppress(Exception):
            remove(spark, path)


_DOCS = f"d AS (SELECT doc_id AS docno, text, {_tok('text')} AS t FROM documents)"
for _name, _query, _where in (
    ("boolean_and", "the of AND", f"{_flag('the')} AND {_flag('of')}"),
    ("boolean_or", "der la OR", f"{_flag('der')} OR {_flag('la')}"),
    ("boolean_nested", "the de AND la der OR AND", f"({_flag('the')} AND {_flag('de')}) AND ({_flag('la')} OR {_flag('der')})"),
    ("boolean_absent", "zebra", _flag("zebra")),
):
    register(_name, (lambda q: lambda spark, d: _stored_index(spark, d).query(q))(_query), f"WITH {_DOCS} SELECT docno FROM d WHERE {_where}")
register(
    "boolean_snippets",
    lambda spark, d: I.with_snippets(_stored_index(spark, d).query("the de AND"), table(spark, d, "documents")),
    f"WITH {_DOCS} SELECT docno, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS snippet FROM d WHERE {_flag('the')} AND {_flag('de')} ORDER BY 1",
)

_SHIFT = f"least({P.MOST_SHIFT}, ceil(log2(greatest(1.0, {P.PER_BLOCK}::DOUBLE * (SELECT count(DISTINCT doc_id) FROM documents) / df))))::INTEGER"
register(
    "boolean_reads",
    lambda spark, d: _stored_index(spark, d).reads("the de AND").select("read", "term", "blocks", "decoded"),
    f"WITH {_POST}, t AS (SELECT term, {_SHIFT} AS shift, df FROM (SELECT term, count(*) AS df FROM i WHERE term IN ('the', 'de') GROUP BY 1)), b AS (SELECT i.term, docno, docno >> shift AS block FROM i JOIN t USING (term)), "
    "o AS (SELECT term, shift, row_number() OVER (ORDER BY df, term = 'de') - 1 AS read FROM t), n AS (SELECT term, count(DISTINCT block) AS blocks FROM b GROUP BY 1) "
    "SELECT o.read::INTEGER AS read, o.term, blocks, CASE WHEN o.read = 0 THEN blocks ELSE (SELECT count(DISTINCT b.block) FROM b WHERE b.term = o.term AND b.block IN (SELECT x.docno >> o.shift FROM b x WHERE x.term <> o.term)) END AS decoded FROM o JOIN n USING (term)",
)


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """An index whose toxic documents are replaced by a later segment, and which is made one again."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), fresh_path(spark, "index")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    both = P.add(P.create(docs, path), docs.join(toxic, "doc_id").withColumn("text", F.concat(F.lit("replaced "), "text")))
    out = cut(P.compact(both).postings("the", "replaced"))
    remove(spark, path)
    return out


def _recreated(spark: SparkSession, d: str) -> DataFrame:
    """An index of the labelled documents, dropped for one of all."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), fresh_path(spark, "index")
    P.create(docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id"), path)
    out = cut(P.create(docs, path).postings("of"))
    remove(spark, path)
    return out


register("index_recreated", _recreated, f"WITH {_POST} SELECT * FROM i WHERE term = 'of'")
_TOXIC = "(SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'replaced ' || text ELSE text END AS text FROM documents)"
register("index_updates", _updates, f"WITH {_POST.replace('FROM documents', f'FROM {_TOXIC}')} SELECT term, docno, tf FROM i WHERE term IN ('the', 'replaced')")

# Graph -----------------------------------------------------------------------------------------------------------------

SOURCES = [1, 2]
PUSH_SOURCES = [1, 2, CUSTOMER + 1, CUSTOMER + 2]


def _graph(fn) -> Query:
    return lambda spark, d: fn(*trade_graph(spark, d))


_EDGES = (
    f"e AS MATERIALIZED (SELECT DISTINCT o_custkey + {CUSTOMER} AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_partkey, l_suppkey + {SUPPLIER} FROM lineitem"
    f" UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + {NATION} FROM supplier), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), dg AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM e)"
)


def _sql_ppr(n: int) -> str:
    a, out = G.ALPHA, [_EDGES, f"r0 AS (SELECT id AS source, id, 1.0::DOUBLE AS rank FROM v WHERE id IN ({', '.join(map(str, SOURCES))}))"]
    for k in range(n):
        out.append(f"c{k} AS MATERIALIZED (SELECT source, dst AS id, sum(rank / deg) AS m FROM r{k} JOIN dg ON r{k}.id = src GROUP BY 1, 2)")
        out.append(f"x{k} AS (SELECT source, id, {1 - a} * m AS rank FROM c{k} UNION ALL SELECT s.source, s.source, {a} + {1 - a} * greatest(0, 1 - coalesce((SELECT sum(m) FROM c{k} WHERE c{k}.source = s.source), 0)) FROM (SELECT source FROM r0) s)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT source, id, sum(rank) AS rank FROM x{k} GROUP BY 1, 2)")
    return "WITH " + ", ".join(out)


def _sql_pagerank(n: int) -> str:
    a, out = G.ALPHA, [_EDGES, "n AS (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS (SELECT id, 1.0 / n AS rank FROM v, n)"]
    for k in range(n):
        out.append(f"c{k} AS MATERIALIZED (SELECT v.id, coalesce(sum(rank / deg), 0) AS m FROM v LEFT JOIN (SELECT dst, rank, deg FROM r{k} JOIN dg ON r{k}.id = src) ON dst = v.id GROUP BY 1)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT id, {a} / n + {1 - a} * (m + greatest(0, 1 - (SELECT sum(m) FROM c{k})) / n) AS rank FROM c{k}, n)")
    return "WITH " + ", ".join(out)


def _sql_components(rounds: int = 10) -> str:
    out = [_EDGES, "u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)", "k0 AS (SELECT id, id AS root FROM v)"]
    for k in range(rounds):
        out.append(f"k{k + 1} AS MATERIALIZED (SELECT k.id, least(any_value(k.root), min(o.root)) AS root FROM k{k} k JOIN u ON u.a = k.id JOIN k{k} o ON o.id = u.b GROUP BY 1)")
    return f"WITH {', '.join(out)} SELECT id, root FROM k{rounds}"


def _rounded(df: DataFrame, c: str = "rank") -> DataFrame:
    return df.withColumn(c, F.round(c, 9))


register("graph_build", _graph(lambda v, e: G.initial_ranks(v, SOURCES)), f"WITH {_EDGES} SELECT s.id AS source, v.id, CASE WHEN s.id = v.id THEN 1.0::DOUBLE ELSE 0 END AS rank FROM v, (VALUES {', '.join(f'({s}::BIGINT)' for s in SOURCES)}) s(id)")
register("graph_stats", _graph(G.stats), f"WITH {_EDGES} SELECT (SELECT count(*) FROM v) AS n_nodes, count(*) AS n_edges, count(DISTINCT src) AS n_active FROM e")
for _n in (1, 3):
    register(f"ppr_iter{_n}", (lambda n: _graph(lambda v, e: _rounded(G.personalized_pagerank(v, e, SOURCES, n))))(_n), f"{_sql_ppr(_n)} SELECT source, id, round(rank, 9) AS rank FROM r{_n}")
register(
    "ppr_topk",
    _graph(lambda v, e: _rounded(G.top_k(G.personalized_pagerank(v, e, SOURCES, 3).withColumn("rank", F.round("rank", 12)), 20))),
    f"{_sql_ppr(3)}, t AS (SELECT source, id, round(rank, 12) AS rank FROM r3) SELECT source, place::INTEGER AS place, id, round(rank, 9) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank DESC, id) AS place FROM t) WHERE place <= 20",
)
register(
    "ppr_push",
    _graph(lambda v, e: _rounded(G.personalized_push(v, e, PUSH_SOURCES)).where("rank > 0")),
    f"WITH {_EDGES}, r0 AS (SELECT id AS source, id, 1.0::DOUBLE AS x FROM v WHERE id IN ({', '.join(map(str, PUSH_SOURCES))})), "
    + ", ".join(f"r{k + 1} AS MATERIALIZED (SELECT source, dst AS id, sum({1 - G.ALPHA} * x / deg) AS x FROM r{k} JOIN dg ON r{k}.id = src GROUP BY 1, 2)" for k in range(3))
    + ", x AS (SELECT source, id, sum(x) AS x FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY 1, 2), y AS (SELECT source, id, round(x / sum(x) OVER (PARTITION BY source), 9) AS rank FROM x) SELECT * FROM y WHERE rank > 0",
)


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds, run in two parts over one layout on storage."""
    path = fresh_path(spark, "graph")
    v, e = trade_graph(spark, d)
    G.personalized_pagerank(v, e, SOURCES, 1, path=path)
    out = _rounded(G.personalized_pagerank(v, e, SOURCES, 3, path=path))
    remove(spark, path)
    return out


def _layout_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and degrees of a layout that is written, forgotten and opened again."""
    path = fresh_path(spark, "graph")
    L.store(*trade_graph(spark, d), path).close()
    at = L.open_layout(spark, path)
    out = cut(at.nodes)
    at.close(delete=True)
    return out


register("ppr_resumed", _resumed, f"{_sql_ppr(3)} SELECT source, id, round(rank, 9) AS rank FROM r3")
register("layout_nodes", _layout_nodes, f"WITH {_EDGES} SELECT id, count(src) AS deg FROM v LEFT JOIN e ON src = id GROUP BY 1")
register(
    "ppr_log_sums",
    _graph(lambda v, e: (lambda r: r.where(f"source = {SOURCES[0]}").select("id", F.log("rank").alias("a")).join(r.where(f"source = {SOURCES[1]}").select("id", F.log("rank").alias("b")), "id", "full").select("id", F.round(log_add("a", "b"), 9).alias("log_rank")))(G.personalized_pagerank(v, e, SOURCES, 3))),
    f"{_sql_ppr(3)} SELECT id, round(ln(sum(rank)), 9) AS log_rank FROM r3 GROUP BY 1",
)
register("pagerank_uniform", _graph(lambda v, e: _rounded(G.pagerank(None, e, 3, kept=True))), f"{_sql_pagerank(3)} SELECT id, round(rank, 9) AS rank FROM r3")
register("weak_components", _graph(lambda v, e: G.components(e)), _sql_components())
register("range_partition_ids", lambda spark, d: table(spark, d, "orders").select("o_orderkey", G.range_part("o_orderkey", 1_500_000, 16).alias("part")), "SELECT o_orderkey, (floor(o_orderkey / 1500000.0::DOUBLE * 16) % 16)::INTEGER AS part FROM orders")

_PARALLEL = _EDGES.replace("SELECT DISTINCT", "SELECT")
register("ppr_parallel_edges", lambda spark, d: _rounded(G.personalized_pagerank(*trade_graph(spark, d, parallel=True), SOURCES, 3)), f"{_sql_ppr(3).replace(_EDGES, _PARALLEL)} SELECT source, id, round(rank, 9) AS rank FROM r3")
register(
    "ppr_topk_lines",
    _graph(lambda v, e: G.top_k_lines(G.top_k(G.personalized_pagerank(v, e, SOURCES, 3).withColumn("rank", F.round("rank", 12)), 20))),
    f"{_sql_ppr(3)}, t AS (SELECT source, id, round(rank, 12) AS rank FROM r3), k AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY rank DESC, id)::INTEGER AS place, id, rank FROM t), m AS (SELECT * FROM k WHERE place <= 20) "
    "SELECT source, place, printf('%.5f', rank) || chr(9) || id AS line FROM m UNION ALL SELECT DISTINCT source, 0, 'Source:' || chr(9) || source FROM m UNION ALL SELECT source, max(place) + 1, '' FROM m GROUP BY 1",
)
register("rank_listing", _graph(lambda v, e: _rounded(G.listing(G.pagerank(None, e, 3, kept=True), log=True))), f"{_sql_pagerank(3)} SELECT id, round(ln(rank), 9) AS rank FROM r3")
register("graph_messages", _graph(lambda v, e: G.message_stats(v.where(F.col("id") < NATION), e)), f"WITH {_EDGES} SELECT count(*) AS mass_messages, count(DISTINCT CASE WHEN dst < {NATION} THEN dst END) AS mass_messages_received, count(DISTINCT CASE WHEN dst >= {NATION} THEN dst END) AS missing_structure FROM e")
register("range_layout", _graph(lambda v, e: G.partitioned(G.one_record_each(v), 16)), f"WITH {_EDGES} SELECT id FROM v")

# Spam ------------------------------------------------------------------------------------------------------------------


def _spam(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where("toxic IS NOT NULL")
    return docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").select(F.col("doc_id").cast("string").alias("docid"), S.label_of("toxic").alias("label"), S.hashed_features("text").alias("features"))


def _models(spark: SparkSession) -> DataFrame:
    """Three stated models over the feature space, without weights for features divisible by 5. Weights are sums of powers of two, so scores are exact."""
    ids = spark.range(S.SPACE).where("id % 5 <> 0").select(F.col("id").cast("int").alias("feature"), F.explode(F.array(*map(F.lit, range(3)))).alias("model_id"))
    return ids.withColumn("weight", ((F.col("feature").cast("long") * (2 * F.col("model_id") + 3)) % 17 - 8) / 1024)


_FEAT = f"x AS MATERIALIZED (SELECT doc_id::VARCHAR AS docid, CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS label, list_transform({_tok('text')}, lambda y: ('0x' || substr(md5(y), 1, 5))::INTEGER) AS f FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"
_SCORES = f"{_FEAT}, o AS (SELECT docid, unnest(f)::BIGINT AS i FROM x), s AS (SELECT docid, " + ", ".join(f"sum(CASE WHEN i % 5 <> 0 THEN ((i * {2 * m + 3}) % 17 - 8) / 1024.0::DOUBLE ELSE 0 END) AS s{m}" for m in range(3)) + " FROM o GROUP BY 1), z AS (SELECT docid, label, " + ", ".join(f"coalesce(s{m}, 0) AS s{m}" for m in range(3)) + " FROM x LEFT JOIN s USING (docid))"
_VOTES = "(CASE WHEN s0 > 0 THEN 1 ELSE -1 END + CASE WHEN s1 > 0 THEN 1 ELSE -1 END + CASE WHEN s2 > 0 THEN 1 ELSE -1 END)"
register("spam_features", lambda spark, d: _spam(spark, d).select("docid", "label", F.array_join(F.col("features").cast("array<string>"), " ").alias("features")), f"WITH {_FEAT} SELECT docid, label, array_to_string(f, ' ') AS features FROM x")
register("spam_shuffle", lambda spark, d: _spam(spark, d).select("docid", S.shuffle_key(7).alias("place")), f"WITH {_FEAT} SELECT docid, md5('7:' || docid) AS place FROM x")
register("spam_train_shards", lambda spark, d: S.train(_spam(spark, d), shards=4, seed=7).select("model_id", "feature", F.round("weight", 9).alias("weight")))
register("spam_train", lambda spark, d: S.train(_spam(spark, d)).select("feature", F.round("weight", 9).alias("weight")))
register("spam_score", lambda spark, d: S.score(_spam(spark, d), _models(spark).where("model_id = 0")), f"WITH {_SCORES} SELECT docid, label, s0 AS score, CASE WHEN s0 > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM z")
register("spam_probability", lambda spark, d: S.score(_spam(spark, d), _models(spark).where("model_id = 0")).select("docid", F.round(logistic("score"), 9).alias("probability")), f"WITH {_SCORES} SELECT docid, round(1 / (1 + exp(-s0)), 9) AS probability FROM z")
register("ensemble_average", lambda spark, d: _rounded(S.ensemble(_spam(spark, d), _models(spark)), "score"), f"WITH {_SCORES} SELECT docid, label, round((s0 + s1 + s2) / 3, 9) AS score, CASE WHEN s0 + s1 + s2 > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM z")
for _name, _compat in (("ensemble_vote", False), ("ensemble_vote_compat", True)):
    register(_name, (lambda c: lambda spark, d: S.ensemble(_spam(spark, d), _models(spark), "vote", reference_compat=c))(_compat), f"WITH {_SCORES} SELECT docid, label, {_VOTES}::DOUBLE AS score, CASE WHEN {_VOTES} {'<' if _compat else '>'} 0 THEN 'spam' ELSE 'ham' END AS prediction FROM z")

# Formats on storage: written to the shared folder and read back ---------------------------------------------------------


def _stored(name: str, write: Callable[[SparkSession, str, str], None], read: Callable[[SparkSession, str, str], DataFrame]) -> Query:
    def go(spark: SparkSession, d: str) -> DataFrame:
        path = fresh_path(spark, name)
        write(spark, d, path)
        out = cut(read(spark, d, path))
        remove(spark, path)
        return out

    return go


def _write_tbl(*names: str) -> Callable[[SparkSession, str, str], None]:
    """Writes tables as ``.tbl``: the columns that the queries use in their places, the others empty. There is no clerk: order priority stands in."""

    def go(spark: SparkSession, d: str, path: str) -> None:
        for name in names:
            used = {i: c.split()[0] for i, c in files.TBL[name].items()}
            t = table(spark, d, name)
            shown = {i: F.date_format(c, "yyyy-MM-dd") if c == "l_shipdate" else F.col("o_orderpriority" if c == "o_clerk" else c).cast("string") for i, c in used.items()}
            t.select(F.concat_ws("|", *[shown.get(i, F.lit("")) for i in range(max(used) + 1)], F.lit(""))).write.text(f"{path}/{name}.tbl")

    return go


def _over_tbl(fn, *names: str, **more) -> Query:
    return _stored("tbl", _write_tbl(*names), lambda spark, d, path: fn(*(files.read_tbl(spark, path, n) for n in names), **more))


def _model_parts(spark: SparkSession, d: str, path: str) -> None:
    for i in range(3):
        files.write_tuples(_models(spark).where(F.col("model_id") == i).select("feature", "weight"), f"{path}/part-{i:05d}")


def _tree(spark: SparkSession, path: str) -> DataFrame:
    return files.read_text(spark, path)


register(
    "tbl_scan_by_month",
    _stored("tbl", _write_tbl("lineitem"), lambda spark, d, path: files.read_tbl(spark, path, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("ym")).agg(F.count("*").alias("cnt"), F.sum("l_orderkey").alias("orders"), F.sum("l_suppkey").alias("suppliers"))),
    "SELECT strftime(l_shipdate, '%Y-%m') AS ym, count(*) AS cnt, sum(l_orderkey)::BIGINT AS orders, sum(l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY 1",
)
register("tbl_nation_counts", _over_tbl(W.nation_counts, "lineitem", "orders", "customer", "nation", when="1996-11"), ORACLE_SQL["q4_nation_counts"])
register("tbl_part_supplier", _over_tbl(W.part_supplier, "lineitem", "part", "supplier", when="1996-11"), ORACLE_SQL["q3_part_supplier_top20"])
register("tbl_order_lookup", _over_tbl(lambda l, o, when: W.order_lookup(l, o, when, field="o_clerk").withColumnRenamed("o_clerk", "o_orderpriority"), "lineitem", "orders", when="1996-11"), ORACLE_SQL["q2_order_lookup_top20"])


def _write_collection(spark: SparkSession, d: str, path: str) -> None:
    """The documents' texts as plain files, GROUP documents a file, in order of their keys."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.floor(F.col("doc_id") / GROUP).alias("grp"))
    docs.repartition("grp").sortWithinPartitions("grp", "doc_id").select("grp", "text").write.partitionBy("grp").text(path)


GROUP = 250
#: Of each file a range of this size is a task.
RANGE_BYTES = 256 << 10
_GROUP_OF = "cast(regexp_extract(file, 'grp=([0-9]+)/', 1) AS bigint) AS grp"
_COLLECTION = f"l AS (SELECT grp, doc_id, i, line, (coalesce(sum(strlen(line) + 1) OVER (PARTITION BY grp ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM (SELECT doc_id // {GROUP} AS grp, doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)))"
register(
    "collection_offsets",
    _stored("collection", _write_collection, lambda spark, d, path: files.read_collection(spark, path, RANGE_BYTES).selectExpr(_GROUP_OF, "offset", "md5(cast(line AS binary)) AS md5")),
    f'WITH {_COLLECTION} SELECT grp, "offset", md5(line) AS md5 FROM l',
)


def _collection_hits(spark: SparkSession, d: str, path: str) -> DataFrame:
    """Lines of the collection that hold two words, found by an index over (file, offset) and read where they stand."""
    lines = files.read_collection(spark, path, RANGE_BYTES).select(F.struct("file", "offset").alias("at"), "line")
    hits = I.boolean_query(I.postings(lines, "at", "line"), "the of AND").select("docno.file", "docno.offset")
    return lines_at(hits).select(F.expr(_GROUP_OF), "offset", T.snippet("line").alias("snippet"))


register(
    "collection_snippets",
    _stored("collection", _write_collection, _collection_hits),
    f"WITH {_COLLECTION}, t AS (SELECT *, {_tok('line')} AS t FROM l) SELECT grp, \"offset\", CASE WHEN length(line) > 80 THEN line[1:80] || '...' ELSE line END AS snippet FROM t WHERE {_flag('the')} AND {_flag('of')}",
)
register("adjacency_edges", _stored("adjacency", lambda spark, d, path: files.write_adjacency(*trade_graph(spark, d, parallel=True), path), lambda spark, d, path: files.parse_adjacency(_tree(spark, path))[1]), f"WITH {_PARALLEL} SELECT src, dst FROM e")
register("adjacency_nodes", _stored("adjacency", lambda spark, d, path: files.write_adjacency(*trade_graph(spark, d), path), lambda spark, d, path: files.parse_adjacency(_tree(spark, path))[0]), f"WITH {_EDGES} SELECT id FROM v")
register("adjacency_nodes_tabs", _stored("adjacency", lambda spark, d, path: files.write_adjacency(*trade_graph(spark, d), path), lambda spark, d, path: files.parse_adjacency(_tree(spark, path), tabs_only=True)[0]), f"WITH {_EDGES} SELECT id FROM v")
def _twice(write: Callable[[DataFrame, str], None]) -> Callable[[SparkSession, str, str], None]:
    """Writes the customers and then, over them, the suppliers."""

    def go(spark: SparkSession, d: str, path: str) -> None:
        write(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n")), path)
        write(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("n")), path)

    return go


register("table_overwritten", _stored("table", _twice(files.write_table), lambda spark, d, path: spark.read.parquet(path)), "SELECT s_suppkey AS k, s_nationkey::BIGINT AS n FROM supplier")
register("lines_overwritten", _stored("lines", _twice(files.write_pairs), lambda spark, d, path: files.read_text(spark, path)), "SELECT s_suppkey || chr(9) || s_nationkey AS line FROM supplier")
register("tuples_overwritten", _stored("tuples", _twice(files.write_tuples), lambda spark, d, path: files.read_text(spark, path)), "SELECT '(' || s_suppkey || ',' || s_nationkey || ')' AS line FROM supplier")
register(
    "pmi_from_frequency_file",
    _stored(
        "frequencies",
        lambda spark, d, path: files.write_pairs(C.line_counts(T.lines(table(spark, d, "documents"))).select("word", F.lit(C.TOTAL).alias("all"), "n"), path, key=2),
        lambda spark, d, path: C.pmi_pairs(T.lines(table(spark, d, "documents")), frequencies=files.parse_line_frequencies(_tree(spark, path)), min_count=MIN_COUNT).withColumn("pmi", F.round("pmi", 6)),
    ),
    ORACLE_SQL["pmi_pairs"],
)
register("index_lookup", lambda spark, d: _stored_index(spark, d).postings("the"), f"WITH {_POST} SELECT * FROM i WHERE term = 'the'")
register("model_files_vote", _stored("models", _model_parts, lambda spark, d, path: S.ensemble(_spam(spark, d), files.read_models(spark, [f"{path}/part-{i:05d}" for i in range(3)]), "vote")), ORACLE_SQL["ensemble_vote"])
