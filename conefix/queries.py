"""The engine's operators over the driver's tables, each with its SQL twin beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conefix.functions import context, nullness
from conefix.functions.interval import Itv, in_bounds
from conefix.operators import analytics, edits, graph, scans, states, textdiff
from conefix.session import read_table
from conefix.sources import facts, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that checks it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def finite(value: Column) -> Column:
    """A bound, null where it is infinite."""
    return F.when((value != float("inf")) & (value != float("-inf")), value)


# --- lattices ----------------------------------------------------------------


@query("""
WITH s AS (SELECT user_id % 97 AS cohort, user_id, event_type AS var, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL),
m AS (SELECT cohort, count(DISTINCT user_id) AS n FROM s GROUP BY cohort)
SELECT s.cohort, s.var, min(lo) AS lo, max(hi) AS hi FROM s JOIN m ON s.cohort = m.cohort GROUP BY s.cohort, s.var, n HAVING count(DISTINCT user_id) = n
""")
def itv_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("cohort"), "user_id", F.col("event_type").alias("var"), "value")
    own = rows.groupBy("cohort", "user_id", "var").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return states.join_numeric(own, ["cohort"], "user_id")


@query("""
WITH s AS (SELECT o_orderpriority, o_orderstatus, min(o_totalprice) AS a, max(o_totalprice) AS b, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 30000.0::DOUBLE AS g FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, greatest(a, g) AS lo, least(b, 100000::DOUBLE - 1e-10::DOUBLE) AS hi, greatest(a, g) > least(b, 100000::DOUBLE - 1e-10::DOUBLE) AS is_bottom FROM s
""")
def itv_meet_assume(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    guard = Itv.of(F.substring("o_orderpriority", 1, 1).cast("int") * F.lit(30000.0))
    kept = Itv.of("a", "b").assume(">=", guard).assume("<", Itv.of(100000.0))
    return own.select("o_orderpriority", "o_orderstatus", kept.lo.alias("lo"), kept.hi.alias("hi"), kept.is_bottom().alias("is_bottom"))


@query("""
WITH s AS (SELECT c_mktsegment AS seg, c_nationkey AS nation, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY ALL),
t AS (SELECT seg, nation, lo, hi FROM s WHERE nation % 3 <> 0), u AS (SELECT seg, nation, lo + 500 AS lo, hi - 500 AS hi FROM s WHERE nation % 2 = 0)
SELECT coalesce(t.seg, u.seg) AS seg, coalesce(t.nation, u.nation) AS nation, greatest(coalesce(t.lo, '-inf'::DOUBLE), coalesce(u.lo, '-inf'::DOUBLE)) AS lo,
  least(coalesce(t.hi, 'inf'::DOUBLE), coalesce(u.hi, 'inf'::DOUBLE)) AS hi,
  greatest(coalesce(t.lo, '-inf'::DOUBLE), coalesce(u.lo, '-inf'::DOUBLE)) > least(coalesce(t.hi, 'inf'::DOUBLE), coalesce(u.hi, 'inf'::DOUBLE)) AS is_bottom
FROM t FULL OUTER JOIN u ON t.seg = u.seg AND t.nation = u.nation
""")
def itv_meet_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    narrowed = own.where("nation % 2 = 0").select("seg", "nation", (F.col("lo") + 500).alias("lo"), (F.col("hi") - 500).alias("hi"))
    return states.meet_numeric(own.where("nation % 3 <> 0"), narrowed, ["seg", "nation"])


@query("""
WITH RECURSIVE y AS (
  SELECT o_orderpriority AS var, year(o_orderdate) AS yr, min(o_totalprice) AS lo, max(o_totalprice) AS hi, row_number() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS k
  FROM orders GROUP BY o_orderpriority, year(o_orderdate)
), w AS (
  SELECT var, yr, lo, hi, k FROM y WHERE k = 1
  UNION ALL
  SELECT y.var, y.yr, CASE WHEN y.lo < w.lo THEN '-inf'::DOUBLE ELSE w.lo END, CASE WHEN y.hi > w.hi THEN 'inf'::DOUBLE ELSE w.hi END, y.k FROM w JOIN y ON y.var = w.var AND y.k = w.k + 1
)
SELECT var, CAST(yr AS INTEGER) AS yr, CASE WHEN isfinite(lo) THEN lo END AS lo, CASE WHEN isfinite(hi) THEN hi END AS hi FROM w
""")
def itv_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("var"), F.year("o_orderdate").alias("yr")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    lo, hi = edits.widened(F.col("lo"), F.col("hi"), ["var"], ["yr"])
    return yearly.select("var", "yr", finite(lo).alias("lo"), finite(hi).alias("hi"))


@query("""
WITH s AS (SELECT l_returnflag AS f, l_linestatus AS s, min(l_extendedprice) AS pl, max(l_extendedprice) AS ph, 1 - max(l_discount) AS dl, 1 - min(l_discount) AS dh, min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_discount) - 0.05 AS zl, max(l_discount) - 0.05 AS zh FROM lineitem GROUP BY ALL)
SELECT f, s, least(pl*dl, pl*dh, ph*dl, ph*dh) AS mul_lo, greatest(pl*dl, pl*dh, ph*dl, ph*dh) AS mul_hi,
  least(pl/ql, pl/qh, ph/ql, ph/qh) AS div_lo, greatest(pl/ql, pl/qh, ph/ql, ph/qh) AS div_hi, pl - qh AS sub_lo, ph - ql AS sub_hi,
  CASE WHEN zl <= 0 AND zh >= 0 THEN NULL ELSE least(pl/zl, pl/zh, ph/zl, ph/zh) END AS open_lo, CASE WHEN zl <= 0 AND zh >= 0 THEN NULL ELSE greatest(pl/zl, pl/zh, ph/zl, ph/zh) END AS open_hi
FROM s
""")
def itv_eval_binop(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [f(c).alias(n) for c, a, b in (("l_extendedprice", "pl", "ph"), ("l_discount", "dl", "dh"), ("l_quantity", "ql", "qh")) for f, n in ((F.min, a), (F.max, b))]
    own = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(*bounds)
    price, discount, quantity = Itv.of("pl", "ph"), Itv.of("dl", "dh"), Itv.of("ql", "qh")
    product, ratio, rest = price.mul(Itv.of(1.0).sub(discount)), price.div(quantity), price.sub(quantity)
    opened = price.div(discount.sub(Itv.of(0.05)))
    return own.select(
        "f", "s", product.lo.alias("mul_lo"), product.hi.alias("mul_hi"), ratio.lo.alias("div_lo"), ratio.hi.alias("div_hi"),
        rest.lo.alias("sub_lo"), rest.hi.alias("sub_hi"), finite(opened.lo).alias("open_lo"), finite(opened.hi).alias("open_hi"),
    )


@query("""
WITH s AS (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL), c AS (SELECT unnest([0.0, 1000.0, 200000.0, 1000000.0]::DOUBLE[]) AS bound)
SELECT o_orderpriority, bound, CASE WHEN hi < bound THEN true WHEN lo >= bound THEN false END AS lt, CASE WHEN lo >= bound THEN true WHEN hi < bound THEN false END AS ge, CASE WHEN hi < bound OR lo > bound THEN false END AS eq FROM s, c
""")
def itv_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    rows = own.withColumn("bound", F.explode(F.array(*map(F.lit, (0.0, 1000.0, 200000.0, 1000000.0)))))
    x, y = Itv.of("lo", "hi"), Itv.of("bound")
    return rows.select("o_orderpriority", "bound", x.compare("<", y).alias("lt"), x.compare(">=", y).alias("ge"), x.compare("==", y).alias("eq"))


@query("""
WITH s AS (SELECT c_nationkey AS n, c_mktsegment AS var, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY ALL),
p AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)
SELECT a, b, coalesce(bool_and(s2.n IS NULL OR coalesce(s1.lo >= s2.lo AND s1.hi <= s2.hi, false)), true) AS implies
FROM p LEFT JOIN s s2 ON s2.n = p.b LEFT JOIN s s1 ON s1.n = p.a AND s1.var = s2.var GROUP BY a, b
""")
def itv_implies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("var")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    nation = read_table(spark, sf_dir, "nation")
    pairs = nation.select("n_regionkey", F.col("n_nationkey").alias("a")).join(nation.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey").drop("n_regionkey")
    return states.implied_pairs(own, pairs, "n")


@query("""
WITH o AS (SELECT l_orderkey, min(l_linenumber) - 1 AS a, max(l_linenumber) - 1 AS b, min(l_quantity) AS c, max(l_quantity) AS d FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN a >= 0 AND b < c THEN true WHEN b < 0 OR a >= d THEN false END AS safe FROM o
""")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.min("l_linenumber") - 1).cast("double").alias("a"), (F.max("l_linenumber") - 1).cast("double").alias("b"), F.min("l_quantity").alias("c"), F.max("l_quantity").alias("d"))
    return rows.select("l_orderkey", in_bounds(Itv.of("a", "b"), Itv.of("c", "d")).alias("safe"))


@query("""
WITH r AS (SELECT d.source, d.lang, f.field, CASE WHEN f.field = 'quality' THEN l.quality ELSE l.toxic END AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (SELECT unnest(['quality', 'toxic']) AS field) f)
SELECT source, lang, field, bit_or(CASE WHEN v IS NULL THEN 1 ELSE 2 END) AS mask, bool_or(v IS NOT NULL) AS feasible FROM r GROUP BY ALL
""")
def null_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = F.array(*(F.struct(F.lit(n).alias("field"), nullness.of(F.col(n)).alias("mask")) for n in ("quality", "toxic")))
    joined = states.join_masks(rows.select("source", "lang", F.inline(fields)), ["source", "lang"], "field")
    return joined.withColumn("feasible", nullness.feasible(F.col("mask")))


@query("""
SELECT p_brand, string_agg(s, ',' ORDER BY s) AS addresses FROM (SELECT DISTINCT p_brand, l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand
""")
def addr_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return states.join_addresses(rows, ["p_brand"], "l_suppkey").select("p_brand", F.array_join("addresses", ",").alias("addresses"))


@query("""
SELECT p_brand, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM (SELECT DISTINCT p_brand, n_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY p_brand
""")
def points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    held = states.united_addresses(rows, ["p_brand"], "l_suppkey").withColumnRenamed("l_suppkey", "s_suppkey")
    heap = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return states.join_addresses(held.join(heap, "s_suppkey"), ["p_brand"], "n_name").select("p_brand", F.array_join("addresses", ",").alias("nations"))


@query("""
SELECT l_suppkey, l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_returnflag = 'R' GROUP BY ALL
""")
def weak_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    bounds = lambda df: df.groupBy("l_suppkey", "l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    return states.weak_update(bounds(rows.where(early)), bounds(rows.where(~early & (F.col("l_returnflag") == "R"))), ["l_suppkey", "l_returnflag"])


@query("""
WITH s AS (SELECT l_suppkey, l_returnflag, min(l_quantity) FILTER (l_shipdate < TIMESTAMP '1996-01-01') AS a, max(l_quantity) FILTER (l_shipdate < TIMESTAMP '1996-01-01') AS b,
  min(l_quantity) FILTER (l_shipdate >= TIMESTAMP '1996-01-01') AS c, max(l_quantity) FILTER (l_shipdate >= TIMESTAMP '1996-01-01') AS d FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, coalesce(c, a) AS lo, coalesce(d, b) AS hi FROM s
""")
def strong_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    bounds = lambda df: df.groupBy("l_suppkey", "l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    return states.strong_update(bounds(rows.where(early)), bounds(rows.where(~early)), ["l_suppkey", "l_returnflag"])


@query("""
SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY ALL
""")
def havoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    reached = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return states.havoc(own, reached, ["c_nationkey"])


# --- program facts -----------------------------------------------------------


@query("""
SELECT o_orderkey AS site, c_custkey AS callee FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 4 = c_nationkey % 4 OR c_acctbal < 0 AND o_orderkey % 4 >= c_nationkey % 4 - 1
""")
def callee_compat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").cast("string").alias("name"), (F.col("o_orderkey") % 4).alias("n_args"), F.lit(False).alias("is_ctor"))
    methods = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("method"), F.col("c_custkey").cast("string").alias("method_name"), (F.col("c_nationkey") % 4).alias("n_formals"), (F.col("c_acctbal") < 0).alias("varargs"))
    return facts.compatible_callees(sites, methods)


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS caller, o_orderpriority AS callee FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL
""")
def have_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("caller"), F.col("o_orderpriority").alias("callee")).distinct()
    rich = read_table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("method"))
    named = spark.range(2).select(F.when(F.col("id") == 0, "1-URGENT").otherwise("2-HIGH").alias("method"))
    return facts.known_calls(calls, rich.union(named))


@query("""
SELECT c_custkey, 'com.' || lower(c_mktsegment) AS package, 'Nation' || c_nationkey || '$Inner' AS class_name, 'm' || c_custkey AS method_name, c_acctbal < 0 AS is_static,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'String,int' END AS arg_types,
  (CASE WHEN c_acctbal < 0 THEN 'static ' ELSE '' END) || 'com.' || lower(c_mktsegment) || '.Nation' || c_nationkey || '$Inner#m' || c_custkey || '(' || (CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'String,int' END) || ')' AS canonical
FROM customer
""")
def method_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(
        F.when(F.col("c_acctbal") < 0, "static ").otherwise(""), F.lit("com."), F.lower("c_mktsegment"), F.lit(".Nation"), F.col("c_nationkey"), F.lit(".Inner#m"), F.col("c_custkey"),
        F.when(F.col("c_custkey") % 3 == 0, "()").otherwise("(java.lang.String, int)"),
    )
    rows = c.select("c_custkey", facts.method_id(text).alias("m"))
    return rows.select("c_custkey", F.array_join("m.package", ".").alias("package"), "m.class_name", "m.method_name", "m.is_static", F.array_join("m.arg_types", ",").alias("arg_types"), facts.method_text(F.col("m")).alias("canonical"))


@query("""
SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS asked FROM conversations
""")
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    asked = F.when(F.col("role") == "user", F.md5("text"))
    return scans.fill_forward(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], asked, "asked").select("conv_id", "turn", "asked")


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations
""")
def cum_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    sized = rows.select("conv_id", "turn", (F.octet_length("text") + 1).alias("size"))
    return scans.running_offset(sized, ["conv_id"], ["turn"], F.col("size"), "start").select("conv_id", "turn", F.col("start").cast("long").alias("start"))


# --- edits -------------------------------------------------------------------

_LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents),
n AS (SELECT doc_id // 2 AS path, doc_id % 2 AS side, md5(v) AS digest, row_number() OVER (PARTITION BY doc_id, md5(v) ORDER BY k) AS ordinal FROM l)
"""


@query(f"""
WITH {_LINES}, j AS (SELECT coalesce(a.path, b.path) AS path, a.path AS p, b.path AS q FROM (SELECT * FROM n WHERE side = 0) a FULL OUTER JOIN (SELECT * FROM n WHERE side = 1) b ON a.path = b.path AND a.digest = b.digest AND a.ordinal = b.ordinal)
SELECT path, count(*) FILTER (p IS NULL) AS added, count(*) FILTER (q IS NULL) AS deleted, count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) AS shared FROM j GROUP BY path
""")
def diff_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.floor(F.col("doc_id") / 2).alias("path"), "text")
    old, new = (edits.numbered_lines(docs.where(F.col("side") == s), "path", "text") for s in (0, 1))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "deleted", "shared")]
    return edits.diff_lines(old, new).groupBy("path").agg(*kinds)


@query("""
SELECT coalesce(a.doc_id, b.doc_id - 1) // 2 AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS change
FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) a FULL OUTER JOIN (SELECT * FROM documents WHERE doc_id % 2 = 1) b ON b.doc_id = a.doc_id + 1
""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.floor(F.col("doc_id") / 2).alias("path"), "text")
    return edits.file_changes(docs.where("side = 0"), docs.where("side = 1"), "path", "text")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'first' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'second' AS side FROM b WHERE k NOT IN (SELECT k FROM a)
""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FO")
    return edits.symmetric_difference(a, b)


@query("""
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
""")
def incr_eq_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    totals = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    return edits.recompute(totals(orders.where(~late)), orders, orders.where(late), "o_custkey", totals)


# --- graphs ------------------------------------------------------------------

_TRADE = """
edges AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.1)
"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers' to suppliers' nations, for large and discounted items."""
    items = read_table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.1").select("l_orderkey", "l_suppkey")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return items.join(orders, "l_orderkey").join(customer, "c_custkey").join(supplier, "l_suppkey").select("src", "dst").distinct()


@query(f"WITH RECURSIVE {_TRADE}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, edges.dst FROM r JOIN edges ON r.dst = edges.src) SELECT src, dst FROM r")
def cyclic_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(trade(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_TRADE}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, edges.dst FROM r JOIN edges ON r.dst = edges.src),
n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
SELECT node, least(node, coalesce(min(b.src), node)) AS component FROM n LEFT JOIN r a ON a.src = node LEFT JOIN r b ON b.src = a.dst AND b.dst = node GROUP BY node
""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(trade(spark, sf_dir))


@query(f"WITH RECURSIVE {_TRADE}, r AS (SELECT 7 AS node UNION SELECT src FROM r JOIN edges ON edges.dst = r.node WHERE r.node <> 3) SELECT node FROM r WHERE node <> 3")
def natural_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.natural_loop(trade(spark, sf_dir), 3, 7)


@query(f"""
WITH RECURSIVE {_TRADE}, a AS (SELECT 22 AS node UNION SELECT dst FROM a JOIN edges ON edges.src = a.node WHERE a.node <> 17), b AS (SELECT 17 AS node UNION SELECT src FROM b JOIN edges ON edges.dst = b.node)
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM a) AND src <> 17 AND dst IN (SELECT node FROM b)
""")
def region_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.region(trade(spark, sf_dir), 22, 17)


@query(f"WITH RECURSIVE {_TRADE}, r AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION SELECT src FROM r JOIN edges ON edges.dst = r.node) SELECT node FROM r")
def demand_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read_table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit(0).alias("origin"), F.col("n_nationkey").alias("node"))
    return graph.reach(graph.reverse(trade(spark, sf_dir)), seeds).select("node")


_PARENTS = """
edges AS (SELECT 'order ' || o_orderkey AS src, 'customer ' || o_custkey AS dst FROM orders UNION ALL SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation)
"""


def parents(spark: SparkSession, sf_dir: str, orders: bool) -> DataFrame:
    """Edges order -> customer -> nation -> region and supplier -> nation."""
    pairs = [("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey")]
    pairs += [("orders", "order", "o_orderkey", "customer", "o_custkey")] * orders
    return graph.rows_of(read_table(spark, sf_dir, t).select(F.concat(F.lit(f"{a} "), F.col(x)).alias("src"), F.concat(F.lit(f"{b} "), F.col(y)).alias("dst")) for t, a, x, b, y in pairs)


@query(f"""
WITH RECURSIVE {_PARENTS}, r AS (SELECT src, dst FROM edges WHERE src NOT LIKE 'order %' UNION ALL SELECT r.src, edges.dst FROM r JOIN edges ON r.dst = edges.src) SELECT src, dst FROM r
""")
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(parents(spark, sf_dir, False))


@query(f"""
WITH RECURSIVE {_PARENTS}, r AS (SELECT 'order ' || o_orderkey AS node FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' UNION SELECT dst FROM r JOIN edges ON edges.src = r.node) SELECT node FROM r
""")
def dirty_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp")).select(F.lit(0).alias("origin"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("node"))
    return graph.reach(parents(spark, sf_dir, True), seeds).select("node")


_STEPS = "steps AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT user_id, src, dst FROM steps WHERE dst IS NOT NULL)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, src, dst)``: each user's transitions between event types, once each."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read_table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), following.alias("dst")).where("dst IS NOT NULL").distinct()


_NODES = "p AS (SELECT user_id || ':' || src AS src, user_id || ':' || dst AS dst FROM e)"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of all users as one graph, of ``user:event type``."""
    node = lambda c: F.concat_ws(":", "user_id", c).alias(c)
    return steps(spark, sf_dir).select(node("src"), node("dst"))


@query(f"""
WITH RECURSIVE {_STEPS}, {_NODES}, r AS (SELECT src, dst FROM p UNION SELECT r.src, p.dst FROM r JOIN p ON r.dst = p.src), n AS (SELECT src AS node FROM p UNION SELECT dst FROM p)
SELECT node, least(node, coalesce(min(b.src), node)) AS component FROM n LEFT JOIN r a ON a.src = node LEFT JOIN r b ON b.src = a.dst AND b.dst = node GROUP BY node
""")
def transition_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the transitions of all users."""
    return graph.strong_components(transitions(spark, sf_dir))


@query(f"WITH RECURSIVE {_STEPS}, {_NODES}, r AS (SELECT DISTINCT user_id || ':error' AS node FROM events WHERE event_type = 'error' UNION SELECT p.src FROM r JOIN p ON p.dst = r.node) SELECT node FROM r")
def transition_cones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the errors of all users come from."""
    errors = read_table(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit(0).alias("origin"), F.concat_ws(":", "user_id", "event_type").alias("node")).distinct()
    return graph.reach(graph.reverse(transitions(spark, sf_dir)), errors).select("node")


@query(f"WITH {_STEPS} SELECT user_id, src, dst, CAST(row_number() OVER (PARTITION BY user_id, dst ORDER BY src) - 1 AS INTEGER) AS idx FROM e")
def edge_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_ordinals(steps(spark, sf_dir), ["user_id", "dst"], ["src"])


@query(f"""
WITH {_STEPS}, n AS (SELECT user_id || ':' || src AS node FROM e UNION SELECT user_id || ':' || dst FROM e), c AS (SELECT user_id || ':' || dst AS node, count(*) AS k FROM e GROUP BY ALL)
SELECT node, coalesce(k, 0) AS indegree, coalesce(k, 0) >= 2 AS is_join FROM n LEFT JOIN c USING (node)
""")
def indegree_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_indegree(steps(spark, sf_dir).select(F.concat_ws(":", "user_id", "src").alias("src"), F.concat_ws(":", "user_id", "dst").alias("dst")))


@query(f"""
WITH {_STEPS} SELECT count(*) AS edges, count(DISTINCT user_id) AS graphs, count(DISTINCT src) AS sources, count(*) FILTER (src = dst) AS self_loops FROM e
""")
def stats_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).agg(F.count("*").alias("edges"), F.countDistinct("user_id").alias("graphs"), F.countDistinct("src").alias("sources"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))


# --- latency analytics -------------------------------------------------------


@query("""
SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.percentiles(read_table(spark, sf_dir, "events"), ["event_type"], "value")
    return got.select("event_type", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


@query("""
WITH r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 3 AS grp FROM events)
SELECT event_type, grp, round(avg(value), 6) AS mean_ms FROM r GROUP BY event_type, grp HAVING count(*) = 3
""")
def latency_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.group_means(read_table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 3, "value")
    return got.select("event_type", "grp", F.round("mean_ms", 6).alias("mean_ms"))


@query("SELECT event_id, value AS ms, round((row_number() OVER (ORDER BY value, event_id) - 1) / count(*) OVER (), 9) AS share FROM events")
def latency_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "events").select("event_id", F.col("value").alias("ms"))
    return analytics.cdf(log, ["ms", "event_id"]).select("event_id", "ms", F.round("share", 9).alias("share"))


MODES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{m}'), 6) AS {m}" for m in MODES) + " FROM events GROUP BY user_id")
def mode_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.mode_table(read_table(spark, sf_dir, "events").select("user_id", "event_type", "value"), "user_id", "event_type", MODES, "value")
    return got.select("user_id", *(F.round(m, 6).alias(m) for m in MODES))


@query("""
WITH t AS (SELECT user_id % 20 AS program, event_type, sum(value) AS total FROM events GROUP BY ALL UNION ALL SELECT NULL, event_type, sum(value) FROM events GROUP BY event_type)
SELECT t.program, t.event_type, round(100 * t.total / b.total, 6) AS percent FROM t JOIN t b ON t.program IS NOT DISTINCT FROM b.program AND b.event_type = 'view'
""")
def pct_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("program"), "event_type", "value")
    return analytics.percent_of(log, "program", "event_type", "view", "value").select("program", "event_type", F.round("percent", 6).alias("percent"))








# --- tables and diffs --------------------------------------------------------


@query("""
WITH t AS (SELECT user_id, """ + ", ".join(f"avg(value) FILTER (event_type = '{m}') AS {m}" for m in MODES) + """ FROM events GROUP BY user_id),
r AS (SELECT CAST(user_id AS VARCHAR) AS program, * EXCLUDE user_id FROM t UNION ALL SELECT 'average', """ + ", ".join(f"avg({m})" for m in MODES) + """ FROM t)
SELECT program, """ + " || ".join(f"CASE WHEN {m} IS NULL THEN 'open' WHEN {m} < 0.1 THEN 'small' ELSE 'shown' END" for m in MODES) + """ AS shape, program = 'average' AS is_last FROM r
""")  # fmt: skip
def latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table by program and mode with its average row; the shape of its cells, as digits are printed differently elsewhere."""
    means = analytics.mode_table(read_table(spark, sf_dir, "events").select("user_id", "event_type", "value"), "user_id", "event_type", MODES, "value")
    rows = sinks.latex_rows(means.withColumn("program", F.col("user_id").cast("string")), "program", MODES)
    cells = F.slice(F.split(F.regexp_replace("line", r" \\\\$", ""), " & "), 2, len(MODES))
    shape = F.array_join(F.transform(cells, lambda c: F.when(c == "--", "open").when(c == "$<$0.1", "small").otherwise("shown")), "")
    return rows.select("program", shape.alias("shape"), (F.col("last") == 1).alias("is_last"))


@query(None)
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks between each document and the next one, by unique common lines."""
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.floor(F.col("doc_id") / 2).cast("string").alias("path"), "text")
    found = textdiff.diff(docs.where("side = 0"), docs.where("side = 1"))
    return found.select("path", "prev_start", "prev_len", "next_start", F.size("new_lines").alias("next_len"))




# --- positions, sets and counts ------------------------------------------------


@query("SELECT doc_id, substr(hex(encode(text)), 21, 60) AS bytes FROM documents")
def byte_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty bytes of each text from byte 10 on."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.hex(facts.bytes_at(F.col("text"), 10, 30)).alias("bytes"))


_HUNK = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


@query(f"""
SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(l_suppkey - l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift,
  coalesce(lag(l_linestatus) {_HUNK} = l_returnflag, row_number() {_HUNK} = 1) AS joins, coalesce(lag(l_suppkey) {_HUNK}, lead(l_suppkey) {_HUNK}) AS beside FROM lineitem
""")
def hunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets over hunks, contiguity and neighbours, with items of an order as hunks."""
    rows, by, order = read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]
    shift = edits.shifted(F.col("l_partkey"), F.col("l_suppkey"), by, order).cast("long")
    joins = edits.contiguous(F.col("l_returnflag"), F.col("l_linestatus"), by, order)
    return rows.select("l_orderkey", "l_linenumber", shift.alias("shift"), joins.alias("joins"), edits.neighbour(F.col("l_suppkey"), by, order).alias("beside"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS state FROM lineitem), e AS (SELECT l_orderkey, min(l_linenumber) FILTER (state IS NULL) AS first_empty FROM r GROUP BY l_orderkey)
SELECT r.l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY r.l_orderkey) + 1 + l_linenumber AS moved, first_empty FROM r JOIN e ON r.l_orderkey = e.l_orderkey
""")
def iterate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First iterates without a state, and indices moved behind the greatest."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("state"))
    empty = edits.first_empty(rows, ["l_orderkey"], "l_linenumber", "state").withColumnRenamed("l_linenumber", "first_empty")
    moved = edits.reindexed(F.col("l_linenumber"), ["l_orderkey"], F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", moved.alias("moved")).join(empty, "l_orderkey")


SEEDS = [1, 2, 3]


@query("""
WITH r AS (SELECT user_id % 3 + 1 AS seed, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT k AS row, """ + ", ".join(f'coalesce(max(value) FILTER (seed = {s}), 0) AS "{s}"' for s in SEEDS) + " FROM r GROUP BY k")
def seeds_pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs side by side by row number, with a third of the users each."""
    log = read_table(spark, sf_dir, "events").select((F.col("user_id") % 3 + 1).alias("seed"), "ts", "event_id", "value")
    return analytics.pasted(log, "seed", ["ts", "event_id"], SEEDS, "value")


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + user_id AS total FROM events")
def metric_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    metrics = F.create_map(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1).cast("long"), F.lit("user"), F.col("user_id"), F.lit("none"), F.lit(None).cast("long"))
    return rows.select("event_id", analytics.map_total(metrics).alias("total"))


@query("""
WITH r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, count(*) AS total, count(DISTINCT event_type) AS "distinct", count(*) FILTER (b IS NULL OR b <> event_type) AS runs FROM r GROUP BY user_id
""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, different lines and runs of equal lines, with events as lines."""
    return analytics.line_counts(read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS g, l_partkey % 40 AS i FROM lineitem WHERE l_quantity >= 45), p AS (SELECT DISTINCT a.g AS a, b.g AS b FROM s a JOIN s b ON b.g = a.g + 1 OR b.g = a.g),
n AS (SELECT g, count(*) AS size FROM s GROUP BY g), c AS (SELECT p.a, p.b, count(*) AS shared FROM p JOIN s x ON x.g = p.a JOIN s y ON y.g = p.b AND x.i = y.i GROUP BY ALL)
SELECT p.a, p.b, coalesce(shared, 0) = 0 AS disjoint, coalesce(shared, 0) = size AS subset FROM p LEFT JOIN c ON c.a = p.a AND c.b = p.b JOIN n ON n.g = p.a
""")
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sets of parts of neighbouring suppliers are disjoint or within one another."""
    own = read_table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 40).alias("i")).distinct()
    groups = own.select("g").distinct()
    pairs = groups.select(F.col("g").alias("a"), F.explode(F.array("g", F.col("g") + 1)).alias("b")).join(groups.withColumnRenamed("g", "b"), "b", "left_semi")
    return edits.set_relations(own, pairs, "g", "i")


@query("SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier ' || s_suppkey FROM supplier")
def merge_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two tables that share no key; a shared key would be an error."""
    a = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("supplier "), "s_suppkey").alias("name"))
    return edits.merged(a, b, ["id"])


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS is_known FROM customer")
def split_by_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return edits.split_by(read_table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query(f"""
WITH {_LINES}, c AS (SELECT path, digest, ordinal FROM n WHERE side = 1)
SELECT a.path, a.digest, a.ordinal FROM (SELECT * FROM n WHERE side = 0) a WHERE EXISTS (SELECT 1 FROM c WHERE c.path = a.path AND c.digest = a.digest AND c.ordinal = a.ordinal)
""")
def hash_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the old version that the hashes of the new one find again."""
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.floor(F.col("doc_id") / 2).alias("path"), "text")
    old, new = (edits.numbered_lines(docs.where(F.col("side") == s), "path", "text") for s in (0, 1))
    return edits.located(old, new, ["path", "digest", "ordinal"]).select("path", "digest", "ordinal")


# --- method names, call graphs and text sinks ----------------------------------


@query("""
WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '<init>' WHEN 1 THEN 'println' WHEN 2 THEN 'get' || p_brand WHEN 3 THEN 'set' || p_brand WHEN 4 THEN 'getter' ELSE lower(p_brand) END AS name, p_size % 2 AS n FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'constructor' WHEN 1 THEN 'no_effect' WHEN 2 THEN CASE WHEN n = 0 THEN 'getter' ELSE 'unknown' END WHEN 3 THEN CASE WHEN n = 1 THEN 'setter' ELSE 'unknown' END ELSE 'unknown' END AS kind FROM r
""")
def library_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read_table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    name = F.when(k == 0, "<init>").when(k == 1, "println").when(k == 2, F.concat(F.lit("get"), "p_brand")).when(k == 3, F.concat(F.lit("set"), "p_brand")).when(k == 4, "getter").otherwise(F.lower("p_brand"))
    return part.select("p_partkey", facts.library_kind(name, F.col("p_size") % 2).alias("kind"))


@query("""
SELECT c_custkey, c_custkey % 4 = 0 AND c_nationkey = 3 AND c_mktsegment = 'BUILDING' AS is_entry, CASE WHEN c_custkey % 4 = 0 THEN 'main' ELSE 'run' END AS method_name FROM customer WHERE c_custkey % 5 <> 0
""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a query file, empty ones and comments among them, and which ids are entry points."""
    c = read_table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, "main").otherwise("run")
    line = F.concat(F.lit("  com."), F.lower("c_mktsegment"), F.lit(".Nation"), F.col("c_nationkey"), F.lit("#"), name, F.lit("(String[])"))
    lines = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "").when(F.col("c_custkey") % 5 == 0, "# none").otherwise(F.concat(line, F.lit(" "))).alias("value"))
    ids = facts.query_ids(lines.select("value")).dropDuplicates(["text"])
    keyed = lines.withColumn("text", F.trim("value")).join(ids, "text")
    return keyed.select("c_custkey", facts.is_entry_point(F.col("method"), "Nation3", ["com", "building"]).alias("is_entry"), "method.method_name")


@query("SELECT DISTINCT o_orderpriority AS file, 'com.C' || o_custkey || '#m()' AS caller, 'com.O' || o_orderstatus || '#n(int)' AS callee FROM orders")
def call_graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call graphs written as text and read again, a file for each priority."""
    orders = read_table(spark, sf_dir, "orders")
    calls = orders.select(F.col("o_orderpriority").alias("file"), F.concat(F.lit("com.C"), "o_custkey", F.lit("#m()")).alias("caller"), F.concat(F.lit("com.O"), "o_orderstatus", F.lit("#n(int)")).alias("callee")).distinct()
    lines = calls.groupBy("file", "caller").agg(F.sort_array(F.collect_set("callee")).alias("callees")).select("file", "caller", F.posexplode(F.concat(F.array(F.concat(F.lit("CALLER: "), "caller")), F.transform("callees", lambda c: F.concat(F.lit("\tCALLEE: "), c)))).alias("k", "value"))
    return facts.call_graph(lines.select("file", F.col("caller").alias("at"), "k", "value"), ["at", "k"], ["file"])


@query("""
WITH a AS (SELECT c_custkey AS m, c_nationkey AS h, c_mktsegment AS b FROM customer WHERE c_custkey % 3 <> 0), z AS (SELECT c_custkey AS m, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS h, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 4 <> 0),
e AS (SELECT coalesce(a.m, z.m) AS method, CASE WHEN a.m IS NULL THEN 'add_function' WHEN z.m IS NULL THEN 'delete_function' WHEN a.h <> z.h THEN 'modify_header' WHEN a.b <> z.b THEN 'modify_function' END AS edit FROM a FULL OUTER JOIN z ON a.m = z.m)
SELECT method, edit FROM e WHERE edit IS NOT NULL
""")
def method_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods added, deleted and changed between two versions, with customers as methods."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("method"), F.col("c_nationkey").alias("header"), F.col("c_mktsegment").alias("body"))
    later = c.where("method % 4 <> 0").select("method", F.when(F.col("method") % 7 == 0, -1).otherwise(F.col("header")).alias("header"), F.when(F.col("method") % 5 == 0, "x").otherwise(F.col("body")).alias("body"))
    return edits.method_changes(c.where("method % 3 <> 0"), later)


@query(f"""
WITH RECURSIVE {_PARENTS}, own AS (SELECT 'customer ' || c_custkey AS id, c_mktsegment AS f FROM customer UNION SELECT 'nation ' || n_nationkey, n_name FROM nation UNION SELECT 'region ' || r_regionkey, r_name FROM region),
r AS (SELECT id AS a, id AS b FROM own UNION SELECT r.a, edges.dst FROM r JOIN edges ON edges.src = r.b)
SELECT DISTINCT a AS class_id, f AS name FROM r JOIN own ON own.id = r.b
""")
def inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited names along customer, nation and region."""
    own = graph.rows_of(read_table(spark, sf_dir, t).select(F.concat(F.lit(f"{a} "), F.col(k)).alias("class_id"), F.col(f).alias("name")) for t, a, k, f in (("customer", "customer", "c_custkey", "c_mktsegment"), ("nation", "nation", "n_nationkey", "n_name"), ("region", "region", "r_regionkey", "r_name")))
    tree = parents(spark, sf_dir, False).where("NOT startswith(src, 'supplier')").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return graph.inherited(tree, own)


@query("SELECT event_id, printf('%.3f', round(value, 2)) AS line FROM events")
def latency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.latency_lines(read_table(spark, sf_dir, "events").select("event_id", F.round("value", 2).alias("ms"))).select("event_id", "line")


@query(f"""
WITH {_TRADE}, n AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges)
SELECT 0 AS rank, 'digraph "calls" {{' AS line UNION ALL SELECT 1, '  "' || v || '" [label="' || v || '"];' FROM n UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '" [label=""];' FROM edges UNION ALL SELECT 3, '}}'
""")
def call_graph_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph as DOT lines."""
    return sinks.call_graph_dot(trade(spark, sf_dir).select(F.col("src").cast("string").alias("caller"), F.col("dst").cast("string").alias("callee"))).select("rank", "line")


@query("""
WITH r AS (SELECT event_id, event_type AS a, lag(event_type) OVER w AS b, lag(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, '' AS k0, a AS k1, concat_ws('<', a, b) AS k2, concat_ws('<', a, b) AS k2_of_3 FROM r
""")
def call_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context keys of depth 0, 1 and 2, with a user's events as call sites."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.array_compact(F.array(F.lag("event_type").over(order), F.lag("event_type", 2).over(order)))
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("site"), before.alias("caller"))
    key = lambda k: F.array_join(context.call_string(F.col("site"), F.col("caller"), k), "<")
    longer = context.call_string(F.col("site"), context.call_string(F.element_at("caller", 1), F.array_remove(F.slice("caller", 2, 1), ""), 2), 2)
    return rows.select("event_id", key(0).alias("k0"), key(1).alias("k1"), key(2).alias("k2"), F.array_join(F.when(F.size("caller") > 0, longer).otherwise(F.array("site")), "<").alias("k2_of_3"))
