"""Queries of relational domains, calls and heaps over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.functions import interval
from conefix.functions.interval import Itv
from conefix.operators import calls, octagons
from conefix.queries import finite, query
from conefix.session import Scratch, read_table

# --- octagons ----------------------------------------------------------------------

_SIGNED = "v AS (SELECT l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS DOUBLE) AS x, CAST(round(l_discount * 100) AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) AS z FROM lineitem)"
_V = ["x", "-x", "y", "-y", "z", "-z"]
_CELLS = " UNION ALL ".join(f"SELECT f, s, {i} AS i, {j} AS j, max(({a}) - ({b})) AS c FROM v GROUP BY f, s" for i, a in enumerate(_V) for j, b in enumerate(_V) if i != j)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.col("l_linenumber").alias("z"))
    return octagons.from_points(rows, ["f", "s"], ["x", "y", "z"])


@query(f"""
WITH {_SIGNED}, o AS ({_CELLS}), m AS (SELECT f, count(DISTINCT s) AS n FROM o GROUP BY f)
SELECT o.f, i, j, max(c) AS c FROM o JOIN m USING (f) GROUP BY o.f, i, j, n HAVING count(*) = n
""")
def octagon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on sums and differences of quantity, discount and line number, joined over line states."""
    return octagons.join_all(_points(spark, sf_dir), ["f"], "s")


_TIGHT = "c AS (SELECT f, s, i, j, min(c) AS c FROM (SELECT * FROM o UNION ALL SELECT DISTINCT f, s, 0, 2, -3.0 FROM o UNION ALL SELECT DISTINCT f, s, 3, 1, -3.0 FROM o UNION ALL SELECT DISTINCT f, s, 0, 1, 2 * CASE WHEN f = 'A' THEN 2.0 ELSE 9.0 END FROM o) GROUP BY ALL)"
_SQUARED = "".join(
    f", p{k + 1} AS MATERIALIZED (SELECT f, s, i, j, min(c) AS c FROM (SELECT * FROM p{k} UNION ALL SELECT a.f, a.s, a.i, b.j, a.c + b.c FROM p{k} a JOIN p{k} b ON a.f = b.f AND a.s = b.s AND a.j = b.i) GROUP BY ALL)" for k in range(4)
)


@query(f"""
WITH {_SIGNED}, o AS ({_CELLS}), {_TIGHT}, p0 AS (SELECT * FROM c){_SQUARED}, e AS (SELECT DISTINCT f, s FROM p4 WHERE i = j AND c < 0), u AS (SELECT f, s, i, j, c FROM p4 WHERE j = i + 1 - 2 * (i % 2)),
t AS (SELECT f, s, i, j, min(c) AS c FROM (SELECT * FROM p4 WHERE i <> j UNION ALL SELECT a.f, a.s, a.i, b.j, (a.c + b.c) / 2 FROM u a JOIN u b ON a.f = b.f AND a.s = b.s AND a.i <> b.j) GROUP BY ALL)
SELECT k.f, k.s, e.f IS NOT NULL AS empty, CASE WHEN e.f IS NULL THEN -min(c) FILTER (i = 1 AND j = 0) / 2 END AS x_lo, CASE WHEN e.f IS NULL THEN min(c) FILTER (i = 0 AND j = 1) / 2 END AS x_hi,
  CASE WHEN e.f IS NULL THEN -min(c) FILTER (i = 3 AND j = 2) / 2 END AS y_lo, CASE WHEN e.f IS NULL THEN min(c) FILTER (i = 2 AND j = 3) / 2 END AS y_hi,
  CASE WHEN e.f IS NULL THEN -min(c) FILTER (i = 1 AND j = 2) END AS sum_lo, CASE WHEN e.f IS NULL THEN min(c) FILTER (i = 0 AND j = 3) END AS sum_hi
FROM (SELECT DISTINCT f, s FROM o) k LEFT JOIN e ON e.f = k.f AND e.s = k.s LEFT JOIN t ON t.f = k.f AND t.s = k.s GROUP BY k.f, k.s, e.f
""")
def octagon_assume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The octagons where quantity is at least 3 below discount, and below 2 or 9: which are empty, and what the others bound."""
    by = ["f", "s"]
    held = Scratch(spark, "octagon-assume").save(_points(spark, sf_dir), "points")
    entries = F.concat(octagons.assumed(0, 1, F.lit(-3.0), 1, -1), octagons.assumed(0, 1, F.when(F.col("f") == "A", 2.0).otherwise(9.0)))
    tight = octagons.closed(octagons.meet(held, held.select(*by).distinct().select(*by, F.inline(entries)), by), by)
    tight = Scratch(spark, "octagon-assume").save(tight, "closed")
    out = octagons.is_empty(tight, by)
    for name, args in {"x": (0,), "y": (1,), "sum": (0, 1)}.items():
        found = octagons.bounds(tight, by, *args).select(*by, F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
        out = out.join(found, by)
    full = [c for c in out.columns if c.endswith(("_lo", "_hi"))]
    return out.withColumns({c: F.when(~F.col("empty"), F.col(c)) for c in full})


@query(f"""
WITH {_SIGNED}, o AS ({_CELLS}), a AS (SELECT f, i, j, c FROM o WHERE s = 'O'), b AS (SELECT f, i, j, c FROM o WHERE s = 'F')
SELECT a.f, a.i, a.j, a.c FROM a JOIN b ON a.f = b.f AND a.i = b.i AND a.j = b.j WHERE b.c <= a.c
""")
def octagon_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of open lines that those of finished ones keep."""
    held = Scratch(spark, "octagon-widen").save(_points(spark, sf_dir), "points")
    side = lambda s: held.where(F.col("s") == s).drop("s")
    return octagons.widen(side("O"), side("F"), ["f"])


@query(f"""
WITH {_SIGNED}, o AS ({_CELLS}), a AS (SELECT f, i, j, max(c) AS c FROM o GROUP BY f, i, j), p AS (SELECT x.f AS f, y.f AS g FROM (SELECT DISTINCT f FROM a) x, (SELECT DISTINCT f FROM a) y)
SELECT p.f, p.g, bool_and(coalesce(l.c <= r.c, false)) AS implies FROM p JOIN a r ON r.f = p.g LEFT JOIN a l ON l.f = p.f AND l.i = r.i AND l.j = r.j GROUP BY p.f, p.g
""")
def octagon_implies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the octagon of one return flag lies within that of another."""
    own = Scratch(spark, "octagon-implies").save(_points(spark, sf_dir).groupBy("f", "i", "j").agg(F.max("c").alias("c")), "joined")
    flags = own.select("f").distinct()  # the values of a flag
    pairs = flags.select("f", F.lit(1).alias("k")).join(flags.select(F.col("f").alias("g"), F.lit(1).alias("k")), "k").drop("k")
    left = pairs.join(own, "f")
    right = pairs.join(own.withColumnRenamed("f", "g"), "g")
    return octagons.implies(left, right, ["f", "g"])


# --- calls -------------------------------------------------------------------------

_CALLS = """
links AS (SELECT o_orderkey AS site, c_nationkey AS callee FROM orders JOIN customer ON o_custkey = c_custkey),
actuals AS (SELECT l_orderkey AS site, l_linenumber - 1 AS pos, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem),
formals AS (SELECT n_nationkey AS callee, k AS pos, 'p' || k AS name, k = n_nationkey % 4 AND n_nationkey % 3 = 0 AS rest FROM nation, range(n_nationkey % 4 + 1) t(k))
"""


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("c_custkey")).join(read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("callee")), "c_custkey").select("site", "callee")
    actuals = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_linenumber")).alias("hi"))
    n = F.col("n_nationkey")
    formals = read_table(spark, sf_dir, "nation").select(n.alias("callee"), F.explode(F.sequence(F.lit(0), (n % 4).cast("int"))).alias("pos"), n.alias("n")).select("callee", "pos", F.concat(F.lit("p"), "pos").alias("name"), ((F.col("pos") == F.col("n") % 4) & (F.col("n") % 3 == 0)).alias("rest"))
    return links, actuals, formals


@query(f"""
WITH {_CALLS}, t AS (SELECT l.site, l.callee, f.name, f.pos AS start, a.pos, a.lo, a.hi FROM links l JOIN formals f ON f.callee = l.callee AND rest LEFT JOIN actuals a ON a.site = l.site AND a.pos >= f.pos)
SELECT l.site, l.callee, f.name AS var, a.lo, a.hi FROM links l JOIN formals f ON f.callee = l.callee AND NOT rest JOIN actuals a ON a.site = l.site AND a.pos = f.pos
UNION ALL SELECT site, callee, name || '[' || (pos - start) || ']', lo, hi FROM t WHERE pos IS NOT NULL
UNION ALL SELECT site, callee, name || '.#', CAST(count(pos) AS DOUBLE), CAST(count(pos) AS DOUBLE) FROM t GROUP BY site, callee, name
""")
def calls_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as call sites with their lines as arguments, nations as procedures of up to four parameters, some with a variable last one."""
    return calls.bind(*_calls(spark, sf_dir))


@query(f"""
WITH {_CALLS}, sites AS (SELECT o_custkey AS site, o_orderkey % 25 AS callee FROM orders GROUP BY ALL), exits AS (SELECT c_nationkey AS callee, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_nationkey % 7 <> 0 GROUP BY c_nationkey)
SELECT site, CASE WHEN count(*) = count(e.callee) THEN min(lo) END AS lo, CASE WHEN count(*) = count(e.callee) THEN max(hi) END AS hi FROM sites LEFT JOIN exits e USING (callee) GROUP BY site
""")
def calls_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites that call several nations: the join of their exit states, open where one has none."""
    links = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 25).alias("callee")).distinct()
    exits = read_table(spark, sf_dir, "customer").where("c_nationkey % 7 != 0").groupBy(F.col("c_nationkey").cast("long").alias("callee")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return calls.returned(links, exits)


@query("""
WITH heap AS (SELECT l_suppkey AS address, l_returnflag AS field, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL),
pt AS (SELECT DISTINCT p_brand || p_size AS var, s_suppkey AS address FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 48),
w AS (SELECT p_brand || p_size AS var, l_returnflag AS field, min(l_quantity) - 100 AS lo, max(l_quantity) - 90 AS hi FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49 GROUP BY ALL),
n AS (SELECT var, count(*) = 1 AS sure FROM pt GROUP BY var),
r AS (SELECT address, field, min(lo) AS lo, max(hi) AS hi, bool_or(sure) AS sure FROM w JOIN n USING (var) JOIN pt USING (var) GROUP BY address, field)
SELECT coalesce(h.address, r.address) AS address, coalesce(h.field, r.field) AS field, CASE WHEN r.sure THEN r.lo ELSE least(h.lo, r.lo) END AS lo, CASE WHEN r.sure THEN r.hi ELSE greatest(h.hi, r.hi) END AS hi FROM heap h FULL OUTER JOIN r ON r.address = h.address AND r.field = h.field
""")
def alias_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes through variables that point to one supplier or to several: the former overwrite, the latter are joined."""
    items = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_linenumber")
    heap = items.where("l_linenumber < 3").groupBy(F.col("l_suppkey").alias("address"), F.col("l_returnflag").alias("field")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    named = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", "p_size").alias("var"))
    held = items.where("l_quantity > 48").join(named, "l_partkey")
    points_to = held.select("var", F.col("l_suppkey").alias("address")).distinct()
    writes = held.where("l_quantity > 49").groupBy("var", F.col("l_returnflag").alias("field")).agg((F.min("l_quantity") - 100).alias("lo"), (F.max("l_quantity") - 90).alias("hi"))
    return calls.store(heap, points_to, writes)


# --- logic -------------------------------------------------------------------------


@query("""
WITH s AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part GROUP BY p_brand),
t AS (SELECT *, CASE WHEN b < 40 THEN 1 ELSE 0 END AS l1, CASE WHEN a >= 40 THEN 0 ELSE 1 END AS h1, CASE WHEN c > 1000 THEN 1 ELSE 0 END AS l2, CASE WHEN d <= 1000 THEN 0 ELSE 1 END AS h2 FROM s)
SELECT p_brand, CAST(least(l1, l2) AS DOUBLE) AS and_lo, CAST(least(h1, h2) AS DOUBLE) AS and_hi, CAST(greatest(l1, l2) AS DOUBLE) AS or_lo, CAST(greatest(h1, h2) AS DOUBLE) AS or_hi, CAST(1 - h1 AS DOUBLE) AS not_lo, CAST(1 - l1 AS DOUBLE) AS not_hi,
  0.0::DOUBLE AS mask_lo, CAST(least(b, 12) AS DOUBLE) AS mask_hi, CAST(greatest(a, 3) AS DOUBLE) AS set_lo, CAST(b + 12 AS DOUBLE) AS set_hi FROM t
""")
def itv_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And, or, not of comparisons, and of the bits of whole numbers."""
    own = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("a"), F.max("p_size").cast("double").alias("b"), F.min("p_retailprice").alias("c"), F.max("p_retailprice").alias("d"))
    size, price = Itv.of("a", "b"), Itv.of("c", "d")
    small, dear = interval.truth(size.compare("<", Itv.of(40.0))), interval.truth(price.compare(">", Itv.of(1000.0)))
    found = {"and": interval.both(small, dear), "or": interval.either(small, dear), "not": interval.negated(small), "mask": interval.bitwise_and(size, Itv.of(3.0, 12.0)), "set": interval.bitwise_or(size, Itv.of(3.0, 12.0))}
    return own.select("p_brand", *(c.alias(f"{n}_{e}") for n, v in found.items() for e, c in (("lo", finite(v.lo)), ("hi", finite(v.hi)))))


@query("""
SELECT p_partkey, CASE p_partkey % 9 WHEN 8 THEN NULL WHEN 7 THEN CAST(ascii(substr(p_brand, 1, 1)) AS DOUBLE) WHEN 6 THEN CAST(p_size % 2 AS DOUBLE) WHEN 5 THEN p_size * 100.0 WHEN 4 THEN p_size + 0.5 ELSE CAST(p_size AS DOUBLE) END AS value FROM part
""")
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written as literals of all kinds, and their numbers."""
    k, n = F.col("p_partkey") % 9, F.col("p_size")
    text = (
        F.when(k == 0, n.cast("string")).when(k == 1, F.concat(F.lit("0x"), F.hex(n.cast("long")), F.lit("L"))).when(k == 2, F.concat(F.lit("0b0_"), F.bin(n.cast("long")))).when(k == 3, F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8)))
        .when(k == 4, F.concat(n.cast("string"), F.lit(".5f"))).when(k == 5, F.concat(n.cast("string"), F.lit("e2"))).when(k == 6, F.when(n % 2 == 1, "true").otherwise("false")).when(k == 7, F.concat(F.lit("'"), F.substring("p_brand", 1, 1), F.lit("'"))).otherwise(F.lit('"text"'))
    )
    return read_table(spark, sf_dir, "part").select("p_partkey", interval.literal(text).alias("value"))
