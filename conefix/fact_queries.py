"""Queries of the scans, sinks and small lattices over the driver's tables, each with its SQL twin.

Scans and sinks write their text to the shared folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.functions import nullness
from conefix.functions.interval import Itv
from conefix.operators import analytics, states
from conefix.queries import _STEPS, query, steps
from conefix.session import Scratch, read_table
from conefix.sources import facts, sinks

# --- scans -------------------------------------------------------------------------


@query("""
SELECT event_type, user_id % 20 AS program, CAST(row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) - 1 AS BIGINT) AS edit_no, value AS ms FROM events
""")
def latency_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of one number a line, a file for each program and mode, written and read in the order of their lines."""
    path = f"{Scratch(spark, 'logs').root}/logs"
    log = read_table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("program"), "ts", "event_id", F.col("value").cast("string").alias("line"))
    log.repartition("event_type", "program").sortWithinPartitions("event_type", "program", "ts", "event_id").select("event_type", "program", "line").write.partitionBy("event_type", "program").text(path)
    read = facts.latency_log(spark, path)
    part = lambda name: F.regexp_extract("path", name + r"=([^/]+)", 1)
    return read.select(part("event_type").alias("event_type"), part("program").cast("long").alias("program"), "edit_no", "ms")


@query("""
WITH g AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS s FROM events GROUP BY user_id, event_type), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC) AS r FROM g)
SELECT user_id, string_agg(n || ',' || s, ',' ORDER BY event_type) AS numbers FROM t WHERE r <= 3 GROUP BY user_id
""")
def stats_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the last three statistics of each experiment's log, lines of summaries between them."""
    totals = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("long").alias("s"))
    line = F.concat(F.lit("[STATS] "), F.col("n"), F.lit(" edits, "), F.col("s"), F.lit(" ms\n9 SUMMARIES kept\n"))
    logs = totals.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", line.alias("line")))), lambda r: r["line"]), "").alias("text"))
    found = facts.stats_lines(logs.select(F.col("user_id").alias("path"), "text"))
    return found.select(F.col("path").alias("user_id"), F.array_join("values", ",").alias("numbers"))


@query("SELECT 'com.' || lower(c_mktsegment) || '.Nation' || c_nationkey AS name, count(*) AS value FROM customer GROUP BY ALL")
def side_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of programs, written as lines ``name : number`` below a header and read back."""
    path = f"{Scratch(spark, 'sides').root}/sides"
    sizes = read_table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("com."), F.lower("c_mktsegment"), F.lit(".Nation"), "c_nationkey").alias("name")).agg(F.count("*").alias("n"))
    lines = sizes.select(F.explode(F.array(F.lit("program : size"), F.concat(F.lit("  "), "name", F.lit(" : "), "n"))).alias("value"))
    lines.write.text(path)
    return facts.side_file(spark, path)


# --- sinks -------------------------------------------------------------------------


def _written(lines: DataFrame, order: list[str], name: str) -> DataFrame:
    """Lines as they stand in the files that the sink has written."""
    spark = lines.sparkSession
    path = f"{Scratch(spark, name).root}/{name}"
    sinks.write_lines(lines, order, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""
WITH {_STEPS}, n AS (SELECT user_id, src AS v FROM e UNION SELECT user_id, dst FROM e)
SELECT 'digraph "' || user_id || '" {{' AS line FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT '  "' || v || '" [label="' || v || '"];' FROM n
UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="' || CASE WHEN src = dst THEN 'again' ELSE 'goes' END || '"];' FROM e UNION ALL SELECT '}}' FROM (SELECT DISTINCT user_id FROM e)
""")
def flow_graphs_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's transitions as a drawn control-flow graph."""
    kind = F.when(F.col("src") == F.col("dst"), "again").otherwise("goes")
    edges = steps(spark, sf_dir).select(F.col("user_id").cast("string").alias("fn"), "src", "dst", F.concat(F.lit('{"k": "'), kind, F.lit('"}')).alias("stmt"))
    return _written(sinks.cfg_dot(edges), ["graph", "rank", "line"], "flow-graphs")


@query(f"""
WITH {_STEPS}, v AS (SELECT user_id, event_type AS loc, CAST(CAST(min(floor(value)) AS BIGINT) AS VARCHAR) || '..' || CAST(CAST(max(floor(value)) AS BIGINT) AS VARCHAR) AS state FROM events WHERE value > 20 GROUP BY ALL),
n AS (SELECT user_id, src AS loc FROM e UNION SELECT user_id, dst FROM e), c AS (SELECT DISTINCT user_id FROM v), i AS (SELECT DISTINCT e.user_id FROM e JOIN c USING (user_id))
SELECT 'digraph "events ' || user_id || ' all" {{' AS line FROM i
UNION ALL SELECT '  "' || n.loc || '" [label="' || n.loc || CASE WHEN state IS NULL THEN '' ELSE ': ' || state END || '", fillcolor="' || CASE WHEN state IS NULL THEN 'white' ELSE 'palegreen' END || '", style=filled];' FROM n JOIN i USING (user_id) LEFT JOIN v ON v.user_id = n.user_id AND v.loc = n.loc
UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="step"];' FROM e JOIN i USING (user_id) UNION ALL SELECT '}}' FROM i
""")
def cells_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's transitions with the states of event types; types without a value above 20 are empty cells."""
    bound = lambda f: F.format_string("%d", f(F.floor("value")).cast("long"))
    held = read_table(spark, sf_dir, "events").where("value > 20").groupBy("user_id", F.col("event_type").alias("loc")).agg(F.concat(bound(F.min), F.lit(".."), bound(F.max)).alias("state"))
    name = F.col("user_id").cast("string")
    cells = held.select(F.lit("events").alias("program"), name.alias("fn"), F.lit("all").alias("ctx"), "loc", "state")
    edges = steps(spark, sf_dir).select(F.lit("events").alias("program"), name.alias("fn"), "src", "dst", F.lit('{"k": "step"}').alias("stmt"))
    # Contexts of one name in several functions are told apart by the function.
    keyed = cells.withColumn("program", F.concat_ws(" ", "program", "fn")).withColumn("fn", F.lit(""))
    arrows = edges.withColumn("program", F.concat_ws(" ", "program", "fn")).withColumn("fn", F.lit(""))
    lines = sinks.cells_dot(keyed, arrows).withColumn("line", F.regexp_replace("line", '^digraph "(.*?)  all"', 'digraph "$1 all"'))
    return _written(lines, ["graph", "rank", "line"], "cells")


@query("""
SELECT '{' || v || '} ' || event_type || ' {user=' || user_id || '}' AS line FROM (SELECT event_type, user_id, 'value=' || CAST(CAST(floor(max(value)) AS BIGINT) AS VARCHAR) || ' at ' || user_id AS v FROM events GROUP BY event_type, user_id) ORDER BY user_id % 20, event_type, v LIMIT 100
""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred summaries, as the printer shows them."""
    top = read_table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.floor(F.max("value")).cast("long").alias("v"))
    cells = top.select((F.col("user_id") % 20).alias("program"), F.col("event_type").alias("fn"), F.format_string("value=%d at %d", "v", "user_id").alias("entry"), F.lit(1).alias("loc"), F.concat(F.lit("user="), "user_id").alias("state"))
    return sinks.summaries(cells, 100)


@query("""
WITH a AS (SELECT count(DISTINCT (o_orderpriority, o_custkey)) AS contexts, count(*) FILTER (WHERE o_orderstatus <> 'O') AS dependencies, count(DISTINCT (o_orderpriority, o_custkey % 50)) AS methods, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS filled,
  count(*) FILTER (WHERE o_orderstatus <> 'O' AND o_orderkey % 30 = o_custkey % 30) AS self_loops FROM orders)
SELECT a.*, (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)) * 3 AS cells FROM a
""")
def solved_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of solved tables, with orders as cells and dependencies, customers as contexts and every method of three locations."""
    o = read_table(spark, sf_dir, "orders")
    is_ask = F.col("o_orderstatus") != "O"
    ctx = F.col("o_custkey").cast("string")
    asked = F.when(F.col("o_orderkey") % 30 == F.col("o_custkey") % 30, ctx).otherwise(F.concat(ctx, F.lit("x")))
    solved = o.select(F.col("o_orderpriority").alias("program"), ctx.alias("ctx"), (F.col("o_custkey") % 50).alias("fn"), F.when(is_ask, "ask").otherwise("cell").alias("kind"), F.when(is_ask, F.concat(asked, F.lit("|site"))).alias("asked"), F.when(~is_ask & (F.col("o_totalprice") > 100000), "state").alias("state"))
    loops = F.array(*(F.lit(f'{{"src": {a}, "dst": {b}}}') for a, b in ((0, 1), (1, 2), (2, 0))))
    bodies = solved.select("program", "fn").distinct().withColumn("edges", loops)
    return sinks.stats(solved, bodies)


# --- lattices ----------------------------------------------------------------------


@query("""
WITH s AS (SELECT l_returnflag AS f, l_linestatus AS s, min(l_quantity) AS a, max(l_quantity) AS b, CAST(min(l_linenumber) AS DOUBLE) AS c, CAST(max(l_linenumber) AS DOUBLE) AS d FROM lineitem GROUP BY ALL)
SELECT f, s, a * pow(2, c) AS left_lo, b * pow(2, d) AS left_hi, a / pow(2, d) AS right_lo, b / pow(2, c) AS right_hi FROM s
""")
def itv_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [f(c).cast("double").alias(n) for c, a, b in (("l_quantity", "a", "b"), ("l_linenumber", "c", "d")) for f, n in ((F.min, a), (F.max, b))]
    own = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(*bounds)
    left, right = Itv.of("a", "b").shift_left(Itv.of("c", "d")), Itv.of("a", "b").shift_right(Itv.of("c", "d"))
    return own.select("f", "s", left.lo.alias("left_lo"), left.hi.alias("left_hi"), right.lo.alias("right_lo"), right.hi.alias("right_hi"))


@query("""
WITH m AS (SELECT d.source, d.lang, bit_or(CASE WHEN l.toxic IS NULL THEN 1 ELSE 2 END) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL)
SELECT source, lang, ['bottom', 'null', 'not null', 'unknown'][m + 1] AS state, m & 1 AS if_null, m & 2 AS if_not_null, (m & 2) <> 0 AS may_be_used, m = 2 AS safe FROM m
""")
def null_assumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether labels of a source and language may be null, what is left on either side of a test, and whether a use is safe."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    joined = rows.groupBy("source", "lang").agg(nullness.join_all(nullness.of(F.col("toxic"))).alias("m"))
    m = F.col("m")
    return joined.select("source", "lang", nullness.name(m).alias("state"), nullness.assume_null(m).alias("if_null"), nullness.assume_not_null(m).alias("if_not_null"), nullness.feasible(m).alias("may_be_used"), nullness.implies(m, F.lit(nullness.NOT_NULL)).alias("safe"))


@query("""
WITH s AS (SELECT n_regionkey AS r, c_nationkey AS n, c_mktsegment AS k, bit_or(CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END) AS m, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
p AS (SELECT DISTINCT a.n AS a, b.n AS b FROM s a JOIN s b USING (r))
SELECT p.a, p.b, bool_and(x.m IS NULL OR coalesce(x.m & ~y.m, x.m) = 0) AS implies FROM p LEFT JOIN s x ON x.n = p.a LEFT JOIN s y ON y.n = p.b AND y.k = x.k GROUP BY p.a, p.b
""")
def null_implies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a nation's state by segment implies that of another of its region; a key that the other does not have is bottom there."""
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r"))
    rows = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") < 0, nullness.NULL).otherwise(nullness.NOT_NULL).alias("mask")).join(nation, "c_nationkey")
    own = states.join_masks(rows, ["r", "c_nationkey"], "c_mktsegment")
    sides = own.select("r", "c_nationkey").distinct()
    pairs = sides.withColumnRenamed("c_nationkey", "a").join(sides.withColumnRenamed("c_nationkey", "b"), "r").select("a", "b")
    return states.implied_masks(own.select("c_nationkey", "c_mktsegment", "mask"), pairs, "c_nationkey", "c_mktsegment")


@query("SELECT p_type AS form, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_type")
def unsupported_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each form occurs among what is not supported, with types of large parts as forms."""
    return facts.form_counts(read_table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_type").alias("form")))


@query("""
WITH t AS (SELECT user_id, event_type, sum(value) AS total FROM events GROUP BY ALL), p AS (SELECT t.user_id, t.event_type, 100 * t.total / b.total AS x FROM t JOIN t b ON b.user_id = t.user_id AND b.event_type = 'view')
SELECT user_id, event_type, CASE WHEN x < 0.01 THEN '<0.01' WHEN x < 0.1 THEN '<0.1' ELSE 'shown' END AS cell FROM p WHERE x < 100000
""")
def percents_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of views as tables print them; digits are compared in the tests, as they are rounded differently elsewhere."""
    log = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    rows = analytics.percent_of(log, "user_id", "event_type", "view", "value").where("user_id IS NOT NULL AND percent < 100000")
    cell = analytics.shown_percent(F.col("percent"))
    return rows.select("user_id", "event_type", F.when(cell.startswith("<"), cell).otherwise("shown").alias("cell"))
