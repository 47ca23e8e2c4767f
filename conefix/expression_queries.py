"""Queries of expressions that the table of events spells out, each with its SQL twin.

Sixteen consecutive events of a user are an expression: event i has the events 2i + 1 and 2i + 2 as its
children, as far as they exist; its form follows from its type and the number of children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.operators import expressions, scans
from conefix.queries import query
from conefix.session import Scratch, read_table

#: Events of an expression.
SIZE = 16

_TREE = f"""
k AS (SELECT user_id, event_type AS t, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
r AS (SELECT CAST(user_id AS VARCHAR) AS fn, CAST(k // {SIZE} AS VARCHAR) AS stmt, k % {SIZE} AS i, t, v, count(*) OVER (PARTITION BY user_id, k // {SIZE}) AS n FROM k),
f AS (SELECT *, CASE
    WHEN 2 * i + 2 < n THEN CASE t WHEN 'view' THEN 'binary' WHEN 'click' THEN 'assign' WHEN 'purchase' THEN 'call' WHEN 'signup' THEN 'comma' ELSE 'items' END
    WHEN 2 * i + 1 < n THEN CASE t WHEN 'view' THEN 'unary' WHEN 'click' THEN 'after' WHEN 'purchase' THEN 'cast' WHEN 'signup' THEN 'before' ELSE 'new' END
    WHEN v % 3 = 0 THEN 'literal' ELSE 'name' END AS raw FROM r),
g AS (SELECT c.*, CASE WHEN c.i % 2 = 1 AND p.raw IN ('assign', 'before', 'after') AND c.v % 50 > 0 THEN CASE WHEN 2 * c.i + 2 < c.n THEN 'cell' WHEN 2 * c.i + 1 < c.n THEN 'field' ELSE 'name' END ELSE c.raw END AS form FROM f c LEFT JOIN f p ON p.fn = c.fn AND p.stmt = c.stmt AND c.i > 0 AND p.i = (c.i - 1) // 2),
tree AS MATERIALIZED (SELECT fn, stmt, i, CASE WHEN i = 0 THEN NULL ELSE (i - 1) // 2 END AS parent, CASE WHEN i = 0 THEN 0 ELSE (i - 1) % 2 END AS ord, form, CASE
    WHEN form = 'literal' THEN CAST(v AS VARCHAR) WHEN form = 'name' THEN 'x' || (v % 5) WHEN form = 'binary' THEN CASE WHEN v % 2 = 0 THEN '+' ELSE '*' END WHEN form = 'unary' THEN '-' WHEN form IN ('call', 'new', 'cast', 'field') THEN t
    WHEN form = 'assign' THEN CASE v % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END WHEN form = 'before' THEN '-' WHEN form = 'after' THEN '+' END AS value FROM g)
"""

_ERRORS = "wrong AS (SELECT c.fn, c.stmt, c.i, c.form FROM tree c JOIN tree p ON p.fn = c.fn AND p.stmt = c.stmt AND p.i = c.parent WHERE c.ord = 0 AND p.form IN ('assign', 'before', 'after') AND c.form NOT IN ('name', 'field', 'cell'))"

_STEPS = f"""
{_ERRORS},
o AS (SELECT fn, stmt, i, parent, ord, form, value, [0] AS place, CAST([] AS BIGINT[]) AS above FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.fn, t.stmt, t.i, t.parent, t.ord, t.form, t.value, list_append(o.place, CAST(t.ord AS INTEGER)), list_append(o.above, t.parent) FROM tree t JOIN o ON o.fn = t.fn AND o.stmt = t.stmt AND o.i = t.parent),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fn, stmt ORDER BY list_append(place, 99)) AS k FROM o WHERE NOT EXISTS (SELECT 1 FROM wrong w WHERE w.fn = o.fn AND w.stmt = o.stmt)),
u AS (SELECT c.*, p.form AS around, p.value AS with_op, p.ord AS up_ord, p.parent AS beyond, b.form AS far FROM n c LEFT JOIN n p ON p.fn = c.fn AND p.stmt = c.stmt AND p.i = c.parent LEFT JOIN n b ON b.fn = p.fn AND b.stmt = p.stmt AND b.i = p.parent),
m AS MATERIALIZED (SELECT *, CASE
    WHEN form = 'literal' THEN false
    WHEN form <> 'name' THEN true
    WHEN around = 'assign' AND ord = 0 AND with_op IS NULL THEN false
    ELSE EXISTS (SELECT 1 FROM n z JOIN n e ON e.fn = z.fn AND e.stmt = z.stmt AND (e.i = z.i OR list_contains(e.above, z.i)) AND e.form IN ('assign', 'before', 'after')
      WHERE z.fn = u.fn AND z.stmt = u.stmt AND (z.parent = u.parent AND z.ord > u.ord OR far IN ('assign', 'before', 'after') AND up_ord = 0 AND z.parent = u.beyond AND z.ord > 0)) END AS own FROM u),
x AS MATERIALIZED (SELECT *, CASE WHEN own THEN '$' || k ELSE value END AS operand, '$' || k AS mine, coalesce(around = 'assign' AND ord = 0 AND with_op IS NULL, false) AS plain FROM m),
a AS (SELECT fn, stmt, parent AS i, string_agg(operand, ',' ORDER BY ord) AS args, arg_min(operand, ord) AS one, arg_max(operand, ord) AS two FROM x WHERE parent IS NOT NULL GROUP BY fn, stmt, parent),
y AS MATERIALIZED (SELECT x.*, a.args, a.one, a.two, t.form AS t_form, t.value AS t_value, b.args AS t_args FROM x LEFT JOIN a ON a.fn = x.fn AND a.stmt = x.stmt AND a.i = x.i
  LEFT JOIN x t ON t.fn = x.fn AND t.stmt = x.stmt AND t.parent = x.i AND t.ord = 0 AND x.form IN ('assign', 'before', 'after') LEFT JOIN a b ON b.fn = t.fn AND b.stmt = t.stmt AND b.i = t.i)
SELECT fn, stmt, k, 0 AS part, mine AS target, 'copy' AS form, CAST(NULL AS VARCHAR) AS value, value AS args FROM y WHERE form = 'name' AND own
UNION ALL SELECT fn, stmt, k, 0, mine, form, value, args FROM y WHERE form IN ('binary', 'unary', 'cast', 'call', 'new', 'field', 'cell', 'items') AND NOT plain
UNION ALL SELECT fn, stmt, k, 0, mine, 'copy', NULL, CASE WHEN form = 'after' THEN one ELSE two END FROM y WHERE form IN ('comma', 'after') OR form = 'assign' AND value IS NULL
UNION ALL SELECT fn, stmt, k, 0, mine, 'binary', value, one || ',' || CASE WHEN form = 'before' THEN '1' ELSE two END FROM y WHERE form = 'before' OR form = 'assign' AND value IS NOT NULL
UNION ALL SELECT fn, stmt, k, 1, mine || '+', 'binary', value, mine || ',1' FROM y WHERE form = 'after'
UNION ALL SELECT fn, stmt, k, CASE WHEN form = 'after' THEN 2 ELSE 1 END, CASE WHEN t_form = 'name' THEN t_value END, CASE WHEN t_form = 'name' THEN 'copy' ELSE 'store_' || t_form END, CASE WHEN t_form = 'field' THEN t_value END,
  CASE WHEN t_form = 'name' THEN '' ELSE t_args || ',' END || mine || CASE WHEN form = 'after' THEN '+' ELSE '' END FROM y WHERE form IN ('assign', 'before', 'after')
"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expressions that the events of ``sf_dir`` spell out; one target in fifty cannot be assigned to."""
    scratch = Scratch(spark, "expression-trees", spread=True)
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("t"), F.floor("value").cast("long").alias("v"))
    k = scans.running_offset(events, ["user_id"], ["ts", "event_id"], F.lit(1), "k")
    rows = scratch.save(k.select(F.col("user_id").cast("string").alias("fn"), F.floor(F.col("k") / SIZE).cast("string").alias("stmt"), (F.col("k") % SIZE).alias("i"), "t", "v"), "rows")
    t, v, i, n = F.col("t"), F.col("v"), F.col("i"), F.col("n")

    def by_type(view: str, click: str, purchase: str, signup: str, other: str) -> F.Column:
        return F.when(t == "view", view).when(t == "click", click).when(t == "purchase", purchase).when(t == "signup", signup).otherwise(other)

    two, one = 2 * i + 2 < n, 2 * i + 1 < n
    raw = F.when(two, by_type("binary", "assign", "call", "comma", "items")).when(one, by_type("unary", "after", "cast", "before", "new")).when(v % 3 == 0, "literal").otherwise("name")
    rows = scratch.save(rows.join(rows.groupBy("fn", "stmt").agg(F.count("*").alias("n")), ["fn", "stmt"]).withColumn("raw", raw), "forms")
    up = rows.select("fn", "stmt", F.col("i").alias("p"), F.col("raw").alias("around"))
    own = rows.withColumn("p", F.when(i > 0, F.floor((i - 1) / 2))).join(up, ["fn", "stmt", "p"], "left")
    target = (i % 2 == 1) & F.col("around").isin(*expressions.CHANGES) & (v % 50 > 0)
    own = own.withColumn("form", F.when(target, F.when(two, "cell").when(one, "field").otherwise("name")).otherwise(F.col("raw")))
    form, is_form = F.col("form"), lambda *names: F.col("form").isin(*names)
    value = F.when(form == "literal", v.cast("string")).when(form == "name", F.concat(F.lit("x"), (v % 5).cast("string"))).when(form == "binary", F.when(v % 2 == 0, "+").otherwise("*")).when(is_form("unary", "before"), "-")
    value = value.when(form == "after", "+").when(is_form("call", "new", "cast", "field"), t).when(form == "assign", F.when(v % 3 == 0, "+").when(v % 3 == 1, "-"))
    return scratch.save(own.select("fn", "stmt", i.cast("string").alias("node"), F.col("p").cast("string").alias("parent"), F.when(i > 0, (i - 1) % 2).otherwise(0).cast("int").alias("ord"), "form", value.alias("value")), "trees")


@query(f"WITH RECURSIVE {_TREE}, {_STEPS}")
def expressions_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the expressions that the events spell out."""
    steps, _ = expressions.flatten(trees(spark, sf_dir))
    return steps.withColumn("args", F.array_join("args", ","))


@query(f"WITH {_TREE}, {_ERRORS} SELECT fn, stmt, CAST(i AS VARCHAR) AS node, form, 'no target' AS problem FROM wrong")
def expression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of those expressions that are assigned to and cannot be."""
    return expressions.flatten(trees(spark, sf_dir))[1]
