"""Queries of statement trees that the table of events spells out, each with its SQL twin.

Forty consecutive events of a user are a method: event i has the events 3i + 1 to 3i + 3 below it, as far as
they exist. What has others below it is a loop, a branch, a switch or a try by its type, the rest are
simple statements, and a break outside of a loop is an error that is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.operators import scans, statements
from conefix.queries import query
from conefix.session import Scratch, read_table

#: Events of a method.
SIZE = 40

_LOOPS = "('while', 'do', 'for', 'foreach')"
_TREE = f"""
k AS (SELECT user_id, event_type AS t, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
r AS (SELECT user_id || ':' || (k // {SIZE}) AS fn, k % {SIZE} AS i, t, v, count(*) OVER (PARTITION BY user_id, k // {SIZE}) AS n FROM k),
s AS MATERIALIZED (
  SELECT *, CASE
    WHEN 3 * i + 1 < n THEN CASE WHEN i = 0 THEN 'block' WHEN t = 'view' THEN 'while' WHEN t = 'click' THEN 'if' WHEN t = 'purchase' THEN 'try' WHEN t = 'signup' THEN 'switch' WHEN v % 3 = 0 THEN 'do' WHEN v % 3 = 1 THEN 'for' ELSE 'foreach' END
    WHEN t = 'view' THEN 'expr' WHEN t = 'click' THEN 'local' WHEN t = 'purchase' THEN CASE WHEN v % 5 = 0 THEN 'yield' ELSE 'return' END WHEN t = 'signup' THEN CASE WHEN v % 2 = 0 THEN 'continue' ELSE 'break' END
    WHEN v % 2 = 0 THEN 'throw' ELSE 'assert' END AS kind FROM r),
tree AS MATERIALIZED (
  SELECT s.fn, CAST(s.i AS VARCHAR) AS node, CASE WHEN s.i = 0 THEN NULL WHEN p.kind IN {_LOOPS} OR p.kind = 'if' AND (s.i - 1) % 3 > 0 THEN p.i || 'b' ELSE CAST(p.i AS VARCHAR) END AS parent,
    CASE WHEN p.kind = 'if' AND (s.i - 1) % 3 > 0 THEN (s.i - 1) % 3 - 1 WHEN s.i > 0 THEN (s.i - 1) % 3 ELSE 0 END AS ord,
    CASE p.kind WHEN 'if' THEN CASE WHEN (s.i - 1) % 3 = 0 THEN 'then' END WHEN 'switch' THEN CASE WHEN (s.i - 1) % 3 < 2 THEN 'case' ELSE 'default' END
      WHEN 'try' THEN CASE (s.i - 1) % 3 WHEN 0 THEN 'body' WHEN 1 THEN CASE WHEN p.v % 2 = 0 THEN 'catch_all' ELSE 'catch' END ELSE 'finally' END END AS role,
    s.kind, CASE WHEN s.kind = 'local' THEN 1 + s.v % 3 ELSE 1 END AS parts, s.kind = 'expr' AND s.v % 2 = 0 AS calls
  FROM s LEFT JOIN s p ON p.fn = s.fn AND s.i > 0 AND p.i = (s.i - 1) // 3
  UNION ALL SELECT fn, i || 'b', CAST(i AS VARCHAR), CASE WHEN kind = 'if' THEN 1 ELSE 0 END, CASE WHEN kind = 'if' THEN 'else' ELSE 'body' END, 'block', 1, false FROM s WHERE kind IN {_LOOPS} OR kind = 'if' AND 3 * i + 2 < n)
"""

_PLACED = f"""
links AS MATERIALIZED (SELECT c.fn, c.node, c.role, p.node AS above, p.kind, EXISTS (SELECT 1 FROM tree z WHERE z.fn = p.fn AND z.parent = p.node AND z.role = 'catch_all') AS everything FROM tree c JOIN tree p ON p.fn = c.fn AND p.node = c.parent),
ways AS (
  SELECT fn, node, CASE WHEN kind IN ('break', 'continue', 'return', 'throw') THEN kind ELSE 'throw' END AS way FROM tree WHERE kind IN ('break', 'continue', 'return', 'throw', 'foreach') OR calls
  UNION SELECT l.fn, l.above, w.way FROM ways w JOIN links l ON l.fn = w.fn AND l.node = w.node
    WHERE NOT coalesce(w.way = 'break' AND l.kind IN ('while', 'do', 'for', 'foreach', 'switch') OR w.way = 'continue' AND l.kind IN {_LOOPS} OR w.way = 'throw' AND l.everything AND l.role = 'body', false)),
leaving AS (SELECT DISTINCT l.fn, l.above AS node, w.way FROM ways w JOIN links l ON l.fn = w.fn AND l.node = w.node WHERE l.kind = 'try' AND l.role <> 'finally' AND NOT (w.way = 'throw' AND l.everything AND l.role = 'body')),
kids AS (SELECT fn, parent AS node, arg_min(node, ord) AS one, max(node) FILTER (role = 'then') AS yes, max(node) FILTER (role = 'else') AS no, max(node) FILTER (role = 'default') AS other, max(node) FILTER (role = 'finally') AS final, bool_or(coalesce(role, '') LIKE 'catch%') AS catches, bool_or(coalesce(role, '') = 'catch_all') AS everything FROM tree GROUP BY fn, parent),
nodes AS MATERIALIZED (
  SELECT t.*, f.node AS following, one, yes, no, other, final, coalesce(catches, false) AS catches, coalesce(everything, false) AS everything,
    EXISTS (SELECT 1 FROM leaving v WHERE v.fn = t.fn AND v.node = t.node AND v.way = 'return') AS u_ret, EXISTS (SELECT 1 FROM leaving v WHERE v.fn = t.fn AND v.node = t.node AND v.way = 'throw') AS u_thr,
    EXISTS (SELECT 1 FROM leaving v WHERE v.fn = t.fn AND v.node = t.node AND v.way = 'break') AS u_brk, EXISTS (SELECT 1 FROM leaving v WHERE v.fn = t.fn AND v.node = t.node AND v.way = 'continue') AS u_con
  FROM tree t LEFT JOIN tree f ON f.fn = t.fn AND f.parent = t.parent AND f.ord = t.ord + 1 LEFT JOIN kids ON kids.fn = t.fn AND kids.node = t.node),
placed AS (
  SELECT *, '' AS copy, 'in' AS spot, CAST(NULL AS VARCHAR) AS up, 'exit' AS nxt, 'exit' AS ret, 'throw' AS thr, CAST(NULL AS VARCHAR) AS brk, CAST(NULL AS VARCHAR) AS con FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT fn, node, parent, ord, role, kind, parts, calls, following, one, yes, no, other, final, catches, everything, u_ret, u_thr, u_brk, u_con, pcopy || way AS copy,
    CASE WHEN pkind = 'block' AND ord = 0 OR pkind = 'try' AND role = 'body' THEN pat ELSE node || pcopy || way END, CASE WHEN coalesce(role, '') LIKE 'catch%' THEN pnode || pcopy || '#d' ELSE pat END,
    CASE WHEN way = '/return' THEN pret WHEN way = '/throw' THEN pthr WHEN way = '/break' THEN pbrk WHEN way = '/continue' THEN pcon
      WHEN pkind IN ('block', 'switch') AND following IS NOT NULL THEN following || pcopy WHEN pkind = 'do' THEN pnode || pcopy || '#c' WHEN pkind IN ('while', 'for', 'foreach') THEN pnode || pcopy || '#l'
      WHEN guarded THEN pfinal || pcopy || '/next' ELSE pnxt END,
    CASE WHEN NOT guarded THEN pret WHEN p_ret THEN pfinal || pcopy || '/return' END,
    CASE WHEN pkind = 'try' AND role = 'body' AND pcatches THEN pnode || pcopy || '#d' WHEN NOT guarded THEN pthr WHEN p_thr THEN pfinal || pcopy || '/throw' END,
    CASE WHEN pkind IN ('while', 'do', 'for', 'foreach', 'switch') THEN pnxt WHEN NOT guarded THEN pbrk WHEN p_brk AND pbrk IS NOT NULL THEN pfinal || pcopy || '/break' END,
    CASE WHEN pkind = 'do' THEN pnode || pcopy || '#c' WHEN pkind IN {_LOOPS} THEN pnode || pcopy || '#l' WHEN NOT guarded THEN pcon WHEN p_con AND pcon IS NOT NULL THEN pfinal || pcopy || '/continue' END
  FROM (
    SELECT c.*, p.node AS pnode, p.kind AS pkind, p.final AS pfinal, p.catches AS pcatches, p.copy AS pcopy, p.spot AS pat, p.nxt AS pnxt, p.ret AS pret, p.thr AS pthr, p.brk AS pbrk, p.con AS pcon, p.u_ret AS p_ret, p.u_thr AS p_thr, p.u_brk AS p_brk, p.u_con AS p_con,
      p.kind = 'try' AND p.final IS NOT NULL AND c.role <> 'finally' IS TRUE AS guarded, p.kind = 'try' AND coalesce(c.role, '') = 'finally' AS closing, x.way
    FROM placed p JOIN nodes c ON c.fn = p.fn AND c.parent = p.node CROSS JOIN (VALUES (''), ('/next'), ('/return'), ('/throw'), ('/break'), ('/continue')) x(way))
  WHERE CASE way WHEN '' THEN NOT closing WHEN '/next' THEN closing WHEN '/return' THEN closing AND p_ret WHEN '/throw' THEN closing AND p_thr WHEN '/break' THEN closing AND p_brk AND pbrk IS NOT NULL ELSE closing AND p_con AND pcon IS NOT NULL END)
"""

_LOWERED = """
q AS MATERIALIZED (SELECT *, node || copy AS own FROM placed),
drawn AS MATERIALIZED (SELECT * FROM (
  SELECT fn, node, CASE WHEN j = 1 THEN spot ELSE own || '#' || j END AS src, CASE WHEN j = parts THEN nxt ELSE own || '#' || (j + 1) END AS dst, 'assign' AS op FROM q, range(1, 4) z(j) WHERE kind = 'local' AND j <= parts
  UNION ALL SELECT fn, node, spot, CASE kind WHEN 'return' THEN ret WHEN 'throw' THEN thr WHEN 'break' THEN brk WHEN 'continue' THEN con ELSE nxt END, CASE kind WHEN 'assert' THEN 'assume' WHEN 'break' THEN 'skip' WHEN 'continue' THEN 'skip' WHEN 'yield' THEN 'unsupported' ELSE kind END FROM q WHERE kind IN ('expr', 'assert', 'return', 'throw', 'break', 'continue', 'yield')
  UNION ALL SELECT fn, node, spot, thr, 'throws' FROM q WHERE calls OR kind = 'foreach'
  UNION ALL SELECT fn, node, spot, nxt, 'skip' FROM q WHERE kind = 'block' AND one IS NULL
  UNION ALL SELECT fn, node, spot, coalesce(yes || copy, nxt), 'assume' FROM q WHERE kind = 'if'
  UNION ALL SELECT fn, node, spot, coalesce(no || copy, nxt), 'refute' FROM q WHERE kind = 'if'
  UNION ALL SELECT fn, node, CASE kind WHEN 'while' THEN spot WHEN 'do' THEN own || '#c' WHEN 'for' THEN own || '#h' ELSE own || '#t' END, nxt, 'refute' FROM q WHERE kind IN ('while', 'do', 'for', 'foreach')
  UNION ALL SELECT fn, node, CASE kind WHEN 'while' THEN spot WHEN 'do' THEN own || '#c' WHEN 'for' THEN own || '#h' ELSE own || '#t' END, CASE kind WHEN 'do' THEN spot WHEN 'foreach' THEN own || '#b' ELSE one || copy END, 'assume' FROM q WHERE kind IN ('while', 'do', 'for', 'foreach')
  UNION ALL SELECT fn, node, spot, one || copy, 'skip' FROM q WHERE kind = 'do'
  UNION ALL SELECT fn, node, spot, own || '#h', CASE kind WHEN 'for' THEN 'init' ELSE 'iterator' END FROM q WHERE kind IN ('for', 'foreach')
  UNION ALL SELECT fn, node, own || '#h', own || '#t', 'has_next' FROM q WHERE kind = 'foreach'
  UNION ALL SELECT fn, node, own || '#b', one || copy, 'next' FROM q WHERE kind = 'foreach'
  UNION ALL SELECT fn, node, own || m, thr, 'throws' FROM q, (VALUES ('#h'), ('#b')) z(m) WHERE kind = 'foreach'
  UNION ALL SELECT fn, node, own || '#l', CASE kind WHEN 'while' THEN spot ELSE own || '#h' END, CASE kind WHEN 'for' THEN 'update' ELSE 'back' END FROM q WHERE kind IN ('while', 'for', 'foreach')
  UNION ALL SELECT fn, node, spot, nxt, 'default' FROM q WHERE kind = 'switch' AND other IS NULL
  UNION ALL SELECT fn, node, up, spot, CASE WHEN role LIKE 'catch%' THEN 'caught' ELSE role END FROM q WHERE role IN ('case', 'default', 'catch', 'catch_all')
  UNION ALL SELECT fn, node, own || '#d', CASE WHEN final IS NULL THEN thr WHEN u_thr THEN final || copy || '/throw' END, 'uncaught' FROM q WHERE kind = 'try' AND catches AND NOT everything
) WHERE dst IS NOT NULL),
turns AS (SELECT b.fn, b.src AS latch, b.dst AS head, count(*) AS n FROM drawn b JOIN drawn e ON e.fn = b.fn AND e.dst = b.src WHERE b.op = 'back' GROUP BY b.fn, b.src, b.dst)
"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement trees that the events of ``sf_dir`` spell out."""
    scratch = Scratch(spark, "trees", spread=True)
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("t"), F.floor("value").cast("long").alias("v"))
    k = scans.running_offset(events, ["user_id"], ["ts", "event_id"], F.lit(1), "k")
    rows = k.select(F.concat_ws(":", "user_id", F.floor(F.col("k") / SIZE).cast("string")).alias("fn"), (F.col("k") % SIZE).alias("i"), "t", "v")
    rows = scratch.save(rows, "rows")
    rows = rows.join(rows.groupBy("fn").agg(F.count("*").alias("n")), "fn")
    t, v, i = F.col("t"), F.col("v"), F.col("i")
    loop = F.when(v % 3 == 0, "do").when(v % 3 == 1, "for").otherwise("foreach")
    compound = F.when(i == 0, "block").when(t == "view", "while").when(t == "click", "if").when(t == "purchase", "try").when(t == "signup", "switch").otherwise(loop)
    simple = F.when(t == "view", "expr").when(t == "click", "local").when(t == "purchase", F.when(v % 5 == 0, "yield").otherwise("return")).when(t == "signup", F.when(v % 2 == 0, "continue").otherwise("break"))
    simple = F.coalesce(simple, F.when(v % 2 == 0, "throw").otherwise("assert"))
    rows = scratch.save(rows.withColumn("kind", F.when(3 * i + 1 < F.col("n"), compound).otherwise(simple)), "kinds")
    above = rows.select("fn", F.col("i").alias("p"), F.col("kind").alias("around"), F.col("v").alias("pv"))
    own = rows.withColumn("p", F.when(i > 0, F.floor((i - 1) / 3))).join(above, ["fn", "p"], "left")
    slot, around, p = F.when(i > 0, (i - 1) % 3).otherwise(0).cast("int"), F.col("around"), F.col("p").cast("string")
    later = (around == "if") & (slot > 0)
    role = F.when(around == "if", F.when(slot == 0, "then")).when(around == "switch", F.when(slot < 2, "case").otherwise("default"))
    role = role.when(around == "try", F.when(slot == 0, "body").when(slot == 2, "finally").when(F.col("pv") % 2 == 0, "catch_all").otherwise("catch"))
    none = F.lit(None).cast("string")
    given = own.select(
        "fn", i.cast("string").alias("node"), F.when(around.isin(*statements.LOOPS) | later, F.concat(p, F.lit("b"))).otherwise(p).alias("parent"), F.when(later, slot - 1).otherwise(slot).alias("ord"), role.alias("role"),
        "kind", none.alias("label"), none.alias("target"), F.when(F.col("kind") == "local", 1 + v % 3).otherwise(1).cast("int").alias("parts"), ((F.col("kind") == "expr") & (v % 2 == 0)).alias("calls"),
    )
    branch = F.col("kind") == "if"
    blocks = rows.where(F.col("kind").isin(*statements.LOOPS) | branch & (3 * i + 2 < F.col("n"))).select(
        "fn", F.concat(i.cast("string"), F.lit("b")).alias("node"), i.cast("string").alias("parent"), F.when(branch, 1).otherwise(0).alias("ord"), F.when(branch, "else").otherwise("body").alias("role"),
        F.lit("block").alias("kind"), none.alias("label"), none.alias("target"), F.lit(1).alias("parts"), F.lit(False).alias("calls"),
    )
    return scratch.save(given.unionByName(blocks), "trees")


@query(f"""
WITH RECURSIVE {_TREE}, {_PLACED}, {_LOWERED}
SELECT d.fn, d.src, coalesce(head, d.dst) AS dst, d.op, d.node FROM drawn d LEFT JOIN turns t ON t.fn = d.fn AND t.latch = d.dst AND t.n = 1 WHERE d.op <> 'back'
UNION ALL SELECT d.fn, d.src, d.dst, 'skip', d.node FROM drawn d JOIN turns t ON t.fn = d.fn AND t.latch = d.src WHERE d.op = 'back' AND t.n > 1
""")
def statements_lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-flow edges of the methods that the events spell out."""
    return statements.lower(trees(spark, sf_dir))[0]


@query(f"""
WITH RECURSIVE {_TREE}, {_PLACED}
SELECT DISTINCT fn, node, kind, CASE WHEN kind = 'yield' THEN 'unsupported' ELSE 'no target' END AS problem FROM placed WHERE kind = 'yield' OR kind = 'break' AND brk IS NULL OR kind = 'continue' AND con IS NULL
""")
def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps out of loops that are not there, and statements of an unknown kind."""
    return statements.lower(trees(spark, sf_dir))[1]
