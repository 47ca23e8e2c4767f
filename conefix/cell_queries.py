"""Queries over cell graphs of programs that the table of events spells out, each with its SQL twin.

Eight consecutive events of a user are a program. A view opens a loop that the next purchase
closes (two levels deep), an error breaks out of the loop around it, a signup may skip a click, and
values are added, set or compared. The twins run the same programs one location after the other
as a machine of its own, without cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conefix.operators import cells, dominators, graph_edits, interning, paths, ranges, scans, summaries
from conefix.queries import _STEPS, finite, query, steps
from conefix.session import Scratch, read_table, shuffled
from conefix.streaming import registry

#: Events of a program.
SIZE = 8

_PROGRAMS = f"""
k AS (SELECT user_id, event_type AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
r AS (SELECT user_id || ':' || (k // {SIZE}) AS fn, k % {SIZE} AS loc, t, v, lead(t) OVER (PARTITION BY user_id, k // {SIZE} ORDER BY k) AS following FROM k),
p1 AS (SELECT * FROM (SELECT fn, t, loc AS j, lead(t) OVER w AS u, lead(loc) OVER w AS e FROM r WHERE t IN ('view', 'purchase') WINDOW w AS (PARTITION BY fn ORDER BY loc)) WHERE t = 'view' AND u = 'purchase'),
p2 AS (SELECT * FROM (SELECT fn, t, loc AS j, lead(t) OVER w AS u, lead(loc) OVER w AS e FROM r WHERE t IN ('view', 'purchase') AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.fn = r.fn AND (p1.j = r.loc OR p1.e = r.loc)) WINDOW w AS (PARTITION BY fn ORDER BY loc)) WHERE t = 'view' AND u = 'purchase'),
pairs AS MATERIALIZED (SELECT fn, j, e FROM p1 UNION ALL SELECT fn, j, e FROM p2),
q AS MATERIALIZED (
  SELECT r.*, a.e AS tail, b.j AS head, (SELECT min(c.e) FROM pairs c WHERE c.fn = r.fn AND c.j < r.loc AND r.loc < c.e) AS around
  FROM r LEFT JOIN pairs a ON a.fn = r.fn AND a.j = r.loc LEFT JOIN pairs b ON b.fn = r.fn AND b.e = r.loc
)
"""

_EDGES = """
edges AS MATERIALIZED (
  SELECT fn, loc AS src, loc + 1 AS dst, CASE WHEN tail IS NOT NULL THEN 'below' WHEN t = 'signup' THEN 'set' ELSE 'add' END AS op FROM q WHERE head IS NULL
  UNION ALL SELECT fn, loc, tail + 1, 'above' FROM q WHERE tail IS NOT NULL
  UNION ALL SELECT fn, loc, head, 'add' FROM q WHERE head IS NOT NULL
  UNION ALL SELECT fn, loc, loc + 2, 'add' FROM q WHERE t = 'signup' AND following = 'click'
  UNION ALL SELECT fn, loc, around + 1, 'above' FROM q WHERE t = 'error' AND around IS NOT NULL
)
"""

_FULL = """
edges AS MATERIALIZED (
  SELECT fn, loc AS src, loc + 1 AS dst, CASE WHEN tail IS NOT NULL THEN 'below' WHEN t = 'signup' THEN 'set' ELSE 'add' END AS op,
    CASE WHEN t = 'error' THEN 0.0 WHEN t = 'purchase' THEN -v ELSE v END AS a, CASE WHEN t = 'error' THEN 1.0 WHEN t = 'purchase' THEN -v WHEN tail IS NOT NULL THEN v * 10 ELSE v END AS b FROM q WHERE head IS NULL
  UNION ALL SELECT fn, loc, tail + 1, 'above', v, v FROM q WHERE tail IS NOT NULL
  UNION ALL SELECT fn, loc, head, 'add', v, v FROM q WHERE head IS NOT NULL
  UNION ALL SELECT fn, loc, loc + 2, 'add', 0.0, 0.0 FROM q WHERE t = 'signup' AND following = 'click'
  UNION ALL SELECT fn, loc, around + 1, 'above', v, v FROM q WHERE t = 'error' AND around IS NOT NULL
)
"""


def program_rows(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """``(fn, loc, t, v, following, tail, head, around)``: events by program, and the loops that they open, close or are in."""
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("t"), F.col("value").alias("v"))
    k = scans.running_offset(events, ["user_id"], ["ts", "event_id"], F.lit(1), "k")
    rows = k.select(F.concat_ws(":", "user_id", F.floor(F.col("k") / SIZE).cast("string")).alias("fn"), (F.col("k") % SIZE).alias("loc"), "t", "v")
    within = Window.partitionBy("fn").orderBy("loc")  # a program has SIZE rows
    rows = scratch.save(rows.withColumn("following", F.lead("t").over(within)), "rows")
    marks = rows.where("t IN ('view', 'purchase')").select("fn", "loc", "t")

    def matched(m: DataFrame) -> DataFrame:
        found = m.select("fn", F.col("loc").alias("j"), "t", F.lead("t").over(within).alias("u"), F.lead("loc").over(within).alias("e"))
        return found.where("t = 'view' AND u = 'purchase'").select("fn", "j", "e")

    inner = matched(marks)
    rest = marks.join(inner.select("fn", F.explode(F.array("j", "e")).alias("loc")), ["fn", "loc"], "left_anti")
    pairs = scratch.save(inner.unionByName(matched(rest)), "pairs")
    around = rows.where("t = 'error'").select("fn", "loc").join(pairs, "fn").where("j < loc AND loc < e")
    around = shuffled(around.groupBy("fn", "loc").agg(F.min("e").alias("around")))
    return rows.join(pairs.select("fn", F.col("j").alias("loc"), F.col("e").alias("tail")), ["fn", "loc"], "left").join(pairs.select("fn", F.col("e").alias("loc"), F.col("j").alias("head")), ["fn", "loc"], "left").join(around, ["fn", "loc"], "left")


def programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``edges(fn, src, dst, op, a, b)`` and ``entries(fn, entry, lo, hi)`` of the events of ``sf_dir``."""
    return placed_programs(spark, sf_dir)[1:]


def placed_programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the programs, and what ``programs`` makes of them."""
    scratch = Scratch(spark, "programs", spread=True)
    q = scratch.save(program_rows(spark, sf_dir, scratch), "placed")
    edge = lambda when, dst, op, a, b: F.when(when, F.struct(dst.cast("long").alias("dst"), op.alias("op"), a.cast("double").alias("a"), b.cast("double").alias("b")))
    t, v, loc, tail, head, text = F.col("t"), F.col("v"), F.col("loc"), F.col("tail"), F.col("head"), F.lit
    opens, closes = tail.isNotNull(), head.isNotNull()
    straight = F.when(opens, F.lit("below")).when(t == "signup", F.lit("set")).otherwise(F.lit("add"))
    low = F.when(t == "error", F.lit(0.0)).when(t == "purchase", -v).otherwise(v)
    high = F.when(t == "error", F.lit(1.0)).when(t == "purchase", -v).when(opens, v * 10).otherwise(v)
    out = F.array(
        edge(~closes, loc + 1, straight, low, high), edge(opens, tail + 1, text("above"), v, v), edge(closes, head, text("add"), v, v),
        edge((t == "signup") & (F.col("following") == "click"), loc + 2, text("add"), F.lit(0.0), F.lit(0.0)), edge((t == "error") & F.col("around").isNotNull(), F.col("around") + 1, text("above"), v, v),
    )
    edges = q.select("fn", loc.alias("src"), F.explode(F.filter(out, lambda e: e.isNotNull())).alias("e")).select("fn", F.col("src").cast("long").alias("src"), "e.dst", "e.op", "e.a", "e.b")
    entries = q.where("loc = 0").select("fn", F.col("loc").cast("long").alias("entry"), F.lit(0.0).alias("lo"), v.alias("hi"))
    return q, scratch.save(edges, "edges"), scratch.save(entries, "entries")


# --- loops ---------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {_STEPS}, f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS entry FROM events GROUP BY user_id),
n AS (SELECT DISTINCT user_id, src AS loc FROM e UNION SELECT DISTINCT user_id, dst FROM e UNION SELECT user_id, entry FROM f),
without AS (
  SELECT f.user_id, n.loc AS other, f.entry AS loc FROM f JOIN n USING (user_id) WHERE n.loc <> f.entry
  UNION SELECT w.user_id, w.other, e.dst FROM without w JOIN e ON e.user_id = w.user_id AND e.src = w.loc WHERE e.dst <> w.other
)
SELECT user_id, src, dst, src = dst AS is_self FROM e WHERE NOT EXISTS (SELECT 1 FROM without w WHERE w.user_id = e.user_id AND w.loc = e.src AND w.other = e.dst)
""")
def back_edges_by_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back edges of each user's transitions between event types: those whose target dominates their source."""
    edges = steps(spark, sf_dir).withColumnRenamed("user_id", "fn")
    entries = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fn")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("entry"))
    return dominators.back_edges(edges, entries).select(F.col("fn").alias("user_id"), "src", "dst", (F.col("src") == F.col("dst")).alias("is_self"))


@query(f"""
WITH {_PROGRAMS}, {_EDGES}, locs AS (SELECT fn, src AS loc FROM edges UNION SELECT fn, dst FROM edges)
SELECT locs.fn, loc, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS heads FROM locs JOIN pairs ON pairs.fn = locs.fn AND j < loc AND loc <= e GROUP BY locs.fn, loc
""")
def loop_nests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of the loops around each location of the events' programs, outermost first."""
    g = cells.build(*programs(spark, sf_dir))
    return g.locs.where(F.size("nest") > 0).select("fn", F.col("loc").cast("int").alias("loc"), F.array_join("nest", ",").alias("heads"))


# --- the cell graph ------------------------------------------------------------

_GRAPH = f"""
{_PROGRAMS}, {_EDGES},
l AS MATERIALIZED (
  SELECT x.fn, x.loc, coalesce(string_agg(j || ':0', ',' ORDER BY j), '') AS around, coalesce(list(j ORDER BY j) FILTER (WHERE j IS NOT NULL), []) AS nest, EXISTS (SELECT 1 FROM pairs c WHERE c.fn = x.fn AND c.j = x.loc) AS is_head
  FROM (SELECT fn, src AS loc FROM edges UNION SELECT fn, dst FROM edges) x LEFT JOIN pairs ON pairs.fn = x.fn AND j < loc AND loc <= e GROUP BY x.fn, x.loc
), nm AS MATERIALIZED (
  SELECT *, loc || CASE WHEN around = '' THEN '' ELSE '@' || around END AS at_name, loc || '@' || CASE WHEN around = '' THEN '' ELSE around || ',' END || loc || ':0' AS zero, loc || '@' || CASE WHEN around = '' THEN '' ELSE around || ',' END || loc || ':1' AS one FROM l
), o AS MATERIALIZED (
  SELECT *, dst <= src AS is_back, CASE WHEN dst > src THEN row_number() OVER (PARTITION BY fn, dst, dst <= src ORDER BY src) - 1 ELSE -1 END AS i,
    dst > src AND count(*) FILTER (WHERE dst > src) OVER (PARTITION BY fn, dst) + CASE WHEN dst = 0 THEN 1 ELSE 0 END > 1 AS is_join FROM edges
), m AS MATERIALIZED (
  SELECT o.fn, o.src || '>' || o.dst AS edge, i, is_back, is_join, CASE WHEN a.is_head AND list_contains(b.nest, o.src) THEN a.zero ELSE a.at_name END AS from_cell,
    CASE WHEN b.is_head THEN b.zero ELSE b.at_name END AS to_cell, b.zero || '^' || b.one AS wide, b.at_name AS plain,
    CASE WHEN len(a.nest) > len(b.nest) + CASE WHEN is_back THEN 1 ELSE 0 END THEN a.nest[-1] END AS after
  FROM o JOIN nm a ON a.fn = o.fn AND a.loc = o.src JOIN nm b ON b.fn = o.fn AND b.loc = o.dst
), targets AS (
  SELECT *, CASE WHEN is_join THEN i || '*' || edge ELSE edge END AS stmt, CASE WHEN is_back THEN wide WHEN is_join THEN i || '*' || plain ELSE to_cell END AS target FROM m
)
"""


@query(f"""
WITH {_GRAPH}
SELECT fn, stmt AS src, target AS dst, 'transfer' AS kind, after FROM targets UNION ALL SELECT fn, from_cell, target, 'transfer', after FROM targets
UNION ALL SELECT fn, target, to_cell, 'join', NULL FROM targets WHERE is_join
UNION ALL SELECT fn, zero, at_name, 'fix', NULL FROM nm WHERE is_head UNION ALL SELECT fn, one, at_name, 'fix', NULL FROM nm WHERE is_head
UNION ALL SELECT fn, zero, one, 'widen', NULL FROM nm WHERE is_head UNION ALL SELECT fn, zero || '^' || one, one, 'widen', NULL FROM nm WHERE is_head
""")
def cell_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All computations between the cells of the events' programs."""
    return cells.build(*programs(spark, sf_dir)).comps


@query(f"""
WITH {_GRAPH}, c AS (
  SELECT fn, stmt AS cell, 'stmt' AS kind, 'stmt' AS role FROM targets UNION ALL SELECT fn, target, 'state', 'pre' FROM targets WHERE is_join UNION ALL SELECT fn, at_name, 'state', 'at' FROM nm
  UNION ALL SELECT fn, zero, 'state', 'iter' FROM nm WHERE is_head UNION ALL SELECT fn, one, 'state', 'iter' FROM nm WHERE is_head UNION ALL SELECT fn, zero || '^' || one, 'state', 'prewiden' FROM nm WHERE is_head
) SELECT fn, kind, role, count(*) AS n FROM c GROUP BY ALL
""")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each program, by kind and role."""
    return cells.build(*programs(spark, sf_dir)).cells.groupBy("fn", "kind", "role").agg(F.count("*").alias("n"))


# --- values --------------------------------------------------------------------


def _machine(changes: str = "SELECT NULL AS fn, NULL AS src, NULL AS dst, NULL AS a, NULL AS b WHERE false", given: str = "SELECT NULL AS fn, 0.0 AS hi WHERE false", only: str = "true") -> str:
    """SQL that runs each program one location at a time, with its loops' iterates in lists; ``given`` bounds of entries replace their own."""
    new = "coalesce((SELECT c.{x} FROM changes c WHERE c.fn = q.fn AND c.src = q.loc AND c.dst = q.loc + 1), {old})"
    low = new.format(x="a", old="CASE t WHEN 'error' THEN 0.0 WHEN 'purchase' THEN -v ELSE v END")
    high = new.format(x="b", old="CASE WHEN t = 'error' THEN 1.0 WHEN t = 'purchase' THEN -v WHEN tail IS NOT NULL THEN v * 10 ELSE v END")
    meet = lambda lo, hi, a, b: f"CASE WHEN greatest({lo}, {a}) > least({hi}, {b}) OR {lo} > {hi} THEN 'inf'::DOUBLE ELSE greatest({lo}, {a}) END"
    bottom = lambda lo, hi, a, b: f"CASE WHEN greatest({lo}, {a}) > least({hi}, {b}) OR {lo} > {hi} THEN '-inf'::DOUBLE ELSE least({hi}, {b}) END"
    inf = "'inf'::DOUBLE"
    return f"""
{_PROGRAMS}, changes AS ({changes}), given AS ({given}),
prog AS MATERIALIZED (
  SELECT fn, count(*) AS n, list(t ORDER BY loc) AS t, list(v ORDER BY loc) AS v, list(tail ORDER BY loc) AS tail, list(head ORDER BY loc) AS head, list(around ORDER BY loc) AS around,
    list(t = 'signup' AND coalesce(following = 'click', false) ORDER BY loc) AS skips, list({low} ORDER BY loc) AS a, list({high} ORDER BY loc) AS b FROM q GROUP BY fn
), run AS (
  SELECT fn, 0 AS pc, list_prepend(0.0::DOUBLE, list_transform(range(n), lambda x: {inf})) AS lo, list_prepend(coalesce((SELECT g.hi FROM given g WHERE g.fn = prog.fn), v[1]), list_transform(range(n), lambda x: -{inf})) AS hi,
    list_transform(range(n), lambda x: {inf}) AS wlo, list_transform(range(n), lambda x: -{inf}) AS whi, list_transform(range(n), lambda x: 0) AS it
  FROM prog WHERE {only}
  UNION ALL
  SELECT fn, nxt AS pc,
    list_transform(lo, lambda x, i: CASE WHEN fixed AND i = h + 1 THEN nlo ELSE least(CASE WHEN i BETWEEN r0 AND r1 THEN {inf} ELSE x END, CASE WHEN i = t1 THEN l1 ELSE {inf} END, CASE WHEN i = t2 THEN l2 ELSE {inf} END) END),
    list_transform(hi, lambda x, i: CASE WHEN fixed AND i = h + 1 THEN nhi ELSE greatest(CASE WHEN i BETWEEN r0 AND r1 THEN -{inf} ELSE x END, CASE WHEN i = t1 THEN h1 ELSE -{inf} END, CASE WHEN i = t2 THEN h2 ELSE -{inf} END) END),
    list_transform(wlo, lambda x, i: CASE WHEN i = h + 1 THEN nlo ELSE x END), list_transform(whi, lambda x, i: CASE WHEN i = h + 1 THEN nhi ELSE x END),
    list_transform(it, lambda x, i: CASE WHEN i = h + 1 THEN CASE WHEN opens THEN 0 ELSE x + 1 END ELSE x END)
  FROM (
    SELECT *, CASE WHEN closes AND NOT fixed THEN h + 1 ELSE pc + 1 END AS nxt,
      CASE WHEN opens OR closes AND NOT fixed THEN h + 2 ELSE 0 END AS r0, CASE WHEN opens THEN tl + 2 WHEN closes AND NOT fixed THEN pc + 2 ELSE -1 END AS r1,
      CASE WHEN opens OR closes AND NOT fixed THEN h + 2 WHEN closes THEN pc + 2 ELSE pc + 2 END AS t1,
      CASE WHEN opens OR closes AND NOT fixed THEN {meet('nlo', 'nhi', "'-inf'::DOUBLE", 'hb')} WHEN closes THEN {meet('nlo', 'nhi', 'hv', inf)} WHEN xl > xh THEN {inf} WHEN ty = 'signup' THEN av ELSE xl + av END AS l1,
      CASE WHEN opens OR closes AND NOT fixed THEN {bottom('nlo', 'nhi', "'-inf'::DOUBLE", 'hb')} WHEN closes THEN {bottom('nlo', 'nhi', 'hv', inf)} WHEN xl > xh THEN -{inf} WHEN ty = 'signup' THEN bv ELSE xh + bv END AS h1,
      CASE WHEN skip THEN pc + 3 WHEN ty = 'error' AND ar IS NOT NULL THEN ar + 2 ELSE -1 END AS t2,
      CASE WHEN skip THEN xl ELSE {meet('xl', 'xh', 'vv', inf)} END AS l2, CASE WHEN skip THEN xh ELSE {bottom('xl', 'xh', 'vv', inf)} END AS h2
    FROM (
      SELECT *, closes AND nlo = olo AND nhi = ohi AS fixed FROM (
        SELECT *, CASE WHEN opens THEN xl WHEN NOT closes THEN NULL WHEN olo > ohi THEN pl WHEN pl > ph THEN olo WHEN pl < olo THEN '-inf'::DOUBLE ELSE olo END AS nlo,
          CASE WHEN opens THEN xh WHEN NOT closes THEN NULL WHEN olo > ohi THEN ph WHEN pl > ph THEN ohi WHEN ph > ohi THEN {inf} ELSE ohi END AS nhi
        FROM (
          SELECT run.*, p.n, p.t[pc + 1] AS ty, p.v[pc + 1] AS vv, p.a[pc + 1] AS av, p.b[pc + 1] AS bv, p.tail[pc + 1] AS tl, p.around[pc + 1] AS ar, p.skips[pc + 1] AS skip,
            p.tail[pc + 1] IS NOT NULL AS opens, p.head[pc + 1] IS NOT NULL AS closes, coalesce(p.head[pc + 1], CASE WHEN p.tail[pc + 1] IS NOT NULL THEN pc END) AS h,
            p.b[coalesce(p.head[pc + 1], pc) + 1] AS hb, p.v[coalesce(p.head[pc + 1], pc) + 1] AS hv, lo[pc + 1] AS xl, hi[pc + 1] AS xh, wlo[coalesce(p.head[pc + 1], pc) + 1] AS olo, whi[coalesce(p.head[pc + 1], pc) + 1] AS ohi,
            CASE WHEN lo[pc + 1] > hi[pc + 1] THEN {inf} ELSE lo[pc + 1] + p.v[pc + 1] END AS pl, CASE WHEN lo[pc + 1] > hi[pc + 1] THEN -{inf} ELSE hi[pc + 1] + p.v[pc + 1] END AS ph
          FROM run JOIN prog p USING (fn) WHERE pc < p.n
        )
      )
    )
  )
), final AS (
  SELECT run.fn, unnest(range(n + 1)) AS loc, unnest(lo) AS lo, unnest(hi) AS hi, unnest(list_append(list_transform(it, lambda x, i: CASE WHEN p.tail[i] IS NOT NULL THEN x END), NULL)) AS iterations FROM run JOIN prog p USING (fn) WHERE pc = n
)
"""


_RESULT = "SELECT fn, CAST(loc AS INTEGER) AS loc, CASE WHEN isfinite(lo) THEN lo END AS lo, CASE WHEN isfinite(hi) THEN hi END AS hi, lo > hi AS is_bottom, CAST(iterations AS INTEGER) AS iterations FROM final"


def _shown(values: cells.Values, g: cells.CellGraph) -> DataFrame:
    found = values.at_locations(g.locs)
    return found.select("fn", F.col("loc").cast("int").alias("loc"), finite(F.col("lo")).alias("lo"), finite(F.col("hi")).alias("hi"), (F.col("lo") > F.col("hi")).alias("is_bottom"), "iterations")


@query(f"WITH RECURSIVE {_machine()} {_RESULT}")
def cell_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all locations of the events' programs, and after how many iterations their loops have converged."""
    g = cells.build(*programs(spark, sf_dir))
    return _shown(cells.evaluate(g), g)


@query(f"""
WITH RECURSIVE {_machine()}, want AS (SELECT fn, min(loc) AS loc FROM q WHERE t = 'purchase' GROUP BY fn)
SELECT fn, CAST(loc AS INTEGER) AS loc, CASE WHEN isfinite(lo) THEN lo END AS lo, CASE WHEN isfinite(hi) THEN hi END AS hi FROM final JOIN want USING (fn, loc)
""")
def cell_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at each program's first purchase, from the cells alone that it depends on."""
    q, edges, entries = placed_programs(spark, sf_dir)
    g = cells.build(edges, entries)
    bought = q.where("t = 'purchase'").groupBy("fn").agg(F.min("loc").cast("long").alias("loc"))
    found = cells.evaluate(g, wanted=bought).at_locations(g.locs).join(bought, ["fn", "loc"])
    return found.select("fn", F.col("loc").cast("int").alias("loc"), finite(F.col("lo")).alias("lo"), finite(F.col("hi")).alias("hi"))


_CHANGES = "SELECT fn, loc AS src, loc + 1 AS dst, -3 * v AS a, 2 * v AS b FROM q WHERE t = 'click' AND loc = 5"


@query(f"WITH RECURSIVE {_machine(_CHANGES)} {_RESULT}")
def cell_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New statements where the sixth event of a program is a click, applied to kept values: only cells that they reach are computed anew."""
    q, edges, entries = placed_programs(spark, sf_dir)
    store = cells.CellStore(cells.build(edges, entries))
    store.fill()
    clicks = q.where("loc = 5 AND t = 'click'").select("fn", "v")
    changed = edges.where("src = 5 AND dst = 6").join(clicks, "fn").select("fn", "src", "dst", F.lit("add").alias("op"), (-3 * F.col("v")).alias("a"), (2 * F.col("v")).alias("b"))
    store.edit(changed)
    return _shown(store.read(), store.graph)


_CALLERS = "SELECT fn, split_part(fn, ':', 1) || ':' || (CAST(split_part(fn, ':', 2) AS BIGINT) + 1) AS callee, v FROM q WHERE loc = 0 AND t = 'signup' AND CAST(split_part(fn, ':', 2) AS BIGINT) % 2 = 0"
_CALLEES = _machine(given=f"SELECT callee AS fn, v AS hi FROM ({_CALLERS})", only="fn IN (SELECT fn FROM given)")
_TOLD = f"SELECT c.fn, 0 AS src, 1 AS dst, coalesce(e.lo, '-inf'::DOUBLE) AS a, coalesce(e.hi, 'inf'::DOUBLE) AS b FROM ({_CALLERS}) c LEFT JOIN callees e ON e.fn = c.callee AND e.loc = e.n"


@query(f"""
WITH RECURSIVE callees AS MATERIALIZED (WITH RECURSIVE {_CALLEES} SELECT final.*, p.n FROM final JOIN prog p USING (fn)), {_machine(_TOLD, only="fn IN (SELECT fn FROM changes)")},
found AS (SELECT fn, loc, lo, hi, iterations FROM final UNION ALL SELECT fn, loc, lo, hi, iterations FROM callees)
{_RESULT.replace("FROM final", "FROM found")}
""")
def cell_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other program whose first event is a signup calls the user's next program there: states of callers and of callees in the contexts they are asked for in, and no others."""
    scratch = Scratch(spark, "calling", spread=True)
    q, edges, entries = placed_programs(spark, sf_dir)
    user, number = F.substring_index("fn", ":", 1), F.substring_index("fn", ":", -1).cast("long")
    callers = scratch.save(q.where("loc = 0 AND t = 'signup'").where(number % 2 == 0).select("fn", F.concat_ws(":", user, (number + 1).cast("string")).alias("callee")), "callers")
    joined = edges.join(callers.withColumns({"src": F.lit(0).cast("long"), "dst": F.lit(1).cast("long")}), ["fn", "src", "dst"], "left")
    calling = joined.withColumn("op", F.when(F.col("callee").isNotNull(), "call").otherwise(F.col("op")))
    g = cells.build(calling, entries)
    exits = q.groupBy("fn").agg((F.max("loc") + 1).cast("long").alias("loc"))
    demand = entries.join(callers.select("fn"), "fn", "left_semi").select("fn", "lo", "hi")
    found = summaries.solve(g, exits, demand)
    states = found.values.at_locations(found.graph.locs).join(found.contexts.select(F.col("ctx").alias("fn"), F.col("fn").alias("program")), "fn")
    return states.select(F.col("program").alias("fn"), F.col("loc").cast("int").alias("loc"), finite(F.col("lo")).alias("lo"), finite(F.col("hi")).alias("hi"), (F.col("lo") > F.col("hi")).alias("is_bottom"), "iterations")


@query(f"WITH {_GRAPH} SELECT fn, target AS cell, stmt, from_cell AS state, NULL::VARCHAR AS error FROM targets")
def transfer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement and the state that each transfer of the events' programs reads; malformed cells would have an error."""
    g = cells.build(*programs(spark, sf_dir))
    return cells.transfer_inputs(g.cells, g.comps)


# --- edits of graphs ---------------------------------------------------------------

_EDITED = f"""
{_PROGRAMS}, {_FULL}, last AS (SELECT fn, count(*) AS n FROM q GROUP BY fn),
ed AS MATERIALIZED (
  SELECT fn || ':' || loc AS edit, fn, loc AS place, CASE WHEN t = 'click' AND loc % 2 = 1 THEN loc + 1 WHEN t = 'signup' THEN loc + 2 END AS upto, v,
    CASE WHEN t = 'click' AND loc % 2 = 0 THEN 'add' WHEN t = 'click' THEN 'delete' WHEN t = 'signup' THEN 'modify' ELSE 'header' END AS kind
  FROM q WHERE t = 'click' OR t = 'signup' AND following = 'click' OR tail IS NOT NULL
), region AS MATERIALIZED (
  SELECT edit, e.fn, src, dst FROM ed JOIN edges e ON e.fn = ed.fn AND (kind = 'delete' AND src = place AND dst = upto OR kind = 'modify' AND src IN (place, place + 1) AND dst IN (place + 1, upto) AND dst > src)
), moved AS MATERIALIZED (
  SELECT edit, fn, src, dst FROM region UNION SELECT edit, e.fn, src, dst FROM ed JOIN edges e ON e.fn = ed.fn AND (kind = 'add' AND src = place OR kind = 'delete' AND src = upto OR kind = 'header' AND src = place)
  UNION SELECT edit, e.fn, src, dst FROM ed JOIN last USING (fn) JOIN edges e ON e.fn = ed.fn AND kind = 'delete' AND dst = upto AND upto < n
), clash AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY fn, src, dst) AS edits FROM moved QUALIFY edits > 1),
sound AS MATERIALIZED (SELECT ed.*, n, n + row_number() OVER (PARTITION BY fn, kind ORDER BY edit) AS fresh FROM ed JOIN last USING (fn) WHERE edit NOT IN (SELECT edit FROM clash))
"""


@query(f"""
WITH {_EDITED}, kept AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM region r JOIN sound USING (edit) WHERE r.fn = e.fn AND r.src = e.src AND r.dst = e.dst)),
headed AS (SELECT k.fn, k.src, k.dst, k.op, CASE WHEN h.fn IS NOT NULL AND op IN ('below', 'above') THEN -5.0 ELSE a END AS a, CASE WHEN h.fn IS NOT NULL AND op IN ('below', 'above') THEN 500.0 ELSE b END AS b FROM kept k LEFT JOIN sound h ON h.fn = k.fn AND h.place = k.src AND h.kind = 'header'),
merged AS (SELECT fn, place, upto FROM sound WHERE kind = 'delete' AND upto < n),
turned AS (SELECT k.fn, coalesce(x.place, k.src) AS src, coalesce(y.place, k.dst) AS dst, op, a, b FROM headed k LEFT JOIN merged x ON x.fn = k.fn AND x.upto = k.src LEFT JOIN merged y ON y.fn = k.fn AND y.upto = k.dst)
SELECT t.fn, coalesce(s.fresh, t.src) AS src, t.dst, t.op, t.a, t.b FROM turned t LEFT JOIN sound s ON s.fn = t.fn AND s.place = t.src AND s.kind = 'add'
UNION ALL SELECT fn, place, fresh, 'add', 1.0, 2.0 FROM sound WHERE kind = 'add'
UNION ALL SELECT fn, place, upto, 'set', v, v FROM sound WHERE kind = 'modify'
UNION ALL SELECT fn, place, upto, 'add', 0.0, 0.0 FROM sound WHERE kind = 'delete' AND upto = n
""")
def graph_edits_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' programs after a batch of edits: statements put in, replaced and taken out, and new loop headers."""
    return _edited(spark, sf_dir)[0]


@query(f"WITH {_EDITED} SELECT edit, fn, src, dst, edits FROM clash")
def graph_edit_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of that batch that touch an edge of another one, and are not applied."""
    return _edited(spark, sf_dir)[1]


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, edges, _ = placed_programs(spark, sf_dir)
    click, odd, v, loc = F.col("t") == "click", F.col("loc") % 2 == 1, F.col("v"), F.col("loc")
    kind = F.when(click & ~odd, "add").when(click, "delete").when((F.col("t") == "signup") & (F.col("following") == "click"), "modify").when(F.col("tail").isNotNull(), "header")
    upto = F.when(F.col("kind") == "delete", loc + 1).when(F.col("kind") == "modify", loc + 2)
    pick = lambda a, m, h: F.when(F.col("kind") == "add", a).when(F.col("kind") == "modify", m).when(F.col("kind") == "header", h)
    rows = q.withColumn("kind", kind).where("kind IS NOT NULL").select(
        F.concat_ws(":", "fn", loc.cast("string")).alias("edit"), "fn", "kind", loc.alias("at"), upto.alias("upto"), pick(F.lit("add"), F.lit("set"), F.lit(None)).alias("op"), pick(F.lit(1.0), v, F.lit(-5.0)).alias("a"), pick(F.lit(2.0), v, F.lit(500.0)).alias("b"),
    )
    exits = q.groupBy("fn").agg((F.max("loc") + 1).alias("loc"))
    return graph_edits.apply_edits(edges, rows, exits)


# --- paths, ranges, stored states ----------------------------------------------------


@query("""
WITH k AS (SELECT event_id, user_id, event_type AS t, row_number() OVER w AS k, lead(event_id) OVER w AS n1, lead(event_id, 2) OVER w AS n2, lag(event_type) OVER w AS p1, lag(event_type, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, t = 'signup' OR n1 IS NULL OR t = 'error' AND n2 IS NOT NULL AS stops, (t <> 'signup' AND n1 IS NOT NULL) OR coalesce(p1 <> 'signup', false) OR coalesce(p2 = 'error', false) AS is_node FROM k),
e AS (SELECT *, min(CASE WHEN stops THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM s)
SELECT e.event_id AS node, z.event_id AS "end", e.stop - e.k AS length, CASE WHEN z.t = 'error' AND z.n2 IS NOT NULL THEN 'fork' ELSE 'end' END AS kind FROM e JOIN e z ON z.user_id = e.user_id AND z.k = e.stop WHERE e.is_node
""")
def heap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a user's events: each but a signup points to the next one, an error also to the one behind, which ends the chain in a fork."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), F.col("event_type").alias("t"), F.lead("event_id").over(order).alias("n1"), F.lead("event_id", 2).over(order).alias("n2"))
    following = F.when(F.col("t") != "signup", F.array_compact(F.array("n1", F.when(F.col("t") == "error", F.col("n2")))))
    return paths.linear_paths(rows.select("src", F.explode(following).alias("dst")))


@query("""
WITH c AS (SELECT l_suppkey % 10 AS address, l_partkey AS idx, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL),
w AS (SELECT o_orderkey % 10 AS address, o_custkey AS first, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey + o_orderkey % 50 - 3 END AS last, floor(o_totalprice / 5000) AS lo, floor(o_totalprice / 4000) AS hi FROM orders)
SELECT c.address, c.idx, least(c.lo, min(w.lo)) AS lo, greatest(c.hi, max(w.hi)) AS hi, count(w.lo) > 0 AS is_reached FROM c LEFT JOIN w ON w.address = c.address AND c.idx >= w.first AND (w.last IS NULL OR c.idx <= w.last) GROUP BY c.address, c.idx, c.lo, c.hi
""")
def ranged_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten arrays with parts as indices and quantities as cells, after an order has been written to a range of each."""
    held = read_table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("address"), F.col("l_partkey").alias("idx")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    price = lambda n: F.floor(F.col("o_totalprice") / n).cast("double")
    last = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey") + F.col("o_orderkey") % 50 - 3)
    writes = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("address"), F.col("o_custkey").alias("first"), last.alias("last"), price(5000).alias("lo"), price(4000).alias("hi"))
    held = Scratch(spark, "arrays", spread=True).save(held, "cells")
    found = ranges.reached(held.select("address", "idx"), writes, "address", "idx")
    both = held.join(found, ["address", "idx"], "left")
    return both.select("address", "idx", F.least("lo", "w_lo").alias("lo"), F.greatest("hi", "w_hi").alias("hi"), F.col("w_lo").isNotNull().alias("is_reached"))


_COARSE = "s AS (SELECT user_id, event_type AS var, floor(min(value) / 100) AS lo, ceil(max(value) / 100) AS hi FROM events GROUP BY user_id, event_type)"


@query(f"""
WITH {_COARSE}, p AS (SELECT DISTINCT a.user_id AS x, b.user_id AS y FROM s a JOIN s b ON b.user_id = a.user_id + 1)
SELECT x AS user_id, a.var, least(a.lo, b.lo) AS join_lo, greatest(a.hi, b.hi) AS join_hi, CASE WHEN b.lo >= a.lo THEN a.lo END AS widen_lo, CASE WHEN b.hi <= a.hi THEN a.hi END AS widen_hi FROM p JOIN s a ON a.user_id = x JOIN s b ON b.user_id = y AND b.var = a.var
""")
def memo_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins and widenings of each user's state with the next user's, over states that are stored once and pairs that are computed once."""
    states = read_table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("var")).agg(F.floor(F.min("value") / 100).cast("double").alias("lo"), F.ceil(F.max("value") / 100).cast("double").alias("hi"))
    store = interning.Interned(spark)
    named = store.intern(store.scratch.save(states, "given"), ["user_id"])
    asked = named.select("user_id", F.col("digest").alias("a")).join(named.select((F.col("user_id") - 1).alias("user_id"), F.col("digest").alias("b")), "user_id")
    store.combined(asked.where("user_id % 2 = 0"))  # the others find some of these pairs
    found = {op: store.rows(store.combined(asked, op)).select("user_id", "var", F.col("lo").alias(f"{op}_lo"), F.col("hi").alias(f"{op}_hi")) for op in ("join", "widen")}
    both = found["join"].join(found["widen"], ["user_id", "var"])
    return both.select("user_id", "var", "join_lo", "join_hi", finite(F.col("widen_lo")).alias("widen_lo"), finite(F.col("widen_hi")).alias("widen_hi"))


# --- streams -----------------------------------------------------------------------


@query("""
WITH k AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS VARCHAR) AS caller FROM events),
a AS (SELECT user_id, seq, t AS ctx, caller, (SELECT min(z.seq) FROM k z WHERE z.user_id = k.user_id AND z.seq > k.seq AND (z.t = 'purchase' OR z.t = 'signup' AND k.t = 'view' OR z.t = 'error' AND z.caller = k.caller)) AS ends FROM k WHERE t IN ('click', 'view'))
SELECT DISTINCT a.user_id, a.ends AS seq, a.ctx, a.caller, CAST(a.user_id AS VARCHAR) = a.caller AS self_loop FROM a JOIN k ON k.user_id = a.user_id AND k.seq = a.ends WHERE k.t IN ('purchase', 'signup')
""")
def registry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of dependencies over three batches of events, each after a restart: clicks and views add callers, purchases take all, signups those of views, errors drop a caller."""
    scratch = Scratch(spark, "registry")
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    t = F.col("event_type")
    op = F.when(t.isin("click", "view"), "add").when(t == "error", "stale").otherwise("pop")
    ctx = F.when(t.isin("click", "view"), t).when(t == "signup", "view")
    caller = (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 20).cast("string")
    numbered = scans.running_offset(events, ["user_id"], ["ts", "event_id"], F.lit(1), "seq")
    rows = scratch.save(numbered.select(F.col("user_id").alias("callee"), F.col("seq").cast("long").alias("seq"), op.alias("op"), ctx.alias("ctx"), caller.alias("caller")), "rows")
    third = F.floor(3 * F.col("seq") / (F.max("seq").over(Window.partitionBy("callee")) + 1))
    parts = scratch.save(rows.withColumn("part", third), "parts")
    source, target, checkpoint = (f"{scratch.root}/{n}" for n in ("source", "target", "checkpoint"))
    for part in range(3):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        registry.follow(spark.readStream.schema(rows.schema).parquet(source), target, checkpoint)
    return spark.read.parquet(target).select(F.col("callee").alias("user_id"), "seq", "ctx", "caller", "self_loop")
