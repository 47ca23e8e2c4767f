"""Large tables are shuffled in joins: the driver holds no side that Spark would broadcast by the size of its compressed files."""

from __future__ import annotations

import pytest

import __spark_entry__
from conefix.operators import cells, expressions, summaries
from conefix.session import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def broadcasts(monkeypatch):
    """The broadcast joins of all tables that are written, as every table were a large one; sums of ranges are the only ones meant to be."""
    found: list[str] = []
    save = Scratch.save

    def lines(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x for x in plan.splitlines() if "Broadcast" in x and "Join" in x and "\0at" not in x]

    def watched(self, df, *args, **kwargs):
        found.extend(lines(df))
        return save(self, df, *args, **kwargs)

    monkeypatch.setattr(Scratch, "SMALL", -1, raising=False)
    monkeypatch.setattr(Scratch, "save", watched)
    return lambda df: found + lines(df)


def test_small_tables_are_broadcast_and_large_ones_are_not(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k")
    held = Scratch(spark, "small", spread=True).save(rows, "rows")
    assert "BroadcastHashJoin" in plan(rows.join(held, "id"))
    monkeypatch.setattr(Scratch, "SMALL", -1)
    held = Scratch(spark, "large", spread=True).save(rows, "rows")
    assert "SortMergeJoin" in plan(rows.join(held.where("k = 1").groupBy("id").count(), "id"))


def test_many_alike_rows_are_not_broadcast(spark, monkeypatch):
    """Next to no bytes in files are not few rows in the driver."""
    monkeypatch.setattr(Scratch, "FEW", 100, raising=False)
    scratch, rows = Scratch(spark, "alike", spread=True), spark.range(1000).selectExpr("id", "'in' AS place")
    plan = lambda held: rows.join(held.where("id > 5").select("id"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(scratch.save(rows, "many"))
    assert "BroadcastHashJoin" in plan(scratch.save(rows.limit(100), "few"))


def test_parts_of_expressions_are_not_broadcast(spark, broadcasts, monkeypatch):
    """Counts of changes and lists of arguments come from joins, which pass no hint on: they have their own."""
    monkeypatch.setattr(Scratch, "FEW", -1, raising=False)
    tree = "VALUES ('f', '0', 'a', NULL, 0, 'assign', '+'), ('f', '0', 'x', 'a', 0, 'name', 'x'), ('f', '0', 'b', 'a', 1, 'literal', '1')"
    steps, errors = expressions.flatten(spark.sql(f"SELECT * FROM {tree} AS t(fn, stmt, node, parent, ord, form, value)"))
    assert broadcasts(steps) == [] and broadcasts(errors) == []
    assert [tuple(r) for r in steps.orderBy("k", "part").select("target", "form", "args").collect()] == [("$3", "binary", ["x", "1"]), ("x", "copy", ["$3"])]


def test_contexts_are_not_broadcast(spark, broadcasts):
    """What contexts instantiate comes from joins: edges, locations, entries."""
    of = lambda names, values: Scratch(spark, "given", spread=True).save(spark.sql(f"SELECT * FROM VALUES {values} AS t({names})"), "t")
    g = cells.CellGraph(of("fn, src, dst", "('f', 0L, 1L)"), of("fn, loc", "('f', 0L)"), of("fn, entry", "('f', 0L)"))
    made = summaries.instances(g, of("ctx, fn, lo, hi", "('f#0', 'f', 0D, 1D)"))
    for table in (made.edges, made.locs, made.entries):
        assert broadcasts(spark.range(9).selectExpr("CAST(id AS STRING) AS fn").join(table, "fn")) == []
    assert [tuple(r) for r in made.entries.collect()] == [("f#0", 0, 0.0, 1.0)]


@pytest.mark.parametrize("name", ["ranged_writes", "expression_errors", "expressions_flattened", "statement_errors", "transfer_inputs"])
def test_large_tables_are_not_broadcast(spark, broadcasts, name):
    assert broadcasts(__spark_entry__.queries()[name](spark, SF)) == []


def test_address_sets_are_whole_and_one_to_a_brand(spark):
    rows = {r["p_brand"]: r["addresses"].split(",") for r in __spark_entry__.queries()["addr_union"](spark, SF).collect()}
    part, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "lineitem"))
    pairs = {tuple(r) for r in lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("p_brand", "l_suppkey").collect()}
    assert rows == {b: [str(a) for a in sorted(a for c, a in pairs if c == b)] for b in {b for b, _ in pairs}}


def test_demand_finds_purchases_of_nothing(spark, tmp_path):
    """A purchase of value 0 adds nothing, and is a purchase."""
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), 1, t, v, "{}") for i, (t, v) in enumerate([("click", 3.0), ("purchase", 0.0), ("click", -2.0), ("purchase", 1.0)])]
    rows += [(9, datetime(2024, 1, 1), 2, "click", -2.0, "{}"), (10, datetime(2024, 1, 2), 2, "purchase", 5.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["cell_demand"](spark, str(tmp_path)).collect()
    assert sorted((r["fn"], r["loc"]) for r in got) == [("1:0", 1), ("2:0", 1)]
