"""Programs with known results, and operators whose queries compare less than they do."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from conefix.operators import analytics, edits
from conefix.plans import examples, workload
from conefix.sources import sinks


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize(
    ("made", "columns", "wanted"),
    [
        (examples.exit_states, ("program", "variable", "lo", "hi"), [r for r in examples.EXITS if r[2:] != (None, None)]),
        (examples.array_checks, ("program", "index", "safe"), examples.ACCESSES),
        (examples.null_checks, ("program", "variable", "safe"), examples.USES),
        (examples.statement_edits, ("method", "kind", "place", "old", "new"), examples.CHANGES),
        (examples.located_states, ("variable", "loc", "lo", "hi"), examples.PLACES),
        (examples.form_counts, ("form", "n"), examples.FORMS),
        (examples.solved_stats, ("contexts", "dependencies", "methods", "self_loops"), [examples.STATS]),
        (examples.heads_around, ("loc", "heads"), examples.AROUND),
        (examples.list_shapes, ("method", "shape"), examples.SHAPES_FOUND),
    ],
    ids=lambda v: getattr(v, "__name__", ""),
)
def test_known_results(spark, made, columns, wanted):
    assert rows(made(spark), *columns) == sorted(map(tuple, wanted), key=str)


def test_workload_is_drawn_from_its_seed(spark):
    assert rows(workload.edits(spark, 200, 7), "*") == rows(workload.edits(spark, 200, 7), "*")


@pytest.mark.parametrize("bracket", [0.001, 0.0, -0.2])
def test_percentiles_whatever_their_brackets(spark, monkeypatch, bracket):
    """Brackets that miss their points give the same numbers, from the whole group."""
    monkeypatch.setattr(analytics, "BRACKET", bracket)
    monkeypatch.setattr(analytics, "ACCURACY", 10_000 if bracket > 0 else 3)
    data = [(g, float((i * 37) % 101) / 7) for g, n in (("a", 400), ("b", 1), ("c", 2), (None, 33)) for i in range(n)] + [("a", None), ("d", None)]
    got = {r["g"]: r for r in analytics.percentiles(spark.createDataFrame(data, "g string, ms double"), ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        own = sorted(v for k, v in data if k == g and v is not None)
        assert r["mean"] == pytest.approx(sum(own) / len(own)) and r["median"] == pytest.approx(statistics.median(own))
        for name, p in (("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
            at = (len(own) - 1) * p
            low = int(at)
            assert r[name] == pytest.approx(own[low] + (at - low) * (own[min(low + 1, len(own) - 1)] - own[low]))


def test_a_key_of_both_sides_is_an_error(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v long"), spark.createDataFrame([("z", 3)], "id string, v long")
    assert rows(edits.merged(a, b, ["id"]), "id", "v") == [("x", 1), ("y", 2), ("z", 3)]
    with pytest.raises(Exception, match="a key of both sides: x"):
        edits.merged(a, b.union(a.where("id = 'x'")), ["id"]).collect()


def test_digits_of_tables(spark):
    means = spark.createDataFrame([("p_1", 0.05, 12.34, None), ("q", 3.0, 0.26, 1.0)], "program string, a double, b double, c double")
    lines = [r["line"] for r in sinks.latex_rows(means, "program", ["a", "b", "c"]).orderBy("last", "program").collect()]
    assert lines == [r"p\_1 & $<$0.1 & 12.3 & -- \\", r"q & 3.0 & 0.3 & 1.0 \\", r"average & 1.5 & 6.3 & 1.0 \\"]
    shown = spark.createDataFrame([(0.001,), (0.05,), (12.345,), (None,)], "x double").select(analytics.shown_percent(F.col("x")).alias("t"))
    assert [r["t"] for r in shown.collect()] == ["<0.01", "<0.1", "12.3", ""]
