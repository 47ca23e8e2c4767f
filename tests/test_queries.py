"""Every query against its SQL twin, and the entry point without the optional subpackage."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from conefix.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(map(rounded, r)) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(map(rounded, r)) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
