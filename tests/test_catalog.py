from __future__ import annotations

import os

import duckdb
import pytest

from logloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(v[i], 6) if isinstance(v[i], float) else v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(names, want.fetchall())


def test_predicate_on_the_key_goes_below_the_replay(spark):
    plan = catalog.QUERIES["replay_get"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Window") < plan.rindex("Filter")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
