"""Panels made of all lines: what is moved to make them, and their rows against their SQL."""

import os
from datetime import datetime

import pytest

from loompanel.operators import joins
from loompanel.plans import adapters, all_queries
from loompanel.sources import sinks

SF = "/root/testdata/sf0.001"


def exchanges(node):
    """Columns of each shuffle of rows that are still lines: nothing below it groups them."""
    text = node.toString()
    own = [sorted(a.split("#")[0] for a in node.output().mkString("\n").split("\n"))] if node.nodeName() == "Exchange" and "l_orderkey" in text and "Aggregate" not in text else []
    below = node.children()
    return own + [e for i in range(below.size()) for e in exchanges(below.apply(i))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["n06_inference", "n03_standard", "n04_minmax"])
def test_lines_are_moved_once_and_narrow(spark, monkeypatch, name):
    """Where no table is small enough for broadcast of itself, as at size."""
    run, real = [], {"held": joins.held, "materialise": sinks.materialise}
    monkeypatch.setattr(joins, "held", lambda df, most: run.append(df) or real["held"](df, most))
    monkeypatch.setattr(sinks, "materialise", lambda df, label: run.append(df) or real["materialise"](df, label))
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        all_queries()[0][name](spark, SF)
        moved = [e for df in run for e in exchanges(df._jdf.queryExecution().executedPlan())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved == [["date", "l_orderkey", "l_quantity"]]


def odd_tables(spark, folder):
    """Ties up to the last column, orders kept twice or without lines, buyers of no nation, nulls."""
    day = lambda n: None if n is None else datetime(2020, 1, 1 + n, 7)
    lines = [(o, p, 1, n, q, x, 0.1, day(d)) for o, p, n, q, x, d in [
        (1, 1, 1, 2.0, 10.0, 0), (1, 1, 1, 4.0, 10.0, 0), (1, 1, 1, 2.0, 30.0, 0), (1, 2, None, 1.0, 7.0, 0), (2, 1, 1, 1.0, 5.0, 0), (2, 1, 2, 1.0, 6.0, 0),
        (3, 1, 1, None, 8.0, 1), (3, 2, 1, 3.0, 9.0, 1), (4, 1, 1, 2.0, 4.0, 1), (5, 1, 1, 2.0, 8.0, None), (5, 9, 1, 2.0, 9.0, None), (6, 1, 1, 1.0, 1.0, 0),
        (7, 1, 1, 1.0, 2.0, 0), (8, 1, 1, 1.0, 3.0, 0), (9, 1, 1, 1.0, 4.0, 40 % 9), (None, 1, 1, 1.0, 4.0, 0),
    ]]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"),
        "orders": ([(1, 1), (2, 1), (3, 2), (3, 2), (4, 1), (4, 2), (5, 1), (6, 3), (7, None), (8, 4), (10, 1)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 1), (2, 2), (3, 3), (4, None)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, "A", 1), (2, "B", 1), (3, "A", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("most", [adapters.BARS, 1])
def test_sold_panels_equal_their_sql(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(adapters, "BARS", most)
    d = odd_tables(spark, tmp_path / "t")
    for name in ("bars", "weeks", "calm"):
        tables = {t: adapters.table(spark, d, t) for t in adapters.TABLES if "{" + t + "}" in adapters.SQL[name]}
        want = spark.sql(adapters.SQL[name], **tables)
        got = adapters.view(spark, d, name)
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        for some in (["date", "close"], ["tic", "date"], ["tic", "date", "open", "low"] if name == "bars" else ["tic"]):
            assert sorted(map(repr, adapters.view(spark, d, name, *some).collect())) == sorted(map(repr, want.select(*some).collect()))
