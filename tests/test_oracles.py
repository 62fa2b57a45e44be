"""A part of the registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from loompanel.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "f01_calendar f03_ema f06_macd f07_atr_norm f10_f12_channel f13_f14_swings f17_fibonacci f21_ranges f30_patterns f41_signal_lags a06_merge_series a07_constituents j04_as_of j05_interpolate g01_f43_f45_relative p01_date_split p03_p04_purged_folds e02_extend_ids r01_r02_regime n05_robust n10_inverse b04_balanced s01_training_windows s06_rich_samples m03_regression m04_m06_positions m07_m10_equity m11_m14_trades m02_ensemble g14_attribution g06_v10_correlation flagship".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return float(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    queries, oracles = all_queries()
    df = queries[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(oracles[name])
    order = [[d[0] for d in answer.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
    assert got == want and len(answer.description) == len(columns)
