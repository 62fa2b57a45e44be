"""Queries that read a panel more than once make it once: ``lineitem`` is joined and grouped one time."""

import os

import pytest

from loompanel.operators import joins
from loompanel.plans import all_queries
from loompanel.sources import sinks

SF = "/root/testdata/sf0.001"
ONCE = [
    "a15_export_normalised",
    "n08_a15_preprocess",
    "s07_volatility_regime",
    "s07_existing_regime",
    "f58_complete_panel",
    "n05_robust",
    "n06_inference",
    "n03_standard",
    "n04_minmax",
    "n02_log",
    "n10_inverse",
    "v08_aligned",
    "m04_m06_positions",
    "g11_g05_distribution",
    "m08_m09_risk",
    "m11_m14_trades",
    "f50_f52_equilibrium",
    "f50_f52_equilibrium_of_weeks",
    "f46_f47_pairs",
    "f48_f49_spread_adf",
    "p01_date_split",
    "e01_encode",
    "b03_sectors",
    "r01_r02_regime",
    "j08_j09_realign",
    "g10_sparsity",
    "flagship",
    "m12_backtest",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ONCE)
def test_panel_is_made_once(spark, monkeypatch, name):
    made, real = [], sinks.materialise

    def counted(df, label):
        made.append(sum(f.endswith("lineitem.parquet") for f in df.inputFiles()))
        return real(df, label)

    monkeypatch.setattr(sinks, "materialise", counted)
    df = all_queries()[0][name](spark, SF)
    assert sum(made) == 1
    assert not any(f.endswith("lineitem.parquet") for f in df.inputFiles())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_names_of_families_cost_no_panel(spark, monkeypatch):
    """``f58_all_features`` groups lines once, for its own panel, not to learn the columns of each family."""
    grouped, real = [], joins.held

    def counted(df, most):
        grouped.append(any(f.endswith("lineitem.parquet") for f in df.inputFiles()))
        return real(df, most)

    monkeypatch.setattr(joins, "held", counted)
    df = all_queries()[0]["f58_all_features"](spark, SF)
    assert sum(grouped) == 1
    assert not any(f.endswith("lineitem.parquet") for f in df.inputFiles())
