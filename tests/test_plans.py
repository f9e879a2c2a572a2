"""Plans of the catalogue: no pairs of everything with everything, and scans read only the columns they need."""

import re

import pytest

from evidentia.operators import concentration
from evidentia.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    df = QUERIES[name](spark, SF)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan_of(df))
    assert len({c.lower() for c in df.columns}) == len(df.columns)


def test_scans_are_pruned(spark):
    plan = plan_of(QUERIES["brands_distinct"](spark, SF))
    assert "o_totalprice" not in plan and "PushedFilters" in plan
    plan = plan_of(QUERIES["penetration"](spark, SF))
    assert "l_extendedprice" not in plan


def test_all_but_sampling_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"concentration_estimates"}


def test_doses_are_estimated_with_calibrated_settings_and_own_caps(spark, monkeypatch):
    given = []
    monkeypatch.setattr(concentration, "estimate", lambda listed, **settings: given.append((listed, settings)))
    QUERIES["concentration_estimates"](spark, SF)
    (listed, settings), = given
    assert settings == concentration.CALIBRATED
    assert listed.where("cap is not null").count() > 0
