"""Plans over computed events stay small enough for the driver."""

import os

import pytest

from tests.test_catalogue import SF
from wardstone.operators import sigma
from wardstone.plans import report_queries
from wardstone.plans.catalogue import QUERIES
from wardstone.sources.rules import shipped


def test_shipped_rules_share_the_normalizers_expressions(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    rules = sigma.compile_rules(shipped("detection"))
    assert {"command_line", "outcome"} <= set(sigma.columns_of(rules))
    rows = report_queries.normalized(spark, SF)
    assert sigma.settled(rows, ["outcome", "severity"]).columns == [c for c in rows.columns if c in ("outcome", "severity")]
    plan = QUERIES["detect_shipped_rules"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_extract") < 500
