"""Numbering and ranks read their input once: file scans in the plans of queries, before adaptive reuse."""

import os

import pytest

from boreline.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize(("name", "most"), [("rolling_mean_std", 2), ("masked_level_rmse", 4), ("level_window_profile", 12), ("rmse_distribution", 6), ("binned_rms_grid", 12)])
def test_scans(spark, name, most):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most
