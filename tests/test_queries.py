"""Every registered query with SQL, on the smallest tables."""

import os

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, duck

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")
# the same pipeline is checked to the last column by clinical_features
SLOW = {"clinical_prepared", "clinical_attrition", "clinical_missingness"}
# what the queries without SQL must return: bounds of their numbers
BOUNDS = {
    "missing_predict_auc": {"auc": (0, 1)}, "dist_fit": {"ks_stat": (0, 1)},
    "fit_gbt": {"p": (0, 1), "pred": (0, 1)}, "search_grid": {"auc": (0.3, 1), "max_depth": (1, 5)}, "model_grid": {"value": (-1, 1)},
    "forced_bias": {"density": (0, 1e9)}, "group_scores": {"density": (0, 1e9)}, "clinical_models": {"accuracy": (0, 1), "auc": (0, 1)},
}


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_rows_as_sql(spark, con, name):
    ok, text = compare(spark, con, ROOT, name, QUERIES[name], ORACLES[name])
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql(spark, name):
    rows = QUERIES[name](spark, ROOT).collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)
    for column, (low, high) in BOUNDS[name].items():
        values = [r[column] for r in rows if r[column] is not None]
        assert values and all(low <= v <= high for v in values)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
