"""Every registered query with SQL agrees with it on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, compare  # noqa: E402

from spanweave.plans.all_queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
# One query per family keeps the suite short; tools/check_oracle.py runs them all.
CHECKED = [
    "unified_daily", "rollup_month", "feature_table", "cci_visit", "rules_tracking", "penalty_stats",
    "winsor_scale", "cluster_profiles", "ami", "spearman_by_cluster", "rank_biserial", "cohort_compare",
    "threshold_choice", "run_scorecard", "spearman_p",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck.sql(ORACLES[name])).startswith("ok")


def test_registry_is_complete():
    assert set(ORACLES) <= set(QUERIES)
    without = set(QUERIES) - set(ORACLES)
    assert without == {
        "penalty_choice", "gmm_fit", "gmm_model_table",
        "ols_interaction_p", "logit_or", "kruskal_p", "association_summary", "metric_by_cluster_p",
        "cohort_partial_f", "cohort_compare_p", "publication_matrix",
    }
