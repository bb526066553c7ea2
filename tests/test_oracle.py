"""The correctness gate: every registered query against its DuckDB oracle
(exact after the shared rounding), on the smallest test tables.  The same
check at sf0.01: ``python -m tests.oracle_compare /root/testdata/sf0.01``."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle_compare import duck, frame_hash
from tillroll.plans.catalog import ORACLES, QUERIES

# random starts: invariants in test_invariants, the fixed start of the same search has SQL
NO_SQL = {"q_elbow", "q_kmeans_profile", "q_cluster_projection"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 1 and "Median_Total_Sales" in df.columns


def test_every_report_has_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(oracle_sql()[name]).fetchdf()
    assert frame_hash(sdf) == frame_hash(ddf)


def test_tukey_tests_agree_with_the_checked_statistics(spark):
    from tillroll.functions.stats import ptukey

    n = {"log": "noout_pos", "log_bulk": "pos"}
    for r in QUERIES["q_tukey_tests"](spark, SF_SMALL).collect():
        assert r["test"] in n and r["lwr"] < r["diff"] < r["upr"]
        assert (r["p_adj"] < 0.05) == (r["lwr"] > 0 or r["upr"] < 0)
        assert abs(r["q"] - abs(r["diff"]) / r["se"]) < 1e-6 * r["q"] and 0 <= ptukey(r["q"], 5, 1e6) <= 1
