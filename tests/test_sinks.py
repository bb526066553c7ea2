"""Result tables written by the sink read back unchanged (partitioned or not)."""

import tempfile

from tests.conftest import SF_SMALL
from tillroll.operators import kpi
from tillroll.plans.catalog import pops
from tillroll.sources.sinks import publish, publish_all


def test_publish_roundtrip(spark):
    P = pops(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="tillroll-sink-")
    paths = publish_all({"kpi": kpi.kpi_table(P.sc, approx_median=True)}, base)
    back = spark.read.parquet(paths["kpi"])
    assert back.count() == P.sc.select("Region").distinct().count() + 1
    publish(P.sc, f"{base}/lines", partition_by=["Year"])
    lines = spark.read.parquet(f"{base}/lines")
    assert lines.count() == P.sc.count()
    plan = lines.where("Year = 1996")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_materialize_and_cleanup(spark):
    from tillroll.session import cleanup_tables, materialize

    t = materialize(spark.range(10), "probe")
    assert t.count() == 10
    assert cleanup_tables(spark) is True
