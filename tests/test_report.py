"""The whole analysis runs as one multi-report job on the smallest tables."""

from tests.conftest import SF_SMALL
from tillroll.plans.report import full_report
from tillroll.sources.retail import retail_from_tables


def test_full_report(spark):
    reps = full_report(retail_from_tables(spark, SF_SMALL), with_clustering=False)
    assert len(reps) >= 50
    for name, df in reps.items():
        df.write.format("noop").mode("overwrite").save()
    assert reps["kpi_clean"].count() == 6 and reps["forecast"].count() == 24
