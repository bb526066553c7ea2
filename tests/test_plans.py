"""Physical-plan checks: pruning reaches the scans, no Python in row paths,
windows never run as one un-partitioned task over line data."""

from tests.conftest import SF_SMALL
from tillroll.operators import customers, kpi, timeseries
from tillroll.plans.catalog import pops


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_lines_pruned_and_jvm_only(spark):
    p = plan(pops(spark, SF_SMALL).sc)
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    # lineitem is read with only the columns the recipe needs
    li = [ln for ln in p.splitlines() if "lineitem" in ln and "ReadSchema" in ln]
    assert li and all("l_shipdate" not in ln and "l_suppkey" not in ln for ln in li)


def test_filters_pushed_to_scan(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_custkey > 10")
    assert "PushedFilters: [IsNotNull(o_custkey), GreaterThan(o_custkey,10)]" in plan(df)


def test_no_unpartitioned_window_on_lines(spark):
    P = pops(spark, SF_SMALL)
    for df in [kpi.kpi_table(P.sc, approx_median=True), P.noout,
               customers.multi_region_customers(P.sc), customers.churn(P.sc, as_of=None)]:
        wins = [ln for ln in plan(df).splitlines() if "Window [" in ln]
        # every window over line data is partitioned (never one global task)
        assert all("windowspecdefinition(" in ln and "specifiedwindowframe" in ln for ln in wins)
        assert not any("windowspecdefinition(" + "InvoiceDate" in ln for ln in wins)


def test_series_windows_are_partitioned(spark):
    P = pops(spark, SF_SMALL)
    two = timeseries.daily_sales(P.sc, "clean").unionByName(timeseries.daily_sales(P.noout, "noout"))
    p = plan(timeseries.decompose(timeseries.with_position(two, "InvoiceDate"), "TotalSales"))
    wins = [ln for ln in p.splitlines() if "Window [" in ln]
    assert wins and all("windowspecdefinition(series" in ln for ln in wins)


def test_group_stats_join_back_is_broadcast(spark):
    """A hot series (here: every row in one of two series) must not be joined
    back to its statistics through a shuffle on the series key."""
    from pyspark.sql import functions as F

    from tillroll.operators import distribution

    P = pops(spark, SF_SMALL)
    long = P.sc.select(F.when(F.col("Quantity") > 0, "hot").otherwise("cold").alias("series"),
                       F.col("Quantity").cast("double").alias("x"))
    p = plan(distribution.box_stats(long, F.col("x"), by=["series"]))
    assert "BroadcastHashJoin" in p


def test_population_filters_reach_materialised_scan(spark):
    P = pops(spark, SF_SMALL, materialize=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # untruncated scan line
    try:
        p = plan(P.pos.select("TotalSales"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = [ln for ln in p.splitlines() if "PushedFilters" in ln]
    assert scan and "GreaterThanOrEqual(TotalSales,0.0)" in scan[0] \
        and "GreaterThanOrEqual(Quantity,0.0)" in scan[0]
    assert "ReadSchema: struct<Quantity:double,TotalSales:double>" in scan[0]


def scans(spark, run, table="lineitem"):
    """How many scans of a table the jobs of ``run`` have, its result written included."""
    seen = []
    from pyspark.sql import DataFrameWriter

    plain = DataFrameWriter.parquet

    def spy(self, *args, **kw):
        seen.append(plan(self._df))
        return plain(self, *args, **kw)
    DataFrameWriter.parquet = spy
    try:
        out = run()
        seen.append(plan(out))
    finally:
        DataFrameWriter.parquet = plain
    return sum(ln.count(f"/{table}.parquet") for p in seen for ln in p.splitlines() if "ReadSchema" in ln)


def test_reports_read_their_source_once(spark):
    from tillroll.plans.catalog import QUERIES

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for name in ("q_hist_total_sales", "q_hist_log_sales", "q_hist_log_sales_no_outliers", "q_hist_negative",
                     "q_outlier_lines", "q_head_clean", "q_scaled_lines", "q_kpi_clean", "q_kpi_no_outliers"):
            assert scans(spark, lambda: QUERIES[name](spark, SF_SMALL)) == 1, name
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_key_figures_multiply_no_rows(spark):
    P = pops(spark, SF_SMALL, True)
    for pop in (P.sc, P.noout, P.scaled):
        assert "Expand [" not in plan(kpi.kpi_table(pop)) and "Expand" not in plan(kpi.kpi_table(pop, limit=0))


def test_large_key_figures_equal_small_ones(spark):
    P = pops(spark, SF_SMALL, True)
    for pop in (P.sc, P.neg):
        small, large = (kpi.kpi_table(pop, limit=n).collect() for n in (1 << 20, 0))
        for a, b in zip(small, large, strict=True):
            assert all(x == y or abs(x - y) <= 1e-9 * abs(x) for x, y in zip(a[1:], b[1:])) and a[0] == b[0]


def test_distinct_counts_by_bits(spark):
    import pytest

    rows = [("EU", 1, "a"), ("APAC", 1, "a"), (None, 2, "b"), ("EU", None, "c"), ("EU", None, None), ("APAC", None, None),
            ("EU", 3, None), ("EU", None, "a")]
    df = spark.createDataFrame(rows, "Region string, CustomerID long, Invoice string")
    got = {r["_group"]: tuple(r)[2:] for r in kpi.distinct_by_group(df, "Region", ["EU", "APAC"], "all").collect()}
    # customers that aren't null; invoices of null customers and all invoices, a null one counting as one
    assert got == {"EU": (2, 3, 3), "APAC": (1, 1, 2), None: (1, 0, 1), "all": (3, 3, 4)}
    with pytest.raises(Exception, match="labels"):
        kpi.distinct_by_group(df, "Region", ["EU"], "all").collect()
    assert kpi.kpi_table(df.where("1 = 0").withColumns({"TotalSales": df.CustomerID * 1.0, "Quantity": df.CustomerID * 1.0})
                         ).collect()[0]["Unique_Customers"] == 0


def test_statistics_of_the_write_equal_those_read_back(spark):
    from tillroll.operators import clean
    from tillroll.session import materialize_with

    one, two = pops(spark, SF_SMALL, True), pops(spark, SF_SMALL)
    assert sorted(one.out.select("Invoice", "z_score").collect()) == sorted(two.out.select("Invoice", "z_score").collect())
    assert sorted(map(tuple, one.scaled.select("Invoice", "StockCode", "Price_MinMax").collect())) == sorted(
        map(tuple, two.scaled.select("Invoice", "StockCode", "Price_MinMax").collect()))
    table, seen = materialize_with(one.sc.where("1 = 0"), "empty", clean.line_statistics())
    assert table.count() == 0 and set(seen.values()) == {None}
