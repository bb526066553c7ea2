"""Micro fixtures for the semantic traps (hand-written rows, expected values
written by hand)."""

import datetime as dt

from pyspark.sql import functions as F

from tillroll.functions.columns import parse_invoice_date, region_of, weekday_mon1
from tillroll.operators import clean, customers, distribution, kpi, quality, timeseries

RAW_SCHEMA = ("src_rank int, Invoice string, StockCode string, Description string, "
              "Quantity double, InvoiceDate timestamp, Price double, CustomerID long, "
              "Country string")
D1 = dt.datetime(2010, 1, 4, 10, 0)
D2 = dt.datetime(2010, 1, 5, 10, 0)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_t1_keep_first_file(spark):
    df = raw(spark, [(2, "A", "S", "second", 1.0, D1, 2.0, 7, "France"),
                     (1, "A", "S", "first", 1.0, D1, 2.0, 7, "France")])
    out = clean.dedup_first(df).collect()
    assert len(out) == 1 and out[0]["Description"] == "first" and out[0]["src_rank"] == 1


def test_t2_dedup_key_ignores_date(spark):
    df = raw(spark, [(1, "A", "S", "x", 1.0, D1, 2.0, 7, "France"),
                     (1, "A", "S", "x", 1.0, D2, 2.0, 7, "France")])
    out = clean.dedup_first(df).collect()
    assert len(out) == 1 and out[0]["InvoiceDate"] == D1


def test_dedup_null_keys_equal(spark):
    df = raw(spark, [(1, "A", "S", "x", 1.0, D1, 2.0, None, "France"),
                     (2, "A", "S", "y", 1.0, D1, 2.0, None, "France")])
    assert clean.dedup_first(df).count() == 1


def test_t3_t4_region_first_match(spark):
    df = spark.createDataFrame([("Lithuania",), ("Israel",), (None,), ("Atlantis",), ("USA",)],
                               "Country string")
    got = [r[0] for r in df.select(region_of("Country")).collect()]
    assert got == ["EU", "APAC", "Other", "Other", "NA/LATAM"]


def test_t4_null_safe_anti_join(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "Quantity double")
    for drop, keep in [([2.0], {1.0, None}), ([2.0, None], {1.0})]:
        out = spark.createDataFrame([(v,) for v in drop], "Quantity double").distinct()
        kept = df.join(out, df["Quantity"].eqNullSafe(out["Quantity"]), "left_anti")
        assert {r[0] for r in kept.collect()} == keep


def _sc_rows(spark, rows):
    """rows: (Invoice, Quantity, Price, CustomerID) -> SC-like frame."""
    full = [(1, inv, f"S{i}", "d", q, D1, p, cid, "France") for i, (inv, q, p, cid) in enumerate(rows)]
    return clean.clean_lines(raw(spark, full))


def test_t5_guests_one_group(spark):
    sc = _sc_rows(spark, [("1", 1.0, 2.0, None), ("2", 3.0, 2.0, None), ("3", 1.0, 1.0, 9)])
    f = customers.customer_features(sc).collect()
    assert len(f) == 2
    guest = [r for r in f if r["CustomerID"] is None][0]
    assert guest["PurchaseFrequency"] == 2 and guest["TotalSales"] == 8.0


def test_t6_bulk_thresholds(spark):
    sc = _sc_rows(spark, [("1", 24.0, 1.0, 1), ("2", 25.0, 1.0, 1), ("3", 26.0, 1.0, 1)])
    assert sc.where(F.col("Quantity") > 25).count() == 1
    z = clean.with_zscore(sc)
    assert clean.bulk_lines(z).count() == 2


def test_t8_line_count_vs_customers(spark):
    sc = _sc_rows(spark, [("1", 1.0, 1.0, 5), ("2", 1.0, 1.0, 5), ("3", 1.0, 1.0, 5)])
    r = customers.guest_mix(sc).collect()[0]
    assert r["line_count"] == 3 and r["customer_count"] == 1 and r["CustomerType"] == "Unique"


def test_t10_compat_average(spark):
    sc = _sc_rows(spark, [("1", 10.0, 1.0, 5), ("2", 30.0, 1.0, 5)])
    compat = customers.customer_features(sc).collect()[0]
    true = customers.customer_features(sc, compat=False).collect()[0]
    assert compat["TotalSales"] == 40.0 and compat["AverageOrderSize"] == 40.0
    assert true["AverageOrderSize"] == 20.0


def test_t11_positions_and_gap_fill(spark):
    daily = spark.createDataFrame(
        [("s", dt.date(2020, 1, d), float(d)) for d in (1, 2, 5)],
        "series string, InvoiceDate date, TotalSales double")
    pos = timeseries.with_position(daily, "InvoiceDate").orderBy("t").collect()
    assert [r["t"] for r in pos] == [1, 2, 3]
    filled = timeseries.fill_gaps(daily).orderBy("InvoiceDate").collect()
    assert len(filled) == 5 and filled[2]["TotalSales"] == 0.0


def test_t15_constant_minmax_is_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "Quantity double")
    out = clean.minmax_columns(df, ["Quantity"]).collect()
    assert all(r["Quantity_MinMax"] is None for r in out)


def test_t18_description_only_in_summary(spark):
    df = raw(spark, [(1, "A", "S", None, 1.0, D1, 2.0, 7, "France")])
    assert quality.missing_rows(df).count() == 0
    summ = {r["Column"]: r["Missing_Count"] for r in kpi.missing_summary(df).collect()}
    assert summ == {"missing_Description": 1}


def test_t19_distinct_with_and_without_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    r = df.agg(F.count_distinct("x").alias("a"), kpi.n_distinct_with_null(F.col("x")).alias("b")).first()
    assert (r["a"], r["b"]) == (1, 2)


def test_a30_histogram_bins(spark):
    df = spark.createDataFrame([(150.0,), (150.01,)], "x double")
    # 150 is the minimum and sits on a lower edge: it joins the first bin (include-lowest)
    bins = sorted((r["bin"], r["count"]) for r in distribution.histogram(df, F.col("x"), 100.0).collect())
    assert bins == [(2, 2)]
    df2 = spark.createDataFrame([(120.0,), (150.0,), (150.01,)], "x double")
    bins2 = sorted((r["bin"], r["count"]) for r in distribution.histogram(df2, F.col("x"), 100.0).collect())
    assert bins2 == [(1, 2), (2, 1)]


def test_x13_lenient_date_parse(spark):
    df = spark.createDataFrame([("12/1/2009 7:45",), ("bad",)], "d string")
    got = [r[0] for r in df.select(parse_invoice_date("d")).collect()]
    assert got == [dt.datetime(2009, 12, 1, 7, 45), None]


def test_x16_monday_is_one(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 11, 30, 12, 0),)], "d timestamp")
    assert df.select(weekday_mon1("d")).first()[0] == 1


def test_a7_single_row_sd_null(spark):
    sc = _sc_rows(spark, [("1", 2.0, 3.0, 1)])
    r = kpi.kpi_table(sc).where("Region = 'Overall'").first()
    assert r["SD_Total_Sales"] is None and r["Median_Total_Sales"] == 6.0


def test_multi_region_first_appearance(spark):
    rows = [(2, "1", "S1", "d", 1.0, D1, 1.0, 5, "France"),
            (1, "2", "S2", "d", 1.0, D2, 1.0, 5, "USA"),
            (1, "3", "S3", "d", 1.0, D2, 1.0, 5, "Japan"),
            (1, "4", "S4", "d", 1.0, D1, 1.0, 6, "Japan")]
    sc = clean.clean_lines(raw(spark, rows))
    out = {r["CustomerID"]: r["Regions"] for r in customers.multi_region_customers(sc).collect()}
    assert out == {5: "NA/LATAM, APAC, EU"}


def test_j3_lookup_join_equals_case_chain(spark):
    from tillroll.functions.columns import add_region_by_lookup, region_lookup_table

    df = spark.createDataFrame([("Lithuania",), ("Israel",), (None,), ("Atlantis",), ("USA",),
                                ("Nigeria",), ("EIRE",)], "Country string")
    a = {r[0]: r[1] for r in df.select("Country", region_of("Country").alias("R")).collect()}
    b = {r[0]: r[1] for r in add_region_by_lookup(df, region_lookup_table(spark)).collect()}
    assert a == b


def test_a30_histogram_fill_empty(spark):
    df = spark.createDataFrame([(120.0,), (480.0,), (510.0,)], "x double")
    got = sorted((r["bin"], r["count"]) for r in
                 distribution.histogram(df, F.col("x"), 100.0, fill_empty=True).collect())
    assert got == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 2)]


def test_amounts_below_a_cent_count(spark):
    """Means and sums take every line as it is: 3 x 0.001, 4 x 0.001, 1 x 0.004."""
    from tillroll.operators import customers, timeseries

    df = spark.createDataFrame(
        [(1, "a", "EU", 3.0, 0.001), (1, "b", "EU", 4.0, 0.001), (1, "c", "EU", 1.0, 0.004)],
        "CustomerID long, Invoice string, Region string, Quantity double, Price double").withColumn(
        "TotalSales", F.col("Quantity") * F.col("Price")).withColumn("InvoiceDate", F.to_timestamp(F.lit("2010-01-01")))
    row = kpi.kpi_table(df).where("Region = 'EU'").first()
    assert abs(row["Mean_Total_Sales"] - 0.011 / 3) < 1e-15
    assert abs(timeseries.daily_sales(df).first()["TotalSales"] - 0.011) < 1e-15
    assert abs(timeseries.monthly_sales(df, "x").first()["TotalSales"] - 0.011) < 1e-15
    assert abs(customers.customer_features(df).first()["TotalSales"] - 0.011) < 1e-15
    thirds = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "Quantity double")
    assert abs(kpi.bulk_impact(thirds).first()[0] - 4 / 3) < 1e-15


def test_keep_first_goes_by_the_date_a_text_names(spark):
    rows = [("1", "s", "oct", 1.0, "10/1/2010 9:00", 2.0, 7, "France", 1),
            ("1", "s", "sep", 1.0, "9/1/2010 9:00", 2.0, 7, "France", 1),
            ("1", "s", "undated", 1.0, None, 2.0, 7, "France", 1),
            ("2", "s", "undated", 1.0, "soon", 2.0, 7, "France", 1),
            ("2", "s", "dated", 1.0, "12/31/2010 23:59:58", 2.0, 7, "France", 1)]
    df = spark.createDataFrame(rows, "Invoice string, StockCode string, Description string, Quantity double, "
                                     "InvoiceDate string, Price double, CustomerID long, Country string, src_rank int")
    got = {r["Invoice"]: (r["Description"], r["InvoiceDate"]) for r in clean.dedup_first(df).collect()}
    assert got["1"][0] == "sep" and got["2"][0] == "dated"
    sc = {r["Invoice"]: r["InvoiceDate"] for r in clean.clean_lines(df).collect()}
    assert sc["2"].second == 58


def test_split_keys_that_differ_have_different_hashes(spark):
    from tillroll.operators.inference import row_hash

    rows = [("1", "a", 1.0, 0.001, 5), ("1", "a", 1.0, 0.002, 5), ("1", "a", 1.0, 0.001, None), ("1", None, 1.0, 0.001, 5),
            ("1", "", 1.0, 0.001, 5), ("1|1:a", "a", 1.0, 0.001, 5), ("1", "a", 1e-13, 0.001, 5), ("1", "a", 0.0, 0.001, 5)]
    df = spark.createDataFrame(rows, "Invoice string, StockCode string, Quantity double, Price double, CustomerID long")
    assert df.select(row_hash()).distinct().count() == len(rows)
