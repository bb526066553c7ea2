"""Invariants from the survey's test strategy, on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.functions.columns import ln_pos
from tillroll.operators import clean, clustering, customers, inference, kpi, timeseries
from tillroll.plans.catalog import pops


@pytest.fixture(scope="module")
def P(spark):
    return pops(spark, SF_SMALL, materialize=True)


def test_split_partitions_clean_lines(P):
    s = inference.stratified_split(P.sc)
    n = P.sc.count()
    tr, te = s.where("is_train").count(), s.where("NOT is_train").count()
    assert tr + te == n and s.count() == n
    per = inference.split_summary(s).collect()
    for r in per:
        assert r["n_train"] == -(-r["n"] * 8 // 10)   # ceil(0.8 n)


def test_region_line_counts_sum_to_overall(P):
    g = P.sc.groupBy("Region").count().agg(F.sum("count")).first()[0]
    assert g == P.sc.count()
    t = {r["Region"]: r for r in kpi.kpi_table(P.sc).collect()}
    assert "Overall" in t and len(t) == 1 + P.sc.select("Region").distinct().count()


def test_outliers_partition(P):
    n_out = clean.outliers(P.sc_z).count()
    assert n_out + P.noout.count() == P.sc.count()


def test_anti_join_equals_no_outliers(P):
    # z is a function of Quantity, so dropping outlier Quantity values == NOOUT
    t = kpi.metrics_with_without_outliers(P.sc, P.sc_z).where("Outliers = 'Without Outliers'").first()
    r = P.noout.agg(F.avg("Quantity"), F.stddev_samp("Quantity")).first()
    assert t["mean_quantity"] == pytest.approx(r[0]) and t["sd_quantity"] == pytest.approx(r[1])


def test_anova_invariant_to_scaling(P):
    df = customers.zscale(P.pos, ["TotalSales"], "_z")
    a = {r["term"]: r for r in inference.anova_oneway(df, F.col("TotalSales")).collect()}
    b = {r["term"]: r for r in inference.anova_oneway(df, F.col("TotalSales_z")).collect()}
    assert a["group"]["F_value"] == pytest.approx(b["group"]["F_value"], rel=1e-9)


def test_anova_pvalue_in_range(P):
    r = inference.anova_oneway(P.noout_pos, ln_pos("TotalSales"), with_pvalue=True) \
        .where("term = 'group'").first()
    assert 0.0 <= r["P_value"] <= 1.0


def test_decomposition_adds_up(P):
    d = timeseries.with_position(timeseries.daily_sales(P.sc, "s"), "InvoiceDate")
    dec = timeseries.decompose(d, "TotalSales")
    bad = dec.where(F.col("trend").isNotNull() & (F.abs(
        F.col("trend") + F.col("seasonal") + F.col("remainder") - F.col("TotalSales")) > 1e-6))
    assert bad.count() == 0
    figs = dec.select(((F.col("t") - 1) % 30).alias("pos"), "seasonal").distinct()
    assert abs(figs.agg(F.sum("seasonal")).first()[0]) < 1e-6


def test_ols_matches_mllib(P):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = P.sc.select("Quantity", "Price", "TotalSales")
    mine = inference.ols2(df, "TotalSales", "Quantity", "Price").first()
    v = VectorAssembler(inputCols=["Quantity", "Price"], outputCol="f").transform(df)
    m = LinearRegression(featuresCol="f", labelCol="TotalSales", solver="normal",
                         regParam=0.0, standardization=False).fit(v)
    assert mine["intercept"] == pytest.approx(m.intercept, rel=1e-6, abs=1e-6)
    assert mine["b_Quantity"] == pytest.approx(m.coefficients[0], rel=1e-6)
    assert mine["b_Price"] == pytest.approx(m.coefficients[1], rel=1e-6)


def test_segmentation_invariants(P):
    f = customers.customer_features(P.pos).drop("distinct_orders")
    vecs = clustering.scaled_vectors(f).persist()
    el = {r["k"]: r["wss"] for r in clustering.elbow(vecs, ks=[1, 2, 3, 4], starts=4).collect()}
    assert el[1] == pytest.approx(clustering.total_ss(vecs), rel=1e-6)
    assert el[1] >= el[2] - 1e-6 and el[2] >= el[3] * 0.999
    lab, cost = clustering.segment(f, starts=5)
    prof = clustering.cluster_profile(lab).collect()
    for r in prof:      # compat features: AverageOrderSize == TotalSales
        assert r["AverageSales"] == pytest.approx(r["AvgOrderSize"])
    pcs = lab.agg(*[F.var_samp(f"PC{i}") for i in (1, 2, 3)]).first()
    assert pcs[2] == pytest.approx(0.0, abs=1e-9)      # identical columns: rank 2
    best_mllib = clustering.kmeans_best_mllib(vecs, 3, 3)[0]
    assert cost <= best_mllib * 1.05
    vecs.unpersist()


def _points(spark, rows):
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame(rows, "a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="scaled").transform(df)


def test_kmeans_draws_from_all_rows_and_refuses_too_few(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(float(x), float(y)) for c in ((0, 0), (10, 0), (0, 10)) for x, y in rng.normal(c, 0.1, (400, 2))]
    wss, centers = clustering.kmeans_best(_points(spark, rows), 3, 5)
    assert sorted(map(tuple, np.round(centers))) == [(0, 0), (0, 10), (10, 0)] and wss < 40
    few = _points(spark, [(1.0, 1.0)] * 50 + [(2.0, 2.0)])
    with pytest.raises(ValueError):
        clustering.kmeans_best(few, 3, 2)
    wss, centers = clustering.kmeans_best(few, 2, 2)
    assert wss == 0 and sorted(map(tuple, centers)) == [(1, 1), (2, 2)]
    with pytest.raises(RuntimeError):
        clustering.multi_start_kmeans(_points(spark, rows), [3], 3, max_iter=1)


def test_kmeans_moves_an_empty_cluster(spark, monkeypatch):
    starts = [[[0.0, 0.0], [100.0, 100.0], [200.0, 200.0]]]
    monkeypatch.setattr(clustering, "_starting_rows", lambda *a: starts)
    rows = [(0.0, 0.0), (0.1, 0.0), (5.0, 0.0), (5.1, 0.0), (0.0, 9.0)]
    table, centers = clustering.multi_start_kmeans(_points(spark, rows), [3], 1)
    assert table["wss"][0] < 0.02 and len({tuple(c) for c in centers[0]}) == 3


def test_chosen_forecast_is_not_the_worst(P):
    for pop in (P.pos, P.noout_pos):
        acc = timeseries.forecast_accuracy(timeseries.monthly_sales(pop, "s")).collect()
        assert len({r["m"] for r in acc}) == 1
        chosen = next(r for r in acc if r["chosen"])
        assert chosen["rmse"] < max(r["rmse"] for r in acc)
        fitted = timeseries.fitted_values(timeseries.monthly_sales(pop, "s")).orderBy("Date").collect()
        scored = [r["residual"] for r in fitted][-chosen["m"]:]
        assert (sum(e * e for e in scored) / len(scored)) ** 0.5 == pytest.approx(chosen["rmse"], rel=1e-9)


def test_short_series_still_get_a_forecast(spark):
    rows = [("s", t, float(10 + t % 3)) for t in range(1, 11)]
    m = spark.createDataFrame(rows, "series string, t int, TotalSales double").withColumn(
        "Date", F.expr("add_months(DATE '2010-01-01', t - 1)"))
    assert {r["model"] for r in timeseries.forecast_accuracy(m).collect()} >= {"ar1", "ar1_diff", "drift", "mean"}
    assert timeseries.forecast(m).count() == 12


def test_reports_come_out_in_order(spark):
    from tillroll.plans.catalog import QUERIES

    for name, keys in (("q_daily_sales", ["InvoiceDate"]), ("q_monthly_sales", ["series", "Date"]),
                       ("q_guest_mix", ["Region", "CustomerType"]), ("q_region_avg_bulk", ["Bulk Order", "region"])):
        rows = [tuple(r[k] for k in keys) for r in QUERIES[name](spark, SF_SMALL).collect()]
        assert rows == sorted(rows, key=lambda r: tuple((x is None, x) for x in r)), name
    first = QUERIES["q_kpi_clean"](spark, SF_SMALL).collect()
    last = QUERIES["q_kpi_positive"](spark, SF_SMALL).collect()
    assert first[0]["Region"] == "Overall" == last[-1]["Region"]


def test_bounds_are_checked(spark):
    from tillroll.operators import distribution

    df = spark.createDataFrame([(0.0,), (1e9,)], "x double")
    with pytest.raises(Exception, match="bins"):
        distribution.histogram(df, F.col("x"), 1.0, fill_empty=True).collect()
    many = spark.range(300).select(F.col("id").cast("string").alias("Region"), F.rand(1).alias("y"))
    with pytest.raises(Exception, match="groups"):
        inference.tukey_hsd(many, F.col("y")).collect()


def test_forecast_shape(P):
    m = timeseries.monthly_sales(P.pos, "positive")
    fc = timeseries.forecast(m).collect()
    assert len(fc) == 12 and all(r["lo95"] <= r["forecast"] <= r["hi95"] for r in fc)


def _blobs(spark, seed, n=300):
    import numpy as np

    rng = np.random.default_rng(seed)
    return _points(spark, [(float(a), float(b)) for a, b in rng.random((n, 2))])


def test_row_changes_never_end_above_lloyd(spark):
    lower = 0
    for seed in range(3):
        vecs = _blobs(spark, seed, 60)
        plain, _ = clustering.multi_start_kmeans(vecs, [4, 6], 6, exchange=False)
        full, centers = clustering.multi_start_kmeans(vecs, [4, 6], 6)
        assert (full["wss"] <= plain["wss"] * (1 + 1e-12)).all()
        lower += int((full["wss"] < plain["wss"] * (1 - 1e-9)).sum())
        x = [tuple(r["scaled"]) for r in vecs.collect()]
        for run, cen in centers.items():
            _assert_no_row_should_move(x, cen, full["wss"][run])
    assert lower > 0


def _assert_no_row_should_move(x, cen, wss):
    import numpy as np

    x = np.array(x)
    d2 = ((x[:, None, :] - cen[None]) ** 2).sum(axis=2)
    lab = d2.argmin(axis=1)
    assert d2.min(axis=1).sum() == pytest.approx(wss, rel=1e-9)
    size = np.bincount(lab, minlength=len(cen))
    for c in range(len(cen)):
        assert np.allclose(x[lab == c].mean(axis=0), cen[c], atol=1e-6)
    for i, a in enumerate(lab):
        if size[a] > 1:
            leave = size[a] / (size[a] - 1) * d2[i, a]
            join = np.delete(size / (size + 1) * d2[i], a)
            assert leave - join.min() <= 1e-8 * wss


def test_a_row_change_leaves_a_lloyd_optimum(spark):
    # four rows on a line: {0}, {2, 3.1, ...} stands still under Lloyd, and one change lowers it
    vecs = _points(spark, [(0.0, 0.0), (0.0, 0.0), (1.05, 0.0), (2.0, 0.0)])
    starts = [[[0.35, 0.0], [2.0, 0.0]]]
    x = [0.0, 0.0, 1.05, 2.0]
    assert abs(x[2] - 0.35) < abs(x[2] - 2.0)                  # stands still under Lloyd
    stay = sum((v - 0.35) ** 2 for v in x[:3])
    go = 2 * 0.475 ** 2
    assert go < stay
    old = clustering._starting_rows
    clustering._starting_rows = lambda *a: starts
    try:
        plain, _ = clustering.multi_start_kmeans(vecs, [2], 1, exchange=False)
        full, centers = clustering.multi_start_kmeans(vecs, [2], 1)
    finally:
        clustering._starting_rows = old
    assert plain["wss"][0] == pytest.approx(stay) and full["wss"][0] == pytest.approx(go)
    assert sorted(map(tuple, centers[0])) == [(0.0, 0.0), (pytest.approx(1.525), 0.0)]


def test_fixed_start_takes_the_smallest_keys(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(3, 9.0, 9.0), (None, 0.0, 0.0), (1, 1.0, 1.0), (2, 5.0, 5.0)], "id int, a double, b double")
    vecs = VectorAssembler(inputCols=["a", "b"], outputCol="scaled").transform(df)
    assert clustering._first_rows(vecs, "id", 2, "scaled") == [[1.0, 1.0], [5.0, 5.0]]
    with pytest.raises(ValueError):
        clustering.multi_start_kmeans(vecs, [5], 1, start_key="id")


def test_kmeans_rows_are_dealt_to_tasks_by_their_number(spark):
    from tillroll.operators import clustering

    one = spark.range(60_000).coalesce(1)
    assert clustering._dealt(one, 60_000).rdd.getNumPartitions() == 3
    assert clustering._dealt(spark.range(0, 100, 1, 8), 100).rdd.getNumPartitions() == 1
    assert clustering._dealt(one, 60_000).distinct().count() == 60_000
