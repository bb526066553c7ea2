"""Populations added up from masks, quantiles from brackets, duplicates behind a key filter."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_plans import scans
from tillroll.operators import brackets, kpi, lattice, quality
from tillroll.plans.catalog import QUERIES, pops


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(abs(a), abs(b)))


def test_populations_equal_their_filters(spark):
    P = pops(spark, SF_SMALL, True)
    got = {r["population"]: r for r in lattice.population_table(P.sc_z).collect()}
    assert set(got) == set(lattice.memberships())
    for name in ("sc", "pos", "neg", "out", "bulk", "noout", "noout_pos", "nolow"):
        one = P.population(name).agg(
            F.count(F.lit(1)).alias("n_lines"), kpi.n_distinct_with_null(F.col("CustomerID")).alias("customers"),
            *(f(x).alias(f"{n}_{x}") for x in lattice.AMOUNTS for n, f in
              (("sum", F.sum), ("mean", F.avg), ("sd", F.stddev_samp)))).first().asDict()
        assert all(close(got[name][k], v) for k, v in one.items()), name


def test_impact_by_brackets_equals_the_small_path(spark):
    P = pops(spark, SF_SMALL, True, ["CustomerID", "Quantity", "Price", "TotalSales"])
    small, large = (lattice.impact_table(P.sc_z, "pos", "nolow", "a", "b", limit=n).collect() for n in (1 << 20, 0))
    assert all(x[0] == y[0] and close(x[1], y[1]) and close(x[2], y[2]) for x, y in zip(small, large, strict=True))


def test_population_edges(spark):
    rows = [(1.0, 1.0, 1.0, 0.0, None), (None, None, None, None, 7), (2.0, 3.0, 6.0, 0.5, 7), (-1.0, 2.0, -2.0, None, 8)]
    df = spark.createDataFrame(rows, "Quantity double, Price double, TotalSales double, z_score double, CustomerID long")
    got = {r["population"]: r.asDict() for r in lattice.population_table(df).collect()}
    assert got["sc"]["n_lines"] == 4 and got["sc"]["customers"] == 3 and close(got["sc"]["mean_TotalSales"], 5 / 3)
    assert got["neg"]["n_lines"] == 1 and got["neg"]["sd_TotalSales"] is None and got["neg"]["mean_Quantity"] == -1.0
    assert got["out"] == {"population": "out", "n_lines": 0, "customers": 0} | {
        f"{a}_{x}": None for a in ("sum", "mean", "sd") for x in lattice.AMOUNTS}
    empty = lattice.impact_table(df.where("1 = 0"), "pos", "nolow", "a", "b", limit=-1).collect()
    assert [r["Metric"] for r in empty] == ["Total Sales", "Mean Sales", "Median Sales", "Total Quantity", "Unique Customers"]
    assert empty[0]["a"] is None and empty[4]["b"] == 0.0


def test_deviation_without_cancellation(spark):
    df = spark.range(1000).select((F.col("id") % 2 + 1e9).alias("Quantity"), F.lit(1.0).alias("Price"), F.lit(1.0).alias("TotalSales"),
                                  F.when(F.col("id") % 3 == 0, 9.0).otherwise(0.0).alias("z_score"), F.col("id").alias("CustomerID"))
    got = lattice.population_table(df, ["sc", "out"]).where("population = 'sc'").first()["sd_Quantity"]
    assert abs(got - statistics.stdev([i % 2 for i in range(1000)])) < 1e-6


def test_one_scan_of_the_source(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for name in ("q_population_table", "q_impact_bulk", "q_impact_low", "q_metrics_wo_outliers", "q_metrics_by_mask",
                     "q_dup_keys", "q_dup_exact", "q_outlier_counts"):
            assert scans(spark, lambda: QUERIES[name](spark, SF_SMALL)) == 1, name
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_duplicates_with_a_full_filter(spark, slots):
    """One slot: every row passes the filter, and the exact step decides alone."""
    rows = [("a", 1.0), ("a", 1.0), ("a", 2.0), (None, 1.0), (None, 1.0), ("b", None), ("b", 0.0), ("b", -0.0), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = sorted(map(tuple, quality.duplicate_members(df, ["k", "v"], slots=slots).collect()), key=repr)
    assert got == sorted([("a", 1.0), ("a", 1.0), (None, 1.0), (None, 1.0), ("b", 0.0), ("b", -0.0)], key=repr)
    assert quality.duplicate_members(df.where("1 = 0"), ["k"], slots=slots).count() == 0


def bracket_case(spark, n=20000):
    draw = random.Random(5)
    rows = [(draw.choice(["u", "v", None]), draw.lognormvariate(0, 3), float(draw.randrange(5)), None if draw.random() < .3 else -draw.random())
            for _ in range(n)]
    rows += [("only null", None, None, None), ("one", 3.5, 1.0, None)]
    return rows, spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(7)


@pytest.mark.parametrize("window_limit", [1 << 20, 0])
def test_bracketed_quantiles_are_exact(spark, window_limit):
    rows, df = bracket_case(spark, 20000 if window_limit else 4000)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = brackets.bracketed_quantiles(
        df, F.col("g"), lambda g: F.array(g, F.lit("all")), {x: F.col(x) for x in "abc"}, probs,
        sketch_k=64, window_limit=window_limit)
    got = {(r["set"], r["metric"], r["p"]): r["q"] for r in got.collect()}
    want = {}
    for label in ("u", "v", None, "only null", "one", "all"):
        for at, x in enumerate("abc", 1):
            values = [r[at] for r in rows if r[at] is not None and (label == "all" or r[0] == label)]
            if values:
                want |= {(label, x, p): float(np.quantile(values, p)) for p in probs}
    assert set(got) == set(want) and all(close(got[k], want[k]) for k in want)


def test_wrong_brackets_are_found(spark, monkeypatch):
    """Brackets that miss their ranks are answered from all rows of the set."""
    rows, df = bracket_case(spark, 3000)
    plain = brackets._brackets

    def shifted(*args):
        return plain(*args).withColumns({"lo": F.col("hi") + 1, "hi": F.col("hi") + 2})
    monkeypatch.setattr(brackets, "_brackets", shifted)
    got = brackets.bracketed_quantiles(df, F.col("g"), lambda g: F.array(F.lit("all")), {"a": F.col("a")}, [0.5]).collect()
    assert len(got) == 1 and close(got[0]["q"], statistics.median(r[1] for r in rows if r[1] is not None))


def test_bracketed_quantiles_of_nothing(spark):
    _, df = bracket_case(spark, 10)
    for some in (df.where("1 = 0"), df.where("g = 'only null'")):
        got = brackets.bracketed_quantiles(some, F.col("g"), lambda g: F.array(g), {"a": F.col("a")}, [0.5])
        assert got.columns == ["set", "metric", "p", "q"] and got.collect() == []
