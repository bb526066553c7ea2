"""The distributed order-statistics operator against Spark's exact percentile,
including forced refinement passes, a hot group, ties, nulls and tiny groups."""

import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators.order_stats import exact_quantiles


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(20000):
        g = "hot" if i % 3 else rnd.choice(["a", "b", "c"])    # "hot" holds 2/3 of rows
        v = None if i % 97 == 0 else float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1e6]))
        rows.append((g, v))
    rows += [("single", 5.0), ("allnull", None), ("ties", 1.0), ("ties", 1.0), ("ties", 2.0)]
    return spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize("kw", [{}, {"buckets": 64, "final_limit": 500},
                                {"buckets": 4, "final_limit": 8}, {"cache": True}])
def test_matches_builtin(spark, data, kw):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(data, ["g"], "x", probs, **kw).collect()}
    exp = data.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect()
    n = 0
    for r in exp:
        if r["q"] is None:
            assert not any(k[0] == r["g"] for k in got)
            continue
        for p, q in zip(probs, r["q"]):
            assert got[(r["g"], p)] == pytest.approx(q, rel=1e-12, abs=1e-12)
            n += 1
    assert n == 6 * len(probs)


def test_global_quantiles(spark, data):
    got = exact_quantiles(data, [], "x", [0.5]).first()["q"]
    exp = data.agg(F.median("x")).first()[0]
    assert got == pytest.approx(exp, rel=1e-12)


def test_null_group_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 7.0), ("a", 9.0)],
                               "g string, x double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", [0.5]).collect()}
    assert got == {None: 2.0, "a": 7.0}
    forced = {r["g"]: r["q"] for r in
              exact_quantiles(df, ["g"], "x", [0.5], buckets=2, final_limit=1).collect()}
    assert forced == got
