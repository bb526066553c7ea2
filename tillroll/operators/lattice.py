"""Figures of all named populations from one aggregate.

The populations of clean lines overlap (NOLOW is part of NOOUT_POS, which is part of NOOUT), so
that a filter and an aggregate for each reads the same lines again and again.  Here each line
gets the set of populations that it is in, as bits; lines are aggregated once per set (map-side
combined, at most 2^8 rows leave a task), and every population is added up from those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import config
from tillroll.operators.brackets import bracketed_quantiles
from tillroll.operators.order_stats import FINAL_LIMIT

AMOUNTS = ("TotalSales", "Quantity")


def memberships() -> dict[str, Column]:
    """Which clean lines with a ``z_score`` belong to each population."""
    q, price, sales, z = (F.col(x) for x in ("Quantity", "Price", "TotalSales", "z_score"))
    inside = F.abs(z) <= config.Z_OUTLIER
    whole = inside & (q >= 0) & (price >= 0)
    return {"sc": F.lit(True), "pos": (sales >= 0) & (q >= 0), "neg": sales < 0,
            "out": F.abs(z) > config.Z_OUTLIER, "bulk": q >= config.BULK_INCLUSIVE,
            "noout": inside, "noout_pos": whole, "nolow": whole & (sales >= config.LOW_ORDER)}


def with_mask(sc_z: DataFrame, names: Sequence[str]) -> DataFrame:
    """``_mask``: bit i is set where the line is in population ``names[i]`` (a condition that
    is null doesn't hold)."""
    known = memberships()
    bits = [F.when(known[n], F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)]
    return sc_z.withColumn("_mask", reduce(lambda a, b: a + b, bits))


def _in_mask(names: Sequence[str], mask: str = "_mask") -> Column:
    """The names of the populations of a mask, one row each."""
    held = F.array(*(F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)))
    return F.explode(F.filter(held, lambda x: x.isNotNull())).alias("population")


def _merged(parts: Column) -> Column:
    """(n, mean, m2) of the union of disjoint parts: counts, means and squared deviations
    are merged pairwise, without the cancellation of a difference of squares."""
    def merge(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"),
                        (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))
    none = F.struct(*(F.lit(0.0).alias(x) for x in ("n", "mean", "m2")))
    return F.aggregate(F.filter(parts, lambda p: p["n"] > 0), none, merge)


def population_table(sc_z: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per population (of ``names``; None: all): ``population, n_lines, customers``
    (distinct, a missing customer counting as one), and sum, mean and sample sd of TotalSales
    and Quantity.  ``sc_z`` are clean lines with a ``z_score``; they are read twice, once by mask
    and once by customer, whatever the number of populations.  A population without lines has
    counts 0 and null figures; a null amount is left out of its figures.
    """
    names = list(memberships() if names is None else names)
    lines = with_mask(sc_z, names).select("_mask", "CustomerID", *(F.col(x).cast("double").alias(x) for x in AMOUNTS))
    sums = []
    for x in AMOUNTS:
        n = F.count(x).cast("double")
        sums += [F.sum(x).alias(f"sum_{x}"), F.struct(
            n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2")).alias(f"part_{x}")]
    by_mask = lines.groupBy("_mask").agg(F.count(F.lit(1)).alias("n_lines"), *sums)
    figures = by_mask.select(_in_mask(names), *(c for c in by_mask.columns if c != "_mask")).groupBy("population").agg(
        F.sum("n_lines").alias("n_lines"), *(F.sum(f"sum_{x}").alias(f"sum_{x}") for x in AMOUNTS),
        *(_merged(F.collect_list(f"part_{x}")).alias(f"all_{x}") for x in AMOUNTS))
    seen = lines.groupBy("CustomerID").agg(F.bit_or("_mask").alias("_mask")).groupBy("_mask").agg(
        F.count(F.lit(1)).alias("n"))
    customers = seen.select(_in_mask(names), "n").groupBy("population").agg(F.sum("n").alias("customers"))
    out = sc_z.sparkSession.createDataFrame([(n,) for n in names], "population string")
    out = out.join(figures, "population", "left").join(customers, "population", "left")
    cells = []
    for x in AMOUNTS:
        n, one = F.col(f"all_{x}.n"), F.col(f"all_{x}")
        cells += [F.col(f"sum_{x}"), F.when(n > 0, one["mean"]).alias(f"mean_{x}"),
                  F.when(n > 1, F.sqrt(one["m2"] / (n - 1))).alias(f"sd_{x}")]
    return out.select("population", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_lines", "customers")), *cells)


def population_medians(sc_z: DataFrame, names: Sequence[str], value: str = "TotalSales", limit: int = FINAL_LIMIT) -> DataFrame:
    """``population, median``: exact medians of overlapping populations in one operator run, the lines of
    one mask being a cell of every population in it.  Up to ``limit`` lines Spark's ``percentile``, whose
    buffer then holds no more values than that, answers in one aggregate; both are exact."""
    def populations(mask: Column) -> Column:
        return F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names))),
                        lambda x: x.isNotNull())
    lines = with_mask(sc_z, names)
    if sc_z.count() <= limit:
        inside = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(value).cast("double")) for i in range(len(names))]
        return lines.agg(F.array(*(F.struct(F.lit(n).alias("population"), F.median(x).alias("median"))
                                   for n, x in zip(names, inside, strict=True))).alias("m")).selectExpr("inline(m)")
    q = bracketed_quantiles(lines, F.col("_mask"), populations, {"median": F.col(value)}, [0.5])
    return q.select(F.col("set").alias("population"), F.col("q").alias("median"))


def impact_table(sc_z: DataFrame, with_pop: str, without_pop: str, with_name: str, without_name: str,
                 limit: int = FINAL_LIMIT) -> DataFrame:
    """A27 / A28 + R2 + S4: five metrics of two populations as a Metric / with / without table
    (nulls for a population without lines; no customers: 0); ``limit`` as for the medians."""
    names = [with_pop, without_pop]
    rows = population_table(sc_z, names).join(population_medians(sc_z, names, limit=limit), "population", "left")
    metrics = {"Total Sales": "sum_TotalSales", "Mean Sales": "mean_TotalSales", "Median Sales": "median",
               "Total Quantity": "sum_Quantity", "Unique Customers": "customers"}
    long = rows.select("population", F.explode(F.array(*(
        F.struct(F.lit(m).alias("Metric"), F.col(x).cast("double").alias("v"), F.lit(i).alias("i"))
        for i, (m, x) in enumerate(metrics.items())))).alias("r")).select("population", "r.*")
    sides = ((with_pop, with_name), (without_pop, without_name))
    return (long.groupBy("i", "Metric").agg(*(F.max(F.when(F.col("population") == p, F.col("v"))).alias(n) for p, n in sides))
            .orderBy("i").drop("i"))


def outlier_metrics(sc_z: DataFrame) -> DataFrame:
    """Mean and sd of Quantity on all lines and on those whose Quantity is no outlier's value.
    A line's z-score follows from its Quantity alone, so the lines left by an anti join on the
    outliers' quantities (J2, :func:`tillroll.operators.kpi.metrics_with_without_outliers`) are
    those outside OUT: both rows come from the masks, without the join."""
    known = memberships()
    kept = ~F.coalesce(known["out"], F.lit(False))
    parts = sc_z.select(kept.alias("_kept"), F.col("Quantity").cast("double").alias("x")).groupBy("_kept").agg(
        F.struct(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"),
                 (F.var_pop("x") * F.count("x")).alias("m2")).alias("p"))
    label = F.explode(F.when(F.col("_kept"), F.array(F.lit("With Outliers"), F.lit("Without Outliers")))
                      .otherwise(F.array(F.lit("With Outliers")))).alias("Outliers")
    all_ = _merged(F.collect_list("p")).alias("m")
    rows = parts.select(label, "p").groupBy("Outliers").agg(all_)
    return rows.select("Outliers", F.when(F.col("m.n") > 0, F.col("m.mean")).alias("mean_quantity"),
                       F.when(F.col("m.n") > 1, F.sqrt(F.col("m.m2") / (F.col("m.n") - 1))).alias("sd_quantity"))
