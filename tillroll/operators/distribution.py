"""Distribution summaries behind the script's histograms and box plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import join_null_safe
from tillroll.operators.order_stats import exact_quantiles
from tillroll.session import checked_broadcast, materialize


def histogram(df: DataFrame, value: F.Column, width: float, by: list[str] | None = None,
              fill_empty: bool = False, max_bins: int = 1_000_000) -> DataFrame:
    """Fixed-width bins centred on multiples of ``width``, right-closed
    ((k - 1/2) w, (k + 1/2) w]; the lowest value sitting exactly on a lower
    edge joins the first bin (include-lowest).  Null values are dropped.  The values are
    read once; the lowest is found on the bin table, which is written.

    Output: [by...,] bin (long k), center (k * w), count.  By default only
    non-empty bins are returned; ``fill_empty=True`` adds the empty bins
    between the first and last one, and fails where a group's range spans more
    than ``max_bins`` of them.
    """
    by = by or []
    d = df.select(*by, value.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    t = F.col("_x") / F.lit(width) - F.lit(0.5)
    k = F.ceil(t)
    # one pass over the values: rows on an edge are counted apart, so that the lowest of them
    # can be moved on the bin table
    bins = materialize(d.groupBy(*by, k.cast("long").alias("bin"), F.when(k == t, F.col("_x")).alias("_edge")).agg(
        F.count(F.lit(1)).alias("count"), F.min("_x").alias("_low")), "bins")
    lowest = bins.groupBy(*by).agg(F.min("_low").alias("_min"))
    bins = join_null_safe(bins, checked_broadcast(lowest), by) if by else bins.crossJoin(F.broadcast(lowest))
    moved = F.col("bin") + F.coalesce((F.col("_edge") == F.col("_min")).cast("long"), F.lit(0))
    counts = bins.groupBy(*by, moved.alias("bin")).agg(F.sum("count").alias("count"))
    if fill_empty:
        span = counts.groupBy(*by).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
        room = F.when(F.col("_hi") - F.col("_lo") < max_bins, F.sequence("_lo", "_hi")).otherwise(
            F.raise_error(F.lit(f"the values span more than {max_bins} bins of this width")))
        bins = span.select(*by, F.explode(room).alias("bin"))
        counts = (bins.join(counts, [*by, "bin"], "left")
                  .withColumn("count", F.coalesce(F.col("count"), F.lit(0).cast("long"))))
    return (counts.withColumn("center", F.col("bin") * F.lit(width))
            .select(*by, "bin", "center", "count"))


def box_stats(df: DataFrame, value: F.Column, by: list[str] | None = None,
              coef: float = 1.5) -> DataFrame:
    """Box-plot statistics per group: exact type-7 quartiles, whisker
    ends (most extreme values inside the 1.5 IQR fences), outlier count.

    Quartiles come from the distributed order-statistics operator; a second
    pass joins the per-group fences (small) back onto the rows.
    """
    by = by or []
    d = df.select(*by, value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    q = exact_quantiles(d, by, "_x", [0.25, 0.5, 0.75])
    qs = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                              for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]])
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1")) \
           .withColumn("lower_fence", F.col("q1") - coef * F.col("iqr")) \
           .withColumn("upper_fence", F.col("q3") + coef * F.col("iqr"))
    j = join_null_safe(d, checked_broadcast(qs), by) if by else d.crossJoin(F.broadcast(qs))
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    agg = j.groupBy(*by, "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.min("_x").alias("min"), F.max("_x").alias("max"))
    return agg.select(*by, "n", "min", "whisker_low", "q1", "median", "q3", "whisker_high", "max",
                      "iqr", "lower_fence", "upper_fence", "n_outliers")
