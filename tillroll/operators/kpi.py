"""Key-figure tables and the small comparison aggregates around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import config
from tillroll.functions.columns import c, join_null_safe
from tillroll.operators.brackets import bracketed_quantiles
from tillroll.operators.order_stats import FINAL_LIMIT

KPI_COLUMNS = [
    "Region", "Unique_Customers", "Guest_Customers", "Mean_Total_Sales",
    "Median_Total_Sales", "SD_Total_Sales", "Mean_Quantity", "Median_Quantity",
    "SD_Quantity", "Total_Unique_Invoices",
]


def n_distinct_with_null(x: F.Column) -> F.Column:
    """Distinct values counting null as one more value (R's n_distinct /
    length(unique(.)) without na.rm)."""
    return (F.count_distinct(x)
            + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))).cast("long")


def distinct_by_group(df: DataFrame, by: str, labels: Sequence[str], overall_label: str) -> DataFrame:
    """(group, Unique_Customers, Guest_Customers, Total_Unique_Invoices) per value of ``by`` and
    overall, without multiplying rows: each id is first reduced to the set of groups that it
    occurs in, as bits (map-side combined, so a hot id leaves a task once), and then the set
    bits are counted.  ``labels``: at most 62 values of ``by``; null is a group, any other
    value an error.  A null invoice counts as one value, a null customer as none."""
    labels = list(labels)
    if len(labels) > 62:
        raise ValueError("at most 62 groups fit into the bits of a long")
    place = F.array_position(F.array(*map(F.lit, labels)), c(by).cast("string"))
    known = F.when(c(by).isNull(), F.lit(0)).when(place > 0, place).otherwise(
        F.raise_error(F.concat(F.lit("a group that isn't among the labels: "), c(by).cast("string"))).cast("long"))
    lines = df.select("CustomerID", "Invoice", known.cast("int").alias("_place"))
    lines = lines.select("CustomerID", "Invoice", F.expr("shiftleft(1L, _place)").alias("_bit"))
    customers = lines.where("CustomerID IS NOT NULL").groupBy("CustomerID").agg(F.bit_or("_bit").alias("seen"))
    invoices = lines.groupBy("Invoice").agg(
        F.bit_or("_bit").alias("seen"), F.bit_or(F.when(F.col("CustomerID").isNull(), F.col("_bit"))).alias("guest"))

    def counted(bits: str, name: str) -> F.Column:
        """How many ids have each bit, and how many have any."""
        held = [F.sum(F.expr(f"shiftright({bits}, {i}) & 1")) for i in range(len(labels) + 1)]
        return F.array(*(F.coalesce(x, F.lit(0)) for x in (*held, F.count(bits)))).alias(name)

    both = customers.agg(counted("seen", "c")).crossJoin(F.broadcast(invoices.agg(
        counted("guest", "g"), counted("seen", "i"))))
    rows = F.array(*(F.struct(F.lit(x).cast("string").alias("_group"), F.lit(over).alias("_gid"),
                              F.col("c")[i].alias("Unique_Customers"), F.col("g")[i].alias("Guest_Customers"), F.col("i")[i].alias("Total_Unique_Invoices"))
                     for i, (x, over) in enumerate([(None, 0), *((x, 0) for x in labels), (overall_label, 1)])))
    return both.select(F.explode(rows).alias("r")).select("r.*")


def kpi_table(df: DataFrame, sales: str = "TotalSales", qty: str = "Quantity",
              by: str = "Region", overall_label: str = config.OVERALL,
              overall_first: bool = False, approx_median: bool = False,
              labels: Sequence[str] = tuple(config.REGION_LEVELS), limit: int = FINAL_LIMIT) -> DataFrame:
    """Nine key figures per ``by`` value plus one overall row.

    Distinct counts come from bit sets of groups per id (``labels``: the values of ``by``), means
    with sample standard deviations from one aggregate per group and one over all; no row
    is multiplied.  Medians are exact: part of those aggregates up to ``limit`` rows,
    beyond from the distributed quantile operator (or ``percentile_approx`` with
    ``approx_median=True``).  The small results are joined per group, a null group included.
    """
    ids = distinct_by_group(df, by, labels, overall_label)
    amounts = [F.avg(sales).alias("Mean_Total_Sales"), F.stddev_samp(sales).alias("SD_Total_Sales"),
               F.avg(qty).alias("Mean_Quantity"), F.stddev_samp(qty).alias("SD_Quantity")]
    bounded = not approx_median and df.count() <= limit
    median = F.median if bounded else lambda x: F.percentile_approx(x, 0.5, 10000).cast("double")
    if bounded or approx_median:
        amounts += [median(sales).alias("Median_Total_Sales"), median(qty).alias("Median_Quantity")]
    groups = df.groupBy(c(by).cast("string").alias("_group")).agg(*amounts).withColumn("_gid", F.lit(0))
    total = df.agg(*amounts).select(F.lit(overall_label).alias("_group"), "*", F.lit(1).alias("_gid"))
    out = join_null_safe(groups.unionByName(total), F.broadcast(ids), ["_group", "_gid"])
    out = out.withColumn("Region", F.col("_group")).drop("_group", "_gid")
    if not (bounded or approx_median):
        out = join_null_safe(out, grouped_medians(df, by, {"Median_Total_Sales": sales, "Median_Quantity": qty},
                                                  overall_label), ["Region"], "left")
    order = F.when(F.col("Region") == overall_label, 0 if overall_first else 1).otherwise(
        1 if overall_first else 0)
    return out.orderBy(order, F.col("Region").asc_nulls_last()).select(*KPI_COLUMNS)


def grouped_medians(df: DataFrame, by: str, values: dict[str, str],
                    overall_label: str = config.OVERALL) -> DataFrame:
    """Exact medians of several columns per ``by`` value and overall, in one operator run: sketches
    bracket the medians, and no line is copied (:func:`tillroll.operators.brackets.bracketed_quantiles`)."""
    q = bracketed_quantiles(df, c(by).cast("string"), lambda g: F.array(g, F.lit(overall_label)),
                            {n: F.col(v) for n, v in values.items()}, [0.5])
    return q.groupBy(F.col("set").alias("Region")).agg(
        *[F.max(F.when(F.col("metric") == n, F.col("q"))).alias(n) for n in values])


def missing_summary(raw: DataFrame, cols: Sequence[str] = (
        "CustomerID", "Quantity", "Price", "InvoiceDate", "Country", "Description")) -> DataFrame:
    """A17 + R1 + F13: null count per column, long form, only counts > 0."""
    wide = raw.agg(*[F.sum(c(x).isNull().cast("long")).alias(f"missing_{x}") for x in cols])
    long = wide.unpivot([], [f"missing_{x}" for x in cols], "Column", "Missing_Count")
    return long.where(F.col("Missing_Count") > 0)


def bulk_impact(sc: DataFrame, threshold: float = config.BULK_INCLUSIVE) -> DataFrame:
    """Mean / sd of Quantity below vs at-or-above the bulk threshold."""
    q = F.col("Quantity")
    small = F.when(q < threshold, q)
    big = F.when(q >= threshold, q)
    return sc.agg(F.avg(small).alias("mean_quantity_without_bulk"),
                  F.stddev_samp(small).alias("sd_quantity_without_bulk"),
                  F.avg(big).alias("mean_quantity_with_bulk"),
                  F.stddev_samp(big).alias("sd_quantity_with_bulk"))


def metrics_with_without_outliers(sc: DataFrame, sc_z: DataFrame,
                                  k: float = config.Z_OUTLIER) -> DataFrame:
    """A26 + J2: mean / sd of Quantity on all lines and on lines whose
    Quantity value is not among the outliers' values (a null-safe anti join
    on a distinct value list; never ``NOT IN``)."""
    out_values = sc_z.where(F.abs("z_score") > k).select("Quantity").distinct()
    kept = sc.join(out_values, sc["Quantity"].eqNullSafe(out_values["Quantity"]), "left_anti")
    def m(df):
        return df.agg(F.avg("Quantity").alias("mean_quantity"),
                      F.stddev_samp("Quantity").alias("sd_quantity"))
    w, wo = m(sc), m(kept)
    return (w.withColumn("Outliers", F.lit("With Outliers"))
            .unionByName(wo.withColumn("Outliers", F.lit("Without Outliers")))
            .select("Outliers", "mean_quantity", "sd_quantity"))


def share_percent(df: DataFrame, part: F.Column, name: str) -> DataFrame:
    """Percentage of rows for which ``part`` holds (null: it doesn't)."""
    return df.agg((F.avg(F.coalesce(part, F.lit(False)).cast("double")) * 100).alias(name))
