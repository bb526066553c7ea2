"""Customer-level operators: multi-region customers, guest mix, churn,
region averages and the feature table used for segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import config
from tillroll.functions.columns import c, region_decode
from tillroll.operators.order_stats import exact_quantiles

# Line order used for "first appearance" (file, date, invoice, stock code).
LINE_ORDER = ["src_rank", "InvoiceDate", "Invoice", "StockCode"]


def multi_region_customers(sc: DataFrame, order=LINE_ORDER) -> DataFrame:
    """Known customers seen in more than
    one region, regions listed in order of first appearance.

    Per (customer, region) only the first line key is kept (aggregate with
    map-side combine); the per-customer list then holds at most one entry per
    region label, so ``collect_list`` is bounded by the number of regions.
    """
    first = (sc.where(F.col("CustomerID").isNotNull())
             .groupBy("CustomerID", "Region")
             .agg(F.min(F.struct(*[c(x) for x in order])).alias("_o")))
    lists = first.groupBy("CustomerID").agg(
        F.sort_array(F.collect_list(F.struct("_o", "Region"))).alias("_l"))
    out = lists.select("CustomerID", F.array_join(
        F.transform("_l", lambda x: x.getField("Region")), ", ").alias("Regions"))
    return out.where(F.regexp_count(F.col("Regions"), F.lit(",")) >= 1)


def guest_mix(pos: DataFrame) -> DataFrame:
    """Lines per region and customer type (Guest = no id).

    ``line_count`` reproduces the script's "count of customers", which counts
    lines; ``customer_count`` is the number of distinct known customers.
    """
    region = region_decode("Unknown")
    ctype = F.when(F.col("CustomerID").isNull(), F.lit("Guest")).otherwise(F.lit("Unique"))
    return (pos.select(region.alias("Region"), ctype.alias("CustomerType"), "CustomerID")
            .groupBy("Region", "CustomerType")
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.count_distinct("CustomerID").cast("long").alias("customer_count")))


def column_profile(df: DataFrame, col: str) -> DataFrame:
    """Min, quartiles (type 7), mean and max of one numeric column."""
    q = exact_quantiles(df, [], col, [0.25, 0.5, 0.75]).groupBy().agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
          for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]])
    basic = df.agg(F.min(col).cast("double").alias("min"), F.avg(col).alias("mean"),
                   F.max(col).cast("double").alias("max"), F.count(col).alias("n"))
    row = basic.crossJoin(q)
    return row.selectExpr("stack(6, 'Min', min, '1st Qu.', q1, 'Median', median, "
                          "'Mean', mean, '3rd Qu.', q3, 'Max', max) as (stat, value)")


def region_average(df: DataFrame) -> DataFrame:
    """Mean TotalSales per region, the region decoded from the one-hot columns found by name pattern."""
    flags = [x for x in df.columns if x.startswith("Region") and x != "Region"]
    levels = [x[len("Region"):] for x in flags]
    return (df.select(region_decode(None, levels).alias("region"), "TotalSales")
            .groupBy("region")
            .agg(F.avg("TotalSales").alias("avg_total_sales")))


def region_average_with_without(with_df: DataFrame, without_df: DataFrame) -> DataFrame:
    """The two region-average tables stacked with a tag."""
    a = region_average(with_df).withColumn("Bulk Order", F.lit("1"))
    b = region_average(without_df).withColumn("Bulk Order", F.lit("2"))
    tag = F.when(F.col("`Bulk Order`") == "1", F.lit("With Bulk Orders")).when(
        F.col("`Bulk Order`") == "2", F.lit("Without Bulk Orders"))
    return a.unionByName(b).select(tag.alias("Bulk Order"), "region", "avg_total_sales")


def churn(sc: DataFrame, as_of: str | None = config.CHURN_REFERENCE_DATE,
          days: int = config.CHURN_DAYS) -> DataFrame:
    """Last purchase date per customer (the
    guests form one null-id row) and churned = last purchase before
    ``as_of - days``.  ``as_of=None`` uses the latest date in the data
    (a one-row aggregate, broadcast)."""
    last = sc.groupBy("CustomerID").agg(F.max(F.to_date("InvoiceDate")).alias("last_purchase"))
    if as_of is None:
        ref = F.broadcast(sc.agg(F.max(F.to_date("InvoiceDate")).alias("_asof")))
    else:
        ref = F.broadcast(sc.sparkSession.range(1).select(F.to_date(F.lit(as_of)).alias("_asof")))
    thr = F.date_sub(F.col("_asof"), days)
    flag = (F.when(F.col("last_purchase") < thr, F.lit(1))
            .when(F.col("last_purchase") >= thr, F.lit(0)))
    return last.crossJoin(ref).select("CustomerID", "last_purchase", flag.alias("churned"))


def churn_rate(churn_df: DataFrame) -> DataFrame:
    """Customers, churned customers and the churn percentage."""
    return churn_df.agg(F.count(F.lit(1)).alias("customers"),
                        F.sum("churned").cast("long").alias("churned"),
                        (F.sum("churned") / F.count(F.lit(1)) * 100).alias("churn_rate"))


def customer_features(df: DataFrame, return_rate: bool = False, compat: bool = True) -> DataFrame:
    """One row per customer (guests are
    one null-id row).

    ``compat=True`` reproduces the script: AverageOrderSize is the mean of the
    already-summed TotalSales, i.e. equal to it; ``compat=False`` gives the
    mean line value.  PurchaseFrequency counts lines; ``distinct_orders``
    counts invoices.  ``return_rate`` adds the share of lines with Quantity < 0.
    """
    aggs = [F.sum("TotalSales").alias("TotalSales"),
            F.avg("TotalSales").alias("_line_avg"),
            F.count(F.lit(1)).alias("PurchaseFrequency"),
            F.count_distinct("Invoice").cast("long").alias("distinct_orders")]
    if return_rate:
        aggs.append(F.avg((F.col("Quantity") < 0).cast("double")).alias("ReturnRate"))
    g = df.groupBy("CustomerID").agg(*aggs)
    avg_col = F.col("TotalSales") if compat else F.col("_line_avg")
    cols = ["CustomerID", "TotalSales", avg_col.alias("AverageOrderSize"), "PurchaseFrequency"]
    if return_rate:
        cols.append("ReturnRate")
    cols.append("distinct_orders")
    return g.select(*cols)


FEATURES = ["TotalSales", "AverageOrderSize", "PurchaseFrequency"]


def zscale(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd (sample sd) per column, statistics from one
    broadcast row; a constant column gives null."""
    st = F.broadcast(df.agg(*[F.avg(x).alias(f"_mu_{x}") for x in cols],
                            *[F.stddev_samp(x).alias(f"_sd_{x}") for x in cols]))
    out = df.crossJoin(st)
    for x in cols:
        out = out.withColumn(f"{x}{suffix}", F.try_divide(F.col(x) - F.col(f"_mu_{x}"),
                                                          F.col(f"_sd_{x}")))
    return out.drop(*[f"_mu_{x}" for x in cols], *[f"_sd_{x}" for x in cols])
