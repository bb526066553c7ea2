"""Registered report queries: name -> (spark, sf_dir) -> DataFrame, with the
matching DuckDB oracle SQL.

Each query reads the whole test tables of ``sf_dir`` (through the retail
view), builds the population it needs lazily and returns a DataFrame; doubles
are rounded with the same decimals as the oracle so results compare exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import config
from tillroll.operators import arma, clean, kpi, lattice
from tillroll.plans import oracle as O
from tillroll.session import materialize
from tillroll.sources.retail import retail_from_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def sig(col: F.Column, digits: int = 10) -> F.Column:
    """Round to ``digits`` significant digits (same arithmetic as ``O.sig``)."""
    e = F.floor(F.log10(F.abs(col))) - (digits - 1)
    up = F.pow(F.lit(10.0), -e)     # 10^k with k >= 0 is exact in a double
    down = F.pow(F.lit(10.0), e)
    return (F.when(col == 0, F.lit(0.0))
            .when(e < 0, F.round(col * up) / up)
            .otherwise(F.round(col / down) * down))


def rnd(df: DataFrame, spec: dict[str, int | str] | None = None, default: int | str = 6) -> DataFrame:
    """Round every double column: ``spec`` by name, else ``default``; an int
    is a number of decimals, ``"sig"`` / ``"sigN"`` means 10 / N significant digits."""
    spec = spec or {}
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            how = spec.get(f.name, default)
            if isinstance(how, str):
                col = sig(col, int(how[3:] or 10))
            else:
                col = F.round(col, how)
            col = col.alias(f.name)
        out.append(col)
    return df.select(*out)


def pops(spark: SparkSession, sf_dir: str, materialize: bool = False, columns=None) -> clean.Populations:
    """Populations over the test tables; ``materialize`` for queries that read
    the clean lines more than once, of which only ``columns`` are written."""
    return clean.Populations(retail_from_tables(spark, sf_dir), materialize, columns)


#: What the populations filter on, and what the key figures read besides.
AMOUNTS = ["Quantity", "Price", "TotalSales"]
KPI_READS = ["Region", "CustomerID", "Invoice", *AMOUNTS]


KPI_ROUND = {"Mean_Total_Sales": "sig", "Median_Total_Sales": 4, "SD_Total_Sales": 3}
KPI_ROUND_SCALED = {"Mean_Total_Sales": 9, "Median_Total_Sales": 9, "SD_Total_Sales": 9,
                    "Mean_Quantity": 9, "Median_Quantity": 9, "SD_Quantity": 9}


def _kpi_query(pop: str, overall_first: bool = False):
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rnd(kpi.kpi_table(pops(spark, sf_dir, True, KPI_READS).population(pop),
                                 overall_first=overall_first), KPI_ROUND)
    return fn


# --- key figures of the six populations (A1-A8, A21, O3) --------------------
register("q_kpi_clean", O.kpi_sql("sc"))(_kpi_query("sc", overall_first=True))
register("q_kpi_positive", O.kpi_sql("pos"))(_kpi_query("pos"))
register("q_kpi_no_outliers", O.kpi_sql("noout"))(_kpi_query("noout"))
register("q_kpi_no_outliers_positive", O.kpi_sql("noout_pos"))(_kpi_query("noout_pos"))
register("q_kpi_negative", O.kpi_sql("neg"))(_kpi_query("neg"))


@register("q_kpi_scaled", O.kpi_sql("scaled", "TotalSales_MinMax", "Quantity_MinMax",
                                    rs=(9, 9, 9), rq=(9, 9, 9)))
def q_kpi_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnd(kpi.kpi_table(pops(spark, sf_dir, True, KPI_READS).scaled, sales="TotalSales_MinMax",
                             qty="Quantity_MinMax"), KPI_ROUND_SCALED)


@register("q_kpi_refined", O.kpi_sql("sc"))
def q_kpi_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key figures with medians by histogram refinement, as for tables of any size."""
    return rnd(kpi.kpi_table(pops(spark, sf_dir, True, KPI_READS).sc, overall_first=True, limit=0), KPI_ROUND)


# --- sources and data quality (S2, U1, F2, A17, R1, F13, W1, W2, W3) ---------
from tillroll.operators import customers as cust  # noqa: E402
from tillroll.operators import quality  # noqa: E402
from tillroll.sources.retail import RAW_COLUMNS  # noqa: E402

_RAW_COLS = ", ".join(RAW_COLUMNS)


@register("q_union_raw_counts", O.with_prefix("""
SELECT src_rank, count(*) AS n_rows,
       CAST(sum(CAST(Description IS NULL AS BIGINT)) AS BIGINT) AS null_description,
       CAST(sum(CAST(CustomerID IS NULL AS BIGINT)) AS BIGINT) AS null_customer
FROM raw GROUP BY src_rank"""))
def q_union_raw_counts(spark, sf_dir):
    return quality.source_counts(retail_from_tables(spark, sf_dir))


@register("q_missing_rows", O.with_prefix(f"""
SELECT {_RAW_COLS} FROM raw
WHERE CustomerID IS NULL OR Quantity IS NULL OR Price IS NULL OR InvoiceDate IS NULL
   OR Country IS NULL"""))
def q_missing_rows(spark, sf_dir):
    return quality.missing_rows(retail_from_tables(spark, sf_dir))


@register("q_missing_summary", O.with_prefix("""
SELECT * FROM (
  SELECT 'missing_CustomerID' AS "Column", count(*) - count(CustomerID) AS Missing_Count FROM raw
  UNION ALL SELECT 'missing_Quantity', count(*) - count(Quantity) FROM raw
  UNION ALL SELECT 'missing_Price', count(*) - count(Price) FROM raw
  UNION ALL SELECT 'missing_InvoiceDate', count(*) - count(InvoiceDate) FROM raw
  UNION ALL SELECT 'missing_Country', count(*) - count(Country) FROM raw
  UNION ALL SELECT 'missing_Description', count(*) - count(Description) FROM raw
) t WHERE Missing_Count > 0"""))
def q_missing_summary(spark, sf_dir):
    return kpi.missing_summary(retail_from_tables(spark, sf_dir))


@register("q_dup_keys", O.with_prefix(f"""
SELECT {_RAW_COLS} FROM (
  SELECT *, count(*) OVER (PARTITION BY Invoice, StockCode) AS n_ FROM raw) t WHERE n_ > 1"""))
def q_dup_keys(spark, sf_dir):
    return quality.duplicates_by_key(retail_from_tables(spark, sf_dir))


@register("q_dup_exact", O.with_prefix(f"""
SELECT {_RAW_COLS} FROM (
  SELECT *, count(*) OVER (PARTITION BY Invoice, StockCode, Description, Quantity, InvoiceDate,
                                        Price, CustomerID, Country) AS n_ FROM raw) t
WHERE n_ > 1"""))
def q_dup_exact(spark, sf_dir):
    return quality.duplicates_exact(retail_from_tables(spark, sf_dir))


@register("q_dedup_first", O.with_prefix(f"SELECT {_RAW_COLS} FROM nodup"))
def q_dedup_first(spark, sf_dir):
    return clean.dedup_first(retail_from_tables(spark, sf_dir))


_SC_COLS = ('Invoice, StockCode, Description, InvoiceDate, Month, Day, Year, Quantity, Price, '
            'round(TotalSales, 4) AS TotalSales, CustomerID, Country, RegionAFRICA, RegionAPAC, RegionEU, '
            '"RegionNA/LATAM", RegionOther, Region, src_rank')


@register("q_clean_lines", O.with_prefix(f"SELECT {_SC_COLS} FROM sc"))
def q_clean_lines(spark, sf_dir):
    return rnd(pops(spark, sf_dir).sc, {"TotalSales": 4})


@register("q_countries", O.with_prefix("SELECT DISTINCT Country FROM reg"))
def q_countries(spark, sf_dir):
    return quality.distinct_countries(pops(spark, sf_dir).reg)


@register("q_region_map", O.with_prefix(
    "SELECT Country, Region, count(*) AS lines FROM reg GROUP BY Country, Region"))
def q_region_map(spark, sf_dir):
    return quality.country_regions(pops(spark, sf_dir).reg)


# --- customers across regions, outliers, bulk lines, impact tables ----------
@register("q_multi_region_customers", O.with_prefix("""
SELECT * FROM (
  SELECT CustomerID, string_agg(Region, ', ' ORDER BY src_rank, InvoiceDate, Invoice, StockCode)
         AS Regions
  FROM (SELECT CustomerID, Region, src_rank, InvoiceDate, Invoice, StockCode,
               row_number() OVER (PARTITION BY CustomerID, Region
                                  ORDER BY src_rank, InvoiceDate, Invoice, StockCode) AS rn_
        FROM sc WHERE CustomerID IS NOT NULL) t
  WHERE rn_ = 1 GROUP BY CustomerID) u
WHERE length(Regions) - length(replace(Regions, ',', '')) >= 1"""))
def q_multi_region_customers(spark, sf_dir):
    return cust.multi_region_customers(pops(spark, sf_dir).sc)


@register("q_bulk_lines", O.with_prefix(
    f"SELECT {_SC_COLS} FROM sc WHERE Quantity > {float(config.BULK_STRICT)}"))
def q_bulk_lines(spark, sf_dir):
    sc = pops(spark, sf_dir).sc
    return rnd(sc.where(F.col("Quantity") > config.BULK_STRICT), {"TotalSales": 4})


@register("q_outlier_lines", O.with_prefix(
    f"SELECT {_SC_COLS}, round(z_score, 6) AS z_score FROM sc_z "
    f"WHERE abs(z_score) > {config.Z_OUTLIER}"))
def q_outlier_lines(spark, sf_dir):
    p = pops(spark, sf_dir, True)
    return rnd(clean.outliers(p.sc_z), {"TotalSales": 4, "z_score": 6})


@register("q_outlier_counts", O.with_prefix(f"""
SELECT count(*) FILTER (WHERE abs(z_score) > {config.Z_OUTLIER}) AS outlier_count,
       count(*) FILTER (WHERE Quantity >= {config.BULK_INCLUSIVE}) AS bulk_order_count
FROM sc_z"""))
def q_outlier_counts(spark, sf_dir):
    z = pops(spark, sf_dir, True, AMOUNTS).sc_z
    return z.agg(F.count_if(F.abs("z_score") > config.Z_OUTLIER).alias("outlier_count"),
                 F.count_if(F.col("Quantity") >= config.BULK_INCLUSIVE).alias("bulk_order_count"))


@register("q_bulk_impact", O.with_prefix(f"""
SELECT round(avg(Quantity) FILTER (WHERE Quantity < {config.BULK_INCLUSIVE}), 6)
         AS mean_quantity_without_bulk,
       round(stddev_samp(Quantity) FILTER (WHERE Quantity < {config.BULK_INCLUSIVE}), 6)
         AS sd_quantity_without_bulk,
       round(avg(Quantity) FILTER (WHERE Quantity >= {config.BULK_INCLUSIVE}), 6)
         AS mean_quantity_with_bulk,
       round(stddev_samp(Quantity) FILTER (WHERE Quantity >= {config.BULK_INCLUSIVE}), 6)
         AS sd_quantity_with_bulk
FROM sc_z"""))
def q_bulk_impact(spark, sf_dir):
    return rnd(kpi.bulk_impact(pops(spark, sf_dir).sc))


@register("q_metrics_wo_outliers", O.with_prefix(f"""
SELECT 'With Outliers' AS Outliers, round(avg(Quantity), 6) AS mean_quantity,
       round(stddev_samp(Quantity), 6) AS sd_quantity FROM sc
UNION ALL
SELECT 'Without Outliers', round(avg(Quantity), 6), round(stddev_samp(Quantity), 6) FROM sc
WHERE Quantity NOT IN (SELECT DISTINCT Quantity FROM sc_z
                       WHERE abs(z_score) > {config.Z_OUTLIER} AND Quantity IS NOT NULL)"""))
def q_metrics_wo_outliers(spark, sf_dir):
    p = pops(spark, sf_dir, True, AMOUNTS)
    return rnd(kpi.metrics_with_without_outliers(p.sc, p.sc_z))


@register("q_metrics_by_mask", ORACLES["q_metrics_wo_outliers"])
def q_metrics_by_mask(spark, sf_dir):
    """The same table from one aggregate, without the anti join."""
    return rnd(lattice.outlier_metrics(pops(spark, sf_dir, True, AMOUNTS).sc_z))


def _population_sql() -> str:
    """One row per population, from the population's own lines."""
    tables = {n: n for n in ("sc", "pos", "neg", "noout", "noout_pos", "nolow")} | {
        "out": f"(SELECT * FROM sc_z WHERE abs(z_score) > {config.Z_OUTLIER}) o",
        "bulk": f"(SELECT * FROM sc_z WHERE Quantity >= {config.BULK_INCLUSIVE}) b"}
    return O.with_prefix("\nUNION ALL\n".join(
        f"SELECT '{name}' AS population, count(*) AS n_lines, count(DISTINCT CustomerID) + "
        f"coalesce(max(CAST(CustomerID IS NULL AS BIGINT)), 0) AS customers, " + ", ".join(
            f"{O.sig(f'sum({x})')} AS sum_{x}, {O.sig(f'avg({x})')} AS mean_{x}, "
            f"{O.sig(f'stddev_samp({x})', 9)} AS sd_{x}" for x in lattice.AMOUNTS) + f" FROM {table}"
        for name, table in tables.items()))


@register("q_population_table", _population_sql())
def q_population_table(spark, sf_dir):
    """Lines, customers, sums, means and deviations of all eight populations, by mask."""
    t = lattice.population_table(pops(spark, sf_dir, True, ["CustomerID", *AMOUNTS]).sc_z)
    return rnd(t, {f"sd_{x}": "sig9" for x in lattice.AMOUNTS}, default="sig")


def _impact_sql(a: str, b: str, wa: str, wb: str) -> str:
    def one(pop: str) -> str:
        return (f"SELECT sum(TotalSales) AS ts, avg(TotalSales) AS ms, median(TotalSales) AS md, "
                f"sum(Quantity) AS tq, "
                f"CAST(count(DISTINCT CustomerID) + max(CAST(CustomerID IS NULL AS INTEGER)) "
                f"AS DOUBLE) AS uc FROM {pop}")
    return O.with_prefix(f"""
SELECT m.Metric, {O.sig('m.va')} AS {wa}, {O.sig('m.vb')} AS {wb} FROM (
  SELECT 'Total Sales' AS Metric, pa_.ts AS va, pb_.ts AS vb FROM pa_, pb_
  UNION ALL SELECT 'Mean Sales', pa_.ms, pb_.ms FROM pa_, pb_
  UNION ALL SELECT 'Median Sales', pa_.md, pb_.md FROM pa_, pb_
  UNION ALL SELECT 'Total Quantity', pa_.tq, pb_.tq FROM pa_, pb_
  UNION ALL SELECT 'Unique Customers', pa_.uc, pb_.uc FROM pa_, pb_) m""",
                         extra_ctes=f"pa_ AS ({one(a)}), pb_ AS ({one(b)})")


def _impact(spark, sf_dir, kind):
    p = pops(spark, sf_dir, True, ["CustomerID", *AMOUNTS])
    if kind == "bulk":
        t = lattice.impact_table(p.sc_z, "pos", "noout_pos", "With_Bulk_Orders", "Without_Bulk_Orders")
    else:
        t = lattice.impact_table(p.sc_z, "noout_pos", "nolow", "With_Low_Orders", "Without_Low_Orders")
    return rnd(t, default="sig")


@register("q_impact_refined", _impact_sql("pos", "nolow", "With_Bulk_Orders", "Without_Low_Orders"))
def q_impact_refined(spark, sf_dir):
    """Two populations with medians from brackets, as for tables of any size."""
    sc_z = pops(spark, sf_dir, True, ["CustomerID", *AMOUNTS]).sc_z
    return rnd(lattice.impact_table(sc_z, "pos", "nolow", "With_Bulk_Orders", "Without_Low_Orders", limit=0), default="sig")


register("q_impact_bulk", _impact_sql("pos", "noout_pos", "With_Bulk_Orders",
                                      "Without_Bulk_Orders"))(
    lambda spark, sf_dir: _impact(spark, sf_dir, "bulk"))
register("q_impact_low", _impact_sql("noout_pos", "nolow", "With_Low_Orders",
                                     "Without_Low_Orders"))(
    lambda spark, sf_dir: _impact(spark, sf_dir, "low"))


@register("q_negative_share", O.with_prefix("""
SELECT round(CAST((SELECT count(*) FROM neg) AS DOUBLE)
             / CAST((SELECT count(*) FROM sc) AS DOUBLE) * 100, 9) AS percentage_negative"""))
def q_negative_share(spark, sf_dir):
    sc = pops(spark, sf_dir).sc
    return rnd(kpi.share_percent(sc, F.col("TotalSales") < 0, "percentage_negative"), default=9)


@register("q_head_clean", O.with_prefix(f"""
SELECT {_SC_COLS} FROM noout
ORDER BY InvoiceDate, Invoice, StockCode, Quantity, Price, CustomerID NULLS FIRST LIMIT 6"""))
def q_head_clean(spark, sf_dir):
    """O2: the first six lines of NOOUT by a total order on the dedup key."""
    df = pops(spark, sf_dir, True).noout
    return rnd(df.orderBy("InvoiceDate", "Invoice", "StockCode", "Quantity", "Price",
                          F.col("CustomerID").asc_nulls_first()).limit(6), {"TotalSales": 4})


# --- customers: churn, guest mix, region averages (M27-M30, A13-A18, A24) ----
_CHURN_SQL = """
ch AS (SELECT CustomerID, max(CAST(InvoiceDate AS DATE)) AS last_purchase FROM sc
       GROUP BY CustomerID),
thr AS (SELECT max(CAST(InvoiceDate AS DATE)) - {days} AS t FROM sc),
cf AS (SELECT CustomerID, last_purchase,
              CASE WHEN last_purchase < t THEN 1 WHEN last_purchase >= t THEN 0 END AS churned
       FROM ch, thr)""".format(days=config.CHURN_DAYS)


@register("q_churn_customers", O.with_prefix("SELECT * FROM cf", _CHURN_SQL))
def q_churn_customers(spark, sf_dir):
    """Churn flags; the reference date is the last date in the data."""
    return cust.churn(pops(spark, sf_dir).sc, as_of=None)


@register("q_churn_rate", O.with_prefix(
    "SELECT count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned, "
    "round(sum(churned) / count(*) * 100, 9) AS churn_rate FROM cf", _CHURN_SQL))
def q_churn_rate(spark, sf_dir):
    return rnd(cust.churn_rate(cust.churn(pops(spark, sf_dir).sc, as_of=None)), default=9)


@register("q_churn_rate_fixed", O.with_prefix(
    "SELECT count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned, "
    "round(sum(churned) / count(*) * 100, 9) AS churn_rate FROM ("
    "SELECT CustomerID, CASE WHEN max(CAST(InvoiceDate AS DATE)) < CAST("
    f"DATE '{config.CHURN_REFERENCE_DATE}' - {config.CHURN_DAYS} AS DATE) THEN 1 ELSE 0 END AS churned "
    "FROM sc GROUP BY CustomerID) f"))
def q_churn_rate_fixed(spark, sf_dir):
    """Churn at the script's own reference date."""
    return rnd(cust.churn_rate(cust.churn(pops(spark, sf_dir).sc)), default=9)


_GUEST_SQL = """
gm AS (SELECT Region, CASE WHEN CustomerID IS NULL THEN 'Guest' ELSE 'Unique' END AS CustomerType,
              count(*) AS line_count, count(DISTINCT CustomerID) AS customer_count
       FROM pos GROUP BY 1, 2)"""


@register("q_guest_mix", O.with_prefix("SELECT * FROM gm", _GUEST_SQL))
def q_guest_mix(spark, sf_dir):
    return cust.guest_mix(pops(spark, sf_dir).pos).orderBy("Region", "CustomerType")


@register("q_guest_mix_profile", O.with_prefix("""
SELECT stat, round(value, 6) AS value FROM (
  SELECT 'Min' AS stat, CAST(min(line_count) AS DOUBLE) AS value FROM gm
  UNION ALL SELECT '1st Qu.', quantile_cont(line_count, 0.25) FROM gm
  UNION ALL SELECT 'Median', quantile_cont(line_count, 0.5) FROM gm
  UNION ALL SELECT 'Mean', avg(line_count) FROM gm
  UNION ALL SELECT '3rd Qu.', quantile_cont(line_count, 0.75) FROM gm
  UNION ALL SELECT 'Max', CAST(max(line_count) AS DOUBLE) FROM gm) t""", _GUEST_SQL))
def q_guest_mix_profile(spark, sf_dir):
    from tillroll.session import materialize

    mix = materialize(cust.guest_mix(pops(spark, sf_dir).pos), "guest_mix")       # a row per region and type
    return rnd(cust.column_profile(mix, "line_count"))


@register("q_region_avg_bulk", O.with_prefix(f"""
SELECT 'With Bulk Orders' AS "Bulk Order", Region AS region,
       {O.sig("avg(TotalSales)")} AS avg_total_sales FROM pos GROUP BY Region
UNION ALL
SELECT 'Without Bulk Orders', Region, {O.sig("avg(TotalSales)")} FROM noout_pos
GROUP BY Region"""))
def q_region_avg_bulk(spark, sf_dir):
    flags = [f"Region{x}" for x in config.REGION_LEVELS]
    p = pops(spark, sf_dir, True, [*flags, *AMOUNTS])
    return rnd(cust.region_average_with_without(p.pos, p.noout_pos),
               default="sig").orderBy("Bulk Order", "region")


# --- daily / monthly series (A19, A20, F6, M31, W6) --------------------------
from tillroll.operators import timeseries as ts  # noqa: E402

_MONEY = "sum(TotalSales)"


def _daily_sql(pop: str) -> str:
    return O.with_prefix(f"SELECT CAST(InvoiceDate AS DATE) AS InvoiceDate, "
                         f"round({_MONEY}, 2) AS TotalSales FROM {pop} GROUP BY 1")


def _sign_sql(pop: str) -> str:
    return O.with_prefix(f"""
SELECT CAST(InvoiceDate AS DATE) AS InvoiceDate,
  round(sum(TotalSales) FILTER (WHERE TotalSales > 0), 2)
    AS PositiveSales,
  round(sum(TotalSales) FILTER (WHERE TotalSales < 0), 2)
    AS NegativeSales
FROM {pop} GROUP BY 1""")


def _noout(spark, sf_dir):
    """Dates and amounts of the lines without outliers; the clean lines are
    written once, since the z-score reads them twice."""
    return pops(spark, sf_dir, True, ["InvoiceDate", *AMOUNTS]).noout


register("q_daily_sales", _daily_sql("sc"))(
    lambda spark, sf_dir: rnd(ts.daily_sales(pops(spark, sf_dir).sc), default=2).orderBy("InvoiceDate"))
register("q_daily_sales_no_outliers", _daily_sql("noout"))(
    lambda spark, sf_dir: rnd(ts.daily_sales(_noout(spark, sf_dir)), default=2).orderBy("InvoiceDate"))
register("q_daily_sign_trend", _sign_sql("sc"))(
    lambda spark, sf_dir: rnd(ts.daily_sign_trend(pops(spark, sf_dir).sc), default=2).orderBy("InvoiceDate"))
register("q_daily_sign_trend_no_outliers", _sign_sql("noout"))(
    lambda spark, sf_dir: rnd(ts.daily_sign_trend(_noout(spark, sf_dir)), default=2).orderBy("InvoiceDate"))

_MONTHLY_SQL = f"""
mo AS (SELECT 'clean' AS series, CAST(date_trunc('month', InvoiceDate) AS DATE) AS Date,
              {_MONEY} AS TotalSales FROM noout_pos GROUP BY 2
       UNION ALL
       SELECT 'positive', CAST(date_trunc('month', InvoiceDate) AS DATE), {_MONEY}
       FROM pos GROUP BY 2),
ms AS (SELECT series, Date,
              CAST(row_number() OVER (PARTITION BY series ORDER BY Date) AS INTEGER) AS t,
              TotalSales FROM mo)"""


def _monthly(spark, sf_dir):
    """Both monthly series, written once: a row per month, read by several windows."""
    from tillroll.session import materialize

    p = pops(spark, sf_dir, True, ["InvoiceDate", *AMOUNTS])
    both = ts.monthly_sales(p.noout_pos, "clean").unionByName(ts.monthly_sales(p.pos, "positive"))
    return materialize(both, "monthly")


@register("q_monthly_sales", O.with_prefix(
    "SELECT series, Date, t, round(TotalSales, 2) AS TotalSales FROM ms", _MONTHLY_SQL))
def q_monthly_sales(spark, sf_dir):
    return rnd(_monthly(spark, sf_dir).select("series", "Date", "t", "TotalSales"), default=2).orderBy("series", "Date")


# --- decomposition, linear trend (M16-M18, W4, W5) ---------------------------
def _daily_series(spark, sf_dir):
    from tillroll.session import materialize

    p = pops(spark, sf_dir, True, ["InvoiceDate", *AMOUNTS])
    d = ts.daily_sales(p.sc, "clean").unionByName(ts.daily_sales(p.noout, "no_outliers"))
    return ts.with_position(materialize(d, "daily"), "InvoiceDate")


_H = config.DAILY_PERIOD // 2


_DECOMP_SELECT = f"""
SELECT tr.series, d AS InvoiceDate, CAST(t AS INTEGER) AS t, round(x, 2) AS TotalSales,
       round(trend, 4) AS trend, round(figure, 2) AS seasonal,
       round(x - trend - figure, 3) AS remainder
FROM tr JOIN fg2 ON tr.series = fg2.series AND (tr.t - 1) % {config.DAILY_PERIOD} = fg2.pos"""


def _decomp_sql(daily_cte: str) -> str:
    """Decomposition CTEs over ``dd(series, d, v)``."""
    return O.with_prefix(_DECOMP_SELECT, daily_cte + f""",
dt AS (SELECT series, d, v AS x,
              row_number() OVER (PARTITION BY series ORDER BY d) AS t FROM dd),
tr AS (SELECT *, CASE WHEN count(*) OVER w = {2 * _H + 1} THEN
         (sum(x) OVER w - (lag(x, {_H}) OVER o + lead(x, {_H}) OVER o) / 2)
         / {float(config.DAILY_PERIOD)} END AS trend
       FROM dt WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN {_H} PRECEDING
                            AND {_H} FOLLOWING),
                      o AS (PARTITION BY series ORDER BY t)),
fg AS (SELECT series, (t - 1) % {config.DAILY_PERIOD} AS pos, avg(x - trend) AS f FROM tr
       GROUP BY 1, 2),
fg2 AS (SELECT series, pos, f - avg(f) OVER (PARTITION BY series) AS figure FROM fg)""")


@register("q_decompose_daily", _decomp_sql("""
dd AS (SELECT 'clean' AS series, CAST(InvoiceDate AS DATE) AS d,
              sum(TotalSales) AS v FROM sc GROUP BY 2
       UNION ALL
       SELECT 'no_outliers', CAST(InvoiceDate AS DATE), sum(TotalSales)
       FROM noout GROUP BY 2)"""))
def q_decompose_daily(spark, sf_dir):
    d = ts.decompose(_daily_series(spark, sf_dir), "TotalSales", config.DAILY_PERIOD)
    return rnd(d.select("series", "InvoiceDate", "t", "TotalSales", "trend", "seasonal",
                        "remainder"),
               {"TotalSales": 2, "trend": 4, "seasonal": 2, "remainder": 3})


_XF = "(year(Date) + (month(Date) - 1) / 12.0)"
_LM_SQL = f"""
lm AS (SELECT series, CAST(regr_count(TotalSales, {_XF}) AS BIGINT) AS n, regr_intercept(TotalSales, {_XF}) AS intercept,
              regr_slope(TotalSales, {_XF}) AS slope, regr_r2(TotalSales, {_XF}) AS r2,
              regr_sxx(TotalSales, {_XF}) AS sxx, regr_syy(TotalSales, {_XF}) AS syy,
              regr_sxy(TotalSales, {_XF}) AS sxy, regr_avgx(TotalSales, {_XF}) AS x_mean
       FROM ms GROUP BY series),
lm2 AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM lm)"""


@register("q_trend_lm", O.with_prefix(f"""
SELECT series, n, {O.sig('intercept', 8)} AS intercept, {O.sig('slope', 8)} AS slope, {O.sig('r2', 8)} AS r2,
       {O.sig('sigma', 8)} AS sigma, {O.sig('sigma / sqrt(sxx)', 8)} AS se_slope,
       {O.sig('slope / (sigma / sqrt(sxx))', 8)} AS t_slope, {O.sig('x_mean', 8)} AS x_mean,
       {O.sig('sxx', 8)} AS sxx
FROM lm2""", _MONTHLY_SQL + "," + _LM_SQL))
def q_trend_lm(spark, sf_dir):
    return rnd(ts.linear_trend(_monthly(spark, sf_dir)), default="sig8")


@register("q_trend_fit", O.with_prefix(f"""
SELECT ms.series, Date, round(TotalSales, 2) AS TotalSales,
       {O.sig(f'intercept + slope * {_XF}', 8)} AS fitted,
       {O.sig(f'sigma * sqrt(1.0 / n + pow({_XF} - x_mean, 2) / sxx)', 8)} AS se_fit,
       n - 2 AS df
FROM ms JOIN lm2 ON ms.series = lm2.series""", _MONTHLY_SQL + "," + _LM_SQL))
def q_trend_fit(spark, sf_dir):
    return rnd(ts.trend_fit(_monthly(spark, sf_dir)), {"TotalSales": 2}, default="sig8")


#: Two-sided p of Student's t by Simpson's rule over the density (SQL has no t distribution).
def _t_p(t: str, df: str, steps: int = 4000) -> str:
    return (f"(1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * abs({t}) / {3 * steps}"
            f" * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1.0 "
            f"WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(1 + pow(abs({t}) * i / {steps}.0, 2) / {df}, "
            f"-({df} + 1) / 2.0))))")


@register("q_trend_summary", O.with_prefix(f"""
SELECT s.series, s.n, s.n - 2 AS df, {O.sig('intercept', 8)} AS intercept, {O.sig('se0', 8)} AS se_intercept,
       {O.sig('intercept / se0', 8)} AS t_intercept, {O.sig(_t_p('(intercept / se0)', '(s.n - 2)'), 6)} AS p_intercept,
       {O.sig('slope', 8)} AS slope, {O.sig('se1', 8)} AS se_slope, {O.sig('slope / se1', 8)} AS t_slope,
       {O.sig(_t_p('(slope / se1)', '(s.n - 2)'), 6)} AS p_slope, {O.sig('sigma', 8)} AS sigma,
       {O.sig('r2', 8)} AS r2, {O.sig('1 - (1 - r2) * (s.n - 1) / (s.n - 2)', 8)} AS adj_r2,
       {O.sig('pow(slope / se1, 2)', 8)} AS f_value, {O.sig(_t_p('(slope / se1)', '(s.n - 2)'), 6)} AS f_p,
       {O.sig('e0', 8)} AS resid_min, {O.sig('e1', 8)} AS resid_q1, {O.sig('e2', 8)} AS resid_median,
       {O.sig('e3', 8)} AS resid_q3, {O.sig('e4', 8)} AS resid_max
FROM (SELECT *, sigma * sqrt(1.0 / n + pow(x_mean, 2) / sxx) AS se0, sigma / sqrt(sxx) AS se1 FROM lm2) s
JOIN (SELECT ms.series, min(e) AS e0, quantile_cont(e, 0.25) AS e1, quantile_cont(e, 0.5) AS e2,
             quantile_cont(e, 0.75) AS e3, max(e) AS e4
      FROM (SELECT ms.series, TotalSales - (intercept + slope * {_XF}) AS e
            FROM ms JOIN lm2 ON ms.series = lm2.series) ms GROUP BY ms.series) r ON r.series = s.series""",
                                           _MONTHLY_SQL + "," + _LM_SQL))
def q_trend_summary(spark, sf_dir):
    """The whole regression summary of both monthly series."""
    return rnd(ts.linear_summary(_monthly(spark, sf_dir)),
               {"p_intercept": "sig6", "p_slope": "sig6", "f_p": "sig6"}, default="sig8")


# FIXED VALUE: 97.5 % quantile of Student's t at 78 degrees of freedom (80 months).
T975_78 = 1.990847068811692


@register("q_trend_band", O.with_prefix(f"""
SELECT series, Date, round(TotalSales, 2) AS TotalSales, {O.sig('fitted', 8)} AS fitted, {O.sig('se', 8)} AS se_fit,
       df, {O.sig('crit', 8)} AS t_crit, {O.sig('fitted - crit * se', 8)} AS lower,
       {O.sig('fitted + crit * se', 8)} AS upper
FROM (SELECT ms.series, Date, TotalSales, intercept + slope * {_XF} AS fitted,
             sigma * sqrt(1.0 / n + pow({_XF} - x_mean, 2) / sxx) AS se, n - 2 AS df,
             CASE WHEN n = 80 THEN {T975_78} END AS crit
      FROM ms JOIN lm2 ON ms.series = lm2.series) b""", _MONTHLY_SQL + "," + _LM_SQL))
def q_trend_band(spark, sf_dir):
    """Fitted line with its 95 % band."""
    return rnd(ts.trend_band(_monthly(spark, sf_dir)), {"TotalSales": 2}, default="sig8")


# --- histograms and box statistics (A30, A31, X4) ----------------------------
from tillroll.functions.columns import ln_pos  # noqa: E402
from tillroll.operators import distribution as dist  # noqa: E402


def _hist_sql(pop: str, expr: str, w: float) -> str:
    t = f"(x / {w} - 0.5)"
    return O.with_prefix(f"""
SELECT bin, round(CAST(bin AS DOUBLE) * {w}, 6) AS center, count(*) AS count FROM (
  SELECT CAST(CASE WHEN x = mn AND ceil({t}) = {t} THEN ceil({t}) + 1 ELSE ceil({t}) END
              AS BIGINT) AS bin
  FROM (SELECT x, min(x) OVER () AS mn FROM (SELECT {expr} AS x FROM {pop}) a
        WHERE x IS NOT NULL) b) c
GROUP BY bin""")


def _hist(pop: str, expr, w: float):
    def fn(spark, sf_dir):
        df = pops(spark, sf_dir, pop == "noout_pos", AMOUNTS).population(pop)
        return rnd(dist.histogram(df, expr(), w), {"center": 6})
    return fn


register("q_hist_total_sales", _hist_sql("pos", "TotalSales", config.HIST_WIDTH_SALES))(
    _hist("pos", lambda: F.col("TotalSales"), config.HIST_WIDTH_SALES))
register("q_hist_log_sales", _hist_sql(
    "pos", "CASE WHEN TotalSales > 0 THEN ln(TotalSales) END", config.HIST_WIDTH_LOG_SALES))(
    _hist("pos", lambda: ln_pos("TotalSales"), config.HIST_WIDTH_LOG_SALES))
register("q_hist_log_sales_no_outliers", _hist_sql(
    "noout_pos", "CASE WHEN TotalSales > 0 THEN ln(TotalSales) END",
    config.HIST_WIDTH_LOG_SALES_NOOUT))(
    _hist("noout_pos", lambda: ln_pos("TotalSales"), config.HIST_WIDTH_LOG_SALES_NOOUT))
register("q_hist_negative", _hist_sql("neg", "TotalSales", config.HIST_WIDTH_NEGATIVE))(
    _hist("neg", lambda: F.col("TotalSales"), config.HIST_WIDTH_NEGATIVE))


@register("q_box_stats", O.with_prefix("""
SELECT f.series, count(*) AS n, round(min(x), 9) AS min,
  round(min(x) FILTER (WHERE x >= lower_fence AND x <= upper_fence), 9) AS whisker_low,
  round(f.q1, 9) AS q1, round(f.median, 9) AS median, round(f.q3, 9) AS q3,
  round(max(x) FILTER (WHERE x >= lower_fence AND x <= upper_fence), 9) AS whisker_high,
  round(max(x), 9) AS max, round(f.iqr, 9) AS iqr, round(f.lower_fence, 9) AS lower_fence,
  round(f.upper_fence, 9) AS upper_fence,
  count(*) FILTER (WHERE NOT (x >= lower_fence AND x <= upper_fence)) AS n_outliers
FROM bx JOIN f ON bx.series = f.series WHERE x IS NOT NULL
GROUP BY f.series, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence""", """
bx AS (SELECT 'quantity' AS series, CAST(Quantity AS DOUBLE) AS x FROM pos
       UNION ALL SELECT 'log_quantity', CASE WHEN Quantity > 0 THEN ln(Quantity) END FROM pos
       UNION ALL SELECT 'log_quantity_no_outliers', CASE WHEN Quantity > 0 THEN ln(Quantity) END
       FROM noout_pos),
qq AS (SELECT series, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
              quantile_cont(x, 0.75) AS q3 FROM bx WHERE x IS NOT NULL GROUP BY series),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
             q3 + 1.5 * (q3 - q1) AS upper_fence FROM qq)"""))
def q_box_stats(spark, sf_dir):
    p = pops(spark, sf_dir, True, AMOUNTS)
    long = (p.pos.select(F.lit("quantity").alias("series"), F.col("Quantity").cast("double").alias("x"))
            .unionByName(p.pos.select(F.lit("log_quantity").alias("series"),
                                      ln_pos("Quantity").alias("x")))
            .unionByName(p.noout_pos.select(F.lit("log_quantity_no_outliers").alias("series"),
                                            ln_pos("Quantity").alias("x"))))
    return rnd(dist.box_stats(long, F.col("x"), by=["series"]), default=9)


@register("q_quartiles_refined", O.with_prefix(" UNION ALL ".join(
    f"SELECT Region, CAST({p} AS DOUBLE) AS p, round(quantile_cont(TotalSales, {p}), 6) AS q FROM pos GROUP BY Region"
    for p in (0.25, 0.5, 0.75))))
def q_quartiles_refined(spark, sf_dir):
    """Exact quartiles per region by histogram refinement, as for groups of any size."""
    from tillroll.operators.order_stats import exact_quantiles

    pos = pops(spark, sf_dir, True, ["Region", *AMOUNTS]).pos
    return rnd(exact_quantiles(pos, ["Region"], "TotalSales", [0.25, 0.5, 0.75], final_limit=100, buckets=64))


# --- split, train-fitted scaling, OLS hold-out (M1-M4, M7-M9) ----------------
from tillroll.operators import inference as inf  # noqa: E402

def _part(text: str) -> str:
    return f"coalesce(length({text}) || ':' || {text}, '-')"


_SPLIT_SQL = f"""
qs_ AS (SELECT quantile_cont(TotalSales, 0.25) AS b1, quantile_cont(TotalSales, 0.5) AS b2,
               quantile_cont(TotalSales, 0.75) AS b3 FROM sc),
st_ AS (SELECT sc.*, CAST(1 + CAST(TotalSales > b1 AS INTEGER) + CAST(TotalSales > b2 AS INTEGER)
                     + CAST(TotalSales > b3 AS INTEGER) AS INTEGER) AS stratum,
               md5(concat_ws('|', {', '.join(_part(f'CAST({k} AS VARCHAR)') for k in config.DEDUP_KEYS)})) AS h_
        FROM sc, qs_),
sp AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h_)
                   <= ceil(0.8 * count(*) OVER (PARTITION BY stratum)) AS is_train FROM st_),
trs AS (SELECT avg(TotalSales) AS mu_, stddev_samp(TotalSales) AS sd_, min(TotalSales) AS mn_,
               max(TotalSales) - min(TotalSales) AS rg_ FROM sp WHERE is_train),
sps AS (SELECT sp.*, (TotalSales - mu_) / sd_ AS TotalSales_Z,
               (TotalSales - mn_) / rg_ AS TotalSales_MinMax FROM sp, trs)"""


def _split(spark, sf_dir):
    return inf.stratified_split(pops(spark, sf_dir, True, ["Invoice", "StockCode", "CustomerID", *AMOUNTS]).sc)


@register("q_split", O.with_prefix("""
SELECT stratum, count(*) AS n, count(*) FILTER (WHERE is_train) AS n_train,
       count(*) FILTER (WHERE NOT is_train) AS n_test, round(min(TotalSales), 4) AS y_min,
       round(max(TotalSales), 4) AS y_max
FROM sp GROUP BY stratum""", _SPLIT_SQL))
def q_split(spark, sf_dir):
    return rnd(inf.split_summary(_split(spark, sf_dir)), default=4)


def _scaled_split(spark, sf_dir):
    s = _split(spark, sf_dir)
    s = inf.scale_by_train(s, "TotalSales", "z")
    return inf.scale_by_train(s, "TotalSales", "minmax")


@register("q_scaled_train_test", O.with_prefix("""
SELECT Invoice, StockCode, Quantity, Price, CustomerID, stratum, is_train,
       round(TotalSales_Z, 6) AS TotalSales_Z, round(TotalSales_MinMax, 9) AS TotalSales_MinMax
FROM sps""", _SPLIT_SQL))
def q_scaled_train_test(spark, sf_dir):
    s = _scaled_split(spark, sf_dir)
    return rnd(s.select("Invoice", "StockCode", "Quantity", "Price", "CustomerID", "stratum",
                        "is_train", "TotalSales_Z", "TotalSales_MinMax"),
               {"TotalSales_Z": 6}, default=9)


def _ols_sql(target: str) -> str:
    fit = f"""
m_ AS (SELECT count(*) AS n, avg({target}) AS my, avg(Quantity) AS m1, avg(Price) AS m2,
              var_samp(Quantity) AS s11, var_samp(Price) AS s22, covar_samp(Quantity, Price) AS s12,
              covar_samp(Quantity, {target}) AS s1y, covar_samp(Price, {target}) AS s2y
       FROM sps WHERE is_train),
b_ AS (SELECT n, my, m1, m2, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
              (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m_),
f_ AS (SELECT n AS n_train, my - b1 * m1 - b2 * m2 AS intercept, b1, b2 FROM b_),
e_ AS (SELECT sqrt(avg(pow(intercept + b1 * Quantity + b2 * Price - {target}, 2))) AS rmse,
              count(*) AS n_test FROM sps, f_ WHERE NOT is_train)"""
    return O.with_prefix(f"""
SELECT n_train, {O.sig('intercept', 8)} AS intercept, {O.sig('b1', 8)} AS b_Quantity,
       {O.sig('b2', 8)} AS b_Price, {O.sig('rmse', 8)} AS rmse, n_test FROM f_, e_""",
                         _SPLIT_SQL + "," + fit)


@register("q_ols_rmse_z", _ols_sql("TotalSales_Z"))
def q_ols_rmse_z(spark, sf_dir):
    return rnd(inf.holdout_rmse(_scaled_split(spark, sf_dir), "TotalSales_Z"), default="sig8")


@register("q_ols_rmse_minmax", _ols_sql("TotalSales_MinMax"))
def q_ols_rmse_minmax(spark, sf_dir):
    return rnd(inf.holdout_rmse(_scaled_split(spark, sf_dir), "TotalSales_MinMax"), default="sig8")


# --- ANOVA and Tukey (M11-M13, J4) -------------------------------------------
def _anova_sql(pop: str, yexpr: str, extra: str = "") -> str:
    ctes = (extra + ",\n" if extra else "") + f"""
ay AS (SELECT Region AS grp, {yexpr} AS y FROM {pop}),
ag AS (SELECT grp, count(*) AS n, avg(y) AS mean, var_samp(y) AS var FROM ay
       WHERE y IS NOT NULL GROUP BY grp),
at_ AS (SELECT sum(n) AS n_total, count(*) AS k, sum(n * mean) / sum(n) AS grand FROM ag),
as_ AS (SELECT k - 1 AS dfb, n_total - k AS dfw, sum(n * pow(mean - grand, 2)) AS ssb,
               sum(coalesce((n - 1) * var, 0)) AS ssw FROM ag, at_ GROUP BY k, n_total)"""
    return O.with_prefix(f"""
SELECT 'group' AS term, CAST(dfb AS BIGINT) AS Df, {O.sig('ssb', 8)} AS Sum_Sq,
       {O.sig('ssb / dfb', 8)} AS Mean_Sq, {O.sig('(ssb / dfb) / (ssw / dfw)', 8)} AS F_value FROM as_
UNION ALL
SELECT 'Residuals', CAST(dfw AS BIGINT), {O.sig('ssw', 8)}, {O.sig('ssw / dfw', 8)}, NULL FROM as_""",
                         ctes)


_ZS = {"noout_pos": "zs1", "pos": "zs2"}


def _zsql(pop: str) -> str:
    return (f"{_ZS[pop]} AS (SELECT {pop}.*, (TotalSales - mu_) / sd_ AS TotalSales_scaled "
            f"FROM {pop}, (SELECT avg(TotalSales) AS mu_, stddev_samp(TotalSales) AS sd_ "
            f"FROM {pop}) s_)")


def _anova_q(pop: str, scaled: bool):
    def fn(spark, sf_dir):
        df = pops(spark, sf_dir, True, ["Region", *AMOUNTS]).population(pop)
        if scaled:
            y = F.col("TotalSales_scaled")
            df = cust.zscale(df, ["TotalSales"], "_scaled")
        else:
            y = ln_pos("TotalSales")
        return rnd(inf.anova_oneway(df, y), default="sig8")
    return fn


register("q_anova_log", _anova_sql("noout_pos", "CASE WHEN TotalSales > 0 THEN ln(TotalSales) END"))(
    _anova_q("noout_pos", False))
register("q_anova_log_bulk", _anova_sql("pos", "CASE WHEN TotalSales > 0 THEN ln(TotalSales) END"))(
    _anova_q("pos", False))
register("q_anova_scaled", _anova_sql("zs1", "TotalSales_scaled", _zsql("noout_pos")))(
    _anova_q("noout_pos", True))
register("q_anova_scaled_bulk", _anova_sql("zs2", "TotalSales_scaled", _zsql("pos")))(
    _anova_q("pos", True))


def _anova_p_sql() -> str:
    """All four tests; the F tail of four group degrees of freedom in closed form."""
    log = "CASE WHEN TotalSales > 0 THEN ln(TotalSales) END"
    tests = [("log", "noout_pos", log), ("log_bulk", "pos", log), ("scaled", "zs1", "TotalSales_scaled"),
             ("scaled_bulk", "zs2", "TotalSales_scaled")]
    rows = " UNION ALL ".join(f"SELECT '{t}' AS test, Region AS grp, {y} AS y FROM {pop}" for t, pop, y in tests)
    return O.with_prefix(f"""
SELECT test, 'group' AS term, CAST(dfb AS BIGINT) AS Df, {O.sig('ssb', 8)} AS Sum_Sq, {O.sig('ssb / dfb', 8)} AS Mean_Sq,
       {O.sig('fv', 8)} AS F_value, {O.sig('CASE WHEN dfb = 4 THEN exp(dfw / 2.0 * ln(1 - y)) * (1 + dfw / 2.0 * y) END', 8)}
         AS P_value
FROM (SELECT *, 4 * fv / (dfw + 4 * fv) AS y FROM (SELECT *, (ssb / dfb) / (ssw / dfw) AS fv FROM as_) f) f
UNION ALL
SELECT test, 'Residuals', CAST(dfw AS BIGINT), {O.sig('ssw', 8)}, {O.sig('ssw / dfw', 8)}, NULL, NULL FROM as_""",
                         f"""{_zsql("noout_pos")}, {_zsql("pos")},
ay AS ({rows}),
ag AS (SELECT test, grp, count(*) AS n, avg(y) AS mean, var_samp(y) AS var FROM ay WHERE y IS NOT NULL GROUP BY 1, 2),
at_ AS (SELECT test, sum(n) AS n_total, count(*) AS k, sum(n * mean) / sum(n) AS grand FROM ag GROUP BY test),
as_ AS (SELECT ag.test, k - 1 AS dfb, n_total - k AS dfw, sum(n * pow(mean - grand, 2)) AS ssb,
               sum(coalesce((n - 1) * var, 0)) AS ssw FROM ag JOIN at_ ON ag.test = at_.test GROUP BY ag.test, k, n_total)""")


@register("q_anova_pvalues", _anova_p_sql())
def q_anova_pvalues(spark, sf_dir):
    """ANOVA tables of all four tests with the p-value of F."""
    p = pops(spark, sf_dir, True, ["Region", *AMOUNTS])
    scaled = [(name, cust.zscale(df, ["TotalSales"], "_scaled"), F.col("TotalSales_scaled"))
              for name, df in (("scaled", p.noout_pos), ("scaled_bulk", p.pos))]
    parts = [inf.anova_oneway(df, y, with_pvalue=True).withColumn("test", F.lit(name))
             for name, df, y in [("log", p.noout_pos, ln_pos("TotalSales")),
                                 ("log_bulk", p.pos, ln_pos("TotalSales")), *scaled]]
    return rnd(reduce(DataFrame.unionByName, parts), default="sig8")


def _tukey_sql(pop: str) -> str:
    return O.with_prefix(f"""
SELECT b.grp || '-' || a.grp AS comparison, {O.sig('b.mean - a.mean', 8)} AS diff,
       {O.sig('sqrt(ssw / (n_total - k) / 2 * (1.0 / a.n + 1.0 / b.n))', 8)} AS se,
       {O.sig('abs(b.mean - a.mean) / sqrt(ssw / (n_total - k) / 2 * (1.0 / a.n + 1.0 / b.n))', 8)}
         AS q
FROM ag a JOIN ag b ON a.grp < b.grp,
     (SELECT sum(n) AS n_total, count(*) AS k, sum(coalesce((n - 1) * var, 0)) AS ssw FROM ag) t""", f"""
ay AS (SELECT Region AS grp, CASE WHEN TotalSales > 0 THEN ln(TotalSales) END AS y FROM {pop}),
ag AS (SELECT grp, count(*) AS n, avg(y) AS mean, var_samp(y) AS var FROM ay
       WHERE y IS NOT NULL GROUP BY grp)""")


def _tukey_q(pop: str):
    def fn(spark, sf_dir):
        df = pops(spark, sf_dir, True, ["Region", *AMOUNTS]).population(pop)
        # differences of close means lose digits to cancellation: 8 significant
        return rnd(inf.tukey_hsd(df, ln_pos("TotalSales")), default="sig8")
    return fn


register("q_tukey_log", _tukey_sql("noout_pos"))(_tukey_q("noout_pos"))
register("q_tukey_log_bulk", _tukey_sql("pos"))(_tukey_q("pos"))


def _normal_cdf_sql(x: str) -> str:
    """Standard normal distribution function by the sine series of a square wave of
    period 36 smoothed by the density (exact to 1e-16 for |x| <= 9; 0 and 1 beyond)."""
    t = math.pi / 18
    series = " + ".join(f"{2 / math.pi * math.exp(-(m * t) ** 2 / 2) / m!r} * sin({m * t!r} * {x})"
                        for m in range(1, 53, 2))
    return f"(CASE WHEN {x} < -9 THEN 0.0 WHEN {x} > 9 THEN 1.0 ELSE 0.5 + {series} END)"


def _range_sql(points: str) -> str:
    """P(studentized range <= q) for the rows (id, q, k, df) of ``points``: trapezoid sums over
    the normal variable (steps of 0.1) and the scale (97 steps of a quarter of its sd; known
    beyond 25,000 degrees of freedom)."""
    return f"""
SELECT id, any_value(q) AS q, sum(w * k * pow(greatest(pz - px, 0), k - 1) * dens) * 0.1 AS p
FROM (SELECT *, {_normal_cdf_sql('x')} AS px
      FROM (SELECT p.id, p.q, p.k, w, dens, pz, z - p.q * s AS x
            FROM ({points}) p JOIN scales ON scales.df = p.df, normal)) GROUP BY id"""


_TUKEY_TESTS = [("log", "noout_pos"), ("log_bulk", "pos")]
_TUKEY_SQL = O.with_prefix(f"""
SELECT t.test, comparison, {O.sig('diff', 8)} AS diff, {O.sig('se', 8)} AS se, {O.sig('t.q', 8)} AS q,
       {O.sig('crit', 8)} AS q_crit, round(diff - crit * se, 7) AS lwr, round(diff + crit * se, 7) AS upr,
       round(1 - c.p, 8) AS p_adj
FROM tk t JOIN (SELECT id, (lo + hi) / 2 AS crit FROM search WHERE i = 44) s ON s.id = t.test
JOIN ({_range_sql("SELECT id, q, k, df FROM tk")}) c ON c.id = t.id""", f"""
ay AS ({" UNION ALL ".join(
    f"SELECT '{t}' AS test, Region AS grp, CASE WHEN TotalSales > 0 THEN ln(TotalSales) END AS y FROM {p}"
    for t, p in _TUKEY_TESTS)}),
ag AS MATERIALIZED (SELECT test, grp, count(*) AS n, avg(y) AS mean, var_samp(y) AS var FROM ay
                    WHERE y IS NOT NULL GROUP BY test, grp),
within AS (SELECT test, sum(n) AS n_total, count(*) AS k, sum(coalesce((n - 1) * var, 0)) AS ssw FROM ag GROUP BY test),
tk AS MATERIALIZED (
  SELECT *, test || comparison AS id, abs(diff) / se AS q
  FROM (SELECT t.test, b.grp || '-' || a.grp AS comparison, b.mean - a.mean AS diff, k, n_total - k AS df,
               sqrt(ssw / (n_total - k) / 2 * (1.0 / a.n + 1.0 / b.n)) AS se
        FROM ag a JOIN ag b ON a.test = b.test AND a.grp < b.grp JOIN within t ON t.test = a.test)),
normal AS MATERIALIZED (SELECT z, exp(-z * z / 2) / sqrt(2 * pi()) AS dens, {_normal_cdf_sql('z')} AS pz
                        FROM (SELECT CAST(i AS DOUBLE) / 10 AS z FROM range(-90, 91) r(i))),
scales AS MATERIALIZED (
  SELECT df, s, f / sum(f) OVER (PARTITION BY df) AS w
  FROM (SELECT df, s, exp((df - 1) * ln(s) - df * (s * s - 1) / 2) AS f
        FROM (SELECT df, CASE WHEN df > 25000 THEN 1.0 ELSE sqrt((df - 1.0) / df) + i / 4.0 / sqrt(2.0 * df) END AS s
              FROM (SELECT DISTINCT df FROM tk), range(-48, 49) r(i) WHERE df <= 25000 OR i = 0) WHERE s > 0)),
search(i, id, k, df, lo, hi) AS (
  SELECT DISTINCT 0, test, k, df, CAST(0 AS DOUBLE), CAST(64 AS DOUBLE) FROM tk
  UNION ALL
  SELECT i + 1, s.id, k, df, CASE WHEN p < 0.95 THEN q ELSE lo END, CASE WHEN p < 0.95 THEN hi ELSE q END
  FROM search s JOIN ({_range_sql("SELECT id, (lo + hi) / 2 AS q, k, df FROM search")}) c ON c.id = s.id
  WHERE i < 44)""").replace("WITH", "WITH RECURSIVE", 1)


@register("q_tukey_tests", _TUKEY_SQL)
def q_tukey_tests(spark, sf_dir):
    """Tukey HSD with adjusted p-values and 95% bounds (studentized range)."""
    p = pops(spark, sf_dir, True, ["Region", *AMOUNTS])
    parts = [inf.tukey_hsd(p.population(pop), ln_pos("TotalSales"), with_pvalue=True).withColumn("test", F.lit(test))
             for test, pop in _TUKEY_TESTS]
    return rnd(reduce(DataFrame.unionByName, parts), {"p_adj": 8, "lwr": 7, "upr": 7}, default="sig8")


# --- customer features for segmentation (M19, M20, A16, A22) -----------------
def _feat_sql(pop: str, return_rate: bool) -> str:
    rr = (", round(avg(CAST(Quantity < 0 AS DOUBLE)), 9) AS ReturnRate" if return_rate else "")
    return O.with_prefix(f"""
SELECT CustomerID, round({_MONEY}, 2) AS TotalSales, round({_MONEY}, 2) AS AverageOrderSize,
       count(*) AS PurchaseFrequency{rr}, count(DISTINCT Invoice) AS distinct_orders
FROM {pop} GROUP BY CustomerID""")


def _feat(pop: str, return_rate: bool):
    def fn(spark, sf_dir):
        df = pops(spark, sf_dir).population(pop)
        return rnd(cust.customer_features(df, return_rate=return_rate),
                   {"TotalSales": 2, "AverageOrderSize": 2, "ReturnRate": 9})
    return fn


register("q_customer_features", _feat_sql("pos", False))(_feat("pos", False))
register("q_customer_features_no_outliers_positive", _feat_sql("noout_pos", False))(
    _feat("noout_pos", False))
register("q_customer_features_no_outliers", _feat_sql("noout", True))(_feat("noout", True))


def _feat_scaled_sql(pop: str, extra: str = "") -> str:
    names = [*cust.FEATURES, *([extra] if extra else [])]
    z = ",\n  ".join(f"round(({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER (), 6) AS {x}_z" for x in names)
    more = ", avg(CAST(Quantity < 0 AS DOUBLE)) AS ReturnRate" if extra else ""
    return O.with_prefix(f"""
SELECT CustomerID, {z}
FROM (SELECT CustomerID, {_MONEY} AS TotalSales, {_MONEY} AS AverageOrderSize,
             count(*) AS PurchaseFrequency{more} FROM {pop} GROUP BY CustomerID) f""")


def _feat_scaled(pop: str, extra: str = ""):
    def fn(spark, sf_dir):
        from tillroll.session import materialize

        names = [*cust.FEATURES, *([extra] if extra else [])]
        df = pops(spark, sf_dir, True, ["CustomerID", "Invoice", *AMOUNTS]).population(pop)
        f = materialize(cust.customer_features(df, return_rate=bool(extra)), "features")
        return rnd(cust.zscale(f, names).select("CustomerID", *[f"{x}_z" for x in names]), default=6)
    return fn


# the three feature sets of the script, scaled
register("q_customer_features_scaled", _feat_scaled_sql("pos"))(_feat_scaled("pos"))
register("q_customer_features_scaled_no_outliers_positive", _feat_scaled_sql("noout_pos"))(_feat_scaled("noout_pos"))
register("q_customer_features_scaled_no_outliers", _feat_scaled_sql("noout", "ReturnRate"))(
    _feat_scaled("noout", "ReturnRate"))


# --- forecast and its accuracy (M14, M15, W7) --------------------------------
_SEASON = config.MONTHLY_PERIOD


def _fc_sql(monthly_sql: str) -> str:
    """Forecast CTEs over a monthly CTE ``ms(series, Date, t, TotalSales)``."""
    return monthly_sql + _FC_BODY


def _ols_sql(name: str, src: str, y: str, xs: list[str], where: str) -> str:
    """CTE ``name(series, b0, b1, ..., v0, v1, ...)``: least squares per series from covariances by
    cofactors (at most three terms); v is the diagonal of the inverse moment matrix."""
    k = len(xs)
    c = [[f"c{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    if k == 0:
        inv, det = [], "1"
    elif k == 1:
        inv, det = [["1.0"]], c[0][0]
    elif k == 2:
        inv = [[c[1][1], f"-{c[0][1]}"], [f"-{c[0][1]}", c[0][0]]]
        det = f"({c[0][0]} * {c[1][1]} - {c[0][1]} * {c[0][1]})"
    else:
        def minor(i, j):
            r, q = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
            sign = "" if (i + j) % 2 == 0 else "-"
            return f"{sign}({c[r[0]][q[0]]} * {c[r[1]][q[1]]} - {c[r[0]][q[1]]} * {c[r[1]][q[0]]})"
        inv = [[minor(i, j) for j in range(3)] for i in range(3)]
        det = "(" + " + ".join(f"{c[0][j]} * ({inv[0][j]})" for j in range(3)) + ")"
    cells = [f"covar_pop({xs[i]}, {xs[j]}) AS c{i}{j}" for i in range(k) for j in range(i, k)]
    cells += [f"covar_pop({x}, {y}) AS g{i}" for i, x in enumerate(xs)] + [f"avg({x}) AS a{i}" for i, x in enumerate(xs)]
    slopes = [f"({' + '.join(f'({inv[i][j]}) * g{j}' for j in range(k))}) / {det}" for i in range(k)]
    means = "".join(f" - a{i} * ({b})" for i, b in enumerate(slopes))
    spread = "".join(f" + a{i} * a{j} * ({inv[i][j]}) / {det} / n" for i in range(k) for j in range(k))
    return f"""{name} AS (SELECT series, ay{means} AS b0{"".join(f", {b} AS b{i + 1}" for i, b in enumerate(slopes))},
  1.0 / n{spread} AS v0{"".join(f", ({inv[i][i]}) / {det} / n AS v{i + 1}" for i in range(k))}
  FROM (SELECT series, count(*) AS n, avg({y}) AS ay{"".join(", " + x for x in cells)} FROM {src} WHERE {where} GROUP BY series))"""


def _value_sql(name: str, xs: list[str]) -> str:
    return f"{name}.b0" + "".join(f" + {name}.b{k} * {x}" for k, x in enumerate(xs, 1))


_ARMA = arma.CANDIDATES
_LONG = {c: [f"{c}{k}" for k in range(1, arma.LONG + 1)] for c in "zd"}
_JOINS = " ".join(f"JOIN o_{m} ON o_{m}.series = l3.series" for m in _ARMA)
_TERMS = {"mean": ("y", [], "TRUE"), "drift": ("d", [], "d IS NOT NULL"), "ar1": ("y", ["y1"], "y1 IS NOT NULL"),
          "ar1_diff": ("d", ["d1"], "d1 IS NOT NULL")}


def _role_sql(role: str) -> str:
    """The chosen model's coefficient in a role (0 where it has none)."""
    held = [(m, [arma.ROLES[x] for x in xs]) for m, (_, xs) in _ARMA.items()]
    return "CASE model " + " ".join(f"WHEN '{m}' THEN o_{m}.b{r.index(role) + 1}" for m, r in held if role in r) + " ELSE 0 END"


_FC_BODY = f""",
l0 AS (SELECT series, t, Date, TotalSales AS y, lag(TotalSales, 1) OVER w AS y1,
              lag(TotalSales, {_SEASON}) OVER w AS ys,
              TotalSales - avg(TotalSales) OVER (PARTITION BY series) AS z,
              TotalSales - lag(TotalSales, 1) OVER w AS d
       FROM ms WINDOW w AS (PARTITION BY series ORDER BY t)),
l1 AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in "zd" for k in range(1, arma.LONG + 1))},
              lag(z, {_SEASON}) OVER w AS zs, count(*) OVER (PARTITION BY series) AS n_all
       FROM l0 WINDOW w AS (PARTITION BY series ORDER BY t)),
{_ols_sql("h_z", "l1", "z", _LONG["z"], f"z{arma.LONG} IS NOT NULL")},
{_ols_sql("h_d", "l1", "d", _LONG["d"], f"d{arma.LONG} IS NOT NULL")},
l2 AS (SELECT l1.*, z - ({_value_sql("h_z", _LONG["z"])}) AS e, d - ({_value_sql("h_d", _LONG["d"])}) AS u
       FROM l1 LEFT JOIN h_z ON h_z.series = l1.series LEFT JOIN h_d ON h_d.series = l1.series),
l3 AS (SELECT *, lag(e, 1) OVER w AS e1, lag(u, 1) OVER w AS u1,
              t > CASE WHEN n_all > {_SEASON + 4} THEN {_SEASON} ELSE 2 END AS scored
       FROM l2 WINDOW w AS (PARTITION BY series ORDER BY t)),
st AS (SELECT series, count(*) AS n, avg(y) AS ybar, avg(d) AS c,
              regr_intercept(y, y1) AS ar_a, regr_slope(y, y1) AS ar_b,
              regr_intercept(d, d1) AS ad_a, regr_slope(d, d1) AS ad_b,
              arg_max(y, t) AS y_n, arg_max(d, t) AS d_n, max(Date) AS dl, max(t) AS tn,
              arg_max(e, t) AS e_n, arg_max(u, t) AS u_n, list(z ORDER BY t) AS zz, list(d ORDER BY t) AS dd
       FROM l3 GROUP BY series),
{", ".join(_ols_sql(f"o_{m}", "l3", y, xs, "scored") for m, (y, xs) in _ARMA.items())},
cv AS (SELECT l3.series, t, Date, y, z, zs, scored,
              ybar AS f_mean, y1 + c AS f_drift, ar_a + ar_b * y1 AS f_ar1,
              y1 + ad_a + ad_b * d1 AS f_ar1_diff, ys AS f_snaive,
              {", ".join(f"{'ybar' if y == 'z' else 'y1'} + {_value_sql(f'o_{m}', xs)} AS f_{m}" for m, (y, xs) in _ARMA.items())}
       FROM l3 JOIN st ON l3.series = st.series {_JOINS}),
rs AS (SELECT series, count(*) AS m_all,
         {", ".join(f"sum(pow(y - f_{m}, 2)) AS sse_{m}, count(f_{m}) AS m_{m}" for m in ts.MODELS)}
       FROM cv WHERE scored GROUP BY series),
cand AS ({" UNION ALL ".join(f"SELECT series, '{m}' AS model, sse_{m} AS sse, m_{m} AS m, {ts.COEFFICIENTS[m]} AS p FROM rs WHERE m_{m} = m_all"
                             for m in ts.MODELS)}),
fit AS (SELECT *, m * ln(sse / m) + 2 * (p + 1)
                  + CAST(2 * (p + 1) * (p + 2) AS DOUBLE) / (m - p - 2) AS aicc,
               sqrt(sse / (m - p)) AS sigma, sqrt(sse / m) AS rmse
        FROM cand WHERE m > p + 2 AND sse > 0),
fitr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY aicc, model) AS r_ FROM fit),
own AS (SELECT l3.series, model, isdiff, CASE model {" ".join(f"WHEN '{m}' THEN o_{m}.b0" for m in _ARMA)} END AS const,
               {", ".join(f"{_role_sql(r)} AS {r}" for r in ("b1", "b2", "bs", "th"))},
               CASE WHEN isdiff THEN dd ELSE zz END AS held, CASE WHEN isdiff THEN u_n ELSE e_n END AS shock
        FROM (SELECT series, model, model LIKE '%_diff' AS isdiff FROM fitr WHERE r_ = 1) l3
        JOIN st ON st.series = l3.series {_JOINS}),
rec AS (SELECT series, 0 AS h, held AS v, list_append(list_transform(range({_SEASON}), lambda i: 0.0::DOUBLE), 1.0::DOUBLE) AS w FROM own
        UNION ALL
        SELECT rec.series, h + 1,
          list_append(v, const + coalesce(b1 * v[-1], 0) + coalesce(b2 * v[-2], 0) + coalesce(bs * v[-{_SEASON}], 0)
                         + CASE WHEN h = 0 THEN th * shock ELSE 0 END),
          list_append(w, b1 * w[-1] + b2 * w[-2] + bs * w[-{_SEASON}] + CASE WHEN h = 0 THEN th ELSE 0 END)
        FROM rec JOIN own ON own.series = rec.series WHERE h < {config.FORECAST_H}),
steps AS (SELECT rec.series, h, v[-1] AS step, w[-2] AS psi, isdiff FROM rec JOIN own ON own.series = rec.series WHERE h > 0),
added AS (SELECT *, CASE WHEN isdiff THEN sum(step) OVER w ELSE step END AS path,
                 CASE WHEN isdiff THEN sum(psi) OVER w ELSE psi END AS weight
          FROM steps WINDOW w AS (PARTITION BY series ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paths AS (SELECT series, h, path, sum(weight * weight) OVER (PARTITION BY series ORDER BY h
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spread2 FROM added),
hz AS (SELECT b.series, b.model, b.sigma, st.n, st.ybar, st.c, st.ar_a, st.ar_b, st.ad_a, st.ad_b,
              st.y_n, st.d_n, st.dl, st.tn, g.h
       FROM fitr b JOIN st ON b.series = st.series CROSS JOIN generate_series(1, {config.FORECAST_H}) AS g(h)
       WHERE b.r_ = 1),
hz2 AS (SELECT *, CASE WHEN ad_b = 1 THEN CAST(h AS DOUBLE) ELSE (1 - pow(ad_b, h)) / (1 - ad_b) END AS s_ad
        FROM hz),
hz3 AS (SELECT hz2.*,
          sum(ad_a * s_ad + pow(ad_b, h) * d_n) OVER (PARTITION BY hz2.series ORDER BY h
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_g,
          sum(pow(s_ad, 2)) OVER (PARTITION BY hz2.series ORDER BY h
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_s2,
          ms.TotalSales AS y_src
        FROM hz2 LEFT JOIN ms ON ms.series = hz2.series
                              AND ms.t = hz2.tn - {_SEASON} + (hz2.h - 1) % {_SEASON} + 1),
fc AS (SELECT hz3.series, model, hz3.h, CAST(dl + to_months(CAST(hz3.h AS INTEGER)) AS DATE) AS Date,
         CASE WHEN model = 'mean' THEN ybar WHEN model = 'drift' THEN y_n + hz3.h * c
              WHEN model = 'ar1' THEN ar_a * (CASE WHEN ar_b = 1 THEN CAST(hz3.h AS DOUBLE)
                                           ELSE (1 - pow(ar_b, hz3.h)) / (1 - ar_b) END)
                              + pow(ar_b, hz3.h) * y_n
              WHEN model = 'ar1_diff' THEN y_n + cum_g WHEN model = 'snaive' THEN y_src
              WHEN model LIKE '%_diff' THEN y_n + path ELSE ybar + path END AS point,
         sigma * sqrt(CASE model WHEN 'mean' THEN 1 + 1 / n
              WHEN 'drift' THEN hz3.h * (1 + hz3.h / (n - 1))
              WHEN 'ar1' THEN (CASE WHEN abs(ar_b) = 1 THEN CAST(hz3.h AS DOUBLE)
                                    ELSE (1 - pow(ar_b, 2 * hz3.h)) / (1 - pow(ar_b, 2)) END)
              WHEN 'ar1_diff' THEN cum_s2 WHEN 'snaive' THEN floor((hz3.h - 1) / {_SEASON}) + 1 ELSE spread2 END) AS se
       FROM hz3 LEFT JOIN paths ON paths.series = hz3.series AND paths.h = hz3.h),
cvf AS (SELECT cv.*, model, p, m, sse, sigma, aicc, rmse,
               CASE model {" ".join(f"WHEN '{m}' THEN f_{m}" for m in ts.MODELS)} END AS fitted
        FROM cv JOIN fitr ON cv.series = fitr.series AND r_ = 1),
{", ".join(_ols_sql(f"k_{m}", "l3", y, xs, where) for m, (y, xs, where) in _TERMS.items())}"""


def _fc_query(body: str, monthly_sql: str) -> str:
    """Oracle text over the forecast CTEs, some of them recursive."""
    return O.with_prefix(body, _fc_sql(monthly_sql)).replace("WITH", "WITH RECURSIVE", 1)




@register("q_forecast_monthly", _fc_query(f"""
SELECT series, model, CAST(h AS INTEGER) AS h, Date, {O.sig('point', 8)} AS forecast,
       {O.sig('se', 8)} AS se,
       {O.sig(f'point - {ts.Z80} * se', 8)} AS lo80, {O.sig(f'point + {ts.Z80} * se', 8)} AS hi80,
       {O.sig(f'point - {ts.Z95} * se', 8)} AS lo95, {O.sig(f'point + {ts.Z95} * se', 8)} AS hi95
FROM fc""", _MONTHLY_SQL))
def q_forecast_monthly(spark, sf_dir):
    return rnd(ts.forecast(_monthly(spark, sf_dir)), default="sig8")


@register("q_forecast_rmse", _fc_query(f"""
SELECT series, model, p, m, {O.sig('sse', 8)} AS sse, {O.sig('sigma', 8)} AS sigma,
       {O.sig('aicc', 8)} AS aicc, {O.sig('rmse', 8)} AS rmse, r_ = 1 AS chosen
FROM fitr""", _MONTHLY_SQL))
def q_forecast_rmse(spark, sf_dir):
    return rnd(ts.forecast_accuracy(_monthly(spark, sf_dir)), default="sig8")


@register("q_forecast_fitted", _fc_query(f"""
SELECT cv.series, Date, model, round(y, 2) AS TotalSales, {O.sig('fitted', 8)} AS fitted,
       round(y - fitted, 0) AS residual
FROM cvf cv""", _MONTHLY_SQL))
def q_forecast_fitted(spark, sf_dir):
    """Fitted value and residual per month of the chosen model."""
    return rnd(ts.fitted_values(_monthly(spark, sf_dir)), {"TotalSales": 2, "residual": 0}, default="sig8")


_TERM_ROWS = " UNION ALL ".join(
    f"SELECT '{m}' AS model, series, {i} AS i, '{x}' AS term, b{i} AS b, v{i} AS v FROM {c}_{m}"
    for c, own in (("k", {m: xs for m, (_, xs, _) in _TERMS.items()}), ("o", {m: xs for m, (_, xs) in _ARMA.items()}))
    for m, xs in own.items() for i, x in enumerate(["const", *xs]))


@register("q_forecast_coefficients", _fc_query(f"""
SELECT c.series, c.model, term, {O.sig('b', 6)} AS estimate, {O.sig('sigma * sqrt(v)', 6)} AS std_error
FROM ({_TERM_ROWS}) c JOIN fitr ON fitr.series = c.series AND fitr.model = c.model AND r_ = 1""", _MONTHLY_SQL))
def q_forecast_coefficients(spark, sf_dir):
    """Coefficients and standard errors of the chosen model of each monthly series."""
    return rnd(ts.forecast_coefficients(_monthly(spark, sf_dir)), default="sig6")


_SUMMARY_SQL = f"""
SELECT series, model, p, m, {O.sig('pow(sigma, 2)', 8)} AS sigma2, round(ll, 6) AS loglik,
       round(2 * (p + 1) - 2 * ll, 6) AS aic, round(aicc, 6) AS aicc, round((p + 1) * ln(m) - 2 * ll, 6) AS bic,
       round(me, 0) AS me, {O.sig('rmse', 8)} AS rmse, {O.sig('mae', 8)} AS mae, round(mpe, 6) AS mpe, round(mape, 6) AS mape,
       round(mae / scale, 6) AS mase, round(acf1, 6) AS acf1
FROM (SELECT series, any_value(model) AS model, any_value(p) AS p, any_value(m) AS m, any_value(sigma) AS sigma,
             any_value(aicc) AS aicc, any_value(rmse) AS rmse, any_value(scale) AS scale,
             any_value(-m / 2.0 * (ln(2 * pi() * sse / m) + 1)) AS ll, avg(e) AS me, avg(abs(e)) AS mae,
             avg(100 * e / y) AS mpe, avg(100 * abs(e / y)) AS mape, sum(ce * ce1) / sum(ce * ce) AS acf1
      FROM (SELECT *, lag(ce, 1) OVER (PARTITION BY series ORDER BY t) AS ce1
            FROM (SELECT *, e - avg(e) OVER (PARTITION BY series) AS ce
                  FROM (SELECT cvf.*, y - fitted AS e, avg(abs(z - zs)) OVER (PARTITION BY series) AS scale FROM cvf)
                  WHERE scored))
      GROUP BY series)"""


def _summary(monthly: DataFrame) -> DataFrame:
    return rnd(ts.forecast_summary(monthly), {"sigma2": "sig8", "rmse": "sig8", "mae": "sig8", "me": 0})


@register("q_forecast_summary", _fc_query(_SUMMARY_SQL, _MONTHLY_SQL))
def q_forecast_summary(spark, sf_dir):
    """Information criteria and training measures of the chosen model of each monthly series."""
    return _summary(_monthly(spark, sf_dir))


# --- segmentation (M21-M26): random starts, so checked by invariants ---------
from tillroll.operators import clustering as clus  # noqa: E402


def _features(spark, sf_dir):
    """Customer features, written once: every clustering pass reads them."""
    from tillroll.session import materialize

    return materialize(cust.customer_features(pops(spark, sf_dir).pos).drop("distinct_orders"), "features")


def _segments(spark, sf_dir):
    return clus.segment(_features(spark, sf_dir))[0]


@register("q_kmeans_profile")
def q_kmeans_profile(spark, sf_dir):
    return rnd(clus.cluster_profile(_segments(spark, sf_dir)), default="sig")


#: Two of the three features are equal, so with r their correlation to the third the
#: eigenvalues are (3 +- sqrt(1 + 8 r^2)) / 2 and 0, the eigenvectors (1, 1, (l - 2) / r) and one of noise.
_PCA_SQL = """
SELECT CustomerID, round(s1 * (2 * a + c1 * b) / sqrt(2 + c1 * c1), 6) AS PC1,
       round(s2 * (2 * a + c2 * b) / sqrt(2 + c2 * c2), 6) AS PC2, 0.0 AS PC3
FROM z, (SELECT *, CASE WHEN abs(c1) > 1 AND c1 < 0 THEN -1 ELSE 1 END AS s1,
                   CASE WHEN abs(c2) > 1 AND c2 < 0 THEN -1 ELSE 1 END AS s2
         FROM (SELECT ((3 + sqrt(1 + 8 * r * r)) / 2 - 2) / r AS c1, ((3 - sqrt(1 + 8 * r * r)) / 2 - 2) / r AS c2
               FROM (SELECT corr(a, b) AS r FROM z) r) c) e"""


@register("q_pca_scores", O.with_prefix(_PCA_SQL, f"""
z AS (SELECT CustomerID, (ts - avg(ts) OVER ()) / stddev_samp(ts) OVER () AS a,
             (pf - avg(pf) OVER ()) / stddev_samp(pf) OVER () AS b
      FROM (SELECT CustomerID, {_MONEY} AS ts, count(*) AS pf FROM pos GROUP BY CustomerID) f)"""))
def q_pca_scores(spark, sf_dir):
    return rnd(_segments(spark, sf_dir).select("CustomerID", "PC1", "PC2", "PC3"), default=6)


@register("q_cluster_projection")
def q_cluster_projection(spark, sf_dir):
    """The first two components with each customer's cluster."""
    return rnd(_segments(spark, sf_dir).select("CustomerID", "PC1", "PC2", "Cluster"), default=6)


def _elbow(spark, sf_dir, **how):
    vecs = clus.scaled_vectors(_features(spark, sf_dir)).persist()
    vecs.count()
    try:
        return rnd(clus.elbow(vecs, **how), default="sig")
    finally:
        vecs.unpersist()


@register("q_elbow")
def q_elbow(spark, sf_dir):
    return _elbow(spark, sf_dir)


#: The same searches from the rows of the first customers, one change of a row at a time, so that SQL can follow.
_FIXED_KS = [1, 2, 3, 4, 5]
_FIXED = {"start_key": "CustomerID", "slots": 1, "moves": 1}


def _kmeans_sql(body: str, ks) -> str:
    """CTEs ``km`` (final state per k: c centres, wss) and ``lab`` (rows with their
    1-based cluster) by recursion: a Lloyd step while the centres move, else the best
    single change of cluster while it gains more than 1e-9 of the sum of squares."""
    starts = ", ".join(f"({k})" for k in ks)
    return O.with_prefix(body, f"""
feat AS (SELECT CustomerID, {_MONEY} AS ts, count(*) AS pf FROM pos GROUP BY CustomerID),
z AS MATERIALIZED (SELECT CustomerID, ts, pf, (ts - avg(ts) OVER ()) / stddev_samp(ts) OVER () AS a,
                          (pf - avg(pf) OVER ()) / stddev_samp(pf) OVER () AS b FROM feat),
step(it, k, c, wss, done) AS (
  SELECT 0, k, rows[1:k], CAST(NULL AS DOUBLE), false
  FROM (VALUES {starts}) v(k), (SELECT list([a, a, b] ORDER BY CustomerID NULLS LAST) AS rows FROM z)
  UNION ALL
  (WITH near AS MATERIALIZED (
     SELECT it, k, c, a, b, list_position(ds, list_min(ds)) AS cl, list_min(ds) AS d2
     FROM (SELECT it, k, c, a, b, list_transform(c, lambda m: pow(a - m[1], 2) + pow(a - m[2], 2) + pow(b - m[3], 2)) AS ds
           FROM step, z WHERE NOT done AND it < 500)),
   means AS (SELECT it, k, any_value(c) AS c, cl, count(*) AS n, avg(a) AS a, avg(b) AS b, sum(d2) AS ss
             FROM near GROUP BY it, k, cl),
   state AS (SELECT it, k, any_value(c) AS c, list([a, a, b] ORDER BY cl) AS nc, list(n ORDER BY cl) AS ns, sum(ss) AS wss
             FROM means GROUP BY it, k),
   still AS MATERIALIZED (
     SELECT *, len(nc) = k AND list_max(list_transform(list_zip(flatten(c), flatten(nc)), lambda p: abs(p[1] - p[2]))) <= 1e-7
                 AS stands FROM state),
   gains AS (
     SELECT s.k, cl, g.goal, a, b,
            ns[cl] / (ns[cl] - 1) * (pow(a - nc[cl][1], 2) + pow(a - nc[cl][2], 2) + pow(b - nc[cl][3], 2))
            - ns[g.goal] / (ns[g.goal] + 1)
              * (pow(a - nc[g.goal][1], 2) + pow(a - nc[g.goal][2], 2) + pow(b - nc[g.goal][3], 2)) AS gain
     FROM still s JOIN near ON near.k = s.k, range(1, {max(ks) + 1}) g(goal)
     WHERE stands AND g.goal <= s.k AND g.goal <> cl AND ns[cl] > 1),
   best AS (SELECT k, max(row(gain, a, b, cl, goal)) AS t FROM gains GROUP BY k),
   pick AS (SELECT k, t[1] AS gain, t[2] AS a, t[3] AS b, t[4] AS cl, t[5] AS goal FROM best)
   SELECT it + 1, s.k,
          CASE WHEN gain > 1e-9 * wss THEN list_transform(nc, lambda m, i:
            CASE WHEN i = cl THEN list_transform(list_zip(m, [a, a, b]), lambda p: (ns[cl] * p[1] - p[2]) / (ns[cl] - 1))
                 WHEN i = goal THEN list_transform(list_zip(m, [a, a, b]), lambda p: (ns[goal] * p[1] + p[2]) / (ns[goal] + 1))
                 ELSE m END) ELSE nc END,
          wss, stands AND coalesce(gain <= 1e-9 * wss, true)
   FROM still s LEFT JOIN pick ON pick.k = s.k)),
km AS (SELECT k, c, wss FROM step WHERE done),
lab AS (SELECT k, CustomerID, ts, pf, CAST(list_position(ds, list_min(ds)) AS INTEGER) AS Cluster
        FROM (SELECT km.k, z.*, list_transform(c, lambda m: pow(a - m[1], 2) + pow(a - m[2], 2) + pow(b - m[3], 2)) AS ds
              FROM km, z))""").replace("WITH", "WITH RECURSIVE", 1)


@register("q_kmeans_fixed", _kmeans_sql(f"""
SELECT Cluster, {O.sig('avg(ts)', 8)} AS AverageSales, {O.sig('avg(ts)', 8)} AS AvgOrderSize,
       {O.sig('avg(pf)', 8)} AS AvgPurchaseFrequency, count(*) AS customers FROM lab GROUP BY Cluster""", [3]))
def q_kmeans_fixed(spark, sf_dir):
    """Profile of three clusters from the fixed start."""
    lab, _ = clus.segment(_features(spark, sf_dir), 3, **_FIXED)
    return rnd(clus.cluster_profile(lab), default="sig8")


@register("q_cluster_projection_fixed", _kmeans_sql(f"""
SELECT p.CustomerID, PC1, PC2, Cluster FROM lab JOIN ({_PCA_SQL}) p
ON p.CustomerID IS NOT DISTINCT FROM lab.CustomerID""", [3]))
def q_cluster_projection_fixed(spark, sf_dir):
    """The first two components with each customer's cluster from the fixed start."""
    lab, _ = clus.segment(_features(spark, sf_dir), 3, **_FIXED)
    return rnd(lab.select("CustomerID", "PC1", "PC2", "Cluster"), default=6)


@register("q_elbow_fixed", _kmeans_sql(f"SELECT k, {O.sig('wss', 8)} AS wss FROM km", _FIXED_KS))
def q_elbow_fixed(spark, sf_dir):
    """Sum of squares for one to five clusters from the fixed starts."""
    return rnd(_elbow(spark, sf_dir, ks=_FIXED_KS, **_FIXED), default="sig8")


# --- CSV ingestion round trip (S1, S2, X13) ----------------------------------
@register("q_csv_roundtrip", O.with_prefix(f"SELECT {_SC_COLS} FROM sc"))
def q_csv_roundtrip(spark, sf_dir):
    """Raw lines written as invoice CSV files (shared checkpoint folder), scanned
    back through the CSV source and cleaned: every line must come out as it
    does from the tables, dates with their seconds."""
    import uuid

    from tillroll.session import ensure_checkpoint_dir
    from tillroll.sources.retail import read_invoice_csv, write_invoice_csv

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/csv-{uuid.uuid4().hex}"
    paths = write_invoice_csv(retail_from_tables(spark, sf_dir), base)
    return rnd(clean.clean_lines(read_invoice_csv(spark, paths)), {"TotalSales": 4})


_BAD_QUANTITY = "CASE WHEN CAST(StockCode AS BIGINT) % 53 = 0 THEN '?' ELSE '1O' END"


@register("q_csv_bad_rows", O.with_prefix(f"""
SELECT src_rank, 'Quantity' AS column, count(*) AS n_fields, count(DISTINCT {_BAD_QUANTITY}) AS n_values
FROM raw WHERE CAST(StockCode AS BIGINT) % 53 <= 1 GROUP BY src_rank
UNION ALL
SELECT src_rank, 'InvoiceDate', count(*), 1 FROM raw WHERE CAST(StockCode AS BIGINT) % 59 = 0 GROUP BY src_rank"""))
def q_csv_bad_rows(spark, sf_dir):
    """Raw lines written as CSV with broken quantities and dates among them, scanned back: how
    many fields of each file and column are quarantined."""
    import uuid

    from tillroll.session import ensure_checkpoint_dir
    from tillroll.sources.retail import csv_bad_counts, csv_bad_fields, write_invoice_csv

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/csv-{uuid.uuid4().hex}"
    code = F.col("StockCode").cast("long")
    raw = retail_from_tables(spark, sf_dir).withColumns({
        "Quantity": F.when(code % 53 <= 1, F.expr(_BAD_QUANTITY)).otherwise(F.col("Quantity").cast("string")),
        "Broken": code % 59 == 0})
    paths = write_invoice_csv(raw, base, broken_date="Broken")
    return csv_bad_counts(csv_bad_fields(spark, paths))


# --- min-max scaling over all clean lines (M5, M6, W8) -----------------------
@register("q_scaled_lines", O.with_prefix("""
SELECT Invoice, StockCode, Quantity, Price, CustomerID,
       round((Quantity - qmin_) / NULLIF(qmax_ - qmin_, 0), 9) AS Quantity_MinMax,
       round((Price - pmin_) / NULLIF(pmax_ - pmin_, 0), 9) AS Price_MinMax,
       round((TotalSales - smin_) / NULLIF(smax_ - smin_, 0), 9) AS TotalSales_MinMax
FROM sc, (SELECT min(Quantity) AS qmin_, max(Quantity) AS qmax_, min(Price) AS pmin_,
                 max(Price) AS pmax_, min(TotalSales) AS smin_, max(TotalSales) AS smax_
          FROM sc) m_"""))
def q_scaled_lines(spark, sf_dir):
    """SC with min-max Quantity, Price and TotalSales (statistics over all lines)."""
    df = pops(spark, sf_dir, True, ["Invoice", "StockCode", "CustomerID", *AMOUNTS]).scaled_all
    return rnd(df.select("Invoice", "StockCode", "Quantity", "Price", "CustomerID",
                         "Quantity_MinMax", "Price_MinMax", "TotalSales_MinMax"), default=9)


@register("q_minmax_no_outliers_positive", O.with_prefix("""
SELECT Quantity, Price, round((TotalSales - lo) / NULLIF(hi - lo, 0), 9) AS TotalSales_MinMax
FROM noout_pos, (SELECT min(TotalSales) AS lo, max(TotalSales) AS hi FROM noout_pos) m_"""))
def q_minmax_no_outliers_positive(spark, sf_dir):
    """Min-max TotalSales of the positive lines without outliers."""
    df = pops(spark, sf_dir, True, AMOUNTS).noout_pos
    return rnd(clean.minmax_columns(df, ["TotalSales"]).select("Quantity", "Price", "TotalSales_MinMax"), default=9)


# --- many series in one job: monthly forecast per region (M14 at scale) -----
_MONTHLY_BY_REGION_SQL = f"""
mo AS (SELECT Region AS series, CAST(date_trunc('month', InvoiceDate) AS DATE) AS Date,
              {_MONEY} AS TotalSales FROM pos GROUP BY 1, 2),
ms AS (SELECT series, Date,
              CAST(row_number() OVER (PARTITION BY series ORDER BY Date) AS INTEGER) AS t,
              TotalSales FROM mo)"""


@register("q_forecast_by_region", _fc_query(f"""
SELECT series, model, CAST(h AS INTEGER) AS h, Date, {O.sig('point', 8)} AS forecast,
       {O.sig('se', 8)} AS se,
       {O.sig(f'point - {ts.Z80} * se', 8)} AS lo80, {O.sig(f'point + {ts.Z80} * se', 8)} AS hi80,
       {O.sig(f'point - {ts.Z95} * se', 8)} AS lo95, {O.sig(f'point + {ts.Z95} * se', 8)} AS hi95
FROM fc""", _MONTHLY_BY_REGION_SQL))
def q_forecast_by_region(spark, sf_dir):
    """One monthly series per region, all fitted and forecast in one job
    (windows partitioned by series)."""
    m = materialize(ts.monthly_sales(pops(spark, sf_dir).pos, by="Region"), "monthly")
    return rnd(ts.forecast(m), default="sig8")


@register("q_forecast_summary_by_region", _fc_query(_SUMMARY_SQL, _MONTHLY_BY_REGION_SQL))
def q_forecast_summary_by_region(spark, sf_dir):
    """The summary of one monthly series per region, all in one job."""
    return _summary(materialize(ts.monthly_sales(pops(spark, sf_dir).pos, by="Region"), "monthly"))


@register("q_decompose_by_region", _decomp_sql("""
dd AS (SELECT Region AS series, CAST(InvoiceDate AS DATE) AS d,
              sum(TotalSales) AS v FROM sc GROUP BY 1, 2)"""))
def q_decompose_by_region(spark, sf_dir):
    """Daily decomposition of one series per region, all in one job."""
    sc = pops(spark, sf_dir).sc
    d = ts.with_position(ts.daily_sales(sc.withColumn("series", F.col("Region")), by="series"),
                         "InvoiceDate")
    dec = ts.decompose(d, "TotalSales", config.DAILY_PERIOD)
    return rnd(dec.select("series", "InvoiceDate", "t", "TotalSales", "trend", "seasonal",
                          "remainder"),
               {"TotalSales": 2, "trend": 4, "seasonal": 2, "remainder": 3})


# --- result tables written and read back (S3), days without sales (T11) -------
@register("q_published_lines", O.with_prefix(f"""
SELECT Year, Region, count(*) AS n_lines, {O.sig("sum(TotalSales)")} AS total_sales
FROM sc WHERE Year >= 1995 GROUP BY Year, Region"""))
def q_published_lines(spark, sf_dir):
    """Clean lines published as a table partitioned by year, and a report on the later years read
    from it: folders of other years are not opened."""
    import uuid

    from tillroll.session import ensure_checkpoint_dir
    from tillroll.sources.sinks import publish

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/published-{uuid.uuid4().hex}"
    publish(pops(spark, sf_dir).sc, path, partition_by=["Year"], mode="errorifexists")
    lines = spark.read.parquet(path).where("Year >= 1995")
    return rnd(lines.groupBy("Year", "Region").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("TotalSales").alias("total_sales")), default="sig")


@register("q_bulk_days_filled", O.with_prefix("""
SELECT d.series, CAST(d.InvoiceDate AS DATE) AS InvoiceDate, round(coalesce(x.TotalSales, 0.0), 2) AS TotalSales
FROM (SELECT series, unnest(generate_series(min(InvoiceDate)::TIMESTAMP, max(InvoiceDate)::TIMESTAMP,
             INTERVAL 1 DAY)) AS InvoiceDate FROM bd GROUP BY series) d
LEFT JOIN bd x ON x.series = d.series AND x.InvoiceDate = CAST(d.InvoiceDate AS DATE)""", f"""
bd AS (SELECT Region AS series, CAST(InvoiceDate AS DATE) AS InvoiceDate, sum(TotalSales) AS TotalSales
       FROM sc WHERE Quantity >= {config.BULK_INCLUSIVE} GROUP BY 1, 2)"""))
def q_bulk_days_filled(spark, sf_dir):
    """Daily bulk sales of each region, with 0 on the days between without any."""
    p = pops(spark, sf_dir, True, ["InvoiceDate", "Region", *AMOUNTS])
    daily = materialize(ts.daily_sales(p.bulk, by="Region"), "daily")
    return rnd(ts.fill_gaps(daily), default=2)
