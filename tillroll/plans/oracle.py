"""DuckDB SQL oracles for the registered queries.

Every oracle starts from the same CTE chain (RAW -> NODUP -> REG -> SC and
the other populations), written once here and generated from the same fixed
values as the Spark side (``tillroll.config``).  Each query body then reads
one of the population CTEs.  Doubles are rounded identically on both sides.
"""

from __future__ import annotations

from tillroll import config


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _region_case(col: str = "Country") -> str:
    parts = []
    for label, countries in config.REGION_COUNTRIES:
        parts.append(f"WHEN {col} IN ({', '.join(_q(x) for x in dict.fromkeys(countries))}) "
                     f"THEN {_q(label)}")
    return f"CASE {' '.join(parts)} ELSE {_q(config.DEFAULT_REGION)} END"


def _dim_values() -> str:
    return ", ".join(f"({k}, {_q(n)})" for k, n in enumerate(config.FIXTURE_COUNTRIES))


def _onehot() -> str:
    return ", ".join(f"CAST(Region = {_q(lv)} AS INTEGER) AS \"Region{lv}\""
                     for lv in config.REGION_LEVELS)


def prefix() -> str:
    """CTEs: raw, nodup, reg, sc, pos, neg, sc_z, noout, noout_pos, nolow, scaled."""
    return f"""
WITH dim(k, country) AS (VALUES {_dim_values()}),
b AS (SELECT CAST(l_orderkey AS VARCHAR) AS Invoice, CAST(l_partkey AS VARCHAR) AS StockCode,
   CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE p_name END AS Description,
   CASE WHEN l_linenumber = 7 AND l_tax = 0.0 THEN 0.0
        WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN -l_quantity
        WHEN l_partkey % 97 = 0 THEN l_quantity * 40 ELSE l_quantity END AS Quantity,
   o_orderdate AS InvoiceDate,
   CASE WHEN l_discount = 0.0 AND l_tax = 0.0 THEN 0.0
        WHEN l_discount = 0.01 AND l_tax = 0.01 THEN 0.01 ELSE l_extendedprice END AS Price,
   CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS CustomerID, country AS Country
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN part ON l_partkey = p_partkey
 JOIN dim ON k = (c_nationkey + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END) % 25),
raw AS (SELECT 1 AS src_rank, * FROM b WHERE InvoiceDate < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 2 AS src_rank, * FROM b WHERE InvoiceDate >= TIMESTAMP '1998-12-01'),
nodup AS (SELECT src_rank, Invoice, StockCode, Description, Quantity, InvoiceDate, Price,
                 CustomerID, Country FROM (
   SELECT *, row_number() OVER (PARTITION BY Invoice, StockCode, Quantity, Price, CustomerID
          ORDER BY src_rank, InvoiceDate NULLS LAST, Description NULLS FIRST,
                   Country NULLS FIRST) AS rn_ FROM raw) t WHERE rn_ = 1),
reg AS (SELECT *, Quantity * Price AS TotalSales, {_region_case()} AS Region
        FROM nodup WHERE Quantity <> 0 AND Price <> 0),
sc AS (SELECT Invoice, StockCode, Description, InvoiceDate,
          CAST(month(InvoiceDate) AS INTEGER) AS Month, CAST(isodow(InvoiceDate) AS INTEGER) AS Day,
          CAST(year(InvoiceDate) AS INTEGER) AS Year, Quantity, Price, TotalSales, CustomerID,
          Country, {_onehot()}, Region, src_rank FROM reg),
pos AS (SELECT * FROM sc WHERE TotalSales >= 0 AND Quantity >= 0),
neg AS (SELECT * FROM sc WHERE TotalSales < 0),
qstat AS (SELECT avg(Quantity) AS mu_, stddev_samp(Quantity) AS sd_ FROM sc),
sc_z AS (SELECT sc.*, (Quantity - mu_) / sd_ AS z_score FROM sc, qstat),
noout AS (SELECT * EXCLUDE (z_score) FROM sc_z WHERE abs(z_score) <= {config.Z_OUTLIER}),
noout_pos AS (SELECT * FROM noout WHERE Quantity >= 0 AND Price >= 0),
nolow AS (SELECT * FROM noout_pos WHERE TotalSales >= {config.LOW_ORDER}),
pstat AS (SELECT min(Quantity) AS qmin_, max(Quantity) AS qmax_, min(Price) AS pmin_,
                 max(Price) AS pmax_, min(TotalSales) AS smin_, max(TotalSales) AS smax_ FROM pos),
scaled AS (SELECT pos.*, (Quantity - qmin_) / NULLIF(qmax_ - qmin_, 0) AS Quantity_MinMax,
                  (Price - pmin_) / NULLIF(pmax_ - pmin_, 0) AS Price_MinMax,
                  (TotalSales - smin_) / NULLIF(smax_ - smin_, 0) AS TotalSales_MinMax
           FROM pos, pstat)
"""


def with_prefix(body: str, extra_ctes: str = "") -> str:
    """Full oracle text: shared CTEs, optional extra CTEs, then the body."""
    extra = f",\n{extra_ctes.strip().rstrip(',')}\n" if extra_ctes.strip() else "\n"
    return prefix().rstrip() + extra + body.strip() + "\n"


def kpi_sql(pop: str, sales: str = "TotalSales", qty: str = "Quantity",
            rs: tuple = ("sig", 4, 3), rq: tuple[int, int, int] = (6, 6, 6)) -> str:
    """Overall + per-region key figures of one population (grouping sets).
    ``rs`` / ``rq``: decimals for mean, median, sd of sales / quantity."""
    mean = sig(f"avg({sales})") if rs[0] == "sig" else f"round(avg({sales}), {rs[0]})"
    return with_prefix(f"""
SELECT CASE WHEN GROUPING(Region) = 1 THEN 'Overall' ELSE Region END AS Region,
  CAST(count(DISTINCT CustomerID) AS BIGINT) AS Unique_Customers,
  CAST(count(DISTINCT CASE WHEN CustomerID IS NULL THEN Invoice END)
       + coalesce(max(CAST(CustomerID IS NULL AND Invoice IS NULL AS INTEGER)), 0) AS BIGINT)
       AS Guest_Customers,
  {mean} AS Mean_Total_Sales,
  round(median({sales}), {rs[1]}) AS Median_Total_Sales,
  round(stddev_samp({sales}), {rs[2]}) AS SD_Total_Sales,
  round(avg({qty}), {rq[0]}) AS Mean_Quantity,
  round(median({qty}), {rq[1]}) AS Median_Quantity,
  round(stddev_samp({qty}), {rq[2]}) AS SD_Quantity,
  CAST(count(DISTINCT Invoice) + coalesce(max(CAST(Invoice IS NULL AS INTEGER)), 0) AS BIGINT)
       AS Total_Unique_Invoices
FROM {pop} GROUP BY GROUPING SETS ((Region), ())
""")



def sig(expr: str, digits: int = 10) -> str:
    """SQL twin of ``catalog.sig``: round to significant digits."""
    e = f"(floor(log10(abs({expr}))) - {digits - 1})"
    up, down = f"pow(10.0, -{e})", f"pow(10.0, {e})"
    return (f"(CASE WHEN ({expr}) = 0 THEN 0.0 WHEN {e} < 0 THEN round(({expr}) * {up}) / {up} "
            f"ELSE round(({expr}) / {down}) * {down} END)")

