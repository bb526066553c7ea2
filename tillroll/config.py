"""Fixed values and default parameters.

Everything the analysis must agree on lives here: the country -> region
lists, the one-hot level order, the thresholds and the horizons.  Operators
take these as keyword defaults so callers can override any of them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- must equal the analysed script's values for equal results.
# Country lists per region, in the script's order (first matching list wins,
# so "Lithuania" lands in EU; "Israel" is listed twice in APAC).
# ---------------------------------------------------------------------------
REGION_COUNTRIES: list[tuple[str, list[str]]] = [
    ("EU", [
        "European Community", "Iceland", "West Indies", "United Kingdom",
        "Channel Islands", "France", "Belgium", "EIRE", "Germany", "Portugal",
        "Netherlands", "Poland", "Spain", "Italy", "Cyprus", "Greece", "Austria",
        "Sweden", "Norway", "Denmark", "Finland", "Switzerland", "Malta",
        "Lithuania", "Czech Republic",
    ]),
    ("NA/LATAM", ["USA", "Canada", "Brazil"]),
    ("APAC", [
        "Australia", "Israel", "Bahrain", "New Zealand", "Japan", "Hong Kong",
        "Singapore", "Thailand", "Israel", "Lebanon", "Korea",
        "United Arab Emirates", "Saudi Arabia",
    ]),
    ("AFRICA", ["Nigeria", "RSA", "Lithuania"]),
]
DEFAULT_REGION = "Other"
# One-hot levels, sorted as a model matrix sorts factor levels.
REGION_LEVELS: list[str] = ["AFRICA", "APAC", "EU", "NA/LATAM", "Other"]
OVERALL = "Overall"

# Thresholds used by the script (see the operator docstrings for where).
BULK_STRICT = 25.0        # "bulk transactions": Quantity > 25
BULK_INCLUSIVE = 25.0     # bulk lines / impact split: Quantity >= 25 vs < 25
Z_OUTLIER = 3.0           # |z| > 3 is an outlier
LOW_ORDER = 1.0           # low-value lines: TotalSales < 1
CHURN_REFERENCE_DATE = "2011-12-01"
CHURN_DAYS = 180
SPLIT_P = 0.8             # 80/20 train/test split
SPLIT_GROUPS = 5          # quantile breaks for the stratified split (4 strata)
DAILY_PERIOD = 30         # period of the daily series decomposition
MONTHLY_PERIOD = 12       # period of the monthly series
FORECAST_H = 12
KMEANS_K = 3
KMEANS_STARTS = 25
ELBOW_K = list(range(1, 11))
ELBOW_STARTS = 10
PCA_K = 3
# Histogram bin widths used by the script's distribution views.
HIST_WIDTH_NEGATIVE = 1.0
HIST_WIDTH_SALES = 100.0
HIST_WIDTH_LOG_SALES = 0.1
HIST_WIDTH_LOG_SALES_NOOUT = 0.5

# Column names of the cleaned line table, in projection order.
CLEAN_COLUMNS: list[str] = [
    "Invoice", "StockCode", "Description", "InvoiceDate", "Month", "Day", "Year",
    "Quantity", "Price", "TotalSales", "CustomerID", "Country",
    "RegionAFRICA", "RegionAPAC", "RegionEU", "RegionNA/LATAM", "RegionOther",
]
# Dedup key of the script (5 of the 8 source columns).
DEDUP_KEYS: list[str] = ["Invoice", "StockCode", "Quantity", "Price", "CustomerID"]
SOURCE_COLUMNS: list[str] = [
    "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price",
    "CustomerID", "Country",
]

# ---------------------------------------------------------------------------
# FIXED VALUES of the test-table recipe (FIXTURES.md section 3): the country
# given to nation key k = 0..24, in this order.
# ---------------------------------------------------------------------------
FIXTURE_COUNTRIES: list[str] = [
    "United Kingdom", "France", "USA", "Australia", "Nigeria", "Germany", "Canada",
    "Japan", "RSA", "Unspecified", "EIRE", "Brazil", "Israel", "Lithuania",
    "Bermuda", "Spain", "West Indies", "Singapore", "Korea", "Netherlands",
    "Iceland", "Hong Kong", "Italy", "Malta", "Lebanon",
]
