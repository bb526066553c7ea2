"""Column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll import config


def c(name: str) -> Column:
    """Column by name; names with '/' (RegionNA/LATAM) need back-ticks."""
    return F.col(f"`{name}`")


def region_of(country: Column | str = "Country",
              mapping=config.REGION_COUNTRIES,
              default: str = config.DEFAULT_REGION) -> Column:
    """Country -> region label; the first list that contains the country wins.

    ``isin`` on a null country is null, which ``when`` treats as false, so a
    null country falls through to the default exactly like ``%in%``.
    """
    country = F.col(country) if isinstance(country, str) else country
    expr = None
    for label, countries in mapping:
        cond = country.isin(*dict.fromkeys(countries))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def onehot_name(level: str) -> str:
    return f"Region{level}"


def region_onehot(region: Column | str = "Region",
                  levels=config.REGION_LEVELS) -> list[Column]:
    """One 0/1 int column per level (fixed list, so every column always exists)."""
    region = F.col(region) if isinstance(region, str) else region
    return [F.coalesce((region == F.lit(lv)).cast("int"), F.lit(0)).alias(onehot_name(lv))
            for lv in levels]


def region_decode(default: str | None = None, levels=config.REGION_LEVELS) -> Column:
    """Inverse of :func:`region_onehot`: first level whose flag is 1."""
    expr = None
    for lv in levels:
        cond = c(onehot_name(lv)) == 1
        expr = F.when(cond, F.lit(lv)) if expr is None else expr.when(cond, F.lit(lv))
    return expr.otherwise(F.lit(default).cast("string"))


def parse_invoice_date(text: Column | str = "InvoiceDate",
                       fmt: str = "M/d/yyyy H:mm[:ss]") -> Column:
    """Lenient month/day/year hour:minute parse, seconds optional; an unparseable
    value is null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(F.trim(text), F.lit(fmt))


def weekday_mon1(ts: Column | str) -> Column:
    """Day of week with Monday = 1 ... Sunday = 7."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.weekday(ts) + 1).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """Division that gives null instead of raising (ANSI) on a zero divisor."""
    return F.try_divide(num, den)


def ln_pos(x: Column | str) -> Column:
    """Natural log; a non-positive argument gives null (the script's -Inf/NaN
    values are dropped by the plots that use them)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.ln(x))


def year_fraction(month_start: Column) -> Column:
    """Year-month as a number: year + (month - 1) / 12."""
    return F.year(month_start) + (F.month(month_start) - 1) / F.lit(12.0)


def any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c(x).isNull() for x in cols])


def null_safe_keys(left, right, keys: list[str]) -> Column:
    """Join condition with null == null on every key (like R's %in% / duplicated)."""
    return reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys])


def region_lookup_table(spark, mapping=config.REGION_COUNTRIES):
    """Country -> region as a table (first list wins for a repeated country)."""
    seen: dict[str, str] = {}
    for label, countries in mapping:
        for ctry in countries:
            seen.setdefault(ctry, label)
    return spark.createDataFrame(sorted(seen.items()), "Country string, Region string")


LOOKUP_BROADCAST_ROWS = 100_000


def add_region_by_lookup(df, lookup, default: str = config.DEFAULT_REGION,
                         country: str = "Country", out: str = "Region"):
    """J3 for data-driven maps: left join on the country, unknown -> default.

    The lookup side is broadcast only after its row count is checked;
    beyond the bound it is an ordinary (shuffle) join."""
    n = lookup.count()
    side = F.broadcast(lookup) if n <= LOOKUP_BROADCAST_ROWS else lookup
    side = side.select(F.col("Country").alias("_lk_country"), F.col("Region").alias("_lk_region"))
    return (df.join(side, F.col(country) == F.col("_lk_country"), "left")
            .withColumn(out, F.coalesce(F.col("_lk_region"), F.lit(default)))
            .drop("_lk_country", "_lk_region"))


def join_null_safe(left, right, keys: list[str], how: str = "inner"):
    """Join on ``keys`` treating null == null (grouping semantics), keeping
    one copy of each key column.  Without keys both sides are statistics of the
    whole table: ``right`` must then be a single row.  Spark plans ``<=>`` keys as an ordinary
    hash / sort-merge / broadcast equi-join."""
    if not keys:
        return left.crossJoin(right)
    r = right.select(*[F.col(f"`{c_}`").alias(f"_r_{c_}") if c_ in keys else F.col(f"`{c_}`")
                       for c_ in right.columns])
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
