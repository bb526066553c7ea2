"""Cleaning steps and the named line populations built on them.


    RAW -> NODUP -> NOZERO -> REG -> SC -> POS, NEG, SC_Z -> OUT, BULK, NOOUT
                                               NOOUT -> NOOUT_POS -> NOLOW
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import config
from tillroll.functions.columns import (c, parse_invoice_date, region_decode,
                                        region_of, region_onehot, weekday_mon1)


def dedup_first(raw: DataFrame, keys: Sequence[str] = config.DEDUP_KEYS,
                order: Sequence[str] = ("src_rank", "InvoiceDate")) -> DataFrame:
    """Keep one row per key (nulls equal): the first by ``order`` (a text date by
    the date it names; missing values last), then by the remaining columns
    (ascending, nulls first).

    Written as an aggregate, not a window: ``min(struct(...))`` combines
    map-side, so a key with a third of all rows is reduced before the shuffle
    instead of being sorted whole in one task.
    """
    keys = list(keys)
    rest = [x for x in raw.columns if x not in keys and x not in order]
    rank = []
    for i, x in enumerate(order):
        text_date = x == "InvoiceDate" and isinstance(raw.schema[x].dataType, T.StringType)
        value = parse_invoice_date(x) if text_date else c(x)
        rank += [value.isNull().alias(f"_no{i}"), value.alias(f"_by{i}")]
    firsts = raw.groupBy(*[c(k) for k in keys]).agg(
        F.min(F.struct(*rank, *[c(x) for x in [*order, *rest]])).alias("_first"))
    return firsts.select(*[c(x) if x in keys else F.col("_first").getField(x).alias(x)
                           for x in raw.columns])


def drop_zero(df: DataFrame) -> DataFrame:
    """NOZERO: Quantity != 0 and Price != 0 (a null in either drops the row)."""
    return df.where((F.col("Quantity") != 0) & (F.col("Price") != 0))


def add_sales_region(df: DataFrame) -> DataFrame:
    """REG: TotalSales = Quantity * Price and the country's region label."""
    return (df.withColumn("TotalSales", F.col("Quantity") * F.col("Price"))
            .withColumn("Region", region_of("Country")))


def super_clean(reg: DataFrame) -> DataFrame:
    """SC: parse dates, add Month / Day (Mon=1) / Year, one-hot regions and
    project in the script's order.  ``Region`` and ``src_rank`` are kept at
    the end (so the label is not re-decoded ten times downstream)."""
    ts = (parse_invoice_date("InvoiceDate")
          if isinstance(reg.schema["InvoiceDate"].dataType, T.StringType)
          else F.col("InvoiceDate").cast("timestamp"))
    df = reg.withColumn("InvoiceDate", ts)
    return df.select(
        "Invoice", "StockCode", "Description", "InvoiceDate",
        F.month("InvoiceDate").alias("Month"), weekday_mon1("InvoiceDate").alias("Day"),
        F.year("InvoiceDate").alias("Year"),
        "Quantity", "Price", "TotalSales", "CustomerID", "Country",
        *region_onehot("Region"), "Region", "src_rank")


def clean_lines(raw: DataFrame) -> DataFrame:
    """RAW -> SC in one lazy plan."""
    return super_clean(add_sales_region(drop_zero(dedup_first(raw))))


def positive(sc: DataFrame) -> DataFrame:
    """POS: TotalSales >= 0 and Quantity >= 0."""
    return sc.where((F.col("TotalSales") >= 0) & (F.col("Quantity") >= 0))


def negative(sc: DataFrame) -> DataFrame:
    """NEG: TotalSales < 0."""
    return sc.where(F.col("TotalSales") < 0)


def global_stats(df: DataFrame, exprs: dict[str, F.Column]) -> DataFrame:
    """One-row aggregate meant to be broadcast onto every row (size: 1 row)."""
    return F.broadcast(df.agg(*[e.alias(n) for n, e in exprs.items()]))


def with_zscore(df: DataFrame, col: str = "Quantity", out: str = "z_score", known: dict | None = None) -> DataFrame:
    """SC_Z: (x - mean) / sd over the whole frame; the 1-row statistics are
    broadcast (not an un-partitioned window, which would be one task), or literals where
    they are ``known`` (as ``mean`` and ``sd``)."""
    if known is not None:
        mean, sd = (F.lit(known[k]).cast("double") for k in ("mean", "sd"))
        return df.withColumn(out, F.try_divide(F.col(col) - mean, sd))
    st = global_stats(df, {"_mu": F.avg(col), "_sd": F.stddev_samp(col)})
    return (df.crossJoin(st)
            .withColumn(out, F.try_divide(F.col(col) - F.col("_mu"), F.col("_sd")))
            .drop("_mu", "_sd"))


def outliers(sc_z: DataFrame, k: float = config.Z_OUTLIER) -> DataFrame:
    """OUT: |z| > k."""
    return sc_z.where(F.abs("z_score") > k)


def bulk_lines(sc_z: DataFrame, threshold: float = config.BULK_INCLUSIVE) -> DataFrame:
    """BULK: Quantity >= threshold."""
    return sc_z.where(F.col("Quantity") >= threshold)


def no_outliers(sc: DataFrame, k: float = config.Z_OUTLIER, known: dict | None = None) -> DataFrame:
    """NOOUT: |z| <= k on Quantity, z dropped."""
    return with_zscore(sc, known=known).where(F.abs("z_score") <= k).drop("z_score")


def no_outliers_positive(noout: DataFrame) -> DataFrame:
    """NOOUT_POS: Quantity >= 0 and Price >= 0."""
    return noout.where((F.col("Quantity") >= 0) & (F.col("Price") >= 0))


def no_low(noout_pos: DataFrame, threshold: float = config.LOW_ORDER) -> DataFrame:
    """NOLOW: TotalSales >= threshold."""
    return noout_pos.where(F.col("TotalSales") >= threshold)


def minmax_columns(df: DataFrame, cols: Sequence[str], suffix: str = "_MinMax", known: dict | None = None) -> DataFrame:
    """(x - min) / (max - min) per column; min/max from one broadcast row, or literals
    where they are ``known`` (as ``min_<column>``, ``max_<column>``).
    A constant column gives null instead of an ANSI division error."""
    if known is not None:
        low, high = ({x: F.lit(known[f"{m}_{x}"]).cast("double") for x in cols} for m in ("min", "max"))
        return df.select("*", *(F.try_divide(F.col(x) - low[x], high[x] - low[x]).alias(f"{x}{suffix}") for x in cols))
    exprs = {}
    for x in cols:
        exprs[f"_min_{x}"] = F.min(x)
        exprs[f"_max_{x}"] = F.max(x)
    st = global_stats(df, exprs)
    out = df.crossJoin(st)
    for x in cols:
        out = out.withColumn(f"{x}{suffix}", F.try_divide(
            F.col(x) - F.col(f"_min_{x}"), F.col(f"_max_{x}") - F.col(f"_min_{x}")))
    return out.drop(*exprs.keys())


SCALED_COLUMNS = ["Quantity", "Price", "TotalSales"]


def scaled_positive(sc: DataFrame, known: dict | None = None) -> DataFrame:
    """SCALED: POS with min-max Quantity, Price and TotalSales."""
    return minmax_columns(positive(sc), SCALED_COLUMNS, known=known)


def scaled_all(sc: DataFrame, known: dict | None = None) -> DataFrame:
    """SC with the three min-max columns (computed over all clean lines)."""
    return minmax_columns(sc, SCALED_COLUMNS, known=known)


def line_statistics() -> dict[str, F.Column]:
    """What the populations need to know of all clean lines: mean and sd of Quantity, and the
    ranges of the scaled columns over all (``all_``) and over the positive lines (``pos_``)."""
    is_pos = (F.col("TotalSales") >= 0) & (F.col("Quantity") >= 0)
    out = {"mean": F.avg("Quantity"), "sd": F.stddev_samp("Quantity")}
    for x in SCALED_COLUMNS:
        for who, v in (("all", F.col(x)), ("pos", F.when(is_pos, F.col(x)))):
            out |= {f"{who}_min_{x}": F.min(v), f"{who}_max_{x}": F.max(v)}
    return out


def decode_region(df: DataFrame, default: str | None = None, out: str = "Region") -> DataFrame:
    """Rebuild the region label from the one-hot flags (default when none is 1)."""
    return df.withColumn(out, region_decode(default))


class Populations:
    """Lazy named populations over one raw frame; nothing runs until an action.

    ``materialize=True`` writes SC once as a Parquet table in the shared
    checkpoint folder (see :func:`tillroll.session.materialize`): SC feeds
    every other population, so multi-pass reports read the table instead of
    re-running the joins and the dedup shuffle.  ``columns`` keeps only those of
    SC that a report needs (populations filter on Quantity, Price, TotalSales).
    The write also yields the statistics that outlier and scaled populations refer to, so
    those are plain filters and projections of the table.
    """

    def __init__(self, raw: DataFrame, materialize: bool = False, columns: Sequence[str] | None = None):
        self.raw = raw
        self._sc = clean_lines(raw)
        if columns is not None:                   # what the report reads, before it is written
            self._sc = self._sc.select(*[c(x) for x in columns])
        self._known = None
        if materialize:
            from tillroll.session import materialize as _mat, materialize_with
            if set(SCALED_COLUMNS) <= set(self._sc.columns):
                self._sc, self._known = materialize_with(self._sc, "clean_lines", line_statistics())
            else:
                self._sc = _mat(self._sc, "clean_lines")

    def _range(self, who: str) -> dict | None:
        """Known minima and maxima of all lines or of the positive ones."""
        if self._known is None:
            return None
        return {k.removeprefix(f"{who}_"): v for k, v in self._known.items() if k.startswith(f"{who}_")}

    @property
    def nodup(self) -> DataFrame:
        return dedup_first(self.raw)

    @property
    def reg(self) -> DataFrame:
        return add_sales_region(drop_zero(dedup_first(self.raw)))

    @property
    def sc(self) -> DataFrame:
        return self._sc

    @property
    def pos(self) -> DataFrame:
        return positive(self._sc)

    @property
    def neg(self) -> DataFrame:
        return negative(self._sc)

    @property
    def sc_z(self) -> DataFrame:
        return with_zscore(self._sc, known=self._known)

    @property
    def out(self) -> DataFrame:
        return outliers(self.sc_z)

    @property
    def bulk(self) -> DataFrame:
        return bulk_lines(self.sc_z)

    @property
    def noout(self) -> DataFrame:
        return no_outliers(self._sc, known=self._known)

    @property
    def noout_pos(self) -> DataFrame:
        return no_outliers_positive(self.noout)

    @property
    def nolow(self) -> DataFrame:
        return no_low(self.noout_pos)

    @property
    def scaled(self) -> DataFrame:
        return scaled_positive(self._sc, self._range("pos"))

    @property
    def scaled_all(self) -> DataFrame:
        return scaled_all(self._sc, self._range("all"))

    def population(self, name: str) -> DataFrame:
        return getattr(self, name)
