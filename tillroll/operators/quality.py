"""Data-quality views over the raw lines: missing values and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import config
from tillroll.functions.columns import any_null, c, null_safe_keys
from tillroll.session import materialize

KEY_HASH = "_tillroll_key_hash"
MISSING_ROW_COLUMNS = ["CustomerID", "Quantity", "Price", "InvoiceDate", "Country"]


def missing_rows(raw: DataFrame, cols: Sequence[str] = MISSING_ROW_COLUMNS) -> DataFrame:
    """rows with a null in any of ``cols`` (Description is not checked)."""
    return raw.where(any_null(list(cols)))


#: Slots of the filter of repeated keys: what is broadcast never exceeds this many rows.
KEY_SLOTS = 1 << 20


def duplicate_members(df: DataFrame, keys: Sequence[str], slots: int = KEY_SLOTS) -> DataFrame:
    """Every row of a key group with more than one row (nulls equal).

    The rows are written once with a hash of their key.  Hashes that occur twice or more (eight
    bytes a row, map-side combined, so a hot key is cheap) set a slot of a table of at most
    ``slots`` slots, which is broadcast whatever the size of the data; rows outside the set
    slots have keys of their own and go no further.  The others are counted by the keys
    themselves and matched back with a null-safe left-semi join, which AQE may split when skewed.
    Slots shared by unlike keys, up to a full table, only let more rows through to that join.
    """
    keys = list(keys)
    table = materialize(df.withColumn(KEY_HASH, F.xxhash64(*[c(k) for k in keys])), "keyed_lines")
    slot = F.pmod(F.col(KEY_HASH), F.lit(slots)).cast("int")
    repeated = (table.groupBy(KEY_HASH).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                .select(slot.alias("_slot")).distinct())
    some = table.join(F.broadcast(repeated), slot == F.col("_slot"), "left_semi").select(*[c(x) for x in df.columns])
    dup_keys = (some.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).drop("_n"))
    return some.join(dup_keys, null_safe_keys(some, dup_keys, keys), "left_semi")


def duplicates_by_key(raw: DataFrame, keys: Sequence[str] = ("Invoice", "StockCode")) -> DataFrame:
    return duplicate_members(raw, keys)


def duplicates_exact(raw: DataFrame, cols: Sequence[str] = config.SOURCE_COLUMNS) -> DataFrame:
    """Whole-row duplicates over the source columns (our ``src_rank`` tag is
    not part of the row)."""
    return duplicate_members(raw, cols)


def source_counts(raw: DataFrame) -> DataFrame:
    """Rows and null counts per source file after the union."""
    return (raw.groupBy("src_rank")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.col("Description").isNull().cast("long")).alias("null_description"),
                 F.sum(F.col("CustomerID").isNull().cast("long")).alias("null_customer")))


def distinct_countries(reg: DataFrame) -> DataFrame:
    """The distinct country values."""
    return reg.select("Country").distinct()


def country_regions(reg: DataFrame) -> DataFrame:
    """Each distinct country with its region label and line count."""
    return reg.groupBy("Country", "Region").agg(F.count(F.lit(1)).alias("lines"))
