"""Result sinks (the script prints or views its tables; here they are
returned as DataFrames and, when asked, written as tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def publish(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
            mode: str = "overwrite", fmt: str = "parquet") -> None:
    """S3: write a result table.  Line-level tables (clean lines, splits) are
    best partitioned by a low-cardinality column such as ``Year`` so later
    reads prune partitions; small report tables are written as they are."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def publish_all(tables: dict[str, DataFrame], base: str, **kw) -> dict[str, str]:
    """Write several named report tables under ``base``; returns name -> path."""
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        publish(df, path, **kw)
        out[name] = path
    return out
