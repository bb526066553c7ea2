"""Retail invoice-line sources.

Two ways in:

* :func:`read_invoice_csv` -- the analysed script's own input: one or more
  invoice CSV files with a header, each tagged with its position (``src_rank``)
  so "keep the first copy" has a defined meaning on an unordered engine.
* :func:`retail_from_tables` -- the invoice-line view over the TPC-H-like test
  tables (FIXTURES.md section 3).  It plants nulls, zeros, returns, bulk lines,
  unknown countries and an overlap of the two "yearly files" (= duplicates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import config
from tillroll.functions.columns import parse_invoice_date

# Raw column order (src_rank first, then the source file's columns).
RAW_COLUMNS = ["src_rank", *config.SOURCE_COLUMNS]

CSV_SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.DoubleType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("Price", T.DoubleType()),
    # read as double: "13085.0" is not a valid long and would silently become null
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])


#: Column of the text of a line that doesn't have the file's fields.
CORRUPT = "_corrupt_record"


def _scan_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> list[DataFrame]:
    """One scan per file: every field as trimmed text (empty and ``NA`` are null), the rank of
    the file, and the whole line where its fields don't fit the header."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]
                        + [T.StructField(CORRUPT, T.StringType())])
    frames = []
    for rank, path in enumerate([paths] if isinstance(paths, str) else paths, start=1):
        df = (spark.read.schema(text)
              .option("header", True).option("nullValue", "NA")
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .csv(path))
        frames.append(df.select(F.lit(rank).alias("src_rank"), CORRUPT, *[
            F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")).alias(f.name) for f in schema.fields]))
    return frames


def _typed(field: T.StructField) -> F.Column:
    """A field's value in its type, null where the text has none."""
    column = F.col(f"`{field.name}`")
    return column if isinstance(field.dataType, T.StringType) else column.try_cast(field.dataType)


def read_invoice_csv(spark: SparkSession, paths: list[str] | str,
                     schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """Scan invoice CSV files (header row) and stack them, tagging each file.

    Empty fields and ``NA`` become null; quoted blanks are trimmed to null too, and so
    are fields that aren't of the column's type (:func:`csv_bad_fields` has them).
    Each path is one scan so its rank is known without ``input_file_name``;
    the union is by name and does not shuffle.
    """
    out = None
    for df in _scan_csv(spark, paths, schema):
        df = df.select("src_rank", *(_typed(f).alias(f.name) for f in schema.fields))
        df = (df.withColumnRenamed("Customer ID", "CustomerID")
              .withColumn("CustomerID", F.col("CustomerID").try_cast("long")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*RAW_COLUMNS)


def csv_bad_fields(spark: SparkSession, paths: list[str] | str,
                   schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """Quarantine (S1): ``src_rank, column, value, line`` of every field that isn't of its
    column's type (a date: that doesn't parse), with the fields of its line joined by ``|``; and
    of every line with too many or too few fields (column and value null, line as it stands)."""
    out = None
    for df in _scan_csv(spark, paths, schema):
        line = F.concat_ws("|", *(F.coalesce(F.col(f"`{f.name}`"), F.lit("NA")) for f in schema.fields))
        checks = []
        for f in schema.fields:
            value = parse_invoice_date(f.name) if f.name == "InvoiceDate" else _typed(f)
            checks.append(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value"),
                                   (F.col(f"`{f.name}`").isNotNull() & value.isNull()).alias("bad")))
        whole = F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"),
                         F.col(CORRUPT).isNotNull().alias("bad"))
        some = df.select("src_rank", F.coalesce(CORRUPT, line).alias("line"), F.explode(
            F.filter(F.array(*checks, whole), lambda x: x["bad"])).alias("x"))
        some = some.select("src_rank", "x.column", "x.value", "line")
        out = some if out is None else out.unionByName(some)
    return out


def csv_bad_counts(bad: DataFrame) -> DataFrame:
    """``src_rank, column, n_fields, n_values``: quarantined fields per file and column, and how
    many different values they hold."""
    return bad.groupBy("src_rank", "column").agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_distinct("value").alias("n_values"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def country_dim(spark: SparkSession) -> DataFrame:
    """25-row nation-key -> country table of the test recipe."""
    return spark.createDataFrame(list(enumerate(config.FIXTURE_COUNTRIES)),
                                 "k int, country string")


def retail_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines (RAW) assembled from lineitem, orders, customer and part.

    The join order is left to Catalyst/AQE (lineitem-orders is the big
    shuffle join; customer and part are joined on their keys).  Only the
    25-row country table is broadcast -- its size is fixed.  The two
    overlapping "yearly files" come from one pass: each line is emitted once
    per file whose date window contains it.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")
    od = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pa = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    dim = F.broadcast(country_dim(spark))

    j = (li.join(od, li.l_orderkey == od.o_orderkey)
         .join(cu, F.col("o_custkey") == F.col("c_custkey"))
         .join(pa, F.col("l_partkey") == F.col("p_partkey"))
         .withColumn("k", (F.col("c_nationkey")
                           + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)) % 25)
         .join(dim, "k"))
    b = j.select(
        F.col("l_orderkey").cast("string").alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(F.col("l_partkey") % 211 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("Description"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0.0), F.lit(0.0))
         .when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2), -F.col("l_quantity"))
         .when(F.col("l_partkey") % 97 == 0, F.col("l_quantity") * 40)
         .otherwise(F.col("l_quantity")).alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.0), F.lit(0.0))
         .when((F.col("l_discount") == 0.01) & (F.col("l_tax") == 0.01), F.lit(0.01))
         .otherwise(F.col("l_extendedprice")).alias("Price"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.col("country").alias("Country"),
    )
    first_end = F.lit("1999-01-01").cast("timestamp")
    second_start = F.lit("1998-12-01").cast("timestamp")
    ranks = F.filter(
        F.array(F.lit(1), F.lit(2)),
        lambda r: ((r == 1) & (F.col("InvoiceDate") < first_end))
        | ((r == 2) & (F.col("InvoiceDate") >= second_start)))
    return b.select(F.explode(ranks).alias("src_rank"), *b.columns).select(*RAW_COLUMNS)


def write_invoice_csv(raw: DataFrame, base: str, ranks: list[int] = (1, 2), broken_date: str | None = None) -> list[str]:
    """Write raw lines as one CSV folder per source rank, in the invoice-file
    text layout (header, ``M/d/yyyy H:mm:ss`` dates, ``Customer ID`` as a double,
    ``NA`` for missing values).  One pass writes all ranks, partitioned by
    rank; the folders of ``ranks`` come back in order, ready for
    :func:`read_invoice_csv`.  Where the column ``broken_date`` holds, the date is written as
    text that is none (to try the quarantine)."""
    base = base.rstrip("/")
    date = F.date_format("InvoiceDate", "M/d/yyyy H:mm:ss")
    if broken_date:
        date = F.when(F.col(broken_date), F.lit("no date")).otherwise(date)
    (raw.select("src_rank", "Invoice", "StockCode", "Description", "Quantity",
                date.alias("InvoiceDate"), "Price",
                F.col("CustomerID").cast("double").alias("Customer ID"), "Country")
     .write.mode("errorifexists").option("header", True).option("nullValue", "NA")
     .partitionBy("src_rank").csv(base))
    return [f"{base}/src_rank={rank}" for rank in ranks]
