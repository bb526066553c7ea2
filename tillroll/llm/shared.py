"""Small helpers of the operators: settings, stored intermediates, bounded joins."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.session import checked_broadcast, materialize

#: Rows of an Arrow batch: with whole texts this bounds a Python worker's memory.
BATCH_ROWS = 1000
#: Bits of a key filter: as a table at most 2**20 rows, whatever it is made from.
FILTER_BITS = 26


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def release() -> None:
    """Gives back the memory that this process holds but doesn't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # what numpy has freed; glibc alone has it
    if trim is not None:
        trim(0)


def released(run):
    """``run`` for ``mapInArrow``, with ``release`` at its end: Spark uses a Python worker again, and
    what it holds would be added to an executor's memory in the stages that follow."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage
    and survives a lost executor."""
    return materialize(df, name)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more (what was made from them
    must be stored itself by now)."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def split_by_keys(docs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``key`` may be among ``keys``, and the rest, in which
    none is (nor a null key).

    The keys become a bit set of fixed size, broadcast as a table of 64-bit words
    with at most ``2**(FILTER_BITS - 6)`` rows.  Where few rows match, a join
    with the keys then shuffles few texts; where the set fills up, the first part
    is all rows, and only time is lost.
    """
    word, bit, mask = (free_name(n, docs.columns) for n in ("word", "bit", "mask"))
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << FILTER_BITS))
    at = [F.shiftrightunsigned(place, 6).alias(word), (place % 64).cast("int").alias(bit)]
    words = (keys.where(F.col(key).isNotNull()).select(*at).groupBy(word)
             .agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(mask)))
    words = F.broadcast(stored(words, "key-filter"))
    marked = docs.select("*", *at).join(words, word, "left")
    may = F.col(key).isNotNull() & F.coalesce(
        F.expr(f"shiftrightunsigned({mask}, {bit}) & 1L = 1L"), F.lit(False))
    return marked.where(may).select(*docs.columns), marked.where(~may).select(*docs.columns)


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "pos", total: str = "total") -> DataFrame:
    """``df`` with each row's place (from 0) in its group, and the group's rows, written as
    a table.  No group has to fit in a task: rows are dealt out by ranges of group and
    order, and counts of the ranges give where each begins.  Rows equal in ``order``
    stand in any order.  ``df`` is read twice."""
    names = [*df.columns, *by]
    tie, at, part, first, n, shift = (free_name(x, names) for x in ("tie", "at", "part", "first", "n", "shift"))
    keys = [*map(F.col, by), *order, F.col(tie)]
    rows = (df.withColumn(tie, F.monotonically_increasing_id())
            .repartitionByRange(shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
            .withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)).drop(tie))
    rows = stored(rows, "ordered")
    held = rows.groupBy(*by, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum(n).over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    held = checked_broadcast(held.select(*by, part, (F.coalesce(before, F.lit(0)) - F.col(first)).alias(shift),
                                         F.sum(n).over(group).alias(total)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, part)]
    return rows.alias("a").join(held.alias("b"), same).select(
        *(F.col(f"a.`{c}`") for c in df.columns), (F.col(f"a.{at}") + F.col(f"b.{shift}")).alias(name), F.col(f"b.{total}"))


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores before it, unlike any column taken."""
    low = {c.lower() for c in taken}
    while name in low:
        name = "_" + name
    return name


def code_points(text: Column | str) -> Column:
    return F.length(text).cast("long")
