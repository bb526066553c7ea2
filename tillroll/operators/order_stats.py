"""Exact order statistics and quantiles per group, distributed.

Spark's exact ``percentile``/``median`` keeps a value->count map per group in
one buffer; for a group holding a large share of all rows (the "Overall" row
of every KPI table, a dominant region) that buffer is unbounded and lands in a
single task.  This operator finds the exact k-th smallest value by histogram
refinement instead:

1. one aggregate gives n, min and max per group;
2. each pass counts the rows of every open target's value range in
   ``buckets`` equal-width buckets -- a ``groupBy`` with map-side partial
   aggregation, so a hot group costs no more than any other -- and a window
   over at most ``buckets`` rows per target picks the bucket holding the
   wanted rank; the range shrinks to that bucket's [min, max];
3. once a target's range holds at most ``final_limit`` rows, one window over
   just those rows gives the exact value (of all ranks wanted in that range).

Every task sees at most ``buckets`` or ``final_limit`` rows of one target.
The small target state is checkpointed each pass (shared checkpoint folder),
so lineage stays short and a lost executor only recomputes one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import join_null_safe
from tillroll.session import ensure_checkpoint_dir

BUCKETS = 1 << 12
FINAL_LIMIT = 1 << 20     # rows of one target sorted in one task (~16 MB)
BROADCAST_TARGETS = 200_000   # target rows are broadcast only below this count


def _maybe_broadcast(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_TARGETS else df


def order_statistics(data: DataFrame, keys: Sequence[str], value: str,
                     make_targets: Callable[[DataFrame], DataFrame], *,
                     buckets: int = BUCKETS, final_limit: int = FINAL_LIMIT,
                     max_passes: int = 96, cache: bool = False) -> DataFrame:
    """k-th smallest non-null ``value`` per group, exactly.

    ``make_targets(sizes)`` receives ``keys + _n`` (non-null count per group)
    and returns ``keys + tid + rank`` (0-based rank; out-of-range ranks are
    dropped).  Result: ``keys + tid + _n + _v``, materialised (small).

    Each pass re-reads ``data``: pass a cheap scan (e.g. a table written with
    :func:`tillroll.session.materialize`), or ``cache=True`` to persist the
    narrowed (keys, value) projection for the duration of the call.
    """
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)
    keys = list(keys)
    synthetic = not keys
    if synthetic:
        data = data.withColumn("_g", F.lit(0))
        keys = ["_g"]
    kq = [f"`{k}`" for k in keys]

    d = (data.select(*kq, F.col(f"`{value}`").alias("_x"))
         .where(F.col("_x").isNotNull()))
    if cache:
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = d.groupBy(*kq).agg(F.count(F.lit(1)).alias("_n"),
                                   F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        # one row per group; cached (recomputable from lineage if an executor
        # is lost) -- the loop state below is what gets checkpointed
        stats = stats.persist()
        tgt = make_targets(stats.select(*kq, "_n"))
        if synthetic:
            tgt = tgt.withColumn("_g", F.lit(0)) if "_g" not in tgt.columns else tgt
        tgt = tgt.select(*kq, "tid", F.col("rank").cast("long").alias("_res"))
        state = (join_null_safe(tgt, stats, keys)
                 .where((F.col("_res") >= 0) & (F.col("_res") < F.col("_n")))
                 .withColumn("_status",
                             F.when((F.col("_lo") == F.col("_hi")) | (F.col("_res") == 0)
                                    | (F.col("_res") == F.col("_n") - 1), F.lit("done"))
                             .when(F.col("_n") <= final_limit, F.lit("final"))
                             .otherwise(F.lit("open")))
                 .withColumn("_v", F.when(F.col("_res") == F.col("_n") - 1, F.col("_hi"))
                             .when(F.col("_status") == "done", F.col("_lo")))
                 .select(*kq, "tid", "_n", "_res", "_lo", "_hi", "_status", "_v"))

        counts: dict[str, int] = {}
        for i in range(max_passes):
            if i:   # cut the lineage a refinement pass added
                state = state.checkpoint()
            counts = {r["_status"]: r["cnt"] for r in
                      state.groupBy("_status").agg(F.count(F.lit(1)).alias("cnt")).collect()}
            n_open = counts.get("open", 0)
            if n_open == 0:
                break
            open_ = state.where(F.col("_status") == "open")
            ranges = _maybe_broadcast(open_.select(*kq, "_lo", "_hi").distinct(), n_open)
            width = (F.col("_hi") - F.col("_lo")).cast("double")
            hist = (join_null_safe(d, ranges, keys)
                    .where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
                    .withColumn("_b", F.least(
                        F.floor((F.col("_x") - F.col("_lo")).cast("double") / width * buckets),
                        F.lit(buckets - 1)).cast("int"))
                    .groupBy(*kq, "_lo", "_hi", "_b")
                    .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_bmin"),
                         F.max("_x").alias("_bmax")))
            w = (Window.partitionBy(*kq, "tid").orderBy("_b")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
            picked = (join_null_safe(open_, hist, [*keys, "_lo", "_hi"])
                      .withColumn("_cum", F.sum("_c").over(w))
                      .withColumn("_before", F.col("_cum") - F.col("_c"))
                      .where((F.col("_before") <= F.col("_res")) & (F.col("_res") < F.col("_cum")))
                      .select(*kq, "tid", "_n",
                              (F.col("_res") - F.col("_before")).alias("_res"),
                              F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                              F.when(F.col("_bmin") == F.col("_bmax"), F.lit("done"))
                              .when(F.col("_c") <= final_limit, F.lit("final"))
                              .otherwise(F.lit("open")).alias("_status"),
                              F.when(F.col("_bmin") == F.col("_bmax"), F.col("_bmin")).alias("_v")))
            state = state.where(F.col("_status") != "open").unionByName(picked)
        else:
            raise RuntimeError("order_statistics did not converge")

        out = state.where(F.col("_status") == "done").select(*kq, "tid", "_n", "_v")
        n_final = counts.get("final", 0)
        if n_final:
            # wanted ranks of the same range share one sort of its rows
            fin = _maybe_broadcast(
                state.where(F.col("_status") == "final").groupBy(*kq, "_n", "_lo", "_hi")
                .agg(F.collect_list(F.struct("tid", "_res")).alias("_t")), n_final)
            w2 = Window.partitionBy(*kq, "_lo", "_hi").orderBy("_x")
            exact = (join_null_safe(d, fin, keys)
                     .where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
                     .withColumn("_rn", F.row_number().over(w2) - 1)
                     .withColumn("_t", F.filter("_t", lambda t: t["_res"] == F.col("_rn")))
                     .where(F.size("_t") > 0)
                     .select(*kq, F.explode("_t").alias("_t"), "_n", F.col("_x").alias("_v"))
                     .select(*kq, "_t.tid", "_n", "_v"))
            out = out.unionByName(exact)
        out = out.checkpoint()
    finally:
        stats.unpersist()
        if cache:
            d.unpersist()
    return out.drop("_g") if synthetic else out


def exact_quantiles(data: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], **kw) -> DataFrame:
    """Type-7 (linear interpolation) quantiles per group: ``keys + p + q``.

    Equal to ``percentile``/``median`` in Spark SQL and ``quantile_cont`` in
    DuckDB; null values are ignored; a group without values yields no row.
    Up to ``final_limit`` rows in all, Spark's ``percentile`` (whose buffer then
    holds no more values than that) answers in one aggregate; beyond, the
    refinement above.  Both are exact.
    """
    probs = [float(p) for p in probs]
    keys = list(keys)
    kq = [f"`{k}`" for k in keys]
    if data.count() <= kw.get("final_limit", FINAL_LIMIT):
        x = F.percentile(F.col(f"`{value}`").cast("double"), F.array(*[F.lit(p) for p in probs])).alias("_q")
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), F.col("_q").alias("q"))
        return (data.groupBy(*kq).agg(x).where("_q IS NOT NULL")
                .select(*kq, F.explode(pairs).alias("_z")).select(*kq, "_z.p", "_z.q"))

    def targets(sizes: DataFrame) -> DataFrame:
        ranks = []
        for p in probs:
            h = (F.col("_n") - 1) * F.lit(p)
            ranks += [F.floor(h), F.ceil(h)]
        return (sizes.select(*[F.col(c) for c in sizes.columns if c != "_n"],
                             F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks])))
                             .alias("rank"))
                .withColumn("tid", F.col("rank")))

    os_ = order_statistics(data, keys, value, targets, **kw)
    per_group = os_.groupBy(*kq).agg(
        F.first("_n").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct(F.col("tid"), F.col("_v").cast("double"))))
        .alias("_m"))
    h = (F.col("_n") - 1) * F.col("p")
    lo = F.floor(h).cast("long")
    hi = F.ceil(h).cast("long")
    vlo = F.element_at(F.col("_m"), lo)
    vhi = F.element_at(F.col("_m"), hi)
    return (per_group.select(*kq, "_n", "_m", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
            .select(*kq, "p", (vlo + (h - lo) * (vhi - vlo)).alias("q")))


def exact_median(data: DataFrame, keys: Sequence[str], value: str,
                 alias: str = "median") -> DataFrame:
    return exact_quantiles(data, keys, value, [0.5]).select(
        *[f"`{k}`" for k in keys], F.col("q").alias(alias))
