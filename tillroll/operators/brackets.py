"""Exact quantiles of several columns over overlapping sets of rows, in two passes.

Rows fall into few disjoint *cells* (a region; a set of populations), and each wanted *set* is a
union of cells (one region, all regions; one population).  No row is copied for the sets it is in:

1. one mergeable sketch per (cell, column), merged for each set, brackets every wanted rank by
   two values, wide enough for twice the sketch's error;
2. one aggregate counts, per cell, the rows below each bracket and the different values inside it
   with how often they occur.  Rows outside all brackets fold into one row of their cell on the map side.

What is left are the values inside brackets (a few thousandths of the rows at most), in which the
rank is found by a running count.  A bracket with more than ``window_limit`` different values, or one that
the counts prove wrong, goes to the histogram refinement of :mod:`tillroll.operators.order_stats`,
over the bracket's rows or all rows of the set; so the result is exact whatever the sketch says.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import join_null_safe
from tillroll.operators.order_stats import FINAL_LIMIT, order_statistics
from tillroll.session import materialize

SKETCH_K = 4096


def rank_error(k: int) -> float:
    """Twice the usual rank error of a sketch of size ``k``, as a share of the rows."""
    return 2 * 2.3 / k ** 0.9


def _sketches(lines: DataFrame, n_values: int, k: int) -> DataFrame:
    """``cell, s0, s1, ...``: number of values and sketch of each column, per cell."""
    return lines.groupBy("cell").agg(*(F.struct(
        F.lit(i).alias("i"), F.count(f"x{i}").alias("n"), F.kll_sketch_agg_double(F.col(f"x{i}"), F.lit(k)).alias("s")).alias(f"s{i}")
        for i in range(n_values)))


def _brackets(sketched: DataFrame, n_values: int, sets: Callable[[Column], Column], probs: Sequence[float], k: int) -> DataFrame:
    """``set, i, j, p, r_lo, r_hi, frac, lo, hi``: value brackets of the two ranks next to each quantile."""
    long = sketched.select(F.explode(sets(F.col("cell"))).alias("set"), F.array(*(f"s{i}" for i in range(n_values))).alias("a"))
    merged = (long.select("set", F.explode("a").alias("z")).where("z.n > 0").groupBy("set", F.col("z.i").alias("i"))
              .agg(F.sum("z.n").alias("n"), F.kll_merge_agg_double("z.s").alias("s")))
    slack, spots = rank_error(k), []
    few = F.col("n") < 2 / slack                # one row more or less is more than half the slack: take all
    for j, p in enumerate(probs):
        low, high = (F.kll_sketch_get_quantile_double("s", F.lit(r)) for r in (max(p - 1.5 * slack, 0.0), min(p + 1.5 * slack, 1.0)))
        least, most = (F.kll_sketch_get_quantile_double("s", F.lit(r)) for r in (0.0, 1.0))
        spots.append(F.struct(F.lit(j).alias("j"), F.lit(p).alias("p"), F.when(few, least).otherwise(low).alias("lo"),
                              F.when(few, most).otherwise(high).alias("hi")))
    place = (F.col("n") - 1) * F.col("p")
    return merged.select("set", "i", "n", F.explode(F.array(*spots)).alias("w")).select("set", "i", "n", "w.*").select(
        "set", "i", "j", "p", F.floor(place).cast("long").alias("r_lo"), F.ceil(place).cast("long").alias("r_hi"),
        (place - F.floor(place)).alias("frac"), "lo", "hi")


def bracketed_quantiles(df: DataFrame, cell: Column, sets: Callable[[Column], Column], values: dict[str, Column],
                        probs: Sequence[float], *, sketch_k: int = SKETCH_K, window_limit: int = FINAL_LIMIT) -> DataFrame:
    """``set, metric, p, q``: type-7 quantiles of ``values`` in each set, exactly.

    ``cell`` names a row's cell and ``sets(cell)`` gives the array of sets that the cell belongs to
    (labels as text; null is a label like any other).  There must be few cells, each in few sets: their brackets
    are broadcast.  Null values are ignored; a set without values has no row; an empty table gives none.
    ``df`` is read twice, and again only for brackets that need the refinement.
    """
    probs, metrics = [float(p) for p in probs], list(values)
    lines = df.select(cell.alias("cell"), *(values[m].cast("double").alias(f"x{i}") for i, m in enumerate(metrics)))
    sketched = materialize(_sketches(lines, len(metrics), sketch_k), "sketches")
    # merging sketches is random: the brackets are drawn once, and everything below refers to those
    spots = materialize(_brackets(sketched, len(metrics), sets, probs, sketch_k), "brackets")
    cells = sketched.select("cell", F.explode(sets(F.col("cell"))).alias("set"))
    # each cell's brackets, as one array: the wanted sets differ from cell to cell
    per_cell = join_null_safe(cells, spots, ["set"]).groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("i", "set", "j", "lo", "hi"))).alias("b"))
    per_cell = per_cell.select("cell", *(F.expr(f"filter(b, z -> z.i = {i})").alias(f"b{i}") for i in range(len(metrics))))
    per_cell = materialize(per_cell, "cell_brackets")
    most = per_cell.agg(*(F.max(F.size(f"b{i}")).alias(f"m{i}") for i in range(len(metrics)))).first()
    width = [m or 0 for m in most]
    near = join_null_safe(lines, F.broadcast(per_cell), ["cell"])
    below, inside = [], []
    for i, m in enumerate(width):
        x, spot = F.col(f"x{i}"), [F.get(f"b{i}", F.lit(t)) for t in range(m)]
        hit = reduce(lambda a, b: a | b, (F.coalesce(x.between(s["lo"], s["hi"]), F.lit(False)) for s in spot), F.lit(False))
        inside.append(F.when(hit, x).alias(f"x{i}"))
        below += [F.sum((x < s["lo"]).cast("long")).alias(f"under{i}_{t}") for t, s in enumerate(spot)]
    counted = materialize(near.groupBy("cell", *inside).agg(F.count(F.lit(1)).alias("w"), *below), "bracket_counts")

    counted = join_null_safe(counted, F.broadcast(per_cell), ["cell"])
    under_rows, value_rows = [], []
    for i, m in enumerate(width):
        for t in range(m):
            spot = F.get(f"b{i}", F.lit(t))
            key = [spot["set"].alias("set"), F.lit(i).alias("i"), spot["j"].alias("j")]
            under_rows.append(F.struct(*key, F.col(f"under{i}_{t}").alias("under")))
            value_rows.append(F.when(F.col(f"x{i}").between(spot["lo"], spot["hi"]), F.struct(*key, F.col(f"x{i}").alias("x"))))
    key = ["set", "i", "j"]
    if not under_rows:                          # no value at all
        return spots.select("set", F.lit("").alias("metric"), "p", F.lit(0.0).alias("q")).where("1 = 0")
    under = counted.select(F.explode(F.array(*under_rows)).alias("z")).where("z.j IS NOT NULL").select("z.*").groupBy(*key).agg(
        F.coalesce(F.sum("under"), F.lit(0)).alias("under"))
    found = counted.select("w", F.explode(F.filter(F.array(*value_rows), lambda z: z.isNotNull())).alias("z")).groupBy(
        "z.set", "z.i", "z.j", "z.x").agg(F.sum("w").alias("w"))
    found = materialize(found, "bracket_values")
    held = found.groupBy(*key).agg(F.sum("w").alias("held"), F.count(F.lit(1)).alias("n_values"))
    state = materialize(join_null_safe(join_null_safe(spots, under, key), held, key, "left"), "bracket_state")
    right = F.coalesce((F.col("under") <= F.col("r_lo")) & (F.col("r_hi") < F.col("under") + F.col("held")), F.lit(False))
    state = state.withColumn("right", right).withColumn("small", F.col("right") & (F.col("n_values") <= window_limit))

    small = join_null_safe(found, F.broadcast(state.where("small").select(*key, "under", "r_lo", "r_hi")), key)
    upto = F.col("under") + F.sum("w").over(Window.partitionBy(*key).orderBy("x"))
    picked = small.withColumn("upto", upto).groupBy(*key).agg(
        F.min(F.when(F.col("upto") > F.col("r_lo"), F.col("x"))).alias("v_lo"),
        F.min(F.when(F.col("upto") > F.col("r_hi"), F.col("x"))).alias("v_hi"))
    large = state.where("NOT small")
    if not large.isEmpty():
        picked = picked.unionByName(_refined(lines, cells, large, len(metrics)))
    named = F.element_at(F.array(*map(F.lit, metrics)), F.col("i") + 1)
    return join_null_safe(state.select(*key, "p", "frac"), picked, key).select(
        "set", named.alias("metric"), "p", (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("q"))


def _refined(lines: DataFrame, cells: DataFrame, large: DataFrame, n_values: int) -> DataFrame:
    """The two values of each bracket in ``large`` by histogram refinement: among the bracket's
    rows, or among all rows of the set where the bracket was wrong."""
    key = ["set", "i", "j"]
    todo = large.select(*key, *(F.when(F.col("right"), F.col(x)).alias(x) for x in ("lo", "hi")),
                        *((F.col(r) - F.when(F.col("right"), F.col("under")).otherwise(0)).alias(r) for r in ("r_lo", "r_hi")))
    todo = materialize(todo, "open_brackets")
    per_cell = join_null_safe(cells, todo, ["set"]).groupBy("cell").agg(F.collect_list(F.struct(*key, "lo", "hi")).alias("b"))
    x = F.array(*(f"x{i}" for i in range(n_values)))
    rows = join_null_safe(lines, F.broadcast(per_cell), ["cell"]).select(x.alias("a"), F.explode("b").alias("z"))
    rows = rows.select(*(F.col(f"z.{k}").alias(k) for k in key), F.get("a", F.col("z.i")).alias("x"), "z.lo", "z.hi").where(
        "x IS NOT NULL AND (lo IS NULL OR x BETWEEN lo AND hi)").select(*key, "x")
    rows = materialize(rows, "bracket_rows")

    def targets(sizes: DataFrame) -> DataFrame:
        ranks = todo.select(*key, F.explode(F.array_distinct(F.array("r_lo", "r_hi"))).alias("rank"))
        return join_null_safe(sizes.drop("_n"), ranks, key).withColumn("tid", F.col("rank"))

    got = join_null_safe(order_statistics(rows, key, "x", targets), todo.select(*key, "r_lo", "r_hi"), key)
    return got.groupBy(*key).agg(F.max(F.when(F.col("tid") == F.col("r_lo"), F.col("_v"))).alias("v_lo"),
                                 F.max(F.when(F.col("tid") == F.col("r_hi"), F.col("_v"))).alias("v_hi"))
