"""ARMA candidates for the monthly forecast, by two regressions (Hannan and Rissanen).

A moving-average term needs the unseen innovations.  The first regression, a long
autoregression, gives their estimates; the second regresses the series on its own lags, on
the lagged estimates and on the lag of one season.  Both are ordinary least squares: the cross
moments of all terms are summed per series in one aggregate (one row a month, any number
of series), and each candidate's small moment matrix is swept by a fold of higher-order
functions, which leaves the coefficients and the inverse matrix (for standard errors).

Levels are centred at the mean of their series, so that moments don't cancel.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import materialize

#: Lags of the first regression.
LONG = 3
#: Candidates: what is modelled (z: centred level, d: difference) and the terms besides a
#: constant: z1, z2 (lags), zs (lag of a season), e1 (lagged innovation); d1, d2, u1 likewise.
CANDIDATES = {
    "ar2": ("z", ["z1", "z2"]),
    "ar1_sar1": ("z", ["z1", "zs"]),
    "arma11": ("z", ["z1", "e1"]),
    "arma11_sar1": ("z", ["z1", "e1", "zs"]),
    "ma1": ("z", ["e1"]),
    "ma1_sar1": ("z", ["e1", "zs"]),
    "sar1": ("z", ["zs"]),
    "ar2_diff": ("d", ["d1", "d2"]),
    "arma11_diff": ("d", ["d1", "u1"]),
    "ma1_diff": ("d", ["u1"]),
}
#: What multiplies the last value, the one before, the one a season before, the last innovation.
ROLES = {"z1": "b1", "d1": "b1", "z2": "b2", "d2": "b2", "zs": "bs", "e1": "th", "u1": "th"}


def swept(matrix: Column, k: Column) -> Column:
    """A moment matrix (array of arrays; the response last) after sweeping its first ``k``
    variables: coefficients in the last column, the negative inverse before them, and the
    residual sum of squares in the corner.  Null where a variable depends on the others."""
    def step(a: Column, p: Column) -> Column:
        pivot = F.nullif(a[p][p], F.lit(0.0))

        def cell(v: Column, i: Column, j: Column) -> Column:
            return (F.when((i == p) & (j == p), -1 / pivot).when((i == p) | (j == p), v / pivot)
                    .otherwise(v - a[i][p] * a[p][j] / pivot))
        return F.transform(a, lambda row, i: F.transform(row, lambda v, j: cell(v, i, j)))
    return F.aggregate(F.sequence(F.lit(0), k - 1), matrix, step)


def least_squares(rows: DataFrame, designs: dict[str, tuple[str, list[str]]], where: dict[str, Column],
                  series: str = "series") -> DataFrame:
    """Per series a map ``fits`` from design (response, terms; a constant is added) to its
    coefficients ``b``, constant first, and the diagonal ``v`` of the inverse moment matrix.
    Rows are those of the response's ``where``; products with a null are left out."""
    names = {y: ["1", *sorted({x for r, xs in designs.values() if r == y for x in xs}), y]
             for y in dict.fromkeys(y for y, _ in designs.values())}
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    sums = [F.sum(F.when(where[y], value(a) * value(b))).cast("double").alias(f"_{y}_{i}_{j}")
            for y, own in names.items() for i, a in enumerate(own) for j, b in enumerate(own) if i <= j]
    moments = rows.groupBy(series).agg(*sums)
    whole = F.array(*(F.array(*(F.array(*(f"_{y}_{min(i, j)}_{max(i, j)}" for j in range(len(own))))
                                for i in range(len(own)))) for y, own in names.items()))
    places = {m: [names[y].index(c) for c in ("1", *xs, y)] for m, (y, xs) in designs.items()}
    known = F.from_json(F.lit(json.dumps([{"model": m, "of": list(names).index(y), "at": places[m]}
                                          for m, (y, _) in designs.items()])),
                        "array<struct<model:string,of:int,at:array<int>>>")

    def fit(design: Column) -> Column:
        at, k = design["at"], F.size(design["at"]) - 1
        own = F.transform(at, lambda i: F.transform(at, lambda j: F.col("_moments")[design["of"]][i][j]))
        every = F.sequence(F.lit(0), k - 1)
        return F.struct(design["model"], F.transform(F.array(swept(own, k)), lambda a: F.struct(
            F.transform(every, lambda i: a[i][k]).alias("b"), F.transform(every, lambda i: -a[i][i]).alias("v")))[0])

    return moments.select(series, whole.alias("_moments")).select(
        series, F.map_from_entries(F.transform(known, fit)).alias("fits"))


def arma_rows(series_df: DataFrame, value: str, season: int, series: str, t: str) -> DataFrame:
    """The terms of all candidates per row (series, t): centred level and difference, their
    lags, and the innovations estimated by the first regression."""
    w = Window.partitionBy(series).orderBy(t)
    z = F.col(value) - F.avg(value).over(Window.partitionBy(series))
    rows = series_df.select(series, t, z.alias("z")).withColumn("d", F.col("z") - F.lag("z", 1).over(w))
    for k in range(1, LONG + 1):
        rows = rows.withColumn(f"z{k}", F.lag("z", k).over(w)).withColumn(f"d{k}", F.lag("d", k).over(w))
    rows = materialize(rows.withColumn("zs", F.lag("z", season).over(w)), "lags")
    long = {c: (c, [f"{c}{k}" for k in range(1, LONG + 1)]) for c in ("z", "d")}
    rows = rows.join(least_squares(rows, long, {c: F.col(f"{c}{LONG}").isNotNull() for c in long}, series),
                     series, "left")
    for c, out in (("z", "e"), ("d", "u")):
        rows = rows.withColumn(out, F.col(c) - predicted(F.col("fits")[c]["b"], long[c][1]))
        rows = rows.withColumn(f"{out}1", F.lag(out, 1).over(w))
    return rows.drop("fits")


def predicted(b: Column, terms: list[str]) -> Column:
    """The regression's value: constant and terms."""
    out = b[0]
    for k, x in enumerate(terms, 1):
        out = out + b[k] * F.col(x)
    return out


def arma_fitted(rows: DataFrame, fits: DataFrame, level: Column, before: Column, series: str) -> DataFrame:
    """``rows`` with the one-step value ``f_<model>`` of every candidate, in units of the series:
    on top of ``level`` (the mean) or of ``before`` (the value before)."""
    out = rows.join(fits.select(series, "fits"), series)
    return out.withColumns({f"f_{m}": (level if y == "z" else before) + predicted(F.col("fits")[m]["b"], xs)
                            for m, (y, xs) in CANDIDATES.items()}).drop("fits")


def arma_path(rows: DataFrame, chosen: DataFrame, h: int, season: int, series: str, t: str) -> DataFrame:
    """``chosen`` (series, model, fits, ...) with ``path``, the values of the next ``h`` periods
    (centred levels, or differences added up) by its model, and ``spread``, the factors of the
    innovations' standard deviation; null for a model that isn't a candidate here."""
    last = rows.groupBy(series).agg(
        F.array_sort(F.collect_list(F.struct(t, "z", "d"))).alias("_held"),
        F.max_by("e", t).alias("_e"), F.max_by("u", t).alias("_u"))
    both = chosen.join(last, series)
    by_model = lambda of: F.create_map(*(F.lit(x) for m in CANDIDATES for x in (m, of(m))))[F.col("model")]
    terms = {m: [ROLES[x] for x in xs] for m, (_, xs) in CANDIDATES.items()}
    own = F.col("fits")[F.col("model")]["b"]
    both = both.withColumns({
        "_const": F.get(own, F.lit(0)), "_diff": by_model(lambda m: CANDIDATES[m][0] == "d"),
        **{f"_{r}": F.coalesce(F.get(own, by_model(lambda m, r=r: terms[m].index(r) + 1 if r in terms[m] else 99)), F.lit(0.0))
           for r in ("b1", "b2", "bs", "th")}})
    back = lambda v, k: F.coalesce(F.get(v, F.size(v) - k), F.lit(0.0))

    def fold(start: Column, const: Column, shock: Column) -> Column:
        def step(v: Column, i: Column) -> Column:
            return F.concat(v, F.array(const + F.when(i == 1, shock).otherwise(0.0) + F.col("_b1") * back(v, 1)
                                       + F.col("_b2") * back(v, 2) + F.col("_bs") * back(v, season)))
        return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step), -h - 1, h + 1)

    held = F.when(F.col("_diff"), F.col("_held.d")).otherwise(F.col("_held.z"))
    shock = F.col("_th") * F.when(F.col("_diff"), F.col("_u")).otherwise(F.col("_e"))
    both = both.withColumns({"_path": F.slice(fold(held, F.col("_const"), shock), 2, h),
                             "_psi": F.slice(fold(F.array(*[F.lit(0.0)] * season, F.lit(1.0)), F.lit(0.0), F.col("_th")), 1, h)})
    summed = lambda c: F.when(F.col("_diff"), _running(F.col(c))).otherwise(F.col(c))
    both = both.withColumns({"path": summed("_path"), "_psi": summed("_psi")})
    both = both.withColumn("spread", F.transform(_running(F.transform("_psi", lambda x: x * x)), F.sqrt))
    return both.select(*chosen.columns, *(F.when(F.col("_diff").isNotNull(), F.col(c)).alias(c) for c in ("path", "spread")))


def _running(values: Column) -> Column:
    """Running sums of an array."""
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + b))
