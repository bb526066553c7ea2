"""Hold-out split, scaling fitted on the training part, two-predictor OLS with
RMSE, one-way ANOVA and Tukey pairwise comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import config
from tillroll.operators.order_stats import exact_quantiles, order_statistics
from tillroll.session import materialize

SPLIT_KEY = config.DEDUP_KEYS


def row_hash(keys: Sequence[str] = SPLIT_KEY) -> F.Column:
    """md5 hex of the dedup key (unique per clean line).  Each part carries its
    length, or a mark for null, so different keys never give the same text; an
    amount is the shortest text that names its double."""
    def part(k: str) -> F.Column:
        text = F.col(k).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat_ws("|", *map(part, keys)))


def stratified_split(df: DataFrame, y: str = "TotalSales", p: float = config.SPLIT_P,
                     groups: int = config.SPLIT_GROUPS, keys: Sequence[str] = SPLIT_KEY) -> DataFrame:
    """Adds ``stratum`` and ``is_train``.

    Strata are the quantile intervals of ``y`` (breaks at 0, 1/(g-1), ..., 1;
    right-closed, the first one closed); in each stratum the ceil(p * n) lines
    with the smallest md5 of their key go to training.  Reproducible and
    independent of partitioning.  The per-stratum cut is an exact order
    statistic of the hash, found without sorting a stratum in one task.
    """
    probs = [i / (groups - 1) for i in range(groups)]
    qs = exact_quantiles(df, [], y, probs)
    breaks = qs.groupBy().agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("_b"))
    inner = F.transform(F.slice(F.col("_b"), 2, groups - 2), lambda s: s.getField("q"))
    d = (df.crossJoin(F.broadcast(breaks.select(inner.alias("_inner"))))
         .withColumn("stratum", (F.lit(1) + F.size(F.filter("_inner", lambda b: F.col(y) > b)))
                     .cast("int"))
         .drop("_inner")
         .withColumn("_h", row_hash(keys))
         .withColumn("_h60", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")))
    # read by the cut search, the below-count and the final labelling: write once
    d = materialize(d, "split")

    def targets(sizes: DataFrame) -> DataFrame:
        need = F.ceil(F.col("_n") * F.lit(p)).cast("long")
        return sizes.select("stratum", F.lit(0).alias("tid"), (need - 1).alias("rank"),
                            need.alias("_need"))

    cut = order_statistics(d, ["stratum"], "_h60", targets).select(
        "stratum", F.col("_v").alias("_thr"),
        F.ceil(F.col("_n") * F.lit(p)).cast("long").alias("_need"))
    d = d.join(F.broadcast(cut), "stratum")   # one row per stratum (<= groups - 1 rows)
    below = (d.where(F.col("_h60") < F.col("_thr")).groupBy("stratum")
             .agg(F.count(F.lit(1)).alias("_below")))
    # Lines whose 60-bit prefix equals the cut (normally exactly one per
    # stratum) are ordered by the full hash; only those rows enter the window,
    # and they are unioned back -- no join over all lines.
    ties = (d.where(F.col("_h60") == F.col("_thr"))
            .join(F.broadcast(below), "stratum", "left")
            .withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy("_h")))
            .withColumn("is_train",
                        F.col("_r") <= F.col("_need") - F.coalesce(F.col("_below"), F.lit(0)))
            .drop("_r", "_below"))
    rest = d.where(F.col("_h60") != F.col("_thr")).withColumn(
        "is_train", F.col("_h60") < F.col("_thr"))
    out = rest.unionByName(ties)
    return out.drop("_h", "_h60", "_thr", "_need")


def split_summary(split: DataFrame, y: str = "TotalSales") -> DataFrame:
    return split.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_test"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def scale_by_train(split: DataFrame, y: str = "TotalSales", method: str = "z",
                   out: str | None = None) -> DataFrame:
    """M3 / M4: scale ``y`` with statistics of the training rows only
    (z: mean / sample sd; minmax: min / max), applied to every row."""
    out = out or f"{y}_{'Z' if method == 'z' else 'MinMax'}"
    tr = split.where("is_train")
    if method == "z":
        st = tr.agg(F.avg(y).alias("_a"), F.stddev_samp(y).alias("_b"))
        expr = F.try_divide(F.col(y) - F.col("_a"), F.col("_b"))
    else:
        st = tr.agg(F.min(y).alias("_a"), (F.max(y) - F.min(y)).alias("_b"))
        expr = F.try_divide(F.col(y) - F.col("_a"), F.col("_b"))
    return split.crossJoin(F.broadcast(st)).withColumn(out, expr).drop("_a", "_b")


def ols2(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """M7: least squares y ~ 1 + x1 + x2 from second moments (one pass,
    map-side combined): ``n, intercept, b_<x1>, b_<x2>``."""
    m = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"),
               F.avg(x2).alias("m2"), F.var_samp(x1).alias("s11"), F.var_samp(x2).alias("s22"),
               F.covar_samp(x1, x2).alias("s12"), F.covar_samp(x1, y).alias("s1y"),
               F.covar_samp(x2, y).alias("s2y"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)
    b2 = F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)
    return (m.select("n", "my", "m1", "m2", b1.alias(f"b_{x1}"), b2.alias(f"b_{x2}"))
            .select("n", (F.col("my") - F.col(f"b_{x1}") * F.col("m1")
                          - F.col(f"b_{x2}") * F.col("m2")).alias("intercept"),
                    f"b_{x1}", f"b_{x2}"))


def holdout_rmse(split: DataFrame, target: str, x1: str = "Quantity", x2: str = "Price") -> DataFrame:
    """M7 / M8 / M9: fit on the training rows, predict the test rows, RMSE."""
    fit = ols2(split.where("is_train"), target, x1, x2)
    pred = F.col("intercept") + F.col(f"b_{x1}") * F.col(x1) + F.col(f"b_{x2}") * F.col(x2)
    test = split.where(~F.col("is_train")).crossJoin(F.broadcast(fit))
    err = test.agg(F.sqrt(F.avg(F.pow(pred - F.col(target), 2))).alias("rmse"),
                   F.count(F.lit(1)).alias("n_test"))
    return fit.withColumnRenamed("n", "n_train").crossJoin(err)


def group_moments(df: DataFrame, y: F.Column, group: str = "Region") -> DataFrame:
    """n, mean and sample variance of y per group (one aggregate)."""
    return (df.select(F.col(group).alias("group"), y.alias("_y")).where(F.col("_y").isNotNull())
            .groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"),
                                  F.var_samp("_y").alias("var")))


def anova_oneway(df: DataFrame, y: F.Column, group: str = "Region",
                 with_pvalue: bool = False) -> DataFrame:
    """One-way ANOVA table (term, Df, Sum_Sq, Mean_Sq, F_value
    [, P_value]) from per-group moments -- the rows never leave the
    executors, only k small rows are combined."""
    g = group_moments(df, y, group)
    tot = g.agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"),
                (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    s = g.crossJoin(tot).agg(
        F.first("n_total").alias("n_total"), F.first("k").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"))
    dfb, dfw = (F.col("k") - 1), (F.col("n_total") - F.col("k"))
    msb, msw = F.try_divide(F.col("ssb"), dfb), F.try_divide(F.col("ssw"), dfw)
    s = s.select(dfb.alias("dfb"), dfw.alias("dfw"), "ssb", "ssw", msb.alias("msb"),
                 msw.alias("msw"), F.try_divide(msb, msw).alias("F"))
    rows = s.selectExpr(
        "stack(2, 'group', dfb, ssb, msb, F, 'Residuals', dfw, ssw, msw, CAST(NULL AS DOUBLE)) "
        "AS (term, Df, Sum_Sq, Mean_Sq, F_value)", "dfb", "dfw")
    if with_pvalue:
        from tillroll.functions.stats import f_pvalue_udf
        rows = rows.withColumn("P_value", F.when(F.col("term") == "group", f_pvalue_udf(
            F.col("F_value"), F.col("dfb").cast("double"), F.col("dfw").cast("double"))))
    return rows.drop("dfb", "dfw").withColumn("Df", F.col("Df").cast("long"))


def tukey_hsd(df: DataFrame, y: F.Column, group: str = "Region", level: float = 0.95,
              with_pvalue: bool = False, max_groups: int = 200) -> DataFrame:
    """All pairs (a < b) of groups: diff = mean_b - mean_a, its
    standard error from the pooled residual variance, the studentized range
    statistic q, and optionally the adjusted p-value and confidence bounds.
    The pair join runs on the k per-group rows only; more than ``max_groups``
    groups are refused, since their pairs would grow with the square."""
    g = group_moments(df, y, group)
    tot = F.broadcast(g.agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"),
                            F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0)))
                            .alias("ssw")))
    few = g.crossJoin(tot).withColumn("k", F.when(F.col("k") <= max_groups, F.col("k")).otherwise(
        F.raise_error(F.lit(f"more than {max_groups} groups to compare")).cast("long")))
    pairs = few.alias("a").join(g.alias("b"), F.col("a.group") < F.col("b.group"))
    mse = F.col("ssw") / (F.col("n_total") - F.col("k"))
    se = F.sqrt(mse / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    out = pairs.select(
        F.concat_ws("-", F.col("b.group"), F.col("a.group")).alias("comparison"),
        (F.col("b.mean") - F.col("a.mean")).alias("diff"), se.alias("se"),
        "k", (F.col("n_total") - F.col("k")).alias("df"))
    out = out.withColumn("q", F.abs(F.col("diff")) / F.col("se"))
    if with_pvalue:
        from tillroll.functions.stats import tukey_crit_udf, tukey_pvalue_udf
        kd, dfd = F.col("k").cast("double"), F.col("df").cast("double")
        out = (out.withColumn("q_crit", tukey_crit_udf(F.lit(level), kd, dfd))
               .withColumn("lwr", F.col("diff") - F.col("q_crit") * F.col("se"))
               .withColumn("upr", F.col("diff") + F.col("q_crit") * F.col("se"))
               .withColumn("p_adj", tukey_pvalue_udf(F.col("q"), kd, dfd)))
    return out.drop("k", "df")
