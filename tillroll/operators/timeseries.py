"""Sales series: daily / monthly rollups, sign trends, additive decomposition,
linear trend with a confidence band, and a small-model forecast.

Every series operator works on a long frame ``(series, t, date, value)`` and
partitions its windows by ``series``: the script's single global series is
the one-key case, and many series (per region, country, product) run in one
job.  Windows only ever see aggregated rows (one per day or month), so their
size is bounded by the calendar, not by the number of invoice lines.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import config
from tillroll.functions.columns import year_fraction
from tillroll.operators import arma
from tillroll.session import materialize


def daily_sales(df: DataFrame, series: str | None = None, by: str | None = None) -> DataFrame:
    """TotalSales summed per calendar day: ``[series,] InvoiceDate,
    TotalSales`` -- one series labelled ``series``, one per value of column
    ``by``, or no series column."""
    if by:
        keys = [F.col(by).cast("string").alias("series")]
    else:
        keys = [F.lit(series).alias("series")] if series else []
    d = df.select(*keys, F.to_date("InvoiceDate").alias("InvoiceDate"), "TotalSales")
    g = d.groupBy(*(["series"] if keys else []), "InvoiceDate")
    return g.agg(F.sum("TotalSales").alias("TotalSales"))


def daily_sign_trend(df: DataFrame) -> DataFrame:
    """Positive and negative line totals per day in one pass (a day
    without lines of a sign has null there)."""
    ts = F.col("TotalSales")
    return (df.groupBy(F.to_date("InvoiceDate").alias("InvoiceDate"))
            .agg(F.sum(F.when(ts > 0, ts)).alias("PositiveSales"),
                 F.sum(F.when(ts < 0, ts)).alias("NegativeSales")))


def monthly_sales(df: DataFrame, series: str | None = None, by: str | None = None) -> DataFrame:
    """TotalSales per month, with position ``t`` (1..n)
    inside the series: ``series, Date, t, TotalSales``.  One series labelled
    ``series``, or one series per value of the column ``by`` (many series in
    one job)."""
    key = F.col(by).cast("string") if by else F.lit(series)
    m = (df.select(key.alias("series"),
                   F.trunc(F.to_date("InvoiceDate"), "month").alias("Date"), "TotalSales")
         .groupBy("series", "Date")
         .agg(F.sum("TotalSales").alias("TotalSales")))
    return with_position(m, "Date")


def with_position(df: DataFrame, order: str, series: str = "series", out: str = "t") -> DataFrame:
    """Row position inside each series (the positional index of a regular
    series; gaps in the calendar are not filled)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(series).orderBy(order)))


def decompose(df: DataFrame, value: str, period: int = config.DAILY_PERIOD,
              series: str = "series", t: str = "t") -> DataFrame:
    """Classical additive decomposition by position.

    trend: centred moving average over ``period`` (+1 with half weights at
    both ends when the period is even), null near the ends; seasonal: mean
    detrended value per cycle position ((t - 1) mod period), recentred so the
    ``period`` figures average 0; remainder = value - trend - seasonal.
    """
    h = period // 2
    w_ord = Window.partitionBy(series).orderBy(t)
    frame = w_ord.rowsBetween(-h, h)
    x = F.col(value)
    win_sum = F.sum(x).over(frame)
    win_n = F.count(F.lit(1)).over(frame)
    if period % 2 == 0:
        edge = (F.lag(x, h).over(w_ord) + F.lead(x, h).over(w_ord)) / F.lit(2)
        num = win_sum - edge
    else:
        num = win_sum
    trend = F.when(win_n == 2 * h + 1, num / F.lit(float(period)))
    d = (df.withColumn("trend", trend)
         .withColumn("_pos", (F.col(t) - 1) % period)
         .withColumn("_detr", x - F.col("trend")))
    fig = d.groupBy(series, "_pos").agg(F.avg("_detr").alias("_fig"))
    fig = fig.withColumn("figure", F.col("_fig") - F.avg("_fig").over(Window.partitionBy(series)))
    return (d.join(fig.select(series, "_pos", "figure"), [series, "_pos"])
            .withColumn("seasonal", F.col("figure"))
            .withColumn("remainder", x - F.col("trend") - F.col("seasonal"))
            .drop("_detr", "_pos", "figure"))


def linear_trend(monthly: DataFrame, value: str = "TotalSales", date: str = "Date",
                 series: str = "series") -> DataFrame:
    """OLS of value on the year fraction per series, with R-style
    summary figures (standard error and t value of the slope, residual sd)."""
    x = year_fraction(F.col(date))
    y = F.col(value)
    g = monthly.groupBy(series).agg(
        F.regr_count(y, x).alias("n"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"), F.regr_avgx(y, x).alias("x_mean"))
    sse = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")
    sigma = F.sqrt(F.try_divide(sse, (F.col("n") - 2).cast("double")))
    se = F.try_divide(sigma, F.sqrt(F.col("_sxx")))
    return (g.withColumn("sigma", sigma).withColumn("se_slope", se)
            .withColumn("t_slope", F.try_divide(F.col("slope"), F.col("se_slope")))
            .withColumn("sxx", F.col("_sxx"))
            .select(series, "n", "intercept", "slope", "r2", "sigma", "se_slope", "t_slope",
                    "x_mean", "sxx"))


def linear_summary(monthly: DataFrame, value: str = "TotalSales", date: str = "Date",
                   series: str = "series") -> DataFrame:
    """What R's ``summary(lm)`` prints, one row per series: both coefficients
    with standard error, t and p; residual standard error and quartiles; R2,
    adjusted R2, F and its p.  The p-values come from one row per series."""
    from tillroll.functions.stats import t_pvalue_udf

    fit = linear_trend(monthly, value, date, series)
    x = year_fraction(F.col(date))
    e = F.col(value) - (F.col("intercept") + F.col("slope") * x)
    rows = monthly.join(fit, series).withColumn("_e", e)          # one row per period
    resid = rows.groupBy(series).agg(F.min("_e").alias("resid_min"), *(
        F.percentile("_e", p).alias(f"resid_{n}") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))),
        F.max("_e").alias("resid_max"))
    df = (F.col("n") - 2).cast("double")
    se0 = F.col("sigma") * F.sqrt(1.0 / F.col("n") + F.pow("x_mean", F.lit(2)) / F.col("sxx"))
    out = (fit.join(resid, series).withColumn("df", F.col("n") - 2).withColumn("se_intercept", se0)
           .withColumn("t_intercept", F.try_divide(F.col("intercept"), F.col("se_intercept")))
           .withColumn("adj_r2", 1 - (1 - F.col("r2")) * F.try_divide((F.col("n") - 1).cast("double"), df))
           .withColumn("f_value", F.pow("t_slope", F.lit(2)))
           .withColumn("p_slope", t_pvalue_udf("t_slope", df))
           .withColumn("p_intercept", t_pvalue_udf("t_intercept", df)))
    return out.select(series, "n", "df", "intercept", "se_intercept", "t_intercept", "p_intercept",
                      "slope", "se_slope", "t_slope", "p_slope", "sigma", "r2", "adj_r2", "f_value",
                      F.col("p_slope").alias("f_p"), "resid_min", "resid_q1", "resid_median", "resid_q3",
                      "resid_max")


def trend_fit(monthly: DataFrame, value: str = "TotalSales", date: str = "Date",
              series: str = "series") -> DataFrame:
    """M17 (exact part): fitted value and its standard error per month,
    se_fit = sigma * sqrt(1/n + (x - x_mean)^2 / Sxx).  The band is
    fitted +/- t(0.975, n - 2) * se_fit (see :func:`trend_band`)."""
    fit = linear_trend(monthly, value, date, series)
    x = year_fraction(F.col(date))
    return (monthly.join(fit, series)
            .select(series, date, value,
                    (F.col("intercept") + F.col("slope") * x).alias("fitted"),
                    (F.col("sigma") * F.sqrt(1.0 / F.col("n") + F.pow(x - F.col("x_mean"), 2)
                                             / F.col("sxx"))).alias("se_fit"),
                    (F.col("n") - 2).alias("df")))


def trend_band(monthly: DataFrame, level: float = 0.95, **kw) -> DataFrame:
    """Fitted line with its confidence band (t quantile per series)."""
    from tillroll.functions.stats import t_quantile_udf

    f = trend_fit(monthly, **kw)
    series = kw.get("series", "series")
    crit = f.select(series, "df").distinct().select(                      # once per series, not per month
        series, t_quantile_udf(F.lit(0.5 + level / 2), F.col("df").cast("double")).alias("t_crit"))
    return (f.join(crit, series)
            .withColumn("lower", F.col("fitted") - F.col("t_crit") * F.col("se_fit"))
            .withColumn("upper", F.col("fitted") + F.col("t_crit") * F.col("se_fit")))


# ---------------------------------------------------------------------------
# Forecast (re-aim of an automatic ARIMA order search): five small candidate
# models with closed-form fits and the ARMA candidates of arma.py (moving-average and
# seasonal terms, fitted on the scored rows), chosen per series by AICc.  Every candidate is
# scored on the same rows: those behind the first season (snaive has no value
# before), or behind the second row where a series is too short for a season.
#   mean      y_t = mu + e                                   (1 coefficient)
#   drift     y_t = y_{t-1} + c + e                          (1)
#   ar1       y_t = a + b y_{t-1} + e                        (2)
#   ar1_diff  d_t = a + b d_{t-1} + e,  d_t = y_t - y_{t-1}  (2)
#   snaive    y_t = y_{t-12} + e                             (0)
#   arma.CANDIDATES                                          (2 to 4)
# FIXED VALUES: standard normal quantiles for the 80% and 95% bands.
Z80 = 1.2815515655446004
Z95 = 1.959963984540054
CLOSED = {"ar1": 2, "ar1_diff": 2, "drift": 1, "mean": 1, "snaive": 0}
#: Coefficients of every candidate.
COEFFICIENTS = CLOSED | {m: len(xs) + 1 for m, (_, xs) in arma.CANDIDATES.items()}
MODELS = sorted(COEFFICIENTS)


def _geo(b: F.Column, h: F.Column) -> F.Column:
    """sum_{j<h} b^j."""
    return F.when(b == 1, h.cast("double")).otherwise((1 - F.pow(b, h)) / (1 - b))


def candidate_values(series_df: DataFrame, value: str = "TotalSales", season: int = config.MONTHLY_PERIOD,
                     series: str = "series", t: str = "t") -> tuple[DataFrame, DataFrame]:
    """Per row the one-step fitted value of every candidate (``f_<model>``, null
    where it has none) and whether the row is scored; and the coefficients per
    series.  The windows are partitioned by series, one row per period."""
    w = Window.partitionBy(series).orderBy(t)
    y = F.col(value)
    f = (series_df.select(series, t, y.alias("y"))
         .withColumn("y1", F.lag("y", 1).over(w))
         .withColumn("ys", F.lag("y", season).over(w))
         .withColumn("d", F.col("y") - F.col("y1"))
         .withColumn("d1", F.lag("d", 1).over(w)))
    st = f.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("ybar"), F.avg("d").alias("c"),
        F.regr_intercept("y", "y1").alias("ar_a"), F.regr_slope("y", "y1").alias("ar_b"),
        F.regr_intercept("d", "d1").alias("ad_a"), F.regr_slope("d", "d1").alias("ad_b"))
    fitted = {
        "mean": F.col("ybar"),
        "drift": F.col("y1") + F.col("c"),
        "ar1": F.col("ar_a") + F.col("ar_b") * F.col("y1"),
        "ar1_diff": F.col("y1") + F.col("ad_a") + F.col("ad_b") * F.col("d1"),
        "snaive": F.col("ys"),
    }
    skipped = F.when(F.col("n") > season + 4, F.lit(season)).otherwise(F.lit(2))
    terms = arma.arma_rows(series_df, value, season, series, t)
    names = [c for c in terms.columns if c not in (series, t)]
    rows = f.drop("d", "d1").join(st, series).join(terms, [series, t]).select(
        series, t, "y", "y1", "ybar", (F.col(t) > skipped).alias("scored"), *names,
        *(e.alias(f"f_{m}") for m, e in fitted.items()))
    rows = materialize(rows, "candidate-rows")
    fits = materialize(st.join(arma.least_squares(rows, arma.CANDIDATES, {c: F.col("scored") for c in "zd"}, series),
                               series), "candidate-fits")
    return arma.arma_fitted(rows, fits, F.col("ybar"), F.col("y1"), series), fits


def model_fits(series_df: DataFrame, value: str = "TotalSales", season: int = config.MONTHLY_PERIOD,
               series: str = "series", t: str = "t") -> DataFrame:
    """Per series and candidate: coefficients, count m of scored rows (the same for
    all), SSE, sigma, AICc and in-sample RMSE.  A candidate without a value on
    some scored row is left out."""
    return _scores(*candidate_values(series_df, value, season, series, t), series)


def _scores(r: DataFrame, st: DataFrame, series: str) -> DataFrame:
    aggs = [F.count_if("scored").alias("_m")]
    for m in MODELS:
        e = F.when(F.col("scored"), F.col("y") - F.col(f"f_{m}"))
        aggs += [F.sum(F.pow(e, 2)).alias(f"sse_{m}"), F.count(e).alias(f"m_{m}")]
    sse = r.groupBy(series).agg(*aggs)
    k = COEFFICIENTS
    rows = sse.select(series, F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"sse_{m}").alias("sse"),
                 F.col(f"m_{m}").alias("m"), F.lit(k[m]).alias("p")) for m in MODELS])).alias("r"), "_m")
    rows = rows.select(series, "r.*", "_m").where("m = _m").drop("_m")
    m_, p_, sse_ = F.col("m").cast("double"), F.col("p").cast("double"), F.col("sse")
    aic = m_ * F.ln(sse_ / m_) + 2 * (p_ + 1)
    aicc = aic + F.try_divide(2 * (p_ + 1) * (p_ + 2), m_ - p_ - 2)
    return (rows.where((F.col("m") > F.col("p") + 2) & (F.col("sse") > 0))
            .withColumn("aicc", aicc)
            .withColumn("sigma", F.sqrt(sse_ / (m_ - p_)))
            .withColumn("rmse", F.sqrt(sse_ / m_))
            .join(st, series))


def forecast(series_df: DataFrame, h: int = config.FORECAST_H, value: str = "TotalSales",
             date: str = "Date", season: int = config.MONTHLY_PERIOD,
             series: str = "series", t: str = "t") -> DataFrame:
    """Horizon-``h`` forecast with 80 / 95 % bands from the candidate with
    the least AICc per series (ties: model name)."""
    rows, st = candidate_values(series_df, value, season, series, t)
    best_w = Window.partitionBy(series).orderBy("aicc", "model")
    best = (_scores(rows, st, series).withColumn("_r", F.row_number().over(best_w)).where("_r = 1").drop("_r"))
    last = series_df.groupBy(series).agg(F.max_by(value, t).alias("y_n"), F.max(date).alias("_d"),
                                         F.max(t).alias("_tn"))
    d_n = (series_df.withColumn("_d1", F.col(value) - F.lag(value, 1).over(
        Window.partitionBy(series).orderBy(t)))
        .groupBy(series).agg(F.max_by("_d1", t).alias("d_n")))
    best = arma.arma_path(rows, best, h, season, series, t)
    hz = (best.join(last, series).join(d_n, series)
          .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h)))))
    hh = F.col("h")
    hw = Window.partitionBy(series).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    b_ar, b_ad = F.col("ar_b"), F.col("ad_b")
    s_ad = _geo(b_ad, hh)
    g = F.col("ad_a") * s_ad + F.pow(b_ad, hh) * F.col("d_n")
    hz = (hz.withColumn("_cum_g", F.sum(g).over(hw))
          .withColumn("_cum_s2", F.sum(F.pow(s_ad, 2)).over(hw))
          .withColumn("_src_t", F.col("_tn") - season + (hh - 1) % season + 1))
    src = series_df.select(series, F.col(t).alias("_src_t"), F.col(value).alias("_y_src"))
    hz = hz.join(src, [series, "_src_t"], "left")
    n = F.col("n").cast("double")
    levels, diffs = ([m for m, (y, _) in arma.CANDIDATES.items() if y == c] for c in ("z", "d"))
    ahead = lambda c: F.get(F.col(c), hh - 1)
    point = (F.when(F.col("model") == "mean", F.col("ybar"))
             .when(F.col("model") == "drift", F.col("y_n") + hh * F.col("c"))
             .when(F.col("model") == "ar1", F.col("ar_a") * _geo(b_ar, hh) + F.pow(b_ar, hh) * F.col("y_n"))
             .when(F.col("model") == "ar1_diff", F.col("y_n") + F.col("_cum_g"))
             .when(F.col("model").isin(*levels), F.col("ybar") + ahead("path"))
             .when(F.col("model").isin(*diffs), F.col("y_n") + ahead("path"))
             .otherwise(F.col("_y_src")))
    var_ar = F.when(F.abs(b_ar) == 1, hh.cast("double")).otherwise(
        (1 - F.pow(b_ar, 2 * hh)) / (1 - F.pow(b_ar, 2)))
    se = F.col("sigma") * F.sqrt(
        F.when(F.col("model") == "mean", 1 + 1 / n)
        .when(F.col("model") == "drift", hh * (1 + hh / (n - 1)))
        .when(F.col("model") == "ar1", var_ar)
        .when(F.col("model") == "ar1_diff", F.col("_cum_s2"))
        .when(F.col("model").isin(*arma.CANDIDATES), F.pow(ahead("spread"), 2))
        .otherwise(F.floor((hh - 1) / season) + 1))
    return hz.select(
        series, "model", "h", F.add_months(F.col("_d"), hh).alias(date),
        point.alias("forecast"), se.alias("se"),
        (point - Z80 * se).alias("lo80"), (point + Z80 * se).alias("hi80"),
        (point - Z95 * se).alias("lo95"), (point + Z95 * se).alias("hi95"))


def forecast_accuracy(series_df: DataFrame, **kw) -> DataFrame:
    """The chosen model per series with its AICc and in-sample RMSE,
    next to every candidate's (for inspection)."""
    fits = model_fits(series_df, **kw)
    series = kw.get("series", "series")
    best_w = Window.partitionBy(series).orderBy("aicc", "model")
    return (fits.withColumn("chosen", F.row_number().over(best_w) == 1)
            .select(series, "model", "p", "m", "sse", "sigma", "aicc", "rmse", "chosen"))


def fitted_values(series_df: DataFrame, value: str = "TotalSales", date: str = "Date",
                  season: int = config.MONTHLY_PERIOD, series: str = "series", t: str = "t") -> DataFrame:
    """The chosen model's fitted value and residual per period (null where the
    model has none, at the start of a series)."""
    rows, st = candidate_values(series_df, value, season, series, t)
    best = (_scores(rows, st, series).groupBy(series)
            .agg(F.min(F.struct("aicc", "model")).getField("model").alias("model")))
    fitted = F.coalesce(*(F.when(F.col("model") == m, F.col(f"f_{m}")) for m in MODELS))
    return (rows.join(best, series).join(series_df.select(series, t, date), [series, t])
            .select(series, date, "model", F.col("y").alias(value), fitted.alias("fitted"),
                    (F.col("y") - fitted).alias("residual")))


def forecast_coefficients(series_df: DataFrame, value: str = "TotalSales", season: int = config.MONTHLY_PERIOD,
                          series: str = "series", t: str = "t") -> DataFrame:
    """``series, model, term, estimate, std_error`` of the chosen model.  Errors are sigma
    times the root of the inverse moment matrix's diagonal, over the rows that the model was fitted
    on.  ARMA candidates on levels are of levels less their mean (a seasonal naive model has none)."""
    rows, st = candidate_values(series_df, value, season, series, t)
    best = _scores(rows, st, series).groupBy(series).agg(F.min_by(F.struct("model", "sigma"), F.struct("aicc", "model")).alias("b")).select(
        series, "b.*")
    closed = {"mean": ("y", []), "ar1": ("y", ["y1"]), "drift": ("c", []), "ar1_diff": ("d", ["d1"])}
    rows = rows.withColumn("c", F.col("d"))
    own = arma.least_squares(rows, {m: closed[m] for m in ("mean", "drift", "ar1_diff")},
                             {"y": F.col("y").isNotNull(), "c": F.col("c").isNotNull(), "d": F.col("d1").isNotNull()}, series)
    lagged = arma.least_squares(rows, {"ar1": closed["ar1"]}, {"y": F.col("y1").isNotNull()}, series)
    fits = F.map_concat(F.col("fits"), F.col("own"), F.col("lagged"))
    table = (best.join(st.select(series, "fits"), series).join(own.withColumnRenamed("fits", "own"), series)
             .join(lagged.withColumnRenamed("fits", "lagged"), series)
             .select(series, "model", "sigma", fits[F.col("model")].alias("fit")))
    terms = {m: ["const", *xs] for m, (_, xs) in (closed | arma.CANDIDATES).items()} | {"snaive": []}
    names = F.from_json(F.lit(json.dumps(terms)), "map<string,array<string>>")[F.col("model")]
    picked = F.transform(names, lambda x, i: F.struct(
        x.alias("term"), F.col("fit.b")[i].alias("estimate"), (F.col("sigma") * F.sqrt(F.col("fit.v")[i])).alias("std_error")))
    return table.select(series, "model", F.explode(picked).alias("x")).select(series, "model", "x.*")


def forecast_summary(series_df: DataFrame, value: str = "TotalSales", season: int = config.MONTHLY_PERIOD,
                     series: str = "series", t: str = "t") -> DataFrame:
    """The chosen model per series with its training measures on the scored rows: sigma^2,
    log likelihood, AIC, AICc, BIC; ME, RMSE, MAE, MPE, MAPE (over values other than 0), MASE (against
    the seasonal naive error; null in a series without a season) and the lag-1 autocorrelation
    of the residuals."""
    rows, st = candidate_values(series_df, value, season, series, t)
    best = _scores(rows, st, series).groupBy(series).agg(F.min_by(
        F.struct("model", "p", "m", "sse", "sigma", "aicc", "rmse"), F.struct("aicc", "model")).alias("b")).select(
        series, "b.*")
    fitted = F.coalesce(*(F.when(F.col("model") == m, F.col(f"f_{m}")) for m in MODELS))
    w = Window.partitionBy(series)
    step = (rows.join(best.select(series, "model"), series).withColumn("naive", F.abs(F.col("z") - F.col("zs")))
            .withColumn("scale", F.avg("naive").over(w)).where("scored").withColumn("e", F.col("y") - fitted)
            .withColumn("c", F.col("e") - F.avg("e").over(w))
            .withColumn("c1", F.lag("c", 1).over(w.orderBy(t))))
    share = 100 * F.try_divide(F.col("e"), F.col("y"))
    measures = step.groupBy(series).agg(
        F.avg("e").alias("me"), F.avg(F.abs("e")).alias("mae"), F.avg(share).alias("mpe"),
        F.avg(F.abs(share)).alias("mape"), F.first("scale").alias("scale"),
        F.try_divide(F.sum(F.col("c") * F.col("c1")), F.sum(F.pow("c", 2))).alias("acf1"))
    m, q = F.col("m").cast("double"), F.col("p") + 1
    like = -m / 2 * (F.ln(2 * F.pi() * F.col("sse") / m) + 1)
    return best.join(measures, series).select(
        series, "model", "p", "m", F.pow("sigma", 2).alias("sigma2"), like.alias("loglik"),
        (2 * q - 2 * like).alias("aic"), "aicc", (q * F.ln(m) - 2 * like).alias("bic"), "me", "rmse", "mae", "mpe", "mape",
        F.try_divide(F.col("mae"), F.col("scale")).alias("mase"), "acf1")


def fill_gaps(daily: DataFrame, date: str = "InvoiceDate", value: str = "TotalSales",
              series: str | None = "series", fill: float = 0.0) -> DataFrame:
    """T11 option: one row per calendar day between each series' first and
    last day (missing days get ``fill``).  The day list per series is a
    ``sequence`` over its date range -- bounded by the calendar, not the data."""
    keys = [series] if series else []
    rng = daily.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = rng.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))
    return (days.join(daily, [*keys, date], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(fill))))
