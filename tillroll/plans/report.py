"""The whole analysis as one multi-report job.

``full_report(raw)`` cleans the invoice lines once (written as a table in the
shared checkpoint folder) and derives every report table from it, in the
order of the analysed script.  Returns name -> DataFrame; write them with
:func:`tillroll.sources.sinks.publish_all`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import config
from tillroll.functions.columns import ln_pos
from tillroll.operators import (clean, clustering, customers, distribution, inference, kpi, lattice,
                                quality, timeseries)
from tillroll.session import materialize


def full_report(raw: DataFrame, churn_as_of: str | None = config.CHURN_REFERENCE_DATE,
                with_clustering: bool = True) -> dict[str, DataFrame]:
    P = clean.Populations(raw, materialize=True)
    r: dict[str, DataFrame] = {}
    # profiling and cleaning
    r["missing_rows"] = quality.missing_rows(raw)
    r["missing_summary"] = kpi.missing_summary(raw)
    r["duplicates_by_key"] = quality.duplicates_by_key(raw)
    r["duplicates_exact"] = quality.duplicates_exact(raw)
    r["countries"] = quality.distinct_countries(P.reg)
    # key figures of the six populations
    r["kpi_clean"] = kpi.kpi_table(P.sc, overall_first=True)
    r["kpi_positive"] = kpi.kpi_table(P.pos)
    r["kpi_scaled"] = kpi.kpi_table(P.scaled, sales="TotalSales_MinMax", qty="Quantity_MinMax")
    r["kpi_no_outliers"] = kpi.kpi_table(P.noout)
    r["kpi_no_outliers_positive"] = kpi.kpi_table(P.noout_pos)
    r["kpi_negative"] = kpi.kpi_table(P.neg)
    r["multi_region_customers"] = customers.multi_region_customers(P.sc)
    # hold-out regression
    split = inference.scale_by_train(inference.scale_by_train(
        inference.stratified_split(P.sc), "TotalSales", "z"), "TotalSales", "minmax")
    r["ols_rmse_z"] = inference.holdout_rmse(split, "TotalSales_Z")
    r["ols_rmse_minmax"] = inference.holdout_rmse(split, "TotalSales_MinMax")
    # outliers, bulk and low-value orders
    r["bulk_lines"] = P.sc.where(F.col("Quantity") > config.BULK_STRICT)
    r["outliers"] = P.out
    r["bulk_impact"] = kpi.bulk_impact(P.sc)
    r["metrics_with_without_outliers"] = kpi.metrics_with_without_outliers(P.sc, P.sc_z)
    r["impact_bulk"] = lattice.impact_table(P.sc_z, "pos", "noout_pos", "With_Bulk_Orders",
                                            "Without_Bulk_Orders")
    r["impact_low_orders"] = lattice.impact_table(P.sc_z, "noout_pos", "nolow", "With_Low_Orders",
                                                  "Without_Low_Orders")
    r["populations"] = lattice.population_table(P.sc_z)
    r["negative_share"] = kpi.share_percent(P.sc, F.col("TotalSales") < 0, "percentage_negative")
    # distributions
    r["hist_negative"] = distribution.histogram(P.neg, F.col("TotalSales"),
                                                config.HIST_WIDTH_NEGATIVE)
    r["hist_sales"] = distribution.histogram(P.pos, F.col("TotalSales"), config.HIST_WIDTH_SALES)
    r["hist_log_sales"] = distribution.histogram(P.pos, ln_pos("TotalSales"),
                                                 config.HIST_WIDTH_LOG_SALES)
    r["hist_log_sales_no_outliers"] = distribution.histogram(
        P.noout_pos, ln_pos("TotalSales"), config.HIST_WIDTH_LOG_SALES_NOOUT)
    r["box_quantity"] = distribution.box_stats(P.pos, F.col("Quantity"))
    r["box_log_quantity"] = distribution.box_stats(P.pos, ln_pos("Quantity"))
    r["box_log_quantity_no_outliers"] = distribution.box_stats(P.noout_pos, ln_pos("Quantity"))
    # customers and regions
    mix = customers.guest_mix(P.pos)
    r["guest_mix"] = mix
    r["guest_mix_profile"] = customers.column_profile(mix, "line_count")
    r["region_avg_bulk"] = customers.region_average_with_without(
        P.pos.drop("Region"), P.noout_pos.drop("Region"))
    # regional differences
    r["anova_log"] = inference.anova_oneway(P.noout_pos, ln_pos("TotalSales"), with_pvalue=True)
    r["anova_log_bulk"] = inference.anova_oneway(P.pos, ln_pos("TotalSales"), with_pvalue=True)
    r["tukey_log"] = inference.tukey_hsd(P.noout_pos, ln_pos("TotalSales"), with_pvalue=True)
    r["tukey_log_bulk"] = inference.tukey_hsd(P.pos, ln_pos("TotalSales"), with_pvalue=True)
    for name, df in [("anova_scaled", P.noout_pos), ("anova_scaled_bulk", P.pos)]:
        z = customers.zscale(df, ["TotalSales"], "_scaled")
        r[name] = inference.anova_oneway(z, F.col("TotalSales_scaled"), with_pvalue=True)
    # churn
    ch = customers.churn(P.sc, as_of=churn_as_of)
    r["churn"] = ch
    r["churn_rate"] = customers.churn_rate(ch)
    # series
    daily = (timeseries.daily_sales(P.sc, "clean")
             .unionByName(timeseries.daily_sales(P.noout, "no_outliers")))
    r["daily_sales"] = daily
    r["daily_sign_trend"] = timeseries.daily_sign_trend(P.sc)
    r["daily_sign_trend_no_outliers"] = timeseries.daily_sign_trend(P.noout)
    r["decomposition"] = timeseries.decompose(timeseries.with_position(daily, "InvoiceDate"),
                                              "TotalSales", config.DAILY_PERIOD)
    monthly = materialize(timeseries.monthly_sales(P.noout_pos, "clean")
                          .unionByName(timeseries.monthly_sales(P.pos, "positive")), "monthly")
    r["monthly_sales"] = monthly
    r["forecast"] = timeseries.forecast(monthly)
    r["forecast_accuracy"] = timeseries.forecast_accuracy(monthly)
    r["forecast_coefficients"] = timeseries.forecast_coefficients(monthly)
    r["forecast_summary"] = timeseries.forecast_summary(monthly)
    r["forecast_fitted"] = timeseries.fitted_values(monthly)
    r["trend"] = timeseries.linear_summary(monthly)
    r["trend_band"] = timeseries.trend_band(monthly)
    # customer segmentation
    r["customer_features_positive"] = customers.customer_features(P.pos)
    r["customer_features_no_outliers_positive"] = customers.customer_features(P.noout_pos)
    r["customer_features_no_outliers"] = customers.customer_features(P.noout, return_rate=True)
    if with_clustering:
        feats = customers.customer_features(P.pos).drop("distinct_orders")
        labelled, _ = clustering.segment(feats)
        r["segments"] = labelled
        r["cluster_profile"] = clustering.cluster_profile(labelled)
        vecs = clustering.scaled_vectors(feats).persist()
        try:
            r["elbow"] = clustering.elbow(vecs)
        finally:
            vecs.unpersist()
    return r
