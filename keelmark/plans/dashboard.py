"""The tables behind the six dashboard tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keelmark.operators import analytics as an
from keelmark.operators import evaluation as ev
from keelmark.operators import sampling as sm
from keelmark.operators.premium import ensure_premiums


def model_tables(predictions: DataFrame, importances: DataFrame, folds: DataFrame) -> dict[str, DataFrame]:
    """The tables of the two model tabs.

    ``predictions`` has the regression's log_shore_distance and prediction per row,
    ``importances`` its features, ``folds`` the classifier's metrics per fold.
    """
    return {
        "predicted_vs_actual": ev.residuals(predictions, "log_shore_distance", "prediction"),
        "joint_range": ev.joint_range(predictions, "log_shore_distance", "prediction"),
        "top_importances": ev.top_importances(importances),
        "cv_table": ev.cv_table(folds),
        "cv_kpis": ev.cv_kpis(folds),
    }


def dashboard_tables(table: DataFrame, **filters) -> dict[str, DataFrame]:
    """Lazy tables over the scored table, by name; ``model_tables`` has those of the models.

    The filters apply to the record samples and to the probability tab; the
    other tabs describe the whole table. Write the scored table once (partitioned
    by year) and pass the table read from there: every entry is then a pruned scan.
    """
    chosen = an.filter_incidents(table, **filters)
    priced = ensure_premiums(table)
    return {
        "regions": an.filter_regions(table),
        "range": an.filter_range(table),
        "overview": an.overview_kpis(table),
        "attack_types": an.counts_by(table, "attack_type"),
        "vessel_statuses": an.counts_by(table, "vessel_status"),
        "records": sm.sample_records(chosen),
        "annual": an.annual_counts(table),
        "peak_year": an.peak_year(table),
        "region_counts": an.counts_by(table, "region"),
        "year_month": an.year_month_matrix(table),
        "distance_by_region": an.distance_by_region(table),
        "map_sample": sm.map_sample(table),
        "class_counts": an.class_counts(table),
        "region_class": an.region_class_counts(table),
        "probability_kpis": an.probability_kpis(chosen),
        "band_counts": an.band_counts(chosen),
        "probability_histogram": an.probability_histogram(chosen),
        "probability_grid": an.probability_grid(chosen),
        "hierarchy": an.band_attack_hierarchy(chosen),
        "probability_by_region": an.mean_probability_by_region(chosen),
        "probability_by_year": an.mean_probability_by_year(chosen),
        "results": sm.filtered_results(chosen),
        "highest_risk": sm.highest_risk(chosen),
        "lowest_risk": sm.lowest_risk(chosen),
        "median_probability": an.median_probability(priced),
        "portfolio": an.portfolio_kpis(priced),
        "premium_by_region": an.mean_premium_by_region(priced),
        "rate_by_band": an.rate_by_band(priced),
        "premium_sample": sm.premium_sample(priced),
        "premium_histogram": an.premium_histogram(priced),
        "premium_preview": sm.premium_preview(priced),
    }
