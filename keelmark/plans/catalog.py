"""The checked queries: each runs one operator over whole tables of a test folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelmark import constants as K
from keelmark.functions.risk import risk_band
from keelmark.functions.rounding import rounded
from keelmark.operators import analytics as an
from keelmark.operators import cleaning as cl
from keelmark.operators import evaluation as ev
from keelmark.operators import features as ft
from keelmark.operators import models as md
from keelmark.operators import premium as pr
from keelmark.operators import preparation as pp
from keelmark.operators import profiling as pf
from keelmark.operators import sampling as sm
from keelmark.operators.folds import stratified_folds
from keelmark.plans.batch import enrich
from keelmark.schema import (
    ENRICHED_COLUMNS, FLOAT_COLUMNS, INCIDENT_COLUMNS, INTEGER_COLUMNS, NUMERIC_COLUMNS, PREMIUM_COLUMNS,
    PREMIUM_TABLE_COLUMNS, RECORD_COLUMNS, TEXT_COLUMNS,
)
from keelmark.session import new_folder
from keelmark.sources import derived as src
from keelmark.sources import files as io

Query = Callable[[SparkSession, str], DataFrame]

ID = "incident_id"

FILTERS = {
    "regions": ["South Asia", "Sub-Saharan Africa", "South America"],
    "years": (1996, 1999),
    "bands": ["Moderate", "High", "Critical"],
    "min_pct": 30.0,
}
SCENARIOS = [
    pr.Scenario("defaults"),
    pr.Scenario("large hull", insured_value=120_000_000.0),
    pr.Scenario("high loss", lgd=0.6, theta=0.35),
    pr.Scenario("gulf transit", region="Gulf of Aden", base_rate=0.002),
    pr.Scenario("even odds", probability_pct=50.0, region="South Asia"),
]


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Key and columns, doubles rounded and without a negative zero."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(ID, *[
        (rounded(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in columns
    ])


def _on(table: Callable, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(table(spark, sf_dir))


def raw(make): return _on(src.raw_incidents, make)
def cleaned(make): return _on(src.incidents, make)
def scored(make): return _on(src.scored_incidents, make)
def priced(make): return _on(src.scored_incidents, lambda df: make(pr.append_premiums(df)))
def featured(make): return _on(src.incidents, lambda df: make(ft.add_features(_written(df, "clean"))))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what reads it several times does not parse and clean the texts again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def feature(step: Callable, columns: list[str]) -> Query:
    return cleaned(lambda df: _rounded(step(df), columns))


def row_feature(*names: str) -> Query:
    return feature(lambda df: ft.add_row_features(df, *names), list(names))


def _read_csv(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).options(**io.CSV_OPTIONS).csv(path)


def _load_csv(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "raw-csv")
    io.write_csv(df, path)
    return io.load_incidents(df.sparkSession, path, df.schema)


def _write_enriched(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "enriched")
    io.write_enriched(df, path)
    return df.sparkSession.read.parquet(path).select(ID, *ENRICHED_COLUMNS)


def _write_enriched_csv(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "enriched-csv")
    io.write_enriched(df, path, "csv")
    return _read_csv(df, path).select(ID, *ENRICHED_COLUMNS)


def _export_filtered(df: DataFrame) -> DataFrame:
    chosen = an.filter_incidents(df, **FILTERS)
    path = new_folder(df.sparkSession, "filtered-csv")
    io.export_filtered(chosen, path)
    return _read_csv(chosen, path)


def _export_results(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "results-csv")
    io.export_results(df, path)
    return _read_csv(df.select(*RECORD_COLUMNS), path)


def _export_premiums(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "premium-csv")
    io.export_premiums(df, path)
    return _read_csv(df.select(*PREMIUM_TABLE_COLUMNS), path)


def _typed_folds(df: DataFrame) -> DataFrame:
    """Typed but unfiltered rows with folds: they still hold NULL numbers."""
    typed = df.transform(cl.coerce_integers).transform(cl.coerce_floats).transform(cl.strip_text)
    return _written_folds(ft.add_row_features(typed, "attack_occurred"))


def _written_folds(df: DataFrame) -> DataFrame:
    """Rows with folds, written once: what is fitted on them reads them several times and ranks no row again."""
    return _written(stratified_folds(df), "folds")


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("fold") != 0)


def _impute(df: DataFrame) -> DataFrame:
    folded = _typed_folds(df)
    medians = pp.fit_medians(_train(folded), NUMERIC_COLUMNS)
    return _rounded(pp.impute(folded, medians), ["fold", *NUMERIC_COLUMNS])


def _scale(df: DataFrame) -> DataFrame:
    folded = _written_folds(df)
    columns = pp.regression_features().numeric
    return _rounded(pp.scale(folded, pp.fit_scaling(_train(folded), columns)), ["fold", *columns])


def _one_hot(df: DataFrame) -> DataFrame:
    folded = _written_folds(df)
    columns = pp.regression_features().categorical
    encoder = pp.fit_one_hot(_train(folded), columns)
    names = pp.one_hot_names(encoder, columns)
    encoded = encoder.transform(folded)
    return pp.feature_values(encoded, {f"_hot_{c}": names[c] for c in columns if names[c]})


def _vectors(df: DataFrame) -> DataFrame:
    folded = _written_folds(df)
    fitted = pp.fit_preprocessor(_train(folded), pp.classification_features())
    values = pp.feature_values(fitted.transform(folded), {"features": fitted.names})
    return values.withColumn("value", rounded("value", 6) + F.lit(0.0)).where(F.col("value") != 0)


def _fixed_fold_scores(df: DataFrame) -> DataFrame:
    """Rows as every fold's model would score them, here with fixed probabilities.

    The model of fold i shifts the percentage by i, so that the folds differ. Equal
    rows are counted before they are multiplied by the folds.
    """
    counted = stratified_folds(df).groupBy("fold", "attack_occurred", "attack_probability_pct").agg(
        F.count(F.lit(1)).alias("n")
    )
    shifted = F.col("attack_probability_pct") + F.col("model_fold")
    probability = F.least(shifted, F.lit(100.0)) / 100
    return (
        counted.withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(K.FOLDS - 1))))
        .select("model_fold", "fold", F.col("attack_occurred").alias("label"), probability.alias("probability"), "n")
        .withColumn("prediction", F.when(F.col("probability") > 0.5, 1.0).otherwise(0.0))
    )


def _fold_table(df: DataFrame) -> DataFrame:
    return ev.fold_metrics(_fixed_fold_scores(df), "n")


def _fixed_predictions(df: DataFrame) -> DataFrame:
    """Log distances with a fixed prediction for each."""
    logged = ft.add_row_features(df, "log_shore_distance")
    return logged.withColumn("prediction", F.col("log_shore_distance") * 0.9 + F.col("attack_probability_pct") / 100)


def _better(rows: DataFrame, loss: Column, constant: Column) -> Column:
    """Whether the whole table's loss is below that of its best constant, as a scalar."""
    return rows.agg((F.avg(loss) < constant).alias("better")).scalar()


def _regression(df: DataFrame) -> tuple[md.FittedModel, DataFrame]:
    """The fitted model and its predictions, written so that they are made once."""
    fitted = md.fit_regression(df)
    path = new_folder(df.sparkSession, "regression")
    fitted.transform(df).select(ID, "log_shore_distance", "prediction").write.parquet(path)
    return fitted, df.sparkSession.read.parquet(path)


def _regression_rows(df: DataFrame) -> DataFrame:
    _, rows = _regression(df)
    prediction = F.col("prediction")
    return rows.select(
        ID, rounded("log_shore_distance", 6).alias("log_shore_distance"),
        (~F.isnan(prediction) & (F.abs(prediction) < 1e3)).alias("finite"), _better_regression(rows),
    )


def _better_regression(rows: DataFrame) -> Column:
    target = F.col("log_shore_distance")
    return _better(rows, F.pow(F.col("prediction") - target, 2), F.var_pop(target)).alias("better_than_constant")


def _final_fit(df: DataFrame) -> DataFrame:
    _, rows = _regression(df)
    checked = ev.residuals(rows, "log_shore_distance", "prediction")
    ends = ev.joint_range(rows, "log_shore_distance", "prediction")
    inside = (F.col("prediction") >= ends.select("low").scalar()) & (F.col("prediction") <= ends.select("high").scalar())
    return checked.select(
        ID, rounded("log_shore_distance", 6).alias("log_shore_distance"),
        (F.col("abs_residual") == F.abs(F.col("log_shore_distance") - F.col("prediction"))).alias("residual_fits"),
        inside.alias("in_joint_range"), _better_regression(rows),
    )


def _importances(df: DataFrame) -> DataFrame:
    fitted = md.fit_regression(df)
    found = md.feature_importances(df.sparkSession, fitted)
    return found.join(md.split_counts(df.sparkSession, fitted), "feature").select(
        "feature", (F.col("importance").between(0, 1)).alias("is_share"),
        rounded(found.agg(F.sum("importance").alias("s")).scalar(), 6).alias("total"),
        ((F.col("importance") > 0) == (F.col("splits") > 0)).alias("follows_splits"),
    )


def _scored(df: DataFrame) -> DataFrame:
    """Score of every row by the classifier fitted on all of them, written so that it is made once."""
    path = new_folder(df.sparkSession, "scores")
    md.fit_classification(df).transform(df).select(ID, "attack_occurred", "probability", "prediction").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _classification_rows(df: DataFrame) -> DataFrame:
    rows = _scored(df)
    label, probability = F.col("attack_occurred").cast("double"), F.col("probability")
    better = _better(rows, F.pow(probability - label, 2), F.var_pop(label))
    return rows.select(
        ID, "attack_occurred", probability.between(0, 1).alias("is_probability"),
        (F.col("prediction") == (probability > 0.5).cast("double")).alias("prediction_fits"),
        better.alias("better_than_constant"),
    )


def _in_bounds(pct: Column) -> Column:
    return (pct.between(0, 100) & (rounded(pct, 2) == pct)).alias("pct_in_bounds")


def _better_scores(rows: DataFrame) -> Column:
    """Whether the written percentages tell the classes apart better than their base rate does."""
    label = F.col("attack_occurred").cast("double")
    return _better(rows, F.pow(F.col("attack_probability_pct") / 100 - label, 2), F.var_pop(label)).alias("better_than_constant")


def _scores(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "score-rows")
    md.score(df, md.fit_classification(df)).select(ID, "attack_occurred", "attack_probability_pct", "risk_band").write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    pct = F.col("attack_probability_pct")
    return rows.select(
        ID, "attack_occurred", _in_bounds(pct), (F.col("risk_band") == risk_band(pct)).alias("band_follows"), _better_scores(rows),
    )


def _enriched(df: DataFrame) -> DataFrame:
    """The enriched rows, with flags that say whether band and premiums follow from the percentage."""
    path = new_folder(df.sparkSession, "enriched-rows")
    enrich(df).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    again = pr.append_premiums(rows.drop(*PREMIUM_COLUMNS)).select(ID, *[F.col(c).alias(f"_{c}") for c in PREMIUM_COLUMNS])
    pct = F.col("attack_probability_pct")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PREMIUM_COLUMNS])
    return rows.join(again, ID).select(
        ID, *INCIDENT_COLUMNS, "attack_occurred", _in_bounds(pct), (F.col("risk_band") == risk_band(pct)).alias("band_follows"),
        same.alias("premiums_follow"), _better_scores(rows),
    )


def _cross_validation(df: DataFrame) -> DataFrame:
    features = pp.classification_features()
    folded = _written_folds(df.select(ID, *features.columns, features.target))
    found = md.cross_validate(folded, features, md.classifier, parallelism=K.FOLDS)
    return found.join(ev.base_rate_brier(folded), "fold").select(
        "fold", "train_rows", "test_rows", F.col("acc_train").between(0, 1).alias("acc_train_is_share"),
        F.col("acc_test").between(0, 1).alias("acc_test_is_share"), (F.col("brier_test") < F.col("base_brier")).alias("better_than_base_rate"),
    )


QUERIES: dict[str, Query] = {
    # Sources and sinks
    "s1_load_csv": raw(_load_csv),
    "s2_write_enriched": priced(_write_enriched),
    "s2_write_enriched_csv": priced(_write_enriched_csv),
    "s3_export_filtered": scored(_export_filtered),
    "s4_export_results": scored(_export_results),
    "s4_export_filtered_results": scored(lambda df: _export_results(an.filter_incidents(df, **FILTERS))),
    "s5_export_premiums": priced(_export_premiums),
    # Profiling
    "p1_table_profile": raw(pf.table_profile),
    "p2_categorical_summary": cleaned(pf.categorical_summary),
    "p3_numeric_summary": cleaned(lambda df: pf.numeric_summary(df, digits=6)),
    "p4_outliers_iqr": cleaned(lambda df: pf.outliers_iqr(df, FLOAT_COLUMNS, digits=6)),
    "p5_correlation": cleaned(lambda df: pf.correlation_with(df, digits=6)),
    "p6_explore": cleaned(pf.explore_rows),
    # Cleaning
    "c1_coerce_integers": raw(lambda df: cl.coerce_integers(df).select(ID, *INTEGER_COLUMNS)),
    "c2_coerce_floats": raw(lambda df: cl.coerce_floats(df).select(ID, *FLOAT_COLUMNS)),
    "c3_strip_text": raw(lambda df: cl.strip_text(df).select(ID, *TEXT_COLUMNS)),
    "c4_drop_critical_nulls": raw(
        lambda df: df.transform(cl.coerce_integers).transform(cl.coerce_floats)
        .transform(cl.drop_critical_nulls).select(ID, *NUMERIC_COLUMNS)
    ),
    "c5_fill_unknown": raw(
        lambda df: df.transform(cl.strip_text).transform(cl.fill_unknown_text).select(ID, *TEXT_COLUMNS)
    ),
    "c6_domain_filter": raw(
        lambda df: df.transform(cl.coerce_integers).transform(cl.coerce_floats)
        .transform(cl.keep_in_domain).select(ID, *NUMERIC_COLUMNS)
    ),
    "c7_cleaning_report": raw(cl.cleaning_report),
    "c8_clean": raw(cl.clean),
    # Features
    "f1_log_shore_distance": row_feature("log_shore_distance"),
    "f2_season": row_feature("month_sin", "month_cos"),
    "f3_hotspot_distance": row_feature("dist_gulf_aden_km"),
    "f4_abs_latitude": row_feature("abs_latitude"),
    "f5_interaction": row_feature("lon_lat_interaction"),
    "f6_attack_severity": row_feature("attack_severity"),
    "f7_vessel_vulnerability": row_feature("vessel_vulnerability"),
    "f8_group_rare_countries": feature(ft.group_rare, ["nearest_country", "country_grouped"]),
    "f9_year_trend": feature(ft.add_year_trend, ["year", "year_trend"]),
    "f10_label": feature(
        lambda df: ft.add_row_features(df, "attack_occurred"), ["attack_type", "attack_occurred"]
    ),
    "f11_class_balance": scored(lambda df: ft.class_balance(df).withColumn("pct_positive", rounded("pct_positive", 6))),
    "f12_drop_encoded": scored(ft.drop_encoded),
    "f13_engineer_features": cleaned(
        lambda df: (lambda t: _rounded(t, [c for c in t.columns if c != ID]))(ft.engineer_features(df)[0])
    ),
    # Models
    "m1_prepare_features": cleaned(lambda df: (lambda t: _rounded(t, [
        *pp.feature_set(t).columns, pp.feature_set(t).target
    ]))(ft.engineer_features(df)[0])),
    "m2_median_imputer": raw(_impute),
    "m3_standard_scaler": featured(_scale),
    "m4_fill_missing_category": raw(
        lambda df: pp.fill_missing_categories(df, TEXT_COLUMNS).select(ID, *TEXT_COLUMNS)
    ),
    "m5_one_hot": featured(_one_hot),
    "m6_feature_vectors": featured(_vectors),
    "m7_fit_regression": featured(_regression_rows),
    "m8_fit_classification": featured(_classification_rows),
    "m9_final_fit": featured(_final_fit),
    "m10_feature_importances": featured(_importances),
    "m11_stratified_folds": scored(lambda df: stratified_folds(df).select(ID, "attack_occurred", "fold")),
    "m12_fold_metrics": scored(lambda df: _fold_table(df).select(
        "fold", *[rounded(c, 6).alias(c) for c in ev.FOLD_METRICS]
    )),
    "m12_cross_validation": featured(_cross_validation),
    "m13_cv_summary": scored(lambda df: ev.cv_summary(_fold_table(df))),
    "m14_overfit_verdict": scored(lambda df: ev.overfit_verdict(_fold_table(df))),
    "m15_leakage_safe_features": featured(lambda df: _rounded(
        pp.select_features(df, pp.classification_features()),
        [*pp.classification_features().columns, "attack_occurred"],
    )),
    "m16_score_rows": featured(_scores),
    "m17_risk_band": cleaned(lambda df: df.select(
        ID, risk_band((F.col(ID) % 10001 * 7907 % 10001).cast("double") / 100).alias("risk_band")
    )),
    "m18_enrich": cleaned(lambda df: _enriched(_written(df, "clean"))),
    "m19_residuals": scored(lambda df: _rounded(
        ev.residuals(_fixed_predictions(df), "log_shore_distance", "prediction"),
        ["log_shore_distance", "prediction", "abs_residual"],
    )),
    "m19_joint_range": scored(lambda df: ev.joint_range(
        _fixed_predictions(df), "log_shore_distance", "prediction"
    ).select(rounded("low", 6).alias("low"), rounded("high", 6).alias("high"))),
    # Premiums
    "a1_region_multiplier": cleaned(lambda df: pr.add_region_multiplier(df).select(ID, "region", "lambda_region")),
    "a2_append_premiums": priced(lambda df: df.select(ID, *PREMIUM_COLUMNS)),
    "a3_quote_premiums": _on(src.quote_requests, lambda df: pr.quote_premiums(df, "quarantine")),
    "a3_quote_valid": _on(src.quote_requests, lambda df: pr.quote_premiums(
        df.where((F.col("p_attack") >= 0) & (F.col("p_attack") <= 1) & (F.coalesce("insured_value", F.lit(1.0)) > 0)), "fail"
    )),
    "a4_band_of_probability": _on(
        src.quote_requests, lambda df: pr.band_of_probability(df, "p_attack").select("request_id", "risk_band")
    ),
    "a5_premium_statistics": priced(pr.premium_statistics),
    "a6_premium_by_band": priced(pr.premium_by_band),
    "a7_price_scenarios": scored(lambda df: pr.price_scenarios(df, SCENARIOS)),
    "a8_ensure_premiums": scored(lambda df: pr.ensure_premiums(pr.ensure_premiums(df)).select(ID, *PREMIUM_COLUMNS)),
    # Analytics
    "d1_filter": scored(lambda df: an.filter_incidents(df, **FILTERS)),
    "d2_filter_regions": scored(an.filter_regions),
    "d2_filter_range": scored(an.filter_range),
    "d3_overview_kpis": scored(an.overview_kpis),
    "d4_attack_type_counts": scored(lambda df: an.counts_by(df, "attack_type")),
    "d5_vessel_status_counts": scored(lambda df: an.counts_by(df, "vessel_status")),
    "d6_region_counts": scored(lambda df: an.counts_by(df, "region")),
    "d7_annual_counts": scored(an.annual_counts),
    "d8_peak_year": scored(an.peak_year),
    "d9_year_month_matrix": scored(an.year_month_matrix),
    "d10_distance_by_region": scored(an.distance_by_region),
    "d11_map_sample": scored(sm.map_sample),
    "d12_sample_records": scored(lambda df: sm.sample_records(an.filter_incidents(df, **FILTERS))),
    "d13_filtered_results": scored(lambda df: sm.filtered_results(an.filter_incidents(df, **FILTERS))),
    "d14_class_counts": scored(an.class_counts),
    "d15_region_class_counts": scored(an.region_class_counts),
    "d16_cv_table": scored(lambda df: ev.cv_table(_fold_table(df))),
    "d16_cv_kpis": scored(lambda df: ev.cv_kpis(_fold_table(df))),
    "d17_probability_kpis": scored(lambda df: an.probability_kpis(an.filter_incidents(df, **FILTERS))),
    "d18_band_counts": scored(lambda df: an.band_counts(an.filter_incidents(df, **FILTERS))),
    "d19_probability_histogram": scored(an.probability_histogram),
    "d20_probability_grid": scored(an.probability_grid),
    "d21_band_attack_hierarchy": scored(an.band_attack_hierarchy),
    "d22_probability_by_region": scored(an.mean_probability_by_region),
    "d23_probability_by_year": scored(an.mean_probability_by_year),
    "d24_portfolio_kpis": priced(an.portfolio_kpis),
    "d25_premium_by_region": priced(an.mean_premium_by_region),
    "d26_rate_by_band": priced(an.rate_by_band),
    "d27_premium_sample": priced(sm.premium_sample),
    "d28_premium_histogram": priced(an.premium_histogram),
    "d29_median_probability": scored(an.median_probability),
    "d30_premium_preview": priced(sm.premium_preview),
    "t1_highest_risk": scored(sm.highest_risk),
    "t2_lowest_risk": scored(sm.lowest_risk),
}
