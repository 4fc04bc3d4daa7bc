"""The batch job: load, clean, profile, fit, cross-validate, score, price, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keelmark import constants as K
from keelmark.operators.cleaning import clean, cleaning_report
from keelmark.operators.evaluation import cv_summary, overfit_verdict
from keelmark.operators.features import add_features, class_balance
from keelmark.operators.folds import stratified_folds
from keelmark.operators.models import (
    FittedModel, classifier, cross_validate, feature_importances, fit_classification, fit_regression, score,
)
from keelmark.operators.premium import append_premiums, premium_by_band, premium_statistics
from keelmark.operators.preparation import classification_features
from keelmark.operators.profiling import explore, outliers_iqr, table_profile
from keelmark.plans.dashboard import model_tables
from keelmark.schema import ENRICHED_COLUMNS, INCIDENT_COLUMNS
from keelmark.sources.files import add_incident_id, load_incidents, write_enriched


@dataclass(frozen=True)
class BatchResult:
    enriched: DataFrame
    reports: dict[str, DataFrame]
    regression: FittedModel
    classification: FittedModel


def score_and_price(features: DataFrame, model: FittedModel) -> DataFrame:
    """The enriched table: incident, label, percentage, band and premium columns."""
    columns = ["incident_id", *ENRICHED_COLUMNS]
    return append_premiums(score(features, model)).select(*columns)


def enrich(cleaned: DataFrame, trees: int = K.TREES) -> DataFrame:
    """Fit the classifier on all rows, then score and price the same rows."""
    features = add_features(cleaned)
    return score_and_price(features, fit_classification(features, trees))


def run_batch(
    spark: SparkSession, csv_path: str, out_path: str, clean_path: str,
    trees: int = K.TREES, folds: int = K.FOLDS, parallelism: int = 4,
) -> BatchResult:
    """Run the job on CSV files.

    The cleaned table is written to ``clean_path`` first, then the features with their
    folds and the regression's predictions beside it: the fits and all reports on cleaned rows are
    column-pruned Parquet reads, and a lost executor costs no CSV parsing. Only the
    two reports on the raw rows parse the CSV again.
    """
    raw = load_incidents(spark, csv_path)
    cleaned_rows = clean(add_incident_id(raw))
    cleaned_rows.select("incident_id", *INCIDENT_COLUMNS).write.parquet(clean_path)
    cleaned = spark.read.parquet(clean_path)

    features_path = f"{clean_path.rstrip('/')}-features"
    stratified_folds(add_features(cleaned), k=folds).write.parquet(features_path)
    features = spark.read.parquet(features_path)
    regression = fit_regression(features, trees)
    predictions_path = f"{clean_path.rstrip('/')}-predictions"
    regression.transform(features).select("incident_id", "log_shore_distance", "prediction").write.parquet(predictions_path)
    cv = cross_validate(features, classification_features(), lambda: classifier(trees), folds, parallelism)
    classification = fit_classification(features, trees)
    write_enriched(score_and_price(features, classification), out_path)

    importances = feature_importances(spark, regression)
    enriched = spark.read.parquet(out_path).select("incident_id", *ENRICHED_COLUMNS)
    reports = {
        "raw_profile": table_profile(raw),
        "cleaning": cleaning_report(raw),
        "outliers": outliers_iqr(cleaned, ["longitude", "latitude", "shore_distance"]),
        **explore(cleaned),
        "class_balance": class_balance(enriched),
        "importances": importances,
        **model_tables(spark.read.parquet(predictions_path), importances, cv),
        "cv": cv,
        "cv_summary": cv_summary(cv),
        "overfitting": overfit_verdict(cv),
        "premium_statistics": premium_statistics(enriched),
        "premium_by_band": premium_by_band(enriched),
    }
    return BatchResult(enriched, reports, regression, classification)
