"""Every query that has SQL gives the same rows and types as DuckDB."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from keelmark.operators import models as md
from keelmark.plans import batch
from keelmark.plans.catalog import QUERIES as CATALOG
from tests.compare import connect, difference

QUERIES, SQL = queries(), oracle_sql()
FITS = {n for n in SQL if re.match(r"m(7|8|9|10|16|18)_|m12_cross", n)}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(SQL) - FITS))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(FITS - {"m12_cross_validation"}))
def test_fit_matches_sql(name, spark, sf_dir, duck, monkeypatch):
    """With fewer trees, for the time that 200 take; ``tests.compare`` runs these queries as they are registered."""
    regression, classification = md.fit_regression, md.fit_classification
    monkeypatch.setattr(md, "fit_regression", lambda df: regression(df, 10))
    monkeypatch.setattr(md, "fit_classification", lambda df: classification(df, 10))
    monkeypatch.setattr(batch, "fit_classification", lambda df, trees: classification(df, 10))
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


def test_cross_validation_matches_sql(spark, sf_dir, duck, monkeypatch):
    """All folds with five trees, which need not beat the base rate in every small fold: that flag is left to ``tests.compare``."""
    classifier = md.classifier
    monkeypatch.setattr(md, "classifier", lambda: classifier(5))
    name, flag = "m12_cross_validation", "better_than_base_rate"
    assert difference(QUERIES[name](spark, sf_dir).drop(flag), duck, f"SELECT * EXCLUDE ({flag}) FROM ({SQL[name]})") is None


def test_every_query_of_the_catalogue_has_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(CATALOG) <= set(SQL)


def test_entry(spark):
    assert entry(spark).columns == ["region", "avg_premium_usd"]
