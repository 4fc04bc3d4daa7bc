"""Column functions against hand-computed values and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelmark.functions import cleaning as cl
from keelmark.functions import features as fx
from keelmark.functions.risk import clip_pct, risk_band
from keelmark.functions.rounding import rounded, rounded_exactly
from keelmark.functions.statistics import adjusted_skewness


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_text_numbers(spark):
    texts = ["12.5", " 7 ", "1e3", "NaN", "inf", "1.5d", "2f", "", "abc", None, "-0.25"]
    assert values(spark, texts, "string", cl.to_double(F.col("x"))) == [
        12.5, 7.0, 1000.0, None, None, None, None, None, None, None, -0.25]
    texts = ["2001", " 3 ", "2000.0", "2.5", "1e3", "x", None, "9999999999"]
    assert values(spark, texts, "string", cl.to_int(F.col("x"))) == [2001, 3, 2000, None, 1000, None, None, None]


def test_text_repair(spark):
    texts = [None, "\t  ", "nan", "None", " Boarded　\n", " x y "]
    assert values(spark, texts, "string", cl.fill_unknown(cl.strip(F.col("x")))) == [
        "Unknown", "Unknown", "Unknown", "Unknown", "Boarded", "x y"]


def test_whitespace_is_what_python_strips():
    assert set(cl.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_hotspot_is_zero_km_away(spark):
    row = spark.range(1).select(
        fx.hotspot_km(F.lit(12.0), F.lit(47.0)), fx.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
    ).first()
    assert row[0] == 0.0
    assert row[1] == pytest.approx(math.pi * 6371.0)


def test_season(spark):
    sine, cosine = fx.season(F.col("x"))
    assert values(spark, [1, 4, 7, 10], "int", F.round(sine, 6)) == [0, 1, 0, -1]
    assert values(spark, [1, 4, 7, 10], "int", F.round(cosine, 6)) == [1, 0, -1, 0]


def test_lookups_default(spark):
    assert values(spark, ["Hijacked", "Unlisted", None], "string", fx.attack_severity(F.col("x"))) == [6, 3, 3]
    assert values(spark, ["Towed", "Unlisted", None], "string", fx.vessel_vulnerability(F.col("x"))) == [4, 3, 3]
    assert values(spark, ["Gulf of Aden", "Nowhere", None], "string", fx.region_multiplier(F.col("x"))) == [2.5, 1, 1]
    assert values(spark, ["Boarded", "Boarding", None], "string", fx.attack_completed(F.col("x"))) == [1, 0, 0]


def test_band_edges(spark):
    pct = [24.99, 25.0, 49.99, 50.0, 74.99, 75.0, 100.0, None, float("nan")]
    assert values(spark, pct, "double", risk_band(F.col("x"))) == [
        "Low", "Moderate", "Moderate", "High", "High", "Critical", "Critical", None, None]


def test_band_of_raw_and_rounded_probability_differ(spark):
    raw = F.lit(0.24996)
    row = spark.range(1).select(risk_band(raw * 100), risk_band(rounded(raw * 100, 2))).first()
    assert tuple(row) == ("Low", "Moderate")


def test_clip(spark):
    assert values(spark, [-5.0, 140.0, 30.5, None, float("nan")], "double", clip_pct(F.col("x"))) == [
        0.0, 100.0, 30.5, None, None]


def _awkward_numbers():
    rng = random.Random(7)
    ties = [k / 200 for k in range(1, 400)] + [k / 2e7 + 4 for k in range(1, 400, 2)]
    wild = [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 14) for _ in range(600)]
    return ties + wild + [2.675, 1.005, -2.675, 0.0, 1e15 + 0.3, 2.0 ** 53, 1e300]


@pytest.mark.parametrize("digits", [2, 4, 6])
def test_exact_rounding_is_pythons(spark, digits):
    numbers = _awkward_numbers()
    assert values(spark, numbers, "double", rounded_exactly("x", digits)) == [round(x, digits) for x in numbers]


@pytest.mark.parametrize("digits", [2, 6])
def test_column_rounding_is_numpys(spark, digits):
    numbers = [x for x in _awkward_numbers() if abs(x) < 1e200]
    assert values(spark, numbers, "double", rounded("x", digits)) == list(np.round(np.array(numbers), digits))


def test_skewness_is_bias_corrected(spark):
    import pandas as pd

    rows = [1.0, 2.0, 2.5, 3.0, 40.0]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    assert df.agg(adjusted_skewness(F.col("x"))).first()[0] == pytest.approx(pd.Series(rows).skew())
    assert df.limit(2).agg(adjusted_skewness(F.col("x"))).first()[0] is None
    assert df.agg(adjusted_skewness(F.lit(3.0))).first()[0] == 0.0
