"""Operators on hand-written rows, edge cases and brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelmark.operators import analytics as an
from keelmark.operators import cleaning as cl
from keelmark.operators import evaluation as ev
from keelmark.operators import features as ft
from keelmark.operators import premium as pr
from keelmark.operators import profiling as pf
from keelmark.operators import sampling as sm
from keelmark.operators.folds import hashed_folds, stratified_folds
from keelmark.operators.quantiles import (
    column_quantiles, exact_quantiles, quantiles_of_rows, value_rows, with_order_key,
)
from keelmark.schema import INCIDENT_SCHEMA, QUOTE_SCHEMA, RAW_SCHEMA

GOOD = ("2001", "5", "10.5", "-3.25", "Boarded", "Anchored", "12.5", "AAA", "South Asia")


def raw_rows(spark, *changes):
    names = RAW_SCHEMA.fieldNames()
    rows = [tuple({**dict(zip(names, GOOD)), **change}.values()) for change in changes]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_clean_rows(spark):
    df = raw_rows(
        spark, {}, {"year": "2.5"}, {"latitude": "NaN"}, {"month": " "}, {"longitude": "180"}, {"longitude": "180.01"},
        {"shore_distance": "-0.01"}, {"shore_distance": "0"}, {"month": "13"}, {"attack_type": None},
        {"vessel_status": "\t "}, {"region": "None"}, {"nearest_country": " nan "}, {"year": "1900"}, {"year": "2101"},
    )
    out = cl.clean(df).collect()
    assert len(out) == 8
    assert {r.attack_type for r in out} == {"Boarded", "Unknown"}
    assert sum(r.vessel_status == "Unknown" for r in out) == 1
    report = cl.cleaning_report(df).first().asDict()
    assert report == {
        "rows_in": 15, "dropped_null": 3, "filled_attack_type": 1, "filled_vessel_status": 1,
        "filled_nearest_country": 1, "filled_region": 1, "dropped_domain": 4, "rows_out": 8,
    }


def test_clean_accepts_typed_columns(spark):
    typed = spark.createDataFrame(
        [(2001.0, 5, 10.5, -3.25, "Boarded", "Anchored", 12.5, "AAA", "South Asia"),
         (2001.5, 5, 10.5, -3.25, "Boarded", "Anchored", 12.5, "AAA", "South Asia"),
         (2001.0, 5, 10.5, float("nan"), "Boarded", "Anchored", 12.5, "AAA", "South Asia")],
        "year double, month int, longitude double, latitude double, attack_type string, vessel_status string, "
        "shore_distance double, nearest_country string, region string",
    )
    assert [(r.year, r.month, r.latitude) for r in cl.clean(typed).collect()] == [(2001, 5, -3.25)]


def test_clean_needs_its_columns(spark):
    with pytest.raises(ValueError, match="region"):
        cl.clean(spark.createDataFrame([], INCIDENT_SCHEMA).drop("region"))


def _samples():
    rng = random.Random(3)
    return {
        "lognormal": [rng.lognormvariate(0, 4) for _ in range(3000)],
        "outlier": [1000 + rng.random() for _ in range(999)] + [1e12],
        "constant": [7.25] * 50,
        "mixed": [rng.gauss(0, 1) for _ in range(501)],
        "copies": [rng.choice([1.5, 2.5, -3.0]) for _ in range(2000)],
        "one": [42.0],
        "two": [1.0, 2.0],
        "huge": [-1e300, 1e300, 0.0, 5.0],
    }


def test_exact_quantiles_match_numpy(spark):
    rows = [(k, x) for k, xs in _samples().items() for x in xs]
    rows += [("mixed", None), ("mixed", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    probabilities = {"p0": 0.0, "p1": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p999": 0.999, "p100": 1.0}
    for fixed_keys, repeated in ((True, False), (True, True), (False, None)):
        out = {r.k: r for r in exact_quantiles(df, ["k"], "x", probabilities, fixed_keys, repeated).collect()}
        assert set(out) == set(_samples())
        for k, xs in _samples().items():
            got = [out[k][name] for name in probabilities]
            assert got == pytest.approx(list(np.quantile(xs, list(probabilities.values()))), rel=1e-12), k


def test_quantiles_of_many_keys_are_shuffled(spark, monkeypatch):
    from keelmark.operators import quantiles as q
    monkeypatch.setattr(q, "BROADCAST_INTERVALS", 599)
    df = spark.range(6000).select((F.col("id") % 300).alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = {r.k: r.m for r in exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert out == {k: np.median([i * 7 % 1000 for i in range(k, 6000, 300)]) for k in range(300)}


def test_weighted_quantiles(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 4), ("a", None, 9), ("b", 7.0, 1), (None, 1.0, 1)]
    found = quantiles_of_rows(value_rows(spark.createDataFrame(rows, "k string, x double, _n long"), ["k"], "x", weight="_n"), ["k"], {"m": 0.5, "q": 0.25})
    assert sorted(tuple(r) for r in found.select("k", "m", "q").collect()) == [("a", 3.5, 1.0), ("b", 7.0, 7.0)]


def test_order_keys_follow_the_bits_of_doubles(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(-2 ** 63, 2 ** 63 - 1, 5000, dtype=np.int64).view(np.float64)
    values = [*values[~np.isnan(values)].tolist(), 0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, float("inf"), float("-inf"), 1.7976931348623157e308]
    values += [2.0 ** k for k in range(-1074, 1024, 7)] + [float(np.nextafter(2.0 ** k, 0)) for k in range(-1021, 1024, 7)]
    for r in with_order_key(spark.createDataFrame([(x,) for x in values], "_value double")).collect():
        bits = int(np.float64(abs(r["_value"])).view(np.int64))
        assert r["_key"] == (-bits if r["_value"] < 0 else bits)


def test_tight_clusters_are_split_in_every_round(spark, monkeypatch):
    from keelmark.operators import quantiles as q

    xs = [1.0 + i * 1e-13 for i in range(50_000)] + [1.007]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(F.lit("a").alias("k"), "x")
    most, keep = [], q._keep_wanted

    def counted(counts, within, order, probabilities):
        most.append(counts.groupBy(*within).count().agg(F.max("count")).first()[0])
        return keep(counts, within, order, probabilities)
    monkeypatch.setattr(q, "_keep_wanted", counted)
    out = exact_quantiles(df, ["k"], "x", {"m": 0.5, "p": 0.99}, fixed_keys=True).first()
    assert [out.m, out.p] == pytest.approx(list(np.quantile(xs, [0.5, 0.99])), rel=1e-15)
    assert len(most) == 4 and max(most) <= 65_536 and most[0] < 5


def test_sketched_quantiles_are_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).alias("b"))
    out = {r["column"]: r for r in column_quantiles(df, ["a", "b"], {"q": 0.5}, exact=False).collect()}
    assert out["a"].q == pytest.approx(5000, abs=11)
    assert out["b"].q == pytest.approx(10000, abs=21)


def test_profiles_match_pandas(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1990, 2000), rng.lognormvariate(1, 1), rng.choice("abcdefghijkl")) for _ in range(400)]
    pdf = pd.DataFrame(rows, columns=["y", "v", "c"])
    df = spark.createDataFrame(rows, "y int, v double, c string")
    out = pf.numeric_summary(df, ["y", "v"]).toPandas().set_index("column")
    want = pdf[["y", "v"]].describe().T.round(3)
    for theirs, ours in {"count": "count", "mean": "mean", "std": "std", "25%": "q25", "50%": "q50", "75%": "q75"}.items():
        assert list(out[ours]) == pytest.approx(list(want[theirs]), abs=1e-9)
    assert list(out["skew"]) == pytest.approx(list(pdf[["y", "v"]].skew().round(3)), abs=1e-9)

    q1, q3 = pdf.v.quantile(0.25), pdf.v.quantile(0.75)
    outside = int(((pdf.v < q1 - 1.5 * (q3 - q1)) | (pdf.v > q3 + 1.5 * (q3 - q1))).sum())
    assert pf.outliers_iqr(df, ["v"]).first().n_outliers == outside

    top = pf.categorical_summary(df, ["c"]).orderBy("rank").collect()
    assert [r.n for r in top] == list(pdf.c.value_counts().head(8))
    assert {(r.n_distinct, r.n_more) for r in top} == {(12, 4)}


def test_profile_counts_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y"), (2.0, "z")], "a double, b string")
    out = {r["column"]: (r.dtype, r.n_rows, r.n_missing, r.pct_missing) for r in pf.table_profile(df).collect()}
    assert out == {"a": ("double", 4, 2, 50.0), "b": ("string", 4, 1, 25.0)}


def test_correlation_order(spark):
    df = spark.createDataFrame([(1, 1.0, 9.0), (2, 2.5, 1.0), (3, 2.9, 5.0), (4, 4.2, 4.0)], "year int, shore_distance double, latitude double")
    out = pf.correlation_with(df, columns=["year", "shore_distance", "latitude"]).collect()
    assert [r["column"] for r in out] == ["year", "latitude"]


@pytest.mark.parametrize("k", [3, 10])
def test_folds_are_exactly_stratified(spark, k):
    df = spark.range(2357).select(
        F.col("id").alias("incident_id"), (F.col("id") % 3 == 0).cast("int").alias("attack_occurred")
    )
    rows = stratified_folds(df.repartition(7), k=k).collect()
    assert sorted(r.incident_id for r in rows) == list(range(2357))
    for label in (0, 1):
        members = sorted(
            (hashlib.md5(f"42:{r.incident_id}".encode()).hexdigest(), r.fold) for r in rows if r.attack_occurred == label
        )
        assert [fold for _, fold in members] == [i % k for i in range(len(members))]


def test_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "incident_id int, attack_occurred int")
    assert stratified_folds(df, k=2).count() == 3


def test_hashed_folds_cover_all_rows(spark):
    counts = hashed_folds(spark.range(5000).withColumnRenamed("id", "incident_id"), k=5).groupBy("fold").count().collect()
    assert len(counts) == 5 and sum(r["count"] for r in counts) == 5000


def test_top_countries_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "nearest_country string")
    out = {r.nearest_country: r.country_grouped for r in ft.group_rare(df, n=2).collect()}
    assert out == {"c": "c", "a": "a", "b": "Other"}


def quotes(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], QUOTE_SCHEMA)


def test_quote_closed_form(spark):
    row = pr.quote_premiums(quotes(spark, (0.5, "South Asia", None, None, None, None))).first()
    assert (row.expected_loss_usd, row.risk_premium_usd, row.base_premium_usd, row.total_premium_usd) == (
        7_000_000.0, 8_400_000.0, 12_500.0, 8_412_500.0)
    assert (row.premium_rate_pct, row.risk_band, row.lambda_region) == (33.65, "High", 1.6)


BAD = [
    (1.5, "x", None, None, None, None), (float("nan"), "x", None, None, None, None), (None, "x", None, None, None, None),
    (0.5, "x", 0.0, None, None, None), (0.5, "x", None, 0.0, None, None), (0.5, "x", None, 1.01, None, None),
    (0.5, "x", None, None, -0.1, None), (0.5, "x", None, None, None, -0.1),
]


def test_quarantine_names_the_rule(spark):
    rows = pr.quote_premiums(quotes(spark, *BAD, (0.5, "x", None, 1.0, 0.0, 0.0)), "quarantine").orderBy("request_id").collect()
    rules = [(r.error or "ok").split()[0] for r in rows]
    assert rules == ["p_attack"] * 3 + ["insured_value", "lgd", "lgd", "theta", "base_rate", "ok"]
    assert all(r.total_premium_usd is None and r.risk_band is None for r in rows[:-1])


def test_invalid_quote_fails_the_job(spark):
    for bad in BAD:
        with pytest.raises(Exception, match="invalid request"):
            pr.quote_premiums(quotes(spark, bad)).collect()
    with pytest.raises(ValueError):
        pr.quote_premiums(quotes(spark, BAD[0]), "ignore")


def test_premiums_clip_and_default(spark):
    df = spark.createDataFrame(
        [(-5.0, "South Asia"), (140.0, "Nowhere"), (None, "South Asia"), (float("nan"), None)],
        "attack_probability_pct double, region string",
    )
    rows = pr.append_premiums(df).collect()
    assert rows[0].total_premium_usd == 12_500.0
    assert rows[1].expected_loss_usd == 8_750_000.0 and rows[1].lambda_region == 1.0
    assert rows[2].total_premium_usd is None and rows[3].total_premium_usd is None
    assert rows[2].base_premium_usd == 12_500.0


def test_statistics_need_their_columns(spark):
    with pytest.raises(ValueError, match="total_premium_usd"):
        pr.premium_statistics(spark.range(1).toDF("x"))


def test_scenarios_equal_row_by_row_pricing(scored):
    scenario = pr.Scenario("s", insured_value=7_000_000.0, lgd=0.5, theta=0.1, base_rate=0.001)
    got = pr.price_scenarios(scored, [scenario]).first()
    rows = pr.append_premiums(scored, 7_000_000.0, 0.5, 0.1, 0.001)
    want = rows.agg(
        F.count("*").alias("n"), F.sum(F.col("total_premium_usd").cast("decimal(20,2)")).cast("double").alias("total")
    ).first()
    assert (got.n_voyages, got.total_premium_usd) == (want.n, want.total)


def test_empty_table(spark, scored):
    empty = pr.append_premiums(scored.where(F.lit(False)))
    assert tuple(an.probability_kpis(empty).first()) == (0, 0.0, 0.0, 0.0)
    assert [(r.risk_band, r.n) for r in an.band_counts(empty).collect()] == [
        ("Low", 0), ("Moderate", 0), ("High", 0), ("Critical", 0)]
    assert [(r.avg_premium_usd, r.n) for r in pr.premium_by_band(empty).collect()] == [(0.0, 0)] * 4
    for make in (an.premium_histogram, an.rate_by_band, an.distance_by_region, an.probability_grid, an.peak_year):
        assert make(empty).collect() == []


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "total_premium_usd double")
    assert [tuple(r) for r in an.premium_histogram(df).collect()] == [(0, 2)]


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0, "Low"), (100.0, "Critical"), (98.0, "Critical")], "attack_probability_pct double, risk_band string")
    out = an.probability_histogram(df).collect()
    assert [(r.bin, r.n) for r in out] == [(0, 1), (49, 2)]


def test_histograms_cover_all_rows(scored):
    n = scored.count()
    priced = pr.append_premiums(scored)
    assert an.probability_histogram(scored).agg(F.sum("n")).first()[0] == n
    assert an.premium_histogram(priced).agg(F.sum("n")).first()[0] == n


def test_positive_distances_only(scored):
    whole = an.distance_by_region(scored).agg(F.sum("n")).first()[0]
    positive = an.distance_by_region(scored, positive_only=True).agg(F.sum("n")).first()[0]
    assert positive == scored.where("shore_distance > 0").count() <= whole


def test_sample_is_fixed_and_bounded(scored):
    first = [r.incident_id for r in sm.map_sample(scored, 100).collect()]
    again = [r.incident_id for r in sm.map_sample(scored.repartition(3), 100).collect()]
    assert sorted(first) == sorted(again) and len(set(first)) == 100
    lowest = sorted((hashlib.md5(f"42:{r.incident_id}".encode()).hexdigest(), r.incident_id) for r in scored.select("incident_id").collect())
    assert first == [i for _, i in lowest[:100]]
    assert sm.map_sample(scored, 10**6).count() == scored.count()
    assert sorted(first) != sorted(r.incident_id for r in sm.seeded_sample(scored, 100, seed=1).collect())


def test_filters_combine(scored):
    out = an.filter_incidents(scored, regions=["South Asia"], years=(1996, 1997), bands=["High"], min_pct=60).collect()
    assert out and all(
        r.region == "South Asia" and 1996 <= r.year <= 1997 and r.risk_band == "High" and r.attack_probability_pct >= 60
        for r in out
    )
    assert an.filter_incidents(scored).count() == scored.count()


@pytest.mark.parametrize("gap,verdict", [(0.0299, "none"), (0.03125, "mild"), (0.0625, "mild"), (0.125, "significant")])
def test_overfit_verdict(spark, gap, verdict):
    folds = spark.createDataFrame([(0, 0.5 + gap, 0.5, 0.1)], "fold int, acc_train double, acc_test double, brier_test double")
    assert ev.overfit_verdict(folds).first().overfitting == verdict


def test_summary_uses_population_deviation(spark):
    folds = spark.createDataFrame(
        [(0, 0.9, 0.7, 0.1), (1, 0.7, 0.9, 0.3)], "fold int, acc_train double, acc_test double, brier_test double"
    )
    out = {r.metric: r for r in ev.cv_summary(folds).collect()}
    assert out["acc_test"]["std"] == pytest.approx(0.1) and out["brier_test"]["mean"] == pytest.approx(0.2)
