"""The physical plans keep what the design promises."""

import re

import pytest
from pyspark.sql import functions as F

from keelmark.operators import analytics as an
from keelmark.operators import premium as pr
from keelmark.operators import profiling as pf
from keelmark.operators import sampling as sm
from keelmark.operators.cleaning import clean
from keelmark.operators.features import add_features
from keelmark.operators.folds import stratified_folds
from keelmark.plans.catalog import QUERIES
from keelmark.schema import RAW_SCHEMA, RECORD_COLUMNS


def plan(df, mode="simple"):
    explain = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(explain)


def final_plan(df):
    """The adaptive plan after a run."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollectPublic()
    text = execution.executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


NO_PLAN = {  # these fit models or write files while they are built
    n for n in QUERIES if re.match(r"s\d|m(2|3|5|6|7|8|9|10|16|18)_|m12_cross", n)
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_PLAN))
def test_no_python_and_no_pairing_of_rows(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_cleaning_is_one_narrow_stage(spark):
    text = plan(clean(spark.createDataFrame([], RAW_SCHEMA)))
    assert "Exchange" not in text


def test_pricing_is_one_narrow_stage(scored):
    text = plan(pr.append_premiums(scored))
    assert "Exchange" not in text and "Join" not in text


def test_filters_reach_the_scan(scored):
    text = plan(an.filter_incidents(scored, regions=["South Asia"], years=(1996, 1997), min_pct=50.0).select("incident_id"), "formatted")
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    for column in ("region", "year", "attack_probability_pct"):
        assert column in pushed
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "nearest_country" not in schema


def test_scans_are_pruned(scored):
    schema = re.search(r"ReadSchema: (.*)", plan(an.counts_by(scored, "attack_type"), "formatted")).group(1)
    assert schema.strip() == "struct<attack_type:string>"


@pytest.mark.parametrize("make", [sm.highest_risk, sm.lowest_risk, sm.map_sample, sm.sample_records])
def test_top_k_is_a_bounded_sort(make, scored):
    assert "TakeOrderedAndProject" in plan(make(scored))


def test_top_values_are_limited_before_the_shuffle(scored):
    assert "WindowGroupLimit" in plan(pf.categorical_summary(scored))


def test_groups_are_combined_before_the_shuffle(scored):
    assert "partial_count" in plan(an.counts_by(scored, "region"))


def test_only_small_tables_are_broadcast(scored):
    text = plan(add_features(scored))
    assert text.count("BroadcastHashJoin") == 1 and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("make", [
    lambda df: an.rate_by_band(pr.append_premiums(df)), an.distance_by_region, an.median_probability,
    lambda df: pf.outliers_iqr(df, ["latitude", "shore_distance"]), lambda df: pf.numeric_summary(df, ["latitude", "shore_distance"]),
])
def test_quantile_rounds_read_the_written_order_keys(scored, make):
    text = plan(make(scored))
    assert "log2" not in text.lower() and "pow(" not in text.lower()
    scans = [line for line in text.split("\n") if "FileScan" in line]
    assert sum("order-keys" in line and "_key" in line for line in scans) == 4
    assert sum("order-keys" not in line for line in scans) <= 1


def test_quantiles_shuffle_histograms_only(spark, scored):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(pf.outliers_iqr(scored, ["latitude", "shore_distance"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next(row for row in lines[i + 1:] if "Project" not in row)
            assert any(k in below for k in ("HashAggregate", "SortAggregate", "Window", "Filter")), below


def test_first_rows_keep_the_partitions_of_the_scan(spark):
    many = spark.range(40_000, numPartitions=9000).select(
        F.col("id").alias("incident_id"), *[F.lit(0).alias(c) for c in RECORD_COLUMNS]
    )
    assert "Coalesce" not in plan(sm.sample_records(many))


def test_median_is_of_unrounded_values(spark):
    df = spark.createDataFrame([(12.341,), (12.344,), (12.346,), (None,)], "attack_probability_pct double")
    assert an.median_probability(df).first()[0] == 12.344
    assert an.median_probability(df.limit(0)).first()[0] is None


def test_fold_ranks_are_joined_without_moving_the_rows_again(spark, scored):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(stratified_folds(scored))
        wide = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "_slice" in line]
        assert "SortMergeJoin" in text
        # One exchange of the rows; the others carry the counts of the slices.
        assert len(wide) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_scenarios_do_not_multiply_the_rows(scored):
    text = plan(pr.price_scenarios(scored, [pr.Scenario("a"), pr.Scenario("b", lgd=0.5)]))
    lines = text.split("\n")
    generate = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert any("HashAggregate" in line and "_pct" in line for line in lines[generate:])


def test_roll_up_expands_counted_leaves(scored):
    lines = plan(an.band_attack_hierarchy(scored)).split("\n")
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert any("HashAggregate" in line for line in lines[expand:])


def test_checkpoint_folder_is_the_sessions(spark):
    from keelmark.session import ensure_checkpoint_dir, new_folder, shared_folder

    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    assert new_folder(spark, "x").startswith(shared_folder(spark))
    assert spark.range(3).agg(F.sum("id")).first()[0] == 3


def test_written_folders_can_be_removed(spark):
    import os

    from keelmark import session

    others, session._folders[:] = list(session._folders), []
    try:
        paths = [session.new_folder(spark, "removed") for _ in range(3)]
        for path in paths[:2]:
            spark.range(5).write.parquet(path)
        assert session.remove_folders(spark) == 2
        assert not any(os.path.exists(path) for path in paths) and not session._folders
    finally:
        session._folders[:] = others
