"""Fits read cleaned incidents that were written once, and walk only rows that a level asks for."""

import datetime

import numpy as np
import pytest

from keelmark.operators import boosting as bo
from keelmark.plans import catalog


@pytest.fixture
def order_tables(spark, tmp_path):
    """Orders with a null key and a key that comes twice."""
    day = datetime.datetime(1996, 3, 4)
    orders = [(k, k and k % 3, 1000.0 * i, day) for i, k in enumerate([None, 7, 7, *range(20, 60)])]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"),
        "customer": ([(0, 0), (1, 1), (2, 0)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "INDIA", 0), (1, "KENYA", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA"), (1, "AFRICA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["m8_fit_classification", "m12_cross_validation", "m18_enrich"])
def test_fits_read_cleaned_rows_that_were_written(spark, monkeypatch, order_tables, query):
    class Stop(Exception):
        pass

    def stop(df, *_, **__):
        assert "o_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
        raise Stop

    monkeypatch.setattr(catalog.md, "fit_classification", stop)
    monkeypatch.setattr(catalog, "stratified_folds", stop)
    monkeypatch.setattr(catalog, "enrich", stop)
    with pytest.raises(Stop):
        catalog.QUERIES[query](spark, order_tables)


def test_written_rows_are_the_cleaned_ones(spark, order_tables):
    cleaned = catalog.src.incidents(spark, order_tables)
    written = catalog._written(cleaned, "clean")
    assert written.schema.simpleString() == cleaned.schema.simpleString()
    assert cleaned.count() and sorted(map(repr, written.collect())) == sorted(map(repr, cleaned.collect()))


def test_rows_walk_to_their_nodes():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 8, 500).astype("<u2") for _ in range(2)]
    block = bo.Block((0, 0), words, np.zeros(500), np.zeros(500))
    splits = {0: (0, np.arange(8) > 3), 2: (1, np.arange(8) > 5), 5: (0, np.arange(8) > 6)}
    right, over, last = words[0] > 3, words[1] > 5, words[0] > 6
    expected = {1: ~right, 6: right & over, 11: right & ~over & ~last, 12: right & ~over & last}
    rows = np.arange(0, 500, 2)
    found = block.walked(splits, rows)
    assert found.keys() == expected.keys()
    assert all(np.array_equal(found[node], rows[expected[node][rows]]) for node in expected)
    assert {node: r.tolist() for node, r in block.walked(splits, rows, [12]).items()} == {12: found[12].tolist()}
    assert {node: r.tolist() for node, r in block.walked({}, rows, [0]).items()} == {0: rows.tolist()}
