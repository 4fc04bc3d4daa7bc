import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelmark.llm.maxscore import Postings, quantised, search_top
from keelmark.llm.quality import CompressionClassifier, fit_quality, logistic, score_quality
from keelmark.llm.queries import op3_topk_search, op4_quality
from keelmark.llm.sql import OP3
from tests.compare import connect, difference
from tests.llm.cases import edge_frame, edge_rows, table_rows


def test_search_matches_sql(spark, sf_dir):
    assert difference(op3_topk_search(spark, sf_dir), connect(sf_dir), OP3) is None


@pytest.mark.parametrize("seed", range(4))
def test_postings_match_all_products(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-5, 6, (1500, 12)) * (rng.random((1500, 12)) < 0.4)
    vectors[700:760] = vectors[3]  # ties
    postings = Postings(vectors)
    for query in [*(rng.integers(-5, 6, (5, 12))), np.zeros(12, np.int64), vectors[3] * 3]:
        places, scores = postings.search(query, np.array([705]), 10)
        every = vectors @ query
        want = [i for i in np.lexsort((np.arange(1500), -every)) if i != 705][:10]
        assert places.tolist() == want and scores.tolist() == every[want].tolist()


@pytest.mark.parametrize("share, most", [(1, 5), (1, 1000), (1, 10 ** 8), (0.5, 5), (0.05, 9)])
def test_many_queries_share_a_traversal(share, most):
    rng = np.random.default_rng(int(most))
    vectors = rng.integers(0, most + 1, (3000, 30)) * (rng.random((3000, 30)) < share)
    vectors[:, 0] = rng.integers(-most, most, 3000)
    vectors[900:1000] = vectors[7]  # ties
    queries, own = vectors[::25] - most // 2 * (np.arange(120) % 2)[:, None], [np.arange(i, i + i % 3) for i in range(0, 3000, 25)]
    postings = Postings(vectors)
    assert bool(postings.posts) == (share < 0.1) and len(postings.full) + len(postings.posts) == 60
    for query, left_out, (places, scores) in zip(queries, own, postings.search_all(queries, own, 10)):
        every = vectors @ query
        order = np.lexsort((np.arange(3000), -every))
        want = order[~np.isin(order, left_out)][:10]
        assert places.tolist() == want.tolist() and scores.tolist() == every[want].tolist()


def brute(rows, top=10):
    def vector(x):
        if x is None or any(v is None or not np.isfinite(v) for v in x):
            return None
        return [int(np.floor(v * 1024)) for v in x]
    held = [(i, vector(x)) for i, x in rows if i is not None and vector(x) is not None]
    out = set()
    for q, v in {i: v for i, v in sorted(held, reverse=True)}.items():
        if q % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:top])}
    return out


def test_search_edges(spark):
    nan = float("nan")
    rows = [(0, [0.5, -0.25]), (100, [0.1, 0.2]), (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 0.0]),
            (5, [float("inf"), 1.0]), (6, []), (7, [0.5, -0.25, 3.0]), (8, [-0.0001, -1.0]), (None, [1.0, 1.0]), (200, None), (1, [0.5, -0.25])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    vectors = df.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    found = search_top(vectors, vectors.where("vec_id % 100 = 0")).collect()
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    assert {tuple(r) for r in found} == brute(rows)
    assert search_top(vectors.limit(0), vectors.limit(0)).count() == 0


def test_search_in_many_shards(spark, monkeypatch):
    import keelmark.llm.maxscore as module
    monkeypatch.setattr(module, "SHARD", 40)
    monkeypatch.setattr(module, "QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(501)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = df.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    found = search_top(vectors, vectors.where("vec_id % 100 = 0"))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in table_rows(sf_dir, "labels")}
    found = op4_quality(spark, sf_dir).collect()
    assert len(found) == len(table_rows(sf_dir, "documents"))
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in found if r["held_out"] and r["doc_id"] in label]
    y = np.array([label[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), y) > 0.9
    assert np.mean(np.array([r["predicted"] for r in held]) == y) > 0.9


def test_quality_edges(spark):
    docs = edge_frame(spark).withColumnRenamed("lang", "score")
    model = CompressionClassifier(b"the good text of the " * 20, b"!!! ### $$$ " * 20, 1.0, 5.0)
    found = score_quality(docs, model).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert {round(r["score"], 6) for r in found if not r["text"]} == {round(1 / (1 + np.exp(-1)), 6)}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7), (None, None)], "doc_id long, quality int")
    assert fit_quality(edge_frame(spark), labels) == 0.5
    ones = spark.createDataFrame([(6, 1), (6, 1), (99, 0)], "doc_id long, quality int")
    assert fit_quality(edge_frame(spark), ones) == 1.0
    assert {r["score"] for r in score_quality(docs, 1.0).collect()} == {1.0}
    both = spark.createDataFrame([(6, 1), (7, 1), (13, 0), (17, 0)], "doc_id long, quality int")
    assert isinstance(fit_quality(edge_frame(spark), both), CompressionClassifier)
    assert score_quality(docs.limit(0), model).count() == 0


def test_logistic_recovers_its_parameters():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    a, b = logistic(x, y)
    assert abs(a - 0.5) < 0.1 and abs(b - 2) < 0.1
