import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from keelmark.llm import golomb
from keelmark.llm.components import connected_components
from keelmark.llm.exact_dedup import exact_duplicates
from keelmark.llm.queries import op2_exact_dedup, op9_simhash
from keelmark.llm.simhash import hamming_links, near_duplicates
from tests.compare import connect, difference
from tests.llm.cases import edge_frame, edge_rows, table_rows


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for top, n in [(1 << 40, 5000), (100, 60), (1 << 20, 1), (1, 1)]:
        values = np.unique(rng.integers(0, top, n))
        assert np.array_equal(golomb.decode(golomb.encode(values)), values)
    assert len(golomb.decode(golomb.encode(np.empty(0, np.int64)))) == 0
    dense = np.unique(rng.integers(0, 1 << 40, 100_000))
    assert len(golomb.encode(dense)) < 4 * len(dense)  # 40 bits each would be 5 bytes


def test_exact_dedup_matches_sql(spark, sf_dir):
    from keelmark.llm.sql import OP2
    assert difference(op2_exact_dedup(spark, sf_dir), connect(sf_dir), OP2) is None


@pytest.mark.parametrize("bits", [40, 2])  # with two bits nearly every row is a suspect
def test_exact_dedup_edges(spark, bits):
    found = exact_duplicates(edge_frame(spark).repartition(5), bits=bits).collect()
    groups = defaultdict(list)
    for r in edge_rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    assert len(found) == len(edge_rows())
    kept = defaultdict(int)
    for r in found:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", r["row"]["text"] or "")
        assert r["keep_id"] == min(groups[body]) and r["group_size"] == len(groups[body])
        assert r["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()
        kept[body] += r["kept"]
    assert set(kept.values()) == {1}


def test_exact_dedup_null_ids_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (3, "a", 2), (None, "b", 3)], "doc_id long, text string, part long")
    found = {(r["row"]["part"]): (r["keep_id"], r["kept"]) for r in exact_duplicates(df).collect()}
    assert found == {1: (3, False), 2: (3, True), 3: (None, True)}
    assert exact_duplicates(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints: dict) -> dict:
    ids = sorted(prints)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    for n, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[n]) <= 4):
            a, b = find(i), find(ids[j])
            comp[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table_rows(sf_dir, "documents")}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = {(i, f"{prints[i]:016x}", c) for i, c in brute_components(prints).items()}
    assert {tuple(r) for r in op9_simhash(spark, sf_dir).collect()} == want


def test_simhash_edges(spark):
    found = near_duplicates(edge_frame(spark)).collect()
    assert len(found) == len(edge_rows())
    texts = {r[0]: r[1] for r in edge_rows()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(prints)
    assert {tuple(r) for r in found} == {(i, f"{prints[i]:016x}", comp[i]) for i in texts}
    assert near_duplicates(edge_frame(spark).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, 0), (None, "", 1), (5, "", 2)], "doc_id long, text string, print long")
    assert {r["component_id"] for r in near_duplicates(nulls).collect()} == {5}


def test_hamming_links_in_blocks(spark, monkeypatch):
    import keelmark.llm.simhash as module
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4, dtype=np.int64)
    values = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False))) for b in base for _ in range(150)}
    prints = dict(enumerate(sorted(values)))
    want = brute_components(prints)
    for block in (4096, 16):
        monkeypatch.setattr(module, "BLOCK", block)
        edges = hamming_links(spark.createDataFrame([(v,) for v in values], "print long"))
        found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
        lowest = {v: min(prints[j] for j in prints if want[j] == want[i]) for i, v in prints.items()}
        assert {v: found.get(v, v) for v in values} == lowest


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(500)] + [(1000, 1000)] + [(2000, 2000 + i) for i in range(300)]
    df = spark.createDataFrame(chain, "x long, y long").repartition(7)
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert found == {**{i: 0 for i in range(1, 501)}, **{2000 + i: 2000 for i in range(1, 300)}}
    assert connected_components(df.limit(0)).count() == 0


def test_texts_of_single_rows_are_not_shuffled(spark, sf_dir):
    """No exchange of the plan carries a row struct but those of suspects, also where nothing is broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.where("kept").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    single = plan[:plan.index("SortMergeJoin")]  # the first child of the union
    assert "ShuffledHashJoin" in single and "Bucketed: true" in single
    exchanges = [x for x in single.splitlines() if "Exchange" in x]
    assert len(exchanges) == 1 and "part" in exchanges[0]  # the marks
