import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from keelmark.llm import periodic as module
from keelmark.llm.periodic import Grammar, find_runs, periodic_runs
from keelmark.llm.queries import op13_periodic_runs
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows


def brute(x, min_length=24, min_exponent=3):
    """(start, length, period): every maximal stretch of every period, the smallest period of equal stretches."""
    out = {}
    for q in range(1, len(x) // min_exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, x):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not x:
        return x
    g, n = h // 10, len(x)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return x[:a] + [x[a + (i - a) % p] for i in range(a, n)]


def digests(doc_id, text):
    x = planted(doc_id, words(text))
    runs = brute(x)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(x) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_matches_brute_force(spark, sf_dir):
    want = {digests(r["doc_id"], r["text"]) for r in table_rows(sf_dir, "documents")}
    assert sum(r[1] > 0 for r in want) > 10
    assert {tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect()} == want


def test_query_on_edges(spark, tmp_path):
    rows = [r for r in edge_rows() if len(words(r[1])) < 2000]
    rows += [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, None, None, None) for i in range(100, 160)] + [(None, "x " * 30, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()))) == sorted(str(digests(*r[:2])) for r in rows)


@pytest.mark.parametrize("limits", [(24, 3), (6, 2), (2, 2), (10, 4)])
@pytest.mark.parametrize("candidates", [2_000_000, 7])
def test_runs_match_brute_force(monkeypatch, limits, candidates):
    monkeypatch.setattr(module, "CANDIDATES", candidates)
    rng = random.Random(3)
    for _ in range(60):
        sequences = []
        for _ in range(rng.randint(0, 4)):
            letters, x = rng.choice([1, 2, 3, 50]), []
            while len(x) < rng.randint(0, 150):
                part = [rng.randint(1, letters) for _ in range(rng.randint(1, 12))]
                x += (part * rng.choice([1, 1, 2, 3, 7]))[:rng.randint(1, 84)]
            sequences.append(np.array(x, dtype=np.int64))
        owner, start, length, period = (v.tolist() for v in find_runs(sequences, *limits))
        want = [(i, *r) for i, x in enumerate(sequences) for r in brute(x.tolist(), *limits)]
        assert list(zip(owner, start, length, period)) == want


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(5)
    x = np.concatenate([[0], np.tile(rng.integers(1, 3, 40), 6), [1] * 50, [2] * 49, [1] * 50, [0]])
    grammar = Grammar(x)
    a, b = np.sort(rng.choice(np.arange(1, len(x) - 1), (300, 2)), axis=1).T
    a, b = a[a < b], b[a < b]
    ahead, behind = grammar.forward(a, b), grammar.backward(a, b)
    for i, j, f, k in zip(a.tolist(), b.tolist(), ahead.tolist(), behind.tolist()):
        want = next(n for n in range(len(x)) if x[i + n] != x[j + n] or not x[j + n])
        assert f == want
        assert k == next(n for n in range(len(x)) if x[i - 1 - n] != x[j - 1 - n] or not x[i - 1 - n])


def test_edges(spark):
    found = periodic_runs(edge_frame(spark).repartition(3)).collect()
    assert len(found) == len(edge_rows())
    for r in found:
        x = words(r["row"]["text"])
        assert r["n_words"] == len(x)
        if len(x) < 2000:
            runs = brute(x)
            assert [tuple(y) for y in r["runs"]] == runs
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert r["kept_text"] == " ".join(w for i, w in enumerate(x) if i not in gone)
        else:
            assert ([tuple(y) for y in r["runs"]], r["kept_text"]) == ([(0, 20_000, 1)], "long")
    clashing = spark.createDataFrame([("x " * 24, 1)], "text string, runs long")
    assert [(r["row"]["runs"], r["kept_text"]) for r in periodic_runs(clashing).collect()] == [(1, "x")]
    assert periodic_runs(edge_frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs([], min_exponent=1)
