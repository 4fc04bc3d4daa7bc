import re
from collections import Counter

import numpy as np
import pytest

from keelmark.llm import repetition as module
from keelmark.llm.queries import op11_repetition
from keelmark.llm.repetition import NGRAM_LIMITS, repeated_windows, repetition
from keelmark.llm.sql import OP11
from tests.compare import connect, difference
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text):
    x = words(text)
    lines, seen, again, line_chars = [y for y in (text or "").split("\n") if words(y)], set(), 0, 0
    for y in lines:
        if y in seen:
            again += 1
            line_chars += len("".join(words(y)))
        seen.add(y)
    out = [len(x), sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), again, line_chars]
    windows = [tuple(x[i:i + 3]) for i in range(len(x) - 2)]
    counts = Counter(windows)
    out.append(len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}))
    for n in NGRAM_LIMITS:
        seen, covered = set(), set()
        for i in range(len(x) - n + 1):
            w = tuple(x[i:i + n])
            if w in seen:
                covered.update(range(i, i + n))
            seen.add(w)
        out.append(sum(len(x[i]) for i in covered))
    return tuple(out)


def measured(df):
    return [(r["row"], tuple(r)[1:]) for r in repetition(df).collect()]


def test_measures_of_the_table_match_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table_rows(sf_dir, "documents")}
    found = measured(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: x for r, x in found} == {i: brute(t) for i, t in texts.items()}


def test_query_matches_sql(spark, sf_dir):
    assert difference(op11_repetition(spark, sf_dir), connect(sf_dir), OP11) is None


def test_edges(spark):
    found = measured(edge_frame(spark).repartition(3))
    assert len(found) == len(edge_rows())
    for r, x in found:
        assert x == brute(r["text"])
    clashing = spark.createDataFrame([(None, "a\na\nb", 5), (None, None, 6)], "row long, text string, n_words long")
    assert {(r["n_words"], x[:5]) for r, x in measured(clashing)} == {(5, (3, 3, 0, 3, 1)), (6, (0, 0, 0, 0, 0))}
    assert repetition(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    """With hashes of two bits nearly all windows collide."""
    rng = np.random.default_rng(4)
    ids, text = rng.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    want = repeated_windows(ids, text, [3, 5, 8])
    monkeypatch.setattr(module, "mixed", lambda x: x & np.uint64(3))
    found = repeated_windows(ids, text, [3, 5, 8])
    for n in want:
        assert all(np.array_equal(a, b) for a, b in zip(want[n], found[n]))
    counts = Counter(tuple(ids[i:i + 3]) for i in range(48))
    assert set(want[3][0][want[3][0] < 48]) == {i for i in range(48) if counts[tuple(ids[i:i + 3])] > 1}


@pytest.mark.parametrize("text, kept", [
    (" ".join(f"w{i}" for i in range(60)), True),
    (" ".join(f"w{i % 30}" for i in range(60)), False),  # base rule
    (" ".join(f"w{i if i < 150 else i - 40}" for i in range(190)), False),  # n-grams: 40 of 190 words
    (" ".join(f"w{i if i < 150 else i - 20}" for i in range(170)), False),  # 20 of 170 words is more than 10 % in ten-grams
    (" ".join(f"w{i if i < 250 else i - 20}" for i in range(270)), True),
    ("\n".join([" ".join(f"w{i}" for i in range(80)), *["a refrain"] * 5]), True),
    ("\n".join([" ".join(f"w{i}" for i in range(80)), *["the refrain of all the lines"] * 5]), False),
])
def test_verdict(spark, tmp_path, text, kept):
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["kept"] for r in op11_repetition(spark, str(tmp_path)).collect()] == [kept]
