import re
import zlib
from collections import Counter

import pytest

from keelmark.llm import variants as module
from keelmark.llm.queries import op12_spelling_variants
from keelmark.llm.runtime import saved
from keelmark.llm.variants import letter_runs, near_words, spelling_variants
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows


def brute(counts: Counter, least_length=6, least_count=5, ratio=5):
    n = {w: k for w, k in counts.items() if w is not None and len(w) >= least_length and k >= least_count}
    letters, near, form = {c for w in n for c in w}, {}, {}
    for w in n:
        s = {w[:i] + w[i + 1:] for i in range(len(w))}
        for c in letters:
            s |= {w[:i] + c + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1)}
        near[w] = [v for v in s - {w} if v in n]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def slipped(doc_id, run):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
    return w if h % 199 else w[:h % len(w)] + w[h % len(w) + 1:]


def of_texts(rows):
    return Counter(slipped(i, run) for i, t in rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""))


def test_query_matches_brute_force(spark, sf_dir):
    want = brute(of_texts([(r["doc_id"], r["text"]) for r in table_rows(sf_dir, "documents")]))
    assert any(r[1] for r in want)
    assert {tuple(r) for r in op12_spelling_variants(spark, sf_dir).collect()} == want


def test_query_on_edges(spark, tmp_path):
    rows = edge_rows() + [(None, "Straße straßE strase " * 9, None, None, None), (77, "aaaaaa baaaaa aaaaaaa " * 40 + "ÀÉÎÕÜ×÷ÿ " * 6, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in op12_spelling_variants(spark, str(tmp_path)).collect()} == brute(of_texts([r[:2] for r in rows]))


@pytest.mark.parametrize("bucket", [1000, 3, 0])  # with 3 and 0 many or all words are looked up over all letters
def test_chains_ties_and_full_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(module, "BUCKET", bucket)
    counts = Counter({
        "abcdef": 1, "abcdeg": 5, "abcdhg": 25, "abcihg": 125, "abjihg": 700, "zzzzzz": 4, "zzzzzy": 20, "zzzzzx": 20, "zzzzzzz": 3,
        "aéioux": 2, "aeioux": 10, "short": 90, "日本語日本語": 3, "日本語日本": 15, "\U0001d4b3bcdefg": 1, "bcdefg": 9, None: 7,
    })
    rows = [(w, i) for w, k in counts.items() for i in range(k)]
    found = spelling_variants(spark.createDataFrame(rows, "word string, n long"), least_length=5, least_count=1)
    got = {tuple(r) for r in found.collect()}
    assert got == brute(counts, 5, 1)
    assert {r[0]: r[2] for r in got}["abcdef"] == "abjihg"


def test_long_words_and_empty_tables(spark):
    long = "ab" * 2_000
    rows = [(long,)] * 2 + [(long + "a",)] * 10 + [(long[1:],)] * 3
    got = {(len(r["word"]), r["form"] and len(r["form"]), r["n_near"]) for r in spelling_variants(spark.createDataFrame(rows, "word string"), least_count=1).collect()}
    assert got == {(4000, 4001, 2), (4001, None, 1), (3999, None, 1)}
    assert spelling_variants(spark.createDataFrame([], "word string")).count() == 0
    assert letter_runs(edge_frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], "word string"), ratio=1)


@pytest.mark.parametrize("bucket", [1000, 0])  # with 0 all words are looked up over all letters
def test_neighbourhoods_are_not_broadcast(spark, monkeypatch, bucket):
    monkeypatch.setattr(module, "BUCKET", bucket)
    words = saved(spark.createDataFrame([(i, f"abcdef{i}") for i in range(50)], "id long, word string"), "words")
    plan = near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key#" in plan
    assert not re.search(r"BroadcastHashJoin \[key#\w+\], \[key#\w+\], Inner|BroadcastHashJoin \[id#\w+\], \[id#\w+\], LeftSemi", plan)
