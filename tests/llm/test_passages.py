import hashlib
import random
import re

import numpy as np
import pytest

from keelmark.llm.passages import WINDOW, Automaton, remove_repeats, segments, sliding_minimum
from keelmark.llm.queries import op1_substring_dedup
from keelmark.llm.words import Words
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """(id, words, removed, digest) of each row, by a dictionary of all windows."""
    words = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - WINDOW + 1):
            key = tuple(w[j:j + WINDOW])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1):
            if first[tuple(w[j:j + WINDOW])] < i:
                gone[j:j + WINDOW] = [True] * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 200)
    for width in (1, 2, 7, 43, 200):
        assert sliding_minimum(x, width).tolist() == [x[i:i + width].min() for i in range(200 - width + 1)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = [f"s{rng.randrange(40)}" for _ in range(90)]
    texts = [" ".join([f"a{i}x{rng.random()}" for i in range(k)] + shared + [f"b{rng.random()}"] * k) for k in (0, 3, 70)]
    words = Words([t.encode() for t in texts])
    found = segments(words)
    by_window = {}
    for a, t, s, n in zip(found["anchor"], found["text"], found["start"], found["size"]):
        w = texts[t].split()
        for j in range(s, s + n - WINDOW + 1):
            assert by_window.setdefault(tuple(w[j:j + WINDOW]), a) == a
    assert sum(found["size"] - WINDOW + 1) == sum(max(0, len(t.split()) - WINDOW + 1) for t in texts)


def test_automaton_counts_only_smaller_ids():
    a = Automaton([[b"a", b"b", b"c"], [b"b", b"c", b"d"]], [5, 9])
    assert a.covered(b"x a b c d".split(), 5) is None
    assert a.covered(b"x a b c d".split(), 6).tolist() == [False, True, True, True, False]
    assert a.covered(b"x a b c d".split(), 10).tolist() == [False, True, True, True, True]


def test_documents_match_brute_force(spark, sf_dir):
    want = brute([(r["doc_id"], r["text"]) for r in table_rows(sf_dir, "documents")])
    assert sum(r[2] for r in want) > 0
    assert sorted(tuple(r) for r in op1_substring_dedup(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_spliced_texts_match_brute_force(spark, seed, monkeypatch):
    import keelmark.llm.passages as module
    monkeypatch.setattr(module, "SHARD_BYTES", 20_000)
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(30 if k % 2 else 3000)}" for _ in range(400)] for k in range(6)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(1, 5)):
            b, s = rng.choice(base), rng.randrange(0, 350)
            text += b[s:s + rng.choice([20, 48, 49, 50, 51, 60, 75, 100, 200])]
            text += [f"u{rng.random()}"] * rng.randrange(0, 3)
        rows.append((i, " ".join(text), None, None, None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(remove_repeats(df)) == brute([r[:2] for r in rows])


def test_edges(spark):
    rows = [r[:2] for r in edge_rows()]
    assert found(remove_repeats(edge_frame(spark))) == brute(rows)
    assert remove_repeats(edge_frame(spark).limit(0)).count() == 0
    text = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(None, text, 1), (None, text, 2), (4, text, 3)], "doc_id long, text string, shard long")
    got = {r["row"]["shard"]: (r["n_removed"], r["kept_text"]) for r in remove_repeats(df).collect()}
    assert got == {1: (60, ""), 2: (60, ""), 3: (0, None)}
