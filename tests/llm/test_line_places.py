import pytest

import keelmark.llm.fuzzy_lines as module
from keelmark.llm.fuzzy_lines import fuzzy_lines, line_places, without_repeated_lines

BASE = "a line of some length that many documents have in common, number"
ROWS = [(i, f"{BASE} {7 if i % 3 else 8}\n\nonly in {i * 7919} {i * i * 104729}\n  same \n{BASE} 7", i) for i in range(30)]


@pytest.mark.parametrize("copies", [1000, 4])  # with four, common lines are joined in shares
def test_every_line_has_a_decision(spark, monkeypatch, copies):
    monkeypatch.setattr(module, "COPIES", copies)
    monkeypatch.setattr(module, "SHARES", 50)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, part long").repartition(4)
    lines = {(i, n): x.strip() for i, t, _ in ROWS for n, x in enumerate(t.split("\n")) if x.strip()}
    places = line_places(docs).collect()
    assert sorted((r["doc_id"], r["line_no"]) for r in places) == sorted(lines)
    keep_of = {lines[r["doc_id"], r["line_no"]]: (r["keep_doc_id"], r["keep_line_no"]) for r in fuzzy_lines(docs).collect()}
    for r in places:
        keep = (r["keep_doc_id"], r["keep_line_no"])
        assert keep == keep_of[lines[r["doc_id"], r["line_no"]]] and r["kept"] == (keep == (r["doc_id"], r["line_no"]))
    kept = {(r["doc_id"], r["line_no"]) for r in places if r["kept"]}
    want = {(i, "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (i, n) in kept), p) for i, t, p in ROWS}
    assert {tuple(r) for r in without_repeated_lines(docs).collect()} == want


def test_same_or_no_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "abc\n\nabc"), (None, "abc"), (5, "x\n abc "), (5, "x\nabc"), (6, None)], "doc_id long, text string")
    assert sum(r["kept"] for r in line_places(docs).collect()) == 2  # one x, one abc
    left = sorted(((r["doc_id"] or 0, r["text"]) for r in without_repeated_lines(docs).collect()), key=str)
    assert [t for i, t in left if i == 0] == ["", ""] and (6, None) in left
    assert sorted(len((t or "").split()) for i, t in left if i == 5) == [0, 2]
    assert line_places(docs.limit(0)).count() == without_repeated_lines(docs.limit(0)).count() == 0
