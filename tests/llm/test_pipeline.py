import re

import corpus_pipeline as cp
from keelmark.llm.passages import WINDOW
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows
from tests.llm.test_dedup import brute_components, brute_fingerprint
from tests.llm.test_language_packing import check_packing

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def expected(rows):
    """Texts by id before packing, by brute force; ids are unique and not null."""
    texts = {i: t for i, t in sorted(rows) if any(c.isalpha() for c in t or "")}
    seen, single = set(), {}
    for i, t in texts.items():
        body = SPACES.sub(" ", t)
        if body not in seen:
            seen.add(body)
            single[i] = t
    component = brute_components({i: brute_fingerprint(t) for i, t in single.items()})
    near = {i: t for i, t in single.items() if component[i] == i}
    words = {i: [w for w in SPACES.split(t) if w] for i, t in near.items()}
    first = {}
    for i, w in words.items():
        for j in range(len(w) - WINDOW + 1):
            first.setdefault(tuple(w[j:j + WINDOW]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1):
            if first[tuple(w[j:j + WINDOW])] < i:
                gone[j:j + WINDOW] = [True] * WINDOW
        if not any(gone):
            out[i] = near[i]
        elif not all(gone):
            out[i] = " ".join(x for x, g in zip(w, gone) if not g)
    return out


def test_pipeline_matches_brute_force(spark, sf_dir):
    want = expected([(r["doc_id"], r["text"]) for r in table_rows(sf_dir, "documents")])
    assert len(want) < len(table_rows(sf_dir, "documents"))
    check_packing(cp.run(spark, sf_dir).collect(), want)


def before_packing(spark, docs):
    for _, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    return docs


def test_stages_on_edge_cases(spark):
    rows = {r[0]: r for r in edge_rows()}
    docs = spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in before_packing(spark, docs).collect()}
    want = expected([(i, r[1]) for i, r in rows.items()])
    assert {i: r["text"] for i, r in got.items()} == want
    for i, r in got.items():
        assert (r["lang"], r["source"]) == rows[i][2:4]
        assert r["n_chars"] == (rows[i][4] if r["text"] == rows[i][1] else len(r["text"]))


def test_stages_without_ids_and_without_rows(spark):
    docs = spark.createDataFrame([(None, "same words here", None, None, None), (None, "same  words here", "en", None, 3),
                                  (None, "another text", None, "s", None), (7, "same words here", None, None, None)], SCHEMA)
    got = sorted((r["doc_id"] is None, r["text"]) for r in before_packing(spark, docs).collect())
    assert got == [(False, "same words here"), (True, "another text")]
    empty = edge_frame(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0
