"""Inputs beyond what one batch, shard, group or number was made for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
import keelmark.llm.passages as passages
from keelmark.llm import packing, quality
from keelmark.llm.language import fit_documents, fit_languages, identify_languages
from keelmark.llm.maxscore import quantised, search_top
from keelmark.llm.passages import Automaton, automata, remove_repeats
from keelmark.llm.simhash import first_of_similar
from keelmark.llm.words import Words
from tests.llm.cases import SCHEMA
from tests.llm.test_dedup import brute_components, brute_fingerprint
from tests.llm.test_passages import brute, found


def test_signs_that_are_no_letters(spark):
    learned = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat et la souris", "fr")] * 3, "text string, lang string")
    texts = ["½", "Ⅷ ③", "² 12 _", None, "½ le chat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(df, fit_languages(learned)).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "und", 4: "fr"}


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["the", "cat", "sat", "with", "house"]) for _ in range(30)), "en") for _ in range(20)]
    rows += [(" ".join(rng.choice(["le", "chat", "était", "maison", "avec"]) for _ in range(4000)), "fr") for _ in range(5)]
    parser = fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(parser.languages) == ["en", "fr"]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string")
    assert [r["lang_pred"] for r in identify_languages(df, parser).collect()] == [k for _, k in rows]


def test_a_label_of_long_texts_only_is_learned(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["clear", "prose", "about", "rivers", "and", "hills"]) for _ in range(5000)) for _ in range(12)]
    bad = [" ".join(rng.choice(["$$$", "click", "now", "win", "!!!", "free"]) for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good + bad))], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert min(scores[i] for i in range(12)) > max(scores[i] for i in range(12, 52))


def test_quality_scores_follow_from_the_two_dictionaries(spark):
    """Each score again, from plain zstandard calls."""
    import zstandard
    rng = random.Random(3)
    texts = [" ".join(rng.choice((["river", "hill", "stone"], ["win", "free", "$$$"])[i % 2]) for _ in range(rng.randrange(0, 400))) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int"))
    found_scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score_quality(docs, model).collect()}

    def size(block, content):
        return len(zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(content), level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress(block))
    for i, t in enumerate(texts):
        data = t.encode()
        less = sum(size(b, model.bad) - size(b, model.good) for b in quality.blocks(data)) / max(1, len(data))
        score = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * less, -30, 30)))
        assert found_scores[i] == (pytest.approx(score), int(found_scores[i][0] >= quality.THRESHOLD))


def test_large_components_take_part_or_are_refused(spark):
    def search(*vectors):
        df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        rows = df.select("vec_id", quantised(F.col("embedding")).alias("vector"))
        return [tuple(r) for r in search_top(rows, rows.where("vec_id = 0")).orderBy("rank").collect()]
    assert search([1.0, 0.0], [70000.0, 1.0], [5.0, 9.0]) == [(0, 1, 1, 70000 << 20), (0, 2, 2, 5 << 20)]
    assert search([1.0], [1_000_000.0]) == [(0, 1, 1, 1_000_000 << 20)]
    for huge in (1e9, 1e300):
        with pytest.raises(ValueError, match="do not fit"):
            search([1.0, 0.0], [huge, 1.0])
    assert search([1.0], [float("inf")], [float("nan")], [2.0]) == [(0, 1, 3, 2 << 20)]


def test_rows_that_share_an_id_all_lose_their_words(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_BYTES", 600)
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(55)]
    rows = [(0, " ".join(["u", *shared, "v"]))]
    for i in range(1, 13):
        rows += [(i, " ".join([f"a{rng.random()}", *shared, f"b{rng.random()}"])) for _ in range(4)]
        rows += [(i, " ".join(["same", *shared, "tail"]))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(remove_repeats(df))
    assert got == brute(rows)
    assert all(r[2] >= 55 for r in got if r[0])


def test_more_words_than_an_automaton_has_characters(monkeypatch):
    rng = random.Random(5)
    phrases = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([50, 60, 200]))] for _ in range(20)]
    text = sum((p[k:] for p in rng.sample(phrases, 6) for k in (0, 3)), [])
    whole = automata([" ".join(p).encode() for p in phrases], list(range(20)))
    assert len(whole) == 1
    want = whole[0].covered([w.encode() for w in text], 10)
    monkeypatch.setattr(passages, "SYMBOLS", 130)
    monkeypatch.setattr(passages, "PHRASE_WORDS", 60)
    several = automata([" ".join(p).encode() for p in phrases], list(range(20)))
    got = passages._covered(several, [w.encode() for w in text], 10)
    assert (got & want).sum() == want.sum()  # all that whole phrases cover
    assert isinstance(several[0], Automaton)
    monkeypatch.undo()
    many = [f"x{i}".encode() for i in range(1_200_000)]
    found_words = passages._covered(automata([b" ".join(many)], [1]), many, 2)
    assert found_words.all() and passages._covered(automata([b" ".join(many)], [2]), many, 2) is None


def test_places_are_counted_in_blocks(monkeypatch):
    rng = random.Random(6)
    words = Words([" ".join(f"w{rng.randrange(50)}" for _ in range(n)).encode() for n in (700, 49, 0, 400)])
    want = passages.segments(words)
    monkeypatch.setattr(passages, "_PLACE_BITS", 8)  # blocks of 128 windows
    got = passages.segments(words)
    assert all(np.array_equal(want[k], got[k]) for k in want)


def test_packing_of_null_ids_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    rows = [(None, 0, 1 + i % 4096, "g", 7, 8) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, group string, sequence_id long, offset long")
    got = packing.pack(df).collect()
    assert len(got) == 3000 and {r["group"] for r in got} == {"g"}
    sizes = {}
    for r in got:
        sizes.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sizes.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()] and sum(n for _, n in pieces) <= 4096
    assert len({s >> 32 for s in sizes}) == 30


def test_stages_keep_columns_with_their_own_names(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, uid long, print string, row string, id long, shard int"
    rows = [(i, t, "en", None, 3, "s", "p", i, "q", "r", -i, 5) for i, t in enumerate(["one text here", "another one", None, "12"])]
    docs = spark.createDataFrame(rows, names)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert sorted(tuple(r) for r in docs.collect()) == rows[:2]


def test_first_of_similar_matches_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(500)}" for _ in range(300)] for _ in range(6)]
    texts = {}
    for i in range(90):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            x[rng.randrange(300)] = "changed"
        texts[i] = " ".join(x)
    texts |= {200: None, 201: "", 202: " "}
    component = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA).repartition(5)
    assert {r["doc_id"] for r in first_of_similar(df).collect()} == {i for i in texts if component[i] == i}
    same = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z")], "doc_id long, text string")
    assert sorted(r["text"] for r in first_of_similar(same).collect()) == ["a b c", "x y z"]
    assert first_of_similar(df.limit(0)).count() == 0
    assert fit_documents(df.limit(0)).languages == []
