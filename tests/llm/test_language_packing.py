import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keelmark.llm.bpe import Merges, WordBpe
from keelmark.llm.language import (
    PIECE, CrossParser, fit_languages, identify_languages, language_of_documents, letters_only, suffix_automaton,
)
from keelmark.llm.packing import WINDOW, best_fit, pack, pack_documents
from keelmark.llm.queries import op5_language_id, op10_packing
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def greedy_phrases(text: bytes, sample: bytes) -> int:
    """Phrases by substring search: the brute-force version."""
    n = 0
    for at in range(0, len(text), PIECE):
        piece, i = text[at:at + PIECE], 0
        while i < len(piece):
            j = i + 1
            while j < len(piece) and piece[i:j + 1] in sample:
                j += 1
            i, n = j, n + 1
    return n


def test_automaton_has_exactly_the_substrings():
    table = suffix_automaton(bytes([1, 2, 1, 1, 2, 3]), 4)

    def accepts(x):
        state = 0
        for c in x:
            state = table[state, c]
            if not state:
                return False
        return True
    word = [1, 2, 1, 1, 2, 3]
    inside = {tuple(word[i:j]) for i in range(6) for j in range(i + 1, 7)}
    assert all(accepts(x) for x in inside)
    assert not accepts((2, 2)) and not accepts((3, 1)) and not accepts((1, 1, 1))


def test_phrases_match_brute_force():
    samples = {"a": b"the cat sat on the mat and the dog", "b": "le chat était là où".encode()}
    parser = CrossParser(samples)
    texts = [b"the cat", "là le thé".encode(), b"zzz", b"the mat and " * 200, b"q"]
    got = parser.phrases(texts)
    assert got.tolist() == [[greedy_phrases(t, samples[k]) for k in "ab"] for t in texts]


def test_languages_of_held_out_documents(spark, sf_dir):
    truth = {r["doc_id"]: r for r in table_rows(sf_dir, "documents")}
    found = op5_language_id(spark, sf_dir).collect()
    assert len(found) == len(truth)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in found if r["held_out"] and letters_only(truth[r["doc_id"]]["text"])]
    assert np.mean(right) > 0.95
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_held_out_rows_never_change_a_prediction(spark, sf_dir):
    rows = table_rows(sf_dir, "documents")[:120]
    shuffled = [dict(r, lang="xx" if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["lang"]) for r in rows]
    one, two = (
        {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_of_documents(
            spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in x], SCHEMA)).collect()}
        for x in (rows, shuffled)
    )
    assert one == two


def test_language_edges(spark):
    parser = CrossParser({"en": b"long one two start end tail lead", "fr": "ünïcode ßtraße".encode()})
    docs = edge_frame(spark).withColumnRenamed("source", "score")
    found = identify_languages(docs, parser).collect()
    assert len(found) == len(edge_rows())
    for r in found:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert {r["lang_pred"] for r in found if (r["text"] or "").startswith("long")} == {"en"}
    nothing = fit_languages(edge_frame(spark).limit(0))
    assert {tuple(r) for r in identify_languages(docs.select("text"), nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert identify_languages(docs.limit(0), parser).count() == 0


def expected_ids(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts, copies=1):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = expected_ids(text, tokenizer)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= WINDOW
    return sum(r["length"] for r in rows), len(by_sequence)


def test_packing_of_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table_rows(sf_dir, "documents")}
    used, windows = check_packing(op10_packing(spark, sf_dir).collect(), texts)
    assert windows <= -(-used // WINDOW) + 1


def test_packing_edges(spark):
    rows = {r[0]: r for r in edge_rows()}.values()
    check_packing(pack_documents(spark.createDataFrame(list(rows), SCHEMA), WORD_BPE).collect(), {r[0]: r[1] for r in rows})
    assert pack_documents(edge_frame(spark).limit(0), WORD_BPE).count() == 0
    nulls = spark.createDataFrame([(None, "a b", 1), (None, None, 2)], "doc_id long, text string, offset long")
    assert pack_documents(nulls, WORD_BPE).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_tightest(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(5, 60))
    lengths = rng.integers(1, window + 1, 300)
    number, offset = best_fit(lengths, window)
    room: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        fitting = [r for r in room.values() if r >= lengths[i]]
        w = int(number[i])
        assert room.get(w, window) == (min(fitting) if fitting else window) and (w in room) == bool(fitting)
        assert offset[i] == window - room.get(w, window)
        room[w] = room.get(w, window) - int(lengths[i])


def test_pack_keeps_other_columns(spark):
    pieces = spark.range(100).selectExpr("id AS doc_id", "0L AS start", "1 + id * 40 % 4096 AS length", "'x' AS note")
    rows = pack(pieces).collect()
    assert len(rows) == 100 and {r["note"] for r in rows} == {"x"}


def test_words_match_the_library():
    rng = random.Random(8)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    letters = [chr(c) for c in range(33, 0x3100) if unicodedata.category(chr(c))[0] in "LNPSM"]
    words = ["", "<|endoftext|>", "a<|startoftext|>b", "İ", "ΑΣ", "Σ", "don't'll", "é", "x\xa0y", "\x85", "12ab", "<|", "aaaa" * 40, "\x1c"]
    for _ in range(4000):
        words.append("".join(rng.choice(letters if rng.random() < 0.2 else "abcdeABÉßöñ'12.,!?#&") for _ in range(rng.randrange(1, 10))))
    bpe = WordBpe(WORD_BPE)
    for w, ids in zip(words, bpe.encode([[w.encode()] for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w


def test_whole_texts_match_the_library():
    rng = random.Random(9)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    parts = [" ", " ", "\n", "\t\r", "\xa0", "\x85", "\x1c", "\0", "'", "'s", "'LL", "''re", "!'d", "'t1", "don't", "Straße,", "ÀÉ", "12", "½", "İ", "Ⱥ", "ſ",
             "<|endoftext|>", "<", "|", "中文", "e\u0301", "\u0301", "😀", "“so”", "ΑΣ", "the", "aaaaaaa", "word"]
    texts = ["", " ", "\n", "x", "'", "'s", "中", *("".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000))]
    bpe = WordBpe(WORD_BPE)
    for a, b in ((0, 1), (1, 2), (0, 0), (2, 900), (900, len(texts))):
        ids, ends = bpe.encode_texts(texts[a:b], 2)
        assert len(ends) == b - a
        for text, start, end in zip(texts[a:b], [0, *ends], ends):
            assert ids[start:end].tolist() == expected_ids(text, tokenizer), text


def test_each_piece_is_merged_once(monkeypatch):
    """Words that differ in capitals or punctuation share their pieces, also in later batches."""
    merged, merge = [], Merges.merge
    monkeypatch.setattr(Merges, "merge", lambda self, symbols, sizes: merged.append(len(sizes)) or merge(self, symbols, sizes))
    bpe = WordBpe(WORD_BPE)
    words = [f"{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(500)]
    for form in ("{}", "{},", "({})", "{}.", "“{}”"):
        plain = [form.format(w).encode() for w in words]
        bpe.encode([plain, [w.upper() for w in plain]])
    assert sum(merged) == 500 + len({",", "(", ")", "."})
