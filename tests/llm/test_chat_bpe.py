import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelmark.llm.bpe import ByteBpe, decode_documents, encode_documents
from keelmark.llm.chat import conversation_digests, format_conversations, read_turns
from keelmark.llm.queries import op7_chat_format, op8_bpe
from keelmark.llm.sql import OP7
from tests.compare import connect, difference
from tests.llm.cases import edge_frame, edge_rows, table_rows

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_chat_matches_sql(spark, sf_dir):
    assert difference(op7_chat_format(spark, sf_dir), connect(sf_dir), OP7) is None


def test_chat_examples(spark):
    rows = [(1, 2, "assistant", "B<"), (1, 0, "system", "S"), (1, 1, "user", r"a\<says>"), (1, 3, "user", None),
            (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", "only"), (None, None, None, None),
            (3, 0, "assistant", "</turn>\n"), (3, 0, "assistant", "</turn>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    examples = format_conversations(df)
    got = sorted(map(tuple, examples.where("conv_id = 1").select("formatted", "loss_start", "loss_chars").collect()), key=lambda r: len(r[0]))
    head = "<turn>system<says>S</turn>\n<turn>user<says>a\\\\\\<says\\></turn>\n<turn>assistant<says>"
    first = head + "B\\<</turn>\n"
    second = first + "<turn>user<says></turn>\n<turn>assistant<says></turn>\n"
    assert got == [(first, len(head), 3), (second, len(second) - 8, 0), (second + "<turn>user<says>tail</turn>\n", None, 0)]
    turns = {r["conv_id"]: r["t"] for r in examples.groupBy("conv_id").agg(F.max_by(read_turns(F.col("formatted")), "example").alias("t")).collect()}
    assert [tuple(t) for t in turns[1]] == [("system", "S"), ("user", r"a\<says>"), ("assistant", "B<"), ("user", ""), ("assistant", ""), ("user", "tail")]
    assert [tuple(t) for t in turns[None]] == [("", "")]
    assert [tuple(t) for t in turns[3]] == [("assistant", "</turn>\n")] * 2
    digests = {r["conv_id"]: r for r in conversation_digests(examples).collect()}
    assert digests[3]["loss_chars"] == 16 and digests[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert conversation_digests(format_conversations(df.limit(0))).count() == 0


def test_chat_long_text(spark):
    text = "<\\>" * 100_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = conversation_digests(format_conversations(df)).first()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_turns"] == 2


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_matches_the_library_on_documents(spark, sf_dir, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in table_rows(sf_dir, "documents")}
    got = {r["doc_id"]: r for r in op8_bpe(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_matches_the_library_on_random_text(tokenizer):
    rng = random.Random(5)
    letters = [chr(c) for c in range(sys.maxunicode) if unicodedata.category(chr(c))[0] in "LNPSZM" and c < 0x3000]
    spaces = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "\x0b"]
    texts = ["", " ", "\n", "a", "aaaaaaaaaaa", "don't we'll I'VE", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>\n", "<|endof", "zz " * 50]
    for _ in range(1500):
        pieces = []
        for _ in range(rng.randrange(1, 12)):
            pieces.append(rng.choice(spaces) if rng.random() < 0.45 else "".join(
                rng.choice(letters if rng.random() < 0.3 else "abcdeABéß'12.,!?") for _ in range(rng.randrange(1, 8))))
            if rng.random() < 0.03:
                pieces.append("<|endoftext|>")
        texts.append("".join(pieces))
    bpe = ByteBpe(BYTE_BPE)
    for text, ids in zip(texts, bpe.encode(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert bpe.decode(ids.tolist()) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark, tokenizer):
    rows = {r[0]: r[1] for r in edge_rows()}
    encoded = encode_documents(edge_frame(spark).withColumnRenamed("lang", "ids"), BYTE_BPE)
    for r in encoded.collect():
        assert r["ids"] == tokenizer.encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids
    for r in decode_documents(encoded, BYTE_BPE).collect():
        assert r["text"] == (rows[r["doc_id"]] or "")
    assert encode_documents(edge_frame(spark).limit(0), BYTE_BPE).count() == 0


def test_bpe_memory_is_bounded(monkeypatch, tokenizer):
    import keelmark.llm.bpe as module
    monkeypatch.setattr(module, "REMEMBERED", 50)
    bpe = ByteBpe(BYTE_BPE)
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(40)) + " " + "y" * 200
        assert bpe.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(bpe.after_space) <= 50
