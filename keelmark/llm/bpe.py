"""Byte-level BPE by batched merge rounds in numpy."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import prepare, tidy
from keelmark.llm.words import in_chunks

# How texts are cut before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that the library itself encodes: they may compose, change their length in lower case, or hold a special token.
UNUSUAL = re.compile("[\u0130\u023a\u023e\u0250-\U0010ffff]|<[|]")
#: Kinds of characters: spaces between words, other white space, and what pieces are made of.
_BETWEEN, _BLANK, _LETTER, _NUMBER, _OTHER, _ODD = range(6)
#: Pieces whose ids a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
_NONE = np.int32(np.iinfo(np.int32).max)
_BESIDE = re.compile(r"\s(?:\s|\Z)")
_SPACE = re.compile(r" (?=\S)")


def byte_characters() -> dict[str, int]:
    """The printable character that a vocabulary writes for each byte, by the public rule: printable
    Latin-1 characters stand for themselves, the others for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in [*zip(plain, plain), *((b, 256 + i) for i, b in enumerate(rest))]}


class Merges:
    """The merges of a vocabulary file, as arrays over pairs of ids."""

    def __init__(self, model: dict, size: int):
        vocab, self.size = model["vocab"], size
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        # A merge comes after those that make its parts, so all places of a word's lowest pair can be merged in one round.
        made = {vocab[a + b]: n for n, (a, b) in reversed(list(enumerate(pairs)))}
        if any(made.get(vocab[x], -1) >= n for n, pair in enumerate(pairs) for x in pair):
            raise ValueError("a merge uses a token that only a later merge makes")
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # Pairs lie by a hash, so that a look-up reads one place, and a second one in few cases.
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        self.shift = np.uint64(61 - len(pairs).bit_length())
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        self.first = np.full(1 << (64 - int(self.shift)), len(pairs), dtype=np.int32)
        self.first[slot[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        self.keys, self.rank = np.append(keys[order], -1), np.append(order, _NONE).astype(np.int32)
        #: whether the next pair has the same slot
        self.more = np.append(slot[1:] == slot[:-1], [False, False])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``_NONE``; of equal pairs in the file the first counts."""
        key = left.astype(np.int64) * self.size + right
        at = self.first[self._slot(key)]
        hit = self.keys[at] == key
        rest = np.flatnonzero(~hit & self.more[at])
        while len(rest):
            at[rest] += 1
            hit[rest] = self.keys[at[rest]] == key[rest]
            rest = rest[~hit[rest] & self.more[at[rest]]]
        return np.where(hit, self.rank[at], _NONE)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). All words lie in one flat array; a round merges each word's lowest pair."""
        symbols, owner = symbols.astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(symbols), _NONE)
        if len(symbols):
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), _NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(starts, append=len(owner))
            live = np.repeat(lowest != _NONE, lengths)
            done.append((symbols[~live], owner[~live]))
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            places = np.flatnonzero(rank == np.repeat(lowest, np.where(lowest != _NONE, lengths, 0)))
            # Of overlapping places (a pair of two equal symbols) every second one counts, from the left.
            new = np.ones(len(places), dtype=bool)
            new[1:] = np.diff(places) != 1
            runs = np.flatnonzero(new)
            nth = np.arange(len(places)) - np.repeat(runs, np.diff(runs, append=len(places)))
            places = places[nth % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # Only pairs with a merged symbol have changed.
            places -= np.arange(len(places))
            changed = np.concatenate([places[places > 0] - 1, places])
            rank[changed] = _NONE
            changed = changed[changed < len(symbols) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        if not done:
            return symbols, np.zeros(len(sizes), dtype=np.int64)
        symbols, owner = (np.concatenate(x) for x in zip(*done))
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def apply(self, symbols: np.ndarray, sizes: np.ndarray, kind: np.dtype) -> list[bytes]:
        """Ids of every word, as numbers of a kind."""
        ids, counts = self.merge(symbols, sizes)
        data = ids.astype(kind).tobytes()
        ends = (np.cumsum(counts) * kind.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def read_model(path: str) -> tuple[dict, dict[str, int], int]:
    """(model, special tokens, number of ids) of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    return held["model"], special, max([*held["model"]["vocab"].values(), *special.values()]) + 1


class ByteBpe:
    """Encodes and decodes like the tokenizer of a file of the tokenizers library."""

    def __init__(self, path: str):
        model, self.special, self.size = read_model(path)
        letters, vocab = byte_characters(), model["vocab"]
        self.tokens = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.special:
                self.tokens[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.decimal = [b"%d" % i for i in range(self.size)]
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.merges = Merges(model, self.size)
        self.pretoken = regex.compile(PRETOKEN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.after_space: dict[str, bytes] = {}
        self.kind = np.dtype("<u2") if self.size <= 65_536 else np.dtype("<u4")

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of short stretches of text, each cut by the pattern and merged."""
        cut = list(map(self.pretoken.findall, texts))
        distinct = list(set().union(*cut))
        words = [w.encode() for w in distinct]
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ids = self.merges.apply(symbols, np.array(list(map(len, words)), dtype=np.int64), self.kind)
        known = dict(zip(distinct, ids))
        return [known[x[0]] if len(x) == 1 else b"".join([known[w] for w in x]) for x in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text.

        A text is cut before single spaces and line feeds that stand between other characters, where the pattern cuts in
        any case and looks no further; so each distinct piece needs to be merged once.
        """
        parts, whole = [], []
        for text in texts:
            split = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            whole.append(len(split))
            parts += split
        first, rest = [], []
        for part in parts:
            pieces = _SPACE.split(part) if _BESIDE.search(part) else part.replace("\n", " \n").split(" ")
            first.append(pieces[0])
            rest.append(pieces[1:])
        known = self.after_space
        missing = list(set().union(*rest).difference(known))
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = list(set().union(*rest))
        # a piece that starts with a line feed was cut before it, any other one before its space
        found = self._pieces([p if p[:1] == "\n" else " " + p for p in missing])
        known.update(zip(missing, found))
        starts = dict(zip(distinct := list(set(first)), self._pieces(distinct)))
        specials = {s: np.array([i], dtype=self.kind).tobytes() for s, i in self.special.items()}
        coded = [
            specials[a] if a in specials and not pieces else starts[a] + b"".join(map(known.__getitem__, pieces))
            for a, pieces in zip(first, rest)
        ]
        for p in missing:
            if len(p) > LONGEST:
                del known[p]
        out, at = [], 0
        for n in whole:
            out.append(np.frombuffer(b"".join(coded[at:at + n]), dtype=self.kind))
            at += n
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class WordBpe:
    """Ids of words as the tokenizers library gives them, for a file that marks word ends and drops white space.

    Words of plain letters (below U+0250, where nothing composes) are lower-cased, cut and merged here, many
    at a time; the library itself is asked for any others. The memory of pieces is bounded: it is emptied when it is full.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        model, self.special, size = read_model(path)
        end = model["end_of_word_suffix"]
        self.of_byte, self.of_last = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for c, b in byte_characters().items():
            self.of_byte[b], self.of_last[b] = model["vocab"][c], model["vocab"][c + end]
        self.merges = Merges(model, size)
        # Kind and lower case of each plain character; the last entry stands for all others.
        plain = [chr(c) for c in range(0x250)]
        self.kind = np.array([_kind(c) for c in plain] + [_ODD], dtype=np.uint8)
        self.lower = np.array([ord(c.lower()) if k != _ODD else ord(c) for c, k in zip(plain, self.kind)] + [0], dtype="<u4")
        self._forget()

    def _forget(self) -> None:
        """Number 0 is the empty piece."""
        self.numbers: dict[bytes, int] = {}
        self.sizes, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")

    def _library(self, words: list[str]) -> list[list[int]]:
        if words and self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]

    def _learn(self, pieces: list[bytes], some_odd: bool) -> np.ndarray:
        """Hold the ids of new pieces: their numbers."""
        odd = np.array([some_odd and UNUSUAL.search(x.decode()) is not None for x in pieces], dtype=bool)
        plain, asked = (list(compress(pieces, x)) for x in ((~odd).tolist(), odd.tolist()))
        sizes = np.array(list(map(len, plain)), dtype=np.int64)
        codes = np.frombuffer(b"".join(plain), dtype=np.uint8)
        symbols = self.of_byte[codes]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.of_last[codes[last]]
        ids, counts = self.merges.merge(symbols, sizes)
        found = self._library([x.decode() for x in asked])
        at = len(self.sizes)
        self.numbers.update(zip(plain + asked, range(at, at + len(pieces))))
        self.sizes = np.concatenate([self.sizes, counts, np.array(list(map(len, found)), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype("<u4"), *(np.array(x, dtype="<u4") for x in found)])
        return at + np.argsort(np.argsort(odd, kind="stable"), kind="stable")

    def _cut(self, text: str) -> tuple[np.ndarray, pa.DictionaryArray, bool]:
        """Place and bytes of every piece, and if there are odd ones: a word that the library is asked for is one, others are cut as
        ``WORD_PRETOKEN`` cuts their lower case."""
        codes = np.frombuffer((text + "\n" * 4).encode("utf-32-le"), dtype="<u4")
        kind, lowered = self.kind.take(codes, mode="clip"), self.lower.take(codes, mode="clip")
        if "<|" in text:
            special = np.flatnonzero(codes == ord("<"))
            kind[special[codes[special + 1] == ord("|")]] = _ODD
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            inside = np.diff(kind != _BETWEEN, prepend=False)
            edges = np.flatnonzero(inside)  # words begin and end in turn, as the last character is a space
            first = np.unique(np.searchsorted(edges, odd, side="right") - 1)
            marks = np.zeros(len(codes), dtype=np.int8)
            marks[edges[first]] = 1
            marks[edges[first + 1]] = -1
            whole = np.cumsum(marks, dtype=np.int8).astype(bool)
            kind[whole] = _ODD
            lowered = np.where(whole, codes, lowered)
        held = kind > _BLANK
        start = kind == _NUMBER
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        start &= held
        # An apostrophe that stands alone before certain letters makes a piece with them.
        quote = np.flatnonzero(lowered == ord("'"))
        quote = quote[start[quote] & (kind[quote] == _OTHER) & (kind[quote + 1] == _LETTER)]
        one, two = lowered[quote + 1], lowered[quote + 2]
        long = np.zeros(len(quote), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        short = np.isin(one, [ord(x) for x in "stmd"])
        start[quote[short | long] + 1] = False
        for after in (quote[short] + 2, quote[long] + 3):
            start[after] = kind[after] > _BLANK
        letters = lowered[held]
        widths = 1 + (letters >= 0x80).astype(np.int8)
        if len(odd):
            widths += (letters >= 0x800).astype(np.int8) + (letters >= 0x10000)
        ends = np.zeros(len(letters) + 1, dtype=np.int32)
        np.cumsum(widths, out=ends[1:])
        offsets = np.append(ends[:-1][start[held]], ends[-1])
        data = letters.tobytes().decode("utf-32-le").encode()
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return np.flatnonzero(start), pieces.dictionary_encode(), bool(len(odd))

    def encode_texts(self, texts: list[str], last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all texts in turn, each with ``last`` behind it, and where each text's end."""
        place, pieces, some_odd = self._cut("\n".join(texts))
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.numbers) > REMEMBERED or len(self.ids) > REMEMBERED * LONGEST:
            self._forget()
        # Pieces learned here get the numbers from now on in their order, so each is looked up once.
        number = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(number < 0)
        number[missing] = self._learn([distinct[i] for i in missing.tolist()], some_odd)
        number = number[pieces.indices.to_numpy()]
        stop = np.searchsorted(place, np.cumsum([len(x) + 1 for x in texts]))
        number = np.insert(number, stop, 0)
        at_end = stop + np.arange(len(texts))
        first = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[number]
        sizes[at_end] = last is not None
        ends = np.cumsum(sizes)
        # A text's last id is written over what is read for it.
        from_ = np.repeat(first[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.ids[from_] if len(self.ids) else np.zeros(len(from_), dtype="<u4")
        if last is not None:
            ids[ends[at_end] - 1] = last
        return ids, ends[at_end]

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit numbers, of texts that are given as lists of words."""
        ids, ends = self.encode_texts([b" ".join(x).decode() for x in texts])
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _kind(character: str) -> int:
    if character in " \t\n\v\f\r":
        return _BETWEEN
    if UNUSUAL.search(character):
        return _ODD
    for kind, pattern in ((_BLANK, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        if regex.match(pattern, character):
            return kind
    return _OTHER


def _coding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts, 1_000_000):
                ids = [pa.array(x.astype(np.int32)) for x in bpe.encode(texts[a:b])]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text; null counts as empty. Other columns are ignored.

    Texts never leave their task, and a task's memory of pieces is bounded.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _coding(path), f"doc_id {kind}, ids array<int>"
    )


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give an empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids alone, in one pass."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes, ids_digests, text_digests = [], [], []
            for a, b in in_chunks(texts, 1_000_000):
                for ids in bpe.encode(texts[a:b]):
                    ids = ids.tolist()
                    sizes.append(len(ids))
                    ids_digests.append(hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, ids))).hexdigest())
                    text_digests.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
