"""Substring dedup: sharded automata of recurring passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import bucketed, give_back, prepare, saved, tidy
from keelmark.llm.words import Rolling, Words, in_chunks

#: Words of a window, and of the stretch inside it that names it.
WINDOW, ANCHOR = 50, 8
#: Bytes of text in a shard, and in a file of many shards.
SHARD_BYTES, FILE_BYTES = 3_000_000, 256_000_000
#: Files of one shard each, while there are no more of them.
SMALL_FILES = 20_000
LAST_ID = (1 << 63) - 1
_PLACE_BITS = 26
#: Distinct words of an automaton, which are characters to it, and words of a phrase in it.
SYMBOLS, PHRASE_WORDS = 1_000_000, 200_000


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours."""
    step, least = 1, values
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def segments(words: Words) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows that share their anchor.

    A window's anchor is the stretch of ``ANCHOR`` words in it with the least hash (the leftmost of
    equals), which depends on nothing but the window's words. So equal windows, wherever they start, have equal
    anchors, and a segment, the words of one run of windows, is found from about one anchor in 22 words.
    """
    n = len(words.start)
    none = {k: np.empty(0, np.int64) for k in ("anchor", "body", "text", "start", "size")}
    if n < WINDOW:
        return none
    rolling = Rolling(words.hashes())
    at = np.arange(n - ANCHOR + 1)
    anchors = rolling.of(at, at + ANCHOR)
    bits, width, block = np.uint64(_PLACE_BITS), WINDOW - ANCHOR + 1, 1 << (_PLACE_BITS - 1)
    chosen = []
    for a in range(0, n - WINDOW + 1, block):  # places are counted within a block, so that they fit their bits in the longest text
        part = anchors[a:a + block + width - 1]
        least = sliding_minimum(part >> bits << bits | np.arange(len(part), dtype=np.uint64), width)
        chosen.append((least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + a)
    chosen = np.concatenate(chosen)
    inside = words.text[:n - WINDOW + 1] == words.text[WINDOW - 1:]
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    last = np.ones(len(chosen), dtype=bool)
    last[:-1] = (chosen[1:] != chosen[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
    text = words.text[first]
    return {
        "anchor": anchors[chosen[first]].view(np.int64), "body": rolling.of(first, last + WINDOW).view(np.int64),
        "text": text, "start": first - words.first[text], "size": last + WINDOW - first,
    }


def _texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column("text"))
        for a, b in in_chunks(texts):
            found = segments(Words(texts[a:b]))
            rows = pa.array(found["text"] + a)
            yield pa.RecordBatch.from_arrays([
                pa.array(found["anchor"]), pa.array(found["body"]),
                *(batch.column(c).take(rows) for c in ("id", "uid", "shard")),
                pa.array(found["start"], pa.int32()), pa.array(found["size"], pa.int32()),
            ], names=["anchor", "body", "id", "uid", "shard", "start", "size"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct anchors."""
    for batch in batches:
        texts = _texts(batch.column("text"))
        for a, b in in_chunks(texts):
            found = segments(Words(texts[a:b]))
            pairs = np.unique(np.stack([found["text"], found["anchor"]]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[1]), batch.column("id").take(pa.array(pairs[0] + a))], names=["anchor", "id"]
            )


def _chosen_rows(docs: pa.Table, wanted: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(id, text, rows of ``wanted``) for each text of the shard that is wanted."""
    if not wanted.num_rows:
        return
    uids = wanted.column("uid").to_numpy()
    order = np.argsort(uids, kind="stable")
    distinct, starts = np.unique(uids[order], return_index=True)
    rows = dict(zip(distinct.tolist(), np.split(order, starts[1:])))
    for id_, uid, text in zip(docs.column("id").to_pylist(), docs.column("uid").to_pylist(), docs.column("text").cast(pa.binary())):
        if uid in rows:
            yield id_, text.as_py() or b"", rows[uid]


WINDOWS = "window long, id long, uid long, shard int, start int"


def _windows(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The windows of the wanted segments."""
    give_back()
    out = {k: [np.empty(0, np.int64)] for k in ("window", "id", "uid", "start")}
    starts, sizes, uids = (wanted.column(c).to_numpy() for c in ("start", "size", "uid"))
    for id_, text, rows in _chosen_rows(docs, wanted):
        counts = sizes[rows] - WINDOW + 1
        begin = np.repeat(starts[rows], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.unique(begin).astype(np.int64)
        out["window"].append(Rolling(Words([text]).hashes()).of(begin, begin + WINDOW).view(np.int64))
        out["start"].append(begin)
        out["id"].append(np.full(len(begin), id_))
        out["uid"].append(np.full(len(begin), uids[rows[0]]))
    columns = {k: np.concatenate(v) for k, v in out.items()}
    shard = docs.column("shard")[0].as_py() if docs.num_rows else 0
    return pa.table([
        pa.array(columns["window"]), pa.array(columns["id"]), pa.array(columns["uid"]),
        pa.array(np.full(len(columns["id"]), shard), pa.int32()), pa.array(columns["start"], pa.int32()),
    ], names=["window", "id", "uid", "shard", "start"])


def _phrases(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Texts of passages for the shards that need them.

    Wanted stretches that follow each other in both documents come as one passage.
    """
    shards, ids, phrases = [], [], []
    to, start, size = (wanted.column(c).to_numpy() for c in ("to", "start", "size"))
    shift = wanted.column("shift").fill_null(np.iinfo(np.int64).min).to_numpy()
    other = wanted.column("other").fill_null(-1).to_numpy()
    for id_, text, rows in _chosen_rows(docs, wanted):
        words = Words([text])
        rows = rows[np.lexsort((start[rows], shift[rows], other[rows], to[rows]))]
        # Windows come one by one and run on; segments (no shift) stand alone.
        joined = np.zeros(len(rows), dtype=bool)
        a, b = rows[:-1], rows[1:]
        joined[1:] = (other[b] >= 0) & (other[a] == other[b]) & (to[a] == to[b]) & (shift[a] == shift[b]) & (start[b] == start[a] + 1)
        firsts = np.flatnonzero(~joined)
        lasts = np.append(firsts[1:], len(rows)) - 1
        for i, j in zip(rows[firsts].tolist(), rows[lasts].tolist()):
            a, b = int(start[i]), int(start[j]) + int(size[j])
            shards.append(int(to[i]))
            ids.append(id_)
            phrases.append(b" ".join(words.data[words.start[a]:words.stop[b - 1]].split()))
    return pa.table([pa.array(shards, pa.int32()), pa.array(ids, pa.int64()), pa.array(phrases, pa.binary())],
                    names=["to", "first", "phrase"])


class Automaton:
    """Aho-Corasick over words: each distinct word of the phrases is one character."""

    def __init__(self, phrases: list[list[bytes]], firsts: list[int]):
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        lowest: dict[str, int] = {}
        for phrase, first in zip(phrases, firsts):
            key = "".join([self._symbol(w) for w in phrase])
            lowest[key] = min(first, lowest.get(key, first))
        self.found = ahocorasick.Automaton()
        for key, first in lowest.items():
            self.found.add_word(key, (len(key), first))
        if lowest:
            self.found.make_automaton()
        self.empty = not lowest

    def _symbol(self, word: bytes) -> str:
        symbol = self.symbols.get(word)
        if symbol is None:
            code = len(self.symbols) + 1
            symbol = self.symbols[word] = chr(code if code < 0xD800 else code + 0x800)  # leave out the surrogates
        return symbol

    def covered(self, words: list[bytes], id_: int) -> np.ndarray | None:
        """Which words lie in an occurrence of a phrase that a smaller id has."""
        if self.empty:
            return None
        symbols = self.symbols
        coded = "".join([symbols.get(w, "\0") for w in words])
        edges = None
        for end, (size, first) in self.found.iter(coded):
            if first < id_:
                if edges is None:
                    edges = np.zeros(len(words) + 1, dtype=np.int32)
                edges[end - size + 1] += 1
                edges[end + 1] -= 1
        return None if edges is None else np.cumsum(edges[:-1]) > 0


def automata(phrases: list[bytes], firsts: list[int]) -> list[Automaton]:
    """One automaton, or several where the phrases have more than ``SYMBOLS`` distinct words.

    A longer phrase than ``PHRASE_WORDS`` is cut into stretches that overlap in all but one word of a window, so each of its windows lies in one.
    """
    out, waiting, held = [], ([], []), set()
    for phrase, first in zip(phrases, firsts):
        words = phrase.split()
        for a in range(0, max(1, len(words) - WINDOW + 1), PHRASE_WORDS):
            part = words[a:a + PHRASE_WORDS + WINDOW - 1]
            new = held.union(part) if len(held) + len(part) > SYMBOLS else None
            if new and len(new) > SYMBOLS:
                out.append(Automaton(*waiting))
                waiting, held = ([], []), set()
            held.update(part)
            waiting[0].append(part)
            waiting[1].append(first)
    if waiting[0]:
        out.append(Automaton(*waiting))
    return out


def _covered(found: list[Automaton], words: list[bytes], id_: int) -> np.ndarray | None:
    parts = [c for c in (a.covered(words, id_) for a in found) if c is not None]
    return np.logical_or.reduce(parts) if parts else None


def _streaming(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """All documents of a shard through the automaton of the passages that it needs."""
    give_back()
    found = automata(phrases.column("phrase").to_pylist(), phrases.column("first").to_pylist())
    counts, removed, kept_texts, digests = [], [], [], []
    for id_, text in zip(docs.column("id").to_pylist(), docs.column("text").cast(pa.binary())):
        words = (text.as_py() or b"").split()
        covered = _covered(found, words, id_)
        kept = words if covered is None else [w for w, c in zip(words, covered.tolist()) if not c]
        body = b" ".join(kept)
        counts.append(len(words))
        removed.append(len(words) - len(kept))
        kept_texts.append(body if covered is not None else None)
        digests.append(hashlib.sha256(body).hexdigest())
    return pa.table([
        docs.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
        pa.array(kept_texts, pa.binary()).cast(pa.string()),
    ], names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (a struct of its columns), n_words, n_removed, kept_sha256, kept_text.

    Words are runs of other characters than the six ASCII spaces; null texts have none. A word is removed if a window
    of 50 words that covers it also starts in a document with a smaller id; windows are judged on
    the input. kept_text is the rest, joined by single spaces, and null where nothing was removed. Rows that share an
    id never remove each other's words, a null id counts as larger than all others.

    1. The texts are written once, bucketed by shard (about ``SHARD_BYTES`` each); later steps read them where they lie.
    2. Passages are confirmed: anchors in several documents lead to segments, whose words are hashed. Segments that
       several documents have are passages of the smallest. Where an anchor has different segments, their
       windows are compared too, one representative for each segment. All groups are counted or reduced by
       partial aggregates, so a passage of a third of the documents is one row per task.
    3. Each shard is sent the passages that its own documents need, cut from the document with the smallest id, each once per shard.
    4. Each shard compiles them into an automaton and streams all its documents through it. Only what the automaton finds, word by
       word, is removed.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    files = max(min(shards, SMALL_FILES), -(-size // FILE_BYTES))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = bucketed(
        docs.select(
            F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), row.alias("row"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
        )
        .repartition(files, "shard").withColumn("uid", F.monotonically_increasing_id()),
        "texts", files, "shard",
    )
    texts = rows.select("id", "uid", "shard", F.col(f"row.`{text_col}`").cast("string").alias("text"))

    anchors = texts.mapInArrow(tidy(_anchors), "anchor long, id long")
    recurring = saved(
        anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "anchors"
    )
    found = saved(
        texts.mapInArrow(tidy(_segments), "anchor long, body long, id long, uid long, shard int, start int, size int")
        .join(recurring, "anchor", "left_semi"),
        "segments",
    )
    first = F.min(F.struct("id", "uid", "shard", "start", "size")).alias("first")
    classes = saved(found.groupBy("anchor", "body").agg(
        first, F.max("id").alias("last"), (F.min("uid") < F.max("uid")).alias("shared")
    ), "classes")
    several = saved(classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    members = saved(
        found.join(classes.where("shared").select("anchor", "body", "first"), ["anchor", "body"])
        .where("id > first.id OR id = first.id AND uid <> first.uid")
        .select(F.col("shard").alias("to"), (F.col("id") > F.col("first.id")).alias("later"), "first").distinct(),
        "members",
    )
    by_segment = (
        members.where("later").select("to", "first.*")
        .withColumn("shift", F.lit(None).cast("long")).withColumn("other", F.lit(None).cast("long"))
    )
    unlike = classes.join(several, "anchor", "left_semi").select("first.*")
    windows = saved(
        texts.groupBy("shard").cogroup(unlike.groupBy("shard")).applyInArrow(_windows, WINDOWS), "windows"
    )
    lowest = saved(
        windows.groupBy("window").agg(F.min(F.struct("id", "uid", "shard", "start")).alias("first"), F.max("id").alias("last"))
        .where("last > first.id").select("window", "first"),
        "first-windows",
    )
    by_window = windows.join(lowest, "window").where("id > first.id").select(
        F.col("shard").alias("to"), "first.*", F.lit(WINDOW).alias("size"),
        (F.col("start") - F.col("first.start")).cast("long").alias("shift"), F.col("uid").alias("other"),
    )
    # Rows that share the representative's id and segment are sent what it is sent.
    twins = members.where("NOT later").select(F.col("to").alias("also"), F.col("first.uid").alias("other")).distinct()
    for_twins = by_window.join(twins, "other").withColumn("to", F.col("also")).drop("also")
    wanted = by_segment.unionByName(by_window).unionByName(for_twins)
    phrases = texts.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(
        _phrases, "to int, first long, phrase binary"
    )
    # The same passage may come from several segments; a shard takes it once.
    phrases = phrases.groupBy(F.col("to").alias("shard"), "phrase").agg(F.min("first").alias("first"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("shard", "id", "row", F.col(f"row.`{text_col}`").cast("string").alias("text")).groupBy("shard").cogroup(
        phrases.groupBy("shard")
    ).applyInArrow(_streaming, f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
