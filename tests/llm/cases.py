"""Small inputs with the awkward cases, shared by the tests of this folder."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = " ".join(f"w{i * 7 % 101}x{i}" for i in range(120))
    texts = [
        None, "", "   ", "\t\n", "one", "one two", base, base, base.replace(" ", "  "), base + " end",
        "start " + base, base.upper(), "Ünïcode ßtraße   nb space   em", "a" * 30_000,
        "long " * 20_000, "x y z w " * 50, "x y z w " * 49, "!!! ??? 123", "<|endoftext|> mid <|endoftext|>",
        "\x1c\x1d sep \x85 next", "é combining", "emoji 👩‍👩‍👧 𝒳 end ", "tail space \n\n", " \n lead",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append((6, base, None, None, None))  # a row that repeats an id and a text
    rows.append((900, base, "en", "s", 1))
    return rows


def edge_frame(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def table_rows(sf_dir: str, table: str) -> list[dict]:
    out = []
    for path in sorted(glob.glob(f"{sf_dir}/{table}.parquet")):
        out += pq.read_table(path).to_pylist()
    return out
