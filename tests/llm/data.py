"""Small documents with every awkward case, and columns whose names operators might use."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, item long, words string, "
    "bucket string, shard int, _part int, n_words string, fp string, component_id string, score double, held_out string, base string"
)


def frame(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text, lang, source); the other columns are there to clash."""
    full = [(i, t, lang, src, len(t or ""), False, "r", 1, "w", "b", 3, 4, "n", "f", "c", 0.5, "h", "x") for i, t, lang, src in rows]
    return spark.createDataFrame(full, schema)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = [
    (None, "no id at all but some words here", "en", "src1"),
    (1, None, "en", None),
    (2, "", None, "src1"),
    (3, " \t\n\r\n ", "en", "src2"),
    (4, "one", "en", "src2"),
    (5, "a\u00a0b \u2003 c\u0085d Ünï çödé 漢字 \U0001f600", None, "src3"),
    (6, "same text again and again and again " * 3, "en", "src0"),
    (7, "same text again and again and again " * 3, "de", "src0"),
    (7, "same text again and again and again " * 3, "de", "src0"),
    (8, "x" * 200_000, "fr", "src0"),
    (9, " ".join(["long"] * 30_000), "fr", "src0"),
    (10, "\0 \x01 <|endoftext|> </s>[INST] [/INST] a@b.c 1.2.3.4", "es", "s\u0001"),
]
