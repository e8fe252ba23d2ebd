"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows, columns with the operators' own names."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size int, hash string, _slot int, n_tokens int, comp int, node int, kept boolean, _gone string"
WORDS = "the of and sun moon river stone tree cloud wind rain snow light dark green blue house road field hill".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefghij") for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source)"""
    long = prose(1, 30_000)
    near = prose(2, 200)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\r\n", "en", "a"), (4, "one", "en", "a"), (5, "One", None, "b"),
        (6, long, "en", "a"), (7, long, "en", "b"), (8, near, "en", "b"), (9, near.replace("suna", "sunz", 1), "en", None),
        (10, near.upper(), "en", "c"), (None, near, "en", "c"), (None, None, None, None), (11, "é ß 𝄞\x1cx  y　z", "de", "d"),
        (12, "<|startoftext|> it's <|endoftext|> á ͅ ΑΣ Σ", "el", "d"), (13, "12 34 !!", "en", "e"), (14, "tie tie", "en", "e"), (15, "tie tie", "en", "e"),
    ]
    rows += [(16, "again and again", "en", "e")] * 3
    return rows + [(100 + i, prose(100 + i, 60), "en", "abc"[i % 3]) for i in range(30)]


def edge_docs(spark: SparkSession) -> DataFrame:
    rows = [(i, t, la, s, len(t) if t else None, 0, 1, "x", 2, 3, 4, 5, True, "y") for i, t, la, s in texts()]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
