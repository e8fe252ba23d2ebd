"""Token counts: batches encoded in Arrow functions that return lengths only.

Texts are dealt out in batches balanced by bytes. A text is split at safe
boundaries, the runs of ASCII white space: no token of the supported tokenizers
crosses them, because they are dropped before the merges, no composition or
case mapping reaches over them, and special strings hold none. So a text of any
length becomes short pieces, and a piece that returns is encoded once.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; other columns are not read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, map_texts

KNOWN_PIECES = 400_000
"""Lengths of so many distinct pieces are held by a task; then it starts anew."""
BATCH_BYTES = 1 << 16
"""Bytes of the pieces that go to the tokenizer in one call."""


def piece_counter(path: str):
    """A function that gives the token counts of a list of texts, for a tokenizer that drops white space before its merges."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[bytes, int] = {}

    def encode(new: list[bytes]) -> None:
        start = held = 0
        for i, piece in enumerate(new):
            held += len(piece)
            if held >= BATCH_BYTES or i == len(new) - 1:
                part = new[start:i + 1]
                known.update(zip(part, map(len, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False))))
                start, held = i + 1, 0

    def count(texts: list[str | None]) -> list[int]:
        if len(known) > KNOWN_PIECES:
            known.clear()
        split = [t.encode().split() if t else [] for t in texts]
        encode([w for w in {w for words in split for w in words} if w not in known])
        return [sum(map(known.__getitem__, words)) for words in split]

    return count


def whole_counter(path: str):
    """The same for a sentencepiece model, which keeps white space: texts are encoded whole."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(model.encode(t or "", num_threads=1)) for t in texts]


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text of ``docs``, and whether it has more than ``limit`` tokens."""
    counter = whole_counter if path.endswith(".model") else piece_counter

    def make():
        count = counter(path)
        return lambda texts: [count(texts)]

    sized = docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    return map_texts(sized, text, make, "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Held against whole encodings by the library in tests."""
    import public_tokenizers

    return token_counts(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
