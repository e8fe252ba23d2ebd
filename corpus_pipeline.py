"""The corpus pipeline: documents go through the stages one after the other, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import common, exact_dedup, mixing, near_dup, pieces, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list let pass."""
    return quality.keep_good(docs, common.documents(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by five-word shingles and similarity 0.8."""
    return near_dup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every text's pieces."""
    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # learned rules, similarity and tokenizers are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    given = {f for t in (docs, common.documents(spark, sf_dir, "labels")) for f in t.inputFiles()}
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        written = common.cut(made)
        # what only this stage read is no longer needed; the given tables stay
        common.drop_cut(*[t for t in (made, docs) if not given.intersection(t.inputFiles())])
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
