"""Exact deduplication by content hash, with DataFrame functions only.

Rows are grouped by a 128-bit hash of the text. Inside groups of several rows
the smallest and the largest text are taken; if the two agree byte for byte,
all do. A group in which they differ holds a collision and is grouped by the
text itself. Hot groups shrink to a row per task before the shuffle.

Defined cases: a null text counts as empty; of equal texts the row with the
largest (or smallest) id stays, and repeated rows of that id all say so; a row
without an id stays only if its whole group has none; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, documents, with_row, without


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", digest=None) -> DataFrame:
    """One row per row of ``docs`` with the id that stays, the group's size and whether the row is the one that stays.

    ``digest`` makes the 128-bit hash from a text column (for tests of collisions).
    """
    best = F.max if keep == "largest" else F.min
    digest = digest or (lambda c: F.unhex(F.md5(c)))
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("id"), whole.alias("text")).select("id", "text", digest(F.col("text").cast("binary")).alias("hash"))
    rows = cut(texts.select("id", "hash", F.sha2("text", 256).alias("text_sha256")))
    groups = cut(rows.groupBy("hash").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    # bytes are compared inside the groups; only their rows' texts are gathered, one or two per task and group
    ends = texts.join(groups.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    mixed = cut(ends.where(F.col("low") != F.col("high")).select("hash"))
    if mixed.isEmpty():
        out = _told(rows.join(groups, "hash", "left"))
    else:
        apart = texts.join(mixed, "hash", "left_semi")
        each = apart.groupBy("text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        named = apart.select("id", "text", F.sha2("text", 256).alias("text_sha256")).join(each, "text")
        out = _told(rows.join(mixed, "hash", "left_anti").join(groups, "hash", "left")).unionByName(_told(named))
    return out.withColumnRenamed("id", key)


def _told(df: DataFrame) -> DataFrame:
    alone = F.col("group_size").isNull()
    return df.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest") -> DataFrame:
    """One row of each text, all columns kept: the one with the largest (or smallest) id.

    Rows are told apart by a key of their own, so of rows with one id, or without any, one stays too.
    """
    keyed, row = with_row(docs)
    place = F.struct(F.col(key).isNotNull().alias("has"), F.col(key).alias("id"), (-F.col(row)).alias("row")) if keep == "largest" else F.struct(
        F.col(key).isNull().alias("lacks"), F.col(key).alias("id"), F.col(row).alias("row"))
    told = exact_dedup(keyed.select(F.col(text).alias("text"), place.alias("place")), "text", "place", keep)
    return without(keyed, told.where("not kept").select(F.abs("place.row").alias(row)), row).drop(row)


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(documents(spark, sf), keep="largest")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
