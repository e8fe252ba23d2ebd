"""Helpers of the operators: texts through Arrow in bounded pieces, ranks without hot tasks, working tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.lineage import cut, drop_cut

PIECE_BYTES = 2 << 20
"""Texts are handed on in pieces of about this many bytes, so that a batch of long texts never lies decoded in memory at once."""


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes (one text at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], fields: str, keep_text: bool = False) -> DataFrame:
    """Replace ``text`` by the columns ``fields`` that the function made by ``make`` returns for a list of texts.

    ``make`` runs once per task, so models load there; the function gets a list
    of texts (None for null) and gives one list or Arrow array per field. The
    other columns pass through untouched.
    """
    made = T.StructType.fromDDL(fields)
    passed = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(passed + made.fields)
    names, arrow = [f.name for f in passed], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, text):
                out = work(piece.column(text).to_pylist())
                cols = [piece.column(n) for n in names] + list(out)
                yield pa.RecordBatch.from_arrays(
                    [(c if isinstance(c, pa.Array) else pa.array(c, f.type)).cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, text: str, beside: list[str], make: Callable[[], Callable[..., list]], fields: str) -> DataFrame:
    """Replace ``text`` and the columns ``beside`` by ``fields``; the function made by ``make`` gets a list per replaced column."""
    made = T.StructType.fromDDL(fields)
    passed = [f for f in df.schema.fields if f.name not in (text, *beside)]
    schema = T.StructType(passed + made.fields)
    names, arrow = [f.name for f in passed], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, text):
                out = work(*[piece.column(c).to_pylist() for c in (text, *beside)])
                cols = [piece.column(n) for n in names] + list(out)
                yield pa.RecordBatch.from_arrays(
                    [(c if isinstance(c, pa.Array) else pa.array(c, f.type)).cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs outside space and U+0009 to U+000D; splitting bytes parts at exactly these six."""
    return text.encode().split() if text else []


def count_words(text: Column) -> Column:
    """The same count as a column; null has no words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def least_hashed(rows: DataFrame, hashed: str, order: list[str], bound: int) -> DataFrame:
    """The ``bound`` rows with the smallest value of ``hashed``, a 64-bit hash; fewer only if its values crowd at the top.

    Rows that are surely beyond the bound are left out beforehand, so that every
    partition sends its share of the result and not ``bound`` rows.
    """
    share = 2 * bound / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.col(hashed) < int(share * 2.0**64 - 2.0**63))
    return rows.orderBy(hashed, *order).limit(bound)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the 0-based rank by ``order`` among the rows of equal ``keys``, for keys of any size.

    Rows are dealt by range, so a key that holds a third of all rows spreads
    over many tasks; what meets are the counts per partition and key.
    """
    cols = [F.col(k) for k in keys] + order
    placed = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_slot", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_slot", 33))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    runs = placed.groupBy("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumnRenamed("_part", "_p").drop("_n")
    on = F.col("_part") == F.col("_p")
    for c in same:
        on = on & c
    return placed.join(runs, on).withColumn(name, F.col("_before") + F.col("_slot") - F.col("_first")).drop(
        "_slot", "_part", "_p", "_first", "_before", *[f"_k{i}" for i in range(len(keys))])


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a key of its own for every row, and that key's name: ids may be missing or repeat."""
    name = f"_row_{uuid.uuid4().hex[:8]}"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is in ``gone``; rows without a key stay.

    The keys are written first: as their size is known then, Spark broadcasts them
    if they are below its threshold, and only otherwise deals the rows out by key.
    """
    name = f"_gone_{uuid.uuid4().hex[:8]}"
    out = cut(gone.select(F.col(key).alias(name)).distinct())
    return docs.join(out, docs[key] == out[name], "left_anti")


__all__ = ["count_words", "crc_mod", "cut", "documents", "drop_cut", "least_hashed", "map_rows", "map_texts", "pieces", "rank_within", "with_row", "without", "words_of"]
