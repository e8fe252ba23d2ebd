"""Lineage cuts, ranks over data of any size, and parallel greedy choices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares, which ``spark.checkpoint.dir`` names.

    Only a session on one machine may go without that setting; it then works in
    a folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Later reads agree with each other, survive lost executors, read only the
    columns they need and know the table's size.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores when a scan has fewer partitions than that; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) ``columns`` so that each is computed once per row.

    Filters and projections further up would otherwise be merged into their
    inputs and repeat a costly expression at every use. A generated row is a
    boundary that the optimizer does not merge through.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(*columns)
    return df.select(*[c for c in df.columns if c not in columns], made)


def with_rank(df: DataFrame, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """Add the 1-based rank by ``order`` (a total order), within ``keys`` if given.

    Rows are range-partitioned, so a hot key or the whole table spreads over
    all tasks; only one row count per partition is gathered.
    """
    cols = [F.col(k) for k in keys or []] + order
    ordered = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = cut(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33)
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition: a size set by configuration, not by data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local + 1)
        .drop("_part", "_start", "_slot")
    )
    if not keys:
        return out
    first = out.groupBy(*keys).agg(F.min(name).alias("_first"))
    return out.join(first, keys).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def numbered(df: DataFrame, order: list[Column], name: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number rows from 1 within a page; a page is a bounded key, so one shuffle by page serves all steps on it."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of every key; Spark limits each key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def first_by(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (ascending), by a map-side combined aggregate."""
    picked = F.min_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, "_p.*")


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``fold`` makes of every group's rows, given in ``order``.

    For many small groups: tasks take whole batches and hold one group at a time,
    which spares the cost of a frame per group.
    """
    names = [c.strip().split(" ")[0] for c in _top_level(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, out = [], None, []
        rows = (r for b in batches for r in b.to_dict("records"))
        for k, group in groupby(rows, key=lambda r: tuple(r[c] for c in keys)):
            if k != key and held:
                out += fold(held)
                held = []
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            key = k
            held += group
        if held:
            out += fold(held)
        yield pd.DataFrame(out, columns=names)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def _top_level(schema: str) -> list[str]:
    """The columns of a schema text, nested types kept whole."""
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def keep_first_of_each(df: DataFrame, rank: str, keys: list[str]) -> DataFrame:
    """Rows a scan by ``rank`` keeps when it skips any row sharing one of ``keys`` with a kept row.

    Every round keeps the rows that lead all their keys and drops the rows
    that share a key with them; what is left goes to the next round. The
    result is the scan's own, while each round is a handful of aggregates.
    """
    spark = df.sparkSession
    left, kept = cut(df), None
    while True:
        lead = left
        for i, k in enumerate(keys):
            best = left.groupBy(k).agg(F.min(rank).alias(f"_b{i}"))
            lead = lead.join(best, k)
        won = F.lit(True)
        for i in range(len(keys)):
            won = won & (F.col(rank) == F.col(f"_b{i}"))
        marked = cut(lead.withColumn("_won", won).drop(*[f"_b{i}" for i in range(len(keys))]))
        winners = marked.where("_won").drop("_won")
        kept = winners if kept is None else kept.unionByName(winners)
        rest = marked.where(~F.col("_won")).drop("_won")
        for k in keys:
            rest = rest.join(winners.select(k), k, "left_anti")
        left = cut(rest)
        if left.isEmpty():
            return kept
