"""Price change against the previous run, and the latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import top_by

SNAPSHOT_KEY = ["entity", "source_domain", "product_key"]


def latest_run(runs: DataFrame, before: str | None = None) -> DataFrame:
    """The run created last (optionally before run ``before`` was), as one row."""
    if before is not None:
        mark = runs.where(F.col("run_id") == before).select(F.col("created_at").alias("_mark"))
        runs = runs.join(F.broadcast(mark.limit(1)), F.col("created_at") < F.col("_mark")).drop("_mark")
    return runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def change_percent(before: Column, now: Column) -> Column:
    return (now - before) / before * 100


def price_changes(
    current: DataFrame,
    previous: DataFrame,
    min_change_pct: float = 0.5,
    limit: int | None = None,
) -> DataFrame:
    """Products whose price moved by ``min_change_pct`` or whose promotion flipped.

    Both tables hold entity, source_domain, product_key, product_name, price,
    promotion, url. ``previous`` has one row per key. With a ``limit`` the
    first changes in the order of ``pos`` (or of the key) are returned.
    """
    before = previous.select(
        *SNAPSHOT_KEY,
        F.col("price").alias("previous_price"),
        F.col("promotion").cast("boolean").alias("promotion_before"),
    ).where(F.col("previous_price").isNotNull() & (F.col("previous_price") != 0))
    now = current.where(F.col("price").isNotNull()).withColumn("promotion_now", F.coalesce(F.col("promotion").cast("boolean"), F.lit(False)))
    pct = change_percent(F.col("previous_price"), F.col("price"))
    out = now.join(before, SNAPSHOT_KEY).where(
        (F.abs(pct) >= min_change_pct) | (F.col("promotion_now") != F.col("promotion_before"))
    )
    order = ["pos"] if "pos" in current.columns else SNAPSHOT_KEY
    if limit is not None:
        out = out.orderBy(*order).limit(limit)
    return out.select(
        *SNAPSHOT_KEY, "product_name", "previous_price", F.col("price").alias("current_price"),
        F.round(pct, 2).alias("change_pct"), "promotion_before", "promotion_now", "url",
    )


def price_changes_by_run(snapshots: DataFrame, run: str = "run", min_change_pct: float = 0.5) -> DataFrame:
    """Changes of every run against the run just before it, over a whole history.

    ``run`` is an integer run number. A key missing from the previous run has no change.
    """
    before = snapshots.select(
        *SNAPSHOT_KEY, (F.col(run) + 1).alias(run),
        F.col("price").alias("previous_price"), F.col("promotion").alias("promotion_before"),
    ).where(F.col("previous_price").isNotNull() & (F.col("previous_price") != 0))
    pct = change_percent(F.col("previous_price"), F.col("price"))
    return (
        snapshots.where(F.col("price").isNotNull())
        .join(before, [*SNAPSHOT_KEY, run])
        .withColumn("change_pct", pct)
        .where((F.abs("change_pct") >= min_change_pct) | (F.col("promotion") != F.col("promotion_before")))
    )


def last_snapshot_per_key(snapshots: DataFrame, run: str = "run_id", order: str = "pos") -> DataFrame:
    """One row per key and run: the one written last."""
    return top_by(snapshots, [run, *SNAPSHOT_KEY], [F.desc(order)])
