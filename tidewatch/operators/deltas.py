"""What changed between two runs' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def source_delta(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Fingerprints that are ``new`` or ``changed`` since the previous run.

    ``current`` holds fingerprint, body; ``previous`` fingerprint, content_hash.
    Removed sources are not reported; the first run (None) reports nothing.
    """
    now = current.select("fingerprint", F.sha1(F.coalesce("body", F.lit(""))).alias("content_hash")).distinct()
    if previous is None:
        return now.select("fingerprint", F.lit("new").alias("delta")).where(F.lit(False))
    old = previous.select("fingerprint", F.col("content_hash").alias("_old_hash"))
    new = now.select("fingerprint").distinct().join(old, "fingerprint", "left_anti").withColumn("delta", F.lit("new"))
    changed = (
        now.join(old, "fingerprint")
        .where(F.col("content_hash") != F.col("_old_hash"))
        .select("fingerprint").distinct()
        .withColumn("delta", F.lit("changed"))
    )
    return new.unionByName(changed)


def delta_counts(delta: DataFrame) -> DataFrame:
    """One row: new and changed sources."""
    return delta.agg(
        F.count_if(F.col("delta") == "new").alias("new_sources"),
        F.count_if(F.col("delta") == "changed").alias("changed_sources"),
    )
