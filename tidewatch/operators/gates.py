"""Operational metrics, totals and the acceptance gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .diff import class_counts, item_totals

QUALITY = ("fp_generic", "fn_generic", "price_divergence", "unit_divergence", "duplicate", "unresolved", "name_improvement")
TOTALS = (
    "match_exact", "match_semantic", "name_improvement", "fp_legacy", "fn_legacy", "fp_generic", "fn_generic",
    "price_divergence", "unit_divergence", "duplicate", "unresolved",
)


def latency_summary(c: Column, prefix: str = "") -> list[Column]:
    """Interpolated percentiles and maximum of a latency, two decimals; 0 without data."""
    out = [F.coalesce(T.round_half_up(F.percentile(c, p / 100), 2), F.lit(0.0)).alias(f"{prefix}p{p}") for p in (50, 95, 99)]
    return out + [F.coalesce(T.round_half_up(F.max(c), 2), F.lit(0.0)).alias(f"{prefix}max")]


def ranked_percentiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, largest, percentiles): interpolated percentiles of ``value`` by rank, exact for any number of rows.

    Equal values are counted first, distinct ones are dealt by range and each
    partition adds up its counts; a wanted rank is then a look-up of the value at
    which the running count passes it. No task holds more than one range of values.
    """
    names = list(keys)
    tally = df.where(F.col(value).isNotNull()).groupBy(*names, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = [*names, "_v"]
    dealt = cut(tally.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*names, "_part").agg(F.sum("_n").alias("_sum"))
    # a row per partition and key
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in names], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*names, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("_inner", F.sum("_n").over(inside)).join(starts, same).withColumn("_upto", F.col("_start") + F.col("_inner"))
    totals = tally.groupBy(*names).agg(F.sum("_n").alias("n"), F.max("_v").alias("largest"))
    wanted = totals.select(*[F.col(k).alias(f"_t_{k}") for k in names], "n", "largest", *[((F.col("n") - 1) * float(p)).alias(f"_r{i}") for i, p in enumerate(shares)])
    on = F.lit(True)
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    met = run.join(F.broadcast(wanted), on) if not names else run.join(wanted, on)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = met.groupBy(*names).agg(
        F.first("n").alias("n"), F.first("largest").alias("largest"),
        *[x for i in range(len(shares)) for x in (F.first(f"_r{i}").alias(f"_r{i}"), at(F.floor(f"_r{i}")).alias(f"_lo{i}"), at(F.ceil(f"_r{i}")).alias(f"_hi{i}"))])
    between = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (F.col(f"_r{i}") - F.floor(f"_r{i}"))
    return found.select(*names, "n", "largest", F.array(*[between(i) for i in range(len(shares))]).alias("percentiles"))


def latencies(df: DataFrame, value: str, prefix: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles 50, 95 and 99 and the maximum of a latency per key, two decimals; one row of zeros without data and keys."""
    r = ranked_percentiles(df, value, [0.50, 0.95, 0.99], keys)
    two = lambda c: F.coalesce(T.round_half_up(c, 2), F.lit(0.0))
    names = [f"{prefix}{x}" for x in ("p50", "p95", "p99", "max")]
    if not keys:  # no data still gives a row
        r = r.agg(F.first("percentiles").alias("percentiles"), F.first("largest").alias("largest"))
    values = [F.col("percentiles")[i] for i in range(3)] + [F.col("largest")]
    return r.select(*keys, *[two(v).alias(n) for v, n in zip(values, names)])


def operational_summary(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row over the observation log: rows, documents, items, failures, quality sums, latency."""
    if run_id is not None:
        log = log.where(F.col("run_id") == run_id)
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    counts = log.agg(
        F.count(F.lit(1)).alias("records"), total("items").alias("items"), total("crashes").alias("crashes"), total("exceptions").alias("errors"),
        *[total(q).alias(q) for q in QUALITY])
    documents = log.where(F.nullif("document_hash", F.lit("")).isNotNull()).groupBy("document_hash").agg(F.lit(1).alias("one")).agg(F.count("one").alias("documents"))
    one = lambda df, c: df.select(c).scalar().alias(c)
    times = cut(latencies(log, "latency_ms"))
    return counts.select("records", one(documents, "documents"), "items", "crashes", "errors", *QUALITY, *[one(times, c) for c in ("p50", "p95", "p99", "max")])


def latest_observations(log: DataFrame) -> DataFrame:
    """The last observation of every document hash."""
    rest = [c for c in log.columns if c != "document_hash"]
    return log.groupBy("document_hash").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("document_hash", "r.*")


def gate_totals(comparison: DataFrame, old: DataFrame, new: DataFrame, timings: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """One row: documents, crashes, items, classes, rates and latencies of a whole run.

    ``timings`` has one row per document: doc_id, old_ms, new_ms, crashed;
    ``repeats`` the repeated items per document.
    """
    counts = class_counts(comparison).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS if c != "duplicate"])
    items = item_totals(old, new).agg(F.coalesce(F.sum("total_old"), F.lit(0)).alias("old_items"), F.coalesce(F.sum("total_new"), F.lit(0)).alias("new_items"))
    ran = F.when(~F.col("crashed"), F.lit(True))
    docs = timings.agg(F.count(F.lit(1)).alias("documents"), F.count_if("crashed").alias("crashes"))
    for side in ("old", "new"):
        times = cut(latencies(timings.withColumn("_ms", F.when(ran, F.col(f"{side}_ms"))), "_ms", f"{side}_"))
        docs = docs.select("*", *[times.select(c).scalar().alias(c) for c in times.columns])
    doubles = F.lit(0).alias("duplicate")
    if repeats is not None:
        doubles = repeats.agg(F.coalesce(F.sum("duplicate"), F.lit(0)).alias("d")).scalar().alias("duplicate")
    t = docs.select("*", doubles, *[counts.select(c).scalar().alias(c) for c in TOTALS if c != "duplicate"],
                    *[items.select(c).scalar().alias(c) for c in ("old_items", "new_items")])
    size = F.greatest(F.lit(1), "old_items", "new_items")
    return t.withColumn("matching_rate", (F.col("match_exact") + F.col("match_semantic") + F.col("name_improvement")) / size).withColumn(
        "unresolved_rate", F.col("unresolved") / size)


def gate_rows(totals: DataFrame, checks: DataFrame, max_p99_ms: float = 100.0, min_matching: float = 0.95, max_unresolved: float = 0.05) -> DataFrame:
    """The twelve gates as rows (gate, status, expected, actual); ``checks`` is the row that ``run_checks`` measured."""
    text = lambda c: c.cast("string")
    gate = lambda name, ok, expected, actual: F.struct(
        F.lit(name).alias("gate"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), F.lit(str(expected)).alias("expected"), text(actual).alias("actual"))
    none = lambda name, c: gate(name, F.col(c) == 0, 0, F.col(c))
    flag = lambda name, c, want: gate(name, F.coalesce(F.col(c) == want, F.lit(False)), str(want).lower(), F.col(c))
    rate = lambda c: T.round_half_up(F.col(c), 4)
    gates = [
        none("G1_crashes", "crashes"), none("G2_fp_generic", "fp_generic"), none("G3_fn_generic", "fn_generic"),
        none("G4_price_divergence", "price_divergence"), none("G5_unit_divergence", "unit_divergence"), none("G6_duplicate", "duplicate"),
        flag("G7_table_integrity", "tables_intact", True), flag("G8_legacy_regression", "prior_changed", False),
        gate("G9_generic_p99_latency", F.col("new_p99") < max_p99_ms, max_p99_ms, F.col("new_p99")),
        gate("G10_matching_rate", F.col("matching_rate") >= min_matching, min_matching, rate("matching_rate")),
        gate("G11_unresolved_rate", F.col("unresolved_rate") <= max_unresolved, max_unresolved, rate("unresolved_rate")),
        flag("G12_idempotency", "repeatable", True),
    ]
    t = totals.select("*", *[checks.select(c).scalar().alias(c) for c in ("tables_intact", "prior_changed", "repeatable")])
    return t.select(F.col("documents").alias("documents"), F.posexplode(F.array(*gates)).alias("gate_no", "g")).select(
        (F.col("gate_no") + 1).alias("gate_no"), "g.*", "documents")


def decide(gates: DataFrame, min_documents: int = 10) -> DataFrame:
    """One row: FAIL if a gate fails, INSUFFICIENT_DATA below ``min_documents``, else PASS."""
    failed = F.when(F.col("status") == "FAIL", F.struct("gate_no", "gate"))
    d = gates.agg(F.array_sort(F.collect_list(failed)).alias("f"), F.max("documents").alias("documents"))
    names = F.array_join(F.transform("f", lambda x: x["gate"]), ", ")
    return d.select(
        F.when(F.size("f") > 0, "FAIL").when(F.col("documents") < min_documents, "INSUFFICIENT_DATA").otherwise("PASS").alias("decision"),
        F.size("f").alias("failed_gates"), "documents",
        F.when(F.size("f") > 0, F.concat(F.lit("Falha nos seguintes gates: "), names))
        .when(F.col("documents") < min_documents, "Todos os gates aprovados, mas há menos documentos que o mínimo.")
        .otherwise("Todos os gates e o mínimo de documentos foram atendidos.").alias("reason"),
    )


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, low, high): how many rows a table has and two independent sums over their digests, in any order.

    A row's digest is the MD5 of its columns as text, by name, nulls told from texts; the
    sums take 48 bits of it each. As sums count repeats, tables of other multiplicities differ.
    """
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    digest = F.md5(F.concat_ws("\x1f", *cells))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("low"), part(13).alias("high"))


def digests(tables: dict[str, DataFrame], run_id: str = "") -> DataFrame:
    """(run_id, table, rows, low, high) of several tables, to be kept and compared later."""
    return reduce(DataFrame.unionByName, [table_digest(df).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("table"), "*") for name, df in tables.items()])


def changed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names of tables that differ between two sets of digests, or are in one of them only."""
    side = lambda df, tag: df.select("table", F.struct("rows", "low", "high").alias(tag))
    both = side(before, "a").join(side(after, "b"), "table", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("table")


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, in any order."""
    return changed_tables(digests({"t": a}), digests({"t": b.select(*a.columns)})).isEmpty()


def run_checks(job: Callable[[int], DataFrame], tables: Callable[[], dict[str, DataFrame]], prior: Callable[[], DataFrame],
               kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A job's result, and one row (tables_intact, prior_changed, repeatable) of what was measured around it.

    ``tables`` reads the tables that no run may change, before and after; ``job``
    runs twice, as its first and second execution, which may partition their input
    differently; ``prior`` is the prior extractor's result, held against the digest
    ``kept`` of an earlier run, or else against itself before the job.
    """
    before = cut(digests(tables()))
    earlier = kept if kept is not None else cut(digests({"prior": prior()}))
    result = cut(job(1))
    again = digests({"job": job(2).select(*result.columns)})
    after = digests(tables())
    count = lambda changed: changed.agg(F.count(F.lit(1)).alias("n")).scalar()
    return result, cut(result.sparkSession.range(1).select(
        (count(changed_tables(before, after)) == 0).alias("tables_intact"),
        (count(changed_tables(earlier, digests({"prior": prior()}))) > 0).alias("prior_changed"),
        (count(changed_tables(digests({"job": result}), again)) == 0).alias("repeatable")))
