"""Mixing sources to target weights by Pareto order sampling.

Every source's target is a share of all words by weight; it stops at a limit of
repeats, and what is over goes to the others by weight. The whole times that a
source goes into its target are certain copies of all its documents. What is
still owed is drawn: a document's chance is in proportion to its size, so that
chances times sizes sum to the words owed, and documents whose chance would be
above one are certain too. The others are ranked by random odds divided by
inclusion odds, u/(1-u) : p/(1-p), and the first ones are taken until the words
owed are reached. The random number is a hash of id and text, so reruns agree.

The place where a source's ranking stops is found by sums per rank interval,
then per part of the interval in which it lies, so no source's rows meet in one
task however many it has.

Defined cases: null texts have no words and take none; a null source is a
source of its own, the last; sources without words get nothing; repeated rows
and rows without an id are each a document, equal ones with one random number;
ties in rank are settled by id and size; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.lineage import with_rank
from .common import count_words, cut, documents, with_row

STEPS = 4096
"""Rank intervals of a source, and parts of the interval in which its ranking stops."""


def source_targets(sizes: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, stopping at ``limit`` times a source's own.

    ``sizes`` holds (source, size) rows. Sources in order of code points, null
    last, weigh ``weights`` in turn.
    """
    sums = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = with_rank(sums, [F.col("source").isNull(), F.col("source")], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    src = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(limit)).alias("cap")))
    # level: words per unit of weight; what stopped sources leave raises it, until no other stops
    full, level, before = F.lit(False), 0.0, -1
    while True:
        s = src.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if s[3] == before or not s[2]:
            break
        before, level = s[3], (float(s[0]) - (s[1] or 0.0)) / s[2]
        full = F.col("cap") <= F.col("weight") * level
    return src.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def chances(sizes: DataFrame, owed: DataFrame) -> DataFrame:
    """(source, rate, sure): a document's chance is ``rate`` times its size, one at most, and ``sure`` words are certain.

    ``sizes`` counts (source, size, n), ``owed`` holds the words to draw by source. Each
    round takes what is certain out and raises the rate of the rest, until no other becomes certain.
    """
    s = cut(sizes.where("size > 0").join(owed.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).where("owed > 0").drop("_source"))
    words, squares = F.col("n") * F.col("size"), F.col("n") * F.col("size") * F.col("size")

    def solved(rows: DataFrame, certain) -> DataFrame:
        rest = F.sum(F.when(~certain, squares))
        sure = F.coalesce(F.sum(F.when(certain, words)), F.lit(0))
        return cut(rows.groupBy("source").agg(((F.first("owed") - sure) / rest).alias("rate"), sure.alias("sure"), F.count_if(certain).alias("held")))

    found = solved(s, F.lit(False))
    while True:
        with_rate = s.join(found.select(F.col("source").alias("_source"), "rate"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        again = solved(with_rate, F.coalesce(F.col("rate") * F.col("size") >= 1, F.lit(True)))
        grown = again.agg(F.sum("held")).first()[0] != found.agg(F.sum("held")).first()[0]
        found = again
        if not grown:
            return found.select("source", "rate", "sure")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, text: str = "text", source: str = "source",
        key: str = "doc_id", seed: int = 17, lot: Sequence[str] | None = None) -> DataFrame:
    """How often the mix takes every document: (key, size, source_size, target, copies, taken).

    ``lot`` names the columns that, with the text, make a document's random number; the key if none are given.
    """
    drawn = F.xxhash64(F.lit(seed), *[F.col(c) for c in (lot or [key])], F.xxhash64(F.coalesce(text, F.lit(""))))
    base = cut(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), drawn.alias("lot")))
    targets = source_targets(base.select("source", "size"), weights, limit)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut(targets.withColumn("whole", F.floor(times)).withColumn("owed", F.col("target") - F.col("whole") * F.col("source_size")))
    rates = chances(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), plan.select("source", "owed"))
    plan = plan.join(rates.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of").withColumnRenamed("source", "_source")
    rows = base.join(plan, base["source"].eqNullSafe(plan["_source"]), "left").drop("_source")
    # without a rate all that is owed is certain, or nothing is
    chance = F.when(F.col("size") > 0, F.coalesce(F.col("rate") * F.col("size"), (F.coalesce("sure", F.lit(0)) > 0).cast("double"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("chance", chance).withColumn("whole", F.col("whole") + (F.col("chance") >= 1).cast("int")).withColumn(
        "owed", F.col("owed") - F.coalesce("sure", F.lit(0)))
    rows = cut(rows.withColumn("rank", pareto_rank(F.col("lot"), F.col("chance"))).drop("rate", "sure", "lot"))
    return taken_first(rows).select(
        F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def pareto_rank(hashed: Column, chance: Column) -> Column:
    """Random odds over inclusion odds, folded to 0..1 by x/(1+x); null where nothing is owed."""
    u = (F.shiftrightunsigned(hashed, 12) + 0.5) / float(1 << 52)
    odds = u * (1 - chance) / ((1 - u) * chance)
    return F.when((chance > 0) & (chance < 1), odds / (1 + odds))


def taken_first(rows: DataFrame) -> DataFrame:
    """Add ``copies``: the whole ones, and one more for the first rows by rank until ``owed`` words are reached."""
    whole = F.col("whole").cast("long")
    spread = F.least(F.floor(F.col("rank") * STEPS), F.lit(STEPS - 1))
    fine = F.least(F.floor((F.col("rank") * STEPS - F.col("step")) * STEPS), F.lit(STEPS - 1))
    asked = rows.where("rank is not null").withColumn("step", spread)
    first = _stop(asked.groupBy("source", "step").agg(F.sum("size").alias("words"), F.first("owed").alias("owed")), "step", "stop")
    met = _beside(asked, first)
    inside = cut(met.where(F.col("step") == F.col("stop")).withColumn("part", fine).withColumn("owed", F.col("left")).drop("stop", "left"))
    second = _stop(inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("owed").alias("owed")), "part", "stop")
    near = _beside(inside, second)
    last = near.where(F.col("part") == F.col("stop"))
    w = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the row that crosses the mark is taken if that comes nearer to it
    last = last.withColumn("more", F.sum("size").over(w) - F.col("size") / 2 <= F.col("left"))
    names = [*rows.columns, "more"]
    return (
        rows.where("rank is null").withColumn("more", F.lit(False)).select(names)
        .unionByName(met.where(F.col("stop").isNull() | (F.col("step") != F.col("stop"))).withColumn("more", F.coalesce(F.col("step") < F.col("stop"), F.lit(True))).select(names))
        .unionByName(near.where(F.col("stop").isNull() | (F.col("part") != F.col("stop"))).withColumn("more", F.coalesce(F.col("part") < F.col("stop"), F.lit(True))).select(names))
        .unionByName(last.select(names))
        .withColumn("copies", F.coalesce(whole, F.lit(0)) + F.col("more").cast("long"))
    )


def _stop(sums: DataFrame, step: str, name: str) -> DataFrame:
    """Per source, the step in which its running words reach what is owed, and what is left to take there."""
    w = Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("_run", F.sum("words").over(w))
    return run.where("_run >= owed").groupBy(F.col("source").alias("_source")).agg(
        F.min(step).alias(name), F.min_by(F.col("owed") - (F.col("_run") - F.col("words")), step).alias("left"))


def _beside(rows: DataFrame, stops: DataFrame) -> DataFrame:
    return rows.join(stops, rows["source"].eqNullSafe(stops["_source"]), "left").drop("_source")


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as it has copies, all columns kept; rows count by a key of their own."""
    keyed, row = with_row(docs)
    copies = mix(keyed, key=row, lot=[key], **options).where("copies > 0").select(F.col(row).alias("_mix_row"), F.col("copies").alias("_mix_copies"))
    met = keyed.join(copies, keyed[row] == copies["_mix_row"])
    return met.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*[keyed[c] for c in docs.columns])


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Held against a sequential reckoning in tests."""
    return mix(documents(spark, sf))
