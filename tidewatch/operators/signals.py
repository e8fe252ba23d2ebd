"""Checks that signals and competitor notes rest on evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..plans.lineage import once


def cited(items: DataFrame, key: str) -> DataFrame:
    """Items with an ``evidence_ids`` array of texts or numbers, one row per numeric id."""
    ids = F.filter(F.transform("evidence_ids", lambda x: x.cast("string")), lambda x: x.rlike(r"^\d+$"))
    return items.select(key, F.explode(F.transform(ids, lambda x: x.cast("long"))).alias("source_id")).distinct()


def invalid_evidence(items: DataFrame, sources: DataFrame, key: str = "signal_id") -> DataFrame:
    """Cited ids that no source has."""
    return cited(items, key).join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def valid_evidence(items: DataFrame, sources: DataFrame, key: str = "signal_id") -> DataFrame:
    """Cited ids that a source has."""
    return cited(items, key).join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def cap_confidence(items: DataFrame, sources: DataFrame, key: str = "signal_id") -> DataFrame:
    """Items with evidence, their confidence at most that of their best source.

    ``evidence_ids`` is reduced to the valid ids, sorted.
    """
    best = (
        cited(items, key)
        .join(sources.select(F.col("id").alias("source_id"), F.col("confidence").alias("_c")), "source_id")
        .groupBy(key)
        .agg(F.max("_c").alias("_best"), F.array_sort(F.collect_set("source_id")).alias("_ids"))
    )
    own = F.coalesce(F.col("confidence").try_cast("double"), F.col("_best"))
    return (
        items.join(best, key)
        .withColumn("confidence", F.least(own, F.col("_best")))
        .withColumn("evidence_ids", F.col("_ids"))
        .drop("_best", "_ids")
    )


def mentioned(names: DataFrame, sources: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """Distinct ``name`` values whose normalised form occurs in some source text.

    Texts and names meet on words: a name of three words or more holds its inner
    words whole, so its longest inner word must be a word of the text. A shorter
    name may begin and end inside words; those that hold its longest word are
    looked up, by their letter triples, among the distinct words of all texts.
    Texts travel as hashes until a word has matched.
    """
    n = names.select(F.trim(name).alias("name")).where(F.col("name") != "").distinct()
    n = once(n, {"_n": T.normalise(F.col("name"))})
    words = F.split("_n", " ")
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2))
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    n = n.select("name", "_n", longest(inner).alias("_whole"), longest(words).alias("_part"))
    t = once(sources.select(text), {"_t": T.normalise(F.col(text))}).select("_t")
    t = once(t, {"_id": F.xxhash64("_t", F.length("_t"))})
    held = t.select("_id", F.explode(F.array_distinct(F.split("_t", " "))).alias("_word"))
    at = F.sequence(F.lit(1), F.length("_word"))
    cuts = lambda k: F.transform(at, lambda i: F.substring(F.col("_word"), i, F.lit(k)))
    grams = F.concat(cuts(1), cuts(2), cuts(3))
    vocabulary = held.select("_word").where("_word <> ''").distinct().select("_word", F.explode(F.array_distinct(grams)).alias("_gram"))
    part = n.where(F.col("_whole").isNull()).withColumn("_gram", F.substring("_part", 1, 3))
    inside = vocabulary.join(part, "_gram").where(F.contains("_word", F.col("_part"))).select("name", "_n", "_word")
    keys = n.where(F.col("_whole").isNotNull()).select("name", "_n", F.col("_whole").alias("_word")).unionByName(inside)
    near = held.join(keys, "_word").select("_id", "name", "_n").distinct()
    return t.join(near, "_id").where(F.contains("_t", F.col("_n"))).select("name").distinct()


def validate_competitors(notes: DataFrame, sources: DataFrame, key: str = "note_id") -> DataFrame:
    """Competitor notes (key, name, evidence_ids) that cite a source and whose name the sources mention."""
    proof = valid_evidence(notes, sources, key).groupBy(key).agg(F.array_sort(F.collect_set("source_id")).alias("_ids"))
    named = mentioned(notes, sources).withColumnRenamed("name", "_m")
    return (
        notes.withColumn("_m", F.trim("name")).join(named, "_m", "left_semi").join(proof, key)
        .withColumn("evidence_ids", F.col("_ids")).drop("_m", "_ids")
    )


def citations(items: DataFrame, sources: DataFrame, key: str = "signal_id") -> DataFrame:
    """Citation text of every item, its valid ids in the order given."""
    ids = F.transform("evidence_ids", lambda x: x.cast("string").try_cast("long"))
    long = items.select(key, F.posexplode(ids).alias("at", "source_id")).join(
        sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    mark = F.array_sort(F.collect_list(F.struct("at", "source_id")))
    return long.groupBy(key).agg(
        F.array_join(F.transform(mark, lambda m: F.concat(F.lit("[FONTE "), m["source_id"].cast("string"), F.lit("]"))), " ").alias("citation"))


def evidence_pack(sources: DataFrame, k: int = 36) -> DataFrame:
    """The best ``k`` sources with short texts, each also as one JSON document."""
    top = sources.orderBy(F.desc("score"), F.asc("id")).limit(k)
    text = F.coalesce(F.nullif(F.col("snippet"), F.lit("")), "body")
    doc = top.select(
        "id", T.truncate_words(F.col("title"), 180).alias("title"), "url", "category", F.col("published").alias("date"),
        "is_current", "scope", T.round_half_up(F.col("score"), 1).alias("score"),
        T.round_half_up(F.col("confidence"), 2).alias("confidence"), T.truncate_words(text, 650).alias("excerpt"),
    )
    return doc.withColumn("json", F.to_json(F.struct(*doc.columns)))


def package_verdict(items: DataFrame, sources: DataFrame, key: str = "signal_id") -> DataFrame:
    """One row: whether a package of signals holds, how many do, and its invalid ids."""
    bad = invalid_evidence(items, sources, key).select("source_id").distinct()
    good = valid_evidence(items, sources, key).select(key).distinct()
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).scalar().alias(n)
    one = sources.agg(F.countDistinct("id").alias("valid_ids")).select(
        count(good, "signals"), count(bad, "invalid_ids"), "valid_ids")
    return one.withColumn("valid", (F.col("invalid_ids") == 0) & (F.col("signals") > 0))
