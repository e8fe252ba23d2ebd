"""Product matching across competitors, and the price war that follows from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.similarity import jaccard, ratio_ceiling, sequence_ratio
from ..plans.lineage import cut, first_by, once

# Weights of the similarity of two products.
OVERLAP_WEIGHT, SEQUENCE_WEIGHT = 0.64, 0.24
SAME_BRAND, SAME_SKU = 0.14, 0.35
SAME_QUANTITY, OTHER_QUANTITY, OTHER_UNIT = 0.18, -0.18, -0.08
UNIT_KINDS = ("g", "ml", "un", "m2", "raw", "none")


def describe(items: DataFrame) -> DataFrame:
    """Items (name, brand, unit, sku, ...) with the reduced forms that similarity looks at."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = once(items, {
        "_name": T.product_name(F.col("name")), "_brand": T.normalise(blank("brand")), "_sku": T.normalise(blank("sku")), "_q": T.quantity(blank("unit")),
    })
    amount = F.bround(F.col("_q.amount"), 6)
    return d.withColumns({
        "_tokens": T.product_tokens(F.col("_name")), "_amount": amount, "_base": F.col("_q.base"),
        "_kind": F.when(amount.isNotNull(), F.col("_q.base")).when(blank("unit") != "", "raw").otherwise("none"),
    }).drop("_q")


def bonus(a: str, b: str) -> Column:
    """Brand, unit and code part of the similarity of two described items."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    measured = x("_amount").isNotNull() & y("_amount").isNotNull() & (x("_base") == y("_base"))
    unit = (
        F.when(measured & (F.abs(x("_amount") - y("_amount")) < 1e-6), SAME_QUANTITY)
        .when(measured, OTHER_QUANTITY)
        .when((x("_kind") != "none") & (y("_kind") != "none"), OTHER_UNIT)
        .otherwise(0.0)
    )
    same = lambda c, v: F.when((x(c) != "") & (x(c) == y(c)), v).otherwise(0.0)
    return same("_brand", SAME_BRAND) + unit + same("_sku", SAME_SKU)


def name_score(tokens_a: Column, tokens_b: Column, ratio: Column) -> Column:
    """Name part of the similarity."""
    both = (F.size(tokens_a) > 0) & (F.size(tokens_b) > 0)
    overlap = F.when(both, jaccard(tokens_a, tokens_b)).otherwise(ratio)
    return OVERLAP_WEIGHT * overlap + SEQUENCE_WEIGHT * ratio


def product_similarity(pairs: DataFrame) -> DataFrame:
    """Pairs of items (structs ``a`` and ``b`` of name, brand, unit, sku) with their ``similarity``."""
    fields = ["name", "brand", "unit", "sku"]
    forms = ["_name", "_tokens", "_brand", "_sku", "_amount", "_base", "_kind"]
    d = pairs
    for side in ("a", "b"):
        d = describe(d.withColumns({f: F.col(f"{side}.{f}") for f in fields}))
        d = d.drop(*fields).withColumnsRenamed({f: f"{side}{f}" for f in forms})
    d = d.withColumn("_ratio", sequence_ratio("a_name", "b_name"))
    score = name_score(F.col("a_tokens"), F.col("b_tokens"), F.col("_ratio")) + bonus("a", "b")
    return d.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).select(*pairs.columns, "similarity")


def shared_token_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of distinct names whose token overlap (shared over all) can reach ``least``.

    Two names of m and n words that overlap by j share at least
    j/(1+j)*(m+n) words. So short names meet on one shared word, all others
    on a shared pair of words, which keeps the groups behind common words small.
    """
    short = math.floor((1 + least) / least + 1e-9)

    def keys(side: DataFrame, tag: str) -> DataFrame:
        n = F.size("_tokens")
        words = F.array_sort("_tokens")
        singles = F.when(n < short, words).otherwise(F.array().cast("array<string>"))
        pairs = F.flatten(F.transform(
            words, lambda w, i: F.transform(F.slice(words, i + 2, F.greatest(n, F.lit(1))), lambda v: F.concat_ws(" ", w, v))))
        return side.select(F.col("_name").alias(tag), n.alias(f"n_{tag}"), F.explode(F.concat(singles, pairs)).alias("key"))

    hits = keys(left, "a").join(keys(right, "b"), "key")
    paired = F.contains("key", F.lit(" "))
    total = F.col("n_a") + F.col("n_b")
    return hits.where(F.when(paired, total > short).otherwise(total <= short)).select("a", "b").distinct()


def wordless_pairs(left: DataFrame, right: DataFrame, least_ratio: float) -> DataFrame:
    """Pairs with a name that has no telling word: they meet on a shared letter, lengths permitting."""
    def letters(side: DataFrame, tag: str) -> DataFrame:
        chars = F.array_distinct(F.filter(F.split("_name", ""), lambda c: (c != "") & (c != " ")))
        return side.select(F.col("_name").alias(tag), F.size("_tokens").alias(f"n_{tag}"), F.explode(chars).alias("key"))

    bare = lambda side: side.where(F.size("_tokens") == 0)
    near = ratio_ceiling(F.length("a"), F.length("b")) >= least_ratio
    one = letters(bare(left), "a").join(letters(right, "b"), "key").where(near)
    two = letters(left, "a").join(letters(bare(right), "b"), "key").where(near)
    return one.select("a", "b").unionByName(two.select("a", "b")).distinct()


def _class_keys(brand: Column, amount: Column, base: Column, kinds: Column, sku: Column) -> Column:
    """Attribute combinations under which an item can be the best match for a target."""
    measured = F.concat_ws("|", amount.cast("string"), base)
    exact = F.when(amount.isNotNull(), F.array(F.concat(F.lit("bq|"), brand, F.lit("|"), measured), F.concat(F.lit("q|"), measured)))
    loose = F.flatten(F.transform(kinds, lambda k: F.array(F.concat(F.lit("bk|"), brand, F.lit("|"), k), F.concat(F.lit("k|"), k))))
    plain = F.concat(F.coalesce(exact, F.array().cast("array<string>")), loose)
    coded = F.when(sku != "", F.transform(plain, lambda p: F.concat(F.lit("s|"), sku, F.lit("|"), p)))
    return F.concat(plain, F.coalesce(coded, F.array().cast("array<string>")))


def _with_bounds(brand: Column, amount: Column, base: Column, sku: Column) -> Column:
    """The same combinations for a target, each with the most that attributes can add there: array of (class, most)."""
    kinds = F.array(*[F.lit(k) for k in UNIT_KINDS])
    keys = _class_keys(brand, amount, base, kinds, sku)
    plain = lambda k: F.when(k.startswith("s|"), F.substring(k, F.length(sku) + 4, 1 << 20)).otherwise(k)
    branded = lambda k: F.when((brand != "") & plain(k).startswith("b"), SAME_BRAND).otherwise(0.0)
    exact = lambda k: F.when(plain(k).startswith("bq|") | plain(k).startswith("q|"), SAME_QUANTITY).otherwise(0.0)
    coded = lambda k: F.when(k.startswith("s|"), SAME_SKU).otherwise(0.0)
    return F.transform(keys, lambda k: F.struct(k.alias("class"), (branded(k) + exact(k) + coded(k)).alias("most")))


def admitted(items: DataFrame, least: float = 0.70, rules=None) -> DataFrame:
    """Items sure enough to be compared, from pages that are neither blocked nor about news or jobs.

    ``items`` holds name, url, page_type and price_confidence; an item without confidence counts as unsure.
    """
    from .pages import RULES, page_type

    kind = page_type(F.col("url"), F.coalesce("page_type", F.lit("")), F.col("name"), rules or RULES)
    return items.where(F.coalesce("price_confidence", F.lit(0.0)) >= least).where(~kind.isin("BLOCKED", "ARTICLE_OR_EMPLOYMENT"))


def match_products(
    targets: DataFrame,
    catalogue: DataFrame,
    min_similarity: float = 0.72,
    competitors: DataFrame | None = None,
) -> DataFrame:
    """Best item of every competitor for every target product, comparable or not.

    ``targets`` holds target_id, name, brand, unit, sku, price, old_price,
    promotion, url; ``catalogue`` competitor, pos and the same product columns.
    One row per target and competitor; ``competitors`` (competitor) names also
    those whose catalogue is empty, for which nothing is found. ``min_similarity``
    must exceed 0.56: below it names without a common word could match.

    Names are compared once per distinct pair. A competitor's items are reached
    through their attributes: for one name the score depends only on brand,
    quantity, unit kind and code, so the first item of each such class stands
    for all of it. Targets without a comparable item go on to names that share
    a word, and then, class by class, only where a name without one could still
    beat the best found.
    """
    slack = SAME_BRAND + SAME_QUANTITY
    least = (min_similarity - SEQUENCE_WEIGHT - slack) / OVERLAP_WEIGHT
    if least <= 0:
        raise ValueError("min_similarity must be above 0.56")
    attrs = ["_name", "_brand", "_amount", "_base", "_kind", "_sku"]
    payload = ["label", "price", "old_price", "promotion", "url"]
    t, c = cut(describe(targets)), cut(describe(catalogue).withColumnRenamed("name", "label"))

    t_names = t.select("_name", "_tokens").distinct()
    c_names = c.select("_name", "_tokens").distinct()
    by_words = shared_token_pairs(t_names, c_names, least)
    bare = wordless_pairs(t_names, c_names, (min_similarity - slack) / (OVERLAP_WEIGHT + SEQUENCE_WEIGHT))
    equal = t_names.select(F.col("_name").alias("a")).join(c_names.select(F.col("_name").alias("b")), F.col("a") == F.col("b"))
    coded = (
        t.where(F.col("_sku") != "").select(F.col("_name").alias("a"), "_sku").distinct()
        .join(c.where(F.col("_sku") != "").select(F.col("_name").alias("b"), "_sku").distinct(), "_sku")
        .select("a", "b", F.lit(SAME_SKU).alias("extra"))
    )
    pairs = by_words.unionByName(bare).unionByName(equal).withColumn("extra", F.lit(0.0)).unionByName(coded)
    pairs = (
        pairs.groupBy("a", "b").agg(F.max("extra").alias("extra"))
        .join(t_names.select(F.col("_name").alias("a"), F.col("_tokens").alias("ta")), "a")
        .join(c_names.select(F.col("_name").alias("b"), F.col("_tokens").alias("tb")), "b")
    )
    ceiling = name_score(F.col("ta"), F.col("tb"), ratio_ceiling(F.length("a"), F.length("b")))
    pairs = pairs.where(ceiling + slack + F.col("extra") >= min_similarity)
    pairs = pairs.withColumn("_ratio", sequence_ratio("a", "b")).withColumn(
        "base", name_score(F.col("ta"), F.col("tb"), F.col("_ratio"))
    ).where(F.col("base") + slack + F.col("extra") >= min_similarity).select("a", "b", "base")

    kind = F.array(F.col("_kind"))
    reps = c.select("competitor", "pos", "_tokens", *attrs, *payload, F.explode(_class_keys(
        F.col("_brand"), F.col("_amount"), F.col("_base"), kind, F.col("_sku"))).alias("class"))
    reps = first_by(reps, ["competitor", "_name", "class"], [F.col("pos")],
                    ["pos", "_tokens", "_brand", "_amount", "_base", "_kind", "_sku", *payload])
    reps = cut(reps.withColumnsRenamed({x: f"b{x}" for x in ["_tokens", *attrs]}).withColumnsRenamed({x: f"b_{x}" for x in payload}))
    wants = t.select(*attrs).distinct().select(*[F.col(x).alias(f"a{x}") for x in attrs])
    want, found = [f"a{x}" for x in attrs], ["similarity", "pos", *[f"b_{x}" for x in payload]]
    kinds = F.array(*[F.lit(k) for k in UNIT_KINDS])
    classes = _class_keys(F.col("a_brand"), F.col("a_amount"), F.col("a_base"), kinds, F.col("a_sku"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + bonus("a", "b")))
    pick = lambda scored: first_by(scored, [*want, "competitor"], [-F.col("similarity"), F.col("pos")], found)

    asked = wants.join(pairs, F.col("a_name") == F.col("a")).select(*want, "b", "base", F.explode(classes).alias("class"))
    scored = asked.join(reps, (F.col("b") == F.col("b_name")) & (asked["class"] == reps["class"]))
    best = cut(pick(scored.withColumn("similarity", score).where(F.col("similarity") >= min_similarity)))

    stocked = catalogue.agg(F.collect_set("competitor"))  # the watched companies: a configured list
    meets = [F.col(f"_{x}").eqNullSafe(F.col(x)) for x in want] + [F.col("competitor") == F.col("_competitor")]
    settled = best.select(*[F.col(x).alias(f"_{x}") for x in want], F.col("competitor").alias("_competitor"))
    still = cut(wants.withColumn("competitor", F.explode(stocked.scalar())).join(settled, meets, "left_anti"))
    names = still.select(F.col("a_name").alias("a")).distinct().join(t_names.select(F.col("_name").alias("a"), F.col("_tokens").alias("ta")), "a")

    # names that share a word
    words = names.select("a", "ta", F.explode("ta").alias("w")).join(c_names.select(F.col("_name").alias("b"), F.col("_tokens").alias("tb"), F.explode("_tokens").alias("w")), "w")
    near = words.drop("w").distinct().withColumn("_ratio", sequence_ratio("a", "b"))
    near = near.select("a", "b", name_score(F.col("ta"), F.col("tb"), F.col("_ratio")).alias("base"))
    asked = still.join(near, F.col("a_name") == F.col("a")).select(*want, F.col("competitor").alias("c"), "b", "base", F.explode(classes).alias("class"))
    scored = asked.join(reps, (F.col("b") == F.col("b_name")) & (F.col("c") == F.col("competitor")) & (asked["class"] == reps["class"]))
    worded = cut(pick(scored.withColumn("similarity", score)))

    # names that share none: what the sequence and the class's attributes can add must reach the best so far
    held = worded.select(*[F.col(x).alias(f"_{x}") for x in want], F.col("competitor").alias("_competitor"), F.col("similarity").alias("_best"))
    search = still.join(held, meets, "left").drop(*held.columns[:-1]).join(names, F.col("a_name") == F.col("a")).drop("a")
    search = search.withColumnRenamed("competitor", "c").withColumn("_best", F.coalesce("_best", F.lit(0.0))).select(
        "*", F.inline(_with_bounds(F.col("a_brand"), F.col("a_amount"), F.col("a_base"), F.col("a_sku"))))
    weight = F.when((F.size("ta") > 0) & (F.size("b_tokens") > 0), SEQUENCE_WEIGHT).otherwise(OVERLAP_WEIGHT + SEQUENCE_WEIGHT)
    has_bare = c_names.agg(F.bool_or(F.size("_tokens") == 0)).scalar()
    reach = F.when((F.size("ta") > 0) & ~F.coalesce(has_bare, F.lit(False)), SEQUENCE_WEIGHT).otherwise(OVERLAP_WEIGHT + SEQUENCE_WEIGHT)
    slim = 1e-9
    search = search.where(reach + F.col("most") >= F.col("_best") - slim)
    met = search.join(reps, (F.col("c") == F.col("competitor")) & (search["class"] == reps["class"])).drop(reps["class"])
    met = met.where(~F.arrays_overlap("ta", "b_tokens") & (
        weight * ratio_ceiling(F.length("a_name"), F.length("b_name")) + F.col("most") >= F.col("_best") - slim))
    met = cut(met)
    ratios = met.select(F.col("a_name").alias("_an"), F.col("b_name").alias("_bn")).distinct().withColumn("_ratio", sequence_ratio("_an", "_bn"))
    far = met.join(ratios, (F.col("a_name") == F.col("_an")) & (F.col("b_name") == F.col("_bn"))).withColumn("base", weight * F.col("_ratio"))
    far = pick(far.withColumn("similarity", score))
    best = best.unionByName(pick(worded.unionByName(far)))

    listed = stocked if competitors is None else competitors.agg(F.collect_set("competitor"))
    every = t.withColumn("competitor", F.explode(listed.scalar()))
    same = [every[x].eqNullSafe(best[f"a{x}"]) for x in attrs]
    joined = every.join(best, same + [every["competitor"] == best["competitor"]], "left").drop(best["competitor"])
    return classify_matches(joined, min_similarity)


def classify_matches(joined: DataFrame, min_similarity: float = 0.72) -> DataFrame:
    """Comparison rows of targets with their best item (b_* columns, similarity; null when the competitor has none)."""
    priced = (F.coalesce("price", F.lit(0.0)) != 0) & (F.coalesce("b_price", F.lit(0.0)) != 0)
    gap = F.when((F.col("similarity") >= min_similarity) & priced, T.round_half_up((F.col("b_price") - F.col("price")) / F.col("price") * 100, 2))
    d = joined.withColumn("_gap", gap).withColumn("_wild", F.abs("_gap") > 300)
    fine = F.col("_gap").isNotNull() & ~F.col("_wild")
    none = F.col("similarity").isNull()
    empty = F.lit("")
    return d.select(
        "target_id",
        F.col("name").alias("target_product"), F.col("brand"), F.col("unit"),
        F.col("price").alias("target_price"), F.col("old_price").alias("target_old_price"),
        F.col("promotion").alias("target_promotion"),
        "competitor",
        F.col("b_label").alias("competitor_product"),
        F.col("b_price").alias("competitor_price"), F.col("b_old_price").alias("competitor_old_price"),
        F.col("b_promotion").alias("competitor_promotion"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 3).alias("similarity"),
        F.when(fine, F.col("_gap")).alias("gap_percent"),
        F.when(fine & (F.col("b_price") < F.col("price")), "concorrente")
        .when(fine & (F.col("price") < F.col("b_price")), "alvo")
        .when(fine, "igual").when(none, "não encontrado").otherwise("não comparável").alias("cheaper"),
        F.when(fine & (F.col("similarity") >= 0.90), "confirmado").when(fine, "provavel")
        .when(F.col("_wild"), "revisao_necessaria").when(none, "nao_encontrado").otherwise("nao_comparavel").alias("match_class"),
        F.when(fine & (F.col("similarity") >= 0.88), "alta").when(fine, "media").otherwise("baixa").alias("match_confidence"),
        F.col("url").alias("target_url"), F.col("b_url").alias("competitor_url"),
        F.substring(F.sha1(T.normalise(F.concat_ws(
            "|", *[F.coalesce(c, empty) for c in ("brand", "name", "unit", "sku")]))), 1, 24).alias("canonical_product_id"),
    )


def price_war(comparisons: DataFrame) -> DataFrame:
    """Per competitor: how often who is cheaper, and mean, upper median and largest gap."""
    d = F.col("gap_percent")
    c = comparisons.where(d.isNotNull())
    return c.groupBy("competitor").agg(
        F.count(F.lit(1)).alias("comparable"),
        F.count_if(F.col("cheaper") == "concorrente").alias("competitor_cheaper"),
        F.count_if(F.col("cheaper") == "alvo").alias("target_cheaper"),
        F.count_if(F.col("cheaper") == "igual").alias("ties"),
        F.round(F.avg(d.cast("decimal(20,2)")), 2).cast("double").alias("mean_gap"),
        F.expr("-percentile_disc(0.5) within group (order by -gap_percent)").alias("median_gap"),
        F.max_by(d, F.struct(F.abs(d), d)).alias("largest_gap"),
    )


def rank_price_war(war: DataFrame) -> DataFrame:
    """Competitors, the most often cheaper first."""
    return war.orderBy(F.desc("competitor_cheaper"), F.desc(F.abs("mean_gap")), F.asc("competitor"))


def largest_gaps(comparisons: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` comparisons with the largest absolute gap."""
    keep = comparisons.where(F.col("gap_percent").isNotNull())
    return keep.orderBy(F.desc(F.abs("gap_percent")), F.asc("competitor"), F.asc("target_id")).limit(k)


def comparison_summary(comparisons: DataFrame) -> DataFrame:
    """One row over all comparisons, with the status of the run."""
    ok = F.col("gap_percent").isNotNull()
    flag = lambda c: F.count_if(F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    return comparisons.agg(
        F.countDistinct("target_id").alias("target_products"),
        F.count_if(ok).alias("comparable"),
        F.count_if(ok & (F.col("cheaper") == "alvo")).alias("target_cheaper"),
        F.count_if(ok & (F.col("cheaper") == "concorrente")).alias("competitor_cheaper"),
        flag("target_promotion").alias("target_promotions"),
        flag("competitor_promotion").alias("competitor_promotions"),
    ).withColumn("status", F.when(F.col("target_products") == 0, "sem_produtos_alvo")
                 .when(F.col("comparable") > 0, "ok").otherwise("sem_matches_confiaveis"))
