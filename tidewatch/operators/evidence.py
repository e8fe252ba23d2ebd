"""Raw search hits to clean, scored, deduplicated sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from ..plans.lineage import first_by, keep_first_of_each, once, with_rank
from ..rules import TRUSTED_DOMAINS, RadarProfile

SOURCE_COLUMNS = [
    "title", "url", "channel", "category", "body", "snippet", "published", "published_kind",
    "is_current", "is_direct", "score", "confidence", "company_alias", "city_ok", "state_ok",
    "scope", "fingerprint", "domain", "topics", "entity",
]

# Letters of title and text that a source takes over from its page.
TITLE_LETTERS, BODY_LETTERS = 320, 18000


def unite_channels(channels: list[DataFrame]) -> DataFrame:
    """All search channels as one table of hits; a column one lacks is null there."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def company_alias(text: Column, profile: RadarProfile) -> Column:
    """Longest alias standing as a term in normalised ``text``; else null."""
    names = {a.strip() for a in (profile.aliases or (profile.company,)) if a.strip()}
    parts = [p for p in T.normalise_literal(profile.company).split() if len(p) >= 4]
    if len(parts) >= 2:
        names.add(" ".join(parts))
    picks = [F.when(T.has_term(text, a), F.lit(a)) for a in sorted(names, key=lambda a: (-len(a), a))]
    return F.coalesce(*picks, F.lit(None).cast("string"))


def has_column_term(text: Column, term: Column) -> Column:
    """Like ``has_term`` with the term taken from a column; an empty term is absent."""
    word = T.normalise(term)
    return (word != "") & F.rlike(
        text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)"))
    )


def topics(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Tags whose words occur in normalised ``text``, in rule order."""
    tags = [F.when(T.contains_any(text, words), F.lit(tag)) for tag, words in rules.items()]
    return F.array_compact(F.array(*tags))


def base_scope(city: Column, state: Column, foreign: Column, corporate: Column) -> Column:
    """Reach of a text before the target is looked at."""
    return (
        F.when(foreign & ~(city | state), "global")
        .when(city, "local")
        .when(state, "nacional")
        .when(corporate, "corporativo")
        .otherwise("incerto")
    )


def source_score(profile: RadarProfile) -> Column:
    """Relevance of a source row."""
    weight = F.coalesce(
        *[F.when(F.col("domain").contains(d), F.lit(8 * w)) for d, w in profile.priority_domains.items()],
        F.lit(0.0),
    )
    undated = F.col("published") == ""
    return (
        F.when(F.coalesce(F.col("company_alias"), F.lit("")) != "", 34.0).otherwise(0.0)
        + F.when(F.col("city_ok"), 18).when(F.col("state_ok"), 8).otherwise(0)
        + F.when(F.col("is_current"), 18).when(undated, -8).otherwise(0)
        + F.when(F.col("is_direct"), 7).otherwise(0)
        + F.when(F.length("body") >= 1000, 5).otherwise(0)
        + F.when(F.col("scope") == "local", 6).when(F.col("scope") == "corporativo", 4).otherwise(0)
        + weight
        + F.least(F.lit(10), 2 * F.size("topics"))
    )


def classify_hits(hits: DataFrame, profile: RadarProfile) -> DataFrame:
    """Every hit with its source columns and ``reject_reason`` (null when admitted).

    ``hits`` holds pos, title, url, snippet, channel, published, category, target.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    market = F.lit(profile.market)
    h = once(hits, {
        "_title": text("title"), "_raw_url": text("url"), "url": U.normalise_url(text("url")),
        "snippet": text("snippet"), "target": text("target"),
    })
    h = once(h, {
        "_n": T.normalise(F.concat_ws("\n", "_title", "url", "snippet")), "domain": U.host(F.col("url")),
        "_given": T.parse_date(F.col("published")), "_link_date": U.date_in_url(F.col("_raw_url")),
    })
    is_market = F.col("target") == market
    named = (F.col("target") != "") & ~is_market
    grounds = [F.lit(T.normalise_literal(x).replace(" ", "")) for x in (profile.company, "grupo", "corporate") if x]
    squeezed = F.replace(T.normalise(F.col("target")), F.lit(" "), F.lit(""))
    corporate = (squeezed != "") & F.contains("domain", squeezed)
    for g in grounds:
        corporate = corporate | F.contains("domain", g)
    state = T.normalise_literal(profile.state)
    h = once(h.withColumns({"topics": topics(F.col("_n"), profile.topics), "_date": F.coalesce("_given", "_link_date")}), {
        "_alias": company_alias(F.col("_n"), profile),
        "_target_named": named & has_column_term(F.col("_n"), F.col("target")),
        "_corporate": corporate,
        "city_ok": T.has_term(F.col("_n"), profile.city),
        "state_ok": T.has_term(F.col("_n"), state),
        "_foreign": _any_term(F.col("_n"), profile.foreign_cities),
        "_homonym": T.contains_any(F.col("_n"), profile.homonyms),
    }).withColumns({
        "company_alias": F.coalesce("_alias", F.when(named, F.col("target"))),
        "_scope": base_scope(*[F.col(c) for c in ("city_ok", "state_ok", "_foreign", "_corporate")]),
    })
    rival = named & (F.col("target") != F.lit(profile.company)) & F.col("_target_named")
    outside = F.when(F.col("city_ok"), "local")
    scope = (
        F.when(is_market, outside.otherwise("mercado"))
        .when(rival, outside.otherwise("concorrente"))
        .otherwise(F.col("_scope"))
    )
    own = ~is_market & ~rival
    located = F.lit(bool(profile.city))
    reason = (
        F.when(F.col("url") == "", "no_url")
        .when(~is_market & F.col("_homonym"), "homonym")
        .when(F.col("_alias").isNull() & named & ~F.col("_target_named"), "entity_not_named")
        .when(F.col("company_alias").isNull() & ~is_market, "no_entity")
        .when(own & located & (F.col("_scope") == "global"), "foreign")
        .when(own & located & (F.col("_scope") == "incerto") & ~F.col("_corporate"), "uncertain_place")
        .when(F.year("_date") < profile.min_history_year, "too_old")
    )
    dated = F.col("_date").isNotNull()
    confidence = F.least(
        F.lit(1.0),
        F.lit(0.45)
        + F.when(F.col("company_alias").isNotNull(), 0.2).otherwise(0.0)
        + F.when(F.col("city_ok"), 0.15).otherwise(0.0)
        + F.when(F.col("state_ok"), 0.12).otherwise(0.0)
        + F.when(dated, 0.08).otherwise(0.0),
    )
    judged = h.withColumns({
        "reject_reason": reason,
        "title": F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("url")),
        "channel": F.coalesce("channel", F.lit("web")),
        "category": F.coalesce("category", F.lit("geral")),
        "body": F.col("snippet"),
        "published": F.coalesce(F.date_format("_date", "yyyy-MM-dd"), F.lit("")),
        "published_kind": F.when(F.col("_given").isNotNull(), "publicada").when(dated, "url").otherwise("desconhecida"),
        "is_current": F.coalesce(F.year("_date") >= profile.min_current_year, F.lit(False)),
        "is_direct": F.lit(False),
        "scope": scope,
        "fingerprint": F.sha1(T.normalise(F.concat_ws(" ", "_title", F.substring("snippet", 1, 2400), "url"))),
        "entity": F.coalesce(F.nullif(F.col("target"), F.lit("")), "company_alias", market),
        "confidence": confidence,
    })
    return judged.withColumn("score", source_score(profile)).select("pos", *SOURCE_COLUMNS, "reject_reason")


def _any_term(text: Column, words) -> Column:
    words = [T.normalise_literal(w) for w in words]
    if not words:
        return F.lit(False)
    return text.rlike(r"(?U)(?<!\w)(?:" + "|".join(T.quote(w) for w in words) + r")(?!\w)")


def admit(classified: DataFrame) -> DataFrame:
    """Admitted hits as source rows."""
    return classified.where(F.col("reject_reason").isNull()).drop("reject_reason")


def deduplicate(sources: DataFrame) -> DataFrame:
    """Best-scored source of every URL and of every fingerprint, with dense ids by score.

    Same choice as a scan by falling score that skips any URL or fingerprint already kept.
    """
    rest = [c for c in sources.columns if c not in ("url", "fingerprint")]
    order = [-F.col("score"), F.col("pos")]
    best = first_by(sources, ["url", "fingerprint"], order, rest)
    ranked = best.withColumn("_order", F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p")))
    kept = keep_first_of_each(ranked, "_order", ["url", "fingerprint"]).drop("_order")
    return with_rank(kept, [F.desc("score"), F.asc("pos")], "id")


def renumber(sources: DataFrame) -> DataFrame:
    """Fresh dense ids by falling score, ties in the order of the old ids."""
    old = sources.withColumnRenamed("id", "_old")
    return with_rank(old, [F.desc("score"), F.asc("_old")], "id").drop("_old")


def source_quality(s: DataFrame) -> Column:
    """Reliability and completeness of a source, 0..1."""
    alias = (F.coalesce("company_alias", F.lit("")) != "") | (F.coalesce("entity", F.lit("")) != "")
    return F.least(
        F.lit(1.0),
        F.lit(0.30)
        + F.when(alias, 0.15).otherwise(0.0)
        + F.when(F.col("city_ok"), 0.15).when(F.col("state_ok"), 0.06).otherwise(0.0)
        + F.when(F.col("is_direct"), 0.10).otherwise(0.0)
        + F.when(F.coalesce("published", F.lit("")) != "", 0.10).otherwise(0.0)
        + F.when(F.col("domain").isin(*TRUSTED_DOMAINS), 0.10).otherwise(0.0)
        + F.when(F.col("scope") == "local", 0.08).otherwise(0.0),
    )


def recency(published: Column, as_of: str) -> Column:
    """Weight of a publication date as seen on ``as_of``; undated 0.35."""
    age = F.datediff(F.lit(as_of).cast("date"), T.parse_date(published))
    return (
        F.when(age.isNull(), 0.35)
        .when(age <= 7, 1.0)
        .when(age <= 30, 0.88)
        .when(age <= 90, 0.72)
        .when(age <= 180, 0.52)
        .otherwise(0.30)
    )


def enrich(
    sources: DataFrame,
    pages: DataFrame,
    profile: RadarProfile,
    top: int | None = None,
    keep: int | None = None,
) -> DataFrame:
    """Sources with the text of their landed pages, judged anew and renumbered.

    ``pages`` holds url, title, body, published, final_url. Only the ``top``
    sources are enriched and the best ``keep`` returned; None lifts a limit.
    Fingerprint and confidence stay those of the hit.
    """
    p = pages.where(F.coalesce("body", F.lit("")) != "").select(
        F.col("url").alias("_page_url"),
        *[F.coalesce(c, F.lit("")).alias(f"_p_{c}") for c in ("title", "body", "published", "final_url")],
    )
    p = first_by(p, ["_page_url"], [F.col("_p_final_url"), F.col("_p_body")],
                 ["_p_title", "_p_body", "_p_published", "_p_final_url"])
    chosen = F.lit(True) if top is None else F.col("id") <= top
    s = sources.withColumn("_key", F.when(chosen, F.col("url"))).join(p, F.col("_key") == F.col("_page_url"), "left")
    found = F.col("_page_url").isNotNull()
    new_date = F.when(F.col("_p_published") != "", F.col("_p_published")).otherwise(F.col("published"))
    swap = lambda new, old: F.when(found, new).otherwise(F.col(old))
    named = F.when(F.col("_p_title") != "", F.col("_p_title")).otherwise(F.col("title"))
    moved = F.when(F.col("_p_final_url") != "", U.normalise_url(F.col("_p_final_url"))).otherwise(F.col("url"))
    s = once(s, {
        "published": swap(new_date, "published"), "title": swap(T.truncate_words(named, TITLE_LETTERS), "title"),
        "body": swap(T.truncate_words(F.col("_p_body"), BODY_LETTERS), "body"), "is_direct": found | F.col("is_direct"), "url": swap(moved, "url"),
    })
    s = once(s, {
        "_date": F.when(found, T.parse_date(F.col("published"))), "_n": T.normalise(F.concat_ws("\n", "title", "url", "snippet", "body")),
    })
    redated = F.col("_date").isNotNull()
    s = once(s, {
        "is_current": F.when(redated, F.year("_date") >= profile.min_current_year).otherwise(F.col("is_current")),
        "published_kind": F.when(redated, "publicada").otherwise(F.col("published_kind")),
        "company_alias": swap(F.coalesce(company_alias(F.col("_n"), profile), "company_alias"), "company_alias"),
        "city_ok": swap(T.has_term(F.col("_n"), profile.city), "city_ok"),
        "state_ok": swap(T.has_term(F.col("_n"), profile.state), "state_ok"),
        "topics": swap(topics(F.col("_n"), profile.topics), "topics"),
    })
    placed = F.when(found & F.col("city_ok"), "local").when(found & F.col("state_ok"), "nacional").otherwise(F.col("scope"))
    s = s.withColumn("scope", placed).withColumn("score", swap(source_score(profile), "score"))
    out = renumber(s.select("id", "pos", *SOURCE_COLUMNS))
    return out if keep is None else out.where(F.col("id") <= keep)
