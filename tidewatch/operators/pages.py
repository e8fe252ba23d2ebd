"""Page types, commercial links, page text and price-source discovery over landed pages."""

from __future__ import annotations

import json
from functools import lru_cache
from html import entities, unescape

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from ..plans.lineage import first_by, once, top_by
from ..rules import PageRules

RULES = PageRules()
HIDDEN_TAGS = "script|style|noscript|svg|iframe|form"
# Metadata names that hold the publication date.
DATE_META = ("article:published_time", "datepublished", "publish_date", "date")
COMMERCIAL_TYPES = ("COMMERCIAL_CANDIDATE", "ROOT_CANDIDATE")
# A page's type is told from this much of its start; words of news or commerce further down do not change it.
TYPE_TEXT, ARTICLE_TEXT, SHOP_TEXT = 5000, 1800, 1500


def _page_type(url: Column, n: Column, title: Column, text: Column, rules: PageRules) -> Column:
    """Page type from the URL and the normalised URL, title and text."""
    negative = (
        T.contains_any(n, rules.negative_hints)
        | T.contains_any(title, rules.negative_hints)
        | T.contains_any(F.substring(text, 1, ARTICLE_TEXT), rules.negative_hints)
    )
    positive = T.contains_any(n, rules.path_hints) | T.contains_any(F.substring(text, 1, SHOP_TEXT), rules.content_hints)
    slashes = F.length(n) - F.length(F.replace(n, F.lit("/"), F.lit("")))
    return (
        F.when(is_blocked(url, rules), "BLOCKED")
        .when(negative, "ARTICLE_OR_EMPLOYMENT")
        .when(positive, "COMMERCIAL_CANDIDATE")
        .when(slashes <= 3, "ROOT_CANDIDATE")
        .otherwise("OTHER")
    )


def _page_forms(url: Column, title: Column, body: Column) -> list[Column]:
    return [T.normalise(url), T.normalise(title), T.normalise(F.substring(F.coalesce(body, F.lit("")), 1, TYPE_TEXT))]


def page_type(url: Column, title: Column, body: Column, rules: PageRules = RULES) -> Column:
    """Commercial standing of a page, first rule that fits."""
    forms = F.struct(*[f.alias(a) for f, a in zip(_page_forms(url, title, body), "ntb")])
    return T.let(forms, lambda f: _page_type(url, f["n"], f["t"], f["b"], rules))


def typed_pages(pages: DataFrame, url: str, title: str, body: str, rules: PageRules = RULES) -> DataFrame:
    """Pages with ``page_type``, their texts normalised once."""
    forms = dict(zip(("_fn", "_ft", "_fb"), _page_forms(F.col(url), F.col(title), F.col(body))))
    kind = _page_type(F.col(url), F.col("_fn"), F.col("_ft"), F.col("_fb"), rules)
    return once(once(pages, forms), {"page_type": kind}).drop("_fn", "_ft", "_fb")


def price_gate(rules: PageRules = RULES):
    """Predicate for event classification: is this a page on which prices are offered?"""
    return lambda url, title, body: page_type(url, title, body, rules).isin(*COMMERCIAL_TYPES)


def is_blocked(url: Column, rules: PageRules = RULES) -> Column:
    return U.host(url).isin(*rules.blocked_domains) if rules.blocked_domains else F.lit(False)


def is_non_commercial(url: Column, rules: PageRules = RULES) -> Column:
    return is_blocked(url, rules) | T.contains_any(T.normalise(url), rules.negative_hints)


def url_signal(url: Column, rules: PageRules = RULES) -> Column:
    """Commercial score of a URL, -1..1."""
    p = T.normalise(U.path(url))
    score = (
        F.when(T.contains_any(p, rules.path_hints), 0.20).otherwise(0.0)
        + F.when(p.isin(*rules.home_paths), 0.05).otherwise(0.0)
        - F.when(T.contains_any(T.normalise(url), rules.negative_hints), 0.15).otherwise(0.0)
    )
    return F.when((F.coalesce(url, F.lit("")) == "") | is_blocked(url, rules), -1.0).otherwise(score)


def is_candidate(url: Column, rules: PageRules = RULES) -> Column:
    return ~is_blocked(url, rules) & (url_signal(url, rules) >= rules.candidate_score)


@lru_cache(maxsize=1)
def _entities() -> str:
    """Every named reference, with and without its semicolon where the standard allows, and the numbers it reads as Windows-1252."""
    table = dict(entities.html5) | {f"#{i};": unescape(f"&#{i};") for i in range(128, 160)}
    return json.dumps(table)


def _character(reference: Column) -> Column:
    """What a character reference stands for; null if it stands for nothing."""
    body = F.substring(reference, 2, 64)
    named = F.try_element_at(F.from_json(F.lit(_entities()), "map<string,string>"), body)
    wide = F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]{1,6});?$", 1)
    code = F.coalesce(F.regexp_extract(body, r"^#([0-9]{1,7});?$", 1).try_cast("long"), F.conv(F.nullif(wide, F.lit("")), 16, 10).try_cast("long"))
    scalar = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.coalesce(named, F.when(scalar, T.code_points(code)))


def decode_entities(c: Column) -> Column:
    """Character references decoded, all named ones and numbers; those for an ampersand last, so that nothing is decoded twice."""
    reference = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
    ampersand = r"&(?:amp;?|AMP;?|#0*38;?|#[xX]0*26;?)"
    rest = T.replace_each(c, reference, lambda m: F.when(~m.rlike(f"^{ampersand}$"), _character(m)))
    return F.regexp_replace(rest, ampersand, "&")


def strip_tags(html: Column, gap: str = " ") -> Column:
    """Text of a fragment, tags replaced by ``gap``, entities decoded, blanks squeezed."""
    return T.squeeze(decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", gap)))


def page_title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def drop_hidden(html: Column) -> Column:
    """Markup less comments and elements that show no text."""
    no_comments = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(no_comments, rf"(?is)<({HIDDEN_TAGS})\b[^>]*>.*?</\1\s*>", "")


def page_text(html: Column) -> Column:
    """Visible text, one line per text node."""
    lines = F.split(F.regexp_replace(drop_hidden(html), r"(?is)<!doctype[^>]*>|<[^>]*>", "\n"), "\n")
    clean = F.filter(F.transform(lines, lambda x: F.trim(decode_entities(x))), lambda x: x != "")
    return F.array_join(clean, "\n")


def page_published(html: Column) -> Column:
    """Publication date text from the page's metadata or its linked data; '' when absent."""
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"))
    attr = lambda m, name: F.regexp_extract(m, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    dated = F.filter(
        metas,
        lambda m: T.normalise(
            F.when(attr(m, "property") != "", attr(m, "property")).otherwise(attr(m, "name"))
        ).isin(*DATE_META) & (F.trim(attr(m, "content")) != ""),
    )
    linked = F.regexp_extract(html, r"(?is)\"date(?:Published|Created)\"\s*:\s*\"([^\"]+)\"", 1)
    return F.coalesce(F.trim(attr(F.try_element_at(dated, F.lit(1)), "content")), linked)


def read_pages(pages: DataFrame) -> DataFrame:
    """Landed pages (url, html, optional final_url) as title, body and publication date."""
    final = F.col("final_url") if "final_url" in pages.columns else F.col("url")
    return pages.select(
        "url",
        page_title(F.col("html")).alias("title"),
        page_text(F.col("html")).alias("body"),
        page_published(F.col("html")).alias("published"),
        final.alias("final_url"),
    )


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``: absolute, scheme-relative, rooted, query-only or relative."""
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = F.concat(folder, href)
    rest = F.regexp_extract(joined, r"(?s)^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_extract(joined, r"^[^?#]*", 0), "/")
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda at, s: F.when(
        s == "..", F.when(F.size(at) > 1, F.slice(at, 1, F.size(at) - 1)).otherwise(at)).when(s == ".", at).otherwise(F.concat(at, F.array(s))))
    ends_in_folder = F.element_at(steps, -1).isin(".", "..")
    joined = F.concat(F.array_join(F.when(ends_in_folder, F.concat(walk, F.array(F.lit("")))).otherwise(walk), "/"), rest)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .otherwise(F.concat(origin, joined))
    )


def commercial_links(pages: DataFrame, limit: int | None = None, rules: PageRules = RULES) -> DataFrame:
    """Outlinks of each page (page_id, url, html) that lead to something for sale.

    Same-host links need a positive signal, others ``external_link_score``.
    One row per page and canonical link, ``rank`` by signal then URL.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"))
    a = pages.select("page_id", F.col("url").alias("base"), F.posexplode(anchors).alias("at", "tag"))
    signal = url_signal(F.col("link"), rules) + F.when(T.contains_any(T.normalise(strip_tags(F.col("tag"))), rules.anchor_words), 0.35).otherwise(0.0)
    a = (
        a.withColumn("href", F.trim(decode_entities(F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1))))
        .where((F.col("href") != "") & ~F.col("href").rlike(r"^(?:javascript:|mailto:|tel:|#)"))
    )
    a = once(a, {"link": absolute_url(F.col("base"), F.col("href"))}).where(F.col("link").rlike(r"^[hH][tT][tT][pP][sS]?:"))
    a = once(a.where(~is_non_commercial(F.col("link"), rules)), {"signal": signal})
    netloc = lambda c: F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    inside = netloc(F.col("link")) == netloc(F.col("base"))
    a = a.where((F.col("signal") > 0) & (inside | (F.col("signal") >= rules.external_link_score)))
    a = a.withColumn("link", U.normalise_url(F.col("link")))
    a = first_by(a, ["page_id", "base", "link"], [F.col("at")], ["signal"])
    return rank_links(a, limit)


def rank_links(links: DataFrame, limit: int | None) -> DataFrame:
    """Links numbered within their page by signal then URL."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.desc("signal"), "link")
    out = links.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def sitemap_links(pages: DataFrame, rules: PageRules = RULES) -> DataFrame:
    """``<loc>`` rows (page_id, domain, link) of landed sitemaps that stay on the domain and look commercial."""
    locs = F.regexp_extract_all("html", F.lit(r"(?is)<loc>(.*?)</loc>"))
    s = pages.select("page_id", U.host(F.col("url")).alias("domain"), F.explode(locs).alias("link"))
    s = s.withColumn("link", decode_entities(F.trim("link")))
    netloc = F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    own = (netloc == F.col("domain")) | F.endswith(netloc, F.concat(F.lit("."), F.col("domain")))
    return s.where(own & is_candidate(F.col("link"), rules))


def expand_domains(seeds: DataFrame, pages: DataFrame, per_seed: int | None = None,
                   link_limit: int | None = None, rules: PageRules = RULES) -> DataFrame:
    """Price sources found on the landed pages of each seed's domain.

    ``seeds`` holds name, role, url, location_note; ``pages`` page_id, url, html.
    A page, its commercial links and its sitemap's links all count; the best
    ``per_seed`` URLs of every seed are kept.
    """
    seeds = seeds.where((U.host(F.col("url")) != "") & ~is_blocked(F.col("url"), rules))
    seeds = seeds.withColumn("domain", U.host(F.col("url"))).withColumnRenamed("url", "seed_url")
    is_map = F.lower("url").rlike(r"/sitemap(?:_index)?\.xml$")
    domain = U.host(F.col("url"))
    near = pages.withColumn("_domain", domain)
    html_pages = near.where(~is_map)
    found = (
        html_pages.select("page_id", F.lit(0).alias("stage"), F.col("url").alias("link"))
        .unionByName(commercial_links(html_pages, link_limit, rules).select("page_id", F.lit(1).alias("stage"), "link"))
        .unionByName(sitemap_links(near.where(is_map), rules).select("page_id", F.lit(2).alias("stage"), "link"))
        .join(near.select("page_id", "_domain", F.col("url").alias("page_url")), "page_id")
    )
    root = F.regexp_replace("page_url", r"/+$", "") == F.concat(F.lit("https://"), F.col("_domain"))
    reach = seeds.join(found, F.col("domain") == F.col("_domain")).where(
        (F.col("page_url") == F.col("seed_url")) | root | (F.col("stage") == 2)
    )
    reach = reach.where(~is_blocked(F.col("link"), rules))
    first = first_by(reach, ["name", "role", "domain", "location_note", "seed_url", "link"],
                     [F.col("stage"), F.col("page_id")], ["stage"])
    first = first.withColumn("signal", url_signal(F.col("link"), rules))
    if per_seed is not None:
        first = top_by(first, ["name", "role", "seed_url"], [F.desc("signal"), F.asc("stage"), F.asc("link")], per_seed)
    return first.select("name", "role", F.col("link").alias("url"), "domain", "location_note",
                        F.lit(True).alias("discovered"), "signal")


def discover_price_sources(
    sources: DataFrame,
    hits: DataFrame,
    pages: DataFrame,
    company: str,
    market: str = "mercado",
    per_entity: int | None = None,
    rules: PageRules = RULES,
) -> DataFrame:
    """Where each company may be selling: found in its raw hits and its sources.

    ``sources`` holds id, entity, url, title, is_direct, is_current, city_ok,
    score; ``hits`` pos, target, url, title, snippet.
    """
    role = lambda c: F.when(T.normalise(c) == T.normalise_literal(company), "target").otherwise("competitor")
    note = F.when(F.col("city_ok"), "localidade confirmada").otherwise("localidade não confirmada")
    signal = url_signal(F.col("url"), rules)

    shop = T.contains_any(T.normalise(F.concat_ws("\n", "title", "snippet")), rules.official_words)
    raw = hits.withColumn("name", F.trim("target")).where(
        (F.col("name") != "") & (F.col("name") != market) & (U.host(F.col("url")) != "")
        & ~is_blocked(F.col("url"), rules) & ((signal > 0) | shop)
    )
    raw = first_by(raw.withColumn("_e", T.normalise(F.col("name"))).withColumn("_d", U.host(F.col("url"))),
                   ["_e", "_d"], [F.col("pos")], ["name", "url"])
    from_hits = expand_domains(
        raw.select("name", role(F.col("name")).alias("role"), "url", F.lit("descoberta comercial").alias("location_note")),
        pages, per_entity, rules=rules,
    ).withColumn("origin", F.lit(0))

    own = sources.where((F.coalesce("entity", F.lit("")) != "") & (F.col("entity") != market)
                        & (U.host(F.col("url")) != "") & ~is_blocked(F.col("url"), rules))
    own = own.withColumn("name", F.col("entity")).withColumn("role", role(F.col("entity"))).withColumn(
        "location_note", note).withColumn("signal", signal)
    seen = first_by(own.where(F.col("signal") > 0).withColumn("_e", T.normalise(F.col("name"))).withColumn("_d", U.host(F.col("url"))),
                    ["_e", "_d"], [F.col("id")], ["name", "role", "url", "location_note"])
    official = expand_domains(seen.select("name", "role", "url", "location_note"), pages, per_entity, rules=rules).withColumn("origin", F.lit(1))

    plain = own.where(is_candidate(F.col("url"), rules)
                      | ~(is_non_commercial(F.col("url"), rules) | is_non_commercial(F.col("title"), rules)))
    plain = plain.withColumn("domain", U.host(F.col("url"))).withColumn("_cand", is_candidate(F.col("url"), rules))
    order = [F.desc("_cand"), F.desc("is_direct"), F.desc("city_ok"), F.desc("is_current"), F.desc("score"), F.asc("id")]
    plain = top_by(plain, ["name", "domain"], order)
    weak = expand_domains(plain.where(F.col("signal") <= 0).select("name", "role", "url", "location_note"), pages, per_entity, rules=rules)
    strong = plain.where(F.col("signal") > 0).select(
        "name", "role", "url", "domain", "location_note", F.lit(True).alias("discovered"), "signal")
    ranked = strong.unionByName(weak)
    ranked = top_by(ranked, ["name", "role", "domain"], [F.desc("signal"), F.asc("url")])
    if per_entity is not None:
        ranked = top_by(ranked, ["name"], [F.desc("signal"), F.asc("domain")], per_entity)
    ranked = ranked.withColumn("origin", F.lit(2))

    out = from_hits.unionByName(official).unionByName(ranked)
    out = out.withColumn("_e", T.normalise(F.col("name")))
    return first_by(out, ["_e", "domain", "role", "url"], [F.col("origin")],
                    ["name", "location_note", "discovered", "signal", "origin"]).drop("_e")


def merge_price_sources(configured: DataFrame, discovered: DataFrame) -> DataFrame:
    """One source per (entity, domain, role); configured ones win, then discovery order."""
    cols = ["name", "role", "url", "location_note"]
    a = configured.select(*cols, F.lit(-1).alias("origin"), F.lit(0.0).alias("signal"))
    b = discovered.select(*cols, "origin", "signal")
    both = a.unionByName(b).where((F.trim("name") != "") & (F.trim("url") != ""))
    both = both.withColumn("_e", T.normalise(F.col("name"))).withColumn("domain", U.host(F.col("url")))
    return first_by(both, ["_e", "domain", "role"], [F.col("origin"), -F.col("signal"), F.col("url")],
                    ["name", "url", "location_note", "origin"]).drop("_e")


def compact_sources(sources: DataFrame, per_role: int | None = None, rules: PageRules = RULES) -> DataFrame:
    """Best URL of each (entity, domain, role), optionally only ``per_role`` of a role."""
    s = sources.withColumn("signal", url_signal(F.col("url"), rules)).withColumn("domain", U.host(F.col("url")))
    s = s.where(F.col("domain") != "").withColumn("_e", T.normalise(F.col("name")))
    s = first_by(s, ["_e", "domain", "role"], [-F.col("signal"), F.col("url")], ["name", "url", "location_note", "signal"])
    if per_role is not None:
        s = top_by(s, ["role"], [F.desc("signal"), F.asc("_e"), F.asc("domain")], per_role)
    return s.drop("_e")
