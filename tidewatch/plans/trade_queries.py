"""Registered queries on pages, products and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, urls as U
from ..operators import gates as G, matching as M, pages as P, prices as C, products as D
from ..functions.similarity import jaccard
from ..sources import exports
from . import inputs as I
from .inputs import any_sql, norm_sql
from .lineage import cut

R = lambda x, n: f"round(CAST({x} AS DECIMAL(28,8)), {n})::DOUBLE"


def price_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return I.snapshots(spark, sf).drop("product_id")


def _changes(snapshots: DataFrame) -> DataFrame:
    return C.price_changes_by_run(snapshots).select(
        "entity", "source_domain", "product_key", "run", "previous_price", F.col("price").alias("current_price"),
        T.round_half_up(F.col("change_pct"), 2).alias("change_pct"), "promotion_before", F.col("promotion").alias("promotion_now"))


def price_change(spark: SparkSession, sf: str) -> DataFrame:
    """Every year's prices against the year before."""
    return _changes(I.snapshots(spark, sf))


def price_change_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last full year against the one before, first 100 keys."""
    s = I.snapshots(spark, sf).withColumns({"product_name": F.col("product_key"), "url": F.lit("")})
    return C.price_changes(s.where("run = 1998"), s.where("run = 1997"), limit=100).select(
        "entity", "product_key", "previous_price", "current_price", T.round_half_up(F.col("change_pct"), 2).alias("change_pct"), "promotion_now")


def price_change_repeat(spark: SparkSession, sf: str) -> DataFrame:
    """The price changes reckoned twice, the second time from rows dealt out anew: the rows of each, and whether their digests agree."""
    first = cut(_changes(I.snapshots(spark, sf)))
    second = cut(_changes(cut(I.snapshots(spark, sf)).repartition(5, "product_id")))
    a, b = (cut(G.digests({"changes": x})) for x in (first, second))
    same = G.changed_tables(a, b).agg((F.count(F.lit(1)) == 0).alias("s")).scalar()
    return a.select(F.col("rows").alias("first"), b.select("rows").scalar().alias("second"), same.alias("repeatable"))


def report_price_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The report's table of price changes: the first twelve of the last year."""
    last = price_change(spark, sf).where("run = 1998")
    return exports.report_tables(price_changes=last)["price_changes"].select("entity", "product_key", "previous_price", "current_price", "change_pct")


def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return C.latest_run(o)


def last_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Per region, part and year the shipment written last."""
    li = I.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("entity"), F.lit("d").alias("source_domain"), F.col("l_partkey").cast("string").alias("product_key"),
        F.year("l_shipdate").alias("run_id"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("pos"))
    return C.last_snapshot_per_key(li).select("entity", "product_key", "run_id", F.col("pos.l_orderkey").alias("order_key"), F.col("pos.l_extendedprice").alias("price"))


def page_index(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "pages").select("page_id", U.normalise_url(F.col("url")).alias("url"), U.host(F.col("url")).alias("domain"))


def url_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written into page URLs (the order date stands in the path)."""
    o = I.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("https://a.example.com/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/x")).alias("u"),
                                             F.concat(F.lit("https://a.example.com/20"), F.date_format("o_orderdate", "yy-MM-dd")).alias("v"))
    return o.select("o_orderkey", F.date_format(U.date_in_url(F.col("u")), "yyyy-MM-dd").alias("slashed"), F.date_format(U.date_in_url(F.col("v")), "yyyy-MM-dd").alias("dashed"))


def page_types(spark: SparkSession, sf: str) -> DataFrame:
    read = P.read_pages(I.table(spark, sf, "pages").select("page_id", "url", "html")).drop("final_url", "published")
    return P.typed_pages(read, "url", "title", "body", I.PAGE_RULES).select("url", "page_type").groupBy("url", "page_type").agg(F.count(F.lit(1)).alias("n"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "pages").select("page_id", P.page_title(F.col("html")).alias("title"), F.md5(P.page_text(F.col("html"))).alias("text_hash"),
                                              P.page_published(F.col("html")).alias("published"))


def url_signals(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "pages").select("page_id", T.round_half_up(P.url_signal(F.col("url"), I.PAGE_RULES), 2).alias("signal"),
                                              P.is_non_commercial(F.col("url"), I.PAGE_RULES).alias("non_commercial"))


def commercial_links(spark: SparkSession, sf: str) -> DataFrame:
    return P.commercial_links(I.table(spark, sf, "pages"), None, I.PAGE_RULES).select("page_id", "link", T.round_half_up(F.col("signal"), 2).alias("signal"), "rank")


def sitemap_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each host's pages as that host's landed sitemap."""
    p = I.table(spark, sf, "pages").select("page_id", "url", U.host(F.col("url")).alias("h"))
    maps = p.select("page_id", F.concat(F.lit("https://"), "h", F.lit("/sitemap.xml")).alias("url"),
                    F.concat(F.lit("<urlset><loc>https://"), "h", F.lit("/product/"), F.col("page_id").cast("string"), F.lit("</loc><loc>"), "url", F.lit("</loc><loc>https://other.org/product</loc></urlset>")).alias("html"))
    from dataclasses import replace

    return P.sitemap_links(maps, replace(I.PAGE_RULES, candidate_score=0.20)).select("page_id", "domain", "link")


def _price_sources(spark, sf):
    from dataclasses import replace

    rules = replace(I.PAGE_RULES, candidate_score=0.15, negative_hints=("cheap-pills",))
    pages = I.table(spark, sf, "pages").withColumn("domain", U.host(F.col("url")))
    sources = pages.select(
        F.col("page_id").alias("id"), F.element_at(F.split("domain", r"\."), -2).alias("entity"), "url", F.lit("pagina").alias("title"),
        (F.col("page_id") % 2 == 0).alias("is_direct"), (F.col("page_id") % 3 == 0).alias("is_current"), (F.col("page_id") % 5 == 0).alias("city_ok"),
        (F.length("html") / 10).alias("score"))
    hits = pages.select(F.col("page_id").alias("pos"), F.element_at(F.split("domain", r"\."), -1).alias("target"), "url", F.lit("loja online").alias("title"), F.lit("").alias("snippet"))
    found = P.discover_price_sources(sources, hits, pages.drop("domain"), company="example", rules=rules)
    return pages, found, rules


def price_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _price_sources(spark, sf)[1]


def merged_price_sources(spark: SparkSession, sf: str) -> DataFrame:
    pages, found, rules = _price_sources(spark, sf)
    set_up = pages.groupBy("domain").agg(F.min("url").alias("url")).select(F.lit("example").alias("name"), F.lit("target").alias("role"), "url", F.lit("").alias("location_note"))
    return P.compact_sources(P.merge_price_sources(set_up, found), rules=rules)


def page_products(spark: SparkSession, sf: str) -> DataFrame:
    return D.page_products(I.shop_pages(spark, sf)).select(
        "page_id", "name", "price", "old_price", "promotion", "brand", "unit", "sku", T.round_half_up(F.col("price_confidence"), 2).alias("confidence"))


def page_products_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Products on the landed pages themselves (most have none)."""
    p = I.table(spark, sf, "pages").select("page_id", F.lit("web").alias("source"), F.lit("competitor").alias("role"), "url", "html", F.lit("").alias("location_note"))
    return D.page_products(p, I.PAGE_RULES)


def product_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Word overlap of all names that share a word."""
    n = I.table(spark, sf, "part").select("p_name").distinct().select(F.col("p_name").alias("a"), T.product_tokens(T.product_name(F.col("p_name"))).alias("ta"))
    w = n.select("a", "ta", F.explode("ta").alias("w"))
    v = w.select(F.col("a").alias("b"), F.col("ta").alias("tb"), "w")
    return w.join(v, "w").where(F.col("a") < F.col("b")).select("a", "b", T.round_half_up(jaccard(F.col("ta"), F.col("tb")), 4).alias("overlap")).distinct()


def _matches(spark, sf):
    cat = I.catalogue(spark, sf)
    targets = cat.where(F.col("entity") == I.TARGET).withColumnRenamed("product_id", "target_id").drop("entity", "pos")
    rivals = cat.where(F.col("entity") != I.TARGET).withColumnRenamed("entity", "competitor").drop("product_id")
    # how sure an item is follows from its price's cents; a region without any admitted item is still reported
    sure = rivals.withColumns({"price_confidence": (F.round(F.col("price") * 100).cast("long") % 100) / 100 + 0.55, "page_type": F.lit("")})
    names = I.table(spark, sf, "region").where(F.col("r_name") != I.TARGET).select(F.col("r_name").alias("competitor"))
    return M.match_products(targets, M.admitted(sure).where("competitor <> 'AFRICA'"), competitors=names)


def product_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf)


def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.comparison_summary(_matches(spark, sf))


def _same_part(spark, sf):
    """Comparisons of the same part in two regions: similarity is 1 by identity."""
    cat = I.catalogue(spark, sf)
    t = cat.where(F.col("entity") == I.TARGET).withColumnRenamed("product_id", "target_id").drop("entity", "pos", "sku")
    c = cat.where(F.col("entity") != I.TARGET).select(
        F.col("entity").alias("competitor"), F.col("product_id").alias("target_id"), F.col("name").alias("b_label"), F.col("price").alias("b_price"),
        F.col("old_price").alias("b_old_price"), F.col("promotion").alias("b_promotion"), F.col("url").alias("b_url"))
    return M.classify_matches(t.join(c, "target_id").withColumns({"sku": F.lit(""), "similarity": F.lit(1.0)}))


def price_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _same_part(spark, sf).select("target_id", "competitor", "gap_percent", "cheaper", "match_class", "match_confidence", "canonical_product_id")


def price_war(spark: SparkSession, sf: str) -> DataFrame:
    return M.rank_price_war(M.price_war(_same_part(spark, sf)))


def price_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.largest_gaps(_same_part(spark, sf)).select("target_id", "competitor", "gap_percent")


def comparison_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.comparison_summary(_same_part(spark, sf))


QUERIES = {f.__name__: f for f in (
    price_change, price_snapshot, price_change_latest, price_change_repeat, report_price_changes, latest_run, last_snapshot, page_index, url_dates, page_types, page_text, url_signals,
    commercial_links, sitemap_links, price_sources, merged_price_sources, page_products, page_products_raw, product_overlap, product_match, match_summary,
    price_comparison, price_war, price_gaps, comparison_summary)}

HOST = lambda u: f"replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '')"
PATH = lambda u: f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = lambda u: f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
KEPT = lambda u: ("array_to_string(list_filter(string_split(" + QUERY(u) + ", '&'), lambda q: q <> '' AND NOT starts_with(lower(split_part(q, '=', 1)), 'utm_')"
                  " AND lower(split_part(q, '=', 1)) NOT IN ('gclid', 'fbclid', 'msclkid')), '&')")
NURL = lambda u: (f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {HOST(u)} || CASE WHEN regexp_replace(regexp_replace({PATH(u)}, '/{{2,}}', '/', 'g'), '/+$', '') = ''"
                  f" THEN '/' ELSE regexp_replace(regexp_replace({PATH(u)}, '/{{2,}}', '/', 'g'), '/+$', '') END || CASE WHEN {KEPT(u)} = '' THEN '' ELSE '?' || {KEPT(u)} END")


def _decode(x):
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _hidden(x):
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    for t in P.HIDDEN_TAGS.split("|"):
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    return x


TITLE = "trim(regexp_replace(" + _decode("regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
LINES = f"string_split(regexp_replace({_hidden('html')}, '(?is)<!doctype[^>]*>|<[^>]*>', chr(10), 'g'), chr(10))"
TEXT = f"array_to_string(list_filter(list_transform({LINES}, lambda l: trim({_decode('l')})), lambda l: l <> ''), chr(10))"
rules = I.PAGE_RULES
SIGNAL = lambda u: (f"(CASE WHEN {any_sql(norm_sql(PATH(u)), rules.path_hints)} THEN 0.20 ELSE 0 END + CASE WHEN {norm_sql(PATH(u))} IN ('', '/', '/home', '/index.html', '/index.php') THEN 0.05 ELSE 0 END"
                    f" - CASE WHEN {any_sql(norm_sql(u), rules.negative_hints)} THEN 0.15 ELSE 0 END)")

SAME_SQL = f"""WITH {I.CATALOGUE_SQL},
cmp AS (SELECT t.product_id AS target_id, c.entity AS competitor, t.price AS tp, c.price AS cp, t.promotion AS tpr, c.promotion AS cpr, t.name, t.brand, t.size,
   {R('(c.price - t.price) / t.price * 100', 2)} AS g FROM catalogue t JOIN catalogue c ON c.product_id = t.product_id AND c.entity <> '{I.TARGET}' WHERE t.entity = '{I.TARGET}'),
gaps AS (SELECT *, CASE WHEN abs(g) <= 300 THEN g END AS gap_percent, CASE WHEN abs(g) > 300 THEN 'não comparável' WHEN cp < tp THEN 'concorrente' WHEN tp < cp THEN 'alvo' ELSE 'igual' END AS cheaper FROM cmp)"""

ORACLES = {
    "price_snapshot": f"WITH {I.SNAPSHOTS_SQL} SELECT entity, source_domain, product_key, run, price, promotion FROM snapshots",
    "price_change": f"""WITH {I.SNAPSHOTS_SQL}, c AS (SELECT a.entity, a.source_domain, a.product_key, a.run, b.price AS previous_price, a.price AS current_price,
  (a.price - b.price) / b.price * 100 AS pct, b.promotion AS promotion_before, a.promotion AS promotion_now
  FROM snapshots a JOIN snapshots b ON a.entity = b.entity AND a.product_key = b.product_key AND a.run = b.run + 1 WHERE b.price <> 0)
SELECT * EXCLUDE (pct), {R('pct', 2)} AS change_pct FROM c WHERE abs(pct) >= 0.5 OR promotion_before <> promotion_now""",
    "price_change_repeat": f"""WITH {I.SNAPSHOTS_SQL}, c AS (SELECT (a.price - b.price) / b.price * 100 AS pct, b.promotion AS before, a.promotion AS now
  FROM snapshots a JOIN snapshots b ON a.entity = b.entity AND a.product_key = b.product_key AND a.run = b.run + 1 WHERE b.price <> 0)
SELECT count(*) AS first, count(*) AS second, true AS repeatable FROM c WHERE abs(pct) >= 0.5 OR before <> now""",
    "report_price_changes": f"""WITH {I.SNAPSHOTS_SQL}, c AS (SELECT a.entity, a.source_domain, a.product_key, b.price AS previous_price, a.price AS current_price,
  (a.price - b.price) / b.price * 100 AS pct, b.promotion AS before, a.promotion AS now
  FROM snapshots a JOIN snapshots b ON a.entity = b.entity AND a.product_key = b.product_key AND a.run = 1998 AND b.run = 1997 WHERE b.price <> 0)
SELECT entity, product_key, previous_price, current_price, {R('pct', 2)} AS change_pct FROM c WHERE abs(pct) >= 0.5 OR before <> now ORDER BY entity, source_domain, product_key LIMIT 12""",
    "price_change_latest": f"""WITH {I.SNAPSHOTS_SQL}, c AS (SELECT a.entity, a.source_domain, a.product_key, b.price AS previous_price, a.price AS current_price,
  (a.price - b.price) / b.price * 100 AS pct, b.promotion AS promotion_before, a.promotion AS promotion_now
  FROM snapshots a JOIN snapshots b ON a.entity = b.entity AND a.product_key = b.product_key AND a.run = 1998 AND b.run = 1997 WHERE b.price <> 0)
SELECT entity, product_key, previous_price, current_price, {R('pct', 2)} AS change_pct, promotion_now FROM c WHERE abs(pct) >= 0.5 OR promotion_before <> promotion_now
ORDER BY entity, source_domain, product_key LIMIT 100""",
    "latest_run": "SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1",
    "last_snapshot": """SELECT entity, product_key, run_id, l_orderkey AS order_key, l_extendedprice AS price FROM (SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS product_key,
  year(l_shipdate) AS run_id, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_partkey, year(l_shipdate) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "page_index": f"SELECT page_id, {NURL('url')} AS url, {HOST('url')} AS domain FROM pages",
    "url_dates": """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS slashed, '20' || strftime(o_orderdate, '%y-%m-%d') AS dashed FROM orders""",
    "page_types": f"""WITH r AS (SELECT url, {norm_sql('url')} AS n, {norm_sql(TITLE)} AS t, {norm_sql(f'substr({TEXT}, 1, 5000)')} AS b FROM pages)
SELECT url, CASE WHEN {any_sql('n', rules.negative_hints)} OR {any_sql('t', rules.negative_hints)} OR {any_sql('substr(b, 1, 1800)', rules.negative_hints)} THEN 'ARTICLE_OR_EMPLOYMENT'
  WHEN {any_sql('n', rules.path_hints)} OR {any_sql('substr(b, 1, 1500)', rules.content_hints)} THEN 'COMMERCIAL_CANDIDATE'
  WHEN length(n) - length(replace(n, '/', '')) <= 3 THEN 'ROOT_CANDIDATE' ELSE 'OTHER' END AS page_type, count(*) AS n FROM r GROUP BY 1, 2""",
    "page_text": f"SELECT page_id, {TITLE} AS title, md5({TEXT}) AS text_hash, '' AS published FROM pages",
    "url_signals": f"SELECT page_id, {R(SIGNAL('url'), 2)} AS signal, {any_sql(norm_sql('url'), rules.negative_hints)} AS non_commercial FROM pages",
    "sitemap_links": f"""WITH p AS (SELECT page_id, url, {HOST('url')} AS domain FROM pages), l AS (
  SELECT page_id, domain, unnest(['https://' || domain || '/product/' || page_id, url, 'https://other.org/product']) AS link FROM p)
SELECT page_id, domain, link FROM l WHERE (regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = domain OR ends_with(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '.' || domain))
  AND {SIGNAL('link')} >= 0.20""",
    "commercial_links": f"""WITH a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS tag FROM pages),
h AS (SELECT page_id, base, trim({_decode("regexp_extract(tag, '(?is)href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)")}) AS href, {norm_sql(_decode("regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g')"))} AS label FROM a),
l AS (SELECT *, regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || href AS link FROM h WHERE starts_with(href, '/')),
s AS (SELECT *, {SIGNAL('link')} + CASE WHEN {any_sql('label', rules.anchor_words)} THEN 0.35 ELSE 0 END AS signal FROM l WHERE NOT {any_sql(norm_sql('link'), rules.negative_hints)}),
u AS (SELECT page_id, {NURL('link')} AS link, signal, row_number() OVER (PARTITION BY page_id, {NURL('link')}) AS rn FROM s WHERE signal > 0),
d AS (SELECT page_id, link, arg_min(signal, rn) AS signal FROM u GROUP BY 1, 2)
SELECT page_id, link, {R('signal', 2)} AS signal, row_number() OVER (PARTITION BY page_id ORDER BY signal DESC, link) AS rank FROM d""",
    "page_products": """SELECT p_partkey AS page_id, CASE WHEN p_type = 'SMALL' THEN p_name || ' ' || p_brand ELSE p_name END AS name, round(CAST(p_retailprice AS DECIMAL(12,2)), 2)::DOUBLE AS price,
 CASE WHEN p_type NOT IN ('SMALL', 'ECONOMY') THEN (CAST(p_retailprice AS DECIMAL(12,2)) + 10)::DOUBLE END AS old_price, p_type NOT IN ('SMALL', 'ECONOMY') AS promotion,
 CASE WHEN p_type NOT IN ('SMALL', 'ECONOMY') THEN p_brand ELSE '' END AS brand, CASE WHEN p_type NOT IN ('SMALL', 'ECONOMY') THEN p_size || ' un' ELSE '' END AS unit,
 CASE WHEN p_type = 'SMALL' THEN '' ELSE 'P' || p_partkey END AS sku, CASE p_type WHEN 'SMALL' THEN 0.78 WHEN 'ECONOMY' THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence FROM part""",
    "product_overlap": """WITH n AS (SELECT DISTINCT p_name AS a, string_split(p_name, ' ') AS w FROM part), t AS (SELECT a, list_distinct(list_filter(w, lambda x: length(x) > 2)) AS ta FROM n)
SELECT x.a, y.a AS b, round(CAST(len(list_intersect(x.ta, y.ta)) / (len(x.ta) + len(y.ta) - len(list_intersect(x.ta, y.ta)))::DOUBLE AS DECIMAL(28,8)), 4)::DOUBLE AS overlap
FROM t x JOIN t y ON x.a < y.a AND len(list_intersect(x.ta, y.ta)) > 0""",
    "price_comparison": SAME_SQL + f""" SELECT target_id, competitor, gap_percent, cheaper, CASE WHEN gap_percent IS NULL THEN 'revisao_necessaria' ELSE 'confirmado' END AS match_class,
 CASE WHEN gap_percent IS NULL THEN 'baixa' ELSE 'alta' END AS match_confidence, substr(sha1({norm_sql("brand || '|' || name || '|' || size || ' un|'")}), 1, 24) AS canonical_product_id FROM gaps""",
    "price_war": SAME_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY gap_percent) AS rn, count(*) OVER (PARTITION BY competitor) AS n FROM gaps WHERE gap_percent IS NOT NULL)
SELECT competitor, count(*) AS comparable, count(*) FILTER (cheaper = 'concorrente') AS competitor_cheaper, count(*) FILTER (cheaper = 'alvo') AS target_cheaper, count(*) FILTER (cheaper = 'igual') AS ties,
 round(sum(CAST(gap_percent AS DECIMAL(20,2)))::DOUBLE / count(*), 2) AS mean_gap, max(gap_percent) FILTER (rn = n // 2 + 1) AS median_gap, arg_max(gap_percent, abs(gap_percent) * 1000000 + gap_percent) AS largest_gap FROM r GROUP BY competitor""",
    "price_gaps": SAME_SQL + " SELECT target_id, competitor, gap_percent FROM gaps WHERE gap_percent IS NOT NULL ORDER BY abs(gap_percent) DESC, competitor, target_id LIMIT 15",
    "comparison_summary": SAME_SQL + """ SELECT count(DISTINCT target_id) AS target_products, count(gap_percent) AS comparable, count(*) FILTER (gap_percent IS NOT NULL AND cheaper = 'alvo') AS target_cheaper,
 count(*) FILTER (gap_percent IS NOT NULL AND cheaper = 'concorrente') AS competitor_cheaper, count(*) FILTER (tpr) AS target_promotions, count(*) FILTER (cpr) AS competitor_promotions, 'ok' AS status FROM gaps""",
}
