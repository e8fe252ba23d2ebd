"""The given tables seen as the engine's inputs, in Spark and as SQL for cross-checks.

Nothing is made up here: every row derives from the tables, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import boxes as B, text as T
from ..rules import PageRules, RadarProfile
from .lineage import numbered, once, spread

AS_OF = "2024-02-01"

# The prose of the tables is invented, so the rules name words that occur in it.
TOPICS = {
    "preço": ("ndher", "thre"), "reputação": ("therin", "reer"), "digital": ("ingly", "onst"),
    "marketing": ("eaux", "lich"), "pessoas": ("mente", "schen"), "produto": ("ation", "r$"),
}
PROFILE = RadarProfile(
    company="orre", aliases=("orre", "thatin"), city="ononst", state="th", homonyms=("thstth", "hehaha"),
    foreign_cities=("rewh", "inoran", "hehely"), topics=TOPICS,
    priority_domains={"en.example.com": 1.0, "fr.example": 0.95, "example.com": 0.5},
    min_history_year=2020, min_current_year=2023,
)
EVENT_WORDS = {
    "REGULAÇÃO": ("ththth", "ereris"), "PESSOAS": ("mente", "thnd"), "EXPANSÃO": ("thble", "orean"),
    "REPUTAÇÃO": ("therin", "eaueau"), "ATENDIMENTO": ("hehe",), "PREÇO": ("ndth", "thre"),
    "DIGITAL": ("ingly",), "MARKETING": ("lich",), "PRODUTO/SERVIÇO": ("ation",), "PARCERIA": ("tion",),
}
PAGE_RULES = PageRules(
    path_hints=("product", "/en", "offer"), negative_hints=("blog", "news", "thanthan"),
    content_hints=("enier", "thatin", "price"), anchor_words=("the", "la", "der"),
    external_link_score=0.55,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    # texts take long to judge and may lie in one small file
    return spread(df) if name in ("documents", "pages", "part") else df


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw search hits."""
    d = table(spark, sf, "documents")
    day = F.date_add(F.lit("2018-06-01").cast("date"), (F.col("n_chars") % 2400).cast("int"))
    form = F.col("n_chars") % 5
    return d.select(
        F.col("doc_id").alias("pos"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.concat(F.lit("HTTPS://WWW."), "lang", F.lit(".Example.com//"), "lang", F.lit("/"), F.substring(F.md5("text"), 1, 12),
                 F.lit("/?utm_source=feed&page=2#top")).alias("url"),
        F.col("text").alias("snippet"), F.col("source").alias("channel"),
        F.when(form == 0, "").when(form == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("published"),
        F.lit("geral").alias("category"),
        F.when(F.col("lang") == "en", "orre").when(F.col("lang") == "de", "der").when(F.col("lang") == "fr", "la").otherwise("mercado").alias("target"),
    )


HITS_SQL = """
hits AS (
  SELECT doc_id AS pos, substr(split_part(text, chr(10), 1), 1, 80) AS raw_title,
    'HTTPS://WWW.' || lang || '.Example.com//' || lang || '/' || substr(md5(text), 1, 12) || '/?utm_source=feed&page=2#top' AS raw_url,
    text AS raw_snippet, source AS channel, lang,
    DATE '2018-06-01' + CAST(n_chars % 2400 AS INTEGER) AS day, n_chars % 5 AS form,
    CASE lang WHEN 'en' THEN 'orre' WHEN 'de' THEN 'der' WHEN 'fr' THEN 'la' ELSE 'mercado' END AS target
  FROM documents)
"""


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'))"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def term_sql(x: str, word: str) -> str:
    return rf"regexp_matches({x}, '(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)')"


def classified_sql() -> str:
    """CTEs up to ``classified``: hits with every source column and the reason of rejection."""
    p = PROFILE
    n = "n"
    topics = ", ".join(f"CASE WHEN {any_sql(n, ws)} THEN '{t}' END" for t, ws in p.topics.items())
    foreign = " OR ".join(term_sql(n, w) for w in p.foreign_cities)
    weights = " ".join(f"WHEN contains(domain, '{d}') THEN {8 * w}::DOUBLE" for d, w in p.priority_domains.items())
    return f"""{HITS_SQL},
h1 AS (
  SELECT *, trim(raw_title) AS t, trim(raw_snippet) AS snippet, lang || '.example.com' AS domain,
    'https://' || lang || '.example.com/' || lang || '/' || substr(md5(raw_snippet), 1, 12) || '?page=2' AS url,
    CASE WHEN form <> 0 THEN day END AS pub
  FROM hits),
h2 AS (SELECT *, {norm_sql("t || chr(10) || url || chr(10) || snippet")} AS n FROM h1),
h3 AS (
  SELECT *, CASE WHEN {term_sql(n, 'thatin')} THEN 'thatin' WHEN {term_sql(n, 'orre')} THEN 'orre' END AS alias,
    target <> 'mercado' AS named,
    CASE target WHEN 'orre' THEN {term_sql(n, 'orre')} WHEN 'der' THEN {term_sql(n, 'der')} WHEN 'la' THEN {term_sql(n, 'la')} ELSE false END AS target_named,
    (contains(domain, target) OR contains(domain, 'orre') OR contains(domain, 'grupo') OR contains(domain, 'corporate')) AS corporate,
    {term_sql(n, p.city)} AS city_ok, {term_sql(n, p.state)} AS state_ok, ({foreign}) AS foreign_place,
    {any_sql(n, p.homonyms)} AS homonym,
    list_filter([{topics}], lambda x: x IS NOT NULL) AS topics
  FROM h2),
h4 AS (
  SELECT *, CASE WHEN foreign_place AND NOT (city_ok OR state_ok) THEN 'global' WHEN city_ok THEN 'local' WHEN state_ok THEN 'nacional'
      WHEN corporate THEN 'corporativo' ELSE 'incerto' END AS scope0,
    coalesce(alias, CASE WHEN named THEN target END) AS company_alias,
    named AND target <> 'orre' AND target_named AS rival
  FROM h3),
classified AS (
  SELECT *,
    CASE WHEN NOT named THEN CASE WHEN city_ok THEN 'local' ELSE 'mercado' END
      WHEN rival THEN CASE WHEN city_ok THEN 'local' ELSE 'concorrente' END ELSE scope0 END AS scope,
    CASE WHEN named AND homonym THEN 'homonym'
      WHEN alias IS NULL AND named AND NOT target_named THEN 'entity_not_named'
      WHEN company_alias IS NULL AND named THEN 'no_entity'
      WHEN named AND NOT rival AND scope0 = 'global' THEN 'foreign'
      WHEN named AND NOT rival AND scope0 = 'incerto' AND NOT corporate THEN 'uncertain_place'
      WHEN year(pub) < {p.min_history_year} THEN 'too_old' END AS reject_reason,
    CASE WHEN t <> '' THEN t ELSE url END AS title,
    coalesce(strftime(pub, '%Y-%m-%d'), '') AS published,
    coalesce(year(pub) >= {p.min_current_year}, false) AS is_current,
    sha1({norm_sql("t || ' ' || substr(snippet, 1, 2400) || ' ' || url")}) AS fingerprint,
    coalesce(nullif(target, ''), company_alias, 'mercado') AS entity,
    least(1.0::DOUBLE, 0.45::DOUBLE + CASE WHEN company_alias IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN city_ok THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN state_ok THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN pub IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END) AS confidence
  FROM h4),
scored AS (
  SELECT *,
    CASE WHEN coalesce(company_alias, '') <> '' THEN 34.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN city_ok THEN 18 WHEN state_ok THEN 8 ELSE 0 END
    + CASE WHEN is_current THEN 18 WHEN published = '' THEN -8 ELSE 0 END
    + CASE WHEN length(snippet) >= 1000 THEN 5 ELSE 0 END
    + CASE scope WHEN 'local' THEN 6 WHEN 'corporativo' THEN 4 ELSE 0 END
    + CASE {weights} ELSE 0.0::DOUBLE END + least(10, 2 * len(topics)) AS score
  FROM classified)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as price snapshots: region sells part in a year at its mean unit price."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    places = (
        table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
        .join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("entity"))
    )
    unit_price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(20,8)")
    return (
        li.join(places, "l_suppkey")
        .groupBy("entity", F.col("l_partkey").alias("product_id"), F.year("l_shipdate").alias("run"))
        .agg(F.sum(unit_price).alias("s"), F.count(F.lit(1)).alias("n"), F.max("l_discount").alias("d"))
        .select(
            "entity", F.concat(F.lower("entity"), F.lit(".example.com")).alias("source_domain"), F.col("product_id").cast("string").alias("product_key"),
            "product_id", "run", T.round_half_up(F.col("s").cast("double") / F.col("n"), 4).alias("price"), (F.col("d") >= 0.05).alias("promotion"))
    )


SNAPSHOTS_SQL = """
snapshots AS (
  SELECT r_name AS entity, lower(r_name) || '.example.com' AS source_domain, CAST(l_partkey AS VARCHAR) AS product_key, l_partkey AS product_id,
    year(l_shipdate) AS run, round(CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(20,8)))::DOUBLE / count(*) AS DECIMAL(28,8)), 4)::DOUBLE AS price,
    max(l_discount) >= 0.05 AS promotion
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY r_name, l_partkey, year(l_shipdate))
"""


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """What each region sells, at its latest price, with the part's name, brand and size."""
    last = snapshots(spark, sf).groupBy("entity", "product_id").agg(F.max_by(F.struct("price", "promotion"), "run").alias("l"))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return last.join(part, F.col("product_id") == F.col("p_partkey")).select(
        "entity", "product_id", F.col("product_id").alias("pos"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.concat(F.col("p_size").cast("string"), F.lit(" un")).alias("unit"), F.lit("").alias("sku"), F.col("l.price").alias("price"),
        F.lit(None).cast("double").alias("old_price"), F.col("l.promotion").alias("promotion"),
        F.concat(F.lit("https://"), F.lower("entity"), F.lit(".example.com/product/"), F.col("product_id").cast("string")).alias("url"))


CATALOGUE_SQL = SNAPSHOTS_SQL + """,
catalogue AS (
  SELECT entity, product_id, arg_max(price, run) AS price, arg_max(promotion, run) AS promotion,
    any_value(p_name) AS name, any_value(p_brand) AS brand, any_value(p_size) AS size
  FROM snapshots JOIN part ON p_partkey = product_id GROUP BY entity, product_id)
"""
TARGET = "EUROPE"


def scored_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """User events as market events of a day (events, evidence, sources)."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "REPUTAÇÃO").when(F.col("event_type") == "view", "DIGITAL").when(
        F.col("event_type") == "click", "MARKETING").when(F.col("event_type") == "purchase", "PREÇO").otherwise("EXPANSÃO")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("event_id", "user_id", kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", k.alias("k"))
    group = ["user_id", "kind", "day"]
    rows = e.groupBy(*group).agg(
        F.min("event_id").alias("event_id"), F.max("value").alias("v"), F.max("k").alias("k"),
        F.countDistinct(F.floor(F.col("k") / 25)).alias("source_count"), F.count(F.lit(1)).alias("evidence_count"))
    events = rows.select(
        "event_id", "kind", F.concat_ws(" ", "kind", F.col("user_id").cast("string"), "day").alias("title"),
        F.least(F.lit(100), F.floor("v")).cast("int").alias("importance"), (F.col("k") / 100).alias("confidence"),
        F.when(F.col("k") % 10 == 0, "").otherwise(F.col("day")).alias("date"), F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("entity"),
        "source_count", (F.col("day") >= "2024-01-10").alias("is_current"), F.col("event_id").alias("rank"))
    evidence = e.join(rows.select(*group, F.col("event_id").alias("_e")), group).select(F.col("_e").alias("event_id"), F.col("event_id").alias("source_id"))
    sources = e.select(
        F.col("event_id").alias("id"), F.when(F.col("k") % 10 == 0, "").otherwise(F.col("day")).alias("published"),
        (F.col("k") / 100).alias("confidence"))
    return events, evidence, sources


SCORED_EVENTS_SQL = """
e AS (
  SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'REPUTAÇÃO' WHEN 'view' THEN 'DIGITAL' WHEN 'click' THEN 'MARKETING'
    WHEN 'purchase' THEN 'PREÇO' ELSE 'EXPANSÃO' END AS kind, strftime(ts, '%Y-%m-%d') AS day, value,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
grp AS (
  SELECT user_id, kind, day, min(event_id) AS event_id, max(value) AS v, max(k) AS k, count(DISTINCT k // 25) AS source_count, count(*) AS evidence_count
  FROM e GROUP BY user_id, kind, day),
ev AS (
  SELECT event_id, kind, kind || ' ' || user_id || ' ' || day AS title, CAST(least(100, floor(v)) AS INTEGER) AS importance, k / 100.0::DOUBLE AS confidence,
    CASE WHEN k % 10 = 0 THEN '' ELSE day END AS date, 'user' || (user_id % 7) AS entity, source_count, day >= '2024-01-10' AS is_current, event_id AS rank
  FROM grp),
evidence AS (SELECT g.event_id, e.event_id AS source_id FROM e JOIN grp g USING (user_id, kind, day)),
src AS (SELECT event_id AS id, CASE WHEN k % 10 = 0 THEN '' ELSE day END AS published, k / 100.0::DOUBLE AS confidence FROM e)
"""


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as token streams without geometry; texts are dealt by document, so what follows on pages moves no token."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("doc_id", "text").repartition(parts, "doc_id")
    d = d.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "text"))
    return d.where(F.col("text") != "").select(
        "doc_id", "pos", F.col("pos").cast("long").alias("token_id"), "text", F.lit(None).cast(
            "struct<x_min:double,y_min:double,x_max:double,y_max:double>").alias("box"), F.lit(0.9).alias("confidence"),
        F.lit(0.0).alias("page_w"), F.lit(0.0).alias("page_h"))


DOC_TOKENS_SQL = r"""
doc_tokens AS (
  SELECT doc_id, pos - 1 AS pos, tok AS text FROM (
    SELECT doc_id, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents))
  WHERE tok <> '')
"""


def grid_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of words, twelve to a line."""
    t = doc_tokens(spark, sf)
    x, y = (F.col("pos") % 12) * 100.0, F.floor(F.col("pos") / 12) * 24.0
    t = t.withColumn("box", B.box(x, y, x + 8.0 * F.length("text"), y + 16.0))
    t = t.withColumn("confidence", F.when(F.length("text") == 1, 0.22).otherwise(0.9))
    size = t.groupBy("doc_id").agg(F.max("box.x_max").alias("page_w"), F.max("box.y_max").alias("page_h"))
    # pages are bounded, so a task's sizes fit a hash table and its tokens need no sorting
    return t.drop("page_w", "page_h").join(size.hint("shuffle_hash"), "doc_id")


GRID_SQL = DOC_TOKENS_SQL + """,
grid0 AS (SELECT *, (pos % 12) * 100.0::DOUBLE AS x1, (pos // 12) * 24.0::DOUBLE AS y1, CASE WHEN length(text) = 1 THEN 0.22 ELSE 0.9 END AS confidence FROM doc_tokens),
grid AS (
  SELECT *, x1 + 8.0::DOUBLE * length(text) AS x2, y1 + 16.0::DOUBLE AS y2,
    max(x1 + 8.0::DOUBLE * length(text)) OVER (PARTITION BY doc_id) AS page_w, max(y1 + 16.0::DOUBLE) OVER (PARTITION BY doc_id) AS page_h
  FROM grid0)
"""


def record_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages of codes: pay, date, case, tax ids, share and measure."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, part = F.floor(cents / 100), cents % 100
    k = pad(key % 1000000000, 9)
    words = F.array(
        F.when(key % 2 == 0, "Remuneração").otherwise("Total"),
        F.concat(whole.cast("string"), F.lit(","), pad(part, 2)),
        F.concat(F.lit("R$ "), (whole % 1000).cast("string"), F.lit(","), pad(part, 2)),
        F.concat(F.lit("em "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.concat(pad(key % 10000000, 7), F.lit("-"), pad(cust % 100, 2), F.lit("."), F.date_format("o_orderdate", "yyyy")),
        F.concat(F.substring(k, 1, 2), F.lit("."), F.substring(k, 3, 3), F.lit("."), F.substring(k, 6, 3), F.lit("/0001-"), pad(cust % 100, 2)),
        F.concat(F.substring(k, 1, 3), F.lit("."), F.substring(k, 4, 3), F.lit("."), F.substring(k, 7, 3), F.lit("-"), pad(cust % 100, 2)),
        F.concat((cents % 97).cast("string"), F.lit(","), (cents % 10).cast("string"), F.lit("%")),
        F.concat((cents % 990 + 10).cast("string"), F.lit(" g")),
        F.col("o_orderpriority"),
    )
    t = o.select(key.alias("doc_id"), F.posexplode(words).alias("pos", "text"))
    return t.select("doc_id", "pos", (F.col("pos") + 1).cast("long").alias("token_id"), "text", F.lit(None).cast(
        "struct<x_min:double,y_min:double,x_max:double,y_max:double>").alias("box"), F.lit(0.8).alias("confidence"), F.lit(0.0).alias("page_w"), F.lit(0.0).alias("page_h"))


RECORDS_SQL = """
o AS (
  SELECT o_orderkey AS doc_id, o_custkey, o_orderdate, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0') AS k, lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS c2
  FROM orders),
records AS (
  SELECT doc_id, unnest(range(0, 10)) AS pos, unnest([
    CASE WHEN doc_id % 2 = 0 THEN 'Remuneração' ELSE 'Total' END,
    (cents // 100) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0'),
    'R$ ' || ((cents // 100) % 1000) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0'),
    'em ' || strftime(o_orderdate, '%d/%m/%Y'),
    lpad(CAST(doc_id % 10000000 AS VARCHAR), 7, '0') || '-' || c2 || '.' || strftime(o_orderdate, '%Y'),
    substr(k, 1, 2) || '.' || substr(k, 3, 3) || '.' || substr(k, 6, 3) || '/0001-' || c2,
    substr(k, 1, 3) || '.' || substr(k, 4, 3) || '.' || substr(k, 7, 3) || '-' || c2,
    (cents % 97) || ',' || (cents % 10) || '%',
    (cents % 990 + 10) || ' g',
    o_orderpriority]) AS text
  FROM o)
"""


def _line_key() -> Column:
    """A line item's place in its order; line numbers repeat."""
    return F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey") % 10**5


def flyer_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as cards of flyer pages (doc_id, _k, cards): name, pack, measure and price as an array of texts with their boxes."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_type")
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long") % 1000000 + 50
    price = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    n = F.col("l_linenumber") - 1
    x, y = (n % 3) * 600.0 + 50.0, F.floor(n / 3) * 700.0 + 500.0
    piece = lambda text, dx, dy, w, h: F.struct(text.alias("text"), (x + dx).alias("x"), (y + dy).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    sign = F.when(F.col("l_discount") >= 0.05, F.concat(F.lit("R$ "), price)).otherwise(price)
    cards = F.array(
        piece(F.col("p_name"), 0.0, 0.0, 300.0, 30.0), piece(F.lower("p_type"), 0.0, 40.0, 200.0, 30.0),
        piece(F.concat(F.lit("pacote "), (F.col("p_size") * 10).cast("string"), F.lit("g")), 0.0, 80.0, 200.0, 30.0),
        piece(sign, 20.0, 130.0, 180.0, 60.0), piece(F.lit("cada"), 210.0, 160.0, 60.0, 30.0))
    return j.select(F.col("l_orderkey").alias("doc_id"), (_line_key() * 5).alias("_k"), cards.alias("cards"))


def flyer_box(c: Column) -> Column:
    return B.box(c["x"], c["y"], c["x"] + c["w"], c["y"] + c["h"])


def flyer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as flyer pages: each line item is a card with name, pack, measure and price."""
    t = flyer_cards(spark, sf).select("doc_id", "_k", F.posexplode("cards").alias("at", "c"))
    return t.select(
        "doc_id", (F.col("_k") + F.col("at")).alias("pos"), (F.col("_k") + F.col("at")).alias("token_id"),
        "c.text", flyer_box(F.col("c")).alias("box"),
        F.lit(0.8).alias("confidence"), F.lit(1900.0).alias("page_w"), F.lit(2900.0).alias("page_h"))


def extractor_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as two extractors see an order: the new one renames, re-prices, misses and adds some."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    j = li.join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    price = T.round_half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    unit = F.concat(F.col("p_size").cast("string"), F.lit(" un"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")]
    j = numbered(j, order, "pos", ("l_orderkey",))
    # made once per row, whatever a side needs, so that both sides read the same shuffle
    base = once(j.withColumnRenamed("l_orderkey", "doc_id"), {"name": F.col("p_name"), "type": F.col("p_type"), "price": price, "unit": unit}).withColumn(
        "pos", F.col("pos").cast("long"))
    old = base.where(~((F.col("l_returnflag") == "A") & (F.col("l_tax") >= 0.08))).select("doc_id", "pos", "name", "price", "unit")
    new = base.where(~((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08))).select(
        "doc_id", "pos",
        F.when(F.col("l_discount") >= 0.09, F.lower("type")).when(F.col("l_discount") >= 0.07, F.concat_ws(" ", F.lower("type"), "name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("l_tax") == 0.01, F.col("price") + 1).otherwise(F.col("price")).alias("price"),
        F.when(F.col("l_tax") == 0.02, F.lit("1 kg")).otherwise(F.col("unit")).alias("unit"))
    return old, new


def observation_log(spark: SparkSession, sf: str) -> DataFrame:
    """User events as an extractor's observation log."""
    k = F.get_json_object("props", "$.k").cast("long")
    is_kind = lambda t: (F.col("event_type") == t).cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").cast("timestamp").alias("seen_at"),
        F.concat_ws("-", F.col("user_id").cast("string"), k.cast("string")).alias("document_hash"), k.alias("items"),
        is_kind("error").alias("crashes"), is_kind("signup").alias("exceptions"), F.col("value").alias("latency_ms"),
        is_kind("click").alias("fp_generic"), is_kind("view").alias("fn_generic"), is_kind("purchase").alias("price_divergence"),
        (k % 2).alias("unit_divergence"), (k % 3).alias("duplicate"), F.lit(0).cast("long").alias("unresolved"), (k % 5).alias("name_improvement"))


LOG_SQL = """
log AS (
  SELECT event_id AS pos, strftime(ts, '%Y-%m-%d') AS run_id, ts, user_id || '-' || k AS document_hash, k AS items,
    CAST(event_type = 'error' AS INTEGER) AS crashes, CAST(event_type = 'signup' AS INTEGER) AS exceptions, value AS latency_ms,
    CAST(event_type = 'click' AS INTEGER) AS fp_generic, CAST(event_type = 'view' AS INTEGER) AS fn_generic,
    CAST(event_type = 'purchase' AS INTEGER) AS price_divergence, k % 2 AS unit_divergence, k % 3 AS duplicate, 0 AS unresolved, k % 5 AS name_improvement
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events))
"""


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as shop pages: linked data, inline data or plain text, by the part's type."""
    p = table(spark, sf, "part")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    price = F.format_string("%.2f", F.col("p_retailprice"))
    higher = F.format_string("%.2f", F.col("p_retailprice") + 10)
    unit = F.concat(F.col("p_size").cast("string"), F.lit(" un"))
    linked = F.concat(
        F.lit('<html><head><title>Shop</title><script type="application/ld+json">{"@graph":[{"@type":"Product","name":'), q(F.col("p_name")),
        F.lit(',"brand":{"@type":"Brand","name":'), q(F.col("p_brand")), F.lit('},"sku":"P'), F.col("p_partkey").cast("string"),
        F.lit('","size":'), q(unit), F.lit(',"listPrice":"'), higher, F.lit('","offers":{"@type":"Offer","price":"'), price,
        F.lit('"}}]}</script></head><body><h1>buy now</h1></body></html>'))
    inline = F.concat(
        F.lit('<html><head><script>window.item = {"@type":"Product","name":'), q(F.col("p_name")), F.lit(',"productId":"P'), F.col("p_partkey").cast("string"),
        F.lit('","salePrice":'), price, F.lit('};</script></head><body>buy now</body></html>'))
    text = F.concat(
        F.lit('<html><body><ul><li><div class="card"><a href="/p">'), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("</a><span>R$ "),
        F.replace(price, F.lit("."), F.lit(",")), F.lit("</span><button>Comprar</button></div></li></ul></body></html>"))
    return p.select(
        F.col("p_partkey").alias("page_id"), F.lit("shop").alias("source"), F.lit("competitor").alias("role"),
        F.concat(F.lit("https://shop.example.com/product/"), F.col("p_partkey").cast("string")).alias("url"),
        F.when(F.col("p_type") == "ECONOMY", inline).when(F.col("p_type") == "SMALL", text).otherwise(linked).alias("html"), F.lit("").alias("location_note"))
