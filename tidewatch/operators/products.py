"""Product rows from landed pages: linked data, inline data and priced text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.markup import MONEY, price_contexts
from ..plans.lineage import cut, first_by, once
from ..rules import NOT_A_PRICE_WORDS, TEXT_PRICE_WORDS, PageRules
from .pages import COMMERCIAL_TYPES, page_title, strip_tags, typed_pages

# Object keys read for each field, in order.
PRICE_KEYS = ("price", "lowPrice", "salePrice", "sellingPrice", "bestPrice", "currentPrice", "value")
OFFER_KEYS = ("price", "lowPrice", "priceSpecification")
OLD_PRICE_KEYS = ("oldPrice", "listPrice", "compareAtPrice", "originalPrice")
NAME_KEYS = ("name", "productName", "title")
UNIT_KEYS = ("unit", "size", "quantity")
# Fixed value: characters below which a script holds no object.
SHORTEST_SCRIPT = 20
# Links that name a product told in text, and letters of such a name.
NAME_LINKS, NAME_LETTERS = 3, (5, 180)
CODE_KEYS = ("sku", "productId", "gtin", "gtin13", "mpn")

ITEM_COLUMNS = [
    "source", "role", "name", "url", "price", "old_price", "promotion", "brand", "unit", "sku",
    "location_note", "evidence_url", "page_type", "price_confidence",
]
# How far an inline object reaches on either side of a price key, and how much of a page's text tells its type.
INLINE_REACH, JUDGED_TEXT = 5000, 7000
INLINE_PRODUCT = rf"(?is)(\{{.{{0,{INLINE_REACH}}}?(?:price|salePrice|sellingPrice).{{0,{INLINE_REACH}}}?\}})"


def plausible_price(name: Column, price: Column, context: Column) -> Column:
    """A positive price of at most a million, and no talk of finance or jobs."""
    text = T.normalise(F.concat_ws(" ", name, context))
    return F.coalesce(price > 0, F.lit(False)) & (price <= 1_000_000) & ~T.contains_any(text, NOT_A_PRICE_WORDS)


def product_key(name: Column, brand: Column, unit: Column, sku: Column) -> Column:
    """Canonical key of a product."""
    empty = F.lit("")
    return T.normalise(F.concat(*_between([F.coalesce(c, empty) for c in (name, brand, unit, sku)], F.lit(" "))))


def _between(cols: list[Column], gap: Column) -> list[Column]:
    out = [cols[0]]
    for c in cols[1:]:
        out += [gap, c]
    return out


def _get(v: Column, key: str, kind: str = "string") -> Column:
    path = f"$['{key}']"
    return F.try_variant_get(v, path, kind)


def _first_text(v: Column, keys) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_get(v, k)), F.lit("")) for k in keys], F.lit(""))


def first_positive(texts: Column) -> Column:
    """First amount above zero in an array of price texts; nested JSON is no price text."""
    plain = F.filter(texts, lambda t: ~t.rlike(r"^[\[{]"))
    return F.try_element_at(F.filter(F.transform(plain, T.parse_money), lambda p: p > 0), F.lit(1))


def with_price(objects: DataFrame, obj: str = "obj") -> DataFrame:
    """Add ``price`` to objects (page_id, visit, ...): the first amount above zero among the object's own keys, then
    in its offer's price, lowPrice and priceSpecification, then in the offers of a list, and so on inwards.

    Each level of nested offers is written and starts from the one above, for
    the objects whose own keys hold no price; ``_key`` keeps the order of the walk.
    """
    key = ["page_id", "visit"]
    level = cut(objects.select(*key, F.array().cast("array<int>").alias("_key"), F.col(obj).alias("_o")))
    found = []
    while True:
        at = lambda *steps: F.concat("_key", F.array(*[x if isinstance(x, Column) else F.lit(x) for x in steps]).cast("array<int>"))
        own = level.withColumn("price", first_positive(F.array(*[_get(F.col("_o"), k) for k in PRICE_KEYS])))
        found.append(own.where(F.col("price").isNotNull()).select(*key, at(0).alias("_key"), "price"))
        offers = own.where(F.col("price").isNull()).select(*key, "_key", _get(F.col("_o"), "offers", "variant").alias("_offers")).where(F.col("_offers").isNotNull())
        is_object = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT<")
        inner = F.filter(F.array(*[F.struct(at(1, i).alias("_key"), _get(F.col("_offers"), k, "variant").alias("_o"), _get(F.col("_offers"), k).alias("_text"))
                                   for i, k in enumerate(OFFER_KEYS)]), lambda x: x["_o"].isNotNull())
        listed = F.transform(F.coalesce(F.try_variant_get("_offers", "$", "array<variant>"), F.array().cast("array<variant>")),
                             lambda o, i: F.struct(at(2, i).alias("_key"), o.alias("_o"), F.lit(None).cast("string").alias("_text")))
        below = cut(offers.select(*key, F.inline(F.when(is_object(F.col("_offers")), inner).otherwise(listed))))
        nested = is_object(F.col("_o"))
        texts = below.where(~nested).withColumn("price", first_positive(F.array("_text"))).where(F.col("price").isNotNull())
        found.append(texts.select(*key, "_key", "price"))
        level = below.where(nested).select(*key, "_key", "_o")
        if level.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy(*key).agg(F.min_by("price", "_key").alias("price"))
    return objects.join(best, key)


def schema_types(v: Column) -> Column:
    """Normalised type names of an object."""
    of = lambda key: F.coalesce(
        _get(v, key, "array<string>"),
        F.when(F.coalesce(_get(v, key), F.lit("")) != "", F.array(_get(v, key))),
    )
    return F.transform(F.coalesce(of("@type"), of("type"), F.array().cast("array<string>")), T.normalise)


def linked_objects(pages: DataFrame) -> DataFrame:
    """Every JSON object in the pages' linked-data scripts, however deep.

    ``visit`` orders the objects of a page as a walk does that takes the last child
    first. Each level is written and starts from the one above; the walk ends with a
    level that holds nothing.
    """
    scripts = F.regexp_extract_all("html", F.lit(
        r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"))
    raw = (
        pages.where(F.contains("html", F.lit("ld+json")))
        .select("page_id", F.posexplode(scripts).alias("_script", "_raw"))
        .where(F.length("_raw") >= SHORTEST_SCRIPT)
        .select("page_id", F.array(F.col("_script")).alias("visit"), F.try_parse_json("_raw").alias("obj"))
    )
    level, levels = cut(raw.where(F.col("obj").isNotNull())), []
    while not level.isEmpty():
        levels.append(level)
        below = level.where(F.schema_of_variant("obj").rlike("^(OBJECT|ARRAY)<"))
        level = cut(
            below.lateralJoin(below.sparkSession.tvf.variant_explode(F.col("obj").outer()))
            .select("page_id", F.concat("visit", F.array(-F.col("pos"))).alias("visit"), F.col("value").alias("obj"))
        )
    every = reduce(DataFrame.unionByName, levels or [level])
    return every.where(F.schema_of_variant("obj").startswith("OBJECT<"))


def inline_objects(pages: DataFrame) -> DataFrame:
    """Priced JSON objects inside other scripts of commercial pages."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)(<script\b[^>]*>.*?</script>)"))
    s = (
        pages.where((F.col("page_type") == "COMMERCIAL_CANDIDATE") & F.contains(F.lower("html"), F.lit("price")))
        .select("page_id", F.posexplode(scripts).alias("_script", "_tag"))
        .where(~F.col("_tag").rlike(r"(?is)^<script\b[^>]*type\s*=\s*[\"']application/ld\+json"))
        .withColumn("_raw", F.regexp_replace("_tag", r"(?is)^<script\b[^>]*>|</script>$", ""))
        .where(F.length("_raw") >= SHORTEST_SCRIPT)
    )
    found = s.select("page_id", "_script", F.posexplode(F.regexp_extract_all("_raw", F.lit(INLINE_PRODUCT))).alias("_at", "_json"))
    return found.select(
        "page_id", F.array(F.col("_script"), F.col("_at")).alias("visit"), F.try_parse_json("_json").alias("obj")
    ).where(F.col("obj").isNotNull())


def with_page_type(pages: DataFrame, rules: PageRules) -> DataFrame:
    """Pages with their type; blocked and article pages are left out."""
    visible = strip_tags(F.regexp_replace(F.regexp_replace(
        "html", r"(?s)<!--.*?-->", " "), r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", " "))
    read = once(pages, {"_title": page_title(F.col("html")), "_text": F.substring(visible, 1, JUDGED_TEXT)})
    typed = typed_pages(read, "url", "_title", "_text", rules).drop("_title", "_text")
    return typed.where(~F.col("page_type").isin("BLOCKED", "ARTICLE_OR_EMPLOYMENT"))


def object_items(objects: DataFrame, pages: DataFrame, rules: PageRules) -> DataFrame:
    """Objects that describe a product with a believable price, with the confidence in them."""
    v = F.col("obj")
    meta = pages.select("page_id", "source", "role", "url", "location_note", "page_type")
    kinds = schema_types(v)
    brand = F.coalesce(F.try_variant_get(v, "$.brand.name", "string"), F.when(
        ~F.coalesce(F.schema_of_variant(_get(v, "brand", "variant")), F.lit("")).startswith("OBJECT<"), _get(v, "brand")), F.lit(""))
    present = lambda key: F.coalesce(_get(v, key), F.lit("")) != ""
    o = once(objects, {"_types": kinds, "name": _first_text(v, NAME_KEYS), "_offered": _get(v, "offers", "variant").isNotNull() & present("name")})
    o = o.withColumn("_known", F.arrays_overlap("_types", F.array(*[F.lit(t) for t in rules.schema_types])))
    o = o.where((F.col("name") != "") & ((F.size("_types") == 0) | F.col("_known") | F.col("_offered")))
    o = with_price(cut(o)).where(
        plausible_price(F.col("name"), F.col("price"), F.coalesce(_get(v, "description"), F.lit(""))))
    o = once(o, {
        "brand": F.trim(brand), "unit": _first_text(v, UNIT_KEYS), "sku": _first_text(v, CODE_KEYS),
        "old_price": first_positive(F.array(*[_get(v, k) for k in OLD_PRICE_KEYS])),
    }).join(meta, "page_id")
    has_brand = _get(v, "brand", "variant").isNotNull() & (F.coalesce(_get(v, "brand"), F.lit("?")) != "")
    confidence = (
        F.lit(0.40)
        + F.when(F.col("_known"), 0.35).otherwise(0.0)
        + F.when(F.col("sku") != "", 0.10).otherwise(0.0)
        + F.when(F.col("page_type").isin(*COMMERCIAL_TYPES), 0.10).otherwise(0.0)
        + F.when(has_brand, 0.05).otherwise(0.0)
    )
    return (
        o.withColumn("price_confidence", F.least(F.lit(1.0), confidence))
        .where(F.col("price_confidence") >= 0.70)
        .withColumn("promotion", F.coalesce(F.col("old_price") > F.col("price"), F.lit(False)))
        .withColumn("evidence_url", F.col("url"))
        .withColumn("product_key", product_key(F.col("name"), F.col("brand"), F.col("unit"), F.col("sku")))
        .select("page_id", "visit", "product_key", *ITEM_COLUMNS)
    )


def text_items(pages: DataFrame) -> DataFrame:
    """Products told in plain text: a name, a price and a word of commerce in one element."""
    t = (
        pages.where(F.col("page_type").isin(*COMMERCIAL_TYPES) & F.col("html").rlike(r"(?i)R\$"))
        .withColumn("_ctx", price_contexts("html"))
        .select("page_id", "source", "role", "url", "location_note", "page_type", F.posexplode("_ctx").alias("_at", "_c"))
        .withColumn("_text", F.col("_c.context"))
    )
    linked = F.trim(F.array_join(F.slice("_c.links", 1, NAME_LINKS), " "))
    t = once(t, {"price": T.parse_money(F.try_element_at(F.regexp_extract_all("_text", F.lit(MONEY)), F.lit(-1))), "_linked": linked})
    plain = F.regexp_replace("_text", r"R\$\s*[0-9.,]+", " ")
    t = once(t.where(F.col("price").isNotNull()), {"name": T.squeeze(F.when(F.length("_linked") < NAME_LETTERS[0], plain).otherwise(F.col("_linked")))})
    return (
        t.where(F.length("name").between(*NAME_LETTERS) & plausible_price(F.col("name"), F.col("price"), F.col("_text")))
        .where(T.contains_any(T.normalise(F.col("_text")), TEXT_PRICE_WORDS))
        .select(
            "page_id", F.array(F.col("_at")).alias("visit"), T.normalise(F.col("name")).alias("product_key"),
            "source", "role", "name", "url", "price", F.lit(None).cast("double").alias("old_price"),
            F.lit(False).alias("promotion"), F.lit("").alias("brand"), F.lit("").alias("unit"), F.lit("").alias("sku"),
            "location_note", F.col("url").alias("evidence_url"), "page_type", F.lit(0.78).alias("price_confidence"),
        )
    )


def page_products(pages: DataFrame, rules: PageRules = PageRules()) -> DataFrame:
    """Product items of landed pages (page_id, source, role, url, html, location_note), first of each key per page."""
    typed = cut(with_page_type(pages, rules))
    objects = object_items(linked_objects(typed), typed, rules).withColumn("_stage", F.lit(0))
    inline = object_items(inline_objects(typed), typed, rules).withColumn("_stage", F.lit(1))
    texts = text_items(typed).withColumn("_stage", F.lit(2))
    every = objects.unionByName(inline).unionByName(texts)
    return first_by(every, ["page_id", "product_key"], [F.col("_stage"), F.col("visit")], ITEM_COLUMNS)
