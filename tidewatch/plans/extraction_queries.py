"""Registered queries on document tokens, anchors, flyers, extractor diffs, gates, history and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import boxes as B, text as T
from ..operators import anchors as A, diff as X, flyer as Y, gates as Q, spatial as S
from ..operators.flyer_pages import product_pages
from ..sources import exports, history as H, landing as L
from ..streaming import feeds
from . import compare_sql, inputs as I
from .lineage import cut, numbered, shared_folder

R = lambda x, n: f"round(CAST({x} AS DECIMAL(28,8)), {n})::DOUBLE"


def _anchor_view(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "token_id", "type", "raw_text", T.round_half_up(F.col("value_num"), 2).alias("value_num"), "value_str", "unit",
                     T.round_half_up(F.col("confidence"), 4).alias("confidence"), "evidence_kind")


def anchors_court_case(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_view(A.court_case(I.record_tokens(spark, sf)))


def anchors_percentage(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_view(A.percentage(I.record_tokens(spark, sf)))


def anchors_salary(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_view(A.salary(I.record_tokens(spark, sf)))


def anchors_tax_id(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_view(A.tax_id(I.record_tokens(spark, sf)))


def anchors_date(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_view(A.calendar_date(I.record_tokens(spark, sf)))


def anchors_measurement(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_view(A.measurement(I.record_tokens(spark, sf)))


def anchors_currency(spark: SparkSession, sf: str) -> DataFrame:
    return A.currency(I.record_tokens(spark, sf)).select("doc_id", "token_id", "value_num", "unit", "evidence_kind", "cadence", "confidence")


def anchors_in_prose(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over the documents' own words."""
    return A.detect_anchors(S.reading_order(S.clean_tokens(I.doc_tokens(spark, sf))), list(A.RULES)).select(
        "doc_id", "anchor_no", "pos", "type", "raw_text", "value_num", "value_str", "rule")


def zone_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = S.clean_tokens(I.grid_tokens(spark, sf), S.flyer_zones(spark), 0.25)
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("pos").alias("place_sum"))


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    t = S.reading_order(S.clean_tokens(I.grid_tokens(spark, sf)))
    return t.select("doc_id", "token_id", F.col("pos").alias("reading_pos"))


def fragment_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose words were read letter by letter in places."""
    t = I.grid_tokens(spark, sf)
    t = t.withColumn("box", B.box(
        F.when(F.length("text") <= 2, F.col("box.x_min") - 40).otherwise(F.col("box.x_min")), F.col("box.y_min"), F.col("box.x_max"), F.col("box.y_max")))
    return S.merge_fragments(t).select("doc_id", "pos", "token_id", "text", F.size("merged").alias("parts"))


def letter_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same without geometry: runs of single letters become words."""
    return S.merge_fragments(I.doc_tokens(spark, sf)).select("doc_id", "pos", "token_id", "text", F.size("merged").alias("parts"))


def _grid_regions(spark, sf):
    t = I.grid_tokens(spark, sf)
    anchors = t.where(F.length("text") >= 12).withColumn("anchor_no", F.col("pos"))
    return t, anchors, S.anchor_regions(t, anchors, 0.22, 0.10)


def token_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Every word goes to the nearest long word in reach."""
    return _grid_regions(spark, sf)[2].select("doc_id", "token_id", "anchor_no", T.round_half_up(F.col("distance"), 4).alias("distance"))


def unassigned_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t, anchors, assigned = _grid_regions(spark, sf)
    return S.unassigned_tokens(t, anchors, assigned).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("tokens"))


def leftover_region(spark: SparkSession, sf: str) -> DataFrame:
    t, anchors, assigned = _grid_regions(spark, sf)
    return S.leftover_region(t, anchors, assigned, first=15).select("doc_id", "token_id", "region")


def region_boxes(spark: SparkSession, sf: str) -> DataFrame:
    _, anchors, assigned = _grid_regions(spark, sf)
    r = S.regions(assigned, anchors)
    return r.select("doc_id", "region_no", "anchor_no", "token_count", *[F.col(f"region_box.{c}").alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


def sequential_regions(spark: SparkSession, sf: str) -> DataFrame:
    t = I.record_tokens(spark, sf)
    anchors = t.where(F.col("text").rlike(r"^\d+,\d+$|%$")).select("doc_id", "token_id")
    return S.sequential_regions(t, anchors).select("doc_id", "token_id", "anchor_no")


def generic_entities(spark: SparkSession, sf: str) -> DataFrame:
    t = I.record_tokens(spark, sf)
    anchors = cut(A.detect_anchors(t, ["currency", "percentage"]))
    return Y.generic_rows(S.sequential_regions(t, anchors), anchors).drop("values")


def flyer_products(spark: SparkSession, sf: str) -> DataFrame:
    return Y.extract_flyers(I.flyer_tokens(spark, sf))[0].select(
        "doc_id", "region_no", "name", "measure", "condition", "value", "currency", "evidence_kind", "confidence", "absorbed")


def flyer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return Y.extract_flyers(I.flyer_tokens(spark, sf))[1]


def flyer_price_items(spark: SparkSession, sf: str) -> DataFrame:
    return Y.price_items(Y.extract_flyers(I.flyer_tokens(spark, sf))[0], "Shop A")


def ocr_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Flyer pages as OCR documents, read back as tokens."""
    b = lambda c: F.col(f"box.{c}").alias(c)
    d = F.struct(F.col("token_id").alias("id"), F.col("text").alias("texto"), b("x_min"), b("y_min"), b("x_max"), b("y_max"), F.col("confidence").alias("confianca"))
    files = I.flyer_tokens(spark, sf).groupBy(F.col("doc_id").alias("arquivo")).agg(F.array_sort(F.collect_list(d)).alias("deteccoes"))
    t = L.ocr_tokens(files)
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"), F.max("pos").alias("last_pos"))


def card_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a prior extractor's cards."""
    old, _ = I.extractor_items(spark, sf)
    price = F.replace(F.format_string("R$ %.2f", F.col("price")), F.lit("."), F.lit(","))
    card = F.struct("pos", F.struct(price.alias("texto")).alias("preco"), F.array(F.struct(F.col("name").alias("texto")), F.struct(F.col("unit").alias("texto")), F.struct(F.lit("extra").alias("texto"))).alias("textos"))
    files = old.groupBy(F.col("doc_id").alias("arquivo")).agg(F.array_sort(F.collect_list(card)).alias("c")).select("arquivo", F.transform("c", lambda x: x.dropFields("pos")).alias("cards"))
    return L.card_items(files, "Shop A").select("doc_id", "name", "price", "availability", "price_confidence")


def _diff(spark, sf):
    old, new = I.extractor_items(spark, sf)
    return X.compare_extractors(old, new), old, new


def extractor_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)[0]


def diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.class_counts(_diff(spark, sf)[0])


def shadow_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, old, new = _diff(spark, sf)
    return X.shadow_report(X.shadow_classes(rows), old, new)


def divergences(spark: SparkSession, sf: str) -> DataFrame:
    return X.divergences(_diff(spark, sf)[0])


def item_totals(spark: SparkSession, sf: str) -> DataFrame:
    return X.item_totals(*I.extractor_items(spark, sf))


def repeated_items(spark: SparkSession, sf: str) -> DataFrame:
    return X.repeated_items(I.extractor_items(spark, sf)[1])


def _gold(spark, sf):
    """Prices of an order's items as labels; the extractor reads some a few cents off, misses some and sees some twice."""
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    j = li.join(I.table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")]
    price = T.round_half_up(F.col("l_extendedprice") / F.col("l_quantity") % 3, 2)
    j = numbered(j.select("*", F.col("l_orderkey").alias("doc_id"), price.alias("price")), order, "pos")
    value = lambda c: T.round_half_up(c, 2).cast("string")
    gold = j.where(F.col("l_returnflag") != "R").select("doc_id", (F.col("pos") * 2).alias("pos"), F.col("p_type").alias("entity"), value(F.col("price")).alias("value"))
    cents = (F.col("l_quantity").cast("int") % 4) * 0.01
    read = j.where(F.col("l_tax") < 0.08).select("doc_id", (F.col("pos") * 2).alias("pos"), F.col("p_type").alias("entity"), value(F.col("price") + cents).alias("value"))
    twice = j.where(F.col("l_discount") >= 0.09).select("doc_id", (F.col("pos") * 2 + 1).alias("pos"), F.col("p_type").alias("entity"), value(F.col("price")).alias("value"))
    return read.unionByName(twice), gold


def gold_eval(spark: SparkSession, sf: str) -> DataFrame:
    m = X.gold_metrics(X.evaluate_gold(*_gold(spark, sf), scope="doc_id"))
    return m.select("scope", "true_positive", "false_positive", "false_negative", "duplicated", *[T.round_half_up(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1", "duplicate_rate")])


def gold_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every error of the same comparison, with the found value's and the label's place."""
    return X.gold_errors(X.match_gold(*_gold(spark, sf), scope="doc_id"))


def ops_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.operational_summary(I.observation_log(spark, sf))


def latest_observations(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latest_observations(I.observation_log(spark, sf)).select("document_hash", "pos", "run_id", "items", "latency_ms")


def _timings(spark, sf):
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 10000).alias("old_ms"), (F.col("o_totalprice") / 20000).alias("new_ms"),
                                               (F.col("o_orderstatus") == "P").alias("crashed"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latencies(_timings(spark, sf), "new_ms", "new_", ("crashed",))


def gates(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve gates, with what the run did to its input tables and to the prior extractor, and whether a second run agrees."""
    old, new = I.extractor_items(spark, sf)
    deal = lambda df, execution: df if execution == 1 else df.repartition(7, "name")
    job = lambda execution: X.compare_extractors(deal(old, execution), deal(new, execution))
    read = lambda: {name: I.table(spark, sf, name) for name in ("lineitem", "part")}
    rows, checks = Q.run_checks(job, read, lambda: I.extractor_items(spark, sf)[0])
    return Q.gate_rows(Q.gate_totals(rows, old, new, _timings(spark, sf), X.repeated_items(new)), checks)


def gate_decision(spark: SparkSession, sf: str) -> DataFrame:
    return Q.decide(gates(spark, sf))


def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return Q.table_digest(I.table(spark, sf, "lineitem").drop("l_shipdate")).select("rows", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


def history_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of price snapshots written to history, the second read against the first."""
    h = H.History(spark, shared_folder(spark))
    s = I.snapshots(spark, sf).withColumns({"product_name": F.col("product_key"), "url": F.lit(""), "pos": F.col("product_id")})
    empty = spark.createDataFrame([], "fingerprint string, url string, title string, category string, score double, is_current boolean, body string, id long")
    none = spark.createDataFrame([], "event_id string, kind string, title string, importance int, evidence_ids array<long>")
    h.save_price_snapshots("r1997", s.where("run = 1997"), "1997-12-31")
    h.save_run("r1997", empty, none, "1997-12-31")
    return h.save_price_snapshots("r1998", s.where("run = 1998"), "1998-12-31", limit=None).select(
        "entity", "product_key", "previous_price", "current_price", T.round_half_up(F.col("change_pct"), 2).alias("change_pct"), "promotion_now")


def _run_stream(spark: SparkSession, rows: DataFrame, feed) -> DataFrame:
    """Run ``feed`` over what has landed, close it, and read what it wrote."""
    out = shared_folder(spark)
    stream = feed(feeds.closing(rows, f"{out}/end"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    try:
        for last in (False, True):
            if last:
                feeds.close(spark, f"{out}/end")
            stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _price_points(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("entity"), F.lit("shop.example.com").alias("source_domain"), F.col("event_type").alias("product_key"),
        F.col("ts").cast("timestamp").alias("seen_at"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("int") > 80).alias("promotion"))


def _landed_events(spark: SparkSession, sf: str) -> DataFrame:
    schema = I.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def price_change_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _run_stream(spark, _price_points(_landed_events(spark, sf)), feeds.price_change_feed).withColumns(
        {"change_pct": T.round_half_up(F.col("change_pct"), 2), "seen_at": F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss")})


def price_change_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The same feed computed in batch."""
    return feeds.price_change_batch(_price_points(I.table(spark, sf, "events"))).withColumns(
        {"change_pct": T.round_half_up(F.col("change_pct"), 2), "seen_at": F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss")})


def _operations(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("ts").cast("timestamp").alias("seen_at"), F.concat_ws("-", (F.col("user_id") % 20).cast("string"), k.cast("string")).alias("document_hash"), k.alias("items"),
        (F.col("event_type") == "error").cast("long").alias("crashes"), (F.col("event_type") == "signup").cast("long").alias("exceptions"), F.col("value").alias("latency_ms"))


def ops_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily metrics of a stream, every day closed."""
    return _run_stream(spark, _operations(_landed_events(spark, sf)), feeds.operations_feed).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def ops_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.windowed_metrics(_operations(I.table(spark, sf, "events"))).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def source_export(spark: SparkSession, sf: str) -> DataFrame:
    """The export sheet of the sources, accents folded for Latin-1 readers."""
    from .radar_queries import _sources

    return exports.latin1_sheet(exports.source_sheet(_sources(spark, sf)))


def card_export(spark: SparkSession, sf: str) -> DataFrame:
    """Flyer products in the card layout, one document per page."""
    docs = exports.page_documents(product_pages(I.flyer_tokens(spark, sf)))
    return docs.select("arquivo", "total_cards", F.xxhash64(F.to_json("cards")).alias("cards_hash"))


QUERIES = {f.__name__: f for f in (
    anchors_court_case, anchors_percentage, anchors_salary, anchors_tax_id, anchors_date, anchors_measurement, anchors_currency, anchors_in_prose,
    zone_filter, reading_order, fragment_merge, letter_runs, token_regions, unassigned_tokens, leftover_region, region_boxes, sequential_regions,
    generic_entities, flyer_products, flyer_metrics, flyer_price_items, ocr_scan, card_scan, extractor_diff, diff_counts, shadow_report, divergences,
    item_totals, repeated_items, gold_eval, gold_errors, ops_summary, latest_observations, latency_percentiles, gates, gate_decision, table_digest, history_round_trip,
    price_change_stream, price_change_replay, ops_stream, ops_by_day, source_export, card_export)}

NUM = "CAST(NULL AS DOUBLE)"
REC = lambda where, typ, val_num, val_str, unit, conf, kind, raw="text": (
    f"WITH {I.RECORDS_SQL} SELECT doc_id, pos + 1 AS token_id, '{typ}' AS type, {raw} AS raw_text, {val_num} AS value_num, {val_str} AS value_str, {unit} AS unit, {conf}::DOUBLE AS confidence, "
    f"'{kind}' AS evidence_kind FROM records WHERE {where}")
CASE_RE = r"\b(\d{7}-\d{2}\.\d{4}(?:\.\d\.\d{2}\.\d{4})?|\d{7}-\d{2}\.\d{4})\b"
PCT_RE = r"([+-]?\d+(?:[.,]\d+)?)\s*%"
SAL_RE = r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d{3,6}(?:,\d{2})?)"
CNPJ_RE = r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
CPF_RE = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
DATE_RE = r"\b(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})\b"
MEAS_RE = r"(?i)(\b\d+(?:[.,]\d+)?\s*(?:kg|g|mg|ml|l|litros?|sach[eê]s?|c[aá]psulas?|unidades?|un|cm|mm|m)\b|\b\d+x\d+(?:[.,]\d+)?\s*(?:g|ml|cm|mm)?\b)"
TXT = "CAST(NULL AS VARCHAR)"
FRAGMENTS_SQL = f"""
WITH RECURSIVE {I.GRID_SQL},
f AS (SELECT doc_id, pos, text, pos // 12 AS line, CASE WHEN length(text) <= 2 THEN x1 - 40 ELSE x1 END AS a, x2 FROM grid),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY a, pos) AS k FROM f),
scan(doc_id, line, k, pos, text, word, reach, letters) AS (
  SELECT doc_id, line, k, pos, text, 1, x2, length(text) FROM o WHERE k = 1
  UNION ALL
  SELECT doc_id, line, k, pos, text, CASE WHEN joins THEN word ELSE word + 1 END, CASE WHEN joins THEN greatest(reach, x2) ELSE x2 END,
    CASE WHEN joins THEN letters + length(text) ELSE length(text) END
  FROM (SELECT o.*, s.word, s.reach, s.letters, o.a - s.reach BETWEEN -8 AND 16 * 0.45 * CASE WHEN s.letters = 1 OR length(o.text) = 1 THEN 1.8 ELSE 1 END AS joins
    FROM scan s JOIN o ON o.doc_id = s.doc_id AND o.line = s.line AND o.k = s.k + 1)),
w AS (SELECT doc_id, line, word, arg_min(pos, k) AS token_id, string_agg(text, '' ORDER BY k) AS text, count(*) AS parts FROM scan GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, word) AS pos, token_id, text, parts FROM w
"""
LETTERS_SQL = f"""
WITH {I.DOC_TOKENS_SQL},
l0 AS (SELECT doc_id, pos, text, regexp_matches(text, '^[\\p{{L}}\\p{{N}}]$') AS solo FROM doc_tokens),
l1 AS (SELECT *, CASE WHEN solo THEN pos - row_number() OVER (PARTITION BY doc_id, solo ORDER BY pos) ELSE pos END AS run FROM l0),
l2 AS (SELECT doc_id, solo, run, min(pos) AS token_id, string_agg(text, '' ORDER BY pos) AS text, count(*) AS parts FROM l1 GROUP BY doc_id, solo, run)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY token_id) AS pos, token_id, text, parts FROM l2
"""
ITEMS_SQL = """
base AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey % 100000 AS pos, p_name AS name, lower(p_type) AS kind, round(CAST(l_extendedprice / l_quantity AS DECIMAL(28,8)), 2)::DOUBLE AS price,
  p_size || ' un' AS unit, l_discount, l_tax, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
olds AS (SELECT * FROM base WHERE NOT (l_returnflag = 'A' AND l_tax >= 0.08)), news AS (SELECT * FROM base WHERE NOT (l_returnflag = 'R' AND l_tax >= 0.08))
"""
SUMS = ", ".join(f"CAST(sum({q}) AS BIGINT) AS {q}" for q in Q.QUALITY)
LAT = lambda c, p="": ", ".join(f"{R(f'quantile_cont({c}, {x})', 2)} AS {p}p{int(x * 100)}" for x in (0.5, 0.95, 0.99)) + f", {R(f'max({c})', 2)} AS {p}max"

NEAR_SQL = f"""WITH {I.GRID_SQL},
g AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM grid), a AS (SELECT doc_id, pos AS anchor_no, cx AS ax, cy AS ay FROM g WHERE length(text) >= 12),
j AS (SELECT g.doc_id, g.pos AS token_id, anchor_no, sqrt(power(abs(cx - ax) * 1.6, 2) + power(abs(cy - ay) * CASE WHEN cy <= ay THEN 1.0 ELSE 2.0 END, 2)) AS distance
  FROM g JOIN a ON g.doc_id = a.doc_id AND abs(cx - ax) <= 0.22 * page_w AND abs(cy - ay) <= 0.10 * page_h WHERE length(text) < 12),
near AS (SELECT doc_id, token_id, arg_min(anchor_no, round(distance, 6) * 100000 + anchor_no / 1000000.0) AS anchor_no, min(distance) AS distance FROM j GROUP BY 1, 2)"""
FREE = "(SELECT g.doc_id, g.pos AS token_id FROM g WHERE length(text) < 12 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.doc_id = g.doc_id AND n.token_id = g.pos))"

GOLD_SQL = """WITH RECURSIVE j AS (SELECT l.*, CAST(l_orderkey AS VARCHAR) AS scope, p_type AS entity, round(CAST(l_extendedprice / l_quantity % 3 AS DECIMAL(28, 8)), 2)::DOUBLE AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS n FROM lineitem l JOIN part ON p_partkey = l_partkey),
g AS (SELECT scope, entity, n * 2 AS pos, price AS v FROM j WHERE l_returnflag <> 'R'),
f AS (SELECT scope, entity, n * 2 AS pos, round(CAST(price + (CAST(l_quantity AS INTEGER) % 4) * 0.01::DOUBLE AS DECIMAL(28, 8)), 2)::DOUBLE AS v FROM j WHERE l_tax < 0.08
  UNION ALL SELECT scope, entity, n * 2 + 1, price FROM j WHERE l_discount >= 0.09),
e AS (SELECT *, row_number() OVER (PARTITION BY scope, entity ORDER BY pos) AS k FROM f),
labels AS (SELECT scope, entity, list({'p': pos, 'v': v} ORDER BY pos) AS all_g FROM g GROUP BY 1, 2),
scan(scope, entity, k, used, e_pos, g_pos, near) AS (
  SELECT DISTINCT scope, entity, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM e
  UNION ALL
  SELECT scope, entity, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, pos, hit, near FROM (
    SELECT s.scope, s.entity, e.k, s.used, e.pos, list_filter(all_g, lambda x: abs(x.v - e.v) <= 0.02::DOUBLE AND NOT list_contains(s.used, x.p))[1].p AS hit,
      list_filter(all_g, lambda x: abs(x.v - e.v) <= 0.02::DOUBLE)[-1].p AS near
    FROM scan s JOIN e ON e.scope = s.scope AND e.entity = s.entity AND e.k = s.k + 1 LEFT JOIN labels l ON l.scope = s.scope AND l.entity = s.entity)),
matched AS (
  SELECT scope, entity, CASE WHEN g_pos IS NOT NULL THEN 'acerto' WHEN near IS NOT NULL THEN 'duplicacao' ELSE 'falso_positivo' END AS outcome, e_pos, coalesce(g_pos, near) AS g_pos FROM scan WHERE k > 0
  UNION ALL SELECT scope, entity, 'falso_negativo', NULL, pos FROM g WHERE NOT EXISTS (SELECT 1 FROM scan s WHERE s.scope = g.scope AND s.entity = g.entity AND s.g_pos = g.pos))"""

ORACLES = {
    "anchors_court_case": REC(f"regexp_matches(text, '{CASE_RE}')", "LEGAL_PROCESS", NUM, f"regexp_extract(text, '{CASE_RE}', 1)", "'PROCESSO_CNJ'", "0.9", "temporal_code"),
    "anchors_percentage": REC(f"regexp_matches(text, '{PCT_RE}')", "PERCENTAGE", R(f"CAST(replace(regexp_extract(text, '{PCT_RE}', 1), ',', '.') AS DOUBLE)", 2), TXT, "'PERCENT'", "0.85", "bare_decimal"),
    "anchors_salary": (
        f"WITH {I.RECORDS_SQL}, r AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before, regexp_extract(text, '{SAL_RE}', 1) AS m FROM records), "
        "v AS (SELECT *, TRY_CAST(replace(replace(m, '.', ''), ',', '.') AS DOUBLE) AS x FROM r WHERE m <> '' AND (contains(text, '$') OR regexp_matches(coalesce(before, ''), '(?i)remunera[cç][aã]o'))) "
        f"SELECT doc_id, pos + 1 AS token_id, 'SALARY' AS type, text AS raw_text, {R('x', 2)} AS value_num, {TXT} AS value_str, 'BRL' AS unit, 0.95::DOUBLE AS confidence, 'bare_decimal' AS evidence_kind FROM v WHERE x >= 500"),
    "anchors_tax_id": (
        f"WITH {I.RECORDS_SQL} SELECT doc_id, pos + 1 AS token_id, 'TAX_ID' AS type, text AS raw_text, {NUM} AS value_num, coalesce(nullif(regexp_extract(text, '{CNPJ_RE}'), ''), regexp_extract(text, '{CPF_RE}')) AS value_str, "
        f"CASE WHEN regexp_matches(text, '{CNPJ_RE}') THEN 'CNPJ' ELSE 'CPF' END AS unit, 0.8::DOUBLE AS confidence, 'temporal_code' AS evidence_kind FROM records WHERE regexp_matches(text, '{CNPJ_RE}') OR regexp_matches(text, '{CPF_RE}')"),
    "anchors_date": REC(f"regexp_matches(text, '{DATE_RE}')", "DATE", NUM, f"regexp_extract(text, '{DATE_RE}', 1)", "'DATE_ISO'", "0.8", "temporal_code"),
    "anchors_measurement": REC(f"regexp_matches(text, '{MEAS_RE}')", "MEASUREMENT", NUM, f"regexp_extract(text, '{MEAS_RE}', 1)", TXT, "0.8", "specification", f"regexp_extract(text, '{MEAS_RE}', 1)"),
    "zone_filter": f"""WITH {I.GRID_SQL}, c AS (SELECT *, (y1 + y2) / 2 / page_h AS cy, (x1 + x2) / 2 / page_w AS cx FROM grid WHERE confidence >= 0.25)
SELECT doc_id, count(*) AS tokens, CAST(sum(pos) AS BIGINT) AS place_sum FROM c WHERE NOT (cx BETWEEN 0 AND 1 AND (cy BETWEEN 0 AND 0.12 OR cy BETWEEN 0.88 AND 1)) GROUP BY doc_id""",
    "reading_order": f"""WITH {I.GRID_SQL}, c AS (SELECT *, floor((y1 + y2) / 2 / page_h / 0.02) AS line, (x1 + x2) / 2 / page_w AS cx FROM grid WHERE confidence >= 0.20)
SELECT doc_id, pos AS token_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, cx, pos) AS reading_pos FROM c""",
    "token_regions": NEAR_SQL + f" SELECT doc_id, token_id, anchor_no, {R('distance', 4)} AS distance FROM near",
    "unassigned_tokens": NEAR_SQL + f" SELECT doc_id, 'distancia_excessiva' AS reason, count(*) AS tokens FROM {FREE} GROUP BY doc_id",
    "region_boxes": NEAR_SQL + f""", own AS (SELECT g.doc_id, g.pos AS anchor_no, x1, y1, x2, y2, cx, cy, page_h FROM g WHERE length(text) >= 12),
b AS (SELECT doc_id, anchor_no, x1, y1, x2, y2 FROM own UNION ALL SELECT n.doc_id, n.anchor_no, x1, y1, x2, y2 FROM near n JOIN g ON g.doc_id = n.doc_id AND g.pos = n.token_id),
e AS (SELECT doc_id, anchor_no, min(x1) AS x_min, min(y1) AS y_min, max(x2) AS x_max, max(y2) AS y_max FROM b GROUP BY 1, 2), c AS (SELECT doc_id, anchor_no, count(*) AS token_count FROM near GROUP BY 1, 2)
SELECT doc_id, anchor_no, token_count, x_min, y_min, x_max, y_max, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(floor(cy / (0.15 * page_h)) AS INTEGER), cx, anchor_no) AS region_no
FROM c JOIN e USING (doc_id, anchor_no) JOIN own USING (doc_id, anchor_no)""",
    "repeated_items": f"""WITH {ITEMS_SQL}, m AS (SELECT doc_id, CASE WHEN l_discount >= 0.09 THEN kind WHEN l_discount >= 0.07 THEN kind || ' ' || name ELSE name END AS name, CASE WHEN l_tax = 0.01 THEN price + 1 ELSE price END AS price FROM news),
r AS (SELECT doc_id, {I.norm_sql('name')} AS n, price, count(*) - 1 AS extra FROM m GROUP BY 1, 2, 3) SELECT doc_id, CAST(sum(extra) AS BIGINT) AS duplicate FROM r GROUP BY 1""",
    "fragment_merge": FRAGMENTS_SQL,
    "letter_runs": LETTERS_SQL,
    "leftover_region": NEAR_SQL + f" SELECT doc_id, token_id, 'regiao_sem_ancora_1' AS region FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token_id) AS rn FROM {FREE}) WHERE rn <= 15",
    "sequential_regions": f"""WITH {I.RECORDS_SQL}, t AS (SELECT *, regexp_matches(text, '^\\d+,\\d+$|%$') AS is_anchor FROM records),
n AS (SELECT doc_id, count(*) FILTER (is_anchor) AS n, count(*) FILTER (NOT is_anchor) AS m FROM t GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM t WHERE NOT is_anchor)
SELECT doc_id, pos + 1 AS token_id, least((k - 1) // greatest(1, m // n), n - 1) + 1 AS anchor_no FROM f JOIN n USING (doc_id) WHERE n > 0""",
    "ocr_scan": """SELECT l_orderkey AS doc_id, count(*) * 5 AS tokens, max((l_linenumber - 1) % 3 * 600.0 + 50 + 300)::DOUBLE AS page_w, max(floor((l_linenumber - 1) / 3) * 700.0 + 500 + 190)::DOUBLE AS page_h,
 count(*) * 5 - 1 AS last_pos FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""",
    "card_scan": f"WITH {ITEMS_SQL} SELECT doc_id, name || ' ' || unit AS name, price, 'in_stock' AS availability, 0.8::DOUBLE AS price_confidence FROM olds",
    "item_totals": f"WITH {ITEMS_SQL} SELECT doc_id, CAST(sum(o) AS BIGINT) AS total_old, CAST(sum(n) AS BIGINT) AS total_new FROM (SELECT doc_id, 1 AS o, 0 AS n FROM olds UNION ALL SELECT doc_id, 0, 1 FROM news) GROUP BY 1",
    "gold_eval": GOLD_SQL + f""", c AS (SELECT scope, count(*) FILTER (outcome = 'acerto') AS tp, count(*) FILTER (outcome = 'falso_positivo') AS fp, count(*) FILTER (outcome = 'falso_negativo') AS fn,
  count(*) FILTER (outcome = 'duplicacao') AS d FROM matched GROUP BY 1),
m AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS p, tp / greatest(1, tp + fn)::DOUBLE AS r, d / greatest(1, tp + fp + d)::DOUBLE AS dr FROM c)
SELECT scope, tp AS true_positive, fp AS false_positive, fn AS false_negative, d AS duplicated, {R('p', 6)} AS precision, {R('r', 6)} AS recall,
 {R('CASE WHEN p + r > 0 THEN 2 * p * r / greatest(0.0001::DOUBLE, p + r) ELSE 0 END', 6)} AS f1, {R('dr', 6)} AS duplicate_rate FROM m""",
    "gold_errors": GOLD_SQL + " SELECT scope, entity, outcome, e_pos, g_pos FROM matched WHERE outcome <> 'acerto'",
    "ops_summary": f"""WITH {I.LOG_SQL} SELECT count(*) AS records, count(DISTINCT document_hash) AS documents, CAST(sum(items) AS BIGINT) AS items, CAST(sum(crashes) AS BIGINT) AS crashes, CAST(sum(exceptions) AS BIGINT) AS errors,
 {SUMS}, {LAT('latency_ms')} FROM log""",
    "latest_observations": f"WITH {I.LOG_SQL} SELECT document_hash, max(pos) AS pos, arg_max(run_id, pos) AS run_id, arg_max(items, pos) AS items, arg_max(latency_ms, pos) AS latency_ms FROM log GROUP BY 1",
    "latency_percentiles": f"SELECT o_orderstatus = 'P' AS crashed, {LAT('o_totalprice / 20000', 'new_')} FROM orders GROUP BY 1",
    "history_round_trip": f"""WITH {I.SNAPSHOTS_SQL}, c AS (SELECT a.entity, a.product_key, b.price AS previous_price, a.price AS current_price, (a.price - b.price) / b.price * 100 AS pct, b.promotion AS pb, a.promotion AS promotion_now
  FROM snapshots a JOIN snapshots b ON a.entity = b.entity AND a.product_key = b.product_key AND a.run = 1998 AND b.run = 1997 WHERE b.price <> 0)
SELECT entity, product_key, previous_price, current_price, {R('pct', 2)} AS change_pct, promotion_now FROM c WHERE abs(pct) >= 0.5 OR pb <> promotion_now""",
}
ORACLES |= compare_sql.ORACLES
_FEED = f"""WITH p AS (SELECT 'user' || user_id AS entity, 'shop.example.com' AS source_domain, event_type AS product_key, ts, value AS price, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) > 80 AS promotion FROM events),
l AS (SELECT *, lag(price) OVER w AS pp, lag(promotion) OVER w AS pb FROM p WINDOW w AS (PARTITION BY entity, product_key ORDER BY ts, price)), c AS (SELECT *, (price - pp) / nullif(pp, 0) * 100 AS pct FROM l)
SELECT entity, source_domain, product_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at, pp AS previous_price, price AS current_price, {R('pct', 2)} AS change_pct, pb AS promotion_before, promotion AS promotion_now
FROM c WHERE pct IS NOT NULL AND (abs(pct) >= 0.5 OR pb <> promotion)"""
ORACLES["price_change_stream"] = ORACLES["price_change_replay"] = _FEED
ORACLES["ops_stream"] = ORACLES["ops_by_day"] = f"""WITH {I.LOG_SQL}, d AS (SELECT (event_id_user % 20) || '-' || items AS hash, date_trunc('day', ts) AS day, * FROM (
  SELECT l.*, CAST(split_part(document_hash, '-', 1) AS BIGINT) AS event_id_user FROM log l)),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day, hash ORDER BY ts, items, crashes, exceptions, latency_ms) = 1)
SELECT strftime(day, '%Y-%m-%d') AS window_start, count(*) AS documents, CAST(sum(items) AS BIGINT) AS items, CAST(sum(crashes) AS BIGINT) AS crashes,
 CAST(sum(exceptions) AS BIGINT) AS exceptions, {LAT('latency_ms')} FROM f GROUP BY day"""
