"""Registered queries on run history, exports and anchors of records, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import matching as M, scores as S
from ..sources import exports, history as H
from . import inputs as I
from .extraction_queries import R
from .inputs import norm_sql
from .lineage import cut, shared_folder
from .radar_queries import ORACLES as RADAR_SQL, SOURCES_SQL, _candidates, _sources
from .switch_queries import PLAIN
from .trade_queries import ORACLES as TRADE_SQL, _same_part

DAYS = {"r1": "2024-01-01 00:00:00", "r2": "2024-02-01 00:00:00"}


def history_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs with their sources, events and prices written to history and read back: rows and sums per table and run.

    The first run lacks a third of the sources and has seen the start of some only;
    ``delta`` holds the new and the changed sources of the second.
    """
    h = H.History(spark, shared_folder(spark))
    s = cut(_sources(spark, sf))
    found = cut(_candidates(spark, sf).select("source_id", "kind", "title", "importance", "entity"))
    events = found.select(F.concat_ws("|", "kind", "entity").alias("event_key"), "kind", "title", "importance", F.array("source_id").alias("evidence_ids"), F.col("source_id").alias("pos"))
    prices = I.snapshots(spark, sf).withColumns({"product_name": F.col("product_key"), "url": F.lit(""), "pos": F.col("product_id")})
    start = F.when(F.col("pos") % 5 == 0, F.substring("body", 1, 100)).otherwise(F.col("body"))
    early = F.col("pos") % 3 != 0
    h.save_price_snapshots("r1", prices.where("run = 1996"), DAYS["r1"])
    h.save_run("r1", s.where(early).withColumn("body", start), events.where(early), DAYS["r1"], "orre")
    h.save_price_snapshots("r2", prices.where("run = 1997"), DAYS["r2"])
    delta = h.save_run("r2", s, events, DAYS["r2"], "orre")
    # a run written again replaces its own rows only
    h.save_run("r2", s, events, DAYS["r2"], "orre")
    told = lambda df, table, total: df.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), total.cast("long").alias("total")).select(F.lit(table).alias("table"), "run_id", "rows", "total")
    evidence = reduce(DataFrame.unionByName, [h.events(r) for r in DAYS])
    parts = [
        told(h.read("runs"), "runs", F.sum(F.length("created_at"))),
        told(h.read("sources"), "sources", F.sum(F.round(F.col("score") * 100))),
        told(evidence, "events", F.sum(F.col("importance") + F.element_at("evidence_ids", 1))),
        told(h.read("price_snapshots"), "price_snapshots", F.sum(F.round(F.col("price") * 100))),
        delta.select(F.lit("delta").alias("table"), F.lit("r2").alias("run_id"), F.col("new_sources").cast("long").alias("rows"), F.col("changed_sources").cast("long").alias("total")),
    ]
    return reduce(DataFrame.unionByName, parts)


def pack_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Pack sizes as shops write them, in base units."""
    p = I.table(spark, sf, "part").select("p_partkey", "p_size")
    size = F.col("p_size").cast("string")
    written = F.element_at(F.array(
        F.concat(size, F.lit("kg")), F.concat(size, F.lit(",5 kg")), F.concat(size, F.lit(" ml")), F.concat(size, F.lit("L")), F.concat(size, F.lit(" unidades")),
        F.concat(F.lit("pacote "), size, F.lit(" g")), F.lit("caixa")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select("p_partkey", written.alias("unit")).select("p_partkey", "unit", T.quantity(F.col("unit")).alias("q")).select(
        "p_partkey", "unit", T.round_half_up(F.col("q.amount"), 4).alias("amount"), "q.base")


def same_brand_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of every part to the next one of its brand when both have one name: the attribute part of the score."""
    from pyspark.sql import Window

    p = I.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    after = Window.partitionBy("p_brand").orderBy("p_partkey")
    item = lambda size: F.struct(F.lit("cafe torrado").alias("name"), F.col("p_brand").alias("brand"), F.concat(size.cast("string"), F.lit(" un")).alias("unit"), F.lit("").alias("sku"))
    pairs = p.withColumn("next_size", F.lead("p_size").over(after)).where("next_size is not null")
    pairs = pairs.select("p_partkey", item(F.col("p_size")).alias("a"), item(F.col("next_size")).alias("b"))
    return M.product_similarity(pairs).select("p_partkey", T.round_half_up(F.col("similarity"), 4).alias("similarity"))


def report_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The report's table of sources: its first eighty."""
    return exports.report_tables(sources=_sources(spark, sf))["sources"].select("id", "title", "url", "scope")


def report_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The report's first eight signals."""
    return exports.report_tables(signals=S.signals(*I.scored_events(spark, sf)))["signals"].select("event_id", "title", "type", "impact", "urgency")


def report_gaps(spark: SparkSession, sf: str) -> DataFrame:
    events, evidence, sources = I.scored_events(spark, sf)
    return exports.report_tables(gaps=S.gap_statements(S.dimension_scores(events, evidence, sources), events))["gaps"]


def report_price_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The report's six largest price gaps."""
    return exports.report_tables(price_gaps=_same_part(spark, sf).where("gap_percent is not null"))["price_gaps"].select("target_id", "competitor", "gap_percent")


def report_price_war(spark: SparkSession, sf: str) -> DataFrame:
    """The report's first ten competitors."""
    return exports.report_tables(price_war=M.price_war(_same_part(spark, sf)))["price_war"]


def report_events(spark: SparkSession, sf: str) -> DataFrame:
    """The report's first fifteen events."""
    return exports.report_tables(events=I.scored_events(spark, sf)[0])["events"].select("event_id", "kind", "title", "importance")


QUERIES = {f.__name__: f for f in (
    history_tables, pack_quantities, same_brand_similarity, report_sources, report_signals, report_gaps, report_price_gaps, report_price_war, report_events)}




def _history_sql() -> str:
    from .radar_queries import _candidates_sql

    return f"""WITH {_candidates_sql()}, {I.SNAPSHOTS_SQL.strip()},
all_s AS (SELECT 'r1' AS run_id, id, fingerprint, score, CASE WHEN pos % 5 = 0 THEN substr(body, 1, 100) ELSE body END AS body FROM sources WHERE pos % 3 <> 0
  UNION ALL SELECT 'r2', id, fingerprint, score, body FROM sources),
kept AS (SELECT run_id, fingerprint, arg_max(score, id) AS score, arg_max(sha1(body), id) AS hash FROM all_s GROUP BY 1, 2),
ev AS (SELECT run_id, kind || '|' || entity AS k, arg_max(importance, source_id) AS importance, max(source_id) AS evidence FROM (
  SELECT 'r1' AS run_id, * FROM cand WHERE source_id % 3 <> 0 UNION ALL SELECT 'r2', * FROM cand) GROUP BY 1, 2)
SELECT 'runs' AS "table", run_id, 1 AS rows, 19 AS total FROM (VALUES ('r1'), ('r2')) v(run_id)
UNION ALL SELECT 'sources', run_id, count(*), CAST(sum(round(score * 100)) AS BIGINT) FROM kept GROUP BY run_id
UNION ALL SELECT 'events', run_id, count(*), CAST(sum(importance + evidence) AS BIGINT) FROM ev GROUP BY run_id
UNION ALL SELECT 'price_snapshots', CASE run WHEN 1996 THEN 'r1' ELSE 'r2' END, count(*), CAST(sum(round(price * 100)) AS BIGINT) FROM snapshots WHERE run IN (1996, 1997) GROUP BY run
UNION ALL SELECT 'delta', 'r2', (SELECT count(DISTINCT fingerprint) FROM sources WHERE fingerprint NOT IN (SELECT fingerprint FROM kept WHERE run_id = 'r1')),
  (SELECT count(DISTINCT s.fingerprint) FROM sources s JOIN kept k ON k.run_id = 'r1' AND k.fingerprint = s.fingerprint WHERE sha1(s.body) <> k.hash)"""


_AMOUNT = r"TRY_CAST(replace(nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{1,5},[0-9]{2})$', 1), ''), ',', '.') AS DOUBLE)"
ORACLES = {
    "history_tables": _history_sql(),
    "pack_quantities": f"""SELECT p_partkey, unit, {R('amount', 4)} AS amount, base FROM (SELECT p_partkey,
  CASE p_partkey % 7 WHEN 0 THEN p_size || 'kg' WHEN 1 THEN p_size || ',5 kg' WHEN 2 THEN p_size || ' ml' WHEN 3 THEN p_size || 'L' WHEN 4 THEN p_size || ' unidades' WHEN 5 THEN 'pacote ' || p_size || ' g' ELSE 'caixa' END AS unit,
  CASE p_partkey % 7 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN (p_size + 0.5) * 1000 WHEN 3 THEN p_size * 1000.0 WHEN 6 THEN NULL ELSE p_size END AS amount,
  CASE p_partkey % 7 WHEN 0 THEN 'g' WHEN 1 THEN 'g' WHEN 2 THEN 'ml' WHEN 3 THEN 'ml' WHEN 4 THEN 'un' WHEN 5 THEN 'g' END AS base FROM part)""",
    "same_brand_similarity": f"""SELECT p_partkey, {R("least(1.0::DOUBLE, 0.64::DOUBLE + 0.24::DOUBLE + 0.14::DOUBLE + CASE WHEN p_size = n THEN 0.18::DOUBLE ELSE -0.18::DOUBLE END)", 4)} AS similarity
FROM (SELECT *, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n IS NOT NULL""",
    "flyer_price_items": PLAIN + """SELECT doc_id, region_no AS pos, 'Shop A' AS source, 'competitor' AS role, trim(name) AS name, '' AS url, value AS price, CAST(NULL AS DOUBLE) AS old_price, false AS promotion,
  '' AS brand, coalesce(trim(measure), '') AS unit, '' AS sku, '' AS matched_name, 'Shop A' AS competitor, confidence AS similarity, 'in_stock' AS availability, 'extracao_espacial' AS location_note,
  '' AS evidence_url, 'flyer_ocr' AS page_type, confidence AS price_confidence FROM made""",
    "anchors_currency": f"""WITH {I.RECORDS_SQL}, m AS (SELECT doc_id, pos, {_AMOUNT} AS v FROM records WHERE pos IN (1, 2))
SELECT doc_id, pos + 1 AS token_id, {R('v', 2)} AS value_num, 'BRL' AS unit, 'explicit_currency' AS evidence_kind, CAST(NULL AS VARCHAR) AS cadence, 0.95::DOUBLE AS confidence
FROM m WHERE v BETWEEN 0.05 AND 999999""",
    "source_export": f"""WITH {SOURCES_SQL} SELECT id AS "ID", 'geral' AS "Categoria", {norm_sql('title')} AS "Titulo", {norm_sql('url')} AS "URL", published AS "Data", {norm_sql('channel')} AS "Origem",
  scope AS "Escopo", CASE WHEN is_current THEN 'true' ELSE 'false' END AS "Atual", {R('score', 1)} AS "Score", {R('confidence', 3)} AS "Confianca" FROM sources""",
    "report_sources": f"WITH {SOURCES_SQL} SELECT id, title, url, scope FROM sources ORDER BY id LIMIT 80",
    "report_signals": f"SELECT event_id, title, type, impact, urgency FROM ({RADAR_SQL['signals'].replace('ORDER BY rank LIMIT 12', 'ORDER BY rank LIMIT 8')}) x",
    "report_gaps": RADAR_SQL["gap_statements"],
    "report_price_gaps": TRADE_SQL["price_gaps"].replace("LIMIT 15", "LIMIT 6"),
    "report_price_war": f"SELECT * FROM ({TRADE_SQL['price_war']}) x ORDER BY competitor_cheaper DESC, abs(mean_gap) DESC, competitor LIMIT 10",
    "report_events": f"WITH {I.SCORED_EVENTS_SQL} SELECT event_id, kind, title, importance FROM ev ORDER BY rank LIMIT 15",
}
