"""Registered queries of the radar: sources, events, scores, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, urls as U
from ..operators import deltas, events as E, evidence as V, scores as S, signals as G
from ..plans.lineage import cut
from . import inputs as I
from .inputs import any_sql, classified_sql, norm_sql

SPELLED = "array_join(topics, '|')"


def _classified(spark, sf):
    return V.classify_hits(I.hits(spark, sf), I.PROFILE)


def _sources(spark, sf):
    """Admitted hits as sources, numbered by landing order."""
    return V.admit(_classified(spark, sf)).withColumn("id", F.col("pos"))


SOURCES_SQL = classified_sql() + ",\nsources AS (SELECT *, pos AS id, snippet AS body FROM scored WHERE reject_reason IS NULL)"


def clean_sources(spark: SparkSession, sf: str) -> DataFrame:
    return V.admit(_classified(spark, sf)).select(
        F.col("pos"), "title", "url", "domain", "published", "published_kind", "is_current", "entity", "company_alias",
        "city_ok", "state_ok", "scope", T.round_half_up(F.col("confidence"), 2).alias("confidence"), "fingerprint")


def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).groupBy("reject_reason", "scope").agg(F.count(F.lit(1)).alias("hits"))


def topic_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("pos", F.array_join("topics", "|").alias("topics"))


def source_score(spark: SparkSession, sf: str) -> DataFrame:
    return V.admit(_classified(spark, sf)).select("pos", T.round_half_up(F.col("score"), 4).alias("score"))


def dedup_sources(spark: SparkSession, sf: str) -> DataFrame:
    return V.deduplicate(V.admit(_classified(spark, sf))).select("id", "pos", "url", "fingerprint", T.round_half_up(F.col("score"), 4).alias("score"))


def source_quality(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    return s.select("id", T.round_half_up(V.source_quality(s), 4).alias("quality"), V.recency(F.col("published"), I.AS_OF).alias("recency"))


def source_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return V.renumber(_sources(spark, sf)).select("id", "pos")


def enriched_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources joined to their landed pages; here a page holds the other half of the same document."""
    s = _sources(spark, sf)
    pages = s.select("url", F.lower("title").alias("title"), F.reverse("body").alias("body"),
                     F.lit("2024-01-15").alias("published"), F.concat("url", F.lit("&utm_medium=x")).alias("final_url"))
    out = V.enrich(s, pages, I.PROFILE, top=None, keep=None)
    return out.select("id", "pos", "url", "published", "is_direct", "is_current", "published_kind", F.length("body").alias("body_length"))


def channel_union(spark: SparkSession, sf: str) -> DataFrame:
    d = I.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("snippet"))
    c = I.table(spark, sf, "conversations").select(F.col("conv_id").alias("pos"), F.col("text").alias("snippet"), F.col("role").alias("title"))
    from ..sources.landing import tag_channel

    both = V.unite_channels([tag_channel(d, "empresa", "orre", "web"), tag_channel(c, "comercial", "der", "chat")])
    return both.groupBy("channel", "category", "target").agg(F.count(F.lit(1)).alias("hits"), F.count("title").alias("titled"),
                                                               F.sum(F.length("snippet")).alias("letters"))


def source_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Today's documents against a run that lacked one language and had seen shorter texts elsewhere."""
    d = I.table(spark, sf, "documents").select(F.sha1(F.col("doc_id").cast("string")).alias("fingerprint"), F.col("text").alias("body"), "lang", "n_chars")
    seen = F.when(F.col("n_chars") > 2000, F.substring("body", 1, 2000)).otherwise(F.col("body"))
    old = d.where(F.col("lang") != "es").select("fingerprint", F.sha1(seen).alias("content_hash"))
    return deltas.source_delta(d.select("fingerprint", "body"), old)


def source_delta_counts(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.delta_counts(source_delta(spark, sf))


def _candidates(spark, sf):
    return E.event_candidates(_sources(spark, sf), I.AS_OF, words=I.EVENT_WORDS)


def event_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("source_id", "kind", "importance", "confidence", "date", "is_current", "contextual", "entity", "scope")


def event_candidates_gated(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a condition on the page before it may tell of prices."""
    gate = lambda url, title, body: F.contains(url, F.lit("/en/"))
    c = E.event_candidates(_sources(spark, sf), I.AS_OF, price_gate=gate, words=I.EVENT_WORDS)
    return c.select("source_id", "kind", "importance", "confidence", "date", "entity")


def event_key(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("source_id", "event_key", "title")


def _events(spark, sf):
    return E.create_events(_sources(spark, sf), I.AS_OF, title_min=0.52, token_min=0.30, limit=None, words=I.EVENT_WORDS)


def event_clusters(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = _events(spark, sf)
    return events.select("rank", "event_id", "event_key", "kind", "title", "importance", "confidence", "date", "entity", "source_count", "evidence_count",
                         F.array_join("dimensions", "|").alias("dimensions"), F.array_join("source_urls", " ").alias("source_urls"),
                         "direct", "is_current", "contextual")


def event_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf)[1]


def top_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.create_events(_sources(spark, sf), I.AS_OF, title_min=0.52, token_min=0.30, limit=60, words=I.EVENT_WORDS)[0].select(
        "rank", "event_id", "kind", "importance", "confidence")


def same_fact_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of candidates (of one source and kind, at most 45 days apart) that tell one fact."""
    return E.same_fact_pairs(_candidates(spark, sf), 0.70, 0.55, 45)


def dimension_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = S.dimension_scores(*I.scored_events(spark, sf))
    return S.rank_dimensions(d).select("kind", "score", "events", "evidence", "corroborated", "mean_confidence")


def activity_index(spark: SparkSession, sf: str) -> DataFrame:
    return S.activity_index(S.dimension_scores(*I.scored_events(spark, sf)))


def external_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return S.external_pressure(I.scored_events(spark, sf)[0], "user3")


def company_vulnerability(spark: SparkSession, sf: str) -> DataFrame:
    return S.company_vulnerability(I.scored_events(spark, sf)[0], "user3")


def momentum(spark: SparkSession, sf: str) -> DataFrame:
    return S.momentum(*I.scored_events(spark, sf), I.AS_OF)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return S.signals(*I.scored_events(spark, sf)).drop("rank")


def gap_statements(spark: SparkSession, sf: str) -> DataFrame:
    events, evidence, sources = I.scored_events(spark, sf)
    return S.gap_statements(S.dimension_scores(events, evidence, sources), events)


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    return S.run_metrics(I.hits(spark, sf), s, _candidates(spark, sf))


def _cited(spark, sf):
    """Each user's events as a signal citing event ids, some of which no longer exist as sources."""
    e = I.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    items = e.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.floor(F.col("value") / 5).cast("string")).alias("signal_id")).agg(
        F.array_sort(F.collect_set("event_id")).alias("evidence_ids"), (F.max("k") / 100).alias("confidence"))
    sources = e.where(F.col("event_type") != "signup").select(F.col("event_id").alias("id"), (F.col("k") / 120).alias("confidence"))
    return items, sources


CITED_SQL = """
e AS (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events),
cites AS (SELECT user_id || '-' || event_type || '-' || CAST(floor(value / 5) AS BIGINT) AS signal_id, event_id AS source_id, k FROM e),
src AS (SELECT event_id AS id, k / 120.0::DOUBLE AS confidence FROM e WHERE event_type <> 'signup')
"""


def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    items, sources = _cited(spark, sf)
    return G.invalid_evidence(items, sources)


def confidence_cap(spark: SparkSession, sf: str) -> DataFrame:
    items, sources = _cited(spark, sf)
    return G.cap_confidence(items, sources).select("signal_id", T.round_half_up(F.col("confidence"), 6).alias("confidence"), F.size("evidence_ids").alias("evidence"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    items, sources = _cited(spark, sf)
    return G.citations(items, sources)


def package_verdict(spark: SparkSession, sf: str) -> DataFrame:
    items, sources = _cited(spark, sf)
    return G.package_verdict(items, sources)


def mention_check(spark: SparkSession, sf: str) -> DataFrame:
    names = I.table(spark, sf, "benchmark").select(F.substring_index("text", " ", 4).alias("name"))
    return G.mentioned(names, I.table(spark, sf, "documents"))


def competitor_notes(spark: SparkSession, sf: str) -> DataFrame:
    b = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("note_id"), F.substring_index("text", " ", 4).alias("name"),
                                                F.array(F.col("item_id"), F.col("item_id") + 300).alias("evidence_ids"))
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return G.validate_competitors(b, docs).select("note_id", "name", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("evidence"))


def evidence_pack(spark: SparkSession, sf: str) -> DataFrame:
    return G.evidence_pack(_sources(spark, sf)).select("id", "title", "url", "date", "is_current", "scope", "score", "confidence", F.length("excerpt").alias("excerpt_length"))


QUERIES = {f.__name__: f for f in (
    clean_sources, scope_filter, topic_tags, source_score, dedup_sources, source_quality, source_ranking, enriched_sources, channel_union,
    source_delta, source_delta_counts, event_candidates, event_candidates_gated, event_key, event_clusters, event_evidence, top_events, same_fact_pairs, dimension_scores,
    activity_index, external_pressure, company_vulnerability, momentum, signals, gap_statements, run_metrics, evidence_check, confidence_cap,
    citations, package_verdict, mention_check, competitor_notes, evidence_pack)}

R = lambda x, n: f"round(CAST({x} AS DECIMAL(28,8)), {n})::DOUBLE"
TRUNC = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n - 3}), ' [^ ]*$', '') || '...' END"
CLAMP = lambda x: f"CAST(greatest(0, least(100, round_even({x}, 0))) AS INTEGER)"
RECENCY = lambda d: f"CASE WHEN {d} IS NULL THEN 0.35 ELSE CASE WHEN greatest(0, DATE '{I.AS_OF}' - {d}) <= 7 THEN 1.0 WHEN DATE '{I.AS_OF}' - {d} <= 30 THEN 0.88 WHEN DATE '{I.AS_OF}' - {d} <= 90 THEN 0.72 WHEN DATE '{I.AS_OF}' - {d} <= 180 THEN 0.52 ELSE 0.30 END END::DOUBLE"

QUALITY_SQL = """least(1.0::DOUBLE, 0.30::DOUBLE + 0.15::DOUBLE
    + CASE WHEN city_ok THEN 0.15 WHEN state_ok THEN 0.06 ELSE 0 END::DOUBLE + CASE WHEN published <> '' THEN 0.10 ELSE 0 END::DOUBLE
    + CASE WHEN scope = 'local' THEN 0.08 ELSE 0 END::DOUBLE)"""


def _candidates_sql(price_gate: str = "true") -> str:
    words = " ".join(f"WHEN {any_sql('n', ws)}{f' AND {price_gate}' if k == 'PREÇO' else ''} THEN '{k}'" for k, ws in I.EVENT_WORDS.items())
    from ..rules import EVENT_BASE
    base = " ".join(f"WHEN '{k}' THEN {b}.0::DOUBLE" for k, b in EVENT_BASE.items())
    trunc = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n - 3}), ' [^ ]*$', '') || '...' END"
    sq = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return SOURCES_SQL + f""",
c0 AS (SELECT *, CASE {words} END AS kind, {sq('title')} AS t0, {sq('snippet')} AS s0, CASE WHEN published <> '' THEN CAST(published AS DATE) END AS d FROM sources),
c1 AS (SELECT *, {QUALITY_SQL} AS q, {RECENCY('d')} AS r,
    CASE WHEN scope IN ('local', 'concorrente') THEN 1.0 WHEN scope = 'corporativo' THEN 0.82 ELSE 0.60 END::DOUBLE AS sp,
    CASE kind {base} END AS base, coalesce(DATE '{I.AS_OF}' - d <= 45, false) AS cur, coalesce(DATE '{I.AS_OF}' - d <= 180, false) AS contextual,
    CASE WHEN length(t0) < 12 THEN s0 ELSE t0 END AS bt
  FROM c0 WHERE kind IS NOT NULL),
c2 AS (SELECT *, {CLAMP("base * (0.55::DOUBLE + 0.25::DOUBLE * q + 0.15::DOUBLE * r + 0.05::DOUBLE * sp)")} AS i0, {trunc('bt', 180)} AS ev_title FROM c1),
c3 AS (SELECT *, CASE WHEN d IS NULL THEN {CLAMP("i0 * 0.68::DOUBLE")} ELSE i0 END AS i1,
    {R("least(1.0::DOUBLE, 0.45::DOUBLE * q + 0.35::DOUBLE * r + 0.20::DOUBLE * sp)", 2)} AS conf, {norm_sql('ev_title')} AS nt FROM c2),
cand AS (SELECT id AS source_id, kind, CASE WHEN cur THEN i1 ELSE least(i1, 54) END AS importance, conf AS confidence, published AS date, cur AS is_current,
    contextual, entity, scope, ev_title AS title, nt, city_ok, d FROM c3)"""


STOP = "['de','da','do','e','em','para','com','que','um','uma','na','no','por','a','o','os','as','dos','das','ao','aos','sua','seu','sobre']"
KINDS_SQL = """
kinds AS (SELECT * FROM (VALUES ('PREÇO',60.0,0.12),('REPUTAÇÃO',62.0,0.14),('ATENDIMENTO',54.0,0.08),('EXPANSÃO',74.0,0.16),('DIGITAL',62.0,0.12),
  ('MARKETING',48.0,0.08),('PESSOAS',44.0,0.07),('REGULAÇÃO',78.0,0.08),('PRODUTO/SERVIÇO',52.0,0.10),('PARCERIA',50.0,0.05)) t(kind, base, weight)),
now AS (SELECT * FROM ev WHERE is_current),
counts AS (SELECT kind, count(*) AS n, count(*) FILTER (source_count >= 2) AS confirmed FROM now GROUP BY kind),
lead AS (SELECT kind, sum(confidence) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank) AS rn FROM now) WHERE rn <= 8 GROUP BY kind),
proof AS (SELECT kind, count(DISTINCT source_id) AS uniq, bool_or(published <> '') AS any_dated FROM now JOIN evidence USING (event_id) JOIN src ON src.id = source_id GROUP BY kind),
dims0 AS (SELECT k.kind, base::DOUBLE AS base, weight, coalesce(n, 0) AS n, coalesce(confirmed, 0) AS confirmed, coalesce(uniq, 0) AS uniq, coalesce(lead / n, 0)::DOUBLE AS rec,
    coalesce(any_dated, true) AS any_dated FROM kinds k LEFT JOIN counts USING (kind) LEFT JOIN lead USING (kind) LEFT JOIN proof USING (kind)),
dims AS (SELECT *, """ + CLAMP("CASE WHEN n > 0 THEN base * (0.42::DOUBLE + 0.30::DOUBLE * least(1.0::DOUBLE, uniq / 5.0::DOUBLE) + 0.18::DOUBLE * rec + 0.10::DOUBLE * least(1.0::DOUBLE, confirmed / 2.0::DOUBLE)) * CASE WHEN any_dated THEN 1.0 ELSE 0.72 END::DOUBLE ELSE 0 END") + """ AS score FROM dims0)
"""
LEVEL = lambda x, m: f"CASE WHEN {x} >= 70 THEN 'ALTA' WHEN {x} >= {m} THEN 'MÉDIA' ELSE 'BAIXA' END"

ORACLES = {
    "clean_sources": f"WITH {SOURCES_SQL} SELECT pos, title, url, domain, published, CASE WHEN pub IS NOT NULL THEN 'publicada' ELSE 'desconhecida' END AS published_kind, "
                     f"is_current, entity, company_alias, city_ok, state_ok, scope, {R('confidence', 2)} AS confidence, fingerprint FROM sources",
    "scope_filter": f"WITH {classified_sql()} SELECT reject_reason, scope, count(*) AS hits FROM classified GROUP BY ALL",
    "topic_tags": f"WITH {classified_sql()} SELECT pos, array_to_string(topics, '|') AS topics FROM classified",
    "source_score": f"WITH {SOURCES_SQL} SELECT pos, {R('score', 4)} AS score FROM sources",
    "dedup_sources": f"""WITH {SOURCES_SQL},
u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, pos) AS rn FROM sources),
f AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, pos) AS fn FROM u WHERE rn = 1)
SELECT row_number() OVER (ORDER BY score DESC, pos) AS id, pos, url, fingerprint, {R('score', 4)} AS score FROM f WHERE fn = 1""",
    "source_quality": f"WITH {SOURCES_SQL} SELECT id, {R(QUALITY_SQL, 4)} AS quality, {RECENCY('pub')} AS recency FROM sources",
    "source_ranking": f"WITH {SOURCES_SQL} SELECT row_number() OVER (ORDER BY score DESC, id) AS id, pos FROM sources",
    "channel_union": """SELECT 'web' AS channel, 'empresa' AS category, 'orre' AS target, count(*) AS hits, 0 AS titled, sum(length(text)) AS letters FROM documents
UNION ALL SELECT 'chat', 'comercial', 'der', count(*), count(role), sum(length(text)) FROM conversations""",
    "source_delta": """WITH d AS (SELECT sha1(CAST(doc_id AS VARCHAR)) AS fingerprint, text, lang FROM documents)
SELECT fingerprint, 'new' AS delta FROM d WHERE lang = 'es'
UNION ALL SELECT fingerprint, 'changed' FROM d WHERE lang <> 'es' AND sha1(text) <> sha1(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) ELSE text END)""",
    "source_delta_counts": """SELECT count(*) FILTER (lang = 'es') AS new_sources, count(*) FILTER (lang <> 'es' AND length(text) > 2000) AS changed_sources FROM documents""",
    "event_candidates": f"WITH {_candidates_sql()} SELECT source_id, kind, importance, confidence, date, is_current, contextual, entity, scope FROM cand",
    "event_candidates_gated": f"""WITH {_candidates_sql("contains(url, '/en/')")} SELECT source_id, kind, importance, confidence, date, entity FROM cand""",
    "evidence_pack": f"""WITH {SOURCES_SQL}, e AS (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, url, published AS date, is_current, scope, score, confidence,
  trim(regexp_replace(coalesce(nullif(snippet, ''), body), '\\s+', ' ', 'g')) AS x FROM sources ORDER BY score DESC, id LIMIT 36)
SELECT id, {TRUNC('t', 180)} AS title, url, date, is_current, scope, {R('score', 1)} AS score, {R('confidence', 2)} AS confidence, length({TRUNC('x', 650)}) AS excerpt_length FROM e""",
    "event_key": f"""WITH {_candidates_sql()}
SELECT source_id, title, substr(sha1({norm_sql('entity')} || '|' || kind || '|' || CASE WHEN city_ok THEN 'local' ELSE scope END || '|' ||
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(nt, '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({STOP}, x))))[1:24], ' ') || '|' ||
  array_to_string(regexp_extract_all(nt, '\\b\\d+(?:[.,]\\d+)?\\b')[1:4], ',') || '|' || coalesce(strftime(date_trunc('week', d), '%Y-%m-%d'), 'sem-data')), 1, 24) AS event_key FROM cand""",
    "dimension_scores": f"WITH {I.SCORED_EVENTS_SQL}, {KINDS_SQL} SELECT kind, score, n AS events, uniq AS evidence, confirmed AS corroborated, {R('rec', 2)} AS mean_confidence FROM dims",
    "activity_index": f"""WITH {I.SCORED_EVENTS_SQL}, {KINDS_SQL}, t AS (SELECT sum(score * CAST(weight AS DECIMAL(6,2)))::DOUBLE AS total, coalesce(sum(CAST(weight AS DECIMAL(6,2))) FILTER (score > 0), 0)::DOUBLE AS coverage FROM dims),
d AS (SELECT *, total * CASE WHEN coverage < 0.40 THEN 0.72 WHEN coverage < 0.60 THEN 0.86 ELSE 1.0 END::DOUBLE AS damped FROM t)
SELECT {CLAMP('damped')} AS score, {LEVEL('damped', 45)} AS label, {R('coverage', 2)} AS coverage, 'atividade_da_empresa' AS type FROM d""",
    "external_pressure": f"""WITH {I.SCORED_EVENTS_SQL}, x AS (SELECT * FROM ev WHERE is_current AND entity NOT IN ('', 'user3')),
per AS (SELECT entity, sum(CAST(importance * greatest(0.35::DOUBLE, confidence) AS DECIMAL(20,6)))::DOUBLE AS force, count(*) AS n, count(*) FILTER (source_count >= 2) AS confirmed, min(rank) AS first_rank FROM x GROUP BY entity),
t AS (SELECT max(force) AS leader, least(1.0::DOUBLE, count(*) / 4.0::DOUBLE) AS diversity, sum(confirmed) / sum(n)::DOUBLE AS corr FROM per),
s AS (SELECT *, {CLAMP('least(100.0::DOUBLE, leader / 2.8::DOUBLE) * 0.58::DOUBLE + diversity * 24 + corr * 18')} AS score FROM t)
SELECT score, {LEVEL('score', 45)} AS label, {R('diversity', 2)} AS coverage, {R('corr', 2)} AS corroboration,
  (SELECT string_agg(entity, '|' ORDER BY force DESC, first_rank) FROM (SELECT * FROM per ORDER BY force DESC, first_rank LIMIT 5)) AS entities, 'pressao_externa' AS type FROM s""",
    "company_vulnerability": f"""WITH {I.SCORED_EVENTS_SQL}, x AS (SELECT *, row_number() OVER (ORDER BY rank) AS rn FROM ev WHERE is_current AND entity = 'user3' AND kind IN ('REPUTAÇÃO', 'ATENDIMENTO', 'REGULAÇÃO')),
t AS (SELECT sum(CAST(importance * (confidence * CASE WHEN source_count >= 2 THEN 1.0 ELSE 0.5 END::DOUBLE * CASE WHEN date <> '' THEN 1.0 ELSE 0.55 END::DOUBLE) AS DECIMAL(20,8))) FILTER (rn <= 10)::DOUBLE AS total,
  count(*) FILTER (rn <= 10 AND source_count >= 2) AS corroborated, count(DISTINCT kind) FILTER (rn <= 10) AS kinds, count(*) AS n, coalesce(sum(greatest(1, source_count)), 0) AS sources FROM x),
r AS (SELECT *, least(100.0::DOUBLE, coalesce(total, 0) / 2.4::DOUBLE) AS raw FROM t),
s AS (SELECT *, {CLAMP("CASE WHEN corroborated = 0 AND n = 1 THEN least(raw, 38.0) WHEN corroborated = 0 AND n <= 2 THEN least(raw, 52.0) WHEN corroborated = 0 AND kinds = 1 THEN least(raw, 62.0) ELSE raw END")} AS score FROM r)
SELECT score, {LEVEL('score', 40)} AS label, n AS risk_events, corroborated, kinds AS risk_dimensions, CAST(sources AS BIGINT) AS distinct_sources, {R('least(1.0::DOUBLE, (n + corroborated) / 4.0::DOUBLE)', 2)} AS coverage, 'vulnerabilidade_empresa' AS type FROM s""",
    "momentum": f"""WITH {I.SCORED_EVENTS_SQL}, h AS (SELECT * FROM ev WHERE is_current AND date <> '' ORDER BY rank LIMIT 15),
f AS (SELECT h.event_id, importance, min(source_id) AS id FROM h JOIN evidence USING (event_id) GROUP BY 1, 2),
v AS (SELECT importance * {RECENCY("TRY_CAST(published AS DATE)")} AS value FROM f JOIN src USING (id))
SELECT {CLAMP('avg(CAST(value AS DECIMAL(20,6)))::DOUBLE')} AS momentum FROM v""",
    "signals": f"""WITH {I.SCORED_EVENTS_SQL}, h AS (SELECT * FROM ev ORDER BY rank LIMIT 18),
p AS (SELECT event_id, count(*) AS evidence_count FROM h JOIN evidence USING (event_id) JOIN src ON src.id = source_id GROUP BY 1),
e2 AS (SELECT h.*, evidence_count, source_count >= 2 AS several FROM h JOIN p USING (event_id) ORDER BY rank LIMIT 12)
SELECT event_id, title, CASE WHEN kind IN ('REPUTAÇÃO', 'ATENDIMENTO', 'REGULAÇÃO') THEN 'RISCO' ELSE 'OPORTUNIDADE' END AS type,
 CASE WHEN kind IN ('REPUTAÇÃO', 'ATENDIMENTO') AND NOT several THEN CASE WHEN importance < 65 THEN 'BAIXO' ELSE 'MEDIO' END WHEN importance >= 75 AND several THEN 'ALTO' WHEN importance >= 55 THEN 'MEDIO' ELSE 'BAIXO' END AS impact,
 CASE WHEN importance >= 78 AND several THEN 'ALTA' WHEN importance >= 55 THEN 'MEDIA' ELSE 'BAIXA' END AS urgency,
 'Evento sustentado por ' || evidence_count || ' evidência(s) e ' || source_count || ' fonte(s) independente(s). Isso é um sinal; não prova causalidade financeira.' AS rationale,
 CASE kind WHEN 'PREÇO' THEN 'Medir preço/promoção em itens sensíveis antes de alterar margem.' WHEN 'REPUTAÇÃO' THEN 'Quantificar recorrência e gravidade antes de tratar o tema como estrutural.'
  WHEN 'EXPANSÃO' THEN 'Mapear raio de impacto e comparar oferta/concorrência local.' WHEN 'DIGITAL' THEN 'Comparar jornada, aquisição e conveniência digital.' ELSE 'Mapear mensagem, público e timing antes de reagir.' END AS action,
 evidence_count, confidence, CASE WHEN several THEN 'corroborado' ELSE 'sinal isolado' END AS limit, entity FROM e2""",
    "gap_statements": f"""WITH {I.SCORED_EVENTS_SQL}, {KINDS_SQL}, g AS (
SELECT 0 AS position, 'Não há comparação confiável de preço suficiente nesta execução.' AS gap FROM dims WHERE kind = 'PREÇO' AND score < 35
UNION ALL SELECT 1, 'Não há amostra suficiente para inferir tendência de reputação.' FROM dims WHERE kind = 'REPUTAÇÃO' AND score < 35
UNION ALL SELECT 2, 'Não há evidência suficiente de expansão recente.' FROM dims WHERE kind = 'EXPANSÃO' AND score < 35
UNION ALL SELECT 3, 'A maior parte das evidências não possui data verificável.' WHERE NOT EXISTS (SELECT 1 FROM ev WHERE date <> ''))
SELECT * FROM g UNION ALL SELECT 0, 'Não foram detectadas lacunas críticas nas dimensões monitoradas.' WHERE NOT EXISTS (SELECT 1 FROM g)""",
    "run_metrics": f"""WITH {_candidates_sql()} SELECT (SELECT count(*) FROM hits) AS raw_hits, count(*) AS final_sources, count(*) FILTER (is_current) AS current_sources,
 count(*) FILTER (published <> '') AS dated_sources, count(*) FILTER (scope = 'local') AS local_sources, (SELECT count(*) FROM cand) AS events FROM sources""",
    "evidence_check": f"WITH {CITED_SQL} SELECT signal_id, source_id FROM cites WHERE source_id NOT IN (SELECT id FROM src)",
    "confidence_cap": f"""WITH {CITED_SQL}, own AS (SELECT signal_id, max(k) / 100.0::DOUBLE AS c FROM cites GROUP BY 1),
b AS (SELECT signal_id, max(confidence) AS best, count(*) AS n FROM cites JOIN src ON src.id = source_id GROUP BY 1)
SELECT signal_id, {R('least(c, best)', 6)} AS confidence, n AS evidence FROM own JOIN b USING (signal_id)""",
    "citations": f"WITH {CITED_SQL} SELECT signal_id, string_agg('[FONTE ' || source_id || ']', ' ' ORDER BY source_id) AS citation FROM cites JOIN src ON src.id = source_id GROUP BY 1",
    "package_verdict": f"""WITH {CITED_SQL}, v AS (SELECT (SELECT count(DISTINCT signal_id) FROM cites JOIN src ON src.id = source_id) AS signals,
 (SELECT count(DISTINCT source_id) FROM cites WHERE source_id NOT IN (SELECT id FROM src)) AS invalid_ids, (SELECT count(*) FROM src) AS valid_ids) SELECT *, invalid_ids = 0 AND signals > 0 AS valid FROM v""",
    "mention_check": f"""WITH n AS (SELECT DISTINCT trim(array_to_string(string_split(text, ' ')[1:4], ' ')) AS name FROM benchmark),
t AS (SELECT {norm_sql('text')} AS t FROM documents) SELECT name FROM n WHERE name <> '' AND EXISTS (SELECT 1 FROM t WHERE contains(t.t, {norm_sql('name')}))""",
    "competitor_notes": f"""WITH n AS (SELECT item_id AS note_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS name, {norm_sql("array_to_string(string_split(text, ' ')[1:4], ' ')")} AS nn FROM benchmark),
s AS (SELECT doc_id AS id, {norm_sql('text')} AS t FROM documents), c AS (SELECT note_id, unnest([note_id, note_id + 300]) AS id FROM n),
p AS (SELECT note_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS evidence FROM c WHERE id IN (SELECT id FROM s) GROUP BY 1)
SELECT note_id, name, evidence FROM n JOIN p USING (note_id) WHERE trim(name) <> '' AND EXISTS (SELECT 1 FROM s WHERE contains(s.t, n.nn))""",
}
