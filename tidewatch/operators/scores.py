"""Scores of the competitive environment, from events and their evidence.

Events are rows (event_id, kind, title, importance, confidence, date, entity,
source_count, is_current, rank); their evidence is a table of its own
(event_id, source_id), because an event may rest on any number of sources.
``rank`` is the report order of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..plans.lineage import top_by
from ..rules import ACTIONS, ACTIVITY_WEIGHTS, DEFAULT_ACTION, EVENT_BASE, GAPS, NO_DATE_GAP, NO_GAP, OPPORTUNITY_KINDS, RISK_KINDS
from .evidence import recency


def lookup(values: dict, key: Column, default=None) -> Column:
    """A small fixed table as an expression."""
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def kinds_table(spark: SparkSession) -> DataFrame:
    """The ten event kinds, their base and activity weights."""
    rows = [(k, float(b), float(ACTIVITY_WEIGHTS[k]), i) for i, (k, b) in enumerate(EVENT_BASE.items())]
    return spark.createDataFrame(rows, "kind string, base double, weight double, kind_order int")


def level(score: Column, middle: int) -> Column:
    return F.when(score >= 70, "ALTA").when(score >= middle, "MÉDIA").otherwise("BAIXA")


def dimension_scores(events: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The ten dimensions with score, events, evidence, corroboration and mean confidence."""
    now = events.where(F.col("is_current"))
    counts = now.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_count") >= 2).alias("confirmed"))
    leading = top_by(now, ["kind"], [F.col("rank")], 8).groupBy("kind").agg(F.sum("confidence").alias("lead"))
    proof = now.select("event_id", "kind").join(evidence, "event_id").select("kind", "source_id").distinct()
    dated = sources.select(F.col("id").alias("source_id"), (F.coalesce("published", F.lit("")) != "").alias("dated"))
    proof = proof.join(dated, "source_id", "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("uniq"),
        F.coalesce(F.bool_or("dated"), F.lit(True)).alias("any_dated"),
    )
    d = kinds_table(events.sparkSession)
    for part in (counts, leading, proof):
        d = d.join(part, "kind", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = d.withColumn("rec", F.coalesce(F.col("lead") / F.col("n"), F.lit(0.0)))
    raw = F.col("base") * (
        F.lit(0.42)
        + 0.30 * F.least(F.lit(1.0), zero("uniq") / 5.0)
        + 0.18 * F.col("rec")
        + 0.10 * F.least(F.lit(1.0), zero("confirmed") / 2)
    )
    raw = F.when(F.col("n") > 0, raw).otherwise(0.0) * F.when(F.coalesce("any_dated", F.lit(True)), 1.0).otherwise(0.72)
    return d.select(
        "kind", T.clamp_score(raw).alias("score"), zero("n").alias("events"), zero("uniq").alias("evidence"),
        zero("confirmed").alias("corroborated"), T.round_half_up(F.col("rec"), 2).alias("mean_confidence"),
        "weight", "kind_order",
    )


def rank_dimensions(dimensions: DataFrame) -> DataFrame:
    return dimensions.orderBy(F.desc("score"), F.asc("kind_order"))


def activity_index(dimensions: DataFrame) -> DataFrame:
    """One row: weighted activity, damped when few dimensions have evidence."""
    w = F.col("weight").cast("decimal(6,2)")
    total = dimensions.agg(
        F.sum(F.col("score") * w).cast("double").alias("total"),
        F.coalesce(F.sum(F.when(F.col("score") > 0, w)), F.lit(0)).cast("double").alias("coverage"),
    )
    damped = F.col("total") * F.when(F.col("coverage") < 0.40, 0.72).when(F.col("coverage") < 0.60, 0.86).otherwise(1.0)
    return total.select(
        T.clamp_score(damped).alias("score"), level(damped, 45).alias("label"),
        T.round_half_up(F.col("coverage"), 2).alias("coverage"), F.lit("atividade_da_empresa").alias("type"),
    )


def external_pressure(events: DataFrame, company: str, market: str = "mercado") -> DataFrame:
    """One row: pressure from other companies' current events; score null without any."""
    entity = F.coalesce("entity", F.lit(market))
    e = events.where(F.col("is_current") & ~F.coalesce("entity", F.lit(market)).isin("", company))
    e = e.where((entity != market) | (F.col("importance") >= 55)).withColumn("entity", entity)
    force = F.col("importance") * F.greatest(F.lit(0.35), F.coalesce("confidence", F.lit(0.5)))
    per = e.groupBy("entity").agg(
        F.sum(force.cast("decimal(20,6)")).cast("double").alias("force"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source_count") >= 2).alias("confirmed"),
        F.min("rank").alias("first_rank"),
    )
    leaders = per.orderBy(F.desc("force"), F.asc("first_rank")).limit(5)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("force")).alias("f"), "first_rank", "entity")))
    names = leaders.agg(F.array_join(F.transform(listed, lambda x: x["entity"]), "|").alias("l"))
    total = per.agg(
        F.max("force").alias("leader"), F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("confirmed"), F.lit(0)).alias("confirmed"),
    ).withColumn("names", names.scalar())
    diversity = F.least(F.lit(1.0), F.col("entities") / 4)
    corroboration = F.least(F.lit(1.0), F.col("confirmed") / F.greatest(F.lit(1), F.col("n")))
    intensity = F.least(F.lit(100.0), F.col("leader") / 2.8)
    score = F.when(F.col("n") > 0, T.clamp_score(intensity * 0.58 + diversity * 24 + corroboration * 18))
    return total.select(
        score.alias("score"),
        F.when(F.col("n") == 0, "NÃO CALCULADO").otherwise(level(score, 45)).alias("label"),
        T.round_half_up(diversity, 2).alias("coverage"),
        T.round_half_up(corroboration, 2).alias("corroboration"),
        F.col("names").alias("entities"),
        F.lit("pressao_externa").alias("type"),
    )


def company_vulnerability(events: DataFrame, company: str) -> DataFrame:
    """One row: exposure of the company to its first ten current risk events."""
    risks = events.where(F.col("is_current") & (F.col("entity") == company) & F.col("kind").isin(*RISK_KINDS))
    several = F.coalesce("source_count", F.lit(1)) >= 2
    dated = F.coalesce("date", F.lit("")) != ""
    weight = F.coalesce("confidence", F.lit(0.5)) * F.when(several, 1.0).otherwise(0.50) * F.when(dated, 1.0).otherwise(0.55)
    head = risks.orderBy("rank").limit(10).agg(
        F.sum((F.col("importance") * weight).cast("decimal(20,8)")).cast("double").alias("total"),
        F.count_if(several).alias("corroborated"), F.countDistinct("kind").alias("kinds"),
    )
    whole = risks.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.greatest(F.lit(1), F.coalesce("source_count", F.lit(1)))), F.lit(0)).alias("sources"),
    )
    d = whole.select("n", "sources", *[
        head.select(c).scalar().alias(c) for c in ("total", "corroborated", "kinds")])
    raw = F.least(F.lit(100.0), F.coalesce("total", F.lit(0.0)) / 2.4)
    alone = F.col("corroborated") == 0
    raw = (
        F.when(alone & (F.col("n") == 1), F.least(raw, F.lit(38.0)))
        .when(alone & (F.col("n") <= 2), F.least(raw, F.lit(52.0)))
        .when(alone & (F.col("kinds") == 1), F.least(raw, F.lit(62.0)))
        .otherwise(raw)
    )
    score = T.clamp_score(raw)
    return d.select(
        score.alias("score"), level(score, 40).alias("label"), F.col("n").alias("risk_events"), "corroborated",
        F.col("kinds").alias("risk_dimensions"), F.col("sources").alias("distinct_sources"),
        T.round_half_up(F.least(F.lit(1.0), (F.col("n") + F.col("corroborated")) / 4.0), 2).alias("coverage"),
        F.lit("vulnerabilidade_empresa").alias("type"),
    )


def momentum(events: DataFrame, evidence: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One row: mean of importance times recency over the first 15 dated current events."""
    head = events.where(F.col("is_current") & (F.coalesce("date", F.lit("")) != "")).orderBy("rank").limit(15)
    first = head.join(evidence, "event_id", "left").groupBy("event_id", "importance").agg(F.min("source_id").alias("id"))
    seen = first.join(sources.select("id", "published"), "id", "left")
    value = F.when(F.col("published").isNotNull(), F.col("importance") * recency(F.col("published"), as_of)).otherwise(0.0)
    return seen.agg(T.clamp_score(F.coalesce(F.avg(value.cast("decimal(20,6)")), F.lit(0)).cast("double")).alias("momentum"))


def signal_type(kind: Column) -> Column:
    return F.when(kind.isin(*RISK_KINDS), "RISCO").when(kind.isin(*OPPORTUNITY_KINDS), "OPORTUNIDADE").otherwise("MOVIMENTO")


def signals(events: DataFrame, evidence: DataFrame, sources: DataFrame, first: int = 18, keep: int = 12) -> DataFrame:
    """Actionable signals from the first events that rest on a known source."""
    head = events.orderBy("rank").limit(first)
    known = evidence.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    proof = head.select("event_id").join(known, "event_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    e = head.join(proof, "event_id").orderBy("rank").limit(keep)
    n, imp = F.coalesce("source_count", F.lit(1)), F.coalesce("importance", F.lit(0))
    several = n >= 2
    service = F.col("kind").isin("REPUTAÇÃO", "ATENDIMENTO")
    impact = (
        F.when(service & ~several, F.when(imp < 65, "BAIXO").otherwise("MEDIO"))
        .when((imp >= 75) & several, "ALTO").when(imp >= 55, "MEDIO").otherwise("BAIXO")
    )
    return e.select(
        "event_id", "title", signal_type(F.col("kind")).alias("type"), impact.alias("impact"),
        F.when((imp >= 78) & several, "ALTA").when(imp >= 55, "MEDIA").otherwise("BAIXA").alias("urgency"),
        F.concat(
            F.lit("Evento sustentado por "), F.col("evidence_count").cast("string"), F.lit(" evidência(s) e "), n.cast("string"),
            F.lit(" fonte(s) independente(s). Isso é um sinal; não prova causalidade financeira."),
        ).alias("rationale"),
        lookup(ACTIONS, F.col("kind"), DEFAULT_ACTION).alias("action"),
        "evidence_count", "confidence", F.when(several, "corroborado").otherwise("sinal isolado").alias("limit"), "entity", "rank",
    )


def signal_evidence(signal_rows: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The known sources (event_id, source_id) behind the signals."""
    known = evidence.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return known.join(signal_rows.select("event_id"), "event_id", "left_semi")


def gap_statements(dimensions: DataFrame, events: DataFrame) -> DataFrame:
    """What the run cannot say, as rows."""
    weak = dimensions.where(F.col("kind").isin(*GAPS) & (F.col("score") < 35)).select(
        lookup({k: i for i, k in enumerate(GAPS)}, F.col("kind"), 99).alias("position"), lookup(GAPS, F.col("kind")).alias("gap"))
    dated = events.agg(F.coalesce(F.bool_or(F.coalesce("date", F.lit("")) != ""), F.lit(False)).alias("any"))
    undated = dated.where(~F.col("any")).select(F.lit(len(GAPS)).alias("position"), F.lit(NO_DATE_GAP).alias("gap"))
    found = weak.unionByName(undated)
    none = found.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(F.lit(0).alias("position"), F.lit(NO_GAP).alias("gap"))
    return found.unionByName(none)


def run_metrics(hits: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """One row: raw hits, final, current, dated and local sources, events."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar().alias(name)
    return sources.agg(
        F.count(F.lit(1)).alias("final_sources"),
        F.count_if(F.col("is_current")).alias("current_sources"),
        F.count_if(F.coalesce("published", F.lit("")) != "").alias("dated_sources"),
        F.count_if(F.col("scope") == "local").alias("local_sources"),
    ).select(count(hits, "raw_hits"), "*", count(events, "events"))
