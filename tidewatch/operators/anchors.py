"""Anchors: the values in a page around which its facts gather.

A rule is a callable from tokens to anchor rows; ``RULES`` can be added to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes as B
from ..plans.lineage import cut, drop_cut, first_by, numbered
from .spatial import TOKEN_COLUMNS

# The patterns of the rules.
SYMBOL = r"(?i)(?:R\$|\$|€|£|US\$)"
_PERIOD = r"(?:m[eê]s|ano|dia|di[aá]ria|sess[aã]o|hora|un|unidade|kg|g|l|litro|pe[cç]a|item|m[23]|km|pax|noite)"
CADENCE = (
    rf"(?iu)(?:/\s*{_PERIOD}|(?:\s+(?:por|ao|a cada|cada)\s+{_PERIOD})"
    r"|\s+CADA|\s+POR\s+M[EÊ]S|\s+MENSAL|\s+ANUAL|\s+DI[AÁ]RIO|\s+POR\s+DIA)"
)
MEASURED = (
    r"(?iuU)(\b|\d)(g|kg|mg|ml|l|litro|litros|sach[eê]s?|c[aá]psulas?|unidades?|un|cm|mm|m|w|v|hz|pct|pack"
    r"|anos?|meses|dias|h|min|s)\b"
)
DIMENSION = r"(?i)(\d+x\d+([.,]\d+)?|\d+w\d+|\d+v\d+|\d+k\d+)"
NOT_MONEY = r"(?U)(%|\d+-\d+|\.\d{4,}|\b\d{1,2}/\d{1,2}/\d{2,4}\b)"
PRICE = r"(?iU)(\b(?:\d{1,3}(?:\.\d{3})+,\d{2}|\d{1,5}[.,]\d{2})\b)"
NEXT_UNITS = (
    "g", "kg", "mg", "ml", "l", "litro", "litros", "sachê", "sache", "sachês", "saches", "un",
    "unidades", "cm", "mm", "%",
)
COURT_CASE = r"(?U)\b(\d{7}-\d{2}\.\d{4}(?:\.\d\.\d{2}\.\d{4})?|\d{7}-\d{2}\.\d{4})\b"
PERCENT = r"([+-]?\d+(?:[.,]\d+)?)\s*%"
SALARY = r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d{3,6}(?:,\d{2})?)"
SALARY_WORD = r"(?iuU)\b(sal[aá]rio|remunera[cç][aã]o|vencimento|bolsa|honor[aá]rios)\b"
COMPANY_ID = r"(?U)\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
PERSON_ID = r"(?U)\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
DATE = r"(?U)\b(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})\b"
MEASURE = (
    r"(?iuU)(\b\d+(?:[.,]\d+)?\s*(?:kg|g|mg|ml|l|litros?|sach[eê]s?|c[aá]psulas?|unidades?|un|cm|mm|m)\b"
    r"|\b\d+x\d+(?:[.,]\d+)?\s*(?:g|ml|cm|mm)?\b)"
)

ANCHOR_COLUMNS = [
    "doc_id", "pos", "token_id", "type", "raw_text", "value_num", "value_str", "unit", "confidence",
    "evidence_kind", "cadence", "box", "rule",
]
WINDOW = 15


def _anchor(rows: DataFrame, rule: str, kind: str, *, number: Column | None = None, text: Column | None = None,
            unit: Column | None = None, gain: float = 0.0, evidence: str = "bare_decimal", raw: Column | None = None) -> DataFrame:
    return rows.select(
        "doc_id", "pos", "token_id", F.lit(kind).alias("type"), (F.trim("text") if raw is None else raw).alias("raw_text"),
        (F.lit(None) if number is None else number).cast("double").alias("value_num"),
        (F.lit(None) if text is None else text).cast("string").alias("value_str"),
        (F.lit(None) if unit is None else unit).cast("string").alias("unit"),
        (F.least(F.lit(1.0), F.col("confidence") + gain) if gain else F.col("confidence")).alias("confidence"),
        F.lit(evidence).alias("evidence_kind"), F.lit(None).cast("string").alias("cadence"), "box", F.lit(rule).alias("rule"),
    )


def _found(tokens: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    hit = tokens.withColumn("_m", F.regexp_extract(F.trim("text"), pattern, group))
    return hit.where(F.col("_m") != "")


def currency(tokens: DataFrame, currency_code: str = "BRL", lowest: float = 0.05, highest: float = 999999.0) -> DataFrame:
    """Prices, told from measures, codes, dates and percentages by the words around them.

    A currency sign or a cadence may stand on a neighbour: within 15 tokens and a
    small distance when there are boxes, else on the token before or after.
    """
    w = F.when(F.col("page_w") <= 1.0, 2000.0).otherwise(F.col("page_w"))
    h = F.when(F.col("page_h") <= 1.0, 3000.0).otherwise(F.col("page_h"))
    text = F.trim("text")
    t = tokens.withColumn("_t", text)
    cadence = F.regexp_extract("_t", CADENCE, 0)
    prices = t.withColumn("_m", F.regexp_extract("_t", PRICE, 1)).where(F.col("_m") != "").withColumns({
        "_far": 0.060 * w, "_rise": 0.015 * h, "_sym": F.col("_t").rlike(SYMBOL), "_cad": cadence})
    marks = t.withColumns({"_sym": F.col("_t").rlike(SYMBOL), "_cad": cadence}).where(F.col("_sym") | (F.col("_cad") != ""))
    slot = lambda c, k=0: (F.floor(c / (WINDOW + 1)) + k).alias("_slot")
    left = prices.select("doc_id", "pos", "box", "_far", "_rise", slot(F.col("pos")))
    right = marks.select("doc_id", F.col("pos").alias("v_pos"), F.col("box").alias("v_box"), F.col("_sym").alias("v_sym"), F.col("_cad").alias("v_cad"),
                         F.explode(F.array(*[slot(F.col("pos"), k) for k in (-1, 0, 1)])).alias("_slot"))
    gap = F.abs(F.col("pos") - F.col("v_pos"))
    boxed, v_boxed = F.col("box").isNotNull(), F.col("v_box").isNotNull()
    beside = boxed & v_boxed & (gap <= WINDOW) & (B.distance(F.col("box"), F.col("v_box")) <= F.col("_far")) & (
        F.abs(B.centre_y(F.col("box")) - B.centre_y(F.col("v_box"))) <= F.col("_rise"))
    near = left.join(right, ["doc_id", "_slot"]).where((gap > 0) & F.coalesce(beside | (~boxed & (gap == 1)), F.lit(False)))
    near = near.groupBy("doc_id", "pos").agg(
        F.bool_or("v_sym").alias("n_sym"), F.min_by(F.nullif("v_cad", F.lit("")), F.when(F.col("v_cad") != "", F.col("v_pos"))).alias("n_cad"))
    units = t.where(F.lower("_t").isin(*NEXT_UNITS)).select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("box").alias("u_box"), F.lit(True).alias("_unit"))
    p = prices.join(near, ["doc_id", "pos"], "left").join(units, ["doc_id", "pos"], "left")
    p = p.withColumn("_sym", F.col("_sym") | F.coalesce("n_sym", F.lit(False))).withColumn(
        "cadence", F.when(F.col("_cad") != "", F.trim("_cad")).otherwise(F.trim("n_cad")))
    marked = F.col("_sym") | F.col("cadence").isNotNull()
    odd = F.col("_t").rlike(MEASURED) | F.col("_t").rlike(DIMENSION) | F.col("_t").rlike(NOT_MONEY)
    followed = F.coalesce("_unit", F.lit(False)) & F.coalesce(
        F.when(F.col("box").isNotNull() & F.col("u_box").isNotNull(), B.distance(F.col("box"), F.col("u_box")) < F.col("_far")), F.lit(True))
    both = F.contains("_m", F.lit(".")) & F.contains("_m", F.lit(","))
    amount = F.translate(F.when(both, F.translate("_m", ".", "")).otherwise(F.col("_m")), ",", ".").try_cast("double")
    p = p.where(marked | ~(odd | followed)).withColumn("value_num", F.round(amount, 2)).where(F.col("value_num").between(lowest, highest))
    kind = F.when(F.col("_sym"), "explicit_currency").when(F.col("cadence").isNotNull(), "cadence_price").otherwise("bare_decimal")
    gain = F.when(F.col("_sym"), 0.15).when(F.col("cadence").isNotNull(), 0.10).otherwise(0.0)
    return p.select(
        "doc_id", "pos", "token_id", F.lit("CURRENCY").alias("type"), F.col("_t").alias("raw_text"), "value_num",
        F.lit(None).cast("string").alias("value_str"), F.lit(currency_code).alias("unit"),
        F.round(F.least(F.lit(1.0), F.col("confidence") + gain), 4).alias("confidence"), kind.alias("evidence_kind"),
        "cadence", "box", F.lit("currency").alias("rule"),
    )


def court_case(tokens: DataFrame) -> DataFrame:
    return _anchor(_found(tokens, COURT_CASE), "court_case", "LEGAL_PROCESS", text=F.col("_m"), unit=F.lit("PROCESSO_CNJ"),
                   gain=0.10, evidence="temporal_code")


def percentage(tokens: DataFrame) -> DataFrame:
    number = F.round(F.translate("_m", ",", ".").try_cast("double"), 2)
    return _anchor(_found(tokens, PERCENT).where(number.isNotNull()), "percentage", "PERCENTAGE", number=number, unit=F.lit("PERCENT"), gain=0.05)


def salary(tokens: DataFrame, currency_code: str = "BRL", lowest: float = 500.0) -> DataFrame:
    """Pay of at least ``lowest``, with a pay word here or just before, or a currency sign."""
    before = tokens.where(F.col("text").rlike(SALARY_WORD)).select("doc_id", (F.col("pos") + 1).alias("pos"), F.lit(True).alias("_before"))
    t = _found(tokens, SALARY).join(before, ["doc_id", "pos"], "left")
    told = F.trim("text").rlike(SALARY_WORD) | F.coalesce("_before", F.lit(False)) | F.contains("text", F.lit("$"))
    number = F.translate(F.translate("_m", ".", ""), ",", ".").try_cast("double")
    return _anchor(t.where(told & (number >= lowest)), "salary", "SALARY", number=F.round(number, 2), unit=F.lit(currency_code), gain=0.15)


def tax_id(tokens: DataFrame) -> DataFrame:
    company, person = F.regexp_extract(F.trim("text"), COMPANY_ID, 0), F.regexp_extract(F.trim("text"), PERSON_ID, 0)
    t = tokens.withColumn("_company", company).withColumn("_m", F.when(F.col("_company") != "", F.col("_company")).otherwise(person)).where(F.col("_m") != "")
    unit = F.when(F.col("_company") != "", "CNPJ").otherwise("CPF")
    return _anchor(t, "tax_id", "TAX_ID", text=F.col("_m"), unit=unit, evidence="temporal_code")


def calendar_date(tokens: DataFrame) -> DataFrame:
    return _anchor(_found(tokens, DATE), "calendar_date", "DATE", text=F.col("_m"), unit=F.lit("DATE_ISO"), evidence="temporal_code")


def measurement(tokens: DataFrame) -> DataFrame:
    return _anchor(_found(tokens, MEASURE), "measurement", "MEASUREMENT", text=F.col("_m"), evidence="specification", raw=F.col("_m"))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "currency": currency, "court_case": court_case, "percentage": percentage, "salary": salary,
    "tax_id": tax_id, "calendar_date": calendar_date, "measurement": measurement,
}


# Fixed value: rules of this module, which look at nothing but what ``telling_tokens`` keeps.
_OWN = tuple(RULES.values())


def telling_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that one of this module's rules can match or look at from a neighbour; places stay.

    Every value has a digit, a mark has a sign, a slash or a blank; the other
    neighbours are units and words of pay.
    """
    text = F.col("text")
    pay = F.when(F.length(text) >= 5, text.rlike(SALARY_WORD)).otherwise(False)
    return tokens.select(*[c for c in tokens.columns if c in TOKEN_COLUMNS]).where(
        text.rlike(r"[\p{Nd}$€£/\s]") | F.lower(F.trim(text)).isin(*NEXT_UNITS) | pay)


def detect_anchors(tokens: DataFrame, rules: list[str | Callable] = ("currency",)) -> DataFrame:
    """Anchors of all ``rules`` (names in RULES or callables), overlapping ones reduced to the surest.

    ``anchor_no`` numbers a page's anchors by confidence, then rule and place.
    """
    run = [RULES[r] if isinstance(r, str) else r for r in rules]
    # rules read their tokens several times: those that can matter are made and written once; a rule of the caller's may look at any token
    own = all(r in _OWN for r in run)
    seen = cut(telling_tokens(tokens)) if own else tokens
    frames = [r(seen).select(*ANCHOR_COLUMNS).withColumn("_rule_no", F.lit(i)) for i, r in enumerate(run)]
    kept = suppress_overlaps(reduce(DataFrame.unionByName, frames), seen)
    if own:
        drop_cut(seen)  # what is kept was written
    order = [F.desc("confidence"), F.asc("_rule_no"), F.asc("pos")]
    return numbered(kept, order, "anchor_no").drop("_rule_no")


def suppress_overlaps(anchors: DataFrame, tokens: DataFrame, most: float = 0.60, grid: int = 32) -> DataFrame:
    """Anchors less those that overlap a surer kept one by more than ``most`` of their union.

    Such boxes hold each other's centres, so they meet in the grid cell of a centre.
    """
    a = cut(anchors.withColumn("_order", F.struct((-F.col("confidence")).alias("c"), F.col("_rule_no").alias("r"), F.col("pos").alias("p"))))
    solid = B.area(F.col("box")) > 0
    boxed, rest = a.where(solid), a.where(~F.coalesce(solid, F.lit(False)))
    # identical boxes: the surest stands for all
    others = [c for c in boxed.columns if c not in ("doc_id", "box")]
    boxed = cut(first_by(boxed, ["doc_id", "box"], [F.col("_order.c"), F.col("_order.r"), F.col("_order.p")], others))
    size = tokens.groupBy("doc_id").agg((F.greatest(F.first("page_w"), F.lit(1.0)) / grid).alias("_sx"), (F.greatest(F.first("page_h"), F.lit(1.0)) / grid).alias("_sy"))
    g = boxed.select("doc_id", "box", "_order").join(size, "doc_id")
    cell = lambda x, s: F.floor(x / F.col(s))
    b = F.col("box")
    centre = g.select("doc_id", F.col("box").alias("a_box"), F.col("_order").alias("a"), cell(B.centre_x(b), "_sx").alias("gx"), cell(B.centre_y(b), "_sy").alias("gy"))
    cover = g.select("doc_id", F.col("box").alias("b_box"), F.col("_order").alias("b"), "_sy", b["y_min"].alias("y1"), b["y_max"].alias("y2"),
                     F.explode(F.sequence(cell(b["x_min"], "_sx"), cell(b["x_max"], "_sx"))).alias("gx"))
    cover = cover.withColumn("gy", F.explode(F.sequence(cell(F.col("y1"), "_sy"), cell(F.col("y2"), "_sy"))))
    edges = centre.join(cover, ["doc_id", "gx", "gy"]).where((F.col("a") < F.col("b")) & (B.iou(F.col("a_box"), F.col("b_box")) > most))
    edges = cut(edges.select("doc_id", "a", "b").distinct())
    if edges.isEmpty():
        return boxed.unionByName(rest, allowMissingColumns=True).drop("_order")
    dropped = suppressed(edges)
    alive = boxed.join(dropped, (boxed["doc_id"] == dropped["doc_id"]) & (boxed["_order"] == dropped["b"]), "left_anti")
    return alive.unionByName(rest).drop("_order")


def suppressed(edges: DataFrame) -> DataFrame:
    """Nodes (doc_id, b) a scan in order drops, given edges from a node to later ones it would drop.

    Each round keeps the nodes no open edge leads to and drops what they point at.
    """
    gone = None
    while True:
        targets = edges.select("doc_id", F.col("b").alias("a")).distinct()
        sure = edges.select("doc_id", "a").distinct().join(targets, ["doc_id", "a"], "left_anti")
        fell = cut(edges.join(sure, ["doc_id", "a"], "left_semi").select("doc_id", "b").distinct())
        gone = fell if gone is None else gone.unionByName(fell)
        settled = fell.select("doc_id", F.col("b").alias("a"))
        edges = edges.join(sure, ["doc_id", "a"], "left_anti").join(settled, ["doc_id", "a"], "left_anti").join(fell, ["doc_id", "b"], "left_anti")
        edges = cut(edges)
        if edges.isEmpty():
            return gone
