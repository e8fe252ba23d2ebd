"""Exports and report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

ENGINE = "extractors_v2_generic"


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def source_sheet(sources: DataFrame) -> DataFrame:
    """The ten export columns of sources, score to one decimal, confidence to three."""
    return sources.select(
        F.col("id").alias("ID"), F.col("category").alias("Categoria"), F.col("title").alias("Titulo"), F.col("url").alias("URL"),
        F.col("published").alias("Data"), F.col("channel").alias("Origem"), F.col("scope").alias("Escopo"),
        F.when(F.col("is_current"), "True").otherwise("False").alias("Atual"),
        T.round_half_up(F.col("score"), 1).alias("Score"), T.round_half_up(F.col("confidence"), 3).alias("Confianca"),
    )


def export_sources_csv(sources: DataFrame, path: str) -> None:
    """Sources as semicolon-separated text with a header (UTF-8, no byte-order mark)."""
    source_sheet(sources).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def latin1_sheet(df: DataFrame) -> DataFrame:
    """Every text column reduced to Latin-1, for outputs that know nothing else."""
    return df.select([T.latin1(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def card_rows(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """Flyer products in the card layout: price text with comma, region, texts, name and weight.

    ``texts`` holds doc_id, anchor_no, text, confidence, place, is_condition.
    """
    told = texts.where(~F.col("is_condition")).groupBy("doc_id", "anchor_no").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("text").alias("texto"), F.col("confidence").alias("confianca"), F.col("box").alias("bbox")))).alias("t"))
    return entities.join(told, ["doc_id", "anchor_no"], "left").select("doc_id", *_card(F.col, F.transform("t", lambda x: x.dropFields("place"))))


def _card(e: Callable[[str], Column], texts: Column) -> list[Column]:
    """The fields of a product's card; ``e`` gives the product's columns."""
    price = F.coalesce(F.replace(F.format_string("%.2f", e("value")), F.lit("."), F.lit(",")), F.lit(""))
    return [
        e("region_no").alias("id"), F.lit(1).alias("linha"), F.struct(price.alias("texto"), e("value").alias("valor")).alias("preco"),
        e("region_box").alias("regiao"), texts.alias("textos"),
        F.struct(e("name").alias("nome"), F.coalesce(e("measure"), F.lit("")).alias("peso_volume"), e("confidence").alias("confianca")).alias("produto_normalizado"),
    ]


def card_documents(cards: DataFrame) -> DataFrame:
    """Cards gathered per page, as the card files hold them; a page is one document."""
    return cards.groupBy(F.col("doc_id").alias("arquivo")).agg(
        F.count(F.lit(1)).alias("total_precos"), F.count(F.lit(1)).alias("total_cards"), F.lit(ENGINE).alias("engine_utilizado"),
        F.array_sort(F.collect_list(F.struct("id", "linha", "preco", "regiao", "textos", "produto_normalizado"))).alias("cards"))


def page_documents(pages: DataFrame) -> DataFrame:
    """The same of pages with their ``products`` (``flyer_pages.product_pages``), which need not be gathered again."""
    def card(e: Column) -> Column:
        texts = F.transform(e["told"], lambda t: F.struct(t["text"].alias("texto"), t["confidence"].alias("confianca"), t["box"].alias("bbox")))
        return F.struct(*_card(lambda name: e[name], texts))

    n = F.size("products").cast("long")
    return pages.select(F.col("doc_id").alias("arquivo"), n.alias("total_precos"), n.alias("total_cards"), F.lit(ENGINE).alias("engine_utilizado"),
                        F.transform("products", card).alias("cards"))


def _report() -> dict[str, tuple[tuple, int | None]]:
    """The report's tables: their order, and how many rows the report shows (all where None)."""
    return {
        "signals": (("rank",), 8),
        "events": (("rank",), 15),
        "price_gaps": ((F.desc(F.abs("gap_percent")), "competitor", "target_id"), 6),
        "price_war": ((F.desc("competitor_cheaper"), F.desc(F.abs("mean_gap")), "competitor"), 10),
        "price_changes": (("entity", "source_domain", "product_key"), 12),
        "sources": (("id",), 80),
        "gaps": (("position",), None),
    }


def report_tables(**tables: DataFrame) -> dict[str, DataFrame]:
    """The named tables of the report, each with the rows it shows."""
    out = {}
    for name, df in tables.items():
        order, shown = _report()[name]
        out[name] = df.orderBy(*order) if shown is None else df.orderBy(*order).limit(shown)
    return out
