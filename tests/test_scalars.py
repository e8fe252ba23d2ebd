"""Expressions against known values."""

from pyspark.sql import functions as F

from tidewatch.functions import text as T, urls as U


def column(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_normalise(spark):
    got = column(spark, T.normalise, ["Áçúcar Cristal", "  SUPERMERCADO   PINHEIRO  ", None, "123", "ﬁm m² ½…", "é x"])
    assert got == ["acucar cristal", "supermercado pinheiro", "", "123", "fim m2 1⁄2...", "e x"]


def test_latin1(spark):
    got = column(spark, T.latin1, ["Relatório — Preço de “Café” & Chá • Promoção"])
    assert got == ['relatorio - preco de "cafe" & cha - promocao']


def test_terms(spark):
    has = lambda c: T.has_term(T.normalise(c), "Pinheiro")
    assert column(spark, has, ["Supermercado Pinheiro Teresina", "supermercados pinheiros", ""]) == [True, False, False]
    assert column(spark, lambda c: T.has_term(c, ""), ["texto"]) == [False]


def test_money(spark):
    got = column(spark, T.parse_money, ["R$ 1.290,50", "1290,50", "R$ 9,99", "7.99", "0,00", None, "", "sem preco", "1.290", "-3"])
    assert got == [1290.5, 1290.5, 9.99, 7.99, 0.0, None, None, None, 1.29, None]


def test_quantity(spark):
    got = column(spark, T.quantity, ["1kg", "500g", "1.5 kg", "1 l", "200 ml", "2 un", "invalido", "1 lata", "3 m²"])
    assert [tuple(x) for x in got] == [
        (1000.0, "g"), (500.0, "g"), (1500.0, "g"), (1000.0, "ml"), (200.0, "ml"), (2.0, "un"), (None, None), (1000.0, "ml"), (3.0, "m2")]


def test_clamp(spark):
    got = column(spark, lambda c: T.clamp_score(c.cast("double")), ["-15.5", "150", "75.4", "75.6", "2.5"])
    assert got == [0, 100, 75, 76, 2]


def test_dates(spark):
    got = column(spark, lambda c: T.parse_date(c).cast("string"), [
        "2026-08-10", "2026-08-10T10:00:00", "2026-08-10T10:00:00-0300", "10/08/2026", "2026/08/10", "Mon, 10 Aug 2026 07:00:00 GMT",
        "2026-08-10T10:00:00.000Z", "2026-13-10", "ontem", ""])
    assert got == ["2026-08-10"] * 7 + [None, None, None]


def test_urls(spark):
    dirty = "https://www.loja.com.br/produtos/arroz/?utm_source=google&utm_medium=cpc&gclid=12345&id=99"
    got = column(spark, U.normalise_url, [dirty, "HTTP://A.com//x///y/#z", "https://a.com", "", "//b.com/p;v=1?q="])
    assert got == ["https://loja.com.br/produtos/arroz?id=99", "http://a.com/x/y", "https://a.com/", "", "https://b.com/p?q="]
    assert column(spark, U.host, ["https://www.pinheirosupershop.com.br/catalogo", "http://g1.globo.com/pi/noticia", "invalido"]) == [
        "pinheirosupershop.com.br", "g1.globo.com", ""]
    dates = lambda c: U.date_in_url(c).cast("string")
    assert column(spark, dates, ["https://a/2026/08/10/x", "https://a/2026-08-10", "https://a/2026/02/31/x", "https://a/1999/01/01/"]) == [
        "2026-08-10", "2026-08-10", None, None]


def test_truncate(spark):
    got = column(spark, lambda c: T.truncate_words(c, 25), ["curto", "uma frase que passa do limite dado"])
    assert got == ["curto", "uma frase que passa..."]
