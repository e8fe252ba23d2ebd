"""Products, matching and price comparison."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import matching as M, products as D

ITEM = "struct<name:string,brand:string,unit:string,sku:string>"


def similarity(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {ITEM}, b {ITEM}")
    return [r["similarity"] for r in M.product_similarity(df).orderBy("i").collect()]


def test_similarity(spark):
    rice = ("Arroz Tio João Parboilizado 1kg", "Tio João", "1kg", "SKU123")
    got = similarity(spark, [
        (rice, ("Arroz Tio João Parbo 1000g", "Tio João", "1000g", "SKU123")),
        (rice, ("Sabão em Pó Omo Lavagem Perfeita 1kg", "Omo", "1kg", "SKU999")),
        (("Óleo de Soja Soya 900ml", "Soya", "900ml", ""), ("Óleo Soja Soya 900 ml", "Soya", "900ml", "")),
        (("Arroz Camil 1kg", "Camil", "1kg", "SKU1"), ("Detergente Ypê Neutro 500ml", "Ypê", "500ml", "")),
    ])
    assert got[0] >= 0.90 and got[1] < 0.35 and got[2] >= 0.85 and got[3] < 0.35


def test_matching_equals_all_pairs(spark):
    """The best of all pairs, comparable or not; a competitor without items finds nothing."""
    rng = random.Random(7)
    words = "arroz branco tio cafe pilao forte suave leite integral po sabao em de kg".split()
    others = "zyx wvu tsr".split()
    make = lambda words: (" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), rng.choice(["", "A", "B"]), rng.choice(["", "1kg", "1000g", "500 ml", "2 un", "caixa"]),
                          rng.choice(["", "", "s1", "s2"]))
    cols = "name string, brand string, unit string, sku string, price double, old_price double, promotion boolean, url string"
    t_rows = [(i, *make(words if i < 40 else others), rng.choice([10.0, 10.0, 1.0, None]), None, False, "t") for i in range(50)]
    c_rows = [(rng.choice("xy"), i, *make(words), 11.0, None, False, "c") for i in range(150)]
    targets = spark.createDataFrame(t_rows, "target_id long, " + cols)
    catalogue = spark.createDataFrame(c_rows, "competitor string, pos long, " + cols)
    rivals = spark.createDataFrame([("x",), ("y",), ("z",)], "competitor string")
    for items in (catalogue, catalogue.where("name not in ('em', 'de', 'kg', 'em em', 'de de')")):
        got = {(r["target_id"], r["competitor"]): r for r in M.match_products(targets, items, competitors=rivals).collect()}
        assert len(got) == 150
        s = lambda df, n: df.withColumn(n, F.struct("name", "brand", "unit", "sku"))
        pairs = s(targets, "a").select("target_id", "a").join(s(items, "b").select("competitor", "pos", "b"), F.lit(True))
        best = {}
        for r in M.product_similarity(pairs).collect():
            k, v = (r["target_id"], r["competitor"]), (-r["similarity"], r["pos"])
            if k not in best or v < best[k][:2]:
                best[k] = (*v, r["b"]["name"])
        assert len(best) == 100
        price = {r[0]: r[5] for r in t_rows}
        for k, (neg, _, name) in best.items():
            r = got[k]
            assert (r["competitor_product"], r["similarity"]) == (name, round(-neg, 3)), k
            if -neg < 0.72 or price[k[0]] is None:
                assert r["match_class"] == "nao_comparavel" and r["cheaper"] == "não comparável" and r["gap_percent"] is None
            else:
                assert r["match_class"] == ("revisao_necessaria" if price[k[0]] == 1.0 else "confirmado" if -neg >= 0.90 else "provavel")
        for i in range(50):
            r = got[(i, "z")]
            assert (r["match_class"], r["cheaper"], r["similarity"], r["competitor_product"], r["match_confidence"]) == ("nao_encontrado", "não encontrado", 0.0, None, "baixa")
        assert {r["match_class"] for r in got.values()} == {"confirmado", "provavel", "revisao_necessaria", "nao_comparavel", "nao_encontrado"}


def test_admission_of_items(spark):
    rows = [("Arroz 1kg", "https://a.com.br/produto/1", "product_jsonld", 0.70), ("Arroz 2kg", "https://a.com.br/produto/2", "product_jsonld", 0.69),
            ("Arroz 3kg", "https://a.com.br/noticias/3", "product_jsonld", 0.95), ("Arroz 4kg", "https://a.com.br/x", "", None)]
    items = spark.createDataFrame(rows, "name string, url string, page_type string, price_confidence double")
    assert [r["name"] for r in M.admitted(items).collect()] == ["Arroz 1kg"]


PAGE = "page_id long, source string, role string, url string, html string, location_note string"


def test_products_of_pages(spark):
    linked = ('<html><head><script type="application/ld+json">{"@type":"Product","name":"Arroz Branco Tio João 1kg","brand":{"@type":"Brand","name":"Tio João"},'
              '"sku":"TJ-1001","offers":{"@type":"Offer","price":"6.89"}}</script></head><body><h1>P</h1></body></html>')
    text = ('<html><body><div class="card-produto"><a href="/p">Feijão Carioca Camil 1kg</a><span class="preco">R$ 8,49</span>'
            '<button>Comprar oferta</button></div></body></html>')
    broken = '<html><head><script type="application/ld+json">{ "name": "Produto Incompleto", "offers": ... }</script></head><body>C</body></html>'
    nested = ('<script type="application/ld+json">{"catalog":{"items":[{"@type":"Product","name":"Item A","price":10.0},{"nested":{"@type":"Product","name":"Item B",'
              '"offers":[{"price":"x"},{"priceSpecification":1,"price":"20,00"}]}}]}}</script><p>buy now</p>')
    news = '<html><body><div><a>Feijão Camil 1kg</a> R$ 8,49 comprar</div></body></html>'
    df = spark.createDataFrame([
        (1, "C", "target", "https://c.com.br/produto/arroz", linked, ""), (2, "M", "competitor", "https://m.com.br/ofertas", text, ""),
        (3, "A", "competitor", "https://a.com.br/x", broken, ""), (4, "A", "competitor", "https://a.com.br/", nested, ""),
        (5, "N", "competitor", "https://n.com/news/1", news, "")], PAGE)
    got = {(r["page_id"], r["name"]): r for r in D.page_products(df).collect()}
    assert set(got) == {(1, "Arroz Branco Tio João 1kg"), (2, "Feijão Carioca Camil 1kg"), (4, "Item A"), (4, "Item B")}
    rice = got[(1, "Arroz Branco Tio João 1kg")]
    assert (rice["price"], rice["brand"], rice["sku"]) == (6.89, "Tio João", "TJ-1001")
    assert got[(2, "Feijão Carioca Camil 1kg")]["price"] == 8.49 and got[(4, "Item B")]["price"] == 20.0


def test_offers_of_any_depth(spark):
    """Against a recursion over the objects themselves."""
    import json
    rng = random.Random(3)
    keys = ["price", "lowPrice", "salePrice", "value"]

    def thing(depth):
        o = {k: rng.choice(["0", "x", None, 0, "7,50", 12.5, -3]) for k in rng.sample(keys, rng.randint(0, 2))}
        if depth and rng.random() < 0.9:
            inner = lambda: rng.choice([thing(depth - 1), thing(depth - 1), "3,20", 0, None])
            o["offers"] = [inner() for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else {
                k: inner() for k in rng.sample(["price", "lowPrice", "priceSpecification"], rng.randint(0, 3))}
        return o

    def money(x):
        if isinstance(x, str):
            x = x.replace(",", ".")
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.0

    def price(o):
        for k in D.PRICE_KEYS:
            if money(o.get(k)) > 0:
                return money(o[k])
        offers = o.get("offers")
        parts = [offers.get(k) for k in D.OFFER_KEYS] if isinstance(offers, dict) else [x for x in offers or [] if isinstance(x, dict)]
        for x in parts:
            p = price(x) if isinstance(x, dict) else money(x)
            if p and p > 0:
                return p
        return None

    deep = {"price": "4,00"}
    for i in range(9):
        deep = {"offers": [{"price": "0"}, deep]} if i % 2 else {"offers": {"priceSpecification": deep}}
    objects = [deep, *(thing(6) for _ in range(150))]
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "page_id long, j string").select(
        "page_id", F.array(F.lit(0)).alias("visit"), F.parse_json("j").alias("obj"))
    got = {r["page_id"]: r["price"] for r in D.with_price(df).select("page_id", "price").collect()}
    assert got == {i: p for i, o in enumerate(objects) if (p := price(o)) is not None}
    assert got[0] == 4.0 and len(got) > 50


def test_priced_text_in_linear_time():
    import time
    from tidewatch.functions.markup import _price_contexts

    card = '<div><a href="/p">Item {0}</a><b>R$ {0},00</b> comprar <a>more</a></div>'
    got = _price_contexts("<p>R$ 1,00</p><script>R$ 3</script><ul><li>" + card.format(7) + "</li></ul><br>tail <a><i>R$ 2,00")
    assert got[0] == {"context": "R$ 1,00 Item 7 R$ 7,00 comprar more tail R$ 2,00", "links": ["Item 7", "more", "R$ 2,00"]}
    assert {"context": "Item 7 R$ 7,00 comprar more", "links": ["Item 7", "more"]} in got
    start = time.time()
    assert len(_price_contexts("".join(f"<section>{card.format(i)}</section>" for i in range(100_000)))) == 100_000
    assert len(_price_contexts("<u>" * 20_000 + "</b>" * 100_000 + "R$ 5,00")) == 1
    assert time.time() - start < 30


def test_price_war_median_is_the_upper_one(spark):
    df = spark.createDataFrame([("c", i, g, "alvo", False, False) for i, g in enumerate([1.0, -9.0, 3.0, 4.0])],
                               "competitor string, target_id long, gap_percent double, cheaper string, target_promotion boolean, competitor_promotion boolean")
    r = M.price_war(df).first()
    assert (r["median_gap"], r["largest_gap"], r["mean_gap"]) == (3.0, -9.0, -0.25)


def test_price_sources_are_not_cut(spark, tmp_path):
    """Every link of a seed's page and every domain is reported, as no top list was asked for."""
    from tidewatch.plans import trade_queries as Q

    links = "".join(f'<a href="/product/{i}">the offer</a>' for i in range(7))
    pages = [(h, f"https://shop{h:02d}.org/", f"<html><body>{links}</body></html>") for h in range(25)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {(r["domain"], r["url"]) for r in Q.price_sources(spark, str(tmp_path)).where("name = 'org'").collect()}
    want = {(f"shop{h:02d}.org", f"https://shop{h:02d}.org/product/{i}") for h in range(25) for i in range(7)}
    assert want <= found
    merged = Q.merged_price_sources(spark, str(tmp_path)).groupBy("role").agg(F.countDistinct("domain").alias("n")).collect()
    assert {r["role"]: r["n"] for r in merged} == {"target": 25, "competitor": 25}
