"""History tables, logs, landing files, exports and streams."""

from pyspark.sql import functions as F

from tidewatch.operators.gates import latest_observations, operational_summary
from tidewatch.sources import exports, history as H, landing as L
from tidewatch.streaming import feeds

SOURCE = "id long, fingerprint string, url string, title string, category string, score double, is_current boolean, body string"
EVENT = "event_key string, kind string, title string, importance int, evidence_ids array<string>"


def test_runs(spark, tmp_path):
    h = H.History(spark, str(tmp_path / "h"))
    first = spark.createDataFrame([(1, "a", "u", "t", "c", 1.0, True, "x"), (2, "b", "u", "t", "c", 1.0, True, "y")], SOURCE)
    events = spark.createDataFrame([("k1", None, None, 50, ["1", "x", "2"])], EVENT)
    d = h.save_run("r1", first, events, "2026-01-01").first()
    assert (d["previous_run"], d["new_sources"], d["changed_sources"]) == (None, 0, 0)
    second = spark.createDataFrame([(1, "a", "u", "t", "c", 1.0, True, "x2"), (2, "n", "u", "t", "c", 1.0, True, "y")], SOURCE)
    d = h.save_run("r2", second, events, "2026-01-02").first()
    assert (d["previous_run"], d["new_sources"], d["changed_sources"]) == ("r1", 1, 1)
    assert h.previous_run() == "r2" and h.previous_run(before="r2") == "r1"
    e = h.events("r1").first()
    assert (e["kind"], e["title"], e["evidence_ids"]) == ("MOVIMENTO", "Evento sem título", [1, 2])
    h.save_run("r1", first, events, "2026-01-01")
    assert h.read("sources", "r1").count() == 2 and h.read("sources").count() == 4


def test_price_history(spark, tmp_path):
    h = H.History(spark, str(tmp_path / "h"))
    cols = "pos long, entity string, role string, source_domain string, product_key string, product_name string, price double, promotion boolean, url string"
    row = lambda price, promo: spark.createDataFrame([(1, "e", "target", "d", "k", "K", price, promo, "")], cols)
    none_s, none_e = spark.createDataFrame([], SOURCE), spark.createDataFrame([], EVENT)
    assert h.save_price_snapshots("r1", row(6.0, True), "t1").count() == 0
    h.save_run("r1", none_s, none_e, "2026-01-01")
    c = h.save_price_snapshots("r2", row(6.9, False), "t2").first()
    assert (c["change_pct"], c["promotion_before"], c["promotion_now"]) == (15.0, True, False)
    assert h.read("price_snapshots", "r2").first()["price"] == 6.9


def test_log(spark, tmp_path):
    path = tmp_path / "log"
    rows = spark.createDataFrame([("r", "d1", "h1"), ("r", "d2", "h1"), ("s", "d3", "h2")], "run_id string, document_id string, document_hash string")
    H.append_log(rows, str(path))
    (path / "junk.json").write_text('{bad\n\n"text"\n{"other": 1}\n')
    assert H.read_log(spark, str(path)).count() == 3 and H.read_log(spark, str(path), run_id="r").count() == 2
    log = H.read_log(spark, str(path)).withColumn("pos", F.monotonically_increasing_id())
    assert latest_observations(log).count() == 2


def test_empty_summary(spark):
    cols = "run_id string, document_hash string, items long, crashes long, exceptions long, latency_ms double, fp_generic long, fn_generic long, price_divergence long, unit_divergence long, duplicate long, unresolved long, name_improvement long"
    r = operational_summary(spark.createDataFrame([], cols)).first()
    assert r["records"] == 0 and r["p99"] == 0.0 and r["items"] == 0


def test_feed_and_ocr_files(spark, tmp_path):
    items = "".join(f"<item><title>t{i}</title><link>u{i}</link><description>&lt;b&gt;x&lt;/b&gt; y</description><pubDate>Mon, 10 Aug 2026 07:00:00 GMT</pubDate></item>" for i in range(12))
    (tmp_path / "a.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    assert L.read_feed(spark, str(tmp_path / "a.xml"), "empresa").count() == 12
    feed = L.read_feed(spark, str(tmp_path / "a.xml"), "empresa", per_query=10).collect()
    assert len(feed) == 10 and {r["snippet"] for r in feed} == {"x y"}
    (tmp_path / "o.json").write_text('{"arquivo":"p","deteccoes":[{"id":7,"texto":"A","x_min":1,"y_min":2,"x_max":50,"y_max":60,"confianca":0.5},{"texto":"B"}]}')
    t = {r["text"]: r for r in L.read_ocr(spark, str(tmp_path / "o.json")).collect()}
    assert t["A"]["token_id"] == 7 and t["B"]["token_id"] == 2 and t["A"]["page_w"] == 50.0 and t["B"]["confidence"] == 1.0
    (tmp_path / "c.json").write_text('{"arquivo":"p","cards":[{"preco":{"texto":"R$ 1,50"},"textos":[{"texto":"a"},{"texto":"b"},{"texto":"c"}]},{"preco":{"texto":"?"},"textos":[]}]}')
    c = L.read_cards(spark, str(tmp_path / "c.json"), "Shop A").orderBy("pos").collect()
    assert [(r["name"], r["price"], r["availability"]) for r in c] == [("a b", 1.5, "in_stock"), ("Produto sem nome", None, "unknown")]


def test_stream_equals_batch(spark):
    from tidewatch.plans.registry import QUERIES

    from conftest import SMALL

    a = {tuple(r) for r in QUERIES["price_change_stream"](spark, SMALL).collect()}
    b = {tuple(r) for r in QUERIES["price_change_replay"](spark, SMALL).collect()}
    assert a == b and a


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "título", "u", "2026-01-01", "web", "local", True, 80.04, 0.12345)],
                               "id long, category string, title string, url string, published string, channel string, scope string, is_current boolean, score double, confidence double")
    exports.export_sources_csv(df, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("*.csv"))
    # every part has its header
    assert set(text.splitlines()) == {"ID;Categoria;Titulo;URL;Data;Origem;Escopo;Atual;Score;Confianca", "1;c;título;u;2026-01-01;web;local;True;80.0;0.123"}
    exports.export_json({"s": df}, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "s")).count() == 1
