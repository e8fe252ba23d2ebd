"""Sources, events and scores."""

import difflib
import random

from pyspark.sql import functions as F

from tidewatch.operators import deltas, events as E, evidence as V, pages as P, prices as C, scores as S, signals as G
from tidewatch.functions import similarity, text as T
from tidewatch.rules import RadarProfile

HIT = "pos long, title string, url string, snippet string, channel string, published string, category string, target string"
PROFILE = RadarProfile(company="Supermercado Pinheiro", city="Teresina", state="PI", homonyms=("pinheiro material de construcao",))


def test_admission(spark):
    rows = [
        (1, "Supermercado Pinheiro abre loja", "https://www.x.com/a?utm_source=1", "em Teresina PI, nova loja e oferta", "web", "2026-07-01", "g", "Supermercado Pinheiro"),
        (2, "Pinheiro material de construcao", "https://x.com/b", "ferramentas em Teresina", "web", "", "g", "Supermercado Pinheiro"),
        (3, "Outra coisa", "https://x.com/c", "nada", "web", "", "g", "Supermercado Pinheiro"),
        (4, "Supermercado Pinheiro", "https://x.com/d", "in London", "web", "", "g", "Supermercado Pinheiro"),
        (5, "Mateus cresce", "https://x.com/e", "rede em Fortaleza", "web", "10/05/2019", "g", "Mateus"),
        (6, "Mateus cresce", "https://x.com/e2", "rede em Fortaleza", "web", "10/05/2024", "g", "Mateus"),
        (7, "Mercado", "https://x.com/f", "tendencias", "web", "", "g", "mercado"),
        (8, "sem url", "", "Supermercado Pinheiro Teresina", "web", "", "g", "Supermercado Pinheiro"),
    ]
    got = {r["pos"]: r for r in V.classify_hits(spark.createDataFrame(rows, HIT), PROFILE).collect()}
    assert [got[i]["reject_reason"] for i in range(1, 9)] == [None, "homonym", "entity_not_named", "foreign", "too_old", None, None, "no_url"]
    assert got[1]["scope"] == "local" and got[6]["scope"] == "concorrente" and got[7]["scope"] == "mercado"
    assert got[1]["topics"] == ["preço", "expansão"]
    # alias 34, city 18, current 18, local 6, two topics 4
    assert got[1]["score"] == 80.0 and got[1]["confidence"] == 1.0


def test_dedup_follows_the_scan(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 3)), f"u{rng.randint(0, 12)}", f"f{rng.randint(0, 12)}") for i in range(60)]
    kept, urls, prints = [], set(), set()
    for i, s, u, f in sorted(rows, key=lambda r: -r[1]):
        if u not in urls and f not in prints:
            kept.append(i)
            urls.add(u)
            prints.add(f)
    df = spark.createDataFrame(rows, "pos long, score double, url string, fingerprint string")
    for parts in (1, 7):
        got = V.deduplicate(df.repartition(parts)).orderBy("id").collect()
        assert [r["pos"] for r in got] == kept and [r["id"] for r in got] == list(range(1, len(kept) + 1))


def fold(rows, title_min, token_min, days):
    """The plain scan: each fact joins the first leader telling the same."""
    norm = lambda s: " ".join(s.lower().split())
    words = lambda s: {w for w in norm(s).split() if len(w) >= 3 and w not in {"que", "com", "por"}}
    leaders, out = [], {}
    for r in rows:
        for c in leaders:
            if c["group"] != r["group"]:
                continue
            if r["day"] is not None and c["day"] is not None:
                if abs(r["day"] - c["day"]) > days:
                    continue
            elif r["day"] is not None or c["day"] is not None:
                continue
            a, b = words(c["title"]), words(r["title"])
            tok = len(a & b) / len(a | b) if a and b else 0
            if tok >= token_min or difflib.SequenceMatcher(None, norm(c["title"]), norm(r["title"])).ratio() >= title_min:
                if len(r["title"]) > len(c["title"]):
                    c["title"] = r["title"]
                out[r["id"]] = c["id"]
                break
        else:
            leaders.append(dict(r))
            out[r["id"]] = r["id"]
    return out


def test_event_folding_matches_the_scan(spark):
    rng = random.Random(11)
    vocab = "loja nova centro abre vagas rede oferta preco grande praia norte sul mercado bairro shopping festa".split()
    rows, seen = [], set()
    for i in range(1, 181):
        title = " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 7)))
        day = None if rng.random() < 0.15 else rng.randint(0, 150)
        group = rng.choice([("a", "DIGITAL"), ("a", "DIGITAL"), ("a", "DIGITAL"), ("b", "PREÇO")])
        if (title, day, group) not in seen:
            seen.add((title, day, group))
            rows.append({"id": i, "title": title, "day": day, "group": group})
    df = spark.createDataFrame([(r["id"], r["title"], r["day"], *r["group"]) for r in rows], "source_id long, title string, d int, entity string, kind string")
    df = df.withColumn("date", F.coalesce(F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")).cast("string"), F.lit(""))).drop("d")
    want = fold(rows, 0.62, 0.40, 45)
    assert len(set(want.values())) < len(want)
    for block in (500, 7):
        got = {r["source_id"]: r["leader"] for r in E.assign_facts(df, 0.62, 0.40, 45, block).collect()}
        assert got == want


def test_event_totals_match_the_fold(spark):
    rng = random.Random(5)
    rows = [(i, f"key{i}", "DIGITAL", "t" * rng.randint(12, 30), rng.randint(5, 40), rng.randint(30, 60) / 100, "2026-01-01", "local", "x",
             ["DIGITAL"], f"d{rng.choice([1, 1, 1, 2, 3])}", f"u{i % 20:02d}", False, i % 3 == 0, True, 1 if i < 8 else 9 if i < 10 else 10) for i in range(1, 100)]
    df = spark.createDataFrame(rows, (
        "source_id long, event_key string, kind string, title string, importance int, confidence double, date string, scope string, entity string, "
        "dimensions array<string>, origin string, url string, direct boolean, is_current boolean, contextual boolean, leader long"))
    got = {r["event_id"]: r for r in E.build_events(df, None).collect()}
    for lead in (1, 9, 10):
        mine = [r for r in rows if r[-1] == lead]
        imp, conf, origins = mine[0][4], mine[0][5], {mine[0][10]}
        for r in mine[1:]:
            origins.add(r[10])
            imp = min(100, max(imp, r[4]) + min(8, 2 * len(origins)))
            conf = round(min(1.0, max(conf, r[5]) + (0.05 if len(origins) >= 2 else 0)), 2)
        if len(origins) >= 2:
            conf = round(min(1.0, conf + 0.10), 2)
        e = got[lead]
        assert (e["importance"], e["confidence"], e["source_count"], e["evidence_count"]) == (imp, conf, len(origins), len(mine))
        assert e["source_urls"] == sorted({r[11] for r in mine})[:12]
        assert len(e["title"]) == max(len(r[3]) for r in mine)


SOURCE = ("id long, title string, url string, body string, snippet string, published string, company_alias string, city_ok boolean, state_ok boolean, "
          "scope string, entity string, domain string, is_direct boolean")


def test_two_reports_of_one_opening(spark):
    rows = [
        (1, "Pinheiro Super inaugura nova loja no bairro Jockey", "https://portal1.com/1", "Inauguração de supermercado", "", "2026-08-12", "C", True, True, "local", "C", "portal1.com", False),
        (2, "Pinheiro Super abre nova loja no bairro Jockey", "https://portal2.com/2", "Abertura de supermercado", "", "2026-08-12", "C", True, True, "local", "C", "portal2.com", False),
        (3, "Concorrente Mateus abre vagas de emprego em Teresina", "https://portal3.com/3", "Processo seletivo", "", "2026-08-14", "", True, True, "local", "Mateus", "portal3.com", False),
    ]
    events, evidence = E.create_events(spark.createDataFrame(rows, SOURCE), "2026-08-20", P.price_gate())
    by_kind = {r["kind"]: r for r in events.collect()}
    assert set(by_kind) == {"EXPANSÃO", "PESSOAS"}
    opening = by_kind["EXPANSÃO"]
    assert opening["source_count"] == 2 and len(opening["event_key"]) == 24 and opening["rank"] == 1
    assert {(r["event_id"], r["source_id"]) for r in evidence.collect()} == {(1, 1), (1, 2), (3, 3)}
    # base 74, quality .78, recency .88, local; then two origins and one merge
    q = 0.30 + 0.15 + 0.15 + 0.10 + 0.08
    single = round(74 * (0.55 + 0.25 * q + 0.15 * 0.88 + 0.05))
    assert opening["importance"] == min(100, single + 4)


def test_price_changes(spark):
    cols = "entity string, source_domain string, product_key string, product_name string, price double, promotion boolean, url string"
    now = spark.createDataFrame([("e", "d", "a", "A", 6.9, False, ""), ("e", "d", "b", "B", 10.02, False, ""), ("e", "d", "c", "C", 10.08, False, ""),
                                 ("e", "d", "n", "N", 5.0, False, ""), ("e", "d", "z", "Z", None, True, ""), ("e", "d", "p", "P", 10.0, True, "")], cols)
    old = spark.createDataFrame([("e", "d", "a", "A", 6.0, True, ""), ("e", "d", "b", "B", 10.0, False, ""), ("e", "d", "c", "C", 10.0, False, ""),
                                 ("e", "d", "z", "Z", 3.0, False, ""), ("e", "d", "p", "P", 10.0, False, "")], cols)
    got = {r["product_key"]: (r["change_pct"], r["promotion_before"], r["promotion_now"]) for r in C.price_changes(now, old).collect()}
    assert got == {"a": (15.0, True, False), "c": (0.8, False, False), "p": (0.0, False, True)}


def test_source_delta(spark):
    now = spark.createDataFrame([("a", "same"), ("b", "new text"), ("c", "x"), ("c", "x")], "fingerprint string, body string")
    old = spark.createDataFrame([("a", "same"), ("b", "old text"), ("gone", "y")], "fingerprint string, body string").select("fingerprint", F.sha1("body").alias("content_hash"))
    assert {tuple(r) for r in deltas.source_delta(now, old).collect()} == {("c", "new"), ("b", "changed")}
    assert deltas.delta_counts(deltas.source_delta(now, None)).first().asDict() == {"new_sources": 0, "changed_sources": 0}


EVENT = "event_id long, kind string, title string, importance int, confidence double, date string, entity string, source_count int, is_current boolean, rank int"


def test_scores_without_and_with_events(spark):
    none = spark.createDataFrame([], EVENT)
    assert S.external_pressure(none, "C").first()["score"] is None
    assert S.company_vulnerability(none, "C").first()["score"] == 0
    one = spark.createDataFrame([(1, "REPUTAÇÃO", "t", 90, 1.0, "2026-01-01", "C", 1, True, 1)], EVENT)
    assert S.company_vulnerability(one, "C").first()["score"] <= 38
    three = spark.createDataFrame([(i, k, "t", 85, 0.9, "2026-01-01", "C", 2, True, i) for i, k in enumerate(("REPUTAÇÃO", "REGULAÇÃO", "ATENDIMENTO"))], EVENT)
    assert S.company_vulnerability(three, "C").first()["score"] >= 50


def test_mentions_inside_and_across_words(spark):
    names = spark.createDataFrame([("Mateus",), ("Açaí",), ("ab",), ("zz",), ("q",), ("Rede Sul",), ("upo mateus e",), ("po mat",), ("o grupo sul",)], "name string")
    docs = spark.createDataFrame([("o grupo MATEUS e a rede sul",), ("acai do norte, cab",)], "text string")
    want = {"Mateus", "Açaí", "ab", "Rede Sul", "upo mateus e", "po mat"}
    assert {r[0] for r in G.mentioned(names, docs).collect()} == want


def test_text_rules(spark):
    df = spark.createDataFrame([("Inauguração de nova filial abertura",), ("Empresa abre 50 vagas de emprego nova loja",), ("oferta e desconto",), ("nada",)], "t string")
    kind = E.primary_kind(T.normalise(F.col("t")), F.lit(True))
    assert [r[0] for r in df.select(kind).collect()] == ["EXPANSÃO", "PESSOAS", "PREÇO", None]


def test_same_fact_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Every pair of one entity and kind, whatever lies between, in one cell or many."""
    rng = random.Random(11)
    words = "nova loja abre centro procon multa rede oferta queda preco arroz norte sul cliente vendas".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 6))) for _ in range(10)] + ["", "abcabcabc xyz", "abc xyzabcabc"]
    days = ["", "2024-01-01", "2024-02-14", "2024-02-15", "2024-02-16", "2024-03-30", "2024-05-20", "someday"]
    rows = [(i, rng.choice(["Rede A", "rede a", "B"]), rng.choice(["PREÇO", "REGULAÇÃO"]), rng.choice(titles), rng.choice(days)) for i in range(200)]
    c = spark.createDataFrame(rows, "source_id long, entity string, kind string, title string, date string")
    s = c.withColumns({"title": T.normalise(F.col("title")), "g": T.normalise(F.col("entity")), "day": F.coalesce(F.unix_date(T.parse_date(F.col("date"))), F.lit(E.UNDATED))})
    s = s.withColumn("tokens", T.event_tokens(F.col("title")))
    side = lambda n: s.select("g", "kind", *[F.col(x).alias(n + x) for x in ("source_id", "title", "tokens", "date", "day")])
    all_pairs = side("a_").join(side("b_"), ["g", "kind"]).where("a_source_id < b_source_id")
    want = sorted((r.a_source_id, r.b_source_id, r.kind) for r in E.same_fact(all_pairs, "a_", "b_", 0.70, 0.55, 45).collect())
    assert len(want) > 100
    for cell in (1024, 3):
        monkeypatch.setattr(E, "CELL", cell)
        assert sorted(tuple(r) for r in E.same_fact_pairs(c, 0.70, 0.55, 45).collect()) == want


def test_common_lengths_are_those_of_the_table():
    """Longest common subsequences over word bounds, of empty texts and of letters the other text lacks."""
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcé漢😀") for _ in range(rng.choice([0, 1, 7, 63, 64, 65, 128, 130, 200])))
    left, right = [text() for _ in range(150)], [text() for _ in range(150)]
    assert similarity.common_lengths(left, right).tolist() == [plain(a, b) for a, b in zip(left, right)]
    for least in (0.3, 0.52, 0.7, 1.0):
        ratios = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
        assert all(can for can, r in zip(similarity.may_reach(left, right, least).tolist(), ratios) if r >= least)
    assert similarity.common_lengths([], []).tolist() == [] and similarity.may_reach([""], [""], 1.0).tolist() == [True]


def test_titles_that_surely_differ_are_not_aligned(monkeypatch):
    """Titles of the same letters in another order are told apart before their blocks are matched, one by one."""
    rng, calls = random.Random(2), []
    title = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(11))
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    titles = [title() for _ in range(150)]
    rows = [{"entity_n": "a", "kind": "DIGITAL", "first": i, "day": i % 40, "date": "x", "title": t, "tokens": t.split(), "length": len(t), "known": None}
            for i, t in enumerate(titles)]
    out = E._folder(0.60, 0.40, 45)(rows)
    assert [r[3] for r in out] == list(range(150)) and len(calls) < 150
    calls.clear()
    cell = [{"fact": i, "side": 2, "kind": "DIGITAL", "day": i % 40, "title": t, "tokens": t.split()} for i, t in enumerate(titles)]
    assert E._cell_pairs(0.60, 0.40, 45)(cell) == [] and len(calls) < 150
