"""Tokens, anchors, flyers, extractor diffs and gates."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anchors as A, diff as X, flyer as Y, gates as Q, spatial as S

TOKEN = ("doc_id string, pos int, token_id long, text string, box struct<x_min:double,y_min:double,x_max:double,y_max:double>, confidence double, "
         "page_w double, page_h double")


def tokens(spark, docs, size=(1000.0, 1000.0)):
    rows = [(d, i, i + 1, text, None if box is None else tuple(map(float, box)), conf, *size)
            for d, items in docs.items() for i, (text, box, conf) in enumerate(items)]
    return spark.createDataFrame(rows, TOKEN)


def test_currency_values(spark):
    good = {"R$ 1.250,00": 1250.0, "R$ 125.000,00": 125000.0, "1.250,00": 1250.0, "12.500,00": 12500.0, "R$ 999,99": 999.99, "279,90": 279.9, "279.90": 279.9, "R$ 0,15": 0.15}
    bad = ["162,4g", "1,6KG", "10x5,2g", "500g", "10%", "20/12/2026", "7891000315507"]
    t = tokens(spark, {x: [(x, (10, 10, 100, 30), 0.9)] for x in [*good, *bad]})
    assert {r["doc_id"]: r["value_num"] for r in A.currency(t).collect()} == good


def test_cadences(spark):
    want = {"99,90/mês": "/mês", "99,90 /mês": "/mês", "99,90/ mês": "/ mês", "99,90 / mês": "/ mês", "99,90/ano": "/ano", "99,90 / ano": "/ ano",
            "R$ 99,90 / mês": "/ mês", "R$ 99,90 / ano": "/ ano"}
    got = A.currency(tokens(spark, {x: [(x, (100, 100, 250, 130), 0.9)] for x in want})).collect()
    assert {r["doc_id"]: r["cadence"] for r in got} == want
    assert all(r["evidence_kind"] == ("explicit_currency" if "R$" in r["doc_id"] else "cadence_price") for r in got)


def test_neighbours_decide(spark):
    t = tokens(spark, {
        "sign beside": [("R$", (100, 220, 130, 250), 0.9), ("20,79", (135, 220, 180, 250), 0.9)],
        "sign far": [("R$", (100, 220, 130, 250), 0.9), ("20,79", (635, 220, 680, 250), 0.9)],
        "unit after": [("162,49", (100, 220, 130, 250), 0.9), ("g", (135, 220, 145, 250), 0.9)],
        "no boxes": [("R$", None, 0.9), ("20,79", None, 0.9), ("x", None, 0.9), ("30,00", None, 0.9)],
    })
    got = {(r["doc_id"], r["value_num"]): r["evidence_kind"] for r in A.currency(t).collect()}
    assert got == {("sign beside", 20.79): "explicit_currency", ("sign far", 20.79): "bare_decimal",
                   ("no boxes", 20.79): "explicit_currency", ("no boxes", 30.0): "bare_decimal"}


def test_nine_formats_on_one_page(spark):
    texts = ["PACOTE 250g", "FARINHA 1kg", "LEITE 500ml", "CAIXA 10x5,2g", "VALIDADE 17/08/2026", "AUTOS 0812345-67.2026", "CNPJ 00.000.000/0001-00", "JUROS +15,5%", "PREÇO R$ 17,90"]
    t = tokens(spark, {"p": [(x, (10, 10 + 30 * i, 150, 30 + 30 * i), 0.9) for i, x in enumerate(texts)]})
    found = lambda rule: [r["value_num"] if r["value_num"] is not None else r["value_str"] for r in A.detect_anchors(t, [rule]).collect()]
    assert found("currency") == [17.9] and found("court_case") == ["0812345-67.2026"] and found("percentage") == [15.5]
    assert found("tax_id") == ["00.000.000/0001-00"] and found("calendar_date") == ["17/08/2026"]
    assert sorted(found("measurement")) == ["10x5,2g", "1kg", "250g", "500ml"]


def test_rules_share_one_pass_over_their_tokens(spark):
    """Tokens are made once for all seven rules, and those left out tell none of them anything."""
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    texts = ["R$", "1.250,00", "Remuneração", "2.000", "salário", "900,00", "12,50", "kg", "foo", "/ mês", "99,90", "0812345-67.2026", "00.000.000/0001-00",
             "17/08/2026", "+15,5%", "٣,٥٠", "250g", None, "", "bar", "10", "%", "US$ 7,00", "honorários 3.000"]
    t = tokens(spark, {f"d{d}": [(x, None, 0.9) for x in texts[d:] + texts[:d]] for d in range(6)})
    once = t.withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    got = sorted(map(str, A.detect_anchors(once, list(A.RULES)).collect()))
    assert made.value == 6 * len(texts)
    assert got == sorted(map(str, A.detect_anchors(t, [lambda x, r=r: r(x) for r in A.RULES.values()]).collect())) and len(got) > 60


def test_overlap_suppression_follows_the_scan(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        x, y, w, h = rng.randint(0, 60), rng.randint(0, 60), rng.randint(15, 30), rng.randint(15, 30)
        rows.append((f"{10 + i},00", (x, y, x + w, y + h), rng.choice([0.5, 0.6, 0.7, 0.8])))
    t = tokens(spark, {"p": rows}, (100.0, 100.0))
    got = {r["pos"] for r in A.detect_anchors(t).collect()}

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    kept = []
    for i, r in sorted(enumerate(rows), key=lambda x: -x[1][2]):
        if all(iou(r[1], rows[k][1]) <= 0.60 for k in kept):
            kept.append(i)
    assert got == set(kept) and len(kept) < len(rows)


def test_fragments(spark):
    t = tokens(spark, {
        "letters": [("C", (10, 100, 20, 130), .9), ("A", (22, 100, 32, 130), .9), ("F", (34, 100, 44, 130), .9), ("E", (46, 100, 56, 130), .9)],
        "syllables": [("ALUM", (100, 200, 180, 230), .95), ("INIO", (185, 200, 250, 230), .95)],
        "words": [("CAFE", (100, 200, 180, 230), .95), ("PILAO", (260, 200, 350, 230), .95)],
        "flat": [("P", None, .9), ("I", None, .9), ("L", None, .9), ("moido", None, .9), ("A", None, .9)],
    })
    rows = S.merge_fragments(t).orderBy("doc_id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {"letters": ["CAFE"], "syllables": ["ALUMINIO"], "words": ["CAFE", "PILAO"], "flat": ["PIL", "moido", "A"]}
    box = next(r["box"] for r in rows if r["doc_id"] == "letters")
    assert (box["x_min"], box["x_max"]) == (10.0, 56.0)


def test_flyer_page(spark):
    page = [
        ("OFERTAS DA SEMANA", (100, 50, 400, 100), 1.0), ("CAFÉ PILÃO ESPRESSO", (100, 400, 350, 450), 1.0), ("PACOTE 500G", (100, 460, 250, 490), 1.0),
        ("R$ 18,90 CADA", (100, 500, 250, 550), 1.0), ("AÇÚCAR REFINADO UNIÃO", (600, 400, 850, 450), 1.0), ("PACOTE 1KG", (600, 460, 750, 490), 1.0),
        ("4,79", (600, 500, 700, 550), 1.0), ("PREÇOS VÁLIDOS ENQUANTO DURAREM OS ESTOQUES", (100, 1900, 800, 1950), 1.0)]
    entities, metrics = Y.extract_flyers(tokens(spark, {"f": page}, (1000.0, 2000.0)), top=0.10, bottom=0.90)
    got = {r["value"]: r for r in entities.collect()}
    assert set(got) == {18.90, 4.79}
    assert got[18.90]["name"] == "PACOTE 500G CAFÉ PILÃO ESPRESSO" and got[18.90]["measure"] == "PACOTE 500G"
    assert metrics.first().asDict() == {"doc_id": "f", "original_tokens": 8, "filtered_tokens": 6, "anchors": 2, "regions": 2, "entities": 2}


def test_marked_price_absorbs_bare_one(spark):
    page = [
        ("1624 9", (100, 100, 150, 120), .92), ("162,49", (100, 125, 140, 142), .97), ("CAPPUCCINO PREMIUM", (100, 150, 350, 180), .99),
        ("CAIXETA 156,8G OU 162,4G", (100, 190, 350, 215), .85), ("R$", (100, 220, 130, 250), .98), ("20,79", (135, 220, 280, 280), .99), ("CADA", (200, 270, 260, 290), .95)]
    beside = [
        ("GRANDE MIX", (120, 340, 190, 353), .9), ("162,49", (140, 355, 180, 372), .97), ("CAPPUCCINO PREMIUM", (100, 440, 350, 450), .99),
        ("R$ 20,79", (135, 380, 280, 440), .99)]
    entities, _ = Y.extract_flyers(tokens(spark, {"f": page, "g": beside}))
    rows = {r["doc_id"]: r for r in entities.collect()}
    assert entities.count() == 2 and {r["value"] for r in rows.values()} == {20.79} and "CAPPUCCINO PREMIUM" in rows["f"]["name"]
    assert rows["g"]["absorbed"] == 1 and rows["g"]["name"].startswith("GRANDE MIX ")


ITEM = "doc_id string, pos long, name string, price double, unit string"


@pytest.mark.parametrize("name, old, new", [
    ("MATCH_EXACT", ("Café Pilão 500g", 18.90, "500g"), ("Café Pilão 500g", 18.90, "500g")),
    ("MATCH_SEMANTIC", ("Chá Camomila Maratá", 3.29, "10g"), ("Chá Maratá Sabores Camomila", 3.29, "10g")),
    ("NAME_IMPROVEMENT", ("NOVA CÁPSULA DE s P R E $ $ 0", 23.90, ""), ("CAIXETA 10X5,2G CÁPSULAS DE CAFÉ L'OR SABORES", 23.90, "")),
    ("FP_LEGACY", ("Rone Oaltoev 162,4g", 162.49, ""), None),
    ("FN_GENERIC", ("Arroz Tipo Um", 9.0, ""), None),
    ("FN_LEGACY", None, ("PNEU AUTOMOTIVO ARO 14 GOODYEAR", 279.90, "")),
    ("FP_GENERIC", None, ("PNEU", None, "")),
    ("PRICE_DIVERGENCE", ("Café Torrado Pilão Extraforte", 19.90, ""), ("Café Torrado Pilão Extraforte", 17.90, "")),
    ("UNIT_DIVERGENCE", ("Café Pilão", 17.90, "250g"), ("Café Pilão", 17.90, "500g")),
])
def test_diff_classes(spark, name, old, new):
    side = lambda x: spark.createDataFrame([] if x is None else [("d", 1, *x)], ITEM)
    assert [r["class"] for r in X.compare_extractors(side(old), side(new)).collect()] == [name]


def test_diff_follows_the_scan(spark):
    rng = random.Random(9)
    words = "cafe pilao arroz branco leite integral sabao".split()
    make = lambda d, i: (d, i, " ".join(sorted(rng.sample(words, rng.randint(1, 3)))), rng.choice([1.0, 1.01, 1.02, 1.04, 2.0, 5.0]), "")
    docs = [f"d{i}" for i in range(6)]
    old = [make(d, i) for d in docs for i in range(9)]
    new = [make(d, i) for d in docs for i in range(9)]
    sim = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = set()
    for d in docs:
        o, n = [r for r in old if r[0] == d], [r for r in new if r[0] == d]
        for g in list(n):
            near = [r for r in o if abs(r[3] - g[3]) <= 0.02]
            if near:
                r = max(near, key=lambda r: (sim(r[2], g[2]), -r[1]))
                want.add((d, r[1], g[1]))
                o.remove(r)
                n.remove(g)
        for g in list(n):
            r = next((r for r in o if sim(r[2], g[2]) >= 0.65), None)
            if r is not None:
                want.add((d, r[1], g[1]))
                o.remove(r)
                n.remove(g)
        want |= {(d, r[1], None) for r in o} | {(d, None, g[1]) for g in n}
    rows = X.compare_extractors(spark.createDataFrame(old, ITEM), spark.createDataFrame(new, ITEM)).collect()
    assert {(r["doc_id"], r["old_pos"], r["new_pos"]) for r in rows} == want and len(rows) == len(want)


def test_diff_moves_each_side_once(spark):
    """The items of a page meet on one row: nothing is written between, and a side is shuffled once."""
    side = spark.createDataFrame([(d, i, f"cafe {i}", float(i), "") for d in ("a", "b", None) for i in range(3)], ITEM)
    rows = X.compare_extractors(side, side)
    plan = rows._jdf.queryExecution().sparkPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "FileScan" not in plan
    # pages without a key never meet
    assert sorted((r["doc_id"] or "", r["class"]) for r in rows.collect()) == sorted(
        [(d, "MATCH_EXACT") for d in "ab"] * 3 + [("", "FN_GENERIC")] * 3 + [("", "FN_LEGACY")] * 2 + [("", "FP_GENERIC")])


def test_gold_metrics(spark):
    cols = "pos long, entity string, value string"
    def score(ext, gold):
        m = X.gold_metrics(X.evaluate_gold(spark.createDataFrame(ext, cols), spark.createDataFrame(gold, cols))).first()
        return tuple(round(m[c], 4) for c in ("precision", "recall", "f1", "duplicate_rate"))
    assert score([(1, "p", "1.00"), (2, "p", "x")], [(1, "p", "1.01"), (2, "p", " X ")]) == (1.0, 1.0, 1.0, 0.0)
    assert score([(1, "p", "1.0"), (2, "p", "9.0")], [(1, "p", "1.0"), (2, "p", "5.0")]) == (0.5, 0.5, 0.5, 0.0)
    assert score([(1, "p", "1.0"), (2, "p", "1.0")], [(1, "p", "1.0")]) == (1.0, 1.0, 1.0, 0.5)
    # a run of values of which only neighbours agree is matched one by one: 1.00-1.015, then 1.03-1.02
    assert score([(1, "p", "1.00"), (2, "p", "1.03")], [(1, "p", "1.015"), (2, "p", "1.02")]) == (1.0, 1.0, 1.0, 0.0)


def test_percentiles_and_gates(spark):
    lat = spark.createDataFrame([(float(x),) for x in (10, 12, 15, 20, 25, 30, 50)], "x double")
    assert tuple(lat.agg(*Q.latency_summary(F.col("x"))).first()) == (20.0, 44.0, 48.8, 50.0)
    assert tuple(Q.latencies(lat, "x").first()) == (20.0, 44.0, 48.8, 50.0)
    assert tuple(Q.latencies(lat.where("x < 0"), "x").first()) == (0.0, 0.0, 0.0, 0.0)
    item = [("d", 1, "Café Pilão", 1.0, "")]
    same = spark.createDataFrame(item, ITEM)
    times = spark.createDataFrame([("d", 1.0, 2.0, False)], "doc_id string, old_ms double, new_ms double, crashed boolean")
    totals = Q.gate_totals(X.compare_extractors(same, same), same, same, times)
    fine = spark.createDataFrame([(True, False, True)], "tables_intact boolean, prior_changed boolean, repeatable boolean")
    gates = Q.gate_rows(totals, fine)
    assert gates.count() == 12 and Q.decide(gates).first()["decision"] == "INSUFFICIENT_DATA"
    assert Q.decide(gates, 1).first()["decision"] == "PASS"
    other = spark.createDataFrame([("d", 1, "Café Pilão", 2.0, "")], ITEM)
    assert Q.decide(Q.gate_rows(Q.gate_totals(X.compare_extractors(same, other), same, other, times), fine), 1).first()["decision"] == "FAIL"


def test_table_checks(spark):
    a = spark.range(5)
    assert Q.same_table(a, a.repartition(3)) and not Q.same_table(a, spark.range(4))
    assert Q.table_digest(a).first() == Q.table_digest(a.repartition(3)).first()
    rows = lambda *r: Q.table_digest(spark.createDataFrame(list(r), "x string, y string")).first()
    assert rows(("1", None)) != rows((None, "1")) and rows(("1", "2")) != rows(("1", "2"), ("1", "2")) and rows(("", None)) != rows((None, ""))


def test_gates_on_measured_facts(spark, tmp_path):
    """A changed table, an unstable job and a changed prior result each fail their gate."""
    path = str(tmp_path / "table")
    spark.range(9).write.parquet(path)
    item = spark.createDataFrame([("d", 1, "Café Pilão", 1.0, "")], ITEM)
    times = spark.createDataFrame([("d", 1.0, 2.0, False)], "doc_id string, old_ms double, new_ms double, crashed boolean")
    read = lambda: {"table": spark.read.parquet(path)}

    def failed(job, prior=lambda: item, kept=None):
        rows, checks = Q.run_checks(job, read, prior, kept)
        gates = Q.gate_rows(Q.gate_totals(rows, item, item, times), checks)
        return [r["gate"] for r in gates.where("status = 'FAIL'").collect()]

    compare = lambda execution: X.compare_extractors(item, item)
    assert failed(compare) == []
    assert failed(lambda execution: compare(1).withColumn("similarity", F.lit(1.0 / execution))) == ["G12_idempotency"]
    assert failed(compare, kept=Q.digests({"prior": item.withColumn("price", F.lit(2.0))})) == ["G8_legacy_regression"]

    def writes(execution):
        spark.range(1).write.mode("append").parquet(path)
        return compare(1)

    assert failed(writes) == ["G7_table_integrity"]


def test_ranked_percentiles(spark):
    """Against a sorted list; a third of all rows share one value, and one key is null."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, rng.random(), rng.randint(1, 40) / 2, None])) for _ in range(900)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]

    def want(xs):
        xs = sorted(xs)
        out = []
        for p in shares:
            at = (len(xs) - 1) * p
            lo, hi = int(at), min(int(at) + 1, len(xs) - 1)
            out.append(xs[lo] + (xs[hi] - xs[lo]) * (at - lo))
        return out

    got = {r["k"]: r for r in Q.ranked_percentiles(df, "x", shares, ("k",)).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        xs = [x for q, x in rows if q == k and x is not None]
        assert r["n"] == len(xs) and r["largest"] == max(xs) and r["percentiles"] == pytest.approx(want(xs))
    every = Q.ranked_percentiles(df, "x", shares).first()
    assert every["percentiles"] == pytest.approx(want([x for _, x in rows if x is not None]))


def test_gold_errors_follow_the_scan(spark):
    """Row by row against a sequential reckoning; a third of all values are equal."""
    rng = random.Random(11)
    value = lambda: rng.choice(["5.00", f"{rng.randint(100, 112) / 100:.2f}", f"{rng.randint(900, 960) / 100:.2f}", "x", " X", None])
    make = lambda n: [(rng.choice("ab"), i, rng.choice(["p", "q"]), value()) for i in range(n)]
    ext, gold = make(160), make(120)

    def agree(a, b):
        try:
            return abs(float(a) - float(b)) <= 0.02
        except (TypeError, ValueError):
            return (a or "").strip().lower() == (b or "").strip().lower()

    used, want = set(), []
    for s, i, e, v in ext:
        near = [r for r in gold if r[0] == s and r[2] == e and agree(v, r[3])]
        free = [r for r in near if (r[0], r[1]) not in used]
        if free:
            used.add((s, free[0][1]))
            want.append((s, e, "acerto", i, free[0][1]))
        else:
            want.append((s, e, "duplicacao" if near else "falso_positivo", i, near[-1][1] if near else None))
    want += [(s, e, "falso_negativo", None, i) for s, i, e, _ in gold if (s, i) not in used]
    cols = "doc string, pos long, entity string, value string"
    got = X.match_gold(spark.createDataFrame(ext, cols), spark.createDataFrame(gold, cols), scope="doc")
    assert sorted(map(str, map(tuple, got.select("scope", "entity", "outcome", "e_pos", "g_pos").collect()))) == sorted(map(str, want))
    assert {r["outcome"] for r in got.collect()} == {"acerto", "duplicacao", "falso_positivo", "falso_negativo"}
    assert X.gold_errors(got).count() == len(want) - sum(w[2] == "acerto" for w in want)


def test_fragments_follow_the_scan(spark):
    """Against a sequential reckoning; a staircase is no single line."""
    rng = random.Random(8)
    docs = {"stairs": [(f"w{i:02d}", (100 * (i % 9), 8 * i, 100 * (i % 9) + 60, 8 * i + 20), 0.9) for i in range(30)]}
    for d in range(25):
        rows = []
        for _ in range(rng.randint(1, 25)):
            x, y, h = rng.randint(0, 40) * 6, rng.randint(0, 30) * 4, rng.choice([0, 10, 16, 40])
            box = None if rng.random() < (1.0 if d % 6 == 5 else 0.1) else (x, y, x + rng.choice([0, 6, 18, 30]), y + h)
            rows.append((rng.choice(["a", "b", "9", "ab", "xyz", "-"]), box, rng.choice([0.4, 0.8, 0.9])))
        docs[f"d{d}"] = rows
    want = {}
    for d, rows in docs.items():
        have = lambda b: b is not None and (b[2] > b[0] or b[3] > b[1])
        boxed = sorted(((i, *r) for i, r in enumerate(rows) if have(r[1])), key=lambda r: (r[2][1], r[2][0]))
        plain = [(i, *r) for i, r in enumerate(rows) if not have(r[1])]
        out, lines = [], []
        if not boxed:
            for i, text, _, _ in plain:
                if len(text) == 1 and text.isalnum() and out and out[-1][2]:
                    out[-1] = (out[-1][0] + text, out[-1][1] + [i + 1], True)
                else:
                    out.append((text, [i + 1], len(text) == 1 and text.isalnum()))
            want[d] = [(t, m) for t, m, _ in out]
            continue
        for r in boxed:
            mid, tall = lambda b: (b[1] + b[3]) / 2, lambda b: b[3] - b[1]
            line = next((x for x in lines if abs(mid(x[0][2]) - mid(r[2])) <= max(10.0, (tall(x[0][2]) + tall(r[2])) / 2 * 0.40)), None)
            if line is None:
                lines.append(line := [])
            line.append(r)
        for line in lines:
            word = None
            for i, text, b, _ in sorted(line, key=lambda r: r[2][0]):
                if word is not None:
                    a = word[2]
                    ref = max(1.0, ((a[3] - a[1]) + (b[3] - b[1])) / 2)
                    if -ref * 0.5 <= b[0] - a[2] <= ref * (0.45 * (1.8 if len(word[0]) == 1 or len(text) == 1 else 1.0)):
                        word = (word[0] + text, word[1] + [i + 1], (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))
                        continue
                    out.append(word)
                word = (text, [i + 1], b)
            out.append(word)
        want[d] = [(w[0], w[1]) for w in out] + [(t, [i + 1]) for i, t, _, _ in plain]
    got = {}
    for r in S.merge_fragments(tokens(spark, docs)).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], list(r["merged"])))
    assert got == want and len(got["stairs"]) == 30


@pytest.mark.parametrize(("name", "most"), [("token_regions", 0), ("fragment_merge", 1)])
def test_page_steps_move_texts_and_results_only(spark, tmp_path, name, most):
    from tidewatch.plans.registry import QUERIES

    words = "alpha bo c considerations d e incontrovertible f"
    spark.createDataFrame([(i, f"{words} {i} " * (i + 1)) for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and sum("REPARTITION_BY_NUM" not in line for line in moves) <= most
    assert df.count() > 0


def test_regions_follow_the_nearest_anchor(spark):
    rng = random.Random(5)
    docs = {f"p{k}": [("word", (x, y, x + rng.randint(0, 40), y + 10), 0.9) for x, y in ((rng.randint(0, 90) * 10, rng.randint(0, 90) * 10) for _ in range(60))] for k in range(6)}
    t = tokens(spark, {**docs, "bare": [("word", None, 0.9)]})
    anchors = t.where("pos % 7 = 0").withColumn("anchor_no", F.col("pos"))
    # a place that comes twice on a page has one nearest anchor for both rows
    twice = t.where("pos = 3").withColumn("box", F.struct(*[(F.col(f"box.{c}") + 30).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]))
    middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)

    def nearest(page, box):
        x, y = middle(box)
        met = []
        for i, (_, b, _) in enumerate(page):
            ax, ay = middle(b)
            if i % 7 == 0 and abs(x - ax) <= 220 and abs(y - ay) <= 100:
                dy = abs(y - ay) * (1 if y <= ay else 2)
                met.append((round(((abs(x - ax) * 1.6) ** 2 + dy ** 2) ** 0.5, 6), i))
        return min(met, default=None)

    want = {}
    for d, page in docs.items():
        for i, (_, b, _) in enumerate(page):
            boxes = [b, tuple(c + 30 for c in b)] if i == 3 else [b]
            best = min((n for n in (nearest(page, x) for x in boxes) if n), default=None)
            if i % 7 and best:
                want[d, i] = best
    got = S.anchor_regions(t.unionByName(twice), anchors, 0.22, 0.10).collect()
    assert {(r["doc_id"], r["pos"]): (round(r["distance"], 6), r["anchor_no"]) for r in got} == want
    assert len(got) == len(want) + sum((d, 3) in want for d in docs)
