"""Deduplication, mixing, sharding, quality and near copies against plain reckonings."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, mixing, near_dup, quality, sharding
from .cases import edge_docs, empty_docs, prose, texts


def norm(key):
    return -1 if key is None else key


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(spark, collide):
    digest = (lambda c: F.substring(F.md5(c), 1, 1)) if collide else None
    got = sorted((norm(r.doc_id), norm(r.keep_id), r.group_size, r.kept, r.text_sha256)
                 for r in exact_dedup.exact_dedup(edge_docs(spark), keep="largest", digest=digest).collect())
    groups = {}
    for key, text, _, _ in texts():
        groups.setdefault(text or "", []).append(norm(key))
    want = sorted((k, max(ks), len(ks), k == max(ks), hashlib.sha256(t.encode()).hexdigest()) for t, ks in groups.items() for k in ks)
    assert got == want
    if not collide:
        kept = exact_dedup.drop_copies(edge_docs(spark))
        assert kept.columns == edge_docs(spark).columns and exact_dedup.exact_dedup(empty_docs(spark)).count() == 0


ODD = [(None, "lost text here", "a"), (None, "lost text here", "b"), (None, "lost text here", "a"), (7, "other text now", "a"), (7, "other text now", "a"),
       (8, "other text now", "b"), (1, "one text of id one", "a"), (1, "quite another text of it", "b"), (None, None, "b"), (None, "", None)]


def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string")


@pytest.mark.parametrize("keep, winner", [("largest", 8), ("smallest", 7)])
def test_kept_rows_without_or_with_repeated_ids(spark, keep, winner):
    rows = exact_dedup.drop_copies(odd_docs(spark), keep=keep).collect()
    assert sorted((norm(r.doc_id), r.text or "") for r in rows) == sorted([
        (-1, "lost text here"), (winner, "other text now"), (1, "one text of id one"), (1, "quite another text of it"), (-1, "")])
    assert exact_dedup.drop_copies(empty_docs(spark)).count() == 0
    near = near_dup.drop_near_copies(odd_docs(spark)).collect()
    assert sorted((norm(r.doc_id), r.text or "") for r in near) == sorted([
        (-1, "lost text here"), (7, "other text now"), (1, "one text of id one"), (1, "quite another text of it"), (-1, ""), (-1, "")])
    assert near_dup.drop_near_copies(empty_docs(spark)).count() == 0 and near_dup.drop_near_copies(edge_docs(spark)).columns == edge_docs(spark).columns


def test_mixed_rows_without_or_with_repeated_ids(spark):
    """Copies go to the row that has them, not to its id."""
    docs = spark.createDataFrame([(None, "w " * 100, "a")] * 3 + [(None, "v " * 10, "b"), (4, "x " * 50, "b"), (4, "y " * 50, "c")], "doc_id long, text string, source string")
    told = mixing.mix(docs).collect()
    got = Counter((r.source, r.text) for r in mixing.mixed(docs).collect())
    words = Counter()
    for (source, text), n in got.items():
        words[source] += n * len(text.split())
    want = {"a": 0, "b": 0, "c": 0}
    sizes = {"a": 300, "b": 60, "c": 50}
    for r in told:
        source = next(s for s, n in sizes.items() if n == r.source_size)
        want[source] += r.taken
    assert words == Counter(want) and max(got[("b", "v " * 10)], got[("b", "x " * 50)], got[("c", "y " * 50)]) <= 3
    assert mixing.mixed(empty_docs(spark)).count() == 0 and mixing.mixed(edge_docs(spark)).columns == edge_docs(spark).columns


def test_unequal_chances_sum_to_the_words_owed(spark):
    sizes = [(s, n, 1 + n % 3) for s in ("a", None) for n in (0, 1, 2, 5, 9, 40, 900)]
    owed = {"a": 700.0, None: 5.0}
    got = {r.source: r for r in mixing.chances(spark.createDataFrame(sizes, "source string, size long, n long"),
                                                spark.createDataFrame(list(owed.items()), "source string, owed double")).collect()}
    for s, r in got.items():
        total = sum(n * size * min(1.0, (r.rate or 1) * size) for x, size, n in sizes if x == s)
        assert total == pytest.approx(owed[s]) and r.sure == sum(n * size for x, size, n in sizes if x == s and r.rate * size >= 1)
    assert got["a"].rate > got[None].rate


def test_repeated_ids_with_unlike_texts(spark):
    a, b = prose(301, 80), prose(302, 80)
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end")]
    for order in (rows, rows[::-1]):
        got = near_dup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), size=2).collect()
        assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1}


def targets(sizes: dict, weights=(5, 2, 1), limit=3):
    """Water filling, one source after the other."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] >= limit * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        full |= {s: limit * sizes[s] for s in over}


def test_mixing(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    sums = Counter()
    for _, t, _, s in texts():
        sums[s] += size(t)
    want = targets(dict(sums))
    assert Counter((norm(r.doc_id), r.size) for r in got) == Counter((norm(k), size(t)) for k, t, _, _ in texts())
    source = {norm(k): s for k, _, _, s in texts() if k is not None}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        if r.doc_id is not None:
            assert r.source_size == sums[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sums.values()))
    largest = {s: max(size(t) for _, t, _, x in texts() if x == s) for s in sums}
    lost = Counter({s: sum(size(t) for k, t, _, x in texts() if k is None and x == s) * 3 for s in sums})
    for s in sums:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + lost[s] + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((norm(r.doc_id), r.taken) for r in got) == sorted((norm(r.doc_id), r.taken) for r in again)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_pareto_ranks_give_the_asked_chances(spark):
    """Of documents with unequal chances, the first n by rank hold each one about as often as its chance says."""
    rows = spark.range(4000).withColumn("p", F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.6))
    ranked = rows.withColumn("r", mixing.pareto_rank(F.xxhash64(F.lit(9), "id"), F.col("p"))).orderBy("r").limit(1600)
    low = ranked.where("p < 0.5").count()
    assert abs(low - 400) < 60


def test_sharding(spark):
    got = sharding.shard_rows(edge_docs(spark), shards=4).collect()
    assert Counter((norm(r.doc_id), r.size, r.text_crc32) for r in got) == Counter(
        (norm(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _, _ in texts())
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    apart = {}
    for r in got:
        apart.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in apart.values())  # every group of these fits on a shard
    assert sharding.shard_rows(empty_docs(spark)).count() == 0


def test_a_group_larger_than_a_shard_is_parted(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 90, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_rows(docs, shards=8).toPandas()
    assert (got.groupby("shard").size() == 25).all()
    hot = got[got.doc_id < 90].groupby("shard").size()
    assert hot.max() >= 20  # parts of 12 rows, two to a shard at best; spread evenly there would be 11


def groups_on_shards(spark, sizes, shards):
    """Rows of every group on every shard, for groups of the given sizes (1: unlinked)."""
    rows = [(g, f"text {g}") for g, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = sharding.shard_rows(docs, shards=shards).collect()
    assert len({r.doc_id for r in got}) == len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    lie = {}
    for r in got:
        lie.setdefault(rows[r.doc_id][0], Counter())[r.shard] += 1
    return lie


@pytest.mark.parametrize("large", [256, 1])
def test_a_group_that_fits_on_a_shard_is_not_parted(spark, monkeypatch, large):
    """Groups of half to all of a quota, then many small ones that leave few unlinked rows."""
    monkeypatch.setattr(sharding, "LARGE", large)
    for sizes in ([25, 20, 18, 14] + [1] * 123, [9] * 4 + [5] * 16 + [2] * 30 + [1] * 24, [24] + [3] * 40 + [1] * 56):
        lie = groups_on_shards(spark, sizes, 8)
        assert all(len(c) == 1 for c in lie.values())


@pytest.mark.parametrize("large", [256, 1])
def test_parts_have_the_size_of_a_quota(spark, monkeypatch, large):
    monkeypatch.setattr(sharding, "LARGE", large)
    lie = groups_on_shards(spark, [90] + [7] * 6 + [1] * 68, 8)
    assert sorted(lie[0].values()) == [15, 25, 25, 25]
    assert all(len(lie[g]) == 1 for g in range(1, 7))


def test_a_group_is_parted_only_when_no_shard_has_room(spark):
    lie = groups_on_shards(spark, [3, 3, 2, 2, 2], 2)
    assert all(len(c) == 1 for c in lie.values())
    lie = groups_on_shards(spark, [6, 6, 6], 2)  # nine rows to a shard
    assert sorted(len(c) for c in lie.values()) == [1, 1, 2]


def plain_statistics(text):
    words = (text or "").encode().split()
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(wins)
    inside = {i + j for i, w in enumerate(wins) if many[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics(spark):
    extra = ["a b c a b c", "x\nx\n y\nx ", "a a a a", "# $ | é𝄞\x1c a\nb\n\n\n", "a b c d a b c e b c d"]
    docs = edge_docs(spark).select("doc_id", "text", "size").unionByName(spark.createDataFrame([(900 + i, t, 0) for i, t in enumerate(extra)], "doc_id long, text string, size int"))
    got = Counter(tuple(r)[1:6] for r in quality.quality_statistics(docs).collect())
    assert got == Counter(plain_statistics(t) for t in [t for _, t, _, _ in texts()] + extra)


def test_decision_list(spark):
    """Rules found on labelled rows mark held-back rows alike, and the column agrees with the arrays."""
    rng = np.random.default_rng(3)
    n = 3000
    values = {f: rng.random(n) for f in quality.FEATURES}
    bad = (values["symbol_share"] > 0.7) | ((values["upper_share"] > 0.6) & (values["mark_share"] > 0.8))
    rules = quality.learn_rules({k: v[:2000] for k, v in values.items()}, bad[:2000], precision=0.95)
    marked = np.zeros(n, bool)
    for r in rules:
        marked |= quality.covers(r, values, n)
    assert (marked[2000:] == bad[2000:]).mean() > 0.97
    assert quality.learn_rules(values, np.zeros(n, bool)) == []


def test_quality_keeps_clean_documents(spark):
    clean = [(i, prose(i, 80), 1) for i in range(120)]
    junk = [(1000 + i, " ".join(f"{w}$$$" for w in prose(i, 80).split()), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "n") for i, t, _ in clean + junk] + [(None, None, "n"), (5000, "", "n")], "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(i, q) for i, _, q in clean + junk] + [(None, 1), (7, None), (99999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[i].kept for i, _, _ in clean) and sum(not got[i].kept for i, _, _ in junk) > 110
    assert got[5000].base_failed and not got[5000].kept
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 1000").count() == 120
    assert quality.judge(docs, labels.where("false")).where("kept").count() == 240  # no labels: the base rules alone
    assert quality.judge(empty_docs(spark), labels).count() == 0


def brute_components(rows, k):
    sets = []
    for key, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and 100 * m >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    named = {}
    for c, row in zip(comp, rows):
        if row[0] is not None:
            named[c] = min(named.get(c, row[0]), row[0])
    return Counter((norm(r[0]), len(s), norm(named.get(c) if s else r[0])) for r, s, c in zip(rows, sets, comp))


def test_near_duplicates(spark):
    rows = texts()
    got = near_dup.near_duplicates(edge_docs(spark), size=2).collect()
    assert Counter((norm(r.doc_id), r.n_shingles, norm(r.component_id)) for r in got) == brute_components(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(empty_docs(spark)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """More near copies than a node compares at once, in two families that are not alike."""
    rows = []
    for f in range(2):
        words = prose(77 + f, 150).split()
        for i in range(180):
            own = list(words)
            own[(i * 7) % 150], own[(i * 11 + 3) % 150] = f"n{i}", f"m{i}"
            rows.append((f * 1000 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)
    kept = near_dup.drop_near_copies(docs, size=2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.id: r.comp for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}
