"""Runs, cuts and fingerprints against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st

from tidewatch.llm import common, fill_middle, fingerprints, periodic_runs
from .cases import edge_docs, empty_docs, texts

SMALL = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- periodic runs

def all_runs(words, shortest=6, repeats=4):
    """Every period at every place."""
    out, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, repeats * q):
                stretch = words[i:j + q]
                if not any(all(a == b for a, b in zip(stretch, stretch[p:])) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def laid(*lists):
    known = {}
    starts = np.concatenate(([0], np.cumsum([len(w) for w in lists], dtype=np.int64)))
    return np.array([known.setdefault(w, len(known)) for ws in lists for w in ws], np.int64), starts


def by_text(runs, starts):
    out = [[] for _ in starts[1:]]
    for s, n, q in runs.tolist():
        i = int(np.searchsorted(starts, s, "right")) - 1
        out[i].append((s - int(starts[i]), n, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 7), st.integers(0, 9)), max_size=6), st.integers(1, 3), st.randoms(use_true_random=False))
def test_runs_of_any_words(spec, letters, rng):
    made = []
    for period, times, loose in spec:
        unit = [rng.randrange(letters) for _ in range(period)]
        made += unit * times + unit[:rng.randrange(period)] + [rng.randrange(letters) for _ in range(loose)]
    lists = [made, made[: len(made) // 2], [], [0] * 40]
    assert by_text(periodic_runs.find_runs(*laid(*lists)), laid(*lists)[1]) == [all_runs(w) for w in lists]
    other = periodic_runs.find_runs(*laid(made), 9, 3)
    assert by_text(other, laid(made)[1]) == [all_runs(made, 9, 3)]


def test_long_runs_take_linear_time():
    rng = random.Random(1)
    unit = [rng.randrange(1000) for _ in range(40_000)]
    words = [0] * 200_000 + unit * 5 + [1, 2] * 100_000
    got = [tuple(r) for r in periodic_runs.find_runs(*laid(words)).tolist()]
    assert (0, 200_000, 1) in got and (400_000, 200_000, 2) in got and any(q == 40_000 and n >= 200_000 for _, n, q in got)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(*laid(words[:10]), repeats=2)


def test_op11(spark):
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, SMALL).collect()}
    rows = common.documents(spark, SMALL).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept))
    assert sum(r.n_runs > 0 for r in got.values()) > 5


def test_runs_of_odd_rows(spark):
    rows = periodic_runs.periodic_runs(edge_docs(spark)).collect()
    assert len(rows) == len(texts())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].runs == [] and by[1].collapsed == by[2].collapsed == by[3].collapsed == ""
    loop = spark.createDataFrame([(1, "a b " * 10 + "end"), (1, "x " * 6), (None, "y\ty\ny y y y y")], "doc_id long, text string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(loop).collect()}
    assert got == {(1, "a b end"): [(0, 20, 2)], (1, "x"): [(0, 6, 1)], (None, "y"): [(0, 7, 1)]}
    assert periodic_runs.periodic_runs(empty_docs(spark)).count() == 0


# ---- fill in the middle

@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=30), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4), st.booleans())
def test_cuts(text, h, chars):
    units = list(text) if chars else regex.findall(r"[A-Za-z]+|[^A-Za-z]", text, regex.S)
    n, form, pre, mid, out = fill_middle.cut_text(text, tuple(h), 90, 20, "char" if chars else "token")
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    assert n == len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        assert (form, pre, mid, out) == ("plain", None, None, text)
    else:
        assert (pre, mid) == (len(a), len(b))
        assert (form, out) == (("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", f"<P>{a}<S>{c}<M>{b}"))


def test_index_converts_both_ways():
    text = "aé b€𝄞c" * 3
    index = fill_middle.Exceptions(text.encode())
    assert len(index.at_byte) == 9  # ASCII leaves no entry
    for i in range(len(text) + 1):
        at = len(text[:i].encode())
        assert index.byte(i) == at and index.char(at) == i


def test_parts_come_together_again(spark):
    docs = edge_docs(spark).union(spark.createDataFrame(
        [(900 + i, t, *[None] * 12) for i, t in enumerate(["a <P> b", "<<<SMP>>> <S <M", "𝄞 <é\n<", "<P"])], edge_docs(spark).schema))
    for unit in ("token", "char"):
        made = fill_middle.fill_in_middle(docs, plain_from=100, spm_below=50, unit=unit)
        rows = made.withColumn("back", fill_middle.restored(made["output"], made["form"])).collect()
        assert len(rows) == docs.count()
        assert sorted(r.back for r in rows) == sorted(r.text or "" for r in docs.select("text").collect())
        assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="line")


# ---- fingerprints

def parts(text):
    raw = text.encode()
    keys, _ = fingerprints.part_digests([raw])
    return set(keys.tolist())


def alike(a, b):
    a, b = parts(a), parts(b)
    size = lambda s: sum(k & 1023 for k in s)
    return size(a & b) / size(a | b) if a | b else 1.0


def test_parts_cover_texts_and_stay_local():
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(500) for _ in range(3000)]
    text = "\n".join(" ".join(words[i:i + 100]) for i in range(0, 3000, 100))
    raw = text.encode()
    at = fingerprints.part_starts(raw, np.array([0, len(raw)]))
    assert at[0] == 0 and (np.diff(np.append(at, len(raw))) <= 512).all() and len(at) > 200
    alone = fingerprints.part_digests([raw])[0]
    together, owner = fingerprints.part_digests([b"other words here", b"", raw, raw])
    assert (together[owner == 2] == alone).all() and (together[owner == 3] == alone).all()
    changed = text[:4000] + "new words " + text[4000:]
    assert len(parts(text) ^ parts(changed)) < 8
    assert len(parts("x" * 2000)) == 4 and len(parts("same line\n" * 50)) == 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 2**63 - 1), max_size=60), st.sets(st.integers(1, 2**63 - 1), max_size=60), st.integers(0, 60)), min_size=1, max_size=6))
def test_peeling_recovers_the_difference(sets):
    pairs = [(a | set(range(1, c)), b | set(range(1, c))) for a, b, c in sets]
    side = lambda i: tuple(np.array(x, t) for x, t in zip(zip(*[(k, n) for n, p in enumerate(pairs) for k in sorted(p[i])]), (np.uint64, np.int64))) \
        if any(p[i] for p in pairs) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys, pair, signs = fingerprints.differences(side(0), side(1), len(pairs))
    got = set(zip(keys.tolist(), pair.tolist(), signs.tolist()))
    assert got == {(k, n, 1) for n, (a, b) in enumerate(pairs) for k in a - b} | {(k, n, -1) for n, (a, b) in enumerate(pairs) for k in b - a}
    assert len(keys) == len(got)


def expected_next(rows):
    order = sorted(rows)
    return {k: (t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order)}


@pytest.mark.parametrize("slice_rows", [4096, 7])
def test_op13(spark, slice_rows):
    docs = common.documents(spark, SMALL)
    got = fingerprints.compare_with_next(docs, slice_rows=slice_rows).collect()
    want = expected_next([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(want)
    by = {}
    for r in got:
        text, following = want[r.doc_id]
        q = len(text) // 4
        changed = text[:len(text) - q] + following[:q]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(changed)
        assert r.near_edited == pytest.approx(alike(text, changed)) and r.near_next == pytest.approx(alike(text, following))
        assert by.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(by.values())) == len(by)
    near, far = np.array([r.near_edited for r in got]), np.array([r.near_next for r in got])
    assert np.median(near) > 0.5 and np.median(far) < 0.1
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert all(alone[r.doc_id] == r.fingerprint for r in got)


def test_next_of_odd_rows(spark):
    docs = edge_docs(spark)
    got = fingerprints.compare_with_next(docs, slice_rows=5).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, *_ in texts())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    tied = [r for r in got if r.doc_id == 16]
    assert len({r.fingerprint for r in tied}) == 1 and sorted(r.near_next for r in tied)[1:] == [1.0, 1.0]
    assert fingerprints.compare_with_next(empty_docs(spark)).count() == 0
    one = spark.createDataFrame([(5, "only one text")], "doc_id long, text string")
    r = fingerprints.compare_with_next(one).first()
    assert (r.near_next, r.edited_sha256) == (1.0, sha("only one t" + "onl"))
    nothing = spark.createDataFrame([(None, None), (None, None), (None, "x")], "doc_id long, text string")
    assert sorted(r.near_edited for r in fingerprints.compare_with_next(nothing).collect()) == [1.0, 1.0, 1.0]


def test_changes_between_versions(spark):
    old = "first line\nsecond line\nthird line"
    rows = [(1, old, old.replace("second", "other")), (2, None, ""), (3, None, "new"), (4, old, old)]
    got = {r.doc_id: r for r in fingerprints.paragraph_changes(spark.createDataFrame(rows, "doc_id long, old string, new string"), "old", "new").collect()}
    for k, a, b in rows:
        a, b = parts(a or ""), parts(b or "")
        assert set(got[k].removed) == {x - 2**64 if x >= 2**63 else x for x in a - b}
        assert set(got[k].added) == {x - 2**64 if x >= 2**63 else x for x in b - a}
    assert got[2].likeness == got[4].likeness == 1.0 and got[3].likeness == 0.0 and 0 < got[1].likeness < 1
