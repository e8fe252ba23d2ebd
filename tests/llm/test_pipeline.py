"""The pipeline against its stages reckoned one by one, and its registration."""

from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from tidewatch.llm import common, quality

SMALL = "/root/testdata/sf0.001"


def kept_by_brute_force(spark, rows):
    """Exact copies (largest id stays), then five-word near copies (smallest id of a component stays)."""
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), i)
    left = {i: t for t, i in best.items()}
    sets = {}
    for i, t in left.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return {i for i, c in comp.items() if i == c}


def test_stages(spark):
    docs = common.documents(spark, SMALL)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    good = common.cut(stages["quality rules"](spark, docs, SMALL))
    judged = quality.judge(docs, common.documents(spark, SMALL, "labels"))
    assert {r.doc_id for r in good.select("doc_id").collect()} == {r.doc_id for r in judged.where("kept").collect()}
    exact = common.cut(stages["exact dedup"](spark, good, SMALL))
    near = common.cut(stages["near dedup"](spark, exact, SMALL))
    want = kept_by_brute_force(spark, [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()])
    assert {r.doc_id for r in near.select("doc_id").collect()} == want
    mixed = common.cut(stages["mixing"](spark, near, SMALL))
    assert docs.columns == good.columns == exact.columns == near.columns == mixed.columns
    words = lambda df: Counter({r.source: r.n for r in df.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()})
    assert max(Counter(r.doc_id for r in mixed.select("doc_id").collect()).values()) <= 3 and set(words(mixed)) <= set(words(near))
    last = stages["sentencepiece"](spark, mixed, SMALL)
    assert last.count() == mixed.count()


def test_run_against_a_plain_reckoning(spark):
    """Rows, copies, words per source and digests of the whole pipeline."""
    import hashlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    from tidewatch.llm import mixing

    docs = common.documents(spark, SMALL)
    judged = {r.doc_id for r in quality.judge(docs, common.documents(spark, SMALL, "labels")).where("kept").collect()}
    rows = {r.doc_id: (r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()}
    left = kept_by_brute_force(spark, [(i, rows[i][0]) for i in judged])
    plan = mixing.mix(docs.where(docs["doc_id"].isin(sorted(left)))).collect()
    want = Counter({r.doc_id: r.copies for r in plan if r.copies})
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == want
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in got:
        ids = model.encode(rows[r.doc_id][0], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    taken, target, largest = Counter(), {}, Counter()
    for r in plan:
        source = rows[r.doc_id][1]
        taken[source] += r.taken
        target[source] = r.target
        largest[source] = max(largest[source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, empty tables and columns with clashing names pass through every stage."""
    from .cases import SCHEMA, edge_docs, empty_docs

    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, SMALL))
            assert docs.columns == [c.strip().split()[0] for c in SCHEMA.split(",")]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert {"op8_exact_dedup", "op12_fill_in_middle"} <= set(entry.oracle_sql())


def test_stages_leave_no_copies_behind(spark, tmp_path):
    """Once a stage is written, its input and the keyed copy it read are gone; the given tables and the rows stay."""
    from pathlib import Path

    import pyarrow.parquet as pq

    texts = [" ".join(f"{w}{i}" for w in "the plain words of a long enough text about".split() for i in range(k, k + 9)) + "." for k in range(6)] * 2 + [None]
    docs = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = common.documents(spark, SMALL, "labels")
    labels.where("doc_id < 13").write.parquet(f"{tmp_path}/labels.parquet")
    files = lambda: {p for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")}
    with_text = lambda new: [p for p in new if p.is_file() and "text" in pq.read_schema(p).names]
    before = files()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {p.parent for p in with_text(files() - before)} == {Path(f.removeprefix("file://")).parent for f in out.inputFiles()}
    assert out.count() > 0 and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 13
