"""Near-duplicate detection by a chosen-path set similarity join.

Every text becomes its set of word shingles, and texts with equal sets become
one class at once. Classes are joined by trees: a class carries ``SIGNATURE``
minwise tokens, a node picks ``BRANCH`` token places by a hash of its own name,
and a class goes on to the child named by the node and its token there. Nodes
of at most ``SMALL`` classes are compared exhaustively, larger ones branch
again. Independent trees repeat this until the recall is as wanted: with two
branches per level a pair of similarity 0.8 meets in a tree with probability
0.94 or more, and in four trees with more than 0.9999.

A node at the last level that is still large holds classes that are alike. It is
settled by random blocks: classes linked within a block count as one from then
on, and one of each goes to the next round of blocks. When rounds link next to
nothing more, the largest component of a node is its host, and the classes that
are still outside it are compared with each other and with the host's members on
their full sets, in cells of bounded size. So a group of many copies costs a few
passes over its members and, for each class that belongs to none, one more.

Candidates come from codes of one byte per token, with a threshold far enough
below the wanted similarity that chance does not lose a pair. Every candidate is
confirmed on the full sets before it links.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing; texts with fewer words than a shingle have their whole
sequence as their one shingle; every row counts by a key of its own, so rows
without an id link like others but give their component no name, and rows of one
id may hold unlike texts; repeated rows are judged each; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, documents, drop_cut, map_texts, pieces, with_row, without

SIGNATURE, CODES = 128, 64
"""Minwise tokens of a class, and how many of them have a code for the first comparison."""
TREES, BRANCH, LEVELS = 4, 2, 3
SMALL = 64
"""Classes of a node that are compared exhaustively."""
KNOWN_WORDS = 300_000
"""Hashes of so many words are held by a task; then it starts anew."""
CELL_ROWS, CELL_BYTES = 1024, 8 << 20
"""Rows and bytes of each side of a cell, about, in which sets are compared at last."""
WORTH = 0.05
"""Another round of blocks follows if the last one linked so many of the rows it dealt."""
SLACK = 5.0
"""Standard deviations that a candidate's estimate may lie below the wanted similarity."""
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
STEPS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
FACTORS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * U(2) + U(1)
SHIFTS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
ROOTS = np.array([_rng.permutation(SIGNATURE)[:BRANCH] for _ in range(TREES)])
SEEDS = _rng.integers(0, 1 << 63, (TREES, BRANCH), dtype=np.uint64)


def stir(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    """Sets of hashed shingles of ``size`` words, A-Z in lower case."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(h))
        n = len(h) - k + 1
        made = np.full(n, U(k))
        for j in range(k):
            made = made * STEPS[-1] + h[j:j + n] * STEPS[j % 15]
        return np.unique(stir(made))


def signature(items: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set."""
    least = np.full(SIGNATURE, ~U(0))
    for at in range(0, len(items), 256):
        part = items[at:at + 256]
        np.minimum(least, (part[None, :] * FACTORS[:, None] + SHIFTS[:, None]).min(1), out=least)
    return stir(least)


def paths(sig: np.ndarray) -> np.ndarray:
    """Names of the nodes that classes pass, given their signatures as rows: per branch of a root the node, its children, theirs.

    A child's place in the signature follows from the node's name, so classes that meet in a node ask for the same token.
    """
    out = []
    for t in range(TREES):
        for b in range(BRANCH):
            level = [stir(sig[:, ROOTS[t, b]] ^ SEEDS[t, b])]
            out.append(level[0])
            for _ in range(LEVELS - 1):
                below = []
                for node in level:
                    for j in range(BRANCH):
                        ask = stir(node ^ STEPS[j])
                        token = np.take_along_axis(sig, (ask % U(SIGNATURE)).astype(np.int64)[:, None], 1)[:, 0]
                        below.append(stir(ask ^ token))
                out += below
                level = below
    return np.stack(out, 1).view(np.int64)


NODES = sum(BRANCH**i for i in range(LEVELS))
"""Nodes named per branch of a root."""


def describe(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(id, n_shingles, same, codes, nodes) of every row; ``same`` names the set by 128 bits."""
    def make():
        shingles = Shingles(size)

        def work(texts):
            n, same, sigs = [], [], []
            for t in texts:
                items = shingles.of(t)
                n.append(len(items))
                same.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                sigs.append(signature(items) if len(items) else np.zeros(SIGNATURE, np.uint64))
            sig = np.stack(sigs) if sigs else np.zeros((0, SIGNATURE), np.uint64)
            codes = ((sig[:, :CODES] >> U(20)) & U(255)).astype(np.uint8)
            return [n, same, [c.tobytes() for c in codes], list(paths(sig))]

        return work

    return map_texts(docs.select(F.col(key).alias("id"), text), text, make, "n_shingles long, same binary, codes binary, nodes array<long>")


def sets_of(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(id, items): the whole sets, sorted, eight bytes a shingle."""
    def make():
        shingles = Shingles(size)
        return lambda texts: [[shingles.of(t).tobytes() for t in texts]]

    return map_texts(docs.select(F.col(key).alias("id"), text), text, make, "items binary")


def tree_nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small nodes and what is left of large ones at the last level, as (node, id, codes) rows; nodes of one class are left out."""
    at = lambda i: F.element_at("nodes", F.col("b") * NODES + 1 + i)
    level = classes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(TREES * BRANCH - 1)))).select(
        "id", "codes", at(0).alias("node"), F.slice("nodes", F.col("b") * NODES + 2, NODES - 1).alias("below"))
    small = []
    for depth in range(LEVELS):
        level = cut(level)
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = cut(level.join(sizes, "node"))
        small.append(met.where(F.col("n") <= SMALL).select("node", "id", "codes"))
        large = met.where(F.col("n") > SMALL)
        drop_cut(level)
        if depth == LEVELS - 1:
            break
        # the names of a node's children come first, then theirs in the same order
        j = F.col("j")
        under = [F.element_at("below", j + 1).alias("node")]
        for d in range(1, LEVELS - depth - 1):
            first, width = sum(BRANCH**i for i in range(1, d + 1)), BRANCH**d
            under.append(F.slice("below", first + 1 + j * width, width).alias(f"_below{d}"))
        level = large.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1)))).select("id", "codes", *under)
        parts = [c for c in level.columns if c.startswith("_below")]
        level = level.withColumn("below", F.concat(*parts) if parts else F.array().cast("array<long>")).drop(*parts)
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    return out, large.select("node", "id", "codes", "n")


def alike(rows: DataFrame, least: int, chain: bool) -> DataFrame:
    """Candidate pairs (a, b) with a < b among the rows of equal ``node``, if at least ``least`` codes agree.

    ``rows`` has (node, id, codes, comp); rows of one component are not compared.
    With ``chain`` a row gives only its nearest partner, which is enough to join what is
    alike throughout; what that leaves apart is compared in full afterwards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            node = now.column("node").to_numpy()
            start = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if start:
                yield from pairs(now.slice(0, start))
            held = now.slice(start)
        if held is not None:
            yield from pairs(held)

    def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
        node, ids, comp = (part.column(c).to_numpy() for c in ("node", "id", "comp"))
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, CODES)
        open_ = np.ones(len(node), bool)
        for d in range(1, len(node)):
            near = node[:-d] == node[d:]
            if not near.any():
                break
            i = np.flatnonzero(near & (comp[:-d] != comp[d:]) & open_[d:])
            for at in range(0, len(i), 65536):
                k = i[at:at + 65536]
                k = k[(codes[k] == codes[k + d]).sum(1) >= least]
                if chain:
                    open_[k + d] = False
                a, b = np.minimum(ids[k], ids[k + d]), np.maximum(ids[k], ids[k + d])
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = rows.select("node", "id", "codes", "comp").repartition("node").sortWithinPartitions("node", F.xxhash64("id"))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("_wanted")).distinct())
    some = docs.join(wanted, docs[key] == wanted["_wanted"], "left_semi").dropDuplicates([key])
    sets = cut(sets_of(some, size, text, key))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "left"):
                ok = []
                for x, y in zip(part.column("left"), part.column("right")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok, pa.bool_())), part.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked id: the smallest id it can reach.

    In turn every id points to its smallest neighbour, pointers are followed to
    their ends by doubling, and links are drawn anew between the ends, until
    none is left between different ends.
    """
    old: list[DataFrame] = []
    named, left = None, cut(links.select("a", "b"))
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        way = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")))
        while True:
            step = way.select(F.col("id").alias("_at"), F.col("comp").alias("_to"))
            far = cut(way.join(step, F.col("comp") == F.col("_at"), "left").select("id", F.coalesce("_to", "comp").alias("comp"), (F.col("_to") != F.col("comp")).alias("_moved")))
            moved = not far.where("_moved").isEmpty()
            old.append(way)
            way = far.select("id", "comp")
            if not moved:
                break
        if named is None:
            named = way
        else:
            end = way.select(F.col("id").alias("_at"), F.col("comp").alias("_to"))
            named = cut(named.join(end, F.col("comp") == F.col("_at"), "left").select("id", F.coalesce("_to", "comp").alias("comp")))
        a, b = (way.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}")) for c in "ab")
        rest = cut(left.join(a, "a").join(b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        old.append(left)
        left = rest
        if left.isEmpty():
            drop_cut(*old)
            return named


class Linker:
    """Confirmed links so far, and the component of every class by them."""

    def __init__(self, classes: DataFrame, docs: DataFrame, size: int, percent: int, text: str, key: str) -> None:
        self.classes, self.how = classes, (docs, size, percent, text, key)
        share = percent / 100
        self.least = int(CODES * (share - SLACK * (share * (1 - share) / CODES) ** 0.5))
        self.comps = self.links = self.tried = None
        self.added = 0  # links that the last call brought

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their ``id``."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(self.comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def link(self, rows: DataFrame, chain: bool) -> tuple[bool, bool]:
        """Compare ``rows`` (with components), confirm candidates that were not tried before; whether candidates and links came."""
        self.added = 0
        found = alike(rows, self.least, chain)
        if self.tried is not None:
            found = found.join(self.tried, ["a", "b"], "left_anti")
        found = cut(found)
        if found.isEmpty():
            return False, False
        self.tried = found if self.tried is None else self.tried.unionByName(found)
        return True, self.add(confirm(found, *self.how))

    def add(self, links: DataFrame) -> bool:
        new = cut(links)
        self.added = new.count()
        if self.added:
            self.links = new if self.links is None else self.links.unionByName(new)
            self.comps = components(self.links)
        return self.added > 0

    def gather(self, rows: DataFrame) -> None:
        """Compare on full sets what is outside the largest component of its node, with that component and with each other."""
        docs, size, percent, text, key = self.how
        host = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("node").agg(
            F.max_by("comp", F.struct("_n", -F.col("comp"))).alias("host"))
        odd = rows.join(host, "node").where("comp <> host").select("host", "id", "comp").distinct()
        odd = cut(odd.join(self.classes.select("id", "n_shingles"), "id"))
        hosts = odd.select("host").distinct()
        inside = cut(self.placed(self.classes.select("id", "n_shingles")).join(hosts, F.col("comp") == F.col("host")).select("host", "id", "comp", "n_shingles"))
        many = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_ROWS), F.ceil(F.sum("n_shingles") * 8 / CELL_BYTES))
        sizes = odd.groupBy("host").agg(many.alias("q")).join(inside.groupBy("host").agg(many.alias("p")), "host")
        cell = lambda kind, i, j: F.xxhash64("host", F.lit(kind), i, j)
        mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        members = inside.join(sizes, "host").select(
            F.explode(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda i: cell(0, i, mine("p")))).alias("cell"), "id", "comp", F.lit(False).alias("odd"))
        others = odd.join(sizes, "host").select(F.explode(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: cell(0, mine("q"), j)),
            F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: 
                cell(1, F.least(mine("q"), j), F.greatest(mine("q"), j))))).alias("cell"), "id", "comp", F.lit(True).alias("odd"))
        placed = cut(members.unionByName(others))
        wanted = cut(placed.select(F.col("id").alias("_wanted")).distinct())
        sets = cut(sets_of(docs.join(wanted, docs[key] == wanted["_wanted"], "left_semi").dropDuplicates([key]), size, text, key))
        full = placed.join(sets, "id").repartition("cell").sortWithinPartitions("cell")
        self.add(full.mapInArrow(cell_links(percent), "a long, b long").distinct())


def cell_links(percent: int):
    """Links among the rows of a cell, (cell, id, comp, odd, items) sorted by cell: enough of them to join what is alike.

    Rows marked odd are compared with all others of the cell.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.select(["cell", "id", "comp", "odd", "items"]).to_pylist():
                if held and held[0]["cell"] != row["cell"]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    def links(rows: list[dict]) -> pa.RecordBatch:
        sets = [np.frombuffer(r["items"], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        words, code = np.unique(np.concatenate(sets), return_inverse=True)
        root = {r["comp"]: r["comp"] for r in rows}

        def end(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found, mark = [], np.zeros(len(words), bool)
        for i, row in enumerate(rows):
            if row["odd"]:
                own = code[starts[i]:starts[i] + sizes[i]]
                mark[own] = True
                common = np.add.reduceat(mark[code], starts)
                mark[own] = False
                for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common)).tolist():
                    a, b = end(row["comp"]), end(rows[j]["comp"])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append(sorted((row["id"], rows[j]["id"])))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def apart(rows: DataFrame) -> DataFrame:
    """The rows of nodes that hold more than one component."""
    ends = rows.groupBy("node").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("node")
    return rows.join(ends, "node")


def block(node: Column, number: Column) -> Column:
    return F.xxhash64(node, number)


def link_large(linker: Linker, large: DataFrame) -> None:
    """Settle nodes too large to compare at once, as told above."""
    turn = 0
    while True:
        turn += 1
        rows = cut(apart(linker.placed(large.select("node", "id", "codes"))))
        if rows.isEmpty():
            return
        one = rows.groupBy("node", "comp").agg(F.min_by(F.struct("id", "codes"), F.xxhash64(F.lit(turn), "id")).alias("x")).select("node", "comp", "x.*")
        one = cut(one)
        sizes = one.groupBy("node").agg(F.ceil(F.count(F.lit(1)) * 2 / SMALL).alias("_blocks"))
        dealt = one.join(sizes, "node").withColumn("node", block(F.col("node"), F.pmod(F.xxhash64(F.lit(-turn), "id"), F.col("_blocks"))))
        linker.link(dealt.drop("_blocks"), chain=True)
        if linker.added < WORTH * one.count():
            break
    rows = cut(apart(linker.placed(large.select("node", "id", "codes"))))
    if not rows.isEmpty():
        linker.gather(rows)


def row_components(keyed: DataFrame, size: int, percent: int, text: str, row: str) -> DataFrame:
    """(row, n_shingles, comp) of every row: the smallest row key it can reach; null for an empty set."""
    rows = cut(describe(keyed, size, text, row))
    classes = cut(rows.where("n_shingles > 0").groupBy("same").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("codes").alias("codes"), F.first("nodes").alias("nodes")))
    small, large = tree_nodes(classes)
    linker = Linker(classes, keyed, size, percent, text, row)
    if linker.link(linker.placed(small), chain=True)[0]:
        # what is joined by now need not meet again; the rest meets in full
        linker.link(apart(linker.placed(small)), chain=False)
    link_large(linker, large)
    named = linker.placed(classes.select("same", "id")).select("same", "comp")
    return cut(rows.select(F.col("id").alias(row), "n_shingles", "same").join(named, "same", "left").drop("same"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    keyed, row = with_row(docs.select(key, text))
    told = row_components(keyed, size, percent, text, row).join(keyed.select(row, F.col(key).alias("id")), row)
    names = told.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    out = told.join(names, "comp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, all columns kept.

    Rows are told apart by a key of their own; a row without an id stays if its component has none.
    """
    keyed, row = with_row(docs)
    told = row_components(keyed, size, percent, text, row).where("comp is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", row)).alias("first")
    stay = told.join(keyed.select(row, F.col(key).alias("id")), row).groupBy("comp").agg(first).select(F.col("first")[row].alias(row))
    return without(keyed, told.select(row).join(stay, row, "left_anti"), row).drop(row)


def op4_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Held against all pairs by brute force in tests."""
    return near_duplicates(documents(spark, sf), size=2)
