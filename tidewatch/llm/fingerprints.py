"""Document fingerprints: invertible Bloom lookup sketches of a text's parts.

A text is cut into paragraphs at line breaks, and a longer line into parts at
words chosen by the bytes before them, so an edit changes the parts it touches
and no others. Every part, with its number among equal ones, has a 64-bit
digest that carries the part's bytes in its low end. A sketch has three tables
of 2^level cells; a digest goes to one cell of each, where it is counted and
xor-ed together with a check value. Sketches of one level subtract cell by cell;
what both texts share vanishes, and peeling the cells that hold a single digest
recovers those that differ, on either side. If peeling gets stuck, both
sketches are made anew with tables twice as large, until it ends.

The likeness of two fingerprints is the share of bytes in common parts among
the bytes of all parts: from 1 for the same parts to 0 for none in common.

Defined cases: a null text counts as empty, has no parts, and is alike to
another empty text only; parts in another order make the same sketch; rows are
ordered by id, those without one first, then by a hash of the text, so a row of
a repeated id is followed by another of them; the only row follows itself;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import documents, map_rows, pieces

PART_BYTES = 512
"""No part is longer."""
WORD_STEP = 8
"""One of so many words begins a part."""
LAST_LEVEL = 20
"""Three cell numbers of at most 20 bits come from one 64-bit number."""
SLICE_ROWS = 4096
SLICES = 20_000
"""Ordered rows are dealt in slices of about so many rows, at most so many slices."""

_MIX, _CHECK, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    """64 bits that all depend on all of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * factor
    x = (x ^ (x >> np.uint64(29))) * _AGAIN
    return x ^ (x >> np.uint64(32))


def part_starts(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Where parts begin in texts laid end to end, text i from ``starts[i]`` to ``starts[i + 1]``."""
    if not raw:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(raw, np.uint8)
    space = _SPACE[codes]
    fresh = np.zeros(len(codes), bool)
    fresh[1:] = space[:-1] & ~space[1:]
    word = np.flatnonzero(fresh)
    line = codes[word - 1] == 10
    # the four bytes before the space; a text's first words have fewer and begin no part
    owner_start = starts[np.searchsorted(starts, word, "right") - 1]
    deep = word - owner_start >= 5
    tail = np.zeros(len(word), np.uint64)
    for back in range(2, 6):
        tail = (tail << np.uint64(8)) | np.where(deep, codes[np.maximum(word - back, 0)], 0).astype(np.uint64)
    chosen = word[(word > owner_start) & (line | (deep & (_mixed(tail, _MIX) % np.uint64(WORD_STEP) == 0)))]
    found = np.union1d(chosen, starts[:-1][np.diff(starts) > 0])
    gap = np.diff(np.append(found, len(codes)))
    if (gap <= PART_BYTES).all():
        return found
    times = (gap - 1) // PART_BYTES + 1
    first = np.repeat(found, times)
    return first + PART_BYTES * (np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times))


def part_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, owners) of the parts of every text; a digest's low ten bits are the part's bytes."""
    raw = b"".join(texts)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    begin = part_starts(raw, starts)
    view, at = memoryview(raw), begin.tolist()
    hashed = np.fromiter((xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(at, [*at[1:], len(raw)])), np.uint64, len(at))
    size = np.diff(np.append(begin, len(raw))).astype(np.uint64)
    owner = np.searchsorted(starts, begin, "right") - 1
    # equal parts of one text are told apart by their number
    order = np.lexsort((hashed, owner))
    same = np.zeros(len(at), bool)
    same[1:] = (hashed[order][1:] == hashed[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    place = np.arange(len(at))
    turn = np.empty(len(at), np.int64)
    turn[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    hashed = np.where(turn > 0, _mixed(hashed + turn.astype(np.uint64) * _CHECK, _CHECK), hashed)
    return (hashed << np.uint64(10)) | size, owner


class Sketches:
    """Sketches of several sets of digests; set i has three tables of ``2 ** levels[i]`` cells."""

    def __init__(self, levels: np.ndarray) -> None:
        self.levels = levels.astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(3 << self.levels)))
        self.count = np.zeros(self.base[-1], np.int64)
        self.key = np.zeros(self.base[-1], np.uint64)
        self.check = np.zeros(self.base[-1], np.uint64)

    def cells(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        level, spread = self.levels[owner], _mixed(keys, _MIX)
        mask = (np.uint64(1) << level.astype(np.uint64)) - np.uint64(1)
        return np.concatenate([self.base[owner] + (t << level) + ((spread >> np.uint64(21 * t)) & mask).astype(np.int64) for t in range(3)])

    def add(self, keys: np.ndarray, owner: np.ndarray, times=1) -> Sketches:
        at = self.cells(keys, owner)
        np.add.at(self.count, at, np.tile(np.broadcast_to(times, keys.shape), 3))
        np.bitwise_xor.at(self.key, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.check, at, np.tile(_mixed(keys, _CHECK), 3))
        return self

    def less(self, other: Sketches) -> Sketches:
        """This less ``other``, cell by cell; both are of the same levels."""
        out = Sketches(self.levels)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, owners, sides, whole): what the cells hold, side 1 or -1, and whether a set gave up all it held."""
        keys, owners, sides = [], [], []
        look = np.flatnonzero(self.count)
        for _ in range(64 + 2 * len(self.levels) + len(look)):
            look = look[(np.abs(self.count[look]) == 1) & (_mixed(self.key[look], _CHECK) == self.check[look])]
            if not len(look):
                break
            owner = np.searchsorted(self.base, look, "right") - 1
            order = np.lexsort((self.key[look], owner))
            first = np.ones(len(look), bool)
            first[1:] = (np.diff(owner[order]) != 0) | (self.key[look][order][1:] != self.key[look][order][:-1])
            pick = order[first]
            key, owner, side = self.key[look][pick], owner[pick], self.count[look][pick]
            self.add(key, owner, -side)
            keys.append(key), owners.append(owner), sides.append(side)
            look = np.unique(self.cells(key, owner))
        held = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = np.add.reduceat(held, self.base[:-1], dtype=np.int64) == 0 if len(self.levels) else np.zeros(0, bool)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(keys, np.uint64), join(owners, np.int64), join(sides, np.int64), whole

    def written(self, i: int) -> str:
        """Set i as text: its level, then counts, digests and check values of its cells."""
        a, b = self.base[i], self.base[i + 1]
        raw = struct.pack("<B", self.levels[i]) + self.count[a:b].astype("<i4").tobytes() + self.key[a:b].tobytes() + self.check[a:b].astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


def level_for(n: np.ndarray) -> np.ndarray:
    """The level at which a set of n digests is written: a cell to six digests, two cells a table at least."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 18)), 1, LAST_LEVEL).astype(np.int64)


def differences(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, pairs, sides) by which the sets of n pairs differ, each side given as (digests, owners).

    Tables start at the smaller set's written level; pairs whose peeling gets
    stuck try again with tables twice as large.
    """
    of = lambda side: np.bincount(side[1], minlength=n)
    level = np.minimum(level_for(of(left)), level_for(of(right)))
    todo, found = np.arange(n), []
    while len(todo) and level[todo].max() <= LAST_LEVEL:
        number = np.full(n, -1)
        number[todo] = np.arange(len(todo))
        made = []
        for keys, owner in (left, right):
            here = number[owner]
            made.append(Sketches(level[todo]).add(keys[here >= 0], here[here >= 0]))
        keys, owner, sides, whole = made[0].less(made[1]).peel()
        done = whole[owner]
        found.append((keys[done], todo[owner[done]], sides[done]))
        todo = todo[~whole]
        level[todo] += 1
    for i in todo.tolist():  # two digests share all cells of the largest tables
        a, b = left[0][left[1] == i], right[0][right[1] == i]
        for keys, side in ((np.setdiff1d(a, b), 1), (np.setdiff1d(b, a), -1)):
            found.append((keys, np.full(len(keys), i), np.full(len(keys), side)))
    return tuple(np.concatenate([f[j] for f in found]) for j in range(3)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def likeness(left, right, n: int) -> np.ndarray:
    """Bytes of common parts over bytes of all parts, for n pairs; 1 if neither has any."""
    size = lambda keys: (keys & np.uint64(1023)).astype(np.int64)
    total = np.bincount(left[1], size(left[0]), n)
    keys, pair, side = differences(left, right, n)
    gone, come = (np.bincount(pair[side == s], size(keys[side == s]), n) for s in (1, -1))
    union = total + come
    return np.where(union > 0, (total - gone) / np.maximum(union, 1), 1.0)


def written_sketches(digests: tuple[np.ndarray, np.ndarray], n: int) -> list[str]:
    sketches = Sketches(level_for(np.bincount(digests[1], minlength=n))).add(*digests)
    return [sketches.written(i) for i in range(n)]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every text."""
    given = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))

    def make():
        return lambda texts: [written_sketches(part_digests([t.encode() for t in texts]), len(texts))]

    return map_rows(given, "_text", [], make, "fingerprint string").withColumnRenamed("_key", key)


def paragraph_changes(versions: DataFrame, old: str, new: str, key: str = "doc_id") -> DataFrame:
    """(key, likeness, removed, added): digests of the parts that only the old or only the new version has, in order."""
    given = versions.select(F.col(key).alias("_key"), F.coalesce(old, F.lit("")).alias("_old"), F.coalesce(new, F.lit("")).alias("_new"))

    def make():
        def work(olds, news):
            n = len(olds)
            left, right = (part_digests([t.encode() for t in side]) for side in (olds, news))
            keys, pair, side = differences(left, right, n)
            lists = [[[] for _ in olds], [[] for _ in olds]]
            for k, i, s in zip(keys.astype(np.int64).tolist(), pair.tolist(), side.tolist()):
                lists[s < 0][i].append(k)
            return [likeness(left, right, n).tolist(), *[[sorted(x) for x in part] for part in lists]]

        return work

    made = map_rows(given, "_old", ["_new"], make, "likeness double, removed array<bigint>, added array<bigint>")
    return made.withColumnRenamed("_key", key)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the one that follows."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def with_next(docs: DataFrame, text: str, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """Rows (_slice, _edge, _key, _hash, _text) dealt by slices of the order and sorted, so each row's next one follows it.

    A slice ends with an edge, a copy of the next slice's first row; the last
    slice's is the first row of all. Slices begin at rows drawn at random, whose
    number is bounded, so ids may be dealt unevenly or repeat: rows of one id
    part by the hash of their text. Only places of slices depend on the draw.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    n, nulls, low = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_key").isNull()), F.min("_key")).first()
    if not n:
        return None
    start = F.col("_key").isNull() if nulls else F.col("_key") == F.lit(low)
    first = hashed.where(start).agg(F.min("_hash")).first()[0]
    place = lambda k, h: (k is not None, k if k is not None else 0, h)
    slices = min(SLICES, -(-n // slice_rows))
    drawn = sorted({place(*r) for r in hashed.select("_key", "_hash").sample(min(1.0, 16 * slices / n), seed=7).limit(32 * slices).collect()})
    bounds = sorted({place(None if nulls else low, first), *[drawn[i * len(drawn) // slices] for i in range(1, slices) if drawn]})
    schema = T.StructType([T.StructField("_slice", T.IntegerType()), T.StructField("_edge", T.BooleanType()), *hashed.schema.fields])
    arrow = to_arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [place(k, h) for k, h in zip(batch.column("_key").to_pylist(), batch.column("_hash").to_pylist())]
            at = [bisect.bisect_right(bounds, p) - 1 for p in places]
            edge = [i for i, (a, p) in enumerate(zip(at, places)) if bounds[a] == p]
            whole = pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([False] * len(at)), *batch.columns], schema=arrow)
            yield whole
            if edge:
                copies = whole.take(pa.array(edge))
                before = pa.array([(at[i] - 1) % len(bounds) for i in edge], pa.int32())
                yield pa.RecordBatch.from_arrays([before, pa.array([True] * len(edge)), *copies.columns[2:]], schema=arrow)

    dealt = hashed.mapInArrow(deal, schema)
    return dealt.repartitionById(len(bounds), "_slice").sortWithinPartitions("_slice", "_edge", F.asc_nulls_first("_key"), "_hash")


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike the first is to the edited and the next one's."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    placed = with_next(docs, text, key, slice_rows)
    if placed is None:
        return docs.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def compare(rows: list[dict]) -> pa.RecordBatch:
        """Rows of all but the last; the next of each is the one after it."""
        texts = [r["_text"] for r in rows]
        real = [i for i in range(len(rows) - 1) if not rows[i]["_edge"]]
        n, raws = len(real), [t.encode() for t in texts]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in real]
        keys, owner = part_digests(raws)
        number = np.full(len(rows), -1)
        number[real] = np.arange(n)
        after = np.full(len(rows), -1)
        after[np.array(real, np.int64) + 1] = np.arange(n)
        pick = lambda where: (keys[where[owner] >= 0], where[owner][where[owner] >= 0])
        own, following, new = pick(number), pick(after), part_digests(changed)
        columns = [
            [rows[i]["_key"] for i in real], [len(texts[i]) for i in real], [hashlib.sha256(c).hexdigest() for c in changed],
            written_sketches(own, n), written_sketches(new, n), likeness(own, new, n), likeness(own, following, n)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for piece in pieces(batch, "_text"):
                held += piece.select(["_edge", "_key", "_text"]).to_pylist()
                if len(held) > 1:
                    yield compare(held)
                    held = held[-1:]

    return placed.mapInArrow(run, schema)


def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Held against plain set differences of the parts and a sequential edit in tests."""
    return compare_with_next(documents(spark, sf))
