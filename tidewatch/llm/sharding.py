"""Sharding by balanced label propagation.

Rows are linked when their texts are equal. They start on shards with row
counts at most one apart. Every group of linked rows asks for the shard where
most of it lies and that still has room for all of it, ties by a hash; a shard
admits larger groups first, up to its row quota, and a group that was refused
asks for its next shard, until none is left. Then the rows outside their
group's shard change places with unlinked rows, which no shard attracts, so
the counts stay as they are. A group larger than a shard's quota is parted into
parts of that quota and one remainder; any other group is parted only when all
shards have less room left than it has rows.

What meets in the driver: the groups of at least one in ``LARGE`` of a shard's
share (at most ``LARGE`` times the shards), the groups that fit nowhere (fewer
than the shards), and counts per shard and group size.

Defined cases: null texts have size 1, count as empty and are linked with empty
ones; rows without an id and repeated rows are rows of their own; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.lineage import with_rank
from .common import cut, documents, drop_cut, rank_within

SIZE, CHECKSUM = "octet_length(coalesce({0}, '')) + 1", "crc32(cast(coalesce({0}, '') as binary))"
LARGE = 256
"""Groups of a shard's share divided by this, or more, are placed one by one; smaller ones by counts per size."""


def shard_rows(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shard and slot of every row: (key, size, text_crc32, law, shard, slot, grown_shard)."""
    rows = docs.select(
        F.col(key).alias("id"), F.expr(SIZE.format(text)).cast("long").alias("size"), F.expr(CHECKSUM.format(text)).cast("long").alias("crc"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("same"))
    # a total order that has nothing to do with the texts deals the first places
    placed = cut(with_rank(rows, [F.xxhash64("id"), F.col("id"), F.col("same"), F.col("size")], "row").withColumn(
        "shard", (F.col("row") % shards).cast("int")))
    quota = {s: 0 for s in range(shards)} | {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    held = F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)])
    units = cut(placed.groupBy("same").agg(F.count(F.lit(1)).alias("n"), held.alias("held")).where("n > 1"))
    out = rank_within(exchange(placed, units, quota), ["shard"], [F.col("row")], "slot")
    return out.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def exchange(placed: DataFrame, units: DataFrame, quota: dict[int, int]) -> DataFrame:
    """The rows with every group on its shard; every shard keeps its count."""
    spark = placed.sparkSession
    pieces, small, room = homes(units, quota)
    cols = [c for c in placed.columns if c != "shard"]
    table = F.broadcast(spark.createDataFrame(pieces, "same binary, _low long, _high long, _home int"))
    often = F.broadcast(table.groupBy("same").agg(F.count(F.lit(1)).alias("_parts"), F.max("_home").alias("_one")))
    known = placed.join(often, "same", "left")
    # large groups meet short lists only, and never in a join that deals them out by their text
    whole = known.where("_parts = 1").select(*cols, F.col("_one").alias("shard"))
    parted = rank_within(known.where("_parts > 1").select(*cols), ["same"], [F.xxhash64("row"), F.col("row")], "_rank")
    parted = parted.join(table, (parted["same"] == table["same"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))).select(
        *[parted[c] for c in cols], F.col("_home").alias("shard"))
    rest = known.where("_parts is null").select(*cols, "shard")
    if small is None:
        return whole.unionByName(parted).unionByName(unlinked(rest, room))
    rest = cut(rest.join(small, "same", "left"))
    linked = rest.where("_home is not null").select(*cols, F.col("_home").alias("shard"))
    return whole.unionByName(parted).unionByName(linked).unionByName(unlinked(rest.where("_home is null").drop("_home"), room))


def unlinked(rows: DataFrame, room: dict[int, int]) -> DataFrame:
    """Unlinked rows beyond what is left of a shard's quota go where linked rows have left."""
    lie = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    short = {s: n - lie.get(s, 0) for s, n in room.items() if n > lie.get(s, 0)}
    moves = []
    for s in sorted(lie):
        at = room[s]
        while at < lie[s]:
            to = min(short)
            n = min(lie[s] - at, short[to])
            moves.append((s, at, at + n, to))
            at, short[to] = at + n, short[to] - n
            if not short[to]:
                del short[to]
    if not moves:
        return rows
    table = rows.sparkSession.createDataFrame(moves, "_s int, _low long, _high long, _new int")
    ranked = rank_within(rows, ["shard"], [F.xxhash64("row"), F.col("row")], "_rank")
    # at most twice as many rows as shards, whatever the input's size
    hit = (F.col("shard") == F.col("_s")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    return ranked.join(F.broadcast(table), hit, "left").select(*[c for c in rows.columns if c != "shard"], F.coalesce("_new", "shard").alias("shard"))


def homes(units: DataFrame, quota: dict[int, int]) -> tuple[list[tuple], DataFrame | None, dict[int, int]]:
    """Where groups go: pieces (group, first rank, end, shard) of large or parted ones, (same, _home) of others, and the room left."""
    least = -(-sum(quota.values()) // (LARGE * len(quota)))
    listed = lambda df: [(bytes(r["same"]), r["n"], list(r["held"])) for r in df.collect()]
    pieces, room = place(listed(units.where(F.col("n") >= least)), quota)
    left, done, used = cut(units.where(F.col("n") < least)), [], []
    while True:
        asked = cut(left.withColumn("_home", wanted(room)))
        used += [left, asked]
        hist = asked.groupBy("_home", "n").agg(F.count(F.lit(1)).alias("many")).collect()
        took = []
        for home, n, many in sorted(((r["_home"], r["n"], r["many"]) for r in hist if r["_home"] is not None), key=lambda x: (x[0], -x[1])):
            k = min(many, room[home] // n)
            room[home] -= k * n
            took.append((home, n, k, k < many))
        if not took:
            break
        all_in = asked.join(F.broadcast(units.sparkSession.createDataFrame(took, "_home int, n long, _k long, _part boolean")), ["_home", "n"])
        done.append(cut(all_in.where(~F.col("_part")).select("same", "_home")))
        if not any(t[3] for t in took):
            left = cut(asked.where("_home is null").drop("_home"))
            continue
        ranked = cut(rank_within(all_in.where("_part"), ["_home", "n"], [F.xxhash64("same"), F.col("same")], "_rank"))
        done.append(cut(ranked.where("_rank < _k").select("same", "_home")))
        used.append(ranked)
        left = cut(ranked.where("_rank >= _k").select("same", "n", "held").unionByName(asked.where("_home is null").select("same", "n", "held")))
    # what fits on no shard: fewer groups than shards, as each is larger than any room left
    more, room = place(listed(asked), room)
    drop_cut(*used)
    small = None
    for df in done:
        small = df if small is None else small.unionByName(df)
    return pieces + more, small, room


def wanted(room: dict[int, int]) -> Column:
    """The shard with most rows of a group among those with room for it; ties by a hash, in proportion to the room; null if none has."""
    chance = lambda s: (F.pmod(F.xxhash64("same", F.lit(s)), F.lit(1 << 31)) + 1) / float((1 << 31) + 1)
    bid = lambda s, n: F.when(F.lit(n) >= F.col("n"), F.struct(
        F.col("held")[s].alias("rows"), (F.lit(float(n)) / -F.log(chance(s))).alias("tie"), F.lit(s).alias("home")))
    return F.array_max(F.array(*[bid(s, n) for s, n in room.items()]))["home"]


def place(units: list[tuple[bytes, int, list[int]]], quota: dict[int, int]) -> tuple[list[tuple[bytes, int, int, int]], dict[int, int]]:
    """Pieces of the given groups, largest first, and the room then left.

    A group takes the shard with most of its rows; if that parts more groups than
    taking the tightest fit does, the tightest fit is taken.
    """
    plans = []
    for tight in (False, True):
        room, pieces = dict(quota), []
        heap = [(-n, zlib.crc32(same), same, 0, held) for same, n, held in units]
        heapq.heapify(heap)
        while heap:
            n, salt, same, low, held = heapq.heappop(heap)
            n, tie = -n, lambda s: zlib.crc32(b"%d %d" % (salt, s))
            fits = [s for s in room if room[s] >= n]
            if fits:
                home = max(fits, key=lambda s: (-room[s] if tight else 0, held[s], room[s], tie(s)))
            else:
                home = max(room, key=lambda s: (room[s], held[s], tie(s)))
            took = min(n, room[home])
            room[home] -= took
            pieces.append((same, low, low + took, home))
            if took < n:
                heapq.heappush(heap, (took - n, salt, same, low + took, held))
        plans.append((pieces, room))
    return min(plans, key=lambda p: len(p[0]))


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Balance, gapless slots and joined groups are held against brute force in tests."""
    return shard_rows(documents(spark, sf))
