"""Document tokens with positions: cleaning, reading order, fragments, regions.

Tokens are rows (doc_id, pos, token_id, text, box, confidence, page_w, page_h);
``box`` is null for text without geometry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import boxes as B, text as T
from ..plans.lineage import numbered, once, top_by

TOKEN_COLUMNS = ["doc_id", "pos", "token_id", "text", "box", "confidence", "page_w", "page_h"]


def page_size(width: str = "page_w", height: str = "page_h") -> tuple[Column, Column]:
    """Page sides, 1 where they make no sense."""
    bad = (F.col(width) <= 0) | (F.col(height) <= 0)
    return F.when(bad, 1.0).otherwise(F.col(width)), F.when(bad, 1.0).otherwise(F.col(height))


def clean_tokens(tokens: DataFrame, zones: DataFrame | None = None, min_confidence: float = 0.20) -> DataFrame:
    """Tokens with tidy text, enough confidence, and their centre outside every zone.

    ``zones`` is a small table (name, zone) of boxes in fractions of the page.
    """
    w, h = page_size()
    t = (
        tokens.withColumn("text", T.squeeze(F.col("text")))
        .where((F.col("text") != "") & (F.col("confidence") >= min_confidence))
        .withColumn("token_id", F.coalesce("token_id", F.col("pos") + 1))
        .withColumn("cx_rel", B.centre_x(F.col("box")) / w)
        .withColumn("cy_rel", B.centre_y(F.col("box")) / h)
    )
    if zones is None:
        return t
    inside = B.contains_point(F.col("zone"), F.col("cx_rel"), F.col("cy_rel"))
    return t.join(F.broadcast(zones.select("zone")), inside, "left_anti")


def flyer_zones(spark, top: float = 0.12, bottom: float = 0.88) -> DataFrame:
    """Header and footer bands of a flyer."""
    rows = [("banner_topo_cabecalho", (0.0, 0.0, 1.0, top)), ("rodape_disclaimer_juridico", (0.0, bottom, 1.0, 1.0))]
    return spark.createDataFrame(rows, "name string, zone struct<x_min:double,y_min:double,x_max:double,y_max:double>")


def reading_order(tokens: DataFrame, line_height: float = 0.02) -> DataFrame:
    """Cleaned tokens renumbered (``pos`` from 1) by line, then left to right; text without a box follows as it came."""
    placed = F.col("box").isNotNull()
    line = F.when(placed, (F.col("cy_rel") / max(0.001, line_height)).cast("long")).otherwise(F.col("pos").cast("long"))
    t = tokens.withColumn("_flag", F.when(placed, 0).otherwise(1)).withColumn("_line", line).withColumn(
        "_x", F.when(placed, F.col("cx_rel")).otherwise(0.0)).withColumn("_pos", F.col("pos"))
    order = [F.asc("_flag"), F.asc("_line"), F.asc("_x"), F.asc("_pos")]
    return numbered(t, order, "pos").drop("_flag", "_line", "_x", "_pos")


def _lines(floor: float, share: float):
    """For every token of a page the number of the first line whose first token stands level with it, or of a new one; and the lines' sizes.

    Tokens come from the top; the lines that a later token can still reach are held.
    """
    @F.arrow_udf("struct<line:array<int>,size:array<int>>")
    def number(tops: pa.Array, mids: pa.Array, talls: pa.Array) -> pa.Array:
        out, sizes, counts, held = [], [], [], []
        for i in range(len(tops)):
            top, mid, tall = (c[i].values.to_numpy(zero_copy_only=False) for c in (tops, mids, talls))
            sizes.append(len(top))
            if not len(top):
                held.append(0)
                continue
            lines, count, numbers, tallest = [], 0, [], float(tall.max())
            # neighbours of one height and place share their line
            new = np.concatenate([[True], (np.diff(top) != 0) | (np.diff(mid) != 0) | (np.diff(tall) != 0)])
            starts = np.flatnonzero(new)
            for y, m, t in zip(top[starts].tolist(), mid[starts].tolist(), tall[starts].tolist()):
                lines = [x for x in lines if x[1] >= y - max(floor, (x[2] + tallest) / 2 * share)]
                found = next((no for no, lm, lt in lines if abs(lm - m) <= max(floor, (lt + t) / 2 * share)), None)
                if found is None:
                    found = count
                    lines.append((count, m, t))
                    count += 1
                numbers.append(found)
            out.append(np.repeat(np.array(numbers, np.int32), np.diff(np.append(starts, len(top)))))
            counts.append(np.bincount(out[-1], minlength=count).astype(np.int32))
            held.append(count)
        listed = lambda n, parts: pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))
        return pa.StructArray.from_arrays([listed(sizes, out), listed(held, counts)], ["line", "size"])

    return number


def _words(placed: Column, gap_share: float, lone_factor: float) -> Column:
    """Pieces in order of line and place, put together: a piece joins the word so far when it stands close behind it."""
    def word(t: Column) -> Column:
        p = t["piece"]
        return F.struct(t["line"].alias("line"), p["text"].alias("text"), p["box"].alias("box"), p["confidence"].alias("confidence"),
                        p["token_id"].alias("token_id"), F.array(p["token_id"]).alias("merged"))

    def joined(w: Column, n: Column) -> Column:
        a, b = w["box"], n["box"]
        side = lambda pick, c: F.when(~B.has_extent(a), b[c]).when(~B.has_extent(b), a[c]).otherwise(pick(a[c], b[c])).alias(c)
        la, lb = F.greatest(F.lit(1), F.length(w["text"])), F.greatest(F.lit(1), F.length(n["text"]))
        return F.struct(
            w["line"].alias("line"), F.concat(w["text"], n["text"]).alias("text"),
            F.struct(side(F.least, "x_min"), side(F.least, "y_min"), side(F.greatest, "x_max"), side(F.greatest, "y_max")).alias("box"),
            F.bround((w["confidence"] * la + n["confidence"] * lb) / (la + lb), 4).alias("confidence"), w["token_id"].alias("token_id"),
            F.concat(w["merged"], n["merged"]).alias("merged"))

    def step(acc: Column, t: Column) -> Column:
        w, n = acc["word"], word(t)
        tall = F.greatest(F.lit(1.0), (B.height(w["box"]) + B.height(n["box"])) / 2)
        gap = n["box"]["x_min"] - w["box"]["x_max"]
        lone = (F.length(F.trim(w["text"])) == 1) | (F.length(F.trim(n["text"])) == 1)
        near = T.let(tall, lambda h: gap.between(-0.5 * h, h * gap_share * F.when(lone, lone_factor).otherwise(1.0)))
        return F.when((w["line"] == n["line"]) & near, F.struct(acc["out"].alias("out"), joined(w, n).alias("word"))).otherwise(
            F.struct(F.array_append(acc["out"], w).alias("out"), n.alias("word")))

    first = F.get(placed, F.lit(0))
    start = F.struct(F.filter(F.array(word(first)), lambda x: F.lit(False)).alias("out"), word(first).alias("word"))
    return F.aggregate(F.slice(placed, 2, 1 << 30), start, step, lambda acc: F.array_append(acc["out"], acc["word"]))


def merge_fragments(tokens: DataFrame, floor: float = 10.0, line_share: float = 0.40, gap_share: float = 0.45, lone_factor: float = 1.8) -> DataFrame:
    """Words put together from the pieces a reader split them into; ``pos`` is renumbered.

    From the top, a token joins the first line whose first token's middle is within
    ``line_share`` of their mean height (at least ``floor``). In a line, from left to
    right, a piece joins the word so far when the gap is at most ``gap_share`` of the
    mean height, more when either is a single character: a fold over the line.
    Tokens without a box follow; pages without any box join runs of single letters.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b, page = F.col("box"), Window.partitionBy("doc_id")
    t = tokens.repartition(parts, "doc_id").withColumn("_has", B.has_extent(b)).withColumn("_geo", F.max("_has").over(page))
    piece = F.struct(F.col("token_id").cast("long").alias("token_id"), "text", "box", "confidence")
    row = F.struct(b["y_min"].alias("top"), b["x_min"].alias("x"), F.col("pos").cast("long").alias("pos"), B.centre_y(b).alias("mid"), B.height(b).alias("tall"),
                   "page_w", "page_h", piece.alias("piece"))
    # a page's tokens meet once, as one row: lines are slices of its array
    boxed = t.where("_has").groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    side = lambda c: F.transform("_rows", lambda r: r[c])
    boxed = boxed.withColumn("_no", _lines(floor, line_share)(side("top"), side("mid"), side("tall")))
    placed = F.transform(F.arrays_zip(F.col("_rows").alias("r"), F.col("_no.line").alias("no")), lambda z: F.struct(
        z["no"].alias("line"), z["r"]["x"].alias("x"), z["r"]["top"].alias("top"), z["r"]["pos"].alias("pos"), z["r"]["piece"].alias("piece")))
    ends = F.aggregate("_no.size", F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    lines = once(boxed, {"_placed": F.sort_array(placed), "_ends": ends, "page_w": F.col("_rows")[0]["page_w"], "page_h": F.col("_rows")[0]["page_h"]})
    each = F.transform("_no.size", lambda n, i: F.slice("_placed", F.get(F.col("_ends"), i) + 1, n))
    lines = once(lines, {"_words": F.flatten(F.transform(each, lambda x: _words(x, gap_share, lone_factor)))})
    words = lines.select("doc_id", "page_w", "page_h", F.lit(0).alias("_kind"), F.col("_words").alias("_all")).select(
        "doc_id", "page_w", "page_h", "_kind", F.posexplode("_all").alias("_at", "w"))
    words = words.select("doc_id", "page_w", "page_h", "_kind", F.col("_at").cast("long").alias("_at"),
                         *[F.col(f"w.{c}").alias(c) for c in ("token_id", "text", "box", "confidence", "merged")])

    plain = t.where(~F.col("_has")).withColumn("_solo", ~F.col("_geo") & (F.length(F.trim("text")) == 1) & F.trim("text").rlike(r"(?U)^[\p{L}\p{N}]$"))
    plain = numbered(plain, [F.asc("pos")], "_k", ("doc_id", "_solo"))
    # neighbouring letters share the distance from their place to their rank; other tokens stay alone
    order = F.row_number().over(page.orderBy("pos"))
    plain = plain.withColumn("_run", F.when(F.col("_solo"), order - F.col("_k")).otherwise(order))
    letter = F.struct("pos", F.col("token_id").cast("long").alias("token_id"), F.when(F.col("_solo"), F.trim("text")).otherwise(F.col("text")).alias("text"), "box")
    loose = plain.groupBy("doc_id", "_solo", "_run").agg(
        F.sort_array(F.collect_list(letter)).alias("r"), F.avg("confidence").alias("confidence"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    loose = loose.select(
        "doc_id", "page_w", "page_h", F.lit(1).alias("_kind"), F.col("r")[0]["pos"].cast("long").alias("_at"),
        F.col("r")[0]["token_id"].alias("token_id"), F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"), F.col("r")[0]["box"].alias("box"),
        "confidence", F.transform("r", lambda x: x["token_id"]).alias("merged"))
    out = numbered(words.unionByName(loose), [F.asc("_kind"), F.asc("_at")], "pos")
    return out.select("doc_id", "pos", "token_id", "text", "box", "confidence", "page_w", "page_h", "merged")


def anchor_regions(
    tokens: DataFrame, anchors: DataFrame, max_dx: float = 0.22, max_dy: float = 0.40,
) -> DataFrame:
    """Tokens of pages with boxes, each with ``anchor_no`` of its nearest anchor in reach.

    ``anchors`` holds doc_id, anchor_no, token_id, box. Tokens above or level with
    an anchor are nearer than those below. A page's tokens and anchors meet once, as arrays of one row.
    """
    w, h = page_size()
    own = anchors.groupBy("doc_id").agg(
        F.collect_set("token_id").alias("_ids"),
        F.collect_list(F.when(F.col("box").isNotNull(), F.struct(
            F.col("anchor_no").cast("long").alias("no"), B.centre_x(F.col("box")).alias("x"), B.centre_y(F.col("box")).alias("y")))).alias("_anchors"))
    pages = tokens.where(F.col("box").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct(
        *[c for c in tokens.columns if c != "doc_id"],
        w.alias("_w"), h.alias("_h"), B.centre_x(F.col("box")).alias("_cx"), B.centre_y(F.col("box")).alias("_cy"))).alias("_tokens"))
    side = lambda name, field: F.transform(name, lambda t: t[field])
    near = _nearest(max_dx, max_dy)(
        *[side("_tokens", c).cast(k) for c, k in (("pos", "array<bigint>"), ("token_id", "array<bigint>"), ("_cx", "array<double>"), ("_cy", "array<double>"),
                                                  ("_w", "array<double>"), ("_h", "array<double>"))],
        F.col("_ids").cast("array<bigint>"), side("_anchors", "no"), side("_anchors", "x"), side("_anchors", "y"))
    # pages are bounded: a task's anchors fit a hash table, and no token moves
    met = pages.join(own.hint("shuffle_hash"), "doc_id").withColumn("_near", near)
    met = met.select("doc_id", F.inline(F.arrays_zip(F.col("_tokens").alias("t"), F.col("_near").alias("n")))).where(F.size("n") > 0)
    exact = F.array_min(F.transform("n", lambda c: F.struct(F.round(F.hypot(c["x"], c["y"]), 9).alias("distance"), c["no"].alias("no"))))
    met = once(met, {"n": exact})
    return met.select("doc_id", *[F.col(f"t.{c}").alias(c) for c in tokens.columns if c != "doc_id"],
                      F.col("n.no").cast(anchors.schema["anchor_no"].dataType).alias("anchor_no"), F.col("n.distance").alias("distance"))


def _nearest(max_dx: float, max_dy: float):
    """A page's free tokens, each with the anchors in reach whose distance is the least, or so near it that rounding decides.

    Anchors are held in order of height, so a token meets those of its own band only.
    Rows that share a place on the page share their anchors; those of a taken token have none.
    """
    @F.arrow_udf("array<array<struct<x:double,y:double,no:bigint>>>")
    def find(pos: pa.Array, token: pa.Array, cx: pa.Array, cy: pa.Array, w: pa.Array, h: pa.Array, ids: pa.Array, no: pa.Array, ax: pa.Array, ay: pa.Array) -> pa.Array:
        flat = lambda c, i: c[i].values.to_numpy(zero_copy_only=False)
        rows, sizes, xs, ys, nos = [], [], [], [], []
        for i in range(len(pos)):
            n = len(pos[i].values)
            count = np.zeros(n, np.int64)
            order = np.argsort(flat(ay, i), kind="stable") if len(no[i].values) else np.empty(0, np.int64)
            if n and len(order):
                an, x, y = flat(no, i)[order], flat(ax, i)[order], flat(ay, i)[order]
                px, py, dx_most, dy_most, at = flat(cx, i), flat(cy, i), max_dx * flat(w, i), max_dy * flat(h, i), flat(pos, i)
                free = ~np.isin(flat(token, i), flat(ids, i))
                if token[i].values.null_count:
                    free |= token[i].values.is_null().to_numpy(zero_copy_only=False)
                low = np.searchsorted(y, py - dy_most - 1e-6)
                many = np.where(free, np.searchsorted(y, py + dy_most + 1e-6, side="right") - low, 0)
                found = []
                for part in np.split(np.arange(n), np.searchsorted(np.cumsum(many), np.arange(1_000_000, int(many.sum()), 1_000_000))):
                    t = np.repeat(part, many[part])
                    a = np.arange(len(t)) - np.repeat(np.cumsum(many[part]) - many[part], many[part]) + low[t]
                    dx, dy = np.abs(px[t] - x[a]), np.abs(py[t] - y[a])
                    ok = (dx <= dx_most[t]) & (dy <= dy_most[t])
                    t, a, dx, dy = t[ok], a[ok], dx[ok], dy[ok]
                    u, v = dx * 1.6, dy * np.where(py[t] <= y[a], 1.0, 2.0)
                    far = np.hypot(u, v)
                    least = np.full(n, np.inf)
                    np.minimum.at(least, t, far)
                    ok = far <= least[t] + 1e-8 + least[t] * 1e-12
                    found.append((t[ok], u[ok], v[ok], an[a[ok]]))
                t, u, v, k = (np.concatenate(c) for c in zip(*found))
                first, same = np.unique(at, return_inverse=True)
                if len(first) < n:
                    least = np.full(len(first), np.inf)
                    np.minimum.at(least, same[t], np.hypot(u, v))
                    ok = np.hypot(u, v) <= least[same[t]] + 1e-8
                    met = {}
                    for place, *c in zip(same[t[ok]].tolist(), u[ok].tolist(), v[ok].tolist(), k[ok].tolist()):
                        met.setdefault(place, []).append(c)
                    each = [met.get(place, []) if is_free else [] for place, is_free in zip(same.tolist(), free.tolist())]
                    count = np.array([len(c) for c in each])
                    u, v, k = (np.array([c[j] for some in each for c in some], kind) for j, kind in enumerate((float, float, np.int64)))
                else:
                    count = np.bincount(t, minlength=n)
                xs.append(u), ys.append(v), nos.append(k)
            rows.append(n), sizes.append(count)
        whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        cells = pa.StructArray.from_arrays([pa.array(whole(xs, np.float64)), pa.array(whole(ys, np.float64)), pa.array(whole(nos, np.int64))], ["x", "y", "no"])
        starts = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32))
        return pa.ListArray.from_arrays(starts(rows), pa.ListArray.from_arrays(starts(whole(sizes, np.int64)), cells))

    return find


def unassigned_tokens(tokens: DataFrame, anchors: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tokens with a box that are neither anchors nor near one, with the reason."""
    return (
        tokens.where(F.col("box").isNotNull())
        .join(anchors.select("doc_id", "token_id"), ["doc_id", "token_id"], "left_anti")
        .join(assigned.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")
        .withColumn("reason", F.lit("distancia_excessiva"))
    )


def sequential_regions(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """Tokens of pages without boxes, dealt in equal runs to the page's anchors; the last takes the rest."""
    bare = tokens.groupBy("doc_id").agg(F.bool_or(F.col("box").isNotNull()).alias("g")).where(~F.col("g")).select("doc_id")
    counts = anchors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    free = tokens.join(bare, "doc_id", "left_semi").join(anchors.select("doc_id", "token_id"), ["doc_id", "token_id"], "left_anti")
    free = numbered(free, [F.asc("pos")], "_k")
    sizes = free.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m")).join(counts, "doc_id")
    run = F.greatest(F.lit(1), F.floor(F.col("_m") / F.col("_n")))
    return (
        free.join(sizes, "doc_id")
        .withColumn("anchor_no", F.least(F.floor((F.col("_k") - 1) / run), F.col("_n") - 1) + 1)
        .drop("_k", "_m", "_n")
    )


def leftover_region(tokens: DataFrame, anchors: DataFrame, assigned: DataFrame, first: int | None = None) -> DataFrame:
    """The tokens of each page that no anchor took, the ``first`` ones if asked, as one region without anchor."""
    left = unassigned_tokens(tokens, anchors, assigned).drop("reason")
    left = left if first is None else top_by(left, ["doc_id"], [F.asc("pos")], first)
    return left.withColumn("region", F.lit("regiao_sem_ancora_1"))


def regions(assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """Regions with at least one token: envelope of anchor and tokens, density, and place in the page order."""
    own = anchors.select("doc_id", "anchor_no", F.col("box").alias("b"))
    extent = lambda b: B.envelope(F.when(B.has_extent(b), b))
    sizes = assigned.groupBy("doc_id", "anchor_no").agg(
        F.count(F.lit(1)).alias("token_count"), F.avg("confidence").alias("text_confidence"), F.first("page_h").alias("_ph"), extent(F.col("box")).alias("_e"))
    held = own.groupBy("doc_id", "anchor_no").agg(extent(F.col("b")).alias("_o"))
    r = sizes.join(held, ["doc_id", "anchor_no"]).join(own, ["doc_id", "anchor_no"])
    side = lambda pick, c: pick(F.col(f"_e.{c}"), F.col(f"_o.{c}")).alias(c)
    r = r.withColumn("region_box", F.struct(side(F.least, "x_min"), side(F.least, "y_min"), side(F.greatest, "x_max"), side(F.greatest, "y_max")))
    r = r.where(F.col("region_box.x_min").isNotNull())
    row = F.coalesce((B.centre_y(F.col("b")) / (0.15 * F.when(F.col("_ph") <= 0, 1.0).otherwise(F.col("_ph")))).cast("int"), F.lit(0))
    r = r.withColumn("_row", row).withColumn("_x", F.coalesce(B.centre_x(F.col("b")), F.lit(0.0)))
    r = numbered(r, [F.asc("_row"), F.asc("_x"), F.asc("anchor_no")], "region_no")
    return r.select(
        "doc_id", "region_no", "anchor_no", F.concat(F.lit("regiao_ancora_"), F.col("anchor_no").cast("string")).alias("region"),
        "region_box", "token_count", "text_confidence")
