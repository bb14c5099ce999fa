"""Neighbours in space, each found in cells of a size that fits: nearest points, words within reach,
patches where regions touch, shapes that neighbouring tiles both hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators.graph import components
from tessella.session import discard, materialize


def nearest_points(points: DataFrame, by: str, id_col: str, axes: list[str], k: int = 1, first_cell: float | None = None) -> DataFrame:
    """by, id, rank, other, distance: the k nearest other points of each point's group, exactly, ties to the
    smaller id; fewer where the group has fewer. axes are the coordinates' columns; points that miss one, or aren't finite, take no part.

    Points are dealt into cells, and each looks at its own and the adjoining ones: all that is within a cell's side is
    there, so a point that finds k so near is done. The others go on with cells of twice the side, until those are as wide as their
    group. A dense spot is settled by small cells, before it could be a large one. Each round
    is written, and joins the points that are left only. first_cell: the side to begin with, by default
    such that a cell would hold a point if the group's were spread evenly; so rounds follow the logarithm of a group's size.
    """
    n = len(axes)
    names = [f"c{i}" for i in range(n)]
    rows = points.select(by, F.col(id_col).alias("id"), *[F.col(a).cast("double").alias(c) for a, c in zip(axes, names)]).dropna()
    for c in names:
        rows = rows.filter(F.abs(c) < float("inf"))
    rows = materialize(rows, "points")
    widths = [F.max(c) - F.min(c) for c in names]
    boxes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.greatest(*widths, F.lit(0.0)).alias("widest"))
    even = F.lit(float(first_cell)) if first_cell else F.col("widest") / F.pow("size", F.lit(1 / n))
    boxes = boxes.select(by, F.least(F.lit(k), F.col("size") - 1).alias("wanted"), "widest", F.when(F.col("widest") > 0, even).otherwise(1.0).alias("side"))
    rows = rows.join(boxes, by).filter("wanted > 0")
    left, done, spent, times = rows, [], [], 1.0
    while not left.isEmpty():
        side = F.col("side") * times
        own = [F.floor(F.col(c) / side) for c in names]
        asking = left
        for i, cell in enumerate(own):
            asking = asking.withColumn(f"g{i}", F.explode(F.array(cell - 1, cell, cell + 1)))
        held = rows.select(by, F.col("id").alias("other"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(names)], *[cell.alias(f"g{i}") for i, cell in enumerate(own)])
        gap = F.sqrt(sum((F.pow(F.col(f"c{i}") - F.col(f"o{i}"), 2) for i in range(1, n)), F.pow(F.col("c0") - F.col("o0"), 2)))
        met = asking.join(held, [by, *[f"g{i}" for i in range(n)]]).filter("id <> other").withColumn("distance", gap)
        # cells as wide as the group adjoin each other, so nothing is further away than they reach
        met = met.filter((F.col("distance") <= side) | (side >= F.col("widest")))
        rank = F.row_number().over(Window.partitionBy(by, "id").orderBy("distance", "other"))
        best = met.withColumn("rank", rank).filter(F.col("rank") <= F.col("wanted"))
        found = materialize(best.select(by, "id", "wanted", "rank", "other", "distance"), "found")
        full = found.filter("rank = wanted").select(by, "id")
        done.append(found.join(full, [by, "id"], "left_semi"))
        left = materialize(left.join(full, [by, "id"], "left_anti"), "left")
        spent += [found, left]
        times *= 2
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = points.sparkSession.createDataFrame([], f"{by} {kinds[by]}, id {kinds['id']}, wanted bigint, rank int, other {kinds['id']}, distance double")
    for more in done:
        out = out.unionByName(more)
    out = materialize(out.select(by, F.col("id").alias(id_col), F.col("rank"), "other", "distance"), "nearest")
    discard(*spent)
    return out


#: Pairs of words that are measured at once.
_AT_ONCE = 1_000_000


def words_in_reach(words: DataFrame, by: str, reach: float = 1.2) -> DataFrame:
    """by, a, b, gap: pairs of a sheet's words whose boxes are nearer than reach times the taller one's height, across and
    down; a < b, gap is the sum of both. words: by, word_id, x, y, w, h.

    A word's box, grown by its own reach, meets that of every word it is paired with. Words are posted in the tiles that their
    grown boxes touch. Tiles are so wide that this makes 1.2 posts per word on average, as three sums over all words tell, so words
    are shuffled about once. A task reads a tile's words downwards, and keeps of those it has read what later ones may touch, not the tile. A pair is
    measured in the first tile that both are in. Words without height reach nothing, those without a finite place aren't anywhere.
    """
    x, y, w, h = (F.col(c) for c in "xywh")
    rows = words.select(by, F.col("word_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xywh"]).filter("h > 0")
    for c in "xywh":
        rows = rows.filter(F.abs(c) < float("inf"))
    more = h * reach * (1 + 1e-6) + (F.abs(x) + F.abs(y) + F.abs(w) + h) * 1e-9  # a little more than it reaches, as sums are rounded
    ends = [(F.least(at, at + size) - more, F.greatest(at, at + size) + more) for at, size in ((x, w), (y, h))]
    wide, high = (hi - lo for lo, hi in ends)
    sums = rows.agg(F.avg(wide + high), F.avg(wide * high)).first()
    # posts are (1 + wide / side) * (1 + high / side) on average: at most 1 + 1 / 8 + 1 / 16
    side = max(8 * (sums[0] or 0.0), 4 * (sums[1] or 0.0) ** 0.5) or 1.0
    tiles = [F.sequence(F.floor(lo / side), F.floor(hi / side)) for lo, hi in ends]
    posted = rows.dropna().select("*", ends[1][0].alias("lo"), ends[1][1].alias("hi"), tiles[1].alias("_ys"), F.posexplode(tiles[0]).alias("_i", "gx"))
    posted = posted.select(by, "gx", "id", *"xywh", "lo", "hi", "_i", F.posexplode("_ys").alias("_j", "gy"))
    tile = [by, "gx", "gy"]
    read = posted.select(*tile, "lo", "hi", "id", *"xywh", (F.col("_i") == 0).alias("left"), (F.col("_j") == 0).alias("top")).repartition(*tile).sortWithinPartitions(*tile, "lo")

    def measured(frames):
        held = None
        for frame in frames:
            if not len(frame):
                continue
            n, held = (0, frame) if held is None else (len(held), pd.concat([held, frame], ignore_index=True))
            columns = {c: held[c].to_numpy() for c in held.columns}
            starts = np.zeros(len(held), bool)
            for c in tile:
                starts[1:] |= columns[c][1:] != columns[c][:-1]
            nth = np.cumsum(starts)
            # complex numbers are ordered by tile, then by height
            last = np.searchsorted(nth + 1j * columns["lo"], nth + 1j * columns["hi"], side="right")
            first = np.maximum(np.arange(len(held)) + 1, n)
            count = np.maximum(last - first, 0)
            upto = np.cumsum(count)
            for k in range(0, int(upto[-1]), _AT_ONCE):
                at = np.arange(k, min(k + _AT_ONCE, int(upto[-1])))
                i = np.searchsorted(upto, at, side="right")
                j = first[i] + at - (upto[i] - count[i])
                one, other = ({c: v[rows_] for c, v in columns.items()} for rows_ in (i, j))
                taller = np.maximum(one["h"], other["h"]) * reach
                dx, dy = (np.maximum(0.0, np.maximum(one[c], other[c]) - np.minimum(one[c] + one[size], other[c] + other[size])) for c, size in ("xw", "yh"))
                near = (dx < taller) & (dy < taller) & (one["left"] | other["left"]) & (one["top"] | other["top"]) & (one["id"] != other["id"])
                less = one["id"] < other["id"]
                yield pd.DataFrame({by: one[by], "a": np.where(less, one["id"], other["id"]), "b": np.where(less, other["id"], one["id"]), "gap": dx + dy})[near]
            held = held[(nth == nth[-1]) & (columns["hi"] >= columns["lo"][-1])]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return read.mapInPandas(measured, f"{by} {kinds[by]}, a {kinds['id']}, b {kinds['id']}, gap double")


#: In this order, the neighbours that a pixel is compared with.
_OFFSETS = ((1, 0), (0, 1), (1, 1), (-1, 1))


def contact_patches(pixels: DataFrame, by: str) -> DataFrame:
    """by, a, b, patch, n, cx, cy, x0, y0, x1, y1: the connected patches of pixels where two regions (a < b) touch, with
    their middle and box. pixels: by, x, y, label; labels of 0 or less are no region.

    A pixel belongs to the contact with the first neighbour of another region, of the right, lower, lower
    right and lower left ones. Pixels of one contact in a row of the image become runs; runs of adjoining rows that touch, corners included,
    are linked; and patches are the components of those links. Only runs are
    joined, each with the few beside it, so no image is held in one task. patch is the patch's first pixel, as y and x.
    """
    region = pixels.filter("label > 0").select(by, "x", "y", "label")
    met = region.withColumn("key", F.lit(None).cast("struct<a:bigint,b:bigint>"))
    for dx, dy in _OFFSETS:
        other = region.select(by, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("label").alias("other"))
        pair = F.struct(F.least("label", "other").cast("long").alias("a"), F.greatest("label", "other").cast("long").alias("b"))
        met = met.join(other, [by, "x", "y"], "left").withColumn("key", F.coalesce("key", F.when(F.col("label") != F.col("other"), pair))).drop("other")
    contact = met.filter("key is not null").select(by, "key.a", "key.b", "x", "y").distinct()
    row = [by, "a", "b", "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*row).orderBy("x"))
    runs = materialize(contact.withColumn("_i", island).groupBy(*row, "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i"), "runs")
    name = F.struct(*row, "x0")
    below = runs.select(by, "a", "b", (F.col("y") - 1).alias("y"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), name.alias("to"))
    links = runs.join(below, row).filter("x0 <= lx1 + 1 and lx0 <= x1 + 1").select(name.alias("from"), "to")
    # runs are numbered for the components: the order of their places
    labels = _numbered(runs, links, name)
    patched = labels.groupBy(by, "a", "b", "component")
    size = F.col("x1") - F.col("x0") + 1
    out = patched.agg(F.min(F.struct("y", "x0")).alias("first"), F.sum(size).alias("n"), F.sum(size * (F.col("x0") + F.col("x1")) / 2).alias("sx"), F.sum(size * F.col("y")).alias("sy"), F.min("x0").alias("px0"), F.min("y").alias("py0"), F.max("x1").alias("px1"), F.max("y").alias("py1"))
    return out.select(by, "a", "b", F.struct(F.col("first.y").alias("y"), F.col("first.x0").alias("x")).alias("patch"), "n", (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"), F.col("px0").alias("x0"), F.col("py0").alias("y0"), F.col("px1").alias("x1"), F.col("py1").alias("y1"))


def _numbered(runs: DataFrame, links: DataFrame, name: Column) -> DataFrame:
    """runs with their component: ids are 64-bit hashes of their places, which are written once."""
    key = lambda c: F.xxhash64(F.to_json(c))
    edges = materialize(links.select(key(F.col("from")).alias("u"), key(F.col("to")).alias("v")), "links")
    own = runs.withColumn("_id", key(name))
    if edges.isEmpty():
        return own.withColumnRenamed("_id", "component")
    found = components(edges, "u", "v").select(F.col("node").alias("_id"), "component")
    return own.join(found, "_id", "left").withColumn("component", F.coalesce("component", "_id"))


def greedy_kept(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """id of the nodes that stay if they are taken in order of rank (rising) and one goes when it conflicts with one that
    stays. nodes: id. conflicts: first, later, where first has the lower rank.

    The same as one after the other, in rounds: nodes without an open or kept one before them stay, what conflicts with those goes,
    and the rest is open. A round takes whole layers of the conflicts, so there are as many as the longest chain of them. Each is written; only
    open conflicts are joined again.
    """
    open_ = materialize(conflicts.select("first", "later").distinct(), "open")
    gone = nodes.select("id").limit(0)
    while not open_.isEmpty():
        # firsts that nothing open stands before stay, and what they conflict with goes
        settled = open_.select(F.col("first").alias("id")).distinct().join(open_.select(F.col("later").alias("id")), "id", "left_anti")
        dropped = materialize(open_.join(settled.withColumnRenamed("id", "first"), "first", "left_semi").select(F.col("later").alias("id")).distinct(), "dropped")
        rest = open_.join(dropped.withColumnRenamed("id", "later"), "later", "left_anti").join(dropped.withColumnRenamed("id", "first"), "first", "left_anti")
        gone, open_, before = gone.unionByName(dropped), materialize(rest, "open"), open_
        discard(before)
    return nodes.select("id").join(gone, "id", "left_anti")


def merged_tiles(found: DataFrame, tiles: DataFrame, by: str, share: float = 0.5, cell: float = 64.0) -> DataFrame:
    """by, piece_id, tile, area, polygon of the shapes that overlapping tiles of a picture give together: moved back by their tile's
    corner, and of shapes that have more than share of the smaller one in common the larger stays, of equal ones that of the smaller id.

    found: by, tile, piece_id, polygon in the tile's pixels; piece_id is unique over all. tiles: by, tile, x, y. Shapes meet
    in the cells that both their boxes touch, so those of one tile or of neighbours meet and others don't, and no picture is in one task.
    """
    placed = found.join(tiles.select(by, "tile", F.col("x").alias("_x"), F.col("y").alias("_y")), [by, "tile"])
    moved = placed.withColumn("polygon", F.transform("polygon", lambda v: g.point(v["x"] + F.col("_x"), v["y"] + F.col("_y")))).withColumn("area", g.area(F.col("polygon"))).filter("area > 0")
    shapes = materialize(moved.select(by, "piece_id", "tile", "area", "polygon"), "shapes")
    box = shapes.withColumn("_b", g.bounds(F.col("polygon")))
    span = lambda a, b: F.sequence(F.floor(F.col(f"_b.{a}") / cell), F.floor(F.col(f"_b.{b}") / cell))
    cells = box.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    a, b = (cells.select(by, "gx", "gy", *[F.col(c).alias(f"{s}_{c}") for c in ("piece_id", "area", "_b", "polygon")]) for s in "pq")
    before = F.struct(-F.col("p_area"), "p_piece_id") < F.struct(-F.col("q_area"), "q_piece_id")
    touch = (F.col("p__b.x0") < F.col("q__b.x1")) & (F.col("q__b.x0") < F.col("p__b.x1")) & (F.col("p__b.y0") < F.col("q__b.y1")) & (F.col("q__b.y0") < F.col("p__b.y1"))
    # in the first of the cells that both touch
    first = (F.col("gx") == F.floor(F.greatest("p__b.x0", "q__b.x0") / cell)) & (F.col("gy") == F.floor(F.greatest("p__b.y0", "q__b.y0") / cell))
    met = a.join(b, [by, "gx", "gy"]).filter(before & touch & first)

    def common(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([g.intersection_area(np.array([[v["x"], v["y"]] for v in s]), np.array([[v["x"], v["y"]] for v in t])) for s, t in zip(p, q)], dtype=float)

    shared = F.pandas_udf(common, "double")("p_polygon", "q_polygon")
    conflicts = met.select(F.col("p_piece_id").alias("first"), F.col("q_piece_id").alias("later"), shared.alias("common"), (F.col("q_area") * share).alias("most")).filter("common > most")
    kept = greedy_kept(shapes.select(F.col("piece_id").alias("id")), conflicts)
    return shapes.join(kept.withColumnRenamed("id", "piece_id"), "piece_id", "left_semi").select(by, "piece_id", "tile", "area", "polygon")
