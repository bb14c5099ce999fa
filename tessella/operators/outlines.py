"""Unions of polygons by a sweep line, footprints' overlap, and outlines that lie on walls.

A group's edges (a listing's, a floor's) are cut at the heights of all corners and crossings. Between
two cuts no edges cross, so the winding number is a running sum from left to right, and the union
is where it isn't zero. Every step is a join on a height or a window over one strip between two cuts; no group, however large, is
swept in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import sweeps
from tessella.operators.quantiles import few
from tessella.session import materialize

#: Coordinates are rounded to so many decimals, so that walls that should meet do.
DECIMALS = 6
ROUNDED = 2 * 10.0**-DECIMALS
CROSS_CELL = 4.0


def _edges(polygons: DataFrame, by: list[str], polygon: str, decimals: int) -> DataFrame:
    """by, e, x0, y0, x1, y1, turn: edges that aren't level, lower end first; turn is 1 for those that have the
    polygon to their right, else -1. Polygons run counter-clockwise."""
    ring = F.transform(g.counter_clockwise(F.col(polygon)), lambda v: g.point(F.round(v["x"], decimals), F.round(v["y"], decimals)))
    rows = polygons.select(*by, ring.alias("r")).filter(F.size("r") >= 3)
    pair = F.transform("r", lambda v, i: F.struct(v.alias("p"), F.get("r", (i + 1) % F.size("r")).alias("q")))
    down = F.col("e.p.y") > F.col("e.q.y")
    end = lambda upper, c: F.when(down == F.lit(upper), F.col(f"e.p.{c}")).otherwise(F.col(f"e.q.{c}"))
    each = rows.select(*by, F.explode(pair).alias("e")).filter("e.p.y <> e.q.y")
    ends = each.select(*by, end(False, "x").alias("x0"), end(False, "y").alias("y0"), end(True, "x").alias("x1"), end(True, "y").alias("y1"), F.when(down, 1).otherwise(-1).alias("turn"))
    # coincident edges of several polygons are one, with the sum of their turns
    return materialize(ends.groupBy(*by, "x0", "y0", "x1", "y1").agg(F.sum("turn").alias("turn")), "edges")


def _x_at(y: Column) -> Column:
    """x of an edge at a height; exact at its ends."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return F.when(y == y0, x0).when(y == y1, x1).when(x0 == x1, x0).otherwise(x0 + (x1 - x0) * ((y - y0) / (y1 - y0)))


def _crossings(edges: DataFrame, by: list[str], decimals: int) -> DataFrame:
    """by, y: heights at which two edges of a group cross. Edges meet in the cells that their boxes touch."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / CROSS_CELL), F.floor(F.greatest(a, b) / CROSS_CELL))
    cells = edges.select(*by, "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("gx"), span("y0", "y1").alias("gys")).select("*", F.explode("gys").alias("gy")).drop("gys")
    a, b = (cells.select(*by, "gx", "gy", *[F.col(c).alias(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")]) for s in "ab")
    dx, dy, ex, ey = F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0"), F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    den = dx * ey - dy * ex
    rx, ry = F.col("bx0") - F.col("ax0"), F.col("by0") - F.col("ay0")
    t, u = (rx * ey - ry * ex) / den, (rx * dy - ry * dx) / den
    met = a.join(b, [*by, "gx", "gy"]).filter((den != 0) & (F.struct("ax0", "ay0", "ax1", "ay1") < F.struct("bx0", "by0", "bx1", "by1")))
    return met.select(*by, F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), F.round(F.col("ay0") + t * dy, decimals)).alias("y")).filter("y is not null")


def _strips(polygons: DataFrame, by: list[str], polygon: str, decimals: int = DECIMALS) -> DataFrame:
    """by, k, lo, hi, x_lo, x_hi, left: pieces of edges that bound the union between the k-th cut and the next; left is
    true where the union begins, going right."""
    edges = _edges(polygons, by, polygon, decimals)
    heights = edges.select(*by, F.explode(F.array("y0", "y1")).alias("y")).unionByName(_crossings(edges, by, decimals)).distinct()
    cut = Window.partitionBy(*by).orderBy("y")
    cuts = heights.select(*by, "y", F.row_number().over(cut).alias("k"), F.lead("y").over(cut).alias("hi"))
    cuts = materialize(cuts, "cuts")
    at = lambda name, k: cuts.select(*by, F.col("y").alias(name), F.col("k").alias(k))
    placed = edges.join(at("y0", "k0"), [*by, "y0"]).join(at("y1", "k1"), [*by, "y1"])
    pieces = placed.withColumn("k", F.explode(F.expr("sequence(k0, k1 - 1)"))).join(cuts.withColumnRenamed("y", "lo"), [*by, "k"])
    placed = pieces.withColumn("x_lo", F.round(_x_at(F.col("lo")), decimals)).withColumn("x_hi", F.round(_x_at(F.col("hi")), decimals))
    # what stands at the same place is one step, so rooms that touch have no boundary between them
    steps = placed.groupBy(*by, "k", "lo", "hi", "x_lo", "x_hi").agg(F.sum("turn").alias("turn"))
    across = Window.partitionBy(*by, "k").orderBy(F.col("x_lo") + F.col("x_hi"), F.col("x_lo"))
    after = F.sum("turn").over(across)
    wound = steps.withColumn("after", after).withColumn("before", F.col("after") - F.col("turn"))
    return wound.filter((F.col("after") != 0) != (F.col("before") != 0)).select(*by, "k", "lo", "hi", "x_lo", "x_hi", (F.col("before") == 0).alias("left"))


def union_area(polygons: DataFrame, by: list[str], polygon: str = "polygon", decimals: int = DECIMALS) -> DataFrame:
    """by, area of the union of each group's polygons. Polygons are simple rings of points, either
    way round; those of fewer than three points are left out, and a group without area has no row."""
    middle = (F.col("x_lo") + F.col("x_hi")) / 2 * (F.col("hi") - F.col("lo"))
    return _strips(polygons, by, polygon, decimals).groupBy(*by).agg(F.sum(F.when(F.col("left"), -middle).otherwise(middle)).alias("area"))


def outline_edges(polygons: DataFrame, by: list[str], polygon: str = "polygon") -> DataFrame:
    """by, x0, y0, x1, y1: the boundary of each group's union, directed so that it lies to the left."""
    strips = materialize(_strips(polygons, by, polygon), "strips")
    low, high = F.struct(F.col("x_lo").alias("x"), F.col("lo").alias("y")), F.struct(F.col("x_hi").alias("x"), F.col("hi").alias("y"))
    sides = strips.select(*by, F.when(F.col("left"), high).otherwise(low).alias("p"), F.when(F.col("left"), low).otherwise(high).alias("q"))
    # along a cut, the boundary leads from side to side: what begins above it less what ends below it flows to the right
    flow = lambda k, x, y, up: strips.select(*by, F.col("k") + k, F.col(x), F.col(y), F.when(F.col("left"), up).otherwise(-up)).toDF(*by, "k", "x", "y", "flow")
    each = flow(0, "x_lo", "lo", 1).unionByName(flow(1, "x_hi", "hi", -1)).groupBy(*by, "k", "x", "y").agg(F.sum("flow").alias("flow"))
    along = Window.partitionBy(*by, "k").orderBy("x")
    level = each.select(*by, "x", "y", F.lead("x").over(along).alias("next"), F.sum("flow").over(along).alias("net")).filter("next is not null and net <> 0")
    here, there = F.struct("x", "y"), F.struct(F.col("next").alias("x"), "y")
    times = F.explode(F.array_repeat(F.lit(1), F.abs("net").cast("int")))
    flat = level.select(*by, F.when(F.col("net") > 0, here).otherwise(there).alias("p"), F.when(F.col("net") > 0, there).otherwise(here).alias("q"), times.alias("_t")).drop("_t")
    return sides.unionByName(flat).select(*by, F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))


def _bent(ring: list[tuple]) -> list[tuple]:
    """The ring without corners that are on the line from the corner before to the one after, as far as
    rounding can tell; one after the other, from its first corner, which is the end of a cut."""
    out: list[tuple] = []
    for n, corner in enumerate(ring):
        out.append(corner)
        after = ring[(n + 1) % len(ring)]
        while len(out) > 1 and _off(out[-2], out[-1], after) <= ROUNDED:
            out.pop()
    while len(out) > 3 and _off(out[-1], out[0], out[1]) <= ROUNDED:
        out.pop(0)
    return out


def _off(a: tuple, b: tuple, c: tuple) -> float:
    """How far b is from the segment between a and c."""
    dx, dy = c[0] - a[0], c[1] - a[1]
    size = dx * dx + dy * dy
    t = 0.0 if size == 0 else min(1.0, max(0.0, ((b[0] - a[0]) * dx + (b[1] - a[1]) * dy) / size))
    return math.hypot(b[0] - a[0] - t * dx, b[1] - a[1] - t * dy)


def _ring_area(ring: list[tuple]) -> tuple[float, float]:
    """Signed area and length of a ring."""
    area = length = 0.0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        area += x0 * y1 - x1 * y0
        length += math.hypot(x1 - x0, y1 - y0)
    return area / 2, length


def _trace(edges: Iterable[tuple]) -> list[tuple[float, list[tuple]]]:
    """Signed area and corners of the rings of directed edges (x0, y0, x1, y1), on plain floats, as most groups are small. Where several
    leave a corner, the sharpest turn to the left is taken, so pieces that touch in a corner stay apart. Corners that don't turn are dropped."""
    leaving: dict[tuple, list[tuple]] = {}
    for x0, y0, x1, y1 in sorted(edges, reverse=True):
        leaving.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(leaving):
        while leaving.get(start):
            ring, here, came = [start], leaving[start].pop(), start
            while here != start:
                ring.append(here)
                out = leaving[here]
                k = 0
                if len(out) > 1:
                    back = math.atan2(came[1] - here[1], came[0] - here[0])
                    turn = [(back - math.atan2(y - here[1], x - here[0])) % (2 * math.pi) or 2 * math.pi for x, y in out]
                    k = turn.index(min(turn))
                came, here = here, out.pop(k)
            kept = _bent(ring)
            area, length = _ring_area(kept)
            if len(kept) >= 3 and abs(area) > ROUNDED * length:  # not thinner than that
                rings.append((area, kept))
    return rings


#: Groups of at most so many corners in all are a row each, swept in batches.
FEW_IN_ALL = 200


def lists(rows: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and elements of lists."""
    return pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(int), rows.flatten()


def fields(rows: pa.Array, *names: str) -> list[np.ndarray]:
    """Fields of structs as doubles; NaN for null."""
    return [pc.cast(pc.struct_field(rows, name), pa.float64()).to_numpy(zero_copy_only=False) for name in names]


def listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _rings(of: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    return sweeps.rings(*sweeps.boundary(of, sizes, x, y, DECIMALS), _bent, _trace, ROUNDED)


#: Rows that are swept together, so that their arrays stay near the processor.
ROWS_AT_ONCE = 1_000


def _outlines(rooms: pa.Array) -> pa.Array:
    """area, with a sign, and points of the rings of each row's outline."""
    return pa.concat_arrays([_some_outlines(rooms.slice(k, ROWS_AT_ONCE)) for k in range(0, max(1, len(rooms)), ROWS_AT_ONCE)])


def _some_outlines(rooms: pa.Array) -> pa.Array:
    n, each = lists(rooms)
    sizes, points = lists(each)
    of, area, corners, x, y = _rings(np.repeat(np.arange(len(n)), n), sizes, *fields(points, "x", "y"))
    corner = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    return listed(np.bincount(of, minlength=len(n)), pa.StructArray.from_arrays([pa.array(area), listed(corners, corner)], ["area", "points"]))


def large_groups(by: list[str], most: int, *tables: tuple[DataFrame, Column]) -> DataFrame:
    """by of the groups that have more in all tables than most, each row counted for what its column says."""
    each = [df.select(*by, F.greatest(n, F.lit(1)).cast("long").alias("_n")) for df, n in tables]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return few(rows.groupBy(*by).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > most).select(*by))


def union_outlines(polygons: DataFrame, by: list[str], polygon: str = "polygon", corners: Column | None = None) -> DataFrame:
    """by, ring, hole, area, points: rings of the outline of each group's union, largest first. Outer
    rings run counter-clockwise, holes clockwise; area is without a sign. Small groups are a row each, shuffled once by the group, if they aren't
    together already, and swept in batches; of larger ones, counted first, only the boundary is traced in one task. corners: at most how
    many a polygon has, where that is known without making it."""
    polygons = polygons.select(*by, polygon).dropna(subset=by)
    large = large_groups(by, FEW_IN_ALL, (polygons, F.size(polygon) if corners is None else corners))
    if large.isEmpty():
        return _outlines_in_rows(polygons, by, polygon)
    return _outlines_in_rows(polygons.join(large, by, "left_anti"), by, polygon).unionByName(_outlines_swept(polygons.join(large, by, "left_semi"), by, polygon))


def _outlines_in_rows(polygons: DataFrame, by: list[str], polygon: str) -> DataFrame:
    outlines = F.arrow_udf(_outlines, "array<struct<area double, points array<struct<x double, y double>>>>")
    rows = polygons.groupBy(*by).agg(F.collect_list(polygon).alias("_p")).select(*by, outlines("_p").alias("_r"))
    ring = rows.select(*by, F.posexplode("_r").alias("ring", "r"))
    return ring.select(*by, "ring", (F.col("r.area") < 0).alias("hole"), F.abs("r.area").alias("area"), "r.points")


def _outlines_swept(polygons: DataFrame, by: list[str], polygon: str) -> DataFrame:
    """union_outlines of groups of any size. Their boundaries go to Python in batches, a row each."""
    ends = ("x0", "y0", "x1", "y1")

    def trace(*columns: pd.Series) -> pd.DataFrame:
        found = []
        for each in zip(*columns):
            rings = _trace(zip(*[c.tolist() for c in each]))
            found.append(sorted(rings, key=lambda r: (-abs(r[0]), min(x for x, _ in r[1]), min(y for _, y in r[1]))))
        return pd.DataFrame({"area": [[a for a, _ in rings] for rings in found], "x": [[[x for x, _ in p] for _, p in rings] for rings in found], "y": [[[y for _, y in p] for _, p in rings] for rings in found]})

    bounds = outline_edges(polygons, by, polygon).groupBy(*by).agg(F.collect_list(F.struct(*ends)).alias("e")).select(*by, *[F.col("e")[c].alias(c) for c in ends])
    traced = bounds.select(*by, F.pandas_udf(trace, "area array<double>, x array<array<double>>, y array<array<double>>")(*ends).alias("t"))
    ring = traced.select(*by, F.posexplode(F.arrays_zip("t.area", "t.x", "t.y")).alias("ring", "r"))
    points = F.zip_with("r.x", "r.y", g.point)
    return ring.select(*by, "ring", (F.col("r.area") < 0).alias("hole"), F.abs("r.area").alias("area"), points.alias("points"))


#: Pairs of rings with at most so many corners in all meet in batches; larger ones are swept.
FEW_CORNERS = 40


def _batch_iou(px: pd.Series, py: pd.Series, qx: pd.Series, qy: pd.Series) -> pd.Series:
    p, q = ([[*zip(x.tolist(), y.tolist())] for x, y in zip(xs, ys)] for xs, ys in ((px, py), (qx, qy)))
    found = g.pairwise(p, q, lambda u, w: (g.batch_iou(u, w),))
    return pd.Series(found[0] if found else [], dtype=float)


def _pair_iou(pairs: DataFrame, by: list[str], one: str, other: str) -> DataFrame:
    """by, iou of two polygons in each row, by must tell rows apart. Small ones are measured in batches; of large ones, their areas and that of
    their union say how they overlap. Rings of fewer than three corners overlap nothing."""
    pairs = materialize(pairs, "pairs")  # read several times
    corners = F.size(one) + F.size(other)
    whole_rings = (F.size(one) >= 3) & (F.size(other) >= 3)
    small = pairs.filter(whole_rings & (corners <= FEW_CORNERS)).select(*by, F.pandas_udf(_batch_iou, "double")(*[F.col(ring)[c] for ring in (one, other) for c in "xy"]).alias("iou"))
    rest = pairs.filter(~F.coalesce(whole_rings & (corners <= FEW_CORNERS), F.lit(False)))
    if rest.isEmpty():
        return small
    both = rest.select(*by, F.explode(F.array(one, other)).alias("polygon"))
    union = union_area(both, by, decimals=12).withColumnRenamed("area", "whole")
    areas = rest.select(*by, (g.area(F.col(one)) + g.area(F.col(other))).alias("parts"))
    swept = areas.join(union, by, "left").select(*by, F.when(F.col("whole") > 1e-12, (F.col("parts") - F.col("whole")) / F.col("whole")).otherwise(0.0).alias("iou"))
    return small.unionByName(swept)


def _few_ious(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """IoU of rings one of p with rings other of q, which are (corners, x, y), ring by ring; 0 for those of fewer than three corners."""
    (m, px, py), (n, qx, qy) = p, q
    out, first, last = np.zeros(len(one)), sweeps.firsts(m), sweeps.firsts(n)
    kinds, kind = np.unique(np.stack([m[one], n[other]], axis=1).reshape(-1, 2), axis=0, return_inverse=True)
    for k, (a, b) in enumerate(kinds.tolist()):
        rows = np.flatnonzero(kind.ravel() == k) if a >= 3 and b >= 3 else np.zeros(0, int)
        most = max(1, 16_000_000 // (a + b) ** 3)
        for i in range(0, len(rows), most):
            at = rows[i : i + most]
            u, v = first[one[at]][:, None] + np.arange(a), last[other[at]][:, None] + np.arange(b)
            out[at] = g.batch_iou(np.stack([px[u], py[u]], axis=2), np.stack([qx[v], qy[v]], axis=2))
    return out


def _footprints(rows: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """rows that have one, rising, and corners, x, y, centre x and y of the largest outer ring of each one's rooms."""
    of, area, corners, rx, ry = _rings(rows, sizes, x, y)
    outer = np.flatnonzero(area > 0)
    of, one = np.unique(of[outer], return_index=True)
    at, n = sweeps.firsts(corners)[outer[one]], corners[outer[one]]
    row, k = sweeps.counted(n)
    x, y, after = rx[at[row] + k], ry[at[row] + k], sweeps.following(n)
    cross = x * y[after] - x[after] * y
    total = lambda v: np.bincount(row, v, len(n))
    half = total(cross) / 2.0
    thin = np.abs(half) < 1e-9
    whole = np.where(thin, 1.0, half * 6.0)
    centre = [np.where(thin, total(v) / np.maximum(n, 1), total((v + v[after]) * cross) / whole) for v in (x, y)]
    return of, n, x, y, *centre


def _some_layouts(built: pa.Array, plan: pa.Array, matches: pa.Array) -> pa.Array:
    """iou of the footprints, and of the rooms that are matched, of each row."""
    size = len(built)
    sides = []
    for rows in (built, plan):
        n, rooms = lists(rows)
        sizes, points = lists(pc.struct_field(rooms, "p"))
        sides.append((np.repeat(np.arange(size), n), pc.struct_field(rooms, "id"), sizes, *fields(points, "x", "y")))
    (b_row, b_id, *b), (r_row, r_id, *r) = sides
    b_of, b_n, bx, by, bcx, bcy = _footprints(b_row, *b)
    r_of, r_n, rx, ry, rcx, rcy = _footprints(r_row, *r)
    both, i, j = np.intersect1d(b_of, r_of, assume_unique=True, return_indices=True)
    dx, dy = np.zeros((2, len(b_of), 2))
    dx[i], dy[i] = np.stack([rcx[j], bcx[i]], axis=1), np.stack([rcy[j], bcy[i]], axis=1)
    spread = np.repeat(np.arange(len(b_of)), b_n)
    moved = (b_n, bx + dx[spread, 0] - dx[spread, 1], by + dy[spread, 0] - dy[spread, 1])
    iou = np.full(size, np.nan)
    iou[both] = _few_ious(moved, (r_n, rx, ry), i, j)
    # rooms on the plan rooms they are matched with
    m_n, pairs = lists(matches)
    row = np.repeat(np.arange(size), m_n)
    m, one = _joined(row, pc.struct_field(pairs, "a"), b_row, b_id)
    k, other = _joined(row[m], pc.struct_field(pairs, "b").take(pa.array(m)), r_row, r_id)
    each = _few_ious(tuple(b), tuple(r), one[k], other)
    return pa.StructArray.from_arrays([pa.array(iou, mask=np.isnan(iou)), listed(np.bincount(row[m][k], minlength=size), pa.array(each))], ["iou", "rooms"])


def _joined(row: np.ndarray, ids: pa.Array, rows: np.ndarray, of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of elements of one side and the other that have the same row and id, in order of the first."""
    codes = pa.concat_arrays([ids, of]).dictionary_encode()
    code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(int)
    most = len(codes.dictionary) + 1
    key, keys = row * most + code[: len(ids)], rows * most + code[len(ids) :]
    order = np.argsort(keys, kind="stable")
    first, end = (np.searchsorted(keys[order], key, side) for side in ("left", "right"))
    one, k = sweeps.counted(np.where(code[: len(ids)] < 0, 0, end - first))
    return one, order[first[one] + k]


def _layouts(*columns: pa.Array) -> pa.Array:
    return pa.concat_arrays([_some_layouts(*[c.slice(k, ROWS_AT_ONCE) for c in columns]) for k in range(0, max(1, len(columns[0])), ROWS_AT_ONCE)])


def layout_iou(built: DataFrame, plan: DataFrame, matches: DataFrame, by: str, corners: Column | None = None) -> DataFrame:
    """by, iou, rooms, median_room_iou: how the footprint of the built rooms (by, room_id, polygon) covers that of the
    plan's (by, plan_room_id, polygon), laid centroid on centroid, as a plan's origin means nothing; and the
    rooms on the plan rooms they are matched with (by, room_id, plan_room_id), where they are. A footprint is the
    largest outer ring of the union. Groups without either have no iou. Small groups are a row each, all of it measured there in batches;
    larger ones, counted first, are swept. corners: at most how many a room has, where that is known without making it."""
    size = F.size("polygon") if corners is None else corners
    large = large_groups([by], FEW_IN_ALL, (built, size), (plan, size), (matches, F.lit(1)))
    if large.isEmpty():
        return _layout_in_rows(built, plan, matches, by)
    parts = [[df.join(large, by, how) for df in (built, plan, matches)] for how in ("left_anti", "left_semi")]
    return _layout_in_rows(*parts[0], by).unionByName(_layout_swept(*parts[1], by))


def _layout_in_rows(built: DataFrame, plan: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    gather = lambda df, name, *fields: df.groupBy(by).agg(F.collect_list(F.struct(*fields)).alias(name), *([F.count(F.lit(1)).alias("rooms")] if name == "_b" else []))
    room = lambda id_col: (F.col(id_col).alias("id"), F.col("polygon").alias("p"))
    met = gather(built, "_b", *room("room_id")).join(gather(plan, "_r", *room("plan_room_id")), by, "left").join(gather(matches, "_m", F.col("room_id").alias("a"), F.col("plan_room_id").alias("b")), by, "left")
    found = met.select(by, "rooms", F.arrow_udf(_layouts, "struct<iou double, rooms array<double>>")("_b", "_r", "_m").alias("_f"))
    each = F.array_sort(F.transform("_f.rooms", lambda v: F.round(v, 4)))
    at = lambda v, up: F.get(v, ((F.size(v) - (0 if up else 1)) / 2).cast("int"))
    return found.withColumn("_e", each).select(by, "_f.iou", "rooms", (at(F.col("_e"), False) * 0.5 + at(F.col("_e"), True) * 0.5).alias("median_room_iou"))


def _layout_swept(built: DataFrame, plan: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """layout_iou of groups of any size."""
    def footprint(rooms: DataFrame, name: str) -> DataFrame:
        outer = union_outlines(rooms, [by]).filter("not hole").groupBy(by).agg(F.max_by("points", F.struct("area", -F.col("ring"))).alias(name))
        return outer.select(by, F.col(name), g.centroid(F.col(name)).alias(f"{name}_c"))

    met = footprint(built, "b").join(footprint(plan, "r"), by)
    moved = F.transform("b", lambda v: g.point(v["x"] + F.col("r_c")["x"] - F.col("b_c")["x"], v["y"] + F.col("r_c")["y"] - F.col("b_c")["y"]))
    whole = _pair_iou(met.select(by, moved.alias("b"), "r"), [by], "b", "r")
    pairs = matches.join(built.select(by, "room_id", F.col("polygon").alias("b")), [by, "room_id"]).join(plan.select(by, "plan_room_id", F.col("polygon").alias("r")), [by, "plan_room_id"])
    rooms = _pair_iou(pairs.select(by, "room_id", "b", "r"), [by, "room_id"], "b", "r").groupBy(by).agg(F.median(F.round("iou", 4)).alias("median_room_iou"))
    counts = built.groupBy(by).agg(F.count(F.lit(1)).alias("rooms"))
    return counts.join(whole, by, "left").join(rooms, by, "left").select(by, "iou", "rooms", "median_room_iou")


#: Groups of at most so many corners and walls in all are a row; pairs of edges and walls that are looked at together.
FEW_SIDES, SIDES_AT_ONCE = 400, 500_000


def outline_fit(rooms: DataFrame, walls: DataFrame, by: list[str], id_col: str, polygon: str = "polygon", tolerance: float = 0.1, cell: float = 4.0) -> DataFrame:
    """by, id, fit: the share of each room's outline that is within the tolerance of a wall.
    rooms: by, id, polygon; by and id tell rooms apart. walls: by, x0, y0, x1, y1.

    Small groups are a row each, measured in batches, and shuffled by the group only, if they aren't already. Edges of larger ones,
    counted first, meet walls in the cells of a grid. Stretches of an edge that lie on several
    walls count once: a running maximum of their ends tells what each adds. A room without walls fits by 0; one of less than
    three corners, or without length, has no row; a wall that misses a coordinate is none.
    """
    walls = walls.dropna(subset=["x0", "y0", "x1", "y1"])
    sides = rooms.select(*by, F.size(polygon).alias("n")).unionByName(walls.select(*by, F.lit(1).alias("n"))).groupBy(*by).agg(F.sum("n").alias("n"))
    large = few(sides.filter(F.col("n") > FEW_SIDES).select(*[F.col(c).alias(f"_{c}") for c in by]))
    if large.isEmpty():
        return _fit_in_rows(rooms, walls, by, id_col, polygon, tolerance)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    (small_rooms, small_walls), (large_rooms, large_walls) = ([df.join(large, same, how) for df in (rooms, walls)] for how in ("left_anti", "left_semi"))
    return _fit_in_rows(small_rooms, small_walls, by, id_col, polygon, tolerance).unionByName(_fit_in_cells(large_rooms, large_walls, by, id_col, polygon, tolerance, cell))


def _fits(sizes: pd.Series, xs: pd.Series, ys: pd.Series, *walls: pd.Series, tolerance: float) -> list[np.ndarray]:
    """The fits of each group's rooms, NaN for those without length. sizes: corners of its rooms, xs and ys: all of them, in that order."""
    flat = lambda column: np.concatenate([np.zeros(0), *column]).astype(float)
    corners, n_edges, n_walls = flat(sizes).astype(int), np.array([len(c) for c in xs], int), np.array([len(c) for c in walls[0]], int)
    x, y, (a0, b0, a1, b1) = flat(xs), flat(ys), map(flat, walls)
    room, ring = np.repeat(np.arange(len(corners)), corners), np.cumsum(corners) - corners
    after = np.arange(len(x)) + 1
    after[ring + corners - 1] = ring
    length = np.hypot(x[after] - x, y[after] - y)
    real = length > 0
    around = np.bincount(room[real], length[real], len(corners))
    # every edge of a group with every wall of it, by their boxes
    of, wall = np.repeat(n_walls, n_edges), np.repeat(np.cumsum(n_walls) - n_walls, n_edges)
    upto = np.cumsum(of)
    found = [(np.zeros(0, int), np.zeros(0), np.zeros(0))]
    for k in range(0, int(upto[-1]) if len(upto) else 0, SIDES_AT_ONCE):
        at = np.arange(k, min(k + SIDES_AT_ONCE, int(upto[-1])))
        e = np.searchsorted(upto, at, side="right")
        w = wall[e] + at - (upto[e] - of[e])
        apart = lambda p, q, u, v: np.maximum(np.minimum(p[e], p[after[e]]) - np.maximum(u[w], v[w]), np.minimum(u[w], v[w]) - np.maximum(p[e], p[after[e]]))  # noqa: B023, E731
        near = real[e] & (apart(x, x, a0, a1) <= 2 * tolerance) & (apart(y, y, b0, b1) <= 2 * tolerance)
        e, w = e[near], w[near]
        low, high = g.stretch_within(x[e], y[e], x[after[e]], y[after[e]], a0[w], b0[w], a1[w], b1[w], tolerance)
        found.append((e[low < high], low[low < high], high[low < high]))
    e, low, high = map(np.concatenate, zip(*found))
    order = np.lexsort((high, low, e))
    e, low, high = e[order], low[order], high[order]
    # the furthest end before, edge by edge: numbers of ends in rising order, and edges come first
    ends, nth = np.unique(high, return_inverse=True)
    furthest = np.maximum.accumulate(e * (len(ends) + 1) + nth + 1)
    before = np.concatenate([[0], furthest[:-1]])[: len(e)] - e * (len(ends) + 1)
    reached = np.where(before > 0, np.concatenate([[0.0], ends])[np.maximum(before, 0)], 0.0)
    added = np.maximum(0.0, high - np.maximum(low, reached))
    covered = np.bincount(room[e], added * length[e], len(corners))
    with np.errstate(invalid="ignore"):
        fit = np.where(around > 0, covered / around, np.nan)
    return np.split(fit, np.cumsum([len(c) for c in sizes])[:-1]) if len(sizes) else []


def _fit_in_rows(rooms: DataFrame, walls: DataFrame, by: list[str], id_col: str, polygon: str, tolerance: float) -> DataFrame:
    """outline_fit of groups that are small."""
    numbers = lambda c: F.transform(F.col(polygon), lambda v: v[c].cast("double"))
    shaped = rooms.filter(F.size(polygon) >= 3).select(*by, F.struct(F.col(id_col).alias("id"), numbers("x").alias("x"), numbers("y").alias("y")).alias("r"))
    ends = ("x0", "y0", "x1", "y1")
    placed = walls.select(*by, F.struct(*[F.col(c).cast("double").alias(c) for c in ends]).alias("w"))
    met = shaped.groupBy(*by).agg(F.collect_list("r").alias("r")).join(placed.groupBy(*by).agg(F.collect_list("w").alias("w")), by, "left")
    sizes = F.transform("r", lambda v: F.size(v["x"]))
    wall = [F.coalesce(F.col("w")[c], F.array().cast("array<double>")) for c in ends]
    fit = F.pandas_udf(lambda *columns: pd.Series(_fits(*columns, tolerance=tolerance), dtype=object), "array<double>")
    fits = met.select(*by, F.col("r.id").alias("id"), fit(sizes, F.flatten("r.x"), F.flatten("r.y"), *wall).alias("fit"))
    each = fits.select(*by, F.explode(F.arrays_zip("id", "fit")).alias("f")).select(*by, F.col("f.id").alias(id_col), "f.fit")
    return each.filter(F.col("fit").isNotNull() & ~F.isnan("fit"))


def _fit_in_cells(rooms: DataFrame, walls: DataFrame, by: list[str], id_col: str, polygon: str, tolerance: float, cell: float) -> DataFrame:
    """outline_fit of groups of any size: edges meet walls in the cells of a grid that the boxes of both touch."""
    nth = F.transform(F.col(polygon), lambda v, i: F.struct(i.alias("edge"), v.alias("p"), F.get(F.col(polygon), (i + 1) % F.size(polygon)).alias("q")))
    edges = rooms.filter(F.size(polygon) >= 3).select(*by, F.col(id_col).alias("id"), F.explode(nth).alias("e")).select(*by, "id", "e.edge", *[F.col(f"e.{end}.{c}").cast("double").alias(f"{c}{k}") for k, end in ((0, "p"), (1, "q")) for c in "xy"])
    edges = edges.withColumn("length", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))).filter("length > 0")

    def celled(df: DataFrame, names: tuple[str, ...], grow: float) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor((F.least(a, b) - grow) / cell), F.floor((F.greatest(a, b) + grow) / cell))
        return df.withColumn("gx", F.explode(span(names[0], names[2]))).withColumn("gy", F.explode(span(names[1], names[3])))

    wall = ("a0", "b0", "a1", "b1")
    placed = celled(walls.select(*by, *[F.col(c).cast("double").alias(w) for c, w in zip(("x0", "y0", "x1", "y1"), wall)]), wall, tolerance)
    met = celled(edges, ("x0", "y0", "x1", "y1"), 0.0).join(placed, [*by, "gx", "gy"])

    def reach(*ends: pd.Series) -> pd.DataFrame:
        low, high = g.stretch_within(*[c.to_numpy(float) for c in ends], tolerance)
        return pd.DataFrame({"low": low, "high": high})

    near = F.pandas_udf(reach, "low double, high double")("x0", "y0", "x1", "y1", *wall)
    parts = met.select(*by, "id", "edge", "length", near.alias("near")).select(*by, "id", "edge", "length", "near.low", "near.high").filter("low < high").distinct()
    before = Window.partitionBy(*by, "id", "edge").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    added = F.greatest(F.lit(0.0), F.col("high") - F.greatest(F.col("low"), F.coalesce(F.max("high").over(before), F.lit(0.0))))
    covered = parts.select(*by, "id", (added * F.col("length")).alias("part")).groupBy(*by, "id").agg(F.sum("part").alias("covered"))
    around = edges.groupBy(*by, "id").agg(F.sum("length").alias("around"))
    return around.join(covered, [*by, "id"], "left").select(*by, F.col("id").alias(id_col), (F.coalesce("covered", F.lit(0.0)) / F.col("around")).alias("fit"))


def plan_sheets(plans: DataFrame, rooms: DataFrame, walls: DataFrame, shells: DataFrame, packages: DataFrame, triage: DataFrame, by: str, **fit) -> DataFrame:
    """A row per plan with all that its sheet shows: address, n_plan, n_shell, ceilings_measured, area, stated,
    scale_source, ceiling, outline_fit, flags.

    plans: by, area (printed, null if there is none), scale_source, qa_flags. rooms: by, room_id, polygon,
    area. shells: by, room_id, height, photographed. packages and triage: by, address, area, where the
    package's address goes first and triage's area does. Artifacts that aren't there leave nulls, or
    counts of 0; a plan alone makes a row.
    """
    fits = outline_fit(rooms, walls, [by], "room_id", **fit).groupBy(by).agg(F.median("fit").alias("outline_fit"))
    own = rooms.groupBy(by).agg(F.count(F.lit(1)).alias("n_plan"), F.sum("area").alias("rooms_area"))
    shell = shells.groupBy(by).agg(F.count(F.lit(1)).alias("n_shell"), F.count_if(F.col("photographed")).alias("ceilings_measured"), F.median(F.when(F.col("height") > 0, F.col("height"))).alias("ceiling"))
    named = lambda df, k: df.groupBy(by).agg(F.max(F.struct("address", "area")).alias(k))
    met = plans
    for artifact in (own, shell, named(packages, "_p"), named(triage, "_t"), fits):
        met = met.join(artifact, by, "left")
    address = F.coalesce(F.nullif(F.col("_p.address"), F.lit("")), F.col("_t.address"), F.lit(""))
    none = F.lit(0).cast("long")
    return met.select(
        by,
        F.substring(address, 1, 58).alias("address"),
        F.coalesce("n_plan", none).alias("n_plan"),
        F.coalesce("n_shell", none).alias("n_shell"),
        F.coalesce("ceilings_measured", none).alias("ceilings_measured"),
        F.nullif(F.coalesce(F.nullif("area", F.lit(0.0)), "rooms_area"), F.lit(0.0)).alias("area"),
        F.coalesce(F.nullif(F.col("_t.area"), F.lit(0.0)), F.col("_p.area")).alias("stated"),
        F.coalesce("scale_source", F.lit("none")).alias("scale_source"),
        "ceiling",
        "outline_fit",
        F.coalesce("qa_flags", F.array().cast("array<string>")).alias("flags"),
    )


def _corners(polygon: str) -> Column:
    """Points as arrays, for numpy."""
    return F.transform(polygon, lambda v: F.array(v["x"], v["y"]))


def wall_directions(polygons: DataFrame, by: str, polygon: str = "polygon") -> DataFrame:
    """by, directions: the directions in degrees, modulo 180, that the walls of a group's polygons run along, rising. Each polygon's edge
    lengths by degree are summed for the group by Spark, 180 numbers at most; the peaks are told from those."""
    def weigh(frames):
        for rows in frames:
            rings = [[*map(list, p)] for p in rows["_p"]]
            for at in g.batches([(len(p),) for p in rings]):
                w = g.batch_direction_weights(np.array([rings[i] for i in at.tolist()], float))
                which, angle = np.nonzero(w)
                yield pd.DataFrame({by: rows[by].to_numpy()[at[which]], "angle": angle, "weight": w[which, angle]})

    def peaks(angles: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([g.peak_directions(np.bincount(np.asarray(a, int), w, 180)) for a, w in zip(angles, weights)])

    kind = polygons.schema[by].dataType.simpleString()
    shaped = polygons.filter((F.size(polygon) >= 3) & F.col(by).isNotNull()).select(by, _corners(polygon).alias("_p"))
    by_angle = shaped.mapInPandas(weigh, f"{by} {kind}, angle int, weight double").groupBy(by, "angle").agg(F.sum("weight").alias("weight"))
    all_angles = by_angle.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("angle", "weight"))).alias("w"))
    return all_angles.select(by, F.pandas_udf(peaks, "array<double>")("w.angle", "w.weight").alias("directions"))


def _some_squared(rooms: pa.Array) -> tuple[np.ndarray, ...]:
    """Rooms of each row, and directions, turn, area, corners, x and y of each room."""
    n, each = lists(rooms)
    sizes, points = lists(pc.struct_field(each, "p"))
    x, y = fields(points, "x", "y")
    first, row = sweeps.firsts(sizes), np.repeat(np.arange(len(n)), n)
    weights = np.zeros((len(n), 180))
    of_size = {k: np.flatnonzero(sizes == k) for k in np.unique(sizes).tolist()}
    shaped = lambda at, k: np.stack([v[first[at][:, None] + np.arange(k)] for v in (x, y)], axis=2)
    for k, at in of_size.items():
        np.add.at(weights, row[at], g.batch_direction_weights(shaped(at, k)))
    many, directions = g.batch_peak_directions(weights)
    turn, area, corner = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros((len(x), 2))
    for k, at in of_size.items():
        for d in np.unique(many[row[at]]).tolist():
            some = at[many[row[at]] == d]
            snapped, turn[some] = g.batch_snap_to(shaped(some, k), directions[row[some], :d])
            area[some] = np.abs(g.batch_area(snapped))
            corner[first[some][:, None] + np.arange(k)] = snapped
    many[~weights.any(axis=1)] = 0  # rooms without length run along nothing, and have no row
    room, k = sweeps.counted(many[row])
    return n, listed(many[row], pa.array(directions[row[room], k])), turn, area, sizes, corner


def _squared(rooms: pa.Array) -> pa.Array:
    def some(part: pa.Array) -> pa.Array:
        n, directions, turn, area, sizes, corner = _some_squared(part)
        points = pa.StructArray.from_arrays([pa.array(corner[:, 0].copy()), pa.array(corner[:, 1].copy())], ["x", "y"])
        return listed(n, pa.StructArray.from_arrays([directions, pa.array(turn), pa.array(area), listed(sizes, points)], ["directions", "turn", "area", "polygon"]))

    return pa.concat_arrays([some(rooms.slice(k, ROWS_AT_ONCE)) for k in range(0, max(1, len(rooms)), ROWS_AT_ONCE)])


def squared_rooms(polygons: DataFrame, by: str, id_col: str, polygon: str = "polygon", corners: Column | None = None) -> DataFrame:
    """by, id, directions, turn, area, polygon: each room with its walls turned into its group's directions. Small groups are a row each,
    shuffled once by the group, and turned in batches; of larger ones, counted first, edge lengths are summed by Spark. corners: at most how
    many a polygon has, where that is known without making it."""
    polygons = polygons.select(by, id_col, F.col(polygon).alias("p")).filter(F.col(by).isNotNull())
    large = large_groups([by], FEW_IN_ALL, (polygons, F.size("p") if corners is None else corners))
    if large.isEmpty():
        return _squared_in_rows(polygons, by, id_col)
    return _squared_in_rows(polygons.join(large, by, "left_anti"), by, id_col).unionByName(_squared_by_spark(polygons.join(large, by, "left_semi"), by, id_col, "p"))


def _squared_in_rows(polygons: DataFrame, by: str, id_col: str) -> DataFrame:
    rows = polygons.filter(F.size("p") >= 3).groupBy(by).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "p")).alias("_r"))
    turned = F.arrow_udf(_squared, "array<struct<directions array<double>, turn double, area double, polygon array<struct<x double, y double>>>>")
    each = rows.select(by, F.col("_r.id").alias("id"), turned("_r").alias("s")).select(by, F.explode(F.arrays_zip("id", "s")).alias("_s")).filter(F.size("_s.s.directions") > 0)
    return each.select(by, F.col("_s.id").alias(id_col), *[F.col(f"_s.s.{c}").alias(c) for c in ("directions", "turn", "area", "polygon")])


def _squared_by_spark(polygons: DataFrame, by: str, id_col: str, polygon: str = "polygon") -> DataFrame:
    """squared_rooms of groups of any size."""
    def snap(rings: pd.Series, directions: pd.Series) -> pd.DataFrame:
        rings = [[*map(list, p)] for p in rings]
        turn, area, snapped = np.zeros(len(rings)), np.zeros(len(rings)), [None] * len(rings)
        for at in g.batches([(len(p), len(d)) for p, d in zip(rings, directions)]):
            found, turn[at] = g.batch_snap_to(np.array([rings[i] for i in at.tolist()], float), np.array([list(directions.iloc[i]) for i in at.tolist()], float))
            area[at] = np.abs(g.batch_area(found))
            for i, p in zip(at.tolist(), found.tolist()):
                snapped[i] = p
        return pd.DataFrame({"turn": turn, "area": area, "polygon": snapped})

    met = polygons.filter(F.size(polygon) >= 3).select(by, F.col(id_col), _corners(polygon).alias("_p")).join(wall_directions(polygons, by, polygon), by)
    out = F.pandas_udf(snap, "turn double, area double, polygon array<array<double>>")("_p", "directions")
    return met.select(by, id_col, "directions", out.alias("_s")).select(by, id_col, "directions", "_s.turn", "_s.area", F.transform("_s.polygon", lambda v: g.point(v[0], v[1])).alias("polygon"))
