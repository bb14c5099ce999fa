"""Shells of rooms as triangles: walls split around their openings and ears clipped in batches of rooms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import sweeps
from tessella.operators.outlines import ROWS_AT_ONCE, fields, large_groups, listed, lists

#: How far from a wall's line an opening may be, and its width, sill and head where they aren't given.
REACH, WIDTH, SILL, HEAD, WINDOW_HEAD = 0.45, 0.85, 0.9, 2.04, 2.1
CELL = 16.0
#: Groups of at most so many openings have them in each room's row.
FEW_OPENINGS = 64


def rooms_with_openings(rooms: DataFrame, openings: DataFrame, by: str) -> DataFrame:
    """rooms (by, room_id, polygon, floor, height, provenance) their rings counter-clockwise, with an array of their group's openings (by, x, y, width,
    kind, head), which are joined by the group alone. Of groups with many openings, counted first, only those in or at a room's box are with it."""
    low = F.col("kind").isin("door", "opening")
    cut = openings.filter("x is not null and y is not null").select(by, F.struct("x", "y", F.coalesce(F.nullif("width", F.lit(0.0)), F.lit(WIDTH)).alias("width"), F.when(low, 0.0).otherwise(SILL).alias("sill"), F.coalesce(F.nullif("head", F.lit(0.0)), F.when(F.col("kind") == "window", WINDOW_HEAD).otherwise(HEAD)).alias("head")).alias("o"))
    shaped = rooms.filter(F.size("polygon") >= 3).select(by, "room_id", g.counter_clockwise(F.col("polygon")).alias("polygon"), "floor", "height", "provenance")
    large = large_groups([by], FEW_OPENINGS, (cut, F.lit(1)))
    beside = lambda rooms, cut: rooms.join(cut.groupBy(by).agg(F.collect_list("o").alias("openings")), by, "left")
    if large.isEmpty():
        return beside(shaped, cut)
    (few_rooms, few_cut), (many_rooms, many_cut) = ([df.join(large, by, how) for df in (shaped, cut)] for how in ("left_anti", "left_semi"))
    return beside(few_rooms, few_cut).unionByName(_met_in_cells(many_rooms, many_cut, by))


def _met_in_cells(rooms: DataFrame, cut: DataFrame, by: str) -> DataFrame:
    """rooms with the openings in or at their boxes. They meet in cells of a grid, a row per room and cell."""
    box = g.bounds(F.col("polygon"))
    cells = lambda c: F.sequence(F.floor((F.col(f"box.{c}0") - REACH) / CELL), F.floor((F.col(f"box.{c}1") + REACH) / CELL))
    own = ("polygon", "floor", "height", "provenance")
    placed = rooms.withColumn("box", box).withColumn("gx", F.explode(cells("x"))).withColumn("gy", F.explode(cells("y")))
    inside = F.col("o.x").between(F.col("box.x0") - REACH, F.col("box.x1") + REACH) & F.col("o.y").between(F.col("box.y0") - REACH, F.col("box.y1") + REACH)
    met = placed.join(cut.withColumn("gx", F.floor(F.col("o.x") / CELL)).withColumn("gy", F.floor(F.col("o.y") / CELL)), [by, "gx", "gy"], "left").withColumn("o", F.when(inside, F.col("o")))
    return met.groupBy(by, "room_id").agg(*[F.first(c).alias(c) for c in own], F.collect_list("o").alias("openings"))


def _panels(row, wall, px, py, qx, qy, height, n_openings, openings) -> tuple[np.ndarray, ...]:
    """side, t0, t1, z0, z1: upright panels of walls beside, below and above their rows' openings. An opening cuts every wall that it is within reach
    of and beside. Of those that overlap, the one that begins first goes first; what it covers isn't cut again. Heights count from the floor."""
    ox, oy, width, sill, head = openings
    dx, dy, length = qx - px, qy - py, np.hypot(qx - px, qy - py)
    s, k = sweeps.counted(np.where(length >= 1e-6, n_openings[row], 0))
    o = sweeps.firsts(n_openings)[row[s]] + k
    t = ((ox[o] - px[s]) * dx[s] + (oy[o] - py[s]) * dy[s]) / (length[s] * length[s])
    near = (t >= 0) & (t <= 1) & (np.abs((oy[o] - py[s]) * dx[s] - (ox[o] - px[s]) * dy[s]) / length[s] <= REACH)
    s, o, t = s[near], o[near], t[near]
    half = width[o] / 2 / length[s]
    t0, t1, low, high = np.maximum(0.0, t - half), np.minimum(1.0, t + half), sill[o], head[o]
    order = np.lexsort((high, low, t1, t0, s))
    s, t0, t1, low, high = (v[order] for v in (s, t0, t1, low, high))
    place = np.arange(len(s)) - np.searchsorted(s, s, "left")
    cursor, start = np.zeros(len(row)), np.zeros(len(s))
    for k in range(int(place.max(initial=-1)) + 1):
        at = np.flatnonzero(place == k)
        start[at] = cursor[s[at]]
        cursor[s[at]] = np.maximum(start[at], t1[at])
    a, b, h, zero = np.maximum(start, t0), np.maximum(start, t1), height[row[s]], np.zeros(len(s))
    every = np.arange(len(row))
    parts = [(s, start, a, zero, h), (s, a, b, zero, low), (s, a, b, np.fmin(h, high), h), (every, cursor, np.ones(len(row)), np.zeros(len(row)), height[row])]
    side, t0, t1, z0, z1 = map(np.concatenate, zip(*parts))
    kept = np.flatnonzero((t1 > t0) & (z1 > z0) & (length[side] >= 1e-6))
    kept = kept[np.lexsort((z0[kept], t0[kept], side[kept]))]
    return side[kept], t0[kept], t1[kept], z0[kept], z1[kept]


def _ears(sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, corner numbers) of the triangles of counter-clockwise rings, by clipping ears; and whether they add up to each ring, which they
    don't if it crosses itself."""
    first, whole, found = sweeps.firsts(sizes), np.zeros(len(sizes), bool), [(np.zeros(0, int), np.zeros((0, 3), int))]
    for n in np.unique(sizes).tolist():
        for at in np.array_split(np.flatnonzero(sizes == n), max(1, int((sizes == n).sum()) * n * n // 1_000_000)):
            p = np.stack([v[first[at][:, None] + np.arange(n)] for v in (x, y)], axis=2)
            ears, count = g.batch_ear_clip(p)
            row, k = sweeps.counted(count)
            corners = ears[row, k]
            a, b, c = (p[row, corners[:, i]] for i in range(3))
            parts = np.bincount(row, np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])), len(at)) / 2
            size = g.batch_area(p)
            whole[at] = (count == n - 2) & (np.abs(parts - size) <= 1e-9 * np.maximum(1.0, size))
            found.append((at[row], corners + first[at][row][:, None]))
    row, corners = map(np.concatenate, zip(*found))
    return row, corners, whole


_CORNERS = [f"{end}{c}" for end in "abc" for c in "xyz"]
_PARTS = ("floor", "ceiling", "wall")


def _some_triangles(polygon: pa.Array, floor: pa.Array, height: pa.Array, openings: pa.Array) -> pa.Array:
    sizes, points = lists(polygon)
    x, y = fields(points, "x", "y")
    floor, height = (pc.cast(v, pa.float64()).to_numpy(zero_copy_only=False) for v in (floor, height))
    n, each = lists(openings)
    row, wall = sweeps.counted(sizes)
    after = sweeps.following(sizes)
    qx, qy = x[after], y[after]
    side, t0, t1, z0, z1 = _panels(row, wall, x, y, qx, qy, height, n, fields(each, "x", "y", "width", "sill", "head"))
    at, base = [(x[side] + (qx - x)[side] * t, y[side] + (qy - y)[side] * t) for t in (t0, t1)], floor[row[side]]
    a, b, c, d = (*at[0], base + z0), (*at[1], base + z0), (*at[1], base + z1), (*at[0], base + z1)
    of, corners, whole = _ears(sizes, x, y)
    level = lambda z, *k: [v for i in k for v in (x[corners[:, i]], y[corners[:, i]], z[of])]
    groups = [(of, 0, level(floor, 0, 1, 2)), (of, 1, level(floor + height, 0, 2, 1)), (row[side], 2, [*a, *b, *c]), (row[side], 2, [*a, *c, *d])]
    rows = np.concatenate([r for r, _, _ in groups])
    order = np.argsort(rows, kind="stable")
    part = np.concatenate([np.full(len(r), k, np.int32) for r, k, _ in groups])[order]
    walls = np.concatenate([np.zeros(2 * len(of)), wall[side], wall[side]]).astype(np.int32)[order]
    ends = [pa.array(np.concatenate(v)[order], from_pandas=True) for v in zip(*[corners for _, _, corners in groups])]
    triangle = pa.StructArray.from_arrays([pa.array(part), pa.array(walls, mask=part < 2), *ends, pa.array((part == 2) | whole[rows[order]])], ["part", "wall", *_CORNERS, "whole"])
    return listed(np.bincount(rows, minlength=len(sizes)), triangle)


def _triangles(*columns: pa.Array) -> pa.Array:
    at_once = ROWS_AT_ONCE
    return pa.concat_arrays([_some_triangles(*[c.slice(k, at_once) for c in columns]) for k in range(0, max(1, len(columns[0])), at_once)])


def room_mesh(rooms: DataFrame, openings: DataFrame, by: str) -> DataFrame:
    """by, room_id, provenance, part, wall, ax, ay, az, bx, by, bz, cx, cy, cz, whole: a row per triangle of each room's shell, with openings
    cut from its walls: its floor and ceiling, whose sides face the room, and two for each panel of its walls. Triangles are made
    in batches of rooms; whole is false in floors and ceilings that ears don't add up to."""
    kind = f"array<struct<part int, wall int, {', '.join(f'{c} double' for c in _CORNERS)}, whole boolean>>"
    met = rooms_with_openings(rooms, openings, by).select(by, "room_id", "provenance", F.arrow_udf(_triangles, kind)("polygon", "floor", "height", "openings").alias("t"))
    each = met.select(by, "room_id", "provenance", F.inline("t"))
    return each.withColumn("part", F.element_at(F.array(*map(F.lit, _PARTS)), F.col("part") + 1))


def triangle_area() -> Column:
    """Area of a triangle of room_mesh."""
    u, v = ([F.col(f"{end}{c}") - F.col(f"a{c}") for c in "xyz"] for end in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
