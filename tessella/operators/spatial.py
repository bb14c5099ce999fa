"""Order-dependent spatial operators: one group (a sheet, a listing, a wall) per task."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators.quantiles import quantile_of


def suppress_words(words: DataFrame, by: str) -> DataFrame:
    """Keeps the surest reading of each printed word: a less sure one with the same text goes if its
    centre is within half the width and 0.6 of the height of a kept one. words: by, word_id, text,
    conf, x, y, w, h. A word that went suppresses none."""
    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conf", "word_id"], ascending=[False, True])
        kept: list = []
        for r in rows.itertuples():
            cx, cy = r.x + r.w / 2, r.y + r.h / 2
            if not any(k.text.lower() == r.text.lower() and abs(k.x + k.w / 2 - cx) < 0.5 * max(k.w, r.w) and abs(k.y + k.h / 2 - cy) < 0.6 * max(k.h, r.h) for k in kept):
                kept.append(r)
        return rows.loc[[k.Index for k in kept]].sort_values(["y", "x", "word_id"])

    return words.groupBy(by).applyInPandas(keep, words.schema)


def cluster_captions(words: DataFrame, by: str, reach: float = 1.2, strict: float = 0.5) -> DataFrame:
    """Words of one caption: pairs within reach of the taller one are united from the nearest on;
    two that each hold a label stay apart unless their gap is at most strict of the shorter.
    words: by, word_id, x, y, w, h, is_label. Adds cluster, the least word of each."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", cluster long"

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word_id").reset_index(drop=True)
        x0, y0, w, h = (rows[c].to_numpy(float) for c in "xywh")
        parent, labels = list(range(len(rows))), rows["is_label"].astype(int).tolist()

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        pairs = []
        for i in range(len(rows)):
            dx = np.maximum(0, np.maximum(x0[i + 1 :] - x0[i] - w[i], x0[i] - x0[i + 1 :] - w[i + 1 :]))
            dy = np.maximum(0, np.maximum(y0[i + 1 :] - y0[i] - h[i], y0[i] - y0[i + 1 :] - h[i + 1 :]))
            for k in np.flatnonzero((dx < reach * np.maximum(h[i], h[i + 1 :])) & (dy < reach * np.maximum(h[i], h[i + 1 :]))):
                pairs.append((float(np.hypot(dx[k], dy[k])), i, i + 1 + int(k)))
        for gap, i, j in sorted(pairs):
            a, b = find(i), find(j)
            if a != b and not (labels[a] and labels[b] and gap > strict * min(h[i], h[j])):
                a, b = min(a, b), max(a, b)
                parent[b] = a
                labels[a] += labels[b]
        rows["cluster"] = [int(rows["word_id"][find(i)]) for i in range(len(rows))]
        return rows

    return words.groupBy(by).applyInPandas(unite, schema)


def suppress_overlaps(polygons: DataFrame, by: str, share: float = 0.5, least_of_median: float = 0.0) -> DataFrame:
    """Largest first: a polygon goes if more than share of the smaller of it and a kept one is
    common; before that, ones under a part of the group's median area go. polygons: by, poly_id,
    p (array of arrays)."""
    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = {r.poly_id: np.array([list(v) for v in r.p]) for r in rows.itertuples()}
        size = {k: abs(g.np_area(p)) for k, p in shapes.items()}
        floor = least_of_median * float(np.median(list(size.values())))
        kept: list = []
        for k in sorted(shapes, key=lambda k: (-size[k], k)):
            if size[k] >= floor and all(g.intersection_area(shapes[k], shapes[o]) <= share * min(size[k], size[o]) for o in kept):
                kept.append(k)
        return rows[rows["poly_id"].isin(kept)]

    return polygons.groupBy(by).applyInPandas(keep, polygons.schema)


def grid_components(cells: DataFrame, by: str, fill: float = 0.72) -> DataFrame:
    """Connected parts (4 neighbours) of the cells of each wall that fill enough of their box:
    by, part, n, x0, y0, x1, y1, kind: a door if it touches row 0, else a window."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(rows["cx"], rows["cy"]))
        out = []
        while left:
            todo, seen = [min(left)], []
            left.discard(todo[0])
            while todo:
                x, y = todo.pop()
                seen.append((x, y))
                for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if n in left:
                        left.discard(n)
                        todo.append(n)
            xs, ys = [x for x, _ in seen], [y for _, y in seen]
            box = (max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1)
            if len(seen) >= fill * box:
                out.append((rows[by].iloc[0], len(out), len(seen), min(xs), min(ys), max(xs), max(ys), "door" if min(ys) == 0 else "window"))
        return pd.DataFrame(out, columns=[by, "part", "n", "x0", "y0", "x1", "y1", "kind"])

    return cells.groupBy(by).applyInPandas(parts, f"{by} {kinds[by]}, part int, n int, x0 long, y0 long, x1 long, y1 long, kind string")


@functools.lru_cache(64)
def _drawn(n: int, tries: int, seed: int, sample: int) -> tuple:
    """Places of the corners tried and of the points seen (None for all), the same for all rooms of n points."""
    rng = np.random.default_rng(seed)
    triplets = np.array([rng.choice(n, 3, replace=False) for _ in range(tries)])
    return triplets, None if n <= sample else np.sort(rng.choice(n, sample, replace=False))


def up_direction(points: DataFrame, by: str, prior: tuple[float, float, float] | None = None, tries: int = 48, seed: int = 7, sample: int = 20_000) -> DataFrame:
    """by, ux, uy, uz, score: the normal along which most points lie in two thin layers, of random
    triplets' normals and the axes. A prior is tried too, and weighs down what lies far from it: an
    orthogonal direction counts 0.45 of its score. A room of under 50 points gets the z axis and
    score 0. Rooms of more than `sample` points are scored on so many, drawn at random by a fixed
    seed: the method's own bound. points: by, point_id, x, y, z."""
    kind = points.schema[by].dataType.simpleString()

    def search(xyz: np.ndarray) -> tuple:
        if len(xyz) < FEWEST:
            return 0.0, 0.0, 1.0, 0.0
        triplets, seen = _drawn(len(xyz), tries, seed, sample)
        corners = xyz[triplets]
        normals = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
        normals = np.concatenate([np.eye(3)[::-1], normals, *([[prior]] if prior else [])])
        size = np.linalg.norm(normals, axis=1)
        normals = normals[size > 1e-9] / size[size > 1e-9, None]
        seen = xyz if seen is None else xyz[seen]
        step = max(1, NUMBERS // len(seen))
        score = np.concatenate([layer_scores(np.stack([seen @ n for n in normals[k : k + step]])) for k in range(0, len(normals), step)])
        if prior:
            score *= PRIOR_FLOOR + (1 - PRIOR_FLOOR) * np.abs(normals @ np.array(prior)) / np.linalg.norm(prior)
        best = int(score.argmax())
        return *(normals[best] * (1 if normals[best][2] >= 0 else -1)).tolist(), float(score[best])

    def searched(frames):
        for rooms in frames:
            found = [search(np.array([x, y, z], float).T.copy()) for x, y, z in zip(rooms["x"], rooms["y"], rooms["z"])]
            yield pd.DataFrame(found, columns=["ux", "uy", "uz", "score"]).assign(**{by: rooms[by].to_numpy()})[[by, "ux", "uy", "uz", "score"]]

    axes = [F.col(f"p.{c}").cast("array<double>").alias(c) for c in "xyz"]
    gathered = points.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("point_id", "x", "y", "z"))).alias("p"))
    return gathered.select(by, *axes).mapInPandas(searched, f"{by} {kind}, ux double, uy double, uz double, score double")


#: Points that a room needs, what a direction across the prior keeps of its score,
#: bins of a height histogram, thickness and least extent in metres.
FEWEST, PRIOR_FLOOR, BINS, THICK, EXTENT = 50, 0.45, 120, 0.08, 0.4


def layer_score(height: np.ndarray) -> float:
    """Share of the points between the 1st and 99th percentile that lie in the two fullest layers.
    A layer is a bin with its neighbours within THICK; the second is more than four times that
    away. Clouds that are flatter than EXTENT have none."""
    return float(layer_scores(np.asarray(height, float)[None])[0]) if len(height) else 0.0


def layer_scores(height: np.ndarray) -> np.ndarray:
    """layer_score of each row. Bins are those of np.histogram."""
    score = np.zeros(len(height))
    low, high = np.percentile(height, [1, 99], axis=1)
    some = np.flatnonzero(~(high - low < EXTENT))
    height, low, high = height[some], low[some], high[some]
    if not len(some):
        return score
    edges = np.linspace(low, high, BINS + 1, axis=1)
    inside = (height >= low[:, None]) & (height <= high[:, None])
    rows = np.nonzero(inside)[0]
    value = height[inside]
    bins = ((value - low[rows]) / (high - low)[rows] * BINS).astype(int)
    bins[bins == BINS] -= 1
    bins -= value < edges[rows, bins]
    bins += (value >= edges[rows, bins + 1]) & (bins != BINS - 1)
    count = np.bincount(rows * BINS + bins, minlength=len(some) * BINS).reshape(-1, BINS)
    total = np.concatenate([np.zeros((len(some), 1), int), np.cumsum(count, axis=1)], axis=1)
    reach = np.maximum(1, np.round(THICK * BINS / (high - low))).astype(int)[:, None]
    at = np.arange(BINS)
    layer = np.take_along_axis(total, np.minimum(at + reach + 1, BINS), 1) - np.take_along_axis(total, np.maximum(at - reach, 0), 1)
    first = layer.argmax(1)[:, None]
    other = np.where(np.abs(at - first) > 4 * reach, layer, 0).max(1)
    score[some] = (np.take_along_axis(layer, first, 1)[:, 0] + other) / np.maximum(1, count.sum(1))
    return score


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy
    halves = []
    for points in (xy, xy[::-1]):
        half: list[np.ndarray] = []
        for p in points:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def widest_pair(points: DataFrame, by: str, id_col: str, parts: int = 64) -> DataFrame:
    """by, widest: the largest distance between two points of each group. points: by, an id, x, y.
    Both lie on the hull, so hulls of parts of a group are taken first, and then that of their
    corners; only its corners meet."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_hull(rows[["x", "y"]].to_numpy(float)), columns=["x", "y"])
        return out.assign(**{by: rows[by].iloc[0]})[[by, "x", "y"]]

    def widest(rows: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(rows[["x", "y"]].to_numpy(float))
        far = max(float(np.hypot(*(hull - p).T).max()) for p in hull)
        return pd.DataFrame([(rows[by].iloc[0], far)], columns=[by, "widest"])

    dealt = points.filter("x is not null and y is not null").withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(parts)))
    outer = dealt.groupBy(by, "_part").applyInPandas(corners, f"{by} {kinds[by]}, x double, y double")
    return outer.groupBy(by).applyInPandas(widest, f"{by} {kinds[by]}, widest double")


def clip_reasons(points: DataFrame, by: str, low_conf: float = 0.1, radial: float = 0.98, most: float = 6.0, margin: float = 0.35) -> DataFrame:
    """points with reason: null if kept, else the first of low_confidence, far, height. Quantiles
    are a group's own; the height band is its 2nd to 98th percentile with a margin. points: by,
    x, y, z, conf."""
    values = lambda c: F.array_sort(F.collect_list(F.col(c).cast("double")))
    sorted_ = points.groupBy(by).agg(values("conf").alias("c"), F.median("x").alias("mx"), F.median("y").alias("my"), values("z").alias("z"))
    q = sorted_.select(by, quantile_of(F.col("c"), low_conf).alias("qc"), "mx", "my", F.array(quantile_of(F.col("z"), 0.02), quantile_of(F.col("z"), 0.98)).alias("qz"))
    far = points.join(q, by).withColumn("radius", F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))))
    limit = far.groupBy(by).agg(values("radius").alias("r")).select(by, F.least(F.lit(most), quantile_of(F.col("r"), radial)).alias("limit"))
    reason = F.when(F.col("conf") < F.col("qc"), "low_confidence").when(F.col("radius") > F.col("limit"), "far").when((F.col("z") < F.col("qz")[0] - margin) | (F.col("z") > F.col("qz")[1] + margin), "height")
    return far.join(limit, by).withColumn("reason", reason).drop("qc", "mx", "my", "qz", "limit")


def footprint(points: DataFrame, by: str, step: int = 1) -> DataFrame:
    """by, angle, width, depth: of the angles 0, step, ... 89 degrees, the one whose box between the
    1st and 99th percentiles is smallest, and that box between the 1.5th and 98.5th. points: by,
    x, y. A room's points are brought together once and turned there, many rooms in a batch."""
    turns = [(a, math.cos(math.radians(a)), math.sin(math.radians(a))) for a in range(0, 90, step)]
    angles, c, s = (np.array(v, float) for v in zip(*turns))

    def box(rooms: pd.DataFrame) -> np.ndarray:
        """angle, width and depth of rooms with equally many points."""
        x, y = (np.stack([np.asarray(v, float) for v in rooms[k]])[:, None] for k in "xy")
        u, v = (np.sort(p, axis=2) for p in (x * c[:, None] + y * s[:, None], y * c[:, None] - x * s[:, None]))
        size = lambda p, low, high: _ranked(p, high) - _ranked(p, low)
        return np.stack([size(u, 0.01, 0.99) * size(v, 0.01, 0.99), size(u, 0.015, 0.985), size(v, 0.015, 0.985)], axis=2)

    def boxes(frames):
        for rooms in frames:
            for at in _alike(rooms["n"].to_numpy(), len(turns)):
                some = rooms.iloc[at]
                found = box(some)
                yield pd.DataFrame({by: np.repeat(some[by].to_numpy(), len(turns)), "angle": np.tile(angles.astype(int), len(some)), "area": found[..., 0].ravel(), "width": found[..., 1].ravel(), "depth": found[..., 2].ravel()})

    gathered = points.filter("x is not null and y is not null").select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(by).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    kind = points.schema[by].dataType.simpleString()
    made = gathered.select(by, F.size("p").alias("n"), "p.x", "p.y").mapInPandas(boxes, f"{by} {kind}, angle long, area double, width double, depth double")
    best = made.groupBy(by).agg(F.min(F.struct(F.round("area", 6).alias("area"), "angle", "width", "depth")).alias("b"))
    return best.select(by, "b.angle", "b.width", "b.depth")


def _ranked(ordered: np.ndarray, q: float) -> np.ndarray:
    """The quantile of values that are sorted along the last axis, interpolated."""
    at = (ordered.shape[-1] - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return ordered[..., low] if low == high else ordered[..., low] * (high - at) + ordered[..., high] * (at - low)


#: Numbers that are held at a time when rooms of one size are worked on together.
NUMBERS = 1 << 19


def _alike(sizes: np.ndarray, times: int):
    """Places of rooms of one size, so many that they make at most NUMBERS numbers of `times` for each point; one at least."""
    order = np.argsort(sizes, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(same):
            most = max(1, NUMBERS // max(1, times * int(sizes[same[0]])))
            yield from (same[k : k + most] for k in range(0, len(same), most))


def wall_inliers(points: DataFrame, walls: DataFrame, by: str, near: float = 0.12) -> DataFrame:
    """by, wall_id, n, inlier_fraction: of all points of a room, the share close to each wall's line.
    walls: by, wall_id, nx, ny, offset; a room has few. Points are counted within a task first."""
    met = points.join(walls, by).withColumn("dist", F.abs(F.col("x") * F.col("nx") + F.col("y") * F.col("ny") - F.col("offset")))
    return met.groupBy(by, "wall_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("dist") < near).cast("double")).alias("inlier_fraction"))


def wall_panels(cuts: DataFrame, by: str, length: str) -> DataFrame:
    """Solid stretches of each wall between its cuts: by, t0, t1. cuts: by, length, c0, c1 (null for
    a wall without any), sorted by c0; overlapping cuts merge through a running maximum."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("c0", "c1")
    cursor = F.greatest(F.lit(0.0), F.coalesce(F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    before = cuts.filter("c0 is not null").withColumn("t0", cursor).select(by, "t0", F.least(F.col(length), "c0").alias("t1"))
    last = cuts.groupBy(by).agg(F.coalesce(F.max("c1"), F.lit(0.0)).alias("t0"), F.max(length).alias("t1"))
    return before.unionByName(last).filter(F.col("t1") - F.col("t0") > 1e-9)
