"""Polygons as array<struct<x, y>>, ring not closed. Column functions stay in the JVM; the numpy
functions below them are for grouped maps and pandas functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside lambdas an expression would be again for
    every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ring(p: Column, f) -> Column:
    """Array of f(vertex, next vertex) around the ring."""
    return F.transform(p, lambda a, i: f(a, F.get(p, (i + 1) % F.size(p))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def signed_area(p: Column) -> Column:
    return _let(p, lambda p: _sum(_ring(p, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2.0)


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def counter_clockwise(p: Column) -> Column:
    return _let(p, lambda p: F.when(signed_area(p) < 0, F.reverse(p)).otherwise(p))


def centroid(p: Column) -> Column:
    """Centre of area; the mean vertex where the area is next to nothing."""
    a = signed_area(p)
    cross = lambda q, r: q["x"] * r["y"] - r["x"] * q["y"]
    x = _sum(_ring(p, lambda q, r: (q["x"] + r["x"]) * cross(q, r))) / F.nullif(a * 6.0, F.lit(0.0))
    y = _sum(_ring(p, lambda q, r: (q["y"] + r["y"]) * cross(q, r))) / F.nullif(a * 6.0, F.lit(0.0))
    mean = lambda k: _sum(F.transform(p, lambda v: v[k])) / F.size(p)
    return F.when(F.abs(a) < 1e-9, point(mean("x"), mean("y"))).otherwise(point(x, y))


def perimeter(p: Column) -> Column:
    return _let(p, lambda p: _sum(_ring(p, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))))


def bounds(p: Column) -> Column:
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def oriented_extent(p: Column) -> Column:
    """struct<long, short> of the smallest box along any edge."""
    def spread(p: Column, ux: Column, uy: Column) -> Column:
        at = F.transform(p, lambda v: v["x"] * ux + v["y"] * uy)
        return F.array_max(at) - F.array_min(at)

    def box(p: Column, a: Column, b: Column) -> Column:
        unit = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        side = _let(F.struct(((b["x"] - a["x"]) / F.nullif(unit, F.lit(0.0))).alias("x"), ((b["y"] - a["y"]) / F.nullif(unit, F.lit(0.0))).alias("y")), lambda u: F.struct(spread(p, u["x"], u["y"]).alias("w"), spread(p, -u["y"], u["x"]).alias("h")))
        return _let(side, lambda s: F.struct((s["w"] * s["h"]).alias("area"), F.greatest(s["w"], s["h"]).alias("long"), F.least(s["w"], s["h"]).alias("short")))

    best = _let(p, lambda p: F.array_min(F.filter(_ring(p, lambda a, b: box(p, a, b)), lambda s: s["area"].isNotNull())))
    return _let(best, lambda s: F.struct(s["long"].alias("long"), s["short"].alias("short")))


def contains(p: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the parity of crossings of a ray to the right."""
    def crosses(a: Column, b: Column) -> Column:
        over = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when(over & F.coalesce(x < at, F.lit(False)), 1).otherwise(0)

    return F.aggregate(_ring(p, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def placed(p: Column, theta_deg: Column, flip: Column, tx: Column, ty: Column, scale: Column | None = None) -> Column:
    """Scaled, flipped in x, rotated and moved, in this order."""
    c, s = F.cos(F.radians(theta_deg)), F.sin(F.radians(theta_deg))
    k = F.lit(1.0) if scale is None else scale
    fx = lambda v: F.when(flip, -v["x"]).otherwise(v["x"]) * k
    return F.transform(p, lambda v: point(fx(v) * c - v["y"] * k * s + tx, fx(v) * s + v["y"] * k * c + ty))


def to_metres(p: Column, px_per_metre: Column, height_px: Column) -> Column:
    """Pixels to metres, y up."""
    return F.transform(p, lambda v: point(v["x"] / px_per_metre, (height_px - v["y"]) / px_per_metre))


def wrap_degrees(a: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def vertical_fov(fov_x_deg: Column, width: Column, height: Column) -> Column:
    """Vertical field of view of a landscape picture; null for a portrait one."""
    return F.when(width >= height, F.degrees(2.0 * F.atan(F.tan(F.radians(fov_x_deg) / 2.0) * height / width)))


# Numpy: for polygons in grouped maps.


def np_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def np_contains(p: np.ndarray, x: float, y: float) -> bool:
    q = np.roll(p, -1, axis=0)
    on = (p[:, 1] > y) != (q[:, 1] > y)
    if not on.any():
        return False
    a, b = p[on], q[on]
    return bool((x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)


def _cuts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """y values between which no edge of either polygon starts, ends or crosses another."""
    a, b = np.vstack([p, q]), np.vstack([np.roll(p, -1, axis=0), np.roll(q, -1, axis=0)])
    ys = [*a[:, 1]]
    d = b - a
    for i in range(len(a)):
        den = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        ok = np.abs(den) > 1e-15
        r = a[ok] - a[i]
        t = (r[:, 0] * d[ok, 1] - r[:, 1] * d[ok, 0]) / den[ok]
        u = (r[:, 0] * d[i, 1] - r[:, 1] * d[i, 0]) / den[ok]
        ys += [*(a[i, 1] + t[(t > 0) & (t < 1) & (u > 0) & (u < 1)] * d[i, 1])]
    return np.unique(np.array(ys))


def _spans(p: np.ndarray, y: float) -> list[tuple[float, float]]:
    q = np.roll(p, -1, axis=0)
    on = (p[:, 1] > y) != (q[:, 1] > y)
    a, b = p[on], q[on]
    xs = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])) if on.any() else np.zeros(0)
    return list(zip(xs[::2], xs[1::2]))


def intersection_area(p: np.ndarray, q: np.ndarray) -> float:
    """Exact for simple polygons: between cuts, overlaps at the middle times the height."""
    ys, total = _cuts(p, q), 0.0
    for lo, hi in zip(ys, ys[1:]):
        y = (lo + hi) / 2
        right = _spans(q, y)
        total += (hi - lo) * sum(max(0.0, min(b, d) - max(a, c)) for a, b in _spans(p, y) for c, d in right)
    return total


def iou(p: np.ndarray, q: np.ndarray) -> float:
    both = intersection_area(p, q)
    whole = abs(np_area(p)) + abs(np_area(q)) - both
    return both / whole if whole > 0 else 0.0


def shared_edge_length(p: np.ndarray, q: np.ndarray, tolerance: float) -> float:
    """Length of q's edges that run along an edge of p: projections of edges that are parallel
    within ten degrees and no further away than the tolerance."""
    total = 0.0
    for a, b in zip(q, np.roll(q, -1, axis=0)):
        n = np.hypot(*(b - a))
        if n < 1e-12:
            continue
        u = (b - a) / n
        parts = []
        for c, d in zip(p, np.roll(p, -1, axis=0)):
            m = np.hypot(*(d - c))
            if m < 1e-12 or abs(u[0] * (d - c)[1] - u[1] * (d - c)[0]) > math.sin(math.radians(10)) * m:
                continue
            off = [abs(u[0] * (x - a)[1] - u[1] * (x - a)[0]) for x in (c, d)]
            lo, hi = sorted(((c - a) @ u, (d - a) @ u))
            if min(off) <= tolerance and (sum(off) / 2 <= tolerance) and hi > 0 and lo < n:
                parts.append((max(0.0, lo), min(n, hi)))
        end = 0.0
        for lo, hi in sorted(parts):
            total += max(0.0, hi - max(lo, end))
            end = max(end, hi)
    return total


def stretch_within(x0, y0, x1, y1, a0, b0, a1, b1, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Between which fractions of edges (x0, y0, x1, y1) their points are within the tolerance of walls (a0, b0,
    a1, b1), row by row; 1 and 0 where none are. What is that near to a wall is convex, so it is one stretch: of
    the strip along the wall and the discs around its ends."""
    dx, dy, wx, wy = x1 - x0, y1 - y0, a1 - a0, b1 - b0
    size = np.hypot(wx, wy)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = wx / size, wy / size
        low, high = np.zeros(len(x0)), np.where(size > 0, 1.0, -1.0)
        for start, step, least, most in (((x0 - a0) * ux + (y0 - b0) * uy, dx * ux + dy * uy, 0.0 * size, size), ((y0 - b0) * ux - (x0 - a0) * uy, dy * ux - dx * uy, 0.0 * size - tolerance, 0.0 * size + tolerance)):
            one, two = (least - start) / step, (most - start) / step
            level, inside = np.abs(step) < 1e-12, (start >= least) & (start <= most)
            low = np.maximum(low, np.where(level, np.where(inside, 0.0, 2.0), np.minimum(one, two)))
            high = np.minimum(high, np.where(level, np.where(inside, 1.0, -1.0), np.maximum(one, two)))
        stretches = [(low, high)]
        length2 = dx * dx + dy * dy
        for px, py in ((a0, b0), (a1, b1)):
            middle = ((px - x0) * dx + (py - y0) * dy) / length2
            gap2 = (x0 + middle * dx - px) ** 2 + (y0 + middle * dy - py) ** 2
            half = np.sqrt(np.where(gap2 <= tolerance**2, tolerance**2 - gap2, np.nan) / length2)
            stretches.append((np.maximum(middle - half, 0.0), np.minimum(middle + half, 1.0)))
        real = [(np.where(lo < hi, lo, np.inf), np.where(lo < hi, hi, -np.inf)) for lo, hi in stretches]
    low, high = np.min([lo for lo, _ in real], axis=0), np.max([hi for _, hi in real], axis=0)
    return np.where(low < high, low, 1.0), np.where(low < high, high, 0.0)


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a ring, cut at its first vertex and the one farthest from it."""
    if len(p) < 4:
        return p
    far = int(np.hypot(*(p - p[0]).T).argmax())
    keep = {0, far}
    ring = np.vstack([p, p[:1]])
    todo = [(0, far), (far, len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b = ring[i], ring[j]
        n = np.hypot(*(b - a))
        mid = ring[i + 1 : j]
        dist = np.hypot(*(mid - a).T) if n < 1e-12 else np.abs((b - a)[0] * (mid - a)[:, 1] - (b - a)[1] * (mid - a)[:, 0]) / n
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    out = p[sorted(k for k in keep if k < len(p))]
    return out if len(out) >= 3 else p


def representative_point(p: np.ndarray) -> tuple[float, float]:
    """The centroid if it is inside, else the middle of the widest span half way up."""
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    a = cross.sum() / 2
    c = p.mean(0) if abs(a) < 1e-9 else ((p + q) * cross[:, None]).sum(0) / (6 * a)
    if np_contains(p, *c):
        return float(c[0]), float(c[1])
    y = (p[:, 1].min() + p[:, 1].max()) / 2 + 1e-9
    lo, hi = max(_spans(p, y), key=lambda s: s[1] - s[0], default=(c[0], c[0]))
    return float((lo + hi) / 2), float(y)


def ear_clip(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (vertex numbers) of a simple polygon."""
    ids = list(range(len(p)))
    if np_area(p) < 0:
        ids.reverse()
    p = p.tolist()  # plain floats: corners are looked at one by one
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out: list[tuple[int, int, int]] = []
    while len(ids) > 3:
        for k in range(len(ids)):
            i, j, m = ids[k - 1], ids[k], ids[(k + 1) % len(ids)]
            if turn(p[i], p[j], p[m]) <= 1e-12:
                continue
            others = [v for v in ids if v not in (i, j, m)]
            if any(turn(p[i], p[j], p[v]) >= 0 and turn(p[j], p[m], p[v]) >= 0 and turn(p[m], p[i], p[v]) >= 0 for v in others):
                continue
            out.append((i, j, m))
            del ids[k]
            break
        else:
            return out  # degenerate rest
    return [*out, tuple(ids)] if len(ids) == 3 else out


def dominant_angle(p: np.ndarray, bins: int = 90) -> float:
    """Angle in [0, 90) along which most edge length lies: each edge is split between its two
    nearest bins, the circle is smoothed by three, the fullest bin wins."""
    e = np.roll(p, -1, axis=0) - p
    length, at = np.hypot(*e.T), np.degrees(np.arctan2(e[:, 1], e[:, 0])) % 90 / 90 * bins
    low = np.floor(at).astype(int)
    hist = np.bincount(low % bins, length * (1 - (at - low)), bins) + np.bincount((low + 1) % bins, length * (at - low), bins)
    return float((hist + np.roll(hist, 1) + np.roll(hist, -1)).argmax() * 90 / bins)


#: Weights that a direction is smoothed with, how many directions there are at most, how far apart in
#: degrees, from what share of all edge length, and how far an edge may be off to be turned.
SPREAD, MOST_DIRECTIONS, APART, LEAST_SHARE, OFF = (1, 2, 3, 4, 5, 4, 3, 2, 1), 4, 12.0, 0.06, 22.0


def _between(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """Degrees between two undirected lines."""
    return abs((a - b + 90.0) % 180.0 - 90.0)


def direction_weights(p: np.ndarray) -> np.ndarray:
    """Edge length by whole degrees of undirected direction, each edge split between its two nearest."""
    e = np.roll(p, -1, axis=0) - p
    length, at = np.hypot(*e.T), np.degrees(np.arctan2(e[:, 1], e[:, 0])) % 180.0
    low = np.floor(at).astype(int)
    return np.bincount(low % 180, length * (1 - (at - low)), 180) + np.bincount((low + 1) % 180, length * (at - low), 180)


def peak_directions(weights: np.ndarray) -> list[float]:
    """The directions that most edge length lies along, rising, of weights by degree: the strongest and the one
    across it, then others by strength, each with its own across where there is room. Weights are smoothed around the circle; a
    direction too near to one that is taken already goes, and so does one of too small a share. Without any length they are 0 and 90."""
    if weights.sum() <= 0:
        return [0.0, 90.0]
    reach = len(SPREAD) // 2
    smooth = sum(np.roll(weights, k - reach) * w for k, w in enumerate(SPREAD)) / sum(SPREAD)
    taken: list[float] = []
    for at in np.argsort(-smooth, kind="stable"):
        if len(taken) >= MOST_DIRECTIONS or (taken and smooth[at] < LEAST_SHARE * smooth.sum()):
            break
        for angle in (float(at), (float(at) + 90.0) % 180.0):
            if len(taken) < MOST_DIRECTIONS and all(_between(angle, t) > APART for t in taken):
                taken.append(angle)
            elif angle == at:
                break
    return sorted(taken)


def snap_to(p: np.ndarray, directions: list[float], within: float = OFF) -> tuple[np.ndarray, float]:
    """(ring, mean turn in degrees): every edge turned about its middle into the nearest of the directions, if
    it is that near, and corners rebuilt where two such edges meet. Other corners stay, as does one that would move by more than a
    quarter of the perimeter; and all of the ring, if its area would fall under two fifths."""
    p = p if np_area(p) >= 0 else p[::-1]
    e = np.roll(p, -1, axis=0) - p
    length = np.hypot(*e.T)
    angle = np.degrees(np.arctan2(e[:, 1], e[:, 0])) % 180.0
    off = np.stack([_between(angle, d) for d in directions])
    best = off.argmin(axis=0)
    turned = (off.min(axis=0) <= within) & (length > 1e-6)
    to = np.radians(np.array(directions)[best])
    normal = np.stack([-np.sin(to), np.cos(to)], axis=1)
    level = (normal * (p + e / 2)).sum(axis=1)
    out = p.copy()
    for k in np.flatnonzero(turned & np.roll(turned, 1)):
        m = np.stack([normal[k - 1], normal[k]])
        if abs(np.linalg.det(m)) > 1e-8:
            corner = np.linalg.solve(m, [level[k - 1], level[k]])
            if np.hypot(*(corner - p[k])) <= length.sum() / 4:
                out[k] = corner
    if abs(np_area(out)) < 0.4 * abs(np_area(p)):
        return p, 0.0
    return out, float(off.min(axis=0)[turned].mean()) if turned.any() else 0.0


def snap_directions(p: np.ndarray, within: float = 12.0) -> np.ndarray:
    """Edges near the dominant direction or across it are turned into it about their middles and
    corners rebuilt where neighbours meet. The original stays if a corner moves by more than a
    quarter of the perimeter or the area falls under two fifths."""
    base = dominant_angle(p)
    q = np.roll(p, -1, axis=0)
    angle = np.degrees(np.arctan2(*(q - p).T[::-1]))
    off = (angle - base + 45) % 90 - 45
    angle = np.radians(np.where(np.abs(off) <= within, angle - off, angle))
    u, mid = np.stack([np.cos(angle), np.sin(angle)], 1), (p + q) / 2
    out = p.copy()
    for k in range(len(p)):
        a, b = mid[k - 1], mid[k]
        den = u[k - 1, 0] * u[k, 1] - u[k - 1, 1] * u[k, 0]
        if abs(den) > 0.05:
            t = ((b - a)[0] * u[k, 1] - (b - a)[1] * u[k, 0]) / den
            out[k] = a + t * u[k - 1]
    moved, around = np.hypot(*(out - p).T).max(), np.hypot(*(q - p).T).sum()
    return p if moved > around / 4 or abs(np_area(out)) < 0.4 * abs(np_area(p)) else out


def pose_search(room: np.ndarray, target: np.ndarray) -> tuple[float, bool, float, float, float]:
    """(theta, flip, tx, ty, iou) that lays a room on a target: two flips by four turns about the
    centroids, then two rounds of small turns and shifts around the best."""
    def place(theta, flip, tx, ty):
        x = room - room.mean(0)
        x = x * [-1, 1] if flip else x
        c, s = math.cos(math.radians(theta)), math.sin(math.radians(theta))
        return x @ np.array([[c, s], [-s, c]]) + target.mean(0) + [tx, ty]

    tries = [(float(t), f, 0.0, 0.0) for f in (False, True) for t in (0, 90, 180, 270)]
    best = max(((iou(place(*x), target), -i, x) for i, x in enumerate(tries)), key=lambda s: s[:2])
    step, turn = 0.1 * float(np.ptp(target, axis=0).max()), 8.0
    for _ in range(2):
        t, f, tx, ty = best[2]
        near = [(t + dt, f, tx + dx, ty + dy) for dt in (-turn, 0.0, turn) for dx, dy in ((0, 0), (step, 0), (-step, 0), (0, step), (0, -step))]
        best = max([best, *((iou(place(*x), target), -99 - i, x) for i, x in enumerate(near))], key=lambda s: s[:2])
        step, turn = step / 2, turn / 2
    t, f, tx, ty = best[2]
    return t % 360, f, tx, ty, best[0]


# Batches: the functions above for many polygons of equally many corners at once, arrays of (rows, corners, 2).


#: Rows of a batch that are worked on at a time, which bounds its arrays.
BATCH_ROWS = 2_000


def batches(lengths: list[tuple[int, ...]]):
    """Row numbers of equal lengths, some at a time."""
    rows: dict[tuple[int, ...], list[int]] = {}
    for i, k in enumerate(lengths):
        rows.setdefault(k, []).append(i)
    for at in rows.values():
        for i in range(0, len(at), BATCH_ROWS):
            yield np.array(at[i : i + BATCH_ROWS])


def pairwise(p: list, q: list, f) -> tuple[np.ndarray, ...]:
    """f(polygons, polygons) of batches for lists of rings of any lengths, back in their order; f gives arrays, a value per row."""
    out: list[np.ndarray] = []
    for at in batches([(len(a), len(b)) for a, b in zip(p, q)]):
        found = f(np.array([list(p[i]) for i in at.tolist()], float), np.array([list(q[i]) for i in at.tolist()], float))
        out = out or [np.empty(len(p), v.dtype) for v in found]
        for whole, part in zip(out, found):
            whole[at] = part
    return tuple(out)


def batch_area(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=1)
    return (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(axis=1) / 2


def _batch_cuts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """_cuts of each row, rising, with inf behind the last."""
    a, b = np.concatenate([p, q], axis=1), np.concatenate([np.roll(p, -1, axis=1), np.roll(q, -1, axis=1)], axis=1)
    (ax, ay), (dx, dy) = (np.moveaxis(v, 2, 0) for v in (a, b - a))
    i, j = (slice(None), slice(None), None), (slice(None), None, slice(None))
    den = dx[i] * dy[j] - dy[i] * dx[j]
    rx, ry = ax[j] - ax[i], ay[j] - ay[i]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        t, u = (rx * dy[j] - ry * dx[j]) / den, (rx * dy[i] - ry * dx[i]) / den
        met = (np.abs(den) > 1e-15) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys = np.concatenate([ay, np.where(met, ay[i] + t * dy[i], np.inf).reshape(len(a), -1)], axis=1)
    ys.sort(axis=1)
    ys[:, 1:][ys[:, 1:] == ys[:, :-1]] = np.inf
    ys.sort(axis=1)
    return ys[:, : int(np.isfinite(ys).sum(axis=1).max(initial=1))]


def _batch_spans(p: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """_spans of each row at each of its heights (rows, heights); from inf to -inf where there are fewer."""
    a, b = p[:, None], np.roll(p, -1, axis=1)[:, None]
    y = y[:, :, None]
    on = (a[..., 1] > y) != (b[..., 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        xs = np.where(on, a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1]), np.inf)
    xs.sort(axis=2)
    return [(xs[..., k], np.where(np.isinf(xs[..., k + 1]), -np.inf, xs[..., k + 1])) for k in range(0, p.shape[1] - 1, 2)]


def batch_intersection_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    ys = _batch_cuts(p, q)
    lo, hi = ys[:, :-1], ys[:, 1:]
    there = np.isfinite(hi)
    with np.errstate(invalid="ignore"):
        y, high = np.where(there, (lo + hi) / 2, np.nan), np.where(there, hi - lo, 0.0)
    right, wide = _batch_spans(q, y), np.zeros(y.shape)
    for a, b in _batch_spans(p, y):
        for c, d in right:
            wide += np.maximum(0.0, np.minimum(b, d) - np.maximum(a, c))
    total = np.zeros(len(p))
    for k in range(y.shape[1]):
        total += high[:, k] * wide[:, k]
    return total


def batch_iou(p: np.ndarray, q: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
    both = batch_intersection_area(p, q) if both is None else both
    whole = np.abs(batch_area(p)) + np.abs(batch_area(q)) - both
    return np.where(whole > 0, both / np.where(whole > 0, whole, 1.0), 0.0)


def batch_shared_edge_length(p: np.ndarray, q: np.ndarray, tolerance: float) -> np.ndarray:
    total, d = np.zeros(len(p)), np.roll(p, -1, axis=1)
    e = d - p
    m = np.hypot(e[..., 0], e[..., 1])
    for k in range(q.shape[1]):
        a, b = q[:, k], q[:, (k + 1) % q.shape[1]]
        n = np.hypot(*(b - a).T)
        u = (b - a) / np.where(n < 1e-12, 1.0, n)[:, None]
        ux, uy, n = u[:, :1], u[:, 1:], n[:, None]
        level = (m >= 1e-12) & (n >= 1e-12) & (np.abs(ux * e[..., 1] - uy * e[..., 0]) <= math.sin(math.radians(10)) * m)
        off = [np.abs(ux * (x[..., 1] - a[:, 1:]) - uy * (x[..., 0] - a[:, :1])) for x in (p, d)]
        at = [(x[..., 0] - a[:, :1]) * ux + (x[..., 1] - a[:, 1:]) * uy for x in (p, d)]
        lo, hi = np.minimum(*at), np.maximum(*at)
        near = level & (np.minimum(*off) <= tolerance) & ((off[0] + off[1]) / 2 <= tolerance) & (hi > 0) & (lo < n)
        lo, hi = np.where(near, np.maximum(0.0, lo), np.inf), np.where(near, np.minimum(n, hi), -np.inf)
        order = np.lexsort((hi, lo), axis=1)
        lo, hi, end = np.take_along_axis(lo, order, 1), np.take_along_axis(hi, order, 1), np.zeros(len(p))
        for i in range(p.shape[1]):
            total += np.maximum(0.0, hi[:, i] - np.maximum(lo[:, i], end))
            end = np.maximum(end, hi[:, i])
    return total


def batch_pose_search(room: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """pose_search of each row, its tries one after the other for all rows."""
    size = len(room)
    x, centre = room - room.mean(axis=1, keepdims=True), target.mean(axis=1, keepdims=True)
    mirrored = x * [-1, 1]

    def score(theta, flip, tx, ty):
        angles, at = np.unique(theta, return_inverse=True)
        turns = np.array([[[c, s], [-s, c]] for c, s in ((math.cos(math.radians(t)), math.sin(math.radians(t))) for t in angles.tolist())])
        return batch_iou(np.where(flip[:, None, None], mirrored, x) @ turns[at] + centre + np.stack([tx, ty], axis=1)[:, None], target)

    full = lambda v: np.full(size, v)
    best = [full(-1.0), full(-1000), full(0.0), full(False), full(0.0), full(0.0)]  # iou, rank, theta, flip, tx, ty

    def offer(rank, *pose):
        found = [score(*pose), full(rank), *pose]
        better = (found[0] > best[0]) | ((found[0] == best[0]) & (found[1] > best[1]))
        best[:] = [np.where(better, new, old) for new, old in zip(found, best)]

    for i, (f, t) in enumerate((f, t) for f in (False, True) for t in (0, 90, 180, 270)):
        offer(-i, full(float(t)), full(f), full(0.0), full(0.0))
    step, turn, still = 0.1 * np.ptp(target, axis=1).max(axis=1), 8.0, np.zeros(size)
    for _ in range(2):
        _, _, t, f, tx, ty = best
        near = [(t + dt, f, tx + dx, ty + dy) for dt in (-turn, 0.0, turn) for dx, dy in ((still, still), (step, still), (-step, still), (still, step), (still, -step))]
        for i, pose in enumerate(near):
            offer(-99 - i, *pose)
        step, turn = step / 2, turn / 2
    return best[2] % 360, best[3], best[4], best[5], best[0]


def batch_contains(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """np_contains of each row's point."""
    a, b, x, y = p, np.roll(p, -1, axis=1), x[:, None], y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1])
    return (((a[..., 1] > y) != (b[..., 1] > y)) & (x < at)).sum(axis=1) % 2 == 1


def batch_representative_point(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.roll(p, -1, axis=1)
    cross = p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]
    a = cross.sum(axis=1) / 2
    thin = np.abs(a) < 1e-9
    c = np.where(thin[:, None], p.mean(axis=1), ((p + q) * cross[..., None]).sum(axis=1) / (6 * np.where(thin, 1.0, a))[:, None])
    y = (p[..., 1].min(axis=1) + p[..., 1].max(axis=1)) / 2 + 1e-9
    lo, hi = (np.stack([s[k][:, 0] for s in _batch_spans(p, y[:, None])], axis=1) for k in (0, 1))
    widest = (hi - lo).argmax(axis=1)[:, None]
    lo, hi = np.take_along_axis(lo, widest, 1)[:, 0], np.take_along_axis(hi, widest, 1)[:, 0]
    with np.errstate(invalid="ignore"):
        other = np.where(lo <= hi, (lo + hi) / 2, c[:, 0])
    inside = batch_contains(p, c[:, 0], c[:, 1])
    return np.where(inside, c[:, 0], other), np.where(inside, c[:, 1], y)


def batch_dominant_angle(p: np.ndarray, bins: int = 90) -> np.ndarray:
    e = np.roll(p, -1, axis=1) - p
    length, at = np.hypot(e[..., 0], e[..., 1]), np.degrees(np.arctan2(e[..., 1], e[..., 0])) % 90 / 90 * bins
    low = np.floor(at).astype(int)
    own = np.arange(len(p))[:, None] * bins
    count = lambda b, w: np.bincount((own + b % bins).ravel(), w.ravel(), len(p) * bins).reshape(len(p), bins)
    hist = count(low, length * (1 - (at - low))) + count(low + 1, length * (at - low))
    return (hist + np.roll(hist, 1, axis=1) + np.roll(hist, -1, axis=1)).argmax(axis=1) * 90 / bins


def batch_snap_directions(p: np.ndarray, within: float = 12.0) -> np.ndarray:
    base, q = batch_dominant_angle(p)[:, None], np.roll(p, -1, axis=1)
    angle = np.degrees(np.arctan2((q - p)[..., 1], (q - p)[..., 0]))
    off = (angle - base + 45) % 90 - 45
    angle = np.radians(np.where(np.abs(off) <= within, angle - off, angle))
    u, mid = np.stack([np.cos(angle), np.sin(angle)], axis=2), (p + q) / 2
    before, gap = np.roll(u, 1, axis=1), mid - np.roll(mid, 1, axis=1)
    den = before[..., 0] * u[..., 1] - before[..., 1] * u[..., 0]
    meet = np.abs(den) > 0.05
    t = (gap[..., 0] * u[..., 1] - gap[..., 1] * u[..., 0]) / np.where(meet, den, 1.0)
    out = np.where(meet[..., None], np.roll(mid, 1, axis=1) + t[..., None] * before, p)
    moved, around = np.hypot(*np.moveaxis(out - p, 2, 0)).max(axis=1), np.hypot(*np.moveaxis(q - p, 2, 0)).sum(axis=1)
    stays = (moved > around / 4) | (np.abs(batch_area(out)) < 0.4 * np.abs(batch_area(p)))
    return np.where(stays[:, None, None], p, out)


def batch_direction_weights(p: np.ndarray) -> np.ndarray:
    """direction_weights of each row: (rows, 180)."""
    e = np.roll(p, -1, axis=1) - p
    length, at = np.hypot(e[..., 0], e[..., 1]), np.degrees(np.arctan2(e[..., 1], e[..., 0])) % 180.0
    low = np.floor(at).astype(int)
    own = np.arange(len(p))[:, None] * 180
    count = lambda b, w: np.bincount((own + b % 180).ravel(), w.ravel(), len(p) * 180).reshape(len(p), 180)
    return count(low, length * (1 - (at - low))) + count(low + 1, length * (at - low))


def batch_snap_to(p: np.ndarray, directions: np.ndarray, within: float = OFF) -> tuple[np.ndarray, np.ndarray]:
    """snap_to of each row into its own directions (rows, directions): rings and mean turns."""
    p = np.where((batch_area(p) >= 0)[:, None, None], p, p[:, ::-1])
    e = np.roll(p, -1, axis=1) - p
    length = np.hypot(e[..., 0], e[..., 1])
    angle = np.degrees(np.arctan2(e[..., 1], e[..., 0])) % 180.0
    off = _between(angle[:, None], directions[:, :, None])
    least = off.min(axis=1)
    turned = (least <= within) & (length > 1e-6)
    to = np.radians(np.take_along_axis(directions, off.argmin(axis=1), 1))
    normal = np.stack([-np.sin(to), np.cos(to)], axis=2)
    level = (normal * (p + e / 2)).sum(axis=2)
    m = np.stack([np.roll(normal, 1, axis=1), normal], axis=2)
    meet = turned & np.roll(turned, 1, axis=1) & (np.abs(np.linalg.det(m)) > 1e-8)
    corner = np.linalg.solve(np.where(meet[..., None, None], m, np.eye(2)), np.stack([np.roll(level, 1, axis=1), level], axis=2)[..., None])[..., 0]
    near = np.hypot(*np.moveaxis(corner - p, 2, 0)) <= (length.sum(axis=1) / 4)[:, None]
    out = np.where((meet & near)[..., None], corner, p)
    lost = np.abs(batch_area(out)) < 0.4 * np.abs(batch_area(p))
    turn = np.where(turned, least, 0.0).sum(axis=1) / np.maximum(1, turned.sum(axis=1))
    return np.where(lost[:, None, None], p, out), np.where(lost, 0.0, turn)


def batch_peak_directions(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """peak_directions of each row of weights by degree: how many, and (rows, most) of them, rising, inf behind the last."""
    rows, reach = np.arange(len(weights)), len(SPREAD) // 2
    smooth = sum(np.roll(weights, k - reach, axis=1) * w for k, w in enumerate(SPREAD)) / sum(SPREAD)
    total, some = smooth.sum(axis=1), weights.sum(axis=1) > 0
    taken, n = np.full((len(weights), MOST_DIRECTIONS), np.inf), np.zeros(len(weights), int)
    left, around = np.where(some[:, None], smooth, -np.inf), np.arange(-int(APART), int(APART) + 1)

    def take(at: np.ndarray, angle: np.ndarray) -> None:
        taken[at, n[at]] = angle
        n[at] += 1
        left[at[:, None], (angle[:, None] + around) % 180] = -np.inf

    for _ in range(MOST_DIRECTIONS):
        angle = left.argmax(axis=1)
        best = left[rows, angle]
        at = np.flatnonzero((n < MOST_DIRECTIONS) & (best > -np.inf) & ((n == 0) | (best >= LEAST_SHARE * total)))
        if not len(at):
            break
        take(at, angle[at])
        across = (angle[at] + 90) % 180
        free = (n[at] < MOST_DIRECTIONS) & (left[at, across] > -np.inf)
        take(at[free], across[free])
    taken[~some, :2], n[~some] = (0.0, 90.0), 2
    return n, np.sort(taken, axis=1)


def batch_ear_clip(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ear_clip of counter-clockwise rings of equally many corners: (rows, corners - 2, 3) triangles, and how many there are."""
    size, n = p.shape[:2]
    out, count, rows = np.zeros((size, max(0, n - 2), 3), int), np.zeros(size, int), np.arange(size)
    ids = np.tile(np.arange(n), (size, 1))
    turn = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    while ids.shape[1] > 3 and len(rows):
        m = ids.shape[1]
        b = p[rows[:, None], ids]
        a, c = np.roll(b, 1, axis=1), np.roll(b, -1, axis=1)
        v, (i, j, k) = b[:, None], (w[:, :, None] for w in (a, b, c))
        inside = (turn(i, j, v) >= 0) & (turn(j, k, v) >= 0) & (turn(k, i, v) >= 0)
        near = np.abs((np.arange(m)[:, None] - np.arange(m) + m // 2) % m - m // 2) <= 1
        ear = (turn(a, b, c) > 1e-12) & ~(inside & ~near).any(axis=2)
        some = ear.any(axis=1)
        rows, ids, at = rows[some], ids[some], ear[some].argmax(axis=1)
        one = np.arange(len(rows))
        out[rows, count[rows]] = np.stack([ids[one, at - 1], ids[one, at], ids[one, (at + 1) % m]], axis=1)
        count[rows] += 1
        ids = ids[np.arange(m) != at[:, None]].reshape(len(rows), m - 1)
    if ids.shape[1] == 3:
        out[rows, count[rows]] = ids
        count[rows] += 1
    return out, count
