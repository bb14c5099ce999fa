"""Unions of many small groups of polygons at once: numpy on flat arrays, group by group in order. The steps are those of
operators/outlines.py, where groups of any size are swept by Spark."""

from __future__ import annotations

import math

import numpy as np

#: Pairs of edges, and pieces of edges between cuts, that are held at a time.
AT_ONCE = 2_000_000
#: Walls at least so long are along an axis or not, whatever the rounding.
LONG = 1e-5


def rounded(v: np.ndarray, decimals: int) -> np.ndarray:
    """Halves away from zero."""
    scale = 10.0**decimals
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.copysign(np.floor(np.abs(v) * scale + 0.5) / scale, v) + 0.0
    return np.where(np.abs(v) * scale < 2.0**52, near, v)


def firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def following(sizes: np.ndarray) -> np.ndarray:
    """Number of the next corner of each ring's corner."""
    after = np.arange(int(sizes.sum())) + 1
    real = sizes > 0
    first = firsts(sizes)[real]
    after[first + sizes[real] - 1] = first
    return after


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, k) with k from 0 to n[row] - 1 of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(firsts(n), n)


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of rows in the order of their keys, and the first row of each."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.empty(len(order), int)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _crossings(group, x0, y0, x1, y1, decimals):
    """group and height of where edges cross, one of which isn't upright. Edges are in the order of groups."""
    sloped = np.flatnonzero(x0 != x1)
    found = [(np.zeros(0, group.dtype), np.zeros(0))]
    if not len(sloped):
        return found[0]
    first, end = np.searchsorted(group, group[sloped], "left"), np.searchsorted(group, group[sloped], "right")
    upto = np.cumsum(end - first)
    is_sloped = x0 != x1
    for k in range(0, int(upto[-1]), AT_ONCE):
        at = np.arange(k, min(k + AT_ONCE, int(upto[-1])))
        s = np.searchsorted(upto, at, side="right")
        a, b = sloped[s], first[s] + at - (upto[s] - (end - first)[s])
        met = (~is_sloped[b] | (a < b)) & (np.maximum(y0[a], y0[b]) <= np.minimum(y1[a], y1[b]))
        a, b = a[met], b[met]
        swap, level = np.zeros(len(a), bool), np.ones(len(a), bool)
        for c in (x0, y0, x1, y1):
            swap |= level & (c[a] > c[b])
            level &= c[a] == c[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        dx, dy, ex, ey, rx, ry = x1[a] - x0[a], y1[a] - y0[a], x1[b] - x0[b], y1[b] - y0[b], x0[b] - x0[a], y0[b] - y0[a]
        with np.errstate(divide="ignore", invalid="ignore"):
            den = dx * ey - dy * ex
            t, u = (rx * ey - ry * ex) / den, (rx * dy - ry * dx) / den
            hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        found.append((group[a[hit]], rounded((y0[a] + t * dy)[hit], decimals)))
    return tuple(map(np.concatenate, zip(*found)))


def boundary(of: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, decimals: int) -> tuple[np.ndarray, ...]:
    """group, x0, y0, x1, y1: the directed boundary of each group's union, which lies to the left. of: rising group numbers of
    rings, sizes: their corners; x and y: all corners, ring by ring."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    after, ring = following(sizes), np.repeat(np.arange(len(sizes)), sizes)
    back = np.bincount(ring, x * y[after] - x[after] * y, len(sizes)) < 0
    x, y = rounded(x, decimals), rounded(y, decimals)
    keep = (sizes[ring] >= 3) & np.isfinite(x + y + x[after] + y[after]) & (y != y[after])
    p, q, group, back = np.flatnonzero(keep), after[keep], of[ring[keep]], back[ring[keep]]
    p, q = np.where(back, q, p), np.where(back, p, q)
    down = y[p] > y[q]
    low, high = np.where(down, q, p), np.where(down, p, q)
    x0, y0, x1, y1, turn = x[low], y[low], x[high], y[high], np.where(down, 1, -1)
    n = len(group)
    cross_g, cross_y = _crossings(group, x0, y0, x1, y1, decimals)
    gs, ys = np.concatenate([group, group, cross_g]), np.concatenate([y0, y1, cross_y])
    number, rows = _numbered(gs, ys)
    k0, k1, cut_y, cut_g = number[:n], number[n : 2 * n], ys[rows], gs[rows]
    # pieces of edges, some cuts at a time
    crossing = np.cumsum(np.bincount(k0, minlength=len(rows) + 1) - np.bincount(k1, minlength=len(rows) + 1)) if n else np.zeros(1, int)
    total, strips, c = np.concatenate([[0], np.cumsum(crossing)]), [], 0
    while c < len(rows):
        d = max(c + 1, int(np.searchsorted(total, total[c] + AT_ONCE, side="right")) - 1)
        d = min(d, len(rows))
        some = np.flatnonzero((k0 < d) & (k1 > c)) if c or d < len(rows) else np.arange(n)
        a = np.maximum(k0[some], c)
        e, k = counted(np.minimum(k1[some], d) - a)
        k = a[e] + k
        e = some[e]
        strips.append(_strips(k, cut_y[k], cut_y[np.minimum(k + 1, len(rows) - 1)], x0[e], y0[e], x1[e], y1[e], turn[e], decimals))
        c = d
    if not strips:
        return np.zeros(0, of.dtype), *[np.zeros(0)] * 4
    k, lo, hi, x_lo, x_hi, left = map(np.concatenate, zip(*strips))
    side = lambda a, b: np.where(left, a, b)
    sides = (cut_g[k], side(x_hi, x_lo), side(hi, lo), side(x_lo, x_hi), side(lo, hi))
    # along a cut, the boundary leads from side to side: what begins above it less what ends below it flows to the right
    fk, fx, flow = np.concatenate([k, k + 1]), np.concatenate([x_lo, x_hi]), np.concatenate([side(1, -1), side(-1, 1)])
    number, rows = _numbered(fk, fx)
    fk, fx, flow = fk[rows], fx[rows], np.bincount(number, flow, len(rows)).astype(int)
    net = _running(fk, flow)
    at = np.flatnonzero((net[:-1] != 0) & (fk[1:] == fk[:-1]))
    at = np.repeat(at, np.abs(net[at]))
    here, there, right = fx[at], fx[at + 1], net[at] > 0
    height = cut_y[fk[at]]
    flat = (cut_g[fk[at]], np.where(right, here, there), height, np.where(right, there, here), height)
    return tuple(np.concatenate(v) for v in zip(sides, flat))


def _running(key: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Running sum of v within equal keys, which are together."""
    total = np.cumsum(v)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    return total - np.repeat((total - v)[start], np.diff(np.append(start, len(key)))) if len(key) else total


def _strips(k, lo, hi, x0, y0, x1, y1, turn, decimals):
    """k, lo, hi, x_lo, x_hi, left: pieces that bound the union."""
    def at(h):
        with np.errstate(invalid="ignore"):
            return rounded(np.where(h == y0, x0, np.where(h == y1, x1, np.where(x0 == x1, x0, x0 + (x1 - x0) * ((h - y0) / (y1 - y0))))), decimals)

    x_lo, x_hi = at(lo), at(hi)
    order = np.lexsort((x_lo, x_lo + x_hi, k))
    k, lo, hi, x_lo, x_hi, turn = (v[order] for v in (k, lo, hi, x_lo, x_hi, turn))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (x_lo[1:] != x_lo[:-1]) | (x_hi[1:] != x_hi[:-1])
    start = np.flatnonzero(new)
    turn = np.add.reduceat(turn, start) if len(start) else turn
    after = _running(k[start], turn)
    before = after - turn
    bounds = (after != 0) != (before != 0)
    at_ = start[bounds]
    return k[at_], lo[at_], hi[at_], x_lo[at_], x_hi[at_], before[bounds] == 0


def _next(vertex: np.ndarray, to: np.ndarray, x0, y0, x1, y1) -> np.ndarray:
    """The edge after each: of those that leave its end, the sharpest turn to the left. Edges are in order of vertex, the number
    of where they begin."""
    first, count = np.searchsorted(vertex, to, "left"), np.bincount(vertex, minlength=int(max(vertex.max(), to.max())) + 1)[to]
    after = np.where(count > 0, first, -1)
    many = np.flatnonzero(count > 1)
    if len(many):
        row, k = counted(count[many])
        e, f = many[row], first[many][row] + k
        turn = (np.arctan2(y0[e] - y1[e], x0[e] - x1[e]) - np.arctan2(y1[f] - y0[f], x1[f] - x0[f])) % (2 * math.pi)
        turn[turn == 0] = 2 * math.pi
        order = np.lexsort((f, turn, e))
        one = np.ones(len(order), bool)
        one[1:] = e[order][1:] != e[order][:-1]
        after[e[order][one]] = f[order][one]
    return after


def rings(group, x0, y0, x1, y1, bent, trace, thin: float) -> tuple[np.ndarray, ...]:
    """group, area, corners, x, y of the rings of directed edges, area signed and rings of each group largest first. bent drops the corners
    of a ring that don't turn; trace follows a group's edges one by one, where they don't pair at a corner. Rings not wider than thin are none."""
    none = (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0))
    if not len(group):
        return none
    order = np.lexsort((y1, x1, y0, x0, group))
    group, x0, y0, x1, y1 = (v[order] for v in (group, x0, y0, x1, y1))
    n = len(group)
    vertex, _ = _numbered(np.concatenate([group, group]), np.concatenate([x0, x1]), np.concatenate([y0, y1]))
    vertex, to = vertex[:n], vertex[n:]
    after = _next(vertex, to, x0, y0, x1, y1)
    into = np.bincount(after[after >= 0], minlength=n)
    odd = np.unique(np.concatenate([group[after < 0], group[into != 1]]))
    extra: list[tuple] = []
    if len(odd):
        for one in odd:
            at = slice(*np.searchsorted(group, [one, one + 1]))
            extra += [(int(one), a, ring) for a, ring in trace(zip(*[v[at].tolist() for v in (x0, y0, x1, y1)]))]
        keep = ~np.isin(group, odd)
        shift = np.cumsum(keep) - 1
        group, x0, y0, x1, y1, vertex, after = (v[keep] for v in (group, x0, y0, x1, y1, vertex, after))
        after, n = shift[after], len(group)
    found = _cycles(group, x0, y0, x1, y1, vertex, after, bent) if n else none[:1] + none[2:]
    of, sizes, x, y = found
    if extra:
        of, sizes = np.concatenate([of, [g for g, _, _ in extra]]).astype(int), np.concatenate([sizes, [len(r) for _, _, r in extra]]).astype(int)
        x, y = (np.concatenate([v, [p[c] for _, _, r in extra for p in r]]) for c, v in enumerate((x, y)))
    ring, nxt = np.repeat(np.arange(len(sizes)), sizes), following(sizes)
    area = np.bincount(ring, x * y[nxt] - x[nxt] * y, len(sizes)) / 2
    around = np.bincount(ring, np.hypot(x[nxt] - x, y[nxt] - y), len(sizes))
    start = firsts(sizes)
    kept = np.flatnonzero((sizes >= 3) & (np.abs(area) > thin * around))
    if not len(kept):
        return none
    least = [np.minimum.reduceat(v, start[sizes > 0]) for v in (x, y)]
    dense = np.cumsum(sizes > 0) - 1
    kept = kept[np.lexsort((least[1][dense[kept]], least[0][dense[kept]], -np.abs(area[kept]), of[kept]))]
    row, k = counted(sizes[kept])
    at = start[kept][row] + k
    return of[kept], area[kept], sizes[kept], x[at], y[at]


def _cycles(group, x0, y0, x1, y1, vertex, after, bent):
    """group, corners, x, y of rings that go from their least corner back to it."""
    n = len(group)
    root, jump, most = np.arange(n), after, int(np.bincount(group).max())
    for _ in range(max(1, math.ceil(math.log2(most + 1)))):
        root = np.minimum(root, root[jump])
        jump = jump[jump]
    place, here, step = np.zeros(n, int), np.flatnonzero(root == np.arange(n)), 0
    while len(here):
        place[here] = step
        here, step = after[here], step + 1
        here = here[root[here] != here]
    order = np.argsort(root * (step + 1) + place, kind="stable")
    root, vertex = root[order], vertex[order]
    ring = np.cumsum(vertex == vertex[np.searchsorted(root, root, "left")]) - 1
    group, x0, y0, x1, y1 = (v[order] for v in (group, x0, y0, x1, y1))
    sizes = np.bincount(ring)
    start, prior = firsts(sizes), np.arange(n) - 1
    prior[start] = start + sizes - 1
    dx, dy = x1 - x0, y1 - y0
    ways = np.where(dx != 0, np.sign(dx), 2 * np.sign(dy))
    plain = ((dx == 0) != (dy == 0)) & (np.abs(dx) + np.abs(dy) > LONG) & (ways != -ways[prior])
    whole = np.bincount(ring, ~plain, len(sizes)) == 0
    corner = whole[ring] & (ways != ways[prior])
    of, kept, x, y = group[start], np.bincount(ring, corner, len(sizes)).astype(int), x0[corner], y0[corner]
    if whole.all():
        return of, kept, x, y
    bends = [bent(list(zip(x0[s : s + k].tolist(), y0[s : s + k].tolist()))) for s, k in zip(start[~whole].tolist(), sizes[~whole].tolist())]
    more = np.array([len(b) for b in bends], int)
    flat = np.array([p for b in bends for p in b], float).reshape(-1, 2)
    return np.concatenate([of[whole], of[~whole]]), np.concatenate([kept[whole], more]), np.concatenate([x, flat[:, 0]]), np.concatenate([y, flat[:, 1]])
