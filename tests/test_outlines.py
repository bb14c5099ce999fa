"""Unions, outlines on walls, patches and neighbours against brute force on small fixtures."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import meshes, outlines, proximity

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


FRAME = [box(0, 0, 6, 1), box(0, 5, 6, 1), box(0, 0, 1, 6), box(5, 0, 1, 6)]
SHAPES = {
    "two": [box(0, 0, 2, 2), box(1, 1, 2, 2)],
    "touch": [box(0, 0, 2, 2), box(2, 0, 3, 2)],
    "frame": FRAME,
    "frame and core": [*FRAME, box(2, 2, 1, 1)],
    "corner": [box(0, 0, 1, 1), box(1, 1, 1, 1)],
    "star": [ring((0, 0), (4, 0), (2, 3)), ring((0, 2), (4, 2), (2, -1))],
    "clockwise": [box(0, 0, 2, 2)[::-1], box(0, 0, 2, 2)],
    "inside": [box(0, 0, 9, 9), box(2, 2, 3, 3)],
    "line": [ring((0, 0), (1, 0))],
}
#: Area, and of each ring whether it is a hole, its area and its corners.
WANT = {
    "two": (7, [(False, 7, 8)]),
    "touch": (10, [(False, 10, 4)]),
    "frame": (20, [(False, 36, 4), (True, 16, 4)]),
    "frame and core": (21, [(False, 36, 4), (True, 16, 4), (False, 1, 4)]),
    "corner": (2, [(False, 1, 4), (False, 1, 4)]),
    "star": (8, [(False, 8, 12)]),
    "clockwise": (4, [(False, 4, 4)]),
    "inside": (81, [(False, 81, 4)]),
}


def polygons(spark, shapes):
    rows = [(name, i, p) for name, ps in shapes.items() for i, p in enumerate(ps)] + [("none", 0, None), ("none", 1, [])]
    return spark.createDataFrame(rows, f"plan string, room int, polygon {RING}")


def test_outlines_of_shapes(spark):
    df = polygons(spark, SHAPES)
    assert {r["plan"]: round(r["area"], 6) for r in outlines.union_area(df, ["plan"]).collect()} == {k: a for k, (a, _) in WANT.items()}
    got = {}
    for r in outlines.union_outlines(df, ["plan"]).orderBy("plan", "ring").collect():
        got.setdefault(r["plan"], []).append((r["hole"], round(r["area"], 6), len(r["points"])))
        assert (g.np_area(np.array(r["points"])) < 0) == r["hole"]
    assert got == {k: rings for k, (_, rings) in WANT.items()}


def test_outlines_of_random_polygons(spark):
    rng = np.random.default_rng(5)
    shapes = {}
    for n in range(5):
        shapes[f"r{n}"] = []
        for _ in range(6):
            at, angle, reach = rng.uniform(0, 6, 2), (np.arange(7) + rng.uniform(0, 0.8, 7)) * 2 * np.pi / 7, rng.uniform(1, 3, 7)
            shapes[f"r{n}"].append(ring(*np.stack([at[0] + reach * np.cos(angle), at[1] + reach * np.sin(angle)], 1).round(3)))
    df = polygons(spark, shapes)
    area = {r["plan"]: r["area"] for r in outlines.union_area(df, ["plan"]).collect()}
    rings = {}
    for r in outlines.union_outlines(df, ["plan"]).collect():
        rings.setdefault(r["plan"], []).append(np.array(r["points"]))
    for name, ps in shapes.items():
        ps = [np.array(p) for p in ps]
        q = rng.uniform(-3, 9, (1500, 2))
        inside = np.array([any(g.np_contains(p, *x) for p in ps) for x in q])
        traced = np.array([sum(g.np_contains(r, *x) for r in rings[name]) % 2 == 1 for x in q])
        assert (inside == traced).mean() > 0.998
        assert sum(map(g.np_area, rings[name])) == pytest.approx(area[name], abs=1e-3)
    two = {k: ps[:2] for k, ps in shapes.items()}
    for r in outlines.union_area(polygons(spark, two), ["plan"]).collect():
        p, q = (np.array(x) for x in two[r["plan"]])
        whole = abs(g.np_area(p)) + abs(g.np_area(q)) - g.intersection_area(p, q)
        assert r["area"] == pytest.approx(whole, abs=1e-4)


def test_layout_of_a_moved_plan(spark):
    rooms = [("a", "k", box(0, 0, 4, 3)), ("a", "l", box(4, 0, 2, 3)), ("b", "k", box(0, 0, 2, 2))]
    built = spark.createDataFrame(rooms, f"plan string, room_id string, polygon {RING}")
    plan = spark.createDataFrame([("a", "k", box(10, 7, 4, 3)), ("a", "m", box(14, 7, 2, 3))], f"plan string, plan_room_id string, polygon {RING}")
    matches = spark.createDataFrame([("a", "k", "k"), ("a", "l", "gone")], "plan string, room_id string, plan_room_id string")
    got = {r["plan"]: tuple(r)[1:] for r in outlines.layout_iou(built, plan, matches, "plan").collect()}
    assert got["a"][0] == pytest.approx(1.0) and got["a"][1:] == (2, 0.0) and got["b"] == (None, 1, None)


def test_small_layouts_are_measured_in_a_row_as_large_ones_by_spark(spark):
    rng = np.random.default_rng(6)
    rows = [(k // 4, f"r{k % 4}", box(*(rng.integers(0, 8, 2) / 2).tolist(), *rng.integers(1, 6, 2).tolist())) for k in range(48)]
    rows += [(20, "t", ring((0, 0), (5, 1), (2, 4))), (20, "u", ring((0, 0), (1, 0))), (21, "only", box(0, 0, 1, 1))]
    other = [(k, name, ring(*[(x * 1.25 + 3, y + 1) for x, y in p])) for k, name, p in rows if k != 21] + [(20, "t", box(0, 0, 3, 3))]
    built, plan = (spark.createDataFrame(side, f"plan int, {name} string, polygon {RING}") for side, name in ((rows, "room_id"), (other, "plan_room_id")))
    matches = spark.createDataFrame([(k, name, f"r{i % 4}" if k < 20 else name) for i, (k, name, _) in enumerate(rows)] + [(3, "r1", "r0"), (4, "r1", None), (5, "gone", "r1")], "plan int, room_id string, plan_room_id string")
    plain = lambda df: {r["plan"]: (None if r["iou"] is None else round(r["iou"], 8), r["rooms"], r["median_room_iou"]) for r in df.collect()}
    small = outlines.layout_iou(built, plan, matches, "plan")
    assert small._jdf.queryExecution().executedPlan().toString().count("Window") == 0 and "parquet" not in small._jdf.queryExecution().toString()
    assert plain(small) == plain(outlines._layout_swept(built, plan, matches, "plan"))


def test_outlines_are_traced_in_batches(spark):
    """A call for each group took most of the time."""
    df = polygons(spark, SHAPES)
    assert "FlatMapGroups" not in outlines.union_outlines(df, ["plan"])._jdf.queryExecution().toString()


def test_small_groups_are_swept_in_a_row_as_large_ones_by_spark(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(name, p) for name, ps in SHAPES.items() for p in ps] + [(f"r{k // 5}", box(*(rng.integers(0, 12, 2) / 2).tolist(), *rng.integers(1, 6, 2).tolist())) for k in range(60)]
    rows += [(f"f{k // 4}", ring(*map(tuple, (rng.uniform(0, 8, 2) + rng.uniform(0, 5, (3, 2))).round(2).tolist()))) for k in range(40)] + [(None, box(0, 0, 1, 1)), ("n", None)]
    df = spark.createDataFrame(rows, f"plan string, polygon {RING}")
    small = outlines.union_outlines(df, ["plan"])
    plan = small._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange ") == 1
    found = lambda out: sorted((r["plan"], r["ring"], r["hole"], round(r["area"], 6), tuple((round(p["x"], 5) + 0.0, round(p["y"], 5) + 0.0) for p in r["points"])) for r in out.collect())
    swept = found(outlines._outlines_swept(df, ["plan"], "polygon"))
    assert len(swept) > 30 and found(small) == swept
    monkeypatch.setattr(outlines, "FEW_IN_ALL", 12)
    assert found(outlines.union_outlines(df, ["plan"])) == swept


def test_small_pairs_are_measured_in_batches_and_large_ones_swept(spark):
    wave = ring(*[(k, k % 2) for k in range(40)], (39, 5), (0, 5))
    rows = [(0, box(0, 0, 4, 3), box(2, 0, 4, 3)), (1, box(0, 0, 4, 3), box(9, 9, 1, 1)), (2, wave, wave), (3, wave, box(0, 2, 39, 3)), (4, ring((0, 0), (1, 0)), box(0, 0, 1, 1))]
    df = spark.createDataFrame(rows, f"row int, p {RING}, q {RING}")
    got = {r["row"]: round(r["iou"], 9) for r in outlines._pair_iou(df, ["row"], "p", "q").collect()}
    assert got == {0: round(1 / 3, 9), 1: 0.0, 2: 1.0, 3: round(117 / 175.5, 9), 4: 0.0}
    small = outlines._pair_iou(df.filter("row < 2"), ["row"], "p", "q")
    assert "ArrowEvalPython" in small._jdf.queryExecution().toString() and "Join" not in small._jdf.queryExecution().toString()


def test_outline_fit_against_samples(spark):
    rng = np.random.default_rng(2)
    rooms = [("p", k, ring(*(rng.uniform(0, 20, 2) + rng.uniform(0, 6, (3, 2))).round(2))) for k in range(12)]
    walls = [("p", *rng.uniform(0, 25, 4).round(2).tolist()) for _ in range(25)] + [("p", 3.0, 3.0, 3.0, 3.0), ("q", 0.0, 0.0, 9.0, 9.0)]
    got = {r["room_id"]: r["fit"] for r in outlines.outline_fit(spark.createDataFrame(rooms, f"plan string, room_id int, polygon {RING}"), spark.createDataFrame(walls, "plan string, x0 double, y0 double, x1 double, y1 double"), ["plan"], "room_id", tolerance=0.7).collect()}
    for _, k, p in rooms:
        p = np.array(p)
        q = np.roll(p, -1, axis=0)
        n = 2000
        share = np.hypot(*(q - p).T) / np.hypot(*(q - p).T).sum()
        near = 0.0
        for a, b, part in zip(p, q, share):
            x = a + (np.arange(n)[:, None] + 0.5) / n * (b - a)
            hit = np.zeros(n, bool)
            for name, x0, y0, x1, y1 in walls:
                if name == "p":
                    d = np.array([x1 - x0, y1 - y0])
                    t = np.clip(((x - [x0, y0]) @ d) / max(d @ d, 1e-12), 0, 1)
                    hit |= np.hypot(*(x - [x0, y0] - t[:, None] * d).T) <= 0.7
            near += part * hit.mean()
        assert got[k] == pytest.approx(near, abs=2e-3)
    alone = outlines.outline_fit(spark.createDataFrame(rooms[:1], f"plan string, room_id int, polygon {RING}"), spark.createDataFrame([], "plan string, x0 double, y0 double, x1 double, y1 double"), ["plan"], "room_id").collect()
    assert [r["fit"] for r in alone] == [0.0]


def test_small_groups_fit_in_rows_as_large_ones_do_in_cells(spark, monkeypatch):
    """Edges and walls in cells, joined, were some 600 bytes a room."""
    rng = np.random.default_rng(7)
    rooms = [(f"p{k % 4}", k, ring(*(rng.uniform(0, 20, 2) + rng.uniform(0, 6, (3 + k % 3, 2))).round(2))) for k in range(40)]
    rooms += [("p0", 90, None), ("p0", 91, ring((1, 1), (2, 2))), ("p1", 92, ring((1, 1), (1, 1), (1, 1))), ("alone", 93, box(0, 0, 2, 2)), (None, 94, box(0, 0, 2, 2))]
    walls = [(f"p{k % 3}", *rng.uniform(0, 25, 4).round(2).tolist()) for k in range(120)] + [("p0", None, 0.0, 9.0, 9.0), (None, 0.0, 0.0, 2.0, 0.0), ("none", 0.0, 0.0, 1.0, 1.0), ("p3", 4.0, 4.0, 4.0, 4.0)]
    r, w = spark.createDataFrame(rooms, f"plan string, room_id int, polygon {RING}"), spark.createDataFrame(walls, "plan string, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for few, at_once in ((400, 7), (90, 500_000), (0, 500_000)):
        monkeypatch.setattr(outlines, "FEW_SIDES", few)
        monkeypatch.setattr(outlines, "SIDES_AT_ONCE", at_once)
        got[few] = {(x["plan"], x["room_id"]): round(x["fit"], 9) for x in outlines.outline_fit(r, w, ["plan"], "room_id", tolerance=0.7).collect()}
    assert got[400] == got[90] == got[0] and len(got[0]) == 42 and sum(f > 0 for f in got[0].values()) > 20
    monkeypatch.setattr(outlines, "FEW_SIDES", 400)
    plan = outlines.outline_fit(r, w, ["plan"], "room_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and plan.count("Generate") == 1  # no cells, and no edges before rooms meet their walls


def flood(label):
    h, w = label.shape
    key = {}
    for y in range(h):
        for x in range(w):
            for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
                v, u = y + dy, x + dx
                if v < h and 0 <= u < w and label[y, x] > 0 and label[v, u] > 0 and label[y, x] != label[v, u]:
                    key[x, y] = (min(label[y, x], label[v, u]), max(label[y, x], label[v, u]))
                    break
    seen, out = set(), []
    for start in sorted(key):
        if start in seen:
            continue
        seen.add(start)
        patch, todo = [], deque([start])
        while todo:
            x, y = todo.popleft()
            patch.append((x, y))
            for other in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if other not in seen and key.get(other) == key[start]:
                    seen.add(other)
                    todo.append(other)
        xs, ys = zip(*patch)
        out.append((*map(int, key[start]), len(patch), round(float(np.mean(xs)), 6), round(float(np.mean(ys)), 6), min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


def test_contact_patches_are_those_of_a_flood_fill(spark):
    rng = np.random.default_rng(4)
    label = np.kron(rng.integers(1, 5, (4, 5)), np.ones((7, 6), int))
    label[rng.random(label.shape) < 0.25] = 0
    label = np.where(rng.random(label.shape) < 0.1, rng.integers(1, 5, label.shape), label)
    rows = [("i", x, y, int(label[y, x])) for y in range(label.shape[0]) for x in range(label.shape[1])]
    out = proximity.contact_patches(spark.createDataFrame(rows, "image string, x long, y long, label long"), "image").collect()
    assert sorted((r["a"], r["b"], r["n"], round(r["cx"], 6), round(r["cy"], 6), r["x0"], r["y0"], r["x1"], r["y1"]) for r in out) == flood(label)
    assert proximity.contact_patches(spark.createDataFrame([("i", 0, 0, 1), ("i", 5, 0, 2)], "image string, x long, y long, label long"), "image").collect() == []


@pytest.mark.parametrize("axes", ["xy", "xyz"])
def test_nearest_points_against_all_pairs(spark, axes):
    rng = np.random.default_rng(len(axes))
    n = len(axes)
    clouds = {"even": rng.uniform(0, 10, (60, n)), "dense": np.concatenate([rng.normal(0, 0.01, (50, n)), rng.uniform(-50, 50, (10, n))]), "same": np.ones((5, n)), "one": np.zeros((1, n)), "two": np.array([[0.0] * n, [1000.0] * n])}
    rows = [(name, i, *map(float, p.round(4))) for name, ps in clouds.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame([*rows, ("one", 9, *[None] * n), ("one", 10, *[float("inf")] * n), (None, 11, *[1.0] * n)], "cloud string, id int, " + ", ".join(f"{a} double" for a in axes))
    got = sorted((r["cloud"], r["id"], r["rank"], r["other"], round(r["distance"], 6)) for r in proximity.nearest_points(df, "cloud", "id", list(axes), k=3).collect())
    want = []
    for name in clouds:
        own = [(r[1], np.array(r[2:])) for r in rows if r[0] == name]
        for i, p in own:
            best = sorted((float(np.sqrt(((p - q) ** 2).sum())), j) for j, q in own if j != i)[:3]
            want += [(name, i, k + 1, j, round(d, 6)) for k, (d, j) in enumerate(best)]
    assert got == sorted(want)
    assert proximity.nearest_points(df.limit(0), "cloud", "id", list(axes)).collect() == []


def test_words_in_reach_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{k % 2}", k, *map(float, rng.uniform(0, 300, 2).round(1)), float(rng.integers(2, 60)), float(rng.choice([0.5, 3, 4, 7.9, 8, 30, 120]))) for k in range(160)] + [("s0", 900, 5.0, 5.0, 9.0, 0.0)]
    got = {(r["sheet"], r["a"], r["b"], round(r["gap"], 6)) for r in proximity.words_in_reach(spark.createDataFrame(rows, "sheet string, word_id int, x double, y double, w double, h double"), "sheet").collect()}
    want = set()
    for s, i, x, y, w, h in rows:
        for t, j, p, q, v, k in rows:
            if s == t and i < j and min(h, k) > 0:
                dx, dy = max(0.0, max(x, p) - min(x + w, p + v)), max(0.0, max(y, q) - min(y + h, q + k))
                if dx < 1.2 * max(h, k) and dy < 1.2 * max(h, k):
                    want.add((s, i, j, round(dx + dy, 6)))
    assert got == want and len(want) > 100


def test_words_meet_in_tiles_and_over_batches_without_joins(spark, monkeypatch):
    """Posts of words in the cells of every class, joined, were some 600 bytes a word."""
    rng = np.random.default_rng(9)
    rows = [(k % 2, k, *map(float, rng.uniform(-900, 900, 2).round(1)), float(rng.integers(2, 40)), float(rng.choice([4, 5, 9, 60], p=[0.4, 0.3, 0.25, 0.05]))) for k in range(700)]
    odd = [(0, 901, None, 5.0, 9.0, 4.0), (0, 902, 5.0, 5.0, float("inf"), 4.0), (None, 903, 5.0, 5.0, 9.0, 4.0)]
    monkeypatch.setattr(proximity, "_AT_ONCE", 70)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        out = proximity.words_in_reach(spark.createDataFrame([*rows, *odd], "sheet int, word_id int, x double, y double, w double, h double"), "sheet")
        got = sorted((r["sheet"], r["a"], r["b"], round(r["gap"], 6)) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for s, i, x, y, w, h in rows:
        for t, j, p, q, v, k in rows:
            if s == t and i < j:
                dx, dy = max(0.0, max(x, p) - min(x + w, p + v)), max(0.0, max(y, q) - min(y + h, q + k))
                if dx < 1.2 * max(h, k) and dy < 1.2 * max(h, k):
                    want.append((s, i, j, round(dx + dy, 6)))
    assert got == sorted(want) and len(want) > 150
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = spark.createDataFrame([], "sheet int, word_id int, x double, y double, w double, h double")
    assert proximity.words_in_reach(none, "sheet").collect() == []


def test_three_directions_are_found(spark):
    """Legs along two axes and a long slope: the third direction, and its own across."""
    slope = ring((0, 0), (4, 0), (4, 0.2), (0.2, 4), (0, 4))
    rooms = [("slope", 0, slope), ("slope", 1, ring((0, 0), (0.04, 0.003), (0, 0.04))), ("plain", 0, box(0, 0, 3, 2)), ("plain", 1, ring((0, 0), (3, 0.1), (3, 2), (0, 2))), ("none", 0, ring((1, 1), (1, 1), (1, 1)))]
    df = spark.createDataFrame(rooms, f"plan string, room int, polygon {RING}")
    got = {r["plan"]: r["directions"] for r in outlines.wall_directions(df, "plan").collect()}
    assert got["plain"] == [0.0, 90.0] and len(got["slope"]) == 4 and "none" not in got
    assert all(min(abs((a - b + 90) % 180 - 90) for b in got["slope"]) <= 3 for a in (0, 90, 135))
    squared = {(r["plan"], r["room"]): r for r in outlines.squared_rooms(df, "plan", "room").collect()}
    assert squared["plain", 1]["area"] == pytest.approx(2 * 3 - 0.15, abs=0.01) and 0 < squared["plain", 1]["turn"] < 2
    edges = np.array(squared["slope", 1]["polygon"])
    angle = np.degrees(np.arctan2(*(np.roll(edges, -1, axis=0) - edges).T[::-1])) % 180
    assert all(min(abs((a - b + 90) % 180 - 90) for b in got["slope"]) < 1e-6 for a in angle)  # every wall is in one of them


def test_edges_far_from_any_direction_stay():
    p = np.array([(0, 0), (10, 0), (10, 10), (5, 16), (0, 10)], float)  # a gable at some 40 degrees
    out, turn = g.snap_to(p, [0.0, 90.0])
    assert out == pytest.approx(p) and turn == 0.0
    assert g.peak_directions(np.zeros(180)) == [0.0, 90.0]


def test_greedy_rounds_are_one_after_the_other(spark):
    rng = np.random.default_rng(12)
    edges = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(90)} | {(k, k + 1) for k in range(100, 130)}
    want = []
    for k in [*range(60), *range(100, 131)]:
        if not any((j, k) in edges for j in want):
            want.append(k)
    nodes = spark.createDataFrame([(k,) for k in [*range(60), *range(100, 131)]], "id long")
    got = proximity.greedy_kept(nodes, spark.createDataFrame(sorted(edges), "first long, later long"))
    assert sorted(r["id"] for r in got.collect()) == want


def test_tiles_merge_to_what_was_cut(spark):
    rng = np.random.default_rng(3)
    whole = {k: np.array([(x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + h), (x, y + h)]) for k in range(25) for x, y, w, h in [(*rng.uniform(0, 20, 2) + [(k % 5) * 80, (k // 5) * 80], *rng.uniform(20, 50, 2))]}
    tiles = [("p", 10 * i + j, 90.0 * i, 90.0 * j) for i in range(5) for j in range(5)]
    found = []
    for _, tile, x, y in tiles:
        for k, p in whole.items():
            low, high = p.min(axis=0), p.max(axis=0)
            if (low >= [x, y]).all() and (high <= [x + 160, y + 160]).all():
                found.append(("p", tile, k * 1000 + tile, ring(*(p - [x, y]))))
            elif (low < [x + 160, y + 160]).all() and (high > [x, y]).all():
                a, b = np.maximum(low, [x, y]), np.minimum(high, [x + 160, y + 160])
                found.append(("p", tile, k * 1000 + tile, box(*(a - [x, y]), *((b - a) * [0.6, 0.5]))))  # a part, badly read
    out = proximity.merged_tiles(spark.createDataFrame(found, f"plan string, tile long, piece_id long, polygon {RING}"), spark.createDataFrame(tiles, "plan string, tile long, x double, y double"), "plan").collect()
    assert sorted(r["piece_id"] // 1000 for r in out) == sorted(whole)
    for r in out:
        assert np.array(r["polygon"]) == pytest.approx(whole[r["piece_id"] // 1000])


def test_mesh_of_rooms(spark):
    rooms = [("p", "box", box(0, 0, 4, 3), 0.5, 2.5, "measured"), ("p", "far", box(20, 20, 2, 2)[::-1], 0.0, 2.0, "inferred"), ("p", "bow", ring((40, 0), (42, 2), (42, 0), (40, 2)), 0.0, 2.0, "inferred"), ("p", "none", [], 0.0, 2.0, "inferred")]
    openings = [("p", 2.0, 0.1, 1.0, "door", None), ("p", 2.4, 0.0, 1.0, "door", 2.0), ("p", 4.0, 1.5, None, "window", None), ("p", 2.0, 1.0, 1.0, "door", None), ("q", 20.0, 21.0, 1.0, "door", None), ("p", None, None, 1.0, "door", None)]
    df = spark.createDataFrame(rooms, f"plan string, room_id string, polygon {RING}, floor double, height double, provenance string")
    cuts = spark.createDataFrame(openings, "plan string, x double, y double, width double, kind string, head double")
    out = meshes.room_mesh(df, cuts, "plan").withColumn("area", meshes.triangle_area()).collect()
    area = lambda room, part: round(sum(r["area"] for r in out if (r["room_id"], r["part"]) == (room, part)), 6)
    # doors from 1.5 to 2.5 and on to 2.9, a window of 0.85 from 0.9 to 2.1
    assert area("box", "wall") == round(14 * 2.5 - 1.0 * 2.04 - 0.4 * 2.0 - 0.85 * 1.2, 6) and area("box", "floor") == area("box", "ceiling") == 12
    assert area("far", "wall") == 16 and area("far", "floor") == 4 and len([r for r in out if r["room_id"] == "far"]) == 12
    assert {r["whole"] for r in out if r["room_id"] in ("box", "far")} == {True}
    assert {r["whole"] for r in out if r["room_id"] == "bow" and r["part"] != "wall"} <= {False} and not [r for r in out if r["room_id"] == "none"]
    corners = np.array([[[r[f"{e}{c}"] for c in "xyz"] for e in "abc"] for r in out if r["room_id"] == "far"])
    assert {tuple(c) for t in corners for c in t.tolist()} == {(x, y, z) for x in (20.0, 22.0) for y in (20.0, 22.0) for z in (0.0, 2.0)}
    assert all(r["az"] >= 0.5 and r["cz"] <= 3.0 for r in out if r["room_id"] == "box")


def test_meshes_shuffle_rooms_and_not_their_walls(spark):
    df = spark.createDataFrame([("p", "box", box(0, 0, 4, 3), 0.5, 2.5, "measured")], f"plan string, room_id string, polygon {RING}, floor double, height double, provenance string")
    cuts = spark.createDataFrame([("p", 2.0, 0.1, 1.0, "door", None)], "plan string, x double, y double, width double, kind string, head double")
    plan = meshes.room_mesh(df, cuts, "plan")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 3 and "PythonUDTF" not in plan


def test_batches_of_rooms_are_squared_as_single_ones():
    rng = np.random.default_rng(2)
    for corners in (4, 6, 9):
        angle, far = np.sort(rng.uniform(0, 2 * np.pi, (30, corners)), axis=1), rng.uniform(1, 5, (30, corners))
        p, d = np.stack([far * np.cos(angle), far * np.sin(angle)], axis=2), np.sort(rng.uniform(0, 180, (30, 3)), axis=1)
        p[::2] = p[::2, ::-1]
        rings, turns = g.batch_snap_to(p, d)
        for i in range(30):
            ring, turn = g.snap_to(p[i], list(d[i]))
            assert rings[i] == pytest.approx(ring, abs=1e-9) and turns[i] == pytest.approx(turn, abs=1e-9)
        assert g.batch_direction_weights(p) == pytest.approx(np.array([g.direction_weights(r) for r in p]), abs=1e-9)


def test_small_groups_are_squared_in_a_row_as_large_ones_by_spark(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        c, s = math.cos(k // 3 * 0.2), math.sin(k // 3 * 0.2)
        w, h = rng.uniform(1, 6, 2).tolist()
        p = [(0, 0), (w, 0), (w, h), (0, h)] if k % 4 else [(0, 0), (w, 0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0, h)]
        rows.append((k // 3, f"r{k}", ring(*[(x * c - y * s + rng.normal() / 50, x * s + y * c) for x, y in p])))
    df = spark.createDataFrame([*rows, (99, "line", ring((0, 0), (1, 0))), (98, "none", None), (97, "dot", ring((1, 1), (1, 1), (1, 1))), (None, "gone", box(0, 0, 1, 1))], f"plan int, room string, polygon {RING}")
    small = outlines.squared_rooms(df, "plan", "room")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1
    plain = lambda out: {r["room"]: (r["plan"], r["directions"], round(r["turn"], 9), round(r["area"], 9), [(round(p["x"], 8) + 0.0, round(p["y"], 8) + 0.0) for p in r["polygon"]]) for r in out.collect()}
    assert plain(small) == plain(outlines._squared_by_spark(df, "plan", "room")) and len(plain(small)) == 60


def test_peaks_of_batches_are_those_one_by_one():
    weights = np.round(np.random.default_rng(9).exponential(1, (200, 180)) ** 3, 1) * (np.random.default_rng(10).random((200, 180)) < np.linspace(0, 1, 200)[:, None])
    n, found = g.batch_peak_directions(weights)
    assert [f[:k].tolist() for k, f in zip(n.tolist(), found)] == [g.peak_directions(w) for w in weights]


def test_ears_of_batches_are_those_one_by_one():
    rng = np.random.default_rng(11)
    for n in (3, 4, 6, 9):
        angle = np.sort(rng.uniform(0, 2 * math.pi, (40, n)), axis=1)
        p = np.stack([np.cos(angle), np.sin(angle)], axis=2) * rng.uniform(0.2, 3, (40, n, 1))
        p = np.where((g.batch_area(p) >= 0)[:, None, None], p, p[:, ::-1])
        ears, count = g.batch_ear_clip(p)
        assert [list(map(tuple, e[:k].tolist())) for e, k in zip(ears, count.tolist())] == [g.ear_clip(q) for q in p]


def test_openings_meet_rooms_by_their_group_alone(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rooms = [(k // 3, k, box(*rng.integers(0, 40, 2).tolist(), *rng.integers(2, 9, 2).tolist()), 0.5, 2.5, "measured") for k in range(30)]
    cuts = [(k // 3, float(p[0][0] + rng.uniform(0, 3)), float(p[0][1] + rng.uniform(-0.3, 0.3)), 0.8, "door" if k % 2 else "window", None) for _, k, p, *_ in rooms for _ in range(2)]
    df = spark.createDataFrame(rooms, f"plan int, room_id int, polygon {RING}, floor double, height double, provenance string")
    openings = spark.createDataFrame(cuts, "plan int, x double, y double, width double, kind string, head double")
    small = meshes.room_mesh(df, openings, "plan")
    plan = small._jdf.queryExecution().toString()
    assert "gx" not in plan and "cursor" not in plan
    found = lambda out: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in out.collect())
    want = found(small)
    monkeypatch.setattr(meshes, "FEW_OPENINGS", 1)
    assert len(want) > 30 * 12 and found(meshes.room_mesh(df, openings, "plan")) == want
