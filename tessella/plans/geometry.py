"""Geometry queries: polygons made of part columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.sources.tables import table


def _rooms(spark, d):
    """Each part is a rectangle; every third one an L with a corner cut out."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 17 + 3).cast("double").alias("h"), (F.col("p_partkey") % 40 * 7).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 40) * 9).cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    ell = F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h / 2), g.point(x + w / 2, y + h / 2), g.point(x + w / 2, y + h), g.point(x, y + h))
    return p.withColumn("polygon", F.when(F.col("p_partkey") % 3 == 0, ell).otherwise(g.rectangle(x, y, w, h)))


def polygon_area(spark, d):
    r = _rooms(spark, d)
    c = g.centroid(F.col("polygon"))
    b = g.bounds(F.col("polygon"))
    return r.select("p_partkey", F.round(g.area(F.col("polygon")), 4).alias("area"), F.round(g.perimeter(F.col("polygon")), 4).alias("perimeter"), F.round(c["x"] - F.col("x"), 4).alias("cx"), F.round(c["y"] - F.col("y"), 4).alias("cy"), (b["x1"] - b["x0"]).alias("bw"), (b["y1"] - b["y0"]).alias("bh"))


def polygon_orientation(spark, d):
    """Turned and flipped rooms keep area and oriented extent; the ring runs counter-clockwise. A
    room with a corner cut out has the extent of its bounds."""
    r = _rooms(spark, d)
    moved = g.placed(F.col("polygon"), F.lit(37.0), F.col("p_partkey") % 2 == 0, F.lit(5.0), F.lit(-3.0))
    e = g.oriented_extent(moved)
    return r.select("p_partkey", F.round(g.area(moved), 4).alias("area"), F.round(e["long"], 4).alias("long_side"), F.round(e["short"], 4).alias("short_side"), (g.signed_area(g.counter_clockwise(moved)) > 0).alias("ccw"))


def pixel_to_metre(spark, d):
    r = _rooms(spark, d)
    m = g.to_metres(F.col("polygon"), F.lit(10.0), F.lit(500.0))
    return r.select("p_partkey", F.round(g.area(m), 6).alias("area_m2"), F.round(F.array_max(F.transform(m, lambda v: v["y"])), 6).alias("top"))


def _hits(spark, d):
    """Suppliers' points in rooms: a grid-bucket equi-join, then the exact test."""
    cell = 60.0
    pts = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.pmod(F.abs("s_acctbal"), F.lit(280.0)) + 0.013).alias("px"), (F.col("s_suppkey") * 4 % 440 + 0.517).cast("double").alias("py"))
    pts = pts.withColumn("gx", F.floor(F.col("px") / cell)).withColumn("gy", F.floor(F.col("py") / cell))
    r = _rooms(spark, d)
    over = lambda lo, size: F.explode(F.sequence(F.floor(lo / cell), F.floor((lo + size) / cell)))
    cells = r.withColumn("gx", over(F.col("x"), F.col("w"))).withColumn("gy", over(F.col("y"), F.col("h")))
    return pts.join(cells, ["gx", "gy"]).filter((F.col("px").between(F.col("x"), F.col("x") + F.col("w"))) & F.col("py").between(F.col("y"), F.col("y") + F.col("h")) & g.contains(F.col("polygon"), F.col("px"), F.col("py")))


def point_in_room(spark, d):
    """The room of each point: of several, the smallest."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_suppkey").orderBy(g.area(F.col("polygon")), "p_partkey")
    return _hits(spark, d).withColumn("k", F.row_number().over(w)).withColumn("rooms", F.count(F.lit(1)).over(Window.partitionBy("s_suppkey"))).filter("k = 1").select("s_suppkey", "p_partkey", "rooms")


def room_captions(spark, d):
    """The caption of each room: of those inside, the biggest, of equally big ones the first."""
    size = F.struct(F.abs("s_acctbal").alias("size"), (-F.col("s_suppkey")).alias("first"))
    return _hits(spark, d).groupBy("p_partkey").agg(F.max_by("s_suppkey", size).alias("s_suppkey"), F.count(F.lit(1)).alias("captions"))


def caption_hit_rate(spark, d):
    """Share of points inside exactly one room."""
    hits = point_in_room(spark, d)
    pts = table(spark, d, "supplier").select("s_suppkey")
    joined = pts.join(hits, "s_suppkey", "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.coalesce("rooms", F.lit(0)) == 1).cast("double")), 6).alias("rate"))


def angles_and_views(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(g.wrap_degrees(F.col("p_partkey") * 37.5 - 720), 6).alias("wrapped"), F.round(g.vertical_fov(F.lit(98.6), F.col("p_size") + 10.0, F.col("p_partkey") % 50 + 8.0), 6).alias("fov_y"))


def _pairs(spark, d):
    """Neighbouring rooms (next part key) as coordinate arrays, for numpy functions. A small table is read and joined by one
    task, so pairs are dealt out before."""
    r = _rooms(spark, d).select("p_partkey", F.transform("polygon", lambda v: F.array(v["x"], v["y"])).alias("p"))
    met = r.alias("a").join(r.alias("b"), F.col("a.p_partkey") + 1 == F.col("b.p_partkey")).select(F.col("a.p_partkey").alias("a"), F.col("a.p").alias("p"), F.col("b.p").alias("q"))
    return met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a")


def polygon_overlap(spark, d):
    """Overlap, IoU and shared edge of neighbouring rooms (numpy; checked against grid sampling)."""
    def measure(p, q):
        both = g.batch_intersection_area(p, q)
        return both, g.batch_iou(p, q, both), g.batch_shared_edge_length(p, q, 0.2)

    def run(frames):
        for f in frames:
            if len(f):
                both, iou, shared = g.pairwise(list(f["p"]), list(f["q"]), measure)
                yield pd.DataFrame({"a": f["a"], "overlap": [round(v, 6) for v in both.tolist()], "iou": [round(v, 6) for v in iou.tolist()], "shared": [round(v, 6) for v in shared.tolist()]})

    return _pairs(spark, d).mapInPandas(run, "a long, overlap double, iou double, shared double")


def polygon_tools(spark, d):
    """Triangles, simplified corners, a point inside, dominant angle and snapped area (numpy)."""
    def measure(p, _):
        return g.batch_contains(p, *g.batch_representative_point(p)), g.batch_dominant_angle(p), np.abs(g.batch_area(g.batch_snap_directions(p)))

    def run(frames):
        for f in frames:
            if len(f):
                inside, angle, snapped = g.pairwise(list(f["p"]), list(f["p"]), measure)
                shapes = [np.array([*map(list, p)]) for p in f["p"]]
                yield pd.DataFrame({"a": f["a"], "triangles": [len(g.ear_clip(p)) for p in shapes], "corners": [len(g.simplify(p, 0.5)) for p in shapes], "inside": inside, "angle": angle, "snapped": [round(v, 6) for v in snapped.tolist()]})

    return _pairs(spark, d).mapInPandas(run, "a long, triangles int, corners int, inside boolean, angle double, snapped double")


def pose_fit(spark, d):
    """Pose of each room on its neighbour."""
    def run(frames):
        for f in frames:
            if len(f):
                found = g.pairwise(list(f["p"]), list(f["q"]), g.batch_pose_search)
                yield pd.DataFrame({"a": f["a"], **dict(zip(("theta", "flip", "tx", "ty", "iou"), found))})

    return _pairs(spark, d).mapInPandas(run, "a long, theta double, flip boolean, tx double, ty double, iou double")


_R = """
r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 17 + 3 AS DOUBLE) AS h, CAST(p_partkey % 40 * 7 AS DOUBLE) AS x, CAST(floor(p_partkey / 40) * 9 AS DOUBLE) AS y, p_partkey % 3 = 0 AS ell FROM part)"""
_HITS = f"""
{_R}, pts AS (SELECT s_suppkey, abs(s_acctbal) % 280.0::DOUBLE + 0.013::DOUBLE AS px, s_suppkey * 4 % 440 + 0.517::DOUBLE AS py FROM supplier),
hit AS (SELECT s_suppkey, p_partkey, CASE WHEN ell THEN w * h * 0.75 ELSE w * h END AS area FROM pts JOIN r ON px >= x AND px < x + w AND py >= y AND py < y + h WHERE NOT (ell AND px >= x + w / 2 AND py >= y + h / 2)),
best AS (SELECT s_suppkey, p_partkey, count(*) OVER (PARTITION BY s_suppkey) AS rooms FROM hit QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY area, p_partkey) = 1)"""

QUERIES = {f.__name__: f for f in (polygon_area, polygon_orientation, pixel_to_metre, point_in_room, room_captions, caption_hit_rate, angles_and_views, polygon_overlap, polygon_tools, pose_fit)}
ORACLES = {
    "polygon_area": f"""WITH {_R}
SELECT p_partkey, round(CASE WHEN ell THEN w * h * 0.75 ELSE w * h END, 4) AS area, round(2 * (w + h), 4) AS perimeter, round(CASE WHEN ell THEN w * 5 / 12 ELSE w / 2 END, 4) AS cx, round(CASE WHEN ell THEN h * 5 / 12 ELSE h / 2 END, 4) AS cy, w AS bw, h AS bh FROM r""",
    "polygon_orientation": f"WITH {_R} SELECT p_partkey, round(CASE WHEN ell THEN w * h * 0.75 ELSE w * h END, 4) AS area, greatest(w, h) AS long_side, least(w, h) AS short_side, true AS ccw FROM r",
    "pixel_to_metre": f"WITH {_R} SELECT p_partkey, round(CASE WHEN ell THEN w * h * 0.75 ELSE w * h END / 100, 6) AS area_m2, round((500 - y) / 10, 6) AS top FROM r",
    "point_in_room": f"WITH {_HITS} SELECT s_suppkey, p_partkey, rooms FROM best",
    "room_captions": f"WITH {_HITS} SELECT p_partkey, s_suppkey, captions FROM (SELECT h.p_partkey, h.s_suppkey, count(*) OVER (PARTITION BY p_partkey) AS captions, abs(s_acctbal) AS size FROM hit h JOIN supplier s ON h.s_suppkey = s.s_suppkey) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY size DESC, s_suppkey) = 1",
    "caption_hit_rate": f"WITH {_HITS} SELECT count(*) AS n, round(avg((coalesce(rooms, 0) = 1)::INT), 6) AS rate FROM supplier LEFT JOIN best USING (s_suppkey)",
    "angles_and_views": """
SELECT p_partkey, round(((p_partkey * 37.5::DOUBLE - 540) % 360 + 360) % 360 - 180, 6) AS wrapped,
  round(CASE WHEN p_size + 10 >= p_partkey % 50 + 8 THEN degrees(2 * atan(tan(radians(98.6::DOUBLE) / 2) * (p_partkey % 50 + 8) / (p_size + 10))) END, 6) AS fov_y FROM part""",
}
