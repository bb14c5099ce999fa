"""Footprints, outlines on walls, contact patches and neighbours: orders as listings, their lines as rooms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import meshes
from tessella.operators import outlines as op
from tessella.operators import proximity as near
from tessella.sources.tables import table


def _number(c: str, modulus: int, more: float = 0.0):
    return (F.col(c).cast("long") % modulus + more).cast("double")


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _lines(spark, d, together: bool = False):
    """Lines with their place in the order, as line numbers repeat; together also where their place isn't read."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    l = table(spark, d, "lineitem").select("l_orderkey", *_ORDER, "l_returnflag")
    return (l.repartition("l_orderkey") if together else l).withColumn("line", F.row_number().over(w).cast("long"))


def _overlapping(spark, d, together: bool = False):
    """Rooms that overlap their neighbours; every third one has a corner cut out."""
    r = _lines(spark, d, together).select("l_orderkey", "line", "l_partkey", (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("long") % 4).cast("double").alias("x"), _number("l_partkey", 7).alias("y"), _number("l_quantity", 9, 2).alias("w"), _number("l_suppkey", 6, 2).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    ell = F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h / 2), g.point(x + w / 2, y + h / 2), g.point(x + w / 2, y + h), g.point(x, y + h))
    return r.withColumn("polygon", F.when(F.col("l_partkey") % 3 == 0, ell).otherwise(g.rectangle(x, y, w, h)))


def union_outline(spark, d):
    """Area, perimeter and corners of each order's footprint, over its outer rings and holes."""
    rings = op.union_outlines(_overlapping(spark, d, together=True), ["l_orderkey"], corners=F.lit(6))
    signed = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    return rings.groupBy("l_orderkey").agg(F.round(F.sum(signed), 4).alias("area"), F.round(F.sum(g.perimeter(F.col("points"))), 4).alias("perimeter"), F.sum(F.size("points")).cast("long").alias("corners"))


def _row_of_rooms(spark, d, width: str, height: str, id_col: str):
    """Rooms side by side, each as wide and high as two columns say."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    wide = _number(width, 7, 2)
    before = F.sum(wide).over(order.rowsBetween(Window.unboundedPreceding, -1))
    l = table(spark, d, "lineitem").select("l_orderkey", *_ORDER).select("l_orderkey", F.row_number().over(order).cast("long").alias(id_col), F.coalesce(before, F.lit(0.0)).alias("x"), wide.alias("w"), _number(height, 5, 3).alias("h"))
    return l.select("l_orderkey", id_col, g.rectangle(F.col("x"), F.lit(0.0), F.col("w"), F.col("h")).alias("polygon"))


def layout_overlap(spark, d):
    """How each order's built footprint covers its plan's."""
    built, plan = _row_of_rooms(spark, d, "l_quantity", "l_partkey", "room_id"), _row_of_rooms(spark, d, "l_suppkey", "l_quantity", "plan_room_id")
    matches = built.select("l_orderkey", "room_id", F.col("room_id").alias("plan_room_id"))
    return op.layout_iou(built, plan, matches, "l_orderkey", corners=F.lit(4)).select("l_orderkey", F.round(F.round("iou", 9), 4).alias("iou"), "rooms", "median_room_iou")


def _sheet_rooms(spark, d):
    r = _overlapping(spark, d)
    return r.select("l_orderkey", F.col("line").alias("room_id"), "l_partkey", "x", "y", "w", "h", g.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("polygon"), (F.col("w") * F.col("h")).alias("area"))


def plan_sheets(spark, d):
    """The sheet of each order: its rooms, its shell, its address, and how its outlines lie on its walls."""
    rooms = _sheet_rooms(spark, d)
    shift, aside = F.col("l_partkey") % 5 * 0.04, F.col("l_partkey") % 4 * 0.06
    wall = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x, y, w, h = (F.col(c) for c in "xywh")
    walls = rooms.select("l_orderkey", F.explode(F.array(wall(x - 0.5, y + shift, x + w * 0.75, y + shift), wall(x + aside, y, x + aside, y + h * 0.5))).alias("v")).select("l_orderkey", "v.*")
    shells = _lines(spark, d).filter("l_linenumber % 4 <> 0").select("l_orderkey", F.col("line").alias("room_id"), F.when(F.col("l_partkey") % 6 > 0, 2.2 + F.col("l_partkey") % 6 / 10.0).alias("height"), (F.col("l_returnflag") == "R").alias("photographed"))
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    plans = o.select("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, F.col("o_custkey") % 90.0 + 20).alias("area"), F.when(F.col("l_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("scale_source"), F.when(F.col("l_orderkey") % 5 != 0, F.array("o_orderpriority")).alias("qa_flags"))
    named = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    packages = named.filter("l_orderkey % 2 = 0").select("l_orderkey", F.when(F.col("l_orderkey") % 6 != 0, F.col("c_name")).otherwise("").alias("address"), (F.col("o_custkey") % 70 + 1.0).alias("area"))
    triage = named.filter("l_orderkey % 7 <> 0").select("l_orderkey", F.col("c_mktsegment").alias("address"), F.when(F.col("l_orderkey") % 8 != 0, F.col("o_custkey") % 50 + 2.0).alias("area"))
    out = op.plan_sheets(plans, rooms, walls, shells, packages, triage, "l_orderkey")
    return out.withColumns({"outline_fit": F.round("outline_fit", 9), "ceiling": F.round("ceiling", 4), "flags": F.array_join("flags", ",")})


def contact_patches(spark, d):
    """Orders as pixels of plans of 64 by 64: four by four regions, with gaps where a customer's key says so."""
    k = F.col("o_orderkey")
    px = table(spark, d, "orders").select(F.expr("o_orderkey div 4096").alias("plan"), (k % 64).alias("x"), F.expr("o_orderkey div 64 % 64").alias("y"), "o_custkey")
    label = F.when(F.col("o_custkey") % 7 == 0, 0).otherwise(F.expr("1 + x div 16 + 4 * (y div 16)")).cast("long")
    out = near.contact_patches(px.withColumn("label", label), "plan")
    return out.select("plan", "a", "b", F.col("patch.y").alias("py"), F.col("patch.x").alias("px"), "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "x0", "y0", "x1", "y1")


def cloud_spacing(spark, d):
    """The two nearest others of each vector of its label, by its first three components."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    out = near.nearest_points(e, "label", "vec_id", ["x", "y", "z"], k=2)
    return out.select("label", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def words_in_reach(spark, d):
    """Lines as words on their suppliers' sheets, every fifth one a heading."""
    q = F.col("l_quantity").cast("long")
    words = _lines(spark, d).select("l_suppkey", (F.col("l_orderkey") * 64 + F.col("line")).cast("long").alias("word_id"), (F.col("l_orderkey") * 37 % 2000).cast("double").alias("x"), (F.col("l_partkey") * 53 % 3000).cast("double").alias("y"), (q % 30 + 5).cast("double").alias("w"), F.when(F.col("l_linenumber") % 5 == 0, 40 + q).otherwise(4 + q % 6).cast("double").alias("h"))
    return near.words_in_reach(words, "l_suppkey").select("l_suppkey", "a", "b", F.round("gap", 4).alias("gap"))


def squared_rooms(spark, d):
    """Rooms of orders whose plans are turned, some with a wall askew; walls are turned into what the order's walls run along."""
    r = _overlapping(spark, d)
    turned = g.placed(F.col("polygon"), (F.col("l_orderkey") % 4 * 10).cast("double"), F.lit(False), F.lit(0.0), F.lit(0.0))
    pushed = F.transform(turned, lambda v, i: F.when((i == 1) & (F.col("l_partkey") % 4 == 0), g.point(v["x"] + 0.05, v["y"] + 0.05)).otherwise(v))
    out = op.squared_rooms(r.select("l_orderkey", "line", pushed.alias("polygon")), "l_orderkey", "line", corners=F.lit(6))
    return out.select("l_orderkey", F.col("line").alias("room"), F.size("directions").alias("n_directions"), F.round("turn", 4).alias("turn"), F.round("area", 4).alias("area"))


def mesh_totals(spark, d):
    """Triangles and area of the orders' shells by provenance and part, each line with a door or window on its front."""
    lines = _overlapping(spark, d)
    r = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("provenance")), "l_orderkey")
    r = r.select("l_orderkey", F.col("line").alias("room_id"), "polygon", F.lit(0.0).alias("floor"), (F.col("l_partkey") % 3 * 0.25 + 2.25).alias("height"), "provenance")
    k = F.col("l_partkey")
    openings = lines.filter(k % 5 > 0).select("l_orderkey", (F.col("x") + F.col("w") / 4).alias("x"), (F.col("y") + 0.125).alias("y"), (k % 4 * 0.5).alias("width"), F.when(k % 2 == 0, "door").otherwise("window").alias("kind"), F.when(k % 7 == 0, 2.5).alias("head"))
    out = meshes.room_mesh(r, openings, "l_orderkey").withColumn("area", meshes.triangle_area())
    return out.groupBy("provenance", "part").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum("area"), 2).alias("area"), F.bool_and("whole").alias("whole"))


#: More than there are tiles, so that a part and a tile make one number.
_TILES = 1_000_000_000


def tile_merge(spark, d):
    """Parts as rooms of one large plan that is read in tiles of 200, 50 of which are the next one's too. A tile cuts off what
    is outside of it; each room comes out once, whole."""
    k = F.col("p_partkey")
    r = table(spark, d, "part").select("p_partkey", (k % 40 * 60).cast("double").alias("x"), F.expr("CAST(p_partkey div 40 * 25 AS DOUBLE)").alias("y"), F.col("p_size").cast("double").alias("w"), (k % 17 + 3).cast("double").alias("h"))
    reach = lambda at, size: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(at) - 200) / 150)), F.floor((F.col(at) + F.col(size)) / 150)).cast("array<bigint>"))
    cut = r.withColumn("tx", reach("x", "w")).withColumn("ty", reach("y", "h"))
    near_, far = [F.greatest(F.col(c), F.col(t) * 150) for c, t in (("x", "tx"), ("y", "ty"))], [F.least(F.col(c) + F.col(s), F.col(t) * 150 + 200) for c, s, t in (("x", "w", "tx"), ("y", "h", "ty"))]
    tile = F.col("ty") * 1000 + F.col("tx")
    pieces = cut.select(F.lit(0).alias("plan"), tile.alias("tile"), (k * _TILES + tile).alias("piece_id"), g.rectangle(near_[0] - F.col("tx") * 150, near_[1] - F.col("ty") * 150, far[0] - near_[0], far[1] - near_[1]).alias("polygon"), "tx", "ty")
    tiles = pieces.select("plan", "tile", (F.col("tx") * 150.0).alias("x"), (F.col("ty") * 150.0).alias("y")).distinct()
    out = near.merged_tiles(pieces.drop("tx", "ty"), tiles, "plan")
    b = g.bounds(F.col("polygon"))
    return out.select(F.expr(f"piece_id div {_TILES}").alias("p_partkey"), "tile", "area", b["x0"].alias("x0"), b["y0"].alias("y0"))


_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
_ROOMS = f"""
room AS (SELECT l_orderkey AS k, {_NTH} AS id, l_partkey, CAST(l_linenumber * 5 + CAST(l_quantity AS BIGINT) % 4 AS DOUBLE) AS x, CAST(l_partkey % 7 AS DOUBLE) AS y,
  CAST(CAST(l_quantity AS BIGINT) % 9 + 2 AS DOUBLE) AS w, CAST(l_suppkey % 6 + 2 AS DOUBLE) AS h FROM lineitem)"""
_SIDE = """SELECT k, i, {0}0, {0}1 FROM (SELECT k, {0} AS {0}0, lead({0}) OVER (PARTITION BY k ORDER BY {0}) AS {0}1, row_number() OVER (PARTITION BY k ORDER BY {0}) AS i FROM (
  SELECT DISTINCT k, unnest([{0}0, {0}1]) AS {0} FROM rect UNION SELECT k, min({0}0) - 1 FROM rect GROUP BY k UNION SELECT k, max({0}1) + 1 FROM rect GROUP BY k)) WHERE {0}1 IS NOT NULL"""
_LINE = f"""SELECT l_orderkey AS k, {_NTH} AS id, CAST({{0}} AS BIGINT) % 7 + 2.0::DOUBLE AS w, CAST({{1}} AS BIGINT) % 5 + 3.0::DOUBLE AS h,
  coalesce(sum(CAST({{0}} AS BIGINT) % 7 + 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x FROM lineitem"""

QUERIES = {f.__name__: f for f in (union_outline, layout_overlap, plan_sheets, contact_patches, cloud_spacing, words_in_reach, squared_rooms, tile_merge, mesh_totals)}
ORACLES = {
    "union_outline": f"""WITH {_ROOMS},
rect AS (SELECT k, x AS x0, x + CASE WHEN l_partkey % 3 = 0 THEN w / 2 ELSE w END AS x1, y AS y0, y + h AS y1 FROM room UNION ALL SELECT k, x, x + w, y, y + h / 2 FROM room WHERE l_partkey % 3 = 0),
gx AS ({_SIDE.format("x")}), gy AS ({_SIDE.format("y")}),
cell AS (SELECT gx.k, gx.i, gy.i AS j, any_value(gx.x1 - gx.x0) AS dx, any_value(gy.y1 - gy.y0) AS dy, max((r.x0 <= gx.x0 AND r.x1 >= gx.x1 AND r.y0 <= gy.y0 AND r.y1 >= gy.y1)::INT) AS c
  FROM gx JOIN gy ON gx.k = gy.k JOIN rect r ON r.k = gx.k GROUP BY gx.k, gx.i, gy.i),
one AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY k, i ORDER BY j) AS d FROM cell),
two AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY k, j ORDER BY i) AS l, lag(d, 1, 0) OVER (PARTITION BY k, j ORDER BY i) AS dl FROM one)
SELECT k AS l_orderkey, round(sum(c * dx * dy), 4) AS area, round(sum((c <> l)::INT * dy + (c <> d)::INT * dx), 4) AS perimeter,
  CAST(sum(CASE WHEN c + l + d + dl IN (1, 3) THEN 1 WHEN c + l + d + dl = 2 AND c = dl THEN 2 ELSE 0 END) AS BIGINT) AS corners FROM two GROUP BY k""",
    "layout_overlap": f"""WITH b AS ({_LINE.format("l_quantity", "l_partkey")}), r AS ({_LINE.format("l_suppkey", "l_quantity")}),
cb AS (SELECT k, sum(w * h) AS a, sum(w * h * (x + w / 2)) / sum(w * h) AS cx, sum(w * h * h / 2) / sum(w * h) AS cy, count(*) AS rooms FROM b GROUP BY k),
cr AS (SELECT k, sum(w * h) AS a, sum(w * h * (x + w / 2)) / sum(w * h) AS cx, sum(w * h * h / 2) / sum(w * h) AS cy FROM r GROUP BY k),
m AS (SELECT k, cb.a + cr.a AS parts, cr.cx - cb.cx AS dx, cr.cy - cb.cy AS dy, rooms FROM cb JOIN cr USING (k)),
o AS (SELECT m.k, parts, rooms, sum(greatest(0, least(b.x + dx + b.w, r.x + r.w) - greatest(b.x + dx, r.x)) * greatest(0, least(dy + b.h, r.h) - greatest(dy, 0))) AS shared_ FROM m JOIN b ON b.k = m.k JOIN r ON r.k = m.k GROUP BY m.k, parts, rooms),
p AS (SELECT k, b.w * b.h + r.w * r.h AS parts, greatest(0, least(b.x + b.w, r.x + r.w) - greatest(b.x, r.x)) * least(b.h, r.h) AS shared_ FROM b JOIN r USING (k, id)),
q AS (SELECT k, median(round(shared_ / (parts - shared_), 4)) AS median_room_iou FROM p GROUP BY k)
SELECT k AS l_orderkey, round(shared_ / (parts - shared_), 4) AS iou, rooms, median_room_iou FROM o JOIN q USING (k)""",
    "plan_sheets": f"""WITH {_ROOMS},
wall AS (SELECT k, x - 0.5 AS x0, x + w * 0.75 AS x1, y + l_partkey % 5 * 0.04::DOUBLE AS y0, y + l_partkey % 5 * 0.04::DOUBLE AS y1 FROM room
  UNION SELECT k, x + l_partkey % 4 * 0.06::DOUBLE, x + l_partkey % 4 * 0.06::DOUBLE, y, y + h * 0.5 FROM room),
edge AS (SELECT k, id, 0 AS e, x AS lo, x + w AS hi, y AS c, true AS flat FROM room UNION ALL SELECT k, id, 1, x, x + w, y + h, true FROM room
  UNION ALL SELECT k, id, 2, y, y + h, x, false FROM room UNION ALL SELECT k, id, 3, y, y + h, x + w, false FROM room),
met AS (SELECT e.*, CASE WHEN flat THEN x0 ELSE y0 END AS a, CASE WHEN flat THEN x1 ELSE y1 END AS b, greatest(0, CASE WHEN flat THEN y0 ELSE x0 END - c, c - CASE WHEN flat THEN y1 ELSE x1 END) AS gap FROM edge e JOIN wall w ON w.k = e.k),
part AS (SELECT k, id, e, greatest(lo, a - sqrt(0.01::DOUBLE - gap * gap)) AS a, least(hi, b + sqrt(0.01::DOUBLE - gap * gap)) AS b FROM met WHERE gap * gap < 0.01::DOUBLE),
reach AS (SELECT *, max(b) OVER (PARTITION BY k, id, e ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM part WHERE a < b),
fit AS (SELECT k, median(coalesce(covered, 0) / around) AS outline_fit FROM (SELECT k, id, 2 * (w + h) AS around FROM room) LEFT JOIN (SELECT k, id, sum(greatest(0, b - greatest(a, coalesce(upto, a)))) AS covered FROM reach GROUP BY k, id) USING (k, id) GROUP BY k),
own AS (SELECT k, count(*) AS n_plan, sum(w * h) AS rooms_area FROM room GROUP BY k),
shell AS (SELECT l_orderkey AS k, count(*) AS n_shell, count(*) FILTER (l_returnflag = 'R') AS ceilings_measured, median(2.2::DOUBLE + l_partkey % 6 / 10.0::DOUBLE) FILTER (l_partkey % 6 > 0) AS ceiling FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 THEN c_name WHEN o_orderkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS address, coalesce(n_plan, 0) AS n_plan, coalesce(n_shell, 0) AS n_shell,
  coalesce(ceilings_measured, 0) AS ceilings_measured, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 90 + 20.0::DOUBLE ELSE rooms_area END AS area,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 8 <> 0 THEN o_custkey % 50 + 2.0::DOUBLE WHEN o_orderkey % 2 = 0 THEN o_custkey % 70 + 1.0::DOUBLE END AS stated, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus ELSE 'none' END AS scale_source,
  round(ceiling, 4) AS ceiling, round(outline_fit, 9) AS outline_fit, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS flags
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN own ON own.k = o_orderkey LEFT JOIN shell ON shell.k = o_orderkey LEFT JOIN fit ON fit.k = o_orderkey""",
    "contact_patches": """WITH RECURSIVE px AS (SELECT o_orderkey // 4096 AS plan, o_orderkey % 64 AS x, o_orderkey // 64 % 64 AS y, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE 1 + o_orderkey % 64 // 16 + 4 * (o_orderkey // 64 % 64 // 16) END AS label FROM orders),
r AS (SELECT * FROM px WHERE label > 0),
hit AS (SELECT p.plan, p.x, p.y, p.label, q.label AS other, CASE WHEN q.y = p.y THEN 1 WHEN q.x = p.x THEN 2 WHEN q.x > p.x THEN 3 ELSE 4 END AS turn FROM r p JOIN r q ON p.plan = q.plan AND p.label <> q.label AND ((q.y = p.y AND q.x = p.x + 1) OR (q.y = p.y + 1 AND abs(q.x - p.x) <= 1))),
c AS (SELECT plan, x, y, least(label, other) AS a, greatest(label, other) AS b, y * 64 + x AS id FROM hit QUALIFY row_number() OVER (PARTITION BY plan, x, y ORDER BY turn) = 1),
near AS (SELECT p.plan, p.a, p.b, p.id AS u, q.id AS v FROM c p JOIN c q ON p.plan = q.plan AND p.a = q.a AND p.b = q.b AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1),
reach AS (SELECT plan, a, b, u, v FROM near UNION SELECT reach.plan, reach.a, reach.b, reach.u, near.v FROM reach JOIN near ON near.plan = reach.plan AND near.a = reach.a AND near.b = reach.b AND near.u = reach.v),
named AS (SELECT plan, a, b, u, min(v) AS patch FROM reach GROUP BY ALL)
SELECT plan, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, patch // 64 AS py, patch % 64 AS px, count(*) AS n, round(avg(u % 64), 6) AS cx, round(avg(u // 64), 6) AS cy, min(u % 64) AS x0, min(u // 64) AS y0, max(u % 64) AS x1, max(u // 64) AS y1 FROM named GROUP BY plan, a, b, patch""",
    "cloud_spacing": """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT p.label, p.vec_id, q.vec_id AS other, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS distance FROM e p JOIN e q ON p.label = q.label AND p.vec_id <> q.vec_id),
k AS (SELECT label, vec_id, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS rank FROM d)
SELECT label, vec_id, rank, round(distance, 6) AS distance FROM k WHERE rank <= 2""",
    "mesh_totals": f"""WITH {_ROOMS},
m AS (SELECT room.*, o_orderpriority AS provenance, l_partkey % 3 * 0.25::DOUBLE + 2.25::DOUBLE AS height, l_partkey % 3 = 0 AS ell FROM room JOIN orders ON o_orderkey = k),
corner AS (SELECT k, id, height, provenance, unnest(CASE WHEN ell THEN [[x, y, x + w, y], [x + w, y, x + w, y + h / 2], [x + w, y + h / 2, x + w / 2, y + h / 2], [x + w / 2, y + h / 2, x + w / 2, y + h], [x + w / 2, y + h, x, y + h], [x, y + h, x, y]]
  ELSE [[x, y, x + w, y], [x + w, y, x + w, y + h], [x + w, y + h, x, y + h], [x, y + h, x, y]] END) AS s, unnest(range(CASE WHEN ell THEN 6 ELSE 4 END)) AS wall FROM m),
e AS (SELECT k, id, height, provenance, wall, s[1] AS px, s[2] AS py, s[3] - s[1] AS dx, s[4] - s[2] AS dy, abs(s[3] - s[1]) + abs(s[4] - s[2]) AS len FROM corner),
o AS (SELECT k, x + w / 4 AS ox, y + 0.125::DOUBLE AS oy, CASE WHEN l_partkey % 4 = 0 THEN 0.85::DOUBLE ELSE l_partkey % 4 * 0.5::DOUBLE END AS width, CASE WHEN l_partkey % 2 = 0 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS sill,
  CASE WHEN l_partkey % 7 = 0 THEN 2.5::DOUBLE WHEN l_partkey % 2 = 0 THEN 2.04::DOUBLE ELSE 2.1::DOUBLE END AS head FROM m WHERE l_partkey % 5 > 0),
c AS (SELECT e.*, greatest(0, t - width / 2 / len) AS t0, least(1, t + width / 2 / len) AS t1, sill, head FROM (SELECT e.*, o.*, ((ox - px) * dx + (oy - py) * dy) / (len * len) AS t, abs((oy - py) * dx - (ox - px) * dy) / len AS off FROM e JOIN o ON o.k = e.k) e WHERE t BETWEEN 0 AND 1 AND off <= 0.45::DOUBLE),
n AS (SELECT *, coalesce(max(t1) OVER (PARTITION BY k, id, wall ORDER BY t0, t1, sill, head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM c),
q AS (SELECT provenance, len, cursor AS a, greatest(cursor, t0) AS b, 0.0::DOUBLE AS z0, height AS z1 FROM n UNION ALL SELECT provenance, len, greatest(cursor, t0), greatest(cursor, t1), 0.0::DOUBLE, sill FROM n
  UNION ALL SELECT provenance, len, greatest(cursor, t0), greatest(cursor, t1), least(height, head), height FROM n
  UNION ALL SELECT provenance, len, coalesce(til, 0), 1.0::DOUBLE, 0.0::DOUBLE, height FROM e LEFT JOIN (SELECT k, id, wall, max(t1) AS til FROM c GROUP BY k, id, wall) USING (k, id, wall))
SELECT provenance, 'wall' AS part, 2 * count(*) AS triangles, round(sum((b - a) * len * (z1 - z0)), 2) AS area, true AS whole FROM q WHERE b > a AND z1 > z0 GROUP BY provenance
UNION ALL SELECT provenance, part, sum(CASE WHEN ell THEN 4 ELSE 2 END)::BIGINT, round(sum(CASE WHEN ell THEN w * h * 0.75 ELSE w * h END), 2), true FROM m, (SELECT unnest(['floor', 'ceiling']) AS part) GROUP BY provenance, part""",
    "tile_merge": """WITH r AS (SELECT p_partkey, CAST(p_partkey % 40 * 60 AS DOUBLE) AS x, CAST(p_partkey // 40 * 25 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 17 + 3 AS DOUBLE) AS h FROM part),
t AS (SELECT *, unnest(range(0, 20)) AS tx FROM r), u AS (SELECT *, greatest(0, CAST(floor(y / 150) AS BIGINT) - 1) + unnest(range(0, 2)) AS ty FROM t),
whole AS (SELECT p_partkey, x, y, w * h AS area, ty * 1000 + tx AS tile FROM u WHERE x >= tx * 150 AND x + w <= tx * 150 + 200 AND y >= ty * 150 AND y + h <= ty * 150 + 200)
SELECT p_partkey, min(tile) AS tile, area, x AS x0, y AS y0 FROM whole GROUP BY p_partkey, area, x, y""",
    "words_in_reach": f"""WITH w AS (SELECT l_suppkey, CAST(l_orderkey * 64 + {_NTH} AS BIGINT) AS id, CAST(l_orderkey * 37 % 2000 AS DOUBLE) AS x, CAST(l_partkey * 53 % 3000 AS DOUBLE) AS y, CAST(CAST(l_quantity AS BIGINT) % 30 + 5 AS DOUBLE) AS w,
  CAST(CASE WHEN l_linenumber % 5 = 0 THEN 40 + CAST(l_quantity AS BIGINT) ELSE 4 + CAST(l_quantity AS BIGINT) % 6 END AS DOUBLE) AS h FROM lineitem),
p AS (SELECT s.l_suppkey, s.id AS a, t.id AS b, greatest(0, greatest(s.x, t.x) - least(s.x + s.w, t.x + t.w)) AS dx, greatest(0, greatest(s.y, t.y) - least(s.y + s.h, t.y + t.h)) AS dy, greatest(s.h, t.h) * 1.2::DOUBLE AS reach FROM w s JOIN w t ON s.l_suppkey = t.l_suppkey AND s.id < t.id)
SELECT l_suppkey, a, b, round(dx + dy, 4) AS gap FROM p WHERE dx < reach AND dy < reach""",
}
