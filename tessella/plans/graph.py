"""Graph, neighbour and spatial queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import graph as op
from tessella.operators import spatial as sp
from tessella.operators.quantiles import quantiles
from tessella.sources.tables import table


def adjacency_pairs(spark, d):
    s = table(spark, d, "supplier")
    out = op.band_pairs(s, "s_nationkey", "s_suppkey", "s_acctbal", 900.0)
    return out.select("s_nationkey", "x", "y", F.round("gap", 4).alias("gap"))


def door_adjacency(spark, d):
    """Parts that share an order, with the largest shipment between them as the door."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").toDF("o", "p", "q").filter("o is not null and p is not null")
    # an order's lines are brought together once, and pairs are made in its row
    lines = l.groupBy("o").agg(F.collect_list(F.struct("p", "q")).alias("x")).withColumn("y", F.col("x"))
    pairs = lines.select("o", "y", F.explode("x").alias("s")).select("o", "s", F.explode(F.filter("y", lambda v: v["p"] > F.col("s.p"))).alias("t"))
    return op.widest_door(pairs.select(F.col("s.p").alias("a"), F.col("t.p").alias("b"), F.when(F.col("s.q") > 25, F.col("s.q")).alias("width"), F.col("o").alias("aperture_id")))


def edge_metrics(spark, d):
    """Part-supplier edges of a year against the next's."""
    l = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    out = op.edge_metrics(l, l.select((F.col("year") - 1).alias("year"), "a", "b"), "year")
    return out.withColumn("jaccard", F.round("jaccard", 6))


def components(spark, d):
    """Components of all orders, each linked with its customer's order before it: long paths."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(w).alias("b"))
    return op.components(o.filter("b is not null"), "a", "b")


def phash_duplicates(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", op.hash_bits(F.transform("embedding", lambda v: v.cast("double"))).alias("phash"))
    return op.first_seen(e, "phash", "vec_id").select("vec_id", "phash", "first_id", "duplicate")


def first_seen_duplicates(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return op.first_seen(t, "sha", "doc_id").select("doc_id", "first_id", "duplicate")


def centroid_argmax(spark, d):
    e = table(spark, d, "embeddings")
    return op.nearest_centroid(e, "vec_id", "embedding", "label").select("vec_id", "label", "nearest")


def nearest_neighbour(spark, d):
    """Nearest other vector of the same label, for vectors whose id ends in 0, in blocks of a label's vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    near = op.nearest_of_group(e, F.col("vec_id") % 10 == 0, "label", "vec_id", "v")
    return near.select("query_id", "vec_id", F.col("distance").alias("dist"))


def neighbour_spacing(spark, d):
    """Median distance to the second nearest event of a user's day, and the widest gap."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    near = [F.abs(f("t", k).over(w) - F.col("t")) for f in (F.lag, F.lead) for k in (1, 2)]
    second = F.get(F.array_sort(F.filter(F.array(*near), lambda x: x.isNotNull())), F.lit(1))
    return e.withColumn("second", second).groupBy("user_id").agg(F.median("second").alias("spacing"), F.max("second").alias("widest"))


def cloud_summary(spark, d):
    """Per label, of points in the plane: how far the two that are furthest apart are, and the count,
    extent and mean of those above the 40th percentile. The two lie on the hull of the points, so
    only its corners meet: the hull of parts of a label is taken first, then that of the parts'."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    q = quantiles(e, ["label"], "x", {"p40": 0.4})
    kept = e.join(q, "label").filter(F.col("x") > F.col("p40"))
    summary = kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("y") - F.min("y"), 6).alias("extent"), F.round(F.avg("x"), 6).alias("mean_x"))
    return summary.join(sp.widest_pair(e, "label", "vec_id"), "label").withColumn("widest", F.round("widest", 6))


def _cloud(spark, d):
    """Events as points of rooms (users): a floor, a ceiling and noise."""
    e = table(spark, d, "events")
    layer = F.when(F.col("event_id") % 5 < 2, 0.0).when(F.col("event_id") % 5 < 4, 2.5).otherwise(F.col("event_id") % 23 / 9.0)
    return e.select(F.col("user_id").alias("room"), F.col("event_id").alias("point_id"), ((F.col("event_id") * 37) % 401 / 100.0).alias("x"), ((F.col("event_id") * 53) % 307 / 100.0).alias("y"), (layer + F.col("event_id") % 7 / 100.0).alias("z"), (F.col("value") / 50.0).alias("conf"))


def clip_reasons(spark, d):
    out = sp.clip_reasons(_cloud(spark, d), "room")
    return out.groupBy("room", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def footprints(spark, d):
    out = sp.footprint(_cloud(spark, d), "room")
    return out.select("room", "angle", F.round("width", 7).alias("width"), F.round("depth", 7).alias("depth"))


def wall_inliers(spark, d):
    four = [(0, 1.0, 0.0, 0.0), (1, 1.0, 0.0, 4.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 1.0, 3.06)]
    walls = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("wall_id", "nx", "ny", "offset"), w)]) for w in four])
    pts = _cloud(spark, d)
    rooms = pts.select("room").distinct().select("room", F.explode(walls).alias("w")).select("room", "w.*")
    out = sp.wall_inliers(pts, rooms, "room")
    return out.select("room", F.col("wall_id").cast("long").alias("wall_id"), "n", F.round("inlier_fraction", 6).alias("inlier_fraction"))


def wall_panels(spark, d):
    """Orders as walls, lines as cuts: what stays solid between them."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.lit(50.0).alias("length"), F.col("l_quantity").alias("c0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("c1"))
    out = sp.wall_panels(l, "l_orderkey", "length")
    return out.select("l_orderkey", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"))


def up_directions(spark, d):
    """Up vector of each room's cloud (seeded search; no SQL)."""
    out = sp.up_direction(_cloud(spark, d), "room")
    return out.select("room", *[F.round(c, 6).alias(c) for c in ("ux", "uy", "uz", "score")])


def wall_openings(spark, d):
    """Openings of walls (users): empty cells of a coverage grid in connected rectangles."""
    e = table(spark, d, "events")
    have = e.groupBy("user_id", (F.hour("ts").cast("long")).alias("cx"), (F.dayofmonth("ts") % 8).cast("long").alias("cy")).count().filter("count >= 1").drop("count")
    grid = e.select("user_id").distinct().withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("user_id", F.col("cx").cast("long"), F.col("cy").cast("long"))
    return sp.grid_components(grid.join(have, ["user_id", "cx", "cy"], "left_anti"), "user_id")


def _words(spark, d):
    """Parts as words, 30 a sheet."""
    p = table(spark, d, "part")
    return p.select(F.expr("p_partkey div 900 * 30 + p_partkey % 30").alias("sheet"), F.col("p_partkey").alias("word_id"), "p_name", (F.col("p_size") * 2.0).alias("conf"), (F.col("p_partkey") * 7 % 60 * 1.5).cast("double").alias("x"), (F.col("p_partkey") * 11 % 40 * 1.5).cast("double").alias("y"), (F.length("p_name") * 0.5).cast("double").alias("w"), F.lit(4.0).alias("h"), F.split("p_name", " ")[1].alias("text"))


def suppressed_words(spark, d):
    return sp.suppress_words(_words(spark, d).drop("p_name"), "sheet").select("sheet", "word_id", "text")


def caption_clusters(spark, d):
    w = _words(spark, d).select("sheet", "word_id", "x", "y", "w", "h", (F.col("word_id") % 4 == 0).alias("is_label"))
    return sp.cluster_captions(w, "sheet").select("sheet", "word_id", "cluster")


def _shapes(spark, d):
    """Parts as rectangles, 40 a listing."""
    p = table(spark, d, "part").select(F.expr("p_partkey div 800 * 20 + p_partkey % 20").alias("listing"), F.col("p_partkey").alias("poly_id"), g.rectangle((F.col("p_partkey") * 13 % 50).cast("double"), (F.col("p_partkey") * 29 % 50).cast("double"), F.col("p_size") / 3.0, F.col("p_partkey") % 11 + 2.0).alias("r"))
    return p.select("listing", "poly_id", F.transform("r", lambda v: F.array(v["x"], v["y"])).alias("p"))


def suppressed_overlaps(spark, d):
    return sp.suppress_overlaps(_shapes(spark, d), "listing").select("listing", "poly_id")


def tidied_polygons(spark, d):
    return sp.suppress_overlaps(_shapes(spark, d), "listing", 0.35, 0.06).select("listing", "poly_id")


def island_links(spark, d):
    pts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("floor"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 97 % 1000).cast("double").alias("y"))
    edges = op.band_links(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 600.0).withColumnRenamed("s_nationkey", "floor")
    return op.join_islands(pts, edges, "floor")


_CLOUD = """
c AS (SELECT user_id AS room, event_id AS point_id, (event_id * 37) % 401 / 100.0::DOUBLE AS x, (event_id * 53) % 307 / 100.0::DOUBLE AS y,
  CASE WHEN event_id % 5 < 2 THEN 0.0::DOUBLE WHEN event_id % 5 < 4 THEN 2.5::DOUBLE ELSE event_id % 23 / 9.0::DOUBLE END + event_id % 7 / 100.0::DOUBLE AS z, value / 50.0::DOUBLE AS conf FROM events)"""

QUERIES = {
    f.__name__: f
    for f in (adjacency_pairs, door_adjacency, edge_metrics, components, phash_duplicates, first_seen_duplicates, centroid_argmax, nearest_neighbour, neighbour_spacing, cloud_summary, clip_reasons, footprints, wall_inliers, wall_panels, up_directions, wall_openings, suppressed_words, caption_clusters, suppressed_overlaps, tidied_polygons, island_links)
}
ORACLES = {
    "adjacency_pairs": "SELECT a.s_nationkey, a.s_suppkey AS x, b.s_suppkey AS y, round(abs(a.s_acctbal - b.s_acctbal), 4) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) <= 900",
    "door_adjacency": """
WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem),
x AS (SELECT a.p AS a, b.p AS b, a.q AS q, a.o AS o FROM l a JOIN l b ON a.o = b.o AND a.p < b.p), w AS (SELECT a, b, max((q, o)) AS m FROM x WHERE q > 25 GROUP BY 1, 2)
SELECT e.a, e.b, w.m[1] AS width, w.m[2] AS aperture_id, w.m IS NOT NULL AS door FROM (SELECT DISTINCT a, b FROM x) e LEFT JOIN w ON e.a = w.a AND e.b = w.b""",
    "edge_metrics": """
WITH t AS (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS y, l_partkey AS a, l_suppkey AS b FROM lineitem), j AS (SELECT coalesce(t.y, u.y - 1) AS year, t.y IS NOT NULL AS t, u.y IS NOT NULL AS u FROM t FULL JOIN t u ON t.y = u.y - 1 AND t.a = u.a AND t.b = u.b),
c AS (SELECT year, count(*) FILTER (t AND u) AS shared, count(*) FILTER (t AND NOT u) AS missing, count(*) FILTER (u AND NOT t) AS extra FROM j GROUP BY 1)
SELECT *, round(shared / greatest(1, shared + missing + extra)::DOUBLE, 6) AS jaccard FROM c""",
    "components": """
WITH RECURSIVE o AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), e AS (SELECT a, b FROM o WHERE b IS NOT NULL),
s AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e), r(node, c) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.node WHERE r.c < s.v)
SELECT node, min(c) AS component FROM r GROUP BY 1""",
    "phash_duplicates": """
WITH m AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), b AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > list_sum(v) / len(v) THEN 1 ELSE 0 END) AS bits FROM m),
h AS (SELECT vec_id, array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + bits[4 * k + 1] * 8 + bits[4 * k + 2] * 4 + bits[4 * k + 3] * 2 + bits[4 * k + 4], 1)), '') AS phash FROM b)
SELECT vec_id, phash, min(vec_id) OVER (PARTITION BY phash) AS first_id, vec_id <> min(vec_id) OVER (PARTITION BY phash) AS duplicate FROM h""",
    "first_seen_duplicates": "SELECT doc_id, min(doc_id) OVER w AS first_id, doc_id <> min(doc_id) OVER w AS duplicate FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))",
    "centroid_argmax": """
WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS p FROM embeddings), c AS (SELECT label AS cl, p, avg(v) AS m FROM f GROUP BY 1, 2),
n AS (SELECT cl, sqrt(sum(m * m)) AS n FROM c GROUP BY 1), s AS (SELECT vec_id, label, c.cl, sum(v * m) / any_value(n) AS s FROM f JOIN c ON f.p = c.p JOIN n ON n.cl = c.cl GROUP BY 1, 2, 3)
SELECT vec_id, label, cl AS nearest FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cl) = 1""",
    "nearest_neighbour": """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT q.vec_id AS query_id, e.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - q.v[i]) * (e.v[i] - q.v[i])))), 6) AS dist FROM e q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 10 = 0)
SELECT query_id, vec_id, dist FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) = 1""",
    "neighbour_spacing": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events), w AS (SELECT user_id, list_sort(list_filter([abs(lag(t, 1) OVER s - t), abs(lag(t, 2) OVER s - t), abs(lead(t, 1) OVER s - t), abs(lead(t, 2) OVER s - t)], lambda x: x IS NOT NULL))[2] AS g FROM e WINDOW s AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, median(g) AS spacing, max(g) AS widest FROM w GROUP BY 1""",
    "cloud_summary": """
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), q AS (SELECT label, quantile_cont(x, 0.4) AS p FROM e GROUP BY 1)
, w AS (SELECT a.label, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS widest FROM e a JOIN e b ON a.label = b.label GROUP BY 1)
SELECT e.label, count(*) AS n, round(max(y) - min(y), 6) AS extent, round(avg(x), 6) AS mean_x, any_value(widest) AS widest FROM e JOIN q ON e.label = q.label JOIN w ON e.label = w.label WHERE x > p GROUP BY 1""",
    "clip_reasons": f"""
WITH {_CLOUD}, q AS (SELECT room, quantile_cont(conf, 0.1) AS qc, median(x) AS mx, median(y) AS my, quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1 FROM c GROUP BY 1),
f AS (SELECT c.*, qc, z0, z1, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r FROM c JOIN q ON c.room = q.room), l AS (SELECT room, least(6, quantile_cont(r, 0.98)) AS lim FROM f GROUP BY 1)
SELECT f.room, CASE WHEN conf < qc THEN 'low_confidence' WHEN r > lim THEN 'far' WHEN z < z0 - 0.35 OR z > z1 + 0.35 THEN 'height' ELSE 'kept' END AS reason, count(*) AS n FROM f JOIN l ON f.room = l.room GROUP BY 1, 2""",
    "footprints": f"""
WITH {_CLOUD}, t AS (SELECT room, a, x * cos(radians(a::DOUBLE)) + y * sin(radians(a::DOUBLE)) AS u, y * cos(radians(a::DOUBLE)) - x * sin(radians(a::DOUBLE)) AS v FROM c, (SELECT unnest(range(90)) AS a)),
b AS (SELECT room, a, round((quantile_cont(u, 0.99) - quantile_cont(u, 0.01)) * (quantile_cont(v, 0.99) - quantile_cont(v, 0.01)), 6) AS area, quantile_cont(u, 0.985) - quantile_cont(u, 0.015) AS w, quantile_cont(v, 0.985) - quantile_cont(v, 0.015) AS d FROM t GROUP BY 1, 2)
SELECT room, a AS angle, round(w, 7) AS width, round(d, 7) AS depth FROM b QUALIFY row_number() OVER (PARTITION BY room ORDER BY area, a) = 1""",
    "wall_inliers": f"""
WITH {_CLOUD}, w(wall_id, nx, ny, o) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.0, 4.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 1.0, 3.06)), d AS (SELECT room, wall_id, abs(x * nx + y * ny - o) AS d FROM c, w)
SELECT room, CAST(wall_id AS BIGINT) AS wall_id, count(*) AS n, round(avg((d < 0.12)::INT), 6) AS inlier_fraction FROM d GROUP BY 1, 2""",
    "wall_panels": """
WITH c AS (SELECT l_orderkey, l_quantity AS c0, l_quantity + l_linenumber AS c1 FROM lineitem),
p AS (SELECT l_orderkey, greatest(0, coalesce(max(c1) OVER (PARTITION BY l_orderkey ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t0, least(50, c0) AS t1 FROM c UNION ALL SELECT l_orderkey, max(c1), 50 FROM c GROUP BY 1)
SELECT l_orderkey, round(t0, 4) AS t0, round(t1, 4) AS t1 FROM p WHERE t1 - t0 > 1e-9""",
}
