"""Stage queries over the driver tables, whose shapes stand in for rooms, images and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import stages as op
from tessella.sources.tables import table

LABELS = ("bathroom", "kitchen", "bedroom", "hallway", "garden")


def _images(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_suppkey").alias("listing"), F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("label"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image"), F.col("l_partkey").alias("part"))


def usable_images(spark, d):
    calibrated = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("part"))
    kept = op.usable_images(_images(spark, d), calibrated, "part")
    none = op.usable_images(_images(spark, d), calibrated.filter("part < 0"), "part")
    return kept.groupBy("listing").agg(F.count(F.lit(1)).alias("kept")).join(none.groupBy("listing").agg(F.count(F.lit(1)).alias("unfiltered")), "listing")


def top_views(spark, d):
    im = _images(spark, d).groupBy("image").agg(F.min(F.struct("listing", "label", "score")).alias("s")).select("image", "s.*")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("listing"), (F.col("s_suppkey") % 4).cast("int").alias("bedrooms"))
    out = op.top_views(im.join(s, "listing"), "listing", "label", "score", "image", F.col("label") == "kitchen", F.col("bedrooms"))
    return out.select("listing", "label", "image", F.col("place").cast("long").alias("place"))


def room_type_views(spark, d):
    """Labels of a listing with three images at least: how many, best and worst score, and the eight
    best images."""
    im = _images(spark, d)
    kinds = im.groupBy("listing", "label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("worst")).filter("n >= 3")
    top = op.top_views(im, "listing", "label", "score", "image", F.lit(True), F.lit(None).cast("int"))
    views = top.groupBy("listing", "label").agg(F.array_sort(F.collect_list(F.struct("place", "image"))).alias("v"))
    return kinds.join(views, ["listing", "label"]).select("listing", "label", "n", "best", "worst", F.array_join(F.transform("v", lambda x: x["image"].cast("string")), ",").alias("views"))


def largest_asset(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return op.largest_asset(o, "o_custkey", "o_totalprice", "o_orderkey")


def choose_scale(spark, d):
    l = table(spark, d, "lineitem")
    source = F.element_at(F.array(F.lit("printed_dimensions"), F.lit("stated_area"), F.lit("printed_area"), F.lit("scale_ratio")), (F.col("l_partkey") % 4 + 1).cast("int"))
    c = l.select("l_orderkey", source.alias("source"), F.col("l_quantity").alias("px"), (F.col("l_extendedprice") / 1e5).alias("weight"))
    out = op.choose_scale(c, "l_orderkey")
    return out.withColumn("disagreement_pct", F.round("disagreement_pct", 4))


def choose_reading(spark, d):
    p = table(spark, d, "part")
    c = op.choose_reading((F.col("p_size") % 10) / 10.0, F.col("p_size") * 1.0, (F.col("p_partkey") % 10) / 10.0, (F.col("p_partkey") % 50) * 1.0)
    return p.select("p_partkey", c.alias("c")).select("p_partkey", "c.pick", "c.close_call", "c.on_coverage")


def _rooms(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 300).alias("flat"), F.col("p_partkey").alias("room_id"), F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_size") % 5 + 1).cast("int")).alias("label"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 10.0).alias("height"), (F.col("p_size") / 4.0).alias("extent"))


def ceilings(spark, d):
    out = op.ceilings(_rooms(spark, d), "flat", "height", F.lit(1.1))
    return out.select("room_id", F.round("ceiling", 4).alias("ceiling"), "ceiling_source")


def plausibility(spark, d):
    out = op.plausibility(_rooms(spark, d), "flat")
    return out.select("flat", "n_rooms", "n_with_height", "outdoor", F.round("median_height", 4).alias("median_height"), F.round("plausible", 4).alias("plausible"), "max_extent", "any_over_12")


def _cloud(spark, d):
    e = table(spark, d, "events")
    layer = F.when(F.col("event_id") % 5 < 2, 0.0).when(F.col("event_id") % 5 < 4, (F.col("user_id") % 7) * 0.6).otherwise(F.col("event_id") % 23 / 9.0)
    return e.select("user_id", ((F.col("event_id") * 37) % 401 / 20.0).alias("x"), ((F.col("event_id") * 53) % 307 / 100.0).alias("y"), layer.alias("z"), F.lit(0.0).alias("lo"), F.when(F.col("user_id") % 7 > 0, (F.col("user_id") % 7) * 0.6).alias("hi"))


def surfaces_visible(spark, d):
    return op.surfaces_visible(_cloud(spark, d), "user_id", "lo", "hi")


def oriented_cloud(spark, d):
    """Turned into the frame of each room's up vector: heights stay what the up axis says. Norms lose the digits that
    turning and the order of sums leave, so that halves are rounded up."""
    c = _cloud(spark, d).withColumn("ux", F.lit(0.0)).withColumn("uy", F.lit(0.6)).withColumn("uz", F.lit(0.8))
    out = op.oriented(c, "user_id", ("ux", "uy", "uz"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("flipped").alias("flipped"), F.round(F.max(F.abs("h")), 5).alias("highest"), F.round(F.round(F.sum(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("h") * F.col("h")), 7), 3).alias("norm"))


def aperture_kinds(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy(op.aperture_kind(F.col("l_quantity"), F.col("l_linenumber"), F.when(F.col("l_partkey") % 3 > 0, 18.0)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def basin_contacts(spark, d):
    """Label grids of 40 by 25 pixels, one for each of 20 plans."""
    px = spark.range(20 * 1000).select((F.col("id") % 20).alias("plan"), (F.floor(F.col("id") / 20) % 40).alias("x"), F.floor(F.col("id") / 800).alias("y"))
    px = px.withColumn("label", F.when((F.col("x") % 13 == 12) & (F.col("y") != 5), 0).otherwise(F.floor(F.col("x") / 13) + F.floor((F.col("y") + F.col("plan")) / 9) * 4 + 1))
    return op.basin_contacts(px, "plan")


def aperture_walls(spark, d):
    """Suppliers' points against the edges of their nation's square."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("aperture_id"), (F.col("s_suppkey") % 11).cast("double").alias("ax"), ((F.col("s_suppkey") % 5) * 0.1).alias("ay"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    e = n.select("s_nationkey", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("edge_id", "x0", "y0", "x1", "y1"), (i, *map(float, q)))]) for i, q in enumerate(((0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)))])).alias("e")).select("s_nationkey", "e.*")
    out = op.wall_of_aperture(s, e, "s_nationkey")
    return out.select("aperture_id", F.col("edge_id").cast("long"), F.round("t", 6).alias("t"), F.round("off", 6).alias("off"))


def cumulative_keep(spark, d):
    return op.cumulative_keep(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


def scene_rooms(spark, d):
    """Parts as plan rooms, large line items as matches, suppliers as layouts."""
    plan = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("flat"), F.col("p_partkey").alias("plan_room_id"))
    matches = table(spark, d, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_partkey").alias("plan_room_id")).agg(F.min("l_suppkey").alias("room_id")).withColumn("flat", F.col("plan_room_id") % 100)
    layouts = table(spark, d, "supplier").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("flat"), F.col("s_suppkey").alias("room_id"), "s_acctbal")
    out = op.scene_rooms(plan, matches, layouts, "flat")
    return out.groupBy("flat").agg(F.count(F.lit(1)).alias("rooms"), F.count_if(F.col("provenance") == "reconstructed").alias("reconstructed"), F.round(F.sum("s_acctbal"), 2).alias("area"))


def two_hop_join(spark, d):
    """Matches to layouts to plan rooms: unmatched ones drop out on the way."""
    l, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    j = l.join(p.filter("p_size > 40").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).join(s.filter("s_acctbal > 0").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


def semi_and_anti(spark, d):
    """Wanted, known and not yet present: customers with orders of one status and none of another."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    known, present = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey")) for s in ("F", "P"))
    return c.join(known, "c_custkey", "left_semi").join(present, "c_custkey", "left_anti").select("c_custkey")


def photos_by_room(spark, d):
    """Images gathered by the room of their label."""
    im = _images(spark, d)
    return im.groupBy("listing", "label").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("image")), 1, 12), lambda x: x.cast("string")), ",").alias("photos"), F.count(F.lit(1)).alias("n"))


def bounding_boxes(spark, d):
    return _cloud(spark, d).groupBy("user_id").agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for f, k in ((F.min, 0), (F.max, 1))])


def annotation_coverage(spark, d):
    """Labelled documents per source: covered, partly or not."""
    t, l = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit"))
    g = t.join(l, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("annotated"))
    share = F.col("annotated") / F.col("n")
    return g.select("source", "n", "annotated", F.when(share >= 0.5, "covered").when(share >= 0.3, "partly").otherwise("sparse").alias("state"))


def tiles(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 100).cast("int").alias("w"), (F.col("p_partkey") % 30 * 30 + 200).cast("int").alias("h"))
    return p.select("p_partkey", op.tile_boxes(F.col("w"), F.col("h"), 640).alias("t"), "w", "h").select("p_partkey", F.size("t").cast("long").alias("n"), F.array_max(F.transform("t", lambda v: v["x"])).cast("long").alias("last_x"), F.array_max(F.transform("t", lambda v: v["y"])).cast("long").alias("last_y"))


def letterbox_undo(spark, d):
    p = table(spark, d, "part")
    out = op.unletterbox(F.lit(100.0), F.lit(200.0), F.col("p_size") * 10.0, F.col("p_partkey") % 90 + 60.0, 512)
    return p.select("p_partkey", F.round(out["x"], 5).alias("x"), F.round(out["y"], 5).alias("y"))


def grid_normals(spark, d):
    """A tilted plane's depth grid: the same normal everywhere but at the far edges."""
    g = spark.range(12 * 15 * 20).select((F.col("id") % 12).alias("image"), (F.floor(F.col("id") / 12) % 15).alias("row"), F.floor(F.col("id") / 180).alias("col"))
    g = g.select("image", "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("col") * 0.5 + F.col("row") * F.col("image") * 0.25).alias("z"))
    out = op.grid_normals(g, "image")
    return out.groupBy("image").agg(F.count("nx").alias("n"), F.round(F.avg("nx"), 6).alias("nx"), F.round(F.avg("ny"), 6).alias("ny"), F.round(F.avg("nz"), 6).alias("nz"))


def unprojected(spark, d):
    l = table(spark, d, "lineitem")
    out = op.unproject(F.col("l_quantity") * 10, F.col("l_linenumber") * 50.0, F.col("l_tax") + 1, F.lit(640.0), F.lit(480.0), F.lit(98.6))
    return l.select("l_orderkey", "l_linenumber", F.round(out["x"], 6).alias("x"), F.round(out["y"], 6).alias("y"), F.round(out["z"], 6).alias("z"))


def total_area_metric(spark, d):
    """M1: model against the printed total, else the stated area."""
    o = table(spark, d, "orders")
    m = op.area_metric(F.col("o_totalprice") / 1000, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") * 0.3), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") * 0.4))
    return o.select("o_orderkey", m.alias("m")).select("o_orderkey", F.round("m.error_pct", 9).alias("error_pct"), "m.reference")


def missing_stage_report(spark, d):
    """Which event types (as stages) a user's day lacks; none if it is complete."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    kinds = ("click", "error", "purchase", "signup", "view")
    g = e.groupBy("user_id", "day").agg(*[F.bool_or(F.col("event_type") == k).alias(k) for k in kinds])
    return g.select("user_id", F.col("day").cast("string").alias("day"), F.array_join(op.missing_stages({k: F.col(k) for k in kinds}), ",").alias("missing"))


def confidence_product(spark, d):
    """Confidence of an order: mean of its lines', times what its status leaves, clamped."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    m = l.groupBy("l_orderkey").agg(F.avg(1 - F.col("l_discount")).alias("c"))
    out = F.greatest(F.lit(0.02), F.least(F.lit(1.0), F.col("c") * F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.8)))
    return m.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.round(out, 6).alias("confidence"))


def provenance_groups(spark, d):
    """Shell totals per provenance: pieces, area and share."""
    s = scene_rooms(spark, d)
    return s.agg(F.sum("rooms").alias("rooms"), F.sum("reconstructed").alias("reconstructed"), F.round(F.sum("reconstructed") / F.greatest(F.lit(1), F.sum("rooms")), 6).alias("coverage"))


def stage_names(spark, d):
    """Stage names given as a number, a word or both, brought to one form."""
    from tessella.plans.quality import STAGES

    names = spark.createDataFrame([(i, s) for i, s in enumerate(STAGES)], "place int, stage string")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = F.col("l_linenumber") % 10
    word = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (n + 1).cast("int"))
    given = l.withColumn("given", F.when(F.col("l_orderkey") % 3 == 0, n.cast("string")).when(F.col("l_orderkey") % 3 == 1, word).otherwise(F.concat(n.cast("string"), F.lit("-"), word)))
    hit = (F.col("given") == F.col("place").cast("string")) | (F.col("given") == F.col("stage")) | (F.col("given") == F.concat(F.col("place").cast("string"), F.lit("-"), F.col("stage")))
    return given.join(F.broadcast(names), hit).select("l_orderkey", "l_linenumber", "stage")


_LAB = "['bathroom', 'kitchen', 'bedroom', 'hallway', 'garden']"
_IM = f"im AS (SELECT l_suppkey AS listing, {_LAB}[l_partkey % 5 + 1] AS label, l_discount AS score, l_orderkey * 10 + l_linenumber AS image, l_partkey AS part FROM lineitem)"
_RM = f"r AS (SELECT p_partkey % 300 AS flat, p_partkey AS room_id, {_LAB}[p_size % 5 + 1] AS label, CASE WHEN p_size % 3 > 0 THEN p_size / 10.0::DOUBLE END AS height, p_size / 4.0::DOUBLE AS extent FROM part)"
_CL = """c AS (SELECT user_id, (event_id * 37) % 401 / 20.0::DOUBLE AS x, (event_id * 53) % 307 / 100.0::DOUBLE AS y, CASE WHEN event_id % 5 < 2 THEN 0.0::DOUBLE WHEN event_id % 5 < 4 THEN user_id % 7 * 0.6::DOUBLE ELSE event_id % 23 / 9.0::DOUBLE END AS z, CASE WHEN user_id % 7 > 0 THEN user_id % 7 * 0.6::DOUBLE END AS hi FROM events)"""
_SCENE = """
m AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem WHERE l_quantity >= 49 GROUP BY 1),
sc AS (SELECT p_partkey % 100 AS flat, count(*) AS rooms, count(m.s) AS reconstructed, round(sum(s_acctbal), 2) AS area FROM part LEFT JOIN m ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = m.s GROUP BY 1)"""

QUERIES = {
    f.__name__: f
    for f in (usable_images, top_views, room_type_views, largest_asset, choose_scale, choose_reading, ceilings, plausibility, surfaces_visible, oriented_cloud, aperture_kinds, basin_contacts, aperture_walls, cumulative_keep, scene_rooms, two_hop_join, semi_and_anti, photos_by_room, bounding_boxes, annotation_coverage, tiles, letterbox_undo, grid_normals, unprojected, total_area_metric, missing_stage_report, confidence_product, provenance_groups, stage_names)
}
ORACLES = {
    "usable_images": f"WITH {_IM} SELECT listing, count(*) FILTER (part IN (SELECT p_partkey FROM part WHERE p_size > 25)) AS kept, count(*) AS unfiltered FROM im GROUP BY 1",
    "top_views": f"""WITH {_IM}, u AS (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY image ORDER BY listing, label, score) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY listing, label ORDER BY score DESC, image) AS place FROM u)
SELECT listing, label, image, place FROM k WHERE place <= CASE WHEN label = 'kitchen' THEN 8 ELSE greatest(1, coalesce(nullif(listing % 4, 0), 2) + 1) END""",
    "room_type_views": f"WITH {_IM} SELECT listing, label, count(*) AS n, max(score) AS best, min(score) AS worst, array_to_string(list_transform(list((score, image) ORDER BY score DESC, image)[1:8], lambda x: CAST(x[2] AS VARCHAR)), ',') AS views FROM im GROUP BY 1, 2 HAVING count(*) >= 3",
    "largest_asset": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "choose_scale": """
WITH c AS (SELECT l_orderkey, ['printed_dimensions', 'stated_area', 'printed_area', 'scale_ratio'][l_partkey % 4 + 1] AS source, l_quantity AS px, l_extendedprice / 1e5::DOUBLE AS weight FROM lineitem),
r AS (SELECT *, CASE source WHEN 'printed_dimensions' THEN 3 WHEN 'printed_area' THEN 2 WHEN 'stated_area' THEN 1 ELSE 0 END AS r FROM c),
g AS (SELECT l_orderkey, max((r, weight, source, px)) AS t, max((r, weight, source, px)) FILTER (source IN ('printed_area', 'stated_area')) AS a, count(px) AS n, max(px) AS hi, min(px) AS lo FROM r GROUP BY 1),
f AS (SELECT *, coalesce(t[3] = 'printed_dimensions' AND greatest(t[4] / a[4], a[4] / t[4]) > 1.8, false) AS lost FROM g)
SELECT l_orderkey, CASE WHEN lost THEN a[3] ELSE t[3] END AS source, CASE WHEN lost THEN a[4] ELSE t[4] END AS px, lost AS overruled, round(CASE WHEN n > 1 THEN (hi - lo) / hi * 100 END, 4) AS disagreement_pct FROM f""",
    "choose_reading": """
WITH p AS (SELECT p_partkey, p_size % 10 / 10.0::DOUBLE AS fa, p_size::DOUBLE AS a, p_partkey % 10 / 10.0::DOUBLE AS fb, (p_partkey % 50)::DOUBLE AS b FROM part), k AS (SELECT *, a / greatest(a, b) >= 0.8 AS ka, b / greatest(a, b) >= 0.8 AS kb FROM p)
SELECT p_partkey, CASE WHEN ka AND NOT kb THEN 'a' WHEN kb AND NOT ka THEN 'b' WHEN fb > fa THEN 'b' ELSE 'a' END AS pick, ka AND kb AND abs(fa - fb) < 0.05::DOUBLE AS close_call, ka <> kb AS on_coverage FROM k""",
    "ceilings": f"""WITH {_RM}, h AS (SELECT flat, room_id, CASE WHEN height * 1.1::DOUBLE BETWEEN 2.0 AND 4.2 THEN height * 1.1::DOUBLE END AS own FROM r), f AS (SELECT *, median(own) OVER (PARTITION BY flat) AS m FROM h)
SELECT room_id, round(coalesce(own, m, 2.55::DOUBLE), 4) AS ceiling, CASE WHEN own IS NOT NULL THEN 'measured' WHEN m IS NOT NULL THEN 'flat_median' ELSE 'uk_prior' END AS ceiling_source FROM f""",
    "plausibility": f"""WITH {_RM}, i AS (SELECT *, label <> 'garden' AS inside FROM r)
SELECT flat, count(*) FILTER (inside) AS n_rooms, count(height) FILTER (inside) AS n_with_height, count(*) FILTER (NOT inside) AS outdoor, round(median(height) FILTER (inside), 4) AS median_height, round(avg((height BETWEEN 2.0 AND 4.2)::INT) FILTER (inside), 4) AS plausible, max(extent) FILTER (inside) AS max_extent, coalesce(max(extent) FILTER (inside) > 12, false) AS any_over_12 FROM i GROUP BY 1""",
    "surfaces_visible": f"""WITH {_CL}, g AS (SELECT user_id, 0.0 AS lo, max(hi) AS hi, avg((abs(z) < 0.18)::INT) AS a, avg((abs(z - hi) < 0.18)::INT) AS b, greatest(quantile_cont(x, 0.97) - quantile_cont(x, 0.03), quantile_cont(y, 0.97) - quantile_cont(y, 0.03)) AS span FROM c GROUP BY 1),
w AS (SELECT user_id, CASE WHEN hi IS NULL THEN 'no_floor_ceiling_found' WHEN hi - lo < 1.9 THEN 'floor_ceiling_gap_too_small' WHEN a < 0.06 OR b < 0.06 THEN 'ceiling_or_floor_barely_observed' WHEN span > (hi - lo) * 6 THEN 'room_far_wider_than_tall' END AS reason FROM g)
SELECT user_id, reason IS NULL AS visible, reason FROM w""",
    "oriented_cloud": f"""WITH {_CL}, h AS (SELECT user_id, y * 0.6::DOUBLE + z * 0.8::DOUBLE AS h, x * x + y * y + z * z AS n2 FROM c), q AS (SELECT user_id, quantile_cont(h, 0.05) AS q0, quantile_cont(h, 0.95) AS q1 FROM h GROUP BY 1)
SELECT h.user_id, count(*) AS n, count(*) FILTER (abs(h - q1) < 0.15) > count(*) FILTER (abs(h - q0) < 0.15) * 1.6 AS flipped, round(max(abs(h)), 5) AS highest, round(sum(n2), 3) AS norm FROM h JOIN q ON h.user_id = q.user_id GROUP BY 1""",
    "aperture_kinds": """
WITH a AS (SELECT l_quantity / 18.0::DOUBLE AS w, l_linenumber AS n, l_partkey % 3 > 0 AS s FROM lineitem)
SELECT CASE WHEN s THEN CASE WHEN n >= 2 THEN CASE WHEN w BETWEEN 0.55 AND 1.4 THEN 'door' WHEN w > 1.4 THEN 'opening' END ELSE CASE WHEN w BETWEEN 0.35 AND 4.0 THEN 'window' END END ELSE CASE WHEN n >= 2 THEN 'door' ELSE 'window' END END AS kind, count(*) AS n FROM a GROUP BY 1""",
    "basin_contacts": """
WITH p AS (SELECT p AS plan, x, y, CASE WHEN x % 13 = 12 AND y <> 5 THEN 0 ELSE x // 13 + (y + p) // 9 * 4 + 1 END AS label FROM (SELECT unnest(range(20)) AS p), (SELECT unnest(range(40)) AS x), (SELECT unnest(range(25)) AS y)),
m AS (SELECT a.plan, a.x, a.y, a.label AS l, b.label AS o FROM p a JOIN p b ON a.plan = b.plan AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.label <> b.label AND a.label > 0 AND b.label > 0)
SELECT plan, least(l, o) AS a, greatest(l, o) AS b, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY 1, 2, 3""",
    "aperture_walls": """
WITH s AS (SELECT s_suppkey AS aperture_id, (s_suppkey % 11)::DOUBLE AS ax, s_suppkey % 5 * 0.1::DOUBLE AS ay FROM supplier), e(edge_id, x0, y0, x1, y1) AS (VALUES (0, 0, 0, 10, 0), (1, 10, 0, 10, 10), (2, 10, 10, 0, 10), (3, 0, 10, 0, 0)),
m AS (SELECT aperture_id, edge_id, ((ax - x0) * (x1 - x0) + (ay - y0) * (y1 - y0)) / 100 AS t, abs((ax - x0) * (y1 - y0) - (ay - y0) * (x1 - x0)) / 10 AS off FROM s, e)
SELECT aperture_id, CAST(edge_id AS BIGINT) AS edge_id, round(t, 6) AS t, round(off, 6) AS off FROM m WHERE t BETWEEN 0 AND 1 AND off <= 0.45 QUALIFY row_number() OVER (PARTITION BY aperture_id ORDER BY round(off, 9), edge_id) = 1""",
    "cumulative_keep": """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS a FROM orders) WHERE b < 0.9 * a""",
    "scene_rooms": f"WITH {_SCENE} SELECT * FROM sc",
    "two_hop_join": "SELECT l_returnflag, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 40 AND s_acctbal > 0 GROUP BY 1",
    "semi_and_anti": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "photos_by_room": f"WITH {_IM} SELECT listing, label, array_to_string(list_sort(list(image))[1:12], ',') AS photos, count(*) AS n FROM im GROUP BY 1, 2",
    "bounding_boxes": f"WITH {_CL} SELECT user_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM c GROUP BY 1",
    "annotation_coverage": "SELECT source, count(*) AS n, count(l.doc_id) AS annotated, CASE WHEN count(l.doc_id) / count(*)::DOUBLE >= 0.5 THEN 'covered' WHEN count(l.doc_id) / count(*)::DOUBLE >= 0.3 THEN 'partly' ELSE 'sparse' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "tiles": """
WITH p AS (SELECT p_partkey, p_size * 40 + 100 AS w, p_partkey % 30 * 30 + 200 AS h FROM part), k AS (SELECT *, CAST(greatest(0, ceil((w - 640) / 480.0::DOUBLE)) AS BIGINT) AS kx, CAST(greatest(0, ceil((h - 640) / 480.0::DOUBLE)) AS BIGINT) AS ky FROM p)
SELECT p_partkey, (kx + 1) * (ky + 1) AS n, CAST(greatest(0, least(kx * 480, w - 640)) AS BIGINT) AS last_x, CAST(greatest(0, least(ky * 480, h - 640)) AS BIGINT) AS last_y FROM k""",
    "letterbox_undo": "WITH p AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS w, p_partkey % 90 + 60.0::DOUBLE AS h FROM part), k AS (SELECT *, 512.0::DOUBLE / greatest(w, h) AS k FROM p) SELECT p_partkey, round((100 - (512 - w * k) / 2) / k, 5) AS x, round((200 - (512 - h * k) / 2) / k, 5) AS y FROM k",
    "grid_normals": """SELECT i AS image, CAST(14 * 19 AS BIGINT) AS n, round(-0.5::DOUBLE / s, 6) AS nx, round(-(i * 0.25::DOUBLE) / s, 6) AS ny, round(1 / s, 6) AS nz FROM (SELECT i, sqrt(1.25::DOUBLE + i * i * 0.0625::DOUBLE) AS s FROM (SELECT unnest(range(12)) AS i))""",
    "unprojected": """
WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS u, l_linenumber * 50.0::DOUBLE AS v, l_tax + 1 AS z, 320 / tan(radians(98.6::DOUBLE) / 2) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, round((u - 320) * z / f, 6) AS x, round((v - 240) * z / f, 6) AS y, round(z, 6) AS z FROM f""",
    "total_area_metric": """
WITH m AS (SELECT o_orderkey, o_totalprice / 1000 AS m, CASE WHEN o_orderkey % 3 = 0 THEN nullif(o_custkey * 0.3::DOUBLE, 0) END AS p, CASE WHEN o_orderkey % 2 = 0 THEN nullif(o_custkey * 0.4::DOUBLE, 0) END AS s FROM orders)
SELECT o_orderkey, round(abs(m - coalesce(p, s)) / coalesce(p, s) * 100, 9) AS error_pct, CASE WHEN p IS NOT NULL THEN 'printed' WHEN s IS NOT NULL THEN 'stated' ELSE 'none' END AS reference FROM m""",
    "missing_stage_report": """
WITH g AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list_distinct(list(event_type)) AS h FROM events GROUP BY 1, 2)
SELECT user_id, day, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda k: NOT list_contains(h, k)), ',') AS missing FROM g""",
    "confidence_product": "SELECT l_orderkey, round(greatest(0.02, least(1.0, avg(1 - l_discount) * CASE WHEN any_value(o_orderstatus) = 'F' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END)), 6) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "provenance_groups": f"WITH {_SCENE} SELECT CAST(sum(rooms) AS BIGINT) AS rooms, CAST(sum(reconstructed) AS BIGINT) AS reconstructed, round(sum(reconstructed)::DOUBLE / greatest(1, sum(rooms)), 6) AS coverage FROM sc",
    "stage_names": "SELECT l_orderkey, l_linenumber, ['triage', 'conditioning', 'grouping', 'geometry', 'layout', 'plan', 'assembly', 'scale', 'shell', 'package'][l_linenumber % 10 + 1] AS stage FROM lineitem",
}
