"""Listing, adjacency and scoring queries over the driver tables, which stand in for web pages and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import rooms as op
from tessella.plans.geometry import _rooms
from tessella.sources import html as hs
from tessella.sources import listings as ls
from tessella.sources.tables import table


def typed_listings(spark, d):
    """Customers as pages of a portal: the payload is found in the page, read and typed."""
    c = table(spark, d, "customer")
    photo = F.struct(F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_mktsegment").alias("caption"))
    payload = F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("displayAddress"), F.col("c_mktsegment").alias("outcode")).alias("address"),
        F.struct(F.concat(F.lit("£"), F.format_number(F.floor(F.abs("c_acctbal")), 0), F.lit(" pcm")).alias("primaryPrice")).alias("prices"),
        (F.col("c_nationkey") % 5).alias("bedrooms"), F.array_repeat(photo, (F.col("c_custkey") % 9).cast("int")).alias("images"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.struct(F.lit("sqft").alias("unit"), (F.col("c_custkey") % 700 + 300).alias("minimumSize")))).alias("sizings"),
        F.struct(F.concat(F.lit("<p>A flat of "), (F.col("c_custkey") % 90 + 10).cast("string"), F.lit(" sq m</p>")).alias("description")).alias("text"),
    )
    page = F.concat(F.lit("<html><script>window.PAGE = "), F.to_json(payload), F.lit("; other = {}</script></html>"))
    pages = c.select(hs.json_after(page, F.lit("window.PAGE")).alias("payload"))
    out = ls.with_photos(ls.listings(pages, "payload", "first", ls.FIRST_PORTAL))
    return out.select(F.col("listing_id").cast("long").alias("listing_id"), "display_address", "outcode", "bedrooms", "price", "floor_area_sqm", F.size("photos").cast("long").alias("n_photos"), F.col("photos")[0]["url"].alias("first_photo"), "description")


def flattened_payloads(spark, d):
    """Parts as flat arrays whose members are indices, read back."""
    p = table(spark, d, "part")
    flat = F.concat(F.lit('[{"name":1,"brand":2,"sizes":3,"none":-1,"far":99},'), F.to_json(F.array("p_name")).substr(F.lit(2), F.length(F.to_json(F.array("p_name"))) - 2), F.lit(","), F.to_json(F.array("p_brand")).substr(F.lit(2), F.length(F.to_json(F.array("p_brand"))) - 2), F.lit(",[4,4],"), F.col("p_size").cast("string"), F.lit("]"))
    out = p.select("p_partkey", hs.unflattened(flat).alias("j"))
    return out.select("p_partkey", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.brand").alias("brand"), F.get_json_object("j", "$.sizes[1]").cast("long").alias("size"), F.get_json_object("j", "$.far").isNull().alias("far_is_null"))


def payload_rows(spark, d):
    """The values of the parts' flattened payloads as rows, by a table function joined to each."""
    p = table(spark, d, "part")
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    flat = F.concat(F.lit('[{"name":1,"sizes":2,"none":-1,"far":99,"self":0},'), text("p_name"), F.lit(",[3,3,4],"), F.col("p_size").cast("string"), F.lit(',{"brand":5,"flag":6},'), text("p_brand"), F.lit(",true]"))
    return p.select("p_partkey", flat.alias("payload")).lateralJoin(hs.PayloadRows(F.col("payload").outer())).select("p_partkey", "path", "kind", "value")


def payload_search(spark, d):
    """The first listing inside nested payloads of suppliers, the last child first."""
    s = table(spark, d, "supplier")
    inner = lambda v: F.struct(F.struct(v.alias("id")).alias("listing"))
    payload = F.when(F.col("s_suppkey") % 4 > 0, F.to_json(F.struct(F.array(inner(F.lit(-1).cast("long")), inner(F.col("s_suppkey"))).alias("x"), F.lit("s").alias("y")))).otherwise(F.lit('{"x": [1, {"y": 2}]}'))
    found = hs.key_search(payload, ["listing", "listingDetails"])
    return s.select("s_suppkey", F.get_json_object(found, "$.id").cast("long").alias("found"))


def conditioned_images(spark, d):
    """Line items as images of their suppliers."""
    l = table(spark, d, "lineitem")
    flags = F.array_compact(F.array(F.when(F.col("l_discount") == 0, "blank_image"), F.when(F.col("l_linenumber") > 5, F.concat(F.lit("duplicate_of_"), F.col("l_orderkey").cast("string"))), F.when(F.col("l_tax") > 0.05, "dark")))
    images = l.select("l_suppkey", F.when(F.col("l_returnflag") == "N", "interior").otherwise("exterior").alias("type"), flags.alias("quality_flags"))
    return op.conditioned(images).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("quality_flags", "dark")).alias("dark"))


def aperture_rooms(spark, d):
    """Orders as apertures of the parts they hold."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("rooms"))
    out = op.by_room(l, "rooms", "l_orderkey")
    return out.select(F.col("room").alias("l_partkey"), F.size("apertures").cast("long").alias("n"), F.array_join(F.transform("apertures", lambda x: x.cast("string")), ",").alias("apertures"))


def shared_walls(spark, d):
    """Rooms of a floor of forty that run along each other (checked against all pairs in the tests)."""
    r = _rooms(spark, d).select(F.floor(F.col("p_partkey") / 40).alias("floor"), "p_partkey", F.transform("polygon", lambda v: F.array(v["x"], v["y"])).alias("p"))
    out = op.shared_walls(r, "floor", "p_partkey", "p", 0.25, 0.5, 30.0)
    return out.select("floor", "a", "b", F.round("shared", 6).alias("shared"), F.round("confidence", 6).alias("confidence"))


def adjacency_metric(spark, d):
    """Part-supplier edges of a year, with suppliers matched to nations, against those of the next. Suppliers as rooms have
    numbers below zero, as parts' would be some suppliers' too."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    room = lambda c: -F.col(c) - 1
    e = l.select(F.year("l_shipdate").cast("long").alias("year"), (F.col("l_partkey") % 50 + 1000).alias("a"), room("l_suppkey").alias("b")).distinct()
    nations = s.select(room("s_suppkey").alias("room_id"), F.col("s_nationkey").alias("plan_room_id"))
    placed = e.join(nations.select(F.col("room_id").alias("b"), "plan_room_id"), "b")
    matches = placed.select("year", F.col("b").alias("room_id"), "plan_room_id").unionByName(e.select("year", F.col("a").alias("room_id"), F.col("a").alias("plan_room_id"))).distinct()
    named = placed.select((F.col("year") - 1).alias("year"), "a", F.col("plan_room_id").alias("b"))
    out = op.adjacency_metric(e, matches, named, "year")
    return out.withColumn("share", F.round("share", 6))


def assignment_accuracy(spark, d):
    """Orders as rooms, customers as what they are matched with, per status."""
    o = table(spark, d, "orders")
    truth = o.select("o_orderstatus", F.col("o_orderkey").alias("room_id"), F.array(F.col("o_custkey") % 10, F.col("o_custkey") % 7).alias("accepted"))
    matches = o.filter("o_orderpriority <> '5-LOW'").select("o_orderstatus", F.col("o_orderkey").alias("room_id"), (F.col("o_orderkey") % 10).alias("plan_room_id"))
    out = op.assignment_accuracy(truth, matches, "o_orderstatus")
    return out.withColumn("accuracy_pct", F.round("accuracy_pct", 6))


def plan_channel(spark, d):
    """Orders as plans, their lines as rooms with printed sides."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rooms = l.select("l_orderkey", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("label"), F.col("l_quantity").cast("double").alias("area"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") + 2.0).alias("side_a"), F.lit(5.0).alias("side_b"))
    plans = o.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1000).alias("area"), F.when(F.col("o_orderstatus") == "F", 120.0).alias("printed"), F.lit(150.0).alias("stated"))
    out = op.plan_channel(rooms, plans, "l_orderkey")
    for c in ("room_error_pct", "within_10", "total_error_pct"):
        out = out.withColumn(c, F.round(c, 6))
    return out


def farthest_vertices(spark, d):
    """The corner of each room that is farthest from its first corner's neighbour."""
    r = _rooms(spark, d)
    p = F.transform("polygon", lambda v: F.array(v["x"], v["y"]))
    far = op.farthest_vertex(p, F.col("x") + F.col("w") - 0.25, F.col("y") + 0.25)
    return r.select("p_partkey", (far[0] - F.col("x")).alias("fx"), (far[1] - F.col("y")).alias("fy"))


def entry_rooms(spark, d):
    """Customers' orders as waypoints: fulfilled ones are centres of rooms."""
    o = table(spark, d, "orders")
    points = o.select("o_custkey", F.col("o_orderkey").alias("waypoint_id"), F.when(F.col("o_orderstatus") == "F", "room_centre").otherwise("door").alias("kind"), F.col("o_orderkey").alias("room_id"))
    rooms = o.select("o_custkey", F.col("o_orderkey").alias("room_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("area"))
    return op.entry_room(points, rooms, "o_custkey")


def room_predictions(spark, d):
    """Orders as readings whose rooms are their lines."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rooms = l.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.array_repeat("l_quantity", F.col("l_linenumber").cast("int")).alias("polygon"), F.col("l_returnflag").alias("label"))).alias("rooms"))
    readings = o.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", "room_finder").otherwise("ours").alias("kind")).join(rooms, "l_orderkey")
    out = op.imported_rooms(readings, "l_orderkey")
    return out.select("l_orderkey", F.size("rooms").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("rooms", lambda r: r["label"])), ",").alias("labels"))


def scene_index(spark, d):
    """Customers as scenes: their orders are rooms, those of one status waypoints."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    held = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("rooms"), F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("waypoints"))
    scenes = c.select("c_custkey").join(held, "c_custkey", "left").withColumn("edges", F.slice(F.coalesce("waypoints", F.array().cast("array<bigint>")), 2, 1000))
    return op.scene_index(scenes, "c_custkey")


def label_manifest(spark, d):
    """Items of events: the part of values above the threshold."""
    out = op.label_manifest(table(spark, d, "events").select("user_id", "value"), "user_id", "value", 100.0)
    return out.withColumn("share", F.round("share", 4))


def facts_sheets(spark, d):
    """Orders' lines as plan rooms, and orders themselves as layouts."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    plans = l.select("l_orderkey", F.col("l_linenumber").cast("long").alias("plan_room_id"), F.col("l_returnflag").alias("label"))
    layouts = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("room_id"), F.col("o_orderpriority").alias("label"))
    out = op.facts_sheet(plans, layouts, "l_orderkey")
    text = lambda c, *f: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda r: F.concat_ws(":", *[r[k].cast("string") for k in f])), ",")
    return out.select("l_orderkey", text("plan_rooms", "plan_room_id", "label").alias("plan_rooms"), text("reconstructed_rooms", "room_id", "label").alias("reconstructed_rooms"))


_RECT = "r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 17 + 3 AS DOUBLE) AS h, p_partkey % 3 = 0 AS ell FROM part)"

QUERIES = {
    f.__name__: f
    for f in (typed_listings, flattened_payloads, payload_rows, payload_search, conditioned_images, aperture_rooms, shared_walls, adjacency_metric, assignment_accuracy, plan_channel, farthest_vertices, entry_rooms, room_predictions, scene_index, label_manifest, facts_sheets)
}
ORACLES = {
    "payload_rows": """
SELECT p_partkey, unnest(['/name', '/sizes/0', '/sizes/1', '/sizes/2/brand', '/sizes/2/flag', '/none', '/far', '/self']) AS path, unnest(['string', 'number', 'number', 'string', 'boolean', 'null', 'null', 'cycle']) AS kind,
  unnest(['"' || p_name || '"', p_size::VARCHAR, p_size::VARCHAR, '"' || p_brand || '"', 'true', 'null', 'null', '0']) AS value FROM part""",
    "typed_listings": """
SELECT c_custkey AS listing_id, c_name AS display_address, c_mktsegment AS outcode, CAST(c_nationkey % 5 AS INT) AS bedrooms, CAST(floor(abs(c_acctbal)) AS BIGINT) AS price,
  CASE WHEN c_custkey % 3 = 0 THEN round((c_custkey % 700 + 300) * 0.09290304::DOUBLE, 2) ELSE (c_custkey % 90 + 10)::DOUBLE END AS floor_area_sqm, c_custkey % 9 AS n_photos,
  'http://x/' || c_custkey AS first_photo, 'A flat of ' || (c_custkey % 90 + 10) || ' sq m' AS description FROM customer WHERE c_custkey % 9 >= 4""",
    "flattened_payloads": "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size, true AS far_is_null FROM part",
    "payload_search": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey END AS found FROM supplier",
    "conditioned_images": "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_tax > 0.05) AS dark FROM lineitem WHERE l_returnflag = 'N' AND l_discount <> 0 AND l_linenumber <= 5 GROUP BY 1",
    "aperture_rooms": "SELECT l_partkey, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS apertures FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1",
    "adjacency_metric": """
WITH e AS (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS year, l_partkey % 50 + 1000 AS a, s_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
j AS (SELECT coalesce(w.year - 1, e.year) AS year, w.year IS NOT NULL AS w, e.year IS NOT NULL AS u FROM e w FULL JOIN e ON w.year - 1 = e.year AND w.a = e.a AND w.b = e.b)
SELECT year, count(*) FILTER (w) AS n_reference, count(*) FILTER (u) AS n_built, count(*) FILTER (w AND u) AS correct, round(count(*) FILTER (w AND u) / count(*) FILTER (w)::DOUBLE, 6) AS share FROM j GROUP BY 1 HAVING count(*) FILTER (w) > 0""",
    "assignment_accuracy": """
WITH k AS (SELECT o_orderstatus, o_orderpriority <> '5-LOW' AND o_orderkey % 10 IN (o_custkey % 10, o_custkey % 7) AS r FROM orders)
SELECT o_orderstatus, count(*) AS total, count(*) FILTER (r) AS correct, round(100 * count(*) FILTER (r) / count(*)::DOUBLE, 6) AS accuracy_pct FROM k GROUP BY 1""",
    "plan_channel": """
WITH r AS (SELECT l_orderkey, count(*) AS n_rooms, count(*) FILTER (l_returnflag <> 'A') AS n_labelled, list(100 * abs(l_quantity - (l_linenumber + 2.0::DOUBLE) * 5) / ((l_linenumber + 2.0::DOUBLE) * 5)) FILTER (l_linenumber % 2 = 1) AS e FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(n_rooms, 0) AS n_rooms, coalesce(n_labelled, 0) AS n_labelled, coalesce(len(e), 0) AS n_printed, round(list_median(e), 6) AS room_error_pct,
  round(len(list_filter(e, lambda x: x <= 10)) / len(e)::DOUBLE, 6) AS within_10, round(100 * abs(o_totalprice / 1000 - CASE WHEN o_orderstatus = 'F' THEN 120 ELSE 150 END) / CASE WHEN o_orderstatus = 'F' THEN 120 ELSE 150 END, 6) AS total_error_pct,
  CASE WHEN o_orderstatus = 'F' THEN 'printed' ELSE 'stated' END AS reference, n_rooms IS NOT NULL AS complete FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""",
    "farthest_vertices": f"WITH {_RECT} SELECT p_partkey, 0.0::DOUBLE AS fx, h AS fy FROM r",
    "entry_rooms": """
SELECT o_custkey, o_orderkey AS waypoint_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice ELSE 0 END END DESC, o_orderkey) = 1""",
    "room_predictions": "SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linenumber >= 3 GROUP BY 1",
    "scene_index": """
SELECT c_custkey, count(o_orderkey) AS n_rooms, count(*) FILTER (o_orderstatus = 'F') AS n_waypoints, greatest(0, count(*) FILTER (o_orderstatus = 'F') - 1) AS n_edges, count(o_orderkey) > 0 AS usable FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
    "label_manifest": "SELECT user_id, count(value) AS n, round(avg((value > 100)::INT), 4) AS share FROM events GROUP BY 1",
    "facts_sheets": """
WITH p AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS plan_rooms FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey, o_custkey || ':' || o_orderpriority AS t FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(l_orderkey, o_orderkey) AS l_orderkey, coalesce(plan_rooms, '') AS plan_rooms, coalesce(t, '') AS reconstructed_rooms FROM p FULL JOIN f ON l_orderkey = o_orderkey""",
}
