"""Rooms of a scene: adjacency by shared walls, isolated scoring of plans, sheets and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import batch_shared_edge_length, pairwise

#: Flags that keep an image out, tolerances of a match in percent.
UNUSABLE_PREFIX, UNUSABLE_FLAG, WITHIN_PCT = "duplicate_of_", "blank_image", 10.0


def conditioned(images: DataFrame, kind: str = "type", flags: str = "quality_flags") -> DataFrame:
    """Interior images without a flag that marks a duplicate or a blank; null flags are none."""
    bad = F.exists(F.coalesce(F.col(flags), F.array().cast("array<string>")), lambda f: f.startswith(UNUSABLE_PREFIX) | (f == UNUSABLE_FLAG))
    return images.filter((F.col(kind) == "interior") & ~F.coalesce(bad, F.lit(False)))


def by_room(apertures: DataFrame, rooms: str = "rooms", id_col: str = "aperture_id") -> DataFrame:
    """room, apertures: the sorted apertures of each room. A room has few; an aperture names its rooms
    in an array."""
    each = apertures.select(F.explode(F.array_distinct(rooms)).alias("room"), F.col(id_col).alias("_a")).filter("room is not null")
    return each.groupBy("room").agg(F.sort_array(F.collect_list("_a")).alias("apertures"))


def shared_walls(rooms: DataFrame, by: str, id_col: str, polygon: str, tolerance: float, least: float, cell: float) -> DataFrame:
    """by, a, b, shared, confidence: pairs of a group's rooms (a < b) that run along each other, within
    the tolerance, for `least` at least.

    Rooms meet in the cells of a grid that their boxes, widened by the tolerance, touch, so rooms far
    from each other never do. polygon: array of [x, y].
    """
    x, y = F.transform(F.col(polygon), lambda v: v[0]), F.transform(F.col(polygon), lambda v: v[1])
    span = lambda v: F.sequence(F.floor((F.array_min(v) - tolerance) / cell), F.floor((F.array_max(v) + tolerance) / cell))
    boxed = rooms.select(by, F.col(id_col).alias("id"), F.col(polygon).alias("p"), F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"), F.explode(span(x)).alias("gx"), span(y).alias("gys"))
    celled = boxed.withColumn("gy", F.explode("gys")).drop("gys")
    a, b = celled.alias("a"), celled.alias("b")
    near = (F.col("a.x0") <= F.col("b.x1") + tolerance) & (F.col("b.x0") <= F.col("a.x1") + tolerance) & (F.col("a.y0") <= F.col("b.y1") + tolerance) & (F.col("b.y0") <= F.col("a.y1") + tolerance)
    # a pair is taken in one of the cells it shares: the first
    first = (F.col("a.gx") == F.greatest(F.floor((F.col("a.x0") - tolerance) / cell), F.floor((F.col("b.x0") - tolerance) / cell))) & (F.col("a.gy") == F.greatest(F.floor((F.col("a.y0") - tolerance) / cell), F.floor((F.col("b.y0") - tolerance) / cell)))
    # merged, as what is known of the table's size doesn't count the cells, and a broadcast would hold all of them on the driver
    met = a.join(b.hint("merge"), (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.id") < F.col("b.id"))).filter(near & first)

    def length(p: pd.Series, q: pd.Series) -> pd.Series:
        found = pairwise([[*map(list, u)] for u in p], [[*map(list, w)] for w in q], lambda u, w: (batch_shared_edge_length(u, w, tolerance),))
        return pd.Series(found[0] if found else [], dtype=float)

    shared = F.pandas_udf(length, "double")("a.p", "b.p")
    out = met.select(F.col(f"a.{by}").alias(by), F.col("a.id").alias("a"), F.col("b.id").alias("b"), shared.alias("shared"))
    return out.filter(F.col("shared") >= least).withColumn("confidence", F.least(F.lit(1.0), F.col("shared") / (tolerance * 12)))


def adjacency_metric(built: DataFrame, matches: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """by, n_reference, n_built, correct, share: built edges (by, a, b of rooms), named by what each room
    is matched with (by, room_id, plan_room_id), against reference edges (by, a, b of plan rooms).
    Edges have no direction; ends without a match drop their edge. Groups without a reference have
    no row."""
    to = lambda c: matches.select(by, F.col("room_id").alias(c), F.col("plan_room_id").alias(f"p_{c}"))
    ordered = lambda df, a, b: df.select(by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    named = ordered(built.join(to("a"), [by, "a"]).join(to("b"), [by, "b"]), "p_a", "p_b").withColumn("_built", F.lit(True))
    wanted = ordered(reference, "a", "b").withColumn("_wanted", F.lit(True))
    both = wanted.join(named, [by, "a", "b"], "full")
    counted = both.groupBy(by).agg(F.count("_wanted").alias("n_reference"), F.count("_built").alias("n_built"), F.count_if(F.col("_wanted") & F.col("_built")).alias("correct"))
    return counted.filter("n_reference > 0").withColumn("share", F.col("correct") / F.col("n_reference"))


def assignment_accuracy(truth: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """by, total, correct, accuracy_pct: truth(by, room_id, accepted: plan rooms that are right) against
    matches(by, room_id, plan_room_id). An unmatched room is wrong."""
    joined = truth.join(matches, [by, "room_id"], "left")
    right = F.coalesce(F.array_contains("accepted", F.col("plan_room_id")), F.lit(False))
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct")).withColumn("accuracy_pct", 100 * F.col("correct") / F.col("total"))


def plan_channel(rooms: DataFrame, plans: DataFrame, by: str) -> DataFrame:
    """The plan by itself against its own printed numbers: by, n_rooms, n_labelled, n_printed,
    room_error_pct (median), within_10, total_error_pct, reference, complete. rooms: by, label, area,
    side_a, side_b (printed). plans: by, area, printed, stated; a group without rooms is not
    complete. A plan has few rooms."""
    sides = F.col("side_a") * F.col("side_b")
    error = F.when((sides > 0) & (F.coalesce(F.col("area"), F.lit(0.0)) != 0), 100 * F.abs(F.col("area") - sides) / sides)
    seen = rooms.withColumn("_e", error).groupBy(by).agg(F.count(F.lit(1)).alias("n_rooms"), F.count(F.nullif(F.col("label"), F.lit(""))).alias("n_labelled"), F.count("_e").alias("n_printed"), F.median("_e").alias("room_error_pct"), F.avg((F.col("_e") <= WITHIN_PCT).cast("double")).alias("within_10"))
    printed = F.nullif(F.col("printed"), F.lit(0.0))
    wanted = F.coalesce(printed, F.nullif(F.col("stated"), F.lit(0.0)))
    total = F.when(F.col("area") != 0, 100 * F.abs(F.col("area") - wanted) / wanted)
    scored = plans.select(by, total.alias("total_error_pct"), F.when(printed.isNotNull(), "printed").otherwise("stated").alias("reference"))
    return scored.join(seen, by, "left").select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rooms", "n_labelled", "n_printed")], "room_error_pct", "within_10", "total_error_pct", "reference", F.col("n_rooms").isNotNull().alias("complete"))


def farthest_vertex(polygon: Column, x: Column, y: Column) -> Column:
    """The vertex [x, y] of a polygon that is farthest from a point: the first of equally far ones."""
    far = lambda v: (v[0] - x) * (v[0] - x) + (v[1] - y) * (v[1] - y)
    return F.aggregate(polygon, polygon[0], lambda best, v: F.when(far(v) > far(best), v).otherwise(best))


def entry_room(waypoints: DataFrame, rooms: DataFrame, by: str) -> DataFrame:
    """by, waypoint_id: where a visitor begins, at the centre of the largest room, else at the first
    waypoint. waypoints: by, waypoint_id, kind, room_id, in order of waypoint_id. rooms: by, room_id,
    area. A room without an area counts as none; ties go to the first."""
    sized = waypoints.join(rooms.select(by, "room_id", "area"), [by, "room_id"], "left")
    rank = F.struct((F.col("kind") == "room_centre").cast("int").alias("c"), F.when(F.col("kind") == "room_centre", F.coalesce("area", F.lit(0.0))).alias("s"), (-F.col("waypoint_id")).alias("i"))
    return sized.groupBy(by).agg(F.max_by("waypoint_id", rank).alias("waypoint_id"))


def imported_rooms(readings: DataFrame, by: str, kind: str = "kind", wanted: str = "room_finder") -> DataFrame:
    """by, rooms: of the wanted kind of reading, the rooms whose polygon has three points at least;
    readings without any go. rooms: array<struct<polygon, label>>."""
    kept = readings.filter(F.col(kind) == wanted).select(by, F.filter("rooms", lambda r: F.coalesce(F.size(r["polygon"]), F.lit(0)) >= 3).alias("rooms"))
    return kept.filter(F.size("rooms") > 0)


def label_manifest(pixels: DataFrame, by: str, value: str, threshold: float = 127.0) -> DataFrame:
    """by, n, share: of each labelled item, how many values there are and which part is above the
    threshold. Summed per task first."""
    return pixels.groupBy(by).agg(F.count(value).alias("n"), F.avg((F.col(value) > threshold).cast("double")).alias("share"))


def facts_sheet(plan_rooms: DataFrame, layouts: DataFrame, by: str) -> DataFrame:
    """by, plan_rooms, reconstructed_rooms: what an annotator reads of a listing, as sorted arrays of
    structs. A listing has few of either."""
    listed = lambda df, name: df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias(name))
    joined = listed(plan_rooms, "plan_rooms").join(listed(layouts, "reconstructed_rooms"), by, "full")
    return joined


def scene_index(scenes: DataFrame, by: str) -> DataFrame:
    """A row per scene: how many rooms, waypoints and edges it has, and whether anything stands in it.
    scenes: by, rooms, waypoints, edges (arrays); null ones are empty."""
    sizes = {c: F.size(F.coalesce(F.col(c), F.array())).cast("long") for c in ("rooms", "waypoints", "edges")}
    return scenes.select(by, *[v.alias(f"n_{k}") for k, v in sizes.items()], (sizes["rooms"] > 0).alias("usable"))
