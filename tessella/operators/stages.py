"""Relational cores of the reconstruction stages: grouping, layout, plan, shell, scene, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.quantiles import quantiles_in_rows

#: Fixed values.
CEILING_PRIOR, CEILING_RANGE = 2.55, (2.0, 4.2)
DOOR_M, WINDOW_M = (0.55, 1.4), (0.35, 4.0)
SOURCE_RANK = (("printed_dimensions", 3), ("printed_area", 2), ("stated_area", 1))
OUTDOOR = ("garden", "balcony", "terrace")


def usable_images(images: DataFrame, calibrated: DataFrame, key: str, empty_is_no_filter: bool = True) -> DataFrame:
    """Images that were calibrated. If nothing was, all are kept, unless empty_is_no_filter is off:
    one scalar decides, no second pass over the images."""
    if not empty_is_no_filter:
        return images.join(calibrated, key, "left_semi")
    some = calibrated.select(F.lit(1)).limit(1).agg(F.count(F.lit(1)).alias("_n"))
    marked = images.join(calibrated.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.crossJoin(F.broadcast(some)).filter(F.coalesce("_hit", F.lit(False)) | (F.col("_n") == 0)).drop("_hit", "_n")


def top_views(images: DataFrame, by: str, label: str, score: str, image: str, singleton: Column, bedrooms: Column, most: int = 8) -> DataFrame:
    """The best views of each label: up to `most` where the label is one room, else one group per
    image, up to one more than bedrooms (2 if unknown). Ties go to the smaller image."""
    w = Window.partitionBy(by, label).orderBy(F.desc(F.coalesce(F.col(score), F.lit(0.0))), image)
    limit = F.when(singleton, F.lit(most)).otherwise(F.greatest(F.lit(1), F.coalesce(F.nullif(bedrooms, F.lit(0)), F.lit(2)) + 1))
    return images.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def largest_asset(assets: DataFrame, by: str, size: str, asset: str) -> DataFrame:
    """The largest asset of each group; ties to the smaller name."""
    return assets.groupBy(by).agg(F.min(F.struct((-F.col(size)).alias("n"), F.col(asset).alias("a"))).alias("s")).select(by, F.col("s.a").alias(asset), (-F.col("s.n")).alias(size))


def choose_scale(candidates: DataFrame, by: str, gross: float = 1.8) -> DataFrame:
    """by, source, px, overruled, disagreement_pct. The best rank wins, then weight, but printed
    dimensions that differ from the best area-based candidate by more than a factor lose to it.
    candidates: by, source, px, weight."""
    rank = F.lit(0)
    for source, r in SOURCE_RANK:
        rank = F.when(F.col("source") == source, r).otherwise(rank)
    ranked = candidates.withColumn("r", rank)
    best = lambda on: F.max(F.when(on, F.struct("r", "weight", "source", "px")))
    area = F.col("source").isin("printed_area", "stated_area")
    both = ranked.groupBy(by).agg(best(F.lit(True)).alias("top"), best(area).alias("area"), F.count("px").alias("n"), F.max("px").alias("hi"), F.min("px").alias("lo"))
    ratio = F.greatest(F.col("top.px") / F.col("area.px"), F.col("area.px") / F.col("top.px"))
    lost = F.coalesce((F.col("top.source") == "printed_dimensions") & (ratio > gross), F.lit(False))
    return both.select(by, F.when(lost, F.col("area.source")).otherwise(F.col("top.source")).alias("source"), F.when(lost, F.col("area.px")).otherwise(F.col("top.px")).alias("px"), lost.alias("overruled"), F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / F.col("hi") * 100).alias("disagreement_pct"))


def choose_reading(fit_a: Column, area_a: Column, fit_b: Column, area_b: Column, tolerance: float = 0.8, close: float = 0.05) -> Column:
    """struct<pick, close_call, on_coverage> of two readings of a plan: one that covers too little
    of the other's floor loses, else the better outline fit wins, ties to a."""
    most = F.nullif(F.greatest(area_a, area_b), F.lit(0.0))
    ok_a, ok_b = F.coalesce(area_a / most, F.lit(0.0)) >= tolerance, F.coalesce(area_b / most, F.lit(0.0)) >= tolerance
    pick = F.when(ok_a & ~ok_b, "a").when(ok_b & ~ok_a, "b").when(fit_b > fit_a, "b").otherwise("a")
    return F.struct(pick.alias("pick"), (ok_a & ok_b & (F.abs(fit_a - fit_b) < close)).alias("close_call"), (ok_a != ok_b).alias("on_coverage"))


def ceilings(rooms: DataFrame, by: str, height: str, scale: Column) -> DataFrame:
    """Adds ceiling and its source: the room's own plausible height, else the median plausible one
    of its flat, else the prior."""
    own = F.col(height) * scale
    fine = F.when(own.between(*CEILING_RANGE), own)
    flat = rooms.groupBy(by).agg(F.median(fine).alias("_flat"))
    joined = rooms.join(flat, by)
    return joined.withColumn("ceiling", F.coalesce(fine, F.col("_flat"), F.lit(CEILING_PRIOR))).withColumn("ceiling_source", F.when(fine.isNotNull(), "measured").when(F.col("_flat").isNotNull(), "flat_median").otherwise("uk_prior")).drop("_flat")


def surfaces_visible(points: DataFrame, by: str, floor: str, ceiling: str) -> DataFrame:
    """Per room whether floor and ceiling are both in the cloud, and else the first reason why not.
    points: by, x, y, z and the two heights, the same on all rows of a room (null if not found)."""
    near = lambda c: F.avg((F.abs(F.col("z") - F.col(c)) < 0.18).cast("double"))
    span = lambda c: F.percentile(c, F.lit(0.97)) - F.percentile(c, F.lit(0.03))
    g = points.groupBy(by).agg(F.max(floor).alias("lo"), F.max(ceiling).alias("hi"), near(floor).alias("at_lo"), near(ceiling).alias("at_hi"), F.greatest(span("x"), span("y")).alias("span"))
    gap = F.col("hi") - F.col("lo")
    reason = F.when(gap.isNull(), "no_floor_ceiling_found").when(gap < 1.9, "floor_ceiling_gap_too_small").when((F.col("at_hi") < 0.06) | (F.col("at_lo") < 0.06), "ceiling_or_floor_barely_observed").when(F.col("span") > gap * 6, "room_far_wider_than_tall")
    return g.select(by, reason.isNull().alias("visible"), reason.alias("reason"))


def oriented(points: DataFrame, by: str, up: tuple[str, str, str]) -> DataFrame:
    """points with u, v, h in a frame whose third axis is up: the first is across up and x, or up
    and y where up is near x. Upside-down rooms, by 1.6 times more points near the top height than
    near the bottom one (5th and 95th percentile), are flipped."""
    ux, uy, uz = (F.col(c) for c in up)
    n = F.sqrt(ux * ux + uy * uy + uz * uz)
    zx, zy, zz = ux / n, uy / n, uz / n
    tilt = F.abs(zx) > 0.9
    ax, ay = F.when(tilt, 0.0).otherwise(1.0), F.when(tilt, 1.0).otherwise(0.0)
    cx, cy, cz = ay * zz, -ax * zz, ax * zy - ay * zx
    m = F.sqrt(cx * cx + cy * cy + cz * cz)
    frame = points.withColumns({"_zx": zx, "_zy": zy, "_zz": zz, "_cx": cx / m, "_cy": cy / m, "_cz": cz / m})
    dot = lambda a, b, c: F.col("x") * a + F.col("y") * b + F.col("z") * c
    zx, zy, zz, cx, cy, cz = (F.col(c) for c in ("_zx", "_zy", "_zz", "_cx", "_cy", "_cz"))
    turned = frame.withColumns({"u": dot(cx, cy, cz), "v": dot(zy * cz - zz * cy, zz * cx - zx * cz, zx * cy - zy * cx), "h": dot(zx, zy, zz)}).drop("_zx", "_zy", "_zz", "_cx", "_cy", "_cz")
    q = quantiles_in_rows(turned, by, "h", {"_q0": 0.05, "_q1": 0.95})
    near = turned.join(q, by, "left").groupBy(by).agg(F.count_if(F.abs(F.col("h") - F.col("_q0")) < 0.15).alias("_lo"), F.count_if(F.abs(F.col("h") - F.col("_q1")) < 0.15).alias("_hi"))
    flip = F.col("_hi") > F.col("_lo") * 1.6
    return turned.join(near, by).withColumn("h", F.when(flip, -F.col("h")).otherwise(F.col("h"))).withColumn("flipped", flip).drop("_lo", "_hi")


def aperture_kind(width_px: Column, n_rooms: Column, px_per_metre: Column) -> Column:
    """door, opening, window or null: by metres where there is a scale, else by topology."""
    w = width_px / px_per_metre
    metric = F.when(n_rooms >= 2, F.when(w.between(*DOOR_M), "door").when(w > DOOR_M[1], "opening")).otherwise(F.when(w.between(*WINDOW_M), "window"))
    return F.when(px_per_metre > 1, metric).otherwise(F.when(n_rooms >= 2, "door").otherwise("window"))


def basin_contacts(pixels: DataFrame, by: str) -> DataFrame:
    """Where two label basins touch: by, a, b, n, x0, y0, x1, y1 over pixels (by, x, y, label) whose
    right or lower neighbour has another label. Neighbours meet by an equi-join on coordinates."""
    right = pixels.select(by, F.col("x") - 1, "y", "label").toDF(by, "x", "y", "other")
    below = pixels.select(by, "x", F.col("y") - 1, "label").toDF(by, "x", "y", "other")
    met = pixels.join(right.unionByName(below), [by, "x", "y"]).filter("label <> other and label > 0 and other > 0")
    return met.groupBy(by, F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def wall_of_aperture(apertures: DataFrame, edges: DataFrame, by: str, reach: float = 0.45) -> DataFrame:
    """The wall edge that each aperture lies on: its projection falls on the edge and it is within
    reach; the nearest wins. apertures: by, aperture_id, ax, ay. edges: by, edge_id, x0, y0, x1, y1."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = ((F.col("ax") - F.col("x0")) * dx + (F.col("ay") - F.col("y0")) * dy) / size
    off = F.abs((F.col("ax") - F.col("x0")) * dy - (F.col("ay") - F.col("y0")) * dx) / F.sqrt(size)
    met = apertures.join(edges, by).withColumn("t", t).withColumn("off", off).filter(F.col("t").between(0, 1) & (F.col("off") <= reach))
    return met.groupBy(by, "aperture_id").agg(F.min(F.struct(F.round("off", 9).alias("off"), "edge_id", "t")).alias("m")).select(by, "aperture_id", "m.edge_id", "m.t", "m.off")


def cumulative_keep(parts: DataFrame, by: str, size: str, key: str, share: float = 0.9) -> DataFrame:
    """The largest parts of a group until they hold a share of it; the one that reaches it stays."""
    w = Window.partitionBy(by).orderBy(F.desc(size), key)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("_before", before).withColumn("_all", F.sum(size).over(Window.partitionBy(by))).filter(F.col("_before") < F.lit(share) * F.col("_all")).drop("_before", "_all")


def scene_rooms(plan: DataFrame, matches: DataFrame, layouts: DataFrame, by: str) -> DataFrame:
    """Plan rooms with the layout of the room matched to them, if any, and where they come from."""
    matched = matches.join(layouts, [by, "room_id"], "left")
    return plan.join(matched, [by, "plan_room_id"], "left").withColumn("provenance", F.when(F.col("room_id").isNotNull(), "reconstructed").otherwise("inferred"))


def plausibility(rooms: DataFrame, by: str) -> DataFrame:
    """Indoor rooms of a flat: how many have a height, its median, the plausible share, the largest
    extent and whether any is over 12. rooms: by, label, height, extent."""
    indoor = ~F.coalesce(F.col("label").isin(*OUTDOOR), F.lit(False))
    h = F.when(indoor, F.nullif(F.col("height"), F.lit(0.0)))
    e = F.when(indoor, F.col("extent"))
    return rooms.groupBy(by).agg(F.count_if(indoor).alias("n_rooms"), F.count(h).alias("n_with_height"), F.count_if(~indoor).alias("outdoor"), F.median(h).alias("median_height"), F.avg(h.between(*CEILING_RANGE).cast("double")).alias("plausible"), F.max(e).alias("max_extent"), F.coalesce(F.max(e) > 12, F.lit(False)).alias("any_over_12"))


def gather_union(rows: DataFrame, by: str, flags: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(flags))))


def tile_boxes(width: Column, height: Column, tile: int, overlap: float = 0.25) -> Column:
    """Array of struct<x, y> tile corners that cover a picture with an overlap; the last ones are
    set back to its edge."""
    step = int(tile * (1 - overlap))
    axis = lambda size: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - tile) / step)).cast("int")), lambda k: F.greatest(F.lit(0), F.least(k * step, size - tile)))
    return F.flatten(F.transform(axis(height), lambda y: F.transform(axis(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def unletterbox(x: Column, y: Column, width: Column, height: Column, side: int) -> Column:
    """A point of a picture that was fitted into a square, back in the picture."""
    k = F.lit(float(side)) / F.greatest(width, height)
    return F.struct(((x - (F.lit(side) - width * k) / 2) / k).alias("x"), ((y - (F.lit(side) - height * k) / 2) / k).alias("y"))


def grid_normals(points: DataFrame, by: str) -> DataFrame:
    """Unit normals of a depth grid (by, row, col, x, y, z) from right and lower differences."""
    right, down = Window.partitionBy(by, "row").orderBy("col"), Window.partitionBy(by, "col").orderBy("row")
    d = points.withColumns({f"a{c}": F.lead(c).over(right) - F.col(c) for c in "xyz"}).withColumns({f"b{c}": F.lead(c).over(down) - F.col(c) for c in "xyz"})
    nx, ny, nz = (F.col(f"a{p}") * F.col(f"b{q}") - F.col(f"a{q}") * F.col(f"b{p}") for p, q in ("yz", "zx", "xy"))
    size = F.nullif(F.sqrt(nx * nx + ny * ny + nz * nz), F.lit(0.0))
    return d.select(by, "row", "col", (nx / size).alias("nx"), (ny / size).alias("ny"), (nz / size).alias("nz"))


def unproject(u: Column, v: Column, depth: Column, width: Column, height: Column, fov_x_deg: Column) -> Column:
    """Pinhole: a pixel and its depth as struct<x, y, z>."""
    f = width / 2.0 / F.tan(F.radians(fov_x_deg) / 2.0)
    return F.struct(((u - width / 2.0) * depth / f).alias("x"), ((v - height / 2.0) * depth / f).alias("y"), depth.alias("z"))


def area_metric(model: Column, printed: Column, stated: Column) -> Column:
    """struct<error_pct, reference>: against the printed total, else the stated area, else null."""
    ref = F.coalesce(F.nullif(printed, F.lit(0.0)), F.nullif(stated, F.lit(0.0)))
    kind = F.when(F.coalesce(printed, F.lit(0.0)) != 0, "printed").when(F.coalesce(stated, F.lit(0.0)) != 0, "stated").otherwise("none")
    return F.struct(F.when(model > 0, F.abs(model - ref) / ref * 100).alias("error_pct"), kind.alias("reference"))


def missing_stages(present: dict[str, Column]) -> Column:
    """Names whose artifact is absent."""
    return F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in present.items()]), lambda x: x.isNotNull())
