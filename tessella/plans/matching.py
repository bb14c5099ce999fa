"""Matching and scale queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import matching as op
from tessella.operators import scale as sc
from tessella.sources.tables import table

LABELS = ("bathroom", "wc", "kitchen", "dining_room", "living_room", "reception", "bedroom", "hallway", "storage", "study")


def _sides(spark, d):
    """Suppliers as rooms and customers as plan rooms. A listing is a nation's part of a hundred
    suppliers and of the fifteen hundred customers that go with them, at any scale factor."""
    labels = F.array(*[F.lit(x) for x in LABELS])
    s = table(spark, d, "supplier").select(F.expr("s_suppkey div 100 * 25 + s_nationkey").alias("n"), F.col("s_suppkey").alias("room_id"), F.when(F.col("s_suppkey") % 7 > 0, F.element_at(labels, (F.col("s_suppkey") % 10 + 1).cast("int"))).alias("label"), (F.abs("s_acctbal") / 300.0 + 2.0).alias("area"), (F.col("s_suppkey") % 4 * 0.5 + 0.5).alias("aspect"), (F.col("s_suppkey") % 3).cast("int").alias("apertures"), (F.col("s_suppkey") % 10 / 10.0).alias("confidence"))
    c = table(spark, d, "customer").select(F.expr("c_custkey div 1500 * 25 + c_nationkey").alias("n"), F.col("c_custkey").alias("plan_room_id"), F.when(F.col("c_custkey") % 11 > 0, F.element_at(labels, (F.col("c_custkey") % 10 + 1).cast("int"))).alias("label"), (F.abs("c_acctbal") / 300.0 + 2.0).alias("area"), (F.col("c_custkey") % 4 * 0.5 + 0.5).alias("aspect"), (F.col("c_custkey") % 4).cast("int").alias("apertures"))
    return s, c


def cost_matrix(spark, d):
    out = op.cost_matrix(*_sides(spark, d), "n")
    return out.select("n", "room_id", "plan_room_id", *[F.round(k, 5).alias(k) for k in (*op.WEIGHTS, "cost")])


def runner_up_margin(spark, d):
    costs = op.cost_matrix(*_sides(spark, d), "n").withColumn("cost", F.round("cost", 6))
    out = op.runner_up(costs, "n")
    return out.select("n", "room_id", "best", "cost", F.round("margin", 6).alias("margin"), F.round(op.match_confidence(F.col("cost"), F.col("margin")), 4).alias("confidence"), "alternatives")


def assignment(spark, d):
    """One-to-one matching per listing (checked against brute force in the tests)."""
    out = op.assignment(op.cost_matrix(*_sides(spark, d), "n"), "n")
    return out.select("n", "room_id", "plan_room_id", F.round("cost", 6).alias("cost"), F.round("margin", 6).alias("margin"))


def pinned_costs(spark, d):
    """Costs left after pins and rejects, and the pinned pairs themselves."""
    costs = op.cost_matrix(*_sides(spark, d), "n").select("n", "room_id", "plan_room_id", "cost")
    pins = costs.filter("room_id % 17 = 3 and plan_room_id % 60 = room_id % 60").groupBy("n", "room_id").agg(F.min("plan_room_id").alias("plan_room_id"))
    rejects = costs.filter("room_id % 17 in (3, 5)").select("n", "room_id").distinct()
    free, pinned = op.with_pins(costs, pins, rejects, "n")
    return free.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("room_id").alias("rooms")).join(pinned.groupBy("n").agg(F.count(F.lit(1)).alias("pinned")), "n", "left").select("n", "pairs", "rooms", F.coalesce("pinned", F.lit(0)).alias("pinned"))


def _constraints(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_retailprice")
    joined = l.join(p, l["l_partkey"] == p["p_partkey"])
    return joined.select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("target"), (F.col("l_quantity") * F.col("p_retailprice")).alias("observed"), F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(2.0).alias("power"), (1.0 + F.col("l_tax") * 10).alias("weight"), (F.col("l_linenumber") % 3).alias("kind"))


def wls_scale(spark, d):
    out = sc.solve(_constraints(spark, d), "g")
    out = out.withColumn("quality", sc.quality(F.col("n_used"), F.col("kinds"), F.col("residual_rms_pct"), F.col("n_rejected")))
    return out.select("g", F.round("scale", 6).alias("scale"), F.round("sigma_log", 6).alias("sigma_log"), F.round("residual_rms_pct", 4).alias("residual_rms_pct"), "n_used", "n_rejected", F.round("quality", 4).alias("quality"))


def printed_area_gate(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("double")
    gated = sc.printed_area(size, F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 97 + 0.5), F.when(F.col("p_partkey") % 5 == 0, size / 4.0), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 9 + 0.25))
    return p.select("p_partkey", F.round(gated, 4).alias("area")).filter("area is not null")


def aggregate_scale(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * 100).alias("px"), F.col("l_quantity").alias("m2"))
    out = sc.aggregate_scale(rows, "l_suppkey", "px", "m2")
    return out.select("l_suppkey", "n", F.round("scale", 4).alias("scale"))


def self_consistency(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_retailprice")
    rows = l.join(p, l["l_partkey"] == p["p_partkey"]).select("l_suppkey", (F.col("l_quantity") * F.col("p_retailprice")).alias("truth"), F.col("l_extendedprice").alias("got"))
    out = sc.self_consistency(rows, "l_suppkey", "truth", "got")
    return out.select("l_suppkey", "n", F.round("median_error_pct", 4).alias("median_error_pct"), F.round("within_10", 4).alias("within_10"))


def estimate_weights(spark, d):
    out = sc.spread_and_weight(table(spark, d, "supplier").filter("s_acctbal > 0"), "s_nationkey", "s_acctbal")
    return out.select("s_nationkey", F.round("median", 4).alias("median"), "n", F.round("spread", 4).alias("spread"), F.round("weight", 4).alias("weight"))


_L = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_AFF = ", ".join(f"('{'|'.join(sorted((a, b)))}', {c}::DOUBLE)" for a, b, c in op.AFFINITY)
_COST = f"""
s AS (SELECT s_suppkey // 100 * 25 + s_nationkey AS n, s_suppkey AS room_id, CASE WHEN s_suppkey % 7 > 0 THEN {_L}[s_suppkey % 10 + 1] END AS label, abs(s_acctbal) / 300.0::DOUBLE + 2 AS area, s_suppkey % 4 * 0.5::DOUBLE + 0.5::DOUBLE AS aspect, s_suppkey % 3 AS ap, s_suppkey % 10 / 10.0::DOUBLE AS conf FROM supplier),
c AS (SELECT c_custkey // 1500 * 25 + c_nationkey AS n, c_custkey AS plan_room_id, CASE WHEN c_custkey % 11 > 0 THEN {_L}[c_custkey % 10 + 1] END AS label, abs(c_acctbal) / 300.0::DOUBLE + 2 AS area, c_custkey % 4 * 0.5::DOUBLE + 0.5::DOUBLE AS aspect, c_custkey % 4 AS ap FROM customer),
aff(k, v) AS (VALUES {_AFF}),
parts AS (SELECT s.n, room_id, plan_room_id,
  0.34::DOUBLE * CASE WHEN s.label IS NULL OR c.label IS NULL THEN 0.5 WHEN s.label = c.label THEN 0.0 ELSE coalesce(aff.v, 1.0) END AS room_type,
  0.30::DOUBLE * least(1.0::DOUBLE, abs(ln(s.area / c.area)) / ln(2.2::DOUBLE)) AS area_ratio,
  0.18::DOUBLE * least(1.0::DOUBLE, abs(ln(s.aspect / c.aspect)) / ln(2.0::DOUBLE)) AS aspect,
  0.10::DOUBLE * CASE WHEN s.ap = 0 AND c.ap = 0 THEN 0.3 ELSE least(1.0, abs(s.ap - c.ap) / 3.0::DOUBLE) END AS apertures,
  0.08::DOUBLE * (1 - least(1.0::DOUBLE, coalesce(nullif(s.conf, 0), 0.5))) AS confidence
  FROM s JOIN c ON s.n = c.n LEFT JOIN aff ON aff.k = least(s.label, c.label) || '|' || greatest(s.label, c.label)),
costs AS (SELECT *, room_type + area_ratio + aspect + apertures + confidence AS cost FROM parts)"""
_ROUND = """
{n}f AS (SELECT g, sum(weight * power * y) / sum(weight * power * power) AS ls FROM {p} GROUP BY g),
{n}r AS (SELECT p.*, y - power * ls AS r FROM {p} p JOIN {n}f ON p.g = {n}f.g),
{n}m AS (SELECT g, median(r) AS med, count(*) AS n FROM {n}r GROUP BY g),
{n}d AS (SELECT a.*, abs(a.r - m.med) AS d, m.n FROM {n}r a JOIN {n}m m ON a.g = m.g),
{n}s AS (SELECT g, 1.4826::DOUBLE * median(d) AS mad FROM {n}d GROUP BY g),
{n}k AS (SELECT d.*, s.mad, d.d <= 2.5 * s.mad AS keep, count(*) FILTER (d.d <= 2.5 * s.mad) OVER (PARTITION BY d.g) AS nk FROM {n}d d JOIN {n}s s ON d.g = s.g),
{n}a AS (SELECT g, power, weight, kind, y FROM {n}k WHERE NOT (n > 2 AND mad > 1e-6 AND nk >= 2 AND nk < n) OR keep)"""

QUERIES = {f.__name__: f for f in (cost_matrix, runner_up_margin, assignment, pinned_costs, wls_scale, printed_area_gate, aggregate_scale, self_consistency, estimate_weights)}
ORACLES = {
    "cost_matrix": f"WITH {_COST} SELECT n, room_id, plan_room_id, round(room_type, 5) AS room_type, round(area_ratio, 5) AS area_ratio, round(aspect, 5) AS aspect, round(apertures, 5) AS apertures, round(confidence, 5) AS confidence, round(cost, 5) AS cost FROM costs",
    "runner_up_margin": f"""WITH {_COST}, q AS (SELECT n, room_id, plan_room_id, round(cost, 6) AS cost FROM costs), r AS (SELECT *, row_number() OVER (PARTITION BY n, room_id ORDER BY cost, plan_room_id) AS k FROM q),
b AS (SELECT n, room_id, min(plan_room_id) FILTER (k = 1) AS best, min(cost) AS cost, min(cost) FILTER (k = 2) - min(cost) AS margin, coalesce(string_agg(CAST(plan_room_id AS VARCHAR), ',' ORDER BY k) FILTER (k BETWEEN 2 AND 4), '') AS alternatives FROM r GROUP BY 1, 2)
SELECT n, room_id, best, cost, round(margin, 6) AS margin, round(least(1, greatest(0.02, CASE WHEN margin IS NOT NULL THEN 0.6 * greatest(0, 1 - cost / 0.72) + 0.4 * least(1, margin / 0.25) ELSE greatest(0, 1 - cost / 0.72) END)), 4) AS confidence, alternatives FROM b""",
    "pinned_costs": f"""WITH {_COST}, pins AS (SELECT n, room_id, min(plan_room_id) AS plan_room_id FROM costs WHERE room_id % 17 = 3 AND plan_room_id % 60 = room_id % 60 GROUP BY 1, 2),
free AS (SELECT * FROM costs c WHERE room_id % 17 NOT IN (3, 5) AND NOT EXISTS (SELECT 1 FROM pins p WHERE p.n = c.n AND p.plan_room_id = c.plan_room_id)),
k AS (SELECT n, count(*) AS pinned FROM pins GROUP BY 1), f AS (SELECT n, count(*) AS pairs, count(DISTINCT room_id) AS rooms FROM free GROUP BY 1)
SELECT f.n, pairs, rooms, coalesce(pinned, 0) AS pinned FROM f LEFT JOIN k ON f.n = k.n""",
    "wls_scale": f"""
WITH a0 AS (SELECT l_suppkey AS g, CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS power, 1.0::DOUBLE + l_tax * 10 AS weight, l_linenumber % 3 AS kind, ln(l_extendedprice) - ln(l_quantity * p_retailprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 AND l_quantity * p_retailprice > 0),
{_ROUND.format(n="x", p="a0")}, {_ROUND.format(n="y", p="xa")}, {_ROUND.format(n="z", p="ya")},
f AS (SELECT g, sum(weight * power * y) / sum(weight * power * power) AS ls FROM za GROUP BY g), r AS (SELECT a.*, f.ls, a.y - a.power * f.ls AS r FROM za a JOIN f ON a.g = f.g),
o AS (SELECT g, any_value(ls) AS ls, count(*) AS n_used, count(DISTINCT kind) AS kinds, sqrt(sum(weight * r * r) / (sum(weight) * greatest(1, count(*) - 1))) AS sg, (exp(sqrt(avg(r * r))) - 1) * 100 AS rms FROM r GROUP BY g),
t AS (SELECT g, count(*) AS n_all FROM a0 GROUP BY g)
SELECT o.g, round(exp(ls), 6) AS scale, round(sg, 6) AS sigma_log, round(rms, 4) AS residual_rms_pct, n_used, n_all - n_used AS n_rejected,
  round(least(1, greatest(0.02, 0.25::DOUBLE + 0.15::DOUBLE * least(3, kinds) + 0.2::DOUBLE * greatest(0, 1 - rms / 25) + 0.1::DOUBLE * least(1, n_used / 4.0) - CASE WHEN n_all > n_used THEN 0.1::DOUBLE ELSE 0 END)), 4) AS quality FROM o JOIN t ON o.g = t.g""",
    "printed_area_gate": """
WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS drawn, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_size / 4.0::DOUBLE * (p_partkey % 9 + 0.25::DOUBLE) END, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 97 + 0.5::DOUBLE END) AS v FROM part)
SELECT p_partkey, round(v, 4) AS area FROM r WHERE v BETWEEN 1.5 AND 120 AND drawn > 0 AND greatest(v / drawn, drawn / v) <= 2""",
    "aggregate_scale": "SELECT l_suppkey, count(*) AS n, round(sqrt(sum(l_extendedprice * 100) / sum(l_quantity)), 4) AS scale FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY 1 HAVING count(*) >= 2 AND sqrt(sum(l_extendedprice * 100) / sum(l_quantity)) BETWEEN 1 AND 5000",
    "self_consistency": """
WITH e AS (SELECT l_suppkey, abs(l_extendedprice - l_quantity * p_retailprice) / (l_quantity * p_retailprice) * 100 AS e FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_suppkey, count(e) AS n, round(median(e), 4) AS median_error_pct, round(avg((e <= 10)::INT), 4) AS within_10 FROM e GROUP BY 1""",
    "estimate_weights": """
WITH m AS (SELECT s_nationkey, median(s_acctbal) AS med, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1), f AS (SELECT s.s_nationkey, any_value(med) AS med, any_value(n) AS n, max(abs(s_acctbal - med)) / any_value(med) AS sp FROM supplier s JOIN m ON s.s_nationkey = m.s_nationkey WHERE s_acctbal > 0 GROUP BY 1)
SELECT s_nationkey, round(med, 4) AS median, n, round(sp, 4) AS spread, round(least(3, n / (1 + 10 * sp)), 4) AS weight FROM f""",
}
