"""Cost matrices, runner-up margins and minimum-cost assignment within groups."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts of a cost.
WEIGHTS = {"room_type": 0.34, "area_ratio": 0.30, "aspect": 0.18, "apertures": 0.10, "confidence": 0.08}
#: What it costs to take one label for another; other pairs cost 1.
AFFINITY = (
    ("living_room", "dining_room", 0.15),
    ("living_room", "reception", 0.05),
    ("dining_room", "reception", 0.10),
    ("living_room", "kitchen", 0.35),
    ("kitchen", "dining_room", 0.30),
    ("hallway", "bedroom", 0.55),
    ("hallway", "storage", 0.25),
    ("bathroom", "wc", 0.10),
    ("bathroom", "utility", 0.35),
    ("study", "bedroom", 0.30),
    ("other_room", "storage", 0.20),
    ("balcony", "garden", 0.15),
)
UNKNOWN, REFUSE = 0.5, 0.72


def label_cost(a: Column, b: Column) -> Column:
    pairs = F.create_map(*[x for p, q, c in AFFINITY for x in (F.lit("|".join(sorted((p, q)))), F.lit(c))])
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(UNKNOWN)).when(a == b, F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(pairs, key), F.lit(1.0)))


def log_ratio_cost(a: Column, b: Column, factor: float, missing: float) -> Column:
    """|ln(a / b)| over ln(factor), at most 1: half and twice cost the same."""
    return F.when((a > 0) & (b > 0), F.least(F.lit(1.0), F.abs(F.ln(a / b)) / F.ln(F.lit(factor)))).otherwise(F.lit(missing))


def aperture_cost(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(0.3)).otherwise(F.least(F.lit(1.0), F.abs(a - b) / 3.0))


def cost_matrix(rooms: DataFrame, plans: DataFrame, by: str) -> DataFrame:
    """Rows (by, room_id, plan_room_id, cost and its parts) for every pair within a group. The join
    is on the group; sizes of groups bound its rows.

    rooms: by, room_id, label, area, aspect, apertures, confidence. plans: by, plan_room_id, the
    same without confidence. Missing aspect and confidence count as 1 and 0.5.
    """
    r = rooms.select(by, "room_id", *[F.col(c).alias(f"r_{c}") for c in ("label", "area", "aspect", "apertures", "confidence")])
    p = plans.select(by, "plan_room_id", *[F.col(c).alias(f"p_{c}") for c in ("label", "area", "aspect", "apertures")])
    both = r.join(p, by)
    one = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0))
    parts = {
        "room_type": label_cost(F.col("r_label"), F.col("p_label")),
        "area_ratio": log_ratio_cost(F.coalesce("r_area", F.lit(0.0)), F.coalesce("p_area", F.lit(0.0)), 2.2, 1.0),
        "aspect": log_ratio_cost(one("r_aspect"), one("p_aspect"), 2.0, 0.5),
        "apertures": aperture_cost(F.coalesce("r_apertures", F.lit(0)), F.coalesce("p_apertures", F.lit(0))),
        "confidence": 1.0 - F.least(F.lit(1.0), F.coalesce(F.nullif(F.col("r_confidence"), F.lit(0.0)), F.lit(0.5))),
    }
    weighed = both.select(by, "room_id", "plan_room_id", *[(F.lit(WEIGHTS[k]) * c).alias(k) for k, c in parts.items()])
    return weighed.withColumn("cost", sum((F.col(k) for k in parts), F.lit(0.0)))


def runner_up(costs: DataFrame, by: str) -> DataFrame:
    """Per room: the cheapest plan room, its cost, the margin to the next and the next three."""
    w = Window.partitionBy(by, "room_id").orderBy("cost", "plan_room_id")
    top = costs.withColumn("k", F.row_number().over(w)).filter("k <= 4")
    second = F.min(F.when(F.col("k") == 2, F.col("cost")))
    others = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") > 1, F.struct("k", "plan_room_id")))), lambda s: s["plan_room_id"].cast("string")), ",")
    return top.groupBy(by, "room_id").agg(F.min_by("plan_room_id", "k").alias("best"), F.min("cost").alias("cost"), (second - F.min("cost")).alias("margin"), others.alias("alternatives"))


def match_confidence(cost: Column, margin: Column) -> Column:
    """How sure a match is: low cost, and a clear lead over the runner-up where there is one."""
    plain = F.greatest(F.lit(0.0), 1.0 - cost / REFUSE)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.02), F.when(margin.isNotNull(), 0.6 * plain + 0.4 * F.least(F.lit(1.0), margin / 0.25)).otherwise(plain)))


def assign_matrix(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a minimum-cost assignment of a rectangular matrix: shortest
    augmenting paths with potentials, O(n^2 m)."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign_matrix(cost.T))
    n, m = cost.shape
    of_row, of_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, col = row, 0.0, -1
        while True:
            through = base + cost[at] - of_row[at] - of_col
            better = ~done & (through < dist - 1e-15)
            dist[better], prev[better] = through[better], col
            col = int(np.where(done, np.inf, dist).argmin())
            base, done[col] = dist[col], True
            if owner[col] < 0:
                break
            at = owner[col]
        reached = done & (np.arange(m) != col)
        of_row[row] += base
        of_row[owner[reached]] += base - dist[reached]
        of_col[reached] -= base - dist[reached]
        while col >= 0:
            back = prev[col]
            owner[col] = owner[back] if back >= 0 else row
            col = back
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def brute_force(cost: np.ndarray) -> float:
    """Least total cost over all assignments; for tests."""
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    return min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(cost.shape[1]), cost.shape[0]))


def assignment(costs: DataFrame, by: str, refuse: float = REFUSE) -> DataFrame:
    """by, room_id, plan_room_id, cost, margin: the cheapest one-to-one matching of each group,
    without pairs dearer than refuse. A group (one listing) is solved in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in costs.schema}

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="room_id", columns="plan_room_id", values="cost").sort_index().sort_index(axis=1)
        c = matrix.to_numpy(float)
        out = []
        for i, j in assign_matrix(c):
            rest = np.delete(c[i], j)
            if c[i, j] <= refuse:
                out.append((rows[by].iloc[0], matrix.index[i], matrix.columns[j], c[i, j], rest.min() - c[i, j] if len(rest) else np.nan))
        return pd.DataFrame(out, columns=[by, "room_id", "plan_room_id", "cost", "margin"])

    return costs.select(by, "room_id", "plan_room_id", "cost").groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, room_id {kinds['room_id']}, plan_room_id {kinds['plan_room_id']}, cost double, margin double")


def with_pins(costs: DataFrame, pins: DataFrame, rejects: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(free costs, pinned pairs): pinned rooms and plan rooms leave both sides, then rejected
    rooms leave; a pin beats a reject. pins: by, room_id, plan_room_id. rejects: by, room_id."""
    free = costs.join(pins.select(by, "room_id"), [by, "room_id"], "left_anti").join(pins.select(by, "plan_room_id"), [by, "plan_room_id"], "left_anti")
    return free.join(rejects, [by, "room_id"], "left_anti"), costs.join(pins, [by, "room_id", "plan_room_id"], "left_semi")
