"""Robust scale: weighted least squares in log space with rejection, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import discard, materialize


def _residual(k: int) -> Column:
    return F.col("y") - F.col("power") * F.col(f"ls{k}")


def _active(rows: DataFrame, k: int) -> DataFrame:
    """Rows that the first k rounds keep."""
    for i in range(k):
        rows = rows.filter(F.col(f"bound{i}").isNull() | (F.abs(_residual(i) - F.col(f"med{i}")) <= F.col(f"bound{i}")))
    return rows


#: Up to so many groups, what the rounds find for them is carried by the driver and broadcast.
FEW = 10_000


class _State:
    """A row per group: what the rounds so far found for it. The next step starts from it and not
    from all before: from rows that the driver holds, if their number is checked to be small, or
    from a written table."""

    def __init__(self, state: DataFrame, by: str):
        self.by, self.few = by, state.count() <= FEW
        self.table = self._kept(state)

    def _kept(self, state: DataFrame) -> DataFrame:
        if self.few:
            return F.broadcast(state.sparkSession.createDataFrame(state.toArrow(), state.schema))
        return materialize(state, "state")

    def step(self, base: DataFrame, k: int, value: Column, name: str) -> None:
        """Adds an aggregate of the rows still active after k rounds."""
        found = _active(base.join(self.table, self.by), k).groupBy(self.by).agg(value.alias(name))
        old, self.table = self.table, self._kept(self.table.join(found, self.by, "left"))
        discard(old)


def solve(constraints: DataFrame, by: str, rounds: int = 3, reject: float = 2.5) -> DataFrame:
    """Per group: scale, log_scale, sigma_log, residual_rms_pct, n_used, n_rejected.

    constraints: by, target, observed, power, weight, kind. target = observed * scale^power in log
    space. Up to `rounds` times, of more than two constraints those go whose residual is further
    from the median than `reject` scaled median deviations, if that deviation exceeds 1e-6, at
    least two stay and not all. A round without rejection changes nothing, so a fixed number of
    rounds does: each is two medians and a count with the next fit per group over the same base
    rows, which the small table of groups filters. Groups without a usable constraint give none.
    A group's median is that of one task; a group is a listing here, or a few hundred at most.
    """
    t, o = F.col("target"), F.col("observed")
    usable = constraints.filter((t > 0) & (o > 0) & (t < F.lit(float("inf"))) & (o < F.lit(float("inf"))))
    base = materialize(usable.select(by, "power", "weight", "kind", (F.ln("target") - F.ln("observed")).alias("y")), "constraints")
    state = _State(base.groupBy(by).agg(F.count(F.lit(1)).alias("n_all")), by)
    leverage = F.col("weight") * F.col("power")
    of = lambda rows: F.sum(F.when(rows, leverage * F.col("y"))) / F.nullif(F.sum(F.when(rows, leverage * F.col("power"))), F.lit(0.0))
    state.step(base, 0, of(F.lit(True)), "ls0")
    for k in range(rounds):
        state.step(base, k, F.median(_residual(k)), f"med{k}")
        state.step(base, k, F.lit(1.4826) * F.median(F.abs(_residual(k) - F.col(f"med{k}"))), f"mad{k}")
        near = F.abs(_residual(k) - F.col(f"med{k}")) <= F.lit(reject) * F.col(f"mad{k}")
        # the fit of the next round too, both ways: only this count tells which of them it is
        state.step(base, k, F.struct(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("keep"), of(F.lit(True)).alias("every"), of(near).alias("kept")), f"c{k}")
        c = F.col(f"c{k}")
        acts = (c["n"] > 2) & (F.col(f"mad{k}") > 1e-6) & (c["keep"] >= 2) & (c["keep"] < c["n"])
        state.table = state.table.withColumn(f"bound{k}", F.when(acts, F.lit(reject) * F.col(f"mad{k}"))).withColumn(f"ls{k + 1}", F.when(acts, c["kept"]).otherwise(c["every"])).drop(f"c{k}", f"mad{k}")
    at = _active(base.join(state.table, by), rounds).withColumn("r", _residual(rounds)).withColumn("ls", F.col(f"ls{rounds}"))
    w, r = F.col("weight"), F.col("r")
    out = at.groupBy(by).agg(F.first("ls").alias("log_scale"), F.count(F.lit(1)).alias("n_used"), F.countDistinct("kind").alias("kinds"), F.sqrt(F.sum(w * r * r) / F.nullif(F.sum(w) * F.greatest(F.lit(1), F.count(F.lit(1)) - 1), F.lit(0.0))).alias("sigma_log"), ((F.exp(F.sqrt(F.avg(r * r))) - 1) * 100).alias("residual_rms_pct"))
    return out.join(state.table.select(by, "n_all"), by).select(by, F.exp("log_scale").alias("scale"), "log_scale", F.coalesce("sigma_log", F.lit(0.0)).alias("sigma_log"), "residual_rms_pct", "n_used", (F.col("n_all") - F.col("n_used")).alias("n_rejected"), "kinds")


def quality(n_used: Column, kinds: Column, rms_pct: Column, n_rejected: Column) -> Column:
    """Trust in a scale, 0.02 to 1: kinds of evidence, their agreement and number; 0 without any."""
    q = F.lit(0.25) + 0.15 * F.least(F.lit(3), kinds) + 0.2 * F.greatest(F.lit(0.0), 1 - rms_pct / 25.0) + 0.1 * F.least(F.lit(1.0), n_used / 4.0) - F.when(n_rejected > 0, 0.1).otherwise(0.0)
    return F.when(n_used == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.02), q)))


def printed_area(drawn: Column, printed: Column, side_a: Column, side_b: Column, low: float = 1.5, high: float = 120.0, factor: float = 2.0) -> Column:
    """The printed area that a drawn one may be checked against: the product of printed sides, else
    the printed area; null if implausible or off the drawn one by more than a factor."""
    value = F.coalesce(side_a * side_b, printed)
    ratio = F.greatest(value / F.nullif(drawn, F.lit(0.0)), drawn / F.nullif(value, F.lit(0.0)))
    return F.when(value.between(low, high) & (F.coalesce(drawn, F.lit(0.0)) > 0) & (ratio <= factor), value)


def aggregate_scale(rows: DataFrame, by: str, pixels: str, metres: str) -> DataFrame:
    """sqrt(sum of pixel areas / sum of printed areas) of groups with two rows at least, if it is
    between 1 and 5000."""
    grouped = rows.filter((F.col(pixels) > 0) & (F.col(metres) > 0)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(pixels) / F.sum(metres)).alias("scale"))
    return grouped.filter("n >= 2 and scale > 1 and scale < 5000")


def self_consistency(rows: DataFrame, by: str, truth: str, got: str) -> DataFrame:
    """Absolute percent errors of a group: n, median, share within 10 percent."""
    error = F.abs(F.col(got) - F.col(truth)) / F.nullif(F.col(truth), F.lit(0.0)) * 100
    return rows.withColumn("error", error).groupBy(by).agg(F.count("error").alias("n"), F.median("error").alias("median_error_pct"), F.avg((F.col("error") <= 10).cast("double")).alias("within_10"))


def spread_and_weight(rows: DataFrame, by: str, value: str, most: float = 3.0) -> DataFrame:
    """Median of a group's estimates, the largest relative distance from it, and a weight that
    grows with the number and falls with the spread, capped."""
    mid = rows.groupBy(by).agg(F.median(value).alias("mid"), F.count(value).alias("n"))
    far = rows.join(mid, by).groupBy(by).agg(F.first("mid").alias("median"), F.first("n").alias("n"), (F.max(F.abs(F.col(value) - F.col("mid"))) / F.nullif(F.first("mid"), F.lit(0.0))).alias("spread"))
    return far.withColumn("weight", F.least(F.lit(most), F.col("n") / (1.0 + 10.0 * F.col("spread"))))
