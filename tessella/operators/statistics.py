"""Coverage, latency, rollups, gates, histograms and regression alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.quantiles import few, quantiles


def rate(part: Column, whole: Column) -> Column:
    """A share, 0 where there is nothing to share."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def coverage(rows: DataFrame, by: str, has: Column, amount: Column) -> DataFrame:
    """Per group: rows seen, rows with the property, its rate, median amount and rows without any
    amount. Observe before any filter, or denominators lie."""
    grouped = rows.groupBy(by).agg(F.count(F.lit(1)).alias("seen"), F.count_if(has).alias("with_property"), F.count_if(F.coalesce(amount, F.lit(0)) == 0).alias("without_amount"))
    grouped = grouped.join(quantiles(rows.select(by, amount.alias("_amount")), [by], "_amount", {"median_amount": 0.5}), by, "left")
    return grouped.withColumn("property_rate", rate(F.col("with_property"), F.col("seen")))


def latency_report(stages: DataFrame, runs: DataFrame, stage: str, seconds: str, status: str, total: str, full: str, small: int = 20) -> DataFrame:
    """stage, n, p50, p95 (nearest rank), max_s, mean_s, few: of each stage over what ran or came from
    the cache; and of the whole run, as end_to_end_full over runs from the first stage on (full)
    and end_to_end_all over all of them. few marks figures of under `small` values.

    stages: a row per run and stage, with stage, seconds, status. runs: a row per run, with its
    total seconds and whether it was full. Null seconds are not counted.
    """
    timed = stages.filter(F.col(status).isin("ok", "cached")).select(F.col(stage).alias("stage"), F.col(seconds).cast("double").alias("s"))
    whole = runs.select(F.explode(F.array_compact(F.array(F.lit("end_to_end_all"), F.when(F.col(full), "end_to_end_full")))).alias("stage"), F.col(total).cast("double").alias("s"))
    rows = timed.unionByName(whole)
    grouped = rows.groupBy("stage").agg(F.count("s").alias("n"), F.max("s").alias("max_s"), F.avg("s").alias("mean_s"))
    ranks = quantiles(rows, ["stage"], "s", {"p50": 0.5, "p95": 0.95}, nearest=True)
    return grouped.join(ranks, "stage", "left").select("stage", "n", "p50", "p95", "max_s", "mean_s", (F.col("n") < small).alias("few"))


def rollup(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, coverage (share of non-null), median, mean, p10, p90, min, max."""
    v = F.col(value)
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(v) / F.count(F.lit(1))).alias("coverage"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return plain.join(quantiles(rows, by, value, {"median": 0.5, "p10": 0.1, "p90": 0.9}), by, "left")


def status_pivot(rows: DataFrame, by: str, status: str, values: list) -> DataFrame:
    """Counts of each status per group, 0 where there is none. The values are listed, so no pass
    over the data looks for them."""
    return rows.groupBy(by).pivot(status, values).count().fillna(0)


def confusion(rows: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; undefined ratios are 0, null truth or
    prediction counts nowhere."""
    judged = rows.filter(truth.isNotNull() & said.isNotNull())
    counted = judged.groupBy(*(by or [])).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counted.withColumn("precision", p).withColumn("recall", r)
    out = out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def gate_verdict(judged: Column, all_: Column, rate_: Column) -> Column:
    """Not judged under half of all; then passes from 0.7 and is marginal from 0.5."""
    return F.when(judged * 2 < all_, "not judged").when(rate_ >= 0.7, "passes").when(rate_ >= 0.5, "marginal").otherwise("fails")


def gate_summary(rows: DataFrame, by: str, passed: str, value: str) -> DataFrame:
    """Per criterion: judged and unjudged rows, pass rate over the judged, median value, verdict.
    A null pass is no judgement and counts in neither. Criteria are few and have many rows, so medians are
    those of `quantiles`; rows without a criterion have none."""
    p = F.col(passed)
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(p).alias("judged"), F.count_if(p.isNull()).alias("unjudged"), F.count_if(p).alias("n_pass"))
    counted = counted.join(quantiles(rows, [by], value, {"median_value": 0.5}), by, "left")
    counted = counted.withColumn("pass_rate", F.when(F.col("judged") > 0, F.col("n_pass") / F.col("judged")))
    return counted.withColumn("verdict", gate_verdict(F.col("judged"), F.col("n"), F.coalesce("pass_rate", F.lit(0.0))))


def regressions(history: DataFrame, by: str, order: str, value: str, lower_is_better: Column, floor: Column, sigmas: float = 2.0) -> DataFrame:
    """Each point against the one before it and the spread of all before it: drop, threshold,
    alert. The point itself is not in its own baseline; a spread needs three earlier points."""
    series = Window.partitionBy(by).orderBy(order)
    past = series.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(value).over(past)
    sigma = F.when(n >= 3, F.stddev_pop(value).over(past)).otherwise(F.lit(0.0))
    rows = history.withColumn("previous", F.lag(value).over(series)).withColumn("points", n).withColumn("sigma", sigma)
    rows = rows.withColumn("drop_by", F.when(lower_is_better, F.col(value) - F.col("previous")).otherwise(F.col("previous") - F.col(value)))
    rows = rows.withColumn("threshold", F.greatest(F.lit(sigmas) * F.col("sigma"), floor))
    return rows.withColumn("alert", F.col("drop_by") > F.col("threshold")).withColumn("rule", F.when(F.lit(sigmas) * F.col("sigma") >= floor, "sigma").otherwise("floor")).filter(F.col("previous").isNotNull())


def histogram(rows: DataFrame, by: str, value: str, bins: int, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """by, bin, n over equal bins between two percentiles of each group; values outside go."""
    v = F.col(value).cast("double")
    range_ = few(quantiles(rows, [by], value, {"lo": low, "hi": high}))
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)).cast("long")
    return rows.join(range_, by).filter((v >= F.col("lo")) & (v <= F.col("hi"))).groupBy(by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dense_span(hist: DataFrame, by: str, share: float = 0.12) -> DataFrame:
    """Outermost bins that reach a share of the fullest one, and its count."""
    top = F.max("n").over(Window.partitionBy(by))
    dense = hist.withColumn("mode", top).filter(F.col("n") >= F.lit(share) * F.col("mode"))
    return dense.groupBy(by).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.max("mode").alias("mode"), F.count(F.lit(1)).alias("dense_bins"))


def smoothed(hist: DataFrame, by: str, half: int = 1) -> DataFrame:
    """Moving sum of each bin and its neighbours, absent bins as none."""
    w = Window.partitionBy(by).orderBy("bin").rangeBetween(-half, half)
    return hist.withColumn("around", F.sum("n").over(w))


def two_layers(hist: DataFrame, by: str, apart: int, half: int = 1) -> DataFrame:
    """The fullest smoothed bin and the fullest one at least apart bins away: two layers (floor and
    ceiling, say) and the share of all rows that they hold. Ties go to the smaller bin."""
    s = smoothed(hist, by, half)
    first = s.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("around"), "bin"))).filter("k = 1").select(by, F.col("bin").alias("bin1"), F.col("around").alias("around1"))
    far = s.join(first, by).filter(F.abs(F.col("bin") - F.col("bin1")) >= apart)
    second = far.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("around"), "bin"))).filter("k = 1").select(by, F.col("bin").alias("bin2"), F.col("around").alias("around2"))
    total = hist.groupBy(by).agg(F.sum("n").alias("total"))
    return first.join(second, by).join(total, by).withColumn("score", (F.col("around1") + F.col("around2")) / F.col("total"))


def flag_frequency(rows: DataFrame, flags: str, id_col: str) -> DataFrame:
    """Rows per flag; a row that carries a flag twice counts once."""
    return rows.select(id_col, F.explode(F.array_distinct(flags)).alias("flag")).groupBy("flag").agg(F.countDistinct(id_col).alias("n"))


def spread_of_estimates(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(max - min) / max in percent over a group's estimates; null under two of them."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count(v).alias("n"), F.when(F.count(v) >= 2, (F.max(v) - F.min(v)) / F.nullif(F.max(v), F.lit(0.0)) * 100).alias("disagreement_pct"))
