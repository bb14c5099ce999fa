"""Validation by rules, flags, verdicts, run status and review priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, schema: str, id_col: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """schema, id, path, rule: a row for every rule that a row breaks. rules hold (path, rule name,
    condition that must be true); a condition that is null counts as broken. All are listed, not
    only the first."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))) for path, rule, ok in rules]), lambda x: x.isNotNull())
    return rows.select(F.lit(schema).alias("schema"), F.col(id_col).alias("id"), F.explode(found).alias("v")).select("schema", "id", "v.path", "v.rule")


def flags(rules: dict[str, Column]) -> Column:
    """Sorted array of the names whose condition holds; null conditions don't."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull()))


def flag_union(rows: DataFrame, by: str, flag_col: str) -> DataFrame:
    """Sorted distinct flags over a group's rows."""
    return rows.select(by, F.explode(flag_col).alias("f")).groupBy(by).agg(F.array_sort(F.collect_set("f")).alias("flags"))


def confidence(parts: list[tuple[Column, float]], base: float, low: float = 0.02, high: float = 1.0) -> Column:
    """base plus weighted parts, clamped."""
    total = F.lit(base)
    for part, weight in parts:
        total = total + part * F.lit(weight)
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def run_status(stages: DataFrame, run: str, status: str, seconds: str, budget: Column, slo: float) -> DataFrame:
    """Per run: failed if every stage failed; partial if any failed or was skipped; else ok. Also
    the number of stages over budget and whether all together broke the objective."""
    s = F.col(status)
    grouped = stages.groupBy(run).agg(F.bool_and(s == "failed").alias("_all"), F.bool_or(s.isin("failed", "skipped")).alias("_any"), F.sum(seconds).alias("total_seconds"), F.count_if(F.col(seconds) > budget).alias("over_budget"))
    state = F.when(F.col("_all"), "failed").when(F.col("_any"), "partial").otherwise("ok")
    return grouped.select(run, state.alias("status"), "total_seconds", "over_budget", (F.col("total_seconds") > slo).alias("slo_breach"))


def fit_verdict(fit: Column, checks: list[Column], good: float = 0.85, poor: float = 0.70) -> Column:
    """unknown without a fit, poor below one threshold, clean above the other with all checks
    passed, else check."""
    passed = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks), F.lit(0))
    return F.when(fit.isNull(), "unknown").when(fit < poor, "poor").when((fit >= good) & (passed == len(checks)), "clean").otherwise("check")


def review_priority(blocking: Column, conf: Column, has_result: Column) -> Column:
    """2 per blocking flag, 3 for what confidence lacks, 5 without a result."""
    return blocking * 2 + (1 - conf) * 3 + F.when(has_result, 0).otherwise(5)


def plausible_share(rows: DataFrame, by: str, value: str, low: float, high: float, share: float) -> DataFrame:
    """Keeps rows whose value lies between bounds and, in groups of more than two, is at most a
    share of the group's total. Where that would leave nothing of a group, the whole group stays."""
    group = Window.partitionBy(by)
    part = F.col(value) / F.nullif(F.sum(value).over(group), F.lit(0.0))
    ok = F.col(value).between(low, high) & ((F.count(F.lit(1)).over(group) <= 2) | (part <= share))
    marked = rows.withColumn("share", part).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return marked.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(group)).filter(F.col("_ok") | (F.col("_n") == 0)).withColumn("fallback", F.col("_n") == 0).drop("_ok", "_n")


def rescaled(rows: DataFrame, by: str, value: str, to: float) -> DataFrame:
    """Values as parts of their group's total, which becomes `to`; missing (null or 0) values stay
    as they are, and so do groups without any."""
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(Window.partitionBy(by))
    return rows.withColumn("rescaled", F.when((F.coalesce(F.col(value), F.lit(0.0)) != 0) & (total > 0), F.col(value) / total * F.lit(to)).otherwise(F.col(value)))


def first_by_priority(rows: DataFrame, by: str, priority: Column, tie: str, available: Column) -> DataFrame:
    """The available row of the smallest priority of each group: a fallback chain."""
    w = Window.partitionBy(by).orderBy(priority, tie)
    return rows.filter(available).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
