"""Versions, content hashes, overrides and stage graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """sha256 of the JSON of the named columns in sorted order. Leave out what changes between
    equal results (times, run ids): it would make every write a new version."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def versions(writes: DataFrame, key: list[str], order: list[str], sha: str) -> DataFrame:
    """Collapses writes into versions: a new one only where the hash differs from the last write's.
    Per version: sha, first and last order value, how often it was seen."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.coalesce((F.col(sha) != F.lag(sha).over(w)).cast("int"), F.lit(1))
    numbered = writes.withColumn("_new", changed).withColumn("version", F.sum("_new").over(w))
    return numbered.groupBy(*key, "version").agg(F.first(sha).alias("sha"), F.min(order[0]).alias("written_at"), F.max(order[0]).alias("last_seen_at"), F.count(F.lit(1)).alias("seen_count"))


def latest(versioned: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return versioned.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def required(wanted: DataFrame, present: DataFrame, key: str, stage: str) -> DataFrame:
    """key, missing, present: per key the stages of wanted(key, stage) that have no artifact, and
    the ones that have; only keys with something missing."""
    have = present.select(key, stage).distinct().withColumn("_have", F.lit(True))
    joined = wanted.join(have, [key, stage], "left")
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("_have").isNull(), F.col(stage)))).alias("missing"), F.array_sort(F.collect_set(F.when(F.col("_have"), F.col(stage)))).alias("present"))
    return grouped.filter(F.size("missing") > 0)


def merge_overrides(base: Column, patch: Column) -> Column:
    """Two-level merge of maps of maps: a patch's inner keys win, the others stay."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,map<string,string>>")), F.coalesce(patch, F.create_map().cast("map<string,map<string,string>>")), lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k2, x, y: F.coalesce(y, x))))


def clear_section(overrides: Column, section: str) -> Column:
    return F.map_filter(overrides, lambda k, v: k != section)


def apply_patches(base: DataFrame, patches: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """base with the last non-null patch of each column; keys that only patches have appear too.
    patches: key, order and some of the columns. Adds patched."""
    folded = patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    joined = base.join(folded, key, "full")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], F.coalesce("_hit", F.lit(False)).alias("patched"))


def blocked_stages(outcomes: DataFrame, stages: Sequence[str], needs: Sequence[tuple[str, str]]) -> DataFrame:
    """run, stage, effective: outcomes(run, stage, status) after blocking spreads along needs
    (stage, what it needs): what depends on a failed or skipped stage is skipped.

    What a stage depends on, over any number of steps, is known before any run is seen, so a run's
    outcomes meet in one row and no step repeats over the data. stages: all of them, any order. A
    stage that isn't among them, or whose run or status is null, blocks nothing and is itself kept.
    """
    above = {s: {n for stage, n in needs if stage == s} for s in stages}
    for _ in stages:
        above = {s: direct.union(*[above.get(n, set()) for n in direct]) for s, direct in above.items()}
    bad = F.collect_set(F.when(F.col("status").isin("failed", "skipped"), F.col("stage"))).alias("bad")
    depends = F.create_map(*[x for s in stages for x in (F.lit(s), F.array(*map(F.lit, sorted(above[s]))).cast("array<string>"))])
    per = outcomes.groupBy("run").agg(bad, F.collect_list(F.struct("stage", "status")).alias("all")).select("run", "bad", F.explode("all").alias("o")).select("run", "bad", "o.stage", "o.status")
    blocked = F.coalesce(F.arrays_overlap("bad", F.try_element_at(depends, F.col("stage"))), F.lit(False))
    effective = F.when(F.col("status") == "failed", "failed").when(blocked | (F.col("status") == "skipped"), "skipped").otherwise(F.col("status"))
    return per.select("run", "stage", effective.alias("effective"))


def earliest_stage(changed: DataFrame, key: str, stage: str, order: DataFrame) -> DataFrame:
    """The first stage, by order(stage, place), that a key's changes touch."""
    joined = changed.join(F.broadcast(order), stage)
    return joined.groupBy(key).agg(F.min_by(stage, "place").alias("from_stage"), F.min("place").alias("place"))
