"""Deterministic sampling: keyed-hash splits, apportionment, quotas, interleaving and seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_hash(key: str, id_col: str) -> Column:
    """sha256 of "key:id", which orders a stratum the same on every run."""
    return F.sha2(F.concat(F.lit(f"{key}:"), F.col(id_col).cast("string")), 256)


def apportion(counts: DataFrame, n: int, by: str = "stratum", size: str = "size") -> DataFrame:
    """Largest-remainder shares of n over strata: by, size, quota. Ties go to the smaller name.

    counts has a row per stratum, so the windows without a partition hold few rows.
    """
    whole = Window.partitionBy()
    exact = F.col(size) * F.lit(n) / F.sum(size).over(whole)
    shares = counts.withColumn("base", F.floor(exact).cast("long")).withColumn("fraction", exact - F.floor(exact))
    rank = F.row_number().over(Window.orderBy(F.desc("fraction"), F.col(by)))
    left = F.lit(n) - F.sum("base").over(whole)
    return shares.withColumn("quota", F.col("base") + F.when(rank <= left, 1).otherwise(0)).select(by, size, "quota")


def stratified_split(rows: DataFrame, id_col: str, stratum: Column, n: int, key: str) -> DataFrame:
    """id, stratum, position, held_out: each stratum holds out the first of its quota by keyed hash.

    Positions have two levels, so no stratum is ordered in one task: rows fall into buckets by the
    first digits of the hash, and a bucket's rows follow all those of the buckets before it.
    """
    named = rows.select(F.col(id_col).alias("id"), stratum.alias("stratum"), keyed_hash(key, id_col).alias("_hash")).withColumn("_bucket", F.substring("_hash", 1, 3))
    sizes = named.groupBy("stratum", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    quotas = apportion(sizes.groupBy("stratum").agg(F.sum("n").alias("size")), n)
    earlier = Window.partitionBy("stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("stratum", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(quotas.select("stratum", "quota"), "stratum")
    place = F.row_number().over(Window.partitionBy("stratum", "_bucket").orderBy("_hash", "id"))
    ranked = named.withColumn("_place", place).join(starts, ["stratum", "_bucket"])
    position = (F.col("before") + F.col("_place")).cast("long")
    return ranked.select("id", "stratum", position.alias("position"), (position <= F.col("quota")).alias("held_out"))


def seal(rows: DataFrame, id_col: str, groups: list[str]) -> DataFrame:
    """Per group: n and the sha256 of its sorted ids, joined by commas. Ids gather per group, so
    seal what a quota bounds, such as the held-out side of a split, and not tables."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col(id_col).cast("string"))), ",")
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sha2(ids, 256).alias("seal"))


def interleave(rows: DataFrame, stratum: str, order: list[Column], id_col: str) -> DataFrame:
    """Round robin over strata: each row's turn in its stratum; sort by (turn, stratum)."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order, F.col(id_col))).cast("long"))


def quota_select(candidates: DataFrame, in_first: Column, target: int, share: float, order: list[str]) -> DataFrame:
    """The target rows picked from two pools: ceil(target * share) from the first, the rest from the
    second, and either pool fills up what the other lacks. Adds pool and place.

    A pool gives its first `target` rows at most, which each task finds among its own, so what is
    ordered in one place is twice the target, whatever the pools' sizes.
    """
    first = F.coalesce(in_first, F.lit(False))
    tops = [candidates.filter(chosen).withColumn("pool", F.lit(pool)).orderBy(*order).limit(target) for pool, chosen in ((1, first), (2, ~first))]
    top = tops[0].unionByName(tops[1])
    ranked = top.withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy(*order)))
    held = lambda pool: F.count_if(F.col("pool") == pool).over(Window.partitionBy())  # noqa: E731  over twice the target
    take = F.least(held(1), F.greatest(F.ceil(F.lit(target * share)), F.lit(target) - held(2)))
    limited = ranked.withColumn("_take", take)
    return limited.filter(F.col("place") <= F.when(F.col("pool") == 1, F.col("_take")).otherwise(F.lit(target) - F.col("_take"))).drop("_take")


def hash_fraction(id_col: str) -> Column:
    """First eight hex digits of the id's sha256, mod 1000, over 1000: a stateless coin per id."""
    digits = F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % 1000) / 1000.0
