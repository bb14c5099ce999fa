"""Exact quantiles of groups of any size, without gathering a group in one task.

Fixed-size sketches bracket each wanted rank, an exact count says how many values lie below the
bracket, and only the bracket's own values, some thousandths of a large group, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

#: Rows of a table that goes to every task.
FEW = 10_000


def few(groups: DataFrame) -> DataFrame:
    """A table of groups, written once, and broadcast if it is counted to be small: joined otherwise, all rows of a hot group
    would be read by one task."""
    groups = materialize(groups, "groups")
    return F.broadcast(groups) if groups.count() <= FEW else groups


#: Groups of up to so many values are ordered whole; half width of a bracket; sketch accuracy.
SMALL, HALF, ACCURACY = 20_000, 0.001, 10_000


def between(lo: Column, hi: Column, share: Column) -> Column:
    """lo * (1 - share) + hi * share, rounded once less, by a fused multiply-add, as SQL's quantile_cont does. Where
    the two are apart by their last bits, it is one of them, and what equals it falls on the same side as in SQL."""
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), lo, 1 - share, hi * share).cast("double")
    return F.when(lo.isNull() | (share == 0), lo).otherwise(fused)


def quantile_of(values: Column, q: float) -> Column:
    """The same quantile of an array of sorted doubles; null for none."""
    at = F.lit(float(q)) * (F.size(values) - 1)
    return between(F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int")), at - F.floor(at))


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """by and a double per name in wanted: the value at q * (n - 1) of the sorted non-null values,
    interpolated, or with nearest the one at that rank rounded half to even. Groups without
    values are left out. The sketch's rank error (n / 10,000) is a tenth of a bracket's half."""
    names, v = list(wanted), F.col("v")
    kept = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    fractions = [f for q in wanted.values() for f in (max(0.0, q - HALF), min(1.0, q + HALF))]
    sketch = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [float(f) for f in fractions], ACCURACY).alias("b"))
    big = F.col("n") > SMALL
    brackets = sketch.select(*by, "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(big, F.col("b")[2 * i]).alias("lo"), F.when(big, F.col("b")[2 * i + 1]).alias("hi"), (F.lit(float(q)) * (F.col("n") - 1)).alias("pos"))
        for i, q in enumerate(wanted.values())
    ])).alias("t")).select(*by, "t.*")
    met = kept.join(few(brackets), by)
    low = F.col("lo").isNotNull() & (v < F.col("lo"))
    # one row per value and bracket; all below a bracket make one row (v null), summed per task first
    counted = met.filter(F.col("hi").isNull() | (v <= F.col("hi"))).groupBy(*by, "i", "pos", F.when(~low, v).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("end", F.sum("c").over(order)).filter("v is not null")
    k0 = F.bround("pos") if nearest else F.floor("pos")
    k1 = k0 if nearest else F.ceil("pos")
    at = lambda k: F.min(F.when((F.col("end") > k), v))
    found = ranked.groupBy(*by, "i", "pos").agg(at(k0).alias("a"), at(k1).alias("z"))
    exact = between(F.col("a"), F.col("z"), F.col("pos") - F.floor("pos")) if not nearest else F.col("a")
    return found.select(*by, "i", exact.alias("exact")).groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("exact"))).alias(name) for i, name in enumerate(names)])


def quantiles_in_rows(rows: DataFrame, by: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """quantiles of groups most of which are small: those are ordered in a row each, and only counted large ones are bracketed."""
    kept = rows.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    large = few(kept.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select(by))
    ordered = lambda df: df.groupBy(by).agg(F.sort_array(F.collect_list("_v")).alias("_v")).select(by, *[quantile_of(F.col("_v"), q).alias(name) for name, q in wanted.items()])
    if large.isEmpty():
        return ordered(kept)
    return ordered(kept.join(large, by, "left_anti")).unionByName(quantiles(kept.join(large, by, "left_semi"), [by], "_v", wanted))
