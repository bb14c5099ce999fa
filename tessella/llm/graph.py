"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import discard, materialize


def _to_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step. edges are (u, v); every neighbour of u moves to the least of u and its
    neighbours: the larger neighbours (edges in both directions), or all and u itself (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(least, "u")
    if larger_only:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, component (the least node reached) of every node that has an edge to another, written.

    Alternating large-star and small-star steps; the table is written after each pair, and the
    loop ends when its number of rows and its checksum stay. Minima are summed per task before
    the shuffle, so a node with very many neighbours is no hot key. Loops and repeated edges are
    ignored. Nulls take no part. No edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, True).distinct()
        small = _to_minimum(large.filter("u <> v"), False).distinct()
        now, old = materialize(small, "edges"), now
        discard(old)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct()), "components")
    discard(now)
    return found


def united(found: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """found (node, component) after more edges between nodes, of which few are expected: only the
    components that they touch are gone through again."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = connected_components(named.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("final"))
    kept = found.join(to, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    return materialize(kept.unionByName(moved.join(found, "node", "left_anti").select("node", "component")), "components")
