"""Sampling queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import sampling as op
from tessella.sources.tables import table

KEY = "tessella-holdout-1"
#: Account-balance bands, the stand-in for price bands: one table for all uses.
BANDS = ((0.0, "a:<0"), (2500.0, "b:<2500"), (5000.0, "c:<5000"), (7500.0, "d:<7500"))


def _band(value):
    out = F.lit("e:top")
    for top, name in reversed(BANDS):
        out = F.when(value < top, F.lit(name)).otherwise(out)
    return out


_BAND_SQL = "CASE " + " ".join(f"WHEN c_acctbal < {top} THEN '{name}'" for top, name in BANDS) + " ELSE 'e:top' END"


def _split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    stratum = F.concat_ws("/", "c_mktsegment", _band(F.col("c_acctbal")))
    return op.stratified_split(c, "c_custkey", stratum, 50, KEY)


def stratified_holdout(spark, d):
    return _split(spark, d).select(F.col("id").alias("c_custkey"), "stratum", "position", "held_out")


def holdout_seal(spark, d):
    """The seal of what each stratum holds out."""
    return op.seal(_split(spark, d).filter("held_out"), "id", ["stratum"]).select("stratum", "n", "seal")


def holdout_strata(spark, d):
    """Sizes of each stratum and what it holds out."""
    return _split(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("total"), F.count_if("held_out").alias("holdout"))


def stratified_interleave(spark, d):
    """Suppliers nation by nation in turn, the richest first, with the global place of each."""
    s = table(spark, d, "supplier").dropDuplicates(["s_suppkey"])
    turned = op.interleave(s, "s_nationkey", [F.desc("s_acctbal")], "s_suppkey")
    return turned.select("s_suppkey", "s_nationkey", "turn")


def quota_selection(spark, d):
    """60 customers, 70 % of them with a positive balance and orders, backfilled."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    joined = c.join(o, "c_custkey", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    picked = op.quota_select(joined, F.col("active") & (F.col("c_acctbal") > 9500), 60, 0.7, ["c_custkey"])
    return picked.select("c_custkey", F.col("pool").cast("long"), F.col("place").cast("long"))


def bernoulli_split(spark, d):
    e = table(spark, d, "events").select("event_id", op.hash_fraction("event_id").alias("u"))
    return e.filter(F.col("u") < 0.1).select("event_id", "u")


def keyed_dedup(spark, d):
    """First event of each user and type, by time and id."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_type", "event_id")


_SPLIT_SQL = f"""
named AS (SELECT c_custkey AS id, c_mktsegment || '/' || {_BAND_SQL} AS stratum FROM customer),
sizes AS (SELECT stratum, count(*) AS size FROM named GROUP BY stratum),
shares AS (SELECT stratum, size, CAST(floor(size * 50 / (SUM(size) OVER ())) AS BIGINT) AS base, size * 50 / (SUM(size) OVER ()) - floor(size * 50 / (SUM(size) OVER ())) AS fraction FROM sizes),
quotas AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY fraction DESC, stratum) <= 50 - SUM(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
ranked AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{KEY}:' || CAST(id AS VARCHAR)), id) AS position FROM named),
split AS (SELECT r.id, r.stratum, r.position, r.position <= q.quota AS held_out FROM ranked r JOIN quotas q ON r.stratum = q.stratum)"""

QUERIES = {f.__name__: f for f in (stratified_holdout, holdout_seal, holdout_strata, stratified_interleave, quota_selection, bernoulli_split, keyed_dedup)}
ORACLES = {
    "stratified_holdout": f"WITH {_SPLIT_SQL} SELECT id AS c_custkey, stratum, position, held_out FROM split",
    "holdout_seal": f"WITH {_SPLIT_SQL} SELECT stratum, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))) AS seal FROM split WHERE held_out GROUP BY stratum",
    "holdout_strata": f"WITH {_SPLIT_SQL} SELECT stratum, count(*) AS total, count(*) FILTER (held_out) AS holdout FROM split GROUP BY stratum",
    "stratified_interleave": "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier",
    "quota_selection": """
WITH j AS (SELECT c_custkey, c_acctbal, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS active FROM customer),
p AS (SELECT c_custkey, CASE WHEN active AND c_acctbal > 9500 THEN 1 ELSE 2 END AS pool FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY c_custkey) AS place FROM p),
n AS (SELECT count(*) FILTER (pool = 1) AS n1, count(*) FILTER (pool = 2) AS n2 FROM p),
t AS (SELECT n2, least(n1, greatest(42, 60 - n2)) AS take1 FROM n),
l AS (SELECT take1, least(n2, 60 - take1) AS take2 FROM t)
SELECT c_custkey, CAST(pool AS BIGINT) AS pool, place FROM r, l WHERE place <= CASE pool WHEN 1 THEN take1 ELSE take2 END""",
    "bernoulli_split": "SELECT event_id, u FROM (SELECT event_id, (CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000) / 1000.0::DOUBLE AS u FROM events) WHERE u < 0.1",
    "keyed_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
}
