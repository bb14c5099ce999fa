"""Streaming queries: each drains the events table as a stream and returns what came out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.sources.tables import table
from tessella.session import shared_folder
from tessella.streaming import events as st


def _source(spark, d):
    """A folder that holds the events alone: a stream reads folders."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    return folder


def _drained(spark, d, make, mode="append", **more):
    folder = _source(spark, d)
    stream = make(st.event_stream(spark, f"{folder}/in", 100))
    st.drain(stream, f"{folder}/out", f"{folder}/state", mode, **more)
    return spark.read.parquet(f"{folder}/out")


def stream_coverage(spark, d):
    name = f"coverage_{uuid.uuid4().hex}"
    st.drain_to_memory(st.running_coverage(st.event_stream(spark, f"{_source(spark, d)}/in")), name)
    return spark.table(name).select("event_type", "seen", "large", F.round("total", 2).alias("total"))


def stream_latency(spark, d):
    """Windows that the watermark has closed: all but the last hour's."""
    out = _drained(spark, d, lambda e: st.latency_windows(e, "1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean_s", 9).alias("mean_s"), "max_s")


def stream_first_seen(spark, d):
    out = _drained(spark, d, lambda e: st.first_seen(e, ["event_id"]))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_versions(spark, d):
    return _drained(spark, d, st.version_stream, empty_batches=False)


def session_bursts(spark, d):
    """Sessions of each user in batch form; tests compare the streamed ones."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.round(F.max("total"), 2).alias("largest"))


QUERIES = {f.__name__: f for f in (stream_coverage, stream_latency, stream_first_seen, stream_versions, session_bursts)}
ORACLES = {
    "stream_coverage": "SELECT event_type, count(*) AS seen, count(*) FILTER (value > 50) AS large, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "stream_latency": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 9) AS mean_s, max(value) AS max_s FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""",
    "stream_first_seen": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_versions": """
WITH c AS (SELECT user_id, event_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_type, event_id FROM c WHERE new""",
    "session_bursts": """
WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM events),
s AS (SELECT user_id, value, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), t AS (SELECT user_id, k, count(*) AS n, sum(value) AS total FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest, round(max(total), 2) AS largest FROM t GROUP BY 1""",
}
