"""Structured Streaming forms: counters, latency windows, versions, first-seen and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as a stream, with ts as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def running_coverage(events: DataFrame) -> DataFrame:
    """Counters per type; for complete or update mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("value") > 50).alias("large"), F.sum("value").alias("total"))


def latency_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows per type behind a watermark; for append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_s"), F.max("value").alias("max_s")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_s", "max_s")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen before, as far back as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a user's events."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


class Versions(StatefulProcessor):
    """Emits a row where a key's value differs from its last one, with the number of the change. A key whose state hasn't been
    changed for as long as it lives is forgotten, and begins again at 1: so state follows the keys that are active, not all there ever were."""

    def __init__(self, lives_ms: int):
        self.lives_ms = lives_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string, version long", self.lives_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, version = self.last.get() if self.last.exists() else (None, 0)
        before, out = version, []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            if r.event_type != value:
                value, version = r.event_type, version + 1
                out.append((key[0], version, value, r.event_id))
        if version != before:
            self.last.update((value, version))
        yield pd.DataFrame(out, columns=["user_id", "version", "event_type", "event_id"])

    def close(self) -> None:
        pass


#: Where state with a time to live is kept; a stream's session needs it.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def version_stream(events: DataFrame, lives_ms: int = 30 * 86_400_000) -> DataFrame:
    """The versions of each user's last event type, by state that a restart restores. Sets the state store of the
    session. State lives for so many milliseconds of the wall clock, 30 days by default, after its last change."""
    for key, value in STATE_STORE.items():
        events.sparkSession.conf.set(key, value)
    return events.groupBy("user_id").transformWithStateInPandas(Versions(lives_ms), "user_id long, version long, event_type string, event_id long", "Append", "ProcessingTime")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True) -> None:
    """Runs a stream over what is there into Parquet files, then ends. Without empty batches there is none after the last
    data, which closes windows, but which a stream on the wall clock would ask for again and again."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(empty_batches).lower())
    try:
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, before)


def drain_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> None:
    """The same into a named in-memory table: for small aggregates only."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
