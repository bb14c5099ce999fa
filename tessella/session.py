"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessella").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine
    (a local master, as in tests) a temporary folder takes its place where it is unset; on a cluster
    there is no such folder, and leaving it unset is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'tessella-shared')}"
    return folder.rstrip("/")


def small_arrow_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch on its way to Python, unless the session has a bound of
    its own. Rows that hold whole texts would otherwise fill batches of tens of megabytes, whose
    buffers stay with the executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


_WRITTEN: dict[str, SparkSession] = {}


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: its lineage is cut, and
    no lost executor takes it away. Use where a plan branches or a loop iterates."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.tessella_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for these tables, which must be needed no more."""
    for path in (getattr(t, "tessella_path", None) for t in tables):
        if path and (spark := _WRITTEN.pop(path, None)):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that materialize wrote in this process: call it when the results that
    were built on them are written."""
    for path in [p for p, s in _WRITTEN.items() if s is spark]:
        del _WRITTEN[path]
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
