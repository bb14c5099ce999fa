"""Listing sets, versioned artifacts, run ledgers, metric history and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "kind", "caption", "local_path")]))
LISTING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("listing_id", "source", "url", "provenance", "display_address", "outcode", "country", "property_subtype", "transaction_type", "tenure", "description", "agent", "fetched_at", "floor_area_source")]
    + [T.StructField(n, T.IntegerType()) for n in ("bedrooms", "bathrooms", "price_gbp")]
    + [T.StructField("floor_area_sqm", T.DoubleType()), T.StructField("photos", MEDIA), T.StructField("floorplans", MEDIA), T.StructField("key_features", T.ArrayType(T.StringType()))]
)
STAGE = T.StructType([T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("budget_s", T.DoubleType()), T.StructField("over_budget", T.BooleanType()), T.StructField("qa_flags", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
RUN = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "listing_id", "profile", "started_at", "finished_at", "from_stage", "status")] + [T.StructField("stages", T.ArrayType(STAGE)), T.StructField("total_seconds", T.DoubleType()), T.StructField("qa_flags", T.ArrayType(T.StringType()))])
ARTIFACT = "listing_id string, stage string, version bigint, sha256 string, written_at string, last_seen_at string, seen_count bigint, run_id string, payload string"


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of JSON documents {listings: [...]}, a row each, with has_floorplan and n_photos.
    What doesn't fit the schema is null; unknown fields are ignored."""
    documents = spark.read.schema(T.StructType([T.StructField("listings", T.ArrayType(LISTING))])).json(path, multiLine=True)
    rows = documents.select(F.explode("listings").alias("l")).select("l.*")
    return rows.withColumn("has_floorplan", F.coalesce(F.size("floorplans"), F.lit(0)) > 0).withColumn("n_photos", F.greatest(F.lit(0), F.coalesce(F.size("photos"), F.lit(0))))


def media(listings: DataFrame) -> DataFrame:
    """listing_id, kind, position, url of all pictures; positions are the original ones, gaps kept."""
    one = lambda c, kind: listings.select("listing_id", F.lit(kind).alias("kind"), F.posexplode(c).alias("position", "m")).select("listing_id", "kind", "position", "m.url")
    return one("photos", "photo").unionByName(one("floorplans", "floorplan"))


def canonical(payload: str) -> F.Column:
    return F.sha2(F.col(payload), 256)


def append_artifacts(store: DataFrame, writes: DataFrame) -> DataFrame:
    """The store after writes (listing_id, stage, run_id, at, payload): a new version where the
    payload's hash differs from the key's last one, else the last version is seen again. Writes of
    one key apply in order of (at, run_id)."""
    key = ["listing_id", "stage"]
    last = store.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("version")))).filter("k = 1").select(*key, F.col("version").alias("v0"), F.col("sha256").alias("sha0"))
    w = Window.partitionBy(*key).orderBy("at", "run_id")
    new = writes.withColumn("sha256", canonical("payload")).join(last, key, "left")
    before = F.coalesce(F.lag("sha256").over(w), F.col("sha0"))
    new = new.withColumn("step", F.when(before.isNull() | (before != F.col("sha256")), 1).otherwise(0))
    new = new.withColumn("version", F.coalesce("v0", F.lit(0)) + F.sum("step").over(w))
    grouped = new.groupBy(*key, "version").agg(F.min_by("sha256", "at").alias("sha256"), F.min("at").alias("written_at"), F.max("at").alias("last_seen_at"), F.count(F.lit(1)).alias("seen_count"), F.min_by("run_id", "at").alias("run_id"), F.min_by("payload", "at").alias("payload"))
    every = store.unionByName(grouped)
    return every.groupBy(*key, "version").agg(F.min_by("sha256", "written_at").alias("sha256"), F.min("written_at").alias("written_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("seen_count").alias("seen_count"), F.min_by("run_id", "written_at").alias("run_id"), F.min_by("payload", "written_at").alias("payload"))


def read_artifact(store: DataFrame, stage: str, version: int | None = None) -> DataFrame:
    """A stage's artifacts: the latest of each listing, or a given version."""
    rows = store.filter(F.col("stage") == stage)
    if version is not None:
        return rows.filter(F.col("version") == version)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("listing_id").orderBy(F.desc("version")))).filter("k = 1").drop("k")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """sha256, path, length of binary files, one row for each content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", "length").groupBy("sha256").agg(F.min("path").alias("path"), F.first("length").alias("length"))


def put_blobs(files: DataFrame, store: str, content: str = "content") -> None:
    """Adds contents to a content-addressed store: a row (sha256, content) for each that isn't there
    yet, in folders by the hash's first two digits, so a look-up reads one. Null contents are left
    out. The store's hashes alone are read to tell what is new."""
    spark = files.sparkSession
    new = files.filter(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    new.withColumn("head", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("head").parquet(store)


def present_stages(store: DataFrame) -> DataFrame:
    """listing_id, stages (sorted), versions: what each listing of a store has."""
    return store.groupBy("listing_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"), F.count(F.lit(1)).alias("versions"))


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def stage_facts(runs: DataFrame) -> DataFrame:
    """A row per run and stage."""
    return runs.select("run_id", "listing_id", "started_at", F.posexplode("stages").alias("place", "s")).select("run_id", "listing_id", "started_at", "place", "s.*")


def latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("listing_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, split: str | None = None, channel: str | None = None) -> DataFrame:
    rows = spark.read.schema("at string, split string, channel string, complete int, metrics map<string,double>, g1 map<string,double>").json(path)
    for column, value in (("split", split), ("channel", channel)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """listing_id, room, answers (array), is_absent of annotation files, whose answers are a string,
    a list or null."""
    raw = spark.read.schema("listing_id string, assignment map<string,string>").json(path, multiLine=True)
    rows = raw.select("listing_id", F.explode("assignment").alias("room", "value"))
    many = F.from_json("value", "array<string>")
    answers = F.when(F.col("value").isNull(), F.array().cast("array<string>")).when(F.col("value").startswith("["), many).otherwise(F.array("value"))
    return rows.select("listing_id", "room", answers.alias("answers"), F.col("value").isNull().alias("is_absent"))


def annotation_match(truth: DataFrame, got: DataFrame, key: list[str], value: str) -> DataFrame:
    """truth with matched: an absent answer matches nothing found, else the found one must be among
    the answers."""
    hit = F.when(F.col("is_absent"), F.col(value).isNull()).otherwise(F.coalesce(F.array_contains("answers", F.col(value)), F.lit(False)))
    return truth.join(got, key, "left").withColumn("matched", hit)


def markdown(table: DataFrame, title: str, most: int = 1000) -> str:
    """A report table. Reports show aggregates: more than `most` rows are refused, not cut."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: over {most} rows are no report")
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
