"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source's documents are shuffled by a hash and replayed in epochs, in packets of a few words.
A packet's virtual finish time is the source's cumulative words up to its end, divided by the
source's target. The packets of all sources are range-sorted by finish time, a running sum over the
sorted partitions finds where the total budget ends, and what stands after it is truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

SEED = "mix-1"
#: What is a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most words of a packet: a source misses its target by less than one packet.
PACKET = 64
#: The order of the queue, over all sources.
ORDER = ("finish", "key", "tie", "source", "epoch", "packet")


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target of every source, by water-filling.

    sizes has a row per source: source, source_size. Sources in code-point order, null last, take
    the weights in turn. The targets sum to share times all sizes; none is above most times its
    source's size, and what is above goes to the others by weight. The table has a row per
    source, so its windows are over few rows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy()
    level = (F.sum("source_size").over(rest) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(rest) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = weighed.withColumn("level", level).withColumn("free", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
    # the first source that its cap doesn't stop sets the level for all later ones
    return found.withColumn("at", F.max("free").over(rest)).select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def shuffled(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **mix) -> DataFrame:
    """row, doc_id, source, size, source_size, target, start, key, tie: a row per document, with
    the words of its source that stand before it in the shuffled order, which is that of key and
    tie. Rows that agree in both are equal in id, source and text.

    The running sum has two levels, so that no source, however hot, is in one task: documents fall
    into buckets by the hash that shuffles them, each source and bucket sums its own, and the
    buckets' offsets come from the table of their sums.
    """
    text = F.col(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("no id "), F.coalesce(F.md5(text), F.lit("")))).alias("name")
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.md5(F.concat(name, F.lit(f":{seed}"))).alias("key"), F.xxhash64(text).alias("tie"))
    sized = materialize(read.withColumn("bucket", F.substring("key", 1, 3)).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # texts are read once
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bucket_size")
    goal = targets(by_source, **mix)
    placed = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    local = Window.partitionBy("source", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.withColumn("local", F.coalesce(F.sum("size").over(local), F.lit(0)))
    same = ranked["source"].eqNullSafe(placed["source"]) & (ranked["bucket"] == placed["bucket"])
    return ranked.join(placed, same).select("row", ranked["doc_id"], ranked["source"], "size", "source_size", "target", (F.col("local") + F.col("offset")).alias("start"), "key", "tie")


def queue(documents: DataFrame, epochs: int = 2, packet: int = PACKET) -> DataFrame:
    """The queue, written in the order of ORDER and range-partitioned by it: row, doc_id, source,
    epoch, packet, words, finish, part (its partition). documents: what shuffled gives.

    Packets that begin at time 1 or later are left out: those that end by then and those in service
    hold the whole budget.
    """
    served = documents.filter("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    served = served.withColumn("packet", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.lit(packet)).cast("int") - 1)))
    begun = F.col("start") + F.col("epoch") * F.col("source_size") + F.col("packet") * F.lit(packet)
    words = F.least(F.lit(packet).cast("long"), F.col("size") - F.col("packet") * F.lit(packet))
    timed = served.withColumn("begun", begun).withColumn("words", words).filter("begun < target").withColumn("finish", (F.col("begun") + F.col("words")) / F.col("target"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = timed.select("row", "doc_id", "source", "epoch", "packet", "words", "finish", "key", "tie").repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    return materialize(ranged.withColumn("part", F.spark_partition_id()), "mix-queue")


def truncated(queued: DataFrame, budget: int) -> DataFrame:
    """The packets within the budget, with take: their words, or what the budget leaves of the one
    at which it ends.

    The running sum has two levels: over the partitions, and within the one partition in which the
    budget ends.
    """
    sums = queued.groupBy("part").agg(F.sum("words").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row per partition: of a size that the session sets
    marked = queued.join(F.broadcast(sums), "part").filter(F.col("before") < budget)
    ends = F.col("before") + F.col("held")
    whole = marked.filter(ends <= budget).withColumn("take", F.col("words"))
    running = F.coalesce(F.sum("words").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = marked.filter(ends > budget).withColumn("take", F.least(F.col("words"), F.lit(budget) - F.col("before") - running))
    return whole.unionByName(last).filter("take > 0").drop("held", "before")


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, epochs: int, packet: int, seed: str, **mix) -> tuple[DataFrame, DataFrame]:
    documents = materialize(shuffled(docs, id_col, source_col, text_col, seed, **mix), "mix-documents")
    goals = documents.groupBy("source").agg(F.first("target").alias("target"))
    budget = goals.agg(F.round(F.round(F.sum("target"), 3)).cast("long")).first()[0] or 0
    return documents, truncated(queue(documents, epochs, packet), budget)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: int = 2, packet: int = PACKET, seed: str = SEED, **mix) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken.

    taken is the number of words that the mix takes of the document, over all epochs: those of its
    packets that stand in the queue before the budget ends. Null and empty texts have size 0 and
    give 0. A null source is a source of its own, the last. Rows that share a doc_id are separate
    documents, in the order of a hash of their texts; equal rows are interchangeable. Null ids are
    told apart by their texts. An empty table gives none. A source without words has target 0.
    Texts are counted whole. Other columns are not read, whatever their names.
    """
    documents, kept = _mixed(docs, id_col, source_col, text_col, epochs, packet, seed, **mix)
    taken = kept.groupBy("row").agg(F.sum("take").alias("taken"))
    joined = documents.join(taken, "row", "left")
    return joined.select("doc_id", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sequence(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: int = 2, packet: int = PACKET, seed: str = SEED, **mix) -> DataFrame:
    """The mix itself, in order: doc_id, source, epoch, packet, finish, take, part. Sorted by virtual
    finish time and truncated at the total budget; part numbers the sorted partitions."""
    _, kept = _mixed(docs, id_col, source_col, text_col, epochs, packet, seed, **mix)
    return kept.orderBy("part", *ORDER).select("doc_id", "source", "epoch", "packet", "finish", "take", "part")


#: The same rows as mix_sources over documents, for DuckDB.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'no id ' || coalesce(md5(text), '')) || ':mix-1') AS key, row_number() OVER () AS row FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM sums),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
  FROM weighed WINDOW r AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, cap, weight, max(CASE WHEN cap >= level * weight THEN level END) OVER () AS lvl FROM leveled),
target AS (SELECT source, source_size, least(cap, coalesce(lvl * weight, cap)) AS target FROM goal),
queued AS (
  SELECT s.row, s.doc_id, s.key, s.size, t.source_size, t.target, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
epoch AS (SELECT *, unnest([0, 1]) AS epoch FROM queued WHERE size > 0 AND target > 0),
packet AS (SELECT *, unnest(range((size + 63) // 64)) AS packet FROM epoch),
timed AS (SELECT row, key, epoch, packet, target, start + epoch * source_size + packet * 64 AS begun, least(64, size - packet * 64) AS words FROM packet),
summed AS (
  SELECT row, words, sum(words) OVER (ORDER BY (begun + words) / target, key, epoch, packet ROWS UNBOUNDED PRECEDING) - words AS before FROM timed WHERE begun < target),
budget AS (SELECT CAST(round(round(sum(target), 3)) AS BIGINT) AS budget FROM target),
took AS (SELECT row, sum(least(words, budget - before)) AS taken FROM summed, budget WHERE before < budget GROUP BY row)
SELECT q.doc_id, q.size, q.source_size, CAST(q.target AS DOUBLE) AS target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN took t ON q.row = t.row
"""
