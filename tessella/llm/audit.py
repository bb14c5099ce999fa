"""Interactions of document filters: what each filter removes in each order of all of them.

A relational word pipeline: words are exploded, aggregated by (document, word) and then by document,
which gives totals and distinct words; the other flags are outer-joined. Every document then fails a
subset of the five filters, and 32 conditional counts for each part say all that any order of the
filters can do. The 120 orders are read off those counts, so documents are never filtered twice.
DataFrame functions only.

Texts are dealt by document once; both aggregations of words keep that dealing, so no exploded word is
shuffled. Equal texts meet by their SHA-256, smallest ids first within each task. The smallest ids of texts
that are very common, of which there are MOST_HOT at most, are broadcast, so that no text's copies meet in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

FILTERS = "ABCDE"
#: A: fewer words. B: so many distinct ones of a hundred. C: more capitals of a hundred code points. D: one of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
#: A text with more copies than this, or than the documents over MOST_HOT, is very common.
HOT, MOST_HOT = 1000, 10_000
SPACE = r"[\x20\x09-\x0D]+"
#: Each order's steps: its letters, the step, the filter's bit and the bits before it.
STEPS = [("".join(order), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:k])) for order in permutations(FILTERS) for k, f in enumerate(order)]
MASKS = range(1 << len(FILTERS))


def _word_counts(rows: DataFrame) -> DataFrame:
    """own_id, digest, all_words, all_distinct: of the rows of one id and text together; none without words."""
    words = rows.select("own_id", "digest", F.explode(F.split("text", SPACE)).alias("word")).filter("word != ''")
    by_word = words.groupBy("own_id", "digest", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy("own_id", "digest").agg(F.sum("n").alias("all_words"), F.count(F.lit(1)).alias("all_distinct"))


def _first_ids(flags: DataFrame, hot: int) -> DataFrame:
    """flags with first: the smallest id of the text, of texts that have several ids."""
    firsts = flags.groupBy(F.col("digest").alias("same")).agg(F.min("own_id").alias("least"), F.max("own_id").alias("most"), F.count(F.lit(1)).alias("held")).filter("least < most")
    firsts = materialize(firsts.drop("most"), "firsts")
    common, others = firsts.filter(F.col("held") > hot), firsts.filter(F.col("held") <= hot)
    common = common.select(F.col("same").alias("common"), F.col("least").alias("common_least"))
    met = flags.join(F.broadcast(common), F.col("digest") == F.col("common"), "left")
    # rows of common texts, which are done, are dealt by their ids
    key = F.when(F.col("common").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.coalesce(F.col("own_id").cast("string"), F.lit("")))))
    met = met.withColumn("key", key).join(others, F.col("key") == F.col("same"), "left")
    return met.withColumn("first", F.coalesce("common_least", "least"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hot: int = HOT) -> DataFrame:
    """own_id, part, mask, copies: the filters that each document fails, as bits, A the lowest. A
    row for each distinct (id, text, part), with the number of such rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("own_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"))
    capitals = F.regexp_count("text", F.lit("[A-Z]")) * 100 > MOST_CAPITALS * F.length("text")
    flagged = rows.select("own_id", "digest", "part", capitals.alias("c"), F.col("text").rlike(MARKS).alias("d"))
    flags = materialize(flagged.groupBy("own_id", "digest", "part", "c", "d").agg(F.count(F.lit(1)).alias("copies")), "flags")  # no texts
    # of the rows of one id and text, whatever their parts
    together = flags.groupBy(F.col("own_id").alias("id2"), F.col("digest").alias("digest2")).agg(F.sum("copies").alias("rows"))
    counted = _word_counts(rows.repartition("own_id", "digest"))
    counted = counted.join(together, F.col("own_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")))
    words = counted.select(F.col("own_id").alias("id3"), F.col("digest").alias("digest3"), F.expr("all_words div rows").alias("words"), F.col("all_distinct").alias("distinct"))
    least = max(hot, flags.count() // MOST_HOT)
    met = _first_ids(flags, least).join(words, F.col("own_id").eqNullSafe(F.col("id3")) & (F.col("digest") == F.col("digest3")), "left")
    n, unlike = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = [n < LEAST_WORDS, unlike * 100 < LEAST_DISTINCT * n, F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("own_id"), F.lit(False))]
    mask = sum((F.when(yes, 1 << k).otherwise(0) for k, yes in enumerate(fails)), F.lit(0))
    return met.select("own_id", "part", mask.alias("mask"), "copies")


def _sum(cells: str, field: str, test) -> Column:
    return F.aggregate(F.filter(cells, test), F.lit(0).cast("long"), lambda total, x: total + x[field])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hot: int = HOT) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley: 600 rows for each part, zeros included.

    Null texts count as empty, null parts as the part ''. Empty texts fail A, and E if another id
    that is smaller has one. A row of docs is a document: rows of one id count each, and don't make
    each other fail E. Rows of a null id are nobody's earlier copy and nobody's copy, and have no
    label. A document is good or toxic if any of its label rows says so; labels of null or unknown
    ids say nothing. Texts are read whole. Tables without rows give none. Other columns of docs and
    labels are not read, whatever their names.
    """
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = failures(docs, id_col, text_col, lang_col, hot).join(marked, F.col("own_id") == F.col("label_id"), "left")
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = met.groupBy("part").agg(*[F.sum(F.when((F.col("mask") == m) & yes, F.col("copies")).otherwise(0)).alias(f"{kind}_{m}") for m in MASKS for kind, yes in kinds.items()])
    cells = F.array(*[F.struct(F.lit(m).alias("mask"), *[F.col(f"{kind}_{m}").alias(kind) for kind in kinds]) for m in MASKS])
    steps = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for order, k, bit, before in STEPS])
    rows = counts.select("part", cells.alias("cells")).select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")
    own, before = F.col("bit"), F.col("before")
    here = lambda x: (x["mask"].bitwiseAND(own) != 0) & (x["mask"].bitwiseAND(before) == 0)
    # a filter is the first of the m filters that a document fails in 120 / m of the orders
    share = F.aggregate(F.filter("cells", lambda x: x["mask"].bitwiseAND(own) != 0), F.lit(0).cast("long"), lambda total, x: total + (F.lit(120) / F.bit_count(x["mask"])).cast("long") * x["n"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        _sum("cells", "n", lambda x: x["mask"].bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        _sum("cells", "n", here).alias("removed"),
        _sum("cells", "n", lambda x: (x["mask"].bitwiseAND(own) != 0) & (x["mask"].bitwiseAND(before) != 0)).alias("redundant"),
        _sum("cells", "n", lambda x: x["mask"] == own).alias("unique_fails"),
        _sum("cells", "good", here).alias("good_lost"),
        _sum("cells", "toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


#: Applies the filters in each order as said, and sums what each removes over all of them.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT rid, doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS e4, coalesce(first < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * e4::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(k, bit)),
o AS (SELECT p.k || q.k || r.k || s.k || u.k AS filter_order FROM x p, x q, x r, x s, x u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
st AS (SELECT filter_order, step, x.bit, coalesce((SELECT sum(y.bit) FROM x y WHERE contains(substr(filter_order, 1, step - 1), y.k)), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) g JOIN x ON x.k = substr(filter_order, step, 1)),
r AS (SELECT p.part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM (SELECT DISTINCT part FROM n) p CROSS JOIN st JOIN n ON n.part = p.part GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
