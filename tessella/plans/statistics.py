"""Statistics queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import statistics as op
from tessella.plans.quality import STAGES
from tessella.operators.quantiles import quantiles
from tessella.sources.tables import table

R = 4


def _round(df, *cols, places=R):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), places))
    return df


def coverage_stats(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "n_chars"), table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled"))
    joined = docs.join(labels, "doc_id", "left")
    out = op.coverage(joined, "source", F.coalesce("labelled", F.lit(False)), F.col("n_chars"))
    return _round(out, "median_amount", "property_rate")


def latency_report(spark, d):
    """Line items as stages of orders: returned ones failed, open ones came from the cache."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    name = F.element_at(F.array(*map(F.lit, STAGES)), F.col("l_linenumber").cast("int"))
    stages = l.select(name.alias("stage"), F.col("l_quantity").alias("seconds"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "cached").otherwise("ok").alias("status"))
    runs = o.select((F.col("o_totalprice") / 1000).alias("total"), (F.col("o_orderstatus") != "P").alias("full"))
    return _round(op.latency_report(stages, runs, "stage", "seconds", "status", "total", "full"), "mean_s")


def metric_rollup(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("v"))
    return _round(op.rollup(rows, ["l_returnflag", "l_linestatus"], "v"), "coverage", "median", "mean", "p10", "p90", "min", "max", places=2)


def status_pivot(spark, d):
    return op.status_pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).withColumnsRenamed({"F": "n_f", "O": "n_o", "P": "n_p"})


def label_confusion(spark, d):
    """Document quality against a simple rule on the text: few symbols and some length."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rule = (F.length("text") > 100) & (F.length(F.regexp_replace("text", "[^|#$%&*!]", "")) * 20 < F.length("text"))
    rows = docs.join(labels, "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), rule.alias("said"))
    return _round(op.confusion(rows, F.col("truth"), F.col("said"), ["lang"]), "precision", "recall", "f1", "accuracy")


def label_distribution(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def fraction_with_feature(spark, d):
    """Share of documents with a digit, over all and over the long ones, and the ratio of sums."""
    docs = table(spark, d, "documents").select("lang", "n_chars", F.col("text").rlike("[0-9]").alias("has"))
    long_ = F.col("n_chars") >= 2000
    return _round(docs.groupBy("lang").agg(F.avg(F.col("has").cast("double")).alias("share"), F.avg(F.when(long_, F.col("has").cast("double"))).alias("share_long"), (F.sum(F.when(F.col("has"), F.col("n_chars")).otherwise(0)) / F.greatest(F.lit(1), F.sum("n_chars"))).alias("share_of_chars")), "share", "share_long", "share_of_chars")


def three_valued_gate(spark, d):
    """Quality as a pass (null where unlabelled), by source."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "n_chars"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left").select("source", (F.col("quality") == 1).alias("passed"), "n_chars")
    return _round(op.gate_summary(rows, "source", "passed", "n_chars"), "pass_rate", "median_value")


def regression_alerts(spark, d):
    """Daily medians of each event type against their own history; errors are better low."""
    e = table(spark, d, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.median("value"), 6).alias("v"))
    out = op.regressions(daily, "event_type", "day", "v", F.col("event_type") == "error", F.lit(2.0))
    return _round(out.select("event_type", F.col("day").cast("string").alias("day"), F.col("v").alias("current"), "previous", "points", "drop_by", "threshold", "alert", "rule"), "drop_by", "threshold", "current", "previous")


def histogram_layers(spark, d):
    """Price bins per return flag, and the outermost dense ones."""
    hist = op.histogram(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 40)
    return op.dense_span(hist, "l_returnflag")


def histogram_bins(spark, d):
    return op.smoothed(op.histogram(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 40), "l_returnflag", 2)


def two_layer_score(spark, d):
    hist = op.histogram(table(spark, d, "events"), "event_type", "value", 30)
    return _round(op.two_layers(hist, "event_type", 4).select("event_type", "bin1", "around1", "bin2", "around2", "total", "score"), "score")


def wall_coverage_grid(spark, d):
    """Cells of hour and user bucket with at least two events."""
    e = table(spark, d, "events")
    cells = e.groupBy(F.hour("ts").cast("long").alias("hour"), F.floor(F.col("user_id") / 10).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return cells.filter("n >= 2")


def estimate_disagreement(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return _round(op.spread_of_estimates(rows, "l_partkey", "unit"), "disagreement_pct", places=2)


def parameter_sweep(spark, d):
    """Per discount step: percentiles of tax and the share in a range."""
    l = table(spark, d, "lineitem")
    plain = l.groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_tax").between(0.02, 0.05)).cast("double")).alias("in_range"))
    return _round(plain.join(quantiles(l, ["l_discount"], "l_extendedprice", {"q1": 0.25, "q3": 0.75}), "l_discount", "left").select("l_discount", "n", "q1", "q3", "in_range"), "q1", "q3", "in_range", places=2)


def score_ladder(spark, d):
    """Part types by median price: change to the first and to the best so far, and new bests."""
    from pyspark.sql import Window

    p = table(spark, d, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 9).alias("score"))
    w = Window.orderBy("p_size")  # one row per size, of which there are 50
    best = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return _round(p.select("p_size", "score", (F.col("score") - F.first("score").over(w)).alias("to_base"), (F.col("score") - best).alias("to_best"), F.coalesce(F.col("score") > best + 0.005, F.lit(True)).alias("new_best")), "to_base", "to_best", places=7)


def split_metric_rollup(spark, d):
    """Rollup over priority and status: an extension of the metric rollup."""
    o = table(spark, d, "orders")
    return _round(o.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("level")), "total", places=2)


def success_accounting(spark, d):
    """Rows, errors and median over successes, per user."""
    e = table(spark, d, "events")
    ok = F.col("event_type") != "error"
    return _round(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), F.median(F.when(ok, F.col("value"))).alias("median_ok")), "median_ok")


def flat_detector(spark, d):
    """Parts whose shipped quantities vary by less than a quarter of their prices' variation."""
    l = table(spark, d, "lineitem")
    v = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("l_quantity") / F.avg("l_quantity")).alias("a"), (F.stddev_samp("l_extendedprice") / F.avg("l_extendedprice")).alias("b"))
    return _round(v.filter("n >= 3").select("l_partkey", "a", "b", (F.col("a") < 0.25 * F.col("b")).alias("flat")), "a", "b")


def global_overlap(spark, d):
    """Ratio of summed overlaps to summed unions of shipped and returned parts, by supplier."""
    l = table(spark, d, "lineitem")
    cells = l.groupBy("l_suppkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("f"))
    return _round(cells.groupBy("l_suppkey").agg((F.sum(((F.col("r") == 1) & (F.col("f") == 1)).cast("int")) / F.greatest(F.sum(((F.col("r") == 1) | (F.col("f") == 1)).cast("int")), F.lit(1))).alias("iou")), "iou")


_HIST = """
rng AS (SELECT {by}, quantile_cont(CAST({v} AS DOUBLE), 0.02) AS lo, quantile_cont(CAST({v} AS DOUBLE), 0.98) AS hi FROM {t} GROUP BY {by}),
hist AS (SELECT t.{by}, CAST(least({bins} - 1, floor(({v} - lo) / nullif(hi - lo, 0) * {bins})) AS BIGINT) AS bin, count(*) AS n FROM {t} t JOIN rng ON t.{by} = rng.{by} WHERE {v} >= lo AND {v} <= hi GROUP BY 1, 2)"""
_PRICE = _HIST.format(by="l_returnflag", v="l_extendedprice", t="lineitem", bins=40)
_VALUE = _HIST.format(by="event_type", v="value", t="events", bins=30)

QUERIES = {
    f.__name__: f
    for f in (coverage_stats, latency_report, metric_rollup, status_pivot, label_confusion, label_distribution, fraction_with_feature, three_valued_gate, regression_alerts, histogram_layers, histogram_bins, two_layer_score, wall_coverage_grid, estimate_disagreement, parameter_sweep, score_ladder, split_metric_rollup, success_accounting, flat_detector, global_overlap)
}
ORACLES = {
    "coverage_stats": """
SELECT source, count(*) AS seen, count(l.doc_id) AS with_property, round(median(n_chars), 4) AS median_amount, count(*) FILTER (coalesce(n_chars, 0) = 0) AS without_amount,
  round(count(l.doc_id) / count(*)::DOUBLE, 4) AS property_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
    "latency_report": """
WITH r AS (SELECT ['triage', 'conditioning', 'grouping', 'geometry', 'layout', 'plan', 'assembly', 'scale', 'shell', 'package'][l_linenumber] AS stage, l_quantity::DOUBLE AS value FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL SELECT 'end_to_end_all', o_totalprice / 1000 FROM orders UNION ALL SELECT 'end_to_end_full', o_totalprice / 1000 FROM orders WHERE o_orderstatus <> 'P'),
g AS (SELECT stage, list_sort(list(value)) AS v, count(value) AS n, max(value) AS max_s, avg(value) AS mean_s FROM r GROUP BY stage)
SELECT stage, n, v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95, max_s, round(mean_s, 4) AS mean_s, n < 20 AS few FROM g""",
    "metric_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(v) / count(*)::DOUBLE, 2) AS coverage, round(median(v), 2) AS median, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.1), 2) AS p10,
  round(quantile_cont(v, 0.9), 2) AS p90, round(min(v), 2) AS min, round(max(v), 2) AS max
FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_discount > 0 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1, 2""",
    "status_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "label_confusion": """
WITH r AS (SELECT lang, quality = 1 AS t, length(text) > 100 AND length(regexp_replace(text, '[^|#$%&*!]', '', 'g')) * 20 < length(text) AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
c AS (SELECT lang, count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn FROM r GROUP BY lang),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re FROM c)
SELECT lang, tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy FROM p""",
    "label_distribution": "SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3",
    "fraction_with_feature": """
WITH r AS (SELECT lang, n_chars, regexp_matches(text, '[0-9]') AS has FROM documents)
SELECT lang, round(avg(has::INT), 4) AS share, round(avg(has::INT) FILTER (n_chars >= 2000), 4) AS share_long, round(CAST(sum(CASE WHEN has THEN n_chars ELSE 0 END) AS DOUBLE) / greatest(1, sum(n_chars)), 4) AS share_of_chars FROM r GROUP BY lang""",
    "three_valued_gate": """
WITH r AS (SELECT source, quality = 1 AS passed, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT source, count(*) AS n, count(passed) AS judged, count(*) FILTER (passed IS NULL) AS unjudged, count(*) FILTER (passed) AS n_pass, median(n_chars) AS m FROM r GROUP BY source),
p AS (SELECT *, n_pass / nullif(judged, 0)::DOUBLE AS r FROM c)
SELECT source, n, judged, unjudged, n_pass, round(m, 4) AS median_value, round(r, 4) AS pass_rate, CASE WHEN judged * 2 < n THEN 'not judged' WHEN r >= 0.7 THEN 'passes' WHEN r >= 0.5 THEN 'marginal' ELSE 'fails' END AS verdict FROM p""",
    "regression_alerts": """
WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, round(median(value), 6) AS v FROM events GROUP BY 1, 2),
w AS (SELECT event_type, day, v, lag(v) OVER s AS previous, count(v) OVER p AS points, stddev_pop(v) OVER p AS sd FROM daily
  WINDOW s AS (PARTITION BY event_type ORDER BY day), p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN points >= 3 THEN sd ELSE 0 END AS sigma, CASE WHEN event_type = 'error' THEN v - previous ELSE previous - v END AS drop_by FROM w WHERE previous IS NOT NULL)
SELECT event_type, CAST(day AS VARCHAR) AS day, round(v, 4) AS current, round(previous, 4) AS previous, points, round(drop_by, 4) AS drop_by, round(greatest(2 * sigma, 2.0), 4) AS threshold,
  drop_by > greatest(2 * sigma, 2.0) AS alert, CASE WHEN 2 * sigma >= 2.0 THEN 'sigma' ELSE 'floor' END AS rule FROM x""",
    "histogram_layers": f"WITH {_PRICE}, m AS (SELECT *, max(n) OVER (PARTITION BY l_returnflag) AS mode FROM hist) SELECT l_returnflag, min(bin) AS first_bin, max(bin) AS last_bin, max(mode) AS mode, count(*) AS dense_bins FROM m WHERE n >= 0.12 * mode GROUP BY 1",
    "histogram_bins": f"WITH {_PRICE} SELECT l_returnflag, bin, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS around FROM hist",
    "two_layer_score": f"""WITH {_VALUE}, s AS (SELECT event_type, bin, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around FROM hist),
f AS (SELECT event_type, bin AS bin1, around AS around1 FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY around DESC, bin) = 1),
g AS (SELECT s.event_type, s.bin AS bin2, s.around AS around2 FROM s JOIN f ON s.event_type = f.event_type WHERE abs(s.bin - f.bin1) >= 4 QUALIFY row_number() OVER (PARTITION BY s.event_type ORDER BY s.around DESC, s.bin) = 1),
t AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS total FROM hist GROUP BY 1)
SELECT f.event_type, bin1, around1, bin2, around2, total, round((around1 + around2) / total::DOUBLE, 4) AS score FROM f JOIN g ON f.event_type = g.event_type JOIN t ON f.event_type = t.event_type""",
    "wall_coverage_grid": "SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(floor(user_id / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2",
    "estimate_disagreement": "SELECT l_partkey, count(u) AS n, round(CASE WHEN count(u) >= 2 THEN (max(u) - min(u)) / nullif(max(u), 0) * 100 END, 2) AS disagreement_pct FROM (SELECT l_partkey, l_extendedprice / l_quantity AS u FROM lineitem) GROUP BY 1",
    "parameter_sweep": "SELECT l_discount, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 2) AS q1, round(quantile_cont(l_extendedprice, 0.75), 2) AS q3, round(avg((l_tax BETWEEN 0.02 AND 0.05)::INT), 2) AS in_range FROM lineitem GROUP BY 1",
    "score_ladder": """
WITH p AS (SELECT p_size, round(avg(p_retailprice), 9) AS score FROM part GROUP BY 1),
w AS (SELECT p_size, score, first(score) OVER (ORDER BY p_size) AS base, max(score) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p)
SELECT p_size, score, round(score - base, 7) AS to_base, round(score - best, 7) AS to_best, coalesce(score > best + 0.005, true) AS new_best FROM w""",
    "split_metric_rollup": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "success_accounting": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_error, round(median(value) FILTER (event_type <> 'error'), 4) AS median_ok FROM events GROUP BY 1",
    "flat_detector": "SELECT l_partkey, round(a, 4) AS a, round(b, 4) AS b, a < 0.25 * b AS flat FROM (SELECT l_partkey, count(*) AS n, stddev_samp(l_quantity) / avg(l_quantity) AS a, stddev_samp(l_extendedprice) / avg(l_extendedprice) AS b FROM lineitem GROUP BY 1) WHERE n >= 3",
    "global_overlap": """
WITH c AS (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, round(count(*) FILTER (r AND f) / greatest(count(*) FILTER (r OR f), 1)::DOUBLE, 4) AS iou FROM c GROUP BY 1""",
}
