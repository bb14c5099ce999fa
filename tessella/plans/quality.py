"""Quality, status and versioning queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import quality as op
from tessella.operators import statistics as st
from tessella.operators import versioning as ver
from tessella.sources import artifacts
from tessella.sources.tables import table

#: Stages and what each needs; the photo branch and the plan branch meet at assembly.
STAGES = ("triage", "conditioning", "grouping", "geometry", "layout", "plan", "assembly", "scale", "shell", "package")
NEEDS = (("conditioning", "triage"), ("grouping", "conditioning"), ("geometry", "grouping"), ("layout", "geometry"), ("plan", "triage"), ("assembly", "layout"), ("assembly", "plan"), ("scale", "assembly"), ("shell", "scale"), ("package", "shell"))


def schema_violations(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rules_c = [("c_acctbal", "minimum 0", F.col("c_acctbal") >= 0), ("c_name", "pattern", F.col("c_name").rlike("^Customer#[0-9]+$")), ("c_mktsegment", "enum", F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"))]
    rules_o = [("o_totalprice", "maximum 400000", F.col("o_totalprice") <= 400000), ("o_orderstatus", "enum", F.col("o_orderstatus").isin("F", "O")), ("o_orderpriority", "maxLength 8", F.length("o_orderpriority") <= 8)]
    return op.violations(c, "customer/v1", "c_custkey", rules_c).unionByName(op.violations(o, "order/v1", "o_orderkey", rules_o))


def _flagged(spark, d):
    t = table(spark, d, "documents")
    low = F.lower("text")
    return t.select("doc_id", "source", op.flags({"short": F.length("text") < 200, "pipes": F.col("text").contains(" | "), "has_digits": F.col("text").rlike("[0-9]"), "shouting": F.length(F.regexp_replace("text", "[^A-Z]", "")) * 3 > F.length("text"), "licensed": low.contains("license"), "secret": low.contains("token =")}).alias("flags"))


def qa_flags(spark, d):
    return _flagged(spark, d).select("doc_id", F.array_join("flags", ",").alias("flags"), F.size("flags").cast("long").alias("n"))


def flag_frequency(spark, d):
    return st.flag_frequency(_flagged(spark, d), "flags", "doc_id")


def flag_union(spark, d):
    return op.flag_union(_flagged(spark, d), "source", "flags").select("source", F.array_join("flags", ",").alias("flags"))


def run_status(spark, d):
    """Orders as runs and their lines as stages: returned is failed, open is skipped."""
    l = table(spark, d, "lineitem")
    stages = l.select("l_orderkey", F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "skipped").otherwise("ok").alias("status"), F.col("l_quantity").alias("seconds"))
    return op.run_status(stages, "l_orderkey", "status", "seconds", F.lit(40.0), 120.0)


def version_history(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.sha2("event_type", 256).alias("sha"))
    out = ver.versions(e, ["user_id"], ["event_id"], "sha")
    return out.select("user_id", F.col("version").cast("long"), "sha", "written_at", "last_seen_at", "seen_count")


def latest_version(spark, d):
    return ver.latest(version_history(spark, d), ["user_id"]).select("user_id", "version", "sha")


def present_stages(spark, d):
    """Users as listings, their kinds of events as stages."""
    e = table(spark, d, "events").select(F.col("user_id").alias("listing_id"), F.col("event_type").alias("stage"))
    return artifacts.present_stages(e).select("listing_id", F.array_join("stages", ",").alias("stages"), "versions")


def content_hashes(spark, d):
    """Equal payloads by content: how often each is written."""
    p = table(spark, d, "part").select(ver.content_hash(["p_type", "p_brand"]).alias("h"), "p_partkey")
    return p.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))


def required_artifacts(spark, d):
    """Which event types (as stages) each user's day lacks."""
    e = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("user_day"), "event_type")
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    wanted = e.select("user_day").distinct().select("user_day", F.explode(kinds).alias("event_type"))
    out = ver.required(wanted, e, "user_day", "event_type")
    return out.select("user_day", F.array_join("missing", ",").alias("missing"), F.array_join("present", ",").alias("present"))


def override_merge(spark, d):
    """Customers patched by the last order that says something: a later patch wins, nulls don't."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("amount"))
    o = table(spark, d, "orders")
    patches = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("label"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"))
    return ver.apply_patches(c, patches, "c_custkey", ["label", "amount"], "o_orderkey")


def nested_override(spark, d):
    """Maps of maps merged at two levels, one section cleared."""
    p = table(spark, d, "part")
    base = F.create_map(F.lit("plan"), F.create_map(F.lit("label"), F.col("p_type"), F.lit("brand"), F.col("p_brand")), F.lit("scale"), F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    patch = F.when(F.col("p_size") > 25, F.create_map(F.lit("plan"), F.create_map(F.lit("label"), F.lit("patched")), F.lit("note"), F.create_map(F.lit("by"), F.lit("hand"))))
    merged = ver.clear_section(ver.merge_overrides(base, patch), "scale")
    return p.select("p_partkey", merged["plan"]["label"].alias("label"), merged["plan"]["brand"].alias("brand"), F.try_element_at(merged, F.lit("note"))["by"].alias("note"), F.array_join(F.array_sort(F.map_keys(merged)), ",").alias("sections"))


def stage_blocking(spark, d):
    """Outcomes by order key: some stages fail, what needs them is skipped."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.posexplode(F.array(*map(F.lit, STAGES))).alias("place", "stage"))
    outcomes = runs.select("run", "stage", F.when((F.col("run") * 7 + F.col("place") * 3) % 29 == 0, "failed").otherwise("ok").alias("status"))
    return ver.blocked_stages(outcomes, STAGES, NEEDS)


def earliest_rerun(spark, d):
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, place int")
    changed = table(spark, d, "lineitem").select("l_orderkey", F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("l_linenumber") + 2).cast("int")).alias("stage"))
    return ver.earliest_stage(changed, "l_orderkey", "stage", stages).select("l_orderkey", "from_stage", F.col("place").cast("long"))


def share_and_gate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = op.plausible_share(o, "o_custkey", "o_totalprice", 20000.0, 450000.0, 0.35)
    return out.withColumn("share", F.round("share", 6))


def rescaled_totals(spark, d):
    s = table(spark, d, "supplier").withColumn("amount", F.greatest(F.lit(0.0), F.col("s_acctbal")))
    return op.rescaled(s, "s_nationkey", "amount", 60.0).select("s_suppkey", F.round("rescaled", 6).alias("rescaled"))


def priority_queue(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    stats = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("blocking"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("conf"))
    joined = c.join(stats, "c_custkey", "left")
    score = op.review_priority(F.coalesce("blocking", F.lit(0)), F.coalesce("conf", F.lit(0.0)), F.col("blocking").isNotNull())
    ranked = joined.select("c_custkey", F.round(score, 6).alias("priority"))
    return ranked.orderBy(F.desc("priority"), "c_custkey").limit(100)


def fit_verdicts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 11 != 0, F.col("p_size") / 50.0).alias("fit"), (F.col("p_retailprice") > 950).alias("a"), (F.col("p_size") > 44).alias("b"), (F.col("p_partkey") % 13 > 0).alias("c"), F.when(F.col("p_partkey") % 17 > 0, True).alias("e"))
    return p.select("p_partkey", op.fit_verdict(F.col("fit"), [F.col(x) for x in "abce"]).alias("verdict"))


def engine_fallback(spark, d):
    """The cheapest available supplier of each part, in order of preference."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    offers = l.select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct().join(s, "s_suppkey")
    return op.first_by_priority(offers, "l_partkey", F.col("s_nationkey"), "s_suppkey", F.col("s_acctbal") > 0).select("l_partkey", "s_suppkey", "s_nationkey")


def condition_majority(spark, d):
    """Orders of which more than half the lines are returned."""
    l = table(spark, d, "lineitem")
    return l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("l_returnflag") == "R") * 2 > F.count(F.lit(1))).alias("unusual"))


def blocking_flags(spark, d):
    """Flags that block, of all flags of a document."""
    f = _flagged(spark, d)
    return f.select("doc_id", F.array_join(F.array_intersect("flags", F.array(F.lit("pipes"), F.lit("secret"), F.lit("shouting"))), ",").alias("blocking"), F.exists("flags", lambda x: x.like("s%")).alias("any_s")).filter("blocking <> '' or any_s")


def integrity_verify(spark, d):
    """Locked hashes against what is there: ok, absent or mismatch."""
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    lock = t.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 2 == 0, F.col("sha")).otherwise(F.lit("x")).alias("locked"))
    there = t.filter("doc_id % 5 <> 0")
    joined = lock.join(there, lock["key"] == there["doc_id"], "left")
    return joined.select("key", F.when(F.col("sha").isNull(), "absent").when(F.col("sha") == F.col("locked"), "ok").otherwise("CHECKSUM MISMATCH").alias("state"))


def dataset_catalogue(spark, d):
    """Registered tables by tag: files and essential bytes (here rows), with tag overlap."""
    rows = [("orders", ["fact", "sales"], True, 3), ("lineitem", ["fact"], True, 5), ("part", ["dim"], False, 2), ("customer", ["dim", "sales"], True, 1)]
    reg = spark.createDataFrame(rows, "name string, tags array<string>, essential boolean, files int")
    wanted = F.array(F.lit("sales"), F.lit("dim"))
    return reg.filter(F.arrays_overlap("tags", wanted)).select("name", F.array_join("tags", ",").alias("tags"), F.when(F.col("essential"), F.col("files")).otherwise(0).cast("long").alias("essential_files"))


_FLAGS = """
f AS (SELECT doc_id, source, list_filter([
  CASE WHEN regexp_matches(text, '[0-9]') THEN 'has_digits' END, CASE WHEN contains(lower(text), 'license') THEN 'licensed' END, CASE WHEN contains(text, ' | ') THEN 'pipes' END,
  CASE WHEN contains(lower(text), 'token =') THEN 'secret' END, CASE WHEN length(text) < 200 THEN 'short' END,
  CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) * 3 > length(text) THEN 'shouting' END], lambda x: x IS NOT NULL) AS flags FROM documents)"""
_VER = """
w AS (SELECT user_id, event_id, sha256(event_type) AS sha, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events),
n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version FROM w),
v AS (SELECT user_id, version, any_value(sha) AS sha, min(event_id) AS written_at, max(event_id) AS last_seen_at, count(*) AS seen_count FROM n GROUP BY 1, 2)"""
_NEEDS = ", ".join(f"('{a}', '{b}')" for a, b in NEEDS)
_STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES))

QUERIES = {
    f.__name__: f
    for f in (schema_violations, qa_flags, flag_frequency, flag_union, run_status, version_history, latest_version, present_stages, content_hashes, required_artifacts, override_merge, nested_override, stage_blocking, earliest_rerun, share_and_gate, rescaled_totals, priority_queue, fit_verdicts, engine_fallback, condition_majority, blocking_flags, integrity_verify, dataset_catalogue)
}
ORACLES = {
    "schema_violations": """
SELECT 'customer/v1' AS schema, c_custkey AS id, 'c_acctbal' AS path, 'minimum 0' AS rule FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)
UNION ALL SELECT 'customer/v1', c_custkey, 'c_name', 'pattern' FROM customer WHERE NOT coalesce(regexp_matches(c_name, '^Customer#[0-9]+$'), false)
UNION ALL SELECT 'customer/v1', c_custkey, 'c_mktsegment', 'enum' FROM customer WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'), false)
UNION ALL SELECT 'order/v1', o_orderkey, 'o_totalprice', 'maximum 400000' FROM orders WHERE NOT coalesce(o_totalprice <= 400000, false)
UNION ALL SELECT 'order/v1', o_orderkey, 'o_orderstatus', 'enum' FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)
UNION ALL SELECT 'order/v1', o_orderkey, 'o_orderpriority', 'maxLength 8' FROM orders WHERE NOT coalesce(length(o_orderpriority) <= 8, false)""",
    "qa_flags": f"WITH {_FLAGS} SELECT doc_id, array_to_string(flags, ',') AS flags, CAST(len(flags) AS BIGINT) AS n FROM f",
    "flag_frequency": f"WITH {_FLAGS} SELECT flag, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(flags) AS flag FROM f) GROUP BY flag",
    "flag_union": f"WITH {_FLAGS} SELECT source, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM (SELECT source, unnest(flags) AS flag FROM f) GROUP BY source",
    "run_status": """
WITH s AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'skipped' ELSE 'ok' END AS status, l_quantity AS seconds FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('failed', 'skipped')) THEN 'partial' ELSE 'ok' END AS status, sum(seconds) AS total_seconds,
  count(*) FILTER (seconds > 40) AS over_budget, sum(seconds) > 120 AS slo_breach FROM s GROUP BY 1""",
    "version_history": f"WITH {_VER} SELECT user_id, version, sha, written_at, last_seen_at, seen_count FROM v",
    "latest_version": f"WITH {_VER} SELECT user_id, version, sha FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC) = 1",
    "present_stages": "SELECT user_id AS listing_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS stages, count(*) AS versions FROM events GROUP BY 1",
    "content_hashes": """SELECT sha256('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}') AS h, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1""",
    "required_artifacts": """
WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS user_day, event_type FROM events), k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type),
w AS (SELECT u.user_day, k.event_type, e.event_type IS NOT NULL AS have FROM (SELECT DISTINCT user_day FROM e) u CROSS JOIN k LEFT JOIN e ON e.user_day = u.user_day AND e.event_type = k.event_type)
SELECT user_day, string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT have) AS missing, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (have), '') AS present FROM w GROUP BY 1 HAVING count(*) FILTER (NOT have) > 0""",
    "override_merge": """
WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS label, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount FROM orders),
f AS (SELECT o_custkey, arg_max(label, o_orderkey) FILTER (label IS NOT NULL) AS l, arg_max(amount, o_orderkey) FILTER (amount IS NOT NULL) AS a FROM p GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(l, c_mktsegment) AS label, coalesce(a, c_acctbal) AS amount, o_custkey IS NOT NULL AS patched FROM customer FULL JOIN f ON c_custkey = o_custkey""",
    "nested_override": """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'patched' ELSE p_type END AS label, p_brand AS brand, CASE WHEN p_size > 25 THEN 'hand' END AS note, CASE WHEN p_size > 25 THEN 'note,plan' ELSE 'plan' END AS sections FROM part""",
    "stage_blocking": f"""
WITH RECURSIVE e(stage, needs) AS (VALUES {_NEEDS}), s(place, stage) AS (VALUES {_STAGES}),
o AS (SELECT o_orderkey AS run, stage, CASE WHEN (o_orderkey * 7 + place * 3) % 29 = 0 THEN 'failed' ELSE 'ok' END AS status FROM orders, s),
b(run, stage) AS (SELECT run, stage FROM o WHERE status IN ('failed', 'skipped') UNION SELECT b.run, e.stage FROM b JOIN e ON e.needs = b.stage)
SELECT o.run, o.stage, CASE WHEN o.status = 'failed' THEN 'failed' WHEN b.stage IS NOT NULL THEN 'skipped' ELSE o.status END AS effective FROM o LEFT JOIN b ON o.run = b.run AND o.stage = b.stage""",
    "earliest_rerun": f"WITH s(place, stage) AS (VALUES {_STAGES}), m AS (SELECT l_orderkey, min(l_linenumber) + 1 AS place FROM lineitem GROUP BY 1) SELECT l_orderkey, stage AS from_stage, CAST(m.place AS BIGINT) AS place FROM m JOIN s ON s.place = m.place",
    "share_and_gate": """
WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice / nullif(sum(o_totalprice) OVER g, 0) AS share, count(*) OVER g AS n FROM orders WINDOW g AS (PARTITION BY o_custkey)),
k AS (SELECT *, o_totalprice BETWEEN 20000 AND 450000 AND (n <= 2 OR share <= 0.35) AS ok FROM w), c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY o_custkey) AS kept FROM k)
SELECT o_orderkey, o_custkey, o_totalprice, round(share, 6) AS share, kept = 0 AS fallback FROM c WHERE ok OR kept = 0""",
    "rescaled_totals": """
WITH s AS (SELECT s_suppkey, s_nationkey, greatest(0, s_acctbal) AS a FROM supplier), t AS (SELECT *, sum(a) OVER (PARTITION BY s_nationkey) AS total FROM s)
SELECT s_suppkey, round(CASE WHEN a <> 0 AND total > 0 THEN a / total * 60 ELSE a END, 6) AS rescaled FROM t""",
    "priority_queue": """
WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS blocking, avg((o_orderstatus = 'F')::INT) AS conf FROM orders GROUP BY 1)
SELECT c_custkey, round(coalesce(blocking, 0) * 2 + (1 - coalesce(conf, 0)) * 3 + CASE WHEN blocking IS NOT NULL THEN 0 ELSE 5 END, 6) AS priority FROM customer LEFT JOIN s ON c_custkey = o_custkey ORDER BY priority DESC, c_custkey LIMIT 100""",
    "fit_verdicts": """
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'unknown' WHEN p_size / 50.0::DOUBLE < 0.70 THEN 'poor' WHEN p_size / 50.0::DOUBLE >= 0.85 AND p_retailprice > 950 AND p_size > 44 AND p_partkey % 13 > 0 AND p_partkey % 17 > 0 THEN 'clean' ELSE 'check' END AS verdict FROM part""",
    "engine_fallback": """
SELECT l_partkey, s_suppkey, s_nationkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY s_nationkey, s_suppkey) = 1""",
    "condition_majority": "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') * 2 > count(*) AS unusual FROM lineitem GROUP BY 1",
    "blocking_flags": f"""WITH {_FLAGS}, b AS (SELECT doc_id, array_to_string(list_filter(flags, lambda x: x IN ('pipes', 'secret', 'shouting')), ',') AS blocking, len(list_filter(flags, lambda x: x LIKE 's%')) > 0 AS any_s FROM f)
SELECT doc_id, blocking, any_s FROM b WHERE blocking <> '' OR any_s""",
    "integrity_verify": """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), l AS (SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN sha ELSE 'x' END AS locked FROM t WHERE doc_id % 3 = 0)
SELECT key, CASE WHEN t.sha IS NULL THEN 'absent' WHEN t.sha = locked THEN 'ok' ELSE 'CHECKSUM MISMATCH' END AS state FROM l LEFT JOIN (SELECT * FROM t WHERE doc_id % 5 <> 0) t ON t.doc_id = l.key""",
    "dataset_catalogue": "SELECT * FROM (VALUES ('orders', 'fact,sales', CAST(3 AS BIGINT)), ('part', 'dim', 0), ('customer', 'dim,sales', 1)) v(name, tags, essential_files)",
}
