"""Text, HTML and JSON queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.sources import html as hs
from tessella.sources.tables import table

COMMON_GROUP = "# all\nUser-agent: *\nDisallow: /de/  # most of it\nAllow: /de/1*\nCrawl-delay: 2\n"
NAMED_GROUP = "Sitemap: /s.xml\n\nUser-Agent: otherbot\nUser-agent: tessellabot\nDisallow: /en/\nDisallow:\n"
RULES = (("/de/", False), ("/de/1*", True), ("/*?page=1", False), ("/fr/*ref=x$", False), ("/es", True), ("/es/", False), ("/en/2", False), ("/en/2", True), ("*7?", False))


def _captions(spark, d):
    """Room captions made of part columns: labels, areas and dimensions in varied forms."""
    p = table(spark, d, "part")
    words = F.array(*[F.lit(x) for x in ("Master Bedroom", "KITCHEN / Dining", "En-suite", "W.C.", "Utility room", "Reception hall", "Roof Terrace", "Home Office", "Lounge", "Store cupboard", "void", "Bed 2", "Family Bathroom")])
    label = F.element_at(words, (F.col("p_partkey") % 13 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    area = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), size, F.lit(".5 sq m"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" 1,"), F.lpad(size, 3, "0"), F.lit(" SQ FT / "), size, F.lit(" m2"))).otherwise(F.concat(F.lit(" scale 1:"), size, F.lit("0 not to scale")))
    return p.select("p_partkey", F.concat(label, area).alias("caption"))


def canonical_label(spark, d):
    return _captions(spark, d).select("p_partkey", tx.canonical_label(F.col("caption")).alias("label"))


def area_extract(spark, d):
    c = _captions(spark, d)
    return c.select("p_partkey", tx.first_area(F.col("caption")).alias("first_area"), F.array_join(F.transform(tx.areas(F.col("caption")), lambda x: F.format_number(x, 2)), ";").alias("areas"))


def scale_text(spark, d):
    c = _captions(spark, d)
    return c.select("p_partkey", tx.scale_ratio(F.col("caption")).cast("long").alias("ratio"), F.col("caption").rlike(tx.NOT_TO_SCALE).alias("disclaimer"))


def room_vocabulary(spark, d):
    c = _captions(spark, d)
    return c.select("p_partkey", F.array_join(tx.vocabulary(F.col("caption"), ["bed", "kitchen", "hall", "room", "store"]), ",").alias("words"))


def slugs(spark, d):
    return _captions(spark, d).select("p_partkey", tx.slug(F.col("caption")).alias("slug"), tx.digits(F.col("caption")).alias("digits"))


def dwelling_filter(spark, d):
    """Parts as listings: size as bedrooms, a marketing line as summary."""
    p = table(spark, d, "part")
    lines = F.array(*[F.lit(x) for x in ("a small flat", "Off-plan units", "7.5% rental yield", "portfolio of five", "buy to let", "Block of six", "an honest house", "student scheme")])
    blob = F.element_at(lines, (F.col("p_partkey") % 8 + 1).cast("int"))
    sub = F.when(F.col("p_type") == "PROMO", "Land").otherwise(F.col("p_type"))
    return p.select("p_partkey", tx.dwelling_reason(F.when(F.col("p_size") < 12, F.col("p_size")), blob, sub).alias("reason"))


def dimension_parse(spark, d):
    """Sides in metres of printed dimensions (match offsets matter, so no SQL)."""
    p = table(spark, d, "part")
    a, b = (F.col("p_size") / 5.0 + 0.6).cast("decimal(6,2)").cast("string"), ((F.col("p_partkey") % 37) / 4.0 + 1.0).cast("decimal(6,2)").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(a, F.lit("m x "), b, F.lit("m"))).when(F.col("p_partkey") % 4 == 1, F.concat(a, F.lit(" "), b)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("13'3\" x "), (F.col("p_size") % 20 + 4).cast("string"), F.lit("'6\""))).otherwise(F.concat(a, F.lit(" ft x "), b, F.lit(" ft")))
    return p.select("p_partkey", text.alias("caption"), tx.dimensions(text).alias("dims")).select("p_partkey", "caption", F.round("dims.long_m", 3).alias("long_m"), F.round("dims.short_m", 3).alias("short_m"))


def url_rules(spark, d):
    rules = spark.createDataFrame(list(RULES), "rule string, allow boolean")
    return tx.robots(table(spark, d, "pages"), "url", rules)


def robots_by_host(spark, d):
    """Each host's own robots file, of which every other has a group for the agent."""
    hosts = table(spark, d, "pages").select(tx.host_of(F.col("url")).alias("host")).distinct()
    body = F.concat(F.lit(COMMON_GROUP), F.when(F.length("host") % 2 == 0, F.lit(NAMED_GROUP)).otherwise(F.lit("")))
    rules = tx.robots_rules(hosts.withColumn("body", body), "host", "body", "Mozilla/5.0 (compatible; TessellaBot/1.0)")
    return tx.robots(table(spark, d, "pages"), "url", rules)


def url_paths(spark, d):
    return table(spark, d, "pages").select("page_id", tx.path_of(F.col("url")).alias("path"))


def html_payload(spark, d):
    """Title, number of links and text length of each page, by built-in functions."""
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return p.select("page_id", title.alias("title"), F.regexp_count("html", F.lit(r'<a href="')).cast("long").alias("links"), F.length(F.regexp_replace("html", r"<[^>]+>", " ")).cast("long").alias("text_length"))


def embedded_json(spark, d):
    """First balanced JSON object after a marker in each page (a balanced scan has no SQL)."""
    p = table(spark, d, "pages")
    page = F.concat(F.col("html"), F.lit("<script>window.__MODEL = {\"id\": "), F.col("page_id").cast("string"), F.lit(", \"s\": \"a } \\\" b\", \"o\": {\"k\": [1, 2]}}; x = {}</script>"))
    found = hs.json_after(page, F.lit("window.__MODEL"))
    return p.select("page_id", found.alias("payload"), F.get_json_object(found, "$.id").cast("long").alias("id"), F.get_json_object(found, "$.o.k[1]").cast("long").alias("k"))


def json_props(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def enum_counts(spark, d):
    """Counts of each status in a map, per priority."""
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").count()
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderstatus", "count"))))
    return o.groupBy("o_orderpriority").agg(F.to_json(m).alias("counts"))


def price_digits(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", tx.digits(F.concat(F.lit("£"), F.format_number(F.abs("c_acctbal"), 2), F.lit(" pcm"))).alias("pence"))


def image_label_adjudication(spark, d):
    """Where two classifiers of a document disagree: the strict one wins on pipes; flags and counts."""
    t = table(spark, d, "documents").select("source", F.col("text").contains(" | ").alias("portal"), (F.length("text") > 3000).alias("model"))
    final = F.when(F.col("portal") & ~F.col("model"), "table").when(F.col("model"), "long").otherwise("plain")
    return t.groupBy("source", final.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("portal") != F.col("model")).alias("disagree"))


_CAPTIONS = """
c AS (SELECT p_partkey, ['Master Bedroom', 'KITCHEN / Dining', 'En-suite', 'W.C.', 'Utility room', 'Reception hall', 'Roof Terrace', 'Home Office', 'Lounge', 'Store cupboard', 'void', 'Bed 2', 'Family Bathroom'][p_partkey % 13 + 1] ||
  CASE p_partkey % 3 WHEN 0 THEN ' ' || p_size || '.5 sq m' WHEN 1 THEN ' 1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' SQ FT / ' || p_size || ' m2' ELSE ' scale 1:' || p_size || '0 not to scale' END AS caption FROM part)"""
_LABELS = "CASE " + " ".join(f"WHEN regexp_matches(caption, '(?i){p}') THEN '{label}'" for label, p in tx.LABEL_PATTERNS) + " END"
_A = tx.AREA.replace("(?i)", "")
_M2 = f"""
m AS (SELECT p_partkey, unnest(regexp_extract_all(caption, '(?i){_A}')) AS x, unnest(range(len(regexp_extract_all(caption, '(?i){_A}')))) AS k FROM c),
v AS (SELECT p_partkey, k, CAST(replace(regexp_extract(x, '(?i){_A}', 1), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(regexp_replace(lower(regexp_extract(x, '(?i){_A}', 2)), '[ .]', '', 'g'), '^(sqf|ft)') THEN {tx.SQFT_TO_SQM}::DOUBLE ELSE 1.0::DOUBLE END AS a FROM m)"""
_RULES = ", ".join(f"('{r}', {str(a).lower()}, '{_p}')" for r, a in RULES for _p in [("^" + "".join({"*": ".*", "?": "\\?", "$": "$"}.get(ch, ch) for ch in r))])
_PATH = "(CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END)"

QUERIES = {
    f.__name__: f
    for f in (canonical_label, area_extract, scale_text, room_vocabulary, slugs, dwelling_filter, dimension_parse, url_rules, robots_by_host, url_paths, html_payload, embedded_json, json_props, enum_counts, price_digits, image_label_adjudication)
}
ORACLES = {
    "canonical_label": f"WITH {_CAPTIONS} SELECT p_partkey, {_LABELS} AS label FROM c",
    "area_extract": f"""WITH {_CAPTIONS}, {_M2}
SELECT c.p_partkey, max(CASE WHEN k = 0 AND a BETWEEN 8 AND 1500 THEN round(a, 2) END) AS first_area, coalesce(string_agg(CASE WHEN a BETWEEN 2 AND 1500 THEN printf('%.2f', round(a, 2)) END, ';' ORDER BY k), '') AS areas FROM c LEFT JOIN v ON c.p_partkey = v.p_partkey GROUP BY 1""",
    "scale_text": f"WITH {_CAPTIONS} SELECT p_partkey, TRY_CAST(regexp_extract(caption, '\\b1\\s*:\\s*(\\d{{2,4}})\\b', 1) AS BIGINT) AS ratio, regexp_matches(caption, '(?i)not\\s+to\\s+scale|approximate|illustrative|indicative') AS disclaimer FROM c",
    "room_vocabulary": f"WITH {_CAPTIONS} SELECT p_partkey, array_to_string(list_filter(['bed', 'kitchen', 'hall', 'room', 'store'], lambda w: contains(lower(caption), w)), ',') AS words FROM c",
    "slugs": f"WITH {_CAPTIONS} SELECT p_partkey, regexp_replace(regexp_replace(lower(caption), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, TRY_CAST(regexp_replace(caption, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM c",
    "dwelling_filter": """
WITH r AS (SELECT p_partkey, p_size, p_type, ['', 'Off-plan', '7.5% rental yield', 'portfolio', 'buy to let', 'Block of', '', 'student scheme'][p_partkey % 8 + 1] AS hit FROM part)
SELECT p_partkey, CASE WHEN p_size < 12 AND p_size > 6 THEN 'bedrooms=' || p_size WHEN hit <> '' THEN 'matched ''' || CASE WHEN hit LIKE '7.5%' THEN 'rental yield' ELSE hit END || '''' WHEN p_type = 'PROMO' THEN 'subtype=land' ELSE '' END AS reason FROM r""".replace("CASE WHEN hit LIKE '7.5%' THEN 'rental yield' ELSE hit END", "hit"),
    "url_rules": f"""
WITH r(rule, allow, pattern) AS (VALUES {_RULES}), p AS (SELECT DISTINCT url, {_PATH} AS path FROM pages),
m AS (SELECT url, rule, allow FROM p LEFT JOIN r ON regexp_matches(path, pattern))
SELECT url, coalesce(allow, true) AS allowed, rule FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC NULLS LAST, allow DESC) = 1""",
    "robots_by_host": f"""
WITH r(named, rule, allow, pattern) AS (VALUES (false, '/de/', false, '^/de/'), (false, '/de/1*', true, '^/de/1.*'), (true, '/en/', false, '^/en/')),
p AS (SELECT DISTINCT url, {_PATH} AS path, length(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))) % 2 = 0 AS named FROM pages), m AS (SELECT url, rule, allow FROM p LEFT JOIN r ON p.named = r.named AND regexp_matches(path, pattern))
SELECT url, coalesce(allow, true) AS allowed, rule FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC NULLS LAST, allow DESC) = 1""",
    "url_paths": f"SELECT page_id, url_decode({_PATH}) AS path FROM pages",
    "html_payload": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="')) AS BIGINT) AS links, CAST(length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS BIGINT) AS text_length FROM pages""",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "enum_counts": """SELECT o_orderpriority, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""",
    "price_digits": "SELECT c_custkey, CAST(regexp_replace(printf('%.2f', abs(c_acctbal)), '[^0-9]', '', 'g') AS BIGINT) AS pence FROM customer",
    "image_label_adjudication": """
WITH t AS (SELECT source, contains(text, ' | ') AS p, length(text) > 3000 AS m FROM documents)
SELECT source, CASE WHEN p AND NOT m THEN 'table' WHEN m THEN 'long' ELSE 'plain' END AS kind, count(*) AS n, count(*) FILTER (p <> m) AS disagree FROM t GROUP BY 1, 2""",
}
