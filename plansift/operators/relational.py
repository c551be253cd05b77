"""Scans, filters, joins and aggregates over projects, pages, detections and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plansift.functions.windows import running_sum
from plansift.functions.geometry import Box
from plansift.functions.text import DRAWING_NUMBER, discipline, looked_up, significant, stem_match, whole_word, SERIES
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

# --- scans and filters ---------------------------------------------------------------------------------------------


@register("s01_point_lookup", oracle("v_page", "SELECT project_id, page_number, drawing_number, length(raw_text) AS n_chars FROM v_page WHERE project_id = 'src3' AND page_number = (SELECT min(page_number) FROM v_page WHERE project_id = 'src3')"))
def s01(spark, sf_dir):
    """One page by project and number: the first of a project."""
    p = views.page(spark, sf_dir).where("project_id = 'src3'")
    first = p.agg(F.min("page_number").alias("page_number"))
    return p.join(F.broadcast(first), "page_number").select("project_id", "page_number", "drawing_number", F.length("raw_text").cast("long").alias("n_chars"))


@register("s02_range_scan", oracle("v_page v_detection", """
SELECT p.project_id, p.page_number, p.drawing_number, count(d.det_id) AS detections FROM v_page p LEFT JOIN v_detection d ON d.doc_id = p.page_number
WHERE p.page_number BETWEEN 100 AND 149 GROUP BY ALL"""))
def s02(spark, sf_dir):
    """A chunk of pages (the span is the request's) with their annotation counts."""
    p = views.page(spark, sf_dir).where(F.col("page_number").between(100, 149)).select("project_id", "page_number", "drawing_number")
    d = views.detection(spark, sf_dir).where(F.col("doc_id").between(100, 149)).groupBy(F.col("doc_id").alias("page_number")).agg(F.count("*").alias("n"))
    return p.join(d, "page_number", "left").select("project_id", "page_number", "drawing_number", F.coalesce("n", F.lit(0)).alias("detections"))


@register("s04_visibility_scan", "SELECT l_returnflag AS creator, l_linenumber AS source, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber IN (1, 3, 5) GROUP BY ALL")
def s04(spark, sf_dir):
    """Own rows or rows of public sources."""
    i = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber")
    return i.where((F.col("l_returnflag") == "R") | F.col("l_linenumber").isin(1, 3, 5)).groupBy(F.col("l_returnflag").alias("creator"), F.col("l_linenumber").alias("source")).agg(F.count("*").alias("n"))


@register("s05_in_list_scan", oracle("v_page v_detection", "SELECT page_number, drawing_number FROM v_page WHERE page_number IN (SELECT doc_id FROM v_detection WHERE name = 'tables' AND conf >= 9e-1)"))
def s05(spark, sf_dir):
    """Pages in a list that another table gives."""
    wanted = views.detection(spark, sf_dir).where("name = 'tables' AND conf >= 0.9D").select(F.col("doc_id").alias("page_number"))
    return views.page(spark, sf_dir).select("page_number", "drawing_number").join(wanted, "page_number", "left_semi")


@register("s09_raw_text", oracle("v_word v_line", "SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY line_idx)) AS digest, count(*) AS lines FROM v_line GROUP BY doc_id"))
def s09(spark, sf_dir):
    """Raw text of a page: its lines in order."""
    g = views.line(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("x"))
    return g.select("doc_id", F.md5(F.array_join(F.transform("x", lambda v: v["text"]), "\n").cast("binary")).alias("digest"), F.size("x").cast("long").alias("lines"))


@register("s12_staging_offsets", "SELECT source, doc_id, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS start FROM documents")
def s12(spark, sf_dir):
    """Files of a project in order, with the offset of each in the whole."""
    run = running_sum(read(spark, sf_dir, "documents", "source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", "run")
    return run.select("source", "doc_id", "n_chars", (F.col("run") - F.col("n_chars")).alias("start"))


@register("s15_index_lookup", oracle("v_word v_text v_taxonomy v_page_code", """
SELECT code, count(DISTINCT doc_id) AS pages FROM v_page_code WHERE starts_with(replace(code, ' ', ''), '08') OR code = '03 02 32' GROUP BY code"""))
def s15(spark, sf_dir):
    """Index entries by exact key or by the start of the key without spaces."""
    key = F.replace("code", F.lit(" "), F.lit(""))
    return views.page_code(spark, sf_dir).where(key.startswith("08") | (F.col("code") == "03 02 32")).groupBy("code").agg(F.count_distinct("doc_id").alias("pages"))


@register("p02_json_predicate", "SELECT o_orderstatus AS model, count(*) AS n, sum(o_orderkey % 10)::BIGINT AS total FROM orders WHERE (o_orderkey % 10) >= 3 GROUP BY ALL")
def p02(spark, sf_dir):
    """Values of a JSON column, cast and compared."""
    data = F.to_json(F.struct(F.col("o_orderstatus").alias("modelId"), (F.col("o_orderkey") % 10).alias("level")))
    j = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(data.alias("data"))
    level = F.get_json_object("data", "$.level").cast("int")
    return j.where(level >= 3).groupBy(F.get_json_object("data", "$.modelId").alias("model")).agg(F.count("*").alias("n"), F.sum(level).alias("total"))


@register("p03_annotation_filter", oracle("v_detection", "SELECT name, count(*) AS n FROM v_detection WHERE name IN ('tables', 'grid') AND coalesce(nullif(conf, 2e-1), 1e0) >= 6e-1 GROUP BY name"))
def p03(spark, sf_dir):
    """Detections by class and confidence; a missing confidence counts as 1."""
    conf = F.coalesce(F.nullif(F.col("conf"), F.lit(2e-1)), F.lit(1.0))
    return views.detection(spark, sf_dir).where(F.col("name").isin("tables", "grid") & (conf >= 0.6)).groupBy("name").agg(F.count("*").alias("n"))


@register("p04_whole_word", "SELECT lang, count(*) AS pages FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])license([^A-Za-z0-9_]|$)') GROUP BY lang")
def p04(spark, sf_dir):
    return read(spark, sf_dir, "documents", "text", "lang").where(whole_word(F.col("text"), "license")).groupBy("lang").agg(F.count("*").alias("pages"))


@register("p05_stem_prefix", oracle("v_word", """
WITH s AS (SELECT tok, regexp_replace(lower(tok), '[^a-z0-9]+', '', 'g') AS s, count(*) AS n FROM v_word GROUP BY tok)
SELECT tok, n FROM s WHERE length(s) > 2 AND (starts_with(s, 'tion') OR starts_with('tion', s))"""))
def p05(spark, sf_dir):
    """Words that match a term by their stems."""
    n = views.word(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("n"))
    return n.where(stem_match(F.col("tok"), F.lit("tion")))


@register("p07_page_scope", oracle("v_page", "SELECT project_id, count(*) AS pages FROM v_page WHERE regexp_matches(drawing_number, '^(A|FP)-') AND lang IN ('en', 'de') GROUP BY project_id"))
def p07(spark, sf_dir):
    """Pages in scope: listed ones whose drawing number has a listed prefix."""
    return views.page(spark, sf_dir).where(F.col("drawing_number").rlike("^(A|FP)-") & F.col("lang").isin("en", "de")).groupBy("project_id").agg(F.count("*").alias("pages"))


@register("p09_strictness", oracle("v_detection", """
WITH t AS (SELECT CASE WHEN conf >= 7e-1 THEN 'high' WHEN conf >= 35e-2 THEN 'medium' ELSE 'low' END AS tier, name FROM v_detection)
SELECT tier, tier <> 'low' AS balanced, tier = 'high' AS strict, count(*) AS n FROM t GROUP BY tier"""))
def p09(spark, sf_dir):
    """Matches by tier, and which a balanced or strict filter keeps."""
    tier = F.when(F.col("conf") >= 0.7, "high").when(F.col("conf") >= 0.35, "medium").otherwise("low")
    n = views.detection(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
    return n.select("tier", (F.col("tier") != "low").alias("balanced"), (F.col("tier") == "high").alias("strict"), "n")


@register("p10_bbox_validation", oracle("v_detection", """
SELECT CASE WHEN maxx > 1 OR maxy > 1 OR minx < 0 OR miny < 0 THEN 'out of range' WHEN minx >= maxx OR miny >= maxy THEN 'empty' ELSE 'ok' END AS verdict, count(*) AS n FROM v_detection GROUP BY ALL"""))
def p10(spark, sf_dir):
    b = Box.of()
    bad = (b.maxx > 1) | (b.maxy > 1) | (b.minx < 0) | (b.miny < 0)
    return views.detection(spark, sf_dir).groupBy(F.when(bad, "out of range").when((b.minx >= b.maxx) | (b.miny >= b.maxy), "empty").otherwise("ok").alias("verdict")).agg(F.count("*").alias("n"))


@register("p13_redaction", "SELECT doc_id, substr(text, 1, 500) AS shown, length(text) > 500 AS truncated FROM documents")
def p13(spark, sf_dir):
    """The text as a report shows it: its first 500 characters, and whether there is more."""
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.substring("text", 1, 500).alias("shown"), (F.length("text") > 500).alias("truncated"))


@register("p14_legacy_types", oracle("v_detection", """
SELECT CASE name WHEN 'grid' THEN 'schedule-table' WHEN 'text_box' THEN 'notes-numbered' WHEN 'vertical_area' THEN 'spec-dense-columns' ELSE name END AS type, count(*) AS n
FROM v_detection WHERE name IN ('grid', 'text_box', 'vertical_area', 'tables') GROUP BY ALL"""))
def p14(spark, sf_dir):
    """Types under their new names, legacy ones renamed on reading."""
    new = {"grid": "schedule-table", "text_box": "notes-numbered", "vertical_area": "spec-dense-columns"}
    d = views.detection(spark, sf_dir).where(F.col("name").isin("grid", "text_box", "vertical_area", "tables"))
    return d.groupBy(F.coalesce(looked_up(new, F.col("name")), "name").alias("type")).agg(F.count("*").alias("n"))


@register("p17_class_types", oracle("v_detection", "SELECT d.name, count(*) AS n FROM v_detection d WHERE d.name IN (SELECT c FROM (VALUES ('tables', 'spatial'), ('grid', 'count'), ('drawings', 'both')) t(c, k) WHERE k IN ('spatial', 'both')) GROUP BY d.name"))
def p17(spark, sf_dir):
    """Detections whose class a model's configuration marks as spatial or both."""
    config = spark.createDataFrame([("tables", "spatial"), ("grid", "count"), ("drawings", "both")], "name string, kind string").where("kind IN ('spatial', 'both')")
    return views.detection(spark, sf_dir).join(F.broadcast(config.select("name")), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


# --- joins ---------------------------------------------------------------------------------------------------------


@register("j01_pages_projects", oracle("v_page v_project", "SELECT name, count(*) AS pages, min(page_number) AS first_page FROM v_page JOIN v_project USING (project_id) GROUP BY name"))
def j01(spark, sf_dir):
    return views.page(spark, sf_dir).join(views.project(spark, sf_dir), "project_id").groupBy("name").agg(F.count("*").alias("pages"), F.min("page_number").alias("first_page"))


@register("j02_annotations_projects", oracle("v_detection v_page", "SELECT project_id, d.name, count(*) AS n FROM v_detection d JOIN v_page p ON d.doc_id = p.page_number GROUP BY ALL"))
def j02(spark, sf_dir):
    p = views.page(spark, sf_dir).select("project_id", F.col("page_number").alias("doc_id"))
    return views.detection(spark, sf_dir).select("doc_id", "name").join(p, "doc_id").groupBy("project_id", "name").agg(F.count("*").alias("n"))


@register("j17_label_value", oracle("v_word", """
WITH x AS (SELECT doc_id, idx, tok, lead(tok) OVER (PARTITION BY doc_id, line_idx ORDER BY idx) AS value FROM v_word)
SELECT doc_id, idx, value FROM x WHERE lower(tok) = 'the' AND value IS NOT NULL"""))
def j17(spark, sf_dir):
    """The word to the right of each label on its line."""
    w = views.word(spark, sf_dir).withColumn("value", F.lead("tok").over(W.partitionBy("doc_id", "line_idx").orderBy("idx")))
    return w.where((F.lower("tok") == "the") & F.col("value").isNotNull()).select("doc_id", "idx", "value")


@register("j18_reference_pages", oracle("v_page v_cross_ref", """
WITH t AS (SELECT upper(drawing_number) AS dn, max(page_number) AS page FROM v_page GROUP BY ALL)
SELECT r.from_doc, t.page AS to_page, count(*) AS n FROM v_cross_ref r JOIN v_page p ON r.to_doc = p.page_number JOIN t ON t.dn = upper(p.drawing_number) GROUP BY ALL"""))
def j18(spark, sf_dir):
    """References by drawing number to pages; of pages that share a number the last wins."""
    p = views.page(spark, sf_dir).select("page_number", F.upper("drawing_number").alias("dn"))
    last = p.groupBy("dn").agg(F.max("page_number").alias("to_page"))
    refs = views.cross_ref(spark, sf_dir).join(p.withColumnRenamed("page_number", "to_doc"), "to_doc").join(last, "dn")
    return refs.groupBy("from_doc", "to_page").agg(F.count("*").alias("n"))


@register("j22_group_members", "SELECT n_name AS grp, count(*) AS members, count(DISTINCT c_mktsegment) AS kinds FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name")
def j22(spark, sf_dir):
    """Groups with their members through the bridge."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("n_name").alias("grp")).agg(F.count("*").alias("members"), F.count_distinct("c_mktsegment").alias("kinds"))


@register("j23_membership_validation", "SELECT count(*) AS strangers, count(DISTINCT o_custkey) AS ids FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j23(spark, sf_dir):
    members = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders", "o_custkey").join(members, "o_custkey", "left_anti").agg(F.count("*").alias("strangers"), F.count_distinct("o_custkey").alias("ids"))


@register("j24_schedule_specs", oracle("v_schedule", "SELECT tag, arg_min(p_type, p_partkey) AS type, arg_min(p_size, p_partkey) AS size, count(*) AS n FROM v_schedule GROUP BY tag"))
def j24(spark, sf_dir):
    """The first schedule row of a tag supplies its specifications."""
    return views.schedule(spark, sf_dir).groupBy("tag").agg(F.min_by("p_type", "p_partkey").alias("type"), F.min_by("p_size", "p_partkey").alias("size"), F.count("*").alias("n"))


@register("j26_class_config", oracle("v_detection", """
SELECT c.codes, count(*) AS n, round(avg(d.conf), 6) AS conf FROM v_detection d JOIN (VALUES ('tables', '08 00 00'), ('grid', '03 00 00'), ('drawings', '26 00 00')) c(name, codes) USING (name) GROUP BY c.codes"""))
def j26(spark, sf_dir):
    config = spark.createDataFrame([("tables", "08 00 00"), ("grid", "03 00 00"), ("drawings", "26 00 00")], "name string, codes string")
    return views.detection(spark, sf_dir).join(F.broadcast(config), "name").groupBy("codes").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


@register("j28_region_codes", oracle("v_word v_text v_taxonomy v_page_code v_line", """
WITH w AS (SELECT code, unnest(string_split(description, ' ')) AS tok, len(string_split(description, ' ')) AS n FROM v_taxonomy),
h AS (SELECT l.doc_id, l.line_idx, w.code, n, count(*) AS m FROM v_line l JOIN v_page_code c ON l.doc_id = c.doc_id JOIN w ON w.code = c.code AND contains(lower(l.text), w.tok) GROUP BY ALL)
SELECT doc_id, line_idx, code, m FROM h WHERE m >= ceil(n * 4e-1)"""))
def j28(spark, sf_dir):
    """A page's code belongs to a region (here a line) that has 40 % of the description's words in its text."""
    words = F.split("description", " ")
    w = views.taxonomy(spark, sf_dir).select("code", F.size(words).alias("n"), F.explode(words).alias("tok"))
    regions = views.line(spark, sf_dir).select("doc_id", "line_idx", F.lower("text").alias("text"))
    asked = views.page_code(spark, sf_dir).select("doc_id", "code").join(w, "code")
    h = regions.join(asked, "doc_id").where(F.col("text").contains(F.col("tok"))).groupBy("doc_id", "line_idx", "code", "n").agg(F.count("*").alias("m"))
    return h.where(F.col("m") >= F.ceil(F.col("n") * F.lit(0.4))).drop("n")


@register("j32_company_counts", "SELECT n_name, coalesce(c.n, 0) AS users, coalesce(s.n, 0) AS projects FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey")
def j32(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("users"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("projects"))
    return read(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("projects", F.lit(0)).alias("projects"))


@register("j33_project_page_counts", oracle("v_project v_page", "SELECT project_id, count(page_number) AS pages FROM v_project LEFT JOIN v_page USING (project_id) GROUP BY project_id"))
def j33(spark, sf_dir):
    n = views.page(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n"))
    return views.project(spark, sf_dir).join(n, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("pages"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@register("a01_project_matches", "SELECT source, count(*) AS match_count, count(DISTINCT doc_id) AS page_count FROM documents WHERE contains(lower(text), 'the') GROUP BY source")
def a01(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source").where(F.lower("text").contains("the"))
    return d.groupBy("source").agg(F.count("*").alias("match_count"), F.count_distinct("doc_id").alias("page_count"))


@register("a02_word_total", r"SELECT source, sum(len(regexp_split_to_array(lower(text), '\s+')))::BIGINT AS total_words FROM documents GROUP BY source")
def a02(spark, sf_dir):
    return read(spark, sf_dir, "documents", "text", "source").groupBy("source").agg(F.sum(F.size(F.split(F.lower("text"), r"\s+"))).alias("total_words"))


@register("a05_detections_by_model", oracle("v_detection v_page", "SELECT project_id, name AS model, count(*) AS n, round(avg(conf), 6) AS conf FROM v_detection JOIN v_page ON doc_id = page_number GROUP BY ALL"))
def a05(spark, sf_dir):
    p = views.page(spark, sf_dir).select("project_id", F.col("page_number").alias("doc_id"))
    return views.detection(spark, sf_dir).join(p, "doc_id").groupBy("project_id", F.col("name").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


@register("a10_disciplines", oracle("v_page", """
WITH p AS (SELECT regexp_extract(drawing_number, '^([A-Z]{1,4})-?([0-9]{1,4})', 1) AS prefix, regexp_extract(drawing_number, '^([A-Z]{1,4})-?([0-9]{1,4})', 2)::INT AS num FROM v_page),
s AS (SELECT prefix, num // 100 * 100 AS series, count(*) AS n FROM p GROUP BY ALL)
SELECT p.prefix, count(*) AS sheets, min(num) AS lo, max(num) AS hi, (SELECT string_agg(series || ':' || n, ',' ORDER BY series) FROM s WHERE s.prefix = p.prefix) AS histogram FROM p GROUP BY p.prefix"""))
def a10(spark, sf_dir):
    """Sheets by drawing-number prefix: number, range and histogram by hundreds."""
    part = lambda k: F.regexp_extract("drawing_number", DRAWING_NUMBER, k)
    p = views.page(spark, sf_dir).select(part(1).alias("prefix"), part(2).cast("int").alias("num"))
    s = p.groupBy("prefix", (F.floor(F.col("num") / 100) * 100).alias("series")).agg(F.count("*").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series", "n"))), lambda x: F.concat_ws(":", x["series"], x["n"])), ",")
    return s.groupBy("prefix").agg(F.sum("n").alias("sheets"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), text.alias("histogram"))


_PREFIX = "regexp_extract(drawing_number, '^([A-Z]{1,4})-?([0-9]{1,4})(?:\\.([0-9]{1,2}))?$', %d)"


@register("r01_page_classifier", oracle("v_page", f"""
WITH p AS (SELECT page_number, {_PREFIX % 1} AS prefix, substr({_PREFIX % 2}, 1, 1) AS digit FROM v_page),
d(k, name) AS (VALUES ('T','Title/Cover'),('G','General'),('C','Civil'),('L','Landscape'),('A','Architectural'),('I','Interior'),('ID','Interior Design'),('DM','Demolition'),('S','Structural'),
 ('M','Mechanical'),('E','Electrical'),('P','Plumbing'),('FP','Fire Protection'),('FA','Fire Alarm'),('SP','Sprinkler')),
s(k, name) AS (VALUES ('0','General/Cover'),('1','Floor Plan'),('2','Elevation'),('3','Section'),('4','Enlarged Plan'),('5','Detail'),('6','Schedule/Diagram'),('7','Diagram'),('8','Detail'),('9','3D/Rendering'))
SELECT page_number, coalesce(d1.name, d2.name, d3.name) AS discipline, s.name AS sub_type, CASE WHEN coalesce(d1.name, d2.name, d3.name) IS NOT NULL THEN 95e-2 ELSE 5e-1 END AS confidence
FROM p LEFT JOIN d d1 ON d1.k = prefix LEFT JOIN d d2 ON d2.k = substr(prefix, 1, 2) LEFT JOIN d d3 ON d3.k = substr(prefix, 1, 1) LEFT JOIN s ON s.k = digit"""))
def r01(spark, sf_dir):
    """Discipline and kind of each page from its drawing number."""
    part = lambda k: F.regexp_extract("drawing_number", DRAWING_NUMBER, k)
    found = discipline(part(1))
    return views.page(spark, sf_dir).select(
        "page_number", found.alias("discipline"), looked_up(SERIES, F.substring(part(2), 1, 1)).alias("sub_type"), F.when(found.isNotNull(), 0.95).otherwise(0.5).alias("confidence")
    )


@register("a29_annotation_pivot", oracle("v_detection", """
SELECT doc_id, count(*) FILTER (name IN ('tables', 'grid')) AS yolo, count(*) FILTER (name = 'drawings') AS takeoff, count(*) FILTER (name NOT IN ('tables', 'grid', 'drawings')) AS other FROM v_detection GROUP BY doc_id"""))
def a29(spark, sf_dir):
    bucket = F.when(F.col("name").isin("tables", "grid"), "yolo").when(F.col("name") == "drawings", "takeoff").otherwise("other")
    p = views.detection(spark, sf_dir).withColumn("bucket", bucket).groupBy("doc_id").pivot("bucket", ["yolo", "takeoff", "other"]).count()
    return p.na.fill(0, ["yolo", "takeoff", "other"])


@register("a30_category_counts", oracle("v_detection", "SELECT name, count(*) AS n, count(DISTINCT doc_id) AS pages FROM v_detection GROUP BY name"))
def a30(spark, sf_dir):
    return views.detection(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


@register("a31_takeoff_totals", oracle("v_detection", "SELECT name AS item, count(*) AS n, round(sum((maxx - minx) * (maxy - miny)), 6) AS area, count(DISTINCT doc_id) AS pages FROM v_detection GROUP BY name"))
def a31(spark, sf_dir):
    return views.detection(spark, sf_dir).groupBy(F.col("name").alias("item")).agg(F.count("*").alias("n"), F.round(F.sum(Box.of().area), 6).alias("area"), F.count_distinct("doc_id").alias("pages"))


@register("a33_detection_summary", oracle("v_detection", "SELECT doc_id, name, count(*) AS n, round(avg(conf), 6) AS conf FROM (SELECT *, 1 AS rank FROM v_detection) GROUP BY doc_id, name, rank QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, name) <= 5"))
def a33(spark, sf_dir):
    """The five classes with most detections of each page (a top-5 report)."""
    n = views.detection(spark, sf_dir).groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "name"))).where("r <= 5").drop("r")


@register("a39_annotation_summary", oracle("v_detection", "SELECT name AS type, CASE WHEN conf >= 7e-1 THEN 'sure' ELSE 'unsure' END AS category, count(*) AS n FROM v_detection GROUP BY GROUPING SETS ((name), (CASE WHEN conf >= 7e-1 THEN 'sure' ELSE 'unsure' END), ())"))
def a39(spark, sf_dir):
    d = views.detection(spark, sf_dir).select(F.col("name").alias("type"), F.when(F.col("conf") >= 0.7, "sure").otherwise("unsure").alias("category"))
    return d.groupingSets([["type"], ["category"], []], "type", "category").agg(F.count("*").alias("n"))


@register("a40_auto_groups", oracle("v_detection", "SELECT doc_id, name || ':' || round(conf, 1) AS bucket, count(*) AS n FROM v_detection GROUP BY ALL HAVING count(*) >= 2"))
def a40(spark, sf_dir):
    bucket = F.concat_ws(":", "name", F.round("conf", 1).cast("string"))
    return views.detection(spark, sf_dir).groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n")).where("n >= 2")


_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@register("a42_tag_patterns", oracle("v_word", f"""
WITH u AS (SELECT doc_id, translate(tok, '{_LOW}', '{_UP}') AS tok FROM v_word),
t AS (SELECT doc_id, tok, regexp_extract(tok, '^([A-Z]{{2,4}})', 1) AS prefix FROM u WHERE regexp_matches(tok, '^[A-Z]{{2,4}}[0-9.,!?-]*$'))
SELECT prefix, count(*) AS n, count(DISTINCT tok) AS variants, count(DISTINCT doc_id) AS pages, CASE WHEN count(*) >= 3 THEN 'confirmed' ELSE 'possible' END AS verdict FROM t GROUP BY prefix HAVING count(*) >= 2"""))
def a42(spark, sf_dir):
    """Tag-like words by their letter prefix: confirmed with three or more, possible with two."""
    u = views.word(spark, sf_dir).select("doc_id", F.translate("tok", _LOW, _UP).alias("tok"))
    t = u.where(F.col("tok").rlike("^[A-Z]{2,4}[0-9.,!?-]*$")).withColumn("prefix", F.regexp_extract("tok", "^([A-Z]{2,4})", 1))
    g = t.groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct("tok").alias("variants"), F.count_distinct("doc_id").alias("pages"))
    return g.where("n >= 2").withColumn("verdict", F.when(F.col("n") >= 3, "confirmed").otherwise("possible"))


@register("a44_takeoff_summary", oracle("v_detection", """
SELECT doc_id, count(*) FILTER (name = 'grid') AS counted, round(coalesce(sum((maxx - minx) * (maxy - miny)) FILTER (name = 'drawings'), 0e0), 6) AS area,
  round(coalesce(sum(maxx - minx) FILTER (name = 'horizontal_area'), 0e0), 6) AS linear FROM v_detection GROUP BY doc_id"""))
def a44(spark, sf_dir):
    b = Box.of()
    only = lambda name, v: F.round(F.coalesce(F.sum(F.when(F.col("name") == name, v)), F.lit(0.0)), 6)
    return views.detection(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("name") == "grid").alias("counted"), only("drawings", b.area).alias("area"), only("horizontal_area", b.maxx - b.minx).alias("linear"))


@register("a45_line_items", oracle("v_schedule v_detection", """
WITH t AS (SELECT tag, min(p_partkey) AS first_row FROM v_schedule GROUP BY tag), m AS (SELECT 'D-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS tag, doc_id, conf FROM v_detection WHERE name = 'grid')
SELECT t.tag, count(m.doc_id) AS qty, count(DISTINCT m.doc_id) AS pages, CASE WHEN count(m.doc_id) = 0 THEN 'not-found' WHEN min(conf) < 35e-2 THEN 'low' WHEN min(conf) < 7e-1 THEN 'medium' ELSE '' END AS flag
FROM t LEFT JOIN m USING (tag) GROUP BY t.tag"""))
def a45(spark, sf_dir):
    """Quantity, pages and flags of each scheduled tag from its matches."""
    tags = views.schedule(spark, sf_dir).select("tag").distinct()
    m = views.detection(spark, sf_dir).where("name = 'grid'").select(F.concat(F.lit("D-"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")).alias("tag"), "doc_id", "conf")
    g = m.groupBy("tag").agg(F.count("*").alias("q"), F.count_distinct("doc_id").alias("p"), F.min("conf").alias("c"))
    flag = F.when(F.col("q").isNull(), "not-found").when(F.col("c") < 0.35, "low").when(F.col("c") < 0.7, "medium").otherwise("")
    return tags.join(g, "tag", "left").select("tag", F.coalesce("q", F.lit(0)).alias("qty"), F.coalesce("p", F.lit(0)).alias("pages"), flag.alias("flag"))


@register("a50_tier_fallback", oracle("v_detection", """
WITH c AS (SELECT doc_id, det_id, 1 AS tier FROM v_detection WHERE name = 'tables' AND conf >= 8e-1 UNION ALL SELECT doc_id, det_id, 2 FROM v_detection WHERE name = 'grid' AND conf >= 6e-1 UNION ALL SELECT doc_id, det_id, 3 FROM v_detection WHERE name = 'text_box')
SELECT doc_id, tier, count(*) AS n FROM c GROUP BY doc_id, tier QUALIFY tier = min(tier) OVER (PARTITION BY doc_id)"""))
def a50(spark, sf_dir):
    """Schedule candidates of each page from the best source that has any."""
    d = views.detection(spark, sf_dir)
    tier = F.when((F.col("name") == "tables") & (F.col("conf") >= 0.8), 1).when((F.col("name") == "grid") & (F.col("conf") >= 0.6), 2).when(F.col("name") == "text_box", 3)
    n = d.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("doc_id", "tier").agg(F.count("*").alias("n"))
    return n.withColumn("best", F.min("tier").over(W.partitionBy("doc_id"))).where("tier = best").drop("best")


@register("a51_class_coverage", oracle("v_detection v_page", """
SELECT p.project_id, c.name FROM (SELECT DISTINCT project_id FROM v_page) p CROSS JOIN (VALUES ('tables'), ('drawings'), ('north_arrow')) c(name)
WHERE NOT EXISTS (SELECT 1 FROM v_detection d JOIN v_page q ON d.doc_id = q.page_number WHERE q.project_id = p.project_id AND d.name = c.name)"""))
def a51(spark, sf_dir):
    """Required classes that no page of a project has."""
    need = views.project(spark, sf_dir).select("project_id", F.explode(F.array(F.lit("tables"), F.lit("drawings"), F.lit("north_arrow"))).alias("name"))
    p = views.page(spark, sf_dir).select("project_id", F.col("page_number").alias("doc_id"))
    return need.join(views.detection(spark, sf_dir).join(p, "doc_id").select("project_id", "name").distinct(), ["project_id", "name"], "left_anti")


@register("a55_medians", oracle("v_detection", "SELECT name, round(median(conf), 6) AS median_conf, round(median(maxx - minx), 6) AS median_width FROM v_detection GROUP BY name"))
def a55(spark, sf_dir):
    return views.detection(spark, sf_dir).groupBy("name").agg(F.round(F.median("conf"), 6).alias("median_conf"), F.round(F.median(F.col("maxx") - F.col("minx")), 6).alias("median_width"))


@register("a56_detection_hierarchy", oracle("v_detection", """
WITH g AS (SELECT CASE WHEN conf >= 7e-1 THEN 'a' ELSE 'b' END AS model, name, count(*) AS n, round(min(conf), 6) AS least FROM v_detection GROUP BY ALL)
SELECT *, (sum(n) OVER (PARTITION BY model))::BIGINT AS model_total FROM g"""))
def a56(spark, sf_dir):
    n = views.detection(spark, sf_dir).groupBy(F.when(F.col("conf") >= 0.7, "a").otherwise("b").alias("model"), "name").agg(F.count("*").alias("n"), F.round(F.min("conf"), 6).alias("least"))
    return n.withColumn("model_total", F.sum("n").over(W.partitionBy("model")))


@register("o07_page_proposals", oracle("v_detection", "SELECT doc_id, det_id, conf FROM v_detection WHERE conf >= 65e-2 AND name IN ('tables', 'grid') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, det_id) <= 10"))
def o07(spark, sf_dir):
    """Table proposals of each page: probability 0.65 or more, the ten best (the cap is the operator)."""
    d = views.detection(spark, sf_dir).where((F.col("conf") >= 0.65) & F.col("name").isin("tables", "grid"))
    return d.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("conf"), "det_id"))).where("r <= 10").select("doc_id", "det_id", "conf")


@register("o11_area_order", oracle("v_detection", "SELECT doc_id, det_id, row_number() OVER (PARTITION BY doc_id ORDER BY round((maxx - minx) * (maxy - miny), 9) DESC, det_id, name, conf)::INT AS place FROM v_detection WHERE name = 'drawings'"))
def o11(spark, sf_dir):
    order = W.partitionBy("doc_id").orderBy(F.desc(F.round(Box.of().area, 9)), "det_id", "name", "conf")
    return views.detection(spark, sf_dir).where("name = 'drawings'").select("doc_id", "det_id", F.row_number().over(order).alias("place"))


@register("u03_union_sources", oracle("v_detection v_word v_text v_taxonomy v_page_code", "SELECT 'detection' AS source, count(*) AS n FROM v_detection UNION ALL SELECT 'code', count(*) FROM v_page_code UNION ALL SELECT 'word', count(*) FROM v_word"))
def u03(spark, sf_dir):
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "n")
    return n(views.detection(spark, sf_dir), "detection").unionByName(n(views.page_code(spark, sf_dir), "code")).unionByName(n(views.word(spark, sf_dir), "word"))


@register("u05_intersect_pages", oracle("v_page v_detection", "SELECT page_number FROM v_page WHERE starts_with(drawing_number, 'A-') INTERSECT SELECT doc_id FROM v_detection WHERE name = 'tables'"))
def u05(spark, sf_dir):
    p = views.page(spark, sf_dir).where(F.col("drawing_number").startswith("A-")).select("page_number")
    return p.intersect(views.detection(spark, sf_dir).where("name = 'tables'").select(F.col("doc_id").alias("page_number")))


@register("u07_override_merge", "SELECT coalesce(a.n_nationkey, b.s_nationkey) AS id, coalesce(b.v, a.n_name) AS value, b.v IS NOT NULL AS overridden FROM nation a FULL JOIN (SELECT s_nationkey, min(s_name) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) b ON a.n_nationkey = b.s_nationkey")
def u07(spark, sf_dir):
    """Built-in entries overridden by a company's of the same id."""
    own = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("v"))
    j = read(spark, sf_dir, "nation").join(own, F.col("n_nationkey") == F.col("k"), "full")
    return j.select(F.coalesce("n_nationkey", "k").alias("id"), F.coalesce("v", "n_name").alias("value"), F.col("v").isNotNull().alias("overridden"))


@register("x07_significant_words", oracle("v_taxonomy", "SELECT code, len(list_filter(string_split(description, ' '), lambda w: len(w) > 2 AND NOT list_contains(['a','an','the','and','or','of','for','in','on','at','to','by','with','from','as','is','are','was','were','be','been','not','no','all','any','each','other','such','than','that','this','its','per','new'], w)))::INT AS n FROM v_taxonomy"))
def x07(spark, sf_dir):
    return views.taxonomy(spark, sf_dir).select("code", F.size(significant(F.split("description", " "))).alias("n"))
