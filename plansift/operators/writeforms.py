"""What the writers of ``sources`` put down, as queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plansift.functions.text import csv_field
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle
from plansift.sources.writers import merged_map, updated_json

_MARKERS = """m AS (SELECT o_orderkey, 'item' || (o_custkey % 20) AS item, 'old ' || o_orderstatus AS name FROM orders)"""


@register("k05_renamed_markers", f"WITH {_MARKERS} SELECT o_orderkey, item, CASE WHEN item = 'item7' THEN 'new name' ELSE name END AS name FROM m")
def k05(spark, sf_dir):
    """Markers as JSON: those of one takeoff item get a new name."""
    o = views.read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    item, name = F.concat(F.lit("item"), (F.col("o_custkey") % 20).cast("string")), F.concat(F.lit("old "), "o_orderstatus")
    data = o.select("o_orderkey", F.to_json(F.struct(item.alias("takeoffItemId"), name.alias("name"))).alias("data"))
    new = data.withColumn("data", updated_json(F.col("data"), "takeoffItemId", "item7", {"name": "new name"}))
    return new.select("o_orderkey", F.get_json_object("data", "$.takeoffItemId").alias("item"), F.get_json_object("data", "$.name").alias("name"))


@register("k06_merged_objects", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'none' END AS type, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS size FROM part")
def k06(spark, sf_dir):
    """Objects merged key by key: what comes in wins."""
    p = views.read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    old = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.lit("none"))
    new = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")))
    m = p.select("p_partkey", merged_map(old, new).alias("m"))
    return m.select("p_partkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("brand", "type", "size")))


@register("k07_promoted_regions", oracle("v_detection v_page_code", """
WITH c AS (SELECT doc_id, list_sort(list(DISTINCT code)) AS codes FROM v_page_code GROUP BY 1), r AS (SELECT DISTINCT doc_id, det_id FROM v_detection WHERE name = 'tables' AND conf >= 9e-1)
SELECT r.doc_id, r.det_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(codes, []), ['promoted']))), ';') AS codes FROM r LEFT JOIN c USING (doc_id)"""))
def k07(spark, sf_dir):
    """Regions that become user regions, with the page's codes merged into theirs."""
    codes = views.page_code(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))  # one page's codes
    r = views.detection(spark, sf_dir).where("name = 'tables' AND conf >= 9e-1").select("doc_id", "det_id").distinct()
    merged = F.array_union(F.coalesce("codes", F.array().cast("array<string>")), F.array(F.lit("promoted")))
    return r.join(codes, "doc_id", "left").select("doc_id", "det_id", F.array_join(F.array_sort(merged), ";").alias("codes"))


@register("k09_table_sections", """
WITH x AS (SELECT p_brand, p_partkey, p_type || ',' || p_size AS line FROM part), u AS (
SELECT p_brand, 0 AS part, 0 AS k, '# ' || p_brand || ' (Page ' || min(p_partkey) || ')' AS line FROM x GROUP BY p_brand UNION ALL SELECT p_brand, 1, p_partkey, line FROM x UNION ALL SELECT DISTINCT p_brand, 2, 0, '' FROM x)
SELECT p_brand, part::INT AS part, k::BIGINT AS k, line FROM u""")
def k09(spark, sf_dir):
    """Lines of a text of several tables: a heading, the rows, an empty line; ordered by table, part and key."""
    p = views.read(spark, sf_dir, "part", "p_brand", "p_partkey", "p_type", "p_size")
    line = lambda part, k, text: ["p_brand", F.lit(part).alias("part"), k.cast("long").alias("k"), text.alias("line")]
    head = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first")).select(*line(0, F.lit(0), F.concat(F.lit("# "), "p_brand", F.lit(" (Page "), F.col("first").cast("string"), F.lit(")"))))
    rows = p.select(*line(1, F.col("p_partkey"), F.concat_ws(",", csv_field(F.col("p_type")), F.col("p_size").cast("string"))))
    return head.unionAll(rows).unionAll(p.select("p_brand").distinct().select(*line(2, F.lit(0), F.lit(""))))


@register("k11_takeoff_lines", oracle("v_schedule", """
WITH a AS (SELECT tag, count(*) AS auto, min(p_type) AS spec, string_agg(DISTINCT p_size::VARCHAR, ' ' ORDER BY p_size::VARCHAR) AS pages FROM v_schedule GROUP BY tag), o AS (SELECT tag, max(p_size) AS qty FROM v_schedule WHERE p_partkey % 10 = 0 GROUP BY tag)
SELECT tag || ',' || spec || ',' || coalesce(qty, auto) || ',' || pages || ',' || CASE WHEN qty IS NOT NULL THEN 'override' ELSE '' END AS line FROM a LEFT JOIN o USING (tag)"""))
def k11(spark, sf_dir):
    """CSV lines of a takeoff: tag, spec, quantity (set by hand, else counted), pages and flag."""
    s = views.schedule(spark, sf_dir)
    size = F.col("p_size").cast("string")
    a = s.groupBy("tag").agg(F.count("*").alias("auto"), F.min("p_type").alias("spec"), F.array_join(F.array_sort(F.collect_set(size)), " ").alias("pages"))
    o = s.where(F.col("p_partkey") % 10 == 0).groupBy("tag").agg(F.max("p_size").alias("qty"))
    parts = [csv_field(F.col("tag")), csv_field(F.col("spec")), F.coalesce("qty", "auto").cast("string"), F.col("pages"), F.when(F.col("qty").isNotNull(), "override").otherwise("")]
    return a.join(o, "tag", "left").select(F.concat_ws(",", *parts).alias("line"))
