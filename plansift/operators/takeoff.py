"""Takeoff and table parsing: fuzzy tags, patterns, grids from words, merging of grids, exports and write forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.text import csv_field
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

#: Characters that text recognition confuses.
CONFUSED = {
    "0": "OQD", "O": "0QD", "Q": "0O", "D": "0O", "1": "lI|T", "l": "1I|", "I": "1l|", "5": "S", "S": "5", "6": "G", "G": "6",
    "8": "B", "B": "8", "2": "Z", "Z": "2", "9": "gq", "g": "9q", "q": "9g",
}


CONFUSED_PAIRS = tuple(a + b for a, bs in CONFUSED.items() for b in bs)


def is_fuzzy(a: Column, b: Column) -> Column:
    """Equal, or (both of three characters or more) one confusable substitution or one dropped hyphen apart; null of nulls."""
    pairs = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    one_odd = (F.length(a) == F.length(b)) & (F.size(pairs) == 1) & F.get(pairs, F.lit(0)).isin(*CONFUSED_PAIRS)
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    cut = F.transform(F.split(long, "-"), lambda _, i: F.concat_ws("", F.array_join(F.slice(F.split(long, "-"), 1, i + 1), "-"), F.array_join(F.slice(F.split(long, "-"), i + 2, F.size(F.split(long, "-"))), "-")))
    hyphen = (F.length(long) == F.length(short) + 1) & F.array_contains(F.slice(cut, 1, F.size(cut) - 1), short)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 3) & (one_odd | hyphen))


def blocking_key(tag: Column) -> Column:
    """Equal for all tags that can be fuzzily equal: hyphens dropped, confusable characters as one of them."""
    return F.translate(F.replace(tag, F.lit("-"), F.lit("")), "OQD1lI|TS5G6B8Z2gq9", "0000000055668822999")


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows whose tags are fuzzily equal: an equi-join on the blocking key, then the exact test."""
    keyed = left.withColumn("_k", blocking_key(F.col(a))).join(right.withColumn("_k", blocking_key(F.col(b))), "_k").drop("_k")
    return keyed.where(is_fuzzy(F.col(a), F.col(b)))


@register("p06_fuzzy_tags", oracle("v_word", f"""
WITH t AS (SELECT tok, count(*) AS n FROM v_word WHERE regexp_matches(tok, '^[A-Za-z0-9|-]{{3,12}}$') GROUP BY tok),
v AS (SELECT tok, n, i, tok[i] AS c, tok[:i - 1] || '_' || tok[i + 1:] AS rest, tok[:i - 1] || tok[i + 1:] AS without FROM (SELECT *, unnest(range(1, len(tok) + 1)) AS i FROM t)),
h AS (SELECT DISTINCT v.tok, v.n, t.tok AS other, t.n AS n_other FROM v JOIN t ON v.c = '-' AND v.without = t.tok)
SELECT a.tok, a.n, b.tok AS other, b.n AS n_other FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest WHERE a.tok <> b.tok AND a.c || b.c IN ({", ".join(map(repr, CONFUSED_PAIRS))})
UNION ALL SELECT * FROM h UNION ALL SELECT other, n_other, tok, n FROM h"""))
def p06(spark, sf_dir):
    """Tag-like page words that are fuzzily equal to another page word, with how often each occurs."""
    words = views.word(spark, sf_dir).where(F.col("tok").rlike("^[A-Za-z0-9|-]{3,12}$")).groupBy("tok").agg(F.count("*").alias("n"))
    pairs = fuzzy_join(words, words.select(F.col("tok").alias("other"), F.col("n").alias("n_other")), "tok", "other")
    return pairs.where("tok <> other")


def tag_shape(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(tag, "[A-Z]", "L"), "[0-9]", "d")


@register("a43_tag_shapes", oracle("v_schedule", r"""
WITH s AS (SELECT DISTINCT tag, regexp_replace(regexp_replace(tag, '[A-Z]', 'L', 'g'), '[0-9]', 'd', 'g') AS shape FROM v_schedule),
n AS (SELECT shape, count(*) AS n, min(tag) AS example FROM s GROUP BY shape)
SELECT shape, n, round(n / sum(n) OVER (), 6) AS share, '^' || replace(shape, 'd', '\d') || '$' AS pattern, contains(shape, 'L') AS strong FROM n"""))
def a43(spark, sf_dir):
    """Shapes of the scheduled tags with their share; a shape without a letter is a weak pattern."""
    n = views.schedule(spark, sf_dir).select("tag").distinct().groupBy(tag_shape(F.col("tag")).alias("shape")).agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6)
    pattern = F.concat(F.lit("^"), F.replace("shape", F.lit("d"), F.lit("\\d")), F.lit("$"))
    return n.select("shape", "n", share.alias("share"), pattern.alias("pattern"), F.col("shape").contains("L").alias("strong"))


# --- grids from words ----------------------------------------------------------------------------------------------


def cells(spark, sf_dir) -> DataFrame:
    """The words of each sheet as grid cells: a column is three places of the line wide."""
    w = views.word(spark, sf_dir).select("doc_id", "sheet", F.col("line_idx").alias("row"), F.floor(F.col("idx") % 12 / 3).cast("int").alias("col"), "idx", "tok")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tok"))), lambda x: x["tok"]), " ")
    return w.groupBy("doc_id", "sheet", "row", "col").agg(text.alias("value"))


_CELLS = "c AS (SELECT doc_id, sheet, line_idx AS row, ((idx % 12) // 3)::INT AS col, string_agg(tok, ' ' ORDER BY idx) AS value FROM v_word GROUP BY ALL)"


@register("t08_cells_by_bounds", oracle("v_word", f"WITH {_CELLS} SELECT doc_id, sheet, count(*) AS cells, max(row) - min(row) + 1 AS n_rows, md5(string_agg(value, '|' ORDER BY row, col)) AS digest FROM c GROUP BY ALL"))
def t08(spark, sf_dir):
    """Cell texts of every sheet by half-open bounds, as a digest of the grid."""
    g = cells(spark, sf_dir).groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("x"), (F.max("row") - F.min("row") + 1).alias("n_rows"))
    return g.select("doc_id", "sheet", F.size("x").cast("long").alias("cells"), "n_rows", F.md5(F.array_join(F.transform("x", lambda v: v["value"]), "|").cast("binary")).alias("digest"))


@register("t09_header_rows", oracle("v_word", f"""WITH {_CELLS}, s AS (SELECT doc_id, sheet, row, count(*) FILTER (regexp_matches(value, '^[A-Z]')) AS caps, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, sheet, row, caps FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, sheet ORDER BY caps / n DESC, row) = 1"""))
def t09(spark, sf_dir):
    """The row of a sheet that looks most like a header: cells that start with a capital."""
    s = cells(spark, sf_dir).groupBy("doc_id", "sheet", "row").agg(F.count_if(F.col("value").rlike("^[A-Z]")).alias("caps"), F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("doc_id", "sheet").orderBy(F.desc(F.col("caps") / F.col("n")), "row"))
    return s.withColumn("r", r).where("r = 1").select("doc_id", "sheet", "row", "caps")


@register("t10_tag_columns", oracle("v_word", f"WITH {_CELLS}, s AS (SELECT doc_id, sheet, col, round(avg(CASE WHEN regexp_matches(value, '^[A-Za-z]{{1,6}} ') THEN 1e0 ELSE 0e0 END), 6) AS share FROM c GROUP BY ALL) SELECT doc_id, sheet, col, share FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, sheet ORDER BY share DESC, col) = 1"))
def t10(spark, sf_dir):
    """The column of a sheet whose cells look most like tags."""
    s = cells(spark, sf_dir).groupBy("doc_id", "sheet", "col").agg(F.round(F.avg(F.when(F.col("value").rlike("^[A-Za-z]{1,6} "), 1.0).otherwise(0.0)), 6).alias("share"))
    r = F.row_number().over(W.partitionBy("doc_id", "sheet").orderBy(F.desc("share"), "col"))
    return s.withColumn("r", r).where("r = 1").drop("r")


@register("a53_parse_quality", oracle("v_word", f"WITH {_CELLS}, r AS (SELECT doc_id, sheet, row, count(*) AS n FROM c GROUP BY ALL) SELECT doc_id, sheet, round(sum(n) / (count(*) * 4e0), 6) AS fill, round(avg(CASE WHEN n = 4 THEN 1e0 ELSE 0e0 END), 6) AS consistent FROM r GROUP BY ALL"))
def a53(spark, sf_dir):
    """Fill rate and row consistency of each sheet's grid."""
    r = cells(spark, sf_dir).groupBy("doc_id", "sheet", "row").agg(F.count("*").alias("n"))
    return r.groupBy("doc_id", "sheet").agg(F.round(F.sum("n") / (F.count("*") * 4.0), 6).alias("fill"), F.round(F.avg(F.when(F.col("n") == 4, 1.0).otherwise(0.0)), 6).alias("consistent"))


_GRIDS = """a AS (SELECT p_partkey AS row, 'type' AS col, p_type AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part),
b AS (SELECT row, col, CASE WHEN row % 5 = 0 THEN '' WHEN row % 7 = 0 THEN 'X' || substr(value, 2) ELSE value END AS value FROM a)"""


def _two_grids(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A grid, and the same as another method read it: some cells blank, some with a wrong character."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand")
    a = p.select(F.col("p_partkey").alias("row"), F.inline(F.array(F.struct(F.lit("type").alias("col"), F.col("p_type").alias("value")), F.struct(F.lit("brand").alias("col"), F.col("p_brand").alias("value")))))
    worse = F.when(F.col("row") % 5 == 0, "").when(F.col("row") % 7 == 0, F.concat(F.lit("X"), F.expr("substr(value, 2)"))).otherwise(F.col("value"))
    return a, a.select("row", "col", worse.alias("value"))


@register("t05_grid_merge", f"WITH {_GRIDS} SELECT b.row, b.col, CASE WHEN b.value = '' THEN a.value ELSE b.value END AS value, CASE WHEN b.value = '' THEN 'filled' WHEN a.value = b.value THEN 'agree' WHEN levenshtein(a.value, b.value) <= 2 THEN 'near' ELSE 'disagree' END AS verdict FROM b JOIN a ON a.row = b.row AND a.col = b.col")
def t05(spark, sf_dir):
    """Cells of a base grid filled from another, with their agreement."""
    a, b = _two_grids(spark, sf_dir)
    j = b.join(a.withColumnRenamed("value", "other"), ["row", "col"])
    verdict = F.when(F.col("value") == "", "filled").when(F.col("value") == F.col("other"), "agree").when(F.levenshtein("value", "other") <= 2, "near").otherwise("disagree")
    return j.select("row", "col", F.when(F.col("value") == "", F.col("other")).otherwise(F.col("value")).alias("value"), verdict.alias("verdict"))


@register("a54_agreement_rate", f"WITH {_GRIDS} SELECT b.col, round(avg(CASE WHEN b.value = '' THEN 5e-1 WHEN a.value = b.value THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) AS cells FROM b JOIN a ON a.row = b.row AND a.col = b.col GROUP BY b.col")
def a54(spark, sf_dir):
    a, b = _two_grids(spark, sf_dir)
    j = b.join(a.withColumnRenamed("value", "other"), ["row", "col"])
    agree = F.when(F.col("value") == "", 0.5).when(F.col("value") == F.col("other"), 1.0).otherwise(0.0)
    return j.groupBy("col").agg(F.round(F.avg(agree), 6).alias("rate"), F.count("*").alias("cells"))


@register("x09_levenshtein", "SELECT c_mktsegment, count(*) FILTER (levenshtein(c_name, 'Customer#000000001') <= 2) AS near, count(*) AS n FROM customer GROUP BY c_mktsegment")
def x09(spark, sf_dir):
    near = F.levenshtein("c_name", F.lit("Customer#000000001")) <= 2
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(near).alias("near"), F.count("*").alias("n"))


@register("w06_anchored_rows")
def w06(spark, sf_dir):
    """Rows of boxes down a page: a new row where the distance to the row's first box exceeds 0.006.

    The anchor makes it order-dependent; pages come sorted and a page's state is carried from batch to batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, anchor, row = None, 0.0, -1
        for b in batches:
            out = []
            for d, y in zip(b["doc_id"], b["miny"], strict=True):
                if d != doc:
                    doc, anchor, row = d, y, 0
                elif abs(y - anchor) > 0.006:
                    anchor, row = y, row + 1
                out.append(row)
            yield pd.DataFrame({"doc_id": b["doc_id"], "det_id": b["det_id"], "row": out})

    d = views.detection(spark, sf_dir).select("doc_id", "det_id", "miny")
    return d.repartition("doc_id").sortWithinPartitions("doc_id", "miny", "det_id").mapInPandas(run, "doc_id long, det_id string, row long")


# --- write forms ---------------------------------------------------------------------------------------------------


@register("k01_upsert_pages", "SELECT o_custkey AS page, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY o_custkey")
def k01(spark, sf_dir):
    """Of rows with one key the newest stays."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"))


@register("k03_replace_by_model", "SELECT l_linenumber AS model, count(*) AS n FROM (SELECT l_linenumber FROM lineitem WHERE l_linenumber <> 3 UNION ALL SELECT 3 FROM orders) GROUP BY l_linenumber")
def k03(spark, sf_dir):
    """The rows of one model replaced by new ones."""
    old = read(spark, sf_dir, "lineitem", "l_linenumber").where("l_linenumber <> 3").select(F.col("l_linenumber").cast("int").alias("model"))
    return old.unionAll(read(spark, sf_dir, "orders").select(F.lit(3).alias("model"))).groupBy("model").agg(F.count("*").alias("n"))


@register("k04_purge", "SELECT count(*) AS kept FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def k04(spark, sf_dir):
    gone = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").agg(F.count("*").alias("kept"))


@register("k08_csv_rows", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[",\\n\\r]') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || CASE WHEN regexp_matches(p_type, '[",\\n\\r]') THEN '"' || replace(p_type, '"', '""') || '"' ELSE p_type END AS line FROM part""")
def k08(spark, sf_dir):
    """Rows as quoted CSV lines."""
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", csv_field(F.col("p_name")), csv_field(F.col("p_type"))).alias("line"))


@register("k13_append_note", "SELECT c_custkey, CASE WHEN trim(c_mktsegment) = '' THEN 'checked' ELSE c_mktsegment || chr(10) || 'checked' END AS note FROM customer")
def k13(spark, sf_dir):
    note = F.when(F.trim("c_mktsegment") == "", "checked").otherwise(F.concat_ws("\n", "c_mktsegment", F.lit("checked")))
    return read(spark, sf_dir, "customer").select("c_custkey", note.alias("note"))


@register("k15_next_order", "SELECT n_nationkey, coalesce(max(c_custkey), -1) + 1 AS next FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def k15(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_custkey").alias("m"))
    return read(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_nationkey", (F.coalesce("m", F.lit(-1)) + 1).alias("next"))


@register("k12_history", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM orders QUALIFY place <= 5")
def k12(spark, sf_dir):
    """A ring buffer of the five newest entries of each key (the cap is the operator)."""
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return read(spark, sf_dir, "orders").withColumn("place", r).where("place <= 5").select("o_custkey", "o_orderkey", "place")


@register("k10_takeoff_export", oracle("v_detection", """
SELECT name AS item, 'count' AS kind, count(*)::DOUBLE AS quantity, 'ea' AS unit FROM v_detection GROUP BY name UNION ALL
SELECT name, 'area', round(sum((maxx - minx) * (maxy - miny)), 6), 'sq' FROM v_detection GROUP BY name UNION ALL SELECT name, 'linear', round(sum(maxx - minx), 6), 'len' FROM v_detection GROUP BY name"""))
def k10(spark, sf_dir):
    """Count, area and length of each item as export rows."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    g = views.detection(spark, sf_dir).groupBy(F.col("name").alias("item")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum(w * h), 6).alias("a"), F.round(F.sum(w), 6).alias("l"))
    return g.selectExpr("item", "stack(3, 'count', n, 'ea', 'area', a, 'sq', 'linear', l, 'len') AS (kind, quantity, unit)")


@register("x03_drawing_numbers", oracle("v_page", "SELECT regexp_extract(drawing_number, '^([A-Z]{1,4})-?([0-9]{1,4})', 1) AS prefix, min(regexp_extract(drawing_number, '^([A-Z]{1,4})-?([0-9]{1,4})', 2)) AS lo, count(*) AS n FROM v_page GROUP BY 1"))
def x03(spark, sf_dir):
    from plansift.functions.text import DRAWING_NUMBER

    part = lambda k: F.regexp_extract("drawing_number", DRAWING_NUMBER, k)
    return views.page(spark, sf_dir).groupBy(part(1).alias("prefix")).agg(F.min(part(2)).alias("lo"), F.count("*").alias("n"))


@register("x16_shape_areas", oracle("v_detection", "SELECT name, round(sum(abs((maxx - minx) * (maxy - miny))), 6) AS area, round(sum(2 * (maxx - minx) + (maxy - miny)), 6) AS length FROM v_detection GROUP BY name"))
def x16(spark, sf_dir):
    """Shoelace areas and open-path lengths of the boxes as four-point shapes."""
    from plansift.functions.geometry import polygon_area, polyline_length

    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    shape = F.array(pt("minx", "miny"), pt("maxx", "miny"), pt("maxx", "maxy"), pt("minx", "maxy"))
    s = views.detection(spark, sf_dir).select("name", shape.alias("s"))
    return s.groupBy("name").agg(F.round(F.sum(polygon_area(F.col("s"))), 6).alias("area"), F.round(F.sum(polyline_length(F.col("s"))), 6).alias("length"))
