"""Tables and notes from the positions of words: rows, columns, cells, headers, grids, reading order and note blocks.

Rows and columns are runs of positions without a large gap, found by windows over one region's distinct positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.operators.spatial import points_in_boxes
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle

ROW_GAP, COLUMN_GAP = 0.01, 0.04
HEADERS = ("the", "and", "of", "der", "die", "les", "los", "que")


def table_words(spark, sf_dir) -> DataFrame:
    """Words inside table regions, with their positions; a region stands on every sheet of its document."""
    w = views.word(spark, sf_dir).select("doc_id", "sheet", "idx", "tok", "l", "t", (F.col("l") + F.col("w") / 2).alias("cx"), (F.col("t") + F.col("h") / 2).alias("cy"))
    boxes = views.detection(spark, sf_dir).where("name = 'tables'").select("doc_id", "det_id", "minx", "miny", "maxx", "maxy").distinct()
    region = F.concat_ws("/", "det_id", F.round("minx", 4).cast("string"), F.round("miny", 4).cast("string"), F.round("maxx", 4).cast("string"), F.round("maxy", 4).cast("string"), F.col("sheet").cast("string"))
    return points_in_boxes(w, boxes, F.col("cx"), F.col("cy")).select("doc_id", region.alias("region"), "det_id", "idx", "tok", F.round("l", 6).alias("l"), F.round("t", 6).alias("t"))


def clustered(words: DataFrame, at: str, gap: float, name: str) -> DataFrame:
    """The number (from 0) of each word's run of positions: a new one begins after a gap."""
    order = W.partitionBy("doc_id", "region").orderBy(at)  # the words of one region
    new = (F.round(F.col(at) - F.lag(at).over(order), 6) > gap).cast("int")
    return words.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("_n").over(order).cast("int")).drop("_n")


def cells(spark, sf_dir) -> DataFrame:
    w = clustered(clustered(table_words(spark, sf_dir), "t", ROW_GAP, "row"), "l", COLUMN_GAP, "col")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tok"))), lambda x: x["tok"]), " ")  # the words of one cell
    return w.groupBy("doc_id", "region", "row", "col").agg(text.alias("text"), F.count("*").alias("n"))


_TABLES = f"""b AS (SELECT DISTINCT doc_id, det_id, minx, miny, maxx, maxy FROM v_detection WHERE name = 'tables'),
tw AS (SELECT b.doc_id, b.det_id, dense_rank() OVER (ORDER BY b.det_id, minx, miny, maxx, maxy, v.sheet) AS region, v.idx, v.tok, round(v.l, 6) AS l, round(v.t, 6) AS t FROM b JOIN v_word v ON v.doc_id = b.doc_id
  AND v.l + v.w / 2 BETWEEN b.minx AND b.maxx AND v.t + v.h / 2 BETWEEN b.miny AND b.maxy),
rp AS (SELECT region, t, sum(coalesce((round(t - before, 6) > {ROW_GAP})::INT, 0)) OVER (PARTITION BY region ORDER BY t)::INT AS row FROM (SELECT region, t, lag(t) OVER (PARTITION BY region ORDER BY t) AS before FROM (SELECT DISTINCT region, t FROM tw))),
cp AS (SELECT region, l, sum(coalesce((round(l - before, 6) > {COLUMN_GAP})::INT, 0)) OVER (PARTITION BY region ORDER BY l)::INT AS col FROM (SELECT region, l, lag(l) OVER (PARTITION BY region ORDER BY l) AS before FROM (SELECT DISTINCT region, l FROM tw))),
cells AS (SELECT doc_id, region, row, col, string_agg(tok, ' ' ORDER BY idx) AS text, count(*) AS n FROM tw JOIN rp USING (region, t) JOIN cp USING (region, l) GROUP BY ALL)"""
_V = "v_word v_detection"


@register("t01_position_cells", oracle(_V, f"WITH {_TABLES} SELECT doc_id, row, col, text, n FROM cells"))
def t01(spark, sf_dir):
    """The cells of each table region: words in runs of rows and columns."""
    return cells(spark, sf_dir).select("doc_id", "row", "col", "text", "n")


_SHAPE = "s AS (SELECT region, doc_id, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, count(*) AS filled FROM cells GROUP BY ALL)"


@register("t06_table_confidence", oracle(_V, f"""
WITH {_TABLES}, {_SHAPE}, g AS (SELECT region, avg(CASE WHEN regexp_matches(text, '^[A-Z0-9]') THEN 1e0 ELSE 0e0 END) AS led FROM cells WHERE col = 0 GROUP BY region)
SELECT doc_id, n_rows::INT AS n_rows, n_cols::INT AS n_cols, round(6e-1 * filled / (n_rows * n_cols) + 4e-1 * coalesce(led, 0e0), 6) AS confidence FROM s LEFT JOIN g USING (region)"""))
def t06(spark, sf_dir):
    """Rows, columns and confidence of each table: how many cells are filled, and how many rows begin like a tag."""
    c = cells(spark, sf_dir)
    led = F.avg(F.when(F.col("col") == 0, F.when(F.col("text").rlike("^[A-Z0-9]"), 1.0).otherwise(0.0)))
    s = c.groupBy("region", "doc_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("*").alias("filled"), led.alias("led"))
    return s.select("doc_id", "n_rows", "n_cols", F.round(0.6 * F.col("filled") / (F.col("n_rows") * F.col("n_cols")) + 0.4 * F.coalesce("led", F.lit(0.0)), 6).alias("confidence"))


@register("t07_grid_lines", oracle(_V, f"""
WITH {_TABLES}, e AS (SELECT region, doc_id, col, min(l) AS lo, max(l) + 7e-2 AS hi FROM tw JOIN cp USING (region, l) GROUP BY ALL)
SELECT doc_id, col, round((hi + lead(lo) OVER (PARTITION BY region ORDER BY col)) / 2, 6) AS line FROM e QUALIFY lead(lo) OVER (PARTITION BY region ORDER BY col) IS NOT NULL"""))
def t07(spark, sf_dir):
    """Proposed lines between columns: the middle of the gap after each column but the last."""
    w = clustered(table_words(spark, sf_dir), "l", COLUMN_GAP, "col")
    e = w.groupBy("region", "doc_id", "col").agg(F.min("l").alias("lo"), (F.max("l") + F.lit(0.07)).alias("hi"))
    after = F.lead("lo").over(W.partitionBy("doc_id", "region").orderBy("col"))
    return e.withColumn("after", after).where("after IS NOT NULL").select("doc_id", "col", F.round((F.col("hi") + F.col("after")) / 2, 6).alias("line"))


@register("x12_header_rows", oracle(_V, f"""
WITH {_TABLES}, k AS (SELECT region, doc_id, row, count(*) FILTER (len(list_filter(string_split(lower(text), ' '), lambda w: w IN {HEADERS})) > 0) AS known, count(*) FILTER (NOT regexp_matches(text, '[0-9a-z]')) AS caps, count(*) AS n FROM cells WHERE row < 3 GROUP BY ALL)
SELECT doc_id, row, known, CASE WHEN known > 0 THEN 'keywords' ELSE 'capitals' END AS way FROM k WHERE known > 0 OR caps = n QUALIFY row_number() OVER (PARTITION BY region ORDER BY known DESC, row) = 1"""))
def x12(spark, sf_dir):
    """The header among a table's first three rows: that with most cells of known words, else one in capitals."""
    has = F.exists(F.split(F.lower("text"), " "), lambda w: w.isin(*HEADERS))
    k = cells(spark, sf_dir).where("row < 3").groupBy("region", "doc_id", "row").agg(F.count_if(has).alias("known"), F.count_if(~F.col("text").rlike("[0-9a-z]")).alias("caps"), F.count("*").alias("n"))
    best = k.where("known > 0 OR caps = n").groupBy("region", "doc_id").agg(F.min(F.struct((-F.col("known")).alias("loss"), "row")).alias("b"))
    return best.select("doc_id", "b.row", (-F.col("b.loss")).alias("known"), F.when(F.col("b.loss") < 0, "keywords").otherwise("capitals").alias("way"))


@register("t02_clipped_cells", oracle(_V, f"""
WITH {_TABLES}, c AS (SELECT doc_id, region, row, col, text, count(*) OVER (PARTITION BY region, row) AS most FROM cells WHERE col <= 2)
SELECT doc_id, (dense_rank() OVER (PARTITION BY region ORDER BY row) - 1)::INT AS row, col, text FROM c WHERE most > 1"""))
def t02(spark, sf_dir):
    """Cells clipped to a region's first three columns, without rows of single cells, numbered anew."""
    c = cells(spark, sf_dir).where("col <= 2")
    kept = c.withColumn("most", F.count("*").over(W.partitionBy("doc_id", "region", "row"))).where("most > 1")
    return kept.select("doc_id", (F.dense_rank().over(W.partitionBy("doc_id", "region").orderBy("row")) - 1).alias("row"), "col", "text")


@register("w22_reading_text", oracle("v_word", """
WITH r AS (SELECT doc_id, sheet, round(t / 2e-2)::INT AS band, string_agg(tok, ' ' ORDER BY l, idx) AS line FROM v_word GROUP BY ALL)
SELECT doc_id, sheet, md5(string_agg(line, chr(10) ORDER BY band)) AS digest, count(*) AS lines FROM r GROUP BY ALL"""))
def w22(spark, sf_dir):
    """Words in reading order, by bands of height and then from left to right, as lines of text (here their digest)."""
    w = views.word(spark, sf_dir).withColumn("band", F.round(F.col("t") / F.lit(2e-2)).cast("int"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "idx", "tok"))), lambda x: x["tok"]), " ")
    r = w.groupBy("doc_id", "sheet", "band").agg(line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "line"))), lambda x: x["line"]), "\n")  # a sheet has sixty lines
    return r.groupBy("doc_id", "sheet").agg(F.md5(text.cast("binary")).alias("digest"), F.count("*").alias("lines"))


@register("w14_note_blocks", oracle("v_line", """
WITH k AS (SELECT doc_id, sheet, line_idx, CASE WHEN regexp_matches(text, '[.!?]$') THEN 'end' WHEN regexp_matches(text, '^[A-Z]') THEN 'start' ELSE 'more' END AS kind FROM v_line),
g AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY doc_id ORDER BY line_idx) AS note FROM k)
SELECT doc_id, note::BIGINT AS note, count(*) AS n_lines, min(line_idx) AS first_line FROM g WHERE note > 0 GROUP BY ALL HAVING count(*) >= 2"""))
def w14(spark, sf_dir):
    """Notes: a line that begins one and those that go on with it; of two lines or more."""
    k = F.when(F.col("text").rlike("[.!?]$"), "end").when(F.col("text").rlike("^[A-Z]"), "start").otherwise("more")
    n = views.line(spark, sf_dir).select("doc_id", "line_idx", (k == "start").cast("int").alias("new"))
    g = n.withColumn("note", F.sum("new").over(W.partitionBy("doc_id").orderBy("line_idx")))
    return g.where("note > 0").groupBy("doc_id", "note").agg(F.count("*").alias("n_lines"), F.min("line_idx").alias("first_line")).where("n_lines >= 2")


@register("w13_gap_split", oracle("v_word", """
WITH w AS (SELECT doc_id, sheet, line_idx, idx, tok, l + len(tok) % 6 * 1e-2 AS right_edge, l FROM v_word),
g AS (SELECT *, round(lead(l) OVER p - right_edge, 6) AS gap, round(max(right_edge) OVER q - min(l) OVER q, 6) AS width FROM w WINDOW p AS (PARTITION BY doc_id, line_idx ORDER BY idx), q AS (PARTITION BY doc_id, line_idx)),
b AS (SELECT doc_id, line_idx, arg_min(idx, (-gap, idx)) AS cut, max(gap) AS gap, max(width) AS width FROM g WHERE gap IS NOT NULL GROUP BY ALL)
SELECT doc_id, line_idx, cut, gap FROM b WHERE gap > round(5e-2 * width, 6)"""))
def w13(spark, sf_dir):
    """Lines split into key and value at their largest gap between words, if it is over 5 % of the line's width."""
    w = views.word(spark, sf_dir).select("doc_id", "line_idx", "idx", "l", (F.col("l") + F.char_length("tok") % 6 * F.lit(1e-2)).alias("right_edge"))
    line = W.partitionBy("doc_id", "line_idx")  # twelve words
    g = w.withColumn("gap", F.round(F.lead("l").over(line.orderBy("idx")) - F.col("right_edge"), 6)).where("gap IS NOT NULL")
    width = w.groupBy("doc_id", "line_idx").agg(F.round(F.max("right_edge") - F.min("l"), 6).alias("width"))
    b = g.groupBy("doc_id", "line_idx").agg(F.min(F.struct((-F.col("gap")).alias("loss"), "idx")).alias("b")).join(width, ["doc_id", "line_idx"])
    return b.select("doc_id", "line_idx", F.col("b.idx").alias("cut"), (-F.col("b.loss")).alias("gap"), "width").where(F.col("gap") > F.round(0.05 * F.col("width"), 6)).drop("width")


@register("w11_letter_guard", oracle("v_line", """
WITH k AS (SELECT doc_id, line_idx, ascii(text) AS c FROM v_line WHERE regexp_matches(text, '^[A-Z]')), s AS (SELECT *, c - lag(c) OVER (PARTITION BY doc_id ORDER BY line_idx) AS step FROM k),
g AS (SELECT doc_id, count(*) AS keys, count(*) FILTER (step IS NOT NULL AND step NOT BETWEEN 1 AND 2) AS breaks FROM s GROUP BY doc_id)
SELECT doc_id, keys, breaks, keys >= 2 AND breaks * 4 <= keys AS coherent FROM g"""))
def w11(spark, sf_dir):
    """Whether a page's letter keys go on by one or two, with a quarter of breaks at most."""
    k = views.line(spark, sf_dir).where(F.col("text").rlike("^[A-Z]")).select("doc_id", "line_idx", F.ascii("text").alias("c"))
    step = F.col("c") - F.lag("c").over(W.partitionBy("doc_id").orderBy("line_idx"))
    g = k.withColumn("step", step).groupBy("doc_id").agg(F.count("*").alias("keys"), F.count_if(F.col("step").isNotNull() & ~F.col("step").between(1, 2)).alias("breaks"))
    return g.withColumn("coherent", (F.col("keys") >= 2) & (F.col("breaks") * 4 <= F.col("keys")))


@register("j15_keynote_keys", oracle("v_schedule", """
WITH k AS (SELECT tag AS key, min(p_partkey) AS pos FROM v_schedule GROUP BY tag), d AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ' ' || lower(tag) || ' ' WHEN p_size % 4 = 1 THEN replace(tag, '-0', '-O') ELSE replace(tag, '-', '') END AS text FROM v_schedule),
n AS (SELECT p_partkey, upper(trim(text)) AS text FROM d), e AS (SELECT n.p_partkey, k.key FROM n JOIN k ON n.text = k.key),
f AS (SELECT n.p_partkey, k.key, k.pos FROM n JOIN k ON replace(replace(n.text, '-', ''), 'O', '0') = replace(replace(k.key, '-', ''), 'O', '0') WHERE n.p_partkey NOT IN (SELECT p_partkey FROM e))
SELECT p_partkey, key, 'exact' AS way FROM e UNION ALL SELECT p_partkey, arg_min(key, (pos, key)), 'fuzzy' FROM f GROUP BY p_partkey"""))
def j15(spark, sf_dir):
    """Texts of detections to keynote keys: equal after trimming and upper case, else the first key that is alike but for
    hyphens and the letter O for a zero."""
    s, size = views.schedule(spark, sf_dir), F.col("p_size") % 4
    keys = s.groupBy(F.col("tag").alias("key")).agg(F.min("p_partkey").alias("at"))
    text = F.when(size == 0, F.concat(F.lit(" "), F.lower("tag"), F.lit(" "))).when(size == 1, F.replace("tag", F.lit("-0"), F.lit("-O"))).otherwise(F.replace("tag", F.lit("-"), F.lit("")))
    n = s.select("p_partkey", F.upper(F.trim(text)).alias("text"))
    exact = n.join(keys, n.text == keys.key).select("p_partkey", "key", F.lit("exact").alias("way"))
    plain = lambda c: F.translate(c, "O-", "0")
    rest = n.join(exact, "p_partkey", "left_anti").withColumn("form", plain("text"))
    fuzzy = rest.join(keys.withColumn("form", plain("key")), "form").groupBy("p_partkey").agg(F.min_by("key", F.struct("at", "key")).alias("key"))
    return exact.unionByName(fuzzy.withColumn("way", F.lit("fuzzy")))


@register("j29_annotation_codes", oracle("v_word v_taxonomy v_schedule", """
WITH a AS (SELECT p_partkey, p_type AS text, CASE WHEN p_size % 10 = 0 THEN (SELECT min(code) FROM v_taxonomy) END AS own, (ARRAY['Architectural', 'Structural', 'Mechanical', 'Electrical', 'Plumbing', 'Civil'])[p_partkey % 6 + 1] AS trade FROM v_schedule),
w AS (SELECT p_partkey, lower(unnest(string_split(text, ' '))) AS w FROM a), c AS (SELECT code, unnest(string_split(description, ' ')) AS w, len(string_split(description, ' ')) AS n FROM v_taxonomy),
m AS (SELECT p_partkey, code, count(DISTINCT w) AS k, min(n) AS n FROM (SELECT DISTINCT * FROM w) JOIN c USING (w) GROUP BY ALL HAVING count(DISTINCT w) >= ceil(min(n) * 5e-1)), o AS (SELECT p_partkey, min(code) AS code FROM m GROUP BY 1), t AS (SELECT trade, min(code) AS code FROM v_taxonomy GROUP BY 1)
SELECT a.p_partkey, coalesce(a.own, o.code, t.code) AS code, CASE WHEN a.own IS NOT NULL THEN 'own' WHEN o.code IS NOT NULL THEN 'words' WHEN t.code IS NOT NULL THEN 'trade' END AS way FROM a LEFT JOIN o USING (p_partkey) LEFT JOIN t USING (trade)"""))
def j29(spark, sf_dir):
    """The code of an annotation: its own, else one that shares half its description's words, else one of its trade."""
    codes = views.taxonomy(spark, sf_dir)
    s = views.schedule(spark, sf_dir)
    least = codes.agg(F.min("code").alias("least"))
    a = s.crossJoin(F.broadcast(least)).select(  # one row
        "p_partkey", "p_type", F.when(F.col("p_size") % 10 == 0, F.col("least")).alias("own"), views.pick(views.TRADES, F.col("p_partkey")).alias("trade"))
    words = a.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("w"))
    split = F.split("description", " ")
    of = codes.select("code", F.size(split).alias("n"), F.explode(F.array_distinct(split)).alias("w"))
    met = words.join(of, "w").groupBy("p_partkey", "code", "n").agg(F.count("*").alias("k")).where(F.col("k") >= F.ceil(F.col("n") * 0.5))
    o, t = met.groupBy("p_partkey").agg(F.min("code").alias("by_words")), codes.groupBy("trade").agg(F.min("code").alias("by_trade"))
    j = a.join(o, "p_partkey", "left").join(t, "trade", "left")
    way = F.when(F.col("own").isNotNull(), "own").when(F.col("by_words").isNotNull(), "words").when(F.col("by_trade").isNotNull(), "trade")
    return j.select("p_partkey", F.coalesce("own", "by_words", "by_trade").alias("code"), way.alias("way"))


@register("j24_schedule_tags", oracle("v_schedule v_word", """
WITH t AS (SELECT DISTINCT tag FROM v_schedule WHERE p_size > 20), s AS (SELECT p_partkey, tag, p_type FROM v_schedule)
SELECT s.p_partkey, s.tag, t.tag IS NOT NULL AS placed FROM s LEFT JOIN t ON upper(trim(s.tag)) = upper(trim(t.tag))"""))
def j24(spark, sf_dir):
    """Rows of a schedule with whether their tag is placed on any page (here: the tags of large parts)."""
    s = views.schedule(spark, sf_dir)
    placed = s.where("p_size > 20").select(F.upper(F.trim("tag")).alias("key")).distinct().withColumn("placed", F.lit(True))
    j = s.withColumn("key", F.upper(F.trim("tag"))).join(placed, "key", "left")
    return j.select("p_partkey", "tag", F.coalesce("placed", F.lit(False)).alias("placed"))


@register("t11_note_forms", oracle("v_line", """
WITH c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '^[0-9]+[.)]')) AS numbered, count(*) FILTER (regexp_matches(text, '^[A-Z][a-z]?[.,)]? ')) AS lettered, count(*) FILTER (regexp_matches(text, '[.:]$')) AS sections, count(*) FILTER (regexp_matches(text, '^[^ ]+: ')) AS pairs FROM v_line GROUP BY doc_id)
SELECT doc_id, CASE WHEN numbered >= 2 THEN 'numbered' WHEN lettered >= 2 AND lettered * 5 >= n THEN 'lettered' WHEN sections >= 2 THEN 'sections' WHEN pairs >= 2 THEN 'key-value' ELSE 'plain' END AS form, n FROM c"""))
def t11(spark, sf_dir):
    """The form in which a page's notes are read: numbered, lettered, by sections or key and value; the first that fits."""
    has = lambda p: F.count_if(F.col("text").rlike(p))
    c = views.line(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), has(r"^[0-9]+[.)]").alias("numbered"), has("^[A-Z][a-z]?[.,)]? ").alias("lettered"), has("[.:]$").alias("sections"), has("^[^ ]+: ").alias("pairs"))
    form = F.when(F.col("numbered") >= 2, "numbered").when((F.col("lettered") >= 2) & (F.col("lettered") * 5 >= F.col("n")), "lettered").when(F.col("sections") >= 2, "sections").when(F.col("pairs") >= 2, "key-value")
    return c.select("doc_id", F.coalesce(form, F.lit("plain")).alias("form"), "n")


@register("t14_text_extents", oracle(_V, """
SELECT d.doc_id, d.det_id, count(DISTINCT v.line_idx) AS n_lines, count(DISTINCT v.idx) AS n_words, round(min(v.l), 6) AS minx, round(min(v.t), 6) AS miny, round(max(v.l + v.w), 6) AS maxx, round(max(v.t + v.h), 6) AS maxy
FROM (SELECT DISTINCT doc_id, det_id, minx, miny, maxx, maxy FROM v_detection WHERE name = 'text_box') d JOIN v_word v ON v.doc_id = d.doc_id AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND d.maxy GROUP BY d.doc_id, d.det_id"""))
def t14(spark, sf_dir):
    """What the words in a region cover: lines, words and their common box."""
    w = views.word(spark, sf_dir).select("doc_id", "idx", "line_idx", "l", "t", "w", "h", (F.col("l") + F.col("w") / 2).alias("cx"), (F.col("t") + F.col("h") / 2).alias("cy"))
    boxes = views.detection(spark, sf_dir).where("name = 'text_box'").select("doc_id", "det_id", "minx", "miny", "maxx", "maxy").distinct()
    hits = points_in_boxes(w, boxes, F.col("cx"), F.col("cy"))
    edge = lambda f, c, name: F.round(f(c), 6).alias(name)
    return hits.groupBy("doc_id", "det_id").agg(
        F.count_distinct("line_idx").alias("n_lines"), F.count_distinct("idx").alias("n_words"), edge(F.min, F.col("l"), "minx"), edge(F.min, F.col("t"), "miny"), edge(F.max, F.col("l") + F.col("w"), "maxx"), edge(F.max, F.col("t") + F.col("h"), "maxy")
    )
