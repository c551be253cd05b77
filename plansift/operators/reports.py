"""Reports, catalogs and lookups over pages, codes and detections: group-bys, ranked lists, unions and column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.geometry import Box
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle


def _top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


@register("s03_demo_chunk", oracle("v_page v_project", "SELECT page_number, drawing_number, lang FROM v_page JOIN v_project USING (project_id) WHERE page_number BETWEEN 20 AND 69 AND project_id < 'src5'"))
def s03(spark, sf_dir):
    """A chunk of pages of public projects, in the columns that a viewer needs."""
    p = views.page(spark, sf_dir).where(F.col("page_number").between(20, 69) & (F.col("project_id") < "src5"))
    return p.join(views.project(spark, sf_dir), "project_id", "left_semi").select("page_number", "drawing_number", "lang")


@register("s17_index_first", oracle("v_page_code v_word v_page", """
WITH i AS (SELECT DISTINCT doc_id FROM v_page_code WHERE trade = 'Electrical'), s AS (SELECT DISTINCT doc_id FROM v_word WHERE lower(tok) = 'license')
SELECT doc_id, 'index' AS way FROM i UNION ALL SELECT doc_id, 'scan' FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = s.doc_id)"""))
def s17(spark, sf_dir):
    """Pages of a trade by the index of codes; pages that it lacks by a scan of their words."""
    index = views.page_code(spark, sf_dir).where("trade = 'Electrical'").select("doc_id").distinct()
    scan = views.word(spark, sf_dir).where(F.lower("tok") == "license").select("doc_id").distinct()
    return index.select("doc_id", F.lit("index").alias("way")).unionAll(scan.join(index, "doc_id", "left_anti").select("doc_id", F.lit("scan").alias("way")))


@register("p08_all_pages", oracle("v_page", "SELECT page_number, true AS in_scope FROM v_page"))
def p08(spark, sf_dir):
    """The scope that lets every page through."""
    return views.page(spark, sf_dir).select("page_number", F.lit(True).alias("in_scope"))


@register("p15_rule_migration", """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN [p_brand] END, CASE WHEN p_size % 3 = 1 THEN [p_type, p_brand] END, []) AS required,
  CASE WHEN p_size % 3 = 1 THEN 'all' ELSE 'any' END AS text_mode, coalesce(CASE WHEN p_size % 2 = 0 THEN 'boost' END, 'require') AS detections FROM part""")
def p15(spark, sf_dir):
    """Rules of an old form (here from parts) in the new one: old keywords become required ones, all of them; the default is 'require'."""
    size = F.col("p_size")
    new, old = F.when(size % 3 == 0, F.array("p_brand")), F.when(size % 3 == 1, F.array("p_type", "p_brand"))
    return views.read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size").select(
        "p_partkey", F.coalesce(new, old, F.array().cast("array<string>")).alias("required"), F.when(size % 3 == 1, "all").otherwise("any").alias("text_mode"),
        F.coalesce(F.when(size % 2 == 0, "boost"), F.lit("require")).alias("detections"),
    )


@register("a15_trigger_words", oracle("v_word v_taxonomy v_page_code", """
WITH t AS (SELECT code, unnest(string_split(description, ' ')) AS w, unnest(range(len(string_split(description, ' '))))::INT AS at FROM v_taxonomy),
c AS (SELECT DISTINCT doc_id, code FROM v_page_code),
h AS (SELECT c.doc_id, c.code, t.w, min(v.idx) AS first_idx, count(DISTINCT v.idx) AS n, bool_or(len(t.w) >= 6) AS anchor FROM c JOIN t USING (code) JOIN v_word v ON v.doc_id = c.doc_id AND lower(v.tok) = t.w GROUP BY ALL)
SELECT doc_id, code, w AS word, CASE WHEN anchor THEN 'anchor' ELSE 'other' END AS label, first_idx, n FROM h"""))
def a15(spark, sf_dir):
    """The words of a page that speak for its codes, each once, with the stronger label and the first place."""
    codes = views.taxonomy(spark, sf_dir).select("code", F.explode(F.array_distinct(F.split("description", " "))).alias("word"))
    own = views.page_code(spark, sf_dir).select("doc_id", "code").distinct().join(codes, "code")
    words = views.word(spark, sf_dir).select("doc_id", F.lower("tok").alias("word"), "idx").groupBy("doc_id", "word").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"))
    label = F.when(F.length("word") >= 6, "anchor").otherwise("other")
    return own.join(words, ["doc_id", "word"]).select("doc_id", "code", "word", label.alias("label"), "first_idx", "n")


@register("a28_catalogs", oracle("v_detection", """
SELECT 'schedules' AS catalog, doc_id, det_id AS entry FROM v_detection WHERE name = 'tables' AND conf >= 8e-1 UNION ALL SELECT 'tables', doc_id, det_id FROM v_detection WHERE name = 'tables' AND conf < 8e-1
UNION ALL SELECT 'keynotes', doc_id, det_id FROM v_detection WHERE name = 'text_box' UNION ALL SELECT 'title blocks', doc_id, det_id FROM v_detection WHERE name = 'title_block'"""))
def a28(spark, sf_dir):
    """Catalogs of a project's regions: schedules, other tables, keynotes, title blocks."""
    n = F.col("name")
    catalog = F.when((n == "tables") & (F.col("conf") >= 0.8), "schedules").when(n == "tables", "tables").when(n == "text_box", "keynotes").when(n == "title_block", "title blocks")
    return views.detection(spark, sf_dir).select(catalog.alias("catalog"), "doc_id", F.col("det_id").alias("entry")).where("catalog IS NOT NULL")


@register("a34_large_result", oracle("v_detection", """
WITH g AS (SELECT doc_id, name, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM v_detection GROUP BY doc_id, name)
SELECT doc_id, CASE WHEN total > 50 THEN name ELSE '(listed)' END AS name, sum(n)::BIGINT AS n FROM g GROUP BY ALL"""))
def a34(spark, sf_dir):
    """Results of over fifty rows as counts by class, others as one line."""
    g = views.detection(spark, sf_dir).groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    total = g.withColumn("total", F.sum("n").over(W.partitionBy("doc_id")))  # a page has as many rows as there are classes
    return total.groupBy("doc_id", F.when(F.col("total") > 50, F.col("name")).otherwise("(listed)").alias("name")).agg(F.sum("n").alias("n"))


@register("a57_shapes", oracle("v_detection", """
SELECT CASE WHEN abs(r - 1e0) < 1e-1 THEN 'square' WHEN r > 1e0 THEN 'wide' ELSE 'tall' END AS shape, count(*) AS n FROM (SELECT round((maxx - minx) / (maxy - miny), 6) AS r FROM v_detection) GROUP BY 1"""))
def a57(spark, sf_dir):
    r = F.round((F.col("maxx") - F.col("minx")) / (F.col("maxy") - F.col("miny")), 6)
    shape = F.when(F.abs(r - 1) < 0.1, "square").when(r > 1, "wide").otherwise("tall")
    return views.detection(spark, sf_dir).groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@register("a60_region_divisions", oracle("v_word v_detection v_taxonomy", """
WITH t AS (SELECT DISTINCT division, unnest(string_split(description, ' ')) AS w FROM v_taxonomy), a AS (SELECT division, w FROM t WHERE len(w) >= 6),
r AS (SELECT d.doc_id, d.det_id, v.idx, lower(v.tok) AS w FROM v_detection d JOIN v_word v ON v.doc_id = d.doc_id AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND d.maxy WHERE d.name = 'text_box')
SELECT doc_id, det_id, division, count(DISTINCT idx) AS n FROM r JOIN a USING (w) GROUP BY ALL"""))
def a60(spark, sf_dir):
    """Per parsed region and division the words that speak for the division's codes."""
    from plansift.operators.spatial import points_in_boxes, words_with_centres

    own = views.taxonomy(spark, sf_dir).select("division", F.explode(F.split("description", " ")).alias("w")).where("length(w) >= 6").distinct()
    boxes = views.detection(spark, sf_dir).where("name = 'text_box'")
    words = points_in_boxes(words_with_centres(spark, sf_dir).withColumn("w", F.lower("tok")).join(own.select("w").distinct(), "w", "left_semi"), boxes, F.col("cx"), F.col("cy"))
    return words.join(own, "w").groupBy("doc_id", "det_id", "division").agg(F.count_distinct("idx").alias("n"))


@register("a61_recompute_stats", oracle("v_page_code", "SELECT count(*) AS triggers, count(DISTINCT trade) AS trades, count(DISTINCT doc_id) AS pages, count(DISTINCT code) AS codes FROM v_page_code"))
def a61(spark, sf_dir):
    return views.page_code(spark, sf_dir).agg(F.count("*").alias("triggers"), F.count_distinct("trade").alias("trades"), F.count_distinct("doc_id").alias("pages"), F.count_distinct("code").alias("codes"))


@register("a62_tag_hierarchy", oracle("v_detection v_schedule", """
WITH t AS (SELECT p_partkey % 5 AS model, coalesce(CASE WHEN p_size > 10 THEN p_type END, 'no class') AS class, tag FROM v_schedule)
SELECT 'model ' || model AS model, class, count(DISTINCT tag) AS tags, count(*) AS instances FROM t GROUP BY ALL"""))
def a62(spark, sf_dir):
    """Model, class and tags of instances, with a name for what has none."""
    kind = F.coalesce(F.when(F.col("p_size") > 10, F.col("p_type")), F.lit("no class"))
    model = F.concat(F.lit("model "), (F.col("p_partkey") % 5).cast("string"))
    return views.schedule(spark, sf_dir).groupBy(model.alias("model"), kind.alias("class")).agg(F.count_distinct("tag").alias("tags"), F.count("*").alias("instances"))


@register("o03_newest_events", "SELECT ts, user_id, event_type FROM (SELECT DISTINCT ts, user_id, event_type FROM events) ORDER BY ts DESC, user_id, event_type LIMIT 500")
def o03(spark, sf_dir):
    """The five hundred newest events."""
    return views.read(spark, sf_dir, "events", "ts", "user_id", "event_type").distinct().orderBy(F.desc("ts"), "user_id", "event_type").limit(500)


@register("o05_regions_by_confidence", oracle("v_detection", "SELECT doc_id, det_id, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, det_id, name)::INT AS place FROM v_detection"))
def o05(spark, sf_dir):
    return views.detection(spark, sf_dir).select("doc_id", "det_id", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("conf"), "det_id", "name")).alias("place"))


@register("o08_match_cap", oracle("v_detection", "SELECT doc_id, det_id, name FROM v_detection QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, det_id, name) <= 100"))
def o08(spark, sf_dir):
    """At most a hundred matches of a page, the surest first (the cap is the feature)."""
    return _top(views.detection(spark, sf_dir), ["doc_id"], [F.desc("conf"), "det_id", "name"], 100).select("doc_id", "det_id", "name")


@register("o09_report_tops", oracle("v_page_code", """
WITH d AS (SELECT division, count(*) AS n FROM v_page_code GROUP BY 1 ORDER BY n DESC, division LIMIT 10), c AS (SELECT division, code, count(*) AS m FROM v_page_code GROUP BY ALL)
SELECT d.division, d.n, c.code, c.m FROM d JOIN c USING (division) QUALIFY row_number() OVER (PARTITION BY division ORDER BY m DESC, code) <= 3"""))
def o09(spark, sf_dir):
    """The ten divisions with most hits, each with its three most frequent codes (a top-k report)."""
    p = views.page_code(spark, sf_dir)
    d = p.groupBy("division").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "division").limit(10)
    c = p.groupBy("division", "code").agg(F.count("*").alias("m"))
    return _top(c.join(F.broadcast(d), "division"), ["division"], [F.desc("m"), "code"], 3).select("division", "n", "code", "m")  # d: ten rows


@register("o10_schedule_cap", oracle("v_schedule", """
WITH x AS (SELECT p_brand, tag, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY tag, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS total FROM v_schedule)
SELECT p_brand, tag, p_partkey, total FROM x WHERE r <= 20"""))
def o10(spark, sf_dir):
    """Twenty rows of each schedule and how many it has (the cap is the feature)."""
    s = views.schedule(spark, sf_dir)
    total = s.groupBy("p_brand").agg(F.count("*").alias("total"))
    return _top(s, ["p_brand"], ["tag", "p_partkey"], 20).join(total, "p_brand").select("p_brand", "tag", "p_partkey", "total")


@register("o12_context_caps", oracle("v_detection", """
WITH x AS (SELECT doc_id, det_id, conf, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, det_id, name) AS r, count(*) OVER (PARTITION BY doc_id) AS total FROM v_detection WHERE conf >= 6e-1)
SELECT doc_id, det_id, greatest(total - 8, 0)::BIGINT AS more FROM x WHERE r <= 8"""))
def o12(spark, sf_dir):
    """Eight sure regions of a page for a prompt, and how many more there are (the cap is the feature)."""
    d = views.detection(spark, sf_dir).where("conf >= 0.6")
    total = d.groupBy("doc_id").agg(F.greatest(F.count("*") - 8, F.lit(0)).alias("more"))
    return _top(d, ["doc_id"], [F.desc("conf"), "det_id", "name"], 8).join(total, "doc_id").select("doc_id", "det_id", "more")


_STRATEGIES = """a AS (SELECT doc_id, tok AS candidate, 'corner' AS strategy, 6e-1 + 3e-1 * (idx % 720 >= 600)::INT AS score FROM v_word WHERE regexp_matches(tok, '^[A-Z][a-z]{1,3}[.,]?$')),
b AS (SELECT page_number AS doc_id, drawing_number AS candidate, 'register' AS strategy, 7e-1 AS score FROM v_page), c AS (SELECT doc_id, tok, 'page', 5e-1 FROM v_word WHERE regexp_matches(tok, '^[A-Z]{1,2}-?[0-9]{2,4}$'))"""


@register("u02_candidates", oracle("v_word v_page", f"WITH {_STRATEGIES}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT strategy, count(*) AS n, count(DISTINCT candidate) AS candidates FROM u GROUP BY strategy"))
def u02(spark, sf_dir):
    """Candidates of all strategies for a page's drawing number, in one table."""
    return drawing_candidates(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("candidates"))


def drawing_candidates(spark, sf_dir) -> DataFrame:
    w = views.word(spark, sf_dir)
    near = w.where(F.col("tok").rlike("^[A-Z][a-z]{1,3}[.,]?$"))
    a = near.select("doc_id", F.col("tok").alias("candidate"), F.lit("corner").alias("strategy"), (F.lit(0.6) + F.lit(0.3) * (F.col("idx") % 720 >= 600).cast("int")).alias("score"))
    b = views.page(spark, sf_dir).select(F.col("page_number").alias("doc_id"), F.col("drawing_number").alias("candidate"), F.lit("register").alias("strategy"), F.lit(0.7).alias("score"))
    c = w.where(F.col("tok").rlike("^[A-Z]{1,2}-?[0-9]{2,4}$")).select("doc_id", F.col("tok").alias("candidate"), F.lit("page").alias("strategy"), F.lit(0.5).alias("score"))
    return a.unionByName(b).unionByName(c)


@register("r17_drawing_number", oracle("v_word v_page", f"""
WITH {_STRATEGIES}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
s AS (SELECT doc_id, candidate, strategy, score + CASE WHEN regexp_matches(candidate, '^(A|S|M|E|P|C|FP|G)-[0-9]') THEN 2e-1 ELSE 0e0 END - CASE WHEN regexp_matches(candidate, '^[0-9]|[a-z]') THEN 4e-1 ELSE 0e0 END AS score FROM u)
SELECT doc_id, candidate, strategy, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, candidate, strategy) = 1"""))
def r17(spark, sf_dir):
    """The best of all candidates: known prefixes gain, digits first and lower case lose."""
    gain = F.when(F.col("candidate").rlike("^(A|S|M|E|P|C|FP|G)-[0-9]"), 0.2).otherwise(0.0) - F.when(F.col("candidate").rlike("^[0-9]|[a-z]"), 0.4).otherwise(0.0)
    scored = drawing_candidates(spark, sf_dir).withColumn("score", F.round(F.col("score") + gain, 6))
    best = F.min(F.struct((-F.col("score")).alias("loss"), "candidate", "strategy")).alias("b")
    return scored.groupBy("doc_id").agg(best).select("doc_id", "b.candidate", "b.strategy", (-F.col("b.loss")).alias("score"))


@register("u04_code_union", oracle("v_page_code v_taxonomy v_page", """
SELECT doc_id, code FROM v_page_code UNION SELECT p.page_number, t.code FROM v_page p JOIN (SELECT code, row_number() OVER (ORDER BY code) - 1 AS k FROM v_taxonomy) t ON p.page_number % 50 = t.k"""))
def u04(spark, sf_dir):
    """Codes set by hand (here one for some pages) and found ones, each once."""
    codes = views.taxonomy(spark, sf_dir).select("code").orderBy("code").limit(50)
    named = codes.select("code", (F.row_number().over(W.orderBy("code")) - 1).alias("k"))  # fifty rows at most
    by_hand = views.page(spark, sf_dir).join(F.broadcast(named), F.col("page_number") % 50 == F.col("k")).select(F.col("page_number").alias("doc_id"), "code")
    return views.page_code(spark, sf_dir).select("doc_id", "code").union(by_hand).distinct()


@register("x05_number_forms", oracle("v_page", """
SELECT page_number, drawing_number, regexp_extract(drawing_number, '^([A-Z]{1,2})-?([0-9]{1,4})', 1) AS prefix, regexp_extract(drawing_number, '^([A-Z]{1,2})-?([0-9]{1,4})', 2)::INT AS number,
 regexp_extract(drawing_number, '^([A-Z]{1,2})-?([0-9]{1,4})', 1) IN ('A', 'S', 'M', 'E', 'P') AS known FROM v_page"""))
def x05(spark, sf_dir):
    """Drawing numbers taken apart, and whether their prefix is a main discipline's."""
    part = lambda k: F.regexp_extract("drawing_number", "^([A-Z]{1,2})-?([0-9]{1,4})", k)
    return views.page(spark, sf_dir).select("page_number", "drawing_number", part(1).alias("prefix"), part(2).cast("int").alias("number"), part(1).isin("A", "S", "M", "E", "P").alias("known"))


@register("x15_overlap_of_smaller", oracle("v_detection", """
WITH m AS (SELECT a.doc_id, a.det_id AS a, b.det_id AS b, greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0e0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0e0) AS i,
  least((a.maxx - a.minx) * (a.maxy - a.miny), (b.maxx - b.minx) * (b.maxy - b.miny)) AS s FROM v_detection a JOIN v_detection b ON a.doc_id = b.doc_id AND a.det_id < b.det_id WHERE a.name = 'text_box' AND b.name = 'text_box')
SELECT DISTINCT doc_id, a, b, round(i / s, 6) AS overlap FROM m WHERE round(i / s, 6) >= 5e-1"""))
def x15(spark, sf_dir):
    """Pairs of text boxes of which the smaller lies half inside the other."""
    from plansift.operators.spatial import box_pairs

    d = views.detection(spark, sf_dir).where("name = 'text_box'")
    p, q = Box.of(), Box.of("b_")
    share = F.round(p.shared(q) / F.least(p.area, q.area), 6)
    return box_pairs(d, d).where((F.col("det_id") < F.col("b_det_id")) & (share >= 0.5)).select("doc_id", F.col("det_id").alias("a"), F.col("b_det_id").alias("b"), share.alias("overlap")).distinct()


#: Groups of divisions by the start of their number (own ones).
GROUPS = {"00": "Procurement", "01": "General", "0": "Facility Construction", "1": "Facility Construction", "2": "Facility Services", "3": "Site and Infrastructure", "4": "Process Equipment"}


@register("x28_division_groups", oracle("v_taxonomy", "SELECT code, division, CASE " + " ".join(f"WHEN starts_with(division, '{k}') THEN '{v}'" for k, v in sorted(GROUPS.items(), key=lambda x: -len(x[0]))) + " ELSE 'Other' END AS kind FROM v_taxonomy"))
def x28(spark, sf_dir):
    """The group of each code's division."""
    kind = F.coalesce(*(F.when(F.col("division").startswith(k), v) for k, v in sorted(GROUPS.items(), key=lambda x: -len(x[0]))), F.lit("Other"))
    return views.taxonomy(spark, sf_dir).select("code", "division", kind.alias("kind"))


@register("r20_project_report", oracle("v_page v_page_code v_cross_ref", """
WITH p AS (SELECT project_id, count(*) AS pages, count(DISTINCT lang) AS langs FROM v_page GROUP BY 1), d AS (SELECT project_id, division, count(*) AS n FROM v_page_code c JOIN v_page g ON g.page_number = c.doc_id GROUP BY ALL),
t AS (SELECT project_id, string_agg(division || ' (' || n || ')', ', ' ORDER BY n DESC, division) AS tops FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, division) <= 3) GROUP BY 1),
r AS (SELECT project_id, count(*) AS refs FROM v_cross_ref x JOIN v_page g ON g.page_number = x.from_doc GROUP BY 1)
SELECT project_id, 'Pages: ' || pages || '; languages: ' || langs || '; references: ' || coalesce(refs, 0) || '; divisions: ' || coalesce(tops, 'none') AS report FROM p LEFT JOIN t USING (project_id) LEFT JOIN r USING (project_id)"""))
def r20(spark, sf_dir):
    """One line of each project: pages, languages, references and the three main divisions."""
    page = views.page(spark, sf_dir).select("project_id", "page_number", "lang")
    p = page.groupBy("project_id").agg(F.count("*").alias("pages"), F.count_distinct("lang").alias("langs"))
    d = views.page_code(spark, sf_dir).join(page, F.col("doc_id") == F.col("page_number")).groupBy("project_id", "division").agg(F.count("*").alias("n"))
    top = _top(d, ["project_id"], [F.desc("n"), "division"], 3).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "division", "n"))).alias("x"))  # three rows each
    tops = top.select("project_id", F.array_join(F.transform("x", lambda x: F.concat(x["division"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("tops"))
    r = views.cross_ref(spark, sf_dir).join(page, F.col("from_doc") == F.col("page_number")).groupBy("project_id").agg(F.count("*").alias("refs"))
    j = p.join(tops, "project_id", "left").join(r, "project_id", "left")
    text = F.concat(F.lit("Pages: "), F.col("pages").cast("string"), F.lit("; languages: "), F.col("langs").cast("string"), F.lit("; references: "), F.coalesce("refs", F.lit(0)).cast("string"), F.lit("; divisions: "), F.coalesce("tops", F.lit("none")))
    return j.select("project_id", text.alias("report"))


@register("x30_context_budget", oracle("v_page", """
WITH s AS (SELECT page_number, unnest([1, 2, 3]) AS prio, unnest([len(drawing_number), least(len(raw_text), 4000), len(raw_text) // 3]) AS size FROM v_page),
g AS (SELECT *, (ARRAY[200, 1500, 800])[prio] AS share, coalesce(sum(greatest((ARRAY[200, 1500, 800])[prio] - size, 0)) OVER (PARTITION BY page_number ORDER BY prio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare FROM s)
SELECT page_number, prio::INT AS prio, least(size, share + spare)::BIGINT AS given, size > share + spare AND share + spare > 200 AS cut FROM g"""))
def x30(spark, sf_dir):
    """Sections of a page's context by priority: each its share of the budget and what those before it left over."""
    p = views.page(spark, sf_dir)
    n = F.char_length("raw_text")
    sizes = F.array(F.char_length("drawing_number"), F.least(n, F.lit(4000)), F.floor(n / 3).cast("int"))
    s = p.select("page_number", F.posexplode(sizes).alias("at", "size")).withColumn("share", F.element_at(F.array(*map(F.lit, (200, 1500, 800))), F.col("at") + 1))
    before = W.partitionBy("page_number").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("share") + F.coalesce(F.sum(F.greatest(F.col("share") - F.col("size"), F.lit(0))).over(before), F.lit(0))
    return s.withColumn("limit", limit).select("page_number", (F.col("at") + 1).alias("prio"), F.least("size", "limit").cast("long").alias("given"), ((F.col("size") > F.col("limit")) & (F.col("limit") > 200)).alias("cut"))
