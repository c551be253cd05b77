"""Reference and co-occurrence graphs, clusters, ensemble votes and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plansift.functions.geometry import Box
from plansift.functions.text import upper
from plansift.operators.spatial import box_pairs
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle

_PC = "v_detection v_word v_text v_taxonomy v_page_code"
#: Groups of divisions that belong together.
CLUSTERS = {"MEP": ("22", "23", "26", "27", "28"), "Architectural": ("08", "09", "12"), "Structural": ("03", "05"), "Site": ("31", "32", "33")}
#: Trades of a region by the class of its boxes, to derive more divisions of a page than its text names.
CLASS_DIVISIONS = {"tables": "08", "grid": "03", "title_block": "01", "drawings": "09", "text_box": "26", "vertical_area": "05", "horizontal_area": "23"}


@register("a18_reference_graph", oracle("v_cross_ref", """
WITH e AS (SELECT DISTINCT from_doc, to_doc FROM v_cross_ref), i AS (SELECT to_doc AS doc, count(*) AS n_in FROM e GROUP BY 1), o AS (SELECT from_doc AS doc, count(*) AS n_out FROM e GROUP BY 1)
SELECT doc, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) >= 3 AS hub, coalesce(n_out, 0) > 0 AND coalesce(n_in, 0) = 0 AS leaf FROM i FULL JOIN o USING (doc)"""))
def a18(spark, sf_dir):
    """Degrees of pages in the reference graph; hubs have three incoming references or more, leaves none."""
    e = views.cross_ref(spark, sf_dir).distinct()
    ends = e.select(F.col("to_doc").alias("doc"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select("from_doc", F.lit(0), F.lit(1)))
    d = ends.groupBy("doc").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return d.withColumns({"hub": F.col("n_in") >= 3, "leaf": (F.col("n_out") > 0) & (F.col("n_in") == 0)})


@register("u06_except_leaves", oracle("v_cross_ref", "SELECT from_doc AS doc FROM v_cross_ref EXCEPT SELECT to_doc FROM v_cross_ref"))
def u06(spark, sf_dir):
    e = views.cross_ref(spark, sf_dir)
    return e.select(F.col("from_doc").alias("doc")).exceptAll(e.select("to_doc")).distinct().join(e.select(F.col("to_doc").alias("doc")), "doc", "left_anti")


def page_divisions(spark, sf_dir) -> DataFrame:
    """(``doc_id``, ``division``): of a page's codes and of its surest boxes."""
    d = views.detection(spark, sf_dir).where("conf >= 0.9D")
    pairs = [F.lit(x) for kv in CLASS_DIVISIONS.items() for x in kv]
    boxed = d.select("doc_id", F.element_at(F.create_map(*pairs), F.col("name")).alias("division"))
    return views.page_code(spark, sf_dir).select("doc_id", "division").unionByName(boxed).distinct()


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_DIVISIONS.items())
_PD = f"pd AS (SELECT doc_id, division FROM v_page_code UNION SELECT doc_id, CASE name {_CASE} END FROM v_detection WHERE conf >= 9e-1)"


@register("a20_graph_nodes", oracle(_PC, f"WITH {_PD} SELECT division, count(*) AS pages, min(doc_id) AS first_page FROM pd GROUP BY division"))
def a20(spark, sf_dir):
    return page_divisions(spark, sf_dir).groupBy("division").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"))


def division_pairs(pd: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``weight``): pages on which both divisions occur; a page has at most some dozens of divisions."""
    a, b = pd.select("doc_id", F.col("division").alias("a")), pd.select("doc_id", F.col("division").alias("b"))
    return a.join(b, "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


_PAIRS = f"{_PD}, pr AS (SELECT x.division AS a, y.division AS b, count(*) AS weight FROM pd x JOIN pd y ON x.doc_id = y.doc_id AND x.division < y.division GROUP BY ALL)"


@register("a21_graph_edges", oracle(_PC, f"WITH {_PAIRS} SELECT * FROM pr"))
def a21(spark, sf_dir):
    return division_pairs(page_divisions(spark, sf_dir))


@register("j20_division_pairs", oracle(_PC, f"WITH {_PAIRS} SELECT a AS division, count(*) AS partners, sum(weight)::BIGINT AS weight FROM pr GROUP BY a"))
def j20(spark, sf_dir):
    return division_pairs(page_divisions(spark, sf_dir)).groupBy(F.col("a").alias("division")).agg(F.count("*").alias("partners"), F.sum("weight").alias("weight"))


@register("a22_cross_reference_edges", oracle("v_cross_ref " + _PC, f"""
WITH {_PD} SELECT least(x.division, y.division) AS lo, greatest(x.division, y.division) AS hi, count(DISTINCT from_doc) AS weight
FROM v_cross_ref JOIN pd x ON x.doc_id = from_doc JOIN pd y ON y.doc_id = to_doc WHERE x.division <> y.division GROUP BY ALL"""))
def a22(spark, sf_dir):
    """Division pairs across references, weighed by distinct source pages."""
    pd = page_divisions(spark, sf_dir)
    x, y = pd.select(F.col("doc_id").alias("from_doc"), F.col("division").alias("x")), pd.select(F.col("doc_id").alias("to_doc"), F.col("division").alias("y"))
    r = views.cross_ref(spark, sf_dir).distinct().join(x, "from_doc").join(y, "to_doc").where("x <> y")
    return r.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.count_distinct("from_doc").alias("weight"))


_MEMBERS = ", ".join(f"('{k}', '{d}')" for k, ds in CLUSTERS.items() for d in ds)


@register("a23_group_cohesion", oracle(_PC, f"""
WITH {_PAIRS}, n AS (SELECT division, count(*) AS pages FROM pd GROUP BY ALL), m(cluster, division) AS (VALUES {_MEMBERS}),
h AS (SELECT cluster, division, pages FROM m JOIN n USING (division)),
p AS (SELECT x.cluster, coalesce(weight, 0) / least(x.pages, y.pages) AS c FROM h x JOIN h y ON x.cluster = y.cluster AND x.division < y.division LEFT JOIN pr ON a = x.division AND b = y.division)
SELECT cluster, round(min(c), 3) AS cohesion, round(min(c), 3) >= 7e-1 AS known FROM p GROUP BY cluster"""))
def a23(spark, sf_dir):
    """Cohesion of the known clusters that have two divisions or more: the least overlap of any pair."""
    pd = page_divisions(spark, sf_dir)
    m = spark.createDataFrame([(k, d) for k, ds in CLUSTERS.items() for d in ds], "cluster string, division string")
    h = pd.groupBy("division").agg(F.count("*").alias("pages")).join(F.broadcast(m), "division")
    x, y = h.select("cluster", F.col("division").alias("a"), F.col("pages").alias("pa")), h.select("cluster", F.col("division").alias("b"), F.col("pages").alias("pb"))
    p = x.join(y, "cluster").where("a < b").join(division_pairs(pd), ["a", "b"], "left")
    c = F.round(F.min(F.coalesce("weight", F.lit(0)) / F.least("pa", "pb")), 3)
    return p.groupBy("cluster").agg(c.alias("cohesion")).withColumn("known", F.col("cohesion") >= 0.7)


def greedy_clusters(nodes: list[str], close: dict[tuple[str, str], float], known: dict[str, tuple[str, ...]], least: float) -> list[tuple[str, list[str], float]]:
    """Known groups that hold together, then groups grown in the order of ``nodes``: a node joins the first group all of
    whose members it is close to.  ``close`` has the cohesion of pairs (in order of names) that reach ``least``."""
    cohesion = lambda group: min((close.get((a, b), 0.0) for n, a in enumerate(sorted(group)) for b in sorted(group)[n + 1 :]), default=0.0)
    out, taken = [], set()
    for name, members in known.items():
        here = [d for d in members if d in nodes]
        if len(here) > 1 and cohesion(here) >= least:
            out.append((name, sorted(here), cohesion(here)))
            taken.update(here)
    left = [d for d in nodes if d not in taken]
    for i, seed in enumerate(left):
        if seed in taken:
            continue
        group = [seed]
        for d in left[i + 1 :]:
            if d not in taken and all((min(d, m), max(d, m)) in close for m in group):
                group.append(d)
        if len(group) > 1:
            out.append(("+".join(sorted(group)), sorted(group), cohesion(group)))
            taken.update(group)
    return out


def adhoc_clusters(pd: DataFrame, least: float = 0.7) -> DataFrame:
    """``project, cluster, divisions, cohesion`` of ``project, doc_id, division`` rows.

    Pairs are counted and compared on Spark; a project's close pairs are one row, of at most 4,950 (divisions have two
    digits), over which its clusters grow in the order in which divisions first occur.
    """
    rows = pd.distinct()
    n = rows.groupBy("project", "division").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first"))
    a, b = (rows.select("project", "doc_id", F.col("division").alias(c)) for c in "ab")
    w = a.join(b, ["project", "doc_id"]).where("a < b").groupBy("project", "a", "b").agg(F.count("*").alias("weight"))
    of = lambda c: n.select("project", F.col("division").alias(c), F.col("pages").alias(f"p{c}"))
    close = w.join(of("a"), ["project", "a"]).join(of("b"), ["project", "b"]).select("project", "a", "b", (F.col("weight") / F.least("pa", "pb")).alias("c")).where(F.col("c") >= least)
    nodes = n.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "division"))), lambda x: x["division"]).alias("nodes"))
    edges = close.groupBy("project").agg(F.collect_list(F.struct("a", "b", "c")).alias("edges"))

    def run(batches):
        for t in batches:
            got = []
            for r in t.to_dict("records"):
                near = {(e["a"], e["b"]): e["c"] for e in r["edges"]} if r["edges"] is not None else {}
                got += [(r["project"], name, ",".join(ds), round(c, 3)) for name, ds, c in greedy_clusters(list(r["nodes"]), near, CLUSTERS, least)]
            yield pandas.DataFrame(got, columns=["project", "cluster", "divisions", "cohesion"])

    return nodes.join(edges, "project", "left").mapInPandas(run, "project string, cluster string, divisions string, cohesion double")


@register("a25_adhoc_clusters")
def a25(spark, sf_dir):
    """Clusters of divisions of each project: the known ones that hold together, then those grown greedily (loops in pytest)."""
    pages = views.read(spark, sf_dir, "documents", "doc_id", F.col("source").alias("project"))
    return adhoc_clusters(page_divisions(spark, sf_dir).join(pages, "doc_id").select("project", "doc_id", "division"))


@register("a26_fingerprint", oracle(_PC, f"WITH {_PD}, n AS (SELECT source, division, count(*) AS c FROM pd JOIN documents USING (doc_id) GROUP BY ALL) SELECT source, string_agg(division || ':' || c, ',' ORDER BY c DESC, division) AS fingerprint FROM n GROUP BY source"))
def a26(spark, sf_dir):
    """A project's divisions with their page counts, most first."""
    n = page_divisions(spark, sf_dir).join(views.read(spark, sf_dir, "documents", "doc_id", "source"), "doc_id").groupBy("source", "division").agg(F.count("*").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "division")))
    return n.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["division"], -x["o"])), ",").alias("fingerprint"))


# --- ensemble of votes ---------------------------------------------------------------------------------------------

WEIGHTS = {"tables": 0.9, "grid": 0.5, "text_box": 0.4, "drawings": 0.3}


def votes(spark, sf_dir) -> DataFrame:
    w = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("name"))
    return views.detection(spark, sf_dir).where(F.col("name").isin(*WEIGHTS)).withColumn("weight", w)


def vote_edges(v: DataFrame) -> DataFrame:
    """Votes of a page that mean the same region: IoU 0.3 or more, or half of either inside the other."""
    p, q = Box.of(), Box.of("b_")
    same = (F.round(p.iou(q), 9) >= 0.3) | (F.round(p.containment(q), 9) >= 0.5)
    return box_pairs(v, v).where((F.col("det_id") < F.col("b_det_id")) & same).select("doc_id", F.col("det_id").alias("a"), F.col("b_det_id").alias("b")).distinct()


def page_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``doc_id``, ``det_id``, ``root``): components within pages, root the least member.

    Nodes (as edges to themselves) and edges stream by page; a task holds the nodes of one page, and nothing is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, parent = None, {}

        def top(x: str) -> str:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "det_id", "root"])

        for batch in batches:
            kinds, out = [c.type for c in batch.columns], []
            for at, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != page:
                    out += [(page, x, top(x)) for x in parent]
                    parent.clear()
                    page = at
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                one, two = top(a), top(b)
                parent[max(one, two)] = min(one, two)
            if out:
                yield done(out)
        if parent:
            yield done([(page, x, top(x)) for x in parent])

    every = nodes.select("doc_id", F.col("det_id").alias("a"), F.col("det_id").alias("b")).unionAll(edges.select("doc_id", "a", "b"))
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}
    # dealt by a hash of the page: Spark takes two sides of a union that are dealt by page as one, but reads them in different portions
    return every.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id {kind['doc_id']}, det_id {kind['det_id']}, root {kind['det_id']}")


_E = """v AS (SELECT *, CASE name WHEN 'tables' THEN 9e-1 WHEN 'grid' THEN 5e-1 WHEN 'text_box' THEN 4e-1 ELSE 3e-1 END AS weight FROM v_detection WHERE name IN ('tables', 'grid', 'text_box', 'drawings')),
m AS (SELECT a.doc_id, a.det_id AS a, b.det_id AS b, greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0e0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0e0) AS i,
  (a.maxx - a.minx) * (a.maxy - a.miny) AS sa, (b.maxx - b.minx) * (b.maxy - b.miny) AS sb FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.det_id < b.det_id),
e AS (SELECT DISTINCT doc_id, a, b FROM m WHERE round(i / (sa + sb - i), 9) >= 3e-1 OR round(greatest(i / sa, i / sb), 9) >= 5e-1)"""


@register("g02_vote_edges", oracle("v_detection", f"WITH {_E} SELECT doc_id, count(*) AS edges, min(a) AS first_vote FROM e GROUP BY doc_id"))
def g02(spark, sf_dir):
    return vote_edges(votes(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("edges"), F.min("a").alias("first_vote"))




@register("r10_ensemble", oracle("v_detection", f"""
WITH RECURSIVE {_E}, s AS (SELECT doc_id, a, b FROM e UNION ALL SELECT doc_id, b, a FROM e),
reach(doc_id, det_id, seen) AS (SELECT DISTINCT doc_id, det_id, det_id FROM v UNION SELECT r.doc_id, r.det_id, s.b FROM reach r JOIN s ON s.doc_id = r.doc_id AND s.a = r.seen),
c AS (SELECT doc_id, det_id, min(seen) AS root FROM reach GROUP BY ALL),
g AS (SELECT v.doc_id, root, sum(conf * weight) / sum(weight) AS base, count(DISTINCT name) AS sources, count(*) AS n, min(minx) AS minx, max(maxx) AS maxx FROM v JOIN c USING (doc_id, det_id) GROUP BY ALL)
SELECT doc_id, root, n, sources, round(least(base * CASE WHEN sources = 1 THEN 5e-1 WHEN sources = 2 THEN 1e0 ELSE 11e-1 END, 1e0), 6) AS probability, round(maxx - minx, 6) AS width FROM g""").replace("WITH v_detection", "WITH RECURSIVE v_detection", 1).replace(", RECURSIVE v AS", ", v AS"))
def r10(spark, sf_dir):
    """Regions from votes: weighted mean score times agreement, by connected component."""
    v = votes(spark, sf_dir)
    c = page_components(v, vote_edges(v))
    g = v.join(c, ["doc_id", "det_id"]).groupBy("doc_id", "root").agg(
        (F.sum(F.col("conf") * F.col("weight")) / F.sum("weight")).alias("base"), F.count_distinct("name").alias("sources"), F.count("*").alias("n"), F.round(F.max("maxx") - F.min("minx"), 6).alias("width")
    )
    agree = F.when(F.col("sources") == 1, 0.5).when(F.col("sources") == 2, 1.0).otherwise(1.1)
    return g.select("doc_id", "root", "n", "sources", F.round(F.least(F.col("base") * agree, F.lit(1.0)), 6).alias("probability"), "width")


@register("r11_vote_adapters", oracle("v_detection", """
SELECT source, category, count(*) AS n, round(avg(score), 6) AS score FROM (
 SELECT 'table-classifier' AS source, 'schedule' AS category, conf AS score FROM v_detection WHERE name = 'tables' UNION ALL SELECT 'heatmap', NULL, conf FROM v_detection WHERE name = 'grid'
 UNION ALL SELECT 'parsed', 'keynote', 99e-2 FROM v_detection WHERE name = 'text_box') GROUP BY ALL"""))
def r11(spark, sf_dir):
    """Four sources' rows as votes of one form."""
    d = views.detection(spark, sf_dir)
    one = lambda name, source, category, score: d.where(F.col("name") == name).select(F.lit(source).alias("source"), F.lit(category).cast("string").alias("category"), score.alias("score"))
    u = one("tables", "table-classifier", "schedule", F.col("conf")).unionByName(one("grid", "heatmap", None, F.col("conf"))).unionByName(one("text_box", "parsed", "keynote", F.lit(0.99)))
    return u.groupBy("source", "category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


# --- rules as a table ----------------------------------------------------------------------------------------------

RULES = (
    ("door-schedule", "tables", "grid", "license", "the", "08", 0.45), ("keynotes", "text_box", "drawings", None, "of", None, 0.3), ("mechanical", "vertical_area", "horizontal_area", "that", "with", "23", 0.4),
    ("text-only", None, "grid", "rights", "license", None, 0.2),
)


@register("r04_rule_scores", oracle(_PC, f"""
WITH r(rule, need, boost, kw, kw2, div, least) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) if isinstance(x, str) else f"{x}e0" for x in r) + ")" for r in RULES)}),
f AS (SELECT doc_id, list(DISTINCT name) AS names FROM v_detection GROUP BY doc_id), {_PD}, dv AS (SELECT doc_id, list(DISTINCT division) AS divs FROM pd GROUP BY doc_id),
x AS (SELECT d.doc_id, r.*, names, coalesce(list_contains(names, need), false) AS has, coalesce(list_contains(names, boost), false) AS hb,
  regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || kw || '([^A-Za-z0-9_]|$)') AS hk, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || kw2 || '([^A-Za-z0-9_]|$)') AS hk2, coalesce(list_contains(divs, div), false) AS hd
  FROM documents d CROSS JOIN r LEFT JOIN f USING (doc_id) LEFT JOIN dv USING (doc_id)),
s AS (SELECT doc_id, rule, least, CASE WHEN need IS NOT NULL AND names IS NOT NULL AND NOT has THEN 0e0 WHEN kw IS NOT NULL AND NOT hk AND need IS NULL THEN 0e0 WHEN div IS NOT NULL AND NOT hd THEN 0e0
  ELSE CASE WHEN has THEN 3e-1 ELSE 0e0 END + CASE WHEN hb THEN 1e-1 ELSE 0e0 END + CASE WHEN kw IS NOT NULL AND hk THEN 25e-2 ELSE 0e0 END + CASE WHEN hk2 THEN 5e-2 ELSE 0e0 END + CASE WHEN div IS NOT NULL THEN 15e-2 ELSE 0e0 END END AS score FROM x)
SELECT doc_id, rule, round(least(score, 99e-2), 6) AS confidence FROM s WHERE score >= least"""))
def r04(spark, sf_dir):
    """Every page against every rule of the rule table: evidence adds up, a missing necessity gives nothing."""
    from plansift.functions.text import whole_word

    keywords = sorted({k for r in RULES for k in r[3:5] if k})
    told = [whole_word(F.col("text"), k).alias(f"word{n}") for n, k in enumerate(keywords)]  # each keyword once per text
    d = views.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *told)
    names = views.detection(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    divs = page_divisions(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("division").alias("divs"))
    p = d.join(names, "doc_id", "left").join(divs, "doc_id", "left")

    def scored(rule, need, boost, kw, kw2, div, least):
        has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)) if v else F.lit(False)
        word = lambda k: F.col(f"word{keywords.index(k)}") if k else F.lit(False)
        out = F.lit(False)
        if need:
            out = out | (F.col("names").isNotNull() & ~has("names", need))
        elif kw:
            out = out | ~word(kw)
        if div:
            out = out | ~has("divs", div)
        parts = [(has("names", need), 0.3), (has("names", boost), 0.1), (word(kw), 0.25), (word(kw2), 0.05), (F.lit(bool(div)), 0.15)]
        score = sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0))
        return F.struct(F.lit(rule).alias("rule"), F.when(out, 0.0).otherwise(score).alias("score"), F.lit(float(least)).alias("least"))

    s = p.select("doc_id", F.inline(F.array(*(scored(*r) for r in RULES)))).where("score >= least")
    return s.select("doc_id", "rule", F.round(F.least("score", F.lit(0.99)), 6).alias("confidence"))


@register("r15_score_compose", oracle("v_detection", """
WITH t AS (SELECT det_id, name, conf, CASE name WHEN 'title_block' THEN 5e-2 WHEN 'tables' THEN 3e-1 WHEN 'drawings' THEN 1e0 ELSE 5e-1 END AS w, CASE WHEN conf >= 8e-1 THEN 1e0 ELSE 9e-1 END AS fuzzy FROM v_detection)
SELECT det_id, name, round(w * fuzzy, 6) AS score, CASE WHEN round(w * fuzzy, 6) >= 7e-1 THEN 'high' WHEN round(w * fuzzy, 6) >= 35e-2 THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN round(w * fuzzy, 6) >= 35e-2 THEN NULL WHEN name = 'title_block' THEN 'inside_title_block' WHEN name = 'tables' THEN 'inside_table' ELSE 'weak' END AS drop_reason FROM t"""))
def r15(spark, sf_dir):
    """Score, tier and reason of a match from its region's weight and how exact it is."""
    n = F.col("name")
    w = F.when(n == "title_block", 0.05).when(n == "tables", 0.3).when(n == "drawings", 1.0).otherwise(0.5)
    score = F.round(w * F.when(F.col("conf") >= 0.8, 1.0).otherwise(0.9), 6)
    s = views.detection(spark, sf_dir).select("det_id", "name", score.alias("score"))
    c = F.col("score")
    why = F.when(c >= 0.35, None).when(n == "title_block", "inside_title_block").when(n == "tables", "inside_table").otherwise("weak")
    return s.select("det_id", "name", "score", F.when(c >= 0.7, "high").when(c >= 0.35, "medium").otherwise("low").alias("tier"), why.alias("drop_reason"))


@register("r13_text_tags", oracle("v_word v_schedule", """
WITH t AS (SELECT DISTINCT upper(split_part(p_type, ' ', 1)) AS tag FROM v_schedule UNION SELECT DISTINCT upper(tok) FROM v_word GROUP BY ALL HAVING count(*) >= 300)
SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS pages FROM v_word JOIN t ON upper(tok) = tag GROUP BY tag"""))
def r13(spark, sf_dir):
    """Words that equal a tag in upper case; tags come from the schedule and the commonest words."""
    w = views.word(spark, sf_dir).select("doc_id", "tok", upper(F.col("tok")).alias("tag"))
    common = w.groupBy("tag").agg(F.count("*").alias("n")).where("n >= 300").select("tag")
    tags = views.schedule(spark, sf_dir).select(upper(F.split("p_type", " ")[0]).alias("tag")).union(common).distinct()
    return w.join(tags, "tag").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))
