"""Regions of a page: tag binding, suppression, merging, density cells, tiles, classifiers and cuts.

What is greedy in the surveyed order streams over rows sorted by page and that order; each step's state is the regions
kept so far of one page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.geometry import Box
from plansift.functions.text import upper
from plansift.operators.spatial import points_in_boxes, words_with_centres
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle

BOX = ("minx", "miny", "maxx", "maxy")


def in_page_order(boxes: DataFrame, order: list, step: Callable[[list[tuple], tuple], tuple | None], schema: str, on: str = "doc_id") -> DataFrame:
    """Per page, its rows in order against those kept so far: ``step`` gives the row to keep, or None after it has
    changed what is kept."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, kept, begun = None, [], False
        for rows in batches:
            done: list[tuple] = []
            for r in rows[names].itertuples(index=False, name=None):
                if not begun or r[0] != page:
                    done += kept
                    page, kept, begun = r[0], [], True
                new = step(kept, r)
                if new is not None:
                    kept.append(new)
            if done:
                yield pd.DataFrame(done, columns=names)
        if kept:
            yield pd.DataFrame(kept, columns=names)

    return boxes.select(*names).repartition(on).sortWithinPartitions(on, *order).mapInPandas(run, schema)


def _shared(a: tuple, b: tuple) -> float:
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)


def _area(a: tuple) -> float:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: tuple, b: tuple) -> float:
    both = _shared(a, b)
    return both / (_area(a) + _area(b) - both) if both else 0.0


def suppress(kept: list[tuple], r: tuple, most: float = 0.3) -> tuple | None:
    """Non-maximum suppression: a box stays if it overlaps none kept by more."""
    return r if all(iou(k[2:6], r[2:6]) <= most for k in kept) else None


def merge_or_insert(kept: list[tuple], r: tuple, least: float = 0.5) -> tuple | None:
    """Into the first region that it overlaps enough, which grows; else a region of its own."""
    for n, k in enumerate(kept):
        if iou(k[2:6], r[2:6]) > least:
            box = (min(k[2], r[2]), min(k[3], r[3]), max(k[4], r[4]), max(k[5], r[5]))
            kept[n] = (*k[:2], *box, max(k[6], r[6]))
            return None
    return r


def longer_text(kept: list[tuple], r: tuple, least: float = 0.5) -> tuple | None:
    """Boxes of overlapping tiles: of two that share half of the smaller, that with the longer text stays."""
    for n, k in enumerate(kept):
        if _shared(k[2:6], r[2:6]) > least * min(_area(k[2:6]), _area(r[2:6])):
            if r[6] > k[6]:
                kept[n] = r
            return None
    return r


_SCHEMA = "doc_id long, det_id string, minx double, miny double, maxx double, maxy double, conf double"


@register("g07_suppressed_boxes")
def g07(spark, sf_dir):
    """Boxes that no surer box of the page overlaps by more than 0.3 (greedily, the surest first)."""
    return in_page_order(views.detection(spark, sf_dir), [F.desc("conf"), "det_id"], suppress, _SCHEMA)


@register("g03_merged_regions")
def g03(spark, sf_dir):
    """Boxes merged into the first region of the page that they overlap by more than half, in order of their ids."""
    return in_page_order(views.detection(spark, sf_dir), ["det_id", "conf"], merge_or_insert, _SCHEMA)


@register("g08_tile_dedupe")
def g08(spark, sf_dir):
    """Text boxes that neighbouring tiles both gave: the one with the longer text (here: the surer) stays."""
    return in_page_order(views.detection(spark, sf_dir).where("name = 'text_box'"), ["det_id"], longer_text, _SCHEMA)


@register("g09_tiles", oracle("v_page", """
WITH s AS (SELECT page_number, 2000 + page_number % 3 * 900 AS w, 1500 + page_number % 5 * 700 AS h FROM v_page)
SELECT page_number, x::INT AS x, y::INT AS y, (least(x + 1200, w) - x)::INT AS width, (least(y + 1200, h) - y)::INT AS height, round((x + 6e2) / w, 6) AS mid_x
FROM s, LATERAL (SELECT unnest(range(0, greatest(w - 300, 1), 900)) AS x) a, LATERAL (SELECT unnest(range(0, greatest(h - 300, 1), 900)) AS y) b"""))
def g09(spark, sf_dir):
    """Tiles of 1200 by 1200 that overlap by 300, and where a tile's middle lies on the page."""
    w, h = 2000 + F.col("page_number") % 3 * 900, 1500 + F.col("page_number") % 5 * 700
    p = views.page(spark, sf_dir).select("page_number", w.cast("int").alias("w"), h.cast("int").alias("h"))
    steps = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 300, F.lit(1)) - 1, F.lit(900))
    t = p.withColumn("x", F.explode(steps("w"))).withColumn("y", F.explode(steps("h")))
    side = lambda at, n: (F.least(F.col(at) + 1200, F.col(n)) - F.col(at)).alias("width" if at == "x" else "height")
    return t.select("page_number", "x", "y", side("x", "w"), side("y", "h"), F.round((F.col("x") + 600) / F.col("w"), 6).alias("mid_x"))


@register("g06_density_cells", oracle("v_detection", """
WITH c AS (SELECT doc_id, least((((minx + maxx) / 2) * 10)::BIGINT, 9) AS gx, least((((miny + maxy) / 2) * 10)::BIGINT, 9) AS gy, count(*) AS n FROM (SELECT *, 0 AS z FROM v_detection) GROUP BY ALL),
d AS (SELECT *, n * 1e0 / max(n) OVER (PARTITION BY doc_id) AS density FROM c), k AS (SELECT doc_id, gx, gy FROM d WHERE density >= 35e-2)
SELECT a.doc_id, a.gx::INT AS gx, a.gy::INT AS gy, count(b.gx) AS neighbours FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND (a.gx <> b.gx OR a.gy <> b.gy) GROUP BY ALL""".replace("::BIGINT", "::DOUBLE").replace("least((((minx + maxx) / 2) * 10)::DOUBLE, 9)", "least(floor(((minx + maxx) / 2) * 10), 9)").replace("least((((miny + maxy) / 2) * 10)::DOUBLE, 9)", "least(floor(((miny + maxy) / 2) * 10), 9)")))
def g06(spark, sf_dir):
    """Dense cells of a ten by ten grid (35 % of the page's densest or more) and how many dense ones touch each, corners too."""
    cell = lambda v: F.least(F.floor(v * 10), F.lit(9)).cast("int")
    n = views.detection(spark, sf_dir).groupBy("doc_id", cell(Box.of().cx).alias("gx"), cell(Box.of().cy).alias("gy")).agg(F.count("*").alias("n"))
    dense = n.withColumn("m", F.max("n").over(W.partitionBy("doc_id"))).where(F.col("n") >= F.col("m") * 0.35).select("doc_id", "gx", "gy")
    near = dense.select("doc_id", F.explode(F.array(*(F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))).alias("at"))
    touched = near.groupBy("doc_id", F.col("at.gx").alias("gx"), F.col("at.gy").alias("gy")).agg(F.count("*").alias("neighbours"))
    return dense.join(touched, ["doc_id", "gx", "gy"], "left").select("doc_id", "gx", "gy", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


# --- tag mapping -----------------------------------------------------------------------------------------------------

_TAGS = "t AS (SELECT DISTINCT upper(tok) AS tag FROM v_word WHERE regexp_matches(tok, '^[A-Z][a-z]+$') AND len(tok) BETWEEN 5 AND 7)"


def tags(spark, sf_dir) -> DataFrame:
    """The tags that are looked for: capitalised words of five to seven letters, in upper case."""
    w = views.word(spark, sf_dir)
    own = w.where(F.col("tok").rlike("^[A-Z][a-z]+$") & F.length("tok").between(5, 7))
    return own.select(upper(F.col("tok")).alias("tag")).distinct()


def tag_hits(spark, sf_dir) -> DataFrame:
    """(``doc_id``, ``idx``, ``tag``, ``cx``, ``cy``): words that equal a tag, whatever their case."""
    return words_with_centres(spark, sf_dir).withColumn("tag", upper(F.col("tok"))).join(tags(spark, sf_dir), "tag", "left_semi").select("doc_id", "idx", "tag", "cx", "cy")


_HITS = f"{_TAGS}, h AS (SELECT v.doc_id, v.idx, t.tag, v.l + v.w / 2 AS cx, v.t + v.h / 2 AS cy FROM v_word v JOIN t ON upper(v.tok) = t.tag)"
_BOUND = """b AS (SELECT h.doc_id, h.idx, h.tag, d.det_id, round((h.cx - (d.minx + d.maxx) / 2) * (h.cx - (d.minx + d.maxx) / 2) + (h.cy - (d.miny + d.maxy) / 2) * (h.cy - (d.miny + d.maxy) / 2), 9) AS d2 FROM h JOIN (SELECT * FROM v_detection WHERE name = 'grid') d ON d.doc_id = h.doc_id),
n AS (SELECT doc_id, idx, tag, det_id, d2 FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY d2, det_id) = 1),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, det_id ORDER BY idx) = 1)"""


def bound(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Each hit's nearest target of the page, ties by id; of several hits with one target the first in order keeps it.

    The nearest is a minimum over the page's targets, combined before the shuffle; a page has few targets.
    """
    t = targets.select("doc_id", "det_id", Box.of().cx.alias("tx"), Box.of().cy.alias("ty"))
    dx, dy = F.col("cx") - F.col("tx"), F.col("cy") - F.col("ty")
    near = hits.join(t, "doc_id").groupBy("doc_id", "idx", "tag").agg(F.min(F.struct(F.round(dx * dx + dy * dy, 9).alias("d2"), "det_id")).alias("n"))
    return near.groupBy("doc_id", F.col("n.det_id").alias("det_id")).agg(F.min(F.struct("idx", "tag", F.col("n.d2").alias("d2"))).alias("h")).select("doc_id", "det_id", "h.idx", "h.tag", "h.d2")


@register("r13_2_text_hits", oracle("v_word", f"WITH {_HITS} SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS pages FROM h GROUP BY tag"))
def r13_2(spark, sf_dir):
    """Tags of text only: every word that is the tag."""
    return tag_hits(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


_INNER = "i AS (SELECT DISTINCT h.doc_id, h.idx, h.tag, d.det_id FROM h JOIN v_detection d ON d.doc_id = h.doc_id AND h.cx BETWEEN d.minx AND d.maxx AND h.cy BETWEEN d.miny AND d.maxy WHERE d.name = 'text_box')"


@register("r13_3_inner_and_floating", oracle("v_word v_detection", f"""
WITH {_HITS}, {_INNER}, rest AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = h.doc_id AND i.idx = h.idx)),
{_BOUND.replace('FROM h JOIN', 'FROM rest h JOIN')}
SELECT doc_id, det_id, tag, idx, 1e0 AS score, 'inner' AS way FROM i UNION ALL SELECT doc_id, det_id, tag, idx, 8e-1, 'floating' FROM f"""))
def r13_3(spark, sf_dir):
    """Tags inside a tag shape, and floating ones bound to the nearest object."""
    hits, found = tag_hits(spark, sf_dir), views.detection(spark, sf_dir)
    inner = points_in_boxes(hits, found.where("name = 'text_box'"), F.col("cx"), F.col("cy")).select("doc_id", "det_id", "tag", "idx").distinct()
    rest = hits.join(inner, ["doc_id", "idx"], "left_anti")
    way = lambda df, score, name: df.select("doc_id", "det_id", "tag", "idx", F.lit(score).alias("score"), F.lit(name).alias("way"))
    return way(inner, 1.0, "inner").unionByName(way(bound(rest, found.where("name = 'grid'")), 0.8, "floating"))


@register("r13_4_shape_to_object", oracle("v_word v_detection", f"""
WITH {_HITS}, {_INNER}, {_BOUND.replace('FROM h JOIN', 'FROM (SELECT h.* FROM h WHERE EXISTS (SELECT 1 FROM i WHERE i.doc_id = h.doc_id AND i.idx = h.idx)) h JOIN')}
SELECT doc_id, det_id, tag, idx, CASE WHEN d2 <= 4e-2 THEN 9e-1 ELSE 85e-2 END AS score FROM f"""))
def r13_4(spark, sf_dir):
    """Tags inside a tag shape, bound to the nearest object."""
    hits, found = tag_hits(spark, sf_dir), views.detection(spark, sf_dir)
    inner = points_in_boxes(hits, found.where("name = 'text_box'"), F.col("cx"), F.col("cy")).select(*hits.columns).distinct()
    return bound(inner, found.where("name = 'grid'")).select("doc_id", "det_id", "tag", "idx", F.when(F.col("d2") <= 0.04, 0.9).otherwise(0.85).alias("score"))


@register("r13_5_nearby_text", oracle("v_word v_detection", f"WITH {_HITS}, {_BOUND} SELECT doc_id, det_id, tag, idx, CASE WHEN d2 <= 4e-2 THEN 8e-1 ELSE 7e-1 END AS score FROM f"))
def r13_5(spark, sf_dir):
    """Tags near an object: every hit bound to the nearest, the first in reading order keeps it."""
    b = bound(tag_hits(spark, sf_dir), views.detection(spark, sf_dir).where("name = 'grid'"))
    return b.select("doc_id", "det_id", "tag", "idx", F.when(F.col("d2") <= 0.04, 0.8).otherwise(0.7).alias("score"))


@register("r16_batch_mapping", oracle("v_word v_detection", f"""
WITH {_HITS}, w AS (SELECT h.doc_id, h.idx, h.tag, max(CASE d.name WHEN 'title_block' THEN 3 WHEN 'tables' THEN 2 WHEN 'drawings' THEN 1 END) AS region FROM h LEFT JOIN v_detection d
  ON d.doc_id = h.doc_id AND h.cx BETWEEN d.minx AND d.maxx AND h.cy BETWEEN d.miny AND d.maxy AND d.name IN ('title_block', 'tables', 'drawings') GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, true AS drawn FROM v_detection WHERE name = 'drawings'),
s AS (SELECT w.*, CASE region WHEN 3 THEN 5e-2 WHEN 2 THEN 3e-1 WHEN 1 THEN 1e0 ELSE 5e-1 END * CASE WHEN len(tag) >= 6 THEN 1e0 ELSE 9e-1 END + CASE WHEN region IS NULL AND drawn IS NULL THEN 1e-1 ELSE 0e0 END AS raw FROM w LEFT JOIN p USING (doc_id)),
c AS (SELECT *, round(least(raw, 1e0), 6) AS score FROM s)
SELECT tag, CASE WHEN score >= 7e-1 THEN 'high' WHEN score >= 35e-2 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN score >= 35e-2 THEN 'none' WHEN region = 3 THEN 'inside_title_block' WHEN region = 2 THEN 'inside_table' ELSE 'weak' END AS reason,
  count(*) AS n, count(DISTINCT doc_id) AS pages FROM c GROUP BY ALL"""))
def r16(spark, sf_dir):
    """All tags on all pages at once: region weight, strength of the tag, tiers and why a hit is dropped."""
    hits, found = tag_hits(spark, sf_dir), views.detection(spark, sf_dir)
    ranked = found.where(F.col("name").isin("title_block", "tables", "drawings")).withColumn("rank", F.when(F.col("name") == "title_block", 3).when(F.col("name") == "tables", 2).otherwise(1))
    region = points_in_boxes(hits, ranked, F.col("cx"), F.col("cy")).groupBy("doc_id", "idx").agg(F.max("rank").alias("region"))
    drawn = found.where("name = 'drawings'").select("doc_id", F.lit(True).alias("drawn")).distinct()
    r = F.col("region")
    weight = F.when(r == 3, 0.05).when(r == 2, 0.3).when(r == 1, 1.0).otherwise(0.5) * F.when(F.length("tag") >= 6, 1.0).otherwise(0.9)
    raw = weight + F.when(r.isNull() & F.col("drawn").isNull(), 0.1).otherwise(0.0)
    s = hits.join(region, ["doc_id", "idx"], "left").join(drawn, "doc_id", "left").withColumn("score", F.round(F.least(raw, F.lit(1.0)), 6))
    tier = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.35, "medium").otherwise("low")
    reason = F.when(F.col("score") >= 0.35, "none").when(r == 3, "inside_title_block").when(r == 2, "inside_table").otherwise("weak")
    return s.groupBy("tag", tier.alias("tier"), reason.alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


# --- classifiers of regions -----------------------------------------------------------------------------------------


_FEATURES = """w AS (SELECT d.doc_id, d.det_id, v.tok, v.line_idx, v.idx % 12 AS col FROM v_detection d JOIN v_word v ON v.doc_id = d.doc_id AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND d.maxy WHERE d.name IN ('text_box', 'tables')),
g AS (SELECT doc_id, det_id, count(*) AS words, count(DISTINCT line_idx) AS n_lines, count(DISTINCT col) AS cols, avg(CASE WHEN regexp_matches(tok, '^[0-9A-Z]') THEN 1e0 ELSE 0e0 END) AS led, avg(len(tok)) AS width FROM w GROUP BY ALL)"""


@register("r07a_region_kinds", oracle("v_word v_detection", f"""
WITH {_FEATURES} SELECT doc_id, det_id, words, n_lines, cols, CASE WHEN round(led, 9) >= 6e-1 AND cols <= 2 THEN 'numbered' WHEN cols >= 3 AND n_lines >= 3 THEN 'schedule' WHEN cols = 2 AND round(width, 9) < 4e0 THEN 'key-value' WHEN words > 50 THEN 'spec' WHEN words >= 15 THEN 'paragraph' ELSE 'unknown' END AS kind FROM g"""))
def r07a(spark, sf_dir):
    """The kind of each text region by its words, lines and columns."""
    return region_kinds(spark, sf_dir).select("doc_id", "det_id", "words", "n_lines", "cols", "kind")


def region_kinds(spark, sf_dir) -> DataFrame:
    w = views.word(spark, sf_dir).select("doc_id", "tok", "line_idx", (F.col("idx") % 12).alias("col"), (F.col("l") + F.col("w") / 2).alias("cx"), (F.col("t") + F.col("h") / 2).alias("cy"))
    inside = points_in_boxes(w, views.detection(spark, sf_dir).where(F.col("name").isin("text_box", "tables")), F.col("cx"), F.col("cy"))
    leading = F.avg(F.when(F.col("tok").rlike("^[0-9A-Z]"), 1.0).otherwise(0.0))
    g = inside.groupBy("doc_id", "det_id").agg(
        F.count("*").alias("words"), F.count_distinct("line_idx").alias("n_lines"), F.count_distinct("col").alias("cols"), F.round(leading, 9).alias("leading"), F.round(F.avg(F.char_length("tok")), 9).alias("width")
    )
    kind = (
        F.when((F.col("leading") >= 0.6) & (F.col("cols") <= 2), "numbered").when((F.col("cols") >= 3) & (F.col("n_lines") >= 3), "schedule")
        .when((F.col("cols") == 2) & (F.col("width") < 4), "key-value").when(F.col("words") > 50, "spec").when(F.col("words") >= 15, "paragraph").otherwise("unknown")
    )
    return g.withColumn("kind", kind)


#: Category, the kind of region that it wants, and words that speak for it.
CATEGORIES = (("licence-table", "schedule", "license"), ("rights-notes", "key-value", "rights"), ("article-list", "schedule", "the"), ("word-list", "numbered", "les"), ("glossary", "unknown", "der"))


@register("r08_table_categories", oracle("v_word v_detection", f"""
WITH {_FEATURES}, k AS (SELECT doc_id, det_id, CASE WHEN round(led, 9) >= 6e-1 AND cols <= 2 THEN 'numbered' WHEN cols >= 3 AND n_lines >= 3 THEN 'schedule' WHEN cols = 2 AND round(width, 9) < 4e0 THEN 'key-value' WHEN words > 50 THEN 'spec' WHEN words >= 15 THEN 'paragraph' ELSE 'unknown' END AS kind FROM g),
p(category, wants, word) AS (VALUES {', '.join(map(repr, CATEGORIES))}), f AS (SELECT DISTINCT doc_id, det_id, lower(tok) AS word FROM w),
s AS (SELECT k.doc_id, k.det_id, p.category, CASE WHEN kind = wants THEN 3e-1 ELSE 5e-2 END + CASE WHEN f.word IS NOT NULL THEN 2e-1 ELSE 0e0 END AS score FROM k CROSS JOIN p LEFT JOIN f ON f.doc_id = k.doc_id AND f.det_id = k.det_id AND f.word = p.word WHERE kind <> 'paragraph')
SELECT doc_id, det_id, category, round(score, 6) AS score FROM s WHERE round(score, 6) >= 3e-1 QUALIFY row_number() OVER (PARTITION BY doc_id, det_id ORDER BY round(score, 6) DESC, category) = 1"""))
def r08(spark, sf_dir):
    """The category of each table region: its kind and telling words add up; under 0.3 none; paragraphs are skipped."""
    hits = points_in_boxes(words_with_centres(spark, sf_dir), views.detection(spark, sf_dir).where(F.col("name").isin("text_box", "tables")), F.col("cx"), F.col("cy"))
    told = hits.where(F.lower("tok").isin(*(w for _, _, w in CATEGORIES))).groupBy("doc_id", "det_id").agg(F.collect_set(F.lower("tok")).alias("told"))  # a set of these few words
    k = region_kinds(spark, sf_dir).where("kind <> 'paragraph'").join(told, ["doc_id", "det_id"], "left")
    score = lambda wants, word: F.round(F.when(F.col("kind") == wants, 0.3).otherwise(0.05) + F.when(F.array_contains("told", word), 0.2).otherwise(0.0), 6)
    best = F.array_min(F.array(*(F.struct((-score(wants, word)).alias("loss"), F.lit(c).alias("category")) for c, wants, word in CATEGORIES)))
    return k.select("doc_id", "det_id", best.alias("b")).select("doc_id", "det_id", "b.category", (-F.col("b.loss")).alias("score")).where("score >= 0.3")


@register("j11_header_keywords", oracle("v_word v_detection", """
SELECT d.doc_id, d.det_id, arg_min(lower(v.tok), v.idx) AS keyword FROM v_detection d JOIN v_word v ON v.doc_id = d.doc_id AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND round(d.miny + (d.maxy - d.miny) * 5e-1, 9)
WHERE d.name = 'tables' AND lower(v.tok) IN ('the', 'of', 'die', 'les', 'los') GROUP BY ALL"""))
def j11(spark, sf_dir):
    """Tables with a schedule keyword in their upper strip, and the first such word."""
    top = views.detection(spark, sf_dir).where("name = 'tables'").withColumn("maxy", F.round(F.col("miny") + (F.col("maxy") - F.col("miny")) * 0.5, 9))
    words = words_with_centres(spark, sf_dir).where(F.lower("tok").isin("the", "of", "die", "les", "los"))
    return points_in_boxes(words, top, F.col("cx"), F.col("cy")).groupBy("doc_id", "det_id").agg(F.min_by(F.lower("tok"), "idx").alias("keyword"))


@register("w20_region_rerank", oracle("v_word v_detection", """
WITH c AS (SELECT doc_id, idx, tok, l + w / 2 AS cx, t + h / 2 AS cy FROM v_word WHERE regexp_matches(tok, '^[A-Z][a-z]+$')),
f AS (SELECT c.doc_id, c.idx, max(CASE d.name WHEN 'title_block' THEN 2 ELSE 1 END) AS best FROM c JOIN v_detection d ON d.doc_id = c.doc_id AND c.cx BETWEEN d.minx AND d.maxx AND c.cy BETWEEN d.miny AND d.maxy WHERE d.name IN ('title_block', 'drawings') GROUP BY ALL)
SELECT doc_id, idx, round(5e-1 + CASE best WHEN 2 THEN 2e-1 WHEN 1 THEN 1e-1 ELSE -4e-1 END, 6) AS score FROM c LEFT JOIN f USING (doc_id, idx)"""))
def w20(spark, sf_dir):
    """Candidates gain in a title block and, less, in a drawing; outside both they lose."""
    c = words_with_centres(spark, sf_dir).where(F.col("tok").rlike("^[A-Z][a-z]+$"))
    boxes = views.detection(spark, sf_dir).where(F.col("name").isin("title_block", "drawings")).withColumn("best", F.when(F.col("name") == "title_block", 2).otherwise(1))
    f = points_in_boxes(c, boxes, F.col("cx"), F.col("cy")).groupBy("doc_id", "idx").agg(F.max("best").alias("best"))
    gain = F.when(F.col("best") == 2, 0.2).when(F.col("best") == 1, 0.1).otherwise(-0.4)
    return c.join(f, ["doc_id", "idx"], "left").select("doc_id", "idx", F.round(F.lit(0.5) + gain, 6).alias("score"))


@register("t16_region_snippets", oracle("v_word v_detection", """
SELECT d.doc_id, d.det_id, substr(string_agg(v.tok, ' ' ORDER BY v.idx), 1, 300) AS snippet FROM (SELECT DISTINCT doc_id, det_id, minx, miny, maxx, maxy FROM v_detection WHERE name = 'drawings') d
JOIN v_word v ON v.doc_id = d.doc_id AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND d.maxy GROUP BY d.doc_id, d.det_id, d.minx, d.miny, d.maxx, d.maxy"""))
def t16(spark, sf_dir):
    """The first 300 characters of the text in each marked box (the cap is the feature)."""
    boxes = views.detection(spark, sf_dir).where("name = 'drawings'").select("doc_id", "det_id", *BOX).distinct()
    hits = points_in_boxes(words_with_centres(spark, sf_dir), boxes, F.col("cx"), F.col("cy"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("idx", "tok"))), lambda x: x["tok"])  # the words of one box
    return hits.groupBy("doc_id", "det_id", *BOX).agg(F.substring(F.array_join(words, " "), 1, 300).alias("snippet")).select("doc_id", "det_id", "snippet")


@register("r09_composite_regions", oracle("v_word v_detection", """
WITH k AS (SELECT DISTINCT d.doc_id, d.det_id FROM v_detection d JOIN v_word v ON v.doc_id = d.doc_id AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND round(d.miny + (d.maxy - d.miny) * 5e-1, 9)
  WHERE d.name = 'tables' AND lower(v.tok) IN ('the', 'of', 'die', 'les', 'los')),
g AS (SELECT DISTINCT a.doc_id, a.det_id FROM v_detection a JOIN v_detection b ON a.doc_id = b.doc_id WHERE a.name = 'tables' AND b.name = 'grid' AND greatest(a.minx, b.minx) <= least(a.maxx, b.maxx) AND greatest(a.miny, b.miny) <= least(a.maxy, b.maxy))
SELECT DISTINCT d.doc_id, d.det_id, CASE WHEN k.det_id IS NOT NULL AND g.det_id IS NOT NULL THEN 95e-2 WHEN g.det_id IS NOT NULL THEN 9e-1 WHEN k.det_id IS NOT NULL THEN 8e-1 ELSE 7e-1 END AS confidence
FROM v_detection d LEFT JOIN k USING (doc_id, det_id) LEFT JOIN g USING (doc_id, det_id) WHERE d.name = 'tables'"""))
def r09(spark, sf_dir):
    """Tables with a confidence that rises where a grid meets them and where a keyword stands in their upper half."""
    from plansift.operators.spatial import box_pairs

    d = views.detection(spark, sf_dir)
    own = d.where("name = 'tables'")
    told = j11(spark, sf_dir).select("doc_id", "det_id", F.lit(True).alias("told"))
    met = box_pairs(own, d.where("name = 'grid'")).select("doc_id", "det_id", F.lit(True).alias("met")).distinct()
    j = own.select("doc_id", "det_id").distinct().join(told, ["doc_id", "det_id"], "left").join(met, ["doc_id", "det_id"], "left")
    told, met = F.col("told").isNotNull(), F.col("met").isNotNull()
    return j.select("doc_id", "det_id", F.when(told & met, 0.95).when(met, 0.9).when(told, 0.8).otherwise(0.7).alias("confidence"))
