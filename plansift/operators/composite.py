"""Tables, title blocks and drawings of a page from all sources, confirmed by other boxes and headers, and merged.

Confirmations and headers are joins by page that keep each box, so that boxes are read once and stay where they are dealt; merging follows the surveyed order and streams over a page's
candidates, each into the first region that it overlaps by more than half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.geometry import Box
from plansift.functions.text import whole_word
from plansift.operators.layout import text_regions
from plansift.operators.regions import in_page_order, iou
from plansift.plans import views
from plansift.plans.registry import register

#: Words in the header of a table, the overlaps that merge and confirm, and the strip of a box that is its top.
HEADERS = (
    "SCHEDULE", "LEGEND", "NOTES", "GENERAL NOTES", "KEY NOTES", "KEYNOTES", "DOOR SCHEDULE", "WINDOW SCHEDULE", "ROOM FINISH SCHEDULE", "HARDWARE SCHEDULE", "WALL TYPE", "FINISH SCHEDULE", "EQUIPMENT SCHEDULE",
    "PLUMBING SCHEDULE", "LIGHTING SCHEDULE", "MECHANICAL SCHEDULE", "ELECTRICAL LEGEND", "SYMBOLS LEGEND",
)
MERGE, CONFIRM, TOP = 0.5, 0.6, 0.15
#: Confidences of tables (alone, with areas, a grid, a header; saved ones, classified ones, grids with a header),
#: of title blocks and drawings alone and confirmed.
TABLE, WITH_AREA, WITH_GRID, WITH_HEADER, SAVED, CLASSIFIED, GRID, TITLE, TITLE_SURE, DRAWING, DRAWING_SURE = 0.7, 0.8, 0.85, 0.95, 0.95, 0.6, 0.65, 0.85, 0.95, 0.8, 0.95

_BOX = ("minx", "miny", "maxx", "maxy")
_KEY = ("doc_id", "det_id", *_BOX)
_SCHEMA = "page string, place int, minx double, miny double, maxx double, maxy double, confidence double, sources string, header string"


def _confirmed(boxes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Boxes with ``by_<name>``: whether a box of that class lies in it by 60 % of its own size; one join for all classes."""
    p, q = Box.of(), Box.of("b_")
    by = boxes.where(F.col("name").isin(*names))
    right = by.select(F.col("doc_id").alias("b_doc"), F.col("name").alias("b_name"), *(F.col(c).alias(f"b_{c}") for c in _BOX)).where(q.area > 0)
    inside = (F.col("doc_id") == F.col("b_doc")) & (F.round(p.shared(q) / q.area, 9) >= CONFIRM)
    met = boxes.join(right.hint("shuffle_hash"), inside, "left")
    # what is dealt by page is grouped by page and more: nothing is shuffled
    return met.groupBy(*boxes.columns).agg(*(F.coalesce(F.bool_or(F.col("b_name") == n), F.lit(False)).alias(f"by_{n}") for n in names))


def _headed(boxes: DataFrame, headers: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Boxes with the header of tables and grids: that of the first text region that meets the top and has a keyword."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | whole_word(F.col("header"), k)
    named = headers.where(F.col("header").isNotNull() & hit).select(F.col("doc_id").alias("b_doc"), F.col("region").alias("b_region"), F.col("header").alias("b_header"), *(F.col(c).alias(f"b_{c}") for c in _BOX))
    p = Box.of()
    strip = Box(p.minx, p.miny, p.maxx, p.miny + (p.maxy - p.miny) * TOP)
    meets = (F.col("doc_id") == F.col("b_doc")) & F.col("name").isin("tables", "grid") & (strip.shared(Box.of("b_")) > 0)
    return boxes.join(named.hint("shuffle_hash"), meets, "left").groupBy(*boxes.columns).agg(F.min_by("b_header", "b_region").alias("header"))


def _step(kept: list[tuple], r: tuple) -> tuple | None:
    """A candidate joins the first region that it overlaps, which grows; a grid only stands where no table holds its middle."""
    if r[7].startswith("yolo:grid"):
        x, y = (r[2] + r[4]) / 2, (r[3] + r[5]) / 2
        if any(k[2] <= x <= k[4] and k[3] <= y <= k[5] for k in kept):
            return None
    for n, k in enumerate(kept):
        if iou(k[2:6], r[2:6]) > MERGE:
            sources = k[7].split("+") + [s for s in r[7].split("+") if s not in k[7].split("+")]
            kept[n] = (*k[:2], min(k[2], r[2]), min(k[3], r[3]), max(k[4], r[4]), max(k[5], r[5]), max(k[6], r[6]), "+".join(sources), k[8] or r[8])
            return None
    return r


def page_regions(boxes: DataFrame, headers: DataFrame, saved: DataFrame | None = None, classified: DataFrame | None = None, keywords: tuple[str, ...] = HEADERS) -> DataFrame:
    """``doc_id, kind`` (table, title_block, drawings), box, ``confidence``, ``sources`` and ``header`` of pages.

    ``boxes`` has ``doc_id, det_id, name, model`` and the box, ``headers`` text regions (``doc_id, region, header``, box),
    ``saved`` and ``classified`` tables (``doc_id, det_id``, box).  Drawings that two models gave are surer.
    """
    b = boxes.select(*_KEY, "name", "model").distinct()
    b = _headed(_confirmed(b, ("grid", "vertical_area", "horizontal_area")), headers, keywords)
    grid, va, ha, head = F.col("by_grid"), F.col("by_vertical_area"), F.col("by_horizontal_area"), F.col("header").isNotNull()
    name = F.col("name")
    source = lambda *parts: F.array_join(F.array_compact(F.array(*(F.when(c, s) for c, s in parts))), "+")
    yes = F.lit(True)

    def row(kind: str, order: int, confidence: Column, sources: Column, header: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("turn"), confidence.cast("double").alias("confidence"), sources.alias("sources"), header.cast("string").alias("header"))

    sure = F.when(head, WITH_HEADER).when(grid, WITH_GRID).when(va | ha, WITH_AREA).otherwise(TABLE)
    told = source((yes, "yolo:tables"), (grid, "yolo:grid"), (va, "yolo:vertical_area"), (ha, "yolo:horizontal_area"), (head, "ocr:header_keyword"))
    no = F.lit(None)
    # a box is one candidate at most, so that boxes are read once
    own = F.when(name == "tables", row("table", 0, sure, told, F.col("header")))
    own = own.when((name == "grid") & head, row("table", 3, F.lit(GRID), F.lit("yolo:grid+ocr:header_keyword"), F.col("header")))
    own = own.when(name == "title_block", row("title_block", 0, F.when(va, TITLE_SURE).otherwise(TITLE), source((yes, "yolo:title_block"), (va, "yolo:vertical_area")), no))
    own = own.when(name == "drawings", row("drawings", 0, F.lit(DRAWING), F.lit("yolo:drawings"), no))
    every = b.select(*_KEY, own.alias("r")).where("r IS NOT NULL")
    for df, n, conf, word in ((saved, 1, SAVED, "parsedRegions"), (classified, 2, CLASSIFIED, "pageIntel:classifiedTables")):
        if df is not None:
            every = every.union(df.select(*_KEY, row("table", n, F.lit(conf), F.lit(word), no).alias("r")))
    page = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("r.kind"))
    every = every.select(page.alias("page"), F.col("r.turn").alias("turn"), "det_id", *_BOX, "r.confidence", "r.sources", "r.header")
    placed = every.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy("turn", "det_id", "minx", "miny", "maxx", "maxy")))
    merged = in_page_order(placed, ["place"], _step, _SCHEMA, on="page")
    out = merged.select(F.regexp_extract("page", r"^(.*)\|", 1).cast(boxes.schema["doc_id"].dataType).alias("doc_id"), F.regexp_extract("page", r"\|([a-z_]+)$", 1).alias("kind"), "place", "minx", "miny", "maxx", "maxy", "confidence", "sources", "header")
    drawn = boxes.where(F.col("name") == "drawings").select(F.col("doc_id").alias("b_doc"), F.col("model").alias("b_model"), *(F.col(c).alias(f"b_{c}") for c in _BOX))
    same = (F.col("doc_id") == F.col("b_doc")) & (F.col("kind") == "drawings") & (F.round(Box.of().iou(Box.of("b_")), 9) > MERGE)
    told = out.join(drawn.hint("shuffle_hash"), same, "left").groupBy(*out.columns).agg((F.min("b_model") < F.max("b_model")).alias("two"))
    return told.select("doc_id", "kind", *_BOX, F.when(F.col("two"), F.greatest("confidence", F.lit(DRAWING_SURE))).otherwise(F.col("confidence")).alias("confidence"), "sources", "header")


@register("r09_page_regions")
def r09(spark, sf_dir):
    """Regions of pages from boxes and the headers of their texts (a loop over pages in pytest)."""
    d = views.detection(spark, sf_dir).withColumn("model", F.when(F.pmod(F.crc32(F.col("det_id").cast("binary")), F.lit(2)) == 0, "medium").otherwise("primitive"))
    page = F.split("doc_id", "/")[0].cast("long")
    t = text_regions(views.layout(spark, sf_dir)).select(page.alias("doc_id"), F.concat_ws("/", F.split("doc_id", "/")[1], "region").alias("region"), "type", "header", "minx", "miny", "maxx", "maxy")
    found = t.where("type = 'schedule-table'").select("doc_id", F.col("region").alias("det_id"), "minx", "miny", "maxx", "maxy")
    return page_regions(d, t, classified=found, keywords=(*HEADERS, "LICENSE", "THE", "DE"))
