"""Named query tools with typed arguments, by which a client (a chat, an API) asks for rows.

A tool has a JSON schema; arguments are checked against it before anything runs.  Arguments become filters on the tables,
so a tool for one page reads that page's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions.geometry import Box, zone
from plansift.functions.text import upper
from plansift.operators import notes, search
from plansift.operators.relational import a42
from plansift.operators.spatial import points_in_boxes
from plansift.operators.tables import cells
from plansift.operators.taxonomy import phrase_hits
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

_PAGE = {"type": "integer", "description": "number of a page"}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
_CLASS = {"type": "string", "description": "class of detected boxes"}
_TEXT = {"type": "string", "minLength": 1}
_EDGES = ("minX", "minY", "maxX", "maxY")


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., DataFrame]
    properties: dict[str, dict] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> dict:
        return {"name": self.name, "description": self.description, "input_schema": {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}}


_TOOLS: dict[str, Tool] = {}


def _tool(name: str, description: str, required: tuple[str, ...] = (), /, **properties: dict) -> Callable:
    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _TOOLS[name] = Tool(name, description, run, properties, required)
        return run

    return add


def tools() -> dict[str, Tool]:
    return dict(_TOOLS)


_TYPES = {"string": str, "integer": int, "number": (int, float)}


def checked(tool: Tool, arguments: dict) -> dict:
    """The arguments, or a ValueError that names what is wrong with them."""
    missing, unknown = set(tool.required) - set(arguments), set(arguments) - set(tool.properties)
    if missing or unknown:
        raise ValueError(f"{tool.name}: missing {sorted(missing)}, unknown {sorted(unknown)}")
    for name, value in arguments.items():
        p = tool.properties[name]
        if not isinstance(value, _TYPES[p["type"]]) or isinstance(value, bool):
            raise ValueError(f"{tool.name}: {name} is no {p['type']}")
        if "enum" in p and value not in p["enum"]:
            raise ValueError(f"{tool.name}: {name} is one of {p['enum']}")
        if not p.get("minimum", value) <= value <= p.get("maximum", value) or len(str(value)) < p.get("minLength", 0):
            raise ValueError(f"{tool.name}: {name} is out of range")
    return arguments


def call(spark: SparkSession, sf_dir: str, name: str, arguments: dict) -> DataFrame:
    """The rows that a tool gives for its arguments."""
    if name not in _TOOLS:
        raise KeyError(f"no tool {name}")
    return _TOOLS[name].run(spark, sf_dir, **checked(_TOOLS[name], arguments))


def _page(df: DataFrame, page: int | None, name: str = "doc_id") -> DataFrame:
    return df if page is None else df.where(F.col(name) == page)


def _boxes(spark, sf_dir, page: int | None = None, cls: str | None = None, least: float = 0.0) -> DataFrame:
    d = _page(views.detection(spark, sf_dir), page).where(F.col("conf") >= least)
    return d if cls is None else d.where(F.col("name") == cls)


def _words(spark, sf_dir, page: int | None = None) -> DataFrame:
    """Words of a page, or of all, with their middles."""
    w = views.word_of(_page(read(spark, sf_dir, "documents", "doc_id", "text"), page))
    return w.withColumns({"cx": F.col("l") + F.col("w") / 2, "cy": F.col("t") + F.col("h") / 2})


@_tool("searchPages", "Pages by their text, best first; words in any order, or a phrase in quotes.", ("query",), query={"type": "string", "minLength": 2})
def search_pages(spark, sf_dir, query: str) -> DataFrame:
    q = search.parsed(query)
    found = search.matches(search.stored_index(spark, sf_dir), q)
    ranks = search.ranked(found, q)
    shown = search.headlines(found, read(spark, sf_dir, "documents", "doc_id", "text"), q)
    return ranks.join(shown, "doc_id", "left").select("doc_id", "project_id", "rank", "headline").orderBy(F.desc("rank"), "doc_id")


@_tool("getProjectOverview", "Counts of pages, codes by division, boxes by class: the map of all projects.")
def project_overview(spark, sf_dir) -> DataFrame:
    row = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))
    codes = views.page_code(spark, sf_dir)
    parts = [(views.page(spark, sf_dir), "pages", F.col("project_id")), (codes, "division", F.col("division")), (codes, "trade", F.col("trade")), (_boxes(spark, sf_dir), "class", F.col("name"))]
    out = None
    for df, kind, key in parts:
        out = row(df, kind, key) if out is None else out.union(row(df, kind, key))
    return out


@_tool("getPageDetails", "A page's number, project, codes, trades and boxes by class.", ("pageNumber",), pageNumber=_PAGE)
def page_details(spark, sf_dir, pageNumber: int) -> DataFrame:
    page = _page(views.page(spark, sf_dir), pageNumber, "page_number").select("page_number", "project_id", "drawing_number")
    codes = _page(views.page_code(spark, sf_dir), pageNumber).groupBy(F.col("doc_id").alias("page_number")).agg(F.sort_array(F.collect_set("code")).alias("codes"), F.sort_array(F.collect_set("trade")).alias("trades"))
    boxes = _boxes(spark, sf_dir, pageNumber).groupBy(F.col("doc_id").alias("page_number"), "name").agg(F.count("*").alias("n"))
    counted = boxes.groupBy("page_number").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("classes"))
    return page.join(codes, "page_number", "left").join(counted, "page_number", "left")


@_tool("lookupPagesByIndex", "The pages that have a code, a trade, a division, a class of boxes or a key of notes.", ("index", "key"), index={"type": "string", "enum": ["csi", "trade", "division", "class", "keynote"]}, key=_TEXT)
def lookup_pages(spark, sf_dir, index: str, key: str) -> DataFrame:
    if index == "class":
        return _boxes(spark, sf_dir, cls=key).select("doc_id").distinct()
    if index == "keynote":
        return notes.parsed(notes.note_lines(spark, sf_dir)).where(F.col("key") == key).select("doc_id").distinct()
    return views.page_code(spark, sf_dir).where(F.col({"csi": "code"}.get(index, index)) == key).select("doc_id").distinct()


@_tool("getAnnotations", "Detected boxes, by page, class and least confidence.", pageNumber=_PAGE, className=_CLASS, minConfidence=_SHARE)
def annotations(spark, sf_dir, pageNumber: int | None = None, className: str | None = None, minConfidence: float = 0.25) -> DataFrame:
    return _boxes(spark, sf_dir, pageNumber, className, minConfidence)


@_tool("getParsedSchedule", "The cells of a page's tables.", ("pageNumber",), pageNumber=_PAGE)
def parsed_schedule(spark, sf_dir, pageNumber: int) -> DataFrame:
    return _page(cells(spark, sf_dir), pageNumber)


@_tool("getCsiSpatialMap", "Codes of a page by the zones of its boxes.", ("pageNumber",), pageNumber=_PAGE)
def spatial_map(spark, sf_dir, pageNumber: int) -> DataFrame:
    zones = _boxes(spark, sf_dir, pageNumber).groupBy("doc_id", zone(Box.of().cx, Box.of().cy).alias("zone")).agg(F.count("*").alias("boxes"))
    return zones.join(_page(views.page_code(spark, sf_dir), pageNumber).groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("codes")), "doc_id", "left")


@_tool("getCrossReferences", "References from a page, or all.", pageNumber=_PAGE)
def cross_references(spark, sf_dir, pageNumber: int | None = None) -> DataFrame:
    return _page(views.cross_ref(spark, sf_dir), pageNumber, "from_doc").groupBy("from_doc", "to_doc").agg(F.count("*").alias("n"))


@_tool("getSpatialContext", "Words of a page by the class of the boxes that they stand in.", ("pageNumber",), pageNumber=_PAGE)
def spatial_context(spark, sf_dir, pageNumber: int) -> DataFrame:
    hits = points_in_boxes(_words(spark, sf_dir, pageNumber), _boxes(spark, sf_dir, pageNumber), F.col("cx"), F.col("cy"))
    return hits.groupBy("doc_id", "name").agg(F.count_distinct("idx").alias("words"))


@_tool("getPageOcrText", "The text of a page.", ("pageNumber",), pageNumber=_PAGE)
def page_text(spark, sf_dir, pageNumber: int) -> DataFrame:
    return _page(read(spark, sf_dir, "documents", "doc_id", "text"), pageNumber)


@_tool("detectCsiFromText", "Codes whose description stands in a text.", ("text",), text=_TEXT)
def detect_codes(spark, sf_dir, text: str) -> DataFrame:
    words = views.word_of(spark.createDataFrame([(0, text)], "doc_id long, text string"))
    codes = views.taxonomy(spark, sf_dir)
    return phrase_hits(words, codes).select("code").distinct().join(codes, "code")


@_tool("scanYoloClassTexts", "Texts inside boxes of a class and how often each occurs.", ("yoloClass",), yoloClass=_CLASS, pageNumber=_PAGE)
def class_texts(spark, sf_dir, yoloClass: str, pageNumber: int | None = None) -> DataFrame:
    hits = points_in_boxes(_words(spark, sf_dir, pageNumber), _boxes(spark, sf_dir, pageNumber, yoloClass), F.col("cx"), F.col("cy"))
    return hits.groupBy(F.lower("tok").alias("text")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


@_tool("mapTagsToPages", "Where tags (with commas between) stand, on a page or all, in boxes of a class or anywhere.", ("tags",), tags=_TEXT, yoloClass=_CLASS, pageNumber=_PAGE)
def map_tags(spark, sf_dir, tags: str, yoloClass: str | None = None, pageNumber: int | None = None) -> DataFrame:
    wanted = sorted({t.strip().upper() for t in tags.split(",") if t.strip()})
    hits = _words(spark, sf_dir, pageNumber).withColumn("tag", upper(F.regexp_replace("tok", "[.,;:]+$", ""))).where(F.col("tag").isin(*wanted))
    if yoloClass is not None:
        hits = points_in_boxes(hits, _boxes(spark, sf_dir, pageNumber, yoloClass), F.col("cx"), F.col("cy")).select(*hits.columns).distinct()
    return hits.groupBy("tag", "doc_id").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


@_tool("detectTagPatterns", "Groups of tags of one form.")
def tag_patterns(spark, sf_dir) -> DataFrame:
    return a42(spark, sf_dir)


def _region(x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)


@_tool("getOcrTextInRegion", "The words of a page in a rectangle, in order.", ("pageNumber", *_EDGES), pageNumber=_PAGE, **dict.fromkeys(_EDGES, _SHARE))
def region_text(spark, sf_dir, pageNumber: int, minX: float, minY: float, maxX: float, maxY: float) -> DataFrame:
    w = _words(spark, sf_dir, pageNumber).where(_region(minX, minY, maxX, maxY))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tok"))), lambda x: x["tok"]), " ")  # one page's words
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), text.alias("text"))


@_tool("createMarkup", "A row for a new mark on a page, to be written by an upsert.", ("pageNumber", *_EDGES, "name"), pageNumber=_PAGE, name=_TEXT, note=_TEXT, **dict.fromkeys(_EDGES, _SHARE))
def create_markup(spark, sf_dir, pageNumber: int, minX: float, minY: float, maxX: float, maxY: float, name: str, note: str | None = None) -> DataFrame:
    if minX >= maxX or minY >= maxY:
        raise ValueError("createMarkup: the rectangle is empty")
    schema = "doc_id long, name string, minx double, miny double, maxx double, maxy double, source string, note string"
    return spark.createDataFrame([(pageNumber, name, float(minX), float(minY), float(maxX), float(maxY), "user", note)], schema)


@_tool("batchAddNotes", "Boxes by page, class and least confidence with a note appended, to be written by an upsert.", ("note",), note=_TEXT, pageNumber=_PAGE, className=_CLASS, minConfidence=_SHARE)
def batch_notes(spark, sf_dir, note: str, pageNumber: int | None = None, className: str | None = None, minConfidence: float = 0.0) -> DataFrame:
    return _boxes(spark, sf_dir, pageNumber, className, minConfidence).withColumn("note", F.lit(note))


@register("v05_tag_tool", oracle("v_word v_detection", """
SELECT upper(regexp_replace(v.tok, '[.,;:]+$', '')) AS tag, v.doc_id, count(DISTINCT v.idx) AS n, min(v.idx) AS first FROM v_word v JOIN v_detection d ON v.doc_id = d.doc_id AND d.name = 'text_box' AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND d.maxy
WHERE upper(regexp_replace(v.tok, '[.,;:]+$', '')) IN ('THE', 'DE', 'LICENSE') GROUP BY ALL"""))
def v05_tags(spark, sf_dir):
    """The tool for tags, asked for three of them inside text boxes."""
    return call(spark, sf_dir, "mapTagsToPages", {"tags": "the, de,License", "yoloClass": "text_box"})


@register("v05_annotation_tool", oracle("v_detection", "SELECT doc_id, det_id, name, minx, miny, maxx, maxy, conf FROM v_detection WHERE name = 'grid' AND conf >= 7e-1"))
def v05_annotations(spark, sf_dir):
    """The tool for boxes, asked for sure grids."""
    return call(spark, sf_dir, "getAnnotations", {"className": "grid", "minConfidence": 0.7})


@register("v05_class_text_tool", oracle("v_word v_detection", "SELECT lower(tok) AS text, count(*) AS n, count(DISTINCT v.doc_id) AS pages FROM v_word v JOIN v_detection d ON v.doc_id = d.doc_id AND d.name = 'title_block' AND v.l + v.w / 2 BETWEEN d.minx AND d.maxx AND v.t + v.h / 2 BETWEEN d.miny AND d.maxy GROUP BY 1"))
def v05_class_texts(spark, sf_dir):
    """The tool for texts in boxes, asked for title blocks."""
    return call(spark, sf_dir, "scanYoloClassTexts", {"yoloClass": "title_block"})
