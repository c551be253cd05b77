"""Text regions from the lines of a page, and the columns of a page from its gutters.

Lines (``doc_id, n, text, words`` and their box; ``doc_id`` names a page) become candidate regions by two sweeps in order:
lines whose x ranges meet, directly or through others, form a band as long as each starts before the running right edge;
a band is cut where a line starts too far below the running bottom.  Candidates that overlap are merged as components.
Lines are dealt out once, by page, and stream in order of pages: each step follows from the lines before, for many pages at once, and
none compares all lines of a page with all; only a page's candidate regions meet one another.  `candidates` and `merged` are the same
steps as windows and rows, for queries that ask for them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.text import upper, whole_word
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle

#: Fixed values of the classifier: gap in line heights, merging, columns, headers, shares and sizes.
GAP, IOU, CONTAINED, COLUMN, HEADER, NUMBERED, SHORT, NARROW, SPEC_WORDS, LEAST = 4.0, 0.4, 0.6, 0.02, 1.3, 0.6, 20, 0.35, 50, 5
#: The corner of a page where title blocks stand.
TITLE_BLOCK = (0.45, 0.7, 1.0, 1.0)
#: First marks of numbered items and of sections of specifications.
NUMBERED_ITEM, SECTION = r"^\s*\(?([0-9]{1,3})\s*[.):]\s*", r"\b(PART\s*[0-9]|SECTION\s*[0-9]{2})\b"
#: Keywords of families, kinds and trades; the longest that a text has counts, of equals the first.
FAMILIES = ("SPECIFICATIONS", "SPECIFICATION", "SCHEDULE", "LEGEND", "ABBREVIATIONS", "NOTES", "NOTE")
KINDS = (
    "REFLECTED CEILING", "GENERAL NOTES", "GENERAL NOTE", "DEMOLITION", "DEMO NOTE", "KEY NOTE", "KEYNOTE", "SHEET NOTE", "DRAWING NOTE", "RCP", "GENERAL", "DEMO", "KEY", "PART 1", "PART 2", "PART 3",
    "DOOR SCHEDULE", "FINISH SCHEDULE", "WINDOW SCHEDULE", "EQUIPMENT SCHEDULE", "ROOM FINISH", "MATERIAL SCHEDULE", "SYMBOL LEGEND", "EQUIPMENT TAG", "HVAC", "PLUMBING", "ELECTRICAL",
)
TRADES = (
    "CONCRETE", "REBAR", "MASONRY", "STEEL", "METAL", "WOOD", "LUMBER", "ROOFING", "INSULATION", "DOOR", "WINDOW", "GLAZING", "GYPSUM", "DRYWALL", "PAINT", "CEILING", "FLOORING", "TILE", "SIGNAGE", "PARTITION", "FURNISHING",
    "ELEVATOR", "FIRE PROTECTION", "SPRINKLER", "PLUMBING", "HVAC", "MECHANICAL", "ELECTRICAL", "LIGHTING", "COMMUNICATION", "EARTHWORK", "PAVING", "LANDSCAPE", "UTILITIES",
)
#: Lines in which keywords are looked for, characters of a region's text that are kept.
TIER_LINES, BODY = 50, 500
#: Fixed values of the column split: bins, floor of a gutter, its width, the margin at both edges, words of a column, width.
BINS, FLOOR, GUTTER, EDGE, COLUMN_WORDS, WIDE = 200, 0.1, 0.03, 0.05, 4, 0.2


def candidates(lines: DataFrame) -> DataFrame:
    """Lines with ``band`` and ``piece``, which name their candidate region; pages with fewer than five lines have none."""
    page = W.partitionBy("doc_id")
    by_left = page.orderBy("minx", "n")
    reach = F.max("maxx").over(by_left.rowsBetween(W.unboundedPreceding, -1))
    tall = F.round(F.percentile(F.round(F.col("maxy") - F.col("miny"), 9), F.lit(0.5)).over(page) * GAP, 9)
    a = lines.where(F.trim("text") != "").select("*", reach.alias("reach"), tall.alias("gap"), F.count("*").over(page).alias("of")).where(F.col("of") >= LEAST)
    new = F.when(F.col("reach").isNull() | (F.col("minx") > F.col("reach")), 1).otherwise(0)
    b = a.withColumn("band", F.sum(new).over(by_left))
    by_top = W.partitionBy("doc_id", "band").orderBy("miny", "minx", "n")
    bottom = F.max("maxy").over(by_top.rowsBetween(W.unboundedPreceding, -1))
    c = b.withColumn("bottom", bottom)
    cut = F.when(F.col("bottom").isNull() | (F.round(F.col("miny") - F.col("bottom"), 9) > F.col("gap")), 1).otherwise(0)
    return c.withColumn("piece", F.sum(cut).over(by_top)).drop("reach", "bottom", "gap", "of")


def _extent() -> list[Column]:
    return [f(c).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]


def _name() -> Column:
    return F.concat(F.lpad(F.col("band").cast("string"), 6, "0"), F.lit("."), F.lpad(F.col("piece").cast("string"), 6, "0"))


def _roots(pages: pa.Array) -> pa.Array:
    """For each page's boxes in order of their ids, the id of the first of those that they are merged with.

    Boxes of all pages of a batch meet those one, two, ... places on, so that no more than a row a box is held.
    """
    sizes = np.diff(pages.offsets.to_numpy())
    flat = pages.flatten()
    roots = _tops(sizes, *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("minx", "miny", "maxx", "maxy")))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), flat.field("det_id").take(pa.array(roots)))


def _tops(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For boxes of pages of these sizes, the place of the first that each is merged with."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    area = (u - x) * (v - y)
    parent = list(range(len(x)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    i, step = np.arange(len(x)), 1
    while len(i := i[i + step < ends[i]]):
        j = i + step
        both = np.maximum(np.minimum(u[i], u[j]) - np.maximum(x[i], x[j]), 0.0) * np.maximum(np.minimum(v[i], v[j]) - np.maximum(y[i], y[j]), 0.0)
        meet = np.flatnonzero(both > 0)
        p, q, both = i[meet], j[meet], both[meet]
        # above the bound after rounding to nine decimals
        same = (both / (area[p] + area[q] - both) >= IOU + 5e-10) | (both / np.minimum(area[p], area[q]) >= CONTAINED + 5e-10)
        for a, b in zip(p[same].tolist(), q[same].tolist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
        step += 1
    return np.array([top(k) for k in parent], np.int64)


def merged(pieces: DataFrame) -> DataFrame:
    """Candidate boxes (``doc_id, det_id``, box, and what else they have) with ``root``, the first of those that they are
    merged with.  A page's boxes are gathered in one row, which stays in its task."""
    rest = [c for c in pieces.columns if c not in ("doc_id", "det_id")]
    pages = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("det_id", F.struct(*rest).alias("rest")))).alias("p"))
    kind = pieces.schema["det_id"].dataType.simpleString()
    boxes = F.transform("p", lambda p: F.struct(p["det_id"].alias("det_id"), *(p["rest"][c].alias(c) for c in ("minx", "miny", "maxx", "maxy"))))
    rooted = pages.select("doc_id", "p", F.arrow_udf(_roots, f"array<{kind}>")(boxes).alias("root"))
    return rooted.select("doc_id", F.inline(F.arrays_zip("p", "root"))).select("doc_id", "p.det_id", "p.rest.*", "root")


def _tier(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), w) for w in sorted(words, key=lambda w: -len(w))))


def _nine(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Rows at which a group of neighbours with equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _before(group: np.ndarray, new: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The greatest of the rows before, within groups that stand one after the other; a group's first row has minus infinity."""
    values, place = np.unique(x, return_inverse=True)
    most = np.maximum.accumulate(group * len(values) + place) - group * len(values)
    return np.where(new, -np.inf, values[np.r_[0, most[:-1]]])


def _medians(group: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    x, first = x[np.lexsort((x, group))], np.cumsum(sizes) - sizes
    return 0.5 * x[first + (sizes - 1) // 2] + 0.5 * x[first + sizes // 2]


_REGIONS = ", region string, minx double, miny double, maxx double, maxy double, words long, lines long, numbered long, columns long, right double, section boolean, header string, told string, body string"


def _page_regions(lines: pa.Table) -> Iterator[pa.RecordBatch]:
    """Merged regions of whole pages, each page's lines one after the other: one row a region of five words or more."""
    page = np.cumsum(_starts(lines["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy())) - 1
    keep = np.flatnonzero(np.bincount(page)[page] >= LEAST)
    if not len(keep):
        return
    page = np.unique(page[keep], return_inverse=True)[1]
    n, x, y, u, v, height, words, numbered, section = (lines[c].to_numpy()[keep] for c in ("n", "minx", "miny", "maxx", "maxy", "height", "words", "numbered", "section"))
    # bands from left to right, then pieces of a band from top to bottom
    gap = _nine(_medians(page, height, np.bincount(page)) * GAP)
    order = np.lexsort((n, x, page))
    new = _starts(page[order])
    band = np.empty(len(page), np.int64)
    band[order] = np.cumsum(new | (x[order] > _before(page[order], new, u[order])))
    order = np.lexsort((n, x, y, band))
    keep, page, band, n, x, y, u, v, height, words, numbered, section = (a[order] for a in (keep, page, band, n, x, y, u, v, height, words, numbered, section))
    new = _starts(band)
    cut = new | (_nine(y - _before(band, new, v)) > gap[page])
    at, piece = np.flatnonzero(cut), np.cumsum(cut) - 1
    boxes = [f.reduceat(a, at) for f, a in ((np.minimum, x), (np.minimum, y), (np.maximum, u), (np.maximum, v))]
    root = _tops(np.bincount(page[at]), *boxes)
    # lines by region, in order of their pieces
    region = root[piece]
    order = np.argsort(region, kind="stable")
    keep, n, x, y, u, v, height, words, numbered, section, region = (a[order] for a in (keep, n, x, y, u, v, height, words, numbered, section, region))
    new = _starts(region)
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    sizes, top = np.bincount(of), region[at]
    nth = np.arange(len(of)) - at[of]
    text = lines["text"].combine_chunks().take(pa.array(keep))
    by_left = np.lexsort((n, x, of))
    far = np.r_[0.0, _nine(np.diff(x[by_left]))]
    step = np.cumsum(new | (far > COLUMN))
    column = np.empty(len(of), np.int64)
    column[by_left] = step - step[at][of] + 1
    columns = step[at + sizes - 1] - step[at] + 1
    last = column == columns[of]
    width = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    right = _nine(np.bincount(of[last], width[last], len(at)) / np.bincount(of[last], minlength=len(at)))
    tall = np.flatnonzero(height >= _nine(_medians(of, height, sizes) * HEADER)[of])
    heads = np.full(len(at), -1)
    heads[of[tall][::-1]] = tall[::-1]
    total = np.bincount(of, words, len(at)).astype(np.int64)
    joined = lambda own: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of[own], minlength=len(at)))], pa.int32()), text.filter(pa.array(own))), " ")
    first = np.flatnonzero(_starts(page))  # of a page's lines
    names = band - band[first][page] + 1
    names, pieces = names[np.flatnonzero(cut)][top], (piece - piece[np.flatnonzero(_starts(band))][np.cumsum(_starts(band)) - 1] + 1)[np.flatnonzero(cut)][top]
    called = pa.array([f"{b:06}.{p:06}" for b, p in zip(names.tolist(), pieces.tolist(), strict=True)], pa.string())
    ends = [f.reduceat(a, at) for f, a in ((np.minimum, x), (np.minimum, y), (np.maximum, u), (np.maximum, v))]
    counts = [total, sizes, np.bincount(of[numbered], minlength=len(at)), columns]
    out = [
        lines["doc_id"].combine_chunks().take(pa.array(keep[at])), called, *map(pa.array, ends), *(pa.array(c, pa.int64()) for c in counts), pa.array(right), pa.array(np.bincount(of[section], minlength=len(at)) > 0),
        text.take(pa.array(heads, mask=heads < 0)), joined(nth < TIER_LINES), pc.utf8_slice_codeunits(joined(nth >= 0), 0, BODY),
    ]
    names = ["doc_id", *(f.split()[0] for f in _REGIONS[2:].split(", "))]
    yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(total >= LEAST))


def _by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_page_regions` of the pages that are whole; the last page of what has come waits for its next lines."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ids = b.column("doc_id").dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(ids != ids[-1]) if len(ids) else ids
        whole = first[-1] + 1 if len(first) else 0
        if held and b.num_rows and (whole or held[-1].column("doc_id")[-1] != b.column("doc_id")[0]):
            yield from _page_regions(pa.Table.from_batches([*held, b.slice(0, whole)]))
            held = []
        elif whole:
            yield from _page_regions(pa.Table.from_batches([b.slice(0, whole)]))
        if b.num_rows:
            held.append(b.slice(whole))
    if held:
        yield from _page_regions(pa.Table.from_batches(held))


def analysed(lines: DataFrame) -> DataFrame:
    """Lines to one row a merged region (``region``) of their pages: extent, words, numbered lines, header, columns, keywords.

    Lines are dealt out by page and stream in order of pages; what follows from the lines before is told there, many pages at once.
    """
    # the expression of sections is asked only where one of its words stands
    loud = F.upper("text")
    section = F.when(loud.contains("PART") | loud.contains("SECTION"), loud.rlike(SECTION)).otherwise(False)
    marks = (F.round(F.col("maxy") - F.col("miny"), 9).alias("height"), F.substring_index("text", " ", 1).rlike(NUMBERED_ITEM).alias("numbered"), section.alias("section"))
    own = lines.where((F.trim("text") != "") & F.col("doc_id").isNotNull()).select("doc_id", "n", "text", F.col("words").cast("double").alias("words"), "minx", "miny", "maxx", "maxy", *marks)
    kind = lines.schema["doc_id"].dataType.simpleString()
    g = own.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_by_page, f"doc_id {kind}{_REGIONS}")
    # in upper case once, before regions are dealt out for their keywords, in even portions whatever pages a task had
    g = g.withColumn("told", upper(F.concat_ws("\n", "header", "told"))).repartition("doc_id", "region")
    text = F.col("told")
    return g.select("*", _tier(text, FAMILIES).alias("family"), _tier(text, KINDS).alias("kind"), _tier(text, TRADES).alias("trade")).drop("told")


def classified(regions: DataFrame) -> DataFrame:
    """``type`` and ``confidence`` of each region; those of which nothing can be said go."""
    c = F.col
    a, b, x, y = TITLE_BLOCK
    cornered = (c("minx") >= a) & (c("miny") >= b) & (c("maxx") <= x) & (c("maxy") <= y) & (c("numbered") == 0) & c("header").isNull()
    share = F.round(c("numbered") / c("lines"), 9)
    scheduled = (F.coalesce(c("family"), F.lit("")) == "SCHEDULE") | F.contains(F.coalesce(c("kind"), F.lit("")), F.lit("SCHEDULE"))
    listed = F.least(F.lit(0.6) + F.least(c("numbered"), F.lit(10)) * F.lit(0.03) + F.when(c("header").isNotNull(), 0.1).otherwise(0.0), F.lit(0.95))
    table = F.when(scheduled, F.lit(0.75) + F.least(c("columns"), F.lit(10)) * F.lit(0.02)).otherwise(F.lit(0.55) + F.least(c("columns"), F.lit(10)) * F.lit(0.01))
    rules = [
        (cornered, "paragraph", F.lit(0.2)), ((share >= NUMBERED) & (c("columns") <= 2), "notes-numbered", listed), ((c("columns") >= 3) & (c("lines") >= 3), "schedule-table", table),
        ((c("columns") == 2) & (c("numbered") == 0) & (c("right") > 0) & (c("right") < SHORT), "notes-key-value", F.lit(0.7)),
        ((c("columns") >= 2) & (F.round(c("maxx") - c("minx"), 9) < NARROW) & (c("words") > SPEC_WORDS) & c("section"), "spec-dense-columns", F.lit(0.7)),
        ((c("words") >= 3 * LEAST) & ~c("section"), "paragraph", F.lit(0.4)),
    ]
    kind, sure = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, name, conf in rules[1:]:
        kind, sure = kind.when(test, name), sure.when(test, conf)
    return regions.select("*", kind.alias("type"), F.round(sure, 6).alias("confidence")).where("type IS NOT NULL")


def text_regions(lines: DataFrame) -> DataFrame:
    """The classified text regions of pages."""
    return classified(analysed(lines))


#: Categories of tables with the words that all must stand in them, those of which one speaks for it, the type
#: of region, the divisions that do, and whether such a table holds for its page only.
CATEGORIES = (
    ("keynote-table", (), ("KEYNOTE", "KEYNOTES", "KEY NOTES", "KEY NOTE"), "notes-key-value", (), True),
    ("door-schedule", ("DOOR",), ("SCHEDULE",), "schedule-table", ("08",), False),
    ("finish-schedule", ("FINISH",), ("SCHEDULE",), "schedule-table", ("09",), False),
    ("symbol-legend", (), ("LEGEND", "SYMBOL LEGEND", "SYMBOLS"), "notes-key-value", (), True),
    ("material-schedule", (), ("SCHEDULE", "EQUIPMENT SCHEDULE", "PLUMBING SCHEDULE", "MECHANICAL SCHEDULE"), "schedule-table", (), False),
    ("general-notes", (), ("GENERAL NOTES", "GENERAL NOTE", "DRAWING NOTES", "SHEET NOTES"), "notes-numbered", (), False),
    ("spec-text", (), ("SPECIFICATION", "SPECIFICATIONS"), "spec-dense-columns", (), False),
)
#: What each kind of evidence adds, the least inference that counts, the least score and the greatest.
TYPE, OTHER_TYPE, ALL_WORDS, IN_HEADER, IN_BODY, INFERRED, DIVISION, ITEMS = 0.3, 0.05, 0.2, 0.25, 0.15, 0.2, 0.1, 0.1
SURE, CATEGORY, MOST = 0.4, 0.3, 0.99


def table_categories(regions: DataFrame, codes: DataFrame, inferences: DataFrame, on: str = "doc_id") -> DataFrame:
    """``doc_id, region, category, confidence, own_page`` of classified regions; paragraphs and weak ones have none.

    ``codes`` has ``on, code``, ``inferences`` ``on, label, confidence``; ``on`` is the page or, where all pages of a
    document share them, a column of regions that names it.  Of equal categories the first counts.
    """
    found = inferences.where(F.col("confidence") >= SURE).groupBy(on).agg(F.collect_set("label").alias("labels"))  # a few labels
    divisions = codes.groupBy(on).agg(F.collect_set(F.substring("code", 1, 2)).alias("divisions"))
    r = regions.where("type <> 'paragraph'").join(found, on, "left").join(divisions, on, "left")
    every = sorted({w for _, a, b, *_ in CATEGORIES for w in (*a, *b)})
    seen = lambda text: F.array_compact(F.array(*(F.when(whole_word(F.coalesce(F.col(text), F.lit("")), w), w) for w in every)))
    r = r.withColumns({"in_header": seen("header"), "in_body": seen("body")}).withColumn("seen", F.array_union("in_header", "in_body"))
    has = lambda array, w: F.coalesce(F.array_contains(array, w), F.lit(False))

    def scored(place: int, category: str, all_: tuple, any_: tuple, type_: str, near: tuple, own: bool) -> Column:
        words = lambda array: F.arrays_overlap(array, F.array(*map(F.lit, any_)))
        score = F.when(F.col("type") == type_, TYPE).otherwise(OTHER_TYPE)
        if all_:
            score = score + ALL_WORDS
        score = score + F.when(words("in_header"), IN_HEADER).when(words("seen"), IN_BODY).otherwise(0.0) + F.when(has("labels", category), INFERRED).otherwise(0.0)
        if near:
            score = score + F.when(F.coalesce(F.arrays_overlap("divisions", F.array(*map(F.lit, near))), F.lit(False)), DIVISION).otherwise(0.0)
        if category == "general-notes":
            score = score + F.when(F.col("numbered") >= 2, ITEMS).otherwise(0.0)
        for w in all_:
            score = F.when(has("seen", w), score).otherwise(0.0)
        return F.struct((-F.round(score, 6)).alias("loss"), F.lit(place).alias("place"), F.lit(category).alias("category"), F.lit(own).alias("own_page"))

    best = r.select("doc_id", "region", F.array_min(F.array(*(scored(n, *c) for n, c in enumerate(CATEGORIES)))).alias("b"))
    return best.where(F.col("b.loss") <= -CATEGORY).select("doc_id", "region", "b.category", F.least(-F.col("b.loss"), F.lit(MOST)).alias("confidence"), "b.own_page")


# --- gutters ---------------------------------------------------------------------------------------------------------


def word_centres(lines: DataFrame) -> DataFrame:
    """Middles of a line's words, which share its width evenly: ``doc_id, n, k, x``."""
    k = F.explode(F.sequence(F.lit(0), F.col("words") - 1))
    rows = lines.select("doc_id", "n", "words", "minx", "maxx", k.alias("k"))
    return rows.select("doc_id", "n", "k", F.round(F.col("minx") + (F.col("maxx") - F.col("minx")) * (F.col("k") + F.lit(0.5)) / F.col("words"), 9).alias("x"))


def _low_runs(pages: pa.Array) -> pa.Array:
    """Runs (first and last bin) of each page's histogram of `BINS`, from an array of bins a page."""
    n, edge, width = len(pages), int(EDGE * BINS), int(GUTTER * BINS)
    page = np.repeat(np.arange(n), np.diff(pages.offsets.to_numpy()))
    count = np.bincount(page * BINS + pages.flatten().to_numpy(), minlength=n * BINS).reshape(n, BINS)
    side = np.pad(count, ((0, 0), (1, 1)), mode="edge")
    smooth = side[:, :-2] + count + side[:, 2:]
    low = smooth <= smooth.max(axis=1, keepdims=True, initial=0) * FLOOR
    low[:, :edge], low[:, BINS - edge :] = False, False
    step = np.diff(np.pad(low, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (at, first), (_, stop) = np.nonzero(step == 1), np.nonzero(step == -1)
    wide = stop - first >= width
    runs = pa.StructArray.from_arrays([pa.array(x[wide].astype(np.int32)) for x in (first, stop - 1)], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[wide], np.arange(n + 1)), pa.int32()), runs)


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (``doc_id, rx, rw, bins``) that have a run, with their runs."""
    for b in batches:
        runs = _low_runs(b.column("bins"))
        out = pa.RecordBatch.from_arrays([*b.columns[:3], runs], ["doc_id", "rx", "rw", "gutters"])
        yield out.filter(pc.greater(pc.list_value_length(runs), 0))


def gutters(lines: DataFrame) -> DataFrame:
    """``doc_id, rx, rw, gutters``: runs (first and last bin) of a page's histogram in x that hold under a tenth of its peak.

    A page's lines are gathered in one row, which stays in its task; its words are numbers of bins there, never rows.
    """
    of = F.collect_list(F.struct("minx", "maxx", "words"))
    p = lines.groupBy("doc_id").agg(F.min("minx").alias("rx"), F.max("maxx").alias("right"), of.alias("of"))  # the lines of one page
    p = p.select("doc_id", "rx", F.round(F.col("right") - F.col("rx"), 9).alias("rw"), "of").where(F.col("rw") >= WIDE)
    x = lambda v, k: F.round(v["minx"] + (v["maxx"] - v["minx"]) * (k + F.lit(0.5)) / v["words"], 9)
    bin_ = lambda x: F.least(F.greatest(F.floor(F.round((x - F.col("rx")) / F.col("rw") * BINS, 9)).cast("int"), F.lit(0)), F.lit(BINS - 1))
    bins = F.flatten(F.transform("of", lambda v: F.transform(F.sequence(F.lit(0), v["words"] - 1), lambda k: bin_(x(v, k)))))
    b = p.select("doc_id", "rx", "rw", bins.alias("bins")).where(F.size("bins") >= 2 * COLUMN_WORDS)
    kind = lines.schema["doc_id"].dataType.simpleString()
    return b.mapInArrow(_with_runs, f"doc_id {kind}, rx double, rw double, gutters array<struct<first:int,last:int>>")


def columns(lines: DataFrame) -> DataFrame:
    """``doc_id, cuts``: x of the gutters' middles of pages that split, where every column keeps four words or more."""
    centres, cuts = word_centres(lines), gutters(lines)
    cuts = cuts.select("doc_id", F.transform("gutters", lambda g: F.round(F.col("rx") + (g["first"] + g["last"]) / F.lit(2.0) / BINS * F.col("rw"), 9)).alias("cuts"))
    dealt = centres.join(cuts, "doc_id").groupBy("doc_id", "cuts", _column(F.col("x")).alias("column")).agg(F.count("*").alias("n"))
    full = dealt.groupBy("doc_id", "cuts").agg(F.count("*").alias("columns"), F.min("n").alias("least"))
    return full.where((F.col("columns") == F.size("cuts") + 1) & (F.col("least") >= COLUMN_WORDS)).select("doc_id", "cuts")


def _column(x: Column) -> Column:
    return F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c <= x)) + 1


def read_by_columns(lines: DataFrame) -> DataFrame:
    """Lines with their ``column`` and ``place`` in reading order: column by column, each from top to bottom."""
    cuts = columns(lines)
    middle = F.round((F.col("minx") + F.col("maxx")) / 2, 9)
    placed = lines.join(cuts, "doc_id", "left").withColumn("column", _column(middle))
    return placed.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("column", "miny", "minx", "n")))


# --- the queries -----------------------------------------------------------------------------------------------------

_PIECES = f"""a AS (SELECT *, max(maxx) OVER (PARTITION BY doc_id ORDER BY minx, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, round(median(round(maxy - miny, 9)) OVER (PARTITION BY doc_id) * {GAP}e0, 9) AS gap
  FROM v_layout QUALIFY count(*) OVER (PARTITION BY doc_id) >= {LEAST}),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR minx > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY minx, n) AS band FROM a),
c AS (SELECT *, max(maxy) OVER (PARTITION BY doc_id, band ORDER BY miny, minx, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM b),
line AS (SELECT *, sum(CASE WHEN bottom IS NULL OR round(miny - bottom, 9) > gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, band ORDER BY miny, minx, n) AS piece FROM c),
box AS (SELECT doc_id, lpad(band::VARCHAR, 6, '0') || '.' || lpad(piece::VARCHAR, 6, '0') AS det_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS lines, sum(words)::BIGINT AS words FROM line GROUP BY ALL)"""


@register("g04_region_proposals", oracle("v_layout", f"WITH {_PIECES} SELECT * FROM box"))
def g04(spark, sf_dir):
    """Candidate regions of the laid-out texts: bands of lines, cut at gaps."""
    c = candidates(views.layout(spark, sf_dir)).withColumn("det_id", _name())
    return c.groupBy("doc_id", "det_id").agg(*_extent(), F.count("*").alias("lines"), F.sum("words").alias("words"))


_SHARED = "greatest(least(p.maxx, q.maxx) - greatest(p.minx, q.minx), 0e0) * greatest(least(p.maxy, q.maxy) - greatest(p.miny, q.miny), 0e0)"
_AREA = "({0}.maxx - {0}.minx) * ({0}.maxy - {0}.miny)"
_MERGED = f"""pair AS (SELECT p.doc_id, p.det_id AS a, q.det_id AS b, {_SHARED} AS i, {_AREA.format('p')} AS sa, {_AREA.format('q')} AS sb FROM box p JOIN box q ON p.doc_id = q.doc_id AND p.det_id <> q.det_id),
edge AS (SELECT doc_id, a, b FROM pair WHERE round(i / (sa + sb - i), 9) > {IOU}e0 OR round(greatest(i / sa, i / sb), 9) > {CONTAINED}e0),
walk AS (SELECT doc_id, det_id, det_id AS seen FROM box UNION SELECT walk.doc_id, walk.det_id, edge.b FROM walk JOIN edge ON walk.doc_id = edge.doc_id AND walk.seen = edge.a),
root AS (SELECT doc_id, det_id, min(seen) AS region FROM walk GROUP BY ALL)"""


def _boxes_as_pieces(spark, sf_dir) -> DataFrame:
    return views.detection(spark, sf_dir).where(F.col("name").isin("text_box", "tables", "grid")).groupBy("doc_id", "det_id").agg(*_extent())


@register("g05_region_merge", oracle("v_detection", f"WITH RECURSIVE box AS (SELECT doc_id, det_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM v_detection WHERE name IN ('text_box', 'tables', 'grid') GROUP BY ALL), {_MERGED} SELECT doc_id, region, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS parts FROM box JOIN root USING (doc_id, det_id) GROUP BY ALL").replace("WITH v_detection AS", "WITH RECURSIVE v_detection AS").replace(", RECURSIVE box AS", ", box AS"))
def g05(spark, sf_dir):
    """Detected boxes of text merged into regions where they overlap."""
    return merged(_boxes_as_pieces(spark, sf_dir)).groupBy("doc_id", F.col("root").alias("region")).agg(*_extent(), F.count("*").alias("parts"))


def _tier_sql(words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(txt, '{w}') THEN '{w}'" for w in sorted(words, key=lambda w: -len(w))) + " END"


_ANALYSED = f"""part AS (SELECT line.*, region, row_number() OVER (PARTITION BY line.doc_id, region ORDER BY band, piece, miny, minx, n) AS nth, round(maxy - miny, 9) AS height,
  round(minx - lag(minx) OVER (PARTITION BY line.doc_id, region ORDER BY minx, n), 9) AS far FROM line JOIN root ON root.doc_id = line.doc_id AND root.det_id = lpad(band::VARCHAR, 6, '0') || '.' || lpad(piece::VARCHAR, 6, '0')),
col AS (SELECT *, sum(CASE WHEN far IS NULL OR far > {COLUMN}e0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, region ORDER BY minx, n) AS col, round(median(height) OVER (PARTITION BY doc_id, region) * {HEADER}e0, 9) AS tall FROM part),
cols AS (SELECT *, max(col) OVER (PARTITION BY doc_id, region) AS cols FROM col),
reg AS (SELECT doc_id, region, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, sum(words)::BIGINT AS words, count(*) AS lines, count(*) FILTER (regexp_matches(split_part(text, ' ', 1), '{NUMBERED_ITEM}')) AS numbered,
  max(cols)::BIGINT AS columns, round(avg(len(text)) FILTER (col = cols), 9) AS rgt, bool_or(regexp_matches(upper(text), '{SECTION}')) AS section, arg_min(text, nth) FILTER (height >= tall) AS header,
  string_agg(text, ' ' ORDER BY nth) FILTER (nth <= {TIER_LINES}) AS told, string_agg(text, ' ' ORDER BY nth)[:{BODY}] AS body FROM cols GROUP BY ALL HAVING sum(words) >= {LEAST}),
txt AS (SELECT *, upper(CASE WHEN header IS NULL THEN told ELSE header || chr(10) || told END) AS txt FROM reg),
tier AS (SELECT *, {_tier_sql(FAMILIES)} AS family, {_tier_sql(KINDS)} AS kind, {_tier_sql(TRADES)} AS trade FROM txt),
told AS (SELECT *, CASE WHEN minx >= 45e-2 AND miny >= 7e-1 AND maxx <= 1e0 AND maxy <= 1e0 AND numbered = 0 AND header IS NULL THEN 1 WHEN round(numbered / lines, 9) >= 6e-1 AND columns <= 2 THEN 2 WHEN columns >= 3 AND lines >= 3 THEN 3
  WHEN columns = 2 AND numbered = 0 AND rgt > 0 AND rgt < 20 THEN 4 WHEN columns >= 2 AND round(maxx - minx, 9) < 35e-2 AND words > 50 AND section THEN 5 WHEN words >= 15 AND NOT section THEN 6 END AS r FROM tier)"""


@register("r07_text_regions", oracle("v_layout", f"""WITH RECURSIVE {_PIECES}, {_MERGED}, {_ANALYSED}
SELECT doc_id, region, minx, miny, maxx, maxy, words, lines, numbered, columns, header, family, kind, trade, ['paragraph', 'notes-numbered', 'schedule-table', 'notes-key-value', 'spec-dense-columns', 'paragraph'][r] AS type,
  round(CASE r WHEN 1 THEN 2e-1 WHEN 2 THEN least(6e-1 + least(numbered, 10) * 3e-2 + CASE WHEN header IS NOT NULL THEN 1e-1 ELSE 0e0 END, 95e-2)
    WHEN 3 THEN CASE WHEN coalesce(family = 'SCHEDULE', false) OR coalesce(contains(kind, 'SCHEDULE'), false) THEN 75e-2 + least(columns, 10) * 2e-2 ELSE 55e-2 + least(columns, 10) * 1e-2 END WHEN 6 THEN 4e-1 ELSE 7e-1 END, 6) AS confidence
FROM told WHERE r IS NOT NULL""").replace("WITH v_layout AS", "WITH RECURSIVE v_layout AS").replace(", RECURSIVE a AS", ", a AS"))
def r07(spark, sf_dir):
    """The text regions of the laid-out texts with their types."""
    return text_regions(views.layout(spark, sf_dir)).select("doc_id", "region", "minx", "miny", "maxx", "maxy", "words", "lines", "numbered", "columns", "header", "family", "kind", "trade", "type", "confidence")


_GUTTERS = f"""ext AS (SELECT *, min(minx) OVER (PARTITION BY doc_id) AS rx, round(max(maxx) OVER (PARTITION BY doc_id) - min(minx) OVER (PARTITION BY doc_id), 9) AS rw FROM v_layout),
wd AS (SELECT doc_id, n, rx, rw, round(minx + (maxx - minx) * (k + 5e-1) / words, 9) AS x FROM (SELECT *, unnest(range(words)) AS k FROM ext)),
hist AS (SELECT doc_id, rx, rw, least(greatest(floor(round((x - rx) / rw * 200, 9))::INT, 0), 199) AS bin, count(*) AS n FROM wd WHERE rw >= 2e-1 GROUP BY ALL),
pg AS (SELECT doc_id, rx, rw FROM hist GROUP BY ALL HAVING sum(n) >= 8),
full_ AS (SELECT pg.*, r.bin, coalesce(n, 0) AS n FROM pg CROSS JOIN (SELECT unnest(range(200)) AS bin) r LEFT JOIN hist ON hist.doc_id = pg.doc_id AND hist.bin = r.bin),
sm AS (SELECT *, coalesce(lag(n) OVER o, n) + n + coalesce(lead(n) OVER o, n) AS s FROM full_ WINDOW o AS (PARTITION BY doc_id ORDER BY bin)),
pk AS (SELECT *, s <= max(s) OVER (PARTITION BY doc_id) * 1e-1 AS low FROM sm),
il AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id ORDER BY bin) AS island FROM pk WHERE low AND bin BETWEEN 10 AND 189),
gut AS (SELECT doc_id, rx, rw, min(bin)::INT AS first_bin, max(bin)::INT AS last_bin FROM il GROUP BY doc_id, rx, rw, island HAVING count(*) >= 6)"""


@register("w15_low_runs", oracle("v_layout", f"WITH {_GUTTERS} SELECT doc_id, first_bin, last_bin FROM gut"))
def w15(spark, sf_dir):
    """Gutters of pages: runs of the smoothed histogram of word middles in 200 bins that stay under a tenth of its peak."""
    g = gutters(views.layout(spark, sf_dir))
    return g.select("doc_id", F.inline("gutters").alias("first_bin", "last_bin"))


@register("t12_column_split", oracle("v_layout", f"""WITH {_GUTTERS},
cut AS (SELECT doc_id, list(round(rx + (first_bin + last_bin) / 2e0 / 200 * rw, 9)) AS cuts FROM gut GROUP BY ALL),
deal AS (SELECT doc_id, cuts, len(list_filter(cuts, lambda c: c <= x)) AS col, count(*) AS n FROM wd JOIN cut USING (doc_id) GROUP BY ALL),
ok AS (SELECT doc_id, cuts FROM deal GROUP BY ALL HAVING count(*) = len(cuts) + 1 AND min(n) >= 4),
line AS (SELECT v.*, len(list_filter(coalesce(cuts, []), lambda c: c <= round((minx + maxx) / 2, 9))) + 1 AS col FROM v_layout v LEFT JOIN ok USING (doc_id))
SELECT doc_id, col::INT AS "column", string_agg(text, chr(10) ORDER BY miny, minx, n) AS text FROM line GROUP BY ALL"""))
def t12(spark, sf_dir):
    """The text of each column of a page, from top to bottom; pages without a gutter are one column."""
    g = read_by_columns(views.layout(spark, sf_dir)).groupBy("doc_id", "column").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("x"))  # a page's lines
    return g.select("doc_id", "column", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("text"))


def _word_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(coalesce({text}, ''), '(?i)(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')" for w in words) + ")"


def _category_sql(place: int, category: str, all_: tuple, any_: tuple, type_: str, near: tuple, own: bool) -> str:
    both = "coalesce(header, '') || chr(10) || coalesce(body, '')"
    parts = [f"CASE WHEN type = '{type_}' THEN 3e-1 ELSE 5e-2 END", "2e-1" if all_ else "0e0", f"CASE WHEN {_word_sql('header', any_)} THEN 25e-2 WHEN {_word_sql(both, any_)} THEN 15e-2 ELSE 0e0 END", f"CASE WHEN coalesce(list_contains(labels, '{category}'), false) THEN 2e-1 ELSE 0e0 END"]
    if near:
        parts.append(f"CASE WHEN coalesce(list_has_any(divs, {list(near)!r}), false) THEN 1e-1 ELSE 0e0 END")
    if category == "general-notes":
        parts.append("CASE WHEN numbered >= 2 THEN 1e-1 ELSE 0e0 END")
    must = " AND ".join(_word_sql(both, (w,)) for w in all_) or "true"
    return f"SELECT doc_id, region, {place} AS place, '{category}' AS category, {own} AS own_page, CASE WHEN {must} THEN round({' + '.join(parts)}, 6) ELSE 0e0 END AS score FROM typed"


@register("r08_region_categories", oracle("v_layout v_detection v_word v_text v_taxonomy v_page_code", f"""WITH RECURSIVE {_PIECES}, {_MERGED}, {_ANALYSED},
inf AS (SELECT doc_id, list(DISTINCT label) AS labels FROM (SELECT doc_id, CASE name WHEN 'text_box' THEN 'general-notes' WHEN 'tables' THEN 'material-schedule' WHEN 'grid' THEN 'keynote-table' END AS label FROM v_detection WHERE conf >= 4e-1 AND name IN ('text_box', 'tables', 'grid')) GROUP BY ALL),
dv AS (SELECT doc_id, list(DISTINCT division) AS divs FROM v_page_code GROUP BY ALL),
typed AS (SELECT told.*, labels, divs, ['paragraph', 'notes-numbered', 'schedule-table', 'notes-key-value', 'spec-dense-columns', 'paragraph'][r] AS type FROM told LEFT JOIN inf ON inf.doc_id = split_part(told.doc_id, '/', 1)::BIGINT LEFT JOIN dv ON dv.doc_id = split_part(told.doc_id, '/', 1)::BIGINT WHERE r IN (2, 3, 4, 5)),
sc AS ({" UNION ALL ".join(_category_sql(n, *c) for n, c in enumerate(CATEGORIES))})
SELECT doc_id, region, category, least(score, 99e-2) AS confidence, own_page FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, region ORDER BY score DESC, place) = 1 AND score >= 3e-1""").replace("WITH v_", "WITH RECURSIVE v_", 1).replace(", RECURSIVE a AS", ", a AS"))
def r08(spark, sf_dir):
    """The categories of the laid-out texts' regions, with codes of their documents and what boxes let infer."""
    regions = text_regions(views.layout(spark, sf_dir)).withColumn("doc", F.split("doc_id", "/")[0].cast("long"))
    label = F.when(F.col("name") == "text_box", "general-notes").when(F.col("name") == "tables", "material-schedule").when(F.col("name") == "grid", "keynote-table")
    told = views.detection(spark, sf_dir).select(F.col("doc_id").alias("doc"), label.alias("label"), F.col("conf").alias("confidence")).where("label IS NOT NULL")
    return table_categories(regions, views.page_code(spark, sf_dir).select(F.col("doc_id").alias("doc"), "code"), told, on="doc")
