"""Pages as grids of cells: dense components and the largest empty rectangles.

A page is one row: its cells are an array of at most `rows * columns` numbers.  Arrow batches of pages become one numpy
array, on which labels spread over all pages at once, or whose rows of bits are scanned for rectangles.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.geometry import Box
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle

#: Cells of a page each way, the share of the densest cell that is dense, the least confidence that counts.
GRID, DENSE, SURE = 16, 0.35, 0.1


def _span(low: Column, high: Column, cells: int) -> Column:
    """Cells from one coordinate to another, the end excluded."""
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(v * cells).cast("int")))
    return F.sequence(at(low), F.greatest(at(low), at(high - F.lit(1e-9))))


def heat(boxes: DataFrame, cells: int = GRID, weights: dict[str, float] | None = None, sure: float = SURE) -> DataFrame:
    """``doc_id, cell, name, heat``: confidence (by class weight) that boxes lay on each cell that they touch, row by row."""
    box = Box.of()
    weight = F.coalesce(*(F.when(F.col("name") == k, v) for k, v in (weights or {}).items()), F.lit(1.0))
    d = boxes.where(F.col("conf") >= sure).select("doc_id", "name", (F.col("conf") * weight).alias("heat"), _span(box.minx, box.maxx, cells).alias("xs"), _span(box.miny, box.maxy, cells).alias("ys"))
    c = d.select("doc_id", "name", "heat", "xs", F.explode("ys").alias("y")).select("doc_id", "name", "heat", "y", F.explode("xs").alias("x"))
    return c.groupBy("doc_id", (F.col("y") * cells + F.col("x")).alias("cell"), "name").agg(F.sum("heat").alias("heat"))


def spread(mask: np.ndarray) -> np.ndarray:
    """Labels of the eight-connected components of pages (n, rows, columns): the least cell number of each, -1 elsewhere."""
    n, rows, cols = mask.shape
    none = rows * cols
    label = np.where(mask, np.arange(none, dtype=np.int32).reshape(rows, cols), none)
    while True:
        wide = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        least = np.minimum.reduce([wide[:, i : i + rows, j : j + cols] for i in range(3) for j in range(3)])
        new = np.where(mask, least, none)
        if (new == label).all():
            return np.where(mask, label, -1)
        label = new


def _labels(cells: int) -> Callable[[pa.Array], pa.Array]:
    def run(on: pa.Array) -> pa.Array:
        page = np.repeat(np.arange(len(on)), np.diff(on.offsets.to_numpy()))
        cell = on.flatten().to_numpy()
        mask = np.zeros((len(on), cells * cells), bool)
        mask[page, cell] = True
        label = spread(mask.reshape(-1, cells, cells)).reshape(len(on), -1)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(len(on) + 1)), pa.int32()), pa.array(label[page, cell].astype(np.int32)))

    return run


def components(dense: DataFrame, cells: int = GRID) -> DataFrame:
    """Rows with ``doc_id`` and an array ``on`` of a page's dense cells, and the ``component`` of each cell in order."""
    return dense.withColumn("component", F.arrow_udf(_labels(cells), "array<int>")("on"))


def dense_regions(boxes: DataFrame, cells: int = GRID, least: float = DENSE, weights: dict[str, float] | None = None, sure: float = SURE) -> DataFrame:
    """Components of the dense cells of pages: box, confidence (mean density), cells, classes by what they add inside."""
    # boxes are read once: a cell keeps its classes, a page its dense cells, and only its components are dealt out again
    by_class = heat(boxes, cells, weights, sure).groupBy("doc_id", "cell").agg(F.sum("heat").alias("heat"), F.collect_list(F.struct("name", F.col("heat").alias("part"))).alias("classes"))
    share = by_class.withColumn("density", F.round(F.col("heat") / F.max("heat").over(W.partitionBy("doc_id")), 9)).where(F.col("density") >= least)
    page = share.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("cell").cast("int").alias("cell"), "heat", "density", "classes")).alias("c"))  # cells of one page
    placed = components(page.select("doc_id", "c", F.col("c.cell").alias("on")), cells).select("doc_id", F.inline(F.arrays_zip("c", "component"))).select("doc_id", "component", "c.*")
    x, y = F.col("cell") % cells, F.floor(F.col("cell") / cells)
    # a cell is one row a class; what belongs to the cell stands in its first
    rows = placed.select("doc_id", "component", "cell", "heat", "density", F.posexplode("classes").alias("k", "p")).select("doc_id", "component", "cell", F.col("p.name").alias("name"), F.col("p.part").alias("part"), *(F.when(F.col("k") == 0, F.col(c)).alias(c) for c in ("heat", "density")), F.when(F.col("k") == 0, 1).alias("one"))
    told = rows.groupBy("doc_id", "component", "name").agg(
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.sum("one").alias("one"), F.sum(F.col("density").cast("decimal(10,9)")).alias("density"), F.sum("heat").alias("heat"), F.round(F.sum("part"), 6).alias("sum"),
    )
    mean = F.sum("density") / F.sum("one")  # densities have nine decimals: their mean is exact, whatever the order of the cells
    named = F.array_sort(F.collect_list(F.when(F.col("sum") > 0, F.struct((-F.col("sum")).alias("loss"), "name"))))
    whole = told.groupBy("doc_id", "component").agg(
        (F.min("x0") / cells).alias("minx"), (F.min("y0") / cells).alias("miny"), ((F.max("x1") + 1) / cells).alias("maxx"), ((F.max("y1") + 1) / cells).alias("maxy"), F.sum("one").alias("cells"),
        F.round(F.least(mean, F.lit(1)), 6).cast("double").alias("confidence"), F.round(F.sum("heat"), 6).alias("mass"), named.alias("named"),
    )
    return whole.where(F.size("named") > 0).withColumn("classes", F.array_join(F.transform("named", lambda c: c["name"]), "+")).drop("named")


#: The mask of a page, the rectangles that are looked for, the least share of the page and the shape of a gutter.
MASK_WIDTH, MASK_HEIGHT, RECTANGLES, LEAST_AREA, TALL = 500, 700, 5, 0.02, 3.0


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where columns and rows differ from the ones before, with both ends."""
    cut = lambda m: np.r_[0, np.flatnonzero((m[1:] != m[:-1]).any(axis=1)) + 1, len(m)] if len(m) else np.zeros(1, int)
    return cut(mask.T), cut(mask)


def _above(mask: np.ndarray) -> np.ndarray:
    """For each row and column the row from which the cells down to it are free (the next row, where it is set)."""
    return np.maximum.accumulate(np.where(mask, np.arange(1, len(mask) + 1)[:, None], 0), axis=0)


def _largest_above(top: list[int], xs: list[int], ys: list[int], y: int) -> tuple[int, tuple[int, int, int, int]]:
    """Area, columns and rows (first, one past the last) of the largest free rectangle whose last row is ``y``.

    A stack of rising heights along the row; columns that are free from the same row on are one step.
    """
    low, best, area = ys[y + 1], (0, 0, 0, 0), 0
    begins, rows = [0], [-1]  # the columns where heights begin, and the rows from which they are free
    for x, row in enumerate([*top, y + 1]):
        if row == rows[-1]:
            continue
        start = x
        while rows[-1] >= 0 and rows[-1] < row:
            start, t = begins.pop(), rows.pop()
            size = (low - ys[t]) * (xs[x] - xs[start])
            if size > area:
                area, best = size, (start, x, t, y + 1)
        if row <= y and row != rows[-1]:
            begins.append(start)
            rows.append(row)
    return area, best


def largest_rectangles(mask: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """``x, y, w, h`` of the ``k`` largest rectangles of cells that are not set, one after the other, each set before the
    next is looked for.  Equal neighbouring rows and columns count as one, with their number as its size."""
    xs, ys = _edges(mask)
    return _largest_of(mask[np.ix_(ys[:-1], xs[:-1])].copy(), xs, ys, k)


def _largest_of(small: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """`largest_rectangles` of cells between edges ``xs`` and ``ys``, which it sets.

    What is set later only makes a row's largest rectangle smaller, so its earlier area is a bound: a row is looked at again
    only when no other row's bound is above it.  Of equal areas the one that ends first counts.
    """
    out: list[tuple[int, int, int, int]] = []
    if not small.size:
        return out
    x_at, y_at, top = xs.tolist(), ys.tolist(), _above(small)
    # a rectangle can be the largest only where the row below it sets a free cell
    last = np.flatnonzero(np.r_[(small[1:] & ~small[:-1]).any(axis=1), True])
    tall = (ys[1:, None] - ys[top])[last].max(axis=1) * x_at[-1]
    queue = [(-int(a), int(y), None) for a, y in zip(tall, last, strict=True)]
    heapq.heapify(queue)
    fresh: dict[int, bool] = {}
    while queue and len(out) < k:
        bound, y, found = heapq.heappop(queue)
        if not bound:
            break
        if not fresh.get(y):
            area, found = _largest_above(top[y].tolist(), x_at, y_at, y)
            fresh[y] = True
            heapq.heappush(queue, (-area, y, found))
            continue
        a, b, c, d = found
        out.append((x_at[a], y_at[c], x_at[b] - x_at[a], y_at[d] - y_at[c]))
        small[c:d, a:b] = True
        top[:, a:b] = _above(small[:, a:b])
        fresh = {row: ok for row, ok in fresh.items() if row < c}
        if c and c - 1 not in {row for _, row, _ in queue}:  # now the rectangle is below this row
            heapq.heappush(queue, (bound, c - 1, None))
        heapq.heappush(queue, (bound, y, None))
    return out


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int]:
    """The largest one; all zero where no cell is free."""
    return next(iter(largest_rectangles(mask, 1)), (0, 0, 0, 0))


def _rasterised(boxes: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A page's mask, as cells between the edges of its boxes, and these edges."""
    edge = lambda v, n, f: np.clip(f(np.round(v * n, 6)).astype(int), 0, n)
    a, b, c, d = edge(boxes[:, 0], width, np.floor), edge(boxes[:, 1], height, np.floor), edge(boxes[:, 2], width, np.ceil), edge(boxes[:, 3], height, np.ceil)
    xs, ys = np.unique(np.r_[0, a, c, width]), np.unique(np.r_[0, b, d, height])
    cells = np.zeros((len(ys) - 1, len(xs) - 1), bool)
    for x, y, u, v in zip(*(np.searchsorted(e, at).tolist() for e, at in ((xs, a), (ys, b), (xs, c), (ys, d))), strict=True):
        cells[y:v, x:u] = True
    return cells, xs, ys


def white_rectangles(lines: DataFrame, k: int = RECTANGLES, width: int = MASK_WIDTH, height: int = MASK_HEIGHT, least: float = LEAST_AREA) -> DataFrame:
    """``doc_id, nth, x, y, w, h`` (shares of the page), ``area`` in cells and ``kind`` of the largest white rectangles of
    pages, from the boxes of their lines; a page's boxes are gathered in one row, the mask lives in the task."""
    pages = lines.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("minx", "miny", "maxx", "maxy"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, boxes in zip(b.column("doc_id").to_pylist(), b.column("b"), strict=True):
                cells = _rasterised(np.array(boxes.values).reshape(-1, 4), width, height)
                kept = [r for r in _largest_of(*cells, k) if r[2] * r[3] >= least * width * height]
                out += [(page, n, x / width, y / height, w / width, h / height, w * h, "gutter" if h / max(w, 1) >= TALL else "paragraph-break") for n, (x, y, w, h) in enumerate(kept, 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    kind = pa.string() if lines.schema["doc_id"].dataType.simpleString() == "string" else pa.int64()
    schema = pa.schema([("doc_id", kind), ("nth", pa.int32()), *((c, pa.float64()) for c in "xywh"), ("area", pa.int64()), ("kind", pa.string())])
    ddl = f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, nth int, x double, y double, w double, h double, area long, kind string"
    return pages.mapInArrow(run, ddl)


# --- the queries -----------------------------------------------------------------------------------------------------

_CLASSES = {"grid": 0.5}


@register("g06_density_components", oracle("v_detection", """
WITH RECURSIVE b AS (SELECT doc_id, name, conf * CASE name WHEN 'grid' THEN 5e-1 ELSE 1e0 END AS heat, greatest(0, least(15, floor(minx * 16)::INT)) AS x0, greatest(0, least(15, floor((maxx - 1e-9) * 16)::INT)) AS x1,
  greatest(0, least(15, floor(miny * 16)::INT)) AS y0, greatest(0, least(15, floor((maxy - 1e-9) * 16)::INT)) AS y1 FROM v_detection WHERE conf >= 1e-1),
c AS (SELECT doc_id, name, heat, x, unnest(range(y0, greatest(y0, y1) + 1)) AS y FROM (SELECT *, unnest(range(x0, greatest(x0, x1) + 1)) AS x FROM b)),
k AS (SELECT doc_id, name, y * 16 + x AS cell, sum(heat) AS heat FROM c GROUP BY ALL), s AS (SELECT doc_id, cell, sum(heat) AS heat FROM k GROUP BY ALL),
d AS (SELECT *, round(heat / max(heat) OVER (PARTITION BY doc_id), 9) AS density FROM s), on_ AS (SELECT * FROM d WHERE density >= 35e-2),
near AS (SELECT a.doc_id, a.cell AS a, b.cell AS b FROM on_ a JOIN on_ b ON a.doc_id = b.doc_id AND abs(a.cell // 16 - b.cell // 16) <= 1 AND abs(a.cell % 16 - b.cell % 16) <= 1),
walk AS (SELECT doc_id, cell, cell AS seen FROM on_ UNION SELECT walk.doc_id, walk.cell, near.b FROM walk JOIN near ON walk.doc_id = near.doc_id AND walk.seen = near.a),
comp AS (SELECT doc_id, cell, min(seen) AS component FROM walk GROUP BY ALL),
w AS (SELECT doc_id, component, min(cell % 16) / 16e0 AS minx, min(cell // 16) / 16e0 AS miny, (max(cell % 16) + 1) / 16e0 AS maxx, (max(cell // 16) + 1) / 16e0 AS maxy, count(*) AS cells, round(least(avg(density), 1e0), 6) AS confidence, round(sum(heat), 6) AS mass FROM comp JOIN on_ USING (doc_id, cell) GROUP BY ALL),
n AS (SELECT doc_id, component, name, round(sum(heat), 6) AS sum FROM comp JOIN k USING (doc_id, cell) GROUP BY ALL HAVING round(sum(heat), 6) > 0)
SELECT w.doc_id, w.component::INT AS component, minx, miny, maxx, maxy, cells, confidence, mass, string_agg(name, '+' ORDER BY sum DESC, name) AS classes FROM w JOIN n ON w.doc_id = n.doc_id AND w.component = n.component GROUP BY ALL""").replace("WITH v_detection AS", "WITH RECURSIVE v_detection AS").replace(", RECURSIVE b AS", ", b AS"))
def g06(spark, sf_dir):
    """Where boxes agree: components of dense cells on each page."""
    return dense_regions(views.detection(spark, sf_dir), weights=_CLASSES)


@register("g10_white_rectangles")
def g10(spark, sf_dir):
    """The largest white rectangles between the lines of the laid-out texts (checked by brute force on small masks)."""
    return white_rectangles(views.layout(spark, sf_dir))
