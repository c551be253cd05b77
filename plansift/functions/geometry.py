"""Axis-aligned boxes as four double columns (min-max), and shapes as arrays of points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    minx: Column
    miny: Column
    maxx: Column
    maxy: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + c) for c in ("minx", "miny", "maxx", "maxy")))

    @property
    def cx(self) -> Column:
        return (self.minx + self.maxx) / 2

    @property
    def cy(self) -> Column:
        return (self.miny + self.maxy) / 2

    @property
    def area(self) -> Column:
        return (self.maxx - self.minx) * (self.maxy - self.miny)

    def holds(self, x: Column, y: Column) -> Column:
        return (x >= self.minx) & (x <= self.maxx) & (y >= self.miny) & (y <= self.maxy)

    def shared(self, o: Box) -> Column:
        """Area of the intersection."""
        w = F.least(self.maxx, o.maxx) - F.greatest(self.minx, o.minx)
        h = F.least(self.maxy, o.maxy) - F.greatest(self.miny, o.miny)
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))

    def iou(self, o: Box) -> Column:
        both = self.shared(o)
        union = self.area + o.area - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    def containment(self, o: Box) -> Column:
        """The larger share of either box's area that the other covers."""
        return F.greatest(self.shared(o) / self.area, self.shared(o) / o.area)


def zone(cx: Column, cy: Column, rows: int = 9, cols: int = 9) -> Column:
    """Title-block strip, right margin, or the cell of an n x n grid."""
    cell = lambda v, n: F.least(F.floor(v * n), F.lit(n - 1)) + 1
    grid = F.concat(F.lit("r"), cell(cy, rows).cast("string"), F.lit("-c"), cell(cx, cols).cast("string"))
    return F.when(cy > 0.85, "title-block").when(cx > 0.75, "right-margin").otherwise(grid)


def ninth(cx: Column, cy: Column) -> Column:
    """Label of a third by a third of the page."""
    row = F.when(cy < 0.33, "top").when(cy < 0.66, "mid").otherwise("bottom")
    col = F.when(cx < 0.33, "left").when(cx < 0.66, "center").otherwise("right")
    return F.concat_ws("-", row, col)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def polyline_length(points: Column) -> Column:
    n = F.size(points)
    steps = F.zip_with(
        F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)
