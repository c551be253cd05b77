"""Polygons cut in two by any line, as expressions over arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.functions.geometry import polygon_area
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle

#: Fixed value: a point as near as this to the line is on it.
EPS = 1e-9


def split_by_line(shapes: DataFrame, shape: str, ax: Column, ay: Column, bx: Column, by: Column) -> DataFrame:
    """Shapes (arrays of points ``x, y``) that the line through two points cuts in two: ``left`` and ``right`` of it, and
    the length of the ``chord`` between.

    A shape is cut where its border meets the line in exactly two points and passes to the other side in both; corners
    on the line count as such points.  Shapes of fewer than three points are never cut.
    """
    wide = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    off = lambda p: ((bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)) / wide
    flat = lambda d: F.when(F.abs(d) < EPS, F.lit(0.0)).otherwise(d)
    s = shapes.where(F.size(shape) >= 3).withColumn("_s", F.transform(shape, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), flat(off(p)).alias("d"))))
    n = F.size("_s")
    s = s.withColumn("_e", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("_s", i).alias("a"), F.get("_s", (i + 1) % n).alias("b"))))
    none = F.array().cast("array<struct<x:double,y:double>>")
    at = lambda p: F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = a["d"] / (a["d"] - b["d"])
        new = F.array(F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))
        return F.when(a["d"] * b["d"] < 0, new).otherwise(none)

    side = lambda keep: F.flatten(F.transform("_e", lambda e: F.concat(F.when(keep(e["a"]["d"]), at(e["a"])).otherwise(none), crossing(e))))
    s = s.withColumn("left", side(lambda d: d >= 0)).withColumn("right", side(lambda d: d <= 0))
    met = F.flatten(F.transform("_e", lambda e: F.concat(F.when(e["a"]["d"] == 0, at(e["a"])).otherwise(none), crossing(e))))
    signs = F.transform(F.filter("_s", lambda p: p["d"] != 0), lambda p: F.signum(p["d"]))
    s = s.withColumn("_met", F.array_distinct(met)).withColumn("_signs", signs)
    m = F.size("_signs")
    turns = F.size(F.filter(F.sequence(F.lit(0), m - 1), lambda i: F.get("_signs", i) != F.get("_signs", (i + 1) % m)))
    cut = s.where((F.size("_met") == 2) & (m > 1)).where(turns == 2)
    p, q = F.get("_met", F.lit(0)), F.get("_met", F.lit(1))
    chord = F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    return cut.withColumn("chord", chord).drop("_s", "_e", "_met", "_signs")


_SHAPE = "[{'x': minx, 'y': miny}, {'x': maxx, 'y': miny}, {'x': maxx, 'y': (miny + maxy) / 2}, {'x': (minx + maxx) / 2, 'y': (miny + maxy) / 2}, {'x': (minx + maxx) / 2, 'y': maxy}, {'x': minx, 'y': maxy}]"


@register("j31_split_shapes", oracle("v_detection", f"""
WITH v AS (SELECT *, {_SHAPE} AS v, 25e-2 + doc_id % 3 * 1e-1 AS h FROM (SELECT DISTINCT doc_id, det_id, minx, miny, maxx, maxy FROM v_detection WHERE name = 'drawings')),
e AS (SELECT doc_id, det_id, minx, miny, maxx, maxy, i, v[i] AS a, v[i % 6 + 1] AS b, (v[i].y - h - 4e-1 * v[i].x) / sqrt(1 + 16e-2) AS da, (v[i % 6 + 1].y - h - 4e-1 * v[i % 6 + 1].x) / sqrt(1 + 16e-2) AS db FROM (SELECT *, unnest(range(1, 7)) AS i FROM v)),
z AS (SELECT * REPLACE (CASE WHEN abs(da) < 1e-9 THEN 0e0 ELSE da END AS da, CASE WHEN abs(db) < 1e-9 THEN 0e0 ELSE db END AS db) FROM e),
c AS (SELECT *, CASE WHEN da * db < 0 THEN {{'x': a.x + da / (da - db) * (b.x - a.x), 'y': a.y + da / (da - db) * (b.y - a.y)}} END AS c FROM z),
p AS (SELECT doc_id, det_id, minx, miny, maxx, maxy, s, i * 2 AS k, a AS p FROM c CROSS JOIN (VALUES (1), (-1)) t(s) WHERE da * s >= 0 UNION ALL SELECT doc_id, det_id, minx, miny, maxx, maxy, s, i * 2 + 1, c FROM c CROSS JOIN (VALUES (1), (-1)) t(s) WHERE c IS NOT NULL),
w AS (SELECT *, coalesce(lead(p) OVER o, first_value(p) OVER o) AS q FROM p WINDOW o AS (PARTITION BY doc_id, det_id, minx, miny, maxx, maxy, s ORDER BY k)),
r AS (SELECT doc_id, det_id, minx, miny, maxx, maxy, s, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area FROM w GROUP BY ALL),
h AS (SELECT doc_id, det_id, minx, miny, maxx, maxy, c AS c FROM c WHERE c IS NOT NULL UNION SELECT doc_id, det_id, minx, miny, maxx, maxy, a FROM c WHERE da = 0),
t AS (SELECT doc_id, det_id, minx, miny, maxx, maxy, count(*) FILTER (s <> n) AS turns FROM (SELECT *, sign(da) AS s, coalesce(lead(sign(da)) OVER o, first_value(sign(da)) OVER o) AS n FROM c WHERE da <> 0 WINDOW o AS (PARTITION BY doc_id, det_id, minx, miny, maxx, maxy ORDER BY i)) GROUP BY ALL),
m AS (SELECT doc_id, det_id, minx, miny, maxx, maxy, min(c) AS p, max(c) AS q FROM h JOIN t USING (doc_id, det_id, minx, miny, maxx, maxy) WHERE turns = 2 GROUP BY ALL HAVING count(*) = 2)
SELECT det_id, round(max(area) FILTER (s = 1), 6) AS left_area, round(max(area) FILTER (s = -1), 6) AS right_area, round(max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) AS chord
FROM r JOIN m USING (doc_id, det_id, minx, miny, maxx, maxy) GROUP BY doc_id, det_id, minx, miny, maxx, maxy"""))
def j31(spark, sf_dir):
    """L-shaped drawings that a slanted line of their page cuts in two: the areas of both parts and the chord."""
    d = views.detection(spark, sf_dir).where("name = 'drawings'").select("doc_id", "det_id", "minx", "miny", "maxx", "maxy").distinct()
    x, y = lambda k: F.col(f"{k}x"), lambda k: F.col(f"{k}y")
    cx, cy = (x("min") + x("max")) / 2, (y("min") + y("max")) / 2
    points = [(x("min"), y("min")), (x("max"), y("min")), (x("max"), cy), (cx, cy), (cx, y("max")), (x("min"), y("max"))]
    shape = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in points))
    h = F.lit(25e-2) + F.col("doc_id") % 3 * F.lit(1e-1)
    cut = split_by_line(d.withColumn("shape", shape), "shape", F.lit(0.0), h, F.lit(1.0), h + F.lit(4e-1))
    return cut.select("det_id", F.round(polygon_area(F.col("left")), 6).alias("left_area"), F.round(polygon_area(F.col("right")), 6).alias("right_area"), F.round("chord", 6).alias("chord"))
