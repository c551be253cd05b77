"""Greedy region steps against loops over pages."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plansift.functions.geometry import polygon_area
from plansift.operators import regions as R
from plansift.operators.cuts import split_by_line
from plansift.plans import views


def pages(spark, sf_dir, key, only=None):
    out = defaultdict(list)
    for r in views.detection(spark, sf_dir).collect():
        if only is None or r["name"] == only:
            out[r["doc_id"]].append((r["det_id"], (r["minx"], r["miny"], r["maxx"], r["maxy"]), r["conf"]))
    return {d: sorted(rows, key=key) for d, rows in out.items()}


def shared(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a, b):
    return shared(a, b) / (area(a) + area(b) - shared(a, b))


def test_suppression(spark, sf_dir):
    want = set()
    for doc, rows in pages(spark, sf_dir, lambda r: (-r[2], r[0])).items():
        kept = []
        for r in rows:
            if not any(iou(k[1], r[1]) > 0.3 for k in kept):
                kept.append(r)
        want |= {(doc, r[0]) for r in kept}
    got = [(r["doc_id"], r["det_id"]) for r in R.g07(spark, sf_dir).collect()]
    assert set(got) == want


def test_merge_or_insert(spark, sf_dir):
    want = []
    for doc, rows in pages(spark, sf_dir, lambda r: (r[0], r[2])).items():
        kept = []
        for _, box, _ in rows:
            n = next((n for n, k in enumerate(kept) if iou(k, box) > 0.5), None)
            if n is None:
                kept.append(box)
            else:
                k = kept[n]
                kept[n] = (min(k[0], box[0]), min(k[1], box[1]), max(k[2], box[2]), max(k[3], box[3]))
        want += [(doc, *(round(v, 9) for v in k)) for k in kept]
    got = [(r["doc_id"], *(round(r[c], 9) for c in R.BOX)) for r in R.g03(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_tile_dedupe(spark, sf_dir):
    want = []
    for doc, rows in pages(spark, sf_dir, lambda r: (r[0], r[2]), "text_box").items():
        kept = []
        for r in rows:
            n = next((n for n, k in enumerate(kept) if shared(k[1], r[1]) > 0.5 * min(area(k[1]), area(r[1]))), None)
            if n is None:
                kept.append(r)
            elif r[2] > kept[n][2]:
                kept[n] = r
        want += [(doc, r[0]) for r in kept]
    # rows of one id and confidence come in any order, with equal results
    assert sorted((r["doc_id"], r["det_id"]) for r in R.g08(spark, sf_dir).collect()) == sorted(want)


@pytest.mark.parametrize(
    ("points", "x", "want"),
    [([(0, 0), (1, 0), (1, 1), (0, 1)], 0.25, (0.25, 0.75)), ([(0, 0), (1, 0), (1, 1), (0, 1)], 2, None), ([(0, 0), (4, 0), (0, 4)], 1, (3.5, 4.5)),
     ([(0, 0), (4, 0), (4, 3), (3, 3), (3, 1), (1, 1), (1, 3), (0, 3)], 2, (5.0 - 1, 5.0 - 1)), ([(0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (3, 2), (3, 3), (0, 3)], 2, None)],
)
def test_polygon_halves(spark, points, x, want):
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in points],)], "v array<struct<x:double,y:double>>")
    # seen upwards, the smaller x lie on the left of the line
    out = split_by_line(df, "v", *(F.lit(float(c)) for c in (x, 0, x, 1))).select(polygon_area(F.col("left")), polygon_area(F.col("right"))).collect()
    assert [tuple(r) for r in out] == ([] if want is None else [want])


def test_pages_of_no_boxes(spark):
    none = spark.createDataFrame([], R._SCHEMA)
    assert R.in_page_order(none, ["det_id"], R.suppress, R._SCHEMA).count() == 0
