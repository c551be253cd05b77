"""Dense components and white rectangles: the surveyed examples, and brute force on small masks."""

import numpy as np
import pytest

from plansift.operators import masks as op

SCHEMA = "doc_id long, name string, minx double, miny double, maxx double, maxy double, conf double"


def regions(spark, boxes, **more):
    rows = [(1, *b[:5], b[5] if len(b) > 5 else 0.9) for b in boxes]
    return sorted(op.dense_regions(spark.createDataFrame(rows, SCHEMA), **more).collect(), key=lambda r: -r["confidence"])


def test_dense_regions(spark):
    one = regions(spark, [("text_box", 0.55, 0.1 + 0.05 * k, 0.9, 0.15 + 0.05 * k) for k in range(5)])
    assert one and one[0]["classes"] == "text_box" and one[0]["minx"] > 0.4 and one[0]["cells"] > 0
    three = regions(spark, [(n, 0.1, 0.1 + 0.05 * k, 0.5, 0.15 + 0.05 * k) for k in range(4) for n in ("text_box", "vertical_area", "horizontal_area")])
    assert set(three[0]["classes"].split("+")) == {"text_box", "vertical_area", "horizontal_area"}
    assert regions(spark, [("text_box", 0.1, 0.1, 0.5, 0.5, 0.05)] * 2, sure=0.5) == []
    weighed = [("vertical_area", 0.1, 0.05, 0.9, 0.4), ("vertical_area", 0.1, 0.1, 0.9, 0.35), ("text_box", 0.1, 0.6, 0.9, 0.9), ("text_box", 0.1, 0.65, 0.9, 0.85), ("text_box", 0.1, 0.7, 0.9, 0.8)]
    low = regions(spark, weighed, weights={"vertical_area": 0.1})
    assert low and all((r["miny"] + r["maxy"]) / 2 >= 0.5 for r in low)


def test_mean_density_is_exact(spark):
    """A mean over 128 cells of tenths is often a tie at six decimals; it is rounded as it is, not as its sum in doubles came out."""
    from decimal import ROUND_HALF_UP, Decimal

    rows = [(page, "text_box", (k % 16) / 16 + 0.01, (k // 16) / 16 + 0.01, (k % 16) / 16 + 0.02, (k // 16) / 16 + 0.02, c / 10) for page in range(1, 8) for k in range(128) for c in [10 if k < page else 7 if (k * page) % 3 else 4]]
    for r in op.dense_regions(spark.createDataFrame(rows, SCHEMA)).collect():
        exact = sum((Decimal(10 if k < r["doc_id"] else 7 if (k * r["doc_id"]) % 3 else 4) for k in range(128)), Decimal(0)) / 1280
        assert Decimal(repr(r["confidence"])) == exact.quantize(Decimal("0.000001"), ROUND_HALF_UP) and r["cells"] == 128


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(1)
    mask = rng.random((50, 6, 6)) < 0.35
    mask[0], mask[1] = True, False
    got = op.spread(mask)
    for page, labels in zip(mask, got, strict=True):
        want, todo = np.full((6, 6), -1), {(int(y), int(x)) for y, x in zip(*np.nonzero(page), strict=True)}
        while todo:
            seed = min(todo)
            front, seen = [seed], {seed}
            while front:
                y, x = front.pop()
                for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if p in todo and p not in seen:
                        seen.add(p)
                        front.append(p)
            todo -= seen
            for p in seen:
                want[p] = min(a * 6 + b for a, b in seen)
        assert (labels == want).all()


def mask_of(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


@pytest.mark.parametrize(
    ("rows", "want"),
    [(("...", "...", "..."), (0, 0, 3, 3)), (("###", "###"), (0, 0, 0, 0)), (("#..#", "#..#", "####"), (1, 0, 2, 2)), (("##.##",) * 4, (2, 0, 1, 4))],
)
def test_largest_rectangle_examples(rows, want):
    assert op.largest_rectangle(mask_of(*rows)) == want
    assert op.largest_rectangle(np.zeros((0, 0), bool)) == (0, 0, 0, 0)
    tie = op.largest_rectangle(mask_of("..##..", "..##..", "..##.."))
    assert tie[2] * tie[3] == 6


def test_rectangles_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        mask = rng.random((int(rng.integers(1, 8)), int(rng.integers(1, 9)))) < 0.35
        rows, cols = mask.shape
        best = max((h * w for y in range(rows) for x in range(cols) for h in range(1, rows - y + 1) for w in range(1, cols - x + 1) if not mask[y : y + h, x : x + w].any()), default=0)
        found = op.largest_rectangles(mask, 3)
        assert (found[0][2] * found[0][3] if found else 0) == best
        left = mask.copy()
        for x, y, w, h in found:
            assert not left[y : y + h, x : x + w].any()
            left[y : y + h, x : x + w] = True


def test_white_rectangles_of_pages(spark):
    rows = [("p", 0.0, 0.1 * k, 0.4, 0.1 * k + 0.1) for k in range(10)] + [("p", 0.6, 0.1 * k, 1.0, 0.1 * k + 0.1) for k in range(10)]
    got = op.white_rectangles(spark.createDataFrame(rows, "doc_id string, minx double, miny double, maxx double, maxy double")).collect()
    assert [(r["nth"], r["kind"], round(r["x"], 2), round(r["w"], 2), r["h"]) for r in got] == [(1, "gutter", 0.4, 0.2, 1.0)]


def test_rows_are_looked_at_again_only_under_their_bound(monkeypatch):
    """Fifty lines with ragged ends, five rectangles: a row is not gone through once for each of them."""
    rng = np.random.default_rng(4)
    mask = np.zeros((300, 200), bool)
    for k in range(50):
        mask[6 * k : 6 * k + 4, 10 : int(rng.integers(60, 150))] = True
    calls, look = [], op._largest_above
    monkeypatch.setattr(op, "_largest_above", lambda *a: calls.append(a[-1]) or look(*a))
    found = op.largest_rectangles(mask, 5)
    right = int(mask.any(axis=0).nonzero()[0].max()) + 1
    assert len(found) == 5 and found[0] == (right, 0, 200 - right, 300)
    assert [w * h for _, _, w, h in found] == sorted((w * h for _, _, w, h in found), reverse=True)
    assert len(calls) < 200  # of five times a hundred rows of cells
