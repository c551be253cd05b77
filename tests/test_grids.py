"""Grid merge: alignment against all alignments of small grids, hand-made grids, and agreement by a loop."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansift.operators import grids as op

SCHEMA = "grid long, method string, confidence double, row int, col int, header string, value string"


def frame(spark, *tables):
    rows = [(1, m, c, i, j, h, v) for m, c, heads, body in tables for i, r in enumerate(body) for j, (h, v) in enumerate(zip(heads, r, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def test_alignment_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for _ in range(80):
        a, b = rng.integers(0, 3, (int(rng.integers(0, 5)), 3)), rng.integers(0, 3, (int(rng.integers(0, 5)), 3))
        like = lambda i, j: ((a[i] == b[j]) & (a[i] != 0)).mean()  # noqa: B023, E731
        best = 0.0
        for k in range(min(len(a), len(b)) + 1):
            for i in itertools.combinations(range(len(a)), k):
                for j in itertools.combinations(range(len(b)), k):
                    if all(like(x, y) >= 0.25 for x, y in zip(i, j, strict=True)):
                        best = max(best, sum(like(x, y) for x, y in zip(i, j, strict=True)))
        pairs, mean = op.aligned_rows(a, b)
        assert sum(like(i, j) for i, j in pairs) == pytest.approx(best) and all(x < y for p, q in itertools.pairwise(pairs) for x, y in zip(p, q, strict=True))
        assert mean == pytest.approx(best / max(min(len(a), len(b)), 1))


HEADS = ["TAG", "TYPE", "SIZE"]
BODY = [[f"D-10{k}", t, str(k)] for k, t in enumerate(["steel", "wood", "glass", "vinyl", "brick", "metal"])]


def test_rows_that_are_missing_or_doubled(spark):
    other = [BODY[0], ["x", "new row", "77"], *BODY[1:3], *BODY[4:]]
    cells, grid = op.merged(frame(spark, ("a", 0.8, HEADS, BODY), ("b", 0.7, HEADS, other)))
    verdicts = {(r["row"], r["header"]): r["verdict"] for r in cells.collect()}
    assert all(v == ("base" if row == 3 else "agree") for (row, _), v in verdicts.items()) and len(verdicts) == 18
    g = grid.first()
    assert (g["base"], g["merged"], g["tag_column"]) == ("a", "b", "TAG")
    rate = (15 + 3 * 0.5) / 18
    assert g["rate"] == pytest.approx(rate) and g["confidence"] == pytest.approx(0.8 * 0.6 + rate * 0.3 + 0.04, abs=1e-6)


def test_base_guard_fill_and_disagreement(spark):
    gaps = [[t, "" if k == 1 else v, s] for k, (t, v, s) in enumerate(BODY)]
    far = [[t, "completely other" if k == 2 else v, s] for k, (t, v, s) in enumerate(BODY)]
    near = [[t, v + "x" if k == 4 else v, s] for k, (t, v, s) in enumerate(far)]
    no_tags = [["", v, s] for _, v, s in BODY]
    wide = [[*r, *(str(k) for k in range(8))] for r in BODY]
    tables = [
        ("gaps", 0.7, HEADS, gaps), ("near", 0.65, ["TAG", "KIND", "SIZE"], near), ("untagged", 0.9, HEADS, no_tags), ("one", 0.99, ["ALL"], [[" ".join(r)] for r in BODY]), ("wide", 0.5, HEADS + [f"c{k}" for k in range(8)], wide), ("short", 0.5, HEADS, BODY[:2]),
        ("other", 0.5, HEADS, [["q", "w", "e"]] * 6),
    ]
    cells, grid = op.merged(frame(spark, *tables))
    g = grid.first()
    assert g["base"] == "gaps" and g["merged"] == "near,untagged"
    got = {(r["row"], r["header"]): (r["value"], r["verdict"]) for r in cells.collect()}
    assert got[1, "TYPE"] == ("wood", "filled") and got[2, "TYPE"] == ("glass", "disagree") and got[4, "TYPE"] == ("brick", "agree")
    rate = (18 - 2) / 18
    assert g["rate"] == pytest.approx(rate) and g["confidence"] == pytest.approx(min(0.7 * 0.6 + rate * 0.3 + 0.14, 0.98), abs=1e-6)


def test_given_tables(spark, sf_dir):
    grid = op.merged(op.method_grids(spark, sf_dir))[1].collect()
    assert grid and all(r["base"] == "lattice" and r["tag_column"] == "TAG" and "stream" in r["merged"] and "blob" not in r["merged"] for r in grid)
    cells = op.merged(op.method_grids(spark, sf_dir))[0]
    assert {r["verdict"] for r in cells.select("verdict").distinct().collect()} >= {"agree", "filled", "disagree"}
    assert cells.where(F.col("value") == "").count() < 0.05 * cells.count()


def test_grids_become_objects_a_few_at_a_time():
    """A batch of any length is paired in parts of `AT_ONCE` grids, so that a task's Python holds no more."""
    import pyarrow as pa

    cells = [{"row": i, "at": 0, "value": f"v{i}"} for i in range(4)]
    n = 3 * op.AT_ONCE + 1
    batch = pa.RecordBatch.from_pylist([{"grid": g, "method": "m", "n_rows": 4, "base_rows": 4, "width": 1, "cells": cells, "base": cells} for g in range(n)])
    parts = [p.num_rows for p in op._aligned(iter([batch]))]
    assert parts == [4 * op.AT_ONCE] * 3 + [4]
