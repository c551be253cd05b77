"""Ranges by prefix, polygons cut by lines and greedy clusters, against plain Python."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from plansift.functions.geometry import polygon_area
from plansift.operators import cuts, graphs, ranges


def test_ranges_equal_brute_force(spark):
    rng = random.Random(3)
    table = []
    for k in range(400):
        lo = rng.choice([0, 2**32 - 5000, 10_000, rng.randrange(2**32)]) + rng.randrange(3000)
        table.append((lo, min(lo + rng.choice([0, 1, 7, 255, 5000, 2**20]), 2**32 - 1), f"c{k % 37}"))
    table += [(5, 4, "empty"), (0, 2**32 - 1, "all")]
    numbers = [rng.choice(table)[rng.randrange(2)] + rng.randrange(-3, 4) for _ in range(600)] + [0, 2**32 - 1]
    numbers = [n for n in numbers if 0 <= n < 2**32]
    parts = []
    for lo, hi, v in table:
        if lo <= hi:
            parts += [(32 - n.prefixlen, lo, hi, v, int(n.network_address), int(n.broadcast_address)) for n in ipaddress.summarize_address_range(ipaddress.ip_address(lo), ipaddress.ip_address(hi))]
    want = {n: min((p for p in parts if p[4] <= n <= p[5]), default=(0, 0, 0, None))[3] for n in set(numbers)}
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "number long")
    out = ranges.located(df, spark.createDataFrame(table, "lo long, hi long, value string"))
    assert {r["number"]: r["value"] for r in out.collect()} == want
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString()
    none = ranges.located(df, spark.createDataFrame([], "lo long, hi long, value string"))
    assert {r["value"] for r in none.collect()} == {None}


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
L = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
U = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)]


def cut(spark, points, a, b):
    df = spark.createDataFrame([([tuple(map(float, p)) for p in points],)], "v array<struct<x:double,y:double>>")
    out = cuts.split_by_line(df, "v", *(F.lit(float(c)) for c in (*a, *b)))
    return [tuple(r) for r in out.select(polygon_area(F.col("left")), polygon_area(F.col("right")), "chord").collect()]


@pytest.mark.parametrize(
    ("points", "a", "b", "want"),
    [
        (SQUARE, (-5, 5), (15, 5), (50, 50, 10)), (SQUARE, (5, -5), (5, 15), (50, 50, 10)), (SQUARE, (-1, -1), (11, 11), (50, 50, 200**0.5)), (SQUARE, (-5, 3), (15, 3), (30, 70, 10)), (SQUARE, (-5, 20), (15, 20), None), (SQUARE, (-5, -1), (15, -1), None),
        (SQUARE, (-5, 0), (15, 0), None), ([(0, 0), (10, 0)], (5, -5), (5, 5), None), (L, (-5, 2), (15, 2), (20, 44, 10)), (U, (-5, 8), (15, 8), None), (SQUARE, (-1, 1), (1, -1), None),
    ],
)
def test_cuts(spark, points, a, b, want):
    got = cut(spark, points, a, b)
    assert (want is None and got == []) or (sorted(got[0][:2]) == pytest.approx(sorted(want[:2])) and got[0][2] == pytest.approx(want[2]))


def test_areas_sum_to_the_whole(spark):
    import math

    rng = random.Random(6)
    rows = []
    for k in range(80):
        n = rng.randint(3, 9)
        angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
        rows.append((k, [(math.cos(t) * (1 + rng.random()), math.sin(t) * (1 + rng.random())) for t in angles], rng.random() * 4 - 2, rng.random() * 4 - 2, rng.random() * 4 - 2, rng.random() * 4 - 2))
    df = spark.createDataFrame(rows, "id int, v array<struct<x:double,y:double>>, ax double, ay double, bx double, by double")
    got = cuts.split_by_line(df, "v", *map(F.col, ("ax", "ay", "bx", "by"))).select(polygon_area(F.col("v")).alias("whole"), polygon_area(F.col("left")).alias("l"), polygon_area(F.col("right")).alias("r"))
    got = got.collect()
    assert len(got) > 15 and all(abs(r["whole"] - r["l"] - r["r"]) < 1e-9 for r in got)


def test_greedy_clusters_equal_a_loop(spark):
    rng = random.Random(4)
    divisions = ["03", "05", "08", "09", "12", "22", "23", "26", "31", "32"]
    rows = {(f"p{rng.randrange(25)}", page, d) for page in range(140) for d in rng.sample(divisions, rng.randint(1, 5))}
    got = {(r["project"], r["cluster"], r["divisions"], r["cohesion"]) for r in graphs.adhoc_clusters(spark.createDataFrame(list(rows), "project string, doc_id long, division string"), 0.5).collect()}
    want = set()
    for p in {r[0] for r in rows}:
        pages = {}
        for _, page, d in sorted(r for r in rows if r[0] == p):
            pages.setdefault(d, set()).add(page)
        order = sorted(pages, key=lambda d: (min(pages[d]), d))
        worst = lambda g: min(len(pages[a] & pages[b]) / min(len(pages[a]), len(pages[b])) for a in g for b in g if a < b)  # noqa: B023, E731
        done = set()
        for name, members in graphs.CLUSTERS.items():
            here = [d for d in members if d in pages]
            if len(here) > 1 and worst(here) >= 0.5:
                want.add((p, name, ",".join(sorted(here)), round(worst(here), 3)))
                done |= set(here)
        left = [d for d in order if d not in done]
        for i, d in enumerate(left):
            if d in done:
                continue
            group = [d]
            for e in left[i + 1 :]:
                if e not in done and worst([*group, e]) >= 0.5:
                    group.append(e)
            if len(group) > 1:
                want.add((p, "+".join(sorted(group)), ",".join(sorted(group)), round(worst(group), 3)))
                done |= set(group)
    assert got == want and len(want) > 10
