"""Values of the column functions, computed by hand."""

import pytest
from pyspark.sql import functions as F

from plansift.functions import geometry as g
from plansift.functions import text as t
from plansift.operators.taxonomy import tier1, tier2
from plansift.streaming.visits import ban_steps, fixed_windows


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("code,want", [("8", "08"), ("080000", "08 00 00"), ("08-11-16", "08 11 16"), ("023321", "02 33 21"), ("abc ", "abc")])
def test_normal_code(spark, code, want):
    assert value(spark, t.normal_code(F.lit(code))) == want


@pytest.mark.parametrize("x,y,want", [(0.5, 0.9, "title-block"), (0.8, 0.5, "right-margin"), (0.5, 0.5, "r5-c5")])
def test_zone(spark, x, y, want):
    assert value(spark, g.zone(F.lit(x), F.lit(y))) == want


@pytest.mark.parametrize("a,b,want", [("DOORS", "door", True), ("A", "ab", False), ("A", "a", True), ("--", "--", False)])
def test_stem_match(spark, a, b, want):
    assert value(spark, t.stem_match(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize("text,word,want", [("INDOOR", "DOOR", False), ("a door.", "DOOR", True), ("C++ code", "C++", True), ("door_x", "door", False)])
def test_whole_word(spark, text, word, want):
    assert value(spark, t.whole_word(F.lit(text), word)) is want


@pytest.mark.parametrize("word,want", [("Straße", "STRAẞE"), ("ﬁn", "ﬁN"), ("ᾀx", "ᾈX"), ("a𝒳é", "A𝒳É"), ("", ""), (None, None)])
def test_upper_goes_letter_by_letter(spark, word, want):
    assert value(spark, t.upper(F.lit(word).cast("string"))) == want


def test_scores(spark):
    assert value(spark, F.round(tier1(F.lit(2)), 6)) == pytest.approx(0.1805)
    assert value(spark, F.round(tier1(F.lit(3)), 6)) == pytest.approx(0.76)
    assert value(spark, tier2(F.lit(3), F.lit(4))) == pytest.approx(0.421875)


def test_shapes(spark):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    assert value(spark, g.polygon_area(square)) == 1.0
    assert value(spark, g.polyline_length(square)) == 3.0


def test_csv_field(spark):
    assert value(spark, t.csv_field(F.lit('a "b", c'))) == '"a ""b"", c"'
    assert value(spark, t.csv_field(F.lit("plain"))) == "plain"


def test_fixed_windows():
    ok, start, used = fixed_windows([0, 1, 2, 10, 61, 62], 60, 3)
    assert ok == [True, True, True, False, True, True] and (start, used) == (61, 2)


def test_ban_steps():
    none = float("-1e18")
    out, _ = ban_steps([0, 1, 2, 3, 40, 41, 42, 43], 2, 10, 30, 300, 3600, (none, 0, none, none, none))
    assert out == ["ok", "ok", "cooldown", "cooldown", "ok", "ok", "banned", "banned"]


def test_running_sum_of_hot_and_null_keys(spark):
    from pyspark.sql import functions as F

    from plansift.functions.windows import running_sum

    rows = [("a" if n % 3 else None, n * 7 % 101, n) for n in range(300)] + [("b", 5, None), ("b", 5, 2), ("b", 6, 1)]
    got = sorted(tuple(r) for r in running_sum(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", "v", "s", width=10).select(F.coalesce("k", F.lit("")), "at", "v", "s").where("v IS NOT NULL").collect())
    assert got == sorted((k or "", at, v, sum(x for q, b, x in rows if q == k and b <= at and x is not None)) for k, at, v in rows if v is not None)
    assert running_sum(spark.createDataFrame([], "k string, at long, v long"), "k", "at", "v", "s").count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("D-01", "D-0l", True), ("D-01", "D01", True), ("D-01", "D-02", False), ("A", "A", True), ("AB", "A8", False), ("D--1", "D-1", True), ("-D1", "D1", False), ("-D11", "D11", True), ("D-1-2", "D12", False), ("B8B", "8B8", False), ("ABCD", "ABD", False), ("D11-", "D11", True), (None, "A", None)],
)
def test_fuzzy_tags(spark, a, b, want):
    from pyspark.sql import functions as F

    from plansift.operators.takeoff import is_fuzzy

    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(is_fuzzy(F.col("a"), F.col("b")).alias("x"), is_fuzzy(F.col("b"), F.col("a")).alias("y")).first()[:] == (want, want)


def test_anchored_rows(spark, sf_dir):
    from collections import defaultdict

    from plansift.operators.takeoff import w06
    from plansift.plans import views

    pages = defaultdict(list)
    for r in views.detection(spark, sf_dir).collect():
        pages[r["doc_id"]].append((r["miny"], r["det_id"]))
    want = []
    for doc, rows in pages.items():
        anchor, row = None, -1
        for y, det in sorted(rows):
            if anchor is None or y - anchor > 0.006:
                anchor, row = y, row + 1
            want.append((doc, det, row))
    assert sorted(tuple(r) for r in w06(spark, sf_dir).select("doc_id", "det_id", "row").collect()) == sorted(want)
