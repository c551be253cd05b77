"""Text regions and columns of pages: the classifier's own examples, and loops over random lines."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plansift.operators import layout as op

SCHEMA = "doc_id string, n int, text string, words int, minx double, miny double, maxx double, maxy double"


def line(text, x, y, w, h):
    return (text, len(text.split()), round(x, 9), round(y, 9), round(x + w, 9), round(y + h, 9))


NOTES = [line("GENERAL NOTES", 0.1, 0.1, 0.3, 0.025)] + [
    line(t, 0.1, 0.14 + 0.03 * k, w, 0.02)
    for k, (t, w) in enumerate([("1. All dimensions are approximate.", 0.3), ("2. Contractor shall verify all dimensions.", 0.4), ("3. All doors shall match schedule.", 0.35), ("4. Fire rating as noted.", 0.25), ("5. See specifications for finishes.", 0.35), ("6. Verify with architect before installation.", 0.4)])
]
VARIANTS = [line("GENERAL NOTES", 0.1, 0.1, 0.3, 0.025)] + [line(t, 0.1, 0.14 + 0.03 * k, 0.3, 0.02) for k, t in enumerate(["1) First variant with parens", "2) Second variant", "3) Third variant", "(4) Fourth", "5: Fifth"])]
TABLE = [line("DOOR SCHEDULE", 0.2, 0.1, 0.3, 0.025)] + [
    line(t, x, 0.14 + 0.03 * r, 0.12, 0.02) for r, row in enumerate([["TAG", "TYPE", "WIDTH", "HEIGHT"]] + [[f"D-0{k}", "HM", "3'-0\"", "7'-0\""] for k in range(1, 5)]) for t, x in zip(row, (0.1, 0.3, 0.5, 0.7), strict=True)
]
PROSE = [line("This is plain prose without structured numbering or tabular columns.", 0.1, 0.2 + 0.03 * r, 0.6, 0.02) for r in range(5)]


def frame(spark, pages):
    return spark.createDataFrame([(p, k, *ln) for p, lines in pages.items() for k, ln in enumerate(lines)], SCHEMA)


def test_the_classifiers_examples(spark):
    got = {}
    for r in op.text_regions(frame(spark, {"notes": NOTES, "variants": VARIANTS, "table": TABLE, "prose": PROSE, "few": NOTES[:4]})).collect():
        got.setdefault(r["doc_id"], []).append(r)
    notes = max(got["notes"], key=lambda r: r["confidence"])
    assert notes["type"] == "notes-numbered" and notes["confidence"] >= 0.6 and notes["header"] is None and notes["lines"] == 7 and notes["numbered"] == 6 and notes["kind"] == "GENERAL NOTES"
    assert any(r["type"] == "notes-numbered" for r in got["variants"])
    assert not any(r["type"] == "schedule-table" for r in got["prose"]) and got["prose"][0]["type"] == "paragraph" and "few" not in got
    joined = [line(t[0], t[2], t[3], t[4] - t[2], t[5] - t[3]) for t in TABLE] + [line("DOOR SCHEDULE NOTES FOLLOW BELOW HERE", 0.1, 0.12, 0.72, 0.015)]
    table = [r for r in op.text_regions(frame(spark, {"t": joined})).collect() if r["type"] == "schedule-table"]
    assert table and table[0]["columns"] >= 3 and table[0]["family"] == "SCHEDULE" and table[0]["confidence"] >= 0.8


def loop(lines):
    """Groups of line numbers: connected x ranges by brute force, cut by gaps."""
    n = len(lines)
    group = list(range(n))
    for i in range(n):
        for j in range(n):
            if not (lines[i][4] < lines[j][2] or lines[j][4] < lines[i][2]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    heights = sorted(round(ln[5] - ln[3], 9) for ln in lines)
    gap = (heights[(n - 1) // 2] + heights[n // 2]) / 2 * 4
    out = set()
    for g in set(group):
        piece, bottom = [], None
        for i in sorted((i for i in range(n) if group[i] == g), key=lambda i: (lines[i][3], lines[i][2], i)):
            if piece and lines[i][3] - bottom > gap + 1e-9:
                out.add(frozenset(piece))
                piece, bottom = [], None
            piece.append(i)
            bottom = lines[i][5] if bottom is None else max(bottom, lines[i][5])
        out.add(frozenset(piece))
    return out


def test_candidates_equal_a_loop(spark):
    rng = random.Random(5)
    pages = {f"p{k}": [line("some words here", rng.random() * 0.8, rng.random() * 0.9, rng.choice([0.05, 0.1, 0.3]), rng.choice([0.01, 0.02])) for _ in range(rng.randint(5, 40))] for k in range(60)}
    got = {}
    for r in op.candidates(frame(spark, pages)).collect():
        got.setdefault(r["doc_id"], {}).setdefault((r["band"], r["piece"]), set()).add(r["n"])
    assert {p: {frozenset(v) for v in g.values()} for p, g in got.items()} == {p: loop(lines) for p, lines in pages.items()}


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [line(f"left {k} one two three four", 0.05, 0.1 + 0.02 * k, 0.38, 0.012) for k in range(8)] + [line(f"right {k} one two three four", 0.55, 0.11 + 0.02 * k, 0.38, 0.012) for k in range(8)]
    random.Random(1).shuffle(rows)
    one = [line(f"line {k} one two three four five", 0.05, 0.1 + 0.02 * k, 0.8, 0.012) for k in range(8)]
    out = op.read_by_columns(frame(spark, {"two": rows, "one": one, "little": rows[:1]})).collect()
    read = lambda p: [r["text"].split()[:2] for r in sorted((r for r in out if r["doc_id"] == p), key=lambda r: r["place"])]
    assert read("two") == [["left", str(k)] for k in range(8)] + [["right", str(k)] for k in range(8)]
    assert read("one") == [["line", str(k)] for k in range(8)] and len(read("little")) == 1


@pytest.mark.parametrize("right", [1, 9])
def test_columns_need_four_words(spark, right):
    rows = [line("left " + "w " * (20 + k), 0.05, 0.1 + 0.02 * k, 0.38, 0.012) for k in range(8)] + [line("right", 0.6, 0.1 + 0.02 * k, 0.05, 0.012) for k in range(right)] + [line("far", 0.9, 0.5, 0.03, 0.01)] * (right > 3) * 9
    assert {r["column"] for r in op.read_by_columns(frame(spark, {"p": rows})).collect()} == ({1} if right == 1 else {1, 2, 3})


def test_categories_of_regions(spark):
    schema = "doc_id string, region string, type string, header string, body string, numbered long"
    regions = spark.createDataFrame([
        ("p", "door", "schedule-table", "DOOR SCHEDULE", "D-01", 0), ("p", "indoor", "schedule-table", "INDOOR SCHEDULE", "x", 0), ("p", "keys", "notes-key-value", None, "see keynotes here", 0), ("p", "notes", "notes-numbered", "GENERAL NOTES", "1. x", 3),
        ("p", "prose", "paragraph", "DOOR SCHEDULE", "x", 0), ("q", "weak", "unknown", None, "nothing", 0), ("q", "spec", "spec-dense-columns", None, "x", 0), ("q", "finish", "notes-numbered", None, "finish schedule", 0),
    ], schema)
    codes, found = spark.createDataFrame([("p", "08 11 16")], "doc_id string, code string"), spark.createDataFrame([("p", "door-schedule", 0.5), ("q", "finish-schedule", 0.3)], "doc_id string, label string, confidence double")
    got = {r["region"]: (r["category"], r["confidence"], r["own_page"]) for r in op.table_categories(regions, codes, found).collect()}
    assert got == {
        "door": ("door-schedule", 0.99, False), "indoor": ("material-schedule", 0.55, False), "keys": ("keynote-table", 0.45, True), "notes": ("general-notes", 0.65, False), "spec": ("spec-text", 0.3, False), "finish": ("finish-schedule", 0.4, False),
    }


def test_gutters_hold_a_page_in_one_row(spark, sf_dir):
    """Words never become rows: no windows, joins or sorts over them, and a page's histogram is that of a plain loop."""
    from plansift.plans.registry import queries

    plan = queries()["w15_low_runs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "SortMergeJoin", "BroadcastHashJoin")) and plan.count("Exchange hashpartitioning(doc_id") == 1
    rng = np.random.default_rng(5)
    pages = [np.concatenate([rng.integers(0, a, 60), rng.integers(b, 200, 60)]).tolist() for a, b in ((70, 90), (80, 84), (5, 195), (100, 100), (60, 140))] + [[], [7] * 9]
    got = op._low_runs(pa.array([None, *pages], pa.list_(pa.int32())).slice(1)).to_pylist()
    for bins, runs in zip(pages, got, strict=True):
        n = [bins.count(k) for k in range(200)]
        s = [n[max(k - 1, 0)] + n[k] + n[min(k + 1, 199)] for k in range(200)]
        low, want = [10 <= k < 190 and s[k] <= max(s) * 0.1 for k in range(200)] + [False], []
        for k in range(200):
            if low[k] and not low[k - 1]:
                end = low.index(False, k)
                want += [{"first": k, "last": end - 1}] if end - k >= 6 else []
        assert runs == want
