"""Pages are dealt out once: words, boxes and their pairs are not shuffled again, and components write nothing."""

import pytest

from plansift.operators.graphs import page_components
from plansift.plans.registry import queries


def exchanges(spark, sf_dir, name):
    return queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["t01_position_cells", "t02_clipped_cells", "t06_table_confidence", "t07_grid_lines", "x12_header_rows"])
def test_words_and_boxes_of_tables_meet_after_two_exchanges(spark, sf_dir, name):
    assert exchanges(spark, sf_dir, name) == 2


def test_cells_of_sheets_need_one_exchange(spark, sf_dir):
    assert exchanges(spark, sf_dir, "t08_cells_by_bounds") == 1


def test_components_write_nothing(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: pytest.fail("written"))
    nodes = [(p, f"n{k:03}") for p in ("x/0", "x/1") for k in range(200)] + [("y", "a")]
    edges = [("x/0", f"n{k:03}", f"n{k + 1:03}") for k in range(150, 0, -1)]
    got = page_components(spark.createDataFrame(nodes, "doc_id string, det_id string"), spark.createDataFrame(edges, "doc_id string, a string, b string")).collect()
    assert {tuple(r) for r in got} == {(p, d, "n001" if p == "x/0" and "n001" <= d <= "n151" else d) for p, d in nodes} and len(got) == len(nodes)


def test_components_deal_sides_of_a_union_again(spark):
    """Both sides are dealt by page already, but adaptive execution reads them in different portions."""
    nodes = spark.createDataFrame([("x", "a"), ("x", "b")], "doc_id string, det_id string").repartition("doc_id")
    edges = spark.createDataFrame([("x", "a", "b")], "doc_id string, a string, b string").repartition("doc_id")
    got = page_components(nodes, edges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(xxhash64(" in plan[: plan.index("Union")]
    assert {tuple(r) for r in got.collect()} == {("x", "a", "a"), ("x", "b", "a")}


def test_lines_of_text_regions_are_made_once(spark, sf_dir):
    assert exchanges(spark, sf_dir, "r07_text_regions") == 3


def test_lines_need_no_window(spark, sf_dir):
    from plansift.plans import views

    assert "Window" not in views.layout(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_page_regions_are_read_three_times(spark, sf_dir):
    """Boxes, those that confirm and the drawings of models; two readings of the texts' regions."""
    plan = queries()["r09_page_regions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 3 and "SortMergeJoin" not in plan


def test_density_components_deal_boxes_once(spark, sf_dir):
    plan = queries()["g06_density_components"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1 and plan.count("Exchange hashpartitioning") == 3


def test_categories_read_the_texts_regions_once(spark, sf_dir):
    plan = queries()["r08_region_categories"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_groups_of_words_are_dealt_out_as_sums(spark, sf_dir):
    """No words and no pairs of group and document are dealt out: texts once, then sums by group; no window sorts words."""
    from collections import Counter

    from plansift.operators.sequences import line_grams

    plan = queries()["w01_ngrams"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange hashpartitioning(gram") == 1 and plan.count("Exchange hashpartitioning") == 2
    texts = [(1, "a b a b a b a b a b a b c\n a  b"), (2, " a b "), (3, ""), (4, None), (5, "a"), (None, "a b")]
    times, docs = Counter(), {}
    for doc, text in texts:
        w = (text or "").split()
        for i in range(len(w)):
            for n in range(1, 4):
                if i % 12 + n <= 12 and i + n <= len(w):
                    g = (n, " ".join(w[i : i + n]))
                    times[g] += 1
                    docs.setdefault(g, set()).add(doc)
    got = {(r["n"], r["gram"]): (r["times"], r["docs"]) for r in line_grams(spark.createDataFrame(texts, "doc_id long, text string"), least=1).collect()}
    assert got == {g: (n, len(docs[g] - {None})) for g, n in times.items()}


def test_region_categories_sort_no_windows_and_deal_no_words(spark, sf_dir):
    plan = queries()["r08_region_categories"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode(filter(split(text" not in plan and "collect_list" not in plan


def test_codes_are_found_within_a_texts_row(spark, monkeypatch):
    from plansift.operators import taxonomy as op
    from plansift.plans import views

    codes = [("c1", "a b"), ("c2", "b"), ("c3", "a-b a"), ("c4", "a b"), ("c5", ""), ("c6", None), ("c7", "x  y"), ("c8", "été b c d e f")]
    texts = [(1, "A b a\tB"), (2, "b"), (3, None), (4, ""), (5, " x y "), (6, "a"), (7, "Été B c D\ne f a"), (8, "été b c d e"), (None, "a b"), (2, "a b a")]
    tax = spark.createDataFrame(codes, "code string, description string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = set()
    for doc, text in texts:
        w = (text or "").lower().split()
        for code, d in codes:
            p = (d or "").replace("-", " ").split(" ")
            if doc is not None and any(w[i : i + len(p)] == p for i in range(len(w))):
                want.add((doc, code))
    got = [tuple(r) for r in op.text_hits(docs, tax).select("doc_id", "code").collect()]
    assert set(got) == want and len(got) == len(want) > 8
    assert {tuple(r) for r in op.phrase_hits(views.word_of(docs), tax).collect()} >= want - {(2, c) for c in ("c1", "c3", "c4")}
    monkeypatch.setattr(op, "HELD", 3)
    assert "ArrowEvalPython" not in op.text_hits(docs, tax)._jdf.queryExecution().executedPlan().toString()


def test_pages_meet_over_batches():
    import numpy as np
    import pyarrow as pa

    from plansift.operators import layout as op

    rng = np.random.default_rng(2)
    rows = [(f"p{p}", k, f"1. some words {k}", 4.0, float(x), float(y), float(x) + 0.3, float(y) + 0.02, 0.02, True, False) for p in range(9) for k, (x, y) in enumerate(np.round(rng.random((int(rng.integers(1, 40)), 2)), 3))]
    whole = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n", "text", "words", "minx", "miny", "maxx", "maxy", "height", "numbered", "section"), r, strict=True)) for r in rows])
    one = pa.Table.from_batches(op._by_page(iter([whole])))
    for size in (1, 7, 30):
        cut = op._by_page(iter([whole.slice(k, size) for k in range(0, whole.num_rows, size)]))
        assert pa.Table.from_batches(cut).to_pylist() == one.to_pylist() and one.num_rows > 5
    assert list(op._by_page(iter([whole.slice(0, 0)]))) == [] and list(op._by_page(iter([whole.slice(0, 2)]))) == []


def test_pairs_of_words_are_summed_up_by_portions(spark, sf_dir, monkeypatch):
    """Equal to loops, whatever the portions; neither words nor pairs of words and document are sorted or dealt out."""
    import re
    from collections import defaultdict

    from plansift.operators import sequences as S

    texts = [(1, "a b a b"), (2, " b\x0ba  b c\n"), (3, None), (4, ""), (None, "a b c"), (5, "a b\tb"), (6, "one"), (7, "b c"), (-8, "B a b")]
    n, docs = defaultdict(int), defaultdict(set)
    for i, t in texts:
        ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]
        for pair in map(" ".join, zip(ws, ws[1:])):
            n[pair] += 1
            docs[pair] |= {i} - {None}
    pages = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for size in (1, 12, 1 << 20):
        monkeypatch.setattr(S, "PAIR_BYTES", size)
        for least in (0, 1, 3):
            got = sorted((r["pair"], r["n"], r["first_doc"]) for r in S.common_pairs(pages, least).collect())
            assert got == sorted((p, n[p], min(docs[p], default=None)) for p in n if len(docs[p]) >= least)
    assert S.common_pairs(pages.limit(0)).count() == 0
    plan = S.w04(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange ") == 1
