"""Nearest neighbours, packing, extraction and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from plansift.llm import ann_tree, html_extract, packing


def exact(rows, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.einsum("ij,j->i", x, x[i], optimize=False)
        at = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in at]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(5000 + i, rows[40][1]) for i in range(60)]  # ties
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0, None] * 8), (9080, [1.0]), (None, rows[0][1])]
    got = defaultdict(list)
    for r in ann_tree.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in got.items():
        assert [n for n, _, _ in near] == list(range(1, 21))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_recall_on_the_tables_of_embeddings(spark):
    """All queries of a whole table, most of which calibration has not seen."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    held_out = ann_tree.search(table.selectExpr("vec_id", "embedding"))
    want, got = exact(rows), defaultdict(set)
    for r in held_out.collect():
        got[r["query_id"]].add(r["vec_id"])
    assert got.keys() == want.keys()
    hits = [len(got[q] & {i for i, _ in near}) for q, near in want.items()]
    assert sum(hits) >= 0.9 * 20 * len(want)


def test_calibration_holds_for_other_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 24))
    rows = [(i, (centres[i % 50] + 0.5 * rng.normal(size=24)).tolist()) for i in range(6000)]
    monkeypatch.setattr(ann_tree, "CALIBRATION", 60)
    found = defaultdict(set)
    for r in ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found[r["query_id"]].add(r["vec_id"])
    want = exact(rows)
    assert len(want) == 300 and sum(len(found[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 20 * 300


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 50, [float(i % 7), 1.0, float(i % 3)], i, "x", 0.5) for i in range(100)]
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, leaf string, vec double"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and {r["query_id"] for r in got.collect()} == {0, 20, 40}


def test_few_rows_give_all(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.1])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann_tree.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_queries_are_not_repeated_by_leaf(spark, monkeypatch):
    """Many leaves and small blocks: the same rows, and no table with a query's vector once a leaf."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2000)] + [(3000 + i, [3.0] * 8) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann_tree, "LEAF_ROWS", 8)
    written, write = [], ann_tree.saved

    def counted(df, name):
        written.append((out := write(df, name)).count())
        return out

    monkeypatch.setattr(ann_tree, "saved", counted)
    whole = sorted(map(tuple, ann_tree.search(table).collect()))
    assert max(written) == len(rows)
    monkeypatch.setattr(ann_tree, "ROW_BLOCK", 50)
    monkeypatch.setattr(ann_tree, "QUERY_BLOCK", 16)
    assert sorted(map(tuple, ann_tree.search(table).collect())) == whole and len(whole) == 20 * 110


def test_groups_of_leaves_are_bounded():
    assert ann_tree.grouped({0: 3, 1: 4, 2: 4, 5: 25, 6: 1}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 1), 5: (2, 3), 6: (3, 1)}


def test_nearest_sees_only_the_leaves_of_a_query(monkeypatch):
    rng = np.random.default_rng(2)
    x, q = rng.integers(-2, 3, (60, 4)).astype(float), rng.integers(-2, 3, (9, 4)).astype(float)
    ids, own, leaf, seen = np.arange(60) // 2, np.arange(9), np.arange(60) % 3, rng.random((9, 3)) < 0.5
    want = []
    for n in range(9):
        can = [r for r in range(60) if ids[r] != own[n] and seen[n, leaf[r]]]
        want += [(n, float(q[n] @ x[r]), int(ids[r])) for r in sorted(can, key=lambda r: (-(q[n] @ x[r]), ids[r]))[:5]]
    for products in (1, 200, 1 << 20):
        monkeypatch.setattr(ann_tree, "PRODUCTS", products)
        at, row, score = ann_tree.nearest(x, ids, q, own, 5, (leaf, seen))
        assert list(zip(at.tolist(), score.tolist(), ids[row].tolist(), strict=True)) == want


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_pieces_restore_every_document(docs, texts, odd, tokenizer):
    rows = packing.pack(docs).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == ids.size
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == ids.size
    padding = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert sum(r["length"] for r in packing.pack(odd).collect()) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packing.pack(odd.limit(0)).count() == 0


def test_added_tokens_have_their_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y  <|endoftext", "  \n<|endoftext|>  c", "no such token"]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    encode = packing.encoder(*packing.default_tokenizer(), packing.added_tokens(packing.default_tokenizer()[0]))
    for n, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert encode(text) == ids
        assert got[n]["doc_tokens"] == len(ids) + 1
    assert encode(texts[0]) == [64, 220, 50256, 275]


def test_sum_of_squares_choice():
    p = packing.Packer(0, 10)
    list(p.add(0, 4))
    assert p.best(6) == 4  # fills the window: no level is left
    list(p.add(1, 7))
    for size in range(1, 10):
        n = p.level.copy()
        cost = {}
        for level in range(0, 11 - size):
            if level == 0 or n[level]:
                m = n.copy()
                m[level] -= level > 0
                m[level + size] += level + size < 10
                cost[level] = int((m[1:10] ** 2).sum())
        assert cost[p.best(size)] == min(cost.values())


PAGE = (
    "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a>menu</a></ul></nav><main><article><h1>Title &amp; more</h1>"
    "<p>One <b>bold</b>text<br>two &nbsp; three<p>unclosed<div class='ad'>buy</div><form>mail</form><p>Last<script>if(a<b){{}}</script> part {n}</p>"
    "<p>Share this story</p><section class='comments'><p>c</p></section></article></main><aside>side</aside><footer>f</footer></body></html>"
)


def test_extraction(spark):
    rows = [(n, f"http://host.example/{n}", PAGE.format(n=n)) for n in range(24)] + [(120, None, None), (121, "x", ""), (122, "http://other.example/", "<p>plain</p><p>text"), (123, "http://other.example/", "<!-- <p>")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Last part 3"  # the rest is alike on all pages of the host
    assert got[3]["n_chars"] == len(got[3]["text"])
    assert got[120]["text"] == got[121]["text"] == got[123]["text"] == "" and got[122]["text"] == "plain\n\ntext"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_pages_clashing_columns_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {n} of a long page.</p>" for n in range(20_000)) + "</article>"
    rows = [(n, f"http://host.example/{n}", PAGE.format(n=n), "a", 1, "t", None) for n in range(12)] + [(5, "http://host.example/5", PAGE.format(n=5), "b", 2, None, "x")] * 3
    rows += [(50, "http://long.example/", long, None, None, None, None), (None, None, None, None, None, None, None)]
    names = "page_id long, url string, html string, host string, n_chars int, text string, `a.b` string"
    got = html_extract.extract(spark.createDataFrame(rows, names)).collect()
    assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] == 5] == ["Last part 5"] * 4
    assert next(r for r in got if r["page_id"] == 50)["text"].count("\n\n") == 19_999
    assert [r["text"] for r in got if r["page_id"] is None] == [""]


def test_parts_of_a_page():
    assert html_extract.main_text(PAGE.format(n=3), frozenset(), frozenset()).split("\n\n") == ["Title & more", "One boldtext two three", "unclosed", "Last part 3", "Share this story"]
    marked = "<div class='post'><p>a</p><div id=cookie-notice>b</div><div hidden>c</div><ul role=navigation><li>d</ul><p>e<aside>f</aside>"
    assert html_extract.main_text(marked, frozenset(), frozenset()) == "a\n\ne"


def test_pages_keep_their_articles(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        assert r["text"] == "\n\n".join(p for p in parts if p)


def test_classes_are_equal_occurrence_vectors(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(8)]
    pages = html_extract._pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    got = html_extract.classes(pages).collect()
    whole = {t for r in got for t in r["tokens"]}
    counts = [html_extract.page_tokens(r[2]) for r in rows]
    vectors = defaultdict(set)
    for token in whole:
        vectors[tuple(c[token] for c in counts)].add(token)
    assert {frozenset(r["tokens"]) for r in got} == {frozenset(v) for v in vectors.values()}


def extracted(spark, bodies):
    rows = [(n, f"http://h.example/{n}", f"<html><body>{b}</body></html>") for n, b in enumerate(bodies)]
    return {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_article_template_of_a_small_host(spark):
    bodies = [f"<article><h1>Title {n}</h1>{'<p>Part of %d</p>' % n * (n % 3 + 1)}<div>Share this story</div></article>" for n in range(6)]
    got = extracted(spark, bodies)
    assert all(got[n] == [f"Title {n}", *[f"Part of {n}"] * (n % 3 + 1)] for n in got)
    got = extracted(spark, bodies[:3] * 2)  # copies of three pages are no six pages
    assert all("Share this story" in t for t in got.values())


def test_template_needs_a_class_with_places_in_one_slot(spark):
    # "Maybe" recurs on most pages, but nothing in the markup comes and goes with it
    got = extracted(spark, [f"<div><p>own {n}</p>{'<p>Maybe</p>' if n % 4 else '<p>other</p>'}</div>" for n in range(12)])
    assert got[1] == ["own 1", "Maybe"]
    # here a list does, always in the same slot
    got = extracted(spark, [f"<div><p>own {n}</p></div>{'<ul><li>Maybe</ul>' if n % 4 else ''}<h2>end</h2>" for n in range(12)])
    assert got[1] == ["own 1"]
    # and here it stands now before, now after the frame's heading
    lists = ["<ul><li>Maybe</ul><h2>end</h2>", "<h2>end</h2><ul><li>Maybe</ul>", "<h2>end</h2>"]
    got = extracted(spark, [f"<div><p>own {n}</p></div>{lists[n % 3]}" for n in range(12)])
    assert got[1] == ["own 1", "Maybe"]


def test_tokens_out_of_order_leave_the_template(spark):
    parts = ["<h2>one</h2>", "<h3>two</h3>", "<h4>three</h4>"]
    got = extracted(spark, [f"<p>own {n}</p><h5>first</h5>{''.join(parts[n % 3 :] + parts[: n % 3])}<h6>last</h6>" for n in range(12)])
    assert got[0][0] == "own 0" and "first" not in got[0] and "last" not in got[0] and len(got[0]) > 1


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<p>Hello <span class="ad">BUY</span> world</p><p>next</p>', ["Hello world", "next"]),
        ('<p>Hello <span hidden>x <b>BUY</b></span>, world <i class="ad">y</i></p>', ["Hello , world"]),
        ('<p>Hello <span class="ad">BUY</p><p>next</p>', ["Hello", "next"]),
        ('<div>Hello <span class="ad">BUY<div>more</div></span>world</div>', ["Hello world"]),
        ('<h2 id="related-work">Related work</h2><section id="search"><p>a</p></section>', ["Related work", "a"]),
        ('<div class="social-history"><p>b</p></div><p class="alert-level">c</p>', ["b", "c"]),
        ('<p>d</p><div class="ad-banner">x</div><div class="relatedPosts">y</div><div class="box comments">z</div><div id="search">s</div>', ["d"]),
        ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds</p>", ["so x = 2 holds"]),
    ],
)
def test_marks_and_inline_elements_of_an_article(body, want):
    assert html_extract.main_text(f"<main><article>{body}</article></main>", frozenset(), frozenset()).split("\n\n") == want


def test_stages_leave_only_their_results(spark):
    from plansift.llm.common import drop_all, saved, settled

    drop_all()
    first = saved(spark.range(10).toDF("n"), "first")
    out = settled(lambda: saved(first.where("n > 2"), "between").where("n > 4"), "out")
    assert out.count() == 5 and first.count() == 10
    from plansift.llm import common

    assert set(common._WRITTEN) == {first._plansift_path, out._plansift_path}
    drop_all()
    assert not common._WRITTEN


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from plansift.llm import mixture, quality_rules, simhash
    from plansift.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, seen = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir), "test")
        seen.append((before, docs))
        assert n == 4 or docs.columns == names
    kept = {r["doc_id"] for r in quality_rules.digest(seen[0][0]).where("kept").collect()}
    assert {r["doc_id"] for r in seen[0][1].collect()} == kept
    assert seen[1][1].count() == len(kept) and seen[1][1].where("n_chars <> length(text)").count() == 0
    assert {r["doc_id"] for r in seen[2][1].collect()} == {r["doc_id"] for r in simhash.keep_one(seen[2][0]).collect()}
    same = {}
    for r in sorted(seen[2][0].collect(), key=lambda r: r["doc_id"]):
        same.setdefault(" ".join((r["text"] or "").encode().lower().decode().split()), r["doc_id"])
    assert {r["doc_id"] for r in seen[2][1].collect()} <= set(same.values())
    words = mixture.mix(seen[3][0]).agg({"taken": "sum"}).first()[0]
    assert sum(len(r["text"].split()) for r in seen[3][1].collect()) == pytest.approx(words, rel=0.01)
    assert seen[4][1].select("doc_id").distinct().count() == seen[3][1].select("doc_id").distinct().count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, seen[4][1].groupBy("doc_id").sum("length").collect()))
