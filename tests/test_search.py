"""The stored index: stems in three forms, what a query reads, ranks and headlines against plain loops."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from plansift.functions import stems
from plansift.operators import search

#: Examples of the algorithm's own description.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "formaliti": "formal", "electrical": "electr", "goodness": "good", "allowance": "allow",
    "gyroscopic": "gyroscop", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_stems_are_the_algorithms():
    assert {w: stems.stem(w) for w in STEMS} == STEMS
    assert [stems.stem(w) for w in ("The", "--", "D-101", "a")] == ["", "", "d101", ""]


def test_stems_agree_in_all_forms(spark, sf_dir):
    words = [r["w"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("w")).distinct().limit(4000).collect()] + [*STEMS, "", "Doors,"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stems.stems(F.col("w")).alias("s")).first()["s"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT ? AS w", [words])
    assert got == [stems.stem(w) for w in words] == con.execute(f"SELECT {stems.stems_sql('w')} FROM t").fetchone()[0]


def _bytes_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name.startswith("Scan"):
            total += node.metrics().apply("filesSize").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_query_reads_the_folders_of_its_terms(spark, sf_dir):
    larger = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    index = search.stored_index(spark, larger)
    whole = _bytes_read(index)
    got = _bytes_read(search.matches(index, search.ALL))
    assert 0 < got < 0.05 * whole
    assert _bytes_read(search.matches(index, search.parsed("the of"))) == 0 and search.matches(index, search.parsed("the of")).count() == 0


def test_the_index_is_made_once_for_a_state_of_the_table(spark, tmp_path):
    docs = lambda text: spark.createDataFrame([(1, text, "p")], "doc_id long, text string, source string").coalesce(1)
    docs("steel doors").write.parquet(str(tmp_path / "documents.parquet"))
    first = search.stored_index(spark, str(tmp_path))
    assert first.inputFiles() == search.stored_index(spark, str(tmp_path)).inputFiles()
    docs("wooden doors").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert {r["term"] for r in search.stored_index(spark, str(tmp_path)).collect()} == {"wooden", "door"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    texts = {
        1: "Door schedule: doors and frames. The door schedule lists each door.", 2: "Frames of the door are scheduled elsewhere " + "filler " * 150 + "schedule", 3: "schedule door", 4: None, 5: "", 6: "no hit here",
        7: "door " * 40 + "gap " * 30 + "schedules " * 3,
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("project_id", F.lit("p"))
    path = str(tmp_path_factory.mktemp("index") / "i")
    search.write_index(rows, path)
    return texts, rows, spark.read.parquet(path)


def stemmed(text):
    return [stems.stem(w) for w in re.split(r"\s+", text or "") if w]


def test_matches_phrases_and_ranks(small):
    texts, _, index = small
    q = search.parsed("schedule doors")
    want = {i for i, t in texts.items() if {"door", "schedul"} <= set(stemmed(t))}
    assert {r["doc_id"] for r in search.matches(index, q).collect()} == want == {1, 2, 3, 7}
    phrase = search.parsed('"Door schedules"')
    assert {r["doc_id"]: r["starts"] for r in search.matches(index, phrase).select("doc_id", "starts").collect()} == {1: [0, 6]}
    gap = search.parsed('"frames of the doors"')
    assert {r["doc_id"] for r in search.matches(index, gap).collect()} == {2}
    for r in search.ranked(search.matches(index, q), q).collect():
        s = stemmed(texts[r["doc_id"]])
        left = 1.0
        for i, a in enumerate(s):
            for j, b in enumerate(s):
                if a == "door" and b == "schedul" and abs(i - j) <= 100:
                    left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(i - j) / 1.5 - 2)))
        assert abs(r["rank"] - (1 - left)) < 2e-6


def test_headlines_have_ten_to_twenty_words(small):
    texts, rows, index = small
    q = search.parsed("schedule doors")
    got = {r["doc_id"]: r["headline"] for r in search.headlines(search.matches(index, q), rows, q).collect()}
    for i, h in got.items():
        words = re.split(r"\s+", texts[i].strip())
        shown = h.replace("<mark>", "").replace("</mark>", "").split(" ")
        at = next(k for k in range(len(words)) if words[k : k + len(shown)] == shown)
        assert min(10, len(words)) <= len(shown) <= 20
        s = stemmed(texts[i])
        hits = lambda k: sum(x in q.stems for x in s[k : k + 20])  # noqa: B023, E731
        starts = [k for k in range(len(s)) if s[k] in q.stems]
        best = max(starts, key=lambda k: (hits(k), -k))
        assert at == best or len(words) - best < 10
        assert [w.startswith("<mark>") for w in h.split(" ")] == [x in q.stems for x in s[at : at + len(shown)]]
    assert got[3] == "<mark>schedule</mark> <mark>door</mark>"
    short = search.headlines(search.matches(index, q), rows, q, 30, 5, "**", "**").where("doc_id = 1").first()["headline"]
    assert short.startswith("**Door** **schedule:** **doors** and")


def test_highlights(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("INSTALL the Doorway frame, install to D-1 door frame".split())], "doc_id long, idx int, tok string")
    ids = lambda q: sorted(r["idx"] for r in search.word_hits(words, search.parsed(q)).collect())
    assert ids("installed door") == [0, 2, 4, 7] and ids('"door frames"') == [2, 3, 7, 8] and ids("to") == [5] and ids('"to door"') == []


def test_index_stems_each_different_word_once(spark, tmp_path, monkeypatch):
    """Words are stemmed by portion, not one by one in the plan; positions, texts in several rows and nulls keep their meaning."""
    from plansift.operators import search as op

    monkeypatch.setattr(op, "stems", lambda *_: pytest.fail("each word is stemmed"))
    monkeypatch.setattr(op, "PORTION", 3)
    rows = [(1, "p", "The licenses of Licensing are running \u212aeys"), (1, "p", "runs again license"), (2, None, "license the"), (3, "q", None), (4, "q", "the of -- ")]
    op.write_index(spark.createDataFrame(rows, "doc_id long, project_id string, text string"), str(tmp_path / "i"))
    got = {(r.term, r.doc_id, r.project_id): r.positions for r in spark.read.parquet(str(tmp_path / "i")).collect()}
    assert got == {("licens", 1, "p"): [1, 2, 3], ("run", 1, "p"): [0, 5], ("kei", 1, "p"): [6], ("licens", 2, None): [0]}
