"""Readers and writers: round trips through files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plansift.plans import views
from plansift.sources import deltas, readers, writers


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\td\te\tf\n1\told\t08 11 16\tAluminum Doors\tArchitectural\t08\nshort\trow\n2\told\t23 05 00\tHVAC work\tMechanical\t23\n")
    got = {tuple(r) for r in readers.taxonomy_tsv(spark, str(tmp_path / "t.tsv")).collect()}
    assert got == {("08 11 16", "Aluminum Doors", "Architectural", "08"), ("23 05 00", "HVAC work", "Mechanical", "23")}
    (tmp_path / "u.csv").write_text("code,description,trade,division\n26 05 00,Wires,,\n99 00 00,Odd,,\n,none,,\n26 05 00,Wires,,\n")
    assert {tuple(r) for r in readers.taxonomy_upload(spark, str(tmp_path / "u.csv")).collect()} == {("26 05 00", "Wires", "Electrical", "26"), ("99 00 00", "Odd", None, "99")}
    (tmp_path / "u.json").write_text('{"code": "03 30 00", "description": "Concrete"}\n')
    assert [tuple(r) for r in readers.taxonomy_upload(spark, str(tmp_path / "u.json")).collect()] == [("03 30 00", "Concrete", "Structural", "03")]
    with pytest.raises(ValueError):
        readers.taxonomy_upload(spark, "x.pdf")


def test_ocr_blocks(spark, tmp_path):
    box = {"BoundingBox": {"Left": 0.1, "Top": 0.2, "Width": 0.3, "Height": 0.4}}
    word = lambda i, t: {"Id": i, "BlockType": "WORD", "Text": t, "Confidence": 99.0, "Geometry": box}
    of = lambda i, kind, ids, **more: {"Id": i, "BlockType": kind, "Geometry": box, "Relationships": [{"Type": "CHILD", "Ids": ids}], **more}
    blocks = [word("w1", "GENERAL"), word("w2", "NOTES"), of("l1", "LINE", ["w2", "w1"]), of("c1", "CELL", ["w1"], RowIndex=1, ColumnIndex=2), of("c2", "CELL", [], RowIndex=1, ColumnIndex=3)]
    (tmp_path / "page_7.json").write_text(json.dumps({"Blocks": blocks}))
    words, lines, cells = readers.ocr_blocks(spark, str(tmp_path / "*.json"))
    assert {(r["page"], r["text"], r["w"]) for r in words.collect()} == {(7, "GENERAL", 0.3), (7, "NOTES", 0.3)}
    assert [r["text"] for r in lines.collect()] == ["NOTES GENERAL"]
    assert {(r["row"], r["col"], r["text"]) for r in cells.collect()} == {(1, 2, "GENERAL"), (1, 3, "")}


def test_detection_folder(spark, tmp_path):
    one = {"name": "door", "confidence": 0.9, "bbox": [10.0, 20.0, 30.0, 40.0]}
    (tmp_path / "page_3.json").write_text(json.dumps({"detections": [one, one | {"bbox_normalized": [0.1, 0.2, 0.3, 0.4]}]}))
    (tmp_path / "page_4_b.json").write_text(json.dumps({"detections": []}))
    (tmp_path / "_manifest.json").write_text(json.dumps({"detections": [one]}))
    (tmp_path / "run_manifest.json").write_text(json.dumps({"detections": [one]}))
    classes = spark.createDataFrame([("door", ["08"])], "name string, codes array<string>")
    got = readers.detections(spark, str(tmp_path), classes).collect()
    assert {(r["page"], r["minx"], tuple(r["codes"])) for r in got} == {(3, 10.0, ("08",)), (3, 0.1, ("08",))}


def test_replacing_partitions_and_upserts(spark, tmp_path):
    path = str(tmp_path / "pages")
    page = views.read(spark, "/root/testdata/sf0.001", "documents", "doc_id", "source", "n_chars").withColumn("seq", F.lit(1))
    writers.replace_partitions(page, path, "source")
    n = page.count()
    writers.replace_partitions(page.where("source = 'src1'").limit(1).withColumn("seq", F.lit(2)), path, "source")
    now = spark.read.parquet(path)
    assert now.where("source = 'src1'").count() == 1 and now.count() == n - page.where("source = 'src1'").count() + 1
    before = now.count()
    new = page.where("source IN ('src2', 'src3')").withColumns({"seq": F.lit(3), "n_chars": F.lit(0).cast("long")})
    more = new.limit(2).withColumns({"doc_id": F.col("doc_id") + 100_000, "seq": F.lit(4)})
    for _ in range(2):  # once more changes nothing
        writers.upsert(new.unionByName(more), path, "source", ["source", "doc_id"], "seq")
        spark.catalog.refreshByPath(path)
        got = spark.read.parquet(path)
        assert got.where("source IN ('src2', 'src3')").where("n_chars <> 0").count() == 0
        assert got.count() == before + 2 and got.groupBy("source", "doc_id").count().where("count > 1").count() == 0
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]


def test_upserts_of_null_partitions_and_moved_keys(spark, tmp_path):
    schema = "part string, page long, seq int, v string"
    path = str(tmp_path / "t")
    put = lambda *rows: writers.upsert(spark.createDataFrame(list(rows), schema), path, "part", ["page"], "seq")

    def now():
        spark.catalog.refreshByPath(path)
        return {(r["part"], r["page"], r["seq"], r["v"]) for r in spark.read.schema(schema).parquet(path).collect()}

    put((None, 1, 1, "a"), ("x", 3, 1, "c"), ("7", None, 1, "n"))
    put((None, 2, 1, "b"))
    assert now() == {(None, 1, 1, "a"), (None, 2, 1, "b"), ("x", 3, 1, "c"), ("7", None, 1, "n")}
    put(("y/1 z", 3, 2, "moved"), (None, None, 2, "null key"))  # x and 7 are left empty
    assert now() == {(None, 1, 1, "a"), (None, 2, 1, "b"), ("y/1 z", 3, 2, "moved"), (None, None, 2, "null key")}
    put(("z", 1, 0, "older"))  # stays where it is
    put((None, 2, 1, "tie, new"), (None, 2, 1, "tie, other"), ("y/1 z", 3, None, "no time"))
    assert now() == {(None, 1, 1, "a"), (None, 2, 1, "tie, other"), ("y/1 z", 3, 2, "moved"), (None, None, 2, "null key")}


def test_batches_that_come_again(spark, tmp_path):
    path = str(tmp_path / "t")
    write = writers.ingest(path, "part", ["page"], "seq")
    batch = lambda *rows: spark.createDataFrame(list(rows), "part string, page long, seq int, v string")
    first, second = batch(("p", 1, 1, "one"), ("p", 2, 1, "two")), batch(("q", 1, 1, "three"))
    for b, n in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(b, n)
        spark.catalog.refreshByPath(path)
    assert {(r["part"], r["page"], r["v"], r["_batch"]) for r in spark.read.parquet(path).collect()} == {("q", 1, "three", 1), ("p", 2, "two", 0)}


def test_random_batches_patch_summaries(spark, tmp_path):
    """After ten batches, some of them written again and some folded, the store equals a summary of all rows."""
    rng = random.Random(4)
    state, groups, milli = {}, ["g"], {"total": F.col("v").cast("long")}
    store = deltas.SummaryStore(spark, str(tmp_path / "s"), groups)
    row = "struct<g:string,v:int>"
    empty = spark.createDataFrame([], f"old {row}, new {row}")
    store.start(deltas.totals(deltas.signed(empty), groups, milli))
    written = []
    for batch in range(1, 11):
        changes = {}
        for k in rng.sample(range(30), 8):
            new = None if rng.random() < 0.3 else (rng.choice(["a", "b", None, "c"]), rng.choice([0, 5, -7, None]))
            changes[k] = (state.get(k), new)
        for k, (_, new) in changes.items():
            state.pop(k, None)
            if new is not None:
                state[k] = new
        change = deltas.totals(deltas.signed(spark.createDataFrame(list(changes.values()), f"old {row}, new {row}")), groups, {"total": F.coalesce(F.col("v"), F.lit(0)).cast("long")})
        store.apply(change, batch)
        written.append((change, batch))
        again = rng.choice(written)
        store.apply(*again)
        if batch in (4, 7):
            store.compact(batch - 1)
        want = {}
        for g, v in state.values():
            n, t = want.get(g, (0, 0))
            want[g] = (n + 1, t + (v or 0))
        spark.catalog.clearCache()
        assert {r["g"]: (r["rows"], r["total"]) for r in store.read().collect()} == want
    with pytest.raises(TypeError):
        deltas.totals(deltas.signed(empty), groups, {"x": F.col("v") / 2})


def test_ingest_and_log_streams(spark, sf_dir, tmp_path):
    v = views.visit(spark, sf_dir).select("ip", "ts", "status")
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(writers.ingest(str(tmp_path / "last"), "status", ["ip", "status"], "ts")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    want = {(r[0], r[1], r[2]) for r in v.groupBy("ip", "status").agg(F.max("ts")).collect()}
    assert {(r["ip"], r["status"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "last")).collect()} == want
    q = writers.append_log(stream.where("status = 404"), str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "log")).count() == v.where("status = 404").count()


def test_json_updates_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"id":"a","x":"1"}'), (2, '{"id":"b"}'), (3, None)], "n int, data string")
    got = {r["n"]: r["d"] and json.loads(r["d"]) for r in df.select("n", writers.updated_json(F.col("data"), "id", "a", {"x": "2", "y": "3"}).alias("d")).collect()}
    assert got == {1: {"id": "a", "x": "2", "y": "3"}, 2: {"id": "b"}, 3: None}
    writers.write_lines(df, str(tmp_path / "t"), [F.desc("n")], F.concat(F.lit("row "), F.col("n").cast("string")))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).orderBy(F.desc("value")).collect()] == ["row 3", "row 2", "row 1"]
