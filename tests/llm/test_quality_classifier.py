"""The rule ensemble: held-out accuracy, what it may learn from, and its parts against plain forms."""

import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from plansift.llm import quality_classifier as op


def test_held_out_accuracy(spark, sf_dir):
    larger = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    out = op.scored(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    bad, good = [s for s, q in held if q == 0], [s for s, q in held if q == 1]
    assert bad and good and np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.95


def texts(n=600):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        words = rng.choice(["the", "of", "stone", "river", "and", "walked", "home"], int(rng.integers(5, 60)))
        bad = bool(rng.random() < 0.4)
        rows.append((i, " ".join(w + ("###" if bad and rng.random() < 0.5 else "") for w in words), int(not bad)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")


def test_learns_only_from_rows_that_are_not_held_out(spark):
    rows = texts()
    docs, labels = frame(spark, rows)
    want = {r["doc_id"]: r["score"] for r in op.scored(docs, labels).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    extra = docs.select("*", F.lit("x").alias("lang"), F.lit(1).alias("quality"), F.lit(2.0).alias("words"), F.lit("y").alias("y"))
    assert {r["doc_id"]: r["score"] for r in op.scored(extra, other).collect()} == want
    right = [(want[i] >= 0.3) == q for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.95


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    docs, labels = frame(spark, texts())
    a = op.learn(op.statistics(docs), labels, sample=150)
    b = op.learn(op.statistics(docs.repartition(7)), labels.repartition(3), sample=150)
    assert a == b and a.rules


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 1), (3, 0), (None, 1), (6, 1), (6, 1), (99, 0)], "doc_id long, quality int")
    out = op.scored(odd, labels)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert op.scored(odd.limit(0), labels).collect() == []
    assert {r["score"] for r in op.scored(odd, labels.limit(0)).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1) for i in range(14)], "doc_id long, quality int")
    assert len({r["score"] for r in op.scored(odd, one_kind).collect()}) == 1


def test_column_equals_rules_in_numpy(spark):
    rows = texts(400)
    docs, labels = frame(spark, rows)
    stats = op.statistics(docs)
    model = op.learn(stats, labels)
    names = list(op.STATISTICS)
    got = stats.select("*", model.score().alias("score")).toPandas()
    x = got[names].to_numpy()
    z = np.full(len(x), model.constant)
    for rule, w in zip(model.rules, model.weights, strict=True):
        z += w * np.all([(x[:, names.index(f)] > t) == g for f, g, t in rule], axis=0)
    assert np.abs(1 / (1 + np.exp(-z)) - got["score"]).max() < 1e-12


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    r = (rng.random((500, 12)) < 0.4).astype(np.float32)
    y = (rng.random(500) < 1 / (1 + np.exp(-(3 * r[:, 0] - 2 * r[:, 1] - 0.5)))).astype(float)
    w = op.lasso(r, y, 0.01, np.zeros(13), rounds=5000)
    off = r.T @ (1 / (1 + np.exp(-(r @ w[:-1] + w[-1]))) - y) / len(y)
    for g, v in zip(off, w[:-1], strict=True):
        assert abs(g + 0.01 * np.sign(v)) < 2e-3 if v else abs(g) <= 0.012
    assert (w[:-1] == 0).sum() >= 4 and w[0] > 0 > w[1]


def test_paths_are_conjunctions_of_real_conditions():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    rules = op.paths(x, y, trees=5)
    assert len(set(rules)) == len(rules) and all(1 <= len(r) <= op.DEPTH * 2 for r in rules)
    assert any({(f, g) for f, g, _ in r} == {(0, True), (2, False)} and all(abs(t - (0.5 if f == 0 else 0.3)) < 0.06 for f, _, t in r) for r in rules)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word stone\n" * 300_000), (2, None)], "doc_id long, text string")
    s = {r["id"]: r for r in op.statistics(docs).collect()}
    assert s[1]["words"] == 600_000 and s[1]["top_word"] == 0.5 and s[2]["words"] == 0
