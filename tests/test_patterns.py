"""Inferred tag patterns and abbreviations on hand-made examples."""

from plansift.operators import patterns as op


def inferred(spark, **groups):
    rows = [(g, t) for g, ts in groups.items() for t in ts]
    return {r["g"]: (r["pattern"], r["strength"]) for r in op.tag_patterns(spark.createDataFrame(rows, "g string, tag string"), "g").collect()}


def test_patterns(spark):
    got = inferred(
        spark, doors=["D-101", "D-102", "d-103"], numbers=["01", "02", "03"], letters=["AB1", "CB2", "AB3"], two=["K-1", "K-2", "K-3", "KN-44", "KN-45", "KN-46"], few=["A1", "A2"], same=["A1", "A1", "A1"],
        mixed=["A1", "B-2", "CC3", "DD-44", "5"], mostly=["A1", "A2", "A3", "X-99"], dots=["1.a", "2.a", "3.a"],
    )
    assert got == {
        "doors": (r"^D-\d{3}$", "strong"), "numbers": (r"^\d{2}$", "weak"), "letters": (r"^[AC]B\d$", "strong"), "two": (r"^(?:K-\d|KN-\d{2})$", "strong"), "mostly": (r"^A\d$", "strong"), "dots": (r"^\d\.A$", "strong"),
    }


def test_abbreviations(spark):
    text = "AFF aff. the AFF VAV VAV VAV VAV VAV RTU RTU DOOR DOOR DOOR DOOR DOOR vav".split()
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, idx int, tok string")
    got = op.abbreviations(words, spark.createDataFrame([("Aff", "Above Finished Floor")], "abbreviation string, meaning string")).collect()
    assert {(r["idx"], r["meaning"], r["frequency"], r["confidence"]) for r in got} == {(i, "Above Finished Floor", None, 0.85) for i in (0, 1, 3)} | {(i, None, 5, 0.5) for i in range(4, 9)}
