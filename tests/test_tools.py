"""Tools: schemas, refusals, and what each gives for its arguments."""

import json

import pytest

from plansift.operators import tools


def test_schemas():
    for t in tools.tools().values():
        s = json.loads(json.dumps(t.schema))["input_schema"]
        assert t.description and set(s["required"]) <= set(s["properties"]) and all(p["type"] in ("string", "integer", "number") for p in s["properties"].values())
    assert len(tools.tools()) == 17


@pytest.mark.parametrize(
    ("name", "arguments"),
    [("searchPages", {}), ("searchPages", {"query": "x"}), ("searchPages", {"query": 5}), ("getAnnotations", {"colour": "red"}), ("getAnnotations", {"minConfidence": 2}), ("lookupPagesByIndex", {"index": "date", "key": "x"}), ("getPageDetails", {"pageNumber": "3"}), ("getPageDetails", {"pageNumber": True})],
)
def test_wrong_arguments_are_refused(spark, sf_dir, name, arguments):
    with pytest.raises(ValueError):
        tools.call(spark, sf_dir, name, arguments)


def test_tools_on_the_given_tables(spark, sf_dir):
    ask = lambda tool, /, **arguments: tools.call(spark, sf_dir, tool, arguments).collect()
    with pytest.raises(KeyError):
        ask("dropTables")
    found = ask("searchPages", query="apache license")
    assert found == sorted(found, key=lambda r: (-r["rank"], r["doc_id"])) and all("<mark>" in r["headline"] for r in found)
    text = ask("getPageOcrText", pageNumber=5)[0]["text"]
    whole = ask("getOcrTextInRegion", pageNumber=5, minX=0, minY=0, maxX=1, maxY=1)[0]
    assert whole["text"].split() == text.split() and whole["words"] == len(text.split())
    part = ask("getOcrTextInRegion", pageNumber=5, minX=0, minY=0, maxX=0.5, maxY=1)[0]
    assert 0 < part["words"] < whole["words"]
    some = ask("getAnnotations", pageNumber=5, minConfidence=0.5)
    assert some and {r["doc_id"] for r in some} == {5} and min(r["conf"] for r in some) >= 0.5
    assert {r["kind"] for r in ask("getProjectOverview")} >= {"pages", "class"}
    details = ask("getPageDetails", pageNumber=5)[0]
    assert sum(details["classes"].values()) == len(ask("getAnnotations", pageNumber=5, minConfidence=0.0))
    assert 5 in {r["doc_id"] for r in ask("lookupPagesByIndex", index="class", key=some[0]["name"])} and ask("lookupPagesByIndex", index="keynote", key="K-01")
    assert all(r["from_doc"] == 5 for r in ask("getCrossReferences", pageNumber=5)) and ask("getSpatialContext", pageNumber=5)
    code = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    assert ask("detectCsiFromText", text="see " + " ".join(code.lower().split()) + " there")
    assert {r["note"] for r in ask("batchAddNotes", note="checked", pageNumber=5)} == {"checked"}
    assert ask("createMarkup", pageNumber=5, minX=0.1, minY=0.1, maxX=0.2, maxY=0.2, name="here")[0]["source"] == "user"
    with pytest.raises(ValueError):
        ask("createMarkup", pageNumber=5, minX=0.3, minY=0.1, maxX=0.2, maxY=0.2, name="here")
