"""Tunable thresholds, budget presets and the tools by which a client asks for queries, as plain data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.plans import views
from plansift.plans.registry import queries, register
from plansift.plans.views import oracle
from plansift.sources.deltas import patched, signed, totals


@dataclass(frozen=True)
class Thresholds:
    """What a project may set for itself; the defaults are those of the queries."""

    region_probability: float = 0.5
    heat_density: float = 0.35
    proposal_probability: float = 0.65
    proposals_per_page: int = 10
    overlap_iou: float = 0.3

    def changed(self, **values: float) -> Thresholds:
        """A copy with other values; unknown names and values outside 0 to 1 (shares) are refused."""
        known = {f.name: f.type for f in fields(self)}
        for name, v in values.items():
            if name not in known:
                raise KeyError(name)
            if known[name] == "float" and not 0 <= v <= 1:
                raise ValueError(f"{name} lies between 0 and 1")
        return replace(self, **values)


#: Shares of a context budget by section.
PRESETS = {"balanced": {"text": 0.5, "regions": 0.3, "codes": 0.2}, "structured": {"text": 0.2, "regions": 0.5, "codes": 0.3}, "verbose": {"text": 0.8, "regions": 0.1, "codes": 0.1}}


@register("v06_budget_presets", oracle("v_page", "SELECT page_number, p.preset, floor(len(raw_text) * p.share + 1e-9)::BIGINT AS budget FROM v_page, (VALUES " + ", ".join(f"('{k}', {v['text']}e0)" for k, v in PRESETS.items()) + ") p(preset, share)"))
def v06(spark, sf_dir):
    """Characters of text that each preset gives a page."""
    shares = F.array(*(F.struct(F.lit(k).alias("preset"), F.lit(v["text"]).alias("share")) for k, v in PRESETS.items()))
    p = views.page(spark, sf_dir).select("page_number", F.char_length("raw_text").alias("n"), F.inline(shares))
    return p.select("page_number", "preset", F.floor(F.col("n") * F.col("share") + F.lit(1e-9)).alias("budget"))


@register("v04_tuned_regions", oracle("v_detection", "SELECT name, count(*) FILTER (conf >= 5e-1) AS by_default, count(*) FILTER (conf >= 8e-1) AS tuned FROM v_detection GROUP BY name"))
def v04(spark, sf_dir):
    """Regions by class at the default threshold and at a project's own."""
    base, own = Thresholds(), Thresholds().changed(region_probability=0.8)
    at = lambda t: F.count_if(F.col("conf") >= t.region_probability)
    return views.detection(spark, sf_dir).groupBy("name").agg(at(base).alias("by_default"), at(own).alias("tuned"))


@register("o06_sure_regions", oracle("v_detection", """
SELECT doc_id, det_id, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, det_id, name)::INT AS place, conf >= 5e-1 AS sure FROM v_detection"""))
def o06(spark, sf_dir):
    """All regions of a page in order of their score, and which of them pass the threshold."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("conf"), "det_id", "name"))
    return views.detection(spark, sf_dir).select("doc_id", "det_id", place.alias("place"), (F.col("conf") >= Thresholds().region_probability).alias("sure"))


def tools() -> dict[str, dict]:
    """Every query as a tool: its description and the names of its arguments, as JSON schema."""
    return {name: {"description": (f.__doc__ or name).strip().splitlines()[0], "parameters": {"type": "object", "properties": {"sf_dir": {"type": "string"}}, "required": ["sf_dir"]}} for name, f in queries().items()}


def call(spark: SparkSession, name: str, arguments: dict[str, str], limit: int = 50) -> DataFrame:
    """The tool's rows, ``limit`` at most (a page of an answer; the cap is the feature); unknown tools and arguments are refused."""
    known: dict[str, Callable] = queries()
    if name not in known:
        raise KeyError(f"no tool {name}")
    if set(arguments) != {"sf_dir"}:
        raise ValueError("tools take sf_dir")
    return known[name](spark, arguments["sf_dir"]).limit(limit)


def done_pages(pages: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Pages that a run before has not done yet."""
    return pages.join(done.select(*keys).distinct(), list(keys), "left_anti")


@register("z09_pages_to_do", oracle("v_page v_detection", "SELECT p.page_number FROM v_page p WHERE NOT EXISTS (SELECT 1 FROM v_detection d WHERE d.doc_id = p.page_number AND d.name = 'tables' AND d.conf >= 9e-1)"))
def z09(spark, sf_dir):
    """Pages without a sure table, which a run has still to do."""
    done = views.detection(spark, sf_dir).where("name = 'tables' AND conf >= 9e-1").select(F.col("doc_id").alias("page_number"))
    return done_pages(views.page(spark, sf_dir).select("page_number"), done, "page_number")


_EDITED = """was AS (SELECT doc_id, det_id, name, conf FROM v_detection),
now AS (SELECT doc_id, det_id, CASE WHEN name = 'grid' AND conf < 5e-1 THEN 'tables' ELSE name END AS name, conf FROM was WHERE conf < 9e-1
        UNION ALL SELECT doc_id + 1, det_id || '+', name, conf FROM was WHERE conf >= 9e-1 AND name = 'drawings')"""


@register("z08_patched_summary", oracle("v_detection", f"WITH {_EDITED} SELECT doc_id, name, count(*) AS rows, sum(round(conf * 1000)::BIGINT)::BIGINT AS milli FROM now GROUP BY ALL"))
def z08(spark, sf_dir):
    """Boxes by page and class after edits (sure ones go or move a page on, unsure grids become tables): the summary from
    before takes one row less and one more for each change; nothing is counted anew."""
    was = views.detection(spark, sf_dir).select("doc_id", "det_id", "name", "conf")
    sure = F.col("conf") >= 9e-1
    name = F.when((F.col("name") == "grid") & (F.col("conf") < 5e-1), "tables").otherwise(F.col("name"))
    old = F.struct("doc_id", "name", "conf")
    edits = was.select(old.alias("old"), F.when(~sure, F.struct("doc_id", name.alias("name"), "conf")).alias("new"))
    added = was.where(sure & (F.col("name") == "drawings")).select(F.lit(None).cast(edits.schema["old"].dataType).alias("old"), F.struct((F.col("doc_id") + 1).alias("doc_id"), "name", "conf").alias("new"))
    milli = {"milli": F.round(F.col("conf") * 1000).cast("long")}
    before = totals(was.withColumn("sign", F.lit(1).cast("long")), ["doc_id", "name"], milli)
    return patched(before, totals(signed(edits.union(added)), ["doc_id", "name"], milli), ["doc_id", "name"])


@register("r18_codes_on_write", oracle("v_taxonomy v_schedule", """
WITH n AS (SELECT p_partkey, ' ' || lower(p_type) || ' ' || (SELECT description FROM v_taxonomy ORDER BY code LIMIT 1) || ' ' AS note FROM v_schedule WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, ' ' || lower(p_type) || ' ' FROM v_schedule WHERE p_size % 7 <> 0)
SELECT p_partkey, code FROM n JOIN v_taxonomy t ON contains(note, ' ' || t.description || ' ') WHERE len(note) >= 12"""))
def r18(spark, sf_dir):
    """Codes of a note when it is written: whole descriptions in texts of ten characters or more."""
    from plansift.operators.taxonomy import phrase_hits

    codes = views.taxonomy(spark, sf_dir)
    first = F.broadcast(codes.orderBy("code").limit(1).select(F.col("description").alias("d")))  # one row
    s = views.schedule(spark, sf_dir).crossJoin(first)
    text = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit(" "), "d")).otherwise(""))
    notes = s.select(F.col("p_partkey").alias("doc_id"), text.alias("note")).where(F.length("note") >= 10)
    words = notes.select("doc_id", F.posexplode(F.split("note", " ")).alias("idx", "tok"))
    return phrase_hits(words, codes).select(F.col("doc_id").alias("p_partkey"), "code").distinct()
