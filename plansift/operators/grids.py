"""Grids of one table as several methods read them, merged: base, shape guard, alignment of rows, agreement.

Cells are rows of ``grid, method, confidence, row, col, header, value``.  The choice of the base, the guard and the
comparison of cells are aggregates and joins over all grids; what pairs rows of two grids is a dynamic program over one
pair, which is bounded by the surveyed limits of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.plans.registry import register
from plansift.plans.views import read

#: Limits of a grid, forms and headers of tags, what a whole tag column adds, what one column costs.
MAX_ROWS, MAX_COLS = 10_000, 500
TAG, TAG_HEADERS = r"(?i)^[A-Z]{0,3}-?[0-9]{1,4}[A-Z]?$", ("TAG", "MARK", "NO", "NO.", "NUMBER", "NUM", "ITEM", "ID", "KEY")
COMPLETE, BONUS, SINGLE = 0.9, 0.25, 0.3
#: Shapes that may be merged, likeness of rows, edits that still agree, and the parts of the confidence.
COLUMNS, ROWS, ALIKE, EDITS = (0.5, 3.0), (0.5, 1.5), 0.25, 2
BASE_SHARE, RATE_SHARE, METHOD, METHODS, MOST, ONLY_BASE = 0.6, 0.3, 0.02, 0.15, 0.98, 0.5


def methods(cells: DataFrame) -> DataFrame:
    """``grid, method, confidence, n_rows, n_cols, score, base`` of the grids that are neither empty nor too large."""
    tag = F.when((F.col("col") == 0) & F.trim("value").rlike(TAG), 1).otherwise(0)
    g = cells.groupBy("grid", "method").agg(F.max("confidence").alias("confidence"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.sum(tag).alias("tags"))
    g = g.where((F.col("n_rows") <= MAX_ROWS) & (F.col("n_cols") <= MAX_COLS))
    sure = F.when(F.col("n_cols") <= 1, F.col("confidence") * SINGLE).otherwise(F.col("confidence"))
    whole = F.when(F.col("tags") >= F.col("n_rows") * COMPLETE, BONUS).otherwise(0.0)
    g = g.withColumn("confidence", F.round(sure, 9)).withColumn("score", F.round(F.col("confidence") + whole, 9))
    place = F.row_number().over(W.partitionBy("grid").orderBy(F.desc("score"), "method"))
    return g.withColumn("place", place).drop("tags")


def aligned_rows(base: np.ndarray, other: np.ndarray, least: float = ALIKE) -> tuple[list[tuple[int, int]], float]:
    """Pairs of rows in order with the most likeness together, and their mean over the shorter grid.

    Arrays hold cells as numbers, 0 for empty ones; likeness is the share of the base's columns whose cells are equal and
    not empty, and rows under ``least`` are never paired.
    """
    n, m = len(base), len(other)
    best = np.zeros(m + 1)
    diagonal, left = np.zeros((n, m), bool), np.zeros((n, m), bool)
    for i in range(n):
        like = ((other == base[i]) & (base[i] != 0)).mean(axis=1) if base.shape[1] else np.zeros(m)
        taken = best[:-1] + np.where(like >= least, like, -np.inf)
        diagonal[i] = taken > best[1:]
        row = np.maximum(taken, best[1:])
        run = np.maximum.accumulate(row) if m else row
        left[i, 1:] = run[1:] > row[1:]
        best = np.r_[0.0, run]
    pairs, i, j = [], n - 1, m - 1
    while i >= 0 and j >= 0:
        if left[i, j]:
            j -= 1
        elif diagonal[i, j]:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        else:
            i -= 1
    return pairs[::-1], float(best[-1]) / max(min(n, m), 1)


#: Grids that a task holds as Python objects at once.
AT_ONCE = 32


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch stays in Arrow's form; its grids become Python objects a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            out = []
            for r in part.to_pylist():
                names: dict[str, int] = {"": 0}
                number = lambda v: names.setdefault((v or "").strip().upper(), len(names))  # noqa: B023, E731
                grid = lambda n_rows, cells: _filled(n_rows, r["width"], cells, number)  # noqa: B023, E731
                pairs, mean = aligned_rows(grid(r["base_rows"], r["base"]), grid(r["n_rows"], r["cells"]))
                if mean >= ALIKE:
                    out += [(r["grid"], r["method"], i, j) for i, j in pairs]
            if out:
                kinds = (batch.schema.field("grid").type, pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["grid", "method", "row", "other_row"])


def _filled(n_rows: int, width: int, cells, number) -> np.ndarray:
    out = np.zeros((n_rows, width), np.int64)
    for c in cells:
        out[c["row"], c["at"]] = number(c["value"])
    return out


def merged(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged cells (``grid, row, col, header, value, verdict``) and, for each grid, its base method, the methods that
    were merged, the rate of agreement, the confidence and the tag column.

    Cells are matched by header, else by place.  A verdict is ``agree`` (all other values equal or within two edits),
    ``disagree``, ``filled`` (empty in the base), ``base`` (only the base has one, half an agreement) or ``empty``.
    """
    m = methods(cells)
    base = m.where("place = 1").select("grid", F.col("method").alias("base"), F.col("n_rows").alias("base_rows"), F.col("n_cols").alias("width"), F.col("confidence").alias("base_confidence"))
    others = m.where("place > 1").join(base, "grid")
    wide, tall = F.col("n_cols") / F.col("width"), F.col("n_rows") / F.col("base_rows")
    fit = others.where(wide.between(*COLUMNS) & tall.between(*ROWS))
    mine = cells.join(base, "grid").where(F.col("method") == F.col("base")).select("grid", "row", "col", "header", "value")
    heads = mine.groupBy("grid", "header").agg(F.min("col").alias("by_name"))
    theirs = cells.join(fit.select("grid", "method", "score", "n_rows", "base_rows", "width"), ["grid", "method"]).join(heads, ["grid", "header"], "left")
    # a column goes to the base's column of the same header; only without one to that of the same place
    theirs = theirs.withColumn("at", F.coalesce("by_name", F.when(F.col("col") < F.col("width"), F.col("col")))).where("at IS NOT NULL")
    first = W.partitionBy("grid", "method", "row", "at").orderBy(F.col("by_name").isNull(), "col")
    theirs = theirs.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("grid", "method", "score", "n_rows", "base_rows", "width", "row", "at", F.trim("value").alias("value"))
    pack = lambda df, name, at, *by: df.groupBy(*by).agg(F.collect_list(F.struct("row", F.col(at).alias("at"), "value")).alias(name))  # noqa: E731  # one grid's cells
    pairs = pack(theirs, "cells", "at", "grid", "method", "n_rows", "base_rows", "width").join(pack(mine, "base", "col", "grid"), "grid")
    rows = pairs.mapInArrow(_aligned, f"grid {cells.schema['grid'].dataType.simpleString()}, method string, row int, other_row int")
    seen = theirs.withColumnRenamed("row", "other_row").join(rows, ["grid", "method", "other_row"]).where("value <> ''")
    told = seen.groupBy("grid", "row", F.col("at").alias("col")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("loss"), "method", "value"))).alias("told"))
    both = mine.withColumn("value", F.trim("value")).join(told, ["grid", "row", "col"], "left")
    agrees = F.forall("told", lambda t: (t["value"] == F.col("value")) | (F.levenshtein(t["value"], F.col("value")) <= EDITS))
    verdict = F.when(F.col("value") == "", F.when(F.col("told").isNull(), "empty").otherwise("filled")).when(F.col("told").isNull(), "base").when(agrees, "agree").otherwise("disagree")
    out = both.select("grid", "row", "col", "header", F.when((F.col("value") == "") & F.col("told").isNotNull(), F.get("told", F.lit(0))["value"]).otherwise(F.col("value")).alias("value"), verdict.alias("verdict"))
    count = F.sum(F.when(F.col("verdict") == "agree", 1.0).when(F.col("verdict") == "base", ONLY_BASE).otherwise(0.0)) / F.count("*")
    rates = out.groupBy("grid").agg(F.round(count, 9).alias("rate"))
    n = m.groupBy("grid").agg(F.count("*").alias("n"))
    used = rows.groupBy("grid").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("merged"))  # a few methods
    sure = F.least(F.col("base_confidence") * BASE_SHARE + F.col("rate") * RATE_SHARE + F.least(F.col("n") * METHOD, F.lit(METHODS)), F.lit(MOST))
    whole = base.join(rates, "grid").join(n, "grid").join(used, "grid", "left").join(tag_columns(out), "grid", "left")
    return out, whole.select("grid", "base", F.coalesce("merged", F.lit("")).alias("merged"), "rate", F.round(sure, 6).alias("confidence"), "tag_column")


def tag_columns(cells: DataFrame) -> DataFrame:
    """``grid, tag_column``: the first column headed as tags, else the one with the greatest share of tags, half or more."""
    v = F.trim("value")
    c = cells.groupBy("grid", "col", "header").agg(F.count_if(v != "").alias("n"), F.count_if(v.rlike(TAG)).alias("tags"))
    named = F.upper(F.trim("header")).isin(*TAG_HEADERS)
    share = F.round(F.col("tags") / F.greatest(F.col("n"), F.lit(1)), 9)
    return c.where(named | (share >= 0.5)).groupBy("grid").agg(F.min_by("header", F.struct((~named).alias("a"), F.when(named, 0.0).otherwise(-share).alias("b"), "col")).alias("tag_column"))


# --- the queries -----------------------------------------------------------------------------------------------------


def method_grids(spark, sf_dir) -> DataFrame:
    """Forty parts a grid, as four methods read them: one whole, one with rows missing, doubled, blank and misread, one
    with fewer and renamed columns, one that sees a single column."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = (F.col("p_partkey") % 40).cast("int")
    row = p.select(F.floor(F.col("p_partkey") / 40).alias("grid"), k.alias("k"), F.concat(F.lit("D-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("tag"), "p_name", "p_type", "p_brand", F.col("p_size").cast("string").alias("size"))
    cell = lambda col, header, v: F.struct(F.lit(col).alias("col"), F.lit(header).alias("header"), v.alias("value"))
    c = lambda n: F.col(n)
    worse = lambda v, n: F.when((F.col("k") + n) % 5 == 0, "").when((F.col("k") + n) % 7 == 0, F.concat(F.lit("#??"), F.expr(f"substr({v}, 4)"))).otherwise(F.col(v))
    form = {
        "lattice": (0.8, row, [cell(0, "TAG", c("tag")), cell(1, "TYPE", F.when(c("k") % 6 == 0, "").otherwise(c("p_type"))), cell(2, "BRAND", c("p_brand")), cell(3, "SIZE", c("size"))]),
        "stream": (0.85, row.where("k % 9 <> 4").union(row.where("k % 11 = 0")), [cell(0, "TAG", worse("tag", 0)), cell(1, "TYPE", worse("p_type", 1)), cell(2, "BRAND", worse("p_brand", 2)), cell(3, "SIZE", worse("size", 3)), cell(4, "NAME", c("p_name"))]),
        "ocr": (0.6, row, [cell(0, "TAG", c("tag")), cell(1, "KIND", c("p_type")), cell(2, "BRAND", worse("p_brand", 4))]),
        "blob": (0.95, row, [cell(0, "ALL", F.concat_ws(" ", "tag", "p_type", "p_brand"))]),
    }
    out = None
    for name, (conf, rows, cells) in form.items():
        nth = (F.row_number().over(W.partitionBy("grid").orderBy("k")) - 1).alias("row")
        r = rows.select("grid", nth, "k", "tag", "p_type", "p_brand", "p_name", "size").select("grid", F.lit(name).alias("method"), F.lit(conf).alias("confidence"), "row", F.inline(F.array(*cells)))
        out = r if out is None else out.unionByName(r)
    return out


@register("t05_aligned_merge")
def t05(spark, sf_dir):
    """Cells of the merged grids with their verdicts (checked by hand-made grids and loops in pytest)."""
    return merged(method_grids(spark, sf_dir))[0]


@register("a54_merge_confidence")
def a54(spark, sf_dir):
    """Base, merged methods, rate of agreement, confidence and tag column of each merged grid (loops in pytest)."""
    return merged(method_grids(spark, sf_dir))[1]
