"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

A document's place is the hex of an MD5 of its id and text.  Tokens are summed by source and the first hex digits of
the place (the buckets); a running sum over a source's buckets finds the one in which its budget ends.  Only that
bucket's documents are summed again, by the next digits.  After the last refinement the budget is a threshold on the
place, and documents are taken by comparing strings: no document is sorted.

Thresholds are nested: a larger budget takes the same documents and more.  A source whose target exceeds its size is
taken once whole, and what is missing is taken a second time under the threshold.

Scale: sums by (source, bucket) combine before the shuffle, so a source with a third of all rows is no hot group; per
source at most ``16 ** DIGITS`` buckets are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.llm.common import WORD, col, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
DIGITS = 3
LEVELS = 3
SMALL = 10_000


def place_of(doc_id: Column, text: Column) -> Column:
    """A document's place among those of its source: hex digits that any engine with MD5 gives alike."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.substring(F.md5(named.cast("binary")), 1, DIGITS * LEVELS)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(``id``, ``source``, ``size``, ``place``) of each row; null texts have size 0."""
    words = F.regexp_count(F.coalesce(col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(col(id_col).alias("id"), col(source_col).alias("source"), words.alias("size"), place_of(col(id_col), col(text_col)).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(``source``, ``source_size``) to the same and ``target``.

    Sources in code-point order, null last, take the weights in turn; together they are to give ``share`` of all sizes.
    A target stops at ``most`` times the source's size and the excess goes to the others by weight, until none is
    above: sources stop in the order of the level ``most * size / weight``, and those that don't share what is left.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    weighed = sizes.select("source", "source_size", weight.alias("w")).withColumns({"cap": cap, "level": cap / F.col("w")})
    before = W.orderBy("level", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    stepped = weighed.withColumns({
        "left": F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    # taking away the sources that stop raises the common level of the others until the first that doesn't stop
    common = F.max(F.col("left") / F.col("rest")).over(whole)
    return stepped.select("source", "source_size", F.least("cap", common * F.col("w")).alias("target"))


def _joined(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with their source's values; broadcast only where the sources are few enough."""
    names = [c for c in by_source.columns if c != "source"]
    right = by_source.select(F.col("source").alias("_s"), *names)
    right = F.broadcast(right) if by_source.limit(SMALL + 1).count() <= SMALL else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(``source``, ``budget``) to (``source``, ``upto``): documents with ``place`` < ``upto`` hold about the budget.

    Level by level the bucket in which the budget ends is split by its next hex digits; at the last level it is taken
    where that comes nearer to the budget.
    """
    state = budgets.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for n in range(LEVELS):
        inner = _joined(rows, state).where(F.col("place").startswith(F.col("prefix")) & (F.col("budget") > 0))
        bucket = F.substring("place", 1, DIGITS * (n + 1)).alias("bucket")
        sums = inner.groupBy("source", bucket).agg(F.sum("size").alias("tokens"), F.first("budget").alias("budget"), F.first("below").alias("base"))
        order = W.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("end", F.col("base") + F.sum("tokens").over(order)).withColumn("start", F.col("end") - F.col("tokens"))
        crossing = run.where((F.col("start") < F.col("budget")) & (F.col("end") >= F.col("budget")))
        first = crossing.groupBy("source").agg(F.min(F.struct("bucket", "start", "end")).alias("b"))
        nxt = budgets.join(first.select(F.col("source").alias("_s"), "b"), F.col("source").eqNullSafe(F.col("_s")), "left")
        if n == LEVELS - 1:
            over = F.col("b.end") - F.col("budget") < F.col("budget") - F.col("b.start")
            cut = F.when(F.col("budget") <= 0, "").when(F.col("b").isNull(), "~").when(over, F.concat(F.col("b.bucket"), F.lit("~"))).otherwise(F.col("b.bucket"))
            return saved(nxt.select("source", cut.alias("upto")), "upto")
        # without a crossing the budget is all there is: "~" comes after every hex digit and starts no place
        state = saved(nxt.select("source", "budget", F.coalesce("b.bucket", F.lit("~")).alias("prefix"), F.coalesce("b.start", F.lit(0)).cast("long").alias("below")), "level")
    raise AssertionError


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    rows = saved(measured(docs, id_col, text_col, source_col), "sizes")
    wanted = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    whole = F.col("target") >= F.col("source_size")
    budget = F.when(whole, F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    cuts = thresholds(rows, wanted.select("source", budget.alias("budget")))
    plan = wanted.join(cuts.select(F.col("source").alias("_s"), "upto"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return rows, saved(plan.withColumn("least", whole.cast("int")), "plan")


def _times(place: Column) -> Column:
    return F.col("least") + (place < F.col("upto")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """For each row: id, ``size``, ``source_size``, ``target`` of its source, and ``taken`` words (0, 1 or 2 times its size).

    Null texts have size 0 and take 0 words; a null source is a source of its own, the last; rows equal in id and text
    share a place and are taken or left together; sources without words have target 0; an empty table gives an empty
    one; other columns are not read.
    """
    rows, plan = _plan(docs, id_col, text_col, source_col, weights)
    return _joined(rows, plan).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _times(F.col("place"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix itself: the documents taken, those taken twice as two equal rows, columns as they were.

    Null texts, null ids, null sources, ties and repeated rows are as in ``mix``; a document of size 0 is taken or left
    by its place; very long texts are whole; an empty table gives an empty one.
    """
    _, plan = _plan(docs, id_col, text_col, source_col, weights)
    whole = F.struct(*(col(c) for c in docs.columns)).alias("whole")
    keyed = docs.select(whole, col(source_col).alias("source"), place_of(col(id_col), col(text_col)).alias("place"))
    taken = _joined(keyed, plan).withColumn("times", _times(F.col("place"))).where("times > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("whole.*")
