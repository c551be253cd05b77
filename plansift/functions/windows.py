"""Running sums that no single task has to make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: str, at: str, value: str, name: str, width: int = 10_000) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` up to ``at`` (a whole number), ties included.

    Sums are taken in ranges of ``width`` numbers, and what lies before a range is added from the ranges' totals, so
    that a key with a third of all rows is spread over many tasks.  Null values count as nothing.
    """
    spread = df.withColumn("_range", F.floor(F.col(at) / width))
    totals = spread.groupBy(by, "_range").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = spread.withColumn("_inside", F.sum(value).over(W.partitionBy(by, "_range").orderBy(at)))
    met = inside.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_r")))
    return met.withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)
