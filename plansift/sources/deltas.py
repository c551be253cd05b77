"""Stored summaries that changes patch, instead of being computed anew.

A change has the row as it was and as it is; either may be null.  It counts as one row less for its old group and one more
for its new group.  Counts and sums by group take such signed rows exactly, and numbers of different values do too as
counts by group and value.  The signed sums of a batch are one partition of the store, named by the batch: a batch that is
written again replaces itself.  The summary is the sum of the base and the batches after it; `compact` makes a new base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.sources.shared import file_system


def signed(changes: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Rows that were and rows that are, with ``sign`` -1 and 1; unchanged rows cancel and are left out."""
    moved = changes.where(~F.col(old).eqNullSafe(F.col(new)))
    both = [moved.where(F.col(c).isNotNull()).select(f"{c}.*", F.lit(s).cast("long").alias("sign")) for c, s in ((old, -1), (new, 1))]
    return both[0].unionByName(both[1])


def totals(rows: DataFrame, groups: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Signed rows by group: ``rows`` and the given sums; groups without any effect are left out.

    Sums must be exact types (integers, decimals), or adding and taking away would leave remainders.
    """
    sums = sums or {}
    for name, c in sums.items():
        if isinstance(rows.select(c.alias(name)).schema[0].dataType, (T.DoubleType, T.FloatType)):
            raise TypeError(f"{name}: sums of doubles can't be patched exactly; use a decimal")
    added = {k: F.sum(c * F.col("sign")) for k, c in sums.items()}
    out = rows.groupBy(*groups).agg(F.sum("sign").alias("rows"), *(c.alias(k) for k, c in added.items()))
    return out.where(_any(["rows", *sums]))


def _any(names: list[str]) -> Column:
    hit = F.lit(False)
    for n in names:
        hit = hit | (F.col(n) != 0)
    return hit


def patched(summary: DataFrame, change: DataFrame, groups: list[str]) -> DataFrame:
    """A summary with the totals of changes added; groups that no row is left of go."""
    both = summary.unionByName(change)
    values = [c for c in both.columns if c not in groups]
    types = {f.name: f.dataType for f in summary.schema}
    out = both.groupBy(*groups).agg(*(F.sum(c).cast(types[c]).alias(c) for c in values))
    return out.where(F.col("rows") != 0)


class SummaryStore:
    """``base-N`` (everything up to batch N) and ``batches/batch=K`` under one path."""

    def __init__(self, spark: SparkSession, path: str, groups: list[str]) -> None:
        self.spark, self.path, self.groups = spark, path.rstrip("/"), groups

    def _base(self) -> int | None:
        at, fs = file_system(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[5:]) for n in names if n.startswith("base-") and n[5:].isdigit()), default=None)

    def _write_base(self, rows: DataFrame, upto: int) -> None:
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        made, fs = file_system(self.spark, staged)
        fs.rename(made, file_system(self.spark, f"{self.path}/base-{upto}")[0])

    def start(self, summary: DataFrame) -> None:
        """The summary before the first batch; a store that has begun stays as it is."""
        if self._base() is None:
            self._write_base(summary, 0)

    def apply(self, change: DataFrame, batch: int) -> None:
        """Write a batch (numbered from 1); again, it replaces itself, and those that the base has are left alone."""
        if batch > (self._base() or 0):
            change.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/batches")

    def read(self) -> DataFrame:
        base = self._base()
        kept = self.spark.read.parquet(f"{self.path}/base-{base}")
        at, fs = file_system(self.spark, f"{self.path}/batches")
        if not fs.exists(at):
            return kept
        schema = T.StructType([*kept.schema.fields, T.StructField("batch", T.LongType())])
        later = self.spark.read.schema(schema).parquet(f"{self.path}/batches").where(F.col("batch") > base).drop("batch")
        return patched(kept, later, self.groups)

    def compact(self, upto: int) -> None:
        """Fold the batches up to a number into a new base, then delete what it replaces."""
        old = self._base()
        if upto <= old:
            return
        kept = self.spark.read.parquet(f"{self.path}/base-{old}")
        at, fs = file_system(self.spark, f"{self.path}/batches")
        if fs.exists(at):
            schema = T.StructType([*kept.schema.fields, T.StructField("batch", T.LongType())])
            some = self.spark.read.schema(schema).parquet(f"{self.path}/batches").where(F.col("batch").between(old + 1, upto)).drop("batch")
            kept = patched(kept, some, self.groups)
        self._write_base(kept, upto)
        for name in [f"base-{old}", *(f"batches/batch={k}" for k in range(old + 1, upto + 1))]:
            fs.delete(file_system(self.spark, f"{self.path}/{name}")[0], True)
