"""Writers: replacing partitions, upserts by key, JSON updates, CSV texts and append streams.

Plain Parquet has no row locks: an update computes the partitions that it touches anew and swaps them in with Spark's
dynamic partition overwrite, so that a job that fails before it has changed nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Delete, then insert: the partitions (by ``keys``) that ``rows`` has replace those of the table; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert(rows: DataFrame, path: str, partition: str, keys: list[str], newest: str) -> None:
    """Insert or replace by ``keys``: of all rows with one key the one with the greatest ``newest`` stays.

    Rows as new as each other go by ``_batch`` where they have one (the later batch stays), then rows of ``rows`` before
    stored ones, then by their values, so that the result never depends on chance.  Keys and partitions may be null, and
    a key may move to another partition.  Read and written are the partitions that ``rows`` names and those that hold
    one of its keys; beside the table first, since a table that is read can't be overwritten.  A job that fails half way
    is made good by running it again.
    """
    spark = rows.sparkSession
    merged, stored = rows.withColumn("_stored", F.lit(0)), None
    if _exists(rows, path):
        stored = spark.read.schema(_stored_schema(spark, path, rows)).parquet(path)
        asked = rows.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys))).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
        holding = stored.join(asked, same, "left_semi").select(F.col(partition).alias("_p"))
        touched = rows.select(F.col(partition).alias("_p")).union(holding).distinct()
        old = stored.join(touched, F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
        merged = old.withColumn("_stored", F.lit(1)).unionByName(merged, allowMissingColumns=True)
    whole = F.to_json(F.struct(*(c for c in sorted(merged.columns) if c != "_stored")))
    batch = [F.desc_nulls_last("_batch")] if "_batch" in merged.columns else []
    first = W.partitionBy(*keys).orderBy(F.desc_nulls_last(newest), *batch, "_stored", F.desc(whole))
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    merged.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_stored").write.parquet(staged)
    new = spark.read.parquet(staged)
    emptied = []
    if stored is not None:
        left = touched.join(new.select(F.col(partition).alias("_q")).distinct(), F.col("_p").eqNullSafe(F.col("_q")), "left_anti")
        emptied = [r["_p"] for r in left.join(stored.select(F.col(partition).alias("_q")).distinct(), F.col("_p").eqNullSafe(F.col("_q")), "left_semi").collect()]  # partitions, not rows
    replace_partitions(new, path, partition)
    naming = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for value in emptied:
        _delete(rows, f"{path.rstrip('/')}/{naming.getPartitionPathString(partition, None if value is None else str(value))}")
    _delete(rows, staged)


def _stored_schema(spark, path: str, rows: DataFrame) -> T.StructType:
    """The table's schema, its partition column with the type that ``rows`` has (folders only have names)."""
    types = {f.name: f.dataType for f in rows.schema}
    return T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in spark.read.parquet(path).schema])


def ingest(path: str, partition: str, keys: list[str], newest: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: batches of pages upserted by key.

    Rows carry their batch's number as ``_batch``: a batch that comes again, even after later ones, changes nothing.
    """
    return lambda batch, number: upsert(batch.withColumn("_batch", F.lit(number).cast("long")), path, partition, keys, newest)


def append_log(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only log of a stream; start the writer to run it."""
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def updated_json(data: Column, key: str, value: str, changes: dict[str, str]) -> Column:
    """A JSON object of strings with ``changes`` made where its ``key`` is ``value``; others, and null, as they are."""
    as_map = F.from_json(data, "map<string,string>")
    new = F.create_map(*(F.lit(x) for kv in changes.items() for x in kv))
    return F.when(F.get_json_object(data, f"$.{key}") == value, F.to_json(merged_map(as_map, new))).otherwise(data)


def merged_map(old: Column, new: Column) -> Column:
    """Both maps' entries, the new one's where both have a key; a null map is an empty one."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def write_lines(rows: DataFrame, path: str, order: list, text: Column) -> None:
    """Text files whose lines are in order over all files, and in one file as far as it is small."""
    rows.orderBy(*order).select(text.alias("value")).write.mode("overwrite").text(path)


def _fs(df: DataFrame, path: str):
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def _exists(df: DataFrame, path: str) -> bool:
    at, fs = _fs(df, path)
    return fs.exists(at)


def _delete(df: DataFrame, path: str) -> None:
    at, fs = _fs(df, path)
    fs.delete(at, True)
