"""The folder that driver and executors share, and tables kept there for later queries."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a local session (tests) without it gets a temporary one, a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plansift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's path and its files' names, lengths and times: another one after any change."""
    at, fs = file_system(spark, path)
    files = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
    return hashlib.sha256(repr([path, sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)]).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path of a table in the shared folder; ``write`` makes it where it isn't there yet.

    It is written under a name of its own and renamed when it is whole, so that a job that fails leaves nothing half done.
    """
    path = f"{shared_dir(spark)}/plansift/{name}"
    at, fs = file_system(spark, path)
    if not fs.exists(at):
        staged = f"{path}-staged-{uuid.uuid4().hex}"
        write(staged)
        made, _ = file_system(spark, staged)
        if fs.exists(at) or not fs.rename(made, at):
            fs.delete(made, True)  # another session was first
    return path


def kept_table(spark: SparkSession, sf_dir: str, table: str, name: str, write: Callable[[str], None]) -> DataFrame:
    """`kept` for what is derived from one table: made anew when that table's files change."""
    return spark.read.parquet(kept(spark, f"{name}-{state_of(spark, f'{sf_dir}/{table}.parquet')}", write))
