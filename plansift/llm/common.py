"""What the operators of this subpackage share: column access, written tables, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: a word is a run of other characters.  ``bytes.split`` uses the same six.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Tables written to the shared folder and not deleted yet, by path.
_WRITTEN: dict[str, DataFrame] = {}


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary one; a cluster must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plansift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plansift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plansift_path = path
    _WRITTEN[path] = out
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` describes, written; the tables that were written on the way to it are deleted."""
    before = set(_WRITTEN)
    out = saved(make(), name)
    for path in set(_WRITTEN) - before - {out._plansift_path}:
        drop_saved(_WRITTEN[path])
    return out


def drop_all() -> None:
    """Delete all tables of ``saved``: for after results that read them have been written."""
    for df in list(_WRITTEN.values()):
        drop_saved(df)


def drop_saved(df: DataFrame) -> None:
    """Delete a table of ``saved`` that nothing reads any more."""
    path = getattr(df, "_plansift_path", None)
    if _WRITTEN.pop(path, None) is not None:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions that hold about ``per_part`` rows each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


BITS = 1 << 26


def bit_filter(keys: DataFrame, name: str) -> np.ndarray:
    """Bits (at most 8 MB, whatever the input) set for every value of a long column: a filter without misses.

    It only spares work: what it lets through by chance is sorted out by an exact join or count later.
    """
    at = F.pmod(F.col(name), F.lit(BITS)) + 1
    parts = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        start = (r["n"] - 1) * 4096
        bits[start : start + 4096] |= np.frombuffer(bytes(r["b"]), np.uint8)
    return bits


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit integers) the filter lets through."""
    at = keys.astype(np.uint64) & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
