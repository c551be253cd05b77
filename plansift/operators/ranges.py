"""Which range holds a number: ranges cut at prefix boundaries, joined by prefix.

A range becomes the fewest blocks ``prefix * 2**k`` to ``(prefix + 1) * 2**k - 1``, two a length at most.  A number has one
prefix of each length, so the join is an equi-join on (length, prefix), whatever the number of ranges; of several blocks
that hold a number the smallest counts, then the range that begins first, ends first and has the least value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

BITS = 32


def blocks(ranges: DataFrame, bits: int = BITS) -> DataFrame:
    """``k, prefix, lo, hi, value`` of ranges ``lo, hi, value`` (both ends included); empty ranges have none."""
    found = []
    for k in range(bits + 1):
        size = 1 << k
        # the first and the last block of this size within the range, where the block twice as large is not within it
        first, last = F.floor((F.col("lo") + size - 1) / size), F.floor((F.col("hi") + 1) / size) - 1
        within = lambda b, s: (b * s >= F.col("lo")) & (b * s + s - 1 <= F.col("hi"))
        for b in (first, last):
            b = b.cast("long")
            outer = F.shiftright(b, 1)
            found.append(F.when(within(b, size) & (~within(outer, 2 * size) if k < bits else F.lit(True)), F.struct(F.lit(k).alias("k"), b.alias("prefix"))))
    return ranges.select("lo", "hi", "value", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("b")).select("b.k", "b.prefix", "lo", "hi", "value")


def located(numbers: DataFrame, ranges: DataFrame, number: str = "number", bits: int = BITS) -> DataFrame:
    """The different numbers with the ``value`` of their range, null where none holds them."""
    parts = blocks(ranges, bits)
    lengths = [r["k"] for r in parts.select("k").distinct().collect()]  # bits + 1 at most
    n = numbers.select(number).where(F.col(number).isNotNull()).distinct()
    if not lengths:
        return n.withColumn("value", F.lit(None).cast(ranges.schema["value"].dataType))
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftright(F.col(number), k).alias("prefix")) for k in sorted(lengths))))
    hit = n.select(number, keys.alias("b")).select(number, "b.k", "b.prefix").join(parts, ["k", "prefix"])
    best = hit.groupBy(number).agg(F.min(F.struct("k", "lo", "hi", "value")).alias("b")).select(number, "b.value")
    return n.join(best, number, "left")


@register("x27_countries", oracle("v_visit", """
WITH r AS (SELECT 167772160 + c_custkey * 5 AS lo, 167772160 + c_custkey * 5 + c_custkey % 5 AS hi, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT *, string_split(ip, '.') AS p FROM v_visit), m AS (SELECT ip, ((p[1]::BIGINT * 256 + p[2]::BIGINT) * 256 + p[3]::BIGINT) * 256 + p[4]::BIGINT AS num FROM n)
SELECT coalesce(country, '??') AS country, count(*) AS hits, count(DISTINCT ip) AS visitors FROM m LEFT JOIN r ON num BETWEEN lo AND hi GROUP BY 1"""))
def x27(spark, sf_dir):
    """Visits by country of the address range (here one for each customer); '??' where no range has the address."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(read(spark, sf_dir, "nation", F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("value")), "c_nationkey")
    lo = F.lit(167772160) + F.col("c_custkey") * 5
    ranges = c.select(lo.alias("lo"), (lo + F.col("c_custkey") % 5).alias("hi"), "value")
    num = F.aggregate(F.split("ip", "[.]"), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    v = views.visit(spark, sf_dir).withColumn("number", num)
    found = v.join(located(v, ranges), "number", "left")
    return found.groupBy(F.coalesce("value", F.lit("??")).alias("country")).agg(F.count("*").alias("hits"), F.count_distinct("ip").alias("visitors"))
