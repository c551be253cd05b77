"""Connected components of a link table, by randomised contraction.

Each round every vertex moves to the neighbour (or itself) that comes first in a random order, and links are carried
over to where their ends moved; a constant share of the vertices goes each round whatever the graph's shape, so chains
need no more rounds than stars.  Everything is a group-by or a join; each round's tables are written, none is
collected.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import drop_saved, saved


def components(links: DataFrame, seed: int = 17) -> DataFrame:
    """``links`` (a long, b long; no nulls) to (``node``, ``root``) for every node of a link between two nodes.

    Nodes of one component have the same root, which is one of them.  Links to oneself and repeated links count for
    nothing; an empty table gives an empty one.
    """
    masks = random.Random(seed)
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    edges = saved(links.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "links")
    moved: DataFrame | None = None
    while not edges.isEmpty():
        mask = F.lit(masks.getrandbits(63)).cast("long")
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        step = saved(first.select(F.col("a").alias("v"), F.least(F.col("m"), F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("r")), "step")
        to_a, to_b = step.select(F.col("v").alias("a"), F.col("r").alias("ra")), step.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        nxt = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(*pair(F.col("ra"), F.col("rb"))).distinct()
        nxt = saved(nxt, "links")
        drop_saved(edges)
        edges = nxt
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("v").alias("r"), F.col("r").alias("to"))
            new = saved(moved.join(later, "r", "left").select("v", F.coalesce("to", "r").alias("r")), "moved")
            drop_saved(moved)
            drop_saved(step)
            moved = new
    drop_saved(edges)
    if moved is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return moved.select(F.col("v").alias("node"), F.col("r").alias("root"))
