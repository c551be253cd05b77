"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample; every row is indexed in the leaf that it reaches by nearest centroids.  A query
walks the tree through a priority queue, best centroid first, and its first leaves are searched.  How many: a bounded
set of queries is answered exactly against all rows, and leaf visits are widened until those answers would have been
found at the wanted recall; a query whose leaves hold too few rows gets more.

Scale: the tree (at most ``MAX_LEAVES`` leaves) goes to every task.  Leaves that lie together form groups of a bounded
number of rows, and rows of a larger leaf are split into blocks; queries are split into blocks too.  A cell of the search
is one group or block of rows with one block of queries, so neither a leaf with a third of all rows nor a popular one lands
in one task.  A query goes to a cell once, with the list of those of its leaves that are there, not once a leaf, and
per query and cell at most ``k`` rows go on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.llm.common import col, saved

K = 20
SAMPLE = 10_000
CALIBRATION = 256
LEAF_ROWS = 256
MAX_LEAVES = 2048
BRANCHES = 8
RECALL = 0.94
ROW_BLOCK, QUERY_BLOCK = 8192, 8192
#: Products of rows and queries that a task holds at a time, and queries whose leaves it lists before they go on.
PRODUCTS, WALKED = 1 << 20, 256


class Tree(NamedTuple):
    """Centroids of the nodes, and each node's children; ``leaf`` numbers the nodes without any."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster numbers of the rows of ``x``."""
    centers = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        for c in range(k):
            if (own := label == c).any():
                centers[c] = x[own].mean(0)
    return label


def fit_tree(sample: np.ndarray, leaves: int, seed: int = 5) -> Tree:
    """Split the sample into ``BRANCHES`` clusters, and each again, until there are about ``leaves`` of them."""
    rng = np.random.default_rng(seed)
    centroids, children, leaf = [], [], []

    def grow(x: np.ndarray, wanted: float) -> int:
        node = len(children)
        centroids.append(x.mean(0))
        children.append([])
        leaf.append(-1)
        k = min(BRANCHES, round(wanted), len(x) // 2)
        if k > 1:
            label = _k_means(x, k, rng)
            parts = [x[label == c] for c in range(k) if (label == c).any()]
            if len(parts) > 1:
                children[node] = [grow(p, wanted * len(p) / len(x)) for p in parts]
        return node

    grow(sample, leaves)
    ends = [n for n, c in enumerate(children) if not c]
    for i, n in enumerate(ends):
        leaf[n] = i
    return Tree(np.array(centroids), children, leaf, len(ends))


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``: the nearest centroid at each level."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        kids = tree.children[node]
        if not kids:
            out[rows] = tree.leaf[node]
        elif len(rows):
            c = tree.centroids[kids]
            best = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(kid, rows[best == i]) for i, kid in enumerate(kids)]
    return out


def visits(tree: Tree, query: np.ndarray) -> Iterator[int]:
    """Leaves in best-bin-first order: the open node with the largest inner product goes next."""
    queue = [(0.0, 0)]
    gain = tree.centroids @ query
    while queue:
        _, node = heapq.heappop(queue)
        if tree.leaf[node] >= 0:
            yield tree.leaf[node]
        for kid in tree.children[node]:
            heapq.heappush(queue, (-gain[kid], kid))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(
    x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, seen: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` largest inner products, best first, ties to smaller ids, its own id left out.

    ``seen``: each row's leaf, as a place, and for each query and place whether it searches that leaf; without, it searches
    all.  A matrix product tells who can be among them, its rounding allowed for; those are scored again in one fixed order
    of summing, so that equal vectors tie wherever they stand.  Queries are taken a few at a time.
    """
    step = max(1, PRODUCTS // max(1, len(ids)))
    longest = np.linalg.norm(x, axis=1).max(initial=0.0)
    parts = []
    for lo in range(0, len(own), step):
        part = slice(lo, lo + step)
        at, row, score = _nearest(x, ids, q[part], own[part], k, longest, seen and seen[1][part][:, seen[0]])
        parts.append((at + lo, row, score))
    none = np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (none, none, np.empty(0))


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, longest: float, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    approx = q @ x.T
    if seen is not None:
        approx[~seen] = -np.inf
    same = np.flatnonzero(np.isin(ids, own))
    at, row = np.nonzero(own[:, None] == ids[None, same])
    approx[at, same[row]] = -np.inf
    edge = np.full(len(own), -np.inf)
    if len(ids) > k:
        edge = np.partition(approx, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-12 * np.linalg.norm(q, axis=1) * longest
    at, row = np.nonzero((approx >= edge[:, None]) & (approx > -np.inf))
    score = np.empty(at.size)
    for lo in range(0, at.size, 1 << 14):
        some = slice(lo, lo + (1 << 14))
        score[some] = np.einsum("ij,ij->i", x[row[some]], q[at[some]], optimize=False)
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(at.size) - np.searchsorted(at, at)
    best = place < k
    return at[best], row[best], score[best]


def valid_rows(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(``id``, ``vec``) of the rows that take part: an id, and a vector of finite components that is not zero."""
    vec = F.transform(col(vec_col), lambda v: v.cast("double"))
    finite = F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return rows.select(col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & finite & F.exists("vec", lambda v: v != 0))


def _exact(rows: DataFrame, ids: np.ndarray, vecs: np.ndarray, tree: Tree, k: int) -> list[tuple[int, int]]:
    """(place of query, leaf) of the exact nearest rows of a bounded set of queries, all rows seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in ids]
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _matrix(b.column("vec")), b.column("id").to_numpy()
            leaf = assign(tree, x)
            at, row, score = nearest(x, own, vecs, ids, k)
            for n, *found in zip(at.tolist(), (-score).tolist(), own[row].tolist(), leaf[row].tolist(), strict=True):
                held[n].append(tuple(found))
            held = [heapq.nsmallest(k, h) for h in held]
        flat = [(n, -s, i, f) for n, h in enumerate(held) for s, i, f in h]
        cols = list(zip(*flat, strict=True)) if flat else [(), (), (), ()]
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["n", "score", "id", "leaf"])

    found = rows.mapInArrow(run, "n int, score double, id long, leaf long")
    first = W.partitionBy("n").orderBy(F.desc("score"), "id")
    return [(r["n"], r["leaf"]) for r in found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).collect()]


def grouped(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """(group, blocks) of each leaf: leaves in their order, as many as have ``most`` rows; a larger leaf is a group in blocks."""
    out, group, held = {}, 0, 0
    for leaf, n in sorted(counts.items()):
        if held and held + n > most:
            group, held = group + 1, 0
        out[leaf] = (group, -(-n // most))
        held += n
    return out


def calibrated(tree: Tree, truth: list[tuple[int, int]], vecs: np.ndarray, recall: float) -> int:
    """The least number of leaf visits that finds the wanted share of the true neighbours."""
    order = [{leaf: i for i, leaf in enumerate(visits(tree, q))} for q in vecs]
    need = sorted(order[n][leaf] + 1 for n, leaf in truth)
    return need[min(len(need), int(np.ceil(recall * len(need)))) - 1] if need else 1


def search(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each row whose id is divisible by ``every``, its ``k`` nearest found.

    Nearest: largest inner product of the vectors as given, in double precision; ties to smaller ids; the query's own
    id left out.  Rows with a null id, and vectors that are null, empty, zero, of another length than most, or hold
    null or non-finite components take no part.  Of rows that share an id the least vector is the query; all are
    candidates for other queries.  An empty table gives an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    valid = valid_rows(rows, id_col, vec_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = valid.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return empty
    valid = valid.where(F.size("vec") == lengths["d"])
    by_hash = valid.orderBy(F.xxhash64("id"), "id")  # a sample that reruns draw again
    sample = np.array([r["vec"] for r in by_hash.limit(SAMPLE).collect()])
    tree = fit_tree(sample, min(MAX_LEAVES, max(1, lengths["n"] // LEAF_ROWS), max(1, len(sample) // 4)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = assign(tree, _matrix(b.column("vec"))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["id", "vec", "leaf"])

    index = saved(valid.mapInArrow(place, "id long, vec array<double>, leaf long"), "index")
    counts = dict(index.groupBy("leaf").count().collect())  # at most MAX_LEAVES rows
    queries = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    few = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).collect()
    if not few:
        return empty
    ids, vecs = np.array([r["id"] for r in few]), np.array([r["vec"] for r in few])
    width = calibrated(tree, _exact(index.select("id", "vec"), ids, vecs, tree, k), vecs, recall)

    groups = grouped(counts, ROW_BLOCK)
    to_kind = pa.list_(pa.struct([("g", pa.int64()), ("blocks", pa.int64()), ("leaves", pa.list_(pa.int32()))]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, WALKED) for whole in batches for lo in range(0, whole.num_rows, WALKED)):
            to = []
            for q in _matrix(b.column("vec")):
                held: dict[tuple[int, int], list[int]] = {}
                seen = 0
                for i, leaf in enumerate(visits(tree, q)):
                    if i >= width and seen > k:
                        break
                    if leaf in counts:
                        held.setdefault(groups[leaf], []).append(leaf)
                        seen += counts[leaf]
                to.append([{"g": g, "blocks": blocks, "leaves": leaves} for (g, blocks), leaves in held.items()])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(to, to_kind)], ["id", "vec", "to"])

    asked = -(-queries.count() // QUERY_BLOCK)
    place_of = F.broadcast(spark.createDataFrame([(leaf, *at) for leaf, at in sorted(groups.items())], "leaf long, g long, blocks long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = index.join(place_of, "leaf").select("id", "vec", "leaf", "g", F.pmod(F.xxhash64("id"), "blocks").alias("i"), each(F.lit(asked)).alias("j"))
    right = queries.mapInArrow(walk, "id long, vec array<double>, to array<struct<g: long, blocks: long, leaves: array<int>>>")
    right = right.select("id", "vec", F.explode("to").alias("to"), F.pmod(F.xxhash64("id"), F.lit(asked)).alias("j"))
    right = right.select("id", "vec", "to.leaves", "to.g", each(F.col("to.blocks")).alias("i"), "j")

    near_kind = pa.list_(pa.struct([("loss", pa.float64()), ("id", pa.int64())]))

    def cell(key: tuple, own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], near_kind)], ["query_id", "near"])
        x, xid = _matrix(own["vec"]), own["id"].to_numpy()
        here, leaf = np.unique(own["leaf"].to_numpy(), return_inverse=True)
        lists = asking["leaves"].combine_chunks()
        wanted = lists.flatten().to_numpy()
        which = np.repeat(np.arange(asking.num_rows), lists.value_lengths().to_numpy())
        hit = np.isin(wanted, here)
        seen = np.zeros((asking.num_rows, here.size), bool)
        seen[which[hit], np.searchsorted(here, wanted[hit])] = True
        at, row, score = nearest(x, xid, _matrix(asking["vec"]), asking["id"].to_numpy(), k, (leaf, seen))
        near = pa.StructArray.from_arrays([pa.array(-score), pa.array(xid[row])], ["loss", "id"])
        ends = np.searchsorted(at, np.arange(asking.num_rows + 1))
        return pa.table([asking["id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], ["query_id", "near"])

    cells = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(cell, "query_id long, near array<struct<loss: double, id: long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # k from each of a query's cells at most
    ranked = cells.groupBy("query_id").agg(best.alias("near")).select("query_id", F.posexplode("near").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.loss")).alias("score"))
