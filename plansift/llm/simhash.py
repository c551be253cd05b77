"""SimHash near-dedup with anchor points of a covering code.

A fingerprint's 64 bits are three blocks of 21, 21 and 22.  Of up to 4 differing bits one block has at most 1, so a
linked pair is near in some block.  In each block the anchors are the words of a code with covering radius 1: the
[15, 11] Hamming code on 15 bits times all words on the others (2**17 or 2**18 anchors).  A fingerprint's home is the
one anchor within radius 1; it is copied to every anchor within radius 1 + 1, about 15 of them, so the home of either
of a linked pair has a copy of the other.  Per anchor, homes are compared with copies on all 64 bits.

Scale: only distinct fingerprints are compared (copies of a text are one).  Anchors with many rows are split into a
grid of cells of bounded size, and a large cell gives only links that join what it has not joined yet, so the links
grow with the fingerprints, not with the pairs.  Components come from joins and group-bys on the links.

``keep_one`` takes the same way to a lower similarity, five words and a Jaccard of 0.8, where fingerprints of 64 bits
differ in ten or so and no block is nearly equal for sure.  Its fingerprints are longer, with many blocks, whose number
follows from the wanted recall and their width from the number of texts.  Fingerprints meet at their homes (covering
radius 1, no further copies), first by 128 bits; those that have a partner there are compared on all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.llm.common import col, drop_saved, saved
from plansift.llm.components import components

BLOCKS = ((0, 21), (21, 21), (42, 22))
HAMMING = 15
RADIUS = 1
CELL = 4096
PAIRS = 2_000_000
SEGMENTS = 400
LEAST_LONGS = 16  # the similarity told by 1,024 bits has a standard deviation of about 0.02


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """64 bits, each 1 if set in over half of the XXH64 hashes of the shingles of ``size`` words."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - size + 1)]
    ends = ends[min(size, len(words)) - 1 :] - 1
    xxh, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), 50_000):
        part = zip(starts[k : k + 50_000].tolist(), ends[k : k + 50_000].tolist(), strict=True)
        h = np.array([xxh(joined[a:b], seed) for a, b in part], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _map_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(_map_fingerprints, f"id {kind}, fp long")


def _syndrome(bits: np.ndarray) -> np.ndarray:
    """Of the Hamming code on the lowest 15 bits: zero for its words, else the place (from 1) of the bit to flip."""
    out = np.zeros(bits.shape, np.int64)
    for i in range(HAMMING):
        out ^= np.where(bits >> i & 1, i + 1, 0)
    return out


def flips(width: int, reach: int) -> list[np.ndarray]:
    """By syndrome, the bit patterns of weight up to ``reach`` that lead from a word to an anchor; the home's first."""
    masks = np.array([sum(1 << i for i in c) for k in range(reach + 1) for c in combinations(range(width), k)], np.int64)
    by = _syndrome(masks)
    home = [0] + [1 << i for i in range(HAMMING)]
    return [np.array([home[s], *(m for m in masks[by == s].tolist() if m != home[s])], np.int64) for s in range(HAMMING + 1)]


def _copies(reach: int):
    tables = {w: flips(w, RADIUS + reach) for _, w in BLOCKS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for n, (low, width) in enumerate(BLOCKS):
                value = fp >> low & (1 << width) - 1
                syn = _syndrome(value)
                for s in range(HAMMING + 1):
                    own, table = fp[syn == s], tables[width][s]
                    anchor = (value[syn == s][:, None] ^ table[None, :]).ravel() | n << 40
                    home = np.tile(np.arange(table.size) == 0, own.size)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.repeat(own, table.size)), pa.array(home)], ["anchor", "fp", "home"])

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number it counts those of the magnitude


def _compare(most: int):
    """Rows sorted by cell to links: homes against all rows of their cell."""

    def links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [cell.size]]))
        out = [np.empty((0, 2), np.int64)]
        for s in np.flatnonzero(sizes > 256):
            out.append(_joining(fp[starts[s] : starts[s] + sizes[s]], home[starts[s] : starts[s] + sizes[s]], most))
        run = np.repeat(np.arange(starts.size), sizes)
        at = np.flatnonzero(home & (sizes[run] <= 256))
        for k in range(0, at.size, PAIRS // 256):
            h = at[k : k + PAIRS // 256]
            n = sizes[run[h]]
            left = np.repeat(h, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[run[h]], n)
            near = (_bits(fp[left] ^ fp[right]) <= most) & (fp[left] != fp[right])
            out.append(np.stack([fp[left[near]], fp[right[near]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "home"))
            last = np.searchsorted(new[0], new[0][-1])  # the last cell may go on in the next batch
            if last or held and held[-1][0][-1] != new[0][0]:
                held.append(tuple(x[:last] for x in new))
                yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append(tuple(x[last:] for x in new))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _joining(fp: np.ndarray, home: np.ndarray, most: int) -> np.ndarray:
    """Links of one large cell that join two of its parts not joined before: fewer than it has rows."""
    nodes, index = np.unique(fp, return_inverse=True)
    label = np.arange(nodes.size)
    out = []
    for i in np.unique(index[home]):
        near = np.flatnonzero(_bits(nodes ^ nodes[i]) <= most)
        found, at = np.unique(label[near], return_index=True)
        if found.size > 1:
            other = near[at[found != label[i]]]
            out.append(np.stack([np.full(other.size, nodes[i]), nodes[other]], axis=1))
            label[np.isin(label, found)] = found[0]
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def near_links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints ``fp`` that suffice to connect all pairs at ``most`` bits or fewer."""
    if not 0 <= most < 2 * len(BLOCKS):
        raise ValueError("the blocks serve up to 5 differing bits")
    spark = fps.sparkSession
    rows = fps.select("fp").mapInArrow(_copies(most // len(BLOCKS)), "anchor long, fp long, home boolean")
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    split = counts.where(F.col("n") > CELL).select("anchor", F.ceil(F.col("h") / CELL).alias("hs"), F.ceil(F.col("n") / CELL).alias("ns"))
    split = saved(split, "split")
    few = split.count() <= 10_000
    rows = rows.join(F.broadcast(split) if few else split, "anchor", "left")
    hs, ns = F.greatest(F.coalesce("hs", F.lit(1)), F.lit(1)), F.coalesce("ns", F.lit(1))
    # a home meets every part of the copies, a copy every part of the homes
    as_home = rows.where("home").select("anchor", "fp", "home", F.pmod(F.xxhash64("fp"), hs).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), ns - 1)).alias("j"))
    as_copy = rows.where(~F.col("home") | (hs > 1)).select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), hs - 1)).alias("i"), F.pmod(F.xxhash64("fp"), ns).alias("j"))
    # cells whose hash is equal by chance are merely compared together
    cells = as_home.unionAll(as_copy).select(F.xxhash64("anchor", "i", "j").alias("cell"), "fp", "home")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_compare(most), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Components are those of the whole link relation: fingerprints at ``most`` differing bits or fewer.  The component
    id is the smallest id reachable, null ids left out (null if all are).  Rows without words have fingerprint zero
    and link like any other; repeated rows are linked to each other; an empty table gives an empty one; other columns
    are not read.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = components(near_links(distinct, most))
    roots = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class Code(NamedTuple):
    """A fingerprint's 64-bit parts, its blocks, the bits of each, and how many bits two linked fingerprints may differ in."""

    longs: int
    blocks: int
    width: int
    most: int


def code_for(rows: int, similarity: float, recall: float = 0.9) -> Code:
    """The code whose anchors outnumber the rows and which finds ``recall`` of the pairs of just that Jaccard similarity.

    Sets of that similarity have a cosine of 2 s / (1 + s), and a bit of their fingerprints differs with probability
    angle / pi.  A block's anchors are the Hamming code on 15 bits times all words on the others; both of a pair have
    the same home if the others are equal and so are the nearest words of the code.  The bound on all bits lies one
    standard deviation above those expected.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    exact = lambda n, k: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    home = exact(HAMMING, 0) + (exact(HAMMING, 1) + exact(HAMMING, 2)) / 8
    others = max(1, math.ceil(math.log2(max(2, rows))) - 11)
    blocks = math.ceil(math.log(1 - recall) / math.log(1 - home * (1 - p) ** others))
    longs = max(LEAST_LONGS, -(-blocks * (HAMMING + others) // 64))
    return Code(longs, 64 * longs // (HAMMING + others), HAMMING + others, round(64 * longs * p + math.sqrt(64 * longs * p * (1 - p))))


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """The different hashes of the text's shingles (of all its words, if it has too few)."""
    words = (text or "").encode().lower().split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = max(1, own.size - size + 1)
    h = np.zeros(runs if own.size else 0, np.uint64)
    for k in range(min(size, own.size)):
        h = _mixed(h ^ own[k : k + runs])
    return np.unique(h)


def long_fingerprints(texts: list[str | None], longs: int) -> np.ndarray:
    """Per text ``longs`` times 64 bits, each 1 if set in over half of the hashes of the text's different shingles."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([h.size for h in hashes], np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    # up to 255 rows of bits are summed in one byte each
    segments = -(-sizes // 255)
    doc = np.repeat(np.arange(sizes.size), segments)
    nth = np.arange(doc.size) - np.repeat(np.cumsum(segments) - segments, segments)
    starts = np.repeat(np.cumsum(sizes) - sizes, segments) + 255 * nth
    out = np.zeros((sizes.size, longs), np.uint64)
    counts = np.zeros((sizes.size, longs, 64), np.int32)
    for at in range(0, doc.size, SEGMENTS):
        own, begin = doc[at : at + SEGMENTS], starts[at : at + SEGMENTS]
        part = h[begin[0] : starts[at + SEGMENTS] if at + SEGMENTS < doc.size else h.size]
        for k in range(longs):
            x = _mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            bits = np.unpackbits(x.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(bits, begin - begin[0], axis=0).view(np.uint8)
            np.add.at(counts[:, k], own, sums)
    for k in range(longs):
        out[:, k] = np.packbits(2 * counts[:, k] > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _map_long(longs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            same = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            fps = [fp.tobytes() for k in range(0, len(texts), 256) for fp in long_fingerprints(texts[k : k + 256], longs)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(same, pa.binary()), pa.array(fps, pa.binary())], ["key", "same", "fp"])

    return run


def _rows_of(column: pa.Array, longs: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, longs)


def _homes(code: Code):
    """Per fingerprint and block a row with the home anchor, and the first 128 bits."""
    powers = 1 << np.arange(code.width, dtype=np.int64)
    flip = np.array([0] + [1 << i for i in range(HAMMING)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _rows_of(b.column("fp"), code.longs)
            node = b.column("node").to_numpy()
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, : code.blocks * code.width]
            value = bits.reshape(len(fp), code.blocks, code.width) @ powers
            anchor = (value ^ flip[_syndrome(value)]) + (np.arange(code.blocks, dtype=np.int64) << 50)
            each = lambda x: pa.array(np.repeat(x, code.blocks))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.ravel()), each(node), each(fp[:, 0].view(np.int64)), each(fp[:, -1].view(np.int64))], ["anchor", "node", "x", "y"])

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near_in_cell(most: int, of: int):
    """Rows of a cell that have a partner near enough by the first 128 bits, with a margin of four deviations."""
    p = most / of
    loose = math.ceil(128 * p + 4 * math.sqrt(128 * p * (1 - p)))

    def one(rows: tuple[np.ndarray, ...]) -> np.ndarray:
        sub = np.stack(rows[2:], axis=1).view(np.uint64)
        found = np.zeros(len(sub), bool)
        for i in range(len(sub)):
            if not found[i]:
                near = _distance(sub[i], sub) <= loose
                near[i] = False
                if near.any():
                    found |= near
                    found[i] = True
        return found

    def pick(rows: tuple[np.ndarray, ...], starts: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
        found = np.zeros(len(rows[0]), bool)
        small = (sizes > 1) & (sizes <= 64)
        for n in np.unique(sizes[small]).tolist():  # cells of one size together
            at = starts[sizes == n]
            for k in range(0, at.size, max(1, PAIRS // (n * n))):
                index = at[k : k + max(1, PAIRS // (n * n))][:, None] + np.arange(n)
                sub = np.stack([c[index] for c in rows[2:]], axis=-1).view(np.uint64)
                near = _distance(sub[:, :, None], sub[:, None]) <= loose
                near[:, np.arange(n), np.arange(n)] = False
                found[index] = near.any(axis=2)
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
            found[s : s + n] = one(tuple(c[s : s + n] for c in rows))
        return [rows[0][found], rows[1][found]], ["cell", "node"]

    return pick


def _joining_cells(most: int, longs: int):
    """Links of a cell that join two of its parts not joined before."""

    def pick(rows: tuple[np.ndarray, ...], starts: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
        out = [np.empty((0, 2), np.int64)]
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            node, first = np.unique(rows[1][s : s + n], return_index=True)
            fp = np.frombuffer(b"".join(rows[2][s : s + n][first]), np.uint64).reshape(-1, longs)
            label = np.arange(node.size)
            for i in range(node.size):
                other = np.flatnonzero(label != label[i])  # those joined with it already need no look
                near = other[_distance(fp[i], fp[other]) <= most] if other.size else other
                if near.size:
                    found, at = np.unique(label[near], return_index=True)
                    out.append(np.stack([np.full(found.size, node[i]), node[near[at]]], axis=1))
                    label[np.isin(label, found)] = label[i]
        pairs = np.concatenate(out)
        return [pairs[:, 0], pairs[:, 1]], ["a", "b"]

    return pick


def _by_cell(names: tuple[str, ...], pick):
    """Applies ``pick`` to rows sorted by cell, whole cells at a time."""

    def done(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
        cols, out = pick(rows, starts, np.diff(np.concatenate([starts, [rows[0].size]])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names)
            last = np.searchsorted(new[0], new[0][-1])  # the last cell may go on in the next batch
            if last or held and held[-1][0][-1] != new[0][0]:
                held.append(tuple(x[:last] for x in new))
                yield done(held)
                held = []
            held.append(tuple(x[last:] for x in new))
        if held:
            yield done(held)

    return run


def _in_cells(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of an anchor as rows of cells of bounded size, sorted: those of a large anchor are split into parts, and each
    two parts meet in one cell."""
    spark = rows.sparkSession
    split = saved(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("anchor", F.ceil(F.col("n") / CELL).alias("parts")), "split")
    few = split.count()
    if few:
        rows = rows.join(F.broadcast(split) if few <= 10_000 else split, "anchor", "left")
        own = F.pmod(F.xxhash64("node"), F.col("parts"))
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.select("anchor", "node", *extra, F.coalesce(own, F.lit(0)).alias("i"), other.alias("j"))
        cell = F.xxhash64("anchor", F.least("i", "j"), F.greatest("i", "j"))
    else:
        cell = F.xxhash64("anchor", F.lit(0).cast("long"), F.lit(0).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(cell.alias("cell"), "node", *extra).repartition(parts, "cell").sortWithinPartitions("cell")


def similar_links(nodes: DataFrame, code: Code) -> DataFrame:
    """Links (``a``, ``b``) of (``node``, ``fp``) that connect what is within ``code.most`` bits and shares a home."""
    homes = nodes.mapInArrow(_homes(code), "anchor long, node long, x long, y long")
    near = _by_cell(("cell", "node", "x", "y"), _near_in_cell(code.most, 64 * code.longs))
    met = saved(_in_cells(homes, ["x", "y"]).mapInArrow(near, "cell long, node long").distinct(), "met")
    full = met.withColumnRenamed("cell", "anchor").join(nodes, "node")
    join = _by_cell(("cell", "node", "fp"), _joining_cells(code.most, code.longs))
    links = saved(_in_cells(full, ["fp"]).mapInArrow(join, "a long, b long").distinct(), "similar")
    drop_saved(met)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of near-duplicates, columns as they were.

    Near-duplicates have different five-word shingles in common at a Jaccard similarity of ``similarity`` or more, as
    long fingerprints tell it, and groups are connected through them; texts with equal words are one.  Letters A-Z count
    as lower.  The one that stays has the smallest id, null ids last, ties by a hash of the text; of rows that are equal
    in id and text one stays.  Texts without words are alike, null ones too, and one of them stays; a text of fewer than
    five words is one shingle; very long texts are read whole; an empty table gives an empty one.
    """
    code = code_for(docs.count(), similarity)
    key = F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("hash"))
    keyed = docs.select(key.alias("key"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([keyed.schema["key"], T.StructField("same", T.BinaryType()), T.StructField("fp", T.BinaryType())])
    rows = saved(keyed.mapInArrow(_map_long(code.longs), schema), "fingerprints")
    once = rows.groupBy("same", "key").agg(F.count("*").alias("copies"), F.first("fp").alias("fp"))
    texts = once.groupBy("same").agg(F.min(F.struct("key", "copies")).alias("least"), F.first("fp").alias("fp"))
    nodes = saved(texts.select(F.monotonically_increasing_id().alias("node"), "least", "fp"), "nodes")
    links = similar_links(nodes.select("node", "fp"), code)
    linked = components(links)
    roots = nodes.join(linked, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    stay = saved(roots.groupBy("root").agg(F.min("least").alias("least")).select("least.key", "least.copies"), "stay")
    for df in (rows, nodes, links):
        drop_saved(df)
    ids = stay.select(F.col("key.id").alias("_stay_id"), F.col("key.hash").alias("_stay_hash"))
    kept = docs.join(ids, col(id_col).eqNullSafe(F.col("_stay_id")) & (F.xxhash64(col(text_col)) == F.col("_stay_hash")), "left_semi")
    return kept if stay.where("copies > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])
