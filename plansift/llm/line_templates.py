"""Line dedup with a log-template tree.

Lines are parsed to a fixed depth: by token count, then by their leading tokens; a token with a digit is a variable
field.  In a leaf, a token that many lines have at the same position is constant there, any other is a variable field,
so lines that differ in fields share a template.  Templates that recur across documents are dropped, if enough of
their tokens are constant.

Across documents: a template counts once for each document, however often it stands there, and documents are told
apart by sketches, the least hashes of their five-word shingles (eight, by different orders, whose counts are
averaged).  Equal texts have equal sketches, and so have most near copies of a text, which are left to near-duplicate
detection: a template recurs if it stands under ten sketches or more and these are an eighth of its different texts or
more (of the copies of one text about one in twenty have a sketch of their own).  Documents that share a notice
but have a text of their own mostly have sketches of their own.

Scale: lines are hashes until a leaf is known to recur; all counts combine before the shuffle.  The dropped lines
are broadcast only where they are few, else they are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.llm.common import bit_filter, col, drop_saved, in_filter, saved

DEPTH = 3
SHINGLE = 5
LEAST_TOKENS = 1
LEAST_DOCS = 10
OWN = 0.125
#: Odd multipliers: each puts the hashes in another order.
ORDERS = np.array([2 * k * 0x4F1BBCDCBFA53E0B + 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(8)], np.uint64)
CONSTANT = 0.6
FEW = 1_000_000
FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def parsed(text: str | None, depth: int = DEPTH) -> list[tuple[int, list[bytes]] | None]:
    """(leaf, tokens with variable fields masked) of each line, None for lines without tokens."""
    out: list[tuple[int, list[bytes]] | None] = []
    for line in (text or "").encode().split(b"\n"):
        tokens = line.split()
        if tokens and DIGIT.search(line):
            tokens = [FIELD if DIGIT.search(t) else t for t in tokens]
        out.append((_hash(b"%d " % len(tokens) + b" ".join(tokens[:depth])), tokens) if tokens else None)
    return out


def sketches(text: str | None) -> list[int]:
    """For each order the least hash of the text's word shingles (of all its words, if it has too few)."""
    words = (text or "").encode().split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = max(1, own.size - SHINGLE + 1)
    h = np.zeros(runs, np.uint64)
    for k in range(min(SHINGLE, own.size)):
        h = (h ^ own[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return [int((h * order).min().view(np.int64)) for order in ORDERS]


def _leaves(depth: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, docs = [], []
            for text in b.column("text").to_pylist():
                own = {leaf for leaf, tokens in filter(None, parsed(text, depth)) if len(tokens) >= least}
                leaves += own
                docs += [_hash((text or "").encode())] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(docs, pa.int64())], ["leaf", "doc"])

    return run


def _lines(depth: int, least: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column("text").to_pylist():
                own = {_hash(b" ".join(tokens)): (leaf, tokens) for leaf, tokens in filter(None, parsed(text, depth)) if len(tokens) >= least}
                passed = in_filter(bits, np.array([leaf for leaf, _ in own.values()], np.int64))
                if passed.any():
                    doc, places = _hash((text or "").encode()), sketches(text)
                    rows += [(leaf, doc, line, places, tokens) for (line, (leaf, tokens)), ok in zip(own.items(), passed, strict=True) if ok]
            lead = [sum(t != FIELD for t in r[4][:depth]) for r in rows]
            rest = [[_hash(t) if t != FIELD else None for t in r[4][depth:]] for r in rows]
            cols = [*([r[k] for r in rows] for k in range(3)), [len(r[4]) for r in rows], lead]
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (rest, [r[3] for r in rows])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *lists], ["leaf", "doc", "line", "size", "lead", "rest", "places"])

    return run


def recurring_lines(
    docs: DataFrame, text_col: str = "text", depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS, constant: float = CONSTANT
) -> DataFrame:
    """(``line``, ``template``): masked lines whose template stands in ``least_docs`` documents or more, copies as one."""
    texts = docs.select(col(text_col).cast("string").alias("text"))
    many = F.col("n") >= least_docs
    leaves = texts.mapInArrow(_leaves(depth, least_tokens), "leaf long, doc long").distinct()
    bits = bit_filter(leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(many), "leaf")
    schema = "leaf long, doc long, line long, size long, lead long, rest array<long>, places array<long>"
    rows = saved(texts.mapInArrow(_lines(depth, least_tokens, bits), schema), "lines")
    places = saved(rows.select("line", "doc", "places").dropDuplicates(["line", "doc"]), "places")
    weight = places.groupBy("line").agg(F.count("*").alias("n"))
    shapes = saved(rows.select("leaf", "line", "size", "lead", "rest").dropDuplicates(["line"]).join(weight, "line"), "shapes")
    tokens = shapes.select("leaf", "line", "n", F.posexplode("rest").alias("pos", "token")).where(F.col("token").isNotNull())
    often = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n")).where(many).drop("n")
    fixed = tokens.join(often, ["leaf", "pos", "token"], "left_semi").groupBy("line").agg(F.bit_xor(F.xxhash64("pos", "token")).alias("mark"), F.count("*").alias("fixed"))
    solid = F.col("lead") + F.coalesce("fixed", F.lit(0)) >= F.col("size") * constant
    named = saved(shapes.join(fixed, "line", "left").where(solid).select("line", F.xxhash64("leaf", F.coalesce("mark", F.lit(0))).alias("template")), "templates")
    stands = named.join(places, "line").dropDuplicates(["template", "doc"]).select("template", F.posexplode("places").alias("order", "place"))
    counts = stands.groupBy("template", "order", "place").agg(F.count("*").alias("docs")).groupBy("template").agg(F.count("*").alias("n"), F.sum("docs").alias("docs"))
    spread = counts.where((F.col("n") >= least_docs * len(ORDERS)) & (F.col("n") >= F.col("docs") * OWN))
    out = saved(named.join(spread, "template", "left_semi").select("line", "template"), "recurring")
    for df in (rows, places, shapes, named):
        drop_saved(df)
    return out


def _cut(text: str | None, gone) -> tuple[str | None, int, int]:
    """The text without its dropped lines, the number of its lines with tokens and of those dropped."""
    if text is None:
        return None, 0, 0
    kept, lines, dropped = [], 0, 0
    for raw, line in zip(text.split("\n"), parsed(text), strict=True):
        lines += line is not None
        if line is not None and _hash(b" ".join(line[1])) in gone:
            dropped += 1
        else:
            kept.append(raw)
    return ("\n".join(kept) if dropped else text), lines, dropped


def _candidates(b: pa.RecordBatch) -> tuple[list[int], list[int]]:
    uids, lines = [], []
    for uid, text in zip(b.column("uid").to_pylist(), b.column("text").to_pylist(), strict=True):
        own = {_hash(b" ".join(x[1])) for x in parsed(text) if x}
        uids += [uid] * len(own)
        lines += own
    return uids, lines


def drop_recurring(docs: DataFrame, text_col: str = "text", few: int = FEW, **options) -> DataFrame:
    """``docs`` with its recurring template lines taken out of the text, and ``n_lines`` and ``n_dropped`` (long) added.

    All other columns stay, and every row: a text may become empty.  Lines are told apart by their tokens, so white
    space at a line's ends does not matter.  Null texts stay null with counts of 0; blank lines stay, and lines of
    fewer than ``least_tokens`` tokens; a line that only one document repeats stays; rows that repeat a text count
    once; an empty table gives an empty one.  The added columns replace any of the same name.
    """
    gone = recurring_lines(docs, text_col, **options)
    whole = F.struct(*(col(c) for c in docs.columns)).alias("whole")  # names that clash with ours stay apart
    rows = docs.select(whole, col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["whole"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if gone.count() <= few:
        lines = frozenset(r["line"] for r in gone.select("line").collect())

        def few_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _rewritten(b, [_cut(t, lines) for t in b.column("text").to_pylist()])

        done = rows.mapInArrow(few_lines, schema)
    else:

        def own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                uids, lines = _candidates(b)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(lines, pa.int64())], ["uid", "line"])

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True)
                yield _rewritten(b, [_cut(t, frozenset(g or ())) for t, g in own])

        texts = rows.select(F.xxhash64("text").alias("uid"), "text")
        pairs = texts.mapInArrow(own_lines, "uid long, line long").distinct().join(gone.select("line"), "line", "left_semi")
        lists = pairs.groupBy("uid").agg(F.collect_set("line").alias("gone"))  # at most a text's lines
        done = rows.join(lists, F.xxhash64("text") == F.col("uid"), "left").select("whole", "text", "gone").mapInArrow(listed, schema)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    back = [F.col("text").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in names]
    return done.select(*back, "n_lines", "n_dropped")


def _rewritten(b: pa.RecordBatch, cut: list[tuple[str | None, int, int]]) -> pa.RecordBatch:
    """The batch with the text cut, and the two counts."""
    kinds = (pa.string(), pa.int64(), pa.int64())
    cols = [pa.array([c[n] for c in cut], kind) for n, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([b.column("whole"), *cols], ["whole", "text", "n_lines", "n_dropped"])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return drop_recurring(docs.select("doc_id", "text"))
