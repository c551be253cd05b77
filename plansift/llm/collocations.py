"""Phrase collocations, counted in direct-address tiles.

Words are ranked by frequency, and a pair is a cell (rank of the first, rank of the second).  The cells are cut into
square tiles.  A portion of the texts counts its pairs tile by tile: a tile with many pairs by a dense ``bincount``, the
others as sorted coordinates.  Frequent pairs are ranked in turn, and a phrase of three words is a cell (rank of its
first pair, rank of its last word); so on for longer ones.

A phrase can reach the least count only if all its parts do, so rarer words and phrases are left out of the next count.
The ranks that tasks hold are bounded (`RANKED` words, `RANKED_PHRASES` phrases of each length); words and phrases that
are frequent but not ranked go by their text through the same counts, after a filter of fixed size that only spares work.
The filter is asked by keys that follow from those of the parts: a phrase becomes text only once it has passed and is counted.

Scale: texts are read once per phrase length and never shuffled.  Counts of a portion are combined in the task and then
summed by cell, so a frequent word or pair is one row a portion; candidates meet the counts of their parts in equi-joins.

Stated results: null texts and texts without words count nothing; a null language is ``und``; rows that repeat count as
often as they stand there; an empty table gives no rows.  Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plansift.llm.common import bit_filter, col, in_filter, saved

LEAST, TOP, LONGEST, SUBSUMED = 10, 2000, 3, 50
RANKED, RANKED_PHRASES, LONG_WORD = 1 << 18, 1 << 20, 64
#: Bits of a rank within a tile, the pairs that make a tile dense, the bytes of text counted at a time, the different
#: cells that a task sums up before it passes them on, and the rows of a batch that become Python objects at a time.
SIDE, DENSE, PORTION, CELLS, ROWS = 10, 1 << 14, 4_000_000, 500_000, 256

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t", b"." * len(_BREAKS) + b" ")


def tokens(texts: Iterable[bytes]) -> pa.DictionaryArray:
    """Words of the texts in order; ``.`` stands between pieces and texts (no word has one)."""
    raw = b".".join(texts).lower().translate(_TABLE).replace(b".", b" . ")
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)])
    words = pc.ascii_split_whitespace(one).flatten()
    return words.filter(pc.not_equal(words, "")).dictionary_encode()


def tile_counts(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs as ``first << 32 | second`` and how often each occurs; ranks are at least 0 and under 2**31."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = np.int64((1 << SIDE) - 1)
    tile = (first >> SIDE) << 32 | (second >> SIDE)
    order = np.argsort(tile, kind="stable")
    tile, cell = tile[order], ((first & side) << SIDE | (second & side))[order]
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    stops = np.r_[starts[1:], len(tile)]
    codes, counts, sparse = [], [], np.ones(len(tile), bool)
    for lo, hi in zip(*((x[stops - starts >= DENSE]) for x in (starts, stops)), strict=True):
        dense = np.bincount(cell[lo:hi], minlength=1 << 2 * SIDE)
        hit = np.flatnonzero(dense)
        codes.append(((tile[lo] >> 32 << SIDE) + (hit >> SIDE)) << 32 | ((tile[lo] & 0xFFFFFFFF) << SIDE) + (hit & side))
        counts.append(dense[hit])
        sparse[lo:hi] = False
    rest, n = np.unique((first << 32 | second)[order[sparse]], return_counts=True)
    return np.concatenate([*codes, rest]), np.concatenate([*counts, n])


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates of several counts, added up."""
    code, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.add.reduceat(n[order], starts) if len(code) else n


class Ranks(NamedTuple):
    """The ranked words or phrases of one length in one language, and the filter of those that have no rank."""

    words: pa.Array | None  # of length one: words by rank
    codes: np.ndarray  # of longer ones: cells in order, ...
    rank: np.ndarray  # ... and their ranks
    more: np.ndarray | None  # bits of the frequent ones without a rank, if any
    keys: np.ndarray = np.zeros(0, np.uint64)  # of length one: hashes of the words by rank

    @property
    def n(self) -> int:
        return len(self.rank) if self.words is None else len(self.words)


_LOW = 0xFFFFFFFF
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def chained(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit integers, each with its seed: how ``xxhash64`` goes on from one column to a long one."""
    p1, p2, p3, p4, p5 = _PRIMES
    turned = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    h = (seeds + (p5 + np.uint64(8))) ^ turned(keys * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()], np.uint64)


def _key(size: int) -> Column:
    """The key of a phrase, the same as `Portion.keys`: language and hashes of its words, one after the other."""
    words = F.split("phrase", " ", -1)
    return F.xxhash64("lang", *(F.xxhash64(words[k]) for k in range(size)))


class Portion:
    """Word and phrase ids of some texts in one language: ranks, and beyond them ids of this portion's own texts."""

    def __init__(self, lang: str, texts: list[bytes], levels: list[Ranks]) -> None:
        self.lang, self.levels = lang, levels
        self.seed = np.array([xxhash.xxh64_intdigest(lang, 42)], np.uint64)
        words, ranks = tokens(texts), levels[0]
        names = words.dictionary
        ids = pc.index_in(names, ranks.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lost = np.flatnonzero(ids < 0)
        #: By id, beyond the ranks: texts of words, cells of longer phrases.
        self.own: list = [names.slice(0, 0)]
        self.hashes = ranks.keys
        if ranks.more is not None and len(lost):
            left = names.take(pa.array(lost))
            hashes = _hashes(left)
            real = pc.not_equal(left, ".").to_numpy(zero_copy_only=False)
            found = np.flatnonzero(in_filter(ranks.more, chained(hashes, self.seed)) & real)
            ids[lost[found]] = ranks.n + np.arange(len(found))
            self.own[0] = left.take(pa.array(found))
            self.hashes = np.concatenate([ranks.keys, hashes[found]])
        self.words = ids.astype(np.int32)[words.indices.to_numpy()]
        self.phrases = [self.words]
        for _ in levels[1:]:
            self._next()

    def _cells(self, level: int, ids: np.ndarray) -> np.ndarray:
        """The first parts and last words of phrases, by their ids."""
        ranks = self.levels[level]
        by_rank = np.empty(ranks.n + len(self.own[level]), np.int64)
        by_rank[ranks.rank], by_rank[ranks.n :] = ranks.codes, self.own[level]
        return by_rank[ids]

    def keys(self, level: int, code: np.ndarray) -> np.ndarray:
        """Keys of phrases of this level: of words by their ids, of longer ones by their cells."""
        if level == 0:
            return chained(self.hashes[code], self.seed)
        first = code >> 32
        return chained(self.hashes[code & _LOW], self.keys(level - 1, self._cells(level - 1, first) if level > 1 else first))

    def texts(self, level: int, code: np.ndarray) -> pa.Array:
        """The words of phrases of this level, told as in `keys`."""
        if level == 0:
            return pa.concat_arrays([self.levels[0].words, self.own[0]]).take(pa.array(code))
        first = code >> 32
        parts = self.texts(level - 1, self._cells(level - 1, first) if level > 1 else first), self.texts(0, code & _LOW)
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where phrases one word longer than the longest so far may stand, their first parts and last words."""
        size = len(self.phrases)
        parts = self.phrases[-1]
        if len(self.words) <= size:
            none = np.zeros(0, np.int64)
            return none, none, none
        first, then, last = parts[:-size], parts[1 : len(parts) - size + 1], self.words[size:]
        at = np.flatnonzero((first >= 0) & (then >= 0) & (last >= 0))
        return at, first[at].astype(np.int64), last[at].astype(np.int64)

    def _next(self) -> None:
        level = len(self.phrases)
        ranks = self.levels[level]
        at, first, last = self.pairs()
        code = first << 32 | last
        known, ids = np.zeros(len(code), bool), np.full(len(code), -1, np.int64)
        if len(ranks.codes):
            order = np.argsort(code)  # in order, neighbouring cells are looked up in memory just read
            asked = code[order]
            found = np.minimum(np.searchsorted(ranks.codes, asked), len(ranks.codes) - 1)
            hit = ranks.codes[found] == asked
            known[order] = hit
            ids[order[hit]] = ranks.rank[found[hit]]
        self.own.append(np.zeros(0, np.int64))
        if ranks.more is not None:
            left = np.flatnonzero(~known)
            left = left[in_filter(ranks.more, self.keys(level, code[left]))]
            self.own[level], back = np.unique(code[left], return_inverse=True)
            ids[left] = ranks.n + back
        out = np.full(len(self.words), -1, np.int32)
        out[at] = ids
        self.phrases.append(out)

    def counts(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[pa.Array, np.ndarray]]:
        """Cells of ranked parts with their counts, and the texts of the other phrases with theirs."""
        _, first, last = self.pairs()
        code, n = tile_counts(first, last)
        ranked = ((code >> 32) < self.levels[-1].n) & ((code & _LOW) < self.levels[0].n)
        return (code[ranked], n[ranked]), (self.texts(len(self.phrases), code[~ranked]), n[~ranked])


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, of about ``size`` bytes together (one text may be longer)."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):  # few texts of a batch become Python objects at a time
            some = b.slice(lo, ROWS)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                total += len(text)
                if total >= size:
                    while held:
                        yield held.popitem()
                    total = 0
        some = lang = text = b = None  # not held while the next batch comes
    while held:
        yield held.popitem()


COUNTS = "lang string, code long, phrase string, n long"


def _rows(lang: str, code: pa.Array, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, code, phrase, n.cast(pa.int64())], ["lang", "code", "phrase", "n"])


def _count_words(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _portions(batches, size):
            words = tokens(texts)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            real = pc.not_equal(words.dictionary, ".")
            names, n = words.dictionary.filter(real).cast(pa.string()), n[real.to_numpy(zero_copy_only=False)]
            names = pa.concat_arrays([names, pa.nulls(1, pa.string())])  # the null phrase counts all words
            yield _rows(lang, pa.nulls(len(names), pa.int64()), names, pa.array(np.r_[n, n.sum()]))

    return run


def _count_phrases(levels, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = levels.value
        runs: dict[str, list] = {}

        def passed_on(least: int) -> Iterator[pa.RecordBatch]:
            for lang in list(runs):
                runs[lang] = [merged(runs[lang])]
            if sum(len(r[0][0]) for r in runs.values()) > least:
                for lang, [(code, n)] in runs.items():
                    for lo in range(0, len(code), 1 << 16):
                        cut = slice(lo, lo + (1 << 16))
                        yield _rows(lang, pa.array(code[cut]), pa.nulls(len(code[cut]), pa.string()), pa.array(n[cut]))
                runs.clear()

        for lang, texts in _portions(batches, size):
            ranked, (others, n) = Portion(lang, texts, [_of(x, lang, k) for k, x in enumerate(held)]).counts()
            if len(others):
                yield _rows(lang, pa.nulls(len(others), pa.int64()), others.cast(pa.string()), pa.array(n))
            runs.setdefault(lang, []).append(ranked)
            if sum(len(code) for r in runs.values() for code, _ in r) > 2 * CELLS:
                yield from passed_on(CELLS)
        yield from passed_on(-1)

    return run


def _of(level: tuple[dict, np.ndarray | None], lang: str, k: int) -> Ranks:
    ranked, more = level
    none = np.zeros(0, np.int64)
    words, codes, rank, *keys = ranked.get(lang, (None if k else pa.array([], pa.large_string()), none, none))
    return Ranks(words, codes, rank, more, *keys)


def _name_phrases(levels) -> Callable:
    """Rows of `COUNTS` with cells: the words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = levels.value
        for b in batches:
            lang, code = b.column("lang"), b.column("code")
            for name in pc.unique(lang).to_pylist():
                mine = pc.equal(lang, name)
                own = b.filter(pc.and_(mine, pc.is_null(code)))
                yield _rows(name, own.column("code"), own.column("phrase"), own.column("n"))
                ranked = b.filter(pc.and_(mine, pc.is_valid(code)))
                ids, parts = ranked.column("code").to_numpy(), []
                for k in range(len(held) - 1, -1, -1):
                    parts.append(ids & 0xFFFFFFFF)
                    ids = ids >> 32
                    if k:
                        ranks = _of(held[k], name, k)
                        by_rank = np.empty_like(ranks.codes)
                        by_rank[ranks.rank] = ranks.codes
                        ids = by_rank[ids]
                words = _of(held[0], name, 0).words
                names = [words.take(pa.array(p)).cast(pa.string()) for p in [ids, *parts[::-1]]]
                yield _rows(name, ranked.column("code"), pc.binary_join_element_wise(*names, " "), ranked.column("n"))

    return run


def _most(table: DataFrame, limit: int) -> Column:
    """Which rows are the most frequent, no more than ``limit``: those over a count that a histogram of the counts gives."""
    step = F.floor(F.log2("n") * 16)
    left, least = limit, None
    for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).toLocalIterator():
        left -= r["rows"]
        if left < 0:
            return step >= least if least is not None else F.lit(False)
        least = r["step"]
    return F.lit(True)


def _ranks(table: DataFrame, n_rows: int, limit: int, size: int) -> tuple[dict, np.ndarray | None]:
    """Ranks for each language of phrases of ``size`` words: at most ``limit`` rows; the filter of those left out, if any."""
    words = size == 1
    ok = F.octet_length("phrase") <= LONG_WORD if words else F.col("code").isNotNull()
    most = ok & _most(table.where(ok), limit)
    got = table.where(most).select("lang", "phrase" if words else "code", "n").toArrow()
    out: dict[str, tuple] = {}
    for lang in pc.unique(got["lang"]).to_pylist():
        t = got.filter(pc.equal(got["lang"], lang)).sort_by([("n", "descending"), ("phrase" if words else "code", "ascending")])
        if words:
            names = t["phrase"].combine_chunks().cast(pa.large_string())
            out[lang] = (names, np.zeros(0, np.int64), np.zeros(0, np.int64), _hashes(names))
        else:
            codes = t["code"].to_numpy()
            order = np.argsort(codes)
            out[lang] = (None, codes[order], order)
    more = None if got.num_rows == n_rows else bit_filter(table.where(~most).select(_key(size).alias("h")), "h")
    return out, more


def phrase_counts(docs: DataFrame, least: int, longest: int, ranked: int, ranked_phrases: int, portion: int, lang_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and for each length the phrases found ``least`` times or more: ``lang, phrase, n``."""
    spark = docs.sparkSession
    rows = docs.where(col(text_col).isNotNull()).select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("string").alias("text"))
    summed = lambda df, by: df.groupBy(*by).agg(F.sum("n").alias("n"))
    words = summed(rows.mapInArrow(_count_words(portion), COUNTS), ["lang", "phrase"])
    words = saved(words.where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    tables = [words.where("phrase IS NOT NULL")]
    levels = [_ranks(tables[0], tables[0].count(), ranked, 1)]
    for _ in range(longest - 1):
        held = spark.sparkContext.broadcast(levels)
        cells = summed(rows.mapInArrow(_count_phrases(held, portion), COUNTS), ["lang", "code", "phrase"]).where(F.col("n") >= least)
        named = saved(cells.select("lang", "code", "phrase", "n").mapInArrow(_name_phrases(held), COUNTS), "phrases")
        tables.append(named)
        if len(tables) < longest:
            levels = [*levels, _ranks(named, named.count(), ranked_phrases, len(tables))]
    return words.where("phrase IS NULL").select("lang", F.col("n").alias("total")), [t.select("lang", "phrase", "n") for t in tables]


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(tables: list[DataFrame]) -> DataFrame:
    """Phrases of two words and more: ``lang, phrase, size, a``, and ``l, r, score`` of their lowest-scoring cut.

    Counts below 10**16 keep the products within decimal's 38 digits.
    """
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    words = F.split("phrase", " ", -1)
    found = tables[1]
    for t in tables[2:]:
        found = found.union(t)
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", F.size("w").alias("size"), "k", _part(F.col("w"), 1, F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    left = every.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast(T.DecimalType(16, 0))
    both = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    both = both.select("lang", "phrase", "size", "a", "k", "l", "r", (F.lit(1_000_000).cast(T.DecimalType(7, 0)) * (wide("a") * wide("a"))).alias("over"), (wide("l") * wide("r")).alias("under"))
    both = both.withColumn("score", F.expr("over div under"))
    low = F.min(F.struct("score", "k", "l", "r")).alias("x")
    return both.groupBy("lang", "phrase", "size", "a").agg(low).select("lang", "phrase", "size", "a", "x.l", "x.r", "x.score")


def maximal(found: DataFrame, longest: int, subsumed: int = SUBSUMED) -> DataFrame:
    """Without the phrases inside a longer one that has ``subsumed`` percent of their occurrences or more."""
    if longest < 3:
        return found
    words = F.split("phrase", " ", -1)
    longer = found.where("size > 2").select("lang", "size", F.col("a").alias("most"), words.alias("w"))
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part(F.col("w"), i, m)))))
    inside = longer.select("lang", "most", at.alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return found.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed * F.col("a"))).drop("most")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, subsumed: int = SUBSUMED,
    ranked: int = RANKED, ranked_phrases: int = RANKED_PHRASES, portion: int = PORTION, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a, l, r`` are the occurrences of the phrase and of the two parts of its lowest-scoring cut, ``n`` all words of the
    language, ``score`` is ``a * a * 1000000 / (l * r)`` without its fraction.  Equal scores go by ``a``, then by phrase.
    """
    total, tables = phrase_counts(docs, least, longest, ranked, ranked_phrases, portion, lang_col, text_col)
    kept = maximal(saved(scored(tables), "scored"), longest, subsumed)
    best = (F.desc("score"), F.desc("a"), "phrase")
    # the best of each of many parts first: no task ranks all phrases of a language
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return some.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
