"""Substring dedup with repeated-phrase automata.

A passage is a window of 35 words.  Of the 8-word phrases in a window the one with the least hash stands for it (its
anchor), so equal windows have equal anchors and about one phrase in fourteen is one.

1. Confirm: anchors are counted over all documents; those found twice or more are the recurring phrases.
2. Locate: all documents stream through Aho-Corasick automata of the recurring phrases, compiled for one portion of
   the documents after the other, which find every occurrence by its words.  An occurrence stands for a stretch: the
   words of all windows whose anchor it is.
3. A phrase whose stretches are all alike recurs with them whole.  For the others, where copies begin, end or differ,
   windows are compared one by one.  Both by 128 bits of hash, which equal for different words once in 2**128.
4. Words covered by a recurring window go.

Scale: texts stay where they are until the last join; between, rows are anchors of recurring phrases.  Counts combine
before the shuffle, and keys with many rows are broadcast, so a passage that a third of all documents share is no hot
group.  The two filters sent to the tasks have a fixed size and only spare work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import bit_filter, col, drop_saved, in_filter, saved

WINDOW, PHRASE = 35, 8
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd: they have inverses modulo 2**64
PORTION = 4_000_000
HEAVY, FEW = 20_000, 100_000


class _Powers:
    """Powers of a base and of its inverse, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(self.base, -1, 1 << 64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(self.base)))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, inverse))])
        return self.up[:n], self.down[:n]


_powers = [_Powers(base) for base in BASES]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return x ^ x >> np.uint64(27)


class Runs:
    """Hashes of runs of words of one document: 64 bits to find candidates, 128 (two lanes of 64) to decide."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.lanes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        if lane not in self.lanes:
            up, down = _powers[lane](self.n + 1)
            self.lanes[lane] = np.concatenate([[np.uint64(0)], np.cumsum(self.own[:, lane] * up[: self.n], dtype=np.uint64)]), down
        sums, down = self.lanes[lane]
        return _mixed((sums[ends] - sums[starts]) * down[starts])

    def sized(self, size: int) -> np.ndarray:
        starts = np.arange(max(0, self.n - size + 1))
        return self.hashes(starts, starts + size)


class Anchors(NamedTuple):
    """Of each anchor occurrence: the phrase's place and hash, and its first and last window."""

    place: np.ndarray
    phrase: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(runs: Runs, window: int = WINDOW, size: int = PHRASE) -> Anchors:
    """For each window the leftmost of its phrases with the least hash; windows in a row with one anchor together."""
    h = runs.sized(size)
    n = runs.n - window + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return Anchors(none, none.view(np.uint64), none, none)
    span = window - size + 1
    at, reach = np.arange(h.size), 1
    while 2 * reach <= span:
        left, right = at[:-reach], at[reach:]
        at = np.where(h[left] <= h[right], left, right)
        reach *= 2
    left, right = at[:n], at[span - reach : span - reach + n]
    at = np.where(h[left] <= h[right], left, right)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return Anchors(at[first], h[at[first]], first, last)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _portions(ids: list, texts: list) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(uid, words) of documents, some megabytes of text at a time."""
    part, size = [], 0
    for uid, text in zip(ids, texts, strict=True):
        part.append((uid, _words(text)))
        size += len(text or "")
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def _table(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64)) for c in cols], names)


def _count_anchors(window: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(anchors(Runs(_words(t)), window, size).phrase,) for t in b.column("text").to_pylist()]
            yield _table(["phrase"], parts)

    return run


def located(part: list[tuple[int, list[bytes]]], recurring: Callable[[np.ndarray], np.ndarray], window: int, size: int) -> Iterator[tuple[int, Runs, Anchors]]:
    """Documents of a portion with the anchors whose phrases an automaton of the recurring phrases finds in them."""
    known, automaton = [], ahocorasick.Automaton()
    for uid, words in part:
        runs = Runs(words)
        a = anchors(runs, window, size)
        known.append((uid, words, runs, a))
        for p in a.place[recurring(a.phrase)].tolist():
            automaton.add_word(" " + b" ".join(words[p : p + size]).decode() + " ", p)
    if not len(automaton):
        return
    automaton.make_automaton()
    for uid, words, runs, a in known:
        text = " " + b" ".join(words).decode() + " "
        ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
        if ends.size:
            # the space after word w lies at the sum of the lengths up to w, plus w + 1
            stops = np.cumsum([len(w) + 1 for w in text[1:-1].split(" ")])
            place = np.searchsorted(stops, ends) - size + 1
            own = np.isin(a.place, place)
            if own.any():
                yield uid, runs, Anchors(*(x[own] for x in a))


def _spans_table(hashed: str, rows: list[tuple]) -> pa.RecordBatch:
    """Per document (uid, phrases or None, starts, stops, two lanes of hashes) as rows."""
    names = ["phrase"] * (hashed == "stretch") + ["uid", "start", "stop", "x", "y"]
    count = [len(r[2]) for r in rows]
    uid = pa.array([r[0] for r in rows], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), count)))
    whole = lambda k: np.concatenate([r[k] for r in rows]) if rows else np.empty(0, np.int64)
    as_long = lambda x: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())
    cols = [uid, *(pa.array(whole(k), pa.int32()) for k in (2, 3)), *(as_long(whole(k)) for k in (4, 5))]
    return pa.RecordBatch.from_arrays([as_long(whole(1)), *cols] if hashed == "stretch" else cols, names)


def _stretches(bits: np.ndarray, window: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _portions(b.column("uid").to_pylist(), b.column("text").to_pylist()):
                rows = []
                for uid, runs, a in located(part, lambda h: in_filter(bits, h), window, size):
                    offset = (a.place - a.first).astype(np.uint64)  # where in the stretch the phrase stands
                    whole = [runs.hashes(a.first, a.last + window, lane) + offset for lane in (0, 1)]
                    rows.append((uid, a.phrase, a.first, a.last + window, *whole))
                yield _spans_table("stretch", rows)

    return run


def _windows(bits: np.ndarray, window: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text").to_pylist(), strict=True):
                runs = Runs(_words(text))
                a = anchors(runs, window, size)
                found = in_filter(bits, a.phrase)
                if found.any():
                    starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a.first[found], a.last[found], strict=True)])
                    rows.append((uid, None, starts, starts + window, *(runs.hashes(starts, starts + window, lane) for lane in (0, 1))))
                if sum(len(r[2]) for r in rows) > 500_000:
                    yield _spans_table("window", rows)
                    rows = []
            yield _spans_table("window", rows)

    return run


def _uid(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text."""
    named = F.concat(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(col(text_col).cast("string"), F.lit("")))
    return F.unhex(F.md5(named.cast("binary")))


def _of_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys`` (with ``n``, the rows of each).

    Keys with many rows are few: they are broadcast, if checked to be, and only the others are joined by a shuffle.
    """
    heavy = saved(keys.where(F.col("n") > HEAVY).select(*on), "heavy")
    if not 0 < heavy.limit(FEW + 1).count() <= FEW:
        return rows.join(keys.select(*on), on, "left_semi")
    small = F.broadcast(heavy)
    rest = rows.join(small, on, "left_anti").join(keys.where(F.col("n") <= HEAVY).select(*on), on, "left_semi")
    return rows.join(small, on, "left_semi").unionAll(rest)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, size: int = PHRASE) -> DataFrame:
    """(``uid``, ``spans``): runs [start, stop) of words in windows that start at another place too, for documents with any."""
    texts = docs.select(_uid(id_col, text_col).alias("uid"), col(text_col).cast("string").alias("text"))
    phrases = texts.select("text").mapInArrow(_count_anchors(window, size), "phrase long")
    recurring = bit_filter(phrases.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1"), "phrase")
    found = saved(texts.mapInArrow(_stretches(recurring, window, size), "phrase long, uid binary, start int, stop int, x long, y long"), "stretches")
    both = F.struct("x", "y")
    stats = saved(found.groupBy("phrase").agg(F.count("*").alias("n"), F.min(both).alias("a"), F.max(both).alias("b")).where("n > 1"), "phrases")
    # a phrase's stretches are all alike if the least and the largest of their hashes are
    settled = _of_keys(found, stats.where("a = b"), ["phrase"]).select("uid", "start", "stop")
    mixed = bit_filter(stats.where("a <> b"), "phrase")
    single = saved(texts.mapInArrow(_windows(mixed, window, size), "uid binary, start int, stop int, x long, y long"), "windows")
    twice = single.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")
    confirmed = _of_keys(single, saved(twice, "twice"), ["x", "y"]).select("uid", "start", "stop")
    spans = settled.unionAll(confirmed).groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most one for each word
    out = saved(spans, "spans")
    for df in (found, stats, single):
        drop_saved(df)
    return out


def _kept(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, [s["start"] for s in spans], 1)
    np.add.at(cover, [s["stop"] for s in spans], -1)
    return [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]


def _joined(docs: DataFrame, id_col: str, text_col: str, window: int, size: int) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, window, size).select(F.col("uid").alias("_uid"), F.col("spans").alias("_spans"))
    return docs.join(spans, _uid(id_col, text_col) == F.col("_uid"), "left").drop("_uid")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, size: int = PHRASE) -> DataFrame:
    """(``id_col``, ``n_words``, ``n_removed``, ``text``) of every row: the text's words that no recurring window covers.

    A window recurs if its words, unchanged, also start anywhere else, in the same text or another; windows are judged
    on the input.  Kept words are joined by one space.  Null and empty texts, and those shorter than a window, lose
    nothing (a null text has no words); rows that are equal in id and text are two documents; an empty table gives an
    empty one; other columns are not read.
    """
    return _rewritten(docs, id_col, text_col, window, size, False)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op5: the kept text as its SHA-256."""
    return _rewritten(docs, "doc_id", "text", WINDOW, PHRASE, True)


def _rewritten(docs: DataFrame, id_col: str, text_col: str, window: int, size: int, hashed: bool) -> DataFrame:
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    name = "kept_sha256" if hashed else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, out = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                words = _words(text)
                kept = _kept(words, spans)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                body = b" ".join(kept)
                out.append(hashlib.sha256(body).hexdigest() if hashed else body.decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [id_col, "n_words", "n_removed", name])

    kind = docs.schema[id_col].dataType.simpleString()
    return _joined(rows, "id", "text", window, size).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, {name} string")
