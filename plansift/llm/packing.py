"""Packing documents into training windows by the sum-of-squares rule, online.

Each task packs its own documents as they come.  A level array counts the partly filled windows at each fill level,
and a document's tail goes to the level where the sum of the squared counts becomes least.  Documents longer than a
window first give whole windows.  At the end of a task the windows still open are closed by cutting: the emptiest
one's pieces fill the gaps of the others, and what is left is laid out in windows of power-of-two sizes, which need
no padding.

Scale: no shuffle and no state between tasks; a task's memory is one Arrow batch and its open windows (at most a few
per level).  Sequence ids carry the task's partition number, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plansift.llm.common import col

WINDOW, END = 2048, 1
Piece = tuple[int, int, int]  # document, start, length


def added_tokens(ranks_path: str) -> dict[str, int]:
    """The tokens that the ``tokenizers`` file beside the ranks adds to them; none where there is no such file."""
    path = Path(ranks_path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(path.read_text("utf-8"))["added_tokens"]} if path.exists() else {}


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """Byte-level BPE ids of a whole text; ``added`` tokens in it have their own ids, as ``tokenizers`` gives them.

    The ranks are the same vocabulary as the ``tokenizers`` file beside them, with the same ids (see the tests), and
    encode several times faster.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = added or {}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if any(t in text for t in added) else encoding.encode_ordinary(text)

    return encode


class Packer:
    """Online sum-of-squares packing of one stream of documents."""

    def __init__(self, first_id: int, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        self.level = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.open: dict[int, list[tuple[int, list[Piece]]]] = {}

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def best(self, size: int) -> int:
        """The level (0: a new window) whose use leaves the least sum of squared counts; ties to the fullest."""
        n, w = self.level, self.window
        after = n[size:w] * 2 + 1  # the level that it moves to gains one; a full window leaves the array
        cost = np.append(after, 0)
        cost[1:] += np.where(n[1 : w - size + 1] > 0, 1 - 2 * n[1 : w - size + 1], 4 * w * w)
        return int(w - size - np.argmin(cost[::-1]))

    def add(self, doc: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Pieces (document, start, length, sequence, offset) of windows that this document completes."""
        start = 0
        while size - start >= self.window:
            yield doc, start, self.window, self._new(), 0
            start += self.window
        if (rest := size - start) > 0:
            level = self.best(rest)
            if level:
                seq, pieces = self.open[level].pop()
                self.level[level] -= 1
            else:
                seq, pieces = self._new(), []
            pieces.append((doc, start, rest))
            if level + rest == self.window:
                yield from self.lay(seq, pieces)
            else:
                self.level[level + rest] += 1
                self.open.setdefault(level + rest, []).append((seq, pieces))

    @staticmethod
    def lay(seq: int, pieces: list[Piece]) -> Iterator[tuple[int, int, int, int, int]]:
        at = 0
        for doc, start, length in pieces:
            yield doc, start, length, seq, at
            at += length

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Close the open windows: fill the fullest from the emptiest, then cut the rest into powers of two."""
        left = [(level, seq, pieces) for level, ws in sorted(self.open.items()) for seq, pieces in ws]
        lo, hi = 0, len(left) - 1
        while lo < hi:
            level, seq, pieces = left[hi]
            need = self.window - level
            while need and lo < hi:
                have, other, source = left[lo]
                doc, start, length = source.pop()
                take = min(need, length)
                pieces.append((doc, start + length - take, take))
                if take < length:
                    source.append((doc, start, length - take))
                need -= take
                left[lo] = (have - take, other, source)
                if have == take:
                    lo += 1
            if need:
                left[hi] = (self.window - need, seq, pieces)
                break
            yield from self.lay(seq, pieces)
            hi -= 1
        if lo == hi:
            level, seq, pieces = left[lo]
            while level:
                size = 1 << (level.bit_length() - 1)
                level -= size
                part = []
                while size:
                    doc, start, length = pieces.pop(0)
                    take = min(size, length)
                    part.append((doc, start, take))
                    if take < length:
                        pieces.insert(0, (doc, start + take, length - take))
                    size -= take
                yield from self.lay(seq, part)
                seq = self._new() if level else seq
        self.open.clear()


def default_tokenizer() -> tuple[str, str]:
    """Path and pre-tokeniser pattern of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None, window: int = WINDOW, end_id: int = END) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    A document is its text's ids and then ``end_id``; each id lies in exactly one piece.  A null or empty text is its
    end id alone; null ids and repeated rows are documents like any other; a very long text is many whole windows and a
    tail, its ids in memory one document at a time; equal fill levels are told apart by their order; an empty table gives
    an empty one; other columns are not read.
    """
    path, pattern = tokenizer or default_tokenizer()
    added = added_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path, pattern, added), Packer(TaskContext.get().partitionId() << 40, window)
        waiting: dict[int, tuple] = {}  # documents with a tail in an open window: id, ids of the tail, its start, size
        count, kind = 0, None
        for b in batches:
            kind, rows = b.column("id").type, []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = np.array([*encode(text or ""), end_id], "<u4")
                whole = tokens.size - tokens.size % window
                waiting[count] = (doc, tokens, 0, tokens.size)
                rows += _rows(packer.add(count, tokens.size), waiting)
                if whole == tokens.size:
                    waiting.pop(count, None)
                elif count in waiting:
                    waiting[count] = (doc, tokens[whole:].copy(), whole, tokens.size)
                count += 1
            yield _batch(rows, kind, id_col)
        if count:
            yield _batch(_rows(packer.finish(), waiting), kind, id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _rows(pieces: Iterator[tuple[int, int, int, int, int]], waiting: dict[int, tuple]) -> list[tuple]:
    out = []
    for n, start, length, seq, at in pieces:
        doc, tokens, base, size = waiting[n]
        part = tokens[start - base : start - base + length]
        out.append((doc, start, length, zlib.crc32(part.tobytes()), size, seq, at))
        if start == base and start + length == size:
            del waiting[n]  # the whole tail is laid; what finish() cuts stays until the task ends
    return out


def _batch(rows: list[tuple], kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

