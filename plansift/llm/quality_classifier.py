"""Quality classifier as a sparse ensemble of rules.

1. Every text gives statistics (shares of symbols, capitals, repeated words and so on), computed once.
2. Boosted shallow trees on a bounded sample of labelled rows propose rules: each path from a root is a conjunction of
   conditions on statistics.
3. Logistic regression under an L1 penalty, its strength chosen on a fifth of the sample, keeps few rules with weights.
4. The weighted rules are compiled into one Spark column expression over the statistics, which scores every document.

Scale: one map over the texts; statistics of a fixed width are written once.  The fit sees at most ``sample`` labelled
documents (`SAMPLE`, chosen by a hash of the id, whatever the size of the corpus); scoring uses all rows.

Stated results: null and empty texts have all statistics zero and a score like any other; rows that repeat are scored
each; a null id is never labelled nor held out.  A document whose labels disagree or are null is not learnt from; of
rows that share an id one is learnt from.  Without labels of both kinds every score is the share of label 1 (a half
without any).  Learning uses no row whose ``crc32(doc_id) % 5`` is zero.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.llm.common import col, saved
from plansift.llm.quality_rules import FEATURES, text_features

SAMPLE, THRESHOLD = 6_000, 0.3
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 32, 0.15, 5
_DIGITS = b"0123456789"
_MARKS = b".,;:!?\"'()-"
COUNTS = (*FEATURES, "n_digits", "n_marks", "n_pipes", "n_bytes", "n_top", "longest")
STATISTICS = {
    "words": ("n_words", None), "lines": ("n_lines", None), "longest": ("longest", None), "word_size": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "pipes": ("n_pipes", "n_words"), "bangs": ("n_bangs", "n_words"), "marks": ("n_marks", "n_words"), "digits": ("n_digits", "word_chars"), "capitals": ("n_upper", "word_chars"),
    "wide": ("n_bytes", "word_chars"), "copied_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "ended_lines": ("n_ended", "n_lines"),
    "line_size": ("n_words", "n_lines"), "function_words": ("n_function", "n_words"), "different": ("n_distinct", "n_words"), "top_word": ("n_top", "n_words"),
}
#: A condition is (statistic, greater, threshold); a rule is a tuple of them, all of which must hold.
Rule = tuple[tuple[str, bool, float], ...]


def counts_of(text: str | None) -> tuple[int, ...]:
    """The values of `COUNTS` for one text."""
    raw = (text or "").encode()
    words = raw.split()
    without = lambda marks: len(raw) - len(raw.translate(None, marks))
    top = max(Counter(words).values(), default=0)
    return (*text_features(text), without(_DIGITS), without(_MARKS), raw.count(b"|"), sum(map(len, words)), top, max(map(len, words), default=0))


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [counts_of(t) for t in b.column(b.num_columns - 1).to_pylist()]
        values = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in values)], [*b.schema.names[:-1], *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the doubles of `STATISTICS` for every document."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_append, T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in COUNTS)]))
    of = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1)) if b else F.col(a)).cast("double")
    return counted.select("id", *(of(a, b).alias(k) for k, (a, b) in STATISTICS.items()))


def _remainder(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 5


class Model(NamedTuple):
    """Rules with their weights, and the constant."""

    rules: list[Rule]
    weights: list[float]
    constant: float

    def score(self) -> Column:
        """Probability of label 1, over columns named as in `STATISTICS`."""
        holds = lambda c: F.col(c[0]) > c[2] if c[1] else F.col(c[0]) <= c[2]
        terms = [F.when(functools.reduce(lambda a, b: a & b, map(holds, r)), w).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)]
        total = F.aggregate(F.array(*terms), F.lit(self.constant), lambda a, b: a + b) if terms else F.lit(self.constant)
        return 1 / (1 + F.exp(-total))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """For each column up to `BINS` - 1 thresholds between its values, at quantiles."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        above = np.sort(np.unique(c))
        nxt = above[np.minimum(np.searchsorted(above, q, side="right"), len(above) - 1)]
        out.append(np.unique(((q + nxt) / 2)[nxt > q]))
    return out


def _split(bins: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
    """Column and bin whose lower side gains most, or none."""
    width = bins.shape[1]
    at = (bins[rows] + np.arange(width) * BINS).ravel()
    hist = [np.bincount(at, np.repeat(w, width), width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
    gl, hl, nl = hist
    gt, ht, nt = (x[:, -1:] for x in hist)
    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
    gain = np.where((nl >= LEAST) & (nt - nl >= LEAST), gain, 0)
    best = int(gain.argmax())
    return divmod(best, BINS) if gain.flat[best] > 1e-9 else None


def _grow(bins: np.ndarray, rows: np.ndarray, every: np.ndarray, g: np.ndarray, h: np.ndarray, path: tuple, out: np.ndarray, found: list) -> None:
    """A tree on ``rows``: its paths to ``found``, its values for all rows to ``out``."""
    if path:
        found.append(path)
    cut = _split(bins, rows, g, h) if len(path) < DEPTH and len(rows) >= 2 * LEAST else None
    if cut is None:
        out[every] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        return
    f, b = cut
    for greater in (False, True):
        side = lambda r: r[(bins[r, f] > b) == greater]  # noqa: B023, E731
        _grow(bins, side(rows), side(every), g, h, (*path, (f, greater, b)), out, found)


def paths(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list[tuple[tuple[int, bool, float], ...]]:
    """Different paths of boosted trees, as conditions on columns, the tightest for each side of a column."""
    edges = _edges(x)
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    rng, score = np.random.default_rng(0), np.zeros(len(y))
    found: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out = np.zeros(len(y))
        _grow(bins, rng.permutation(len(y))[: max(len(y) // 2, 2 * LEAST)], np.arange(len(y)), y - p, p * (1 - p), (), out, found)
        score += out
    rules: dict[tuple, None] = {}
    for path in found:
        tight: dict[tuple[int, bool], int] = {}
        for f, greater, b in path:
            tight[f, greater] = (max if greater else min)(tight.get((f, greater), b), b)
        rules[tuple(sorted((f, greater, float(edges[f][b])) for (f, greater), b in tight.items()))] = None
    return list(rules)


def _holds(rules: list, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for f, greater, t in rule:
            out[:, k] *= (x[:, f] > t) == greater
    return out


def lasso(r: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights and constant of logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    r1 = np.c_[r, np.ones(len(r), np.float32)].astype(np.float32)
    v = np.ones(r1.shape[1], np.float32)
    for _ in range(20):
        v = r1.T @ (r1 @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / float(np.linalg.norm(r1.T @ (r1 @ v)) + 1e-12) / 1.05
    w, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(r1 @ ahead.astype(np.float32)).astype(np.float64))) - y
        step = ahead - rate * (r1.T @ off.astype(np.float32)) / len(y)
        new = np.r_[np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * strength, 0), step[-1]]
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        moved = float(np.abs(new - w).max())
        ahead, w = new + (last - 1) / t * (new - w), new
        if moved < 1e-4:
            break
    return w


def _loss(r: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = r @ w[:-1] + w[-1]
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_rows(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """The model of a sample: statistics, labels 0 and 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Model([], [], math.log(share / (1 - share)))
    if len(y) < 4 * LEAST or not 0 < y.sum() < len(y):
        return flat
    held = np.arange(len(y)) % 5 == 0
    rules = paths(x, y)
    r = _holds(rules, x)
    used = np.flatnonzero((r.sum(axis=0) >= LEAST) & (r.sum(axis=0) <= len(y) - LEAST))
    if not len(used):
        return flat
    _, first = np.unique(np.packbits(r[:, used].astype(bool), axis=0), axis=1, return_index=True)  # rules alike on all rows
    used = used[np.sort(first)]
    r, rules = r[:, used], [rules[k] for k in used]
    most = float(np.abs(r.T @ (y - y.mean())).max()) / len(y)
    w, best = np.r_[np.zeros(len(rules)), math.log(share / (1 - share))], (math.inf, most)
    for k in range(1, 9):
        w = lasso(r[~held], y[~held], most * 0.5**k, w)
        best = min(best, (_loss(r[held], y[held], w), most * 0.5**k))
    w = lasso(r, y, best[1], w)
    kept = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return Model([tuple((names[f], g, t) for f, g, t in rules[k]) for k in kept], [float(w[k]) for k in kept], float(w[-1]))


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, those of the least hashes of their ids."""
    rows = labels.select(col(id_col).alias("id"), col(label_col).cast("double").alias("y")).where(F.col("id").isNotNull() & (_remainder(F.col("id")) != 0))
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most"), F.count("y").alias("n"), F.count("*").alias("all"))
    rows = rows.where((F.col("y") == F.col("most")) & (F.col("n") == F.col("all")) & F.col("y").isin(0.0, 1.0)).select("id", "y")
    # ids alone first, about twice as many as wanted, so that few are sorted
    place, span = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), 1 << 40
    rows = rows.join(stats.select("id").distinct(), "id", "left_semi")
    n = rows.count()
    upto = span if n <= sample else min(span, int(span * (2 * sample + 100) / n))
    chosen = rows.where(place < upto).orderBy(place, "id").limit(sample)
    got = stats.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s")).orderBy("id").select("y", "s.*").toArrow()
    x = np.stack([got[c].to_numpy() for c in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit_rows(x, got["y"].to_numpy(), list(STATISTICS))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    stats = saved(statistics(docs, id_col, text_col), "statistics")
    model = learn(stats, labels, sample, id_col, label_col)
    out = stats.select(F.col("id").alias("doc_id"), F.coalesce(_remainder(F.col("id")) == 0, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
