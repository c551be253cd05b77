"""Quality rules by weak supervision.

Rules vote good (+1), bad (-1) or abstain (0) on every document.  Expectation-maximisation over the counts of
vote patterns estimates each rule's accuracy without labels, and the posterior probability of quality decides,
instead of demanding that every rule passes.

Scale: one map over the texts; the only thing gathered is a count for each vote pattern, of which there are at
most ``3 ** len(RULES)``, whatever the corpus size.  The features are written once and read twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.llm.common import SPACE, col, saved

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it with as on be at by this from or an are was "
    "de la le les et des en un une du que qui dans pour est sur pas au "
    "der die und das den von zu mit sich ist auf nicht ein eine dem "
    "el los las por con para del se lo su al".encode().split()
)
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended", "n_function", "n_upper", "n_bangs", "n_distinct",
)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    mark = b"\x01" * size
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + size] = mark
            hit[j : j + size] = mark
    return sum(hit)


def text_features(text: str | None) -> tuple[int, ...]:
    """The values of ``FEATURES`` for one text; a null text has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        body = line.strip()
        if body:
            lines += 1
            ended += body[-1:] in b".!?:;\"'" and not body.endswith(b"!!")
            dup += line in seen
            seen.add(line)
    distinct = set(words)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        dup,
        repeated_words(words),
        lines,
        ended,
        sum(map(FUNCTION_WORDS.__contains__, words)),
        len(raw) - len(raw.translate(None, UPPER)),
        raw.count(b"!!"),
        len(distinct),
    )


def _append_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each row its features; the last column is the text, which goes unless it has a name of the caller's."""
    for b in batches:
        rows = [text_features(t) for t in b.column(b.num_columns - 1).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(FEATURES)
        kept = b.columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in cols)], [*b.schema.names[:-1], *FEATURES])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id`` and the long columns of ``FEATURES``."""
    return _features(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")))


def _features(rows: DataFrame) -> DataFrame:
    """The text, which is the last column, gives way to its features."""
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f, T.LongType()) for f in FEATURES)])
    return rows.mapInArrow(_append_features, schema)


def base_failed() -> Column:
    """The hard rule: under 10 words, or over 20 % of the words in repeated 5-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Vote columns over ``FEATURES``: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    ratio = lambda c, d: F.col(c) / d
    return {
        "length": _vote(F.col("n_words") >= 60, F.col("n_distinct") < 8),
        "word_size": _vote(ratio("word_chars", words).between(3.5, 9.0), ~ratio("word_chars", words).between(2.5, 12.0)),
        "symbols": _vote(ratio("n_symbols", words) < 0.03, ratio("n_symbols", words) > 0.25),
        "line_copies": _vote(F.col("n_dup_lines") == 0, (ratio("n_dup_lines", lines) > 0.3) & (F.col("n_dup_lines") > 1)),
        "repeats": _vote(ratio("n_repeat_words", words) < 0.02, ratio("n_repeat_words", words) > 0.15),
        "endings": _vote(ratio("n_ended", lines) >= 0.6, ratio("n_ended", lines) < 0.2),
        "function_words": _vote(ratio("n_function", words) >= 0.12, (ratio("n_function", words) < 0.03) & (F.col("n_words") >= 30)),
        "shouting": _vote(
            (F.col("n_bangs") == 0) & (F.col("n_upper") < 0.15 * F.col("word_chars")),
            (ratio("n_bangs", words) > 0.2) | (F.col("n_upper") > 0.5 * F.greatest(F.col("word_chars"), F.lit(1))),
        ),
    }


#: Names of `rules`, in the order of the vote pattern.
RULES = ("length", "word_size", "symbols", "line_copies", "repeats", "endings", "function_words", "shouting")


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """EM over (votes, number of documents), without labels.

    Votes cast are independent given the class; abstaining says nothing.  Each rule has two accuracies: how often it
    is right on good and on bad documents.  The start takes a document for bad by its votes against; pseudo-counts
    and bounds keep a rule from turning its meaning round.
    """
    m = len(patterns[0][0]) if patterns else 0
    belief = [0.95 if -1 not in v else 0.5 if v.count(-1) == 1 else 0.05 for v, _ in patterns]
    total = sum(n for _, n in patterns)
    model = Model(0.5, (0.9,) * m, (0.5,) * m)
    for _ in range(rounds if total else 0):
        good = sum(n * p for (_, n), p in zip(patterns, belief, strict=True))
        on_good, on_bad = [], []
        for j in range(m):
            cast = [(v[j], n, p) for (v, n), p in zip(patterns, belief, strict=True) if v[j]]
            plus, minus = sum(n * p for _, n, p in cast), sum(n * (1 - p) for _, n, p in cast)
            on_good.append(min(0.999, max(0.6, (sum(n * p for v, n, p in cast if v > 0) + 9) / (plus + 10))))
            on_bad.append(min(0.99, max(0.05, (sum(n * (1 - p) for v, n, p in cast if v < 0) + 1) / (minus + 2))))
        new = Model(min(0.95, max(0.05, good / total)), tuple(on_good), tuple(on_bad))
        belief = [posterior(v, new) for v, _ in patterns]
        moved = max(abs(x - y) for x, y in zip((model.prior, *model.on_good, *model.on_bad), (new.prior, *new.on_good, *new.on_bad), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


class Model(NamedTuple):
    """``prior``: share of good documents; ``on_good``, ``on_bad``: each rule's accuracy on either class."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def posterior(votes: tuple[int, ...], model: Model) -> float:
    """Probability that a document with these votes is good."""
    odds = math.log(model.prior / (1 - model.prior))
    for v, g, b in zip(votes, model.on_good, model.on_bad, strict=True):
        odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
    return 1 / (1 + math.exp(-odds))


def _code(votes: dict[str, Column]) -> Column:
    """A vote pattern as one base-3 number."""
    out = F.lit(0)
    for v in votes.values():
        out = out * 3 + (v + 1)
    return out.cast("int")


def _decode(code: int, m: int) -> tuple[int, ...]:
    out = []
    for _ in range(m):
        code, r = divmod(code, 3)
        out.append(r - 1)
    return tuple(reversed(out))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, ``base_failed``, ``p_quality`` and ``kept`` of every document.

    One row per input row, repeated rows included.  A null or empty text has no words and so fails the base rule;
    a null id is carried through; a posterior of exactly ``threshold`` is kept; an empty table gives an empty one;
    other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    votes = rules()
    table = saved(features(docs, id_col, text_col).withColumn("pattern", _code(votes)), "quality")
    counts = [(_decode(r["pattern"], len(votes)), r["n"], r["pattern"]) for r in table.groupBy("pattern").agg(F.count("*").alias("n")).collect()]
    model = fit(sorted((v, n) for v, n, _ in counts))
    verdicts = spark.createDataFrame([(c, posterior(v, model)) for v, _, c in counts], "pattern int, p_quality double")
    return (
        table.join(F.broadcast(verdicts), "pattern", "left")  # at most 3 ** len(RULES) rows
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold))
        .withColumnRenamed("id", id_col)
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``assess`` keeps, with their columns as they were.

    The texts never leave their partitions: the kept vote patterns (at most ``3 ** len(RULES)``) go to the rows,
    instead of the rows to a join on ids, so repeated and null ids are no special case.  Null and empty texts fail the
    base rule and go; a posterior of exactly 0.5 stays; very long texts are read whole; an empty table gives an empty one.
    """
    votes = rules()
    counts = features(docs, id_col, text_col).groupBy(_code(votes).alias("pattern")).agg(F.count("*").alias("n")).collect()
    patterns = sorted((_decode(r["pattern"], len(votes)), r["n"], r["pattern"]) for r in counts)
    model = fit([(v, n) for v, n, _ in patterns])
    good = [c for v, _, c in patterns if posterior(v, model) >= 0.5]
    whole = F.struct(*(col(c) for c in docs.columns)).alias("whole")  # keeps names that clash with a feature's
    judged = _features(docs.select(whole, col(text_col).cast("string").alias("text")))
    return judged.where(~base_failed() & _code(votes).isin(good)).select("whole.*")
