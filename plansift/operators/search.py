"""Full-text search over a stored positional index.

The index has one posting a term and page: the positions of the term's words, stop words counted but not stored.
Postings lie in folders by a hash of the term, sorted by term within, so a query reads the folders of its own terms and of
those the row groups that have them.  A frequent term's postings are written by several tasks, split by page.  The index is
made once for a state of the table (`plansift.sources.shared.kept`); queries never look at the texts but to show them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plansift.functions.stems import stem, stems, stems_sql
from plansift.functions.text import stem_match
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read
from plansift.sources.shared import kept_table

BUCKETS, SPLITS = 128, 8
#: Words that a task holds as postings at once, if no text has more.
PORTION = 1 << 20
MOST_WORDS, LEAST_WORDS = 20, 10
#: Weight of a plain word, range of nearness, and the sum of 1 / k**2, of the ranking that is followed.
WEIGHT, NEAR, ZETA = 0.1, 100, 1.64493406685


def _words(text: str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    return stem(word)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole texts: each different word of a portion of texts is stemmed once."""
    for b in batches:
        sizes = np.diff(b.column("words").offsets.to_numpy())
        words = b.column("words").flatten().dictionary_encode()
        terms: dict[str, int] = {"": 0}
        number = np.array([terms.setdefault(_stem(w), len(terms)) for w in words.dictionary.to_pylist()], np.int64)
        term = number[words.indices.to_numpy()]
        page, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = np.flatnonzero(term)
        key = page[kept] * len(terms) + term[kept]
        order = np.argsort(key, kind="stable")  # positions stay in order
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0][: len(order)])
        posting = kept[order[first]]
        positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.array(at[kept[order]], pa.int32()))
        of = pa.array(page[posting])
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("project_id").take(of), pa.array(list(terms)).take(pa.array(term[posting])), positions], ["doc_id", "project_id", "term", "positions"])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a portion has at most `PORTION` words, or one text."""
    for b in batches:
        end = np.cumsum(np.diff(b.column("words").offsets.to_numpy()))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + PORTION, "right")))
            yield b.slice(start, stop - start)
            start = stop


def write_index(pages: DataFrame, path: str) -> None:
    """Postings of ``doc_id, project_id, text``: ``term, doc_id, project_id, positions`` in folders by ``bucket``."""
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    texts = pages.where(F.col("text").isNotNull()).repartition("doc_id").select("doc_id", "project_id", _words("text").alias("words"))
    hits = texts.mapInArrow(lambda batches: _postings(_portions(batches)), f"doc_id {kind['doc_id']}, project_id {kind['project_id']}, term string, positions array<int>")
    # by term and part of the pages: one shuffle, and no task has all pages of a frequent term
    dealt = hits.select("*", _bucket(F.col("term")).alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS)).alias("split")).repartition("bucket", "split")
    # texts of one page that stand in several rows are one posting
    whole = dealt.groupBy("bucket", "split", "term", "doc_id", "project_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")).drop("split")
    whole.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(path)


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents", "doc_id", F.col("source").alias("project_id"), "text")
    return kept_table(spark, sf_dir, "documents", "index", lambda path: write_index(pages, path))


class Query(NamedTuple):
    """Stems with their places in the text of the query; in quotes they must stand at these distances."""

    terms: tuple[tuple[str, int], ...]
    phrase: bool
    words: tuple[str, ...]

    @property
    def stems(self) -> list[str]:
        return sorted({t for t, _ in self.terms})


def parsed(text: str) -> Query:
    """Words in any order, or a phrase where the text stands in double quotes; stop words only keep their places."""
    phrase = len(text) > 2 and text[0] == text[-1] == '"'
    words = (text[1:-1] if phrase else text).lower().split()
    return Query(tuple((s, i) for i, w in enumerate(words) if (s := stem(w))), phrase, tuple(words))


def postings(index: DataFrame, query: Query) -> DataFrame:
    """The query's postings: of the index only the folders of its terms are read."""
    terms = query.stems
    if not terms:
        return index.limit(0)
    return index.where(F.col("bucket").isin(*(_bucket(F.lit(t)) for t in terms)) & F.col("term").isin(*terms)).drop("bucket")


def matches(index: DataFrame, query: Query) -> DataFrame:
    """Pages that fulfil the query: ``doc_id, project_id, tf, first``, hits' ``at`` by term (a map), and ``starts`` of phrases."""
    terms = query.stems
    found = postings(index, query).groupBy("doc_id", "project_id").agg(
        F.sum(F.size("positions")).alias("tf"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")
    ).where(F.size("at") == len(terms))
    if query.phrase and terms:
        first = query.terms[0][1]
        starts = None
        for t, i in query.terms:
            here = F.transform(F.col("at")[t], lambda p: p - (i - first))  # noqa: B023
            starts = here if starts is None else F.array_intersect(starts, here)
        found = found.withColumn("starts", starts).where(F.size("starts") > 0)
    return found.withColumn("first", F.array_min(F.transform(F.map_values("at"), lambda p: p[0])))


def ranked(found: DataFrame, query: Query) -> DataFrame:
    """``doc_id, project_id, rank``: nearer pairs of different terms count more; a lone term by its frequency.

    The ranking of the database whose search is followed, for words of equal weight: every pair of positions within `NEAR`
    adds to the chance of relevance as independent evidence.  Positions meet in cells of `NEAR` words, not all with all.
    """
    if len(query.stems) < 2:
        tf = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / (k * k))
        return found.select("doc_id", "project_id", F.round(WEIGHT * tf / ZETA, 6).alias("rank"))
    hits = found.select("doc_id", "project_id", F.explode("at").alias("term", "ps")).select("doc_id", "project_id", "term", F.explode("ps").alias("p"))
    cell = F.floor(F.col("p") / NEAR)
    left = hits.select("doc_id", "project_id", F.col("term").alias("s"), F.col("p").alias("q"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = hits.select("doc_id", "project_id", "term", "p", cell.alias("cell"))
    far = F.abs(F.col("p") - F.col("q"))
    near = left.join(right, ["doc_id", "project_id", "cell"]).where((F.col("s") < F.col("term")) & far.between(1, NEAR))
    weight = WEIGHT * F.sqrt(1 / (F.lit(1.005) + F.lit(0.05) * F.exp(far / F.lit(1.5) - 2)))
    some = near.groupBy("doc_id", "project_id").agg((1 - F.exp(F.sum(F.log(1 - weight)))).alias("r"))
    return found.select("doc_id", "project_id").join(some, ["doc_id", "project_id"], "left").select("doc_id", "project_id", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("rank"))


def headlines(found: DataFrame, pages: DataFrame, query: Query, most: int = MOST_WORDS, least: int = LEAST_WORDS, start: str = "<mark>", stop: str = "</mark>") -> DataFrame:
    """Of each page the window of ``most`` words with most hits (the earliest of equals), cut after its last hit but not
    below ``least`` words; hits stand in marks."""
    hits = found.select("doc_id", F.explode(F.array_distinct(F.flatten(F.map_values("at")))).alias("p"))
    ahead = W.partitionBy("doc_id").orderBy("p").rangeBetween(0, most - 1)
    near = hits.select("doc_id", "p", F.count("*").over(ahead).alias("n"), F.max("p").over(ahead).alias("last"))
    best = near.groupBy("doc_id").agg(F.max_by(F.struct("p", "last"), F.struct("n", -F.col("p"))).alias("b"))
    words = pages.join(best, "doc_id").select("doc_id", "b", _words("text").alias("w"))
    end = F.least(F.size("w") - 1, F.greatest(F.col("b.last"), F.col("b.p") + least - 1))
    begin = F.greatest(F.lit(0), F.least(F.col("b.p"), end - least + 1))
    cut = words.select("doc_id", F.slice("w", begin + 1, end - begin + 1).alias("w"))
    marked = F.zip_with("w", stems(F.col("w")), lambda w, s: F.when(s.isin(*query.stems), F.concat(F.lit(start), w, F.lit(stop))).otherwise(w))
    return cut.select("doc_id", F.array_join(marked, " ").alias("headline"))


def word_hits(words: DataFrame, query: Query) -> DataFrame:
    """Words of pages to be highlighted: that match any word of the query, or stand in a run that matches all in order."""
    one = lambda term: stem_match(F.col("tok"), F.lit(term))
    if not query.phrase or len(query.words) < 2:
        hit = None
        for t in query.words:
            hit = one(t) if hit is None else hit | one(t)
        return words.where(hit)
    by, n = W.partitionBy("doc_id").orderBy("idx"), len(query.words)
    flags = words.select("*", *(one(t).alias(f"_m{k}") for k, t in enumerate(query.words)))
    whole = None  # a run starts here
    for k in range(n):
        here = F.lead(f"_m{k}", k).over(by)
        whole = here if whole is None else whole & here
    flags = flags.withColumn("_run", F.coalesce(whole, F.lit(False)))
    inside = F.max(F.col("_run").cast("int")).over(by.rowsBetween(1 - n, 0)) == 1
    return flags.withColumn("_in", inside).where("_in").drop("_run", "_in", *(f"_m{k}" for k in range(n)))


ALL, QUOTED = parsed("Licensed works under the general"), parsed('"licensed under the GNU general public"')

_TERM = f"""term AS (SELECT doc_id, unnest(toks) AS tok, unnest({stems_sql('toks')}) AS term, unnest(range(len(toks))) AS p
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda y: y <> '') AS toks FROM documents))"""
_IN = ", ".join(f"'{t}'" for t in ALL.stems)
_ALL = f"{_TERM}, hit AS (SELECT doc_id, term, p FROM term WHERE term IN ({_IN}) AND doc_id IN (SELECT doc_id FROM term WHERE term IN ({_IN}) GROUP BY doc_id HAVING count(DISTINCT term) = {len(ALL.stems)}))"
_RANK = f"""{_ALL}, near AS (
  SELECT a.doc_id, 1 - exp(sum(ln(1 - 1e-1 * sqrt(1 / (1.005e0 + 5e-2 * exp(abs(a.p - b.p) / 1.5e0 - 2)))))) AS r
  FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.term < b.term AND abs(a.p - b.p) <= {NEAR} GROUP BY a.doc_id),
ranked AS (SELECT doc_id, round(coalesce(r, 0), 6) AS rank FROM (SELECT DISTINCT doc_id FROM hit) LEFT JOIN near USING (doc_id))"""


@register("f01_token_index", f"WITH {_TERM} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS tf, min(p)::INT AS earliest FROM term WHERE term <> '' GROUP BY term")
def f01(spark, sf_dir):
    """The terms of the stored index with their pages, occurrences and earliest place."""
    i = stored_index(spark, sf_dir)
    return i.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("tf"), F.min(F.col("positions")[0]).alias("earliest"))


@register("f02_and_query", f"WITH {_ALL} SELECT doc_id, count(*) AS tf, min(p)::INT AS first FROM hit GROUP BY doc_id")
def f02(spark, sf_dir):
    """Pages that have all terms."""
    return matches(stored_index(spark, sf_dir), ALL).select("doc_id", "tf", "first")


_STEPS = " ".join(f"JOIN term t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.p = t0.p + {i - QUOTED.terms[0][1]} AND t{k}.term = '{t}'" for k, (t, i) in enumerate(QUOTED.terms) if k)


@register("f03_phrase_query", f"WITH {_TERM} SELECT t0.doc_id, count(*) AS hits, min(t0.p)::INT AS first FROM term t0 {_STEPS} WHERE t0.term = '{QUOTED.terms[0][0]}' GROUP BY t0.doc_id")
def f03(spark, sf_dir):
    """A phrase: the positions of its terms, moved by their places, meet within a posting."""
    found = matches(stored_index(spark, sf_dir), QUOTED)
    return found.select("doc_id", F.size("starts").cast("long").alias("hits"), F.array_min("starts").alias("first"))


@register("f04_rank", f"WITH {_RANK} SELECT doc_id, rank FROM ranked ORDER BY rank DESC, doc_id LIMIT 20")
def f04(spark, sf_dir):
    """The twenty best pages."""
    return ranked(matches(stored_index(spark, sf_dir), ALL), ALL).select("doc_id", "rank").orderBy(F.desc("rank"), "doc_id").limit(20)


@register("f04_rank_one", f"WITH {_TERM} SELECT doc_id, round(1e-1 * sum(1e0 / (n * n)) / 1.64493406685e0, 6) AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS n FROM term WHERE term = 'licens') GROUP BY doc_id")
def f04_one(spark, sf_dir):
    """Ranks of pages for one term."""
    q = parsed("licensing")
    return ranked(matches(stored_index(spark, sf_dir), q), q).select("doc_id", "rank")


@register("f05_headline", f"""WITH {_ALL}, w AS (SELECT doc_id, p, count(*) OVER ahead AS n, max(p) OVER ahead AS last FROM hit WINDOW ahead AS (PARTITION BY doc_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)),
best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1),
stop AS (SELECT best.doc_id, best.p, least(max(term.p), greatest(last, best.p + 9)) AS stop FROM best JOIN term USING (doc_id) GROUP BY best.doc_id, best.p, last),
cut AS (SELECT doc_id, greatest(0, least(p, stop - 9)) AS start, stop FROM stop)
SELECT doc_id, string_agg(CASE WHEN term IN ({_IN}) THEN '<mark>' || tok || '</mark>' ELSE tok END, ' ' ORDER BY p) AS headline FROM term JOIN cut USING (doc_id) WHERE p BETWEEN start AND stop GROUP BY doc_id""")
def f05(spark, sf_dir):
    """Ten to twenty words of each page that has all terms, where most hits are."""
    return headlines(matches(stored_index(spark, sf_dir), ALL), read(spark, sf_dir, "documents", "doc_id", "text"), ALL)


def _stem_match_sql(tok: str, term: str) -> str:
    w = f"regexp_replace(lower({tok}), '[^a-z0-9]+', '', 'g')"
    if len(term) <= 2:
        return f"({w} = '{term}' AND {w} <> '')"
    return f"CASE WHEN len({w}) <= 2 THEN {w} = '{term}' AND {w} <> '' ELSE starts_with({w}, '{term}') OR starts_with('{term}', {w}) END"


_ANY = " OR ".join(f"({_stem_match_sql('tok', t)})" for t in ALL.words)


def _pages_words(spark: SparkSession, sf_dir: str, query: Query) -> DataFrame:
    """Words of the pages that fulfil the query; other texts are not split."""
    found = matches(stored_index(spark, sf_dir), query).select("doc_id")
    return views.word_of(read(spark, sf_dir, "documents", "doc_id", "text").join(found, "doc_id", "left_semi"))


@register("f06_word_hits", oracle("v_word", f"WITH {_ALL} SELECT doc_id, idx, round(l, 6) AS l, round(t, 6) AS t FROM v_word WHERE doc_id IN (SELECT doc_id FROM hit) AND ({_ANY})"))
def f06(spark, sf_dir):
    """Boxes of the words to highlight on pages that have all terms."""
    return word_hits(_pages_words(spark, sf_dir, ALL), ALL).select("doc_id", "idx", F.round("l", 6).alias("l"), F.round("t", 6).alias("t"))


_LEADS = " AND ".join(f"({_stem_match_sql(f'lead(tok, {k}) OVER w' if k else 'tok', t)})" for k, t in enumerate(QUOTED.words))


@register("f06_phrase_hits", oracle("v_word", f"""WITH {_TERM}, found AS (SELECT DISTINCT t0.doc_id FROM term t0 {_STEPS} WHERE t0.term = '{QUOTED.terms[0][0]}'),
run AS (SELECT doc_id, idx, {_LEADS} AS run FROM v_word WHERE doc_id IN (SELECT doc_id FROM found) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
place AS (SELECT DISTINCT doc_id, idx + unnest(range({len(QUOTED.words)})) AS idx FROM run WHERE run)
SELECT doc_id, v_word.idx, round(l, 6) AS l, round(t, 6) AS t FROM v_word JOIN place USING (doc_id, idx)"""))
def f06_phrase(spark, sf_dir):
    """Boxes of the words of a phrase."""
    return word_hits(_pages_words(spark, sf_dir, QUOTED), QUOTED).select("doc_id", "idx", F.round("l", 6).alias("l"), F.round("t", 6).alias("t"))


@register("f07_cross_project", f"WITH {_ALL} SELECT source, count(*) AS match_count, count(DISTINCT doc_id) AS page_count FROM hit JOIN documents USING (doc_id) GROUP BY source")
def f07(spark, sf_dir):
    """Hits and pages by project."""
    found = matches(stored_index(spark, sf_dir), ALL)
    return found.groupBy(F.col("project_id").alias("source")).agg(F.sum("tf").alias("match_count"), F.count("*").alias("page_count"))


@register("f08_retrieval", f"WITH {_RANK} SELECT doc_id, rank, substr(text, 1, 2000) AS text FROM ranked JOIN documents USING (doc_id) ORDER BY rank DESC, doc_id LIMIT 10")
def f08(spark, sf_dir):
    """Context for a question: the ten best pages, as much of their text as a report shows."""
    top = ranked(matches(stored_index(spark, sf_dir), ALL), ALL).select("doc_id", "rank").orderBy(F.desc("rank"), "doc_id").limit(10)
    return read(spark, sf_dir, "documents", "doc_id", "text").join(F.broadcast(top), "doc_id").select("doc_id", "rank", F.substring("text", 1, 2000).alias("text"))
