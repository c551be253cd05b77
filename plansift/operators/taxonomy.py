"""Taxonomy codes in page words: phrase, bag and anchor matches, combined.

The match is inverted: description words meet page words in an equi-join, never every description with every page.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.text import significant
from plansift.plans import views
from plansift.plans.registry import register

TIER1, TIER1_WEIGHTS = 0.95, (0.0, 0.01, 0.19, 0.80, 0.80, 0.80)
TIER2, TIER2_WORDS = 0.75, 3
TIER3, TIER3_WORDS, ANCHORS = 0.50, 5, 4
THRESHOLD = 0.4


def descriptions(taxonomy: DataFrame) -> DataFrame:
    words = F.split(F.regexp_replace("description", "-", " "), " ")
    return taxonomy.select("code", words.alias("words"), F.array_distinct(significant(words)).alias("sig"))


def phrase_hits(word: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(``doc_id``, ``code``): the description's words stand in a row on the page.

    The places of a description's rarest word give the starts at which it could stand; only there are the other words
    looked up, so common words never meet every description that has them.
    """
    asked = descriptions(taxonomy).select("code", F.size("words").alias("n"), F.posexplode("words").alias("k", "tok"))
    words = word.select("doc_id", "idx", F.lower("tok").alias("tok")).join(asked.select("tok").distinct(), "tok", "left_semi")
    known = asked.join(words.groupBy("tok").agg(F.count("*").alias("tf")), "tok")
    rare = known.groupBy("code").agg(F.min_by(F.struct("n", "k", "tok"), F.struct("tf", "k")).alias("r")).select("code", "r.*")
    starts = words.join(rare, "tok").select("code", "doc_id", (F.col("idx") - F.col("k")).alias("start"), "n")
    wanted = starts.join(asked.select("code", "k", "tok"), "code").select("code", "doc_id", "start", "n", (F.col("start") + F.col("k")).alias("idx"), "tok")
    met = wanted.join(words, ["doc_id", "idx", "tok"]).groupBy("code", "doc_id", "start", "n").agg(F.count("*").alias("votes"))
    return met.where("votes = n").select("doc_id", "code").distinct()


#: Descriptions up to which tasks hold them all; more are joined.
HELD = 100_000


def _finder(codes: list[str], phrases: list[list[str]]) -> Callable[[pa.Array], pa.Array]:
    """For texts, the codes whose words stand in a row in each: all places go down the tree of the phrases together."""
    names = sorted({w for p in phrases for w in p})
    number = {w: i for i, w in enumerate(names)}
    tree: dict[tuple[int, int], int] = {}
    ends = []
    for c, p in enumerate(phrases):
        node = 0
        for w in p:
            node = tree.setdefault((node, number[w]), len(tree) + 1)
        ends.append((node, c))
    edges = np.array([n << 32 | w for n, w in tree] or [-1], np.int64)
    order = np.argsort(edges)
    edges, child = edges[order], np.array(list(tree.values()) or [0], np.int64)[order]
    end, code = np.array(sorted(ends), np.int64).reshape(-1, 2).T
    deepest = max(map(len, phrases), default=0)
    vocabulary, named = pa.array(names, pa.large_string()), pa.array(codes, pa.string())

    def some(texts: pa.Array) -> pa.Array:
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        row, flat = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy()), words.flatten()
        real = pc.not_equal(flat, "")
        row, flat = row[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
        ids = pc.index_in(flat.dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[flat.indices.to_numpy()]
        at, found = np.flatnonzero(ids >= 0), [np.zeros((2, 0), np.int64)]
        node = np.zeros(len(at), np.int64)
        for k in range(deepest):
            on = at + k < len(ids)
            at, node = at[on], node[on]
            asked = node << 32 | np.where(row[at + k] == row[at], ids[at + k], -1)
            place = np.minimum(np.searchsorted(edges, asked), len(edges) - 1)
            on = (edges[place] == asked) & (asked >= 0)
            at, node = at[on], child[place[on]]
            first, stop = np.searchsorted(end, node), np.searchsorted(end, node, "right")
            n = stop - first
            found.append(np.stack([np.repeat(row[at], n), code[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]]))
        rows, hit = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)), pa.int32()), named.take(pa.array(hit)))

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(texts.slice(k, 500)) for k in range(0, len(texts), 500)] or [pa.array([], pa.list_(pa.string()))])

    return run


def text_hits(texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """`phrase_hits` of whole texts (``doc_id, text``): each is read once in its row, and no word is a row of its own."""
    asked = descriptions(taxonomy).select("code", "words").where("words IS NOT NULL")
    held = asked.limit(HELD + 1).collect()
    if len(held) > HELD:
        return phrase_hits(views.word_of(texts), taxonomy)
    find = F.arrow_udf(_finder([r["code"] for r in held], [r["words"] for r in held]), "array<string>")
    return texts.where("doc_id IS NOT NULL").select("doc_id", F.explode(find(F.lower("text"))).alias("code")).distinct()


def bag_hits(word: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(``doc_id``, ``code``, ``n_sig``, ``matched``): significant description words that the page has."""
    asked = descriptions(taxonomy).select("code", F.size("sig").alias("n_sig"), F.explode("sig").alias("tok"))
    have = word.select("doc_id", F.lower("tok").alias("tok")).join(asked.select("tok").distinct(), "tok", "left_semi").distinct()
    return have.join(asked, "tok").groupBy("doc_id", "code").agg(F.first("n_sig").alias("n_sig"), F.count("*").alias("matched"))


def anchors(taxonomy: DataFrame) -> DataFrame:
    """(``code``, ``tok``): the description's words that fewest descriptions have, four at most, ties by place."""
    asked = descriptions(taxonomy).select("code", F.posexplode("sig").alias("k", "tok"))
    spread = asked.groupBy("tok").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("code").orderBy("df", "k"))
    return asked.join(spread, "tok").withColumn("r", rank).where(F.col("r") <= ANCHORS).select("code", "tok")


def anchor_hits(word: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(``doc_id``, ``code``, ``anchor``): share of the anchors that the page has, times the tier's weight."""
    a = anchors(taxonomy)
    n = a.groupBy("code").agg(F.count("*").alias("n"))
    have = word.select("doc_id", F.lower("tok").alias("tok")).join(a.select("tok").distinct(), "tok", "left_semi").distinct()
    got = have.join(a, "tok").groupBy("doc_id", "code").agg(F.count("*").alias("m"))
    return got.join(n, "code").select("doc_id", "code", (F.col("m") / F.col("n") * F.lit(TIER3)).alias("anchor"))


def tier1(n_sig: Column) -> Column:
    weights = F.array(*map(F.lit, TIER1_WEIGHTS))
    return F.lit(TIER1) * F.element_at(weights, F.least(n_sig, F.lit(len(TIER1_WEIGHTS) - 1)) + 1)


def tier2(matched: Column, n_sig: Column) -> Column:
    return F.pow(matched / n_sig, F.lit(2.0)) * F.lit(TIER2)


def detect(word: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(``doc_id``, ``code``, ``confidence``, ``tier``) at the threshold or above.

    A phrase match decides; else the better of bag and anchors, raised a little where both speak for the code (the
    boost does not ask for the least number of words).
    """
    bag, anchor = bag_hits(word, taxonomy), anchor_hits(word, taxonomy)
    phrase = phrase_hits(word, taxonomy).withColumn("phrase", F.lit(True))
    both = bag.join(anchor, ["doc_id", "code"], "left").join(phrase, ["doc_id", "code"], "left")
    b, a = tier2(F.col("matched"), F.col("n_sig")), F.coalesce("anchor", F.lit(0.0))
    bow = F.when(F.col("n_sig") >= TIER2_WORDS, b).otherwise(F.lit(0.0))
    anc = F.when(F.col("n_sig") >= TIER3_WORDS, a).otherwise(F.lit(0.0))
    base = F.greatest(bow, anc)
    lower = F.when((b > 0.4) & (a > 0.2), F.least(base + F.lit(0.05), F.lit(0.9))).otherwise(base)
    scored = both.select(
        "doc_id", "code", F.when(F.col("phrase"), tier1(F.col("n_sig"))).otherwise(lower).alias("c"), F.when(F.col("phrase"), 1).when(bow >= anc, 2).otherwise(3).alias("tier")
    )
    return scored.where(F.col("c") >= THRESHOLD).select("doc_id", "code", F.round("c", 6).alias("confidence"), "tier")


_DESC = """d AS (SELECT code, string_split(replace(description, '-', ' '), ' ') AS words FROM v_taxonomy),
s AS (SELECT code, list_filter(words, lambda w: len(w) > 2 AND NOT list_contains([{stop}], w)) AS sig0 FROM d),
k AS (SELECT code, unnest(sig0) AS tok, unnest(range(len(sig0))) AS pos FROM s),
sig AS (SELECT code, tok, min(pos) AS pos FROM k GROUP BY ALL),
n AS (SELECT code, count(*) AS n_sig FROM sig GROUP BY code),
pt AS (SELECT DISTINCT doc_id, lower(tok) AS tok FROM v_word)"""


def _sql(body: str) -> str:
    from plansift.functions.text import STOP_WORDS

    return views.oracle("v_word v_text v_taxonomy", "WITH " + _DESC.format(stop=", ".join(map(repr, STOP_WORDS))) + ", " + body)


_BAG = "bag AS (SELECT doc_id, code, n_sig, count(*) AS matched FROM pt JOIN sig USING (tok) JOIN n USING (code) GROUP BY ALL)"
_ANC = """df AS (SELECT tok, count(*) AS df FROM sig GROUP BY tok),
anc AS (SELECT code, tok FROM sig JOIN df USING (tok) QUALIFY row_number() OVER (PARTITION BY code ORDER BY df, pos) <= 4),
an AS (SELECT code, count(*) AS a FROM anc GROUP BY code),
ah AS (SELECT doc_id, code, count(*) / a * 5e-1 AS anchor FROM pt JOIN anc USING (tok) JOIN an USING (code) GROUP BY doc_id, code, a)"""
_PHR = "phr AS (SELECT x.doc_id, d.code FROM v_text x JOIN d ON contains(x.body, ' ' || array_to_string(d.words, ' ') || ' '))"


@register("a11_phrase_confidence", _sql(_PHR + " SELECT doc_id, code, round(95e-2 * [0e0, 1e-2, 19e-2, 8e-1, 8e-1, 8e-1][least(n_sig, 5) + 1], 6) AS confidence FROM phr JOIN n USING (code)"))
def a11(spark, sf_dir):
    word, tax = views.word(spark, sf_dir), views.taxonomy(spark, sf_dir)
    n = descriptions(tax).select("code", F.size("sig").alias("n_sig"))
    return phrase_hits(word, tax).join(n, "code").select("doc_id", "code", F.round(tier1(F.col("n_sig")), 6).alias("confidence"))


@register("a12_bag_score", _sql(_BAG + " SELECT doc_id, code, matched, n_sig, round(pow(matched / n_sig, 2) * 75e-2, 6) AS score FROM bag WHERE n_sig >= 3"))
def a12(spark, sf_dir):
    bag = bag_hits(views.word(spark, sf_dir), views.taxonomy(spark, sf_dir)).where(F.col("n_sig") >= TIER2_WORDS)
    return bag.select("doc_id", "code", "matched", F.col("n_sig").cast("long").alias("n_sig"), F.round(tier2(F.col("matched"), F.col("n_sig")), 6).alias("score"))


@register("a13_anchor_score", _sql(_ANC + " SELECT doc_id, code, round(anchor, 6) AS score FROM ah JOIN n USING (code) WHERE n_sig >= 5"))
def a13(spark, sf_dir):
    tax = views.taxonomy(spark, sf_dir)
    n = descriptions(tax).select("code", F.size("sig").alias("n_sig"))
    return anchor_hits(views.word(spark, sf_dir), tax).join(n, "code").where(F.col("n_sig") >= TIER3_WORDS).select("doc_id", "code", F.round("anchor", 6).alias("score"))


_DETECT = _BAG + ", " + _ANC + ", " + _PHR + """,
sc AS (SELECT bag.doc_id, bag.code, n_sig, pow(matched / n_sig, 2) * 75e-2 AS b, coalesce(anchor, 0e0) AS a, phr.code IS NOT NULL AS phrase
       FROM bag LEFT JOIN ah ON bag.doc_id = ah.doc_id AND bag.code = ah.code LEFT JOIN phr ON bag.doc_id = phr.doc_id AND bag.code = phr.code),
g AS (SELECT *, CASE WHEN n_sig >= 3 THEN b ELSE 0e0 END AS bow, CASE WHEN n_sig >= 5 THEN a ELSE 0e0 END AS an FROM sc),
det AS (SELECT doc_id, code, CASE WHEN phrase THEN 95e-2 * [0e0, 1e-2, 19e-2, 8e-1, 8e-1, 8e-1][least(n_sig, 5) + 1]
             WHEN b > 4e-1 AND a > 2e-1 THEN least(greatest(bow, an) + 5e-2, 9e-1) ELSE greatest(bow, an) END AS c,
             CASE WHEN phrase THEN 1 WHEN bow >= an THEN 2 ELSE 3 END AS tier FROM g)"""


@register("a14_tier_combination", _sql(_DETECT + " SELECT doc_id, code, round(c, 6) AS confidence, tier FROM det WHERE c >= 4e-1"))
def a14(spark, sf_dir):
    return detect(views.word(spark, sf_dir), views.taxonomy(spark, sf_dir))


@register("j27_taxonomy_pages", _sql(_DETECT + " SELECT code, count(*) AS pages, max(round(c, 6)) AS best FROM det WHERE c >= 4e-1 GROUP BY code"))
def j27(spark, sf_dir):
    return detect(views.word(spark, sf_dir), views.taxonomy(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("pages"), F.max("confidence").alias("best"))


@register("a16_grid_text_codes", views.oracle("v_word v_taxonomy", """
WITH g AS (SELECT doc_id, sheet, ' ' || string_agg(lower(tok), ' ' ORDER BY idx) || ' ' AS body FROM v_word GROUP BY ALL)
SELECT doc_id, sheet, code FROM g JOIN v_taxonomy ON contains(body, ' ' || replace(description, '-', ' ') || ' ')"""))
def a16(spark, sf_dir):
    """Codes of a grid: the cells of a sheet as one text."""
    cells = views.word(spark, sf_dir).select(F.struct("doc_id", "sheet").alias("doc_id"), "idx", "tok")
    return phrase_hits(cells, views.taxonomy(spark, sf_dir)).select("doc_id.doc_id", "doc_id.sheet", "code")


@register("a17_code_merge", views.oracle("v_word v_text v_taxonomy v_page_code", """
WITH m AS (SELECT doc_id, code, 0 AS prio FROM v_page_code UNION ALL SELECT item_id AS doc_id, code, 1 FROM benchmark b JOIN v_taxonomy t
  ON lower(b.text) LIKE t.description || '%')
SELECT doc_id, code, substr(code, 1, 2) AS division, min(prio)::INT AS prio FROM m GROUP BY doc_id, code"""))
def a17(spark, sf_dir):
    """Codes found on a page and codes given for it, each once, the found ones first."""
    found = views.page_code(spark, sf_dir).select("doc_id", "code", F.lit(0).alias("prio"))
    tax = views.taxonomy(spark, sf_dir).select("code", "description", F.split("description", " ")[0].alias("head"))
    b = views.read(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("body")).withColumn("head", F.split("body", " ")[0])
    given = b.join(tax, "head").where(F.col("body").startswith(F.col("description"))).select(F.col("item_id").alias("doc_id"), "code", F.lit(1).alias("prio"))
    return found.unionByName(given).groupBy("doc_id", "code").agg(F.min("prio").alias("prio")).withColumn("division", F.substring("code", 1, 2))


@register("a03_code_rollup", views.oracle("v_word v_text v_taxonomy v_page_code", """
SELECT code, division, trade, count(DISTINCT source) AS projects, count(*) AS pages, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM v_page_code JOIN documents USING (doc_id) GROUP BY ALL ORDER BY pages DESC, code LIMIT 200"""))
def a03(spark, sf_dir):
    """Codes with their projects and pages; the report is the top 200."""
    docs = views.read(spark, sf_dir, "documents", "doc_id", "source")
    g = views.page_code(spark, sf_dir).join(docs, "doc_id").groupBy("code", "division", "trade")
    return g.agg(F.count_distinct("source").alias("projects"), F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).orderBy(F.desc("pages"), "code").limit(200)


@register("a04_sheet_histogram", views.oracle("v_word v_text v_taxonomy v_page_code", """
WITH c AS (SELECT code, source, count(*) AS n FROM v_page_code JOIN documents USING (doc_id) GROUP BY ALL)
SELECT code, string_agg(source || ':' || n, ',' ORDER BY source) AS sheets FROM c GROUP BY code"""))
def a04(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents", "doc_id", "source")
    n = views.page_code(spark, sf_dir).join(docs, "doc_id").groupBy("code", "source").agg(F.count("*").alias("n"))
    return n.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"])), ",").alias("sheets"))


@register("a19_topology", views.oracle("v_word v_text v_taxonomy v_page_code", "SELECT division, count(DISTINCT code) AS codes, count(DISTINCT doc_id) AS pages FROM v_page_code GROUP BY division"))
def a19(spark, sf_dir):
    return views.page_code(spark, sf_dir).groupBy("division").agg(F.count_distinct("code").alias("codes"), F.count_distinct("doc_id").alias("pages"))


@register("a27_page_index", views.oracle("v_word v_text v_taxonomy v_page_code v_detection", """
WITH k AS (SELECT unnest(['code:' || code, 'trade:' || trade, 'division:' || division]) AS key, doc_id FROM v_page_code UNION ALL SELECT 'class:' || name, doc_id FROM v_detection)
SELECT key, (doc_id // 1000)::BIGINT AS part, string_agg(DISTINCT lpad(doc_id::VARCHAR, 12, '0'), ',' ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS pages FROM k GROUP BY ALL"""))
def a27(spark, sf_dir):
    """Pages by code, trade, division and class of detection, a thousand page numbers to a row, so that no row grows with the corpus."""
    key = lambda kind: F.concat(F.lit(f"{kind}:"), "name" if kind == "class" else kind)
    coded = views.page_code(spark, sf_dir).select(F.explode(F.array(*map(key, ("code", "trade", "division")))).alias("key"), "doc_id")
    rows = coded.unionAll(views.detection(spark, sf_dir).select(key("class").alias("key"), "doc_id"))
    pages = F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("doc_id").cast("string"), 12, "0"))), ",")
    return rows.groupBy("key", F.floor(F.col("doc_id") / 1000).alias("part")).agg(pages.alias("pages"))


@register("a32_distinct_lists", views.oracle("v_word v_text v_taxonomy v_page_code", "SELECT DISTINCT 'trade' AS kind, trade AS value FROM v_page_code UNION SELECT DISTINCT 'code', code FROM v_page_code"))
def a32(spark, sf_dir):
    pc = views.page_code(spark, sf_dir)
    return pc.select(F.lit("trade").alias("kind"), F.col("trade").alias("value")).union(pc.select(F.lit("code"), "code")).distinct()


@register("a52_dominant_trade", views.oracle("v_word v_text v_taxonomy v_page_code", """
SELECT doc_id, trade, count(*) AS n FROM v_page_code GROUP BY doc_id, trade QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, trade) = 1"""))
def a52(spark, sf_dir):
    n = views.page_code(spark, sf_dir).groupBy("doc_id", "trade").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "trade"))).where("r = 1").drop("r")


@register("a58_division_suggestions", views.oracle("v_taxonomy", "SELECT division, count(*) AS codes, min(code) AS first_code, sum(CASE WHEN contains(description, 'th') OR contains(code, '1') THEN 1 ELSE 0 END)::BIGINT AS suggested FROM v_taxonomy GROUP BY division"))
def a58(spark, sf_dir):
    hit = F.col("description").contains("th") | F.col("code").contains("1")
    return views.taxonomy(spark, sf_dir).groupBy("division").agg(F.count("*").alias("codes"), F.min("code").alias("first_code"), F.sum(hit.cast("int")).alias("suggested"))


@register("a59_project_codes", views.oracle("v_word v_text v_taxonomy v_page_code", """
SELECT source, code, min(t.description) AS description, count(DISTINCT doc_id) AS pages FROM v_page_code JOIN documents USING (doc_id) JOIN v_taxonomy t USING (code) GROUP BY ALL"""))
def a59(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents", "doc_id", "source")
    tax = views.taxonomy(spark, sf_dir).select("code", "description")
    return views.page_code(spark, sf_dir).join(docs, "doc_id").join(tax, "code").groupBy("source", "code").agg(F.min("description").alias("description"), F.count_distinct("doc_id").alias("pages"))
