"""Queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plansift.llm import ann_tree, collocations, html_extract, license_scan, line_templates, mixture, packing, phrase_dedup, quality_classifier, quality_rules, secret_scan, simhash, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(table(spark, sf_dir, "documents"))


def op2_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"))


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_templates,
            op2_ann_tree,
            op3_quality_rules,
            op4_license_scan,
            op5_phrase_dedup,
            op6_mixture,
            op7_secret_scan,
            op8_simhash,
            op9_html_extraction,
            op10_packing,
            op11_collocations,
            op12_quality_classifier,
            op13_whitening,
            pipeline,
        )
    }


#: DuckDB SQL for the rows of the queries that SQL can express.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 9) AS place
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, source_size * 2e0 AS cap,
         sum(source_size) OVER () * 15e-1 - coalesce(sum(source_size * 2e0) OVER before, 0) AS rem,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest
  FROM s WINDOW before AS (ORDER BY source_size * 2e0 / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, max(rem / rest) OVER () * w) AS target FROM c),
b AS (
  SELECT *, target >= source_size AS whole, CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget FROM t),
h AS (
  SELECT d.source, d.place, sum(d.size) AS tokens FROM d GROUP BY ALL),
r AS (
  SELECT h.*, b.budget, sum(tokens) OVER (PARTITION BY h.source ORDER BY place) AS stop
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
x AS (
  SELECT source, min(place) AS place, arg_min(stop - tokens, place) AS start, arg_min(stop, place) AS stop
  FROM r WHERE stop - tokens < budget AND stop >= budget GROUP BY source),
cut AS (
  SELECT b.*, CASE WHEN budget <= 0 THEN '' WHEN x.place IS NULL THEN '~'
                   WHEN x.stop - budget < budget - x.start THEN x.place || '~' ELSE x.place END AS upto
  FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source)
SELECT d.doc_id, d.size::BIGINT AS size, cut.source_size::BIGINT AS source_size, cut.target,
       (d.size * (whole::INT + (d.place < upto)::INT))::BIGINT AS taken
FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""


def _op4_sql() -> str:
    """Every unit against every template it may have, without bounds or marks."""
    rows = ", ".join(f"({n}, '{name}', {license_scan.bigrams_of(text)!r}, {len(license_scan.words_of(text))})" for n, (name, text) in enumerate(license_scan.TEMPLATES))
    normal = f"trim(regexp_replace(translate({{}}, '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    last, sentence = license_scan.LINES - 1, license_scan.SENTENCE
    return rf"""
WITH t(nth, license, grams, size) AS (VALUES {rows}),
l AS (
  SELECT rid, doc_id, len(x) AS n_lines, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
m AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS w
  FROM (SELECT *, {normal.format("line")} AS norm FROM l)),
c AS (SELECT *, sum(w) OVER (PARTITION BY rid ORDER BY i) AS cum, lag(w) OVER (PARTITION BY rid ORDER BY i) AS before FROM m),
near AS (SELECT a.rid, a.i, a.w, a.before, a.cum - a.w AS base, z.i AS j, z.w AS zw, z.cum FROM c a JOIN c z ON a.rid = z.rid AND z.i BETWEEN a.i AND a.i + {last} WHERE a.w > 0),
runs AS (
  SELECT rid, i, nth AS pick, unnest([below, below + 1]) AS k, n
  FROM (SELECT rid, i, nth, count(*) FILTER (WHERE cum - base < size) AS below, count(*) AS n FROM near CROSS JOIN t GROUP BY ALL)),
paras AS (
  SELECT rid, i, -1 AS pick, CASE WHEN z IS NOT NULL THEN z - i WHEN n <= {last} THEN n END AS k, n
  FROM (SELECT rid, i, min(j) FILTER (WHERE zw = 0) AS z, count(*) AS n FROM near WHERE coalesce(before, 0) = 0 GROUP BY ALL)),
u AS (
  SELECT rid, i, i + k - 1 AS j, pick FROM runs WHERE k BETWEEN 2 AND n
  UNION ALL SELECT rid, i, i + k - 1, pick FROM paras WHERE k > 1),
x AS (
  SELECT rid, i, j, pick, x FROM (
    SELECT u.rid, u.i, u.j, u.pick, string_agg(m.norm, ' ' ORDER BY m.i) AS x FROM u JOIN m ON u.rid = m.rid AND m.i BETWEEN u.i AND u.j AND m.norm <> '' GROUP BY ALL)
  UNION ALL SELECT rid, i, i, -1, norm FROM m
  UNION ALL SELECT rid, i, i, -1, {normal.format("x")} FROM (SELECT rid, i, unnest(string_split_regex(line, '{sentence}')) AS x FROM m WHERE regexp_matches(line, '{sentence}'))
  UNION ALL SELECT rid, 0, 0, -1, string_agg(norm, ' ' ORDER BY i) FROM m WHERE n_lines > 1 AND norm <> '' GROUP BY rid),
g AS (
  SELECT rid, i, j, pick, list_distinct(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS grams
  FROM (SELECT rid, i, j, pick, string_split(x, ' ') AS words FROM x) WHERE len(words) > 1),
d AS (
  SELECT rid, i, j, len(g.grams) AS n, t.nth, t.license, 2e0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON g.pick IN (-1, t.nth)),
s AS (
  SELECT * FROM d WHERE dice >= 8e-1
  QUALIFY row_number() OVER (PARTITION BY rid, i ORDER BY dice DESC, nth, j, n) = 1)
SELECT doc_id, s.i::INT AS line_no, s.j::INT AS line_to, license, dice, s.n::INT AS n_bigrams
FROM s JOIN (SELECT DISTINCT rid, doc_id FROM l) USING (rid)
WHERE s.i = 0 OR NOT EXISTS (
  SELECT 1 FROM s v WHERE v.rid = s.rid AND v.i > 0 AND v.i <= s.j AND v.j >= s.i AND (-v.dice, v.nth, v.i, v.j) < (-s.dice, s.nth, s.i, s.j))
"""


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
q AS (SELECT lang, row_number() OVER () AS pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, pid, unnest(w) AS a, unnest(range(len(w))) AS i FROM q),
g AS (SELECT lang, a, lead(a) OVER piece AS b, lead(a, 2) OVER piece AS c FROM t WINDOW piece AS (PARTITION BY pid ORDER BY i)),
f1 AS (SELECT lang, a, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*)::HUGEINT AS f FROM g WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT x.lang, x.a || ' ' || x.b AS phrase, x.f AS a, 1 AS k, y.f AS l, z.f AS r
  FROM f2 x JOIN f1 y ON x.lang = y.lang AND x.a = y.a JOIN f1 z ON x.lang = z.lang AND x.b = z.a WHERE x.f >= 10
  UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 1, y.f, z.f
  FROM f3 x JOIN f1 y ON x.lang = y.lang AND x.a = y.a JOIN f2 z ON x.lang = z.lang AND x.b = z.a AND x.c = z.b
  UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 2, y.f, z.f
  FROM f3 x JOIN f2 y ON x.lang = y.lang AND x.a = y.a AND x.b = y.b JOIN f1 z ON x.lang = z.lang AND x.c = z.a),
low AS (
  SELECT *, 1000000 * a * a // (l * r) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, a || ' ' || b AS phrase, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3) GROUP BY ALL),
best AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN part ON low.lang = part.lang AND low.phrase = part.phrase WHERE part.most IS NULL OR 100 * part.most < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best JOIN (SELECT lang, count(*) AS n FROM t GROUP BY lang) USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": OP11_SQL, "op4_license_scan": _op4_sql(), "op6_mixture": OP6_SQL}
