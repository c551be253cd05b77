"""Notes and specifications: lines of a page bound to keys and sections, and blocks of numbered notes.

Lines are ``doc_id`` (a page, or a column of one), ``place``, ``text``, ``top`` and ``edge`` (the right edge of the first
word).  All forms of notes are bound at once, each as a running count of its key lines; guards over the bound rows tell
which forms hold, and the first of those in the fixed order is the page's.  States are folded over one page's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

#: What begins a numbered, lettered or tagged note, a section and a sub-section, a block of notes.
NUMBERED, LETTERED, TAGGED = r"^\s*\(?([0-9]{1,3})\s*[.):]\s*", r"^\s*\(?([A-Za-z])\s*[.):]\s*", r"^\s*([A-Z]{1,3}[-.]?[0-9]{1,3}[A-Z]?)[\s.:)]"
STRONG = (
    r"(?i)^\s*(PART\s+[0-9]+\b|SECTION\s+[0-9]{2,}(?:\s+[0-9]{2,}){0,2}|SPECIFICATIONS?\b|(?:[A-Z][A-Z&]{0,15}(?:\s+[A-Z][A-Z&]{0,15}){0,3}\s+)?(?:GENERAL\s+(?:CONSTRUCTION\s+)?)?NOTES?\b|ABBREVIATIONS?\b|LEGEND\b|SYMBOLS?\b)"
)
SUB = r"^\s*([0-9]{1,2}\.[0-9]{1,2})(?:\s|$)"
BLOCK_HEADER, BLOCK_NUMBER = r"(?i)^(?:GENERAL\s+)?NOTES?:?\s*$", r"^([0-9]+)\.\s*"
#: Forms in the order in which they are tried; spread of the tags' edges; share of odd ones; nearness of a line.
FORMS = ("numbered", "tagged", "lettered", "sections")
SPREAD, ODD_TAGS, ODD_LETTERS, SAME_LINE = 0.02, 0.25, 0.2, 0.02


def _first(text: Column) -> Column:
    return F.split(text, " ")[0]


def bound(lines: DataFrame) -> DataFrame:
    """Rows of every form on every page: ``doc_id, form, nth, key, note, top, lines``, with ``edges`` of the key lines.

    Lines before the first key belong to no note; before the first section they are a preamble with an empty key.
    """
    t = F.trim("text")
    is_key = {"numbered": _first(t).rlike(NUMBERED), "tagged": t.rlike(TAGGED), "lettered": _first(t).rlike(LETTERED), "sections": t.rlike(STRONG)}
    key = {"numbered": F.regexp_extract(t, NUMBERED, 1), "tagged": F.regexp_extract(t, TAGGED, 1), "lettered": F.regexp_extract(t, LETTERED, 1), "sections": t}
    rest = {"numbered": F.regexp_replace(t, NUMBERED, ""), "tagged": F.regexp_replace(t, TAGGED, ""), "lettered": F.regexp_replace(t, LETTERED, ""), "sections": F.lit("")}
    one = [F.struct(F.lit(f).alias("form"), is_key[f].alias("is_key"), F.when(is_key[f], key[f]).alias("key"), F.when(is_key[f], F.trim(rest[f])).otherwise(t).alias("part")) for f in FORMS]
    rows = lines.where(t != "").select("doc_id", "place", "top", "edge", F.inline(F.array(*one)))
    order = W.partitionBy("doc_id", "form").orderBy("place")  # the lines of one page
    rows = rows.withColumn("nth", F.sum(F.col("is_key").cast("int")).over(order)).where((F.col("nth") > 0) | (F.col("form") == "sections"))
    parts = F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("place", "part"))))
    return rows.groupBy("doc_id", "form", "nth").agg(
        F.coalesce(F.max("key"), F.lit("")).alias("key"), F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("note"), F.min("top").alias("top"), F.count("*").alias("lines"),
        F.max(F.when(F.col("is_key"), F.col("edge"))).alias("edge"),
    )


def parsed(lines: DataFrame) -> DataFrame:
    """The notes of each page in its form: ``doc_id, form, nth`` (from 1), ``key, note, top, lines``; pages of no form have none.

    Letters must mostly go on by one or two; tags must stand in one column and mostly share their letters; sections need a
    strong header.
    """
    rows = bound(lines)
    page = W.partitionBy("doc_id", "form")
    code = F.ascii(F.upper("key"))
    step = F.when(F.col("form") == "lettered", code - F.lag(code).over(page.orderBy("nth")))
    letters = F.upper(F.regexp_replace("key", r"[0-9.\-]+", ""))
    n, go_on = F.count("*"), F.count_if(F.col("step").between(1, 2))
    told = rows.withColumn("step", step).groupBy("doc_id", "form").agg(
        n.alias("n"), go_on.alias("on"), F.count_if(F.col("step").isNotNull() & ~F.col("step").between(1, 2)).alias("off"), F.stddev_pop("edge").alias("spread"), F.count_distinct(letters).alias("kinds"), F.max("nth").alias("strong"),
    )
    odd = F.floor(F.col("n") * ODD_LETTERS)
    good = (
        F.when(F.col("form") == "numbered", True).when(F.col("form") == "tagged", (F.col("n") >= 2) & (F.round("spread", 9) <= SPREAD) & (F.col("kinds") <= F.greatest(F.lit(1), F.floor(F.col("n") * ODD_TAGS))))
        .when(F.col("form") == "lettered", (F.col("n") >= 2) & (F.col("on") >= F.col("n") - 1 - F.ceil(F.col("n") * ODD_LETTERS)) & (F.col("off") <= F.greatest(F.lit(1), odd))).otherwise(F.col("strong") > 0)
    )
    rank = F.array_position(F.array(*map(F.lit, FORMS)), F.col("form"))
    form = told.where(good).groupBy("doc_id").agg(F.min_by("form", rank).alias("form"))
    out = rows.join(form, ["doc_id", "form"]).where((F.col("key") != "") | (F.col("note") != ""))
    key = F.when(F.col("key") == "", "(preamble)").otherwise(F.col("key"))
    return out.select("doc_id", "form", F.row_number().over(page.orderBy("nth")).alias("nth"), key.alias("key"), "note", "top", "lines")


def spec_sections(lines: DataFrame, sub_sections: bool = True) -> DataFrame:
    """Sections of pages: ``doc_id, section, header, body``; numbers like 1.01 open one too, after the first strong header.

    What comes before the first header has an empty one; pages without a strong header have none.
    """
    t = F.trim("text")
    order = W.partitionBy("doc_id").orderBy("place")
    rows = lines.where(t != "").select("doc_id", "place", t.alias("t"), t.rlike(STRONG).alias("strong"), t.rlike(SUB).alias("sub"))
    seen = F.coalesce(F.bool_or("strong").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    opens = F.col("strong") | (F.col("sub") & seen) if sub_sections else F.col("strong")
    rows = rows.withColumn("opens", opens).withColumn("any", F.bool_or("strong").over(W.partitionBy("doc_id"))).where("any")
    rows = rows.withColumn("section", F.sum(F.col("opens").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("place", "t"))))
    return rows.groupBy("doc_id", "section").agg(F.coalesce(F.max(F.when(F.col("opens"), F.col("t"))), F.lit("")).alias("header"), F.array_join(F.transform(body, lambda p: p["t"]), " ").alias("body"))


def note_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of two notes or more: ``doc_id, block, title, notes, text``.

    A header opens a block, and so does a note with number one where none is open; numbered lines are its notes; a line at
    the height of the one before goes on with the last note, any other closes a block that has notes.

    A header or a first note leaves the same state whatever came before, so lines fall into stretches that begin with one
    of them; within a stretch the state follows from its first note and the first line after it that closes.
    """
    t = F.trim("text")
    order = W.partitionBy("doc_id").orderBy("place")
    number = F.regexp_extract(t, BLOCK_NUMBER, 1)
    near = F.coalesce(F.abs(F.round(F.col("top") - F.lag("top").over(order), 9)) < SAME_LINE / 2, F.lit(False))
    kind = F.when(t.rlike(BLOCK_HEADER), "header").when(number == "1", "first").when(number != "", "note").when(near, "on").otherwise("stop")
    rows = lines.select("doc_id", "place", t.alias("t"), kind.alias("kind"))
    rows = rows.withColumn("stretch", F.sum(F.when(F.col("kind").isin("header", "first"), 1).otherwise(0)).over(order)).where("stretch > 0")
    at = W.partitionBy("doc_id", "stretch")
    begun = F.min(F.when(F.col("kind").isin("first", "note"), F.col("place"))).over(at)
    rows = rows.withColumn("begun", begun)
    rows = rows.withColumn("closed", F.min(F.when((F.col("kind") == "stop") & (F.col("place") > F.col("begun")), F.col("place"))).over(at))
    heads = rows.groupBy("doc_id", "stretch").agg(F.min_by("kind", "place").alias("opens"), F.min_by("t", "place").alias("title"), F.max("begun").alias("begun"), F.max("closed").alias("closed"))
    by = W.partitionBy("doc_id").orderBy("stretch")
    # a first note opens a block of its own only where the stretch before has closed, or there is none
    open_ = F.lag("closed").over(by).isNull() & F.lag("stretch").over(by).isNotNull()
    heads = heads.withColumn("open", open_).withColumn("block", F.sum(F.when((F.col("opens") == "header") | ~F.col("open"), 1).otherwise(0)).over(by))
    inside = rows.drop("begun", "closed").join(heads.select("doc_id", "stretch", "block", "begun", "closed"), ["doc_id", "stretch"])
    inside = inside.where((F.col("place") >= F.col("begun")) & (F.col("closed").isNull() | (F.col("place") < F.col("closed"))))
    title = heads.groupBy("doc_id", "block").agg(F.min_by(F.when(F.col("opens") == "header", F.col("title")).otherwise("NOTES"), "stretch").alias("title"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), " ")
    found = inside.groupBy("doc_id", "block").agg(F.count_if(F.col("kind").isin("first", "note")).alias("notes"), text.alias("text")).where("notes >= 2")
    out = found.join(title, ["doc_id", "block"])
    return out.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("block")).alias("block"), "title", "notes", "text")


# --- the queries -----------------------------------------------------------------------------------------------------


def note_lines(spark, sf_dir) -> DataFrame:
    """Lines of the laid-out texts, and twelve parts a page as lists in five forms."""
    a = views.layout(spark, sf_dir).select("doc_id", F.col("n").alias("place"), "text", F.col("miny").alias("top"), F.round(F.col("minx") + F.char_length(_first(F.col("text"))) * F.lit(11e-3), 9).alias("edge"))
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    k, page = (F.col("p_partkey") % 12).cast("int"), F.floor(F.col("p_partkey") / 12)
    f, num = page % 5, F.col("p_partkey") % 12
    s = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    name, third = F.col("p_name"), F.floor(num / 4) + 1
    text = (
        F.when((f == 0) & (num == 0), "GENERAL NOTES").when((f == 0) & (num % 4 != 3), s(num, ". ", name)).when((f == 1) & (num % 3 != 2), s("K-", F.lpad(num.cast("string"), 2, "0"), " ", name))
        .when(f == 2, s(F.char(65 + num), ". ", name)).when((f == 3) & (num % 4 == 0), s("PART ", third, " - ", F.upper("p_type"))).when((f == 3) & (num % 4 == 1), s(third, ".0", num, " ", name))
        .when(f == 4, s(F.char(65 + num * 7 % 26), ") ", name)).otherwise(name)
    )
    b = p.select(s("P/", page).alias("doc_id"), k.alias("place"), text.alias("text"), F.round(F.lit(5e-2) + num * F.lit(2e-2) - F.when((f == 0) & (num % 4 == 3), 2e-2).otherwise(0e0), 9).alias("top"))
    return a.unionByName(b.withColumn("edge", F.round(F.lit(1e-1) + F.char_length(_first(F.col("text"))) * F.lit(1e-2), 9)))


_LINES = """v_notes AS (SELECT doc_id, n AS place, text, miny AS top, round(minx + len(split_part(text, ' ', 1)) * 11e-3, 9) AS edge FROM v_layout
UNION ALL SELECT 'P/' || pg, num::INT, text, round(5e-2 + num * 2e-2 - CASE WHEN f = 0 AND num % 4 = 3 THEN 2e-2 ELSE 0e0 END, 9), round(1e-1 + len(split_part(text, ' ', 1)) * 1e-2, 9) FROM (
SELECT *, CASE WHEN f = 0 AND num = 0 THEN 'GENERAL NOTES' WHEN f = 0 AND num % 4 <> 3 THEN num || '. ' || p_name WHEN f = 1 AND num % 3 <> 2 THEN 'K-' || lpad(num::VARCHAR, 2, '0') || ' ' || p_name WHEN f = 2 THEN chr((65 + num)::INT) || '. ' || p_name
  WHEN f = 3 AND num % 4 = 0 THEN 'PART ' || (num // 4 + 1) || ' - ' || upper(p_type) WHEN f = 3 AND num % 4 = 1 THEN (num // 4 + 1) || '.0' || num || ' ' || p_name WHEN f = 4 THEN chr((65 + num * 7 % 26)::INT) || ') ' || p_name ELSE p_name END AS text
FROM (SELECT p_name, p_type, p_partkey // 12 AS pg, p_partkey // 12 % 5 AS f, p_partkey % 12 AS num FROM part)))"""


def _bound_sql() -> str:
    t, first = "trim(text)", "split_part(trim(text), ' ', 1)"
    test = {"numbered": (first, NUMBERED), "tagged": (t, TAGGED), "lettered": (first, LETTERED), "sections": (t, STRONG)}
    parts = []
    for f in FORMS:
        c, p = test[f]
        key, rest = (t, "''") if f == "sections" else (f"regexp_extract({t}, '{p}', 1)", f"trim(regexp_replace({t}, '{p}', ''))")
        hit = f"regexp_matches({c}, '{p}')"
        parts.append(f"SELECT doc_id, '{f}' AS form, place, top, edge, {hit} AS is_key, CASE WHEN {hit} THEN {key} END AS key, CASE WHEN {hit} THEN {rest} ELSE {t} END AS part FROM v_notes WHERE {t} <> ''")
    return f"""one AS ({' UNION ALL '.join(parts)}),
run AS (SELECT *, sum(is_key::INT) OVER (PARTITION BY doc_id, form ORDER BY place) AS nth FROM one),
bound AS (SELECT doc_id, form, nth, coalesce(max(key), '') AS key, coalesce(string_agg(part, ' ' ORDER BY place) FILTER (part <> ''), '') AS note, min(top) AS top, count(*) AS lines, max(edge) FILTER (is_key) AS edge FROM run WHERE nth > 0 OR form = 'sections' GROUP BY ALL)"""


@register("w10_key_binding", oracle("v_layout", f"WITH {_LINES}, {_bound_sql()} SELECT doc_id, form, nth::BIGINT AS nth, key, note, lines FROM bound WHERE form <> 'sections'"))
def w10(spark, sf_dir):
    """Numbered, tagged and lettered keys with the lines that follow them."""
    return bound(note_lines(spark, sf_dir)).where("form <> 'sections'").select("doc_id", "form", "nth", "key", "note", "lines")


@register("t11_parsed_notes", oracle("v_layout", f"""WITH {_LINES}, {_bound_sql()},
step AS (SELECT *, CASE WHEN form = 'lettered' THEN ascii(upper(key)) - ascii(upper(lag(key) OVER (PARTITION BY doc_id, form ORDER BY nth))) END AS step FROM bound),
told AS (SELECT doc_id, form, count(*) AS n, count(*) FILTER (step BETWEEN 1 AND 2) AS go, count(*) FILTER (step IS NOT NULL AND NOT step BETWEEN 1 AND 2) AS off, stddev_pop(edge) AS spread, count(DISTINCT upper(regexp_replace(key, '[0-9.\\-]+', '', 'g'))) AS kinds, max(nth) AS strong FROM step GROUP BY ALL),
good AS (SELECT doc_id, arg_min(form, list_position(['numbered', 'tagged', 'lettered', 'sections'], form)) AS form FROM told WHERE CASE form WHEN 'numbered' THEN true WHEN 'tagged' THEN n >= 2 AND round(spread, 9) <= 2e-2 AND kinds <= greatest(1, floor(n * 25e-2))
  WHEN 'lettered' THEN n >= 2 AND go >= n - 1 - ceil(n * 2e-1) AND off <= greatest(1, floor(n * 2e-1)) ELSE strong > 0 END GROUP BY doc_id)
SELECT doc_id, form, row_number() OVER (PARTITION BY doc_id ORDER BY nth)::INT AS nth, CASE key WHEN '' THEN '(preamble)' ELSE key END AS key, note, round(top, 6) AS top, lines FROM bound JOIN good USING (doc_id, form) WHERE key <> '' OR note <> ''"""))
def t11(spark, sf_dir):
    """Notes of all pages, each in the first form that holds for it."""
    return parsed(note_lines(spark, sf_dir)).withColumn("top", F.round("top", 6))


@register("w12_spec_sections", oracle("v_layout", f"""WITH {_LINES},
r AS (SELECT doc_id, place, trim(text) AS t, regexp_matches(trim(text), '{STRONG}') AS strong, regexp_matches(trim(text), '{SUB}') AS sub FROM v_notes WHERE trim(text) <> ''),
o AS (SELECT *, strong OR (sub AND coalesce(bool_or(strong) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS opens, bool_or(strong) OVER (PARTITION BY doc_id) AS any_ FROM r),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM o WHERE any_)
SELECT doc_id, section::BIGINT AS section, coalesce(max(t) FILTER (opens), '') AS header, coalesce(string_agg(t, ' ' ORDER BY place) FILTER (NOT opens), '') AS body FROM s GROUP BY ALL"""))
def w12(spark, sf_dir):
    """Sections and sub-sections of pages that have a strong header."""
    return spec_sections(note_lines(spark, sf_dir))


@register("w14_note_machine", oracle("v_layout", f"""WITH RECURSIVE {_LINES},
k AS (SELECT doc_id, row_number() OVER o AS i, trim(text) AS t, CASE WHEN regexp_matches(trim(text), '{BLOCK_HEADER}') THEN 'header' WHEN regexp_extract(trim(text), '{BLOCK_NUMBER}', 1) = '1' THEN 'first' WHEN regexp_extract(trim(text), '{BLOCK_NUMBER}', 1) <> '' THEN 'note'
  WHEN coalesce(abs(round(top - lag(top) OVER o, 9)) < 1e-2, false) THEN 'on' ELSE 'stop' END AS kind FROM v_notes WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
m AS (SELECT doc_id, 0::BIGINT AS i, 0 AS state, 0 AS block, '' AS title, false AS taken, '' AS t, '' AS kind FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT k.doc_id, k.i, CASE WHEN k.kind = 'header' THEN 1 WHEN k.kind = 'first' THEN 2 WHEN k.kind = 'note' THEN CASE state WHEN 0 THEN 0 ELSE 2 END WHEN state = 2 AND k.kind = 'stop' THEN 0 ELSE state END,
    block + CASE WHEN k.kind = 'header' OR (k.kind = 'first' AND state = 0) THEN 1 ELSE 0 END, CASE WHEN k.kind = 'header' THEN k.t WHEN k.kind = 'first' AND state = 0 THEN 'NOTES' ELSE title END,
    k.kind = 'first' OR (k.kind = 'note' AND state > 0) OR (k.kind = 'on' AND state = 2), k.t, k.kind FROM m JOIN k ON k.doc_id = m.doc_id AND k.i = m.i + 1),
b AS (SELECT doc_id, block, max(title) AS title, count(*) FILTER (kind <> 'on') AS notes, string_agg(t, ' ' ORDER BY i) AS text FROM m WHERE taken GROUP BY ALL HAVING count(*) FILTER (kind <> 'on') >= 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block)::INT AS block, title, notes, text FROM b""").replace("WITH v_layout AS", "WITH RECURSIVE v_layout AS").replace(", RECURSIVE v_notes AS", ", v_notes AS"))
def w14(spark, sf_dir):
    """Blocks of numbered notes under their headers."""
    return note_blocks(note_lines(spark, sf_dir))
