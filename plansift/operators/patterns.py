"""Patterns of tags inferred from examples, and abbreviations by a dictionary and by frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.functions.text import upper
from plansift.operators.takeoff import tag_shape
from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

#: Examples that a pattern needs, the share of one shape, and of two together.
EXAMPLES, ONE, TWO = 3, 0.75, 0.85


def tag_patterns(tags: DataFrame, on: str) -> DataFrame:
    """``on, pattern, strength, examples``: the expression that the tags of a group follow.

    The commonest shape (letters and digits by kind) counts if three quarters of the examples have it, else the two
    commonest if 85 % have one of them, else the group has none.  Digits are any, letters those seen at their place; a
    pattern without letters is weak.  Groups of fewer than three tags, or of one only, have none.
    """
    v = tags.select(on, F.upper(F.trim("tag")).alias("tag")).where("tag <> ''").withColumn("shape", tag_shape(F.col("tag")))
    by = W.partitionBy(on)
    n = v.groupBy(on, "shape").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("kinds"))
    n = n.select("*", F.row_number().over(by.orderBy(F.desc("n"), "shape")).alias("nth"), F.sum("n").over(by).alias("all"), F.sum("kinds").over(by).alias("distinct"))
    n = n.where((F.col("all") >= EXAMPLES) & (F.col("distinct") >= 2) & (F.col("nth") <= 2))
    share = lambda upto: F.sum(F.when(F.col("nth") <= upto, F.col("n"))).over(by) / F.col("all")
    n = n.withColumn("single", share(1) >= ONE).withColumn("pair", (share(2) >= TWO) & (F.count("*").over(by) == 2))
    chosen = n.where((F.col("single") & (F.col("nth") == 1)) | (~F.col("single") & F.col("pair"))).select(on, "shape", "nth", "all")
    at = v.join(chosen, [on, "shape"]).select(on, "shape", "nth", "all", F.posexplode(F.split("tag", "")).alias("p", "c"))
    kind = F.substring("shape", F.col("p") + 1, F.lit(1))
    seen = F.sort_array(F.collect_set("c"))  # characters of one place
    literal = F.when(F.get(seen, F.lit(0)).rlike(r"[.*+?^${}()|\[\]\\]"), F.concat(F.lit("\\"), F.get(seen, F.lit(0)))).otherwise(F.get(seen, F.lit(0)))
    letters = F.when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(seen, ""), F.lit("]")))
    token = at.groupBy(on, "shape", "nth", "all", "p", kind.alias("kind")).agg(F.when(F.col("kind") == "d", "\\d").when(F.col("kind") == "L", letters).otherwise(literal).alias("token"))
    along = W.partitionBy(on, "shape").orderBy("p")
    goes_on = F.col("kind").isin("d", "L") & (F.col("kind") == F.lag("kind").over(along)) & (F.col("token") == F.lag("token").over(along))
    runs = token.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(along))
    runs = runs.groupBy(on, "shape", "nth", "all", "run", "token", "kind").agg(F.count("*").alias("k"))
    part = F.when(F.col("k") > 1, F.concat("token", F.lit("{"), F.col("k").cast("string"), F.lit("}"))).otherwise(F.col("token"))
    one = runs.groupBy(on, "nth", "all").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", part.alias("s")))), lambda x: x["s"]), "").alias("s"), F.bool_or(F.col("kind") == "L").alias("letters"))
    out = one.groupBy(on, "all").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "s"))), lambda x: x["s"]), "|").alias("s"), F.count("*").alias("shapes"), F.bool_or("letters").alias("letters"))
    pattern = F.when(F.col("shapes") == 1, F.concat(F.lit("^"), "s", F.lit("$"))).otherwise(F.concat(F.lit("^(?:"), "s", F.lit(")$")))
    return out.select(on, pattern.alias("pattern"), F.when(F.col("letters"), "strong").otherwise("weak").alias("strength"), F.col("all").alias("examples"))


@register("a43_tag_patterns", r"""
WITH v AS (SELECT p_type, upper(trim(p_brand)) AS tag, regexp_replace(regexp_replace(upper(trim(p_brand)), '[A-Z]', 'L', 'g'), '[0-9]', 'd', 'g') AS shape FROM part WHERE trim(p_brand) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, shape) AS nth, sum(n) OVER (PARTITION BY p_type) AS total, sum(kinds) OVER (PARTITION BY p_type) AS kinds_all FROM (SELECT p_type, shape, count(*) AS n, count(DISTINCT tag) AS kinds FROM v GROUP BY ALL)),
m AS (SELECT *, max(n) OVER (PARTITION BY p_type) / total >= 75e-2 AS single, sum(n) OVER (PARTITION BY p_type) / total >= 85e-2 AND count(*) OVER (PARTITION BY p_type) = 2 AS pair FROM n WHERE total >= 3 AND kinds_all >= 2 AND nth <= 2),
c AS (SELECT * FROM m WHERE (single AND nth = 1) OR (NOT single AND pair)),
p AS (SELECT c.p_type, c.shape, nth, total, unnest(range(1, len(tag) + 1)) AS p, tag FROM v JOIN c ON v.p_type = c.p_type AND v.shape = c.shape),
t AS (SELECT p_type, shape, nth, total, p, shape[p] AS kind, list_sort(list(DISTINCT tag[p])) AS seen FROM p GROUP BY ALL),
k AS (SELECT *, CASE WHEN kind = 'd' THEN '\d' WHEN kind = 'L' AND len(seen) > 1 THEN '[' || array_to_string(seen, '') || ']' WHEN kind <> 'L' AND regexp_matches(seen[1], '[.*+?^${}()|\[\]\\]') THEN '\' || seen[1] ELSE seen[1] END AS token FROM t),
r AS (SELECT *, sum(CASE WHEN kind IN ('d', 'L') AND kind = before AND token = token_before THEN 0 ELSE 1 END) OVER (PARTITION BY p_type, shape ORDER BY p) AS run FROM (SELECT *, lag(kind) OVER o AS before, lag(token) OVER o AS token_before FROM k WINDOW o AS (PARTITION BY p_type, shape ORDER BY p))),
g AS (SELECT p_type, nth, total, run, kind, token || CASE WHEN count(*) > 1 THEN '{' || count(*) || '}' ELSE '' END AS s FROM r GROUP BY p_type, nth, total, run, kind, token),
w AS (SELECT p_type, nth, total, string_agg(s, '' ORDER BY run) AS s, bool_or(kind = 'L') AS letters FROM g GROUP BY ALL)
SELECT p_type, CASE WHEN count(*) = 1 THEN '^' || min(s) || '$' ELSE '^(?:' || string_agg(s, '|' ORDER BY nth) || ')$' END AS pattern, CASE WHEN bool_or(letters) THEN 'strong' ELSE 'weak' END AS strength, total::BIGINT AS examples FROM w GROUP BY p_type, total""")
def a43(spark, sf_dir):
    """The pattern of the brands of each type of parts."""
    return tag_patterns(read(spark, sf_dir, "part", "p_type", F.col("p_brand").alias("tag")), "p_type")


#: Words in capitals that are no abbreviations.
PLAIN = (
    "THE AND FOR ARE BUT NOT YOU ALL CAN HER WAS ONE OUR OUT HAS HIS HOW ITS LET MAY NEW NOW OLD SEE WAY WHO BOY DID GET HIM HIT HOT MAP MOM SET SIT TOP TWO RED RUN USE PER MAX MIN REF FROM THAT WITH THIS HAVE WILL "
    "EACH MAKE LIKE BEEN CALL COME THAN INTO ONLY OVER SUCH TAKE THEM VERY WHEN ALSO BACK JUST KNOW SOME THEY WHAT PLAN AREA ROOM WALL DOOR ROOF PIPE DUCT WIRE BEAM SLAB NOTE TYPE SIZE HIGH WIDE LONG DEEP OPEN FLAT "
    "INCH FEET FOOT YARD MILE WEST EAST NORTH SOUTH LEFT RIGHT DATE NONE MARK LINE"
).split()
#: How often an unknown word must stand on a page, and what both kinds are worth.
OFTEN, KNOWN, UNKNOWN = 5, 0.85, 0.5


def abbreviations(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, idx, tok, meaning, frequency, confidence``: words of the dictionary (``abbreviation, meaning``), whatever
    their case and with or without a full stop, and other words of three to five capitals that a page has five times."""
    d = dictionary.groupBy(upper(F.col("abbreviation")).alias("key")).agg(F.min("meaning").alias("meaning"))
    w = words.select("doc_id", "idx", "tok", upper(F.regexp_replace("tok", r"[.]+$", "")).alias("key"))
    capital = F.col("tok").rlike("^[A-Z]{3,5}$") & ~F.col("tok").isin(*PLAIN)
    j = w.join(d, "key", "left").withColumn("caps", capital).where(F.col("meaning").isNotNull() | F.col("caps"))
    # only words that may be abbreviations are counted
    j = j.withColumn("n", F.sum(F.col("caps").cast("int")).over(W.partitionBy("doc_id", "tok")))
    known = F.col("meaning").isNotNull()
    out = j.where(known | (F.col("n") >= OFTEN))
    return out.select("doc_id", "idx", "tok", "meaning", F.when(~known, F.col("n")).alias("frequency"), F.when(known, KNOWN).otherwise(UNKNOWN).alias("confidence"))


_PLAIN = ", ".join(f"'{w}'" for w in PLAIN)


@register("d07_abbreviations", oracle("v_word", f"""
WITH d AS (SELECT key, min(meaning) AS meaning FROM (SELECT upper(substr(n_name, 1, 2)) AS key, n_name AS meaning FROM nation UNION ALL SELECT upper(substr(p_name, 1, 2)), p_name FROM part) GROUP BY key),
w AS (SELECT doc_id, idx, tok, upper(regexp_replace(tok, '[.]+$', '')) AS key, regexp_matches(tok, '^[A-Z]{{3,5}}$') AND tok NOT IN ({_PLAIN}) AS caps FROM v_word),
j AS (SELECT w.*, meaning, count(*) FILTER (caps) OVER (PARTITION BY doc_id, tok) AS n FROM w LEFT JOIN d USING (key))
SELECT doc_id, idx, tok, meaning, CASE WHEN meaning IS NULL THEN n END AS frequency, CASE WHEN meaning IS NOT NULL THEN 85e-2 ELSE 5e-1 END AS confidence FROM j WHERE meaning IS NOT NULL OR (caps AND n >= 5)"""))
def d07(spark, sf_dir):
    """Abbreviations on pages: those of a dictionary (here of nations and parts) and unknown ones that recur."""
    nation, part = read(spark, sf_dir, "nation", "n_name"), read(spark, sf_dir, "part", "p_name")
    dictionary = nation.select(F.substring("n_name", 1, 2).alias("abbreviation"), F.col("n_name").alias("meaning")).union(part.select(F.substring("p_name", 1, 2), "p_name"))
    return abbreviations(views.word(spark, sf_dir), dictionary)
