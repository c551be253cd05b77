"""Derived views: pages, words, lines, detections, taxonomy, references, visits and schedules from the star schema.

Each view exists twice, as a DataFrame and as SQL for the oracle, in formulas that both engines evaluate alike: integer
arithmetic, and coordinates from the same double expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.sources.tables import read

PREFIXES = ("A", "S", "M", "E", "P", "C", "FP", "G")
CLASSES = ("tables", "grid", "title_block", "drawings", "text_box", "vertical_area", "horizontal_area")
DIVISIONS = (
    "01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12",
    "13", "14", "21", "22", "23", "25", "26", "27", "28", "31", "32", "33",
)
TRADES = ("Architectural", "Structural", "Mechanical", "Electrical", "Plumbing", "Civil")
PER_LINE, LINES = 12, 60


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], index: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({index}) % {len(values)} + 1]"


def n_documents(spark: SparkSession, sf_dir: str) -> Column:
    """The number of documents, as a scalar subquery: nothing runs before the query itself does."""
    return read(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "source").distinct().select(F.col("source").alias("project_id"), F.concat(F.lit("Project "), "source").alias("name"))


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    number = F.concat(pick(PREFIXES, F.col("doc_id")), F.lit("-"), (100 + F.col("doc_id") % 700).cast("string"))
    return d.select(F.col("source").alias("project_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("raw_text"), number.alias("drawing_number"), "lang")


def word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts, twelve to a line and sixty lines to a sheet.

    Texts are dealt out by page before they are split, so that what is grouped or joined by page moves no word again.
    """
    return word_of(read(spark, sf_dir, "documents", "doc_id", "text").repartition("doc_id"))


def word_of(pages: DataFrame) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = pages.select("doc_id", F.posexplode(words).alias("idx", "tok"))
    idx, row = F.col("idx"), F.floor(F.col("idx") / PER_LINE).cast("int")
    return d.select(
        "doc_id", "idx", "tok", F.floor(idx / (PER_LINE * LINES)).cast("int").alias("sheet"), row.alias("line_idx"),
        ((idx % PER_LINE) * F.lit(8e-2) + F.lit(2e-2)).alias("l"), ((row % LINES) * F.lit(16e-3) + F.lit(2e-2)).alias("t"),
        F.lit(7e-2).alias("w"), F.lit(12e-3).alias("h"),
    )


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", "tok")))
    text = F.array_join(F.transform(ordered, lambda x: x["tok"]), " ")
    return word(spark, sf_dir).groupBy("doc_id", "sheet", "line_idx").agg(text.alias("text"), F.min("t").alias("t"), F.count("*").alias("n_words"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts set in two columns: their own lines, cut after six words, short lines in taller type, a gap between lines
    and hanging indents.  A page (``doc_id`` names document and sheet) has a hundred places for lines."""
    d = read(spark, sf_dir, "documents", F.col("doc_id").alias("doc"), "text").repartition("doc")
    # a line's place follows from the pieces and lines before it: a text is cut within its row, nothing is sorted or dealt
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda s: F.filter(F.split(s, r"\s+"), lambda x: x != "")), lambda ws: F.size(ws) > 0)
    parts = lambda ws, i: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 6).cast("int")),
        lambda k: F.struct(i.alias("line"), F.size(ws).alias("in_line"), k.alias("seg"), F.slice(ws, k * 6 + 1, 6).alias("ws")),
    )
    c = d.select("doc", lines.alias("lines")).select("doc", F.posexplode(F.flatten(F.transform("lines", parts))).alias("at", "x")).select("doc", "at", "x.*")
    pos = (F.col("at") + 2 * F.col("line")).cast("long")
    e = c.select("doc", (F.col("at") + 1).alias("n"), "in_line", "seg", F.array_join("ws", " ").alias("text"), F.size("ws").alias("words"), pos.alias("pos"))
    left = F.lit(5e-2) + F.floor((F.col("pos") % 100) / 50) * F.lit(5e-1) + F.when(F.col("seg") == 0, F.lit(0e0)).otherwise(F.lit(3e-2))
    top = F.lit(4e-2) + (F.col("pos") % 50) * F.lit(18e-3)
    f = e.select(F.concat("doc", F.lit("/"), F.floor(F.col("pos") / 100).cast("string")).alias("doc_id"), "n", "text", "words", F.round(left, 9).alias("minx"), F.round(top, 9).alias("miny"),
                 F.least(F.lit(4e-1), F.char_length("text") * F.lit(11e-3)).alias("w"), F.when(F.col("in_line") <= 3, F.lit(2e-2)).otherwise(F.lit(12e-3)).alias("h"))
    return f.select("doc_id", "n", "text", "words", "minx", "miny", F.round(F.col("minx") + F.col("w"), 9).alias("maxx"), F.round(F.col("miny") + F.col("h"), 9).alias("maxy"))


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from line items, dealt out by page; rows alike in all columns are one detection."""
    n = n_documents(spark, sf_dir)
    i = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    minx, miny = (F.col("l_partkey") % 80) / F.lit(1e2), (F.col("l_suppkey") % 80) / F.lit(1e2)
    return i.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("det_id"),
        (F.col("l_orderkey") % n).alias("doc_id"), pick(CLASSES, (F.col("l_linenumber") - 1)).alias("name"),
        minx.alias("minx"), miny.alias("miny"), (minx + F.lit(5e-2) + (F.col("l_quantity").cast("int") % 10) / F.lit(1e2)).alias("maxx"),
        (miny + F.lit(4e-2) + F.col("l_discount").cast("double")).alias("maxy"), (F.lit(2e-1) + F.col("l_tax").cast("double") * F.lit(1e1)).alias("conf"),
    ).repartition("doc_id").distinct()


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with descriptions: the first six lower-case tokens of a benchmark text."""
    b = read(spark, sf_dir, "benchmark", "item_id", "text")
    two = lambda k: F.lpad(((F.col("item_id") * k) % 100).cast("string"), 2, "0")
    div = pick(DIVISIONS, F.col("item_id"))
    tokens = F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""), 1, 6)
    rows = b.select(F.concat_ws(" ", div, two(7), two(13)).alias("code"), F.array_join(tokens, " ").alias("description"), pick(TRADES, F.col("item_id")).alias("trade"), div.alias("division"), "item_id")
    first = F.min_by(F.struct("description", "trade", "division"), "item_id").alias("x")
    return rows.groupBy("code").agg(first).select("code", "x.*")


def cross_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_documents(spark, sf_dir)
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.select((F.col("o_orderkey") % n).alias("from_doc"), (F.col("o_custkey") % n).alias("to_doc")).where("from_doc <> to_doc")


def visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    return e.select(
        ts.alias("ts"), F.concat(F.lit("10.0."), (F.floor(F.col("user_id") / 256) % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(ts, "yyyyMMdd")).alias("session_id"),
        F.when(kind == "purchase", "POST").when(kind == "signup", "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/"), kind).alias("path"), F.when(kind == "error", 404).otherwise(200).alias("status"), F.col("value").alias("latency"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_size", "p_brand")
    return p.select("p_partkey", F.concat(F.lit("D-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("tag"), "p_type", "p_size", "p_brand")


def page_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of pages: the description occurs as a phrase in the page's lower-case words."""
    from plansift.operators.taxonomy import text_hits

    texts = read(spark, sf_dir, "documents", "doc_id", "text")
    return text_hits(texts, taxonomy(spark, sf_dir)).join(taxonomy(spark, sf_dir), "code").select("doc_id", "code", "division", "trade")


SQL = {
    "v_project": "SELECT DISTINCT source AS project_id, 'Project ' || source AS name FROM documents",
    "v_page": f"SELECT source AS project_id, doc_id AS page_number, text AS raw_text, {_pick_sql(PREFIXES, 'doc_id')} || '-' || (100 + doc_id % 700) AS drawing_number, lang FROM documents",
    "v_word": rf"""SELECT doc_id, idx::INT AS idx, tok, (idx // 720)::INT AS sheet, (idx // 12)::INT AS line_idx,
        (idx % 12) * 8e-2 + 2e-2 AS l, ((idx // 12) % 60) * 16e-3 + 2e-2 AS t, 7e-2 AS w, 12e-3 AS h
      FROM (SELECT doc_id, unnest(x) AS tok, unnest(range(len(x))) AS idx
            FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '') AS x FROM documents))""",
    "v_line": "SELECT doc_id, sheet, line_idx, string_agg(tok, ' ' ORDER BY idx) AS text, min(t) AS t, count(*) AS n_words FROM v_word GROUP BY ALL",
    "v_layout": r"""SELECT doc_id, n, text, words, minx, miny, round(minx + w, 9) AS maxx, round(miny + h, 9) AS maxy FROM (
        SELECT doc || '/' || (pos // 100) AS doc_id, n::INT AS n, text, words, round(5e-2 + ((pos % 100) // 50) * 5e-1 + CASE WHEN seg = 0 THEN 0e0 ELSE 3e-2 END, 9) AS minx, round(4e-2 + (pos % 50) * 18e-3, 9) AS miny,
          least(4e-1, len(text) * 11e-3) AS w, CASE WHEN in_line <= 3 THEN 2e-2 ELSE 12e-3 END AS h FROM (
        SELECT doc, in_line, seg, array_to_string(ws, ' ') AS text, len(ws)::INT AS words, row_number() OVER o AS n, (sum(CASE WHEN seg = 0 THEN 3 ELSE 1 END) OVER o - 3)::BIGINT AS pos FROM (
        SELECT doc, line_no, len(ws) AS in_line, seg, ws[seg * 6 + 1 : seg * 6 + 6] AS ws FROM (
        SELECT *, unnest(range((len(ws) + 5) // 6)) AS seg FROM (
        SELECT doc, line_no, list_filter(regexp_split_to_array(s, '\s+'), lambda y: y <> '') AS ws FROM (
        SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL)))) WINDOW o AS (PARTITION BY doc ORDER BY line_no, seg)))""",
    "v_detection": f"""SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS det_id,
        l_orderkey % (SELECT count(*) FROM documents) AS doc_id, {_pick_sql(CLASSES, 'l_linenumber - 1')} AS name,
        (l_partkey % 80) / 1e2 AS minx, (l_suppkey % 80) / 1e2 AS miny, (l_partkey % 80) / 1e2 + 5e-2 + (l_quantity::INT % 10) / 1e2 AS maxx,
        (l_suppkey % 80) / 1e2 + 4e-2 + l_discount::DOUBLE AS maxy, 2e-1 + l_tax::DOUBLE * 1e1 AS conf FROM lineitem""",
    "v_taxonomy": rf"""SELECT code, arg_min(description, item_id) AS description, arg_min(trade, item_id) AS trade, arg_min(division, item_id) AS division FROM (
        SELECT item_id, {_pick_sql(DIVISIONS, 'item_id')} AS division, {_pick_sql(TRADES, 'item_id')} AS trade,
          {_pick_sql(DIVISIONS, 'item_id')} || ' ' || lpad((item_id * 7 % 100)::VARCHAR, 2, '0') || ' ' || lpad((item_id * 13 % 100)::VARCHAR, 2, '0') AS code,
          array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda y: y <> '')[1:6], ' ') AS description FROM benchmark) GROUP BY code""",
    "v_cross_ref": """SELECT from_doc, to_doc FROM (SELECT o_orderkey % (SELECT count(*) FROM documents) AS from_doc,
        o_custkey % (SELECT count(*) FROM documents) AS to_doc FROM orders) WHERE from_doc <> to_doc""",
    "v_visit": """SELECT ts, '10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS ip, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, '/api/' || event_type AS path,
        CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, value AS latency FROM events""",
    "v_schedule": "SELECT p_partkey, 'D-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS tag, p_type, p_size, p_brand FROM part",
    "v_text": "SELECT doc_id, ' ' || string_agg(lower(tok), ' ' ORDER BY idx) || ' ' AS body FROM v_word GROUP BY doc_id",
    "v_page_code": """SELECT x.doc_id, c.code, c.division, c.trade FROM v_text x JOIN v_taxonomy c ON contains(x.body, ' ' || c.description || ' ')""",
}
NEEDS = {"v_line": ("v_word",), "v_text": ("v_word",), "v_page_code": ("v_word", "v_text", "v_taxonomy")}


def oracle(views: str, sql: str) -> str:
    """``sql`` after the definitions of the views that it names, and of those that these need."""
    wanted: dict[str, None] = {}
    for v in views.split():
        wanted |= dict.fromkeys((*NEEDS.get(v, ()), v))
    parts = [f"{v} AS ({SQL[v]})" for v in SQL if v in wanted]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body if parts else body
