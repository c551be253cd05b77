"""Readers for files beside Parquet: taxonomies, OCR blocks and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trades by the division that a code begins with.
TRADES = {"03": "Structural", "05": "Structural", "08": "Architectural", "09": "Architectural", "21": "Fire Protection", "22": "Plumbing", "23": "Mechanical", "26": "Electrical", "27": "Electrical", "31": "Civil"}
BOX = "struct<Left: double, Top: double, Width: double, Height: double>"
BLOCKS = f"Blocks array<struct<Id: string, BlockType: string, Text: string, Confidence: double, RowIndex: int, ColumnIndex: int, Geometry: struct<BoundingBox: {BOX}>, Relationships: array<struct<Type: string, Ids: array<string>>>>>"
DETECTIONS = "detections array<struct<name: string, confidence: double, bbox_normalized: array<double>, bbox: array<double>>>"


def taxonomy_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(``code``, ``description``, ``trade``, ``division``) from a file of six tab-separated columns with a header.

    The third to sixth column count; rows with fewer are dropped, as are rows without a code.
    """
    names = ["old_code", "old_description", "code", "description", "trade", "division"]
    rows = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{n} string" for n in names), mode="PERMISSIVE", enforceSchema=True)
    return rows.where("code IS NOT NULL AND division IS NOT NULL").select(*(F.trim(c).alias(c) for c in names[2:]))


def taxonomy_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded taxonomy: CSV, TSV or JSON by the path's ending; a missing trade or division follows from the code.

    Rows without a code are dropped; of rows with one code the first by description stays.
    """
    schema = "code string, description string, trade string, division string"
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        rows = spark.read.json(path, schema=schema, multiLine=False)
    elif kind in ("csv", "tsv"):
        rows = spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True, schema=schema)
    else:
        raise ValueError(f"taxonomies come as csv, tsv or json, not {kind}")
    two = F.substring(F.regexp_replace("code", "[^0-9]", ""), 1, 2)
    trade = F.try_element_at(F.create_map(*(F.lit(x) for kv in TRADES.items() for x in kv)), two)
    full = rows.where("code IS NOT NULL").select("code", "description", F.coalesce("trade", trade).alias("trade"), F.coalesce("division", two).alias("division"))
    return full.groupBy("code").agg(F.min(F.struct("description", "trade", "division")).alias("x")).select("code", "x.*")


def ocr_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, lines and table cells of OCR results, one JSON document a file, named by its page number.

    Lines and cells name their words by id; the ids are resolved by joins within a page.
    """
    raw = spark.read.json(path, schema=BLOCKS, multiLine=True).withColumn("page", _page())
    b = raw.select("page", F.posexplode("Blocks").alias("pos", "b")).select("page", "pos", "b.*")
    box = F.col("Geometry.BoundingBox")
    placed = [box["Left"].alias("l"), box["Top"].alias("t"), box["Width"].alias("w"), box["Height"].alias("h")]
    words = b.where("BlockType = 'WORD'").select("page", F.col("Id").alias("id"), F.col("Text").alias("text"), F.col("Confidence").alias("confidence"), *placed)
    child = F.flatten(F.transform(F.filter("Relationships", lambda r: r["Type"] == "CHILD"), lambda r: r["Ids"]))
    told = words.select("page", F.col("id").alias("child"), "text")

    def of_words(kind: str, *more: str) -> DataFrame:
        own = b.where(F.col("BlockType") == kind).select("page", F.col("Id").alias("id"), *more, *placed, F.posexplode_outer(child).alias("k", "child"))
        text = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("k", "text")))), lambda x: x["text"])  # one line's or cell's words
        return own.join(told, ["page", "child"], "left").groupBy("page", "id", *more, "l", "t", "w", "h").agg(F.array_join(text, " ").alias("text"))

    cells = of_words("CELL", "RowIndex", "ColumnIndex").withColumnsRenamed({"RowIndex": "row", "ColumnIndex": "col"})
    return words, of_words("LINE"), cells


def detections(spark: SparkSession, folder: str, classes: DataFrame | None = None) -> DataFrame:
    """Detections of all ``*.json`` files of a folder but its manifest: page from the name, normalised box if there is one.

    ``classes`` (``name``, ``codes``) adds the codes of each class; it is a short list, broadcast if Spark finds it small.
    """
    raw = spark.read.json(f"{folder}/*.json", schema=DETECTIONS, multiLine=True).where(~F.input_file_name().contains("_manifest"))
    d = raw.withColumn("page", _page()).where("page IS NOT NULL").select("page", F.inline("detections"))
    box = F.coalesce("bbox_normalized", "bbox")
    out = d.select("page", "name", "confidence", *(box[k].alias(n) for k, n in enumerate(("minx", "miny", "maxx", "maxy"))))
    return out if classes is None else out.join(classes, "name", "left")


def _page() -> Column:
    """The number in ``page_<number>`` of the file's name; null without one."""
    number = F.regexp_extract(F.input_file_name(), r"page_(\d+)[^/]*$", 1)
    return F.when(number != "", number.cast("int"))
