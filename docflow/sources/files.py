"""Files of trade documents: caches of recognised words, training pages, shipment folders, uploads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import folded

CACHE = "map<string, struct<width: double, height: double, words: array<struct<text: string, bbox: array<double>, confidence: double>>, ocr_time: double, error: string>>"
PAGES = "id string, shipment_id string, doc_type string, width double, height double, text array<string>, bboxes array<array<double>>, labels array<bigint>"
#: Kinds of files that may be uploaded, and their greatest size.
UPLOADS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif", "bmp")
MOST_BYTES = 20 << 20


def word_cache(spark: SparkSession, path: str) -> DataFrame:
    """(image, width, height, words, ocr_time, error) of the images of each cache file, a JSON object by image; an unreadable file gives a row of its path with an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", CACHE, {"mode": "PERMISSIVE"}).alias("images"))
    broken = F.map_from_arrays(F.array("file"), F.array(F.from_json(F.lit('{"error": "unreadable"}'), CACHE.removeprefix("map<string, ").removesuffix(">"))))
    return files.select(F.explode(F.coalesce("images", broken)).alias("image", "page")).select("image", "page.*")


def cached_words(cache: DataFrame) -> DataFrame:
    """(image, pos, text, x1, y1, x2, y2, confidence) of the words of a cache; images without words have no rows."""
    words = cache.select("image", F.posexplode("words").alias("pos", "w"))
    return words.select("image", "pos", "w.text", *[F.get("w.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], "w.confidence")


def training_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of JSON lines; blank lines are left out, fields that a line lacks are null."""
    return spark.read.schema(PAGES).json(path)


def write_training_pages(pages: DataFrame, path: str) -> None:
    """Write pages with a column train as JSON lines, one folder a part."""
    parts = pages.select(*[c.split()[0] for c in PAGES.split(", ")], F.when(F.col("train"), "train").otherwise("val").alias("split"))
    parts.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("split").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """Write a frame of few rows (a summary, a map of labels) as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _listing(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")  # the content is not read


def shipment_folders(spark: SparkSession, root: str) -> DataFrame:
    """(shipment, ci, pl, bl, truth) of each folder that holds a workbook: paths of the documents by the ends of their names, and of the first workbook."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    files = _listing(spark, root).select("path", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("shipment")).where("shipment NOT LIKE '.%'")
    first = lambda test: F.min(F.when(test, F.col("path")))
    document = lambda kind: first(F.col("name").endswith(f"_{kind}.pdf")).alias(kind)
    found = files.groupBy("shipment").agg(document("ci"), document("pl"), document("bl"), first(F.col("name").endswith(".xlsx")).alias("truth"))
    return found.where("truth IS NOT NULL")


def uploads(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, error) of the files of a folder: 400 for another kind of file, 413 for one too large, null for what is taken."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return _listing(spark, root).withColumn("error", F.when(~suffix.isin(*UPLOADS), 400).when(F.col("length") > MOST_BYTES, 413))



def _leaves(row: dict) -> list[dict]:
    try:
        todo = [(None, json.loads(row["value"] or ""))]
    except ValueError:
        return [{"file": row["file"], "key": None, "value": None, "placeholder": False}]
    out = []
    while todo:
        key, value = todo.pop()
        if isinstance(value, (dict, list)):
            own = value.items() if isinstance(value, dict) else enumerate(value)
            todo += [(f"{key}.{k}" if key is not None else str(k), v) for k, v in own]
        elif key is not None:
            text = value if isinstance(value, str) or value is None else json.dumps(value)
            out.append({"file": row["file"], "key": key, "value": text, "placeholder": isinstance(value, str) and value.startswith("***")})
    return out


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, placeholder) of the leaves of files that hold a JSON object each: keys joined by points, values as text, and whether a value stands for one still to be filled in. An unreadable file gives a row without a key."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return folded(files, _leaves, "file string, key string, value string, placeholder boolean")
