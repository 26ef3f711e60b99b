"""Pages of documents and the images that were made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_name(stem: Column, page: Column) -> Column:
    """The name of a page's image, as the end of its path."""
    return F.concat(stem, F.lit("_p"), page.cast("string"), F.lit(".png"))


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages (stem, page, ...) with image, the first of images (image, ord) whose path ends in the page's name; null without one.

    The ends of an image's last path part, from each of its characters up to the page number, are rows that meet the names in an equi-join, so
    no image is held against all pages. A part has a few dozen characters; names are far fewer than pairs.
    """
    last = F.element_at(F.split("image", "/"), -1)
    ends = images.select("image", "ord", last.alias("_part")).where(F.col("_part").rlike(r"_p[0-9]+\.png$"))
    room = F.length(F.regexp_extract("_part", r"^(.*)_p[0-9]+\.png$", 1))
    ends = ends.select("image", "ord", F.explode(F.transform(F.sequence(F.lit(1), room + 1), lambda k: F.substring(F.col("_part"), k, F.length("_part")))).alias("_name"))
    first = ends.groupBy("_name").agg(F.min_by("image", "ord").alias("image"))
    return pages.withColumn("_name", image_name(F.col("stem"), F.col("page"))).join(first, "_name", "left").drop("_name")
