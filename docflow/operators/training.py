"""Operators on training data: splits, epochs, evidence sets and derived numbers."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import folded


def is_train(group: Column, share: float = 0.8) -> Column:
    """Whether a group of pages belongs to the training part: by a hash of its id, so that pages of one group stay together and no list is shuffled on the driver."""
    return F.conv(F.substring(F.md5(group.cast("string")), 1, 4), 16, 10).cast("int") < int(share * 65536)


def best_epochs(epochs: DataFrame, patience: int) -> DataFrame:
    """(run, best, best_epoch, last_epoch) of rows (run, epoch, f1): the first strictly best score up to the epoch at which patience rows in a row brought no better one."""
    w = W.partitionBy("run").orderBy("epoch")
    before = F.coalesce(F.max("f1").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = epochs.withColumn("_better", F.col("f1") > before).withColumn("_island", F.sum(F.col("_better").cast("int")).over(w))
    idle = F.row_number().over(W.partitionBy("run", "_island").orderBy("epoch")) - F.when(F.col("_island") > 0, 1).otherwise(0)
    rows = rows.withColumn("_stop", idle >= patience)
    stop = F.min(F.when(F.col("_stop"), F.col("epoch"))).over(W.partitionBy("run"))
    kept = rows.withColumn("_last", stop).where(F.col("_last").isNull() | (F.col("epoch") <= F.col("_last")))
    best = F.max(F.when(F.col("_better"), F.struct("f1", "epoch")))
    return kept.groupBy("run").agg(F.coalesce(best["f1"], F.lit(0.0)).alias("best"), best["epoch"].alias("best_epoch"), F.max("epoch").alias("last_epoch"))


def distinct_within(rows: DataFrame, reach: float) -> DataFrame:
    """(doc_id, kept) of rows (doc_id, values): the values of each array in order, without those nearer than reach to one kept before. A value is held against those of its own and the next buckets only."""

    def walk(row: dict) -> list[dict]:
        kept: list[float] = []
        near: dict[int, list[float]] = {}
        for v in row["values"]:
            at = floor(v / reach)
            if not any(abs(v - s) < reach for k in (at - 1, at, at + 1) for s in near.get(k, ())):
                kept.append(v)
                near.setdefault(at, []).append(v)
        return [{"doc_id": row["doc_id"], "kept": kept}]

    return folded(rows.select("doc_id", F.array_compact("values").alias("values")), walk, "doc_id bigint, kept array<double>")


#: Fixed value: the label of a token that counts for no loss.
NO_LABEL = -100


def split_words(pages: DataFrame) -> DataFrame:
    """pages (text, bboxes, labels, width, height, ...) with words cut at blanks: each part has its word's label and its box, scaled to 0..1000 of the page; blank words go."""
    scale = lambda b, k, size: F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(F.get(b, F.lit(k)) / F.when(F.col(size) != 0, F.col(size)).otherwise(1) * 1000).cast("int")))
    box = lambda b: F.array(scale(b, 0, "width"), scale(b, 1, "height"), scale(b, 2, "width"), scale(b, 3, "height"))
    words = F.filter(F.arrays_zip("text", "bboxes", "labels"), lambda w: w["text"].isNotNull() & w["bboxes"].isNotNull() & w["labels"].isNotNull())
    parts = F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.split(w["text"], r"\s+"), lambda t: t != ""), lambda t: F.struct(t.alias("text"), box(w["bboxes"]).alias("box"), F.greatest(w["labels"], F.lit(0)).alias("label")))))
    out = pages.withColumn("_parts", parts)
    return out.withColumns({"text": F.transform("_parts", lambda p: p["text"]), "bboxes": F.transform("_parts", lambda p: p["box"]), "labels": F.transform("_parts", lambda p: p["label"])}).drop("_parts")


def token_labels(word_ids: Column, labels: Column) -> Column:
    """The label of each token's word; NO_LABEL for tokens without one and for words beyond the labels."""
    return F.transform(word_ids, lambda w: F.coalesce(F.when(w >= 0, F.get(labels, w.cast("int"))), F.lit(NO_LABEL).cast("bigint")))


def with_labels(pages: DataFrame) -> DataFrame:
    """The pages on which some word has a label but O."""
    return pages.where(F.coalesce(F.exists("labels", lambda x: x != 0), F.lit(False)))


def tolerant_json(text: Column) -> Column:
    """The JSON object of an answer: the text itself, else a fenced block, else from the first brace to the last; null without a readable one."""
    good = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(good(text), good(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), good(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def fallback_confidence(quantity: Column, price: Column, amount: Column) -> Column:
    """Trust in an item found by its amount alone: by how near it is to quantity times price, 0.5 where only one of them is known."""
    ratio = F.when(quantity * price > 0, amount / (quantity * price))
    both = quantity.isNotNull() & price.isNotNull() & (amount > 0)
    return F.when(both & ratio.between(0.85, 1.20), 0.85).when(both & ratio.between(0.70, 1.50), 0.65).when(both, 0.30).when(quantity.isNotNull() | price.isNotNull(), 0.50).otherwise(0.30)


def derived(quantity: Column, price: Column, amount: Column) -> tuple[Column, Column, Column]:
    """(quantity, price, amount) with what the others give: quantity as the rounded quotient where it fits the amount within 15 percent, price from 0.01 to 500 with four decimals, amount with two."""
    count = F.bround(amount / price, 0)
    fits = (price > 0) & (amount > 0) & (F.abs(count * price - amount) < 0.15 * amount)
    each = F.when(quantity > 0, amount / quantity)
    return F.coalesce(quantity, F.when(fits, count)), F.coalesce(price, F.when(each.between(0.01, 500), F.bround(each, 4))), F.coalesce(amount, F.bround(quantity * price, 2))
