"""Operational reads over shipments and activities: KPIs, filters, search, pages, and updates as new snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("Draft Valid", "Draft Invalid", "Sent", "Failed", "Approved")


def kpis(shipments: DataFrame) -> DataFrame:
    """Dashboard counters in one pass: by status, by kind of document held, and the mean confidence of rows that have one."""
    kinds = F.from_json("documents", "array<string>")
    name = lambda s: re.sub(r"\W+", "_", s.lower())
    counts = [F.count_if(F.col("status") == s).alias(f"n_{name(s)}") for s in STATUSES]
    held = [F.count_if(F.array_contains(kinds, k)).alias(f"with_{k.lower()}") for k in ("CI", "PL", "BL")]
    mean = F.coalesce(F.bround(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))) * 100, 1), F.lit(0.0)).alias("avg_confidence")
    out = shipments.agg(F.count("*").alias("total"), *counts, *held, mean)
    return out.withColumn("ceisa_ready", F.col("n_draft_valid") + F.col("n_sent")).withColumn("needs_review", F.col("n_draft_invalid"))


def search(df: DataFrame, **texts: str) -> DataFrame:
    """Rows that hold one of the texts (ILIKE wildcards work) in the column of that name, case aside; null columns don't match."""
    found: Column = F.lit(False)
    for c, text in texts.items():
        found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.where(found)


def page(df: DataFrame, *order: Column, size: int = 20, number: int = 1) -> DataFrame:
    """One page of the rows in a total order (top-k without a full sort of what isn't shown)."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def activity_stats(activities: DataFrame) -> DataFrame:
    return activities.agg(
        F.count("*").alias("total"), F.count_if(F.col("action") == "OCR Process").alias("ocr_runs"),
        F.count_if(F.col("action").isin("Declaration Send", "Declaration Approve")).alias("submissions"), F.max("created_at").alias("latest"),
    )


def with_status(shipments: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot with the statuses of changes (id, new_status) that are in the domain; merge on read by an equi-join."""
    good = changes.where(F.col("new_status").isin(*STATUSES))
    return shipments.join(good, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def without(shipments: DataFrame, gone: DataFrame) -> DataFrame:
    return shipments.join(gone, "id", "left_anti")


def quality(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "high").when(confidence >= 0.60, "medium").otherwise("low")
