"""New shipments with reference codes of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

TRIES = 5


def reference_code(key: Column, attempt: int) -> Column:
    """CD- and eight hexadecimal digits of a hash of the key; another code for each attempt."""
    return F.concat(F.lit("CD-"), F.upper(F.substring(F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(attempt))), 256), 1, 8)))


def with_reference_codes(new: DataFrame, existing: DataFrame, key: str = "id", tries: int = TRIES, code=reference_code) -> DataFrame:
    """new (key, ...) with reference_code, which no row of existing (reference_code) and no other new row has; null where all tries met codes in use.

    Each try is an anti-join over the rows that are still without a code; of new rows that try the same one the least key gets it. Keys must be distinct and not null.
    """
    used = existing.select("reference_code").where("reference_code is not null").distinct()
    left, done = stored(new), []
    for k in range(tries):
        tried = left.withColumn("reference_code", code(F.col(key), k))
        free = tried.join(used, "reference_code", "left_anti").groupBy("reference_code").agg(F.min(key).alias(key))
        got = stored(tried.join(free, ["reference_code", key], "left_semi"))
        done.append(got)
        left = stored(left.join(got.select(key), key, "left_anti"))
        used = used.unionByName(got.select("reference_code"))
        if not left.limit(1).count():
            break
    out = left.withColumn("reference_code", F.lit(None).cast("string"))
    for got in done:
        out = out.unionByName(got.select(out.columns))
    return out


def with_json(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with nested columns as JSON text, as they are stored; nulls stay null."""
    return rows.withColumns({c: F.to_json(c) for c in columns})
