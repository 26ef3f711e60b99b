"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, partitions, table

BINS = 128  # a power of two
BITS = 8
WORDS = 5
_VALUE_BITS = 63 - int(math.log2(BINS))
_TOP = (1 << _VALUE_BITS) - 1
_LONG = (1 << 63) - 1


def shingles(text: Column) -> Column:
    """63-bit hashes of each run of five words (white space divides words, case is folded); shorter texts have one shingle, wordless ones none."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]).bitwiseAND(F.lit(_LONG)))
        one = F.array(F.xxhash64(h).bitwiseAND(F.lit(_LONG)))
        return F.when(F.size(h) >= WORDS, runs).when(F.size(h) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column) -> Column:
    """BINS low-order bytes (array<tinyint>), null for a text without words.

    Each hash falls in the bin of its top bits; a bin keeps its least hash. An empty bin i takes the value of
    the first filled bin in i's own order, s_i + t * a_i modulo BINS for t = 0, 1, ... with odd a_i: two texts
    that both leave bin i empty ask the other bins in one order. The first few places are looked up one by one;
    beyond them, the filled bins are ranked in that order.
    """
    marks = F.array(*[F.lit((b << _VALUE_BITS) | _TOP) for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS)
    wrap = lambda x: x.bitwiseAND(F.lit(BINS - 1))
    steps = [(i * 146 + 59) % BINS | 1 for i in range(BINS)]
    step, back = F.lit(steps), F.lit([pow(a, -1, BINS) for a in steps])

    def least(ordered: Column) -> Column:
        first = F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))
        return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_TOP)) != F.lit(_TOP), x))

    def dense(bins: Column) -> Column:
        def lent(i: Column) -> Column:
            shift = i * 57 + 11
            tried = [F.get(bins, wrap(shift + F.get(step, i) * t)) for t in range(8)]
            filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(bins, j).isNotNull())
            rank = F.array_min(F.transform(filled, lambda j: wrap((j - shift) * F.get(back, i)) * BINS + j))
            return F.coalesce(*tried, F.get(bins, wrap(rank)))

        value = F.transform(bins, lambda x, i: F.coalesce(x, lent(i)))
        low = F.transform(value, lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
        return F.when(F.exists(bins, lambda x: x.isNotNull()), low)

    return let(let(F.sort_array(F.concat(shingles(text), marks)), least), dense)


def packed(s: Column) -> Column:
    """The sketch as lowercase hex; empty for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(s, lambda v: F.lpad(F.hex(v.cast("int") + 128), 2, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bytes, less what chance makes equal (2^-BITS); two wordless texts are alike, one of them is unlike any other."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(a, i) == F.get(b, i))) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds under doc_id, looked up in two levels."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    coarse, fine = F.lit(bounds[step - 1 :: step]), F.lit(bounds)
    low = F.size(F.filter(coarse, lambda b: b < doc_id)) if len(bounds) >= step else F.lit(0)
    return F.coalesce(let(low, lambda k: k * step + F.size(F.filter(F.slice(fine, k * step + 1, step), lambda b: b < doc_id))), F.lit(0))


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Add each carried column, made from the row, and next_<c>: its value in the row that follows by doc_id (then by text); after the last row, the first.

    Rows are dealt by ranges of ids at measured quantiles, so one shuffle of the rows serves; the head of each range
    (one row a range) is looked up by an equi-join for the last row of the range before it, and only then carried.
    """
    wanted = 4 * partitions(docs.sparkSession)
    found = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 100 * wanted)).first()[0] or []
    dealt = docs.withColumn("_range", _range_of(F.col("doc_id"), sorted(set(found))))
    heads = sorted(docs.select("doc_id").withColumn("_range", _range_of(F.col("doc_id"), sorted(set(found)))).groupBy("_range").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("null")).collect(), key=lambda r: r["_range"])
    if not heads:
        return docs.withColumns(carried).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    of = [(r["_range"], None if n["null"] else n["head"]) for r, n in zip(heads, heads[1:] + heads[:1], strict=True)]  # a null id comes first
    first = docs.sparkSession.createDataFrame(of, "_before int, _head bigint")
    first = docs.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("_head")))  # a row a range, but for ids that repeat
    first = first.withColumn("_n", F.row_number().over(W.partitionBy("_before").orderBy(*[c for c in docs.columns if c != "doc_id"]))).where("_n = 1")
    first = first.withColumns(carried).select("_before", F.struct(*carried).alias("_wrap"))
    order = W.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), *[c for c in docs.columns if c != "doc_id"])
    led = dealt.withColumns(carried).withColumn("_next", F.lead(F.struct(*carried)).over(order))
    joined = led.join(first, F.col("_range") == F.col("_before"), "left")
    nearest = F.when(F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("_wrap"))
    return joined.withColumn("_next", nearest).select(*docs.columns, *carried, *[F.col("_next")[c].alias(f"next_{c}") for c in carried])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text, and compare them.

    docs needs doc_id and text; other columns are ignored. A null text is empty; a text without words has the empty
    fingerprint. Rows that share an id follow each other by text; a null id comes first. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs.withColumnRenamed("text", "whole"), {"text": F.col("whole"), "fp": sketch(F.col("whole"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    near = near.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "fp", "next_fp")
    near = near.withColumn("edited_fp", sketch(F.col("edited")))
    return near.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
