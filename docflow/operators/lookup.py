"""Tiered dictionary lookups: exact, then containment in the order of the dictionary, then a default.

The dictionaries are fixed (under 120 entries), so each lookup is an expression over literals: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.values import blank, digits, filled, let, lookup


def tier(name: Column, dim: dict[str, str], inside, cleaned=None) -> Column:
    """Code of a name: of the exact key, else of the first key for which inside(name, key), else of the exact cleaned(name), else null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("code")) for k, v in dim.items()])

    def code(n: Column) -> Column:
        near = F.get(F.filter(entries, lambda e: inside(n, e["key"])), F.lit(0))["code"]
        tiers = [lookup(n, dim), near] + ([lookup(cleaned(n), dim)] if cleaned else [])
        return F.when(filled(n).isNotNull(), F.coalesce(*tiers))

    return let(name, code)


def either_way(name: Column, key: Column) -> Column:
    return F.contains(name, key) | F.contains(key, name)


def within(name: Column, key: Column) -> Column:
    return F.contains(name, key)


def bounded(name: Column, key: Column) -> Column:
    """One holds the other and its first occurrence there isn't beside a letter."""

    def first(hay: Column, needle: Column) -> Column:
        at = F.instr(hay, needle)
        before, after = F.substring(hay, at - 1, F.lit(1)), F.substring(hay, at + F.length(needle), F.lit(1))
        return (at > 0) & ((at == 1) | ~before.rlike(r"\p{L}")) & ~after.rlike(r"\p{L}")

    return first(name, key) | first(key, name)


def clean_name(c: Column) -> Column:
    """Upper case without blanks around; null for nothing but blanks."""
    return filled(F.trim(F.upper(c)))


def port_code(c: Column) -> Column:
    return tier(clean_name(c), dims.PORTS, either_way, lambda n: F.regexp_replace(n, dims.PORT_COUNTRY, ""))


def country_code(c: Column) -> Column:
    name, two = clean_name(c), clean_name(c).rlike(r"^\p{L}{2}$")
    return F.when(two, name).otherwise(F.coalesce(tier(name, dims.COUNTRIES, bounded), F.lit("CN")))


def currency_code(c: Column) -> Column:
    name = F.regexp_replace(clean_name(c), r"[/\s]*(?:PER|KGS?|LBS?)\s*$", "")
    return F.coalesce(tier(name, dims.CURRENCIES, either_way), F.lit("USD"))


def incoterm_code(c: Column) -> Column:
    return tier(clean_name(c), dims.INCOTERMS, within)


def packaging_code(c: Column) -> Column:
    return F.coalesce(tier(clean_name(c), dims.PACKAGING, within), F.lit("PCE"))


def party_code(c: Column) -> Column:
    """The first word of the dictionary that the name holds, exact or not, decides."""
    name = F.lower(F.trim(c))
    found = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(int(v))) for k, v in dims.PARTIES.items()], F.lit(1))
    return F.when(blank(c), 1).otherwise(found)


def tariff_by_chapter(df: DataFrame, c: str) -> DataFrame:
    """Add duty and facility by the first two digits."""
    rows = [(k, v) for k, v in dims.CHAPTERS.items()]
    d = F.broadcast(df.sparkSession.createDataFrame(rows, "_chapter string, duty double"))
    return df.withColumn("_chapter", F.substring(digits(F.col(c)), 1, 2)).join(d, "_chapter", "left").drop("_chapter").withColumn("duty", F.coalesce("duty", F.lit(dims.CHAPTER_DEFAULT))).withColumn("facility", F.lit(dims.CHAPTER_FACILITY))


def tariff_by_prefix(df: DataFrame, code: Column, near_found: bool = False) -> DataFrame:
    """Add bm, ppn, pph and found: of the code itself, else of the first code with its first four digits (found only with near_found), else the default (not found)."""
    rows = df.sparkSession.createDataFrame(dims.tariff_rows(), "hs8 bigint, hs4 bigint, bm double, ppn double, pph double, ord int")
    rates = F.struct("bm", "ppn", "pph")
    exact = F.broadcast(rows.select(F.col("hs8").alias("_hs8"), rates.alias("_exact")))
    near = F.broadcast(rows.groupBy("hs4").agg(F.min(F.struct("ord", rates.alias("rates")))["rates"].alias("_near")).withColumnRenamed("hs4", "_hs4"))
    out = df.withColumn("_hs8", code).withColumn("_hs4", F.floor(F.col("_hs8") / 10000)).join(exact, "_hs8", "left").join(near, "_hs4", "left")
    pick = lambda k, d: F.coalesce(F.col("_exact")[k], F.col("_near")[k], F.lit(d)).alias(k)
    return out.select(*df.columns, *[pick(k, d) for k, d in zip(("bm", "ppn", "pph"), dims.TARIFF_DEFAULT, strict=True)], (F.col("_exact").isNotNull() | (F.lit(near_found) & F.col("_near").isNotNull())).alias("found"))


def rate_rows(rated: DataFrame, certified: Column) -> DataFrame:
    """Each row of rated (bm, pph, ppn, ...) as three, with kind and rate: import duty, income tax, VAT. Income tax is due only with a certificate."""
    rates = F.array(*[F.struct(F.lit(k).alias("kind"), r.alias("rate")) for k, r in (("BM", F.col("bm")), ("PPH", F.when(certified, F.col("pph")).otherwise(0.0)), ("PPN", F.col("ppn")))])
    return rated.select(*[c for c in rated.columns if c not in ("bm", "pph", "ppn")], F.inline(rates))
