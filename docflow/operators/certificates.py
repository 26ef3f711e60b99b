"""Goods of certificates of origin: listed in sections of one tariff code each, or one a line with its own code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..functions.values import filled
from .lookup import tariff_by_prefix
from .stored import folded


def _by_pos(*more: str):
    return W.partitionBy("doc_id", *more).orderBy("pos")


#: A section's head, an item, its pieces, lines that are no goods, and texts that no item has.
SECTION = r"(?i)^HS\s+CODE\s*[:\-]\s*([0-9]{4})(?:[^0-9\n]([0-9]{2}))?"
ITEM = r"^([1-9][0-9]?)(?:\s+(.+))?$"
PIECES = r"(?i)([0-9][0-9,]*)\s*PIECESI?\b"
NO_GOODS = (
    r"(?i)(?:^TOTAL|^NUMBER|^Kind|^Gross|^Marks\b|^Item\b|^Origin\b|^Origin\s+criteria|^Declaration|^Certification|^Importer|^Exporter|"
    r"^undersigned|^RVC\b|^criterion\b|^applied\b|^see\s+Overleaf|^hereby\b|^[0-9]{10,}$|^[0-9]{1,5}\.[0-9]+$|^[0-9]{4}$|^HS\s*CODE\b|"
    r"^[0-9]{1,3}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC))"
)
NO_TEXT = r"(?i)(?:of\s+Annex|Protocol|RVC|certificate|origin\s+criteria|preferential|ACFTA|Upgrading|Rule\b|Party|Parties|Weight|package|Invoice)"
#: What is replaced in a description, in order.
TEXT_CUTS = (
    (r"[\x00-\x1f]", ""), (r"(?i)\bN/?M\b", ""), (r"(?i)\bJOUTER\b", "OUTER"), (r'"[^"]*"', ""), (r"(?i)[0-9]{3,}\s*PIECESI?\b", ""),
    (r"(?i)\b[0-9]{1,2}\s*PIECESI?\b", ""), (r"(?i)\bPE\b", ""), (r"\s*[A-Z]{3,}[0-9]{4,}[A-Z0-9]*\s*$", ""), (r"\s+", " "),
)
MOST_ITEMS, LONGEST_LINE, LONGEST_TEXT = 31, 80, 200
BACK = 4  # lines before an item's number that may describe it


def goods_text(c: Column) -> Column:
    for pattern, new in TEXT_CUTS:
        c = F.regexp_replace(c, pattern, new)
    c = F.trim(c)
    return F.when(F.length(c) >= 2, F.substring(c, 1, LONGEST_TEXT)).otherwise("")


def _with_rates(goods: DataFrame) -> DataFrame:
    """Add the rates of the code's first six digits, filled up to eight with zeros; those of a code with the same first four digits count as found."""
    return tariff_by_prefix(goods, F.rpad(F.substring("hs_code", 1, 6), 8, "0").cast("bigint"), near_found=True)


def section_goods(lines: DataFrame) -> DataFrame:
    """(doc_id, number, hs_code, quantity, description, bm, ppn, pph, found) of rows (doc_id, pos, line): the first item of each number.

    An item is a number of 1 to 31 below a section's head, alone or before its description; alone it takes the nearest of
    the four lines before that may describe goods. The pieces stand between two lines before and three lines after it.
    Null lines are empty; what isn't found is the empty string. Of lines of one pos the order is undefined.
    """
    line = F.coalesce("line", F.lit(""))
    rows = lines.select("doc_id", "pos", line.alias("line"), stripped(line).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("section", F.count_if(text.rlike(SECTION)).over(_by_pos().rowsBetween(W.unboundedPreceding, 0))).where("section > 0")
    rows = rows.withColumns({"goods": (text != "") & ~text.rlike(NO_GOODS), "code": F.concat(F.regexp_extract(text, SECTION, 1), F.regexp_extract(text, SECTION, 2))})
    rows = rows.withColumn("own", F.when(F.col("goods") & (F.length(text) <= LONGEST_LINE), goods_text(text)))
    within = _by_pos("section")
    rows = rows.select(
        "doc_id", "pos", "goods", F.regexp_extract(text, ITEM, 1).alias("number"), F.regexp_extract(text, ITEM, 2).alias("more"), F.first("code").over(within).alias("hs_code"),
        F.coalesce(*[F.lag("own", k).over(within) for k in range(1, BACK + 1)], F.lit("")).alias("above"),
        F.concat_ws(" ", F.collect_list("line").over(within.rowsBetween(-2, 3))).alias("around"),
    )
    items = rows.where(F.col("goods") & (F.col("number") != "") & ~F.col("more").rlike(NO_TEXT)).withColumn("number", F.col("number").cast("bigint")).where(F.col("number") <= MOST_ITEMS)
    items = items.withColumn("_first", F.row_number().over(_by_pos("number"))).where("_first = 1")
    pieces = F.replace(F.regexp_extract("around", PIECES, 1), F.lit(","), F.lit(""))
    description = F.when(F.col("more") == "", F.col("above")).otherwise(goods_text(F.col("more")))
    return _with_rates(items.select("doc_id", "number", "hs_code", pieces.alias("quantity"), description.alias("description")))


#: The first tariff code of a line, lines that are no goods, and the currencies that end a line's quantities where all four are named.
LINE_CODE = r"^(.*?)([0-9]{6,8})\b"
NO_LINE = (
    r"(?i)(?:Signatory|Declaration|Certification|Disclaimer|TOTAL:|Page\s|Beneficiary|Applicant|Invoice\s+No|NPWP:|TEL:|Phone|"
    r"^[0-9]{10,}$|^Hs\s+Code|^Gross\s+Weight|^N/M\s*$|^FORM E\b|^CERTIFICATE|^ACFTA|Origin Country|Issuing Country|"
    r"Item\s+Quantity|Invoice Number|Invoice Date|Currency|^\s*[A-Z][A-Z\s]{10,}$|^[0-9]{1,3}\s+of\s+[0-9])"
)
CURRENCIES = ("USD", "CNY", "EUR", "SGD")
LEAST_QUANTITY, MOST_QUANTITY, MOST_NUMBER = 1, 999_999, 100


def _numbers(own: list[int | None]) -> list[int | None]:
    """The numbers of a document's goods in order: their own, where it is new (none where it isn't), else the next free one."""
    used, numbers = set(), []
    for given in own:
        n = len(used) + 1 if given is None else given
        while given is None and n in used:
            n += 1
        numbers.append(None if n in used else n)
        used.add(n)
    return numbers


def _numbered(frame: pd.DataFrame) -> pd.DataFrame:
    """The goods of one document, as a frame, with a number each."""
    frame = frame.sort_values(["pos", "hs_code"])
    numbers = _numbers([None if pd.isna(n) else int(n) for n in frame["number"]])
    return frame.assign(number=pd.array(numbers, dtype="Int64")).dropna(subset=["number"])


def _goods(row: dict) -> list[dict]:
    """The goods of one document, as a row, with a number each."""
    numbers = _numbers([g["number"] for g in row["goods"]])
    return [{"doc_id": row["doc_id"], **g, "number": n} for g, n in zip(row["goods"], numbers, strict=True) if n is not None]


def line_goods(lines: DataFrame) -> DataFrame:
    """(doc_id, number, hs_code, quantity, unit, description, bm, ppn, pph, found) of rows (doc_id, pos, line) that hold a tariff code.

    The unit follows the code, or is the next line; the quantity follows the code, else it is the line's last one. A line
    without a number of its own needs a unit and gets the next free number in the document's order; of lines of one
    number the first counts. Null lines are empty; what isn't found is the empty string.
    """
    rows = lines.select("doc_id", "pos", stripped(F.coalesce("line", F.lit(""))).alias("text"))
    text, code = F.col("text"), F.col("code")
    rows = rows.withColumn("next", F.lead("text").over(_by_pos())).where(~text.rlike(NO_LINE))
    rows = rows.withColumns({"before": F.regexp_extract(text, LINE_CODE, 1), "code": F.regexp_extract(text, LINE_CODE, 2)}).where((code != "") & ~code.startswith("0"))
    rows = rows.withColumn("rest", F.substr(text, F.length("before") + F.length(code) + 1))
    plain = lambda v: F.replace(v, F.lit(","), F.lit(""))
    fits = lambda v: F.coalesce(v.try_cast("double").between(LEAST_QUANTITY, MOST_QUANTITY), F.lit(False))
    beside = plain(F.regexp_extract(F.substring("rest", 1, 15), r"^[\s,]*([0-9,]*\.[0-9]+)\b", 1))
    money = F.array(*[F.instr(text, c) for c in CURRENCIES])
    area = F.when(F.array_min(money) > 0, F.substr(text, F.lit(1), F.array_min(money) - 1)).otherwise(text)
    every = F.filter(F.transform(F.regexp_extract_all(area, F.lit(r"([0-9][0-9,]*\.[0-9]+)"), F.lit(1)), plain), fits)
    unit = F.coalesce(filled(F.regexp_extract(F.substring("rest", 1, 5), r"^\s+([A-Z]{2})\b", 1)), F.when(F.col("next").rlike("^[A-Z]{2,4}$"), F.substring("next", 1, 2)), F.lit(""))
    own = F.regexp_extract(text, r"^0*([0-9]+)\b", 1)
    number = F.when(own != "", F.when(F.length(own) > 3, MOST_NUMBER + 1).otherwise(own.try_cast("bigint"))).cast("bigint")
    named = stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(F.col("before")), r"(?i)^N/M\b", "")), r"[0-9,]+(\.[0-9]+)?\s*", ""))
    goods = rows.select(
        "doc_id", "pos", number.alias("number"), F.substring(code, 1, 6).alias("hs_code"), F.when(fits(beside), beside).otherwise(F.coalesce(F.try_element_at(every, F.lit(-1)), F.lit(""))).alias("quantity"),
        unit.alias("unit"), F.when((own != "") & (F.length(named) >= 3), F.substring(named, 1, 100)).otherwise("").alias("description"),
    ).where(F.when(F.col("number").isNull(), F.col("unit") != "").otherwise(F.col("number") <= MOST_NUMBER))
    rest = [c for c in goods.columns if c not in ("doc_id", "pos", "hs_code")]
    rows = goods.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hs_code", *rest))).alias("goods"))
    return _with_rates(folded(rows, _goods, ", ".join(f"`{c}` {t}" for c, t in goods.dtypes if c != "pos")))
