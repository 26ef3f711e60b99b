"""Scalar rules of trade documents as Column -> Column functions: amounts, dates, codes, containers, valuation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def blank(c: Column) -> Column:
    """Whether a string is null or empty; a blank is not empty."""
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument isn't inlined."""
    return F.transform(F.array(value), body)[0]


def number(c: Column) -> Column:
    """The string as a double where it is a plain decimal number, else null."""
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))


def lookup(c: Column, dim: dict) -> Column:
    """Value of the key c in a small fixed table, else null."""
    return F.create_map(*[F.lit(x) for kv in dim.items() for x in kv])[c]


# amounts ---------------------------------------------------------------------------------------------------------


def amount_by_rules(c: Column) -> Column:
    """Locale-aware amount: the last separator is decimal; a lone comma before one to three last digits is a point; 0 when unreadable."""

    def plain(s: Column) -> Column:
        dot, comma = s.contains("."), s.contains(",")
        last_dot = F.length(s) - F.instr(F.reverse(s), ".")
        last_comma = F.length(s) - F.instr(F.reverse(s), ",")
        return F.trim(
            F.when(dot & comma & (last_dot > last_comma), F.replace(s, F.lit(","), F.lit("")))
            .when(dot & comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(comma & s.rlike(r",[0-9]{1,3}$"), F.replace(s, F.lit(","), F.lit(".")))
            .otherwise(F.replace(s, F.lit(","), F.lit("")))
        )

    def signed(s: Column) -> Column:
        value = F.coalesce(let(let(F.translate(s, "()", ""), plain), number), F.lit(0.0))
        return value * F.when(s.contains("(") & s.contains(")"), -1).otherwise(1)

    return F.when(blank(c), 0.0).otherwise(let(F.trim(F.regexp_replace(F.trim(c), r"[A-Z$€£¥₹p]", "")), signed))


def amount_plain(c: Column) -> Column:
    """Amount with capitals, four currency signs and commas removed; null when unreadable, as with blanks between digits."""
    return let(F.trim(F.regexp_replace(F.trim(c), r"[A-Z$€£¥,]", "")), number)


def number_normalised(c: Column) -> tuple[Column, Column]:
    """(text, confidence) of a number in European or American writing, with one or two decimals; others lose blanks and commas. What is then unreadable stays as it was, with 0."""
    s = F.trim(c)
    european, american = s.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]{1,2}$"), s.rlike(r"^[0-9]{1,3}(,[0-9]{3})*\.[0-9]{1,2}$")
    text = (
        F.when(european, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(american, F.replace(s, F.lit(","), F.lit("")))
        .otherwise(F.regexp_replace(s, r"[\s,]", ""))
    )
    both = let(text, lambda t: F.when(t.rlike(PLAIN_NUMBER), F.struct(t.alias("text"), F.lit(1.0).alias("sure"))).otherwise(F.struct(s.alias("text"), F.lit(0.0).alias("sure"))))
    both = F.when(F.coalesce(s, F.lit("")) == "", F.struct(F.lit("").alias("text"), F.lit(0.0).alias("sure"))).otherwise(both)
    return both["text"], both["sure"]


def amount_formatted(value: Column, currency: Column) -> Column:
    american = F.format_number(value, 2)
    swapped = F.translate(american, ",.", ".,")
    return F.when(currency.isin("USD", "EUR", "SGD", "AUD"), F.concat(currency, F.lit(" "), swapped)).when(currency == "IDR", F.concat(F.lit("Rp "), F.translate(F.format_number(F.bround(value, 0), 0), ",", "."))).otherwise(american)


# dates -----------------------------------------------------------------------------------------------------------

#: Accepted patterns in the order tried.
DATE_PATTERNS = ("d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d.M.yyyy", "d MMM yy")


def parsed_date(c: Column) -> Column:
    s = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in DATE_PATTERNS])


# codes -----------------------------------------------------------------------------------------------------------


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def hs_formatted(c: Column) -> Column:
    """dddd.dd.dd or dddd.dd of a code of 6 to 13 digits in chapters 1 to 97; else null."""
    d = F.regexp_replace(c, r"[., ]", "")
    good = d.rlike(r"^[0-9]{6,13}$")
    chapter = F.substring(d, 1, 2)
    dotted = F.concat_ws(".", F.substring(d, 1, 4), F.substring(d, 5, 2), F.when(F.length(d) >= 8, F.substring(d, 7, 2)))
    return F.when(good & chapter.between("01", "97"), dotted)


def hs_padded(c: Column) -> Column:
    """Eight digits: six or more are cut or filled up on the right, fewer on the left; null without digits."""
    d = digits(c)
    return F.when(F.length(d) >= 6, F.rpad(F.substring(d, 1, 8), 8, "0")).when(F.length(d) > 0, F.lpad(d, 8, "0"))


def container_number(c: Column) -> tuple[Column, Column]:
    """(prefix, digits) of the first container number; empty without one."""
    p = r"\b([A-Z]{3,4})[Uu]?([0-9]{6,7})\b"
    return F.regexp_extract(F.upper(c), p, 1), F.regexp_extract(F.upper(c), p, 2)


def container_size(c: Column) -> Column:
    s = F.upper(F.trim(c))
    found = F.regexp_extract(s, r"\b([0-9]{1,2})[FTQH]\b", 1)
    return (
        F.when(blank(c), "20").when(s.contains("20") & s.contains("FT"), "20").when(s.contains("40") & (s.contains("HQ") | s.contains("HC")), "40HQ")
        .when(s.contains("40"), "40").when(s.contains("45"), "45").when(s.isin("LCL", "BULK"), "LCL").when(found != "", F.concat(found, F.lit("FT"))).otherwise("20")
    )


def kilograms(value: Column, unit: Column) -> Column:
    return value * F.coalesce(lookup(F.upper(F.trim(unit)), dims.WEIGHTS), F.lit(1.0))


def declaration_number(office: Column, kind: Column, importer: Column, day: Column, sequence: Column) -> Column:
    """26 digits: office 4, document 2, importer 6, day 8, sequence 6; null for a part of another shape, an unknown document or a sequence outside 1 to 999,999."""
    good = office.rlike("^[0-9]{4}$") & kind.isin(*dims.DOCUMENT_CODES) & importer.rlike("^[0-9]{6}$") & sequence.between(1, 999_999)
    return F.when(good, F.concat(office, kind, importer, F.date_format(day, "yyyyMMdd"), F.lpad(sequence.cast("string"), 6, "0")))


def declaration_errors(c: Column, kinds: tuple[str, ...], today: Column) -> Column:
    """What is wrong with a declaration number, in order; an empty array for a good one."""
    day = F.to_date(F.try_to_timestamp(F.substring(c, 13, 8), F.lit("yyyyMMdd")))
    shaped = c.rlike(r"^[0-9]{26}$")
    empty = F.coalesce(c, F.lit("")) == ""
    each = [(empty, "empty"), (~empty & ~shaped, "format"), (shaped & ~F.substring(c, 5, 2).isin(*kinds), "document"), (shaped & day.isNull(), "day"), (shaped & (day > today), "future"), (shaped & (F.substring(c, 21, 6) == "000000"), "sequence")]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in each]), lambda x: x.isNotNull())


# valuation -------------------------------------------------------------------------------------------------------


def cif_term(term: Column) -> Column:
    return F.coalesce(F.upper(term).isin(*dims.CIF_TERMS), F.lit(False))


def fx_rate(currency: Column) -> Column:
    return F.coalesce(lookup(F.upper(F.trim(currency)), dims.FX), F.lit(1.0))


def freight_cost(kind: Column, containers: Column, cbm: Column) -> Column:
    k = F.when(blank(kind), "20").otherwise(F.upper(F.trim(kind)))
    loose = (k == "LCL") | ((cbm > 0) & (containers == 0))
    return F.when(loose, dims.FREIGHT["LCL"] * F.greatest(cbm, F.lit(1.0))).otherwise(F.coalesce(lookup(k, dims.FREIGHT), F.lit(dims.FREIGHT["20"])) * containers)


def insurance(value: Column) -> Column:
    rate, low, high = dims.INSURANCE
    return F.when(value <= 0, 0.0).otherwise(F.greatest(F.lit(low), F.least(value * rate, F.lit(high))))


def fob_of_total(total: Column, term: Column, freight: Column, insured: Column) -> Column:
    return F.when(cif_term(F.trim(term)), total - freight - insured).otherwise(total)


def customs_value(fob: Column, freight: Column, insured: Column, duty: Column) -> dict[str, Column]:
    """Parts of the customs value, not rounded; round with bround(x, 2) for display."""
    cif = fob + freight + insured
    bm = cif * (duty / 100)
    vat = (cif + bm) * dims.VAT
    return {"cif": cif, "bm": bm, "ppn": vat, "nilaipabean": bm + cif, "total": bm + cif + vat}
