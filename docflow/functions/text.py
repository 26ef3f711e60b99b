"""Rules over text as Column functions: predicates of values, codes and lines, the pattern bank of header fields, repairs, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .values import blank, filled, let, number_normalised, parsed_date

_WORDS = "|".join(w.replace(".", r"\.") for w in dims.NO_CODE_WORDS)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


# predicates --------------------------------------------------------------------------------------------------------


def is_garbage(value: Column, label: Column) -> Column:
    """Whether a value is noise: empty, broken over lines, few letters, a caption, or no port where a port is looked for."""
    port = (
        F.when(F.length(value) < 3, True).when(value.rlike("^[A-Z]{2}[A-Z0-9]{3}$"), False).when(value.rlike("^[A-Z]{2}") & (F.length(value) >= 5), False)
        .when(value.contains(" ") & ~value.rlike("^[A-Z]{2}[A-Z0-9]+$"), True).otherwise(False)
    )
    return (
        F.when(blank(value) | value.rlike(r"[\n\r]"), True)
        .when((F.length(value) > 5) & (letters(value) / F.length(value) < 0.30), True)
        .when(F.upper(value).isin(*dims.GARBAGE), True)
        .when(label.isin("port_of_loading", "port_of_discharge"), port)
        .otherwise(False)
    )


def is_item_code(c: Column) -> Column:
    u = F.upper(c)
    return (
        F.when(blank(c) | (F.length(c) < 4), False).when(c.rlike(r"^[0-9]+[Xx*][0-9]+([Xx*][0-9]+)+$"), False).when(~c.rlike("[0-9]"), False)
        .when(~c.rlike(r"\p{L}"), c.rlike("^[0-9]{11,}$")).when(c.rlike("^[A-Z]{3,4}[0-9]{6,9}$"), False).when(c.rlike("(?i)" + dims.NO_CODE), False)
        .when(u.isin(*dims.NO_CODE_WORDS), False).when((F.length(c) >= 6) & u.rlike(rf"(?<![A-Z0-9-])({_WORDS})(?![A-Z0-9-])"), False).otherwise(True)
    )


def is_list_code(c: Column) -> Column:
    """Whether a packing list can have the code."""
    u = F.upper(c)
    starts = lambda names: F.exists(F.lit(list(names)), lambda n: F.startswith(u, n))
    return F.when(blank(c) | (F.length(c) < 4), False).when(c.rlike("(?i)" + dims.NO_LIST_CODE), False).when(starts(dims.LIST_CODES), True).when(u.startswith("ID-"), starts(dims.LIST_ID_CODES)).otherwise(True)


def is_skipped_line(line: Column) -> Column:
    """Whether a line, without blanks around it, holds no item."""
    few = (F.length(line) > 10) & (letters(line) / F.length(line) < 0.15)
    return line.rlike(r"^[0-9\s,.\-+]+$") | (F.length(line) < 4) | few | F.lower(line).rlike("(?i)" + "|".join(dims.SKIPPED_LINES))


# the pattern bank ----------------------------------------------------------------------------------------------------


def _first(text: Column, pattern: str, any_case: bool, label: str, seen: list[Column]) -> Column:
    """The first match that is a value and none of those seen."""
    group = 1 if "(" in pattern.replace("(?:", "").replace(r"\(", "") else 0
    found = F.transform(F.regexp_extract_all(text, F.lit("(?i)" * any_case + pattern), F.lit(group)), stripped)

    def good(v: Column) -> Column:
        out = F.length(v).between(2, 100) & ~is_garbage(v, F.lit(label))
        for s in seen:
            out = out & ~F.coalesce(v == s, F.lit(False))
        return out

    return F.get(F.filter(found, good), F.lit(0))


def field_values(text: Column, label: str) -> Column:
    """array<string>: the values of a header field, of each of its patterns the first that is new; null where a pattern has none."""

    def more(rest, seen: list[Column]) -> Column:
        if not rest:
            return F.array(*seen)
        return let(_first(text, *rest[0], label, seen), lambda v: more(rest[1:], [*seen, v]))

    return more(dims.ENTITY_PATTERNS[label], [])


def port_by_name(text: Column, discharge: bool) -> Column:
    """Code of the first port of the keywords that the text names, of those where goods arrive or of the others; null without one."""
    upper = F.upper(text)
    tests = [F.when(F.contains(upper, F.lit(k)), F.lit(v)) for k, v in dims.PORT_KEYWORDS.items() if (k in dims.DISCHARGE) == discharge]
    return F.coalesce(*tests)


def unit_price_currency(text: Column) -> Column:
    """The currency of a price a kilogram; null without one."""
    upper = F.upper(text)
    return F.when(upper.contains("USD/KG") | upper.contains("USD /KG"), "USD").otherwise(filled(F.regexp_extract(upper, r"\b(USD|CNY|EUR|GBP)\s*/\s*(?:KG|KILO|KILOS)\b", 1)))


# repairs and names ----------------------------------------------------------------------------------------------------


def repaired_code(c: Column) -> Column:
    for pattern, new in dims.CODE_FIXES:
        c = F.regexp_replace(c, "(?i)" + pattern, new)
    return c


def match_text(c: Column) -> Column:
    """Upper case, marks as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[.,;:]", " "), r"\s+", " "))


#: What a description of goods loses, in order, and what stands for it.
DESCRIPTION_CUTS = (
    (r"[\x00-\x1f]", ""), (r"(?i)\bN/?M\b", ""), (r"(?i)\bJOUTER\b", "OUTER"), (r'"[^"]*"', ""), (r"(?i)[0-9]{3,}\s*PIECESI?\b", ""),
    (r"(?i)[0-9]{1,2}\s*PIECESI?\b", ""), (r"(?i)\bPE\b", ""), (r"\s*[A-Z]{3,}[0-9]{4,}[A-Z0-9]*\s*$", ""), (r"\s+", " "),
)


def clean_description(c: Column) -> Column:
    for pattern, new in DESCRIPTION_CUTS:
        c = F.regexp_replace(c, pattern, new)
    return let(F.trim(c), lambda d: F.when(F.length(d) >= 2, F.substring(d, 1, 200)).otherwise(""))


def certificate_layout(text: Column) -> Column:
    label, anchor = r"(?i)HS\s+CODE\s*[:\-]", r"[0-9]{6}\s+[A-Z]{2}\b"
    first = text.rlike(r"(?i)Page\s+[0-9]+\s+of\s+[0-9]+") | text.rlike(label)
    return F.when(first, "Layout 1").when(text.rlike(r"(?i)Electronic\s+Certificate"), "Layout 2").when(F.regexp_count(text, F.lit(anchor)) == 0, "Layout 1").otherwise("Layout 2")


def file_kind(name: Column) -> Column:
    """Kind of a file by what its name holds, in the order of the table."""
    low = F.lower(name)
    out = None
    for kind, parts in dims.FILE_KINDS.items():
        held = F.exists(F.lit(list(parts)), lambda p: F.contains(low, p))
        out = F.when(held, kind) if out is None else out.when(held, kind)
    return out.otherwise("other")


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def shipment_id(bill: Column, invoice: Column, day: Column) -> Column:
    """BL or CI and the last six digits (of a bill without digits, characters), else SHP; then month and day, or the last four characters of an unreadable day."""
    tail = lambda c: F.when(F.length(c) > 6, F.substring(c, -6, 6)).otherwise(c)
    number = lambda c: filled(F.regexp_replace(c, "[^0-9]", ""))
    base = (
        F.when(filled(bill).isNotNull(), F.concat(F.lit("BL"), tail(F.coalesce(number(bill), bill))))
        .when(filled(invoice).isNotNull() & number(invoice).isNotNull(), F.concat(F.lit("CI"), tail(number(invoice)))).otherwise("SHP")
    )
    end = F.coalesce(F.date_format(parsed_date(day), "MMdd"), F.when(F.length(day) > 4, F.substring(day, -4, 4)).otherwise(day))
    return F.when(blank(day), base).otherwise(F.concat(base, F.lit("-"), end))


def number_28(office: Column, document: str, day: Column, taxpayer: Column, sequence: int = 1) -> Column:
    """The mapper's declaration number: office 6, document 2, taxpayer 6, day 8, sequence 6; null without a day."""
    return F.concat(office, F.lit(document), F.rpad(F.substring(F.regexp_replace(taxpayer, "[^0-9]", ""), 1, 6), 6, "0"), F.date_format(day, "yyyyMMdd"), F.lit(f"{sequence:06d}"))


# dates and weights -------------------------------------------------------------------------------------------------------

#: Patterns of dates in the order tried, of the normaliser, the mapper and the declaration numbers.
ISO_PATTERNS = ("d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d.M.yyyy", "MMM d, yyyy", "yyyyMMdd")
MAPPER_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "MMM d, yyyy", "d MMM yyyy")
NUMBER_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyyMMdd", "d.M.yyyy")


def date_by(c: Column, patterns: tuple[str, ...]) -> Column:
    """The date by the first pattern that reads it; null for none."""
    return let(F.trim(c), lambda s: F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in patterns]))


def iso_date(c: Column) -> Column:
    """struct<day, confidence, method>: read by a pattern (1.0), pieced together without a look at the calendar (0.7), or left as it is (0.0)."""
    made = lambda day, sure, how: F.struct(day.alias("day"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    part = lambda s, p, k: filled(F.regexp_extract(s, p, k))
    dmy, dnumber, ymd = r"([0-9]{1,2})\s+(\w{3,9})\s+([0-9]{4})", r"([0-9]{1,2})[\s\-/.]([0-9]{1,2})[\s\-/.]([0-9]{4})", r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
    months = F.create_map(*[F.lit(x) for kv in dims.MONTHS.items() for x in kv])

    def read(s: Column) -> Column:
        named = F.concat_ws("-", part(s, dmy, 3), two(months[F.lower(F.substring(part(s, dmy, 2), 1, 3))]), two(part(s, dmy, 1)))
        named = F.when(months[F.lower(F.substring(part(s, dmy, 2), 1, 3))].isNotNull(), named)
        numbers = F.when(s.rlike(dnumber), F.concat_ws("-", part(s, dnumber, 3), two(part(s, dnumber, 2)), two(part(s, dnumber, 1))))
        turned = F.when(s.rlike(ymd), F.concat_ws("-", part(s, ymd, 1), two(part(s, ymd, 2)), two(part(s, ymd, 3))))
        exact, pieced = F.date_format(date_by(s, ISO_PATTERNS), "yyyy-MM-dd"), F.coalesce(named, numbers, turned)
        return F.when(blank(s), made(F.lit(""), 0.0, "empty")).when(exact.isNotNull(), made(exact, 1.0, "parsed")).when(pieced.isNotNull(), made(pieced, 0.7, "inferred")).otherwise(made(s, 0.0, "unparsed"))

    return let(F.trim(F.coalesce(c, F.lit(""))), read)


def normalised_weight(c: Column) -> Column:
    """Kilograms: the number before the unit, times 1000 where the text holds mt or ton anywhere; null when unreadable."""
    text, sure = number_normalised(F.regexp_replace(F.trim(c), r"(?i)\s*(KGS?|KG|LBS?|LB|MT|TONS?)\s*$", ""))
    tons = F.lower(c).contains("mt") | F.lower(c).contains("ton")
    return F.when(sure == 1.0, text.cast("double") * F.when(tons, 1000).otherwise(1))


def dotted_hs(c: Column) -> Column:
    """struct<text, confidence, method>: dddd.dd of six digits, dddd.dd.dd of eight and more, seven as they are; else the text itself."""
    made = lambda t, sure, how: F.struct(t.alias("text"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))

    def read(s: Column) -> Column:
        d = F.regexp_replace(s, r"[.\s]", "")
        dotted = F.when(F.length(d) == 7, d).otherwise(F.concat_ws(".", F.substring(d, 1, 4), F.substring(d, 5, 2), F.when(F.length(d) >= 8, F.substring(d, 7, 2))))
        good = d.rlike("^[0-9]{6,13}$")
        return F.when(s == "", made(F.lit(""), 0.0, "empty")).when(good & ~F.substring(d, 1, 2).between("01", "97"), made(s, 0.0, "invalid_chapter")).when(good, made(dotted, 1.0, "parsed")).otherwise(made(s, 0.0, "invalid"))

    return let(F.trim(F.coalesce(c, F.lit(""))), read)
