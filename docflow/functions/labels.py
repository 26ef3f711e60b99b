"""Single values: the label that rules give a value, and the normal form of a value by its label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import dotted_hs, iso_date, stripped
from .values import let, lookup, number_normalised

#: Patterns of values by label.
ISO_DAY, DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{4})$"
NAMED_DAY = r"^[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}$"
CONTAINER, BILL = r"^[A-Z]{4}[0-9]{7}$", r"^[A-Z]{4}[0-9]{7,12}$"
INVOICE = r"(?i)^(INV|INV\.|INVOICE|FACTUR)?[\s\-:]*[A-Z0-9]{4,}$"
CURRENCY = r"(?i)\b(USD|EUR|GBP|IDR|JPY|CNY|SGD|THB|MYR|HKD|KRW|TWD)\b"
TERM = r"(?i)\b(FOB|CIF|CFR|EXW|DAP|DDP|FCA|CPT|CIP|FAS|DAT)\b"
VESSEL_HEAD = r"(?i)^VESSEL\s*NAME\s*:?\s*"
COUNTRY = r"(?i)\b(CHINA|INDONESIA|SINGAPORE|MALAYSIA|THAILAND|JAPAN|KOREA|HONG\s*KONG|TAIWAN|VIETNAM|INDIA|USA|GERMANY|UK|AUSTRALIA)\b"
PORT = r"^[A-Z][A-Z\s]{2,25}(?:,?\s*[A-Z]{2,10})?$"
NO_COMPANY = r"(?i)^(THE|AND|OF|FOR|TO|NO\.|INV|INVOICE|BL|B/L|DATE|TERM)"


def classified(value: Column, doc_type: Column) -> Column:
    """struct<label, value, confidence> by the first rule that knows the value; null for none, as for a null or shorter than two letters."""
    made = lambda label, v, sure: F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), v.alias("value"), F.lit(sure).alias("confidence"))
    trade = F.coalesce(doc_type.isin("CI", "PL"), F.lit(False))
    day = F.when(trade, "invoice_date").otherwise("bl_date")

    def rules(v: Column) -> Column:
        hs, vessel = F.regexp_replace(v, "[., ]", ""), stripped(F.regexp_replace(v, VESSEL_HEAD, ""))
        dmy = F.concat_ws("-", F.regexp_extract(v, DAY, 3), F.lpad(F.regexp_extract(v, DAY, 2), 2, "0"), F.lpad(F.regexp_extract(v, DAY, 1), 2, "0"))
        word = ~v.rlike("^[0-9]")
        company = (F.length(v) > 5) & word & ~v.rlike("[0-9]{4,}") & v.rlike("[A-Z]{3,}") & ~v.rlike(NO_COMPANY)
        return (
            F.when(v.isNull() | (F.length(v) < 2), None)
            .when(v.rlike(ISO_DAY), made(day, v, 0.95)).when(v.rlike(DAY), made(day, dmy, 0.90)).when(v.rlike(NAMED_DAY), made(day, v, 0.85))
            .when(hs.rlike("^[0-9]{8,10}$") & F.substring(hs, 1, 2).between("01", "97"), made("item_hs_code", hs, 0.95))
            .when(v.rlike(CONTAINER), made("container_number", v, 0.98)).when(v.rlike(BILL), made("bl_number", v, 0.95))
            .when(trade & v.rlike(INVOICE), made("invoice_number", v, 0.90))
            .when(v.rlike(CURRENCY), made("currency", F.upper(F.regexp_extract(v, CURRENCY, 1)), 0.98))
            .when(v.rlike(TERM), made("incoterms", F.upper(F.regexp_extract(v, TERM, 1)), 0.98))
            .when((F.length(vessel) > 2) & ~vessel.rlike("^[0-9]"), made("vessel_name", vessel, 0.85))
            .when(v.rlike(COUNTRY), made("country_of_origin", F.upper(F.regexp_extract(v, COUNTRY, 1)), 0.95))
            .when(v.rlike(PORT) & (F.length(v) > 3), made("port_of_loading", v, 0.75))
            .when(company & F.coalesce(doc_type == "BL", F.lit(False)), made("shipper_name", v, 0.75)).when(company, made("seller_name", v, 0.70))
        )

    return let(stripped(value), rules)


def _made(text: Column, sure: float, how: str) -> Column:
    return F.struct(text.alias("text"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))


def _number(s: Column) -> Column:
    text, sure = number_normalised(s)
    return F.struct(text.alias("text"), sure.alias("confidence"), F.when(sure == 1.0, "parsed").otherwise("invalid").alias("method"))


def _weight(s: Column) -> Column:
    """Kilograms with one to six decimals."""
    plain = _number(F.regexp_replace(s, r"(?i)\s*(KGS?|KG|LBS?|LB|MT|TONS?)\s*$", ""))
    tons = F.lower(s).contains("mt") | F.lower(s).contains("ton")
    kilos = lambda n: F.regexp_replace(F.regexp_replace((n["text"].try_cast("decimal(24,6)") * F.when(tons, 1000).otherwise(1)).cast("decimal(30,6)").cast("string"), "0+$", ""), r"\.$", ".0")
    return let(plain, lambda n: F.when(n["confidence"] == 1.0, F.struct(kilos(n).alias("text"), n["confidence"].alias("confidence"), n["method"].alias("method"))).otherwise(n))


def _named(u: Column, names: dict[str, str], sure: float, otherwise: float) -> Column:
    """Code of the first name that holds the text or is held by it."""
    entries = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("code")) for k, v in names.items()])
    code = F.get(F.filter(entries, lambda e: F.contains(u, e["name"]) | F.contains(e["name"], u)), F.lit(0))["code"]
    return let(code, lambda c: F.when(c.isNotNull(), _made(c, sure, "mapped")).otherwise(_made(u, otherwise, "inferred")))


def normalised(value: Column, label: Column) -> Column:
    """struct<text, confidence, method>: the normal form of a value by its label; of another label the value without blanks around, at 0.5. Null and blank values are empty, at 0."""

    def forms(s: Column) -> Column:
        u = F.upper(s)
        mapped = lambda codes: F.when(u.isin(*codes), _made(lookup(u, codes), 1.0, "mapped")).otherwise(_made(u, 0.5, "inferred"))
        known = lambda codes: F.when(u.isin(*codes), _made(u, 1.0, "exact")).otherwise(_made(u, 0.5, "inferred"))
        box = F.regexp_replace(u, r"[\s\-]", "")
        day = iso_date(s)
        return (
            F.when(s == "", _made(F.lit(""), 0.0, "empty"))
            .when(label.isin("invoice_date", "bl_date", "issue_date"), F.struct(day["day"].alias("text"), day["confidence"].alias("confidence"), day["method"].alias("method")))
            .when(label == "invoice_number", _made(u, 0.5, "as_is")).when(label == "bl_number", _made(u, 0.8, "cleaned"))
            .when(label == "currency", known(dims.CURRENCY_CODES)).when(label == "incoterms", known(dims.NORMAL_TERMS))
            .when(label.isin("country_of_origin", "country_of_destination"), F.when(u.rlike(r"^\p{L}{2}$"), _made(u, 1.0, "exact")).otherwise(_named(u, dims.NORMAL_COUNTRIES, 0.95, 0.3)))
            .when(label.isin("port_of_loading", "port_of_discharge"), F.when(u.isin(*dims.NORMAL_PORTS.values()), _made(u, 1.0, "exact")).otherwise(_named(u, dims.NORMAL_PORTS, 0.9, 0.5)))
            .when(label.isin("item_hs_code", "hs_code"), dotted_hs(s))
            .when(label.isin("total_amount", "total_quantity", "item_quantity", "item_unit_price", "item_amount"), _number(s))
            .when(label.isin("total_net_weight", "total_gross_weight", "net_weight", "gross_weight"), _weight(s))
            .when(label == "container_number", F.when(box.rlike(CONTAINER), _made(box, 1.0, "parsed")).otherwise(_made(box, 0.0, "invalid")))
            .when(label.isin("unit", "item_unit"), mapped(dims.NORMAL_UNITS)).when(label == "packaging_type", mapped(dims.NORMAL_PACKAGING))
            .otherwise(_made(s, 0.5, "cleaned"))
        )

    return let(stripped(F.coalesce(value, F.lit(""))), forms)
