"""Parties of bills of lading by what stands around their captions, fields that a letter's own lines supply, and headers merged over three documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import filled, let
from .items import every, first

#: Names of companies, captions, addresses, and how far from a caption its party may stand (characters).
COMPANY = r"(?i)\b([A-Z][A-Z][A-Za-z \t]{1,50}?(?<! AS\b)(?:CORPORATION|LIMITED|LTD\.?|INC\.?|CO\.?|LLC|MANUFACTURING))\b"
PT_COMPANY = r"(PT\.?[ \t]+[A-Za-z0-9][A-Za-z0-9 \t]{2,50}(?:CO\.?,?[ \t]*LTD\.?|CO\.?|LTD\.?|INC\.?)?)"
CONSIGNEE, NOTIFY = r"(?i)(?:CONSIG|IMPORTER|BUYER)", r"(?i)(?:NOTIFY|PAR ?TY|NON.?NEGOTIABLE|AS ?NOTIFY|IFY)"
CAPTIONS = r"(?i)(?:Export\s+References?|BILL\s+OF\s+LADING|NOT\s+NEGOTIABLE|ORIGINAL|JOINT\s+SERVICE|MERCHANT|SHIPPER|CONSIGNEE|NOTIFY\s+PARTY|EVERGREEN|BANGKOK\s+THAILAND)"
CARRIERS = r"(?i)(?:MERCHANT|SHIPPING|AGENCY|AS\s+CARRIER|EVERGREEN)"
COUNTRIES = r"(?i)(?<![A-Z-])(THAILAND|KOREA|CHINA|MALAYSIA|SINGAPORE|INDONESIA|VIETNAM)\b"
ADDRESS = (
    r"(?i)(?:JL\.?|KENARI|RAYA|BLOK|G3|CIKARANG|DELTA|SILICON|CICU|HARYONO|KAV\.?|PANCORAN|JAKARTA|BEKASI|INDONESIA|(?<![A-Z-])SEOUL|(?<![A-Z-])KOREA|(?<![A-Z-])BUSAN|TOWERS|FLOOR|CHEONGGYECH|ROAD|"
    r"(?<![A-Z-])BANGKOK|(?<![A-Z-])THAILAND|SUKHUMVIT|KLONGTOEY)"
)
HEAD, HEAD_LINES, AFTER_CONSIGNEE, AFTER_NOTIFY, NOTIFY_FROM, FALLBACK, ADDRESS_REACH = 800, 8, 400, 300, 500, 1500, 200


def located(documents: DataFrame, text: Column, pattern: str, keep: list[str]) -> DataFrame:
    """keep, match, at of each match of a pattern, with its place from 0. Gaps and matches come as arrays; a running sum of their lengths gives the places."""
    rows = documents.select(*keep, F.split(text, pattern, -1).alias("_gaps"), every(text, pattern, 0).alias("_matches")).where("size(_matches) > 0")
    rows = rows.select(*keep, F.posexplode(F.zip_with("_gaps", "_matches", lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))).alias("_k", "_p"))
    ends = F.sum(F.coalesce("_p.g", F.lit(0)) + F.coalesce(F.length("_p.m"), F.lit(0))).over(W.partitionBy("doc_id").orderBy("_k"))
    return rows.select(*keep, F.col("_p.m").alias("match"), (ends - F.length("_p.m")).cast("int").alias("at")).where("match is not null")


def _named(text: Column, least: int) -> Column:
    """array<string>: names of companies in a text, but no captions."""
    names = F.transform(every(text, COMPANY), T.stripped)
    return F.filter(names, lambda n: (F.length(n) >= least) & ~F.upper(n).startswith("SHIPPE"))


def _shippers(head: Column) -> Column:
    """array<string>: of each line before the consignee the first company that isn't the carrier.

    Lines count up to the first that is longer than the consignee's caption is far from the start.
    """
    far = F.coalesce(F.length(F.when(head.rlike(CONSIGNEE), F.regexp_extract(head, f"(?s)^(.*?)(?:{CONSIGNEE})", 1))), F.length(head))
    # What all lines share is bound by let; in the lambda it would be searched for again at each line.
    long = lambda lines: let(far, lambda reach: F.array_position(F.transform(lines, lambda line: F.length(line) > reach), True))
    kept = let(F.split(head, "\n", -1), lambda lines: let(long(lines), lambda at: F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)))
    sound = lambda n: ~n.rlike(CARRIERS) & (T.letters(n) >= F.length(n) * 0.5)
    names = F.transform(F.filter(kept, lambda line: ~line.rlike(CAPTIONS)), lambda line: F.get(F.filter(_named(T.stripped(line), 8), sound), F.lit(0)))
    return F.array_compact(names)


def bill_parties(documents: DataFrame) -> DataFrame:
    """(doc_id, label, value, confidence) of bills (doc_id, text): shippers before the consignee's caption, the country of the first lines, the company after
    the captions of consignee and of the party to notify; without a shipper, a company with an address after it. Each value once; null texts give none."""
    text = F.col("text")
    head = F.substring(text, 1, HEAD)
    rows = documents.where(text.isNotNull()).select("doc_id", "text", _shippers(head).alias("shippers"))
    country = F.get(F.array_compact(F.transform(F.slice(F.split(head, "\n", -1), 1, HEAD_LINES), lambda line: first(line, COUNTRIES))), F.lit(0))
    value = lambda label, v, sure: F.struct(F.lit(label).alias("label"), v.alias("value"), F.lit(sure).alias("confidence"))
    # A company that stands twice has the address of its first place.
    beside = lambda n: F.substring(F.col("text"), F.instr(text, n), F.lit(ADDRESS_REACH)).rlike(ADDRESS)
    settled = F.get(F.filter(_named(F.substring(text, 1, FALLBACK), 10), beside), F.lit(0))
    found = F.concat(
        F.transform("shippers", lambda n: value("shipper_name", n, 0.80)), F.array(value("country_of_origin", F.upper(country), 0.85)), F.array(value("shipper_name", F.when(F.size("shippers") == 0, settled), 0.78)),
    )
    single = rows.select("doc_id", F.inline(found))
    consignees = located(documents, text, CONSIGNEE, ["doc_id", "text"])
    company = T.stripped(first(F.substring(text, F.col("at") + F.length("match") + 1, F.lit(AFTER_CONSIGNEE)), PT_COMPANY))
    consignees = consignees.withColumn("value", company).where("value is not null").groupBy("doc_id").agg(F.min_by("value", "at").alias("value"))
    notified = located(documents, text, NOTIFY, ["doc_id", "text"]).where((F.regexp_replace(F.upper("match"), "[- ]", "") == "NONNEGOTIABLE") & (F.col("at") >= NOTIFY_FROM))
    window = F.substring(text, F.col("at") + F.length("match") + 1, F.lit(AFTER_NOTIFY))
    notified = notified.withColumn("value", F.when(~F.upper(T.stripped(window)).startswith("SAME AS"), T.stripped(first(window, PT_COMPANY)))).where("value is not null")
    notified = notified.groupBy("doc_id").agg(F.min_by("value", "at").alias("value"))
    one = lambda d, label: d.select("doc_id", F.lit(label).alias("label"), "value", F.lit(0.82).alias("confidence"))
    every_one = single.unionByName(one(consignees, "consignee_name")).unionByName(one(notified, "notify_party_name"))
    return every_one.where("length(value) >= 2").groupBy("doc_id", "label", "value").agg(F.max("confidence").alias("confidence"))


# what a letter's own lines supply ------------------------------------------------------------------------------------

#: What no line with the seller's name holds, and the caption of a buyer.
NO_SELLER_LINE = ("INVOICE", "DATE", "NO.:", "NUMBER", "AND", "FOR", "JL.", "JL ", "ROAD", "STREET", "FLOOR", "TOWER", "BLOK")
BUYER = r"(?i)(?:BUYER|IMPORTER|CONSIGNEE|PEMBELI)[:\s]+([A-Z][A-Z\s.,\-']{3,60}?)(?=\s*(?:INVOICE|DATE|JL\.|TEL|FAX|TAX|ADDRESS|NO\.|KS\.|,INDUSTRIAL|,BLOK|\n|$))"
WEAK, LEAST_WEIGHT, MOST_WEIGHT = 0.70, 100, 500_000


def supplied(documents: DataFrame) -> DataFrame:
    """(doc_id, label, value, confidence) that the texts of documents (doc_id, doc_type, text) supply: seller and buyer of an invoice, the weights of a packing list's first line of totals."""
    text, kind = F.col("text"), F.col("doc_type")
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, HEAD_LINES), T.stripped)

    def seller(line: Column) -> Column:
        upper = F.upper(line)
        odd = F.exists(F.lit(list(NO_SELLER_LINE)), lambda w: upper.contains(w)) | line.rlike(r"^[A-Z][A-Z\s/]{0,20}:") | line.rlike("^[0-9]") | (line.contains("/") & ~line.rlike(r"\.(CO|LTD|INC)$"))
        name = T.stripped(F.regexp_replace(line, r"\s+[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\s*$", ""))
        return F.when((F.length(line) >= 8) & ~odd & (F.length(name) >= 8), name)

    buyers = F.filter(F.transform(every(text, BUYER), T.stripped), lambda n: F.length(n) >= 5)
    totals = F.get(F.filter(F.transform(F.split(text, "\n", -1), T.stripped), lambda line: F.upper(line).startswith("TOTAL")), F.lit(0))
    numbers = F.filter(F.transform(every(totals, r"([0-9,]+\.?[0-9]*)"), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double")), lambda v: v > LEAST_WEIGHT)
    net, gross = F.try_element_at(numbers, F.lit(-2)), F.try_element_at(numbers, F.lit(-1))
    weighed = (kind == "PL") & (net < MOST_WEIGHT) & (gross < MOST_WEIGHT)
    value = lambda label, v, sure: F.struct(F.lit(label).alias("label"), v.alias("value"), F.lit(sure).alias("confidence"))
    found = F.array(
        value("seller_name", F.when(kind == "CI", F.get(F.array_compact(F.transform(lines, seller)), F.lit(0))), 0.65), value("buyer_name", F.when(kind == "CI", F.get(buyers, F.lit(0))), 0.75),
        value("total_net_weight", F.when(weighed, F.format_string("%.2f", net)), 0.97), value("total_gross_weight", F.when(weighed, F.format_string("%.2f", gross)), 0.97),
    )
    return documents.select("doc_id", F.inline(found)).where("value is not null")


def with_supplied(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """entities (doc_id, label, value, confidence) with what the documents supply.

    A name replaces what is there where that is a caption (a slash, or letters and blanks only) or no surer, and only below WEAK; weights always do.
    """
    own = entities.groupBy("doc_id", "label").agg(F.max("confidence").alias("sure"), F.max(F.col("value").contains("/") | F.col("value").rlike(r"^[A-Z][A-Za-z\s/]+$")).alias("caption"))
    weight = F.col("label").isin("total_net_weight", "total_gross_weight")
    met = supplied(documents).join(own, ["doc_id", "label"], "left")
    takes = weight | (F.coalesce("sure", F.lit(0.0)) < WEAK) & (F.col("sure").isNull() | F.coalesce("caption", F.lit(False)) | (F.col("confidence") >= F.col("sure")))
    new = met.where(takes).select("doc_id", "label", "value", "confidence")
    return entities.join(new.select("doc_id", "label"), ["doc_id", "label"], "left_anti").select("doc_id", "label", "value", "confidence").unionByName(new)


# one header of three documents ---------------------------------------------------------------------------------------

#: By field the documents that may give it, in order.
SOURCES = {
    **dict.fromkeys(("invoice_number", "invoice_date", "currency", "incoterms", "total_amount", "freight", "seller_name", "seller_address", "buyer_name", "buyer_address", "country_of_destination"), ("CI",)),
    **dict.fromkeys(("bl_number", "bl_date", "port_of_loading", "port_of_discharge", "country_of_origin"), ("CI", "BL")),
    **dict.fromkeys(("shipper_name", "shipper_address", "consignee_name", "consignee_address", "notify_party_name", "notify_party_address", "vessel_name", "voyage_number"), ("BL",)),
    **dict.fromkeys(("number_of_packages", "total_net_weight", "total_gross_weight"), ("CI", "PL")),
    "freight_term": ("PL",),
}
#: Parties that stand in for others, with their addresses.
STAND_INS = {"seller": "shipper", "buyer": "consignee"}


def _not_in(names: list[str]):
    return lambda k, _: ~k.isin(*names)


def merged_header(values: DataFrame) -> DataFrame:
    """(doc_id, label, value) of values (doc_id, doc_type, label, value): each field from the first of its documents that has it; the shipper stands in for a missing seller, the consignee for a buyer, with the address."""
    ranks = F.create_map(*[x for label, types in SOURCES.items() for k, t in enumerate(types) for x in (F.lit(f"{label} {t}"), F.lit(k))])
    ranked = values.where(filled(F.col("value")).isNotNull()).withColumn("_rank", ranks[F.concat_ws(" ", "label", "doc_type")]).where("_rank is not null")
    top = ranked.groupBy("doc_id", "label").agg(F.min(F.struct("_rank", "value"))["value"].alias("value"))
    fields = top.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("m"))
    m = F.col("m")
    for party, other in STAND_INS.items():
        entries = [F.struct(F.lit(f"{party}_{part}").alias("key"), m[f"{other}_{part}"].alias("value")) for part in ("name", "address")]
        lent = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
        names = [f"{party}_name", f"{party}_address"]
        bare = F.map_filter(m, _not_in(names))
        fields = fields.withColumn("m", F.when(m[f"{party}_name"].isNull() & m[f"{other}_name"].isNotNull(), F.map_concat(bare, lent)).otherwise(m))
    return fields.select("doc_id", F.explode("m").alias("label", "value"))


def with_weights(items: DataFrame, weights: DataFrame) -> DataFrame:
    """items (doc_id, item_code, net_weight, gross_weight, ...) with the weights (doc_id, code, net_weight, gross_weight) of the packing list of the same document: by the repaired code, else by the code as it stands; what an item has it keeps."""
    own = weights.select("doc_id", F.col("code").alias("_code"), F.struct(F.col("net_weight").cast("string").alias("net"), F.col("gross_weight").cast("string").alias("gross")).alias("_w"))
    codes = items.withColumn("_fixed", T.repaired_code(F.coalesce("item_code", F.lit(""))))
    met = codes.join(own.withColumnRenamed("_code", "_fixed").withColumnRenamed("_w", "_w1"), ["doc_id", "_fixed"], "left")
    met = met.join(own.withColumnRenamed("_code", "item_code").withColumnRenamed("_w", "_w2"), ["doc_id", "item_code"], "left")
    w = F.coalesce("_w1", "_w2")
    return met.withColumns({f"{c}_weight": F.coalesce(filled(F.col(f"{c}_weight")), w[c]) for c in ("net", "gross")}).select(*items.columns)
