"""Sheets of a customs declaration and the mapper's document: rows from headers and items of shipments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..functions import values as V
from ..functions.text import MAPPER_PATTERNS, date_by, number_28
from . import lookup

#: Fixed values of the declaration's sheets.
LOW_QUALITY = 0.35
GOODS_CONSTANTS = {"lain": "-", "guna": "KMD", "asal": "1", "lartas": "T", "empat_tahun": "T", "kondisi": "1", "metode": "Metode 1", "perbedaan": "T"}
CONTAINER_KIND, CONTAINER_TYPE, VERSION, DEFAULT_HS = "8", "1", "1.3", "94031000"


def held(c: str | Column) -> Column:
    return V.filled(F.col(c) if isinstance(c, str) else c).isNotNull()


def amount(c: str) -> Column:
    return V.amount_by_rules(F.col(c))


def parties_filled(headers: DataFrame) -> DataFrame:
    """A seller without a name takes name and address of the shipper, a buyer the consignee's name."""
    no_seller = ~held("seller_name")
    return headers.withColumns({
        "seller_name": F.when(no_seller, F.col("shipper_name")).otherwise(F.col("seller_name")),
        "seller_address": F.when(no_seller, F.col("shipper_address")).otherwise(F.col("seller_address")),
        "buyer_name": F.when(held("buyer_name"), F.col("buyer_name")).otherwise(F.col("consignee_name")),
    })


def quality_report(headers: DataFrame, items: DataFrame) -> DataFrame:
    """(id, confidence, flag, missing, n_present, n_items, n_low) of each shipment.

    The share of filled header fields is averaged with the mean confidence of the items, less a penalty for those of low quality.
    """
    per = items.groupBy("doc_id").agg(F.avg("confidence").alias("_mean"), F.count("*").alias("n_items"), F.count_if(F.col("confidence") < LOW_QUALITY).alias("n_low"))
    both = headers.join(per.withColumnRenamed("doc_id", "id"), "id", "left")
    share = sum((held(c).cast("int") for c in dims.HEADER_FIELDS), F.lit(0)) / F.lit(float(len(dims.HEADER_FIELDS)))
    quality = (F.col("_mean") * (1 - 0.3 * F.col("n_low") / F.col("n_items")) + 1) / 2
    sure = F.when(F.col("n_items") > 0, (share + quality) / 2).otherwise(share)
    missing = F.filter(F.array(*[F.when(~held(c), F.lit(c)) for c in dims.REQUIRED_FIELDS]), lambda x: x.isNotNull())
    out = both.select("id", sure.alias("_sure"), missing.alias("_missing"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_low", F.lit(0)).alias("n_low"))
    n = F.size("_missing")
    flag = F.when(n > 5, "FAIL").when((n > 2) | (F.col("_sure") < 0.5), "REVIEW").otherwise("PASS")
    return out.select("id", F.bround("_sure", 3).alias("confidence"), flag.alias("flag"), F.array_join("_missing", ",").alias("missing"), (len(dims.REQUIRED_FIELDS) - n).alias("n_present"), "n_items", "n_low")


def document_rows(headers: DataFrame) -> DataFrame:
    row = lambda seri, code, number, day: F.struct(F.lit(seri).alias("seri"), F.lit(code).alias("code"), F.trim(number).alias("number"), F.date_format(V.parsed_date(F.col(day)), "dd/MM/yyyy").alias("day"), held(number).alias("keep"))
    rows = F.array(row("1.0", "380", F.col("invoice_number"), "invoice_date"), row("2.0", "860", F.col("bl_number"), "bl_date"))
    return headers.select("id", F.inline(F.filter(rows, lambda r: r["keep"]))).drop("keep")


def transport_rows(headers: DataFrame) -> DataFrame:
    return headers.where(held("vessel_name") | held("voyage_number")).select("id", F.lit("1").alias("seri"), F.lit("1").alias("mode"), F.trim(V.filled(F.col("vessel_name"))).alias("name"), F.trim(V.filled(F.col("voyage_number"))).alias("number"))


def package_rows(headers: DataFrame, items: DataFrame) -> DataFrame:
    """One row of packages; without a number, the items' quantity in pieces; without either, none."""
    total = items.groupBy("doc_id").agg(F.sum(V.amount_by_rules(F.coalesce("quantity", F.lit("0")))).alias("_q")).withColumnRenamed("doc_id", "id")
    rows = headers.join(total, "id", "left").withColumn("_n", amount("number_of_packages"))
    by_items = (F.col("_n") == 0) & (F.coalesce("_q", F.lit(0.0)) > 0)
    code = F.when(by_items, "PCE").otherwise(lookup.packaging_code(F.col("packaging_type")))
    return rows.select("id", F.lit("1").alias("seri"), code.alias("code"), F.when(by_items, F.col("_q")).otherwise(F.col("_n")).alias("number"), F.lit("-").alias("brand")).where("number <> 0")


def container_rows(headers: DataFrame) -> DataFrame:
    """A row a container with its seal by place; seals beyond the containers are dropped. headers has arrays containers and seals."""
    each = headers.select("id", "seals", F.posexplode("containers").alias("k", "box"))
    seal = F.trim(F.upper(F.get("seals", F.col("k"))))
    return each.select("id", (F.col("k") + 1).cast("string").alias("seri"), F.trim(F.upper("box")).alias("number"), V.container_size(F.col("box")).alias("size"), F.lit(CONTAINER_KIND).alias("kind"), F.lit(CONTAINER_TYPE).alias("type"), seal.alias("seal"))


def goods_rows(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Goods of the declaration: numbered in order of ord, with defaults, fob (quantity times price where there is no amount) and its value in rupiah."""
    h = headers.select(F.col("id").alias("doc_id"), V.fx_rate(lookup.currency_code(F.col("currency"))).alias("rate"))
    w = W.partitionBy("doc_id").orderBy("ord")
    q, p, a = amount("quantity"), amount("price"), amount("amount")
    digits = V.digits(F.coalesce("hs_code", F.lit("")))
    out = items.join(h, "doc_id").withColumns({"seri": F.row_number().over(w), "_q": q, "_p": p, "_a": a})
    fob = F.when(F.col("_a") != 0, F.col("_a")).when((F.col("_q") > 0) & (F.col("_p") > 0), F.col("_q") * F.col("_p")).otherwise(0.0)
    out = out.withColumn("_fob", fob)
    some = lambda value, places: F.when(value > 0, F.bround(value, places))
    return out.select(
        F.col("doc_id").alias("id"), "seri", F.when(F.length(digits) >= 6, F.rpad(F.substring(digits, 1, 8), 8, "0")).otherwise(DEFAULT_HS).alias("hs"), F.trim("item_code").alias("code"), F.trim("dimensions").alias("size"),
        F.when(F.col("_q") > 0, F.col("_q")).alias("quantity"), some(amount("net"), 3).alias("net"), some(amount("gross"), 3).alias("gross"),
        some(F.col("_fob"), 2).alias("fob"), some(F.col("_fob"), 2).alias("cif"), some(F.col("_fob") * F.col("rate"), 2).alias("cif_rupiah"), F.when(F.col("_fob") > 0, F.col("rate")).alias("ndpbm"),
        some(F.col("_p"), 4).alias("unit_price"), *[F.lit(v).alias(k) for k, v in GOODS_CONSTANTS.items()],
    )


def _valued(headers: DataFrame) -> DataFrame:
    """Adds fob, fr, ins, cif and rate of the cost sheet, which estimates freight by the number of containers where a term includes it."""
    code = lookup.incoterm_code(F.col("incoterms"))
    based = V.cif_term(code)
    total, paid = amount("total_amount"), amount("freight")
    n = F.size("containers")
    out = headers.withColumns({"_total": total, "_paid": paid, "_based": based})
    fob = F.when(F.col("_based"), F.col("_total") - F.col("_paid")).otherwise(F.col("_total"))
    guessed = F.when(F.col("_based") & (F.col("_paid") == 0) & (n > 0), dims.FREIGHT["40"] * n).otherwise(F.col("_paid"))
    out = out.withColumns({"fob": fob, "fr": guessed}).withColumn("ins", V.insurance(F.col("fob") + F.col("fr")))
    return out.withColumns({"cif": F.col("fob") + F.col("fr") + F.col("ins"), "rate": V.fx_rate(lookup.currency_code(F.col("currency")))})


def cost_rows(headers: DataFrame) -> DataFrame:
    v = _valued(headers)
    two = lambda c: F.bround(c, 2)
    return v.select("id", two("fob").alias("price"), two("fr").alias("freight"), two("ins").alias("insurance"), two("cif").alias("cif"), two(F.col("cif") * F.col("rate")).alias("cif_rupiah"), F.col("rate").alias("ndpbm"))


def duty_rows(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Import duty and VAT of each shipment, by the chapter of its first item's code."""
    first = items.groupBy("doc_id").agg(F.min(F.struct("ord", "hs_code"))["hs_code"].alias("_hs")).withColumnRenamed("doc_id", "id")
    v = _valued(headers).join(first, "id", "left")
    pct = F.coalesce(V.lookup(F.substring(V.digits(F.col("_hs")), 1, 2), dims.CHAPTERS), F.lit(dims.CHAPTER_DEFAULT))
    v = v.withColumn("pct", pct).withColumn("bm", F.col("cif") * F.col("pct") / 100).withColumn("ppn", (F.col("bm") + F.col("cif")) * dims.VAT)
    rate = F.concat(F.lit("BM"), F.bround("pct", 0).cast("int").cast("string"), F.lit("%"))
    rows = F.array(F.struct(F.lit("BM").alias("kind"), F.bround("bm", 2).alias("value"), rate.alias("rate")), F.struct(F.lit("PPN").alias("kind"), F.bround("ppn", 2).alias("value"), F.lit(None).cast("string").alias("rate")))
    return v.select("id", F.inline(rows))


# the mapper's document -------------------------------------------------------------------------------------------------


def customs_header(headers: DataFrame, office: str, document: str = "20", taxpayer: str = "") -> DataFrame:
    """Header of the document that is posted. Without a day the number and day are null: today's would not be repeatable."""
    money = {c: V.amount_plain(F.col(c)) for c in ("total_amount", "freight", "insurance")}
    term = F.when(F.upper("incoterms").isin(*dims.INCOTERMS), F.upper("incoterms")).otherwise("FOB")
    day = date_by(F.col("invoice_date"), MAPPER_PATTERNS)
    out = headers.withColumns({"_day": day, "_term": term, **{f"_{k}": v for k, v in money.items()}})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fob = F.when(F.col("_term").isin(*dims.CIF_TERMS), F.greatest(F.lit(0.0), zero("_total_amount") - zero("_freight") - zero("_insurance"))).otherwise(F.col("_total_amount"))
    pick = lambda *cs: F.coalesce(*[V.filled(F.col(c)) if not isinstance(c, Column) else c for c in cs])
    return out.select(
        "id", number_28(F.lit(office), document, F.col("_day"), F.lit(taxpayer)).alias("nomorAju"), F.date_format("_day", "yyyy-MM-dd").alias("tanggalAju"), F.lit(office).alias("kodeKantor"), F.lit(document).alias("kodeDokumen"),
        F.lit("1").alias("kodeCaraBayar"), F.col("_term").alias("kodeIncoterm"), F.col("_total_amount").alias("nilaiIncoterm"), F.lit(15000.0).alias("ndpbm"), pick("currency", F.lit("USD")).alias("valuta"),
        fob.alias("fob"), F.col("_insurance").alias("asuransi"), F.col("_freight").alias("freight"), fob.alias("nilaiBarang"), pick("port_of_loading", F.lit("CN")).alias("kodePelMuat"), pick("port_of_discharge", F.lit("ID")).alias("kodePelTujuan"),
        pick("buyer_name", "seller_name", F.lit("UNKNOWN")).alias("namaPerusahaan"), F.lit("LN").alias("kodeAsuransi"), F.lit("MANAGER").alias("jabatanTtd"), F.coalesce("invoice_number", F.lit("")).alias("invoiceNumber"), F.coalesce("invoice_date", F.lit("")).alias("invoiceDate"),
    )


def customs_items(items: DataFrame, rate: float = 15000.0) -> DataFrame:
    """Goods of the posted document, numbered in order of ord; a missing or zero quantity is 1, an amount quantity times price."""
    w = W.partitionBy("doc_id").orderBy("ord")
    or_else = lambda c, d: F.coalesce(F.nullif(V.amount_plain(F.col(c)), F.lit(0.0)), d)
    out = items.withColumns({"seri": F.row_number().over(w), "_q": or_else("quantity", F.lit(1.0)), "_p": or_else("price", F.lit(0.0))}).withColumn("_a", or_else("amount", F.col("_q") * F.col("_p")))
    return out.select(
        F.col("doc_id").alias("id"), "seri", F.coalesce(V.hs_padded(V.filled(F.col("hs_code"))), F.lit("00000000")).alias("hsCode"), F.col("_q").alias("jumlahSatuan"), F.lit("NMP").alias("kodeSatuan"), F.col("_p").alias("hargaSatuan"),
        F.col("_a").alias("hargaPerolehan"), F.col("_a").alias("cif"), (F.col("_a") * rate).alias("cifRupiah"), or_else("net", F.lit(0.0)).alias("netto"), or_else("gross", F.lit(0.0)).alias("bruto"), F.lit("01").alias("kodeGuna"),
    )


def customs_document(header: DataFrame, items: DataFrame) -> DataFrame:
    """(id, document): the header's fields and barang, the array of its goods, as JSON."""
    goods = items.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in items.columns if c != "id"]))).alias("barang"))
    both = header.join(goods, "id", "left")
    return both.select("id", F.to_json(F.struct(*[c for c in header.columns if c != "id"], "barang")).alias("document"))
