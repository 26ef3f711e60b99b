"""Queries of the declaration's sheets and of the posted document, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import sheets
from ..sources.views import sql, view
from .registry import query

HEAD, BOTH = sql("v_headers"), sql("v_headers", "v_items")
_num = lambda c: f"coalesce(TRY_CAST(nullif({c}, '') AS DOUBLE), 0)"
_rate = lambda c: f"(CASE coalesce(nullif({c}, ''), 'USD') {' '.join(f'WHEN {k!r} THEN CAST({v} AS DOUBLE)' for k, v in dims.FX.items())} ELSE 1 END)"


def _heads(spark, d) -> DataFrame:
    """Headers with their containers and seals as arrays."""
    parts = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    return view(spark, d, "v_headers").withColumns({"containers": parts("containers"), "seals": parts("seals")})


@query(f"{HEAD} SELECT id, CASE WHEN seller_name = '' THEN shipper_name ELSE seller_name END AS seller_name, CASE WHEN seller_name = '' THEN shipper_address ELSE seller_address END AS seller_address, CASE WHEN buyer_name = '' THEN consignee_name ELSE buyer_name END AS buyer_name FROM v_headers")
def party_fallback(spark, d) -> DataFrame:
    return sheets.parties_filled(_heads(spark, d)).select("id", "seller_name", "seller_address", "buyer_name")


_some = lambda c: f"(coalesce({c}, '') <> '')"


@query(
    f"""{BOTH}, i AS (SELECT doc_id, avg(c) AS m, count(*) AS n, count(*) FILTER (c < 0.35) AS low FROM (SELECT doc_id, CAST(partkey % 100 AS DOUBLE) / 100 AS c FROM v_items) GROUP BY doc_id),
 s AS (SELECT h.*, ({' + '.join(f'{_some(c)}::INT' for c in dims.HEADER_FIELDS)})::DOUBLE / 13 AS share, m, n, low, list_filter([{', '.join(f"CASE WHEN NOT {_some(c)} THEN '{c}' END" for c in dims.REQUIRED_FIELDS)}], lambda x: x IS NOT NULL) AS gone FROM v_headers h LEFT JOIN i ON doc_id = id),
 t AS (SELECT *, CASE WHEN n > 0 THEN (share + (m * (1 - 0.3::DOUBLE * low / n) + 1) / 2) / 2 ELSE share END AS sure FROM s)
 SELECT id, round_even(sure, 3) AS confidence, CASE WHEN len(gone) > 5 THEN 'FAIL' WHEN len(gone) > 2 OR sure < 0.5 THEN 'REVIEW' ELSE 'PASS' END AS flag, array_to_string(gone, ',') AS missing, 10 - len(gone) AS n_present, coalesce(n, 0) AS n_items, coalesce(low, 0) AS n_low FROM t"""
)
def quality_report(spark, d) -> DataFrame:
    items = view(spark, d, "v_items").select("doc_id", ((F.col("partkey") % 100).cast("double") / 100).alias("confidence"))
    return sheets.quality_report(_heads(spark, d), items)


@query(
    f"""{HEAD} SELECT id, '1.0' AS seri, '380' AS code, trim(invoice_number) AS number, strftime(try_strptime(invoice_date, '%d/%m/%Y'), '%d/%m/%Y') AS day FROM v_headers WHERE invoice_number <> ''
 UNION ALL SELECT id, '2.0', '860', bl_number, strftime(try_strptime(bl_date, '%Y-%m-%d'), '%d/%m/%Y') FROM v_headers WHERE bl_number <> ''"""
)
def document_rows(spark, d) -> DataFrame:
    return sheets.document_rows(_heads(spark, d))


@query(f"{HEAD} SELECT id, '1' AS seri, '1' AS mode, trim(nullif(vessel_name, '')) AS name, voyage_number AS number FROM v_headers WHERE vessel_name <> '' OR voyage_number <> ''")
def transport_rows(spark, d) -> DataFrame:
    return sheets.transport_rows(_heads(spark, d))


@query(
    f"""{BOTH}, q AS (SELECT doc_id, sum({_num('quantity')}) AS q FROM v_items GROUP BY doc_id), n AS (SELECT id, packaging_type AS t, {_num('number_of_packages')} AS n, coalesce(q, 0) AS q FROM v_headers LEFT JOIN q ON doc_id = id)
 SELECT id, '1' AS seri, CASE WHEN n = 0 AND q > 0 THEN 'PCE' WHEN t = 'cartons' THEN 'CT' WHEN t = 'pallet' THEN 'TDP' ELSE 'PCE' END AS code, CASE WHEN n = 0 THEN q ELSE n END AS number, '-' AS brand FROM n WHERE n <> 0 OR q > 0"""
)
def package_rows(spark, d) -> DataFrame:
    return sheets.package_rows(_heads(spark, d), view(spark, d, "v_items"))


@query(
    f"""{HEAD}, a AS (SELECT id, list_filter(string_split(containers, '|'), lambda x: x <> '') AS c, list_filter(string_split(seals, '|'), lambda x: x <> '') AS s FROM v_headers), e AS (SELECT id, s, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS box FROM a)
 SELECT id, CAST(k AS VARCHAR) AS seri, upper(trim(box)) AS number, CASE WHEN contains(box, '40') THEN '40' WHEN contains(box, '45') THEN '45' ELSE '20' END AS size, '8' AS kind, '1' AS type, upper(trim(s[k])) AS seal FROM e"""
)
def container_rows(spark, d) -> DataFrame:
    return sheets.container_rows(_heads(spark, d))


@query(
    f"""{BOTH}, g AS (SELECT i.*, {_rate('currency')} AS rate, {_num('quantity')} AS q, {_num('price')} AS p, {_num('i.amount')} AS a FROM v_items i JOIN v_headers ON id = doc_id), f AS (SELECT *, CASE WHEN a <> 0 THEN a WHEN q > 0 AND p > 0 THEN q * p ELSE 0 END AS fob FROM g)
 SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS seri, CASE WHEN length(hs_code) >= 6 THEN rpad(hs_code[1:8], 8, '0') ELSE '94031000' END AS hs, item_code AS code, dimensions AS size, CASE WHEN q > 0 THEN q END AS quantity,
 CASE WHEN {_num("replace(net, 'n/a', '')")} > 0 THEN {_num("replace(net, 'n/a', '')")} END AS net, CASE WHEN {_num('gross')} > 0 THEN {_num('gross')} END AS gross, CASE WHEN fob > 0 THEN fob END AS fob, CASE WHEN fob > 0 THEN fob END AS cif, CASE WHEN fob > 0 THEN fob * rate END AS cif_rupiah,
 CASE WHEN fob > 0 THEN rate END AS ndpbm, CASE WHEN p > 0 THEN p END AS unit_price, '-' AS lain, 'KMD' AS guna, '1' AS asal, 'T' AS lartas, 'T' AS empat_tahun, '1' AS kondisi, 'Metode 1' AS metode, 'T' AS perbedaan FROM f"""
)
def goods_rows(spark, d) -> DataFrame:
    return sheets.goods_rows(_heads(spark, d), view(spark, d, "v_items"))


_VALUED = f"""v0 AS (SELECT id, coalesce(incoterms, '') IN ('CIF', 'CFR') AS based, {_num('total_amount')} AS total, {_num('freight')} AS paid, CASE WHEN containers = '' THEN 0 WHEN contains(containers, '|') THEN 2 ELSE 1 END AS n, {_rate('currency')} AS rate FROM v_headers),
 v1 AS (SELECT *, CASE WHEN based THEN total - paid ELSE total END AS fob, CASE WHEN based AND paid = 0 AND n > 0 THEN 1400.0::DOUBLE * n ELSE paid END AS fr FROM v0),
 v2 AS (SELECT *, CASE WHEN fob + fr <= 0 THEN 0 ELSE greatest(20, least((fob + fr) * 0.005::DOUBLE, 500)) END AS ins FROM v1), v AS (SELECT *, fob + fr + ins AS cif FROM v2)"""


@query(f"{HEAD}, {_VALUED} SELECT id, round_even(fob, 2) AS price, round_even(fr, 2) AS freight, round_even(ins, 2) AS insurance, round_even(cif, 2) AS cif, round_even(cif * rate, 2) AS cif_rupiah, rate AS ndpbm FROM v")
def cost_rows(spark, d) -> DataFrame:
    return sheets.cost_rows(_heads(spark, d))


@query(
    f"""{BOTH}, {_VALUED}, f AS (SELECT doc_id, arg_min(hs_code, ord) AS hs FROM v_items GROUP BY doc_id), b AS (SELECT id, cif, CASE WHEN hs = '940310' THEN 10.0::DOUBLE ELSE 5.0::DOUBLE END AS pct FROM v LEFT JOIN f ON doc_id = id), c AS (SELECT *, cif * pct / 100 AS bm FROM b)
 SELECT id, 'BM' AS kind, round_even(bm, 2) AS value, 'BM' || CAST(CAST(pct AS INT) AS VARCHAR) || '%' AS rate FROM c UNION ALL SELECT id, 'PPN', round_even((bm + cif) * 0.11::DOUBLE, 2), NULL FROM c"""
)
def duty_rows(spark, d) -> DataFrame:
    return sheets.duty_rows(_heads(spark, d), view(spark, d, "v_items"))


_day = "try_strptime(nullif(invoice_date, ''), '%d/%m/%Y')"
_cast = lambda c: f"TRY_CAST(nullif({c}, '') AS DOUBLE)"
_CUSTOMS = f"""h AS (SELECT *, {_day} AS day, CASE WHEN incoterms IN ('CIF', 'FOB', 'CFR', 'EXW') THEN incoterms ELSE 'FOB' END AS term, {_cast('total_amount')} AS total, {_cast('freight')} AS fr, {_cast('insurance')} AS ins FROM v_headers),
 w AS (SELECT *, CASE WHEN term IN ('CIF', 'CFR') THEN greatest(0, coalesce(total, 0) - coalesce(fr, 0) - coalesce(ins, 0)) ELSE total END AS worth FROM h),
 head AS (SELECT id, '04030020' || '000000' || strftime(day, '%Y%m%d') || '000001' AS "nomorAju", strftime(day, '%Y-%m-%d') AS "tanggalAju", '040300' AS "kodeKantor", '20' AS "kodeDokumen", '1' AS "kodeCaraBayar", term AS "kodeIncoterm", total AS "nilaiIncoterm", 15000.0::DOUBLE AS ndpbm,
 coalesce(nullif(currency, ''), 'USD') AS valuta, worth AS fob, ins AS asuransi, fr AS freight, worth AS "nilaiBarang", coalesce(nullif(port_of_loading, ''), 'CN') AS "kodePelMuat", coalesce(nullif(port_of_discharge, ''), 'ID') AS "kodePelTujuan", coalesce(nullif(buyer_name, ''), nullif(seller_name, ''), 'UNKNOWN') AS "namaPerusahaan",
 'LN' AS "kodeAsuransi", 'MANAGER' AS "jabatanTtd", coalesce(invoice_number, '') AS "invoiceNumber", coalesce(invoice_date, '') AS "invoiceDate" FROM w)"""


@query(f"{HEAD}, {_CUSTOMS} SELECT * FROM head")
def customs_header(spark, d) -> DataFrame:
    return sheets.customs_header(_heads(spark, d), "040300")


_or = lambda c, e: f"coalesce(nullif(TRY_CAST(nullif({c}, '') AS DOUBLE), 0), {e})"
_GOODS = f"""c1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS seri, {_or('quantity', '1')} AS q, {_or('price', '0')} AS p FROM v_items), c2 AS (SELECT *, {_or('amount', 'q * p')} AS a FROM c1),
 goods AS (SELECT doc_id AS id, seri, coalesce(rpad(nullif(hs_code, ''), 8, '0'), '00000000') AS "hsCode", q AS "jumlahSatuan", 'NMP' AS "kodeSatuan", p AS "hargaSatuan", a AS "hargaPerolehan", a AS cif, a * 15000 AS "cifRupiah", {_or("replace(net, 'n/a', '')", '0')} AS netto, {_or('gross', '0')} AS bruto, '01' AS "kodeGuna" FROM c2)"""


@query(f"{sql('v_items')}, {_GOODS} SELECT * FROM goods")
def customs_items(spark, d) -> DataFrame:
    return sheets.customs_items(view(spark, d, "v_items"))


@query(f"{BOTH}, {_CUSTOMS}, {_GOODS}, n AS (SELECT id, count(*) AS n, max(\"cifRupiah\") FILTER (seri = 1) AS first FROM goods GROUP BY id) SELECT id, \"namaPerusahaan\" AS company, coalesce(n, 0) AS n_goods, first AS first_rupiah FROM head LEFT JOIN n USING (id)")
def customs_document(spark, d) -> DataFrame:
    """Fields read back from the posted document."""
    docs = sheets.customs_document(sheets.customs_header(_heads(spark, d), "040300"), sheets.customs_items(view(spark, d, "v_items")))
    read = lambda path: F.get_json_object("document", path)
    n = F.coalesce(F.json_array_length(read("$.barang")), F.lit(0)).cast("bigint")
    return docs.select("id", read("$.namaPerusahaan").alias("company"), n.alias("n_goods"), read("$.barang[0].cifRupiah").cast("double").alias("first_rupiah"))


@query(f"{HEAD} SELECT id, '1.3' AS version FROM v_headers")
def version_rows(spark, d) -> DataFrame:
    return view(spark, d, "v_headers").select("id", F.lit(sheets.VERSION).alias("version"))


@query(
    f"""{HEAD} SELECT id, CASE WHEN upper(notify_party_name) LIKE 'SAME AS%' AND consignee_name <> '' THEN consignee_name ELSE notify_party_name END AS notify, CASE WHEN upper(notify_party_name) LIKE 'SAME AS%' AND consignee_name <> '' THEN 0.92::DOUBLE ELSE confidence END AS confidence FROM v_headers"""
)
def notify_resolved(spark, d) -> DataFrame:
    """A notified party that is said to be the same takes the consignee of its document."""
    same = F.upper("notify_party_name").startswith("SAME AS") & (F.col("consignee_name") != "")
    return view(spark, d, "v_headers").select("id", F.when(same, F.col("consignee_name")).otherwise(F.col("notify_party_name")).alias("notify"), F.when(same, 0.92).otherwise(F.col("confidence")).alias("confidence"))


_LABELS = {"invoice_number": "Invoice No", "bl_number": "B/L No", "vessel_name": "Vessel", "seller_name": "Seller", "buyer_name": "Buyer", "total_amount": "Total"}


@query(f"{HEAD} " + " UNION ALL ".join(f"SELECT id, '{label}' AS label, {c}[1:80] AS value FROM v_headers WHERE {_some(c)}" for c, label in _LABELS.items()))
def header_response(spark, d) -> DataFrame:
    """Header fields that have a value, under their labels, as rows of at most 80 characters."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.substring(c, 1, 80).alias("value")) for c, label in _LABELS.items()])
    return view(spark, d, "v_headers").select("id", F.inline(F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")))
