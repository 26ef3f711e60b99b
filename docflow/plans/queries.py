"""The engine's queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..functions import values as V
from ..operators import analytics, documents, lookup
from ..sources.views import load, sql, view
from .registry import query

SHIP, ACT, STR, ITEM, CAND, WORD, TAG = (sql(v) for v in ("v_shipments", "v_activities", "v_strings", "v_items", "v_candidates", "v_words", "v_tags"))

# reads over shipments and activities --------------------------------------------------------------------------------

_KPI = """SELECT count(*) AS total, count(*) FILTER (status = 'Draft Valid') AS n_draft_valid, count(*) FILTER (status = 'Draft Invalid') AS n_draft_invalid,
 count(*) FILTER (status = 'Sent') AS n_sent, count(*) FILTER (status = 'Failed') AS n_failed, count(*) FILTER (status = 'Approved') AS n_approved,
 count(*) FILTER (documents LIKE '%"CI"%') AS with_ci, count(*) FILTER (documents LIKE '%"PL"%') AS with_pl, count(*) FILTER (documents LIKE '%"BL"%') AS with_bl,
 coalesce(round_even(avg(confidence) FILTER (confidence > 0) * 100, 1), 0) AS avg_confidence,
 count(*) FILTER (status IN ('Draft Valid', 'Sent')) AS ceisa_ready, count(*) FILTER (status = 'Draft Invalid') AS needs_review FROM v_shipments"""


@query(f"{SHIP} {_KPI}")
def dash_kpi(spark, d) -> DataFrame:
    return analytics.kpis(view(spark, d, "v_shipments"))


@query(f"""{SHIP} SELECT kind, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(replace(documents, '[', ''), ']', ''), '"', ''), ',')) AS kind FROM v_shipments) GROUP BY kind""")
def dash_doc_membership(spark, d) -> DataFrame:
    return view(spark, d, "v_shipments").select(F.explode(F.from_json("documents", "array<string>")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{SHIP} SELECT id, reference_code, filename, status, CAST(round_even(confidence * 100, 0) AS INT) AS confidence, replace(replace(replace(documents, '[', ''), ']', ''), chr(34), '') AS documents, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM v_shipments WHERE status LIKE 'Draft%' AND (filename ILIKE '%_1%' OR reference_code ILIKE '%99%') ORDER BY updated_at DESC, id LIMIT 50 OFFSET 50")
def ship_list_page(spark, d) -> DataFrame:
    found = analytics.search(view(spark, d, "v_shipments").where(F.col("status").startswith("Draft")), filename="_1", reference_code="99")
    top = analytics.page(found, F.desc_nulls_first("updated_at"), F.col("id"), size=50, number=2)
    documents_held = F.from_json("documents", "array<string>")
    return top.select("id", "reference_code", "filename", "status", F.coalesce(F.bround(F.col("confidence") * 100, 0).cast("int"), F.lit(0)).alias("confidence"), F.array_join(documents_held, ",").alias("documents"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"))


@query(f"{SHIP} SELECT id, filename, status FROM v_shipments WHERE filename ILIKE '%INVOICE_12%' OR reference_code ILIKE '%777%'")
def ship_search(spark, d) -> DataFrame:
    s = view(spark, d, "v_shipments")
    found = F.col("filename").ilike("%INVOICE_12%") | F.col("reference_code").ilike("%777%")
    return s.where(found).select("id", "filename", "status")


@query(f"{SHIP} SELECT id, reference_code, status, total FROM v_shipments WHERE id = 7")
def ship_get(spark, d) -> DataFrame:
    return view(spark, d, "v_shipments").where("id = 7").select("id", "reference_code", "status", "total")


@query(f"{SHIP} SELECT id, CASE WHEN id % 10 = 3 THEN 'Approved' ELSE status END AS status FROM v_shipments WHERE id % 11 <> 0")
def ship_update_delete(spark, d) -> DataFrame:
    s = view(spark, d, "v_shipments").select("id", "status")
    changes = s.where("id % 10 in (3, 4)").select("id", F.when(F.col("id") % 10 == 3, "Approved").otherwise("Lost").alias("new_status"))
    return analytics.without(analytics.with_status(s, changes), s.where("id % 11 = 0").select("id"))


@query(f"{SHIP} SELECT quality, status_now, count(*) AS n FROM (SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS quality, CASE WHEN confidence > 0.5 THEN 'Draft Valid' ELSE 'Draft Invalid' END AS status_now FROM v_shipments) GROUP BY ALL")
def quality_bucket(spark, d) -> DataFrame:
    s = view(spark, d, "v_shipments")
    return s.groupBy(analytics.quality(F.col("confidence")).alias("quality"), F.when(F.col("confidence") > 0.5, "Draft Valid").otherwise("Draft Invalid").alias("status_now")).agg(F.count("*").alias("n"))


@query(f"{ACT} SELECT id, action, status, description, reference_code FROM v_activities WHERE action = 'OCR Process' AND status = 'success' ORDER BY created_at DESC, id LIMIT 20")
def act_list_page(spark, d) -> DataFrame:
    rows = view(spark, d, "v_activities").where("action = 'OCR Process' and status = 'success'")
    return analytics.page(rows, F.desc_nulls_first("created_at"), F.col("id")).select("id", "action", "status", "description", "reference_code")


@query(f"{ACT} SELECT id, reference_code FROM v_activities WHERE description ILIKE '%pment 1%' OR reference_code ILIKE '%42%'")
def act_search(spark, d) -> DataFrame:
    return analytics.search(view(spark, d, "v_activities"), description="pment 1", reference_code="42").select("id", "reference_code")


@query(f"{ACT} SELECT count(*) AS total, count(*) FILTER (action = 'OCR Process') AS ocr_runs, count(*) FILTER (action IN ('Declaration Send', 'Declaration Approve')) AS submissions, max(created_at) AS latest FROM v_activities")
def act_stats(spark, d) -> DataFrame:
    return analytics.activity_stats(view(spark, d, "v_activities"))


@query(f"{ACT} SELECT action, status, count(*) AS n, sum(CAST(json_extract_string(metadata, '$.k') AS BIGINT)) AS sum_k FROM v_activities GROUP BY action, status")
def act_metadata(spark, d) -> DataFrame:
    a = view(spark, d, "v_activities").withColumn("m", F.from_json("metadata", "map<string,string>"))
    return a.groupBy("action", "status").agg(F.count("*").alias("n"), F.sum(F.try_element_at("m", F.lit("k")).try_cast("bigint")).alias("sum_k"))


_FLAGS = "SELECT l_suppkey AS dataset, bool_or(l_returnflag = 'A') AS ci, bool_or(l_linenumber = 2) AS pl, bool_or(l_shipmode_) AS bl FROM (SELECT *, l_partkey % 50 = 0 AS l_shipmode_ FROM lineitem) GROUP BY l_suppkey"


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN ci AND pl AND bl THEN 'complete' WHEN ci OR pl OR bl THEN 'partial' ELSE 'missing' END AS status FROM ({_FLAGS})) GROUP BY status")
def dataset_status(spark, d) -> DataFrame:
    files = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("ci"), F.bool_or(F.col("l_linenumber") == 2).alias("pl"), F.bool_or(F.col("l_partkey") % 50 == 0).alias("bl"))
    status = F.when(F.expr("ci and pl and bl"), "complete").when(F.expr("ci or pl or bl"), "partial").otherwise("missing")
    return files.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# scalar rules ---------------------------------------------------------------------------------------------------------

_NUM = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$'"


@query(
    f"""{STR}, a AS (SELECT id, amount, replace(replace(trim(regexp_replace(trim(amount), '[A-Z$€£¥₹p]', '', 'g')), '(', ''), ')', '') AS s, contains(amount, '(') AND contains(amount, ')') AS neg FROM v_strings),
 b AS (SELECT id, amount, neg, CASE WHEN contains(s, '.') AND contains(s, ',') AND strpos(reverse(s), '.') < strpos(reverse(s), ',') THEN replace(s, ',', '') WHEN contains(s, '.') AND contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.')
  WHEN contains(s, ',') AND regexp_matches(s, ',[0-9]{{1,3}}$') THEN replace(s, ',', '.') ELSE replace(s, ',', '') END AS t FROM a)
 SELECT id, CASE WHEN amount = '' THEN 0 ELSE coalesce(CASE WHEN regexp_matches(trim(t), {_NUM}) THEN TRY_CAST(trim(t) AS DOUBLE) END, 0) * CASE WHEN neg THEN -1 ELSE 1 END END AS value FROM b"""
)
def parse_amount_rules(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", V.amount_by_rules(F.col("amount")).alias("value"))


@query(f"{STR} SELECT id, CASE WHEN regexp_matches(s, {_NUM}) THEN TRY_CAST(s AS DOUBLE) END AS value FROM (SELECT id, trim(regexp_replace(trim(amount), '[A-Z$€£¥,]', '', 'g')) AS s FROM v_strings)")
def parse_amount_mapper(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", V.amount_plain(F.col("amount")).alias("value"))


@query(
    f"""{STR} SELECT id, CASE WHEN regexp_matches(t, {_NUM}) THEN t ELSE trim(amount) END AS value, CASE WHEN regexp_matches(t, {_NUM}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM (SELECT id, amount, CASE WHEN regexp_matches(trim(amount), '^[0-9]{{1,3}}(\\.[0-9]{{3}})*,[0-9]{{1,2}}$') THEN replace(replace(trim(amount), '.', ''), ',', '.')
 WHEN regexp_matches(trim(amount), '^[0-9]{{1,3}}(,[0-9]{{3}})*\\.[0-9]{{1,2}}$') THEN replace(trim(amount), ',', '') ELSE regexp_replace(trim(amount), '[ ,]', '', 'g') END AS t FROM v_strings)"""
)
def parse_amount_normalizer(spark, d) -> DataFrame:
    text, sure = V.number_normalised(F.col("amount"))
    return view(spark, d, "v_strings").select("id", text.alias("value"), sure.alias("confidence"))


@query(f"{STR} SELECT id, strftime(coalesce(try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d-%m-%Y'), CASE WHEN day LIKE '%/%' THEN try_strptime(day, '%Y/%m/%d') END, CASE WHEN day LIKE '%-%' THEN try_strptime(day, '%Y-%m-%d') END, try_strptime(day, '%d.%m.%Y')), '%d/%m/%Y') AS day FROM v_strings")
def parse_dates_dmy(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", F.date_format(V.parsed_date(F.col("day")), "dd/MM/yyyy").alias("day"))


@query(
    f"""{STR} SELECT id, CASE WHEN regexp_matches(h, '^[0-9]{{6,13}}$') AND h[1:2] BETWEEN '01' AND '97' THEN h[1:4] || '.' || h[5:6] || CASE WHEN length(h) >= 8 THEN '.' || h[7:8] ELSE '' END END AS dotted,
 CASE WHEN length(n) >= 6 THEN rpad(n[1:8], 8, '0') WHEN length(n) > 0 THEN lpad(n, 8, '0') END AS padded, n[1:2] AS chapter, length(n) BETWEEN 6 AND 12 AS valid
 FROM (SELECT id, regexp_replace(hs, '[., ]', '', 'g') AS h, regexp_replace(hs, '[^0-9]', '', 'g') AS n FROM v_strings)"""
)
def hs_codes(spark, d) -> DataFrame:
    n = V.digits(F.col("hs"))
    return view(spark, d, "v_strings").select("id", V.hs_formatted(F.col("hs")).alias("dotted"), V.hs_padded(F.col("hs")).alias("padded"), F.substring(n, 1, 2).alias("chapter"), F.length(n).between(6, 12).alias("valid"))


@query(
    f"""{STR} SELECT id, regexp_extract(upper(box), '\\b([A-Z]{{3,4}})[Uu]?([0-9]{{6,7}})\\b', 1) AS prefix, regexp_extract(upper(box), '\\b([A-Z]{{3,4}})[Uu]?([0-9]{{6,7}})\\b', 2) AS serial,
 CASE WHEN box = '' THEN '20' WHEN contains(s, '20') AND contains(s, 'FT') THEN '20' WHEN contains(s, '40') AND (contains(s, 'HQ') OR contains(s, 'HC')) THEN '40HQ' WHEN contains(s, '40') THEN '40' WHEN contains(s, '45') THEN '45' WHEN s IN ('LCL', 'BULK') THEN 'LCL'
 WHEN regexp_matches(s, '\\b[0-9]{{1,2}}[FTQH]\\b') THEN regexp_extract(s, '\\b([0-9]{{1,2}})[FTQH]\\b', 1) || 'FT' ELSE '20' END AS size FROM (SELECT id, box, upper(trim(box)) AS s FROM v_strings)"""
)
def containers(spark, d) -> DataFrame:
    prefix, serial = V.container_number(F.col("box"))
    return view(spark, d, "v_strings").select("id", prefix.alias("prefix"), serial.alias("serial"), V.container_size(F.col("box")).alias("size"))


_CASES = lambda dim, key: " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in dim.items())


@query(f"{STR} SELECT id, weight * CASE upper(trim(unit)) {_CASES(dims.WEIGHTS, 'unit')} ELSE 1 END AS kg FROM v_strings")
def weight_convert(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", V.kilograms(F.col("weight"), F.col("unit")).alias("kg"))


@query(f"{SHIP} SELECT id, total * CASE upper(trim(currency)) {_CASES(dims.FX, 'currency')} ELSE 1 END AS idr FROM v_shipments")
def fx_convert(spark, d) -> DataFrame:
    return view(spark, d, "v_shipments").select("id", (F.col("total") * V.fx_rate(F.col("currency"))).alias("idr"))


@query(
    f"""{STR}, c AS (SELECT id, custkey % 3 AS n, CAST(custkey % 7 AS DOUBLE) AS cbm, CASE WHEN box = '' THEN '20' ELSE upper(trim(box)) END AS k FROM v_strings)
 SELECT id, CASE WHEN k = 'LCL' OR (cbm > 0 AND n = 0) THEN 50 * greatest(cbm, 1) ELSE CASE k {_CASES(dims.FREIGHT, 'k')} ELSE 800 END * n END AS cost FROM c"""
)
def freight(spark, d) -> DataFrame:
    s = view(spark, d, "v_strings").withColumn("n", F.col("custkey") % 3).withColumn("cbm", (F.col("custkey") % 7).cast("double"))
    return s.select("id", V.freight_cost(F.col("box"), F.col("n"), F.col("cbm")).alias("cost"))


@query(f"{SHIP} SELECT id, CASE WHEN total <= 0 THEN 0 ELSE greatest(20, least(total * 0.005, 500)) END AS insurance FROM v_shipments")
def insurance(spark, d) -> DataFrame:
    return view(spark, d, "v_shipments").select("id", V.insurance(F.col("total")).alias("insurance"))


_DUTY = "SELECT o_orderkey AS id, o_totalprice AS fob, CAST(o_custkey % 900 AS DOUBLE) AS fr, CAST(25 AS DOUBLE) AS ins, CAST(o_custkey % 4 AS DOUBLE) * 2.5 AS pct FROM orders"


@query(f"SELECT id, cif, bm, (cif + bm) * 0.11::DOUBLE AS ppn, bm + cif AS nilaipabean, bm + cif + (cif + bm) * 0.11::DOUBLE AS total FROM (SELECT id, fob + fr + ins AS cif, (fob + fr + ins) * (pct / 100) AS bm FROM ({_DUTY}))")
def duty_bundle(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    parts = V.customs_value(F.col("o_totalprice"), (F.col("o_custkey") % 900).cast("double"), F.lit(25.0), (F.col("o_custkey") % 4).cast("double") * 2.5)
    return o.select(F.col("o_orderkey").alias("id"), *[v.alias(k) for k, v in parts.items()])


@query(f"{SHIP} SELECT id, CASE WHEN upper(trim(incoterm)) IN ('CIF', 'CIP', 'CFR', 'CPT') THEN total - freight - 100 ELSE total END AS fob FROM v_shipments")
def fob_from_total(spark, d) -> DataFrame:
    return view(spark, d, "v_shipments").select("id", V.fob_of_total(F.col("total"), F.col("incoterm"), F.col("freight"), F.lit(100.0)).alias("fob"))


@query(
    f"""{SHIP}, v AS (SELECT id, total, freight AS fr, upper(incoterm) IN ('CIF', 'CIP', 'CFR', 'CPT') AS c, greatest(20, least(total * 0.005, 500)) AS ins FROM v_shipments)
 SELECT id, CASE WHEN c THEN total ELSE total + fr + ins END AS cif, CASE WHEN NOT c THEN total WHEN fr > 0 THEN greatest(0, total - fr - ins) ELSE 0 END AS fob, CASE WHEN c AND fr <= 0 THEN 0 ELSE ins END AS insurance FROM v"""
)
def header_valuation(spark, d) -> DataFrame:
    t, fr, ins, c = F.col("total"), F.col("freight"), V.insurance(F.col("total")), V.cif_term(F.col("incoterm"))
    fob = F.when(~c, t).when(fr > 0, F.greatest(F.lit(0.0), t - fr - ins)).otherwise(0.0)
    return view(spark, d, "v_shipments").select("id", F.when(c, t).otherwise(t + fr + ins).alias("cif"), fob.alias("fob"), F.when(c & (fr <= 0), 0.0).otherwise(ins).alias("insurance"))


@query("SELECT o_orderkey AS id, '0405' || '25' || lpad(CAST(o_custkey % 1000000 AS VARCHAR), 6, '0') || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS VARCHAR), 6, '0') AS aju FROM orders")
def aju_build(spark, d) -> DataFrame:
    rows = documents.numbered(load(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "o_orderkey", "seq")
    seq = F.col("seq")
    return rows.select(F.col("o_orderkey").alias("id"), V.declaration_number(F.lit("0405"), F.lit("25"), F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0"), F.col("o_orderdate"), seq).alias("aju"))


_AJU = "'0405' || CASE WHEN o_orderkey % 5 = 0 THEN '20' ELSE '23' END || '000123' || CASE WHEN o_orderkey % 7 = 0 THEN '20260299' ELSE '20250105' END || CASE WHEN o_orderkey % 3 = 0 THEN '000000' ELSE '000007' END || CASE WHEN o_orderkey % 11 = 0 THEN '1' WHEN o_orderkey % 13 = 0 THEN NULL ELSE '' END"


@query(
    f"""SELECT id, concat_ws(',', CASE WHEN a IS NULL THEN 'empty' END, CASE WHEN length(a) <> 26 THEN 'format' END, CASE WHEN length(a) = 26 AND a[5:6] NOT IN ('01', '11', '12', '15', '23', '25', '27') THEN 'document' END, CASE WHEN length(a) = 26 AND try_strptime(a[13:20], '%Y%m%d') IS NULL THEN 'day' END,
 CASE WHEN length(a) = 26 AND try_strptime(a[13:20], '%Y%m%d') > TIMESTAMP '2025-06-01' THEN 'future' END, CASE WHEN length(a) = 26 AND a[21:26] = '000000' THEN 'sequence' END) AS errors FROM (SELECT o_orderkey AS id, {_AJU} AS a FROM orders)"""
)
def aju_validate(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_AJU).alias("a"))
    return o.select("id", F.array_join(V.declaration_errors(F.col("a"), dims.DOCUMENT_CODES, F.lit("2025-06-01").cast("date")), ",").alias("errors"))


# lookups ----------------------------------------------------------------------------------------------------------------


def _tier(dim: dict, name: str, inside: str, default: str, cleaned: str = "NULL") -> str:
    return f"""{STR}, dim(key, code, ord) AS (VALUES {dims.values(dims.keyed(dim))}), named AS (SELECT id, nullif({name}, '') AS name FROM v_strings)
 SELECT id, coalesce((SELECT max(code) FROM dim WHERE key = name), (SELECT arg_min(code, ord) FROM dim WHERE {inside}), (SELECT max(code) FROM dim WHERE key = {cleaned}), {default}) AS code FROM named"""


_EITHER = "contains(name, key) OR contains(key, name)"


@query(_tier(dims.PORTS, "upper(trim(port))", _EITHER, "NULL", "regexp_replace(name, '[,\\-\\s]*(CHINA|INDONESIA|KOREA|JAPAN|SINGAPORE|THAILAND|MALAYSIA|VIETNAM).*$', '')"))
def lookup_port(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", lookup.port_code(F.col("port")).alias("code"))


_FIRST = "(strpos({a}, {b}) > 0 AND NOT regexp_matches(CASE WHEN strpos({a}, {b}) > 1 THEN substr({a}, strpos({a}, {b}) - 1, 1) ELSE '' END, '[A-Z]') AND NOT regexp_matches(substr({a}, strpos({a}, {b}) + length({b}), 1), '[A-Z]'))"


@query(f"{_tier(dims.COUNTRIES, 'upper(trim(country))', 'length(name) <> 2 AND (' + _FIRST.format(a='name', b='key') + ' OR ' + _FIRST.format(a='key', b='name') + ')', 'CASE WHEN length(name) = 2 THEN name ELSE NULL END')}".replace("SELECT id, coalesce(", "SELECT id, coalesce(CASE WHEN length(name) = 2 THEN name END, ").replace("ELSE NULL END) AS code", "ELSE 'CN' END) AS code"))
def lookup_country(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", lookup.country_code(F.col("country")).alias("code"))


@query(_tier(dims.CURRENCIES, "regexp_replace(upper(trim(money)), '[/\\s]*(?:PER|KGS?|LBS?)\\s*$', '')", _EITHER, "'USD'"))
def lookup_currency(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", lookup.currency_code(F.col("money")).alias("code"))


@query(_tier(dims.INCOTERMS, "upper(trim(term))", "contains(name, key)", "NULL"))
def lookup_incoterm(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", lookup.incoterm_code(F.col("term")).alias("code"))


@query(_tier(dims.PACKAGING, "upper(trim(pack))", "contains(name, key)", "'PCE'"))
def lookup_packaging(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", lookup.packaging_code(F.col("pack")).alias("code"))


@query(f"{STR}, dim(key, code, ord) AS (VALUES {dims.values([(k, int(v), i) for k, v, i in dims.keyed(dims.PARTIES)])}) SELECT id, coalesce((SELECT arg_min(code, ord) FROM dim WHERE contains(lower(trim(party)), key)), 1) AS code FROM v_strings")
def lookup_party(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", lookup.party_code(F.col("party")).alias("code"))


@query(f"{STR}, dim(key, duty) AS (VALUES {dims.values(list(dims.CHAPTERS.items()))}) SELECT id, coalesce(duty, 5) AS duty, '3' AS facility FROM v_strings LEFT JOIN dim ON key = regexp_replace(hs, '[^0-9]', '', 'g')[1:2]")
def tariff_chapter(spark, d) -> DataFrame:
    return lookup.tariff_by_chapter(view(spark, d, "v_strings"), "hs").select("id", "duty", "facility")


_T = f"t(hs8, hs4, bm, ppn, pph, ord) AS (VALUES {dims.values(dims.tariff_rows())})"
_CODE = "CASE WHEN l_partkey % 3 = 0 THEN 84671900 WHEN l_partkey % 3 = 1 THEN 84130000 + l_partkey ELSE 10000000 + l_partkey END"


@query(
    f"""WITH {_T}, near AS (SELECT hs4, arg_min(bm, ord) AS bm, arg_min(ppn, ord) AS ppn, arg_min(pph, ord) AS pph FROM t GROUP BY hs4), c AS (SELECT l_orderkey, l_linenumber, {_CODE} AS code FROM lineitem)
 SELECT l_orderkey, l_linenumber, coalesce(t.bm, near.bm, 0) AS bm, coalesce(t.ppn, near.ppn, 12) AS ppn, coalesce(t.pph, near.pph, 2.5) AS pph, t.hs8 IS NOT NULL AS found FROM c LEFT JOIN t ON t.hs8 = code LEFT JOIN near ON near.hs4 = code // 10000"""
)
def tariff_prefix(spark, d) -> DataFrame:
    return lookup.tariff_by_prefix(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CODE).cast("bigint").alias("code")), F.col("code")).drop("code")


# candidates, merging, totals ---------------------------------------------------------------------------------------------

_BEST = "row_number() OVER (PARTITION BY {k} ORDER BY confidence DESC, ord)"


@query(f"{CAND} SELECT doc_id, label, value, confidence FROM (SELECT *, {_BEST.format(k='doc_id, label')} AS r FROM v_candidates) WHERE r = 1")
def best_candidate(spark, d) -> DataFrame:
    return documents.best(view(spark, d, "v_candidates"), "doc_id", "label").select("doc_id", "label", "value", "confidence")


_HS_OK = "(regexp_matches(p, '^[0-9]{6,13}$') AND p[1:2] BETWEEN '01' AND '97')"


@query(
    f"""{CAND}, held AS (SELECT *, layer = 'layout' AND label = 'currency' AS money FROM v_candidates WHERE value <> ''),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, layer ORDER BY (money AND regexp_matches(upper(trim(value)), '^(USD|CNY|EUR|GBP|JPY|SGD|IDR|AUD|KRW)$'))::INT DESC, confidence DESC, ord) AS r FROM held),
 top AS (SELECT * REPLACE (CASE WHEN money AND NOT regexp_matches(upper(trim(value)), '^[A-Z]{{3}}$') AND regexp_matches(value, '^(USD|CNY|EUR|GBP|JPY|SGD|IDR|AUD|KRW)[0-9,.]+') THEN value[1:3] ELSE value END AS value) FROM ranked WHERE r = 1),
 b AS (SELECT doc_id, label, max(value) FILTER (layer = 'layout') AS l, max(confidence) FILTER (layer = 'layout') AS lc, max(value) FILTER (layer = 'pattern') AS p, max(confidence) FILTER (layer = 'pattern') AS pc FROM top GROUP BY doc_id, label),
 w AS (SELECT *, CASE WHEN l IS NULL THEN 'p' WHEN p IS NULL THEN CASE WHEN label <> 'incoterms' OR upper(trim(l)) IN ('{"', '".join(dims.INCOTERMS)}') THEN 'l' END WHEN label = 'item_code' THEN 'l' WHEN label = 'item_hs_code' THEN CASE WHEN {_HS_OK} THEN 'h' ELSE 'l' END WHEN label = 'container_number' THEN CASE WHEN regexp_matches(p, '^[A-Z]{{4}}[0-9]{{7}}$') THEN 'c' ELSE 'l' END WHEN label IN ('incoterms', 'total_amount') THEN 'p' WHEN lc >= pc THEN 'l' ELSE 'p' END AS side FROM b)
 SELECT doc_id, label, CASE side WHEN 'l' THEN l WHEN 'h' THEN p[1:4] || '.' || p[5:6] || CASE WHEN length(p) >= 8 THEN '.' || p[7:8] ELSE '' END ELSE p END AS value, CASE side WHEN 'l' THEN lc WHEN 'h' THEN 0.95::DOUBLE WHEN 'c' THEN 0.98::DOUBLE ELSE pc END AS confidence FROM w WHERE side IS NOT NULL"""
)
def arbitrate(spark, d) -> DataFrame:
    return documents.arbitrate(view(spark, d, "v_candidates"))


@query(
    f"""{CAND}, top AS (SELECT * FROM (SELECT *, {_BEST.format(k='doc_id, label, doc_type')} AS r FROM v_candidates WHERE value <> '') WHERE r = 1)
 SELECT doc_id, label, coalesce(max(value) FILTER (doc_type = 'CI'), max(value) FILTER (doc_type = 'BL'), max(value) FILTER (doc_type = 'PL')) AS value FROM top GROUP BY doc_id, label"""
)
def merge_priority(spark, d) -> DataFrame:
    return documents.merge_by_priority(view(spark, d, "v_candidates"), ("CI", "BL", "PL"))


_SUM = lambda c: f"coalesce(sum(TRY_CAST(CASE WHEN regexp_matches({c}, {_NUM}) THEN {c} END AS DOUBLE)), 0) AS sum_{c}"


@query(f"{ITEM} SELECT doc_id, {', '.join(map(_SUM, ('quantity', 'amount', 'net', 'gross')))}, count(*) AS n_items FROM v_items GROUP BY doc_id")
def totals(spark, d) -> DataFrame:
    return documents.reconciled_totals(view(spark, d, "v_items"))


@query(
    f"""{ITEM}, s AS (SELECT doc_id, {', '.join(map(_SUM, ('amount', 'quantity')))}, count(*) AS n FROM v_items GROUP BY doc_id), h AS (SELECT o_orderkey AS doc_id, o_totalprice AS total FROM orders)
 SELECT doc_id, round(CASE WHEN total IS NULL OR abs(total - sum_amount) > 0.25 * sum_amount THEN sum_amount ELSE total END, 4) AS total, abs(total - sum_amount) > 0.25 * sum_amount AS replaced FROM h JOIN s USING (doc_id)"""
)
def totals_reconcile(spark, d) -> DataFrame:
    s = documents.reconciled_totals(view(spark, d, "v_items"))
    h = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("total"))
    off = F.abs(F.col("total") - F.col("sum_amount")) > 0.25 * F.col("sum_amount")
    return h.join(s, "doc_id").select("doc_id", F.round(F.when(F.col("total").isNull() | off, F.col("sum_amount")).otherwise(F.col("total")), 4).alias("total"), off.alias("replaced"))


@query(
    f"""{ITEM}, n AS (SELECT *, TRY_CAST(quantity AS DOUBLE) AS q, TRY_CAST(price AS DOUBLE) AS p, TRY_CAST(nullif(amount, '') AS DOUBLE) AS a FROM v_items), r AS (SELECT *, CASE WHEN q > 0 AND p > 0 AND a > 0 THEN abs(a - q * p) / (q * p) END AS x FROM n),
 f AS (SELECT *, CASE WHEN x <= 0.05 THEN 'valid' WHEN x <= 0.2 THEN 'warning' WHEN x IS NOT NULL THEN 'critical' ELSE 'none' END AS flag, 0.4::DOUBLE + 0.07::DOUBLE * (4 + (quantity IS NOT NULL)::INT + (amount <> '')::INT + (hs_code <> '')::INT + (dimensions IS NOT NULL)::INT) AS s FROM r)
 SELECT doc_id, ord, round_even(x, 6) AS ratio, flag, round_even(CASE flag WHEN 'valid' THEN least(s * 1.15::DOUBLE, 1) WHEN 'warning' THEN s * 0.95::DOUBLE WHEN 'critical' THEN s * 0.70::DOUBLE ELSE s END, 6) AS confidence FROM f"""
)
def price_check(spark, d) -> DataFrame:
    return documents.price_check(view(spark, d, "v_items")).select("doc_id", "ord", "ratio", "flag", "confidence")


# lines, spans, scores -------------------------------------------------------------------------------------------------------


@query(f"{WORD} SELECT doc_id, round_even(y1 / 10, 0) * 10 AS line, string_agg(text, ' ' ORDER BY x1, round_even(y1 / 15, 0), pos) AS text, round_even(avg(conf), 6) AS conf, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM v_words GROUP BY doc_id, round_even(y1 / 10, 0) * 10")
def ocr_lines(spark, d) -> DataFrame:
    return documents.lines(view(spark, d, "v_words"))


@query(f"{WORD} SELECT doc_id, pos, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS session FROM (SELECT doc_id, pos, CASE WHEN abs(y1 - lag(y1) OVER (PARTITION BY doc_id ORDER BY pos)) < 5 THEN 0 ELSE 1 END AS n FROM v_words)")
def line_sessions(spark, d) -> DataFrame:
    return documents.sessions(view(spark, d, "v_words")).select("doc_id", "pos", "session")


@query(
    f"""{WORD.replace('WITH ', 'WITH RECURSIVE ')}, o AS (SELECT doc_id, pos, y1, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM v_words), g AS (SELECT doc_id, pos, y1 AS at, i, 1 AS grp FROM o WHERE i = 1
 UNION ALL SELECT o.doc_id, o.pos, CASE WHEN abs(o.y1 - g.at) > 10 THEN o.y1 ELSE g.at END, o.i, g.grp + (abs(o.y1 - g.at) > 10)::INT FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1) SELECT doc_id, pos, grp FROM g"""
)
def anchored_merge(spark, d) -> DataFrame:
    return documents.anchored(view(spark, d, "v_words"))


@query(
    f"""{WORD}, p AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM v_words), s AS (SELECT doc_id, unnest(range(0, n, 2)) AS start FROM (SELECT DISTINCT doc_id, n FROM p))
 SELECT doc_id, start, count(*) AS n_words, arg_min(text, i) AS first_text, arg_max(text, i) AS last_text FROM s JOIN p USING (doc_id) WHERE i >= start AND i < start + 4 GROUP BY doc_id, start"""
)
def token_windows(spark, d) -> DataFrame:
    return documents.token_windows(view(spark, d, "v_words"), 4, 2)


@query(f"{WORD} SELECT doc_id, pos, x2 - x1 AS width, y2 - y1 AS height, CAST(greatest(0, least(1000, floor(x1 / 840 * 1000))) AS INT) AS nx, CAST(greatest(0, least(1000, floor(y1 / 64 * 1000))) AS INT) AS ny FROM v_words WHERE x1 < 500 AND x2 > 100 AND y1 < 40 AND y2 > 10")
def region_words(spark, d) -> DataFrame:
    w = view(spark, d, "v_words").where("x1 < 500 and x2 > 100 and y1 < 40 and y2 > 10")
    scale = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(F.col(c) / size * 1000))).cast("int")
    return w.select("doc_id", "pos", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), scale("x1", 840).alias("nx"), scale("y1", 64).alias("ny"))


def _lenient(c: str) -> str:
    return f"""SELECT seq_id, t AS type, min(pos) AS start, max(pos) AS "end" FROM (SELECT *, sum(s) OVER (PARTITION BY seq_id ORDER BY pos) AS n FROM (SELECT *, CASE WHEN t IS NOT NULL AND (k = 'B' OR b IS NULL OR b <> t) THEN 1 ELSE 0 END AS s FROM (SELECT *, lag(t) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM (SELECT seq_id, pos, {c}[1] AS k, CASE WHEN {c} <> 'O' THEN {c}[3:] END AS t FROM v_tags)))) WHERE t IS NOT NULL GROUP BY seq_id, n, t"""


_STRICT = """SELECT seq_id, t AS type, min(pos) AS start, max(pos) AS "end" FROM (SELECT *, sum(s) OVER (PARTITION BY seq_id ORDER BY pos) AS n FROM (SELECT *, CASE WHEN t IS NOT NULL AND (k = 'B' OR b IS NULL OR b <> t) THEN 1 ELSE 0 END AS s FROM (SELECT *, lag(t) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM
 (SELECT seq_id, pos, k, CASE WHEN max((k = 'B')::INT) OVER (PARTITION BY seq_id, o ORDER BY pos) = 1 THEN t END AS t FROM (SELECT seq_id, pos, pred[1] AS k, CASE WHEN pred <> 'O' THEN pred[3:] END AS t, sum((pred = 'O')::INT) OVER (PARTITION BY seq_id ORDER BY pos) AS o FROM v_tags))))) WHERE t IS NOT NULL GROUP BY seq_id, n, t"""


@query(f"{TAG} {_STRICT}")
def bio_decode(spark, d) -> DataFrame:
    return documents.bio_spans(view(spark, d, "v_tags", by="seq_id"), "pred", False).select("seq_id", "type", "start", "end")


@query(
    f"""{TAG}, g AS ({_lenient('gold')}), p AS ({_lenient('pred')}), n AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM g) AS n_gold, (SELECT round_even(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) FROM (SELECT bool_or(pred <> 'O') AS hit FROM v_tags GROUP BY seq_id)) AS with_prediction),
 s AS (SELECT *, tp::DOUBLE / greatest(n_pred, 1) AS a, tp::DOUBLE / greatest(n_gold, 1) AS b FROM n) SELECT tp, n_pred, n_gold, with_prediction, round_even(100 * a, 2) AS precision, round_even(100 * b, 2) AS recall, round_even(100 * 2 * a * b / greatest(a + b, 1e-8), 2) AS f1 FROM s"""
)
def chunk_prf(spark, d) -> DataFrame:
    return documents.chunk_scores(view(spark, d, "v_tags", by="seq_id"))


@query(
    f"""{TAG}, c AS (SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT gold AS class, (gold = pred)::INT AS tp, 0 AS fp, (gold <> pred)::INT AS fn FROM v_tags UNION ALL SELECT pred, 0, (gold <> pred)::INT, 0 FROM v_tags) WHERE class <> 'O' GROUP BY class),
 s AS (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS a, tp::DOUBLE / greatest(tp + fn, 1) AS b FROM c) SELECT class, tp, fp, fn, round_even(a, 4) AS precision, round_even(b, 4) AS recall, round_even(2 * a * b / greatest(a + b, 1e-8), 4) AS f1 FROM s"""
)
def token_prf(spark, d) -> DataFrame:
    return documents.confusion(view(spark, d, "v_tags"))


_PRF = f"""{TAG}, c AS (SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT gold AS class, (gold = pred)::INT AS tp, 0 AS fp, (gold <> pred)::INT AS fn FROM v_tags UNION ALL SELECT pred, 0, (gold <> pred)::INT, 0 FROM v_tags) WHERE class <> 'O' GROUP BY class),
 s AS (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS a, tp::DOUBLE / greatest(tp + fn, 1) AS b FROM c) SELECT class, tp, fp, fn, round_even(a, 4) AS precision, round_even(b, 4) AS recall, round_even(2 * a * b / greatest(a + b, 1e-8), 4) AS f1 FROM s"""


@query(f"SELECT *, row_number() OVER (ORDER BY f1 DESC, class) AS place FROM ({_PRF}) WHERE tp + fp + fn > 0")
def metrics_report(spark, d) -> DataFrame:
    return documents.metrics_report(documents.confusion(view(spark, d, "v_tags")))


@query(
    f"""{TAG}, o AS (SELECT *, count(*) FILTER (gold = 'O') OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM v_tags), k AS (SELECT *, bool_or(gold[1] = 'B') OVER (PARTITION BY seq_id, run ORDER BY pos) AS open FROM o), e AS (SELECT seq_id, pos, gold, gold[3:] AS t, lag(CASE WHEN gold <> 'O' AND open THEN gold[3:] END) OVER (PARTITION BY seq_id ORDER BY pos) AS b, gold <> 'O' AND open AS held FROM k),
 n AS (SELECT t AS entity, count(DISTINCT (seq_id, pos)) AS spans FROM e WHERE held AND (gold[1] = 'B' OR b IS NULL OR b <> t) GROUP BY t)
 SELECT entity, spans, row_number() OVER (ORDER BY spans DESC, entity) AS place, (SELECT count(DISTINCT seq_id) FROM v_tags) AS pages, (SELECT count(*) FROM v_tags) AS words, (SELECT count(*) FILTER (gold <> 'O') FROM v_tags) AS labelled, round_even((SELECT count(*) FILTER (gold <> 'O') FROM v_tags)::DOUBLE / (SELECT count(*) FROM v_tags), 6) AS coverage FROM n"""
)
def dataset_counts(spark, d) -> DataFrame:
    return documents.dataset_counts(view(spark, d, "v_tags", by="seq_id"))


@query(
    f"""{ITEM}, s AS (SELECT doc_id, {_SUM('quantity')} FROM v_items GROUP BY doc_id), h AS (SELECT o_orderkey AS doc_id, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '1,0' || lpad(CAST(o_custkey % 90 AS VARCHAR), 2, '0') ELSE CAST(o_custkey % 150 AS VARCHAR) END AS t FROM orders),
 m AS (SELECT *, TRY_CAST(replace(t, ',', '') AS DOUBLE) AS x FROM h LEFT JOIN s USING (doc_id)), f AS (SELECT *, coalesce(sum_quantity > 0, FALSE) AS pos, coalesce(abs(x - sum_quantity) > 0.25 * sum_quantity, FALSE) AS far FROM m)
 SELECT doc_id, CASE WHEN pos AND (t = '' OR x IS NULL OR far) THEN CAST(CAST(floor(sum_quantity) AS BIGINT) AS VARCHAR) ELSE t END AS total_quantity,
 CASE WHEN pos AND far THEN 'total ' || CAST(x AS BIGINT) || ' against items ' || CAST(sum_quantity AS BIGINT) || ', difference ' || CAST(abs(x - sum_quantity) AS BIGINT) END AS note FROM f"""
)
def header_totals(spark, d) -> DataFrame:
    k = F.col("o_custkey")
    total = F.when(k % 4 == 0, "").when(k % 4 == 1, "n/a").when(k % 4 == 2, F.concat(F.lit("1,0"), F.lpad((k % 90).cast("string"), 2, "0"))).otherwise((k % 150).cast("string"))
    headers = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), total.alias("total_quantity"))
    return documents.reconciled_header(headers, documents.reconciled_totals(view(spark, d, "v_items")))


@query(f"{TAG} SELECT gold AS label, count(*) AS n, round_even(count(*)::DOUBLE / (SELECT count(*) FROM v_tags), 6) AS share FROM v_tags GROUP BY gold")
def label_dist(spark, d) -> DataFrame:
    counts = view(spark, d, "v_tags").groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("n"))
    return counts.select("label", "n", F.bround(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6).alias("share"))  # a row a label


@query(f"{TAG} SELECT count(DISTINCT seq_id) AS n_seqs, count(*) AS n_words, count(*) FILTER (gold <> 'O') AS n_labelled, round_even(count(*) FILTER (gold <> 'O')::DOUBLE / count(*), 6) AS coverage FROM v_tags")
def dataset_summary(spark, d) -> DataFrame:
    labelled = F.count_if(F.col("gold") != "O")
    return view(spark, d, "v_tags").agg(F.count_distinct("seq_id").alias("n_seqs"), F.count("*").alias("n_words"), labelled.alias("n_labelled"), F.bround(labelled / F.count("*"), 6).alias("coverage"))


# rows of declaration sheets ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_T}, near AS (SELECT hs4, arg_min(bm, ord) AS bm, arg_min(ppn, ord) AS ppn, arg_min(pph, ord) AS pph FROM t GROUP BY hs4), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CODE} AS code FROM lineitem),
 r AS (SELECT c.*, coalesce(t.bm, near.bm, 0) AS bm, coalesce(t.ppn, near.ppn, 12) AS ppn, coalesce(t.pph, near.pph, 2.5) AS pph FROM c LEFT JOIN t ON t.hs8 = code LEFT JOIN near ON near.hs4 = code // 10000)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['BM', 'PPH', 'PPN']) AS kind, unnest([bm, CASE WHEN l_suppkey % 2 = 0 THEN pph ELSE 0 END, ppn]) AS rate FROM r"""
)
def rates_unpivot(spark, d) -> DataFrame:
    """The rates of each goods row as rows; without a certificate its income tax is 0."""
    goods = load(spark, d, "lineitem")
    rated = lookup.tariff_by_prefix(goods.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.expr(_CODE))
    return lookup.rate_rows(rated, F.col("l_suppkey") % 2 == 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", "rate")


_PARTY = """SELECT o_orderkey AS id, 'Seller ' || o_custkey % 7 AS seller, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE ' Buyer ' || o_custkey % 5 END AS buyer, CASE WHEN o_custkey % 3 = 0 THEN 'Seller ' || o_custkey % 7 ELSE 'Shipper ' || o_custkey END AS shipper,
 CASE WHEN o_custkey % 4 = 0 THEN ' Buyer ' || o_custkey % 5 WHEN o_custkey % 4 = 1 THEN '' ELSE 'Consignee ' || o_custkey END AS consignee, CASE WHEN o_custkey % 6 = 0 THEN 'Notify ' || o_custkey ELSE '' END AS notify FROM orders"""


@query(
    f"""WITH p AS ({_PARTY}), r AS (SELECT id, 1 AS k, 9 AS code, seller AS name FROM p UNION ALL SELECT id, 2, 10, seller FROM p UNION ALL SELECT id, 3, 1, buyer FROM p UNION ALL SELECT id, 4, 7, shipper FROM p WHERE shipper <> seller
 UNION ALL SELECT id, 5, 4, CASE WHEN notify <> '' THEN notify ELSE consignee END FROM p UNION ALL SELECT id, 6, 11, consignee FROM p WHERE consignee <> buyer) SELECT id, CAST(k AS BIGINT) AS row_order, CAST(code AS VARCHAR) AS code, trim(name) AS name FROM r WHERE name <> ''"""
)
def party_rows(spark, d) -> DataFrame:
    p = load(spark, d, "orders").selectExpr(*[c.strip() for c in ("o_orderkey AS id", *documents.PARTY_VIEW)])
    return documents.parties(p)


@query(f"{ITEM}, w AS (SELECT item_code, max_by(net, [doc_id, ord]) AS net_kg FROM v_items WHERE net <> 'n/a' GROUP BY item_code) SELECT doc_id, ord, item_code, coalesce(nullif(net, 'n/a'), net_kg) AS net FROM v_items LEFT JOIN w USING (item_code)")
def weights_merge(spark, d) -> DataFrame:
    items = view(spark, d, "v_items")
    weights = items.where("net <> 'n/a'").groupBy("item_code").agg(F.max(F.struct("doc_id", "ord", "net"))["net"].alias("net_kg"))
    return items.join(weights, "item_code", "left").select("doc_id", "ord", "item_code", F.coalesce(F.nullif("net", F.lit("n/a")), "net_kg").alias("net"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day(spark, d) -> DataFrame:
    e = load(spark, d, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("bigint"))
    return e.groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_items(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
