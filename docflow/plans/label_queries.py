"""Queries of labels and normal forms of single values, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import labels as L
from ..sources.views import sql, view
from .registry import query

STR = sql("v_strings")
_q = lambda s: "'" + s.replace("'", "''") + "'"
_in = lambda values: "(" + ", ".join(map(_q, values)) + ")"

#: Column of v_strings or text -> its name among the values.
_SAID = {
    "box": "box", "hs": "hs", "day": "day", "money": "money", "port": "port", "country": "country", "party": "party", "term": "term", "pack": "pack",
    "ship": "CASE id % 9 WHEN 0 THEN 'Vessel name: EVER GIVEN' WHEN 1 THEN 'VESSEL NAME' WHEN 2 THEN '9 CHINA' WHEN 3 THEN ' 5 Feb 2026' WHEN 4 THEN 'Vessel Name 12' WHEN 5 THEN 'vessel name: 7 Sea' WHEN 6 THEN 'INVOICE - AB12' WHEN 7 THEN 'x' ELSE 'VESSEL NAME: 5 CO' END",
}
_ROWS = " UNION ALL ".join(f"SELECT id, {_q(k)} AS said, {v} AS v0, CASE id % 4 WHEN 0 THEN 'CI' WHEN 1 THEN 'BL' WHEN 2 THEN 'PL' ELSE 'CO' END AS doc_type FROM v_strings" for k, v in _SAID.items())
_DAY = "CASE WHEN doc_type IN ('CI', 'PL') THEN 'invoice_date' ELSE 'bl_date' END"
_m = lambda pattern: f"regexp_matches(v, {_q(pattern)})"
_COMPANY = f"length(v) > 5 AND NOT {_m('^[0-9]')} AND NOT {_m('[0-9]{4,}')} AND {_m('[A-Z]{3,}')} AND NOT {_m(L.NO_COMPANY)}"
_RULES = (
    ("length(v) < 2", "NULL", "NULL", "NULL"), (_m(L.ISO_DAY), _DAY, "v", 0.95),
    (_m(L.DAY), _DAY, f"regexp_extract(v, {_q(L.DAY)}, 3) || '-' || lpad(regexp_extract(v, {_q(L.DAY)}, 2), 2, '0') || '-' || lpad(regexp_extract(v, {_q(L.DAY)}, 1), 2, '0')", 0.90), (_m(L.NAMED_DAY), _DAY, "v", 0.85),
    ("regexp_matches(hs, '^[0-9]{8,10}$') AND hs[1:2] BETWEEN '01' AND '97'", "'item_hs_code'", "hs", 0.95), (_m(L.CONTAINER), "'container_number'", "v", 0.98), (_m(L.BILL), "'bl_number'", "v", 0.95),
    (f"doc_type IN ('CI', 'PL') AND {_m(L.INVOICE)}", "'invoice_number'", "v", 0.90), (_m(L.CURRENCY), "'currency'", f"upper(regexp_extract(v, {_q(L.CURRENCY)}, 1))", 0.98),
    (_m(L.TERM), "'incoterms'", f"upper(regexp_extract(v, {_q(L.TERM)}, 1))", 0.98), ("length(ship) > 2 AND NOT regexp_matches(ship, '^[0-9]')", "'vessel_name'", "ship", 0.85),
    (_m(L.COUNTRY), "'country_of_origin'", f"upper(regexp_extract(v, {_q(L.COUNTRY)}, 1))", 0.95), (f"{_m(L.PORT)} AND length(v) > 3", "'port_of_loading'", "v", 0.75),
    (f"{_COMPANY} AND doc_type = 'BL'", "'shipper_name'", "v", 0.75), (_COMPANY, "'seller_name'", "v", 0.70),
)
_case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in _RULES) + " END"


@query(
    f"""{STR}, r AS ({_ROWS}), s AS (SELECT id, said, doc_type, trim(v0) AS v, regexp_replace(trim(v0), '[., ]', '', 'g') AS hs, trim(regexp_replace(trim(v0), {_q(L.VESSEL_HEAD)}, '')) AS ship FROM r)
 SELECT id, said, {_case(1)} AS label, {_case(2)} AS value, CAST({_case(3)} AS DOUBLE) AS confidence FROM s"""
)
def value_labels(spark, d) -> DataFrame:
    rows = view(spark, d, "v_strings")
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("said"), F.expr(v).alias("value")) for k, v in _SAID.items()])).alias("s")
    doc_type = F.expr("CASE id % 4 WHEN 0 THEN 'CI' WHEN 1 THEN 'BL' WHEN 2 THEN 'PL' ELSE 'CO' END")
    return rows.select("id", said).select("id", "s.said", L.classified(F.col("s.value"), doc_type).alias("r")).select("id", "said", "r.label", "r.value", "r.confidence")


#: Label -> the text that carries it here.
_LABELLED = {
    "invoice_number": "box", "bl_number": "box", "container_number": "box", "currency": "money", "incoterms": "term", "country_of_origin": "country", "country_of_destination": "port", "port_of_loading": "port",
    "port_of_discharge": "country", "unit": "unit", "item_unit": "pack", "packaging_type": "pack", "remark": "party", "hs_code": "hs", "item_amount": "amount",
    "net_weight": "CASE id % 7 WHEN 0 THEN '1.234,5 KGS' WHEN 1 THEN '12 MT' WHEN 2 THEN 'two tons' WHEN 3 THEN '' WHEN 4 THEN ' 1,500.25 lb' WHEN 5 THEN '0.75 TON' ELSE CAST(id AS VARCHAR(20)) END",
}
_PLAIN = "regexp_matches({0}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')"


def _read(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})*,[0-9]{{1,2}}$') THEN replace(replace({c}, '.', ''), ',', '.') WHEN regexp_matches({c}, '^[0-9]{{1,3}}(,[0-9]{{3}})*\\.[0-9]{{1,2}}$') THEN replace({c}, ',', '') ELSE regexp_replace({c}, '[\\s,]', '', 'g') END"


def _dim(name: str, dim: dict[str, str]) -> str:
    return f"{name}(name, code, ord) AS (VALUES {dims.values([(k, v, i) for i, (k, v) in enumerate(dim.items())])})"


_near = lambda t: f"(SELECT arg_min(code, ord) FROM {t} WHERE contains(u, name) OR contains(name, u))"
_ONE = lambda t, s, m: f"struct_pack(text := {t}, confidence := CAST({s} AS DOUBLE), method := '{m}')"


@query(
    f"""{STR}, {_dim("ports", dims.NORMAL_PORTS)}, {_dim("countries", dims.NORMAL_COUNTRIES)}, {_dim("units", dims.NORMAL_UNITS)}, {_dim("packs", dims.NORMAL_PACKAGING)},
 r AS ({" UNION ALL ".join(f"SELECT id, {_q(k)} AS label, coalesce(trim({v}), '') AS s FROM v_strings" for k, v in _LABELLED.items())}),
 a AS (SELECT *, upper(s) AS u, regexp_replace(upper(s), '[\\s\\-]', '', 'g') AS box, regexp_replace(s, '[.\\s]', '', 'g') AS c, {_read("s")} AS n, trim(regexp_replace(s, '(?i)\\s*(KGS?|KG|LBS?|LB|MT|TONS?)\\s*$', '')) AS ws, {_read("ws")} AS wn FROM r),
 b AS (SELECT *, {_near("ports")} AS port, {_near("countries")} AS country, (SELECT min(code) FROM units WHERE name = u) AS unit, (SELECT min(code) FROM packs WHERE name = u) AS pack FROM a),
 f AS (SELECT id, label, CASE WHEN s = '' THEN {_ONE("''", 0, "empty")} WHEN label = 'invoice_number' THEN {_ONE("u", 0.5, "as_is")} WHEN label = 'bl_number' THEN {_ONE("u", 0.8, "cleaned")}
 WHEN label = 'container_number' THEN CASE WHEN regexp_matches(box, '{L.CONTAINER}') THEN {_ONE("box", 1, "parsed")} ELSE {_ONE("box", 0, "invalid")} END
 WHEN label = 'currency' AND u IN {_in(dims.CURRENCY_CODES)} OR label = 'incoterms' AND u IN {_in(dims.NORMAL_TERMS)} THEN {_ONE("u", 1, "exact")} WHEN label IN ('currency', 'incoterms') THEN {_ONE("u", 0.5, "inferred")}
 WHEN label LIKE 'country%' THEN CASE WHEN regexp_matches(u, '^\\pL\\pL$') THEN {_ONE("u", 1, "exact")} WHEN country IS NOT NULL THEN {_ONE("country", 0.95, "mapped")} ELSE {_ONE("u", 0.3, "inferred")} END
 WHEN label LIKE 'port%' THEN CASE WHEN u IN (SELECT code FROM ports) THEN {_ONE("u", 1, "exact")} WHEN port IS NOT NULL THEN {_ONE("port", 0.9, "mapped")} ELSE {_ONE("u", 0.5, "inferred")} END
 WHEN label IN ('unit', 'item_unit') THEN CASE WHEN unit IS NOT NULL THEN {_ONE("unit", 1, "mapped")} ELSE {_ONE("u", 0.5, "inferred")} END WHEN label = 'packaging_type' THEN CASE WHEN pack IS NOT NULL THEN {_ONE("pack", 1, "mapped")} ELSE {_ONE("u", 0.5, "inferred")} END
 WHEN label = 'hs_code' THEN CASE WHEN NOT regexp_matches(c, '^[0-9]{{6,13}}$') THEN {_ONE("s", 0, "invalid")} WHEN c[1:2] NOT BETWEEN '01' AND '97' THEN {_ONE("s", 0, "invalid_chapter")} WHEN length(c) = 7 THEN {_ONE("c", 1, "parsed")} ELSE {_ONE("c[1:4] || '.' || c[5:6] || CASE WHEN length(c) >= 8 THEN '.' || c[7:8] ELSE '' END", 1, "parsed")} END
 WHEN label = 'item_amount' THEN CASE WHEN {_PLAIN.format("n")} THEN {_ONE("n", 1, "parsed")} ELSE {_ONE("s", 0, "invalid")} END
 WHEN label = 'net_weight' THEN CASE WHEN {_PLAIN.format("wn")} THEN {_ONE("regexp_replace(regexp_replace(CAST(CAST(TRY_CAST(wn AS DECIMAL(24, 6)) * CASE WHEN contains(lower(s), 'mt') OR contains(lower(s), 'ton') THEN 1000 ELSE 1 END AS DECIMAL(30, 6)) AS VARCHAR), '0+$', ''), '\\.$', '.0')", 1, "parsed")} ELSE {_ONE("ws", 0, "invalid")} END
 ELSE {_ONE("s", 0.5, "cleaned")} END AS r FROM b)
 SELECT id, label, r.text AS text, r.confidence AS confidence, r.method AS method FROM f"""
)
def values_normalised(spark, d) -> DataFrame:
    rows = view(spark, d, "v_strings")
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.expr(v).alias("value")) for k, v in _LABELLED.items()])).alias("s")
    return rows.select("id", said).select("id", "s.label", L.normalised(F.col("s.value"), F.col("s.label")).alias("r")).select("id", "label", "r.text", "r.confidence", "r.method")
