"""Queries of the rules over text, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..functions import values as V
from ..operators import analytics
from ..sources.views import load, sql, view
from .registry import query

TEXT, CODE, STR, SHIP, CAND = (sql(v) for v in ("v_texts", "v_codes", "v_strings", "v_shipments", "v_candidates"))
_q = lambda s: "'" + s.replace("'", "''") + "'"
_in = lambda names: "(" + ", ".join(map(_q, names)) + ")"


def _garbage(v: str, label: str | None = None) -> str:
    port = "FALSE" if label not in (None, "port_of_loading", "port_of_discharge") else f"CASE WHEN length({v}) < 3 THEN TRUE WHEN regexp_matches({v}, '^[A-Z]{{2}}[A-Z0-9]{{3}}$') THEN FALSE WHEN regexp_matches({v}, '^[A-Z]{{2}}') AND length({v}) >= 5 THEN FALSE ELSE contains({v}, ' ') AND NOT regexp_matches({v}, '^[A-Z]{{2}}[A-Z0-9]+$') END"
    return f"""CASE WHEN {v} = '' OR contains({v}, chr(10)) OR contains({v}, chr(13)) THEN TRUE WHEN length({v}) > 5 AND length(regexp_replace({v}, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length({v}) < 0.30 THEN TRUE
 WHEN upper({v}) IN {_in(dims.GARBAGE)} THEN TRUE ELSE {port} END"""


@query(f"{CODE} SELECT id, {_garbage('code')} AS as_port, {_garbage('code', 'currency')} AS as_other FROM v_codes")
def garbage_filter(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").select("id", T.is_garbage(F.col("code"), F.lit("port_of_loading")).alias("as_port"), T.is_garbage(F.col("code"), F.lit("currency")).alias("as_other"))


_ALL_WORDS = "|".join(w.replace(".", "\\.") for w in dims.NO_CODE_WORDS)


@query(
    f"""{CODE} SELECT id, code FROM v_codes WHERE length(code) >= 4 AND NOT regexp_matches(code, '^[0-9]+[Xx*][0-9]+([Xx*][0-9]+)+$') AND regexp_matches(code, '[0-9]') AND CASE WHEN regexp_matches(code, '\\p{{L}}') THEN NOT regexp_matches(code, '^[A-Z]{{3,4}}[0-9]{{6,9}}$')
 AND NOT regexp_matches(code, {_q('(?i)' + dims.NO_CODE)}) AND upper(code) NOT IN {_in(dims.NO_CODE_WORDS)} AND NOT (length(code) >= 6 AND regexp_matches(upper(code), '(^|[^A-Z0-9-])({_ALL_WORDS})($|[^A-Z0-9-])')) ELSE regexp_matches(code, '^[0-9]{{11,}}$') END"""
)
def item_code_filter(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").where(T.is_item_code(F.col("code"))).select("id", "code")


@query(
    f"""{CODE} SELECT id, code FROM v_codes WHERE length(code) >= 4 AND NOT regexp_matches(code, {_q('(?i)' + dims.NO_LIST_CODE)}) AND ({' OR '.join(f"upper(code) LIKE '{p}%'" for p in dims.LIST_CODES + dims.LIST_ID_CODES)} OR upper(code) NOT LIKE 'ID-%')"""
)
def list_code_filter(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").where(T.is_list_code(F.col("code"))).select("id", "code")


_SKIP = f"""(regexp_matches(line, '^[0-9\\s,.\\-+]+$') OR length(line) < 4 OR (length(line) > 10 AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(line) < 0.15) OR {' OR '.join(f"regexp_matches(lower(line), {_q('(?i)' + p)})" for p in dims.SKIPPED_LINES)})"""


@query(f"SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, trim(raw) AS line FROM (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE NOT {_SKIP}")
def text_lines(spark, d) -> DataFrame:
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return lines.where(~T.is_skipped_line(F.col("line"))).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(f"{CODE} SELECT id, line FROM (SELECT id, CASE id % 5 WHEN 0 THEN code ELSE label || ' ' || code END AS line FROM v_codes) WHERE NOT {_SKIP}")
def line_filter(spark, d) -> DataFrame:
    line = F.when(F.col("id") % 5 == 0, F.col("code")).otherwise(F.concat_ws(" ", "label", "code"))
    return view(spark, d, "v_codes").select("id", line.alias("line")).where(~T.is_skipped_line(F.col("line")))


# the pattern bank ----------------------------------------------------------------------------------------------------------


def _bank(label: str, ctes: list[str]) -> str:
    """SQL of the values of one field: a chain of steps, each of which takes the first value of its pattern that is new."""
    source = "v_texts"
    for k, (pattern, any_case) in enumerate(dims.ENTITY_PATTERNS[label]):
        group = 0 if pattern == r"\bCHINA\b" else 1
        all_found = f"[regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN regexp_extract_all(text, {_q('(?i)' * any_case + pattern)}, {group})]"
        seen = "".join(f" AND v IS DISTINCT FROM f{j}" for j in range(k))
        name = f"{label}_{k}"
        ctes.append(f"{name} AS (SELECT *, [v FOR v IN {all_found} IF length(v) BETWEEN 2 AND 100 AND NOT ({_garbage('v', label)}){seen}][1] AS f{k} FROM {source})")
        source = name
    n = len(dims.ENTITY_PATTERNS[label])
    return " UNION ALL ".join(f"SELECT id, '{label}' AS label, CAST({k} AS INT) AS ord, f{k} AS value FROM {source} WHERE f{k} IS NOT NULL" for k in range(n))


_STEPS: list[str] = []
_ROWS = " UNION ALL ".join(_bank(label, _STEPS) for label in dims.ENTITY_PATTERNS)
_BANK = f"{TEXT}, {', '.join(_STEPS)}, bank AS ({_ROWS})"


def bank(texts: DataFrame, *labels: str) -> DataFrame:
    """(id, label, ord, value, confidence) of the header fields that patterns find in each text."""
    fields = F.array(*[F.struct(F.lit(n).alias("label"), T.field_values(F.col("text"), n).alias("values")) for n in labels or dims.ENTITY_PATTERNS])
    rows = texts.select("id", F.inline(fields)).select("id", "label", F.posexplode("values").alias("ord", "value"))
    return rows.where("value is not null").withColumn("confidence", F.lit(0.7))


@query(f"{_BANK} SELECT *, 0.7::DOUBLE AS confidence FROM bank")
def regex_bank(spark, d) -> DataFrame:
    return bank(view(spark, d, "v_texts"))


_named = lambda inside: "coalesce(" + ", ".join(f"CASE WHEN contains(upper(text), '{k}') THEN '{v}' END" for k, v in dims.PORT_KEYWORDS.items() if (k in dims.DISCHARGE) == inside) + ")"


@query(
    f"""{_BANK} SELECT id, label, value, 0.9::DOUBLE AS confidence FROM (SELECT id, 'port_of_loading' AS label, {_named(False)} AS value FROM v_texts UNION ALL SELECT id, 'port_of_discharge', {_named(True)} FROM v_texts) n
 WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bank WHERE bank.id = n.id AND bank.label = n.label)"""
)
def port_keywords(spark, d) -> DataFrame:
    """Ports named in the text, on a side for which the patterns found none."""
    t, none = view(spark, d, "v_texts"), lambda label: ~F.exists(T.field_values(F.col("text"), label), lambda v: v.isNotNull())
    sides = [F.struct(F.lit(label).alias("label"), F.when(none(label), T.port_by_name(F.col("text"), inside)).alias("value")) for label, inside in (("port_of_loading", False), ("port_of_discharge", True))]
    return t.select("id", F.inline(F.array(*sides))).where("value is not null").withColumn("confidence", F.lit(0.9))


@query(
    f"""{_BANK} SELECT id, value, 0.85::DOUBLE AS confidence FROM (SELECT id, CASE WHEN contains(upper(text), 'USD/KG') OR contains(upper(text), 'USD /KG') THEN 'USD' ELSE nullif(regexp_extract(upper(text), '\\b(USD|CNY|EUR|GBP)\\s*/\\s*(?:KG|KILO|KILOS)\\b', 1), '') END AS value FROM v_texts) n
 WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bank WHERE bank.id = n.id AND label = 'currency')"""
)
def currency_fallback(spark, d) -> DataFrame:
    found = F.exists(T.field_values(F.col("text"), "currency"), lambda v: v.isNotNull())
    return view(spark, d, "v_texts").select("id", F.when(~found, T.unit_price_currency(F.col("text"))).alias("value"), F.lit(0.85).alias("confidence")).where("value is not null")


# codes, names, dates ---------------------------------------------------------------------------------------------------------


def _nested(column: str, pairs, flags: str = "'g'") -> str:
    for pattern, new in pairs:
        column = f"regexp_replace({column}, {_q(pattern)}, {_q(new)}, {flags})"
    return column


@query(f"{CODE} SELECT id, {_nested('code', [('(?i)' + p, n) for p, n in dims.CODE_FIXES])} AS code, trim(regexp_replace(regexp_replace(upper(line), '[.,;:]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM v_codes")
def code_repair(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").select("id", T.repaired_code(F.col("code")).alias("code"), T.match_text(F.col("line")).alias("plain"))


@query(f"{CAND} SELECT doc_id, ord, CASE label WHEN 'item_hs_code' THEN 0.95::DOUBLE ELSE 0.98::DOUBLE END AS confidence FROM v_candidates WHERE (label = 'item_hs_code' AND regexp_matches(value, '^[0-9]{{6,13}}$') AND value[1:2] BETWEEN '01' AND '97') OR (label = 'container_number' AND regexp_matches(value, '^[A-Z]{{4}}[0-9]{{7}}$'))")
def strict_format(spark, d) -> DataFrame:
    hs, box = (F.col("label") == "item_hs_code") & V.hs_formatted(F.col("value")).isNotNull(), (F.col("label") == "container_number") & F.col("value").rlike("^[A-Z]{4}[0-9]{7}$")
    return view(spark, d, "v_candidates").where(hs | box).select("doc_id", "ord", F.when(hs, 0.95).otherwise(0.98).alias("confidence"))


@query(f"{CODE} SELECT id, CASE WHEN length(s) >= 2 THEN s[1:200] ELSE '' END AS description FROM (SELECT id, trim({_nested('line', T.DESCRIPTION_CUTS)}) AS s FROM v_codes)")
def clean_descriptions(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").select("id", T.clean_description(F.col("line")).alias("description"))


@query(
    f"""{CODE} SELECT id, CASE WHEN regexp_matches(line, '(?i)Page\\s+[0-9]+\\s+of\\s+[0-9]+') OR regexp_matches(line, '(?i)HS\\s+CODE\\s*[:\\-]') THEN 'Layout 1' WHEN regexp_matches(line, '(?i)Electronic\\s+Certificate') THEN 'Layout 2'
 WHEN len(regexp_extract_all(line, '[0-9]{{6}}\\s+[A-Z]{{2}}\\b')) > 0 THEN 'Layout 2' ELSE 'Layout 1' END AS layout FROM v_codes"""
)
def certificate_layout(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").select("id", T.certificate_layout(F.col("line")).alias("layout"))


_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(path), {_q(p)})' for p in parts)} THEN '{kind}'" for kind, parts in dims.FILE_KINDS.items()) + " ELSE 'other' END"


@query(f"{CODE} SELECT id, {_KIND} AS kind, regexp_replace(path, '^.*[/\\\\]', '') AS name, regexp_replace(path, '[/\\\\]', '_', 'g') AS folder FROM v_codes")
def file_kinds(spark, d) -> DataFrame:
    path = F.col("path")
    return view(spark, d, "v_codes").select("id", T.file_kind(path).alias("kind"), T.base_name(path).alias("name"), F.regexp_replace(path, r"[/\\]", "_").alias("folder"))


@query(
    f"""{SHIP} SELECT id, CASE WHEN currency IN ('USD', 'EUR', 'SGD', 'AUD') THEN currency || ' ' || translate(format('{{:,.2f}}', total), ',.', '.,') WHEN currency = 'IDR' THEN 'Rp ' || translate(format('{{:,.0f}}', round_even(total, 0)), ',', '.') ELSE format('{{:,.2f}}', total) END AS amount,
 'CD-' || upper(substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS reference FROM v_shipments"""
)
def amount_format(spark, d) -> DataFrame:
    reference = F.concat(F.lit("CD-"), F.upper(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8)))
    return view(spark, d, "v_shipments").select("id", V.amount_formatted(F.col("total"), F.col("currency")).alias("amount"), reference.alias("reference"))


_DMY = "coalesce(try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d-%m-%Y'), CASE WHEN day LIKE '%/%' THEN try_strptime(day, '%Y/%m/%d') END, CASE WHEN day LIKE '%-%' THEN try_strptime(day, '%Y-%m-%d') END, try_strptime(day, '%d.%m.%Y'))"


@query(
    f"""{STR}, b AS (SELECT id, day, CASE id % 4 WHEN 0 THEN 'ABCD' || custkey || '567' WHEN 1 THEN 'no digits' ELSE '' END AS bill, CASE id % 3 WHEN 0 THEN 'INV-' || custkey WHEN 1 THEN 'none' ELSE NULL END AS invoice FROM v_strings),
 n AS (SELECT *, nullif(regexp_replace(bill, '[^0-9]', '', 'g'), '') AS nb, nullif(regexp_replace(invoice, '[^0-9]', '', 'g'), '') AS ni FROM b)
 SELECT id, CASE WHEN bill <> '' THEN 'BL' || right(coalesce(nb, bill), 6) WHEN ni IS NOT NULL THEN 'CI' || right(ni, 6) ELSE 'SHP' END || CASE WHEN day = '' THEN '' ELSE '-' || coalesce(strftime({_DMY}, '%m%d'), right(day, 4)) END AS shipment FROM n"""
)
def shipment_ids(spark, d) -> DataFrame:
    k = F.col("custkey").cast("string")
    bill = F.when(F.col("id") % 4 == 0, F.concat(F.lit("ABCD"), k, F.lit("567"))).when(F.col("id") % 4 == 1, "no digits").otherwise("")
    invoice = F.when(F.col("id") % 3 == 0, F.concat(F.lit("INV-"), k)).when(F.col("id") % 3 == 1, "none")
    return view(spark, d, "v_strings").select("id", T.shipment_id(bill, invoice, F.col("day")).alias("shipment"))


@query("SELECT o_orderkey AS id, '040300' || '20' || rpad(CAST(o_custkey AS VARCHAR)[1:6], 6, '0') || strftime(o_orderdate, '%Y%m%d') || '000001' AS number FROM orders")
def declaration_28(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.number_28(F.lit("040300"), "20", F.col("o_orderdate"), F.concat(F.lit("no "), F.col("o_custkey").cast("string"))).alias("number"))


_ISO = "strftime(coalesce(try_strptime(day, '%d %b %Y'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d-%m-%Y'), CASE WHEN day LIKE '%-%' THEN try_strptime(day, '%Y-%m-%d') END, try_strptime(day, '%d.%m.%Y'), try_strptime(day, '%b %d, %Y'), CASE WHEN regexp_matches(day, '^[0-9]{8}$') THEN try_strptime(day, '%Y%m%d') END), '%Y-%m-%d')"
_PIECES = """CASE WHEN regexp_matches(day, '([0-9]{1,2})[\\s\\-/.]([0-9]{1,2})[\\s\\-/.]([0-9]{4})') THEN regexp_extract(day, '([0-9]{1,2})[\\s\\-/.]([0-9]{1,2})[\\s\\-/.]([0-9]{4})', 3) || '-' || lpad(regexp_extract(day, '([0-9]{1,2})[\\s\\-/.]([0-9]{1,2})[\\s\\-/.]([0-9]{4})', 2), 2, '0') || '-' || lpad(regexp_extract(day, '([0-9]{1,2})[\\s\\-/.]([0-9]{1,2})[\\s\\-/.]([0-9]{4})', 1), 2, '0') END"""
_DAYS = "SELECT id, CASE WHEN id % 16 = 7 THEN '05 Jan ' || (2000 + custkey % 26) WHEN id % 16 = 15 THEN 'Jan 5, 2026' ELSE day END AS day FROM v_strings"


@query(
    f"""{STR}, s AS ({_DAYS}), r AS (SELECT id, day, {_ISO} AS e, {_PIECES} AS p FROM s) SELECT id, CASE WHEN day = '' THEN '' ELSE coalesce(e, p, day) END AS day, CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE WHEN p IS NOT NULL THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
 CASE WHEN day = '' THEN 'empty' WHEN e IS NOT NULL THEN 'parsed' WHEN p IS NOT NULL THEN 'inferred' ELSE 'unparsed' END AS method FROM r"""
)
def iso_dates(spark, d) -> DataFrame:
    return _days(view(spark, d, "v_strings")).select("id", T.iso_date(F.col("day")).alias("r")).select("id", "r.*")


def _days(strings: DataFrame) -> DataFrame:
    day = F.when(F.col("id") % 16 == 7, F.concat(F.lit("05 Jan "), (2000 + F.col("custkey") % 26).cast("string"))).when(F.col("id") % 16 == 15, "Jan 5, 2026").otherwise(F.col("day"))
    return strings.select("id", day.alias("day"))


@query(
    f"""{STR}, s AS ({_DAYS}) SELECT id, strftime(coalesce(CASE WHEN day LIKE '%-%' THEN try_strptime(day, '%Y-%m-%d') END, try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d-%m-%Y'), try_strptime(day, '%b %d, %Y'), try_strptime(day, '%d %b %Y')), '%Y-%m-%d') AS mapped,
 strftime(coalesce(CASE WHEN day LIKE '%-%' THEN try_strptime(day, '%Y-%m-%d') END, try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d-%m-%Y'), CASE WHEN regexp_matches(day, '^[0-9]{{8}}$') THEN try_strptime(day, '%Y%m%d') END, try_strptime(day, '%d.%m.%Y')), '%Y%m%d') AS numbered FROM s"""
)
def other_dates(spark, d) -> DataFrame:
    day = F.col("day")
    return _days(view(spark, d, "v_strings")).select("id", F.date_format(T.date_by(day, T.MAPPER_PATTERNS), "yyyy-MM-dd").alias("mapped"), F.date_format(T.date_by(day, T.NUMBER_PATTERNS), "yyyyMMdd").alias("numbered"))


@query(
    f"""{CODE} SELECT id, CASE WHEN regexp_matches(n, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN n::DOUBLE * CASE WHEN contains(lower(weight), 'mt') OR contains(lower(weight), 'ton') THEN 1000 ELSE 1 END END AS kg FROM (SELECT id, weight, CASE WHEN regexp_matches(s, '^[0-9]{{1,3}}(\\.[0-9]{{3}})*,[0-9]{{1,2}}$') THEN replace(replace(s, '.', ''), ',', '.')
 WHEN regexp_matches(s, '^[0-9]{{1,3}}(,[0-9]{{3}})*\\.[0-9]{{1,2}}$') THEN replace(s, ',', '') ELSE regexp_replace(s, '[\\s,]', '', 'g') END AS n FROM (SELECT id, weight, regexp_replace(trim(weight), '(?i)\\s*(KGS?|KG|LBS?|LB|MT|TONS?)\\s*$', '') AS s FROM v_codes))"""
)
def weight_normalise(spark, d) -> DataFrame:
    return view(spark, d, "v_codes").select("id", T.normalised_weight(F.col("weight")).alias("kg"))


@query(
    f"""{STR}, s AS (SELECT id, trim(hs) AS t, regexp_replace(trim(hs), '[.\\s]', '', 'g') AS c FROM v_strings) SELECT id, CASE WHEN NOT regexp_matches(c, '^[0-9]{{6,13}}$') OR c[1:2] NOT BETWEEN '01' AND '97' THEN t WHEN length(c) = 7 THEN c ELSE c[1:4] || '.' || c[5:6] || CASE WHEN length(c) >= 8 THEN '.' || c[7:8] ELSE '' END END AS text,
 CASE WHEN regexp_matches(c, '^[0-9]{{6,13}}$') AND c[1:2] BETWEEN '01' AND '97' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN t = '' THEN 'empty' WHEN NOT regexp_matches(c, '^[0-9]{{6,13}}$') THEN 'invalid' WHEN c[1:2] NOT BETWEEN '01' AND '97' THEN 'invalid_chapter' ELSE 'parsed' END AS method FROM s"""
)
def hs_dotted(spark, d) -> DataFrame:
    return view(spark, d, "v_strings").select("id", T.dotted_hs(F.col("hs")).alias("r")).select("id", "r.*")


@query(f"{CODE} SELECT id, CASE id % 3 WHEN 0 THEN coalesce(upper(trim(label)) IN ('CIF', 'CIP', 'CFR', 'CPT'), FALSE) ELSE FALSE END AS cif, upper(code) LIKE 'ID-%' AS prefixed FROM v_codes")
def term_class(spark, d) -> DataFrame:
    term = F.when(F.col("id") % 3 == 0, F.trim("label"))
    return view(spark, d, "v_codes").select("id", V.cif_term(term).alias("cif"), F.upper("code").startswith("ID-").alias("prefixed"))


@query(f"{SHIP} SELECT max(created_at) AS latest FROM v_shipments")
def latest_shipment(spark, d) -> DataFrame:
    return view(spark, d, "v_shipments").agg(F.max("created_at").alias("latest"))


@query(f"{sql('v_activities')} SELECT id, action, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS at FROM v_activities ORDER BY created_at DESC, id DESC LIMIT 1")
def act_latest(spark, d) -> DataFrame:
    top = analytics.page(view(spark, d, "v_activities"), F.desc_nulls_first("created_at"), F.desc("id"), size=1)
    return top.select("id", "action", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
