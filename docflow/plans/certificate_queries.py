"""Queries of certificates of origin, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import dims
from ..operators import certificates as C
from ..sources.views import sql, view
from .registry import query

_q = lambda s: "'" + s.replace("'", "''") + "'"


def _cut(c: str, pairs) -> str:
    for pattern, new in pairs:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(new)}, 'g')"
    return c


_RATES = f""", t(hs8, hs4, bm, ppn, pph, ord) AS (VALUES {dims.values(dims.tariff_rows())}), near AS (SELECT hs4, arg_min(bm, ord) AS bm, arg_min(ppn, ord) AS ppn, arg_min(pph, ord) AS pph FROM t GROUP BY hs4),
 c8 AS (SELECT *, CAST(rpad(substr(hs_code, 1, 6), 8, '0') AS BIGINT) AS code FROM goods)
 SELECT c8.* EXCLUDE (code), coalesce(t.bm, near.bm, 0) AS bm, coalesce(t.ppn, near.ppn, 12) AS ppn, coalesce(t.pph, near.pph, 2.5) AS pph, t.hs8 IS NOT NULL OR near.hs4 IS NOT NULL AS found FROM c8 LEFT JOIN t ON t.hs8 = code LEFT JOIN near ON near.hs4 = code // 10000"""
_TEXT = _cut("CASE WHEN more = '' THEN above ELSE more END", C.TEXT_CUTS)


@query(
    f"""{sql("v_certificates")}, a AS (SELECT doc_id, pos, line, trim(line) AS text, regexp_matches(text, {_q(C.SECTION)}) AS opens FROM v_certificates),
 b AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM a),
 d AS (SELECT *, row_number() OVER w AS k, first_value(regexp_extract(text, {_q(C.SECTION)}, 1) || regexp_extract(text, {_q(C.SECTION)}, 2)) OVER w AS hs_code, text = '' OR regexp_matches(text, {_q(C.NO_GOODS)}) AS skip
  FROM b WHERE section > 0 WINDOW w AS (PARTITION BY doc_id, section ORDER BY pos)),
 i AS (SELECT *, regexp_extract(text, {_q(C.ITEM)}, 1) AS n, regexp_extract(text, {_q(C.ITEM)}, 2) AS more FROM d
  WHERE NOT skip AND n <> '' AND CAST(nullif(n, '') AS INT) <= 31 AND NOT regexp_matches(more, {_q(C.NO_TEXT)}) QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) = 1),
 j AS (SELECT i.*, coalesce((SELECT arg_max(x.text, x.k) FROM d x WHERE x.doc_id = i.doc_id AND x.section = i.section AND x.k BETWEEN i.k - 4 AND i.k - 1 AND NOT x.skip AND length(x.text) <= 80), '') AS above,
  (SELECT string_agg(x.line, ' ' ORDER BY x.k) FROM d x WHERE x.doc_id = i.doc_id AND x.section = i.section AND x.k BETWEEN i.k - 2 AND i.k + 3) AS around FROM i),
 goods AS (SELECT doc_id, CAST(n AS BIGINT) AS number, hs_code, replace(regexp_extract(around, {_q(C.PIECES)}, 1), ',', '') AS quantity, CASE WHEN length(trim({_TEXT})) >= 2 THEN substr(trim({_TEXT}), 1, 200) ELSE '' END AS description FROM j)
 {_RATES}"""
)
def certificate_sections(spark, d) -> DataFrame:
    return C.section_goods(view(spark, d, "v_certificates", by="doc_id"))


_AREA = "CASE WHEN contains(text, 'USD') AND contains(text, 'CNY') AND contains(text, 'EUR') AND contains(text, 'SGD') THEN substr(text, 1, least(strpos(text, 'USD'), strpos(text, 'CNY'), strpos(text, 'EUR'), strpos(text, 'SGD')) - 1) ELSE text END"
_NAMED = _cut(f"trim(regexp_replace(trim(before), {_q('(?i)^N/M')}, ''))", [(r"[0-9,]+(\.[0-9]+)?\s*", "")])


@query(
    f"""{sql("v_origins").replace("WITH", "WITH RECURSIVE", 1)}, a AS (SELECT doc_id, pos, trim(line) AS text, lead(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM v_origins),
 b AS (SELECT *, regexp_extract(text, {_q(C.LINE_CODE)}, 1) AS before, regexp_extract(text, {_q(C.LINE_CODE)}, 2) AS code, substr(text, length(before) + length(code) + 1) AS rest FROM a WHERE NOT regexp_matches(text, {_q(C.NO_LINE)})),
 e AS (SELECT *, TRY_CAST(regexp_extract(text, '^([0-9]+)\\b', 1) AS BIGINT) AS own, replace(regexp_extract(substr(rest, 1, 15), '^[\\s,]*([0-9,]*\\.[0-9]+)\\b', 1), ',', '') AS beside,
  list_filter(list_transform(regexp_extract_all({_AREA}, '[0-9][0-9,]*\\.[0-9]+'), lambda v: replace(v, ',', '')), lambda v: CAST(v AS DOUBLE) BETWEEN 1 AND 999999) AS every,
  coalesce(nullif(regexp_extract(substr(rest, 1, 5), '^\\s+([A-Z]{{2}})\\b', 1), ''), CASE WHEN regexp_matches(next, '^[A-Z]{{2,4}}$') THEN substr(next, 1, 2) END, '') AS unit, trim({_NAMED}) AS named FROM b WHERE code <> '' AND code NOT LIKE '0%'),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM e WHERE CASE WHEN own IS NULL THEN unit <> '' ELSE own <= 100 END),
 r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS number FROM f UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN s.n IS NULL THEN s.used ELSE list_append(s.used, s.n) END, s.n FROM (SELECT f.doc_id, f.k, r.used, CASE WHEN f.own IS NULL THEN list_min(list_filter(range(CAST(len(r.used) + 1 AS BIGINT), CAST(2 * len(r.used) + 2 AS BIGINT)), lambda v: NOT list_contains(r.used, v))) WHEN NOT list_contains(r.used, f.own) THEN f.own END AS n FROM r JOIN f ON f.doc_id = r.doc_id AND f.k = r.k + 1) s),
 goods AS (SELECT f.doc_id, r.number, substr(code, 1, 6) AS hs_code, CASE WHEN TRY_CAST(beside AS DOUBLE) BETWEEN 1 AND 999999 THEN beside ELSE coalesce(every[-1], '') END AS quantity, unit, CASE WHEN own IS NOT NULL AND length(named) >= 3 THEN substr(named, 1, 100) ELSE '' END AS description
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k WHERE r.number IS NOT NULL)
 {_RATES}"""
)
def certificate_lines(spark, d) -> DataFrame:
    return C.line_goods(view(spark, d, "v_origins", by="doc_id"))
