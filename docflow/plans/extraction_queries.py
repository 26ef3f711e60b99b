"""Queries of what documents say line by line, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import extraction as X
from ..operators import pages as G
from ..sources.views import sql, view
from .registry import query

PACK, MATERIAL, LETTER = (sql(v) for v in ("v_packing", "v_materials", "v_letters"))
_q = lambda s: "'" + s.replace("'", "''") + "'"


def _nested(c: str, pairs) -> str:
    for pattern, new in pairs:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(new)}, 'g')"
    return c


_LIST_CODE = f"""length(code) >= 4 AND NOT regexp_matches(code, {_q("(?i)" + dims.NO_LIST_CODE)}) AND ({" OR ".join(f"upper(code) LIKE '{p}%'" for p in dims.LIST_CODES + dims.LIST_ID_CODES)} OR upper(code) NOT LIKE 'ID-%')"""


@query(
    f"""{PACK}, a AS (SELECT *, regexp_extract(trim(line), {_q(X.LIST_CODE)}, 1) AS code, list_filter(list_transform(list_filter(string_split_regex(line, '\\s+'), lambda t: regexp_matches(t, '^[0-9]{{3,5}}([^0-9*x]|$)')), lambda t: CAST(regexp_extract(t, '^[0-9]+') AS BIGINT)), lambda v: v >= 200) AS own, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM v_packing),
 b AS (SELECT *, {_LIST_CODE} AS item, regexp_matches(line, '[A-Za-z]') AS letters FROM a),
 n AS (SELECT i.doc_id, i.k, i.code, i.own, (SELECT min(x.k) FROM b x WHERE x.doc_id = i.doc_id AND x.item AND x.k > i.k) AS up_to FROM b i WHERE i.item),
 f AS (SELECT n.*, list_concat(n.own, coalesce((SELECT flatten(list(x.own ORDER BY x.k)) FROM b x WHERE x.doc_id = n.doc_id AND x.k > n.k AND x.k <= n.k + 5 AND (n.up_to IS NULL OR x.k < n.up_to)), [])) AS found FROM n),
 g AS (SELECT f.*, p.own AS o1, p.item OR p.letters AS c1, r.own AS o2, r.item OR r.letters AS c2 FROM f LEFT JOIN b p ON p.doc_id = f.doc_id AND p.k = f.k - 1 LEFT JOIN b r ON r.doc_id = f.doc_id AND r.k = f.k - 2),
 h AS (SELECT doc_id, k, {_nested("code", [("(?i)" + a, b) for a, b in dims.CODE_FIXES])} AS code, CASE WHEN len(found) < 2 AND up_to IS DISTINCT FROM k + 1 THEN list_concat(found, CASE WHEN coalesce(c1, TRUE) THEN [] WHEN len(o1) > 0 THEN o1 WHEN coalesce(c2, TRUE) THEN [] ELSE o2 END) ELSE found END AS found FROM g),
 s AS (SELECT doc_id, k, code, list_reverse_sort(list_distinct(found)) AS best FROM h)
 SELECT doc_id, code, arg_max(best[2], k) AS net_weight, arg_max(best[1], k) AS gross_weight FROM s WHERE len(best) >= 2 AND best[1] <= 40000 GROUP BY doc_id, code"""
)
def packing_weights(spark, d) -> DataFrame:
    return X.packing_weights(view(spark, d, "v_packing"))


_EURO = "CAST(replace(replace(v, '.', ''), ',', '.') AS DOUBLE)"


@query(
    f"""{MATERIAL}, a AS (SELECT doc_id, pos, trim(line) AS text, regexp_extract(trim(line), {_q(X.MATERIAL_CODE)}, 1) AS code FROM v_materials),
 b AS (SELECT *, lead(text) OVER w AS t1, lead(code) OVER w AS k1, lead(text, 2) OVER w AS t2, lead(code, 2) OVER w AS k2 FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 c AS (SELECT * FROM b WHERE length(code) >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY pos) = 1),
 e AS (SELECT *, t1 IS NOT NULL AND (t1 = '' OR (k1 = '' AND length(text) + length(t1) <= 180)) AS one, text || CASE WHEN one AND t1 <> '' THEN ' ' || t1 ELSE '' END AS r1 FROM c),
 m AS (SELECT *, r1 || CASE WHEN one AND t2 <> '' AND k2 = '' AND length(r1) + length(t2) <= 180 THEN ' ' || t2 ELSE '' END AS r FROM e),
 i AS (SELECT doc_id, pos, code, regexp_extract(r, '\\b([0-9]{{8}})\\b', 1) AS hs, nullif(trim(regexp_extract({_nested("r", [(x, "") for x in X.MATERIAL_CUTS])}, {_q(X.MATERIAL_TEXT)}, 1)), '') AS description,
  list_filter(regexp_extract_all(r, '\\b([A-Z]{{2,4}})\\b', 1), lambda u: u IN ({", ".join(map(_q, X.MATERIAL_UNITS))}))[1] AS u,
  list_max(list_filter(list_transform(regexp_extract_all(r, '\\b([0-9]{{1,3}}\\.[0-9]{{3}}(?:,[0-9]{{2}}))\\b', 1), lambda v: {_EURO}), lambda v: v BETWEEN 10 AND 200000)) AS amount,
  list_max(list_filter(list_transform(regexp_extract_all(regexp_replace(r, '([^.,0-9])', '\\1\\1', 'g'), '(?:^|[^.0-9])([0-9]{{1,5}})(?:[^.,0-9]|$)', 1), lambda v: CAST(v AS DOUBLE)), lambda v: v BETWEEN 100 AND 50000)) AS whole,
  list_filter(list_transform(regexp_extract_all(r, '\\b([0-9]+(?:,[0-9]{{1,4}}))\\b', 1), lambda v: {_EURO}), lambda v: v >= 0.001 AND v < 50)[1] AS small FROM m WHERE NOT regexp_matches(r, {_q(X.NO_MATERIAL)})),
 q AS (SELECT *, coalesce(whole, small) AS quantity FROM i)
 SELECT doc_id, pos, code, CASE WHEN hs <> '' AND substr(hs, 1, 2) BETWEEN '01' AND '97' THEN hs END AS hs_code, description, CASE WHEN u IN ('EA', 'PCS', 'UN', 'CT') THEN 'NMP' WHEN u = 'KGM' THEN 'KGM' ELSE 'TNE' END AS unit, quantity, amount, round(amount / quantity, 4) AS unit_price,
 CASE WHEN amount IS NOT NULL AND quantity IS NOT NULL THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM q WHERE quantity IS NOT NULL OR amount IS NOT NULL"""
)
def material_items(spark, d) -> DataFrame:
    return X.material_items(view(spark, d, "v_materials"))


def _family(rank: int, label: str, sure: float, pattern: str) -> str:
    name = "CASE WHEN doc_type IN ('CI', 'PL') THEN 'invoice_date' ELSE 'bl_date' END" if label == "date" else _q(label)
    pattern = pattern.replace("(?=", "(?:")  # DuckDB can't look ahead
    return f"SELECT id, {rank} AS rank, {name} AS label, CAST({sure} AS DOUBLE) AS confidence, unnest(regexp_extract_all(text, {_q(pattern)}, 1)) AS v FROM v_letters"


@query(
    f"""{LETTER}, f AS ({" UNION ALL ".join(_family(k, *r) for k, r in enumerate(X.HEADER_RULES))}), t AS (SELECT id, rank, label, confidence, regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS value FROM f),
 g AS (SELECT * FROM t WHERE length(value) >= 2 AND (label <> 'seller_name' OR (length(value) >= 10 AND regexp_matches(value, '[a-z]') AND NOT regexp_matches(upper(value), '(^|[\\s,.\\-])({"|".join(X.NO_SELLER)})($|[\\s,.\\-])'))))
 SELECT id, label, value, arg_min(confidence, rank) AS confidence FROM g GROUP BY id, label, value"""
)
def header_fallback(spark, d) -> DataFrame:
    return X.header_fields(view(spark, d, "v_letters"))


@query(
    f"""{sql("v_spans")}, w AS (SELECT page_id, unnest([3, 4]) AS pos FROM v_spans WHERE kind < 2 UNION ALL SELECT page_id, 6 FROM v_spans UNION ALL SELECT page_id, 8 FROM v_spans WHERE kind = 0)
 SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE pos WHEN 3 THEN 'B-vessel_name' WHEN 4 THEN 'I-vessel_name' WHEN 6 THEN 'B-port_of_loading' ELSE 'O' END AS label FROM w"""
)
def span_labels(spark, d) -> DataFrame:
    words = view(spark, d, "v_spans", by="page_id").select("page_id", F.split("text", " ").alias("words"))
    sought = {"vessel_name": ("ever;  Given", None), "port_of_loading": ("Ningbo,",), "remark": ("finis", "zzz zzz")}
    entities = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(k).cast("bigint").alias("rank"), F.array(*[F.lit(x) for x in v]).cast("array<string>").alias("values")) for k, (e, v) in enumerate(sought.items())])
    pages = words.select("page_id", "words", F.inline(entities))
    return X.span_labels(X.page_spans(pages), ("vessel_name", "port_of_loading"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, CAST(o_custkey % 3 AS INTEGER) AS n FROM orders)
 SELECT 'doc' || k AS stem, n AS page, CASE WHEN k % 4 < 3 THEN 'scans/' || CASE WHEN k % 4 = 1 THEN 'old_' ELSE '' END || 'doc' || k || '_p' || n || '.png' END AS image FROM p"""
)
def page_images(spark, d) -> DataFrame:
    """The image of a page of each order; some have a name before the document's, some have a second image later, some none."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).cast("int").alias("n"))
    stem = F.concat(F.lit("doc"), F.col("k").cast("string"))
    path = F.concat(F.lit("scans/"), F.when(F.col("k") % 4 == 1, "old_").otherwise(""), G.image_name(stem, F.col("n")))
    images = o.where("k % 4 < 3").select(path.alias("image"), F.col("k").alias("ord"))
    later = o.where("k % 4 = 2").select(F.concat(F.lit("again/x_"), G.image_name(stem, F.col("n"))).alias("image"), (F.col("k") + (1 << 40)).alias("ord"))
    return G.with_images(o.select(stem.alias("stem"), F.col("n").alias("page")), images.unionByName(later))
