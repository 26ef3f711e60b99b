"""Queries of parties, merged headers, weights and workbooks. Letters and cells are made of numbers of orders, from which the DuckDB SQL says what is to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import parties as P
from ..sources import workbooks as B
from ..sources.views import load, parts, sql, view
from .registry import query

BILLS, HEADERS, ITEMS, PACK = (sql(v) for v in ("v_bills", "v_header_values", "v_items", "v_packing"))


@query(
    f"""{BILLS}, f AS (SELECT doc_id, 'shipper_name' AS label, maker AS value, 0.80 AS sure FROM v_bills WHERE kind < 3 UNION ALL SELECT doc_id, 'shipper_name', maker, 0.78 FROM v_bills WHERE kind = 3
 UNION ALL SELECT doc_id, 'country_of_origin', 'KOREA', 0.85 FROM v_bills WHERE kind IN (1, 3) UNION ALL SELECT doc_id, 'consignee_name', taker, 0.82 FROM v_bills WHERE kind IN (0, 1) UNION ALL SELECT doc_id, 'notify_party_name', taker, 0.82 FROM v_bills WHERE kind = 2)
 SELECT doc_id, label, value, CAST(sure AS DOUBLE) AS confidence FROM f"""
)
def bill_parties(spark, d) -> DataFrame:
    return P.bill_parties(view(spark, d, "v_bills", by="doc_id").select("doc_id", "text"))


_ORDER = " ".join(f"WHEN label = '{label}' AND doc_type = '{t}' THEN {k}" for label, types in P.SOURCES.items() for k, t in enumerate(types))


@query(
    f"""{HEADERS}, r AS (SELECT *, CASE {_ORDER} END AS k FROM v_header_values WHERE value <> ''), t AS (SELECT doc_id, label, arg_min(value, (k, value)) AS value FROM r WHERE k IS NOT NULL GROUP BY doc_id, label),
 n AS (SELECT DISTINCT doc_id FROM t s WHERE label = 'shipper_name' AND NOT EXISTS (FROM t x WHERE x.doc_id = s.doc_id AND x.label = 'seller_name'))
 SELECT * FROM t WHERE NOT (label = 'seller_address' AND doc_id IN (FROM n)) UNION ALL SELECT doc_id, replace(label, 'shipper', 'seller'), value FROM t WHERE label IN ('shipper_name', 'shipper_address') AND doc_id IN (FROM n)"""
)
def header_merge(spark, d) -> DataFrame:
    return P.merged_header(view(spark, d, "v_header_values"))


@query(
    f"""{PACK}, {ITEMS.removeprefix("WITH ")}, c AS (SELECT DISTINCT doc_id, CASE WHEN net <> 'n/a' THEN 'own' END AS has FROM v_items)
 SELECT doc_id, has IS NOT NULL AS kept, CAST(count(*) AS BIGINT) AS n FROM (SELECT i.doc_id, CASE WHEN net <> 'n/a' THEN 'own' END AS has FROM v_items i) GROUP BY ALL"""
)
def weights_kept(spark, d) -> DataFrame:
    """Items that have a weight keep it, and the join with a packing list makes no item twice."""
    items = view(spark, d, "v_items").select("doc_id", "item_code", F.nullif("net", F.lit("n/a")).alias("net_weight"), F.lit(None).cast("string").alias("gross_weight"), F.nullif("net", F.lit("n/a")).alias("before"))
    weights = X.packing_weights(view(spark, d, "v_packing"))
    met = P.with_weights(items, weights)
    return met.groupBy("doc_id", (F.col("before").isNotNull() & (F.col("before") == F.col("net_weight"))).alias("kept")).agg(F.count("*").alias("n"))


_LAYOUT = {"HEADER": ["KODE VALUTA", "FOB", "NETTO"], "ENTITAS": ["KODE ENTITAS", "NAMA ENTITAS"], "BARANG": ["HS", "URAIAN", "JUMLAH SATUAN"], "KONTAINER": ["NOMOR KONTINER"]}


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS t FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM lineitem),
 f AS (SELECT k, 'currency' AS entity, 0 AS r, CASE WHEN c % 2 = 0 THEN 'USD' ELSE 'EUR' END AS value FROM o UNION ALL SELECT k, 'total_amount', 0, CAST(c AS VARCHAR) FROM o UNION ALL SELECT k, 'seller_name', 1, 'Maker & Co <' || c || '>' FROM o UNION ALL SELECT k, 'buyer_name', 0, 'Buyer ' || c FROM o
 UNION ALL SELECT k, 'item_description', r, 'Part ' || p FROM l UNION ALL SELECT k, 'item_quantity', r, CAST(n AS VARCHAR) FROM l)
 SELECT CAST(k AS VARCHAR) AS file, entity, CAST(r AS BIGINT) AS row, value FROM f"""
)
def workbook_round_trip(spark, d) -> DataFrame:
    """Workbooks of all orders are written and read, and their values looked up."""
    o, items = load(spark, d, "orders"), load(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    cells = lambda **v: F.map_from_entries(F.array(*[F.struct(F.lit(k.replace("_", " ")), c) for k, c in v.items()]))
    one = lambda sheet, n, c: o.select(F.col("o_orderkey").alias("id"), F.lit(sheet).alias("sheet"), F.lit(n).cast("bigint").alias("row"), c.alias("cells"))
    who = F.concat(F.lit("Maker & Co <"), text("o_custkey"), F.lit(">"))
    rows = one("HEADER", 0, cells(KODE_VALUTA=F.when(F.col("o_custkey") % 2 == 0, "USD").otherwise("EUR"), FOB=text("o_custkey"), OTHER=F.lit("x")))
    rows = rows.unionByName(one("ENTITAS", 0, cells(KODE_ENTITAS=F.lit("1"), NAMA_ENTITAS=F.concat(F.lit("Buyer "), text("o_custkey"))))).unionByName(one("ENTITAS", 1, cells(KODE_ENTITAS=F.lit("9"), NAMA_ENTITAS=who))).unionByName(one("ENTITAS", 2, cells(KODE_ENTITAS=F.lit("9"), NAMA_ENTITAS=F.lit("another"))))
    place = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1").cast("bigint")
    goods = items.select(F.col("l_orderkey").alias("id"), F.lit("BARANG").alias("sheet"), place.alias("row"), cells(URAIAN=F.concat(F.lit("Part "), text("l_partkey")), JUMLAH_SATUAN=text("l_linenumber")).alias("cells"))
    orders = goods.join(o.select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return B.file_values(B.written(rows.unionByName(orders), _LAYOUT, parts=parts(o)))
