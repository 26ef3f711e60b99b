"""Trade-document tables made of the driver's tables by plain arithmetic. Each view is one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name: (base table, columns). The expressions keep to what both dialects share.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_shipments": (
        "orders",
        {
            "id": "o_orderkey",
            "reference_code": "'CD-' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0')",
            "filename": "'invoice_' || CAST(o_custkey AS VARCHAR(20)) || '.pdf'",
            "status": "CASE o_orderkey % 5 WHEN 0 THEN 'Draft Valid' WHEN 1 THEN 'Draft Invalid' WHEN 2 THEN 'Sent' WHEN 3 THEN 'Failed' ELSE 'Approved' END",
            "documents": "CASE o_orderkey % 4 WHEN 0 THEN '[\"CI\",\"PL\",\"BL\"]' WHEN 1 THEN '[\"CI\",\"PL\"]' WHEN 2 THEN '[\"CI\",\"BL\"]' ELSE '[\"CI\"]' END",
            "confidence": "CAST(o_custkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE)",
            "total": "o_totalprice",
            "incoterm": "CASE o_orderkey % 7 WHEN 0 THEN 'FOB' WHEN 1 THEN 'CIF' WHEN 2 THEN 'cfr ' WHEN 3 THEN 'CIP PORT' WHEN 4 THEN 'EXW' WHEN 5 THEN '' ELSE 'CPT' END",
            "currency": "CASE o_orderkey % 9 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' WHEN 2 THEN 'eur' WHEN 3 THEN 'JPY' WHEN 4 THEN 'IDR' WHEN 5 THEN 'SGD' WHEN 6 THEN '' WHEN 7 THEN 'XYZ' ELSE 'GBP' END",
            "freight": "CAST(o_custkey % 5 AS DOUBLE) * CAST(350 AS DOUBLE)",
            "created_at": "o_orderdate",
            "updated_at": "o_orderdate + INTERVAL '1' DAY * (o_custkey % 30)",
            "priority": "o_orderpriority",
            "custkey": "o_custkey",
        },
    ),
    "v_activities": (
        "events",
        {
            "id": "event_id",
            "action": "CASE event_type WHEN 'click' THEN 'OCR Process' WHEN 'view' THEN 'Declaration Create' WHEN 'purchase' THEN 'Declaration Send' WHEN 'signup' THEN 'Declaration Approve' ELSE 'Declaration Update' END",
            "status": "CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'sent' ELSE 'approved' END",
            "description": "'Shipment ' || CAST(user_id AS VARCHAR(20)) || ' handled'",
            "reference_code": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'CD-' || lpad(CAST(user_id AS VARCHAR(20)), 8, '0') END",
            "metadata": "props",
            "created_at": "ts",
        },
    ),
    "v_strings": (
        "orders",
        {
            "id": "o_orderkey",
            "amount": "CASE o_orderkey % 9 WHEN 0 THEN 'USD ' || CAST(o_custkey % 900 + 100 AS VARCHAR(9)) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR(9)), 3, '0') || '.5' WHEN 1 THEN CAST(o_custkey % 900 AS VARCHAR(9)) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR(9)), 3, '0') || ',25' WHEN 2 THEN CAST(o_custkey % 900 AS VARCHAR(9)) || ',' || CAST(o_orderkey % 100 AS VARCHAR(9)) WHEN 3 THEN '12,345,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 4 THEN '(' || CAST(o_custkey % 100 AS VARCHAR(9)) || '.00)' WHEN 5 THEN 'Rp ' || CAST(o_custkey AS VARCHAR(9)) WHEN 6 THEN '' WHEN 7 THEN 'abc' ELSE CAST(o_custkey AS VARCHAR(9)) || '.75' END",
            "day": "CASE o_orderkey % 8 WHEN 0 THEN lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR(9)), 2, '0') || '/' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR(9)), 2, '0') || '/2026' WHEN 1 THEN '2026-' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR(9)), 2, '0') || '-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR(9)), 2, '0') WHEN 2 THEN CAST(o_orderkey % 28 + 1 AS VARCHAR(9)) || '.3.2025' WHEN 3 THEN '31/02/2026' WHEN 4 THEN '' WHEN 5 THEN '20260105' WHEN 6 THEN '2025/11/' || CAST(o_orderkey % 30 + 1 AS VARCHAR(9)) ELSE CAST(o_orderkey % 28 + 1 AS VARCHAR(9)) || '-12-2024' END",
            "hs": "CASE o_orderkey % 7 WHEN 0 THEN '9403.10.00' WHEN 1 THEN CAST(100000 + o_custkey % 800000 AS VARCHAR(9)) WHEN 2 THEN CAST(o_custkey AS VARCHAR(9)) WHEN 3 THEN '00' || CAST(123400 + o_custkey % 99 AS VARCHAR(9)) WHEN 4 THEN '98010000' WHEN 5 THEN '59022020' || CAST(o_orderkey % 1000 AS VARCHAR(9)) ELSE 'HS 8471 30' END",
            "box": "CASE o_orderkey % 9 WHEN 0 THEN 'OOLU' || lpad(CAST(o_custkey AS VARCHAR(9)), 7, '0') WHEN 1 THEN 'no: tclu ' || CAST(o_custkey AS VARCHAR(9)) WHEN 2 THEN 'ABC' || lpad(CAST(o_custkey AS VARCHAR(9)), 6, '0') WHEN 3 THEN '40HQ' WHEN 4 THEN '20 ft' WHEN 5 THEN 'LCL' WHEN 6 THEN '' WHEN 7 THEN '45G1' ELSE '40hc' END",
            "port": "CASE o_orderkey % 9 WHEN 0 THEN 'NINGBO, CHINA' WHEN 1 THEN 'tanjung priok' WHEN 2 THEN 'CNSHA' WHEN 3 THEN 'XYZ' WHEN 4 THEN 'Port of Hamburg' WHEN 5 THEN 'KLANG' WHEN 6 THEN '' WHEN 7 THEN 'SHANTOU, CHINA' ELSE 'Busan' END",
            "country": "CASE o_orderkey % 9 WHEN 0 THEN 'id' WHEN 1 THEN 'Indonesia' WHEN 2 THEN 'MADE IN CHINA' WHEN 3 THEN 'UKRAINE' WHEN 4 THEN '' WHEN 5 THEN 'Atlantis' WHEN 6 THEN 'KOREA' WHEN 7 THEN 'INDIAN' ELSE 'USA ' END",
            "money": "CASE o_orderkey % 9 WHEN 0 THEN 'usd' WHEN 1 THEN 'USD/KG' WHEN 2 THEN 'yen' WHEN 3 THEN 'US DOLLAR PER KG' WHEN 4 THEN '' WHEN 5 THEN 'FRANC' WHEN 6 THEN 'Rupiah' WHEN 7 THEN 'RENMINBI RMB' ELSE 'EURO' END",
            "pack": "CASE o_orderkey % 8 WHEN 0 THEN 'pcs' WHEN 1 THEN 'WOODEN CRATES' WHEN 2 THEN 'MT' WHEN 3 THEN 'JUMBO BAG' WHEN 4 THEN '' WHEN 5 THEN 'XX' WHEN 6 THEN '2 cartons' ELSE 'Kgs' END",
            "term": "CASE o_orderkey % 6 WHEN 0 THEN 'fob' WHEN 1 THEN 'CIF JAKARTA' WHEN 2 THEN 'ddp' WHEN 3 THEN '' WHEN 4 THEN 'ABC' ELSE ' CPT ' END",
            "party": "CASE o_orderkey % 6 WHEN 0 THEN 'Buyer' WHEN 1 THEN 'notify party' WHEN 2 THEN 'SHIPPER' WHEN 3 THEN '' WHEN 4 THEN 'agent' ELSE 'pengirim_barang' END",
            "unit": "CASE o_orderkey % 8 WHEN 0 THEN 'kg' WHEN 1 THEN 'LBS' WHEN 2 THEN 'mt' WHEN 3 THEN 'tael' WHEN 4 THEN 'kin' WHEN 5 THEN 'grams' WHEN 6 THEN '' ELSE 'stone' END",
            "weight": "o_totalprice",
            "custkey": "o_custkey",
        },
    ),
    "v_texts": (
        "orders",
        {
            "id": "o_orderkey",
            "text": "'COMMERCIAL INVOICE' || chr(10) || CASE o_orderkey % 5 WHEN 0 THEN 'C/I NO: AB-' || CAST(o_orderkey AS VARCHAR(20)) || '-XYZ' WHEN 1 THEN 'Invoice No. INVOICE/' || CAST(o_orderkey AS VARCHAR(20)) WHEN 2 THEN 'invoice: 12' WHEN 3 THEN 'INV# 99/2026' ELSE 'INV ABCDEF INV GHIJKL' END || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'Date: Jan 05, 2026' WHEN 1 THEN 'DATE 5-Feb-2026' WHEN 2 THEN 'date: Date' ELSE 'dated 2026' END || chr(10) || CASE o_custkey % 6 WHEN 0 THEN 'Currency: usd' WHEN 1 THEN 'PRICE IN EUR' WHEN 2 THEN 'UNIT usd /kg' WHEN 3 THEN 'gbp / KILO' WHEN 4 THEN 'Valuta CNY, paid in JPY' ELSE 'no money' END || chr(10) || CASE o_custkey % 7 WHEN 0 THEN 'FOB NINGBO' WHEN 1 THEN 'cif jakarta' WHEN 2 THEN 'From SHANGHAI, CHINA' || chr(10) || 'To SURABAYA' WHEN 3 THEN 'Port of Loading: xiamen' WHEN 4 THEN 'PORT OF DISCHARGE: BELAWAN  ' WHEN 5 THEN 'from there' ELSE 'terms' END || chr(10) || CASE o_orderkey % 6 WHEN 0 THEN 'Vessel name: EVER GIVEN 0' WHEN 1 THEN 'MSC OSCAR 123E' WHEN 2 THEN 'Gross Weight: 1,234.5 KGS' WHEN 3 THEN 'OOLU1234567 and TCLU7654321' WHEN 4 THEN 'B/L: OOLU' || CAST(o_orderkey AS VARCHAR(20)) || ' BL No: X' || CAST(o_orderkey AS VARCHAR(20)) || 'YZ' ELSE 'N.W. 88 kg, G.W. 99' END || chr(10) || CASE o_custkey % 5 WHEN 0 THEN 'Made in VIETNAM' WHEN 1 THEN '120 CARTONS of CHINA' WHEN 2 THEN 'Freight: Collect' WHEN 3 THEN 'CBM: 12.50' ELSE 'Container No: MAEU 3.5 m3' END",
        },
    ),
    "v_headers": (
        "orders",
        {
            "id": "o_orderkey",
            "custkey": "o_custkey",
            "invoice_number": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' INV-' || CAST(o_orderkey AS VARCHAR(20)) END",
            "invoice_date": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 28 + 1 AS VARCHAR(9)) || '/3/2026' END",
            "bl_number": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'BL' || CAST(o_custkey AS VARCHAR(20)) END",
            "bl_date": "CASE WHEN o_custkey % 4 = 0 THEN 'soon' ELSE '2026-02-' || CAST(o_custkey % 18 + 10 AS VARCHAR(9)) END",
            "currency": "CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'IDR' ELSE 'SGD' END",
            "incoterms": "CASE o_orderkey % 6 WHEN 0 THEN 'CIF' WHEN 1 THEN '' WHEN 2 THEN 'FOB' WHEN 3 THEN 'CFR' WHEN 4 THEN 'EXW' ELSE NULL END",
            "total_amount": "CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_custkey * 10 AS VARCHAR(20)) || '.37' END",
            "freight": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey % 400 AS VARCHAR(20)) || '.11' END",
            "insurance": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 30 AS VARCHAR(20)) END",
            "port_of_loading": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'NINGBO' END",
            "port_of_discharge": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'JAKARTA' END",
            "vessel_name": "CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE ' EVER ' END",
            "voyage_number": "CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE '12E' END",
            "seller_name": "CASE WHEN o_custkey % 6 < 2 THEN '' ELSE 'Seller' END",
            "seller_address": "'Street ' || CAST(o_custkey AS VARCHAR(20))",
            "buyer_name": "CASE WHEN o_custkey % 5 < 2 THEN '' ELSE 'Buyer' END",
            "shipper_name": "CASE WHEN o_custkey % 4 < 1 THEN '' ELSE 'Shipper' END",
            "shipper_address": "'Dock ' || CAST(o_custkey AS VARCHAR(20))",
            "consignee_name": "CASE WHEN o_custkey % 7 < 1 THEN '' ELSE 'Consignee' END",
            "notify_party_name": "CASE o_custkey % 4 WHEN 0 THEN 'Same as consignee' WHEN 1 THEN 'SAME AS ABOVE' WHEN 2 THEN 'Agent' ELSE '' END",
            "packaging_type": "CASE o_orderkey % 3 WHEN 0 THEN 'cartons' WHEN 1 THEN '' ELSE 'pallet' END",
            "number_of_packages": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_orderkey % 50 AS VARCHAR(9)) END",
            "containers": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' oolu1234567' ELSE 'TCLU1112223|MSKU4040404' END",
            "seals": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ab1' ELSE 'S1| s2 |S3' END",
            "confidence": "CAST(o_custkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE)",
        },
    ),
    "v_codes": (
        "orders",
        {
            "id": "o_orderkey",
            "label": "CASE o_orderkey % 6 WHEN 0 THEN 'cif' WHEN 1 THEN 'CPT' WHEN 2 THEN 'FOB' WHEN 3 THEN ' CIP' WHEN 4 THEN 'Jl. RAYA' ELSE 'phone' END",
            "code": "CASE o_orderkey % 19 WHEN 0 THEN 'HD-12-WHITH' WHEN 1 THEN '850X400X500' WHEN 2 THEN 'OOLU1234567' WHEN 3 THEN '1234567' WHEN 4 THEN '123456789012' WHEN 5 THEN 'TABLE' WHEN 6 THEN 'id-SLD-9' WHEN 7 THEN 'A1 CABINET' WHEN 8 THEN 'total' WHEN 9 THEN 'AB1' WHEN 10 THEN 'CN' || CAST(o_custkey AS VARCHAR(9)) WHEN 11 THEN 'hd-' || CAST(o_custkey AS VARCHAR(9)) || '-whit' WHEN 12 THEN '' WHEN 13 THEN 'DATE' WHEN 14 THEN 'port klang' WHEN 15 THEN 'ID-XY-7' WHEN 16 THEN 'CABINET-7' WHEN 17 THEN 'a' || chr(10) || 'b' ELSE 'NINGBO PORT' END",
            "line": "CASE o_orderkey % 9 WHEN 0 THEN 'N/M  STEEL;BOX 120 PIECES ABCD1234X' WHEN 1 THEN 'JOUTER \"A\" frame 12 PIECESI' WHEN 2 THEN 'HS CODE: 9403.10' WHEN 3 THEN 'Page 1 of 3' WHEN 4 THEN 'an electronic  certificate' WHEN 5 THEN '940310 CN 851220 CN' WHEN 6 THEN 'PE' WHEN 7 THEN '' ELSE 'plain, text: here' END",
            "path": "CASE o_orderkey % 9 WHEN 0 THEN 'a/b/Invoice_1.pdf' WHEN 1 THEN 'x/PACKING.pdf' WHEN 2 THEN 'HBL7.pdf' WHEN 3 THEN 'truth.XLSX' WHEN 4 THEN 'q/w.pdf' WHEN 5 THEN 'note.txt' WHEN 6 THEN 'smu9' WHEN 7 THEN 'AWB.txt' ELSE '' END",
            "weight": "CASE o_orderkey % 9 WHEN 0 THEN '1.234,5 KGS' WHEN 1 THEN '1,234.56 lb' WHEN 2 THEN '2 MT' WHEN 3 THEN '3 carton' WHEN 4 THEN '12 tons' WHEN 5 THEN '' WHEN 6 THEN 'abc' WHEN 7 THEN '1 234' ELSE CAST(o_custkey AS VARCHAR(9)) || 'kg' END",
        },
    ),
    "v_packing": (
        "lineitem",
        {
            "doc_id": "l_orderkey",
            "pos": "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "line": "CASE l_partkey % 11 WHEN 0 THEN 'HD-' || CAST(l_suppkey AS VARCHAR(9)) || '-WHIT 1 carton' WHEN 1 THEN CAST(l_partkey % 4000 + 150 AS VARCHAR(9)) || ' ' || CAST(l_partkey % 3000 + 250 AS VARCHAR(9)) WHEN 2 THEN 'TB-' || CAST(l_suppkey % 50 AS VARCHAR(9)) || '/X 12 850x400 1' || CAST(l_suppkey % 90 + 200 AS VARCHAR(9)) WHEN 3 THEN ' ' || CAST(l_partkey % 900 + 180 AS VARCHAR(9)) WHEN 4 THEN 'remark 45678 45999 123456' WHEN 5 THEN '350*200 410x20 777,5' WHEN 6 THEN 'id-SLD-9 500 600' WHEN 7 THEN 'ID-SLD-' || CAST(l_suppkey % 9 AS VARCHAR(9)) WHEN 8 THEN '' WHEN 9 THEN 'TOTAL 900 1900' ELSE 'MM-' || CAST(l_suppkey % 9 AS VARCHAR(9)) || ' ' || CAST(l_suppkey % 900 + 300 AS VARCHAR(9)) END",
        },
    ),
    "v_materials": (
        "lineitem",
        {
            "doc_id": "l_orderkey",
            "pos": "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "line": "CASE l_partkey % 9 WHEN 0 THEN '16231000' || lpad(CAST(l_suppkey AS VARCHAR(9)), 6, '0') || ' Pcs STEEL PLATE 84713000 ' || CAST(l_partkey % 4000 + 50 AS VARCHAR(9)) || ' 1.234,50 12.000,00' WHEN 1 THEN 'KGM 2.500,00 7 1200' WHEN 2 THEN '1623100A' || lpad(CAST(l_suppkey % 20 AS VARCHAR(9)), 5, '0') || ' Cable-tie, black 0,0294 225.000,00' WHEN 3 THEN 'more text EA 300' WHEN 4 THEN '' WHEN 5 THEN '1234567890123 Freight 100' WHEN 6 THEN '12345 short 500' WHEN 7 THEN 'see 99887766554' || CAST(l_suppkey % 9 AS VARCHAR(9)) || ' 98765432 4,2' ELSE '2026000000' || CAST(l_suppkey % 7 AS VARCHAR(9)) || ' UN Wooden frame Deklarasi Impor 9' END",
        },
    ),
    "v_certificates": (
        "lineitem",
        {
            "doc_id": "l_orderkey - l_orderkey % 32",
            "pos": "CAST(l_orderkey % 32 * 8 + l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "line": "CASE l_partkey % 13 WHEN 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'HS CODE: 8415.20' WHEN 1 THEN 'Hs  code - 9403' ELSE ' HS CODE:7326 90' END WHEN 1 THEN CAST(l_suppkey % 33 + 1 AS VARCHAR(9)) WHEN 2 THEN CAST(l_suppkey % 35 AS VARCHAR(9)) || ' STEEL  PLATE \"X\" 12 PIECES' WHEN 3 THEN '1,200PIECES' WHEN 4 THEN 'Wooden N/M table PE ABC12345' WHEN 5 THEN 'TOTAL 5 cartons' WHEN 6 THEN CAST(l_suppkey % 9 + 1 AS VARCHAR(9)) || ' of Annex 3' WHEN 7 THEN '' WHEN 8 THEN '12345678901' WHEN 9 THEN '7 JAN 2026' WHEN 10 THEN 'Jouter box  frame' WHEN 11 THEN '300 PIECESI packed' ELSE repeat('long row ', 9) || CAST(l_suppkey AS VARCHAR(9)) END",
        },
    ),
    "v_origins": (
        "lineitem",
        {
            "doc_id": "l_orderkey - l_orderkey % 32",
            "pos": "CAST(l_orderkey % 32 * 8 + l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "line": "CASE l_partkey % 11 WHEN 0 THEN 'N/M frames 841370 53944.0000 035 USD CNY EUR SGD 12.5' WHEN 1 THEN 'PE' WHEN 2 THEN CAST(l_suppkey % 110 AS VARCHAR(9)) || ' Chair, oak 94036010 PC 1,250.50' WHEN 3 THEN 'Total 12.50 94036010, 7.25x USD 9.5' WHEN 4 THEN 'ABCD' WHEN 5 THEN '73269090 KG' WHEN 6 THEN 'GOODS from factory' WHEN 7 THEN 'TEL: 560392' WHEN 8 THEN '012345678' WHEN 9 THEN '3,5 x 850000 12.75 EUR SGD 9.5 USD CNY' ELSE CAST(l_suppkey % 7 + 1 AS VARCHAR(9)) || ' 847130 PCS 0.5' END",
        },
    ),
    "v_letters": (
        "orders",
        {
            "id": "o_orderkey",
            "doc_type": "CASE o_orderkey % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'BL' ELSE 'PL' END",
            "text": "CASE o_custkey % 4 WHEN 0 THEN 'ACME Trading house CO.' WHEN 1 THEN 'QUANTITY list of goods LTD' WHEN 2 THEN 'ABC CO' ELSE 'plain' END || chr(10) || CASE o_orderkey % 5 WHEN 0 THEN 'Invoice No: AB-' || CAST(o_orderkey AS VARCHAR(20)) WHEN 1 THEN 'INV.' || CAST(o_orderkey + 1000 AS VARCHAR(20)) WHEN 2 THEN 'BL No: X' || CAST(o_orderkey + 1000 AS VARCHAR(20)) WHEN 3 THEN 'Date: 5-Feb-2026, Issued 6 MAR 26' ELSE 'Seal No. S' || CAST(o_orderkey + 1000 AS VARCHAR(20)) END || chr(10) || CASE o_custkey % 6 WHEN 0 THEN 'Vessel: EVER GIVEN' WHEN 1 THEN 'From NINGBO' WHEN 2 THEN 'USD 5 and IDR 6, USD 7; fob or CIF' WHEN 3 THEN 'Made in CHINA' WHEN 4 THEN 'OOLU1234567 TCLU7654321 OOLU1234567' ELSE 'Port of Discharge: JAKARTA' END || chr(10) || CASE o_custkey % 3 WHEN 0 THEN 'Buyer: PT MAJU JAYA  TEL 5' WHEN 1 THEN 'PT SINAR ABADI CO.' ELSE 'Consignee: NOBODY AT ALL' END",
        },
    ),
    "v_items": (
        "lineitem",
        {
            "doc_id": "l_orderkey",
            "ord": "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "item_code": "'HD-' || CAST(l_suppkey % 90 + 10 AS VARCHAR(9)) || '-' || CAST(l_partkey AS VARCHAR(9))",
            "partkey": "l_partkey",
            "quantity": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(9)) END",
            "amount": "CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(12)) END",
            "price": "CAST(CAST(floor(l_extendedprice / l_quantity * CAST(CASE l_suppkey % 4 WHEN 1 THEN 1.1 WHEN 2 THEN 1.5 ELSE 1 END AS DOUBLE)) AS BIGINT) AS VARCHAR(12))",
            "hs_code": "CASE WHEN l_suppkey % 3 = 0 THEN '940310' ELSE '' END",
            "dimensions": "CASE WHEN l_suppkey % 5 = 0 THEN '850*x400' END",
            "net": "CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE CAST(l_partkey % 900 + 100 AS VARCHAR(9)) END",
            "gross": "CAST(l_partkey % 900 + 120 AS VARCHAR(9))",
        },
    ),
    "v_candidates": (
        "lineitem",
        {
            "doc_id": "l_orderkey",
            "ord": "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "label": "CASE l_partkey % 7 WHEN 0 THEN 'incoterms' WHEN 1 THEN 'seller_name' WHEN 2 THEN 'item_hs_code' WHEN 3 THEN 'container_number' WHEN 4 THEN 'item_code' WHEN 5 THEN 'currency' ELSE 'total_amount' END",
            "layer": "CASE WHEN l_returnflag = 'A' THEN 'layout' ELSE 'pattern' END",
            "doc_type": "CASE l_suppkey % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'PL' ELSE 'BL' END",
            "value": "CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'FOB' WHEN 1 THEN 'cif ' ELSE 'QQQ' END WHEN l_partkey % 7 = 2 THEN CAST(l_partkey * 37 * CASE l_suppkey % 2 WHEN 0 THEN 1 ELSE 10001 END AS VARCHAR(12)) WHEN l_partkey % 7 = 3 THEN CASE l_suppkey % 2 WHEN 0 THEN 'OOLU' ELSE 'OOL' END || CAST(1000000 + l_partkey AS VARCHAR(9)) WHEN l_partkey % 7 = 5 THEN CASE l_suppkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR12.50' WHEN 2 THEN 'JPY' ELSE 'money' END ELSE 'V' || CAST(l_partkey AS VARCHAR(9)) END",
            "confidence": "CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) / CAST(10 AS DOUBLE)",
        },
    ),
    "v_words": (
        "lineitem",
        {
            "doc_id": "l_orderkey",
            "pos": "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "text": "'w' || CAST(l_partkey AS VARCHAR(9))",
            "conf": "l_discount * 10",
            "x1": "CAST(l_partkey % 800 AS DOUBLE)",
            "y1": "CAST(l_linenumber * 6 + l_suppkey % 7 AS DOUBLE)",
            "x2": "CAST(l_partkey % 800 + 40 AS DOUBLE)",
            "y2": "CAST(l_linenumber * 6 + l_suppkey % 7 + 9 AS DOUBLE)",
        },
    ),
    "v_tags": (
        "lineitem",
        {
            "seq_id": "l_orderkey",
            "pos": "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey",
            "gold": "CASE l_partkey % 5 WHEN 0 THEN 'B-a' WHEN 1 THEN 'I-a' WHEN 2 THEN 'I-b' WHEN 3 THEN 'B-b' ELSE 'O' END",
            "pred": "CASE WHEN l_suppkey % 3 = 0 THEN 'O' ELSE CASE l_partkey % 5 WHEN 0 THEN 'B-a' WHEN 1 THEN 'I-a' WHEN 2 THEN 'I-b' WHEN 3 THEN 'B-b' ELSE 'O' END END",
            "score": "l_discount * 10",
        },
    ),
}


def _text(c: str) -> str:
    return f"CAST({c} AS VARCHAR(20))"


def _money(cents: str, thousands: bool = False) -> str:
    """Cents as d.dd, or as d,ddd.dd."""
    whole, rest = f"CAST(floor(({cents}) / 100) AS BIGINT)", f"lpad({_text(f'({cents}) % 100')}, 2, '0')"
    if thousands:
        return f"{_text(f'CAST(floor(({cents}) / 100000) AS BIGINT)')} || ',' || lpad({_text(f'{whole} % 1000')}, 3, '0') || '.' || {rest}"
    return f"{_text(whole)} || '.' || {rest}"


def _letter(*parts: str) -> str:
    return " || ".join(parts)


_BREAK, _COUNT, _CENTS = "chr(10)", "(100 + o_custkey % 300)", "(1001 + (o_orderkey * 7919 + o_custkey * 31) % 8999)"
_SUM = f"{_COUNT} * {_CENTS}"
_CODE, _TARIFF = "'ZX-' || CAST(o_custkey % 900 + 100 AS VARCHAR(20))", "CAST(73260000 + o_custkey % 9000 AS VARCHAR(20))"
_A, _B, _Q, _P, _PLAIN, _GROUPED = f"{_CODE} || '-A'", f"{_CODE} || '-B'", _text(_COUNT), _money(_CENTS), _money(_SUM), _money(_SUM, True)
_MORE = _money(f"({_SUM} + CAST(floor({_SUM} / 10) AS BIGINT))", True)
_ITEM = _letter(_A, "' '", _Q, "' PCS '", _P, "' '", _PLAIN)
_WEIGHED = {x: _letter(x, "' '", _Q, "' KGS '", _P) for x in (_A, _B)}
_REMARKS = f"{_BREAK} || 'first remark' || {_BREAK} || 'second remark' || {_BREAK} || 'third remark' || {_BREAK}"
#: Letters of each kind: the ways in which an invoice gives an item's count, price and amount.
_INVOICE_KINDS = (
    _ITEM, _WEIGHED[_A], _letter(_A, "' oak panel '", _Q, "' '", _P, "' '", _GROUPED), _letter(_A, "' '", _GROUPED, _BREAK, _Q), _letter(_A, "' '", _Q, "' '", _GROUPED), _letter(_A, "' '", _Q, _BREAK, "'at '", _P, "' each'"),
    _letter(_A, "' 1200x600x750 '", _Q), _letter(_A, "' costs '", _P, "' makes '", _GROUPED), _letter(_Q, "' '", _GROUPED, _BREAK, _A), _letter(_A, _BREAK, "'sturdy oak desk'", _BREAK, _Q, "' '", _P, _BREAK, _GROUPED),
    _letter(_WEIGHED[_A], _REMARKS, _GROUPED), _letter(_ITEM, _BREAK, "'goods hs '", _TARIFF), _letter(_ITEM, _BREAK, _B, _BREAK, "'at '", _P, "' each'"), _letter(_A, _BREAK, "'priced '", _P, _BREAK, _GROUPED),
    _letter(_ITEM, _BREAK, _B, _BREAK, "'sum '", _GROUPED), _letter(_WEIGHED[_A], _BREAK, _WEIGHED[_B], _REMARKS, _MORE, _BREAK, _GROUPED),
)
_WEIGHT, _KILO = "(100 + o_custkey % 899)", "(100 + (o_orderkey * 31 + o_custkey) % 900)"
_PAID = f"{_WEIGHT} * {_KILO}"
_W, _K, _USD = _text(_WEIGHT), _money(_KILO), f"'USD' || {_money(_PAID)}"
_GOODS_KINDS = (
    _letter("'rubber rolls '", _W, "' KGS '", _USD), _letter("'net '", _W, "' KGS'", _BREAK, "'nylon '", _USD), _letter("'cotton '", _W, "' KGS at '", _K, "' USD/kg '", _USD),
    _letter("'CORD '", _W, "' KGS '", _USD, _BREAK, "'again '", _W, "' KGS USD'", _money(f"({_PAID} + 50)")), _letter("'list of goods'", _BREAK, "'SYNTHETIC RUBBER'", _BREAK, _W, "' KGS '", _USD), _letter("'16231000'", _W, "' INE Sugar refined 250 1.234,50'"),
)


def _kinds(kinds: tuple[str, ...], last: str = "") -> str:
    return f"(CASE o_orderkey % {len(kinds)} {' '.join(f'WHEN {k} THEN {t}' for k, t in enumerate(kinds))} END){last}"


_LONG = "lpad(CAST(1 + o_custkey % 99 AS VARCHAR(20)), 2, '0') || lpad(CAST(o_orderkey * 37 % 1000000 AS VARCHAR(20)), 6, '0')"
_SHORT = "lpad(CAST(1 + o_orderkey % 97 AS VARCHAR(20)), 2, '0') || lpad(CAST(o_orderkey % 10000 AS VARCHAR(20)), 4, '0')"
_MAKER = "'STEEL WORKS Q' || chr(65 + CAST(o_orderkey % 26 AS INTEGER)) || ' LIMITED'"
_TAKER = "'PT Maju ' || CAST(o_custkey AS VARCHAR(20))"
_BILL_KINDS = (
    _letter(_MAKER, _BREAK, "'Consignee'", _BREAK, _TAKER, _BREAK, "'end'"),
    _letter("'Shipper'", _BREAK, _MAKER, _BREAK, "'Old road 5 Korea'", _BREAK, "'repeated line of words Consignee: '", _TAKER, _BREAK, "'end'"),
    _letter(_MAKER, _BREAK, "repeat('filler line' || chr(10), 60)", "'NON-NEGOTIABLE'", _BREAK, _TAKER, _BREAK, "'end'"),
    _letter("'Consignee nobody here'", _BREAK, _MAKER, "' 12 Seoul Korea'"),
)
_LABELS = ("seller_name", "seller_address", "shipper_name", "shipper_address", "bl_number", "total_net_weight", "vessel_name", "invoice_number", "strange")
VIEWS |= {
    "v_invoices": ("orders", {"doc_id": "o_orderkey", "kind": "o_orderkey % 16", "count": _COUNT, "price": _P, "plain": _PLAIN, "amount": _GROUPED, "more": _MORE, "code": _CODE, "tariff": _TARIFF, "text": _kinds(_INVOICE_KINDS, f" || {_BREAK} || 'end of list'")}),
    "v_goods_letters": ("orders", {"doc_id": "o_orderkey", "kind": "o_orderkey % 6", "weight": _WEIGHT, "price": _K, "plain": _money(_PAID), "text": _kinds(_GOODS_KINDS)}),
    "v_spans": ("orders", {"page_id": "o_orderkey", "kind": "o_orderkey % 3", "text": "'ref ' || CAST(o_custkey AS VARCHAR(20)) || ' vessel ' || CASE o_orderkey % 3 WHEN 0 THEN 'EVER GIVEN' WHEN 1 THEN 'EVER GIVN' ELSE 'SHIP ONE' END || ' from NINGBO on ' || CASE o_orderkey % 3 WHEN 0 THEN 'FINIS' ELSE 'end' END"}),
    "v_bills": ("orders", {"doc_id": "o_orderkey", "kind": "o_orderkey % 4", "maker": _MAKER, "taker": _TAKER, "text": _kinds(_BILL_KINDS)}),
    "v_header_values": (
        "lineitem",
        {
            "doc_id": "l_orderkey",
            "doc_type": "CASE l_suppkey % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'BL' ELSE 'PL' END",
            "label": f"CASE l_partkey % {len(_LABELS)} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_LABELS))} END",
            "value": "CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'v' || CAST(l_partkey AS VARCHAR(20)) END",
        },
    ),
    "v_tariff_letters": ("orders", {"doc_id": "o_orderkey", "long": _LONG, "short": _SHORT, "text": _letter("'Goods hs '", _LONG, "'.'", _BREAK, "repeat('word ', 60)", _SHORT, "' '", "repeat('word ', 12)", "'account 7326909'")}),
}


#: Rows of a part at most, and at least where there are fewer parts than twice the cores.
MOST_ROWS, LEAST_ROWS = 200_000, 2_000
#: Rows of a part at most where long letters are made of them and their lines are sorted.
MOST_LETTERS = 50_000


def parts(rows: DataFrame, most: int | None = None) -> int:
    """In how many parts rows are dealt, so that a part doesn't grow with the table."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(-(-n // (most or MOST_ROWS)), min(2 * cores, -(-n // LEAST_ROWS)), 1)


def dealt(rows: DataFrame, *keys: Column, most: int | None = None) -> DataFrame:
    """rows in parts by their keys. A file of one row group is one task otherwise, whatever is made of its rows."""
    return rows.repartition(parts(rows, most), *keys)


def letters(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(doc_id, text) of several views of one table, each document of the k-th with the id doc_id * (number of views) + k; dealt by it before texts are made."""
    columns = [VIEWS[n][1] for n in names]
    rows = load(spark, sf_dir, VIEWS[names[0]][0])
    rows = rows.select(*[c for c in rows.columns if any(re.search(rf"\b{c}\b", v[e]) for v in columns for e in ("doc_id", "text"))], F.explode(F.array(*map(F.lit, range(len(names))))).alias("_k"))
    pick = lambda c: F.coalesce(*[F.when(F.col("_k") == k, F.expr(v[c])) for k, v in enumerate(columns)])
    rows = dealt(rows.withColumn("_id", pick("doc_id") * len(names) + F.col("_k")), F.col("_id"), most=MOST_LETTERS)
    return rows.select(F.col("_id").alias("doc_id"), pick("text").alias("text"))


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None, most: int | None = None) -> DataFrame:
    """A view of the tables. Where by names a column, the base rows are dealt by it before texts are made of them, most to a part, and what is done by that column needs no other shuffle."""
    base, columns = VIEWS[name]
    rows = load(spark, sf_dir, base)
    if by:
        used = [c for c in rows.columns if any(re.search(rf"\b{c}\b", e) for e in columns.values())]
        rows = dealt(rows.select(*used), F.expr(columns[by]), most=most)
    return rows.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def sql(*names: str) -> str:
    """WITH clause (without a trailing comma) that defines the views for DuckDB."""
    parts = []
    for n in names:
        base, columns = VIEWS[n]
        parts.append(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {base})")
    return "WITH " + ", ".join(parts)
