"""Parties of bills, supplied fields, merged headers."""

import pytest

from docflow.operators import parties as P

FAR = "filler line of words\n" * 45
BILLS = {
    "ACME STEEL CORPORATION\nFloor 5, CHINA\nShipper\nConsignee\nPT. Maju Jaya CO., LTD\nsomething": {("shipper_name", "ACME STEEL CORPORATION", 0.80), ("shipper_name", "Maju Jaya CO", 0.80), ("country_of_origin", "CHINA", 0.85), ("consignee_name", "PT. Maju Jaya CO", 0.82)},
    # no line is longer than the caption is far from the start, so lines after it count too; the carrier and captions are no shippers; a company whose address follows is one without them
    "ORIGINAL FREIGHT LTD\nBLUE OCEAN SHIPPING CO\nmore GREEN RIVER TRADING LIMITED\nJL. Raya 5 Consignee nobody": {("shipper_name", "more GREEN RIVER TRADING LIMITED", 0.80)},
    "Consignee: here\nBANGKOK THAILAND GOLD RIVER LIMITED\n5 Sukhumvit": {("shipper_name", "BANGKOK THAILAND GOLD RIVER LIMITED", 0.78), ("country_of_origin", "THAILAND", 0.85)},
    FAR + "non-negotiable\nPT Sinar Abadi LTD": {("notify_party_name", "PT Sinar Abadi LTD", 0.82)},
    FAR + "non-negotiable SAME AS CONSIGNEE PT Sinar Abadi": {("consignee_name", "PT Sinar Abadi", 0.82)},
    "non-negotiable\nPT Sinar Abadi": set(),  # too early
    "Consignee " + "x" * 500 + " PT Maju Jaya": set(),  # too far
    "Buyer " + "x" * 40 + " Importer " + "y" * 370 + " PT Maju Jaya": {("consignee_name", "PT Maju Jaya", 0.82)},  # near the second caption only
    "": set(),
}


@pytest.mark.parametrize("text", BILLS, ids=lambda t: repr(t[:30]))
def test_bills(spark, text):
    found = P.bill_parties(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert {(r["label"], r["value"], r["confidence"]) for r in found} == BILLS[text]


def test_supplied(spark):
    texts = [
        (1, "CI", "INVOICE 5\nshort\n12 Road\nGREEN RIVER TRADE 2026-01-05\nBuyer: PT MAJU JAYA\nDATE 1"), (2, "CI", "a/b long enough\nJL. Raya five\nCODE X: y\nA/B TRADE.CO"),
        (3, "PL", "x\n total 5 boxes 1,200 1,350.5\nTOTAL 900 950"), (4, "PL", "TOTAL 90 950"), (5, "BL", "GREEN RIVER TRADE\nTOTAL 900 950"), (6, "CI", None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, doc_type string, text string")
    got = {(r["doc_id"], r["label"], r["value"]) for r in P.supplied(docs).collect()}
    assert got == {(1, "seller_name", "GREEN RIVER TRADE"), (1, "buyer_name", "PT MAJU JAYA"), (2, "seller_name", "A/B TRADE.CO"), (3, "total_net_weight", "1200.00"), (3, "total_gross_weight", "1350.50")}
    own = [(1, "seller_name", "SELLER / NAME", 0.69), (1, "seller_name", "Real-1", 0.1), (1, "buyer_name", "x1", 0.72), (2, "seller_name", "x-1", 0.66), (3, "total_net_weight", "7", 0.99), (5, "other", "kept", 0.5)]
    merged = P.with_supplied(spark.createDataFrame(own, "doc_id long, label string, value string, confidence double"), docs).collect()
    assert {(r["doc_id"], r["label"], r["value"]) for r in merged} == {(1, "seller_name", "GREEN RIVER TRADE"), (1, "buyer_name", "x1"), (2, "seller_name", "x-1"), (3, "total_net_weight", "1200.00"), (3, "total_gross_weight", "1350.50"), (5, "other", "kept")}


def test_merged_header(spark):
    rows = [
        (1, "BL", "shipper_name", "S"), (1, "BL", "shipper_address", "SA"), (1, "CI", "seller_address", "own"), (1, "BL", "consignee_name", "C"), (1, "CI", "buyer_name", "B"), (1, "CI", "bl_number", ""), (1, "BL", "bl_number", "N"),
        (1, "PL", "total_net_weight", "5"), (1, "CI", "total_net_weight", "6"), (1, "BL", "total_net_weight", "7"), (1, "PL", "invoice_number", "no"), (2, "XX", "currency", "USD"), (2, "CI", "strange", "1"),
    ]
    got = {tuple(r) for r in P.merged_header(spark.createDataFrame(rows, "doc_id long, doc_type string, label string, value string")).collect()}
    own = {"shipper_name": "S", "shipper_address": "SA", "seller_name": "S", "seller_address": "SA", "consignee_name": "C", "buyer_name": "B", "bl_number": "N", "total_net_weight": "6"}
    assert got == {(1, k, v) for k, v in own.items()}


def test_weights(spark):
    items = spark.createDataFrame([(1, "ID-5", None, ""), (1, "HD-6", "4", None), (1, "ID-7", None, None), (2, "HD-5", None, None), (1, None, None, None)], "doc_id long, item_code string, net_weight string, gross_weight string")
    weights = spark.createDataFrame([(1, "HD-5", 200, 300), (1, "HD-6", 210, 310), (1, "ID-7", 220, 320)], "doc_id long, code string, net_weight long, gross_weight long")
    got = {(r["doc_id"], r["item_code"], r["net_weight"], r["gross_weight"]) for r in P.with_weights(items, weights).collect()}
    assert got == {(1, "ID-5", "200", "300"), (1, "HD-6", "4", "310"), (1, "ID-7", "220", "320"), (2, "HD-5", None, None), (1, None, None, None)}
