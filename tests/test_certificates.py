"""Goods of certificates, told line by line."""

import pandas as pd

from docflow.operators import certificates as C

SCHEMA = "doc_id bigint, pos bigint, line string"


def _lines(spark, text, doc=1):
    return spark.createDataFrame([(doc, k, line) for k, line in enumerate(text)], SCHEMA)


def test_sections(spark):
    text = [
        "4 before any section", "HS CODE: 8415.20", "Jouter box N/M", "TOTAL 5", None, "7", "1,250 PIECES", "8 desk PE 40 PIECES", "", "", "9 of Annex 3", "32", "7 again",
        "hs code - 9999", "10", "x" * 81, "11", "1 " + "y" * 300,
    ]
    found = {r["number"]: (r["hs_code"], r["quantity"], r["description"], r["bm"], r["found"]) for r in C.section_goods(_lines(spark, text)).collect()}
    assert found == {
        7: ("841520", "1250", "OUTER box", 10.0, True),  # the nearest line above that describes goods
        8: ("841520", "1250", "desk", 10.0, True),  # the first pieces near it, which stand a line before
        10: ("9999", "", "", 0.0, False),
        11: ("9999", "", "10", 0.0, False),  # a number is a line like another
        1: ("9999", "", "y" * 200, 0.0, False),
    }


def test_lines(spark):
    text = [
        "3 chair, oak 94036010 PC 1,250.50", "N/M 560392 53944.0000 035 USD", "PEX", "3 again 94036010 PC", "frame 847130", "no unit", None, "N/M lamp 940510 KG", "4 table 847130 0.5",
        "101 bench 940360 PC", "2 x 850000 12.75 EUR", "TEL: 560392", "5 desk 012345 PC", "6 sofa 12345 678901 cut USD 9.5 CNY 8.5 EUR SGD", "7 rest 2.5 of 678901 cut USD 9.5 CNY 8.5 EUR SGD",
    ]
    rows = C.line_goods(_lines(spark, text)).collect()
    assert {r["number"]: (r["hs_code"], r["quantity"], r["unit"], r["description"]) for r in rows} == {
        3: ("940360", "1250.50", "PC", "chairoak"),  # commas go with the digits
        2: ("560392", "53944.0000", "PE", ""),  # the next free number, so the line of a later 2 goes
        4: ("940510", "", "KG", ""),
        6: ("678901", "", "", "sofa"),  # numbers after the first of four currencies don't count
        7: ("678901", "2.5", "", "rest of"),
    }
    assert len(rows) == 5


def test_numbers():
    frame = pd.DataFrame({"pos": range(6), "hs_code": "1", "number": pd.array([None, 3, None, 3, None, 2], dtype="Int64")})
    assert list(C._numbered(frame)["number"]) == [1, 3, 4, 5, 2]  # the second 3 goes; a free number starts at the count of those used, and 3 and 4 are taken


def test_odd(spark):
    none = _lines(spark, ["x"]).limit(0)
    assert C.section_goods(none).count() == 0 and C.line_goods(none).count() == 0
    two = _lines(spark, ["HS CODE: 8471", "1 desk 847130 PC"]).unionByName(_lines(spark, ["HS CODE: 8471", "1 desk 847130 PC"], 2)).selectExpr("*", "'x' AS number", "1 AS code")
    assert C.section_goods(two).count() == 2 and C.line_goods(two).count() == 2  # other columns don't matter
    long = _lines(spark, ["HS CODE: 8471", "1 " + "desk " * 200_000])
    assert C.section_goods(long).first()["description"] == ("desk " * 40)[:200]


def test_lines_of_a_document_are_numbered_in_one_batch_of_documents(spark):
    rows = [(d, k, line) for d in range(50) for k, line in enumerate(("3 Chair 940360 PC 2.5", "3 Table 940360 PC 3.5", "Desk 940310 PC 4.5"))]
    goods = C.line_goods(spark.createDataFrame(rows, "doc_id bigint, pos bigint, line string"))
    assert "FlatMapGroupsInPandas" not in goods._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.number) for r in goods.collect()) == [(d, n) for d in range(50) for n in (2, 3)]
