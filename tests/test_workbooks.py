"""Workbooks that are written, read again, and what is looked up in them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docflow.sources import workbooks as B

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def made(sheet: str, shared: str = "", styles: str = "", book: str = "") -> bytes:
    """A file as other programs write it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{book}<sheets><sheet name="HEADER" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return out.getvalue()


def rows_of(content: bytes) -> list[dict]:
    return [{k: v and (v["text"], v["empty"]) for k, v in r["cells"]} for r in B._records("f", content)]


def test_cells():
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><r><t>KODE </t></r><r><t>X</t></r></is></c><c r="D1" t="str"><v>D</v></c><c r="E1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2"><v>5</v></c><c r="B2"><v>0</v></c><c r="D2" s="1"><v>45000.5</v></c><c r="E2" t="b"><v>1</v></c><c r="F2"><v>9</v></c></row>'
        '<row r="3"><c r="A3"><v>0</v></c><c r="B3" t="inlineStr"><is><t></t></is></c></row><row r="4"/><row r="5"><c r="D5" s="2"><v>2.50</v></c><c r="B5" t="e"><v>#N/A</v></c></row>'
    )
    styles = '<numFmts><numFmt numFmtId="170" formatCode="&quot;day&quot;0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
    got = rows_of(made(sheet, "<si><t> NAME </t></si>", styles))
    # of two columns NAME the last counts; the row of zeros and empty texts is left out; F has no heading
    assert got == [{"NAME": ("True", False), "KODE X": ("0", True), "": None, "D": ("2023-03-15 12:00:00", False)}, {"NAME": None, "KODE X": ("#N/A", False), "": None, "D": ("2.5", False)}]
    assert rows_of(made('<row r="1"><c r="A1" t="str"><v>D</v></c></row><row r="2"><c r="A2" s="1"><v>1</v></c></row>', "", styles, '<workbookPr date1904="1"/>'))[0]["D"][0] == "1904-01-02 00:00:00"


LAYOUT = {"HEADER": ["KODE VALUTA", "FOB", "FREIGHT"], "ENTITAS": ["KODE ENTITAS", "NAMA ENTITAS", "ALAMAT ENTITAS"], "DOKUMEN": ["KODE DOKUMEN", "NOMOR DOKUMEN", "TANGGAL DOKUMEN"], "KONTAINER": ["NOMOR KONTINER", "NOMOR SEGEL"], "VERSI": ["VERSI"]}


@pytest.fixture(scope="module")
def rows(spark):
    cells = [
        (1, "HEADER", 0, {"FOB": "12.5", "KODE VALUTA": " "}), (1, "HEADER", 1, {"FOB": "13", "KODE VALUTA": "USD", "UNKNOWN": "x"}), (1, "ENTITAS", 0, {"KODE ENTITAS": "x9", "NAMA ENTITAS": "none"}),
        (1, "ENTITAS", 1, {"KODE ENTITAS": "9", "NAMA ENTITAS": "ACME & <Sons>\n ü "}), (1, "ENTITAS", 2, {"KODE ENTITAS": "9", "NAMA ENTITAS": "second"}), (1, "DOKUMEN", 0, {"KODE DOKUMEN": "380", "NOMOR DOKUMEN": "A\x00B", "TANGGAL DOKUMEN": "2026-01-05 00:00:00"}),
        (1, "KONTAINER", 0, {"NOMOR KONTINER": "OOLU1", "NOMOR SEGEL": ""}), (1, "KONTAINER", 1, {"NOMOR KONTINER": "OOLU2", "NOMOR SEGEL": "S2"}), (1, "ELSEWHERE", 0, {"VERSI": "1"}), (2, "VERSI", 0, {"VERSI": "1.3"}),
    ]
    return spark.createDataFrame(cells, "id long, sheet string, row long, cells map<string, string>")


def test_round_trip(spark, rows, tmp_path):
    files = B.written(rows, LAYOUT).collect()
    for f in files:
        (tmp_path / "deep").mkdir(exist_ok=True)
        (tmp_path / "deep" / f"{f['file']}.xlsx").write_bytes(f["content"])
        assert list(B.Workbook(f["content"]).sheets) == list(LAYOUT)
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    (tmp_path / "other.txt").write_bytes(b"")
    found = B.workbooks(spark, str(tmp_path))
    errors = [r["file"].rsplit("/", 1)[-1] for r in found.where("error is not null").collect()]
    assert errors == ["broken.xlsx"]
    texts = {(r["file"].rsplit("/", 1)[-1], r["sheet"], r["row"]): {k: v["text"] for k, v in r["cells"].items() if v} for r in found.where("error is null").collect()}
    assert texts["1.xlsx", "ENTITAS", 1] == {"KODE ENTITAS": "9", "NAMA ENTITAS": "ACME & <Sons>\n ü "} and texts["1.xlsx", "HEADER", 1] == {"FOB": "13", "KODE VALUTA": "USD"}
    assert texts["2.xlsx", "VERSI", 0] == {"VERSI": "1.3"} and len(texts) == 9
    got = {(r["entity"], r["row"], r["value"]) for r in B.workbook_values(found).where(F.col("file").endswith("/1.xlsx")).collect()}
    assert got == {
        ("currency", 1, "USD"), ("total_amount", 0, "12.5"), ("seller_name", 1, "ACME & <Sons>\n ü"), ("invoice_number", 0, "AB"), ("invoice_date", 0, "2026-01-05"), ("container_numbers", 0, "OOLU1"),
        ("container_numbers", 1, "OOLU2"), ("seal_numbers", 1, "S2"),
    }


def test_nothing(spark, rows):
    assert B.written(rows.limit(0), LAYOUT).count() == 0
    empty = spark.createDataFrame([("a", None)], "file string, content binary")
    assert [r["error"] is not None for r in B.sheet_rows(empty).collect()] == [True] and B.workbook_values(B.sheet_rows(empty)).count() == 0


def test_workbooks_are_handed_on_together_and_dealt_by_their_keys(spark):
    rows = spark.range(300).selectExpr("id", "'G' as sheet", "0L as row", "map('A', string(id)) as cells")
    files = B.written(rows, {"G": ["A"]}, parts=7)
    assert files.selectExpr("spark_partition_id() as p").distinct().count() == 7
    said = B.sheet_rows(files).selectExpr("file", "cells['A'].text as a").collect()
    assert len(said) == 300 and all(r.file == r.a for r in said)


def test_small_and_large_sheets_read_alike(monkeypatch):
    layout, rows = {"G": ["A", "B"]}, {"G": [{"A": "1", "B": "x"}, {"B": "y & z"}]}
    content = B._workbook(B._frame(layout), layout, rows)
    small = list(B._records("f", content))
    monkeypatch.setattr(B, "SMALL", 0)
    assert small == list(B._records("f", content)) and len(small) == 2


ODD = ["9", "+9", "009", "9\n", " 9 ", "9 1", "x9", "-9", "0", "1", "99999999999", "", None, "١", "4"]


def test_values_are_the_same_while_files_are_read(spark):
    """Looking up a file's values as it is read gives what the rows of all files give, also where they are odd or end in a fault."""
    layout = {
        "HEADER": ["KODE VALUTA", "FOB", "FREIGHT"], "ENTITAS": ["KODE ENTITAS", "NAMA ENTITAS", "ALAMAT ENTITAS"], "DOKUMEN": ["KODE DOKUMEN", "NOMOR DOKUMEN", "TANGGAL DOKUMEN"], "PENGANGKUT": ["NAMA PENGANGKUT", "NOMOR PENGANGKUT"],
        "KEMASAN": ["JUMLAH KEMASAN", "KODE KEMASAN"], "KONTAINER": ["NOMOR KONTINER", "NOMOR SEGEL"], "BARANG": ["HS", "URAIAN", "NETTO"], "VERSI": ["VERSI"],
    }
    texts, rows = ["a", " b ", "", "\t", None, "2026-01-05 00:00:00", "ü\n"], []
    for k in range(40):
        for sheet, columns in layout.items():
            for n in range((k * 7 + len(sheet)) % 6):
                code = lambda c, n=n, k=k: ODD[(k + 5 * n) % len(ODD)] if c == "KODE ENTITAS" else ["380", " 860 ", "860", "x", None][(k + n) % 5]
                rows.append((k, sheet, n, {c: code(c) if c in ("KODE ENTITAS", "KODE DOKUMEN") else texts[(k * 3 + n * 5 + j) % len(texts)] for j, c in enumerate(columns)}))
    files = B.written(spark.createDataFrame(rows, "id long, sheet string, row long, cells map<string, string>"), layout)
    cell = lambda r, t, v, s="": f'<c r="{r}"{s} t="{t}"><v>{v}</v></c>'
    zeros = f'<row r="1">{cell("A1", "str", "FOB")}{cell("B1", "str", "FOB")}{cell("C1", "str", "KODE VALUTA")}</row><row r="2"><c r="A2"><v>0</v></c>{cell("C2", "str", "USD")}</row><row r="3"><c r="A3"><v>0</v></c><c r="B3"><v>7</v></c></row>'
    fault = zeros + '<row r="4"><c r="A4" t="s"><v>5</v></c></row>'
    others = spark.createDataFrame([("zeros", made(zeros)), ("fault", made(fault)), ("none", None), ("text", b"no workbook")], "file string, content binary")
    every = files.unionByName(others)
    wanted, got = (sorted(map(tuple, found.collect())) for found in (B.workbook_values(B.sheet_rows(every)), B.file_values(every)))
    assert got == wanted and len(wanted) > 200 and {"zeros", "fault"} <= {r[0] for r in wanted} and len({r[1] for r in wanted}) > 20


def test_round_trip_sorts_no_rows_of_files(spark):
    plan = entry.queries()["workbook_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map<string,struct" not in plan and "kind" not in plan and plan.count("MapInArrow") == 2


def test_sheets_of_equal_bytes_are_parsed_once():
    layout = {"G": ["A"], "H": ["B"]}
    contents = [B._workbook(B._frame(layout), layout, {"G": [{"A": str(k)}]}) for k in range(5)]
    B._BARE.clear()
    assert [rows_of(c) for c in contents] == [[{"A": (str(k), False)}] for k in range(5)]
    assert len(B._BARE) == 1 and all(p.file is None for p in [B._Part(B._File(contents[0]), "xl/workbook.xml")] if p.root() is not None)
    # another check sum with the same packed bytes is no equal part
    broken = bytearray(contents[0])
    at = broken.index(b"xl/worksheets/sheet1.xml") - 16
    broken[at] ^= 1
    end = broken.rindex(b"xl/worksheets/sheet1.xml") - 30
    broken[end] ^= 1
    assert [r["error"] is not None for r in B._records("f", bytes(broken))] == [True]


def test_files_are_as_zipfile_reads_and_writes_them():
    layout, rows = {"G": ["A", "Ü & <"], "H": ["B"]}, {"G": [{"A": "1" * 3000, "Ü & <": "x"}, {"A": None}]}
    content = B._workbook(B._frame(layout), layout, rows)
    other = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(other, "w") as o:
        assert z.testzip() is None and len(z.namelist()) == 7 and {i.date_time for i in z.infolist()} == {(1980, 1, 1, 0, 0, 0)}
        for n in z.namelist():
            o.writestr(n, z.read(n))
        o.comment = b"of another program"
    assert B._directory(content) is not None and B._directory(other.getvalue()) is None
    assert list(B._records("f", content)) == list(B._records("f", other.getvalue())) and len(list(B._records("f", content))) == 1
    for cut in (b"", b"PK", content[:-1], content[:50] + content[60:], b"x" + content):
        plain = None
        try:
            plain = zipfile.ZipFile(io.BytesIO(cut)).read("xl/worksheets/sheet1.xml")
        except Exception:
            pass
        assert (plain is None) == (list(B._records("f", cut))[-1]["error"] is not None)
