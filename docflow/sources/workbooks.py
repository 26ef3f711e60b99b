"""Workbooks of declarations: their sheets as rows, the values that users look up in them, and workbooks of rows.

Files are read by Spark, whatever the store, one row a file; a task reads a file's sheets as XML, row by row. A file that is no
workbook gives a row with an error.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the file format: name spaces, and the built-in formats of numbers that are dates.
MAIN, LINKS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_C, _V, _IS, _T = f"{MAIN}c", f"{MAIN}v", f"{MAIN}is", f"{MAIN}t"
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
ROWS = "file string, sheet string, row bigint, cells map<string, struct<text: string, empty: boolean>>, error string"
#: Bytes of a sheet that is read at once, rows and bytes that are handed on together.
SMALL, ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 1000, 4 << 20
#: Bytes of a sheet at most that is kept where it has only headings, as many do, and how many are kept.
SHARED, KEPT = 1 << 14, 256
_CELL = pa.struct([("text", pa.string()), ("empty", pa.bool_())])


@lru_cache(maxsize=1 << 14)
def _column(reference: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _said(element: ElementTree.Element) -> str:
    """The text of a string, without readings in other scripts."""
    return "".join(t.text or "" for part in element if part.tag != f"{MAIN}rPh" for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def _number(text: str, dated: bool, start: datetime) -> tuple[str, bool]:
    value = float(text)
    if dated:
        day = start + timedelta(milliseconds=round(value * 86_400_000))
        return str(day if value >= 1 else day.time()), False
    return (str(int(text)) if re.fullmatch(r"[+-]?[0-9]+", text) else repr(value)), value == 0


#: The records of a packed file: of a part, of a part in the directory, and the last.
_LOCAL, _ENTRY, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")


def _directory(content: bytes) -> dict[str, tuple[int, ...]] | None:
    """(place, end, flags, method, check sum, packed bytes, bytes) of each part by name. None for a file that isn't as plain as most are, which zipfile reads."""
    if len(content) < _END.size:
        return None
    sign, disk, first, here, n, size, start, said = _END.unpack_from(content, last := len(content) - _END.size)
    if sign != b"PK\5\6" or disk or first or here != n or said or start + size != last:
        return None
    found, at, ends = [], start, []
    for _ in range(n):
        if at + _ENTRY.size > last:
            return None
        sign, _, needs, flags, method, _, _, check, packed, plain, named, extra, said, _, _, _, place = _ENTRY.unpack_from(content, at)
        name = content[at + _ENTRY.size : at + _ENTRY.size + named]
        odd = extra or said or needs & 255 > 63 or flags & 0x61 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or not name.isascii() or b"\0" in name
        if sign != b"PK\1\2" or odd or (found and place <= found[-1][1]):
            return None
        found.append((name.decode("ascii"), place, flags, method, check, packed, plain))
        ends.append(place)
        at += _ENTRY.size + named
    ends.append(start)
    return {f[0]: (f[1], e, *f[2:]) for f, e in zip(found, ends[1:], strict=True)} if at == last else None


class _File:
    """The parts of a packed file. Small parts of a plain file are unpacked in one step, all others by zipfile."""

    def __init__(self, content: bytes):
        self.content, self.zip, self.parts = content, None, _directory(content)
        if self.parts is None:
            self.parts = {n: (i.header_offset, -1, i.flag_bits, i.compress_type, i.CRC, i.compress_size, i.file_size) for n, i in self.opened().NameToInfo.items()}

    def opened(self) -> zipfile.ZipFile:
        self.zip = self.zip or zipfile.ZipFile(io.BytesIO(self.content))
        return self.zip

    def packed(self, name: str) -> bytes:
        """A part with the record before it."""
        at, _, _, _, _, packed, _ = self.parts[name]
        return self.content[at : at + _LOCAL.size + sum(struct.unpack_from("<2H", self.content, at + 26)) + packed]

    def read(self, name: str) -> bytes:
        at, end, _, method, check, packed, plain = self.parts[name]
        own = self.packed(name)
        if plain <= SMALL and at + len(own) <= end and own[:4] == b"PK\3\4" and own[_LOCAL.size :].startswith(name.encode()) and struct.unpack_from("<H", own, 26)[0] == len(name):
            data = own[len(own) - packed :]
            data = data if method == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(data, plain + 1)
            if len(data) == plain and zlib.crc32(data) == check:
                return data
        return self.opened().read(name)


class _Part:
    """A part of a file that is not unpacked yet. Parts of other files with the same packed bytes are equal to it, so what is made of one serves all."""

    def __init__(self, file: _File, name: str):
        self.file, self.name, self.key = file, name, (name, file.parts[name][1] < 0, *file.parts[name][2:], file.packed(name))

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Part) and self.key == other.key

    def root(self) -> ElementTree.Element:
        found = ElementTree.fromstring(self.file.read(self.name))
        self.file = None  # one that is kept doesn't hold its file
        return found


_BARE: dict[_Part, ElementTree.Element] = {}


def _sheet_root(sheet: _Part) -> ElementTree.Element:
    """A sheet parsed; one of headings alone is kept for other files. Others would only fill the memory, as they seldom come again."""
    if (root := _BARE.get(sheet)) is None:
        root = sheet.root()
        if len(list(islice(root.iter(f"{MAIN}row"), 2))) < 2 and len(_BARE) < KEPT:
            _BARE[sheet] = root
    return root


@lru_cache(maxsize=64)
def _book(content: _Part, links: _Part) -> tuple[datetime, dict[str, str]]:
    """The day from which dates count, and the place of each sheet by name; workbooks of one program share them."""
    book = content.root()
    kind = book.find(f"{MAIN}workbookPr")
    start = datetime(1904, 1, 1) if kind is not None and kind.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target") for r in links.root()}
    place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return start, {s.get("name"): place(targets[s.get(f"{LINKS}id")]) for s in book.iter(f"{MAIN}sheet")}


@lru_cache(maxsize=64)
def _dated(content: _Part) -> list[bool]:
    """Whether a cell of each style is a date."""
    styles = content.root()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in styles.iter(f"{MAIN}numFmt")}
    formats = styles.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in (formats if formats is not None else ())]
    return [i in DATE_FORMATS or bool(re.search("[dmyhs]", own.get(i, ""), re.I)) for i in ids]


class Workbook:
    """Sheets of a workbook file by name."""

    def __init__(self, content: bytes):
        self.file = _File(content)
        part = lambda name: _Part(self.file, name)
        self.start, self.sheets = _book(part("xl/workbook.xml"), part("xl/_rels/workbook.xml.rels"))
        self.strings = [_said(s) for s in ElementTree.fromstring(self.file.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in self.file.parts else []
        self.dated = _dated(part("xl/styles.xml")) if "xl/styles.xml" in self.file.parts else []

    def _value(self, cell: ElementTree.Element) -> tuple[str, bool] | None:
        """(text, whether it counts as empty) of a cell, None for a blank one."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            said = cell.find(_IS)
            if said is None:
                return None
            text = said[0].text or "" if len(said) == 1 and said[0].tag == _T else _said(said)
            return text, not text
        value = cell.find(_V)
        if value is None or value.text is None:
            return None
        if kind == "s":
            return (text := self.strings[int(value.text)]), not text
        if kind == "b":
            return ("True", False) if value.text == "1" else ("False", True)
        if kind in ("str", "e", "d"):
            return value.text, not value.text
        style = int(cell.get("s") or 0)
        return _number(value.text, style < len(self.dated) and self.dated[style], self.start)

    def _row(self, e: ElementTree.Element) -> list[tuple[str, bool] | None]:
        row: list[tuple[str, bool] | None] = []
        for cell in e.iter(_C):
            at = _column(r) if (r := cell.get("r")) else len(row)
            if at >= len(row):
                row += [None] * (at + 1 - len(row))
            row[at] = self._value(cell)
        return row

    def rows(self, sheet: str) -> Iterator[list[tuple[str, bool] | None]]:
        """The rows of a sheet; a small one is read at once."""
        place = self.sheets[sheet]
        if (size := self.file.parts[place][-1]) <= SMALL:
            root = _sheet_root(_Part(self.file, place)) if size <= SHARED else ElementTree.fromstring(self.file.read(place))
            yield from map(self._row, root.iter(f"{MAIN}row"))
            return
        with self.file.opened().open(place) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}row":
                    yield self._row(e)
                    e.clear()


def _rows(content: bytes) -> Iterator[tuple[str, int, list[str], list[tuple[str, bool] | None]]]:
    """(sheet, row, headings, cells) of the rows of all sheets; rows without a value but zeros and empty texts are left out."""
    book = Workbook(content)
    for sheet in book.sheets:
        heads, n = None, 0
        for row in book.rows(sheet):
            if heads is None:
                heads = [v[0].strip() if v and not v[1] else "" for v in row]
            elif any(v and not v[1] for v in row):
                yield sheet, n, heads, row
                n += 1


def _records(file: str, content: bytes) -> Iterator[dict]:
    """The rows of all sheets under their headings; of columns of the same heading the last counts."""
    try:
        for sheet, n, heads, row in _rows(content):
            cells = dict.fromkeys(heads) | {h: {"text": v[0], "empty": v[1]} if v else None for h, v in zip(heads, row)}  # noqa: B905
            yield {"file": file, "sheet": sheet, "row": n, "cells": list(cells.items()), "error": None}
    except Exception as e:  # whatever is wrong with a file is told in its row
        yield {"file": file, "sheet": None, "row": None, "cells": None, "error": f"{type(e).__name__}: {e}"[:200]}


def sheet_rows(files: DataFrame) -> DataFrame:
    """(file, sheet, row, cells, error) of files (file, content): the rows under the headings of each sheet, from 0, cells by heading. Null contents give an error."""
    schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), _CELL)), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                for r in _records(batch.column("file")[k].as_py(), batch.column("content")[k].as_py() or b""):
                    held.append(r)
                    if len(held) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select(F.col("file").cast("string").alias("file"), "content").mapInArrow(run, ROWS)


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return sheet_rows(found.select(F.col("path").alias("file"), "content"))


# values ------------------------------------------------------------------------------------------------------------

#: Codes of parties and documents, and (value, column) of each sheet; dates are cut to their day.
PARTY_CODES = {"9": "seller", "1": "buyer", "7": "shipper", "11": "consignee", "4": "notify_party"}
PAPER_CODES = {"380": "invoice", "860": "bl"}
FIRST_ROWS = {"PENGANGKUT": (("vessel_name", "NAMA PENGANGKUT"), ("voyage_number", "NOMOR PENGANGKUT")), "KEMASAN": (("number_of_packages", "JUMLAH KEMASAN"), ("packaging_type", "KODE KEMASAN"))}
ALL_ROWS = {
    "KONTAINER": (("container_numbers", "NOMOR KONTINER"), ("seal_numbers", "NOMOR SEGEL")),
    "BARANG": (
        ("item_hs_code", "HS"), ("item_description", "URAIAN"), ("item_quantity", "JUMLAH SATUAN"), ("item_unit", "KODE SATUAN"), ("item_unit_price", "HARGA SATUAN"), ("item_amount", "FOB"), ("item_net_weight", "NETTO"), ("item_gross_weight", "BRUTO"),
    ),
}
HEADER_VALUES = (
    ("currency", "KODE VALUTA"), ("incoterms", "KODE INCOTERM"), ("total_amount", "FOB"), ("freight", "FREIGHT"), ("total_gross_weight", "BRUTO"), ("total_net_weight", "NETTO"), ("port_of_loading", "KODE PELABUHAN MUAT"),
    ("port_of_discharge", "KODE PELABUHAN BONGKAR"), ("country_of_origin", "KODE ASAL BARANG"),
)


def _cell(column: str) -> Column:
    """The trimmed text of a cell, null where it is empty or zero."""
    c = F.col("cells")[column]
    return F.when(~c["empty"], F.nullif(F.trim(c["text"]), F.lit("")))


def workbook_values(rows: DataFrame) -> DataFrame:
    """(file, entity, row, value) of rows of sheet_rows: parties and papers by the first row of their code, transport and packages by the first row, containers and goods by all, header fields by the first row that has them."""
    code = lambda column: F.trim(F.coalesce(F.when(~F.col("cells")[column]["empty"], F.col("cells")[column]["text"]), F.lit("")))
    party = F.when(code("KODE ENTITAS").rlike("^[+-]?[0-9]+$"), code("KODE ENTITAS").try_cast("int").cast("string"))
    kind = F.when(F.col("sheet") == "ENTITAS", party).when(F.col("sheet") == "DOKUMEN", code("KODE DOKUMEN"))
    held = rows.where("error is null").withColumn("kind", kind).withColumn("n", F.row_number().over(W.partitionBy("file", "sheet", "kind").orderBy("row")))
    value = lambda name, c: F.struct(F.lit(name).alias("entity"), c.alias("value"))
    of = F.array().cast("array<struct<entity: string, value: string>>")
    parts = []
    for k, name in PARTY_CODES.items():
        parts.append(((F.col("sheet") == "ENTITAS") & (F.col("kind") == k) & (F.col("n") == 1), [value(f"{name}_name", _cell("NAMA ENTITAS")), value(f"{name}_address", _cell("ALAMAT ENTITAS"))]))
    for k, name in PAPER_CODES.items():
        parts.append(((F.col("sheet") == "DOKUMEN") & (F.col("kind") == k) & (F.col("n") == 1), [value(f"{name}_number", _cell("NOMOR DOKUMEN")), value(f"{name}_date", F.substring(_cell("TANGGAL DOKUMEN"), 1, 10))]))
    parts += [((F.col("sheet") == s) & (F.col("n") == 1), [value(e, _cell(c)) for e, c in values]) for s, values in FIRST_ROWS.items()]
    parts += [(F.col("sheet") == s, [value(e, _cell(c)) for e, c in values]) for s, values in ALL_ROWS.items()]
    whole = lambda c: F.nullif(F.trim(F.col("cells")[c]["text"]), F.lit(""))  # noqa: E731  a header's zero counts
    parts.append((F.col("sheet") == "HEADER", [value(e, whole(c)) for e, c in HEADER_VALUES]))
    for test, values in parts:
        of = F.when(test, F.array(*values)).otherwise(of)
    found = held.select("file", "sheet", "row", F.inline(of)).where("value is not null")
    first = F.row_number().over(W.partitionBy("file", "sheet", "entity").orderBy("row"))
    return found.withColumn("n", first).where("sheet <> 'HEADER' or n = 1").select("file", "entity", "row", "value")


def _filled(cells: dict[str, tuple[str, bool] | None], column: str) -> str | None:
    """As _cell."""
    v = cells.get(column)
    return v[0].strip(" ") or None if v and not v[1] else None


def _looked_up(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(entity, row, value) of a file, row by row, as workbook_values finds them in its rows."""
    seen: set[str | tuple[str, str]] = set()  # sheets, codes and header fields of which the first row has come
    for sheet, n, heads, row in _rows(content):
        cells = dict(zip(heads, row))  # noqa: B905
        values: list[tuple[str, str | None]] = []
        if sheet == "HEADER":
            for e, c in HEADER_VALUES:
                if e not in seen and (v := cells.get(c)) and (text := v[0].strip(" ")):
                    seen.add(e)
                    values.append((e, text))
        elif sheet in ALL_ROWS:
            values = [(e, _filled(cells, c)) for e, c in ALL_ROWS[sheet]]
        elif sheet in FIRST_ROWS:
            if sheet not in seen:
                seen.add(sheet)
                values = [(e, _filled(cells, c)) for e, c in FIRST_ROWS[sheet]]
        elif sheet == "ENTITAS":
            code = re.fullmatch(r"\+?0*([1-9][0-9]*)(?:\r\n|\n|\r)?", _filled(cells, "KODE ENTITAS") or "")
            name = code and PARTY_CODES.get(code[1])
            if name and (sheet, name) not in seen:
                seen.add((sheet, name))
                values = [(f"{name}_name", _filled(cells, "NAMA ENTITAS")), (f"{name}_address", _filled(cells, "ALAMAT ENTITAS"))]
        elif sheet == "DOKUMEN":
            name = PAPER_CODES.get(_filled(cells, "KODE DOKUMEN") or "")
            if name and (sheet, name) not in seen:
                seen.add((sheet, name))
                values = [(f"{name}_number", _filled(cells, "NOMOR DOKUMEN")), (f"{name}_date", (_filled(cells, "TANGGAL DOKUMEN") or "")[:10] or None)]
        for e, v in values:
            if v is not None:
                yield e, n, v


def file_values(files: DataFrame) -> DataFrame:
    """(file, entity, row, value) of files (file, content), each of another name: the rows of workbook_values(sheet_rows(files)), looked up while a file is read, so that only values leave its task."""
    schema = pa.schema([("file", pa.string()), ("entity", pa.string()), ("row", pa.int64()), ("value", pa.string())])

    def upto_fault(found: Iterator) -> Iterator:
        try:
            yield from found
        except Exception:  # what comes before the fault of a file counts; sheet_rows tells the fault
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        held: list[tuple[str, str, int, str]] = []
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                for entity, n, value in upto_fault(_looked_up(content.as_py() or b"")):
                    held.append((file, entity, n, value))
                    if len(held) == ROWS_AT_ONCE:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return files.select(F.col("file").cast("string").alias("file"), "content").mapInArrow(run, "file string, entity string, row bigint, value string")


# writing -------------------------------------------------------------------------------------------------------------

_TYPES = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _row_xml(columns: list[tuple[str, str]], row: dict, n: int, style: str = "") -> str:
    cell = lambda c, v: f'<c r="{c}{n}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", v))}</t></is></c>'
    return f'<row r="{n}">{"".join([cell(c, v) for c, h in columns if (v := row.get(h)) is not None])}</row>'


@lru_cache(maxsize=256)
def _headed(columns: tuple[str, ...]) -> tuple[list[tuple[str, str]], str]:
    """Columns with their letters, and a sheet up to its bold row of headings."""
    lettered = [(_letters(k), h) for k, h in enumerate(columns)]
    return lettered, f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{_row_xml(lettered, dict(zip(columns, columns, strict=True)), 1, ' s="1"')}'


def _sheet(columns: list[str], rows: list[dict]) -> str:
    """The XML of a sheet: a bold row of headings and its rows."""
    lettered, head = _headed(tuple(columns))
    return f"{head}{''.join([_row_xml(lettered, r, n) for n, r in enumerate(rows, 2)])}</sheetData></worksheet>"


def _write(z: zipfile.ZipFile, name: str, body: str) -> None:
    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _XML + body)


def _frame(layout: dict[str, list[str]]) -> bytes:
    """What all workbooks of a layout share, as a file: all parts but the sheets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(layout) + 1))
        _write(z, "[Content_Types].xml", f'<Types xmlns="{_TYPES}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        _write(z, "_rels/.rels", f'<Relationships xmlns="{_TYPES}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(layout) + 1))
        _write(z, "xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_TYPES}/relationships">{links}<Relationship Id="s" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        sheets = "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(layout, 1))
        _write(z, "xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>')
        _write(z, "xl/styles.xml", f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
    return out.getvalue()


def _workbook(frame: bytes, layout: dict[str, list[str]], rows: dict[str, list[dict]], made: frozenset[str] = frozenset()) -> bytes:
    """A workbook with the sheets of the layout in order, each with a bold row of headings and its rows; values of other columns are left out. made are the sheets that the frame has already."""
    _, _, _, _, n, size, at, _ = _END.unpack_from(frame, len(frame) - _END.size)
    parts, entries = [frame[:at]], [frame[at : at + size]]
    for k, (sheet, columns) in enumerate(layout.items(), 1):
        if sheet in made:
            continue
        name, body = f"xl/worksheets/sheet{k}.xml".encode(), (_XML + _sheet(columns, rows.get(sheet, []))).encode()
        press = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        packed = press.compress(body) + press.flush()
        about = (20, 0, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(body), len(packed), len(body), len(name), 0)  # of the first day that the format knows, as in _write
        parts += [_LOCAL.pack(b"PK\3\4", *about), name, packed]
        entries += [_ENTRY.pack(b"PK\1\2", 20 | 3 << 8, *about, 0, 0, 0, 0o600 << 16, at), name]
        at, n = at + _LOCAL.size + len(name) + len(packed), n + 1
    directory = b"".join(entries)
    return b"".join([*parts, directory, _END.pack(b"PK\5\6", 0, 0, n, n, len(directory), at, 0)])


def written(rows: DataFrame, layout: dict[str, list[str]], key: str = "id", parts: int | None = None) -> DataFrame:
    """(file, content): a workbook for each key of rows (key, sheet, row, cells), cells a map of texts by column. Sheets without rows have only headings; sheets and columns that the layout lacks are left out. Rows are small and workbooks costly, so parts says in how many parts keys are dealt."""
    known = F.map_from_arrays(F.lit(list(layout)), F.array(*[F.lit(c) for c in layout.values()]))
    kept = rows.where(F.col("sheet").isin(*layout)).select(F.col(key).cast("string").alias("file"), "sheet", "row", F.map_filter("cells", lambda c, _: F.array_contains(known[F.col("sheet")], c)).alias("cells"))
    grouped = (kept.repartition(parts, "file") if parts else kept).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("sheet", "row", F.map_entries("cells").alias("cells")))).alias("rows"))

    frame = _frame(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sheets that have only headings are packed once for all workbooks without rows of them.
        framed = lru_cache(maxsize=256)(lambda bare: _workbook(frame, layout, {}, frozenset(layout) - bare))
        for batch in batches:
            books, size, start = [], 0, 0
            # The arrays within arrays are read one after another, as plain lists.
            sheet, _, cells = batch.column("rows").flatten().flatten()
            sheets, widths, pairs = iter(sheet.to_pylist()), iter(pc.list_value_length(cells).to_pylist()), zip(*[c.to_pylist() for c in cells.flatten().flatten()], strict=True)
            for k, n in enumerate(pc.list_value_length(batch.column("rows")).to_pylist()):
                own: dict[str, list[dict]] = {}
                for s, width in zip(islice(sheets, n), islice(widths, n), strict=True):
                    own.setdefault(s, []).append(dict(islice(pairs, width)))
                bare = frozenset(s for s in layout if s not in own)
                books.append(_workbook(framed(bare), layout, own, bare))
                size += len(books[-1])
                if size >= BYTES_AT_ONCE or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("file").slice(start, len(books)), pa.array(books, pa.binary())], ["file", "content"])
                    books, size, start = [], 0, k + 1

    return grouped.mapInArrow(run, "file string, content binary")
