"""Workbook ingestion (survey A3): the first sheet of every ``.xlsx`` file.

Many workbooks are read in parallel: ``binaryFile`` lists the files, a
``mapInPandas`` step unpacks each one (an .xlsx file is a zip of XML parts;
only the standard library is used) into cell rows ``(path, row, col, text)``,
and the sheet is pivoted back into columns by Spark.  Date-formatted numeric
cells are converted from spreadsheet serial days to ISO dates; the columns are
then typed like CSV text.  Legacy binary ``.xls`` is not supported.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.roles import parse_columns

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Built-in spreadsheet number formats that display dates.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = datetime(1899, 12, 30)
CELL_SCHEMA = "path string, row long, col int, text string"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", NS)
    rid = sheet.get(f"{{{NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("rel:Relationship", NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    st = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in st.findall("m:numFmts/m:numFmt", NS)}
    out = set()
    for i, xf in enumerate(st.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        code = custom.get(fid, "").lower()
        if fid in DATE_FORMAT_IDS or (code and re.search(r"[dy]", re.sub(r'"[^"]*"', "", code))):
            out.add(i)
    return out


def workbook_cells(path: str, content: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
    dates = _date_styles(z)
    sheet = ET.fromstring(z.read(_first_sheet(z)))
    out = []
    for row in sheet.iter(f"{{{NS['m']}}}row"):
        r = int(row.get("r"))
        for c in row.findall("m:c", NS):
            t = c.get("t", "n")
            v = c.find("m:v", NS)
            if t == "inlineStr":
                text = "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t"))
            elif v is None:
                continue
            elif t == "s":
                text = shared[int(v.text)]
            elif t == "b":
                text = "true" if v.text == "1" else "false"
            else:
                text = v.text
                if t == "n" and int(c.get("s", "0")) in dates:
                    text = (EPOCH + timedelta(days=float(text))).isoformat(sep=" ")
            out.append((path, r, _col_index(c.get("r")), text))
    return out


def read_workbooks(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """First sheet of every workbook under ``path`` (file, folder or glob) as one table
    (plus ``_source`` = file path).  All workbooks must share the header row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def unpack(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                rows.extend(workbook_cells(p, bytes(content)))
            yield pd.DataFrame(rows, columns=["path", "row", "col", "text"])

    cells = files.select("path", "content").mapInPandas(unpack, CELL_SCHEMA)
    first_row = cells.groupBy("path").agg(F.min("row").alias("_r0"))
    cells = cells.join(first_row, "path")
    # header names: one small row per column (bounded by the number of columns)
    names = {}
    if header:
        for r in cells.where(F.col("row") == F.col("_r0")).groupBy("col").agg(F.min("text").alias("name")).collect():
            names[int(r["col"])] = r["name"]
        body = cells.where(F.col("row") > F.col("_r0"))
    else:
        body = cells
        for r in cells.select("col").distinct().collect():
            names[int(r["col"])] = f"col{int(r['col'])}"
    order = sorted(names)
    wide = body.groupBy(F.col("path").alias("_source"), "row").pivot("col", order).agg(F.first("text"))
    wide = wide.select("_source", *[F.col(f"`{i}`").alias(names[i]) for i in order], F.col("row").alias("_row"))
    return parse_columns(wide, columns=[names[i] for i in order])
