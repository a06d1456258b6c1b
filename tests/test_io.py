"""Sources, sinks and strict-JSON encoding on small written fixtures."""
import json
import math
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkseries.functions.jsonsafe import json_safe, to_json_rows
from sparkseries.operators import roles
from sparkseries.sources.files import json_lines_report, read_csv, read_json, read_table
from sparkseries.sources.inline import explode_points, from_points
from sparkseries.sources.workbooks import read_workbooks


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="sparkseries-io-"), name)


def test_csv_typing_with_na_tokens(spark):
    p = _tmp("t.csv")
    with open(p, "w") as f:
        f.write("date,value,label,count\n2023-01-01,100,a,1\n2023-01-02,NA,b,2\n2023-01-03,110.5,c,3\n")
    df = read_table(spark, p)
    types = dict(df.dtypes)
    assert types["value"] == "double" and types["count"] == "bigint" and types["label"] == "string"
    assert types["date"] == "timestamp_ntz"
    assert df.where(F.col("value").isNull()).count() == 1


def test_unsupported_extension(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/x/data.xls")


def test_json_column_oriented(spark):
    p = _tmp("c.json")
    with open(p, "w") as f:
        json.dump({"date": {"0": "2023-01-01", "1": "2023-01-02"}, "value": {"0": 1.5, "1": 2.5}}, f)
    df = read_json(spark, p, orient="columns")
    rows = sorted((str(r["date"].date()), r["value"]) for r in df.collect())
    assert rows == [("2023-01-01", 1.5), ("2023-01-02", 2.5)]


def test_json_records_array(spark):
    p = _tmp("r.json")
    with open(p, "w") as f:
        json.dump([{"date": "2023-01-01", "value": 1}, {"date": "2023-01-02", "value": 2}], f)
    assert read_table(spark, p).count() == 2


GOOD = [f'{{"id": {i}, "v": {i}.5, "s": "a, b"}}' for i in range(60)]
FILES = {
    "bad first": (["{\"id\": 1, ", "", "nonsense"] * 20 + GOOD, 60, 40),
    "array by line": (["["] + [x + "," for x in GOOD[:-1]] + [GOOD[-1], "]"], 60, 0),
    "array on one line": (["[" + ", ".join(GOOD) + "]"], 60, 0),
    "pretty": (json.dumps([json.loads(x) for x in GOOD], indent=2).split("\n"), 60, 0),
    "one pretty object": (json.dumps(json.loads(GOOD[3]), indent=1).split("\n"), 1, 0),
    "lines": (["\ufeff" + GOOD[0], *GOOD[1:]], 60, 0),
}


@pytest.mark.parametrize("name", FILES)
def test_json_record_by_record(spark, name):
    lines, rows, bad = FILES[name]
    p = _tmp("r.json")
    with open(p, "w") as f:
        f.write("\n".join(lines))
    got = read_table(spark, p).collect()
    assert len(got) == rows and all(r["v"] == r["id"] + 0.5 and r["s"] == "a, b" for r in got)
    assert json_lines_report(spark, p).first()["bad"] == bad


def test_json_folder_of_mixed_files(spark):
    folder = os.path.dirname(_tmp("x"))
    folder = os.path.join(folder, "mixed.json")
    os.makedirs(folder)
    for i, (lines, _, _) in enumerate(FILES.values()):
        with open(os.path.join(folder, f"part {i}.json"), "w") as f:
            f.write("\n".join(lines))
    assert read_table(spark, folder).count() == sum(rows for _, rows, _ in FILES.values())
    assert read_table(spark, folder, schema="id long").where("id = 3").count() == len(FILES)


def test_json_columns_with_gaps(spark):
    """Any column may lack an index, and indices need no order."""
    p = _tmp("c.json")
    with open(p, "w") as f:
        json.dump({"a": {"2": 1.5}, "b": {"0": "x", "7": None}}, f)
    got = sorted((r["_index"], r["a"], r["b"]) for r in read_json(spark, p, orient="columns").collect())
    assert got == [(0, None, "x"), (2, 1.5, None), (7, None, None)]


def test_csv_with_breaks_in_quotes(spark):
    p = _tmp("q.csv")
    with open(p, "w") as f:
        f.write('id,s\n1,"a\nb"\n2,"c ""d"""\n')
    assert [(r["id"], r["s"]) for r in read_csv(spark, p, quoted_breaks=True).collect()] == [(1, "a\nb"), (2, 'c "d"')]


def _xlsx(path, rows):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    strings = []
    cells = []
    for r, row in enumerate(rows, start=1):
        cs = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                strings.append(v)
                cs.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif isinstance(v, tuple):  # (serial, date style)
                cs.append(f'<c r="{ref}" s="1"><v>{v[0]}</v></c>')
            else:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(cs)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/'
                   'officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/'
                   '2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_workbooks(spark):
    d = tempfile.mkdtemp(prefix="sparkseries-xlsx-")
    _xlsx(os.path.join(d, "a.xlsx"), [["date", "value"], [(44927, 1), 10], [(44928, 1), 11]])
    _xlsx(os.path.join(d, "b.xlsx"), [["date", "value"], [(44929, 1), 12]])
    df = read_workbooks(spark, d)
    assert dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["date"] == "timestamp_ntz"
    assert sorted(str(r["date"].date()) for r in df.collect()) == ["2023-01-01", "2023-01-02", "2023-01-03"]


def test_inline_points_strict_and_lenient(spark):
    pts = [{"date": "2023-01-01", "value": 1}, {"date": "2023-01-02", "value": 2}]
    assert from_points(spark, pts).count() == 2
    bad = spark.createDataFrame([("s", json.dumps(pts + [{"date": "nope", "value": 3}]))], "s string, payload string")
    rows, counts = explode_points(bad, "payload", "s", strict=False)
    assert rows.count() == 2 and counts.first()["bad_points"] == 1
    strict_rows, _ = explode_points(bad, "payload", "s", strict=True)
    with pytest.raises(Exception):
        strict_rows.collect()


def test_json_safe_torture(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, 2.5, nan, inf, -inf, [1.0, nan, inf], {"k": nan, "j": 1.0}, (nan, (inf, 3.0)))],
        "i int, d double, n double, pinf double, ninf double, arr array<double>, m map<string,double>, "
        "st struct<a:double, b:struct<c:double, d:double>>")
    r = json_safe(df).first()
    assert r["n"] is None and r["pinf"] is None and r["ninf"] is None and r["d"] == 2.5
    assert r["arr"] == [1.0, None, None] and r["m"]["k"] is None and r["m"]["j"] == 1.0
    assert r["st"]["a"] is None and r["st"]["b"]["c"] is None and r["st"]["b"]["d"] == 3.0
    doc = json.loads(to_json_rows(df).first()["json"])
    assert doc["n"] is None and doc["arr"] == [1.0, None, None]
    assert not any(isinstance(v, float) and (math.isnan(v) or math.isinf(v)) for v in doc["arr"] if v is not None)


def test_resolve_time_never_casts_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    _, t = roles.resolve_time_column(df)
    assert t is None
    with pytest.raises(ValueError):
        roles.numeric_columns(spark.createDataFrame([("x",)], "s string"))
