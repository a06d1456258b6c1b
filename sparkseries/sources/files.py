"""File readers and writers (survey A1, A2, A5, A6, A7).

Readers accept a file, a directory or a glob, so one call ingests many files in
parallel; writers are distributed (one file per partition, no collect).
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.roles import parse_columns
from ..session import ensure_checkpoint_dir

SUPPORTED = {".csv": "csv", ".json": "json", ".jsonl": "json", ".xlsx": "workbook", ".parquet": "parquet"}


# ---------------------------------------------------------------- A1
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = True, quoted_breaks: bool = False) -> DataFrame:
    """Header row + typed columns.  Without a schema the text is typed by one aggregate
    pass (:func:`sparkseries.operators.roles.parse_columns`: NA tokens, int / double / time).

    ``quoted_breaks=True`` allows line breaks inside quotes; files are then not split."""
    reader = spark.read.option("header", True).option("multiLine", quoted_breaks).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", False).csv(path)
    return parse_columns(df) if infer else df


# ---------------------------------------------------------------- A2
def _lines(spark: SparkSession, path) -> DataFrame:
    """``(file, value, kind)`` of the lines that are not blank: ``record`` (a whole object, or a whole array
    on one line; a comma may follow), ``frame`` (a bracket that opens or ends an array, or a comma) or ``other``."""
    text = F.regexp_replace(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), r"[\s,]+$", "")
    whole = (F.when(text.startswith("{"), F.from_json(text, "map<string,string>").isNotNull())
             .when(text.startswith("["), F.from_json(text, "array<map<string,string>>").isNotNull()).otherwise(False))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").withColumn(
        "kind", F.when(whole, "record").when(text.isin("[", "]", ""), "frame").otherwise("other"))


def json_lines_report(spark: SparkSession, path: str) -> DataFrame:
    """Per file: ``records``, ``bad`` lines, and whether it is read as a ``document`` (no line of it is a
    record, so its values span lines) rather than line by line."""
    per = _lines(spark, path).groupBy("file").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("record", "other")])
    document = F.col("record") == 0
    return per.select("file", document.alias("document"), F.col("record").alias("records"), F.when(document, 0).otherwise(F.col("other")).alias("bad"))


def _records(spark: SparkSession, files, schema) -> DataFrame:
    """Every record line of ``files`` parsed on its own; lines that are none are left out."""
    lines = _lines(spark, files).where("kind = 'record'").select(F.regexp_replace("value", r"\s*,\s*$", "").alias("value"))
    if schema is None:
        found = spark.read.option("columnNameOfCorruptRecord", BAD).json(files).schema
        schema = T.StructType([f for f in found if f.name != BAD])
    elif not isinstance(schema, T.StructType):
        schema = T.StructType.fromDDL(schema)
    # an object counts as an array of one
    return lines.select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r")).where("r is not null").select("r.*")


BAD = "__sparkseries_bad_record"


def read_json(spark: SparkSession, path: str, orient: str = "records", lines: bool | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """Records (JSON lines, arrays of objects) or column-oriented ``{col: {idx: val}}``.

    Records are found line by line, whatever the file is called: a line that is a whole object or a
    whole array counts, any other line is left out and counted by :func:`json_lines_report`.  Files
    without a record line hold values that span lines and are read as documents, file by file, so a
    folder may mix both.  ``lines=True`` / ``False`` takes all files one way without looking.

    Column-oriented input is one row per (column, index), then one row per index of any column; with
    ``lines=True`` every line is a document of its own."""
    if orient == "columns":
        return _columns(spark, path, bool(lines))
    if orient != "records":
        raise ValueError("orient must be 'records' or 'columns'")
    reader = spark.read.option("mode", "DROPMALFORMED") if schema is None else spark.read.schema(schema)
    if lines is not None:
        return reader.option("multiLine", not lines).json(path)
    files = json_lines_report(spark, path).select("file", "document").collect()  # names only, as Spark keeps them too
    by_line, whole = ([unquote(f) for f, d in files if d == is_document] for is_document in (False, True))
    if not whole:
        return _records(spark, by_line or path, schema)
    documents = reader.option("multiLine", True).json(whole)
    return documents if not by_line else _records(spark, by_line, schema).unionByName(documents, allowMissingColumns=True)


def _columns(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``(_index, <columns>)``: every index that any column has; values missing in a column are NULL."""
    raw = spark.read.option("wholetext", not lines).text(path)
    maps = raw.select(F.monotonically_increasing_id().alias("document"), F.from_json("value", "map<string,map<string,string>>").alias("m")).where("m is not null")
    cells = maps.select("document", F.explode("m").alias("column", "cells")).select("document", "column", F.explode("cells").alias("index", "value"))
    cols = [r[0] for r in cells.select("column").distinct().collect()]  # one name per column
    first = maps.select(F.map_keys("m").alias("k")).first()
    cols.sort(key=lambda c: first["k"].index(c) if first and c in first["k"] else len(cols))
    wide = cells.groupBy("document", F.col("index").cast("bigint").alias("_index")).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols]).drop("document")
    return parse_columns(wide, columns=cols)


# ---------------------------------------------------------------- A5
def read_table(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Pick the reader from the lower-cased extension; anything else is unsupported."""
    ext = os.path.splitext(str(path).rstrip("/"))[1].lower()
    kind = SUPPORTED.get(ext)
    if kind is None:
        raise ValueError(f"Unsupported file format {ext or '(none)'}; supported: {sorted(SUPPORTED)}")
    if kind == "csv":
        return read_csv(spark, path, **kw)
    if kind == "json":
        return read_json(spark, path, **kw)
    if kind == "parquet":
        return spark.read.parquet(path)
    from .workbooks import read_workbooks
    return read_workbooks(spark, path, **kw)


# ---------------------------------------------------------------- A6 / A7
def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Whole table as JSON records (one object per row, NULLs kept), one file per partition."""
    from ..functions.jsonsafe import json_safe
    json_safe(df).write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_result_csv(df: DataFrame, folder: str, result_id: str, kind: str, mode: str = "overwrite") -> str:
    """Results exported as ``{folder}/{id}_{kind}`` (CSV with header)."""
    from ..functions.jsonsafe import json_safe
    out = f"{folder.rstrip('/')}/{result_id}_{kind}"
    json_safe(df).write.mode(mode).option("header", True).csv(out)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sparkseries-io/{name}-{uuid.uuid4().hex[:12]}"
