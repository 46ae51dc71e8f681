"""Spectrum files: CSV through Spark's reader, minimal XLSX through the standard library."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionlake.functions.tables import axis_name

# Normalised headers of the axes.
AXES = {"amu": ("xamu", "mass", "amu"), "V": ("xv",), "um": ("xum",)}
FLOOR = 1e-3


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Spectrum of one CSV scan; see `choose`."""
    return choose(spark.read.option("header", True).csv(path).withColumn("_i", F.monotonically_increasing_id()))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """As read_csv, from the first sheet of a workbook."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    names, rows = sheet(bytes(content))
    ddl = ", ".join(f"`{n}` string" for n in names)
    return choose(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{ddl}, _i long"))


def choose(table: DataFrame) -> DataFrame:
    """(scan_id, pt, amu, v, um, m, counts) of a table of text columns and the row order _i.

    Axis columns are known by name; counts is the column of the largest range
    among the rest that has three numbers at least, found in one pass.  Missing
    counts and those under a thousandth are 0; m is the first axis there is, else
    the point's number.
    """
    names = [c for c in table.columns if c != "_i"]
    spark = table.sparkSession
    tidy = spark.range(1).select(*(axis_name(F.lit(n)).alias(f"c{i}") for i, n in enumerate(names))).first()
    axis = {kind: next((n for i, n in enumerate(names) if tidy[i] in known), None) for kind, known in AXES.items()}
    rest = [n for n in names if n not in axis.values() and n.lower() != "pt"]
    number = lambda n: F.trim(F.col(f"`{n}`")).try_cast("double")
    if not rest:
        raise ValueError("no counts column")
    filled = lambda n: F.coalesce(number(n), F.lit(0.0))
    stats = table.agg(*(F.when(F.count(number(n)) >= 3, F.max(filled(n)) - F.min(filled(n))).alias(f"r{i}") for i, n in enumerate(rest))).first()
    usable = [(stats[i], -i) for i in range(len(rest)) if stats[i] is not None]
    if not usable:
        raise ValueError("no counts column")
    counts = filled(rest[-max(usable)[1]])
    from pyspark.sql import Window

    point = F.row_number().over(Window.orderBy("_i")) - 1  # a scan is one small file
    held = table.select(point.alias("pt"), *((number(axis[k]) if axis[k] else F.lit(None).cast("double")).alias(k.lower()) for k in AXES), F.when(counts < FLOOR, 0.0).otherwise(counts).alias("counts"))
    first = next((k.lower() for k in AXES if axis[k]), None)
    return held.select(F.lit("scan").alias("scan_id"), "*", (F.col(first) if first else F.col("pt").cast("double")).alias("m"))


SCANS = "scan_id string, pt int, amu double, v double, um double, m double, counts double"


def read_scans(spark: SparkSession, folder: str, pattern: str = "*.{csv,xlsx}") -> DataFrame:
    """Spectra of all scan files of a folder, (scan_id, pt, amu, v, um, m, counts); scan_id is the file's path.

    A file is parsed by one task, which chooses its axes and counts by the rules
    of `choose`.  A file without a counts column gives no rows.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                names, rows = sheet(bytes(content)) if path.lower().endswith(".xlsx") else text_rows(bytes(content))
                found = chosen(names, rows)
                if found is not None:
                    yield pd.DataFrame({"scan_id": path, **found})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInPandas(run, SCANS)


def text_rows(content: bytes) -> tuple[list[str], list[tuple]]:
    """Header and rows of text of a CSV file; an empty cell is None."""
    lines = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"))) if r]
    names = [n or f"_c{k}" for k, n in enumerate(lines[0])] if lines else []
    return names, [tuple((r[k] or None) if k < len(r) else None for k in range(len(names))) for r in lines[1:]]


def tidy_name(name: str) -> str:
    """tables.axis_name of one name, outside Spark."""
    return re.sub("[() ]", "", name.lower().replace("µ", "u").replace("μ", "u"))


def _numbers(values: list[str | None]) -> np.ndarray:
    def one(v):
        try:
            return float(v) if v is not None and v.strip() else np.nan
        except ValueError:
            return np.nan

    return np.array([one(v) for v in values], float)


def chosen(names: list[str], rows: list[tuple]) -> dict[str, np.ndarray] | None:
    """Columns pt, amu, v, um, m and counts of one scan's text cells, by the rules of `choose`; None without a counts column."""
    columns = {n: _numbers([r[k] for r in rows]) for k, n in enumerate(names)}
    axis = {kind: next((n for n in names if tidy_name(n) in known), None) for kind, known in AXES.items()}
    usable = [n for n in names if n not in axis.values() and n.lower() != "pt" and np.count_nonzero(~np.isnan(columns[n])) >= 3]
    if not usable:
        return None
    counts = max((np.nan_to_num(columns[n]) for n in usable), key=np.ptp)
    pt = np.arange(len(rows))
    out = {"pt": pt, **{kind.lower(): columns[axis[kind]] if axis[kind] else np.full(len(rows), np.nan) for kind in AXES}}
    first = next((kind.lower() for kind in AXES if axis[kind]), None)
    return {**out, "m": out[first] if first else pt.astype(float), "counts": np.where(counts < FLOOR, 0.0, counts)}


def sheet(content: bytes) -> tuple[list[str], list[tuple]]:
    """Header and rows of text of a workbook's first sheet; shared, inline and plain cells."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strip = lambda e: e.tag.rsplit("}", 1)[-1]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if strip(t) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if strip(si) == "si"]
    first = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    rows: list[dict[int, str]] = []
    for row in (e for e in ElementTree.fromstring(book.read(first)).iter() if strip(e) == "row"):
        cells = {}
        for k, c in enumerate(e for e in row if strip(e) == "c"):
            value = "".join(t.text or "" for t in c.iter() if strip(t) in ("v", "t"))
            cells[column_number(c.get("r"), k)] = shared[int(value)] if c.get("t") == "s" and value else value
        rows.append(cells)
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    table = [tuple(r.get(k) or None for k in range(width)) for r in rows]
    names = [n or f"col{k}" for k, n in enumerate(table[0])] if table else []
    return names, table[1:]


def column_number(ref: str | None, default: int) -> int:
    """Column of a cell reference, A being 0."""
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1
