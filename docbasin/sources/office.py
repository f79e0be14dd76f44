"""Word and Excel files as pages and rows, read from their XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbasin.operators.registry import numbered
from docbasin.session import stored
from docbasin.sources.files import named_cells, sniff

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_pages(data: bytes, per_page: int = 10) -> list[str]:
    """Paragraphs with text, ten a page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = [p for p in ("".join(t.text or "" for t in node.iter(f"{W}t")).strip() for node in root.iter(f"{W}p")) if p]
    return ["\n\n".join(paragraphs[i : i + per_page]) for i in range(0, len(paragraphs), per_page)]


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows of cell texts of each sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = targets[sheet.get(f"{R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{S}row"):
                cells: list[str] = []
                for c in row.iter(f"{S}c"):
                    at = 0
                    for letter in (x for x in c.get("r", "") if x.isalpha()):
                        at = at * 26 + ord(letter.upper()) - 64
                    value = c.find(f"{S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    text = shared[int(text)] if c.get("t") == "s" and text else text
                    cells += [""] * (at - 1 - len(cells)) + [text]
                rows.append(cells)
            out.append((sheet.get("name"), rows))
    return out


def office_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, section, text of .docx and .xlsx files below a folder; a sheet is one page of `a | b` lines."""
    def pages(name: str, data: bytes) -> list[str]:
        try:
            if name.lower().endswith(".docx"):
                return docx_pages(data)
            sheets = [(n, [" | ".join(c for c in row if c.strip()) for row in rows]) for n, rows in xlsx_sheets(data)]
            return [f"[Sheet: {n}]\n" + "\n".join(r for r in rows if r) for n, rows in sheets if any(rows)]
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
            return []

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(p, i, t) for p, data in zip(b["path"], b["content"], strict=True) for i, t in enumerate(pages(p, data))], columns=["path", "section", "text"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx}").load(path)
    return raw.select("path", "content").mapInPandas(run, "path string, section int, text string")


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row (from 1), cells of the .xlsx files below a folder; a file that is none has no rows."""

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, name, i, row) for name, sheet in xlsx_sheets(data) for i, row in enumerate(sheet, 1) if any(c.strip() for c in row)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return raw.select("path", "content").mapInPandas(run, "path string, sheet string, row long, cells array<string>")


def sheet_tables(spark: SparkSession, path: str) -> dict[tuple[str, str], DataFrame]:
    """(path, sheet) -> the sheet as a table of texts with __row_number, below the header that its first 30 rows show."""
    rows = stored(sheet_rows(spark, path), "sheet-rows")
    first = Window.partitionBy("path", "sheet").orderBy("row")
    heads: dict[tuple[str, str], list] = {}
    for r in rows.withColumn("k", F.row_number().over(first)).where("k <= 30").orderBy("path", "sheet", "row").collect():  # 30 rows a sheet
        heads.setdefault((r.path, r.sheet), []).append(r)
    out = {}
    for (p, sheet), head in heads.items():
        at = sniff([], [list(r["cells"]) for r in head])[1]
        names = [n.strip() or f"column_{i + 1}" for i, n in enumerate(head[at]["cells"])]
        own = rows.where((F.col("path") == p) & (F.col("sheet") == sheet) & (F.col("row") > head[at].row))
        out[p, sheet] = numbered(named_cells(own, names, ["row"]), ["row"]).drop("row")
    return out
