"""Cells of .xlsx workbooks as rows, with nothing but the standard library.

``spark.read.format("xlsx_cells").load(folder or file)`` gives one row per cell that
has a value, merged spans filled with their anchor's value: workbook, sheet,
sheet_no, row, col, value (text), value_kind (number, text, boolean), cell_format.  Each
file is one input partition.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "workbook string, sheet string, sheet_no int, `row` int, col int, value string, value_kind string, cell_format string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the built-in formats that matter here.
_BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}
_EPOCH = dt.date(1899, 12, 30)


def is_date_format(pattern: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", pattern.lower())
    return bool(re.search(r"[dy]|mmm", bare))


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def read_cells(path: str) -> Iterator[tuple]:
    """The cells of one workbook, in sheet and row order."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name))
        shared = [_texts(s) for s in xml("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        formats: list[str] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
            formats = [own.get(i := int(x.get("numFmtId", 0)), _BUILT_IN.get(i, "General")) for x in styles.findall("m:cellXfs/m:xf", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        workbook = os.path.basename(path)
        for number, sheet in enumerate(xml("xl/workbook.xml").findall("m:sheets/m:sheet", _NS), 1):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = xml(target if target.startswith("xl/") else f"xl/{target}")
            cells: dict[tuple[int, int], tuple[str, str, str]] = {}
            for c in root.iter(f"{{{_NS['m']}}}c"):
                kind, raw, style = c.get("t", "n"), c.find("m:v", _NS), int(c.get("s", 0))
                pattern = formats[style] if style < len(formats) else "General"
                if kind == "inlineStr":
                    value, shown = _texts(c), "text"
                elif raw is None or raw.text is None:
                    continue
                elif kind == "s":
                    value, shown = shared[int(raw.text)], "text"
                elif kind == "b":
                    value, shown = ("true" if raw.text == "1" else "false"), "boolean"
                elif kind in ("str", "e"):
                    value, shown = raw.text, "text"
                elif is_date_format(pattern):
                    value, shown = str(_EPOCH + dt.timedelta(days=int(float(raw.text)))), "date"
                else:
                    value, shown = raw.text, "number"
                if value != "":
                    cells[_place(c.get("r"))] = value, shown, pattern
            for span in root.findall("m:mergeCells/m:mergeCell", _NS):
                (r1, c1), (r2, c2) = map(_place, span.get("ref").split(":"))
                if (r1, c1) in cells:
                    for r in range(r1, r2 + 1):
                        for col in range(c1, c2 + 1):
                            cells.setdefault((r, col), cells[r1, c1])
            for (r, col), (value, shown, pattern) in sorted(cells.items()):
                yield workbook, sheet.get("name"), number, r, col, value, shown, pattern


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_cells(partition.value)


class XlsxCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxCells)
