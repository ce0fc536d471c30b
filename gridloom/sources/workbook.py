"""Workbooks (.xlsx) as a Spark data source: cells in long form, with formulas, indentation and fills.

``spark.dataSource.register(Workbooks)``, then ``spark.read.format("workbook").load(path)``; ``path`` is a file, a folder or a
pattern that Python's ``glob`` expands on a file system that all executors have; each file is one partition. For other stores
``read_binary`` takes the files by Spark's own ``binaryFile`` reader.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet_id string, row int, col int, value string, formula string, indent int, fill string, bold boolean, outline int"
# The name spaces of the format.
_N = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _styles(book: zipfile.ZipFile) -> list[tuple[int, str | None, bool]]:
    """Indent, fill colour (``theme:<n>`` for the theme's) and bold font of each cell style."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    fills, out = [], []
    for x in root.findall("m:fills/m:fill", _N):
        f = x.find(".//m:fgColor", _N)
        fills.append(None if f is None else f.get("rgb") or (f"theme:{f.get('theme')}" if f.get("theme") else None))
    bold = [f.find("m:b", _N) is not None and f.find("m:b", _N).get("val", "1") != "0" for f in root.findall("m:fonts/m:font", _N)]
    for x in root.findall("m:cellXfs/m:xf", _N):
        a = x.find("m:alignment", _N)
        k, font = int(x.get("fillId", 0)), int(x.get("fontId", 0))
        out.append((int(a.get("indent", 0)) if a is not None else 0, fills[k] if k < len(fills) else None, font < len(bold) and bold[font]))
    return out


def cells_of(data: bytes, file: str) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of one workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.findall(".//m:t", _N)) for s in root.findall("m:si", _N)]
        styles = _styles(book)
        rels = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _N):
            with book.open(f"xl/{rels[sheet.get(_REL)]}") as f:
                outline = 0
                for event, c in ElementTree.iterparse(f, ("start", "end")):
                    if event == "start":
                        if c.tag == f"{{{_N['m']}}}row":
                            outline = int(c.get("outlineLevel", 0))
                        continue
                    if c.tag != f"{{{_N['m']}}}c":
                        continue
                    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    v, kind = c.findtext("m:v", None, _N), c.get("t")
                    if kind == "s" and v is not None:
                        v = shared[int(v)]
                    elif kind == "inlineStr":
                        v = "".join(t.text or "" for t in c.findall(".//m:t", _N))
                    formula = c.findtext("m:f", None, _N)
                    indent, fill, bold = styles[k] if (k := int(c.get("s", 0))) < len(styles) else (0, None, False)
                    if v is not None or formula is not None:
                        yield file, sheet.get("name"), int(row), col, v, f"={formula}" if formula else None, indent, fill, bold, outline
                    c.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        p = self.path.removeprefix("file://")
        return [InputPartition(x) for x in sorted(glob.glob(os.path.join(p, "*.xlsx") if os.path.isdir(p) else p))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from cells_of(f.read(), partition.value)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for any store that Spark reads."""
    import pandas as pd

    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                yield pd.DataFrame(list(cells_of(data, name)), columns=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modificationTime)`` of the workbooks of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").option("recursiveFileLookup", "true").load(path).drop("content")
