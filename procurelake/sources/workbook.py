"""A data source for one sheet of an .xlsx workbook; all columns are text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(raw: bytes, sheet: str, skip: int = 0) -> Iterator[list[str | None]]:
    """The cells of a sheet, row by row, without the first `skip` rows."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
    ids = {s.get("name"): s.get(f"{_REL}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
    if sheet not in ids:
        raise ValueError(f"no sheet {sheet!r}; there are {sorted(ids)}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[ids[sheet]].lstrip("/")
    with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
        at = 0
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            at += 1
            if at > skip:
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    k = _column(c.get("r"))
                    cells += [None] * (k + 1 - len(cells))
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[k] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield cells
            row.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, raw: bytes, sheet: str, skip: int, width: int):
        self.raw, self.sheet, self.skip, self.width = raw, sheet, skip, width

    def read(self, partition) -> Iterator[tuple]:
        it = rows(self.raw, self.sheet, self.skip)
        next(it, None)
        for r in it:
            yield tuple((r + [None] * self.width)[: self.width])


class WorkbookSource(DataSource):
    """Options: path (a local file), sheet, skip (rows above the header)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _raw(self) -> bytes:
        with open(self.options["path"].removeprefix("file:"), "rb") as f:
            return f.read()

    def schema(self) -> StructType:
        header = next(rows(self._raw(), self.options["sheet"], int(self.options.get("skip", 0))), [])
        return StructType([StructField(h or f"column_{i + 1}", StringType()) for i, h in enumerate(header)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self._raw(), self.options["sheet"], int(self.options.get("skip", 0)), len(schema))


def read_workbook(spark: SparkSession, path: str, sheet: str, skip: int = 0):
    """A sheet; the file may be in any store that Spark reads."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    it = rows(raw, sheet, skip)
    header = next(it, [])
    names = [h or f"column_{i + 1}" for i, h in enumerate(header)]
    data = [tuple((r + [None] * len(names))[: len(names)]) for r in it]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
