"""Spreadsheets (.xlsx) as a data source: the zipped XML is read on the executors, a partition per sheet, with no further package.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "Visits").load("/data/visits.xlsx")

Options: `path` (a file or, for local files, a pattern), `sheet` (a name; the first sheet by default, `*` for all, which adds a column
`sheet`). The first row with a value is the header; empty names become `Unnamed: k`, repeated ones get `.1`, `.2` behind.
A column's type is that of all its values: long, double, boolean, timestamp (numbers in a date format), else string; empty
cells and errors are NULL, and rows without any value are left out. Sheets of one read share the columns of all of them.
"""

from __future__ import annotations

import glob
import math
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import IO
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

Value = str | int | float | bool | datetime | None
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DATE_CODE = re.compile(r"[ymdhs]", re.I)
CODE_TEXT = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)
REFERENCE = re.compile(r"([A-Z]+)\d+$")


def open_file(path: str) -> IO[bytes]:
    """A file for reading at any place: local paths, or a URI of a file system that Arrow knows."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    system, place = FileSystem.from_uri(path)
    return system.open_input_file(place)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic readings."""
    out = []
    for part in node:
        kind = _local(part.tag)
        if kind == "t":
            out.append(part.text or "")
        elif kind == "r":
            out += [x.text or "" for x in part if _local(x.tag) == "t"]
    return "".join(out)


class Workbook:
    def __init__(self, file: IO[bytes]):
        self.zip = zipfile.ZipFile(file)
        book = self._tree("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target", "") for r in self._tree("xl/_rels/workbook.xml.rels")}
        self.start = datetime(1899, 12, 30)
        self.sheets: dict[str, str] = {}
        for node in book.iter():
            kind = _local(node.tag)
            if kind == "workbookPr" and node.get("date1904") in ("1", "true"):
                self.start = datetime(1904, 1, 1)
            elif kind == "sheet":
                ref = next((v for k, v in node.attrib.items() if _local(k) == "id"), None)
                target = targets.get(ref, "")
                place = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
                if place in self.zip.namelist():
                    self.sheets[node.get("name", "")] = place

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.zip.namelist() else ElementTree.Element("none")

    def _shared(self) -> list[str]:
        return [_text(item) for item in self._tree("xl/sharedStrings.xml")]

    def _dates(self) -> list[bool]:
        """Whether cells of each style show dates."""
        codes, styles = {}, []
        for node in self._tree("xl/styles.xml"):
            if _local(node.tag) == "numFmts":
                codes = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in node}
            elif _local(node.tag) == "cellXfs":
                styles = [int(f.get("numFmtId", 0)) for f in node]
        return [s in DATE_FORMATS if s not in codes else bool(DATE_CODE.search(CODE_TEXT.sub("", codes[s]))) for s in styles]

    def rows(self, sheet: str) -> Iterator[list[Value]]:
        """Rows with any value, cells by column; the XML streams by."""
        shared, dates = self._shared(), self._dates()
        with self.zip.open(self.sheets[sheet]) as file:
            for _, node in ElementTree.iterparse(file):
                if _local(node.tag) != "row":
                    continue
                out: list[Value] = []
                for cell in node:
                    if _local(cell.tag) != "c":
                        continue
                    found = REFERENCE.match(cell.get("r", ""))
                    at = len(out)
                    if found:
                        at = 0
                        for letter in found[1]:
                            at = at * 26 + ord(letter) - 64
                        at -= 1
                    out += [None] * (at + 1 - len(out))
                    out[at] = self._value(cell, shared, dates)
                node.clear()
                if any(v is not None for v in out):
                    yield out

    def _value(self, cell: ElementTree.Element, shared: list[str], dates: list[bool]) -> Value:
        kind, raw = cell.get("t", "n"), None
        for part in cell:
            if _local(part.tag) == "v":
                raw = part.text
            elif _local(part.tag) == "is":
                return _text(part) or None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(raw)] or None
        if kind == "b":
            return raw.strip() == "1"
        if kind == "d":
            return datetime.fromisoformat(raw.replace("Z", ""))
        if kind != "n":
            return raw or None
        number = float(raw)
        style = int(cell.get("s", 0))
        if style < len(dates) and dates[style]:
            return self.start + timedelta(seconds=round(number * 86400, 3))
        return int(number) if number.is_integer() and abs(number) < 2**63 else number


def header(row: list[Value]) -> list[str]:
    out: list[str] = []
    for k, v in enumerate(row):
        name = f"Unnamed: {k}" if v is None else str(v)
        again, made = 0, name
        while made in out:
            again += 1
            made = f"{name}.{again}"
        out.append(made)
    return out


def _table(book: Workbook, sheet: str) -> tuple[list[str], Iterator[list[Value]]]:
    rows = book.rows(sheet)
    first = next(rows, None)
    return ([] if first is None else header(first)), rows


def joined_kind(a: type | None, b: type) -> type:
    """The type that holds values of both."""
    if a is None or a is b:
        return b
    return float if {a, b} == {int, float} else str


TYPES: dict[type | None, DataType] = {
    int: LongType(), float: DoubleType(), bool: BooleanType(), datetime: TimestampType(), str: StringType(), None: StringType(),
}


def cast(value: Value, kind: DataType) -> Value:
    """value as a field of that type; NULL where it can't be."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return str(value)
    if isinstance(kind, TimestampType):
        return value if isinstance(value, datetime) else None
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if not isinstance(value, int | float) or isinstance(value, bool):
        return None
    if isinstance(kind, LongType):
        return int(value) if not isinstance(value, float) or value.is_integer() else None
    if isinstance(kind, DoubleType):
        return float(value) if math.isfinite(value) else None
    raise TypeError(f"fields of sheets are long, double, boolean, timestamp or string, not {kind.simpleString()}")


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def sheets(self) -> list[tuple[str, str]]:
        """(file, sheet) of all that is read."""
        path = self.options["path"]
        paths = sorted(glob.glob(path)) if "://" not in path and glob.has_magic(path) else [path.removeprefix("file:")]
        wanted = self.options.get("sheet")
        out = []
        for p in paths:
            with open_file(p) as file:
                names = list(Workbook(file).sheets)
            if wanted not in (None, "*") and wanted not in names:
                raise ValueError(f"no sheet {wanted} in {p}")
            out += [(p, n) for n in names if wanted == "*" or n == (names[0] if wanted is None else wanted)]
        return out

    def schema(self) -> StructType:
        kinds: dict[str, type | None] = {}
        for path, sheet in self.sheets():
            with open_file(path) as file:
                names, rows = _table(Workbook(file), sheet)
                for n in names:
                    kinds.setdefault(n, None)
                for row in rows:
                    for n, v in zip(names, row, strict=False):
                        if v is not None:
                            kinds[n] = joined_kind(kinds[n], type(v))
        fields = [StructField(n, TYPES[k]) for n, k in kinds.items()]
        if self.options.get("sheet") == "*":
            fields.insert(0, StructField("sheet", StringType()))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(schema, self.sheets(), self.options.get("sheet") == "*")


class SheetReader(DataSourceReader):
    def __init__(self, schema: StructType, sheets: list[tuple[str, str]], named: bool):
        self.schema, self.sheets, self.named = schema, sheets, named

    def partitions(self) -> list[SheetPartition]:
        return [SheetPartition(*s) for s in self.sheets]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        with open_file(partition.path) as file:
            names, rows = _table(Workbook(file), partition.sheet)
            at = {n: k for k, n in enumerate(names)}
            for row in rows:
                out = []
                for f in self.schema.fields:
                    if self.named and f.name == "sheet":
                        out.append(partition.sheet)
                        continue
                    k = at.get(f.name)
                    out.append(cast(row[k] if k is not None and k < len(row) else None, f.dataType))
                yield tuple(out)
