"""Sheets of workbooks as a data source: ``spark.read.format("sheet").option("sheet", name).load(folder)``.

A workbook is a zip of XML parts; a file is one partition. The first row
names the columns, which are strings (numbers as written, dates as
``yyyy-MM-dd`` with a time where there is one); blank rows are left out. The
files of a folder must share their header.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ROWS = 4096
#: Built-in number formats of dates and times (fixed values of the file format).
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH = datetime(1899, 12, 30)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def texts(element: ElementTree.Element) -> str:
    """The text of a string item without its phonetic runs."""
    return "".join(t.text or "" for part in element if local(part.tag) in ("t", "r") for t in ([part] if local(part.tag) == "t" else [x for x in part if local(x.tag) == "t"]))


def dated(serial: float) -> str:
    """A serial date as text, to the second."""
    at = EPOCH + timedelta(seconds=round(serial * 86400))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter() if local(f.tag) == "numFmt"}
    date = lambda i: i in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(i, "")), re.I))
    cells = next((e for e in root if local(e.tag) == "cellXfs"), [])
    return {k for k, style in enumerate(cells) if date(int(style.get("numFmtId") or 0))}


def part_of(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part that holds a sheet, by its name; the first sheet without one."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [e for e in root.iter() if local(e.tag) == "sheet"]
    chosen = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet {sheet} among {[s.get('name') for s in sheets]}")
    link = next(v for k, v in chosen.attrib.items() if local(k) == "id")
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return targets[link].lstrip("/") if targets[link].startswith("/") else f"xl/{targets[link]}"


def lines(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet as text, read as they stream by."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = date_styles(book)
        with book.open(part_of(book, sheet)) as part:
            for _, row in ElementTree.iterparse(part):
                if local(row.tag) != "row":
                    continue
                cells: dict[int, str | None] = {}
                for k, cell in enumerate(row):
                    at = column_number(cell.get("r")) if cell.get("r") else k
                    kind = cell.get("t", "n")
                    value = next((e.text for e in cell if local(e.tag) == "v"), None)
                    if kind == "inlineStr":
                        value = next((texts(e) for e in cell if local(e.tag) == "is"), None)
                    elif value is not None and kind == "s":
                        value = shared[int(value)]
                    elif value is not None and kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "e":
                        value = None
                    elif value is not None and kind == "n" and int(cell.get("s") or 0) in dates:
                        value = dated(float(value))
                    cells[at] = value
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def files(path: str) -> list[str]:
    """The workbook itself, or those of a folder."""
    fs, inner = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in found if i.is_file and i.base_name.endswith(".xlsx"))


def content_of(path: str) -> bytes:
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return f.read()


class Workbook(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.sheet, self.names = options["path"], options.get("sheet"), schema.names

    def partitions(self) -> list[Workbook]:
        return [Workbook(f) for f in files(self.path)]

    def read(self, partition: Workbook) -> Iterator[pa.RecordBatch]:
        rows = lines(content_of(partition.path), self.sheet)
        header = next(rows, [])
        if [h or "" for h in header] != self.names:
            raise ValueError(f"{partition.path} has the columns {header}, not {self.names}")
        held: list[list] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in held], pa.string()) for i in range(len(self.names))], self.names)
        for row in rows:
            if any(v is not None for v in row):
                held.append(row)
            if len(held) == ROWS:
                yield made()
                held.clear()
        yield made()


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no workbook in {self.options['path']}")
        return StructType([StructField(h or "", StringType()) for h in next(lines(content_of(found[0]), self.options.get("sheet")), [])])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options, schema)


def sheet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A sheet, the first without a name, of a workbook or of a folder of them."""
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("sheet")
    return (reader.option("sheet", name) if name else reader).load(path)
