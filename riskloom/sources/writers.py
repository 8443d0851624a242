"""Writers: day partitions, whole-table replacement, JSON payloads, CSV products."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_day(rows: DataFrame, path: str, day: str = "day") -> None:
    """Replace just the days that the rows have; other days stay. Rows are dealt by day so that a day is few files."""
    rows.repartition(F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Replace a table that the rows may have been read from: written aside first, then moved over it."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside, f"{aside}.old"))
    fs = target.getFileSystem(conf)
    # The old table is moved away, not deleted, until the new one stands: a crash in between leaves both on disk.
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, target):
        raise OSError(f"{aside} can't be moved to {path}")
    fs.delete(old, True)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a log; those of earlier runs stay."""
    rows.write.mode("append").parquet(path)


def products(path: str, **tables: DataFrame) -> None:
    """One CSV folder with a header per named table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def payload(rows: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``key, payload``: the other columns as JSON, nulls and non-numbers left out."""
    chosen = [c for c in (columns or rows.columns) if c != key]
    kinds = dict(rows.dtypes)
    safe = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in chosen]
    return rows.select(key, F.to_json(F.struct(*safe)).alias("payload"))


def renamed(items: str, old: str, new: str) -> Column:
    """An array of structs with one of their fields renamed."""
    return F.transform(items, lambda x: x.withField(new, x[old]).dropFields(old))


def documents(rows: DataFrame, folder: str, name: str, content: str) -> int:
    """One file per row, as bytes or text, in folders that all executors reach; how many. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = 0, set()
        for batch in batches:
            for where, called, body in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = pafs.FileSystem.from_uri(where)
                if where not in known:
                    fs.create_dir(path, recursive=True)
                    known.add(where)
                with fs.open_output_stream(f"{path}/{called}") as out:
                    out.write(body)
                made += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([made], pa.int64())})

    chosen = rows.select(F.col(folder).cast("string"), F.col(name).cast("string"), F.col(content).cast("binary"))
    return chosen.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


BOOK = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
}


def day_books(rows: DataFrame, folder: str, day: str = "day") -> int:
    """A series of numbers as workbooks in ``folder``, one a year with a header and serial dates; how many."""
    names = [day, *[c for c in rows.columns if c != day]]
    cell = lambda value, style: F.when(value.isNotNull(), F.concat(F.lit(f'<c s="{style}"><v>'), value, F.lit("</v></c>"))).otherwise("<c/>")
    serial = F.date_diff(F.col(day), F.lit("1899-12-30").cast("date")).cast("string")
    line = F.concat(F.lit("<row>"), cell(serial, 1), *[cell(F.col(c).cast("string"), 0) for c in names[1:]], F.lit("</row>"))
    header = "<row>" + "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in names) + "</row>"
    # A year is 366 lines at most.
    years = rows.groupBy(F.year(day).alias("year")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), line.alias("x")))), lambda r: r["x"]), "").alias("body"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books = []
            for body in batch.column(1).to_pylist():
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
                    for name, part in BOOK.items():
                        book.writestr(name, part)
                    book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{header}{body}</sheetData></worksheet>')
                books.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(books, pa.binary())], ["year", "book"])

    made = years.select("year", "body").mapInArrow(packed, "year int, book binary")
    return documents(made.select(F.lit(folder).alias("folder"), F.format_string("%d.xlsx", "year").alias("name"), "book"), "folder", "name", "book")
