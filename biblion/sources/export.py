"""Sinks: CSV and XLSX with fixed columns, deterministic names."""

from __future__ import annotations

import re
import unicodedata
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..schemas import EXPORT_COLUMNS


def export_rows(rows: DataFrame) -> DataFrame:
    """The export columns in order, as text; missing columns and values are empty, others go."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in EXPORT_COLUMNS])


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with header and doubled quotes; ``files`` asks for so many files, else one per partition."""
    out = export_rows(rows)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of ``write_csv`` as text columns, line breaks within fields included; empty is the empty text."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rows.na.fill("")


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Rows of one sheet, and characters of one cell, that the format allows.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767


_BLANK = re.compile("[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_SHEET = f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
#: Bytes of a fragment that are in memory at a time where fragments are joined.
JOIN_BYTES = 1 << 20


def _line(cells: Iterable[str | None]) -> bytes:
    return ("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BLANK.sub("", c or ""))}</t></is></c>' for c in cells) + "</row>").encode()


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class SheetWriter(DataSourceWriter):
    """Tasks write their rows as deflated fragments beside the sheet; the commit joins those of the tasks that
    count, in the order of partitions, a chunk at a time. The sheet appears under its name once it is whole.
    Fragments of failed, repeated or aborted tasks go with the fragments' folder."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.parts = path, columns, f"{path}.parts-{uuid.uuid4().hex}"
        # made once, here: a task that outlives an abort finds no folder and cannot leave a fragment in a new one
        store, parts = fs.FileSystem.from_uri(self.parts)
        store.create_dir(parts, recursive=True)

    def write(self, rows: Iterator[Row]) -> Fragment:
        store, parts = fs.FileSystem.from_uri(self.parts)
        task, n, pack = TaskContext.get(), 0, zlib.compressobj(6)
        name = f"{parts}/{task.partitionId()}-{task.taskAttemptId()}"
        try:
            with store.open_output_stream(name, compression=None) as out:
                for row in rows:
                    n += 1
                    if n >= SHEET_ROWS:
                        raise ValueError("too many rows for one sheet")
                    out.write(pack.compress(_line(row)))
                out.write(pack.flush())
        except BaseException:
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            raise
        return Fragment(task.partitionId(), name, n)

    def commit(self, messages: list[Fragment | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        made = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if sum(m.rows for m in made) >= SHEET_ROWS:
            self._clear()
            raise ValueError("too many rows for one sheet")
        whole = f"{fs.FileSystem.from_uri(self.parts)[1]}/sheet"
        with store.open_output_stream(whole, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in _BOOK.items():
                z.writestr(name, _HEAD + body)
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(_SHEET.encode() + _line(self.columns))
                for m in made:
                    unpack = zlib.decompressobj()
                    with store.open_input_stream(m.path, compression=None) as found:
                        while chunk := unpack.unconsumed_tail or found.read(JOIN_BYTES):
                            sheet.write(unpack.decompress(chunk, JOIN_BYTES))
                    sheet.write(unpack.flush())
                sheet.write(b"</sheetData></worksheet>")
        store.move(whole, path)
        self._clear()

    def abort(self, messages: list[Fragment | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, parts = fs.FileSystem.from_uri(self.parts)
        if store.get_file_info(parts).type != fs.FileType.NotFound:
            store.delete_dir(parts)


class SheetSink(DataSource):
    """Format ``sheet``: all rows of a DataFrame of text columns as one XLSX sheet (null: empty)."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], schema.names)


def write_xlsx(rows: DataFrame, path: str, columns: list[str] | None = None) -> int:
    """One sheet, made by the tasks and joined at the end; returns the rows. Every cell is inline text, so
    nothing in it is ever a formula. More rows than a sheet holds are an error: take the CSV then. Texts
    longer than a cell may be go on in further columns (name, name 2, …), so nothing is lost. ``path`` is
    absolute or a URI of a file system that driver and executors share."""
    made = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]) if columns else export_rows(rows)
    longest = made.agg(*[F.max(F.length(c)).alias(c) for c in made.columns]).first()
    cells = {c: max(1, -(-(longest[c] or 0) // CELL_CHARS)) for c in made.columns}
    made = made.select(*[F.substring(c, 1 + k * CELL_CHARS, CELL_CHARS).alias(f"{c} {k + 1}" if k else c) for c, n in cells.items() for k in range(n)])
    rows.sparkSession.dataSource.register(SheetSink)
    told = Observation()
    made.observe(told, F.count(F.lit(1)).alias("n")).write.format("sheet").mode("append").save(path)
    return told.get["n"]


def file_name(*parts: str, suffix: str = "csv") -> str:
    text = unicodedata.normalize("NFKD", "_".join(p for p in parts if p))
    return re.sub(r"[^\w\-.]+", "_", "".join(c for c in text if not unicodedata.combining(c))).strip("_") + f".{suffix}"
