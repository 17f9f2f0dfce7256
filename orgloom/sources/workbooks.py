"""Spreadsheet workbooks (.xlsx) as a Spark data source.

``register(spark)`` names the format ``workbook``::

    spark.read.format("workbook").option("header_row", 2).load(folder)
    df.write.format("workbook").option("title", "...").mode("overwrite").save(folder)

A file's sheet is one partition. Its cells are parsed as a stream: the unpacked sheet is never held, and
shared strings are kept as one block of bytes. Every written partition is a file of its own.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import uuid
import zipfile
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

FORMAT = "workbook"
CHUNK, BATCH = 1 << 16, 4096
ROWS = 1 << 20  # of a sheet, by the format

# --- fixed values: parts and names of the file format ------------------------
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path there of a local path or an address that pyarrow knows (file, hdfs, s3, gs)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _list(path: str) -> list[str]:
    store, at = open_folder(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx") and not f.base_name.startswith((".", "_", "~")))


# --- reading -----------------------------------------------------------------

def _events(stream) -> Iterator[tuple[str, str, dict | str | None]]:
    """("open", tag, attributes), ("text", "", characters) and ("close", tag, None) of an XML stream, without name spaces."""
    out: list = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    local = lambda name: name.rsplit("}", 1)[-1]
    parser.StartElementHandler = lambda name, attrs: out.append(("open", local(name), {local(k): v for k, v in attrs.items()}))
    parser.EndElementHandler = lambda name: out.append(("close", local(name), None))
    parser.CharacterDataHandler = lambda text: out.append(("text", "", text))
    while True:
        chunk = stream.read(CHUNK)
        parser.Parse(chunk, not chunk)
        yield from out
        out.clear()
        if not chunk:
            return


_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _plain(text: str) -> str:
    """Text without the format's escapes of control characters."""
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


class _Strings:
    """Shared strings, as bytes one behind the other."""

    def __init__(self):
        self.raw, self.at = bytearray(), array("q", [0])

    def add(self, text: str) -> None:
        self.raw += text.encode("utf-8", "surrogatepass")
        self.at.append(len(self.raw))

    def __getitem__(self, i: int) -> str:
        return self.raw[self.at[i]:self.at[i + 1]].decode("utf-8", "surrogatepass")


class Workbook:
    """A workbook's parts that its sheets need: their names and places, shared strings, which styles are dates."""

    def __init__(self, handle):
        self.zip = zipfile.ZipFile(handle)
        self.names = {n.lower(): n for n in self.zip.namelist()}
        self.sheets: list[tuple[str, str]] = []
        self.active, self.from_1904 = 0, False
        targets = {}
        for kind, tag, attrs in self._part("xl/_rels/workbook.xml.rels"):
            if kind == "open" and tag == "Relationship":
                target = attrs["Target"]
                targets[attrs["Id"]] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for kind, tag, attrs in self._part("xl/workbook.xml"):
            if kind == "open" and tag == "sheet":
                self.sheets.append((attrs["name"], targets.get(attrs.get("id"), f"xl/worksheets/sheet{len(self.sheets) + 1}.xml")))
            elif kind == "open" and tag == "workbookView":
                self.active = int(attrs.get("activeTab", 0))
            elif kind == "open" and tag == "workbookPr":
                self.from_1904 = attrs.get("date1904") in ("1", "true")
        self._strings: _Strings | None = None
        self.dates = self._date_styles()

    def _part(self, name: str) -> Iterator[tuple]:
        real = self.names.get(name.lower())
        if real is None:
            return
        with self.zip.open(real) as stream:
            yield from _events(stream)

    def _date_styles(self) -> set[int]:
        own: dict[int, str] = {}
        inside, styles = False, []
        for kind, tag, attrs in self._part("xl/styles.xml"):
            if tag == "cellXfs":
                inside = kind == "open"
            elif kind == "open" and tag == "numFmt":
                own[int(attrs["numFmtId"])] = attrs.get("formatCode", "")
            elif kind == "open" and tag == "xf" and inside:
                styles.append(int(attrs.get("numFmtId", 0)))
        is_date = lambda f: f in _DATE_FORMATS if f not in own else bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.', "", own[f].lower())))
        return {i for i, f in enumerate(styles) if is_date(f)}

    @property
    def strings(self) -> _Strings:
        if self._strings is None:
            self._strings, text, reading, phonetic = _Strings(), [], False, False
            for kind, tag, value in self._part("xl/sharedStrings.xml"):
                if kind == "text":
                    if reading and not phonetic:
                        text.append(value)
                elif tag == "t":
                    reading = kind == "open"
                elif tag == "rPh":
                    phonetic = kind == "open"
                elif tag == "si":
                    if kind == "open":
                        text = []
                    else:
                        self._strings.add(_plain("".join(text)))
        return self._strings

    def sheet(self, which: str) -> str:
        """The place of a sheet: ``active``, a number from 0, or a name."""
        names = [n for n, _ in self.sheets]
        if which == "active":
            return self.sheets[min(self.active, len(names) - 1)][1]
        if which in names:
            return self.sheets[names.index(which)][1]
        if which.isdigit() and int(which) < len(names):
            return self.sheets[int(which)][1]
        raise ValueError(f"no sheet {which!r} among {names}")

    def _number(self, text: str, style: int) -> str:
        number = float(text)
        if style in self.dates:
            return _date(number, self.from_1904)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, which: str, last: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """(row number from 0, cells as text; None for blank ones), up to row ``last``. Numbers without a fraction have no point."""
        number, cells, column, kind_of, style, text, reading, phonetic = -1, [], -1, "n", 0, [], False, False
        for kind, tag, value in self._part(self.sheet(which)):
            if kind == "text":
                if reading and not phonetic:
                    text.append(value)
            elif tag in ("v", "t"):
                reading = kind == "open"
            elif tag == "rPh":
                phonetic = kind == "open"
            elif tag == "c" and kind == "open":
                at = _column(value["r"]) if "r" in value else column + 1
                column, kind_of, style, text = at, value.get("t", "n"), int(value.get("s", 0)), []
            elif tag == "c":
                if text:
                    cells += [None] * (column + 1 - len(cells))
                    cells[column] = self._value(kind_of, style, "".join(text))
            elif tag == "row" and kind == "open":
                number, cells, column = int(value["r"]) - 1 if "r" in value else number + 1, [], -1
                if last is not None and number > last:
                    return
            elif tag == "row":
                yield number, cells

    def _value(self, kind: str, style: int, text: str) -> str | None:
        if kind == "s":
            return self.strings[int(text)] or None
        if kind == "b":
            return "True" if text.strip() == "1" else "False"
        if kind in ("str", "inlineStr", "e", "d"):
            return _plain(text) or None
        return self._number(text, style)


def _column(reference: str) -> int:
    """The column, from 0, of a cell reference such as AB12."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _date(number: float, from_1904: bool) -> str:
    """A day count as text. Day 60 of the older system, 29 February 1900, never was: days below count one more."""
    if 0 <= number < 1:
        return str((dt.datetime(1900, 1, 1) + dt.timedelta(seconds=round(number * 86400))).time())
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if number >= 60 else 31)
    try:
        return str(start + dt.timedelta(days=int(number), seconds=round(number % 1 * 86400)))
    except OverflowError:
        return repr(number)


@dataclass
class _File(InputPartition):
    path: str


def _names(cells: Sequence[str | None]) -> list[str]:
    """Column names of a header row: stripped; blank ones are numbered, repeated ones get a suffix."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = (cell or "").strip() or f"column{i}"
        k = 1
        while name in out:
            name = f"{(cell or '').strip() or f'column{i}'}.{k}"
            k += 1
        out.append(name)
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.sheet = options["path"], options.get("sheet", "0")
        self.header_row = int(options.get("header_row", 0))

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _list(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        store, _ = open_folder(self.path)
        types = pa.schema([(f"c{i}", pa.string()) for i in range(len(self.columns))])
        with store.open_input_file(partition.path) as handle:
            rows = Workbook(handle).rows(self.sheet)
            places: list[int | None] | None = None
            held: list[list] = [[] for _ in self.columns]
            for number, cells in rows:
                if number < self.header_row:
                    continue
                if places is None:
                    found = {n: i for i, n in reversed(list(enumerate(_names(cells))))} if number == self.header_row else {}
                    places = [found.get(n) for n in self.columns]
                    if number == self.header_row:
                        continue
                if all(c is None for c in cells):
                    continue
                for column, at in zip(held, places):
                    column.append(cells[at] if at is not None and at < len(cells) else None)
                if len(held[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in held], schema=types).rename_columns(self.columns)
                    held = [[] for _ in self.columns]
            if held and held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in held], schema=types).rename_columns(self.columns)


# --- writing -----------------------------------------------------------------

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)|\r")


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) or isinstance(value, float) and math.isfinite(value):
        return f"<c><v>{value!r}</v></c>"
    text = _BAD.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


class _Saved(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Sheet:
    """A workbook being written."""

    def __init__(self, store: fs.FileSystem, path: str, name: str, lines: list[list]):
        self.path, self.out = path, store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        book = f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>'
        for part, text in {**_PARTS, "xl/workbook.xml": book}.items():
            self.zip.writestr(part, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.rows = 0
        self._put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>')
        for line in lines:
            self.add(line)

    def _put(self, text: str) -> None:
        self.sheet.write(text.encode("utf-8", "replace"))

    def add(self, row: Sequence) -> None:
        self._put(f"<row>{''.join(map(_cell, row))}</row>")
        self.rows += 1

    def close(self) -> None:
        self._put("</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        self.out.close()


class _Writer(DataSourceArrowWriter):
    """Every task writes a file under a name of its own, out of readers' sight; the names become visible when all tasks are done."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.columns = [f.name for f in schema.fields]
        self.path, self.title = options["path"], options.get("title", "")
        self.sheet, self.overwrite = options.get("sheet_name", "Sheet1"), overwrite
        self.earlier: list[str] = []
        store, at = open_folder(self.path)
        store.create_dir(at, recursive=True)
        if overwrite:
            self.earlier = _list(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Saved:
        store, at = open_folder(self.path)
        lines = [*([t] for t in self.title.split("\n") if t), self.columns]
        new = lambda: _Sheet(store, f"{at}/.part-{uuid.uuid4().hex}.xlsx", self.sheet, lines)
        sheet, paths = new(), []
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sheet.rows == ROWS:  # a sheet can't be longer
                    sheet.close()
                    paths.append(sheet.path)
                    sheet = new()
                sheet.add(row)
        sheet.close()
        return _Saved([*paths, sheet.path])

    def commit(self, messages: list[_Saved | None]) -> None:
        store, _ = open_folder(self.path)
        for m in messages:
            for path in m.paths if m is not None else ():
                folder, name = path.rsplit("/", 1)
                store.move(path, f"{folder}/{name[1:]}")
        for path in self.earlier:
            store.delete_file(path)

    def abort(self, messages: list[_Saved | None]) -> None:
        store, _ = open_folder(self.path)
        for m in messages:
            for path in m.paths if m is not None else ():
                store.delete_file(path)


class WorkbookSource(DataSource):
    """Options for reading: ``header_row`` (rows above the header, default 0), ``sheet`` (number from 0, name or ``active``). For
    writing: ``title`` (lines above the header), ``sheet_name``.

    All columns read are text, named by the header of the first file; other files' columns are matched by name, missing ones are NULL.
    Rows without any value are dropped.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        header_row = int(self.options.get("header_row", 0))
        store, _ = open_folder(self.options["path"])
        for path in _list(self.options["path"]):
            with store.open_input_file(path) as handle:
                cells = next((c for n, c in Workbook(handle).rows(self.options.get("sheet", "0"), header_row) if n == header_row), [])
            return StructType([StructField(n, StringType()) for n in _names(cells)])
        raise ValueError(f"no workbook in {self.options['path']}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def read_workbook(spark: SparkSession, path: str, header_row: int = 0, sheet: str | int = 0) -> DataFrame:
    """A sheet of every workbook at ``path``, one partition per file: text columns by the header below ``header_row`` rows, rows without any value dropped."""
    register(spark)
    return spark.read.format(FORMAT).option("header_row", header_row).option("sheet", str(sheet)).load(path)


def write_workbooks(df: DataFrame, path: str, title: str = "", sheet_name: str = "Sheet1") -> None:
    """One workbook per partition of ``df``, with title lines and a header; numbers and booleans keep their type, other values are written as text."""
    register(df.sparkSession)
    plain = df.select(*[c if t in ("string", "boolean", "int", "bigint", "double", "float", "smallint", "tinyint") else df[c].cast("string").alias(c) for c, t in df.dtypes])
    plain.write.format(FORMAT).option("title", title).option("sheet_name", sheet_name).mode("overwrite").save(path)
