"""Workbooks (Office Open XML) as a data source: a partition for each sheet of each file, and only the asked columns are read (SRC1, SRC2).

spark.read.format("workbook").schema(...).load(path), with the option sheet for one sheet. The first row
of a sheet names its columns; the schema's columns are looked up there, and cells of other columns are
skipped. Rows that are blank in every column of the sheet are left out. A column that a sheet lacks is
null, and so is a cell that isn't of the column's type. The columns _file and _sheet, where the schema
asks for them, say where a row stands. A sheet is read in a stream; its shared texts are held, which the
format bounds with the sheet (1,048,576 rows).
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet, with its header.
SHEET_ROWS = 1 << 20
EPOCH = dt.date(1899, 12, 30)
#: Characters that XML can't hold.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of an address; a plain path is local, as file: is."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (pafs.LocalFileSystem(), path)


def workbooks(path: str) -> list[str]:
    """The workbooks of a folder, or the one file."""
    fs, at = store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".xlsx") and not f.base_name.startswith((".", "~"))]


def opened(path: str) -> zipfile.ZipFile:
    fs, at = store(path)
    return zipfile.ZipFile(fs.open_input_file(at))


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The parts of a workbook by the names of their sheets, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    found = ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet")
    return {s.get("name"): (t.lstrip("/") if (t := links[s.get(_LINK)]).startswith("/") else f"xl/{t}") for s in found}


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, element in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if element.tag == f"{_MAIN}si":
            out.append(_text(element))
            element.clear()
    return out


def column_number(reference: str) -> int:
    """A1 is column 0, AB7 is column 27."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | bool | float | None:
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(cell)
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    return v.text if kind == "str" else v.text == "1" if kind == "b" else float(v.text)


def rows(book: zipfile.ZipFile, part: str, wanted: Callable[[list], list[int]]) -> Iterator[list | None]:
    """The values of the wanted columns of each row below the header, None for a blank row. wanted: the places of these columns in the header, -1 for none."""
    shared, places, row_ended = _shared(book), None, f"{_MAIN}row"
    top = None
    for event, element in ElementTree.iterparse(book.open(part), ("start", "end")):
        if top is None and element.tag == f"{_MAIN}sheetData":
            top = element
        if event != "end" or element.tag != row_ended:
            continue
        cells = {}
        for i, c in enumerate(element):
            if c.tag == f"{_MAIN}c":
                cells[column_number(c.get("r")) if c.get("r") else i] = c
        if places is None:
            header = [None] * (1 + max(cells, default=-1))
            for k, c in cells.items():
                header[k] = _value(c, shared)
            places = wanted(header)
        else:
            value = {k: _value(cells[k], shared) for k in places if k in cells}
            blank = all(v in (None, "") for v in value.values()) and all(_value(c, shared) in (None, "") for k, c in cells.items() if k not in value)
            yield None if blank else [value.get(k) for k in places]
        element.clear()
        if top is not None:
            top.clear()


def as_type(value, kind: T.DataType):
    """A cell's value in the column's type, or None."""
    if value is None or value == "":
        return None
    try:
        if isinstance(kind, T.StringType):
            if isinstance(value, bool):
                return "TRUE" if value else "FALSE"
            return repr(value).removesuffix(".0") if isinstance(value, float) else value
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).lower().removesuffix(".0"))
        if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
            return int(float(value)) if float(value).is_integer() else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.DateType):
            return EPOCH + dt.timedelta(days=int(value)) if isinstance(value, float) else dt.date.fromisoformat(value)
    except (ValueError, OverflowError):
        return None
    raise TypeError(f"no cells of type {kind.simpleString()}")


class Sheet(InputPartition):
    def __init__(self, file: str, sheet: str, part: str):
        self.file, self.sheet, self.part = file, sheet, part


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.path, self.sheet = schema, options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        out = []
        for file in workbooks(self.path):
            with opened(file) as book:
                out += [Sheet(file, name, part) for name, part in sheets(book).items() if self.sheet in (None, name)]
        return out

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if partition is None:  # no sheet of that name
            return
        names, kinds = self.columns.names, [f.dataType for f in self.columns]
        place = {"_file": partition.file, "_sheet": partition.sheet}
        with opened(partition.file) as book:
            found = lambda header: [header.index(n) if n in header else -1 for n in names]
            for values in rows(book, partition.part, found):
                if values is not None:
                    yield tuple(place[n] if n in place else as_type(v, k) for n, k, v in zip(names, kinds, values, strict=True))


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        raise ValueError("state the columns to read with schema()")

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))


def read_sheet(spark: SparkSession, path: str, schema: str, sheet: str | None = None) -> DataFrame:
    """The rows of a sheet, or of all sheets, of a workbook or of all workbooks in a folder; the schema lists the columns that are read."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").schema(schema)
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def _name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(column: int, row: int, value) -> str:
    if value is None:
        return ""
    at = f'{_name(column)}{row}'
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.date):
        value = (value - EPOCH).days
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


def workbook_bytes(content: dict[str, tuple[list[str], list[list]]]) -> bytes:
    """A workbook of sheets (header, rows); a row may be empty."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(content)))
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{links}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(len(content))) + "</Relationships>")
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="s{i}"/>' for i, n in enumerate(content))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{links}"><sheets>{listed}</sheets></workbook>')
        for i, (header, body) in enumerate(content.values()):
            if len(body) >= SHEET_ROWS:
                raise ValueError("a sheet holds no more rows")
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                for r, values in enumerate([header, *body], 1):
                    part.write(f'<row r="{r}">{"".join(_cell(c, r, v) for c, v in enumerate(values))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
    return out.getvalue()


#: Rows of each sheet in one of the workbooks that write_workbooks() makes.
BOOK_ROWS = 50_000


def write_workbooks(tables: dict[str, tuple[DataFrame, str]], path: str, book_rows: int = BOOK_ROWS) -> int:
    """Writes tables of plain columns as the sheets of workbooks in a folder: by sheet its rows and their key. The key orders the rows and isn't a cell if its name starts with '_'. Rows are dealt by hashed key over as many workbooks as are needed; a task writes one. Returns their number."""
    shown = {name: [f for f in df.schema if f.name != key or not key.startswith("_")] for name, (df, key) in tables.items()}
    headers = {name: [f.name for f in fields] for name, fields in shown.items()}
    kinds = {name: [f.dataType for f in fields] for name, fields in shown.items()}
    n = 1 + max(df.count() for df, _ in tables.values()) // book_rows
    parts = None
    for name, (df, key) in tables.items():
        cells = F.array(*(F.col(f"`{c}`").cast("string") for c in headers[name])).alias("cells")
        part = df.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("book"), F.lit(name).alias("sheet"), F.col(key).cast("double").alias("place"), cells)
        parts = part if parts is None else parts.unionByName(part)
    fs, at = store(path)
    fs.create_dir(at, recursive=True)

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        content = {}
        for name, columns in headers.items():
            body = frame[frame["sheet"] == name].sort_values("place")["cells"]
            typed = lambda v, k: v if v is None or isinstance(k, T.StringType) else dt.date.fromisoformat(v) if isinstance(k, T.DateType) else v == "true" if isinstance(k, T.BooleanType) else int(v) if isinstance(k, T.IntegralType) else float(v)
            content[name] = (columns, [[typed(v, k) for v, k in zip(row, kinds[name], strict=True)] for row in body])
        fs, at = store(path)
        name = f"book-{key[0]:05}.xlsx"
        with fs.open_output_stream(f"{at}/.{name}.part") as out:
            out.write(workbook_bytes(content))
        fs.move(f"{at}/.{name}.part", f"{at}/{name}")  # a repeated task writes the same rows
        return pd.DataFrame({"file": [name]})

    return parts.groupBy("book").applyInPandas(write, "file string").count()
