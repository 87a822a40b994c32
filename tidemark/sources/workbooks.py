"""Workbooks (xlsx) and R data files, read by Spark tasks from the bytes of the files.

Files come as Spark's binary source gives them, so any file system and any number of files will do; a task
turns a file's sheet or object into rows of text cells, of which the first names the columns. Numbers keep
their digits, dates are ISO texts, what is blank or an error is null.
"""

from __future__ import annotations

import bz2
import datetime as dt
import gzip
import io
import lzma
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, place long, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _table(spark: SparkSession, path: str, rows) -> DataFrame:
    """Rows of cells to a table with the first row's names; a name that is blank is its column's number."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for place, cells in enumerate(rows(content)):
                    held.append((file, place, cells))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=["file", "place", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "place", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInPandas(run, CELLS)
    first = cells.where("place = 0").orderBy("file").first()
    if first is None:
        raise ValueError(f"{path} has no rows")
    names = [n if n not in (None, "") else f"col_{i}" for i, n in enumerate(first["cells"])]
    return cells.where("place > 0").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def column_number(reference: str) -> int:
    """From a cell's reference such as AB7, its column from 0."""
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def sheet_rows(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, by number or name; rows that the file leaves out are rows without a cell."""
    book = zipfile.ZipFile(io.BytesIO(content))
    part = lambda name: ElementTree.fromstring(book.read(name)) if name in book.namelist() else None
    head = part("xl/workbook.xml")
    sheets = [(s.get("name"), s.get(_REL)) for s in head.iter(f"{_MAIN}sheet")]
    found = next((r for i, (n, r) in enumerate(sheets) if sheet in (i, n)), None)
    if found is None:
        raise ValueError(f"no sheet {sheet}: there are {[n for n, _ in sheets]}")
    target = next(r.get("Target") for r in part("xl/_rels/workbook.xml.rels") if r.get("Id") == found).lstrip("/")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
    strings = part("xl/sharedStrings.xml")
    shared = [] if strings is None else [text(s) for s in strings.iter(f"{_MAIN}si")]
    styles, dates = part("xl/styles.xml"), set()
    if styles is not None:
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode").lower()))}
        cells = styles.find(f"{_MAIN}cellXfs")
        dates = {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
    settings = head.find(f"{_MAIN}workbookPr")
    start = dt.datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)

    def value(cell) -> str | None:
        kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return text(cell)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind is None and int(cell.get("s", 0)) in dates:
            return (start + dt.timedelta(seconds=round(float(v.text) * 86400, 3))).isoformat(sep=" ")
        return v.text

    at = 0
    for _, row in ElementTree.iterparse(book.open(target if target.startswith("xl/") else f"xl/{target}")):
        if row.tag != f"{_MAIN}row":
            continue
        number, cells = int(row.get("r", at + 1)) - 1, []
        for cell in row.iter(f"{_MAIN}c"):
            place = column_number(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (place + 1 - len(cells))
            cells[place] = value(cell)
        yield from ([] for _ in range(number - at) if at)  # blank lines above the header do not count
        yield cells
        at = number + 1
        row.clear()


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of each workbook, the columns as the first one names them."""
    return _table(spark, path, lambda content: sheet_rows(content, sheet))


class RFile:
    """Reader of R's serialised objects (versions 2 and 3, binary form)."""

    def __init__(self, content: bytes):
        for magic, opener in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
            if content.startswith(magic):
                content = opener(content)
        self.whole = content[:5] in (b"RDX2\n", b"RDX3\n")
        self.data, self.at, self.seen = content, 5 if self.whole else 0, []
        if self.data[self.at : self.at + 2] != b"X\n":
            raise ValueError("not an R file in binary form")
        self.at += 2
        version = self.numbers("i", 3)[0]
        if version == 3:
            size = self.numbers("i", 1)[0]  # of the encoding's name
            self.at += size

    def numbers(self, kind: str, n: int) -> tuple:
        out = struct.unpack_from(f">{n}{kind}", self.data, self.at)
        self.at += struct.calcsize(f">{n}{kind}")
        return out

    def item(self):
        """A value: None, a string, ``(values, attributes)`` of a vector, or a dict of a list of pairs."""
        flags = self.numbers("i", 1)[0]
        kind, has_attributes, has_tag = flags & 255, flags & 512, flags & 1024
        if kind in (254, 253, 252, 251, 250, 242, 241):  # nil and the standard environments
            return None
        if kind == 255:
            return self.seen[(flags >> 8 or self.numbers("i", 1)[0]) - 1]
        if kind == 1:
            self.seen.append(self.item())
            return self.seen[-1]
        if kind == 9:
            size = self.numbers("i", 1)[0]
            text = None if size < 0 else self.data[self.at : self.at + size].decode("latin-1" if flags >> 12 & 4 else "utf-8")
            self.at += max(size, 0)
            return text
        if kind in (2, 5, 6):
            return self.pairs(has_attributes, has_tag)
        if kind == 238:  # a compact form: its class, its state, its attributes
            name, state, extra = list(self.item().values())[0], self.item(), self.item()
            if "compact" in name:
                n, first, step = (int(v) for v in state[0])
                return [first + i * step for i in range(n)], extra or {}
            inner = state[0] if isinstance(state, tuple) and isinstance(state[0], list) and state[0] and isinstance(state[0][0], tuple) else list(state.values())[0] if isinstance(state, dict) else state
            inner = inner[0] if isinstance(inner, list) else inner
            return inner[0], extra or {}
        if kind == 4:
            self.numbers("i", 1)
            self.seen.append(None)
            for _ in range(4):
                self.item()
            return None
        n = self.numbers("i", 1)[0] if kind in (10, 13, 14, 15, 16, 19, 20, 24) else None
        if kind in (10, 13):
            values = [None if v == -(1 << 31) else bool(v) if kind == 10 else v for v in self.numbers("i", n)]
        elif kind == 14:
            values = [None if v != v else v for v in self.numbers("d", n)]
        elif kind == 16:
            values = [self.item() for _ in range(n)]
        elif kind in (19, 20):
            values = [self.item() for _ in range(n)]
        else:
            raise ValueError(f"R objects of type {kind} are not read")
        return values, self.item() or {} if has_attributes else {}

    def pairs(self, has_attributes, has_tag) -> dict:
        out = {}
        while True:
            if has_attributes:
                self.item()
            tag = self.item() if has_tag else None
            out[tag if tag is not None else len(out)] = self.item()
            flags = struct.unpack_from(">i", self.data, self.at)[0]
            if flags & 255 != 2:
                self.item()
                return out
            self.at += 4
            has_attributes, has_tag = flags & 512, flags & 1024


def r_rows(content: bytes, key: str | None = None) -> Iterator[list[str | None]]:
    """The data frame of a file, or of an object that is named; the first that there is."""
    file = RFile(content)
    objects = file.item() if file.whole else {key: file.item()}
    frames = {k: v for k, v in objects.items() if isinstance(v, tuple) and "data.frame" in v[1].get("class", ([],))[0]}
    if key not in frames and (key is not None or not frames):
        raise ValueError(f"no data frame {key or ''}: there are {sorted(map(str, frames))}")
    columns, attributes = frames[key] if key in frames else next(iter(frames.values()))
    names = attributes["names"][0]

    def texts(column) -> list[str | None]:
        values, about = column
        if "levels" in about:
            values = [None if v is None else about["levels"][0][v - 1] for v in values]
        kinds = about.get("class", ([],))[0]
        if "Date" in kinds:
            values = [None if v is None else str(dt.date(1970, 1, 1) + dt.timedelta(days=int(v // 1))) for v in values]
        elif "POSIXct" in kinds:
            values = [None if v is None else (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=v)).isoformat(sep=" ") for v in values]
        return [None if v is None else ("true" if v else "false") if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v) for v in values]

    yield names
    yield from (list(r) for r in zip(*map(texts, columns), strict=True))


def read_rdata(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A data frame of each R file (.RData, .rda, .rds), the columns as the first one names them."""
    return _table(spark, path, lambda content: r_rows(content, key))
