"""SC3: a Python data source for .xlsx workbooks, read as text from zip and XML; one partition per sheet, rows streamed."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from xml.etree.ElementTree import iterparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: How characters that XML can't hold are written: _x0001_ and so on.
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


@contextmanager
def archive(path: str) -> Iterator[zipfile.ZipFile]:
    """The workbook's zip, from a local path or from any file system that Arrow knows by its scheme."""
    if "://" not in path and not path.startswith("file:"):
        with zipfile.ZipFile(path) as z:
            yield z
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
        yield z


def sheets(path: str) -> list[tuple[str, str]]:
    """(sheet name, member) in workbook order."""
    from xml.etree.ElementTree import fromstring

    with archive(path) as z:
        rels = {r.get("Id"): r.get("Target") for r in fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = fromstring(z.read("xl/workbook.xml"))
        return [(s.get("name"), "xl/" + rels[s.get(_REL)].lstrip("/").removeprefix("xl/")) for s in book.iter(f"{_NS}sheet")]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows(path: str, member: str) -> Iterator[list[str | None]]:
    with archive(path) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in iterparse(f):
                    if e.tag == f"{_NS}si":
                        strings.append(unescaped("".join(t.text or "" for t in e.iter(f"{_NS}t"))))
                        e.clear()
        with z.open(member) as f:
            for _, e in iterparse(f):
                if e.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for i, c in enumerate(e.iter(f"{_NS}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    v = c.find(f"{_NS}v")
                    if c.get("t") == "s" and v is not None:
                        out[at] = strings[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        out[at] = unescaped("".join(t.text or "" for t in c.iter(f"{_NS}t")))
                    elif v is not None:
                        out[at] = v.text
                e.clear()
                yield out


class _Sheet(InputPartition):
    def __init__(self, name: str, member: str):
        self.name, self.member = name, member


def width_of(path: str) -> int:
    """The most cells of any row of any sheet (at least 1). The sheets are read through; what they say of their own size may be wrong."""
    return max((len(r) for _, m in sheets(path) for r in rows(path, m)), default=1) or 1


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[_Sheet]:
        return [_Sheet(n, m) for n, m in sheets(self.path)]

    def read(self, part: _Sheet):
        for i, r in enumerate(rows(self.path, part.member), 1):
            if len(r) > self.width:
                raise ValueError(f"row {i} of sheet {part.name} has {len(r)} cells, width is {self.width}")
            yield (part.name, i, *r, *[None] * (self.width - len(r)))


class XlsxSource(DataSource):
    """spark.dataSource.register(XlsxSource); spark.read.format("xlsx_text").load(path): sheet, row_no, c1..cN.

    N is the width of the widest row, or the option ``width``, which spares reading the sheets twice; a wider row then is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx_text"

    def _width(self) -> int:
        return int(self.options["width"]) if self.options.get("width") else width_of(self.options["path"])

    def schema(self) -> str:
        return "sheet string, row_no int, " + ", ".join(f"c{i + 1} string" for i in range(self._width()))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], len(schema.fields) - 2)
