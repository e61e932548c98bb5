"""Peak-list text (BEGIN IONS / END IONS) as a splittable Spark data source and as a table function.

A file is cut into byte ranges. A block begins right after the END IONS line
before it, or at the file's beginning, and belongs to the range in which that
line begins; its reader goes on into later ranges to finish it. So the rows do
not depend on the cuts, one large file keeps many tasks busy, and no line is
sorted or moved. Filters on header columns are judged before peaks are parsed.

Lines outside a block are passed over. Only a line that is END IONS in any case
ends a block. Files are opened by Arrow's file systems (local, HDFS, S3, GCS,
Azure); a byte-order mark at a file's beginning is dropped, bytes that are no
UTF-8 are replaced.
"""
from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

SCHEMA = ("file string, start bigint, headers map<string,string>, pepmass double, adduct string, "
          "peaks array<struct<mz:double,i:double>>, problem string")
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("pepmass", pa.float64()), ("adduct", pa.string()),
                    ("peaks", pa.list_(pa.struct([("mz", pa.float64()), ("i", pa.float64())]))), ("problem", pa.string())])
READ_BYTES = 1 << 20
BATCH_PEAKS = 100_000
#: Either byte ends a line; between the two of CR LF lies an empty one, which means nothing.
_ENDS = re.compile(rb"[\r\n]")


@dataclass
class Block:
    """Raw lines of one block: where it starts, header lines, peak lines, and what is wrong with it."""

    start: int
    headers: list[tuple[str, str]]
    lines: list[str]
    problem: str | None

    def fields(self) -> dict[str, str]:
        """Headers by lower-cased key; the last of a repeated key holds, and a PEPMASS is its first number."""
        return {k.lower(): (v.split() or [""])[0] if k.lower() == "pepmass" else v for k, v in self.headers}

    def peaks(self) -> list[dict | None]:
        """The first two numbers of every peak line; sets ``problem`` where a line has none."""
        out = []
        for line in self.lines:
            try:
                mz, i = map(float, line.split()[:2])
                out.append({"mz": mz, "i": i})
            except ValueError:
                self.problem = self.problem or "malformed peak line"
                out.append({"mz": None, "i": None})
        return out


def blocks(lines: Iterator[tuple[int, str]], until: int | None = None) -> Iterator[Block]:
    """Blocks of (position, text) lines. The last block is the one that follows the last END IONS before ``until``."""
    current, begins = None, 0
    for at, text in lines:
        text = text.strip()
        word = text.upper()
        if not text or text[0] in "#;":
            continue
        if word == "BEGIN IONS":
            current = current or Block(at, [], [], None)
            begins += 1
        elif word == "END IONS":
            block = current or Block(at, [], [], None)
            block.problem = "nested BEGIN IONS" if begins > 1 else None if begins else "END IONS without BEGIN IONS"
            yield block
            current, begins = None, 0
            if until is not None and at >= until:
                return
        elif current is not None:
            key, found, value = text.partition("=")
            current.headers.append((key, value)) if found else current.lines.append(text)
    if current is not None:
        current.problem = "block without END IONS"
        yield current


def text_lines(text: str) -> Iterator[tuple[int, str]]:
    """(line number, line) of a text in memory."""
    return enumerate(text.removeprefix("\ufeff").replace("\r", "\n").split("\n"))


def _byte_lines(f, start: int) -> Iterator[tuple[int, str]]:
    """(byte position, line) from the first line that begins at ``start`` or later."""
    f.seek(max(start - 1, 0))
    held, at, whole = b"", max(start - 1, 0), start == 0
    while True:
        data = f.read(READ_BYTES)
        held += data
        *lines, held = _ENDS.split(held) if data else [*_ENDS.split(held), b""]
        for line in lines:
            if whole:
                text = line.decode("utf-8", "replace")
                yield at, text.removeprefix("\ufeff") if at == 0 else text
            whole = True
            at += len(line) + 1
        if not data:
            return


@dataclass
class _Range(InputPartition):
    path: str
    name: str
    start: int
    end: int


_TESTS = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


class PeakListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", 64 << 20))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes what is said about ``pepmass`` and ``adduct``; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = f.value if isinstance(f, In) else [getattr(f, "value", 0)]
            if column not in ("pepmass", "adduct") or any(v is None or v != v or v == math.inf for v in values):  # NULL and NaN have rules of their own
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((column, lambda x: x is not None))
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, lambda x, v=f.value: x == v))
            elif isinstance(f, In):
                self.tests.append((column, lambda x, v=frozenset(f.value): x in v))
            elif type(f) in _TESTS and column == "pepmass":
                self.tests.append((column, lambda x, v=f.value, test=_TESTS[type(f)]: x is not None and test(math.inf if x != x else x, v)))
            else:
                yield f

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self):
        from pyarrow import fs

        where, base = self._open()
        info = where.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(base, recursive=True))
        named = [(i, i.path[len(base.rstrip("/")):].lstrip("/") or i.base_name) for i in files if i.type == fs.FileType.File and i.base_name[0] not in "._"]
        return [_Range(i.path, name, at, min(at + self.split, i.size)) for i, name in sorted(named, key=lambda x: x[1]) for at in range(0, i.size, self.split)]

    def read(self, part: _Range):
        where, _ = self._open()
        rows, held = [], 0
        with where.open_input_file(part.path) as f:
            lines = _byte_lines(f, part.start)
            if part.start:  # what precedes the first END IONS belongs to an earlier range
                for at, text in lines:
                    if at >= part.end:
                        return
                    if text.strip().upper() == "END IONS":
                        break
                else:
                    return
            for block in blocks(lines, part.end):
                fields = block.fields()
                judged = {"pepmass": _number(fields.get("pepmass")), "adduct": fields.get("adduct")}
                if not all(test(judged[c]) for c, test in self.tests):
                    continue
                peaks = block.peaks()
                rows.append({"file": part.name, "start": block.start, "headers": list(fields.items()), **judged, "peaks": peaks, "problem": block.problem})
                held += len(peaks) + 1
                if held >= BATCH_PEAKS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class PeakListSource(DataSource):
    """``spark.read.format("peaklist").load(path)``; option ``splitBytes`` sets the size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "peaklist"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PeakListReader(self.options)


class PeakRecords:
    """Table function peak_records(text, 'key,key,...'): the blocks of a text cell.

    The named headers become columns of text, in that order, followed by peaks
    and problem; so its schema follows from its second argument.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        if not keys.isConstantExpression or not isinstance(keys.value, str):
            raise ValueError("the second argument names headers, as constant text")
        names = [k.strip().lower() for k in keys.value.split(",") if k.strip()]
        peaks = ArrayType(StructType([StructField("mz", DoubleType()), StructField("i", DoubleType())]))
        return AnalyzeResult(StructType([*[StructField(k, StringType()) for k in names], StructField("peaks", peaks), StructField("problem", StringType())]))

    def eval(self, text: str | None, keys: str):
        names = [k.strip().lower() for k in keys.split(",") if k.strip()]
        for block in blocks(text_lines(text or "")):
            fields = block.fields()
            peaks = [(p["mz"], p["i"]) for p in block.peaks()]
            yield (*[fields.get(k) for k in names], peaks, block.problem)


def register(spark: SparkSession) -> None:
    """Makes the source and the table function known to a session, which lets filters reach Python sources from then on."""
    from pyspark.sql.functions import udtf

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PeakListSource)
    spark.udtf.register("peak_records", udtf(PeakRecords))
