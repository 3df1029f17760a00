"""A reader of folders of word tables, as the local recogniser writes them: data source `word_tables`.

It plans partitions by ranges of bytes, whatever the number and size of the files, and takes filters on level and page: a row that they
refuse is passed over before its other fields are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from foliospark.sources.publishing import _store

# The recogniser's columns in their order
SCHEMA = "file string, level int, page int, block int, par int, line int, word int, left double, top double, width double, height double, conf double, text string"
PUSHED = ("level", "page")
PART_BYTES = 32 << 20
ROWS = 10_000
_TESTS = {EqualTo: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str, part_bytes: int):
        self.folder, self.part_bytes = folder, part_bytes
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters):  # noqa: N802  name of the API
        for f in filters:
            column = getattr(f, "attribute", ())
            known = len(column) == 1 and column[0] in PUSHED
            if known and type(f) in _TESTS and isinstance(f.value, int):
                self.tests.append((PUSHED.index(column[0]), type(f), f.value))
            elif known and type(f) is In and all(isinstance(v, int) for v in f.value):
                self.tests.append((PUSHED.index(column[0]), In, frozenset(f.value)))
            elif not (known and type(f) is IsNotNull):  # a row without them isn't read at all
                yield f

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        store, base = _store(self.folder)
        whole = store.get_file_info(base)
        found = [whole] if whole.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base))
        files = [f for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith((".", "_"))]
        return [_Range(f.path, at, min(f.size, at + self.part_bytes)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.part_bytes)]

    def _wanted(self, level: int, page: int) -> bool:
        row = (level, page)
        return all(row[i] in v if kind is In else _TESTS[kind](row[i], v) for i, kind, v in self.tests)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin within the range, the last of them to its end."""
        store, _ = _store(self.folder)
        names = [c.split() for c in SCHEMA.split(", ")]
        kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in names])
        label, rows = partition.file.rsplit("/", 1)[-1], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*rows), kinds)], schema=kinds)

        for line in _lines(store, partition):
            row = parsed(line, self._wanted)
            if row is not None:
                rows.append((label, *row))
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


def _lines(store, part: _Range) -> Iterator[bytes]:
    with store.open_input_file(part.file) as source:
        at, held = max(0, part.start - 1), b""
        source.seek(at)
        # from one byte before its beginning, what comes before the first line's end is another range's
        skip = part.start > 0
        while True:
            chunk = source.read(1 << 20)
            held += chunk
            *whole, rest = held.split(b"\n")
            if not chunk:
                whole, rest = ([rest] if rest else []), b""
            for line in whole:
                begun, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif begun < part.end:
                    yield line.rstrip(b"\r")
                else:
                    return
            held = rest
            if not chunk:
                return


def parsed(line: bytes, wanted=lambda level, page: True) -> tuple | None:
    """Fields of a line; None for the head, a line of fewer than twelve columns or with another number, and one that isn't wanted.

    Tabs within the text stay; bytes that aren't UTF-8 are replaced.
    """
    head = line.split(b"\t", 2)
    try:
        if len(head) < 3 or not wanted(int(head[0]), int(head[1])):
            return None
        rest = head[2].split(b"\t", 9)
        if len(rest) < 10:
            return None
        return (int(head[0]), int(head[1]), *map(int, rest[:4]), *map(float, rest[4:9]), rest[9].decode("utf-8", "replace"))
    except ValueError:
        return None


class WordTables(DataSource):
    """Rows of the word tables in the folder `path`, or of one file. Option part_bytes: size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "word_tables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def read(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of all word tables in a folder; hidden files and those that begin with _ are passed over.

    Filters on level and page reach the reader, for which the session's spark.sql.python.filterPushdown.enabled is set; such a reader
    can't be used where it is off.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordTables)
    return spark.read.format("word_tables").option("path", folder).option("part_bytes", str(part_bytes)).load()
