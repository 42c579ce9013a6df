"""Sections of document files as a data source that plans its splits: byte ranges are read, never whole files.

``register(spark)``, then ``spark.read.format("document_sections").load(folder)``. A split is a range of sections of one file, or several small
files; large files have their section table (at the offset that bytes 16 to 19 name: a byte with twice the number of entries, then pairs of
32-bit words, identifier and offset) read when the splits are planned, so their sections go to many tasks, and sections over ``chunk``
bytes come as several rows. Only the sections named by the option ``sections`` are read; with the option ``push`` the source also takes filters on ``section_id`` (= or IN),
for which the session must have spark.sql.python.filterPushdown.enabled set. Nothing is decoded.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "document_sections"
#: Bytes of a header up to and with the table's offset; entries of a table at most (a byte holds twice their number).
HEADER, ENTRIES = 20, 127


@dataclass
class Section:
    ordinal: int
    section_id: int
    offset: int
    length: int | None


@dataclass
class Split(InputPartition):
    """Files with the sections to read, or none if the task is to read the table itself, and the first byte and the end of what it takes of a single section."""

    files: list[tuple[str, int, list[Section] | None]]


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def section_table(file, size: int) -> tuple[list[Section], str]:
    """The sections of a file in the order of its table, and its status. A section ends where the next one in the file, the table or the file does; one that begins beyond the end has no length."""
    head = read_at(file, 0, HEADER)
    if len(head) < HEADER:
        return [], "short"
    at = struct.unpack_from("<I", head, 16)[0]
    table = read_at(file, at, 1 + 8 * ENTRIES) if at < size else b""
    n = table[0] // 2 if table else 0
    if not table or len(table) < 1 + 8 * n:
        return [], "no table"
    pairs = [struct.unpack_from("<II", table, 1 + 8 * k) for k in range(n)]
    ends = sorted({offset for _, offset in pairs} | {at, size})
    return [Section(k, uid, offset, next((e for e in ends if e > offset), offset) - offset if offset < size else None) for k, (uid, offset) in enumerate(pairs)], "ok"


class SectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.split, self.chunk = int(options.get("split", 128 << 20)), int(options.get("chunk", 16 << 20))
        self.wanted = {int(x, 0) for x in options["sections"].split(",")} if options.get("sections") else None

    def filesystem(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, root = self.filesystem()
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and f.base_name[:1] not in "._")

    def partitions(self) -> list[Split]:
        store, _ = self.filesystem()
        splits, held, total = [], [], 0
        for path, size in self.files():
            if size <= self.split:
                held.append((path, size, None))
                total += size
                if total >= self.split:
                    splits.append(Split(held))
                    held, total = [], 0
                continue
            with store.open_input_file(path) as file:
                sections, status = section_table(file, size)
            mine, load = [], 0
            for s in [s for s in sections if self.wanted is None or s.section_id in self.wanted] if status == "ok" else [None]:
                mine.append(s)
                load += (s.length or 0) if s else 0
                if load >= self.split or s is None:
                    splits.append(Split([(path, size, None if s is None else mine)]))
                    mine, load = [], 0
            if mine:
                splits.append(Split([(path, size, mine)]))
        return [*splits, Split(held)] if held else splits

    def read(self, partition: Split) -> Iterator[tuple]:
        store, _ = self.filesystem()
        for path, size, sections in partition.files:
            with store.open_input_file(path) as file:
                status = "ok"
                if sections is None:
                    sections, status = section_table(file, size)
                if status != "ok":
                    if self.wanted is None:
                        yield path, None, None, None, None, None, None, status
                    continue
                for s in sections:
                    if self.wanted is not None and s.section_id not in self.wanted:
                        continue
                    if s.length is None:
                        yield path, s.ordinal, s.section_id, s.offset, None, None, None, "beyond the end"
                        continue
                    for k, start in enumerate(range(0, max(s.length, 1), self.chunk)):
                        yield path, s.ordinal, s.section_id, s.offset, s.length, k, read_at(file, s.offset + start, min(self.chunk, s.length - start)), "ok"


class PushingReader(SectionReader):
    """Takes filters on ``section_id``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the name that Spark calls
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("section_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class Sections(DataSource):
    """(path, ordinal, section_id, offset, length, chunk, data, status): sections of damaged files are rows whose status says what is wrong."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, ordinal int, section_id long, offset long, length long, chunk int, data binary, status string"

    def reader(self, schema) -> SectionReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingReader if options.get("push", "false").lower() == "true" else SectionReader)(options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session; its code travels with it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Sections)
