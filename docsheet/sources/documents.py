"""A sink that writes one file for each document and commits them as a whole.

Each attempt of a task writes to a folder of its own under ``_temporary``; only when every task is done are the files of the attempts that count
moved to their places, one after the other, and ``_SUCCESS`` is written last: a folder without it is one whose commit was cut short. Whatever fails before, a task, the job or the driver, leaves no document; an
abort removes the folder, and the next write removes one that a lost driver left. ``documents(...)`` makes the rows with a writer of the
registry in ``sinks``; ``save`` writes them.

Names never reach the driver as a whole: each attempt leaves a sorted list of its names, and the commit reads these lists side by side, line by line. What is held is the listing of one folder
of documents; with ``folders`` documents are dealt over so many of them by their names, each folder is written by one task and moved as a whole where the store can do that, and ``lengths`` lists them in tasks.
"""

from __future__ import annotations

import heapq
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "documents"
#: Endings of the writers' files.
ENDINGS = {"text": "txt", "html4": "html", "xhtml": "xhtml", "html5": "html"}
TEMPORARY = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    """What one attempt wrote: its folder; the names in it are lines of a file beside it."""

    folder: str


def file_name(name: str, ending: str) -> str:
    """A document's name as that of a file: letters, digits and ``-_.`` stay, others are percent-encoded, so different names stay different."""
    safe = quote(name, safe="")
    return f"{'%2E' + safe[1:] if safe.startswith('.') else '%5F' + safe[1:] if safe.startswith('_') else safe or '%00'}.{ending}"


def filesystem(path: str):
    """The store of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folder_of(name: str, folders: int) -> str:
    """The folder of a document with its slash: none without ``folders``."""
    return f"{zlib.crc32(name.encode()) % folders:05d}/" if folders else ""


def files_in(store, folder: str) -> list:
    """The documents of a folder alone."""
    from pyarrow import fs

    return [i for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and not i.base_name.startswith("_")]


def listed(store, m: Written) -> Iterator[str]:
    """The names of an attempt, in order."""
    rest = b""
    with store.open_input_stream(f"{m.folder}.names") as lines:
        while block := lines.read(1 << 14):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.decode() for x in whole)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.ending, self.encoding, self.overwrite = options["path"], options.get("ending", "txt"), options.get("encoding", "utf-8"), overwrite
        self.job, self.folders = uuid.uuid4().hex, int(options.get("folders", 0))

    def filesystem(self):
        return filesystem(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self.filesystem()
        folder, names, made = f"{root}/{TEMPORARY}/{self.job}/{uuid.uuid4().hex}", [], set()
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if row["name"] is None:
                raise ValueError("a document has no name")
            inside = folder_of(row["name"], self.folders)
            if inside not in made:
                store.create_dir(f"{folder}/{inside}".rstrip("/"), recursive=True)
                made.add(inside)
            names.append(inside + file_name(row["name"], self.ending))
            with store.open_output_stream(f"{folder}/{names[-1]}") as out:
                body = row["body"] or ""
                out.write(body.encode(self.encoding, "xmlcharrefreplace" if "html" in self.ending else "replace") if isinstance(body, str) else bytes(body))
        with store.open_output_stream(f"{folder}.names") as out:
            out.write("".join(f"{n}\n" for n in sorted(names)).encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.filesystem()
        done = [m for m in messages if m is not None]
        clash = []
        for folder, names in groupby(heapq.merge(*[listed(store, m) for m in done]), key=lambda n: n[: n.rfind("/") + 1]):
            there = set() if self.overwrite else {folder + i.base_name for i in files_in(store, f"{root}/{folder}".rstrip("/"))}
            clash += [n for n, same in groupby(names) if n in there or sum(1 for _ in same) > 1][:3]
            if clash:
                break
        if clash:
            self.abort(messages)
            raise ValueError(f"documents of one name: {', '.join(clash)}")
        if self.overwrite:
            for folder in ("", *self.subfolders(store, root)):
                for i in files_in(store, f"{root}/{folder}".rstrip("/")):
                    store.delete_file(i.path)
        there = {"", *(f"{x}/" for x in self.subfolders(store, root))}
        for m in done:
            for folder, names in groupby(listed(store, m), key=lambda n: n[: n.rfind("/") + 1]):
                if folder not in there:
                    there.add(folder)
                    if self.moved(store, f"{m.folder}/{folder}".rstrip("/"), f"{root}/{folder}".rstrip("/")):
                        continue
                    store.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
                for name in names:
                    store.move(f"{m.folder}/{name}", f"{root}/{name}")
        store.delete_dir(f"{root}/{TEMPORARY}")
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    @staticmethod
    def moved(store, folder: str, to: str) -> bool:
        """Whether a whole folder could be moved; stores without folders can't."""
        try:
            store.move(folder, to)
        except OSError:
            return False
        return True

    @staticmethod
    def subfolders(store, root: str) -> list[str]:
        """Folders that documents are dealt over."""
        from pyarrow import fs

        return [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.isdigit() and len(i.base_name) == 5]

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = self.filesystem()
        if store.get_file_info(f"{root}/{TEMPORARY}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{TEMPORARY}")


class Documents(DataSource):
    """Takes rows of ``name`` and ``body`` (text or bytes); options are path, ending, encoding and folders."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sink known to a session; its code travels with it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Documents)


def save(documents: DataFrame, path: str, ending: str = "txt", mode: str = "append", encoding: str = "utf-8", folders: int = 0) -> None:
    """Writes (name, body), one file each, with ``folders`` dealt over so many subfolders; with ``overwrite`` other documents of the folder go once all are written. Names must differ and may not be null; a null body is an empty file."""
    register(documents.sparkSession)
    rows = documents.select("name", "body")
    if folders:
        rows = rows.repartition(F.crc32(F.encode("name", "UTF-8")) % folders)
    rows.write.format(NAME).mode(mode).option("ending", ending).option("encoding", encoding).option("folders", folders).save(path)


def render_and_save(paras: DataFrame, by: list[str], order: str, path: str, writer: str = "text", para: str = "para", style: Column | None = None, mode: str = "append", encoding: str = "utf-8", folders: int = 0) -> None:
    """Renders documents with a writer of the registry and writes each as a file, named by the values of ``by``."""
    from .sinks import writer as named

    args = [style if style is not None else F.lit(None).cast("string")] if writer.lower() in ("xhtml", "html5") else []
    bodies = named(writer)(paras, by, order, *args, para)
    name = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])
    save(bodies.select(name.alias("name"), "body"), path, ENDINGS[writer.lower()], mode, encoding, folders)


def _by_folder(spark: SparkSession, path: str, folders: int, work, schema: str) -> DataFrame:
    """What ``work`` (store, folder) yields for each folder, in tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield work(store, f"{root}/{k:05d}")

    return spark.range(0, folders, 1, min(folders, spark.sparkContext.defaultParallelism * 4)).mapInArrow(each, schema)


def lengths(spark: SparkSession, path: str, folders: int) -> DataFrame:
    """(file, length) of the documents that were dealt over ``folders``: each is listed by a task, none by the driver."""

    def work(store, folder: str) -> pa.RecordBatch:
        found = files_in(store, folder)
        return pa.record_batch([pa.array([i.base_name for i in found], pa.string()), pa.array([i.size for i in found], pa.int64())], names=["file", "length"])

    return _by_folder(spark, path, folders, work, "file string, length long")


def drop(spark: SparkSession, path: str, folders: int) -> None:
    """Deletes the documents that were dealt over ``folders``, each folder in a task."""
    from pyarrow import fs

    def work(store, folder: str) -> pa.RecordBatch:
        there = store.get_file_info(folder).type == fs.FileType.Directory
        if there:
            store.delete_dir(folder)
        return pa.record_batch([pa.array([there])], names=["there"])

    _by_folder(spark, path, folders, work, "there boolean").agg(F.count_if("there")).collect()
