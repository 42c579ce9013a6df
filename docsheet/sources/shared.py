"""Tables written to the folder that all executors share, and when they go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session uses a temporary one and a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Open scopes, innermost last: of this thread or task alone, so that one query never deletes what another still reads.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Where the tables that ``written`` has read back lie.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``written`` wrote inside (but for those to be kept); what is read from them must be written by then."""
    made: list[str] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in made:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def note(path: str, kept: bool = False) -> None:
    """``path`` is to be deleted at the end of the scope (of the one around it, if ``kept``), if there is one."""
    scopes = _scopes.get()
    if len(scopes) > kept:
        scopes[-1 - kept].append(path)


def written(df: DataFrame, compression: str = "snappy", kept: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, so lost executors cost no recomputation of what came before. ``kept`` tables outlive the scope they are made in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    note(path, kept)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def written_together(*tables: DataFrame) -> list[DataFrame]:
    """``written`` of several tables at once: they don't wait for each other."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda c, t: c.run(written, t), [copy_context() for _ in tables], tables))


def delete_table(df: DataFrame) -> None:
    """Deletes the files of a table of ``written`` before its scope ends: nothing reads it any more."""
    delete_path(df.sparkSession, _places[df])
