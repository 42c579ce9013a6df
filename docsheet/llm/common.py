"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_path, delete_table, note, scratch, shared_folder  # noqa: F401  for the operators
from ..sources.shared import written as materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


@contextmanager
def sharded_table(df: DataFrame, key: str, shards: int) -> Iterator[DataFrame]:
    """``df`` as a table bucketed and sorted by ``key``, so that what is grouped or joined by it moves the other side only; dropped at the end, with its files."""
    spark, name = df.sparkSession, f"sharded_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tables/{name}"
    df.write.bucketBy(shards, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete_path(spark, path)


#: Lists of ids up to this length (16 bytes each) are broadcast; beyond it joins with them shuffle.
BROADCAST_IDS = 1_000_000


def having_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id is one of ``ids``; both have a column ``id``, and ``ids`` is a written table without repeats."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once per application)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/docsheet", "zip", root, "docsheet"))
        _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with those of its columns renamed that are called like columns of our own (in any case), and what gives them their names back."""
    own = {n.lower() for n in names}
    clashes = [c for c in df.columns if c.lower() in own]
    free, taken = [], {c.lower() for c in df.columns} | own
    for c in clashes:
        name = f"{c}_own"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return df.withColumnsRenamed(dict(zip(clashes, free, strict=True))), lambda out: out.withColumnsRenamed(dict(zip(free, clashes, strict=True)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, near ``names``, that ``df`` doesn't have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
