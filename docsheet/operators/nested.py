"""Objects inside objects: sub-buffers as rows, level by level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import subrange
from ..sources.shared import scratch, written


def expanded(buffers: DataFrame, by: list[str], content: str, children: Callable[[Column], Column], depth: int = 32) -> DataFrame:
    """(by, object_path, depth, offset, length, data, status): a row for each buffer and each object in it, at any depth.

    ``children`` gives the objects that a buffer names as an array of (offset, length) inside it, null where the buffer can't be read. A
    path numbers the objects from 0 ("2/0"; that of a buffer itself is empty), offsets count from the beginning of the outermost buffer. ``status`` is ok,
    ``unreadable`` (null buffers are), ``outside`` where an object doesn't lie in its parent, ``loop`` where it is no shorter than its parent, so that it would hold itself, and
    ``too deep`` beyond ``depth`` levels; such objects are rows without data and have no objects. Each level is written before the next, and
    holds the bytes of its objects only.
    """
    zero = F.lit(0).cast("long")
    found: list[DataFrame] = []
    with scratch(buffers.sparkSession):
        named = children(F.col(content))
        level = written(buffers.select(*by, F.lit("").alias("object_path"), F.lit(0).alias("depth"), zero.alias("offset"), F.length(content).cast("long").alias("length"), F.col(content).cast("binary").alias("data"), F.when(named.isNull(), "unreadable").otherwise("ok").alias("status"), named.alias("_named")))
        while True:
            found.append(level.drop("_named"))
            each = level.where("status = 'ok'").select(*by, "object_path", "depth", "offset", "length", "data", F.posexplode("_named").alias("_k", "_o"))
            start, size = F.col("_o.offset").cast("long"), F.col("_o.length").cast("long")
            path = F.concat(F.col("object_path"), F.when(F.col("depth") > 0, "/").otherwise(""), F.col("_k").cast("string"))
            status = F.when(start.isNull() | size.isNull() | (start < 0) | (size < 0) | (start + size > F.col("length")), "outside").when(size >= F.col("length"), "loop").when(F.col("depth") >= depth, "too deep").otherwise("ok")
            cut = each.select(*by, path.alias("object_path"), (F.col("depth") + 1).alias("depth"), (F.col("offset") + start).alias("offset"), size.alias("length"), F.when(status == "ok", subrange(F.col("data"), start, size)).alias("data"), status.alias("status"))
            read = cut.withColumn("_named", F.when(F.col("status") == "ok", children(F.col("data"))))
            level = written(read.withColumn("status", F.when((F.col("status") == "ok") & F.col("_named").isNull(), "unreadable").otherwise(F.col("status"))))
            if level.isEmpty():
                return written(reduce(DataFrame.unionByName, found), kept=True)
