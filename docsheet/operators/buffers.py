"""Buffers put together from parts, with references patched into their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import little
from .runs import part_offsets


def _concatenated(pieces: Column) -> Column:
    """An array of binary pieces as one: joined as digits, so the work grows with the bytes and not with pieces times bytes."""
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p)), ""))


def patched(parts: DataFrame, patches: DataFrame, by: list[str], data: str, at: str = "at", value: str = "value", size: int = 4) -> DataFrame:
    """``parts`` (by, data) with the ``size`` low-endian bytes of each patch (by, at, value) put over theirs, and ``unplaced``: how many patches are not.

    The patches of a part are sorted once and the part is cut at them. A patch that doesn't lie in its part, begins before the one ahead of it ends or
    has no value (or one that doesn't fit) is not placed; of patches at one place the least value counts. A part is a bounded buffer; a null one stays null.
    """
    each = patches.select(*[F.col(b).alias(f"_{b}") for b in by], F.struct(F.col(at).cast("long").alias("at"), F.col(value).cast("long").alias("value")).alias("_p"))
    held = each.groupBy(*[f"_{b}" for b in by]).agg(F.array_sort(F.collect_list("_p")).alias("_patches"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    met = parts.join(held, same, "left").drop(*[f"_{b}" for b in by]).withColumn("_patches", F.coalesce("_patches", F.array().cast(each.schema["_p"].dataType.simpleString().join(("array<", ">")))))
    length = F.length(data)
    fits = F.filter("_patches", lambda p: (p["at"] >= 0) & (p["at"] + size <= length) & little(p["value"], size).isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<at:bigint,value:bigint>>").alias("kept"))
    placed = F.aggregate(fits, start, lambda s, p: F.when(p["at"] >= s["end"], F.struct((p["at"] + size).alias("end"), F.concat(s["kept"], F.array(p)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    met = met.withColumn("_kept", F.when(F.col(data).isNotNull(), placed))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("_kept", i - 1)["at"] + size)  # noqa: E731  where the patch ahead ends
    piece = lambda p, i: F.concat(F.substring(data, (before(i) + 1).cast("int"), (p["at"] - before(i)).cast("int")), little(p["value"], size))
    tail = F.substring(data, (F.coalesce(F.element_at("_kept", -1)["at"] + size, F.lit(0)) + 1).cast("int"), length)
    whole = F.when(F.size("_kept") == 0, F.col(data)).otherwise(F.concat(_concatenated(F.transform("_kept", piece)), tail))
    unplaced = F.size("_patches") - F.coalesce(F.size("_kept"), F.lit(0))
    return met.withColumn("_whole", whole).withColumn("unplaced", unplaced.cast("long")).drop("_patches", "_kept", data).withColumnRenamed("_whole", data).select(*parts.columns, "unplaced")


def joined(parts: DataFrame, by: list[str], order: str, data: str, targets: DataFrame | None = None, target: str = "target", offset: str = "offset") -> tuple[DataFrame, DataFrame | None]:
    """((by, data): the parts of each group one after the other, ``targets`` (by, order, target, offset) with offsets in the whole). A null part is empty; a target of a part that isn't there goes."""
    placed = part_offsets(parts.select(*by, order, F.coalesce(data, F.lit(b"")).alias(data)).withColumn("_n", F.length(data).cast("long")), by, order, "_n")
    whole = placed.groupBy(*by).agg(_concatenated(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d")))), lambda p: p["d"])).alias(data))
    if targets is None:
        return whole, None
    base = placed.select(*[F.col(c).alias(f"_{c}") for c in (*by, order)], F.col("base").alias("_base"))
    same = F.lit(True)
    for c in (*by, order):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return whole, targets.join(base, same).select(*by, target, (F.col(offset) + F.col("_base")).alias(offset))


def linked(parts: DataFrame, targets: DataFrame, references: DataFrame, by: list[str], order: str, data: str) -> DataFrame:
    """(by, data, unplaced): whole buffers in which every reference holds the offset of its target.

    ``targets`` (by, order, target, offset) and ``references`` (by, order, target, at) lie in parts; of several targets of one name the first offset counts, a reference without one is not placed.
    """
    whole, there = joined(parts, by, order, data, targets)
    _, asked = joined(parts, by, order, data, references, offset="at")
    first = there.groupBy(*by, "target").agg(F.min("offset").alias("value"))
    key = [*by, "target"]
    same = F.lit(True)
    other = first.select(*[F.col(c).alias(f"_{c}") for c in key], "value")
    for c in key:
        same = same & asked[c].eqNullSafe(other[f"_{c}"])
    patches = asked.join(other, same, "left").select(*by, "at", "value")
    return patched(whole, patches, by, data)
