"""Cell blocks and lookups over cells held as rows (sheet, row, column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scanned


def cells_in_blocks(cells: DataFrame, blocks: DataFrame, width: int = 256) -> DataFrame:
    """Cells (row, column, value) joined with the blocks (block, r1, r2, c1, c2) they lie in: an equi-join on bands of ``width`` rows, then exact bounds."""
    band = F.explode(F.sequence(F.floor(F.col("r1") / width), F.floor(F.col("r2") / width))).alias("_band")
    banded = blocks.where("r1 <= r2 and c1 <= c2").select("*", band)
    rows = cells.withColumn("_band", F.floor(F.col("row") / width))
    return rows.join(banded, "_band").where("row between r1 and r2 and column between c1 and c2").drop("_band")


def block_index(blocks: DataFrame, cells: DataFrame, row: Column, column: Column) -> DataFrame:
    """INDEX: each block with the value of its cell at (row, column) counted from 1; null if there is none or it lies outside."""
    at = blocks.withColumn("row", F.col("r1") + row - 1).withColumn("column", F.col("c1") + column - 1)
    found = at.join(cells.select("row", "column", "value"), ["row", "column"], "left")
    inside = (F.col("row") <= F.col("r2")) & (F.col("column") <= F.col("c2"))
    return found.withColumn("value", F.when(inside, F.col("value")))


def offset(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """OFFSET: each cell with ``shifted``, the value so many rows and columns on; null where no cell is."""
    other = cells.select((F.col("row") - rows).alias("row"), (F.col("column") - columns).alias("column"), F.col("value").alias("shifted"))
    return cells.join(other, ["row", "column"], "left")


def lookup_exact(probes: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Probes with the ``value`` of the table's row of equal ``key`` (one row a key); null if there is none."""
    return probes.join(table.select(key, value), key, "left")


def lookup_last(probes: DataFrame, table: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """VLOOKUP, HLOOKUP and LOOKUP: probes with the ``value`` of the last table row of their group whose ``key`` isn't greater.

    Both sides go through one sort, in ranges of group and key, so no pair is ever formed and a group may be of any size. Of table rows with equal keys the greatest value counts.
    """
    one = table.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max(value).alias("_v"))
    right = one.select(*by, key, F.struct(F.col("_v").alias("v")).alias("_t"), F.lit(None).cast(probes.schema.simpleString()).alias("_p"))
    left = probes.select(*by, key, F.lit(None).cast(right.schema["_t"].dataType).alias("_t"), F.struct(*probes.columns).alias("_p"))
    both = right.unionByName(left).withColumn("_asks", F.col("_p").isNotNull())
    found = scanned(both, by, [key, "_asks"], lasts={"_found": F.col("_t")}, ties=True)
    return found.where("_asks").select("_p.*", F.col("_found.v").alias(value))


def bracket(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the last bound that isn't greater than ``value``, for a short literal table; null below the first."""
    out = F.lit(None).cast("string")
    for b, n in sorted(zip(bounds, names, strict=True)):
        out = F.when(value >= b, F.lit(n)).otherwise(out)
    return out


def resolve_reference(row: Column, column: Column, d_row: Column, d_column: Column, absolute_row: Column, absolute_column: Column) -> Column:
    """Position of a cell reference: offsets from the cell unless absolute."""
    return F.struct(F.when(absolute_row, d_row).otherwise(row + d_row).alias("row"), F.when(absolute_column, d_column).otherwise(column + d_column).alias("column"))


def decode_position(packed: Column) -> Column:
    """(column, row) of a 24-bit cell position: column in bits 2 to 9, row in bits 10 to 23."""
    return F.struct(F.shiftright(packed, 2).bitwiseAND(255).alias("column"), F.shiftright(packed, 10).bitwiseAND(16383).alias("row"))
