"""Where the cells of a sheet lie: positions from sparse line sizes with a default, pages from breaks.

Only lines whose size differs from their sheet's default have a row. The position of a line is the default for each line before it, plus what
the sized ones among those differ by: a running sum over the sized lines and the lines asked for, scanned in ranges. The page of a line is
the number of breaks at or before it, found in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scanned


def line_places(asked: DataFrame, sizes: DataFrame, defaults: DataFrame, breaks: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, line, at, size, page) for the distinct lines of ``asked``: ``sizes`` (by, line, size), ``defaults`` (by, size), ``breaks`` (by, line).

    Lines count from 0, as pages do; a break stands before its line. A null size is the default; of several sizes of a line the largest counts, repeated
    breaks are one. A sheet without a default has null positions, lines before the first one and null lines have none at all.
    """
    lines = asked.select(*by, F.col(line).cast("long").alias("line")).where("line >= 0").distinct()
    own = defaults.groupBy(*by).agg(F.max("size").cast("double").alias("default"))
    sized = sizes.select(*by, F.col(line).cast("long").alias("line"), F.col("size").cast("double").alias("size")).where("line >= 0 and size is not null").groupBy(*by, "line").agg(F.max("size").alias("size"))
    broken = breaks.select(*by, F.col(line).cast("long").alias("line")).where("line >= 0").distinct()
    none = F.lit(None).cast("double")
    # in one line its break comes first, then what asks for it, then its size: that counts for the lines behind it
    events = broken.select(*by, "line", F.lit(0).alias("kind"), none.alias("size")).unionByName(lines.select(*by, "line", F.lit(1).alias("kind"), none.alias("size"))).unionByName(sized.select(*by, "line", F.lit(2).alias("kind"), "size"))
    sums = {"before": F.col("size"), "known": F.when(F.col("kind") == 2, 1).otherwise(0), "page": F.when(F.col("kind") == 0, 1).otherwise(0)}
    placed = scanned(events, by, ["line", "kind"], sums=sums).where("kind = 1").select(*by, "line", "before", "known", "page")
    found = _joined(_joined(placed, own, by), sized, [*by, "line"])
    at = F.col("before") + (F.col("line") - F.col("known")) * F.col("default")
    return found.select(*by, F.col("line").alias(line), at.alias("at"), F.coalesce("size", "default").alias("size"), F.col("page").cast("long").alias("page"))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join in which nulls are equal."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(other[f"_{c}"])
    return left.join(other, same, "left").drop(*[f"_{c}" for c in on])


def cell_places(cells: DataFrame, rows: tuple[DataFrame, DataFrame, DataFrame], columns: tuple[DataFrame, DataFrame, DataFrame], by: list[str], scale: Column | float = 1.0) -> DataFrame:
    """``cells`` (by, row, column and others) with x, y, width and height (times ``scale``: points to pixels), page_row and page_column, and page: pages are counted down and then across, by those that cells lie on.

    ``rows`` and ``columns`` are each (sizes, defaults, breaks), as in ``line_places``. Columns called like one of the results are replaced.
    """
    down = line_places(cells, *rows, by, "row").withColumnsRenamed({"at": "y", "size": "height", "page": "page_row"})
    across = line_places(cells, *columns, by, "column").withColumnsRenamed({"at": "x", "size": "width", "page": "page_column"})
    names = ("x", "y", "width", "height", "page_row", "page_column", "page")
    placed = _joined(_joined(cells.drop(*names), down, [*by, "row"]), across, [*by, "column"])
    tall = _joined(cells.select(*by).distinct(), down.groupBy(*by).agg((F.max("page_row") + 1).alias("_tall")), by)
    placed = _joined(placed, tall, by).withColumn("page", F.col("page_column") * F.col("_tall") + F.col("page_row")).drop("_tall")
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    return placed.withColumns({n: F.col(n) * factor for n in ("x", "y", "width", "height")})
