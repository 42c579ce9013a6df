"""Palettes held as tables, one for each picture: colours of pixels and pixels of colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import scratch, written

#: Cells of the colour cube along each side, as a power of two, from coarse to fine.
SIDES = (2, 3, 4, 6)
RGB = ("red", "green", "blue")


def _cells() -> dict[str, Column]:
    """The cell of a colour for each of ``SIDES``, as one number; what is beyond 0 to 1 lies in the outer cells, NaN in cells of its own."""
    most = 1 << SIDES[-1]
    along = [F.when(F.isnan(c), most).otherwise(F.least(F.greatest(F.floor(F.col(c) * most), F.lit(0)), F.lit(most - 1))).cast("int") for c in RGB]
    number = lambda side: sum((F.shiftright(x, SIDES[-1] - side) * (2 * most) ** k for k, x in enumerate(along[1:], 1)), F.shiftright(along[0], SIDES[-1] - side))
    return {f"_{k}": number(side) for k, side in enumerate(SIDES)}


def _known(palettes: DataFrame, by: list[str]) -> DataFrame:
    """Entries with all their parts; of entries of one number the least colour counts."""
    rows = palettes.where(" and ".join(f"{c} is not null" for c in ("entry", *RGB))).groupBy(*by, F.col("entry").cast("int").alias("entry")).agg(F.min(F.struct(*[F.col(c).cast("double").alias(c) for c in RGB])).alias("_c"))
    return rows.select(*by, "entry", "_c.*")


def _on(by: list[str], *more: str) -> list[tuple[str, str]]:
    return [(c, f"_{c}") for c in (*by, *more)]


def _met(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "left") -> DataFrame:
    """A join in which nulls are equal; the right side's keys are renamed and go."""
    other, same = right.withColumnsRenamed(dict(keys)), F.lit(True)
    for a, b in keys:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return left.join(other, same, how).drop(*[b for _, b in keys])


def nearest(pixels: DataFrame, palettes: DataFrame, by: list[str]) -> DataFrame:
    """``pixels`` (by, red, green, blue and others) with ``colour``: the entry of their picture's palette (by, entry, red, green, blue) at the least squared distance, of equals the first.

    Distinct colours of a picture are looked up once, and entries of one colour count once. The colour cube is cut into cells, finer and finer; of the pairs of a cell of colours and a cell of
    entries only those stay whose entries can be nearest: no other cell's farthest distance is less than their nearest one. Finer cells are paired inside the pairs that stay. So a colour
    meets the entries of a few small cells, whatever the palette's size, and the result is exact. A colour with a null part, and one without a palette, has a null colour.
    """
    wanted = pixels.select(*by, *[F.col(c).cast("double").alias(c) for c in RGB]).where(" and ".join(f"{c} is not null" for c in RGB)).distinct()
    entries = _known(palettes, by).groupBy(*by, *RGB).agg(F.min("entry").alias("entry"))
    with scratch(pixels.sparkSession):
        wanted, entries = written(wanted.withColumns(_cells())), written(entries.withColumns(_cells()))
        pairs = None
        for k in range(len(SIDES)):
            a, b = _boxes(wanted, by, k, "a"), _boxes(entries, by, k, "b")
            if pairs is None:
                pairs = _met(a, b, _on(by), "inner")
            else:
                pairs = _met(_met(pairs, a, [*_on(by), (f"a_{k - 1}", "_up")], "inner"), b, [*_on(by), (f"b_{k - 1}", "_up")], "inner")
            pairs = written(_near(pairs, [*by, f"a_{k}"]).select(*by, f"a_{k}", f"b_{k}"))
        last = len(SIDES) - 1
        mine = wanted.select(*by, F.col(f"_{last}").alias("_at"), F.struct(*RGB).alias("_c"))
        theirs = entries.select(*by, F.col(f"_{last}").alias("_at"), F.struct(*RGB, "entry").alias("_e"))
        met = _met(_met(pairs, mine, [*_on(by), (f"a_{last}", "_at")], "inner"), theirs, [*_on(by), (f"b_{last}", "_at")], "inner")
        gap = lambda c: F.col("_c")[c] - F.col("_e")[c]
        best = F.min(F.struct(_square(gap).alias("d"), F.col("_e")["entry"].alias("entry")))["entry"].alias("colour")
        found = written(met.groupBy(*by, "_c").agg(best).select(*by, "_c.*", "colour"), kept=True)
    return _met(pixels.drop("colour"), found, _on(by, *RGB))


def _square(part) -> Column:
    return sum((part(c) * part(c) for c in RGB[1:]), part(RGB[0]) * part(RGB[0]))


def _boxes(rows: DataFrame, by: list[str], k: int, side: str) -> DataFrame:
    """Cells of level ``k`` with the boxes that their colours fill (rather than the cells: colours beyond 0 to 1 have boxes of their own size), and the cells around them as ``_up``."""
    up = [F.first(f"_{k - 1}").alias("_up")] if k else []
    return rows.groupBy(*by, F.col(f"_{k}").alias(f"{side}_{k}")).agg(*[f(c).alias(f"{side}_{c}_{n}") for c in RGB for n, f in (("low", F.min), ("high", F.max))], *up)


def _near(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The pairs whose nearest distance isn't over the least farthest one of their key."""
    gap = lambda c: F.greatest(F.col(f"a_{c}_low") - F.col(f"b_{c}_high"), F.col(f"b_{c}_low") - F.col(f"a_{c}_high"), F.lit(0.0))
    reach = lambda c: F.greatest(F.abs(F.col(f"a_{c}_high") - F.col(f"b_{c}_low")), F.abs(F.col(f"b_{c}_high") - F.col(f"a_{c}_low")))
    least = F.min("_far").over(W.partitionBy(*key))
    return pairs.withColumns({"_gap": _square(gap), "_far": _square(reach)}).withColumn("_least", least).where(F.col("_gap") <= F.col("_least") * (1 + 1e-12))


def colours(pixels: DataFrame, palettes: DataFrame, by: list[str], pixel: str = "pixel") -> DataFrame:
    """``pixels`` with the red, green and blue of their entry; that of the least entry for pixels without one, null without a palette."""
    entries = _known(palettes, by)
    first = entries.groupBy(*by).agg(F.min(F.struct("entry", *RGB)).alias("_first"))
    own = entries.select(*by, F.col("entry").alias(pixel), F.struct(*RGB).alias("_own"))
    met = _met(_met(pixels.drop(*RGB), own, _on(by, pixel)), first, _on(by))
    return met.withColumns({c: F.coalesce(F.col("_own")[c], F.col("_first")[c]) for c in RGB}).drop("_own", "_first")
