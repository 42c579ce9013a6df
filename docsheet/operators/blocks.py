"""Aggregates over many overlapping blocks of cells, by lookups instead of a row for each cell and block.

Columns are cut into dyadic intervals: a cell lies in one of each width, a block's columns are at most two of each width. In each interval
running sums over the rows give SUM, COUNT and what follows from them: a block takes two lookups an interval. For MIN and MAX
the rows of an interval are numbered and cut into chunks of ``CHUNK``; a sparse table over the chunks (the extreme of every 2^k neighbours) answers what
lies between the first and the last chunk with two lookups, and those two chunks are looked through themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete_table, scratch, written
from .scan import scanned

#: Columns of a sheet lie from 0 to 2^WIDTH - 1; rows of a chunk.
WIDTH, CHUNK = 8, 64


def _intervals(first: Column, last: Column) -> Column:
    """The dyadic intervals (j, i) that make up the columns from ``first`` to ``last``: i covers 2^j columns from i * 2^j on."""
    made = []
    for j in range(WIDTH + 1):
        low, high = F.ceil(first / 2**j).cast("long"), F.floor((last + 1) / 2**j).cast("long") - 1  # the intervals of this width that lie inside
        is_maximal = lambda i, low=low, high=high: (i >= low) & (i <= high) & ~((F.floor(i / 2) * 2 >= low) & (F.floor(i / 2) * 2 + 1 <= high))  # noqa: E731  none twice as wide does
        for i in (low, high):
            made.append(F.when(is_maximal(i), F.struct(F.lit(j).alias("j"), i.alias("i"))))
    return F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))


def block_aggregates(cells: DataFrame, blocks: DataFrame, extremes: bool = True, kind: str = "double") -> DataFrame:
    """``blocks`` (block, r1, r2, c1, c2) with n, total, squares, average, varp, var and, with ``extremes``, low and high of the values of ``cells`` (row, column, value) in them.

    n is 0 for a block without values, and the others but total and squares are null there. ``kind`` is the type that sums are carried in: a decimal is exact; with
    doubles a block's error is in proportion to the sum of all cells above it. Cells of one place count each for itself, null values and places not at all; a block whose corners are in the
    wrong order is empty. Repeated block numbers must name the same block. Columns beyond 0 to 2^WIDTH - 1 raise an error.
    """
    inside = F.when(F.col("column").between(0, 2**WIDTH - 1), F.col("column")).otherwise(F.raise_error(F.lit(f"columns lie from 0 to {2**WIDTH - 1}")).cast("long"))
    x = F.col("value").cast(kind)
    known = cells.where("row is not null and column is not null and value is not null").select(F.col("row").cast("long").alias("row"), inside.cast("long").alias("column"), x.alias("x"))
    spark = cells.sparkSession
    with scratch(spark):
        asked = written(blocks.select("block", "r1", "r2", "c1", "c2").distinct())
        fits = "r1 <= r2 and c1 <= c2"
        pieces = written(asked.where(fits).select("block", "r1", "r2", F.explode(_intervals(F.greatest("c1", F.lit(0)), F.least("c2", F.lit(2**WIDTH - 1)))).alias("_k")).select("block", "r1", "r2", "_k.*"))
        # a cell counts in those of its intervals that some block is made of: 2^(WIDTH + 1) - 1 there can be
        needed = sorted(tuple(r) for r in pieces.select("j", "i").distinct().collect())
        own = lambda j: F.floor(F.col("column") / 2**j).cast("long")
        levels = [F.when(own(j).isin([i for k, i in needed if k == j]), F.struct(F.lit(j).alias("j"), own(j).alias("i"))) for j in sorted({j for j, _ in needed})]
        kind_of = "array<struct<j:int,i:bigint>>"
        lies_in = F.explode(F.array_compact(F.array(*levels)).cast(kind_of) if levels else F.array().cast(kind_of))
        grouped = known.select("row", "x", lies_in.alias("_k")).groupBy(F.col("_k.j").alias("j"), F.col("_k.i").alias("i"), "row")
        rows = grouped.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), *([F.min("x").alias("lo"), F.max("x").alias("hi")] if extremes else []))
        ends = ["lo", "hi"] if extremes else []
        edges = pieces.select("block", "j", "i", F.explode(F.array(F.struct((F.col("r1") - 1).alias("row"), F.lit(-1).alias("sign")), F.struct(F.col("r2").alias("row"), F.lit(1).alias("sign")))).alias("_e")).select("block", "j", "i", "_e.*")
        data = rows.select(F.lit(None).cast(asked.schema["block"].dataType).alias("block"), "j", "i", F.col("row"), F.lit(0).alias("sign"), "n", "s", "q", *ends)
        probes = edges.select("block", "j", "i", "row", "sign", *[F.lit(None).cast(data.schema[c].dataType).alias(c) for c in ("n", "s", "q", *ends)])
        with scratch(spark):  # what is dealt goes with the scan; its rows and their numbers serve the extremes, too
            both = written(data.unionByName(probes).withColumn("probe", (F.col("sign") != 0).cast("int")))
            sums = scanned(both, ["j", "i"], ["row", "probe"], sums={"n": F.col("n"), "s": F.col("s"), "q": F.col("q"), "rank": 1 - F.col("probe")}, ties=True)
            delete_table(both)
            sums = sums if extremes else sums.where("probe = 1")
            shown = lambda name: F.when(F.col("probe") == 1, F.col(name)).alias(name)  # noqa: E731  running sums are asked for at the edges of blocks alone
            sums = written(sums.select("block", "j", "i", "sign", "probe", *[shown(x) for x in ("n", "s", "q")], "rank", *ends), kept=True)
        found = sums.where("probe = 1")
        signed = lambda name: F.sum(F.col("sign") * F.col(name)).alias(name)
        totals = found.groupBy("block").agg(signed("n"), signed("s"), signed("q"))
        if extremes:
            spans = found.groupBy("block", "j", "i").agg(F.max(F.when(F.col("sign") < 0, F.col("rank"))).alias("a"), F.max(F.when(F.col("sign") > 0, F.col("rank"))).alias("b")).where("a < b")
            ranked = sums.where("probe = 0").select("j", "i", (F.col("rank") - 1).alias("rank"), "lo", "hi").withColumn("c", F.floor(F.col("rank") / CHUNK))
            totals = totals.join(_extremes(ranked, written(spans)), "block", "left")
        out = written(asked.join(totals, "block", "left"), kept=True)
    n, s, q = F.coalesce("n", F.lit(0)).alias("n"), F.col("s").cast("double"), F.col("q").cast("double")
    spread = F.greatest(F.lit(0.0), q - s * s / F.col("n"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    some = lambda least, v: F.when(F.col("n") >= least, v)
    ends = [F.col("lo").cast("double").alias("low"), F.col("hi").cast("double").alias("high")] if extremes else []
    return out.select("block", "r1", "r2", "c1", "c2", n, zero(s).alias("total"), zero(q).alias("squares"), some(1, s / F.col("n")).alias("average"), some(1, spread / F.col("n")).alias("varp"), some(2, spread / (F.col("n") - 1)).alias("var"), *ends)


def _extremes(ranked: DataFrame, spans: DataFrame) -> DataFrame:
    """(block, lo, hi): ``spans`` (block, j, i, a, b) are the rows numbered from a up to b of an interval, ``ranked`` (j, i, rank, lo, hi, c) all rows with their chunks."""
    ends = F.explode(F.array_distinct(F.array(F.floor(F.col("a") / CHUNK), F.floor((F.col("b") - 1) / CHUNK)))).alias("c")
    partly = spans.select("block", "j", "i", "a", "b", ends).join(ranked.groupBy("j", "i", "c").agg(F.collect_list(F.struct("rank", "lo", "hi")).alias("v")), ["j", "i", "c"])
    mine = partly.withColumn("v", F.filter("v", lambda r: (r["rank"] >= F.col("a")) & (r["rank"] < F.col("b")))).select("block", F.array_min(F.transform("v", lambda r: r["lo"])).alias("lo"), F.array_max(F.transform("v", lambda r: r["hi"])).alias("hi"))
    level = written(ranked.groupBy("j", "i", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    between = spans.select("block", "j", "i", (F.floor(F.col("a") / CHUNK) + 1).alias("f"), (F.floor((F.col("b") - 1) / CHUNK) - 1).alias("t")).where("f <= t")
    wanted = between.withColumn("k", F.floor(F.log2(F.col("t") - F.col("f") + 1)).cast("int"))
    wanted = written(wanted.select("block", "j", "i", "k", F.explode(F.array_distinct(F.array(F.col("f"), F.col("t") - F.pow(F.lit(2), F.col("k")).cast("long") + 1))).alias("c")))
    deepest = wanted.agg(F.max("k")).first()[0]
    k = 0
    while deepest is not None:
        mine = mine.unionByName(wanted.where(F.col("k") == k).join(level, ["j", "i", "c"]).select("block", "lo", "hi"))
        if k == deepest:
            break
        other = level.select("j", "i", (F.col("c") - 2**k).alias("c"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
        level = written(level.join(other, ["j", "i", "c"]).select("j", "i", "c", F.least("lo", "l2").alias("lo"), F.greatest("hi", "h2").alias("hi")))
        k += 1
    return mine.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
