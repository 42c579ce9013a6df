"""Running sums and last known values over ordered groups of any size.

Rows are dealt by ranges of (group, order), so a group with most of the rows is spread over many tasks; each range is scanned
alone and takes up what the ranges before it in its group have left behind. Only groups that span several ranges have something
to take up, so what is carried has two rows a range at most. The dealt rows are written first: ranges and sums are of the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def scanned(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, ties: bool = False) -> DataFrame:
    """``rows`` with running sums (null counts as 0), last known values (null where none is known yet) and values of the row before (as structs of ``v``, null for the first row) of columns, in ``order`` inside the groups of ``by``.

    Sums and last values are those up to and with each row. Null keys are a group, nulls come first in the order. Rows that are equal in ``order`` may come in any order; with ``ties`` those are spread, too.
    """
    drawn, part, there, ranges, *mates = _unused(rows, "_drawn", "_part", "_there", "_ranges", *[f"_of_{b}" for b in by])
    kinds = {"sum": sums or {}, "last": lasts or {}, "previous": previous or {}}
    held = {out: (kind, _unused(rows, f"_{kind}_{out}")[0], x if kind == "sum" else F.when(x.isNotNull() | F.lit(kind == "previous"), F.struct(x.alias("v")))) for kind, wanted in kinds.items() for out, x in wanted.items()}
    place = [*order, *([drawn] if ties else [])]
    rows = rows.withColumns({n: x for _, n, x in held.values()})
    if ties:
        rows = rows.withColumn(drawn, F.rand(17))
    keys = [*by, *place]
    dealt = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id()))
    window = W.partitionBy(part, *by).orderBy(*place)
    upto = window.rowsBetween(W.unboundedPreceding, W.currentRow)
    here = {"sum": lambda n: F.sum(n).over(upto), "last": lambda n: F.last(n, ignorenulls=True).over(upto), "previous": lambda n: F.lag(n).over(window)}
    total = {"sum": lambda n: F.sum(n), "last": lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*place)))}
    left = dealt.groupBy(part, *by).agg(*[total["sum" if kind == "sum" else "last"](n).alias(n) for kind, n, _ in held.values()])
    several = left.withColumn(ranges, F.count(F.lit(1)).over(W.partitionBy(*by))).where(F.col(ranges) > 1)
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = several.select(F.col(part).alias(there), *[F.col(b).alias(m) for b, m in zip(by, mates, strict=True)], *[(F.sum(n) if kind == "sum" else F.last(n, ignorenulls=True)).over(before).alias(f"{n}_c") for kind, n, _ in held.values()])
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(m)) for b, m in zip(by, mates, strict=True)], F.col(part) == F.col(there))
    met = dealt.withColumns({f"{n}_r": here[kind](n) for kind, n, _ in held.values()}).join(F.broadcast(carried), same, "left")
    made = {}
    for out, (kind, n, _) in held.items():
        if kind == "sum":
            made[out] = F.coalesce(F.col(f"{n}_r"), F.lit(0)) + F.coalesce(F.col(f"{n}_c"), F.lit(0))
        else:
            found = F.coalesce(F.col(f"{n}_r"), F.col(f"{n}_c"))
            made[out] = found["v"] if kind == "last" else found
    own = [c for c in rows.columns if c not in {drawn, part, *(n for _, n, _ in held.values()), *made}]
    return met.select(*own, *[v.alias(out) for out, v in made.items()])


def _unused(rows: DataFrame, *names: str) -> list[str]:
    """Names near ``names`` that no column of ``rows`` has, in any case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
