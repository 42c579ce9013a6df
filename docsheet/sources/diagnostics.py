"""Rows checked while they are written: counters by level and code, bad rows aside, a limit that stops the job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .files import LEVELS
from .shared import delete_path

#: Rows with a message of these levels are bad.
GRAVE = ("fatal", "error")


@dataclass(frozen=True)
class Rule:
    """A message for rows that meet a condition (null: they don't)."""

    level: str
    code: str
    condition: Column


class TooManyErrors(RuntimeError):
    """More bad rows than were allowed; nothing was kept."""


def _has(rule: Rule) -> Column:
    return F.exists("messages", lambda m: (m["level"] == rule.level) & (m["code"] == rule.code))


def _stopping(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = 0
        for batch in batches:
            bad += pc.sum(pc.equal(batch.column("checked"), "bad")).as_py() or 0
            if bad > limit:
                raise RuntimeError(f"a task has more than {limit} bad rows")
            yield batch

    return run


def write_checked(rows: DataFrame, path: str, rules: list[Rule], limit: int | None = None) -> dict[tuple[str, str], int]:
    """Writes ``rows`` as Parquet, the good ones to ``path``/checked=good and the bad ones to ``path``/checked=bad, each with ``messages`` (level, code), in one pass, and returns how often each rule was met.

    The counts are an observation of the write itself: no second pass. With a ``limit`` a task stops as soon as it alone has met more bad rows, and if the tasks together have,
    what was written is deleted; either way TooManyErrors is raised. A column called ``messages`` or ``checked`` is replaced.
    """
    for rule in rules:
        if rule.level not in LEVELS:
            raise ValueError(f"no level is called {rule.level}")
    spark, counted = rows.sparkSession, Observation()
    met = [F.coalesce(r.condition, F.lit(False)) for r in rules]
    messages = F.filter(F.array(*[F.when(m, F.struct(F.lit(r.level).alias("level"), F.lit(r.code).alias("code"))) for m, r in zip(met, rules, strict=True)]), lambda x: x.isNotNull())
    checked = rows.drop("messages", "checked").withColumn("messages", messages).withColumn("checked", F.when(F.exists("messages", lambda m: m["level"].isin(*GRAVE)), "bad").otherwise("good"))
    codes = [F.count_if(_has(r)).alias(f"{i}") for i, r in enumerate(rules)]
    observed = checked.observe(counted, F.count_if(F.col("checked") == "bad").alias("bad"), *codes)
    if limit is not None:
        observed = observed.mapInArrow(_stopping(limit), observed.schema)
    try:
        observed.write.partitionBy("checked").parquet(path)
    except Exception as failure:
        if "bad rows" in str(failure):
            delete_path(spark, path)
            raise TooManyErrors(f"more than {limit} bad rows") from failure
        raise
    found = counted.get
    if limit is not None and found["bad"] > limit:
        delete_path(spark, path)
        raise TooManyErrors(f"{found['bad']} bad rows, {limit} are allowed")
    return {(r.level, r.code): found[str(i)] for i, r in enumerate(rules)}
