"""Scans over ranges, what is built on them, and aggregates of many blocks, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from docsheet.operators import blocks, runs, scan, sheet


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_equals_a_loop(spark, parts):
    """One group with most rows, null keys, null values, clashing names; ranges that a group spans."""
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, rng.choice([None, rng.random()]), "x", i) for i in range(500)]
    table = spark.createDataFrame(rows, "g int, o int, x double, _part string, _of_g int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["o"]: r for r in scan.scanned(table, ["g"], ["o"], sums={"s": F.col("x")}, lasts={"l": F.col("x")}, previous={"p": F.col("x")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    total, last, before = {}, {}, {}
    for g, o, x, *_ in rows:
        total[g] = total.get(g, 0.0) + (x or 0.0)
        last[g] = x if x is not None else last.get(g)
        r = got[o]
        assert r["s"] == pytest.approx(total[g]) and r["l"] == last[g] and (r["p"]["v"] if r["p"] else "none") == before.get(g, "none") and (r["g"], r["_part"], r["_of_g"]) == (g, "x", o)
        before[g] = x
    assert len(got) == 500


def test_a_hot_group_is_spread(spark):
    """A group with nine tenths of the rows: no range has more than three times the median."""
    table = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("g"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = scan.scanned(table, ["g"], ["o"], sums={"n": F.lit(1)})
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in made.inputFiles()})
        sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 3 * statistics.median(sizes) and len(sizes) >= 4 and "SinglePartition" not in plan
    assert made.where("g = -1").agg(F.max("n")).first()[0] == 18000


def test_lookups_and_runs_of_one_hot_key(spark):
    table = spark.createDataFrame([("a", k, f"v{k}") for k in range(0, 1000, 3)], "g string, k long, v string")
    probes = spark.range(3000).select(F.lit("a").alias("g"), (F.col("id") % 1000).alias("k"), F.col("id"))
    got = sheet.lookup_last(probes, table, ["g"], "k", "v").collect()
    assert len(got) == 3000 and all(r["v"] == f"v{r['k'] - r['k'] % 3}" for r in got)
    events = spark.range(1000).select(F.lit(None).cast("int").alias("u"), "id", F.when(F.floor(F.col("id") / 10) % 2 == 0, "x").alias("e"))
    merged = runs.merge_runs(events, ["u"], ["id"], ["e"]).collect()
    assert sorted((r["run_no"], r["e"], r["n_rows"], r["first"]) for r in merged) == [(k + 1, "x" if k % 2 == 0 else None, 10, 10 * k) for k in range(100)]
    owners = spark.createDataFrame([(1, k, k % 3) for k in range(100)], "u int, o int, n int")
    pool = spark.range(120).select(F.lit(1).alias("u"), "id")
    dealt = {r["id"]: r["o"] for r in runs.consume_pool(owners, pool, "u", "o", "n", "id").collect()}
    assert dealt == dict(enumerate([k for k in range(100) for _ in range(k % 3)])) | {}


def test_block_aggregates_equal_scans_of_the_cells(spark):
    rng = random.Random(4)
    cells = [(rng.randrange(400), rng.randrange(20) if k % 9 else 255, rng.choice([None, rng.randrange(-50, 50)])) for k in range(1500)] + [(7, 7, 3), (7, 7, 3), (None, 1, 9)]
    asked = [(b, r := rng.randrange(-5, 400), r + rng.randrange(-3, 300), c := rng.randrange(0, 21), c + rng.choice([-1, 0, 1, 5, 19, 235])) for b in range(300)] + [(900, 0, 399, 0, 255), (901, -9, -1, 0, 3), (902, None, 5, 1, 1)]
    table = spark.createDataFrame(cells, "row long, column long, value int")
    got = {r["block"]: r for r in blocks.block_aggregates(table, spark.createDataFrame(asked, "block int, r1 long, r2 long, c1 long, c2 long"), kind="decimal(20,0)").collect()}
    assert len(got) == len(asked)
    for b, r1, r2, c1, c2 in asked:
        v = [] if r1 is None else [x for r, c, x in cells if r is not None and x is not None and r1 <= r <= r2 and c1 <= c <= c2]
        r = got[b]
        assert (r["n"], r["total"], r["squares"], r["low"], r["high"]) == (len(v), sum(v), sum(x * x for x in v), min(v, default=None), max(v, default=None)), (b, r1, r2, c1, c2)
        assert r["average"] == (pytest.approx(statistics.fmean(v)) if v else None) and r["varp"] == (pytest.approx(statistics.pvariance(v)) if v else None) and r["var"] == (pytest.approx(statistics.variance(v)) if len(v) > 1 else None)
    with pytest.raises(Exception, match="columns lie"):
        blocks.block_aggregates(spark.createDataFrame([(1, 256, 1)], "row long, column long, value int"), spark.createDataFrame([(1, 1, 1, 1, 1)], "block int, r1 long, r2 long, c1 long, c2 long")).collect()


def test_blocks_without_cells(spark):
    none = spark.createDataFrame([], "row long, column long, value double")
    asked = spark.createDataFrame([(1, 0, 5, 0, 5)], "block int, r1 long, r2 long, c1 long, c2 long")
    assert [tuple(r)[5:] for r in blocks.block_aggregates(none, asked).collect()] == [(0, 0.0, 0.0, None, None, None, None, None)]


def test_blocks_scan_the_intervals_they_need_once(spark, monkeypatch):
    """Cells go into one scan, only by the intervals that some block is made of."""
    seen, plain = [], blocks.scanned

    def counted(rows, *args, **more):
        seen.append(rows.count())
        return plain(rows, *args, **more)

    monkeypatch.setattr(blocks, "scanned", counted)
    cells = spark.createDataFrame([(r, c, r * c) for r in range(50) for c in range(8)], "row long, column long, value int")
    got = blocks.block_aggregates(cells, spark.createDataFrame([(1, 10, 20, 3, 3)], "block int, r1 long, r2 long, c1 long, c2 long")).first()
    assert (got["n"], got["total"], got["low"], got["high"]) == (11, 495.0, 30.0, 60.0) and seen == [52]
