"""Positions and pages of cells against plain sums."""

import random

from pyspark.sql import functions as F

from docsheet.operators import geometry, runs


def test_cells_lie_where_their_lines_end(spark):
    rng = random.Random(3)
    cells = [(rng.choice([1, 2, None]), rng.randrange(60), rng.randrange(12), i) for i in range(200)] + [(1, -1, 0, 900), (1, None, 0, 901), (3, 5, 5, 902)]
    sizes = {d: [(s, line, rng.choice([None, 0, 7, 30])) for s in (1, 2, None) for line in rng.sample(range(-3, n), n // 3)] for d, n in (("row", 60), ("column", 12))}
    sizes["row"] += [(1, 4, 9), (1, 4, 11)]
    breaks = {d: [(s, line) for s in (1, None) for line in rng.sample(range(n), n // 6)] * 2 for d, n in (("row", 60), ("column", 12))}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)

    def of(d, default):
        sized = frame([(s, k, None if z is None else float(z)) for s, k, z in sizes[d]], f"s int, {d} long, size double")
        return sized, frame([(1, default), (2, default + 1), (None, default)], "s int, size double"), frame(breaks[d], f"s int, {d} long")

    got = geometry.cell_places(frame(cells, "s int, row long, column long, x long"), of("row", 15.0), of("column", 80.0), ["s"], 2.0)
    rows = got.collect()
    assert len(rows) == len(cells)

    def place(d, s, line, default):
        own = {}
        for t, k, z in sizes[d]:
            if t == s and k >= 0 and z is not None:
                own[k] = max(own.get(k, 0), z)
        return sum(own.get(k, default) for k in range(line)), own.get(line, default), len({k for t, k in breaks[d] if t == s and k <= line})

    deepest = {}
    for s, r, c, _ in cells:
        if r is not None and r >= 0:
            deepest[s] = max(deepest.get(s, 0), place("row", s, r, 0)[2])
    for r in rows:
        s, line, column = r["s"], r["row"], r["column"]
        if line is None or line < 0:
            assert r["y"] is None and r["page"] is None
            continue
        if s == 3:
            assert r["y"] is None
            continue
        y, h, pr = place("row", s, line, 15.0 + (s == 2))
        x, w, pc = place("column", s, column, 80.0 + (s == 2))
        assert (r["x"], r["y"], r["width"], r["height"], r["page"]) == (2 * x, 2 * y, 2 * w, 2 * h, pc * (deepest[s] + 1) + pr)


def test_a_code_whose_last_value_is_null(spark):
    rows = spark.createDataFrame([(1, 0, 7, "a"), (1, 1, 7, None), (2, 0, 8, "b")], "k int, n int, code int, value string")
    got = {r["k"]: (r["c7"], r["c8"]) for r in runs.fold_codes(rows, ["k"], ["n"], {7: F.lit("x"), 8: F.lit("y")}).collect()}
    assert got == {1: (None, "y"), 2: ("x", "b")}
