"""Nested objects, patched buffers, palettes as tables, checked writes."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from docsheet import queries
from docsheet.functions.binary import uint
from docsheet.operators import buffers, nested, palettes
from docsheet.sources import diagnostics as D


def thing(*children: bytes, wild=()) -> bytes:
    """A byte with the number of objects, their places (16 bits each), and the objects."""
    places, at, body = [], 1 + 4 * (len(children) + len(wild)), b""
    for c in children:
        places.append((at, len(c)))
        body += c
        at += len(c)
    return bytes([len(places) + len(wild)]) + b"".join(struct.pack("<HH", *p) for p in [*places, *wild]) + body


def children(data):
    n = uint(data, 0, 1)
    entries = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.struct(uint(data, 1 + 4 * k, 2).alias("offset"), uint(data, 3 + 4 * k, 2).alias("length")))
    return F.when((n > 0) & (F.length(data) >= 1 + 4 * n), entries).when(n == 0, F.array().cast("array<struct<offset:bigint,length:bigint>>"))


def test_objects_in_objects(spark):
    leaf = thing()
    deep = thing(thing(leaf, thing(leaf)), leaf)
    looped = thing(leaf, wild=[(0, 10)])
    assert len(looped) == 10
    bad = thing(b"\x05", wild=[(2, 99)])
    rows = spark.createDataFrame([(1, deep), (2, looped), (3, bad), (4, b""), (5, None)], "f int, data binary")
    got = {(r["f"], r["object_path"]): (r["depth"], r["offset"], r["length"], r["status"]) for r in nested.expanded(rows, ["f"], "data", children).collect()}
    assert got == {
        (1, ""): (0, 0, len(deep), "ok"), (1, "0"): (1, 9, len(thing(leaf, thing(leaf))), "ok"), (1, "0/0"): (2, 18, 1, "ok"), (1, "0/1"): (2, 19, 6, "ok"), (1, "0/1/0"): (3, 24, 1, "ok"), (1, "1"): (1, 25, 1, "ok"),
        (2, ""): (0, 0, 10, "ok"), (2, "0"): (1, 9, 1, "ok"), (2, "1"): (1, 0, 10, "loop"), (3, ""): (0, 0, len(bad), "ok"), (3, "0"): (1, 9, 1, "unreadable"), (3, "1"): (1, 2, 99, "outside"), (4, ""): (0, 0, 0, "unreadable"), (5, ""): (0, 0, None, "unreadable"),
    }
    shallow = {r["object_path"]: r["status"] for r in nested.expanded(rows.where("f = 1"), ["f"], "data", children, depth=1).collect()}
    assert shallow == {"": "ok", "0": "ok", "1": "ok", "0/0": "too deep", "0/1": "too deep"}


def test_references_in_joined_parts(spark):
    """Targets and references in parts of random lengths against plain bytes."""
    rng = random.Random(8)
    parts, targets, refs, want, lost = [], [], [], {}, {}
    for doc in (1, 2, None):
        whole, base = b"", {}
        for k in range(6):
            data = bytes(rng.randrange(256) for _ in range(rng.randrange(8, 40))) if k != 3 else b""
            parts.append((doc, k, data if data else None))
            base[k] = len(whole)
            whole += data
        names = {f"t{j}": (k := rng.choice([0, 1, 2, 4, 5]), rng.randrange(4)) for j in range(5)}
        targets += [(doc, k, name, at) for name, (k, at) in names.items()]
        out, n = bytearray(whole), 0
        for k in (0, 1, 2, 4, 5):
            name = rng.choice([*names, "none"])
            refs.append((doc, k, name, 2))
            if name == "none":
                n += 1
            else:
                out[base[k] + 2 : base[k] + 6] = struct.pack("<I", base[names[name][0]] + names[name][1])
        refs.append((doc, 5, "t0", 1000))  # outside
        want[doc], lost[doc] = bytes(out), n + 1
    made = buffers.linked(spark.createDataFrame(parts, "d int, k int, data binary"), spark.createDataFrame(targets, "d int, k int, target string, offset long"), spark.createDataFrame(refs, "d int, k int, target string, at long"), ["d"], "k", "data")
    assert {r["d"]: (bytes(r["data"]), r["unplaced"]) for r in made.collect()} == {d: (want[d], lost[d]) for d in want}


def test_patches_that_overlap(spark):
    part = spark.createDataFrame([(1, bytes(12)), (2, bytes(4)), (3, None)], "k int, data binary")
    patches = spark.createDataFrame([(1, 0, 1), (1, 2, 9), (1, 4, 2), (1, 4, 3), (1, 9, 4), (1, 8, None), (2, 0, -1), (3, 0, 5)], "k int, at long, value long")
    got = {r["k"]: (r["data"], r["unplaced"]) for r in buffers.patched(part, patches, ["k"], "data").collect()}
    assert bytes(got[1][0]) == struct.pack("<III", 1, 2, 0) and got[1][1] == 4 and (bytes(got[2][0]), got[2][1]) == (bytes(4), 1) and got[3] == (None, 1)


def test_nearest_colours_equal_all_distances(spark):
    rng = random.Random(6)
    entries = [(p, e, rng.random(), rng.random(), rng.random()) for p in (1, 2) for e in range(300 if p == 1 else 3)] + [(1, 900, 0.5, 0.5, 0.5), (1, 5, 0.5, 0.5, 0.5), (2, 7, None, 0.0, 0.0), (None, 4, 0.1, 0.1, 0.1)]
    pixels = [(rng.choice([1, 2, 3, None]), rng.choice([rng.random(), 0.5, 0.0, 1.0, 1.5, -0.2]), rng.random(), rng.choice([rng.random(), 0.5])) for _ in range(400)] + [(1, None, 0.1, 0.1)] * 2 + [(1, 0.5, 0.5, 0.5)]
    got = palettes.nearest(spark.createDataFrame([(i, *p, "x") for i, p in enumerate(pixels)], "i int, p int, red double, green double, blue double, colour string"), spark.createDataFrame(entries, "p int, entry int, red double, green double, blue double"), ["p"]).collect()
    known = {}
    for p, e, *c in entries:
        if None not in c:
            known.setdefault(p, {})[e] = min(known.get(p, {}).get(e, c), c)
    want = {}
    for i, (p, *c) in enumerate(pixels):
        own = known.get(p, {})
        want[i] = min(((x - c[0]) * (x - c[0]) + (y - c[1]) * (y - c[1]) + (z - c[2]) * (z - c[2]), e) for e, (x, y, z) in own.items())[1] if own and None not in c else None
    assert {r["i"]: r["colour"] for r in got} == want and len(got) == len(pixels)


def test_colours_of_entries(spark):
    table = spark.createDataFrame([(1, 0, 0.1, 0.2, 0.3), (1, 1, 0.4, 0.5, 0.6)], "p int, entry int, red double, green double, blue double")
    got = palettes.colours(spark.createDataFrame([(1, 1), (1, 9), (1, None), (2, 0)], "p int, pixel int"), table, ["p"]).collect()
    assert sorted(((r["p"], r["pixel"], r["red"]) for r in got), key=str) == sorted([(1, 1, 0.4), (1, 9, 0.1), (1, None, 0.1), (2, 0, None)], key=str)


def test_checked_writes(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 8).select("id", F.when(F.col("id") % 7 != 0, F.col("id")).alias("x"), F.lit("mine").alias("messages"))
    rules = [D.Rule("error", "no x", F.col("x").isNull()), D.Rule("warn", "big", F.col("x") > 990), D.Rule("error", "never", F.lit(None).cast("boolean"))]
    assert D.write_checked(rows, str(tmp_path / "a"), rules) == {("error", "no x"): 143, ("warn", "big"): 8, ("error", "never"): 0}
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.where("checked = 'bad'").count() == 143 and back.where("checked = 'good'").count() == 857 and back.where("size(messages) = 1 and checked = 'good'").count() == 8
    for limit in (10, 142):  # one task alone, and all of them together
        with pytest.raises(D.TooManyErrors):
            D.write_checked(rows, str(tmp_path / f"b{limit}"), rules, limit)
        assert not (tmp_path / f"b{limit}").exists()
    assert D.write_checked(rows, str(tmp_path / "c"), rules, 143)[("error", "no x")] == 143
    with pytest.raises(ValueError, match="no level"):
        D.write_checked(rows, str(tmp_path / "d"), [D.Rule("bad", "x", F.lit(True))])


def test_integers_beyond_32_bits(spark, tmp_path):
    """Keys whose multiple needs more than four bytes come back whole."""
    rows = [(4256657, 70000), (4256658, 70000), (1 << 50, 5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in queries.QUERIES["uint_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {(k, cust % 256, cust % 65536, k * 1009) for k, cust in rows}


def test_nearest_colours_of_a_palette_that_repeats_its_colours(spark):
    """Entries of one colour count once, dense colours and NaN are met exactly, and no cell holds a list of the palette."""
    rng = random.Random(7)
    nan = float("nan")
    shades = [(rng.random() / 50, rng.random() / 50, rng.random()) for _ in range(200)] + [(nan, 0.5, 0.5), (0.01, nan, 0.2)]
    entries = [(1, e, *shades[e * 31 % len(shades)]) for e in range(3000)] + [(2, 8, nan, 0.1, 0.1), (2, 3, nan, 0.2, 0.2)]
    pixels = [(1, rng.random() / 40, rng.random() / 40, rng.random()) for _ in range(300)] + [(2, 0.1, 0.1, 0.1), (2, 0.7, 0.1, 0.9)]
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(pixels)], "i int, p int, red double, green double, blue double")
    got = palettes.nearest(asked, spark.createDataFrame(entries, "p int, entry int, red double, green double, blue double"), ["p"])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {}
    for i, (p, *c) in enumerate(pixels):
        distances = [((x - c[0]) * (x - c[0]) + (y - c[1]) * (y - c[1]) + (z - c[2]) * (z - c[2]), e) for k, e, x, y, z in entries if k == p]
        want[i] = min(((float("inf") if d != d else d), e) for d, e in distances)[1]
    assert {r["i"]: r["colour"] for r in got.collect()} == want
