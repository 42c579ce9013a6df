"""Binary decoding, cells, lookups and streams on small inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from docsheet.functions import binary as B
from docsheet.functions import cells as C
from docsheet.functions import formula as X
from docsheet.functions import text as T
from docsheet.operators import runs, sheet
from docsheet.plans import evaluate
from docsheet.sources import files, sinks
from docsheet.streaming import ingest

HEADERS = {"word": "370000106D0000107F000010FE9F0855", "texted": "370000106D00001085000010F4630855", "sketch": "370000106D0000107D0000109CF90855", "sheet": "370000106D00001088000010A8150855", "mbm": "37000010420000100000000039643947", "clipart": "41000010"}


@pytest.fixture
def folder(tmp_path):
    for name, code in HEADERS.items():
        (tmp_path / name).write_bytes(bytes.fromhex(code))
    (tmp_path / "bad").write_bytes(bytes.fromhex(HEADERS["word"][:-2] + "54"))
    (tmp_path / "short").write_bytes(b"\x37\0\0")
    (tmp_path / "empty").write_bytes(b"")
    return tmp_path


def test_headers(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in files.headers(files.scan(spark, str(folder))).collect()}
    assert got == {k: k for k in HEADERS} | {"bad": "error", "short": "error"}  # Spark leaves empty files out


def test_sections(spark, folder):
    entries = [(0x10000089, 40), (0x10000105, 50), (0x10000089, 60)]
    body = bytes.fromhex(HEADERS["word"]) + struct.pack("<I", 20) + bytes([6]) + b"".join(struct.pack("<II", *e) for e in entries)
    (folder / "table").write_bytes(body)
    (folder / "cut").write_bytes(body[:-4])
    table = files.sections(files.scan(spark, str(folder), "[tc]*"), F.lit(20)).where("path like '%table' or path like '%cut'")
    assert sorted((r.path[-3:], r.ordinal, r.section_id, r.offset) for r in table.collect()) == [("ble", k, *e) for k, e in enumerate(entries)] + [("cut", k, *e) for k, e in enumerate(entries[:2])]
    last = {r.path[-3:]: r.offset for r in files.last_of_section(table, 0x10000089).collect()}
    assert last == {"ble": 60, "cut": 40}


def test_stream_equals_batch(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    pick = lambda df: files.headers(df).select("path", "kind")
    ingest.ingest(ingest.stream_files(spark, str(folder)), pick, f"{out}/t", f"{out}/c").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/t").collect())) == sorted(map(tuple, pick(files.scan(spark, str(folder))).collect()))


@pytest.mark.parametrize("encode,decode,limit", [(B.s_encode, B.s_varint, 0x1FFF), (B.x_encode, B.x_varint, 0x1FFFFFFF)])
def test_varints(spark, encode, decode, limit):
    values = [0, 1, 63, 64, 127, 128, 8191, 8192, 16383, 16384, limit, limit + 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", encode(F.col("v")).alias("code")).select("v", "code", decode(F.col("code"), 0).alias("back"), decode(F.substring("code", F.lit(1), F.length("code") - 1), 0).alias("cut")).collect()
    for r in rows:
        assert (r.code is None) == (r.v > limit)
        if r.code is not None:
            assert (r.back["value"], r.back["size"]) == (r.v, len(r.code)) and (r.cut is None or r.cut["value"] is None)


def test_integers(spark):
    data = bytes([1, 2, 3, 0x84])
    r = spark.createDataFrame([(bytearray(data),)], "d binary").select(B.uint(F.col("d"), 0, 4).alias("u"), B.sint(F.col("d"), 0).alias("s"), B.uint(F.col("d"), 3, 2).alias("over"), B.uint(F.col("d"), -1, 1).alias("under")).first()
    assert (r.u, r.s, r.over, r.under) == (0x84030201, -0x04030201, None, None)


def test_cells(spark):
    cells = [C.cell(F.lit("blank")), C.cell(F.lit("int"), num=F.lit(4)), C.cell(F.lit("bool"), flag=F.lit(True)), C.cell(F.lit("error"), error=F.lit(7)), C.cell(F.lit("string"), text=F.lit(" 2 ")), C.cell(F.lit("string"), text=F.lit("x"))]
    row = spark.range(1).select(*[C.combine(X.div, C.cell(F.lit("int"), num=F.lit(8)), x, none=2).alias(f"c{k}") for k, x in enumerate(cells)]).first()
    assert [(c.num, c.err) for c in row] == [(None, 2), (2.0, None), (8.0, None), (None, 7), (4.0, None), (None, 3)]
    assert [r for r in spark.range(1).select(*[C.error_label(C.failed(k)).alias(f"e{k}") for k in range(8)]).first()] == list(C.ERRORS)


def test_formulas(spark):
    cases = {
        "find": (X.find(F.lit("b"), F.lit("abcb"), 3), 4), "missing": (X.find(F.lit("z"), F.lit("abc"), 1), None), "div": (X.div(F.lit(1.0), F.lit(0.0)), None), "acos": (X.FUNCTIONS["ACOS"][1](F.lit(2.0)), None),
        "value": (X.value(F.lit("12x")), None), "date": (X.date(F.lit(1900), F.lit(1), F.lit(1)), 1), "hour": (X.hour(F.lit(0.75)), 18), "fact": (X.fact(F.lit(5)), 120.0), "fact0": (X.fact(F.lit(0)), 1.0), "neg": (X.fact(F.lit(-1)), None),
        "combin": (X.combin(F.lit(5), F.lit(2)), 10.0), "permut": (X.permut(F.lit(5), F.lit(2)), 20.0), "none": (X.permut(F.lit(5), F.lit(0)), 1.0), "address": (X.address(F.lit(7), F.lit(28)), "$AB$7"), "letters": (X.column_letters(F.lit(703)), "AAA"),
        "irr": (F.round(X.irr(F.array(*[F.lit(float(x)) for x in (-100, 60, 60)])), 6), 0.130662), "noirr": (X.irr(F.array(F.lit(1.0), F.lit(1.0))), None), "ddb": (X.ddb(F.lit(100.0), F.lit(50.0), F.lit(4), F.lit(2)), 0.0), "choose": (X.choose(F.lit(4), F.lit(1), F.lit(2)), None),
    }
    row = spark.range(1).select(*[v.alias(k) for k, (v, _) in cases.items()]).first()
    assert {k: row[k] for k in cases} == {k: w for k, (_, w) in cases.items()}
    refs = [tuple(r.r) if r.r else None for r in spark.createDataFrame([("$B$3",), ("aa10",), ("3B",), ("",), (None,)], "t string").select(X.reference(F.col("t")).alias("r")).collect()]
    assert refs == [(3, 2), (10, 27), None, None, None]


def test_evaluation(spark):
    token = lambda m, v=None: F.struct(F.lit(m).alias("marker"), F.lit(v).cast("double").alias("number"))
    good = F.array(token(0x1F, 2), token(0x1F, 3), token(0x0B), token(0x7D))  # sqrt(2 ^ 3)
    left, few, none = F.array(token(0x1F, 1), token(0x1F, 2)), F.array(token(0x07)), F.array(token(0x1F, 1), token(0x1F, 0), token(0x0A))
    row = spark.range(1).select(*[evaluate.evaluate(t).alias(f"v{k}") for k, t in enumerate((good, left, few, none))]).first()
    assert row[0] == pytest.approx(8**0.5) and list(row)[1:] == [None, None, None]
    cells = spark.createDataFrame([(k, float(k)) for k in range(6)], "cell long, base double")
    edges = spark.createDataFrame([(1, 0, 2.0), (2, 1, 1.0), (2, 0, 1.0), (3, 4, 1.0), (4, 3, 1.0), (5, 3, 1.0)], "cell long, needs long, weight double")
    assert {r.cell: (r.value, r.level) for r in evaluate.evaluate_levels(cells, edges).collect()} == {0: (0.0, 0), 1: (1.0, 1), 2: (3.0, 2), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_text(spark):
    cases = {
        "text": (T.render_text(F.lit("a\x06b\tc\x0bd\x0fe\x01f")), "a\nb\tc-d ef"), "html": (T.render_html(F.lit("<a&\x07b\x02")), "&lt;a&amp;<br/>b"), "ascii": (T.ascii_only(F.lit("a é🙂")), "a ??"), "entities": (T.ascii_html(F.lit("aé🙂")), "a&#xe9;&#x1f642;"),
        "class": (T.css_name(F.lit("My Style ")), "My_Style_"), "heading": (T.heading_level(F.lit("Heading 3")), 3), "none": (T.heading_level(F.lit("Heading")), None), "paras": (T.paragraphs(F.lit("a\x06\x06b\x06")), ["a", "", "b"]), "rest": (T.paragraphs(F.lit("a\x06b")), ["a", "b"]), "no": (T.paragraphs(F.lit("")), []),
    }
    row = spark.range(1).select(*[v.alias(k) for k, (v, _) in cases.items()]).first()
    assert {k: row[k] for k in cases} == {k: w for k, (_, w) in cases.items()}


def test_runs(spark):
    rows = spark.createDataFrame([(1, "aaab"), (2, ""), (3, None), (4, "xyzzz")], "k long, s string")
    got = sorted((r.k, r.run_no, r.value, r.start, r.n) for r in runs.run_lengths(rows.where("s <> ''"), ["k"], F.split("s", "")).collect())
    assert got == [(1, 0, "a", 0, 3), (1, 1, "b", 3, 1), (4, 0, "x", 0, 1), (4, 1, "y", 1, 1), (4, 2, "z", 2, 3)]
    sizes = {r.k: r.encoded for r in runs.rle8_size(runs.run_lengths(rows.where("s <> ''"), ["k"], F.split("s", "")), ["k"]).collect()}
    assert sizes == {1: 4, 4: 5}
    with pytest.raises(ValueError):
        runs.nearest_colour(rows, [(0.0, 0.0, 0.0)] * 257)


def test_lookup_last(spark):
    table = spark.createDataFrame([("g", 1, "a"), ("g", 3, "b"), ("g", 3, "c"), ("h", 2, "d"), ("g", None, "e")], "g string, k int, v string")
    probes = spark.createDataFrame([(0, "g", 0), (1, "g", 1), (2, "g", 2), (3, "g", 9), (4, "h", 1), (5, "x", 5), (6, "g", None), (6, "g", None)], "id int, g string, k int")
    assert sorted((r.id, r.v) for r in sheet.lookup_last(probes, table, ["g"], "k", "v").collect()) == [(0, None), (1, "a"), (2, "a"), (3, "c"), (4, None), (5, None), (6, None), (6, None)]


def test_functions_of_the_moment(spark):
    row = spark.range(1).select(X.FUNCTIONS["NOW"][1]().alias("now"), X.FUNCTIONS["TODAY"][1]().alias("today"), X.FUNCTIONS["RAND"][1]().alias("rand")).first()
    assert row.today <= row.now < row.today + 1 and row.today > 45_000 and 0 <= row.rand < 1


def test_subranges_and_writers(spark):
    row = spark.range(1).select(*[files.subrange(F.lit(b"abcdef"), F.lit(a), F.lit(n)).alias(f"s{a}{n}") for a, n in ((0, 6), (2, 3), (4, 3), (6, 0))]).first()
    assert [bytes(x) if x is not None else None for x in row] == [b"abcdef", b"cde", None, b""]
    assert sinks.writer("XHTML") is sinks.to_xhtml
    with pytest.raises(ValueError):
        sinks.writer("rtf")


def test_plain_formulas():
    for wrong in ([(0x07,)], [(0x1F, 1), (0x1F, 2)], []):
        with pytest.raises(ValueError):
            evaluate.plain(wrong)


def test_irr_without_newton(spark):
    """Flows on which Newton steps run away: the rate is found by halving."""
    flows = F.array(*[F.lit(float(x)) for x in (-1000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 5)])
    found = spark.range(1).select(X.irr(flows).alias("r")).first().r
    assert found == pytest.approx((5 / 1000) ** (1 / 11) - 1, abs=1e-6)


def test_numbering_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    got = runs.numbered(rows, ["b", "a"], "no").collect()
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.no)] == sorted((r.b, r.a) for r in got) and sorted(r.no for r in got) == list(range(1, 1001))


def test_irr_computes_each_step_once(spark):
    """One fold of Newton steps in the whole expression, and the rates of plain halving."""
    flows = F.array(-F.col("id") - 5.0, *[(F.col("id") * k % 7 + 1).cast("double") for k in (1, 3, 5, 6)])
    table = spark.range(50).select(flows.alias("flows")).select("flows", X.irr(F.col("flows")).alias("r"))
    assert table._jdf.queryExecution().analyzed().toString().count("sequence(1, 40") == 1
    for row in table.collect():
        low, high = -0.99, 10.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(x / (1 + middle) ** i for i, x in enumerate(row.flows)) > 0 else (low, middle)
        assert row.r == pytest.approx(low, abs=1e-9)
