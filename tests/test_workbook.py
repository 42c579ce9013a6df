"""Recalculation of workbooks: references between formulas, cycles, computed references, lookups, aggregates."""

import pytest
from pyspark.sql import functions as F

from docsheet.functions import cells as C
from docsheet.plans import evaluate as E
from docsheet.plans import workbook as B


def num(x):
    return B.token(0x1F, float(x))


def text(s):
    return B.token(0x26, text=s)


def op(marker, n=None):
    return B.token(marker, n=n)


def ref(row, column, absolute=False):
    return B.token(0x27, a=B.place(F.lit(row), F.lit(column), absolute, absolute))


def block(r1, c1, r2, c2, absolute=False):
    return B.token(0x28, a=B.place(F.lit(r1), F.lit(c1), absolute, absolute), b=B.place(F.lit(r2), F.lit(c2), absolute, absolute))


def constants(spark, values, sheet=1):
    rows = [(sheet, r, c, *((float(v), None) if isinstance(v, (int, float)) else (None, v))) for (r, c), v in values.items()]
    table = spark.createDataFrame(rows, "sheet long, row long, column long, x double, s string")
    cell = F.when(F.col("s").isNull(), C.cell(F.lit("float"), num=F.col("x"))).otherwise(C.cell(F.lit("string"), text=F.col("s")))
    return table.select("sheet", "row", "column", cell.alias("cell"))


def formulas(spark, tokens, sheet=1):
    one = spark.range(1)
    out = None
    for (r, c), t in tokens.items():
        row = one.select(F.lit(sheet).cast("long").alias("sheet"), F.lit(r).cast("long").alias("row"), F.lit(c).cast("long").alias("column"), F.array(*t).alias("tokens"))
        out = row if out is None else out.unionByName(row)
    return out


def shown(df):
    return {(r["row"], r["column"]): r["cell"]["err"] if r["cell"]["kind"] == "error" else f"#{r['cell']['str']}" if r["cell"]["kind"] == "string" else r["cell"]["bool"] if r["cell"]["kind"] == "bool" else r["cell"]["num"] for r in df.collect()}


ERR = {"REF": 4, "NA": 7, "NAME": 5, "VALUE": 3, "DIV": 2}


def test_formulas_that_refer_to_each_other(spark):
    cells = constants(spark, {(1, 1): 2, (2, 1): 3, (3, 1): 5, (1, 9): "x"})
    f = {
        (1, 2): [ref(1, 1), num(10), op(0x09)],  # 20
        (2, 2): [ref(1, 2), ref(2, 1), op(0x07)],  # 23
        (3, 2): [ref(2, 2), ref(3, 1), op(0x07)],  # 28, of the same template
        (4, 2): [block(1, 2, 3, 2), op(0x98, 1)],  # 71
        (5, 2): [block(1, 1, 4, 2), ref(4, 2), op(0x97, 2)],
        (6, 2): [block(4, 2, 1, 1), op(0x92, 1)],  # 1 blank: (4, 1); corners in any order
        (7, 2): [ref(1, 9), num(1), op(0x07)],  # text
        (8, 2): [ref(7, 2), op(0x3A)],  # ISERROR
        # a cycle of three, one behind it, one that looks at it without an error, one between two cycles
        (1, 3): [ref(2, 3), num(1), op(0x07)],
        (2, 3): [ref(3, 3), num(1), op(0x07)],
        (3, 3): [ref(1, 3), num(1), op(0x07)],
        (4, 3): [ref(3, 3), num(1), op(0x07)],
        (5, 3): [ref(4, 3), op(0x3A)],
        (6, 3): [ref(5, 3), num(7), num(8), op(0x34)],
        (7, 3): [ref(7, 3)],
        (8, 3): [B.token(0x25, text="rate"), num(2), op(0x09)],
        (9, 3): [B.token(0x25, text="none")],
    }
    names = spark.createDataFrame([("rate", 4.0), ("rate", 9.0), ("other", 1.0)], "name string, x double").select("name", C.cell(F.lit("float"), num=F.col("x")).alias("cell"))
    got = shown(B.recalculate(cells, formulas(spark, f), names))
    values = [2, 3, 5, 20, 23, 28, 71, 71]
    mean = sum(values) / 8
    assert got.pop((5, 2)) == pytest.approx((sum((v - mean) ** 2 for v in values) / 7) ** 0.5)
    assert got == {(1, 2): 20, (2, 2): 23, (3, 2): 28, (4, 2): 71, (6, 2): 1, (7, 2): ERR["VALUE"], (8, 2): True, (1, 3): 4, (2, 3): 4, (3, 3): 4, (4, 3): 4, (5, 3): True, (6, 3): 7, (7, 3): 4, (8, 3): 8, (9, 3): ERR["NAME"]}


def test_computed_references(spark):
    cells = constants(spark, {(1, 1): 10, (2, 1): 20, (3, 1): 30, (1, 2): "a", (2, 2): "b", (3, 2): "c", (1, 4): 100, (1, 5): 200, (2, 4): 1, (2, 5): 2})
    table = block(1, 1, 3, 2)
    f = {
        (10, 1): [ref(1, 1), num(1), num(1), op(0x49)],  # OFFSET to b
        (10, 2): [table, num(3), num(1), op(0x46)],  # INDEX: 30
        (10, 3): [table, num(4), num(1), op(0x46)],  # outside
        (10, 4): [text("A2"), op(0x47)],  # INDIRECT: 20
        (10, 5): [text("?"), op(0x47)],
        (10, 6): [num(25), table, num(2), op(0x4C)],  # VLOOKUP: b
        (10, 7): [num(5), table, num(2), op(0x4C)],  # none below
        (10, 8): [num(25), table, num(3), op(0x4C)],  # no such column
        (10, 9): [num(150), block(1, 4, 2, 5), num(2), op(0x45)],  # HLOOKUP: 1
        (11, 1): [num(31), block(1, 1, 3, 1), block(1, 2, 3, 2), op(0x48)],  # LOOKUP: c
        (11, 2): [ref(4, 7), op(0x4A)],  # ROW
        (11, 3): [ref(4, 7), op(0x43)],
        (11, 4): [table, op(0x4B)],  # ROWS
        (11, 5): [table, op(0x44)],
        (11, 6): [text("address"), ref(2, 3), op(0x36)],
        (11, 7): [block(1, 1, 3, 1), block(1, 1, 3, 1), op(0x7E)],  # SUMPRODUCT
        (11, 8): [num(0.1), block(1, 1, 3, 1), op(0x85)],  # NPV
        (12, 1): [ref(12, 2), num(0), num(0), op(0x49), num(1), op(0x07)],  # OFFSET to a formula
        (12, 2): [ref(10, 2), num(5), op(0x07)],  # 35
        (12, 3): [text("C12"), op(0x47)],  # refers to itself
        (12, 4): [ref(1, 1), num(-1), num(0), op(0x49)],  # above the sheet
        (12, 5): [num(1.26), num(1), op(0x7A)],  # ROUND
        (12, 6): [num(1.256), num(2), op(0x59)],  # STRING
        (12, 7): [ref(1, 1), num(1), num(0), op(0x49), op(0x4A)],  # ROW of an OFFSET
        (12, 8): [text("b"), block(1, 2, 3, 2), block(1, 1, 3, 1), op(0x48)],  # by text: 20
        (12, 9): [ref(10, 2), ref(11, 2), num(0), op(0x49), num(2), op(0x09)],  # shifted by a formula's value: a blank
    }
    got = shown(B.recalculate(cells, formulas(spark, f)))
    assert got.pop((11, 8)) == pytest.approx(10 / 1.1 + 20 / 1.21 + 30 / 1.331)
    assert got == {
        (10, 1): "#b", (10, 2): 30, (10, 3): 4, (10, 4): 20, (10, 5): 4, (10, 6): "#b", (10, 7): 7, (10, 8): 4, (10, 9): 1, (11, 1): "#c", (11, 2): 4, (11, 3): 7, (11, 4): 3, (11, 5): 2, (11, 6): "#$C$2", (11, 7): 1400,
        (12, 1): 36, (12, 2): 35, (12, 3): 4, (12, 4): 4, (12, 5): 1.3, (12, 6): "#1.26", (12, 7): 2, (12, 8): 20, (12, 9): 0,
    }


def test_lookups_read_what_formulas_made(spark):
    """Keys and results of a lookup are formulas; nested lookups."""
    cells = constants(spark, {(1, 1): 1, (2, 1): 2})
    f = {(1, 2): [ref(1, 1), num(10), op(0x09)], (2, 2): [ref(2, 1), num(10), op(0x09)], (1, 3): [ref(1, 2), num(1), op(0x07)], (2, 3): [ref(2, 2), num(1), op(0x07)],
         (5, 5): [num(15), block(1, 2, 2, 3), num(2), op(0x4C)], (6, 5): [num(21), block(1, 2, 2, 3), num(2), op(0x4C), num(1), op(0x07), block(1, 2, 2, 3), num(1), op(0x4C)]}
    got = shown(B.recalculate(cells, formulas(spark, f)))
    assert (got[(5, 5)], got[(6, 5)]) == (11, 20)


def test_one_template_for_a_column(spark):
    table = spark.range(1, 200).select(F.lit(1).cast("long").alias("sheet"), F.col("id").alias("row"), F.lit(2).cast("long").alias("column"))
    tokens = F.array(B.token(0x27, a=B.place(F.col("row"), F.lit(1))), B.token(0x27, a=B.place(F.lit(1), F.lit(1), True, True)), B.token(0x07))
    cells = spark.range(1, 200).select(F.lit(1).cast("long").alias("sheet"), F.col("id").alias("row"), F.lit(1).cast("long").alias("column"), C.cell(F.lit("float"), num=F.col("id")).alias("cell"))
    book = B.Workbook(cells, table.withColumn("tokens", tokens), None)
    assert len(book.templates) == 1
    assert shown(book.recalculated()) == {(r, 2): r + 1 for r in range(1, 200)}


def test_empty_and_null(spark):
    cells = constants(spark, {(1, 1): 1})
    none = formulas(spark, {(1, 2): [ref(1, 1)]}).where("false")
    assert B.recalculate(cells, none).collect() == []
    lost = formulas(spark, {(1, 2): [ref(1, 1)]}).withColumn("row", F.lit(None).cast("long"))
    assert B.recalculate(cells, lost).collect() == []
    twice = formulas(spark, {(1, 2): [ref(1, 1)]})
    assert len(B.recalculate(cells, twice.unionByName(twice)).collect()) == 1


def test_formula_cells_with_repeats_and_computed_references(spark):
    cells = constants(spark, {(1, 1): 10, (2, 1): 5, (1, 2): 7}).drop("sheet")
    targets = spark.createDataFrame([(1, 1, 9), (1, 1, 9), (1, 2, 9), (None, 1, 9)], "target long, row long, column long")
    result = lambda tokens, names=None: sorted(((r["target"] or 0, r["row"], r["result"]["num"] if r["result"]["kind"] != "error" else f"e{r['result']['err']}") for r in E.formula_cells(targets, tokens, cells, names).collect()), key=str)
    both = (E.BLOCK, 1, 1, True, True, 2, 1, True, True)
    assert result([both, (0x98, 1)]) == [(0, 1, 15.0), (1, 1, 15.0), (1, 1, 15.0), (1, 2, 15.0)]
    assert result([both, (E.REFERENCE, 0, 1, False, True), (0x98, 2)]) == [(0, 1, 25.0), (1, 1, 25.0), (1, 1, 25.0), (1, 2, 20.0)]
    names = spark.createDataFrame([("k", 3.0), ("k", 4.0)], "name string, x double").select("name", C.cell(F.lit("float"), num=F.col("x")).alias("cell"))
    assert [x for *_, x in result([(E.VARIABLE, "k")], names)] == [3.0] * 4
    assert "NestedLoop" not in E.formula_cells(targets, [(E.VARIABLE, "k"), both, (0x98, 2)], cells, names)._jdf.queryExecution().executedPlan().toString()
    assert [x for *_, x in result([(E.REFERENCE, 1, 1, True, True), (E.INTEGER, 1), (E.INTEGER, 0), (0x49,)])] == [5.0] * 4
    assert [x for *_, x in result([(E.REFERENCE, 0, 1, False, True), (E.BLOCK, 1, 1, True, True, 2, 2, True, True), (E.INTEGER, 3), (0x4C,)])] == ["e4"] * 4
