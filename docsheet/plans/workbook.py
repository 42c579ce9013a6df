"""Recalculation of workbooks: cells whose formulas refer to each other, evaluated in rounds of joins.

Formulas are rows of postfix tokens. Their references are put as offsets from the cell, so that a formula filled down a column is
one template; each template is compiled once into a column expression. A computed reference (INDEX, OFFSET, INDIRECT and the lookups)
becomes a part of its own, which yields an address; the part that reads the cell at that address waits for it.

What a part waits for are edges (an equi-join of references with formula cells, a band join of blocks). In each round the parts without open edges are evaluated
together in one expression, their results move along the edges as operands, and new edges appear where an address turned out to be a
formula cell. A round touches what is still open, is written, and replaces the tables of the round before, so lost executors repeat one round at most.
When nothing is ready any more, what is left over is trimmed from its other end; the core, cells of cycles and on ways between two cycles, gets #REF!,
and the cells behind it go on with that. The number of rounds is the depth of the workbook.

Cells without a row are blank. Rows that repeat a cell's place: the least of them counts, a formula before a constant. The driver holds the
distinct templates, ``TEMPLATES`` at most (more raise an error), never cells.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import formula as X
from ..functions.formula import bound
from ..operators import sheet as S
from ..sources.shared import delete_table, scratch, written, written_together
from . import evaluate as E

TEMPLATES = 10_000
PLACE = ["sheet", "row", "column"]
TOKEN = "struct<marker:int,number:double,text:string,n:int,a:struct<row:long,column:long,abs_row:boolean,abs_column:boolean>,b:struct<row:long,column:long,abs_row:boolean,abs_column:boolean>>"
CELL = "struct<kind:string,num:double,str:string,bool:boolean,err:int>"
#: What a block or single operand adds to an aggregate: numbers with mean and squared deviations, other counts, the least error.
PART = "struct<n:long,filled:long,area:long,sum:double,mean:double,m2:double,sumsq:double,low:double,high:double,product:double,err:int>"
LIST = "array<struct<row:long,column:long,num:double>>"
SEPARATORS = (0x15, 0x2A, 0x2B)
#: Functions whose operands are places rather than values, by marker with their names and numbers of operands (fixed values).
PLACED: dict[int, tuple[str, int]] = {0x36: ("CELL", 2), 0x43: ("COLUMN", 1), 0x44: ("COLUMNS", 1), 0x45: ("HLOOKUP", 3), 0x46: ("INDEX", 3), 0x47: ("INDIRECT", 1), 0x48: ("LOOKUP", 3), 0x49: ("OFFSET", 3), 0x4A: ("ROW", 1), 0x4B: ("ROWS", 1), 0x4C: ("VLOOKUP", 3)}
#: Functions of the numbers of whole blocks (fixed values).
LISTED: dict[int, tuple[str, int]] = {0x7E: ("SUMPRODUCT", 2), 0x84: ("IRR", 2), 0x85: ("NPV", 2)}
LOOKUPS, ADDRESSES = ("HLOOKUP", "VLOOKUP", "LOOKUP"), ("INDEX", "OFFSET", "INDIRECT")


def token(marker: int, number: float | Column | None = None, text: str | None = None, n: int | None = None, a: Column | None = None, b: Column | None = None) -> Column:
    """One token; ``a`` and ``b`` come from ``place``."""
    none = lambda field: F.lit(None).cast(TOKEN)[field]
    number = number if isinstance(number, Column) else F.lit(number)
    return F.struct(F.lit(marker).alias("marker"), number.cast("double").alias("number"), F.lit(text).cast("string").alias("text"), F.lit(n).cast("int").alias("n"), (a if a is not None else none("a")).alias("a"), (b if b is not None else none("b")).alias("b"))


def place(row: Column, column: Column, absolute_row: bool = False, absolute_column: bool = False) -> Column:
    """The cell that a token names, by its place in the sheet; what isn't absolute moves with the formula."""
    return F.struct(row.cast("long").alias("row"), column.cast("long").alias("column"), F.lit(absolute_row).alias("abs_row"), F.lit(absolute_column).alias("abs_column"))


def relative(tokens: Column, row: Column, column: Column) -> Column:
    """``tokens`` with offsets from (row, column) where their places aren't absolute."""

    def moved(p: Column) -> Column:
        return F.when(p.isNotNull(), F.struct(F.when(p["abs_row"], p["row"]).otherwise(p["row"] - row).alias("row"), F.when(p["abs_column"], p["column"]).otherwise(p["column"] - column).alias("column"), p["abs_row"].alias("abs_row"), p["abs_column"].alias("abs_column")))

    return F.transform(tokens, lambda t: t.withField("a", moved(t["a"])).withField("b", moved(t["b"])))


def tree(tokens: list[dict]) -> tuple:
    """The expression of postfix tokens: (name, operands) with ("ref", a), ("block", a, b), ("variable", name) and ("cell", kind, value) at its ends."""
    stack: list = []
    for t in tokens:
        marker = t["marker"]
        if marker in SEPARATORS:
            continue
        if marker in (E.NUMBER, E.INTEGER, E.STRING):
            stack.append(("cell", {E.NUMBER: "float", E.INTEGER: "int", E.STRING: "string"}[marker], t.get("text") if marker == E.STRING else t.get("number")))
        elif marker == E.VARIABLE:
            stack.append(("variable", t.get("text")))
        elif marker == E.REFERENCE:
            stack.append(("ref", t["a"]))
        elif marker in (E.BLOCK, E.VARARG_BLOCK):
            stack.append(("block", t["a"], t["b"]))
        else:
            name, n = PLACED.get(marker) or LISTED.get(marker) or E.MARKERS.get(marker) or (None, 0)
            if name is None:
                raise ValueError(f"no token {marker:#x}")
            stack.append((name, E._pop(stack, t["n"] if n < 0 else n)))
    if len(stack) != 1:
        raise ValueError("a formula leaves exactly one value")
    return stack[0]


def at(p: dict) -> tuple[Column, Column]:
    """Row and column of a template's place, seen from the cell."""
    return (F.lit(p["row"]) if p["abs_row"] else F.col("row") + F.lit(p["row"])), (F.lit(p["column"]) if p["abs_column"] else F.col("column") + F.lit(p["column"]))


def corners(block: tuple) -> list[Column]:
    """First and last row and column of a block, in either order of its corners."""
    (r1, c1), (r2, c2) = at(block[1]), at(block[2])
    return [F.least(r1, r2), F.greatest(r1, r2), F.least(c1, c2), F.greatest(c1, c2)]


def _address(row: Column, column: Column, err: Column) -> Column:
    """An address, or the error that it is instead; rows and columns count from 1."""
    err = F.coalesce(err, F.when((row < 1) | (column < 1) | row.isNull() | column.isNull(), 4))
    return F.struct(F.when(err.isNull(), row.cast("long")).alias("row"), F.when(err.isNull(), column.cast("long")).alias("column"), err.cast("int").alias("err"))


class Template:
    """The parts of one formula. A part is (kind, expression); kinds are value, address and the lookups. ``inputs`` are what parts read, by number: (part, mode, what)."""

    def __init__(self, root: tuple, variables: dict[str, Column]) -> None:
        self.variables, self.parts, self.inputs, self.blocks = variables, [None], [], {}
        self.parts[0] = ("value", self.value(root, 0))

    def read(self, part: int, mode: str, what) -> Column:
        self.inputs.append((part, mode, what))
        return F.col("operands")[F.lit(len(self.inputs) - 1)]

    def value(self, x: tuple, part: int) -> Column:
        name = x[0]
        if name == "cell":
            return C.cell(F.lit(x[1]), **({"text": F.lit(x[2])} if x[1] == "string" else {"num": F.lit(x[2])}))
        if name == "variable":
            return self.variables.get(x[1], C.failed(5))
        if name == "ref":
            return self.read(part, "cell", x[1])["cell"]
        if name == "block":  # where a value is asked for
            return C.failed(3)
        args = x[1]
        if name in LOOKUPS or name in ADDRESSES:
            return self.read(part, "via", self.part(x))["cell"]
        if name in ("ROW", "COLUMN"):
            return bound([self.address(args[0], part)], lambda found: F.when(found["err"].isNotNull(), C.failed_as(found["err"])).otherwise(C.cell(F.lit("int"), num=found[name.lower()])))
        if name in ("ROWS", "COLUMNS"):
            if args[0][0] != "block":
                return C.cell(F.lit("int"), num=F.lit(1)) if args[0][0] == "ref" else C.failed(3)
            r1, r2, c1, c2 = corners(args[0])
            return C.cell(F.lit("int"), num=r2 - r1 + 1 if name == "ROWS" else c2 - c1 + 1)
        if name == "CELL":

            def info(what: Column, c: Column, found: Column) -> Column:
                out = F.when(C.is_error(what), what).when(found["err"].isNotNull(), C.failed_as(found["err"]))
                for attribute in ("row", "column", "address", "contents", "type"):
                    out = out.when(F.lower(C.text(what)) == attribute, C.info(attribute, c, found["row"], found["column"]))
                return out.otherwise(C.failed(3))

            return bound([self.value(args[0], part), self.value(args[1], part), self.address(args[1], part)], info)
        if name in E.AGGREGATES:
            return aggregate(name, [self.read(part, "part", a)["part"] if a[0] == "block" else bound([self.value(a, part)], as_part) for a in args])
        if name in ("SUMPRODUCT", "IRR", "NPV"):
            lists = [self.read(part, "list", a)["list"] if a[0] == "block" else None for a in args]
            if lists[1] is None or (name == "SUMPRODUCT") != (lists[0] is not None):
                return C.failed(3)
            numbers = lambda a: F.transform(F.array_sort(a), lambda e: e["num"])
            if name == "SUMPRODUCT":
                other = F.map_from_entries(F.transform(lists[1], lambda e: F.struct(F.struct(e["row"], e["column"]), e["num"])))
                products = F.transform(lists[0], lambda e: e["num"] * F.coalesce(F.try_element_at(other, F.struct(e["row"], e["column"])), F.lit(0.0)))
                return C.cell(F.lit("float"), num=F.aggregate(products, F.lit(0.0), lambda a, b: a + b))
            rate = X.npv_at if name == "NPV" else lambda guess, flows: X.irr(flows, guess)
            made = lambda first: rate(C.number(first), numbers(lists[1]))
            return bound([self.value(args[0], part)], lambda c: C.guarded([c], [C.number(c)], bound([made(c)], lambda x: F.when(x.isNull(), C.failed(6)).otherwise(C.cell(F.lit("float"), num=x)))))
        return bound([self.value(a, part) for a in args], lambda *c: E.apply(name, list(c)))

    def part(self, x: tuple) -> int:
        """A new part that yields the address of a computed reference."""
        self.parts.append(None)
        k = len(self.parts) - 1
        if x[0] in LOOKUPS:
            key, table, third = x[1]
            if table[0] != "block" or (x[0] == "LOOKUP" and third[0] != "block"):
                self.parts[k] = ("address", _result(address=_address(F.lit(None), F.lit(None), F.lit(3))))
                return k
            self.inputs.append((k, "wait", (x[0], table)))
            self.blocks[k] = (table, third if x[0] == "LOOKUP" else None)
            step = F.lit(1.0) if x[0] == "LOOKUP" else C.number(self.value(third, k))
            self.parts[k] = (x[0], _result(self.value(key, k), step))
        else:
            self.parts[k] = ("address", _result(address=self.address(x, k)))
        return k

    def address(self, x: tuple, part: int) -> Column:
        none = F.lit(None).cast("int")
        if x[0] == "ref":
            return _address(*at(x[1]), none)
        if x[0] == "block":
            r1, _, c1, _ = corners(x)
            return _address(r1, c1, none)
        if x[0] == "INDIRECT":
            return bound([self.value(x[1][0], part)], lambda c: bound([X.reference(C.text(c))], lambda found: _address(found["row"], found["column"], F.when(C.is_error(c), c["err"]))))
        if x[0] in ("OFFSET", "INDEX"):
            base = x[1][0]
            inside = corners(base) if base[0] == "block" else None
            shift = 1 if x[0] == "INDEX" else 0

            def moved(found: Column, down: Column, right: Column) -> Column:
                row, column = found["row"] + F.floor(C.number(down)) - shift, found["column"] + F.floor(C.number(right)) - shift
                err = F.coalesce(found["err"], *[F.when(C.is_error(c), c["err"]).when(C.number(c).isNull(), 3) for c in (down, right)])
                if shift:
                    r1, r2, c1, c2 = inside or [found["row"], found["row"], found["column"], found["column"]]
                    err = F.coalesce(err, F.when(~(row.between(r1, r2) & column.between(c1, c2)), 4))
                return _address(row, column, err)

            return bound([self.address(base, part), *[self.value(a, part) for a in x[1][1:]]], moved)
        return _address(F.lit(None), F.lit(None), F.lit(4))


def _result(cell: Column | None = None, step: Column | None = None, address: Column | None = None) -> Column:
    return F.struct((cell if cell is not None else F.lit(None).cast(CELL)).alias("cell"), (step if step is not None else F.lit(None)).cast("double").alias("step"), (address if address is not None else F.lit(None)).cast("struct<row:long,column:long,err:int>").alias("to"))


def as_part(c: Column) -> Column:
    """One cell as what it adds to an aggregate."""
    x, one = F.when(C.is_number(c), c["num"]), C.is_number(c)
    fields = [one.cast("long"), (~C.is_blank(c)).cast("long"), F.lit(1).cast("long"), F.coalesce(x, F.lit(0.0)), F.coalesce(x, F.lit(0.0)), F.lit(0.0), F.coalesce(x * x, F.lit(0.0)), x, x, F.coalesce(x, F.lit(1.0)), F.when(C.is_error(c), c["err"])]
    return F.struct(*fields).cast(PART)


def parts_of(c: Column) -> Column:
    """The same over the rows of a group."""
    x = F.when(C.is_number(c), c["num"])
    n = F.count(x)
    fields = [n, F.count_if(~C.is_blank(c)), F.lit(0).cast("long"), F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.var_pop(x) * n, F.lit(0.0)), F.coalesce(F.sum(x * x), F.lit(0.0)), F.min(x), F.max(x), F.coalesce(F.product(x), F.lit(1.0)), F.min(F.when(C.is_error(c), c["err"]))]
    return F.struct(*fields).cast(PART)


def joined(a: Column, b: Column) -> Column:
    """Two parts as one."""
    n = a["n"] + b["n"]
    mean = F.when(n > 0, (a["n"] * a["mean"] + b["n"] * b["mean"]) / n).otherwise(0.0)
    gap = F.when((a["n"] > 0) & (b["n"] > 0), F.pow(a["mean"] - b["mean"], 2) * a["n"] * b["n"] / n).otherwise(0.0)
    fields = [n, a["filled"] + b["filled"], a["area"] + b["area"], a["sum"] + b["sum"], mean, a["m2"] + b["m2"] + gap, a["sumsq"] + b["sumsq"], F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"]), a["product"] * b["product"], F.least(a["err"], b["err"])]
    return F.struct(*fields).cast(PART)


def total(parts: Column) -> Column:
    """An array of parts as one."""
    none = F.struct(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(None), F.lit(None), F.lit(1.0), F.lit(None)).cast(PART)
    return F.aggregate(parts, none, joined)


def aggregate(name: str, parts: list[Column]) -> Column:
    p = reduce(joined, parts)
    n = p["n"]
    values = {"COUNT": n, "COUNTA": p["filled"], "COUNTBLANK": p["area"] - p["filled"], "SUM": p["sum"], "SUMSQ": p["sumsq"], "AVERAGE": F.when(n > 0, p["mean"]), "MIN": p["low"], "MAX": p["high"], "PRODUCT": F.when(n > 0, p["product"]),
              "VARP": F.when(n > 0, p["m2"] / n), "VAR": F.when(n > 1, p["m2"] / (n - 1)), "STDEVP": F.when(n > 0, F.sqrt(p["m2"] / n)), "STDEV": F.when(n > 1, F.sqrt(p["m2"] / (n - 1)))}
    v = values[name].cast("double")
    made = F.when(v.isNull(), C.failed(2)).otherwise(C.cell(F.lit("float"), num=v))
    return made if name.startswith("COUNT") else F.when(p["err"].isNotNull(), C.failed_as(p["err"])).otherwise(made)


def _chain(cases: dict[int, Column], on: str, none: Column) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(F.col(on) == k, v) if out is None else out.when(F.col(on) == k, v)
    return none if out is None else out.otherwise(none)


class Workbook:
    """The tables of a recalculation. Keys are (sheet, row, column, part); a part is ``template * 64 + number`` in ``program``."""

    WIDE = 64

    def __init__(self, cells: DataFrame, formulas: DataFrame, variables: DataFrame | None, apart: bool = False) -> None:
        own = formulas.where(F.col("sheet").isNotNull() & F.col("row").isNotNull() & F.col("column").isNotNull()).select(*[F.col(c).cast("long") for c in PLACE], F.to_json(relative("tokens", F.col("row").cast("long"), F.col("column").cast("long"))).alias("t"))
        own = written(own.groupBy(*PLACE).agg(F.min("t").alias("t")))
        kinds = sorted(r[0] for r in own.select("t").distinct().limit(TEMPLATES + 1).collect())
        if len(kinds) > TEMPLATES:
            raise ValueError(f"more than {TEMPLATES} templates")
        trees = [tree(json.loads(t)) for t in kinds]
        self.templates = [Template(t, self._variables(trees, variables)) for t in trees]
        self.led = any(mode == "via" for t in self.templates for _, mode, _ in t.inputs)
        if any(len(t.parts) > self.WIDE for t in self.templates):
            raise ValueError(f"a formula has {self.WIDE - 1} computed references at most")
        number = F.broadcast(cells.sparkSession.createDataFrame(list(zip(kinds, range(len(kinds)), strict=True)), "t string, template int"))
        self.formulas = written(own.join(number, "t").select(*PLACE, "template"))
        #: The formulas that others can refer to.
        self.seen = self.formulas.where("false") if apart else self.formulas
        self.constants = written(cells.groupBy(*[F.col(c).cast("long").alias(c) for c in PLACE]).agg(F.min("cell").alias("cell")).join(self.seen, PLACE, "left_anti"))

    @staticmethod
    def _variables(trees: list[tuple], variables: DataFrame | None) -> dict[str, Column]:
        """The cells of the names that formulas use; of rows with one name the least counts."""
        names: set[str] = set()

        def walk(x) -> None:
            if x[0] == "variable":
                names.add(x[1])
            elif x[0] not in ("cell", "ref", "block"):
                for a in x[1]:
                    walk(a)

        for t in trees:
            walk(t)
        if variables is None or not names:
            return {}
        rows = variables.where(F.col("name").isin(sorted(n for n in names if n is not None))).groupBy("name").agg(F.min("cell").alias("cell")).collect()
        return {r["name"]: C.cell(F.lit(r["cell"]["kind"]), F.lit(r["cell"]["num"]), F.lit(r["cell"]["str"]), F.lit(r["cell"]["bool"]), F.lit(r["cell"]["err"])) for r in rows}

    def _inputs(self, modes: tuple[str, ...]) -> DataFrame:
        """A row for each input of such a mode and formula: its key, k, mode, and the place, block or part that it reads."""
        cases, none = {}, F.lit(None).cast("long")
        for n, t in enumerate(self.templates):
            rows = []
            for k, (part, mode, what) in enumerate(t.inputs):
                if mode not in modes:
                    continue
                if mode == "via":
                    place = [none] * 4 + [F.lit(what)]
                elif mode == "cell":
                    r, c = at(what)
                    place = [r, r, c, c, F.lit(0)]
                else:
                    r1, r2, c1, c2 = corners(what[1] if mode == "wait" else what)
                    if mode == "wait":  # the keys of a lookup are the first column of its block, or the first row
                        r2, c2 = (r1, c2) if what[0] == "HLOOKUP" else (r2, F.when((what[0] == "LOOKUP") & (r1 == r2), c2).otherwise(c1))
                    place = [r1, r2, c1, c2, F.lit(0)]
                rows.append(F.struct(F.lit(part).alias("part"), F.lit(k).alias("k"), F.lit(mode).alias("mode"), *[p.cast("long").alias(x) for p, x in zip(place, ("r1", "r2", "c1", "c2", "on"), strict=True)]))
            if rows:
                cases[n] = F.array(*rows)
        kind = "array<struct<part:int,k:int,mode:string,r1:long,r2:long,c1:long,c2:long,on:long>>"
        return self.formulas.select("*", F.explode(_chain(cases, "template", F.lit(None).cast(kind))).alias("i")).select(*PLACE, "i.*")

    def recalculated(self) -> DataFrame:
        """(sheet, row, column, cell) of every formula."""
        W, key = written, [*PLACE, "part"]
        parts = _chain({n: F.array(*[F.lit(k) for k in range(len(t.parts))]) for n, t in enumerate(self.templates)}, "template", F.lit(None).cast("array<int>"))
        pending, single, blocks = written_together(self.formulas.select("*", F.explode(parts).alias("part")), self._inputs(("cell",)), self._inputs(("part", "list", "wait")))
        expression = self._expression()
        spot = [F.col("sheet"), F.col("r1").alias("row"), F.col("c1").alias("column")]
        need = lambda df: df.select(F.col("sheet").alias("n_sheet"), F.col("row").alias("n_row"), F.col("column").alias("n_column"))
        on_place = [F.col("sheet") == F.col("n_sheet"), F.col("r1") == F.col("n_row"), F.col("c1") == F.col("n_column")]
        edge = [*key, "k", "mode", "n_row", "n_column", "n_part", "o_row", "o_column"]
        zero, none = F.lit(0).cast("long"), F.lit(None)
        # edges to formula cells: (key, k, mode) waits for (n_row, n_column, n_part) of its sheet; o_row and o_column are its place in the block
        from_cells = single.join(need(self.seen), on_place).select(*key, "k", "mode", "n_row", "n_column", F.lit(0).alias("n_part"), zero.alias("o_row"), zero.alias("o_column"))
        banded = self._in_blocks(blocks, self.seen)
        from_blocks = banded.select(*key, "k", "mode", F.col("f_row").alias("n_row"), F.col("f_column").alias("n_column"), F.lit(0).alias("n_part"), (F.col("f_row") - F.col("r1")).alias("o_row"), (F.col("f_column") - F.col("c1")).alias("o_column"))
        via = self._inputs(("via",)).select(*key, "k", "mode", F.col("row").alias("n_row"), F.col("column").alias("n_column"), F.col("on").cast("int").alias("n_part"), zero.alias("o_row"), zero.alias("o_column"))
        edges = W(from_cells.unionByName(from_blocks).unionByName(via).select(*edge))
        # operands from constants: cells, totals of blocks with their areas, lists
        constant = self.constants.select(F.col("sheet").alias("n_sheet"), F.col("row").alias("n_row"), F.col("column").alias("n_column"), "cell")
        blank = C.cell(F.lit("blank"))
        operand = lambda df, cell=none, part=none, items=none: df.select(*key, "k", cell.cast(CELL).alias("cell"), part.cast(PART).alias("part_"), items.cast(LIST).alias("items"))
        first = operand(single.join(need(self.seen), on_place, "left_anti").join(constant, on_place, "left"), F.coalesce("cell", blank))
        inside = self._in_blocks(blocks.where("mode <> 'wait'"), self.constants)
        area = F.struct(*[F.lit(x) for x in (0, 0)], (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1), *[F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, None, None, 1.0, None)]).cast(PART)
        first = first.unionByName(operand(blocks.where("mode = 'part'"), part=area)).unionByName(operand(blocks.where("mode = 'list'"), items=F.array()))
        pieces = W(first.unionByName(self._gathered(inside.withColumn("o_row", F.col("f_row") - F.col("r1")).withColumn("o_column", F.col("f_column") - F.col("c1")), key)))
        done: DataFrame | None = None
        lookups = any(p[0] in LOOKUPS for t in self.templates for p in t.parts)
        while True:
            ready = pending.join(edges.select(*key).distinct(), key, "left_anti")
            fresh = W(self._evaluated(ready, pieces, key, done, expression, lookups))
            if fresh.isEmpty():
                core = self._core(pending, edges)
                if core.isEmpty():
                    break
                fresh = W(core.select(*key, C.failed(4).alias("cell"), F.struct(none.cast("long").alias("row"), none.cast("long").alias("column"), F.lit(4).alias("err")).alias("to")))
            new = fresh.where("part = 0").select(*PLACE, "cell")
            done = new if done is None else done.unionByName(new)
            before = (pending, edges, pieces)
            pending, edges, pieces = self._moved(fresh, pending, edges, pieces, done, key, edge)
            for table in before:
                delete_table(table)
        return self.formulas.select(*PLACE).join(done, PLACE) if done is not None else self.formulas.select(*PLACE, none.cast(CELL).alias("cell"))

    def _known(self, done: DataFrame | None) -> DataFrame:
        return self.constants if done is None or self.seen is not self.formulas else self.constants.unionByName(done)

    def _in_blocks(self, blocks: DataFrame, cells: DataFrame) -> DataFrame:
        """Blocks with the cells in them (f_row, f_column and, if there is one, cell) by an equi-join on bands of rows and columns."""
        tall, wide = 64, 16
        rows = F.explode(F.sequence(F.floor(F.col("r1") / tall), F.floor(F.col("r2") / tall))).alias("_b")
        columns = F.explode(F.sequence(F.floor(F.col("c1") / wide), F.floor(F.col("c2") / wide))).alias("_w")
        spread = blocks.select("*", rows).select("*", columns)
        other = cells.select(F.col("sheet").alias("f_sheet"), F.col("row").alias("f_row"), F.col("column").alias("f_column"), *(["cell"] if "cell" in cells.columns else []), F.floor(F.col("row") / tall).alias("f_b"), F.floor(F.col("column") / wide).alias("f_w"))
        met = spread.join(other, (F.col("sheet") == F.col("f_sheet")) & (F.col("_b") == F.col("f_b")) & (F.col("_w") == F.col("f_w")))
        return met.where("f_row between r1 and r2 and f_column between c1 and c2")

    @staticmethod
    def _gathered(members: DataFrame, key: list[str]) -> DataFrame:
        """Members of blocks (key, k, mode, o_row, o_column, cell) as operands: a total or a list for each key and k."""
        number = F.when(C.is_number(F.col("cell")), F.struct(F.col("o_row").alias("row"), F.col("o_column").alias("column"), F.col("cell.num").alias("num")))
        items = F.when(F.first("mode") == "list", F.collect_list(F.when(F.col("mode") == "list", number)))
        made = members.where("mode in ('part', 'list')").groupBy(*key, "k").agg(F.when(F.first("mode") == "part", parts_of(F.col("cell"))).alias("part_"), items.cast(LIST).alias("items"))
        return made.select(*key, "k", F.lit(None).cast(CELL).alias("cell"), "part_", "items")

    def _expression(self) -> Column:
        """The result of a part by its ``program`` and ``operands``: all templates in one expression."""
        cases = {}
        for n, t in enumerate(self.templates):
            for k, (kind, made) in enumerate(t.parts):
                cases[n * self.WIDE + k] = _result(made) if kind == "value" else made
        return _chain(cases, "program", _result())

    def _evaluated(self, ready: DataFrame, pieces: DataFrame, key: list[str], done: DataFrame | None, expression: Column, lookups: bool) -> DataFrame:
        """(key, cell, to) of the parts that are ready."""
        each = pieces.groupBy(*key, "k").agg(F.first("cell", ignorenulls=True).alias("cell"), total(F.collect_list("part_")).alias("whole"), F.flatten(F.collect_list("items")).alias("list"))
        operands = each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("cell", F.col("whole").alias("part"), "list")))).alias("operands"))
        table = ready.join(operands, key, "left").withColumn("program", F.col("template") * self.WIDE + F.col("part"))
        out = table.select(*key, "program", expression.alias("r")).select(*key, "program", "r.*")
        if not lookups:
            return out.select(*key, "cell", "to")
        searching = [n * self.WIDE + k for n, t in enumerate(self.templates) for k, (kind, _) in enumerate(t.parts) if kind in LOOKUPS]
        out = written(out)
        looked = out.where(F.col("program").isin(searching))
        rest = out.where(~F.col("program").isin(searching)).select(*key, "cell", "to")
        return rest if looked.isEmpty() else rest.unionByName(self._looked_up(looked, key, done))

    def _looked_up(self, looked: DataFrame, key: list[str], done: DataFrame | None) -> DataFrame:
        """Addresses of lookups: the last cell of the first column or row whose key isn't greater, one as-of join for all blocks (numbers and texts apart)."""
        facts = {}
        for n, t in enumerate(self.templates):
            for k, (table, result) in t.blocks.items():
                r1, r2, c1, c2 = corners(table)
                rr, _, rc, _ = corners(result) if result else [F.lit(None)] * 4
                kind = t.parts[k][0]
                along = F.lit(kind == "HLOOKUP") if result is None else r1 == r2  # keys lie along a row
                facts[n * self.WIDE + k] = F.struct(*[x.cast("long").alias(y) for x, y in zip((r1, r2, c1, c2, rr, rc), ("r1", "r2", "c1", "c2", "rr", "rc"), strict=True)], along.alias("along"))
        probes = looked.select("*", _chain(facts, "program", F.lit(None).cast("struct<r1:long,r2:long,c1:long,c2:long,rr:long,rc:long,along:boolean>")).alias("b"))
        sort = lambda c: F.struct(F.when(C.is_text(c), F.lower(c["str"])).alias("s"), F.when(~C.is_text(c), C.number(c)).alias("x"))
        block = F.struct("sheet", "b.r1", "b.r2", "b.c1", "b.c2", "b.along")
        probes = probes.select(*key, "cell", "step", "b", F.to_json(block).alias("block"), C.is_text(F.col("cell")).alias("texts"), sort(F.col("cell")).alias("sorted"))
        wanted = probes.select("block", "sheet", "b.r1", F.when(F.col("b.along"), F.col("b.r1")).otherwise(F.col("b.r2")).alias("r2"), "b.c1", F.when(F.col("b.along"), F.col("b.c2")).otherwise(F.col("b.c1")).alias("c2"), "b.along").distinct()
        rows = self._in_blocks(wanted, self._known(done)).where(C.is_text(F.col("cell")) | C.is_number(F.col("cell")))
        steps = F.when(F.col("along"), F.col("f_column") - F.col("c1")).otherwise(F.col("f_row") - F.col("r1"))
        keyed = rows.select("block", C.is_text(F.col("cell")).alias("texts"), sort(F.col("cell")).alias("sorted"), steps.alias("found"))
        hit = S.lookup_last(probes, keyed, ["block", "texts"], "sorted", "found")
        own, step, found = F.col("cell"), F.floor("step").cast("long"), F.col("found")
        b = F.col("b")
        outside = F.when(b["rr"].isNull(), F.when(b["along"], step > b["r2"] - b["r1"] + 1).otherwise(step > b["c2"] - b["c1"] + 1) | (step < 1)).otherwise(F.lit(False))
        err = F.when(C.is_error(own), own["err"]).when(step.isNull(), 3).when(found.isNull(), 7).when(outside, 4)
        row = F.when(b["rr"].isNotNull(), b["rr"] + F.when(b["along"], 0).otherwise(found)).when(b["along"], b["r1"] + step - 1).otherwise(b["r1"] + found)
        column = F.when(b["rc"].isNotNull(), b["rc"] + F.when(b["along"], found).otherwise(0)).when(b["along"], b["c1"] + found).otherwise(b["c1"] + step - 1)
        return hit.select(*key, F.lit(None).cast(CELL).alias("cell"), _address(row, column, err).alias("to"))

    def _moved(self, fresh: DataFrame, pending: DataFrame, edges: DataFrame, pieces: DataFrame, done: DataFrame, key: list[str], edge: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pending, edges, pieces) after a round: results go along their edges; an address leads to its cell, at once or by an edge to it."""
        W, none, zero = written, F.lit(None), F.lit(0).cast("long")
        needed = fresh.select(F.col("sheet").alias("f_sheet"), F.col("row").alias("n_row"), F.col("column").alias("n_column"), F.col("part").alias("n_part"), "cell", "to")
        on = (F.col("sheet") == F.col("f_sheet")) & (edges["n_row"] == needed["n_row"]) & (edges["n_column"] == needed["n_column"]) & (edges["n_part"] == needed["n_part"])
        fired = W(edges.join(needed, on).select(*[edges[c] for c in edge], "cell", "to"))
        open_edges = edges.join(needed, on, "left_anti").select(*edge)
        operand = lambda df: df.select(*key, "k", "cell", none.cast(PART).alias("part_"), none.cast(LIST).alias("items"))
        direct = operand(fired.where("mode = 'cell'"))
        ready = fresh.select(*key)
        rest = pieces.join(ready, key, "left_anti").unionByName(direct).unionByName(self._gathered(fired, key))
        if not self.led:
            return tuple(written_together(pending.join(ready, key, "left_anti"), open_edges, rest))
        addressed = fired.where("mode = 'via'").withColumn("mode", F.lit("cell"))
        failed = operand(addressed.where("to.err is not null").withColumn("cell", C.failed_as(F.col("to.err"))))
        led = addressed.where("to.err is null").drop("cell", "n_row", "n_column", "n_part").select("*", F.col("to.row").alias("n_row"), F.col("to.column").alias("n_column"))
        known = self._known(done).select(F.col("sheet").alias("f_sheet"), F.col("row").alias("f_row"), F.col("column").alias("f_column"), "cell")
        there = (F.col("sheet") == F.col("f_sheet")) & (F.col("n_row") == F.col("f_row")) & (F.col("n_column") == F.col("f_column"))
        formula = self.seen.select(F.col("sheet").alias("g_sheet"), F.col("row").alias("g_row"), F.col("column").alias("g_column"), F.lit(True).alias("waits"))
        reached = led.join(known, there, "left").join(formula, (F.col("sheet") == F.col("g_sheet")) & (F.col("n_row") == F.col("g_row")) & (F.col("n_column") == F.col("g_column")), "left")
        reached = W(reached.select(*key, "k", "mode", "n_row", "n_column", F.lit(0).alias("n_part"), zero.alias("o_row"), zero.alias("o_column"), "cell", (F.col("waits") & F.col("cell").isNull()).alias("waits")))
        new_edges = reached.where("waits").select(*edge)
        arrived = operand(reached.where("waits is null or not waits").withColumn("cell", F.coalesce("cell", C.cell(F.lit("blank")))))
        return tuple(written_together(pending.join(ready, key, "left_anti"), open_edges.unionByName(new_edges), rest.unionByName(failed).unionByName(arrived)))

    def _core(self, pending: DataFrame, edges: DataFrame) -> DataFrame:
        """Of the parts that wait for each other those of cycles and on ways between cycles: parts that nothing open waits for go, again and again. A part that a formula still has to get the address from counts as waited for."""
        key = [*PLACE, "part"]
        rest, links = pending, edges.select(*key, F.col("n_row"), F.col("n_column"), F.col("n_part")).distinct()
        while True:
            wanted = links.join(rest.select(*key), key, "left_semi").select("sheet", F.col("n_row").alias("row"), F.col("n_column").alias("column"), F.col("n_part").alias("part")).distinct()
            kept = written(rest.join(wanted, key, "left_semi"))
            if kept.count() == rest.count():
                return kept
            rest = kept


def formula_at(targets: DataFrame, tokens: list[tuple], cells: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(row, column, cell) of one formula at each place of ``targets``, over a table of cells of its own: tokens as those of ``formula_cells``, any marker."""
    places = targets.select(F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column")).distinct()

    def spot(r, c, absolute_row, absolute_column) -> Column:
        own = lambda base, d, absolute: F.lit(d).cast("long") if absolute else F.col(base) + F.lit(d)
        return place(own("row", r, absolute_row), own("column", c, absolute_column), bool(absolute_row), bool(absolute_column))

    made = []
    for t in tokens:
        if t[0] in (E.NUMBER, E.INTEGER):
            made.append(token(t[0], t[1]))
        elif t[0] in (E.STRING, E.VARIABLE):
            made.append(token(t[0], text=t[1]))
        elif t[0] in (E.REFERENCE, E.BLOCK, E.VARARG_BLOCK):
            made.append(token(t[0], a=spot(*t[1:5]), b=spot(*t[5:9]) if len(t) > 5 else None))
        else:
            made.append(token(t[0], n=t[1] if len(t) > 1 else None))
    formulas = places.select(F.lit(0).alias("sheet"), "row", "column", F.array(*made).alias("tokens"))
    with scratch(cells.sparkSession):
        return written(Workbook(cells.select(F.lit(0).alias("sheet"), "row", "column", "cell"), formulas, variables, apart=True).recalculated().drop("sheet"), kept=True)


def recalculate(cells: DataFrame, formulas: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(sheet, row, column, cell) of every formula: ``cells`` (sheet, row, column, cell) are constants, ``formulas`` (sheet, row, column, tokens) hold arrays of tokens, ``variables`` (name, cell) the named values. Formulas without a place have no result; an unknown name is #NAME!."""
    with scratch(cells.sparkSession):
        return written(Workbook(cells, formulas, variables).recalculated(), kept=True)
