"""Formula evaluation over tables: postfix tokens as expressions over tagged cells, dependent cells in rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import formula as X
from ..functions.formula import AGGREGATES, FUNCTIONS
from ..operators import sheet as S
from ..sources.shared import scratch, written

#: Markers with their names and numbers of operands, by marker byte (fixed values).
MARKERS: dict[int, tuple[str, int]] = {
    0x01: ("<", 2), 0x02: ("<=", 2), 0x03: (">", 2), 0x04: (">=", 2), 0x05: ("<>", 2), 0x06: ("=", 2), 0x07: ("+", 2), 0x08: ("-", 2), 0x09: ("*", 2), 0x0A: ("/", 2), 0x0B: ("^", 2), 0x0C: ("plus", 1), 0x0D: ("minus", 1),
    0x0E: ("NOT", 1), 0x0F: ("AND", 2), 0x10: ("OR", 2), 0x11: ("&", 2), 0x12: ("()", 1), 0x33: ("FALSE", 0), 0x34: ("IF", 3), 0x35: ("TRUE", 0), 0x37: ("ERRORTYPE", 1), 0x38: ("ISBLANK", 1), 0x39: ("ISERR", 1), 0x3A: ("ISERROR", 1),
    0x3B: ("ISLOGICAL", 1), 0x3C: ("ISNA", 1), 0x3D: ("ISNONTEXT", 1), 0x3E: ("ISNUMBER", 1), 0x3F: ("ISTEXT", 1), 0x40: ("N", 1), 0x41: ("TYPE", 1), 0x42: ("ADDRESS", 2), 0x4D: ("CHAR", 1), 0x4E: ("CODE", 1), 0x4F: ("EXACT", 2), 0x50: ("FIND", 3),
    0x51: ("LEFT", 2), 0x52: ("LEN", 1), 0x53: ("LOWER", 1), 0x54: ("MID", 3), 0x55: ("PROPER", 1), 0x56: ("REPLACE", 4), 0x57: ("REPT", 2), 0x58: ("RIGHT", 2), 0x59: ("STRING", 2), 0x5A: ("T", 1), 0x5B: ("TRIM", 1), 0x5C: ("UPPER", 1), 0x5D: ("VALUE", 1),
    0x5E: ("DATE", 3), 0x5F: ("DATEVALUE", 1), 0x60: ("DAY", 1), 0x61: ("HOUR", 1), 0x62: ("MINUTE", 1), 0x63: ("MONTH", 1), 0x64: ("NOW", 0), 0x65: ("SECOND", 1), 0x66: ("TODAY", 0), 0x67: ("TIME", 3), 0x68: ("TIMEVALUE", 1), 0x69: ("YEAR", 1),
    0x6A: ("ABS", 1), 0x6B: ("ACOS", 1), 0x6C: ("ASIN", 1), 0x6D: ("ATAN", 1), 0x6E: ("ATAN2", 2), 0x6F: ("COS", 1), 0x70: ("DEGREES", 1), 0x71: ("EXP", 1), 0x72: ("FACT", 1), 0x73: ("INT", 1), 0x74: ("LN", 1), 0x75: ("LOG10", 1), 0x76: ("MOD", 2),
    0x77: ("PI", 0), 0x78: ("RADIANS", 1), 0x79: ("RAND", 0), 0x7A: ("ROUND", 2), 0x7B: ("SIGN", 1), 0x7C: ("SIN", 1), 0x7D: ("SQRT", 1), 0x7F: ("TAN", 1), 0x80: ("TRUNC", 1), 0x81: ("CTERM", 3), 0x82: ("DDB", 4), 0x83: ("FV", 3), 0x86: ("PMT", 3), 0x87: ("PV", 3),
    0x88: ("RATE", 3), 0x89: ("SLN", 3), 0x8A: ("SYD", 4), 0x8B: ("TERM", 3), 0x8C: ("COMBIN", 2), 0x8D: ("PERMUT", 2),
    0x8E: ("AVERAGE", -1), 0x8F: ("CHOOSE", -1), 0x90: ("COUNT", -1), 0x91: ("COUNTA", -1), 0x92: ("COUNTBLANK", -1), 0x93: ("MAX", -1), 0x94: ("MIN", -1), 0x95: ("PRODUCT", -1), 0x96: ("STDEVP", -1), 0x97: ("STDEV", -1), 0x98: ("SUM", -1), 0x99: ("SUMSQ", -1), 0x9A: ("VARP", -1), 0x9B: ("VAR", -1),
}
NUMBER, INTEGER, VARIABLE, STRING, REFERENCE, BLOCK, VARARG_BLOCK = 0x1F, 0x20, 0x25, 0x26, 0x27, 0x28, 0x29
#: Functions of text operands and their kinds (s text, n number), fixed values.
TEXTUAL = {"&": "ss", "CODE": "s", "EXACT": "ss", "FIND": "ssn", "LEFT": "sn", "LEN": "s", "LOWER": "s", "MID": "snn", "PROPER": "s", "REPLACE": "snns", "REPT": "sn", "RIGHT": "sn", "TRIM": "s", "UPPER": "s", "VALUE": "s", "DATEVALUE": "s", "TIMEVALUE": "s"}
#: Functions with whole-number operands.
WHOLE = {"CHAR", "DATE", "ADDRESS", "COMBIN", "PERMUT", "FACT", "DDB"}
#: Functions that take cells as operands where the catalogue takes literals or other kinds.
BY_CELL = {"ROUND": X.round_to, "STRING": X.string_to, "TIMEVALUE": lambda s: X.timevalue(s.try_cast("timestamp"))}
COMPARISONS = ("<", "<=", ">", ">=", "<>", "=")


def plain(tokens: list[tuple], operands: dict[str, Column] | None = None) -> Column:
    """Expression of postfix tokens over plain numbers: (0x1F, number or Column) or (marker,), one value left. A table whose rows share a formula evaluates it as compiled code, not token by token."""
    stack: list[Column] = []
    for token in tokens:
        if token[0] in (NUMBER, INTEGER):
            stack.append(token[1].cast("double") if isinstance(token[1], Column) else F.lit(float(token[1])))
        elif token[0] == VARIABLE:
            stack.append((operands or {})[token[1]].cast("double"))
        else:
            name, n = MARKERS[token[0]]
            args = _pop(stack, n)
            stack.append(args[0] if name in ("()", "plus") else -args[0] if name == "minus" else FUNCTIONS[name][1](*args).cast("double"))
    if len(stack) != 1:
        raise ValueError("a formula leaves exactly one value")
    return stack[0]


def _pop(stack: list, n: int) -> list:
    if len(stack) < n:
        raise ValueError("an operator lacks operands")
    args = stack[len(stack) - n :] if n else []
    del stack[len(stack) - n :]
    return args


def evaluate(tokens: Column) -> Column:
    """The value of postfix tokens held in a column (array of structs of ``marker`` and ``number``), for tables whose rows have formulas of their own; null if an operation has no result or anything but one value is left.

    Operands stand left to right; a number pushes itself, brackets change nothing. Numeric operators only; a fold over a stack.
    """
    start = F.array().cast("array<double>")
    numeric = {code: (name, n) for code, (name, n) in MARKERS.items() if n > 0 and name in FUNCTIONS and name not in TEXTUAL and name not in WHOLE and name != "STRING" and not name.startswith("IS") and name not in ("NOT", "AND", "OR", "IF", "N", "T", "TYPE")}

    def step(stack: Column, token: Column) -> Column:
        marker, out = token["marker"], None
        pop = lambda n: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - n, F.lit(0)))
        arg = lambda n, k: F.get(stack, F.size(stack) - n + k)
        out = F.when(marker == NUMBER, F.concat(stack, F.array(token["number"]))).when(marker.isin(0x0C, 0x12), stack).when(marker == 0x0D, F.concat(pop(1), F.array(-arg(1, 0))))
        for code, (name, n) in numeric.items():
            result = BY_CELL.get(name, FUNCTIONS[name][1])(*[arg(n, k) for k in range(n)]).cast("double")
            out = out.when((marker == code) & (F.size(stack) >= n), F.concat(pop(n), F.array(result)))
        return out

    return F.aggregate(tokens, start, step, lambda s: F.when(F.size(s) == 1, F.get(s, 0)))


def formula_cells(targets: DataFrame, tokens: list[tuple], cells: DataFrame, variables: DataFrame | None = None, key: str = "target") -> DataFrame:
    """``targets`` (key, row, column) with ``result``, the tagged cell of one formula at each of them.

    Tokens: (0x1F, number), (0x20, integer), (0x26, text), (0x25, name of a variable), (0x27, d_row, d_column, absolute_row,
    absolute_column), (0x28 or 0x29, the same for two corners) and (marker,) or (marker, number of operands) for those with any
    number. References are left joins with ``cells`` (row, column, cell; none is a blank), variables one with ``variables``
    (name, cell; none is #NAME!), blocks a banded join aggregated per target. Errors travel: the first one of the operands is the result.
    Formulas with computed references or functions of whole blocks (``workbook.PLACED``, ``LISTED``) are evaluated as those of a workbook are, in
    written rounds. Rows of targets may repeat; of variables with one name the least counts.
    """
    from . import workbook as B

    if any(token[0] in B.PLACED or token[0] in B.LISTED for token in tokens):
        found = B.formula_at(targets, tokens, cells, variables).select(F.col("row").alias("_row"), F.col("column").alias("_column"), F.col("cell").alias("result"))
        return targets.join(found, (F.col("row") == F.col("_row")) & (F.col("column") == F.col("_column")), "left").select(*targets.columns, "result")
    table = targets
    named = B.Workbook._variables([("", [("variable", token[1]) for token in tokens if token[0] == VARIABLE])], variables)
    for k, token in enumerate(tokens):
        if token[0] == REFERENCE:
            table = _with_cell(table, cells, token[1:5], f"_r{k}")
    stack: list = []
    for k, token in enumerate(tokens):
        marker = token[0]
        if marker == NUMBER:
            stack.append(C.cell(F.lit("float"), num=F.lit(float(token[1]))))
        elif marker == INTEGER:
            stack.append(C.cell(F.lit("int"), num=F.lit(int(token[1]))))
        elif marker == STRING:
            stack.append(C.cell(F.lit("string"), text=F.lit(token[1])))
        elif marker == VARIABLE:
            stack.append(named.get(token[1], C.failed(5)))
        elif marker == REFERENCE:
            table = table.withColumn(f"_r{k}", F.coalesce(F.col(f"_r{k}"), C.cell(F.lit("blank"))))
            stack.append(F.col(f"_r{k}"))
        elif marker in (BLOCK, VARARG_BLOCK):
            stack.append(token)
        else:
            name, n = MARKERS[marker]
            args = _pop(stack, token[1] if n < 0 else n)
            if name in AGGREGATES:
                table, made = _aggregated(table, cells, name, args, key, f"_a{k}")
            else:
                made = apply(name, args)
            # a column of its own: later operators name it several times
            table = table.withColumn(f"_s{k}", made)
            stack.append(F.col(f"_s{k}"))
    if len(stack) != 1 or isinstance(stack[0], tuple):
        raise ValueError("a formula leaves exactly one value")
    return table.select(*targets.columns, stack[0].alias("result"))


def _with_cell(table: DataFrame, cells: DataFrame, reference: tuple, name: str) -> DataFrame:
    d_row, d_column, absolute_row, absolute_column = reference
    at = S.resolve_reference(F.col("row"), F.col("column"), F.lit(d_row).cast("long"), F.lit(d_column).cast("long"), F.lit(absolute_row), F.lit(absolute_column))
    other = cells.select(F.col("row").alias("_row"), F.col("column").alias("_column"), F.col("cell").alias(name))
    return table.withColumn("_at", at).join(other, (F.col("_at.row") == F.col("_row")) & (F.col("_at.column") == F.col("_column")), "left").drop("_at", "_row", "_column")


def _aggregated(table: DataFrame, cells: DataFrame, name: str, args: list, key: str, out: str) -> tuple[DataFrame, Column]:
    """An aggregate over the cells of blocks and single operands: rows of all of them are grouped per distinct target and place."""
    members, own = None, [key, "row", "column"]
    number = {c: f"_{c}" for c in own}
    for arg in args:
        if isinstance(arg, tuple):
            corner = lambda k, arg=arg: S.resolve_reference(F.col("row"), F.col("column"), *[F.lit(x).cast("long") for x in arg[k : k + 2]], *map(F.lit, arg[k + 2 : k + 4]))
            bounds = table.select(*[F.col(c).alias(n) for c, n in number.items()], corner(1).alias("a"), corner(5).alias("b")).distinct().select(*number.values(), F.col("a.row").alias("r1"), F.col("b.row").alias("r2"), F.col("a.column").alias("c1"), F.col("b.column").alias("c2"))
            found = S.cells_in_blocks(cells, bounds).select(*number.values(), "cell")
        else:
            found = table.select(*[F.col(c).alias(n) for c, n in number.items()], arg.alias("cell")).distinct()
        members = found if members is None else members.unionByName(found)
    cell = F.col("cell")
    numbers = F.when(C.is_number(cell), cell["num"])
    value = {"COUNTA": F.count_if(~C.is_blank(cell)), "COUNTBLANK": F.count_if(C.is_blank(cell))}.get(name, AGGREGATES[name](numbers))
    error = F.min(F.when(C.is_error(cell), cell["err"]))
    grouped = members.groupBy(*number.values()).agg(value.cast("double").alias("v"), error.alias("e")).select(*number.values(), F.struct("v", "e").alias(out))
    table = table.join(grouped, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in number.items()]), "left").drop(*number.values())
    none = F.lit(0.0) if name in ("COUNT", "COUNTA", "COUNTBLANK", "SUM", "SUMSQ") else F.lit(None).cast("double")
    value = F.coalesce(F.col(f"{out}.v"), none)
    failed = F.lit(False) if name.startswith("COUNT") else F.col(f"{out}.e").isNotNull()
    return table, F.when(failed, C.failed_as(F.col(f"{out}.e"))).when(value.isNull(), C.failed(2)).otherwise(C.cell(F.lit("float"), num=value))


def apply(name: str, args: list[Column]) -> Column:
    """An operator or function of the catalogue on tagged cells."""
    if name in ("()",):
        return args[0]
    if name in C.CELL_FUNCTIONS:
        value = C.CELL_FUNCTIONS[name](args[0])
        if name == "ERRORTYPE":
            return F.when(value.isNull(), C.failed(7)).otherwise(C.cell(F.lit("int"), num=value))
        return C.cell(F.lit("float"), num=value) if name in ("N", "TYPE") else C.cell(F.lit("bool"), flag=value)
    if name in ("TRUE", "FALSE"):
        return C.cell(F.lit("bool"), flag=F.lit(name == "TRUE"))
    if name == "IF":
        chosen = C.number(args[0])
        return F.when(C.is_error(args[0]), args[0]).when(chosen.isNull(), C.failed(3)).when(chosen != 0, args[1]).otherwise(args[2])
    if name == "CHOOSE":
        index = C.number(args[0])
        out = F.when(C.is_error(args[0]), args[0])
        for k, arg in enumerate(args[1:], 1):
            out = out.when(F.floor(index) == k, arg)
        return out.otherwise(C.failed(3))
    kinds = TEXTUAL.get(name, "n" * len(args))
    values = [C.text(a) if kind == "s" else C.number(a).cast("int") if name in WHOLE or name in TEXTUAL else C.number(a) for a, kind in zip(args, kinds, strict=True)]
    if name in COMPARISONS:
        both = reduce(lambda a, b: a & b, [C.is_text(a) for a in args])
        by_text, by_number = FUNCTIONS[name][1](*map(C.text, args)), FUNCTIONS[name][1](*values)
        return C.guarded(args, [F.when(both, 0.0).otherwise(v) for v in values], C.cell(F.lit("bool"), flag=F.when(both, by_text).otherwise(by_number)))
    if name in ("AND", "OR", "NOT"):
        return C.guarded(args, values, C.cell(F.lit("bool"), flag=FUNCTIONS[name][1](*[v != 0 for v in values])))
    result = values[0] if name == "plus" else -values[0] if name == "minus" else F.coalesce(args[0]["str"], F.lit("")) if name == "T" else BY_CELL.get(name, FUNCTIONS[name][1])(*values)
    if name in ("STRING", "&", "LEFT", "LOWER", "MID", "PROPER", "REPLACE", "REPT", "RIGHT", "TRIM", "UPPER", "CHAR", "ADDRESS", "T"):
        made = C.cell(F.lit("string"), text=result)
    elif name == "EXACT":
        made = C.cell(F.lit("bool"), flag=result)
    else:
        made = C.cell(F.lit("float"), num=result)
    none = 2 if name in ("/", "MOD", "SLN") else 3 if name in TEXTUAL else 6
    return C.guarded(args, [v for v, kind in zip(values, kinds, strict=True) if kind == "n" and name != "T"], F.when(result.isNull(), C.failed(none)).otherwise(made))


def evaluate_levels(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, value, level) of cells that are sums: ``cells`` (cell, base) and ``edges`` (cell, needs, weight), value = base + the weighted values of what a cell needs, level = the longest way down.

    Where every cell needs one other at most, paths double in each round, so a chain of n cells takes log n rounds. Else each
    round settles the cells whose needs are all settled and touches only these and their edges. Rounds go on until nothing is new: cells in or behind a
    cycle, or that need one that isn't there, have a null value and level. Each round is written, so lost executors repeat one at most; only the result stays.
    """
    with scratch(cells.sparkSession):
        edges = written(edges.select("cell", "needs", "weight"))
        chains = edges.groupBy("cell").count().where("count > 1").isEmpty()
        return written(_doubled(cells, edges) if chains else _levelled(cells, edges), kept=True)


def _levelled(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """A round settles the cells whose needs are all settled."""
    rest = written(cells.select("cell", F.col("base").cast("double").alias("acc")).join(edges.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    done, level = None, 0
    while True:
        new = written(rest.where("n = 0").select("cell", F.col("acc").alias("value"), F.lit(level).alias("level")))
        if new.isEmpty():
            break
        done = new if done is None else done.unionByName(new)
        got = edges.join(new.select(F.col("cell").alias("needs"), "value"), "needs").groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("weight") * F.col("value")).alias("plus"))
        rest = written(rest.where("n > 0").join(got, "cell", "left").select("cell", (F.col("acc") + F.coalesce("plus", F.lit(0.0))).alias("acc"), (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        level += 1
    return cells.select("cell").join(done, "cell", "left") if done is not None else cells.select("cell", F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("level"))


def _doubled(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Linear chains: each cell is base + factor * the value of ``next``; a round puts the expression of ``next`` in its place."""
    now = cells.select("cell", F.col("base").cast("double").alias("base")).join(edges.select("cell", F.col("needs").alias("next"), F.col("weight").cast("double").alias("factor")), "cell", "left")
    now = written(now.withColumn("level", F.col("next").isNotNull().cast("int")))
    longest = now.count()
    reach = 1
    while reach <= 2 * longest and not now.where("next is not null").isEmpty():
        other = now.select(F.col("cell").alias("next"), F.col("base").alias("b"), F.col("factor").alias("f"), F.col("next").alias("n"), F.col("level").alias("l"))
        step = now.join(other, "next", "left")
        moved = F.col("next").isNotNull() & F.col("b").isNotNull()
        now = written(step.select("cell", F.when(moved, F.col("base") + F.col("factor") * F.col("b")).otherwise(F.col("base")).alias("base"), F.when(moved, F.col("n")).otherwise(F.col("next")).alias("next"), F.when(moved, F.col("factor") * F.col("f")).otherwise(F.col("factor")).alias("factor"), F.when(moved, F.col("level") + F.col("l")).otherwise(F.col("level")).alias("level")))
        reach *= 2
    settled = F.col("next").isNull()  # what still has a next after more steps than cells is in or behind a cycle
    return now.select("cell", F.when(settled, F.col("base")).alias("value"), F.when(settled, F.col("level")).alias("level"))
