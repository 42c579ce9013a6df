"""Tagged cell values: errors are data, not nulls.

A cell is a struct of ``kind`` (blank, int, bool, error, float, string) and one nullable field per kind. Operators hand on the
first error of their operands; a blank counts as 0 or as empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes (fixed values), from 0.
ERRORS = ("none", "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME!", "#NUM!", "#N/A!")


def cell(kind: Column, num: Column | None = None, text: Column | None = None, flag: Column | None = None, error: Column | None = None) -> Column:
    """A cell; fields that don't belong to its kind are null."""
    own = lambda kinds, x, t: F.when(kind.isin(*kinds), x.cast(t)).otherwise(F.lit(None).cast(t)) if x is not None else F.lit(None).cast(t)
    return F.struct(kind.alias("kind"), own(("int", "float"), num, "double").alias("num"), own(("string",), text, "string").alias("str"), own(("bool",), flag, "boolean").alias("bool"), own(("error",), error, "int").alias("err"))


def failed(code: int) -> Column:
    return cell(F.lit("error"), error=F.lit(code))


def failed_as(code: Column) -> Column:
    """An error cell of a computed code."""
    return cell(F.lit("error"), error=code)


def guarded(operands: list[Column], numbers: list[Column], result: Column) -> Column:
    """``result``, unless an operand is an error (the first one wins) or one of ``numbers`` is missing (#VALUE!)."""
    out = None
    for c in operands:
        out = F.when(is_error(c), c) if out is None else out.when(is_error(c), c)
    for x in numbers:
        out = F.when(x.isNull(), failed(3)) if out is None else out.when(x.isNull(), failed(3))
    return result if out is None else out.otherwise(result)


def info(attribute: str, c: Column, row: Column, column: Column) -> Column:
    """CELL: the ``row``, ``column``, ``address``, ``contents`` (as text) or ``type`` (b blank, l label, v value) of a cell, as a cell."""
    from .formula import address

    if attribute in ("row", "column"):
        return cell(F.lit("int"), num=row if attribute == "row" else column)
    kinds = {"address": address(row, column), "contents": text(c), "type": F.when(is_blank(c), "b").when(is_text(c), "l").otherwise("v")}
    return cell(F.lit("string"), text=kinds[attribute])


def number(c: Column) -> Column:
    """The number of a cell: a blank is 0, a flag 0 or 1, text that reads as a number that number, else null."""
    return F.when(c["kind"] == "blank", 0.0).when(c["kind"] == "bool", c["bool"].cast("double")).when(c["kind"] == "string", F.trim(c["str"]).try_cast("double")).otherwise(c["num"])


def text(c: Column) -> Column:
    return F.when(c["kind"] == "string", c["str"]).when(c["kind"] == "bool", F.upper(c["bool"].cast("string"))).when(c["kind"] == "int", c["num"].cast("long").cast("string")).when(c["kind"] == "float", c["num"].cast("string")).otherwise("")


def combine(op: Callable[[Column, Column], Column], a: Column, b: Column, none: int = 6) -> Column:
    """``op`` on the numbers of two cells: the first error wins, unreadable text is #VALUE!, a missing result the error ``none``."""
    x, y = number(a), number(b)
    result = op(x, y)
    return guarded([a, b], [x, y], F.when(result.isNull(), failed(none)).otherwise(cell(F.lit("float"), num=result)))


def is_blank(c: Column) -> Column:
    return c["kind"] == "blank"


def is_error(c: Column) -> Column:
    return c["kind"] == "error"


def is_err(c: Column) -> Column:
    """An error other than #N/A!."""
    return is_error(c) & (c["err"] != 7)


def is_na(c: Column) -> Column:
    return is_error(c) & (c["err"] == 7)


def is_logical(c: Column) -> Column:
    return c["kind"] == "bool"


def is_text(c: Column) -> Column:
    return c["kind"] == "string"


def is_nontext(c: Column) -> Column:
    return c["kind"] != "string"


def is_number(c: Column) -> Column:
    return c["kind"].isin("int", "float")


def n(c: Column) -> Column:
    """Its number, 1 for true, else 0."""
    return F.when(is_number(c), c["num"]).when(c["kind"] == "bool", c["bool"].cast("double")).otherwise(0.0)


def type_code(c: Column) -> Column:
    """1 number or blank, 2 text, 4 flag, 16 error."""
    return F.when(is_text(c), 2).when(is_logical(c), 4).when(is_error(c), 16).otherwise(1)


def error_type(c: Column) -> Column:
    return F.when(is_error(c), c["err"])


def error_label(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, ERRORS)), c["err"])


CELL_FUNCTIONS = {"ISBLANK": is_blank, "ISERR": is_err, "ISERROR": is_error, "ISLOGICAL": is_logical, "ISNA": is_na, "ISNONTEXT": is_nontext, "ISNUMBER": is_number, "ISTEXT": is_text, "N": n, "TYPE": type_code, "ERRORTYPE": error_type}
