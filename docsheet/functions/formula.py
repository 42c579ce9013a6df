"""The spreadsheet formula catalogue as column functions.

Values follow common spreadsheet rules where the formats fix only names and operand order: positions count from 1, INT is
the floor, MOD has the sign of the dividend, ROUND rounds halves away from zero, dates are days since 1899-12-31. A result
that doesn't exist (division by zero, logarithm of a negative number, unreadable text) is null here; ``cells`` keeps which error it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Days from 1899-12-31 to 1970-01-01.
EPOCH_DAYS = 25568


def _epoch() -> Column:
    return F.to_date(F.lit("1899-12-31"))


def _n(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _real(x: Column) -> Column:
    """Null instead of NaN and infinity."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def power(a: Column, b: Column) -> Column:
    return _real(F.pow(a, b))


def choose(index: Column, *values: Column) -> Column:
    """The ``index``-th value, from 1; null outside."""
    return F.get(F.array(*values), index - 1)


# text
def find(needle: Column, text: Column, start=1) -> Column:
    """Position from 1 of ``needle`` at or after ``start``; null if it isn't there."""
    return F.nullif(F.call_function("locate", needle, text, _n(start)), F.lit(0))


def replace(text: Column, start: Column, count: Column, new: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), _n(start) - 1), new, F.substring(text, _n(start) + _n(count), F.length(text)))


def string(number: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", number)


def string_to(number: Column, decimals: Column) -> Column:
    """The same with a column of decimals (below 0: none)."""
    return F.call_function("format_string", F.concat(F.lit("%."), F.greatest(decimals.cast("int"), F.lit(0)).cast("string"), F.lit("f")), number.cast("double"))


def trim(text: Column) -> Column:
    """Without outer spaces; inner runs become one."""
    return F.trim(F.regexp_replace(text, " +", " "))


def value(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def proper(text: Column) -> Column:
    return F.initcap(text)


# dates
def date(year: Column, month: Column, day: Column) -> Column:
    return F.date_diff(F.make_date(year, month, day), _epoch())


def datevalue(text: Column) -> Column:
    return F.date_diff(text.try_cast("date"), _epoch())


def serial_date(serial: Column) -> Column:
    """The date of a serial day number."""
    return F.date_add(_epoch(), F.floor(serial).cast("int"))


def _second_of_day(serial: Column) -> Column:
    return F.round((serial - F.floor(serial)) * 86400).cast("int") % 86400


def hour(serial: Column) -> Column:
    return (_second_of_day(serial) / 3600).cast("int")


def minute(serial: Column) -> Column:
    return (_second_of_day(serial) % 3600 / 60).cast("int")


def second(serial: Column) -> Column:
    return _second_of_day(serial) % 60


def time(hours: Column, minutes: Column, seconds: Column) -> Column:
    return (hours * 3600 + minutes * 60 + seconds) / F.lit(86400.0)


def timevalue(moment: Column) -> Column:
    return time(F.hour(moment), F.minute(moment), F.second(moment))


def now_serial() -> Column:
    return F.date_diff(F.current_date(), _epoch()) + timevalue(F.current_timestamp())


# mathematics
def fact(n: Column) -> Column:
    """n!, null outside 0 to 170."""
    return F.when((n >= 0) & (n <= 170), F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), F.lit(1.0), lambda a, x: a * x))


def permut(n: Column, k: Column) -> Column:
    steps = F.when((k >= 1) & (k <= n), F.sequence(F.lit(0), k.cast("int") - 1)).when(k == 0, F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - i))


def combin(n: Column, k: Column) -> Column:
    steps = F.when((k >= 1) & (k <= n), F.sequence(F.lit(1), k.cast("int"))).when(k == 0, F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / i)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_to(x: Column, decimals: Column) -> Column:
    """``x`` to a column of decimals, halves away from zero."""
    scale = F.pow(F.lit(10.0), F.floor(decimals))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


# finance; rates are per period
def cterm(rate: Column, fv: Column, pv: Column) -> Column:
    return _real(F.try_divide(F.ln(F.try_divide(fv, pv)), F.ln(1 + rate)))


def fv(pmt: Column, rate: Column, term: Column) -> Column:
    return F.when(rate == 0, pmt * term).otherwise(pmt * F.try_divide(F.pow(1 + rate, term) - 1, rate))


def pv(pmt: Column, rate: Column, term: Column) -> Column:
    return F.when(rate == 0, pmt * term).otherwise(pmt * F.try_divide(1 - F.pow(1 + rate, -term), rate))


def pmt(principal: Column, rate: Column, term: Column) -> Column:
    return F.when(rate == 0, F.try_divide(principal, term)).otherwise(F.try_divide(principal * rate, 1 - F.pow(1 + rate, -term)))


def rate(fv: Column, pv: Column, term: Column) -> Column:
    return _real(F.pow(F.try_divide(fv, pv), F.try_divide(F.lit(1.0), term)) - 1)


def sln(cost: Column, salvage: Column, life: Column) -> Column:
    return F.try_divide(cost - salvage, life)


def syd(cost: Column, salvage: Column, life: Column, period: Column) -> Column:
    return F.try_divide((cost - salvage) * (life - period + 1), life * (life + 1) / 2)


def ddb(cost: Column, salvage: Column, life: Column, period: Column) -> Column:
    """Double-declining depreciation of ``period``: a fold over the periods before."""
    zero = F.struct(cost.cast("double").alias("left"), F.lit(0.0).alias("last"))

    def step(acc: Column, _: Column) -> Column:
        off = F.greatest(F.lit(0.0), F.least(acc["left"] * 2 / life, acc["left"] - salvage))
        return F.struct((acc["left"] - off).alias("left"), off.alias("last"))

    return F.aggregate(F.sequence(F.lit(1), period.cast("int")), zero, step, lambda acc: acc["last"])


def term(pmt: Column, rate: Column, fv: Column) -> Column:
    return _real(F.try_divide(F.ln(1 + F.try_divide(fv * rate, pmt)), F.ln(1 + rate)))


def npv_at(rate: Column, flows: Column) -> Column:
    """Net present value of an array, the first flow one period away."""
    return F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + rate, i + 1)), F.lit(0.0), lambda a, x: a + x)


def bound(values: list[Column], body) -> Column:
    """``body`` of values that are computed once, however often it names them: nested formulas would grow with each level else."""
    if not values:
        return body()
    row = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda x: body(*[x[f"v{k}"] for k in range(len(values))])), F.lit(0))


def irr(flows: Column, guess: float | Column = 0.1, steps: int = 40) -> Column:
    """Internal rate of return of an array (first flow now) by Newton steps until they no longer move; where these don't converge, by halving between -0.99 and 10 if the value changes its sign there, else null.

    Values and slopes are folds over the flows from the last one (Horner), and what several of them read is computed once.
    """
    discount = lambda r: F.try_divide(F.lit(1.0), 1 + r)

    def newton(back: Column, guess: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("d"))
        value = lambda v: F.aggregate(back, none, lambda a, x: F.struct((a["p"] * v + x).alias("p"), (a["d"] * v + a["p"]).alias("d")))  # noqa: E731  and its slope in v

        def move(acc: Column, _: Column) -> Column:
            r = acc["r"]
            to = lambda v: F.greatest(F.lit(-0.99), r + F.coalesce(bound([value(v)], lambda y: F.try_divide(y["p"], y["d"] * v * v)), F.lit(0.0)))
            moved = bound([bound([discount(r)], to)], lambda x: F.struct(x.alias("r"), F.coalesce(F.abs(x - r) <= 1e-13, F.lit(False)).alias("still")))
            return F.when(acc["still"], acc).otherwise(moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(guess.alias("r"), F.lit(False).alias("still")), move, lambda acc: acc["r"])

    def halved(back: Column) -> Column:
        value = lambda r: bound([discount(r)], lambda v: F.aggregate(back, F.lit(0.0), lambda a, x: a * v + x))
        low, high = F.lit(-0.99), F.lit(10.0)

        def between(at_low: Column, at_high: Column) -> Column:
            def halve(acc: Column, _: Column) -> Column:
                middle = (acc["a"] + acc["b"]) / 2
                return bound([middle, (value(middle) > 0) == (at_low < at_high)], lambda m, above: F.struct(F.when(above, acc["a"]).otherwise(m).alias("a"), F.when(above, m).otherwise(acc["b"]).alias("b")))

            found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(low.alias("a"), high.alias("b")), halve, lambda acc: (acc["a"] + acc["b"]) / 2)
            return F.when(F.signum(at_low) * F.signum(at_high) < 0, found)

        return bound([value(low), value(high)], between)

    def rate(flows: Column, back: Column, guess: Column) -> Column:
        scale = F.aggregate(flows, F.lit(1.0), lambda a, x: a + F.abs(x))
        good = lambda found: F.abs(npv_at(found, flows)) * (1 + found) <= scale * 1e-9
        return bound([newton(back, guess)], lambda found: F.when(good(found), found).otherwise(halved(back)))

    return bound([flows], lambda f: bound([f, F.reverse(f), _n(guess).cast("double")], rate))


# references
def column_letters(column: Column) -> Column:
    """A to Z, AA and on, of a column number from 1; null beyond three letters."""
    n = column.cast("int")
    letter = lambda x: F.chr(F.lit(65) + x)
    one, two = letter((n - 1) % 26), letter(((n - 27) / 26).cast("int") % 26)
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).when(n <= 18278, F.concat(letter(((n - 703) / 676).cast("int")), two, one))


def address(row: Column, column: Column) -> Column:
    return F.concat(F.lit("$"), column_letters(column), F.lit("$"), row.cast("string"))


def reference(text: Column) -> Column:
    """(row, column) of an A1 reference, with or without $; null if it is none."""
    letters = F.upper(F.regexp_extract(text, r"^\$?([A-Za-z]{1,3})\$?[0-9]{1,9}$", 1))
    number = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
    row = F.regexp_extract(text, r"^\$?[A-Za-z]{1,3}\$?([0-9]{1,9})$", 1).try_cast("int")
    return F.when(letters != "", F.struct(row.alias("row"), number.alias("column")))


#: Aggregates over a block: name to aggregate of a column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "COUNTBLANK": lambda x: F.count_if(x.isNull()), "MAX": F.max, "MIN": F.min, "PRODUCT": F.product,
    "STDEVP": F.stddev_pop, "STDEV": F.stddev_samp, "SUM": F.sum, "SUMSQ": lambda x: F.sum(x * x), "VARP": F.var_pop, "VAR": F.var_samp,
}


def sumproduct(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def npv(rate: Column, x: Column, ordinal: Column) -> Column:
    """Net present value over rows, each with its period from 1."""
    return F.sum(x / F.pow(1 + rate, ordinal))


#: Row functions of the catalogue: name to (number of operands, column function).
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "<": (2, lambda a, b: a < b), "<=": (2, lambda a, b: a <= b), ">": (2, lambda a, b: a > b), ">=": (2, lambda a, b: a >= b), "<>": (2, lambda a, b: a != b), "=": (2, lambda a, b: a == b),
    "+": (2, lambda a, b: a + b), "-": (2, lambda a, b: a - b), "*": (2, lambda a, b: a * b), "/": (2, div), "^": (2, power), "NOT": (1, lambda a: ~a), "AND": (2, lambda a, b: a & b), "OR": (2, lambda a, b: a | b),
    "&": (2, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "IF": (3, lambda c, a, b: F.when(c, a).otherwise(b)), "TRUE": (0, lambda: F.lit(True)), "FALSE": (0, lambda: F.lit(False)),
    "CHAR": (1, F.chr), "CODE": (1, F.ascii), "EXACT": (2, lambda a, b: a == b), "FIND": (3, find), "LEFT": (2, F.left), "LEN": (1, F.length), "LOWER": (1, F.lower), "MID": (3, F.substring), "PROPER": (1, proper),
    "REPLACE": (4, replace), "REPT": (2, F.repeat), "RIGHT": (2, F.right), "STRING": (2, string), "T": (1, lambda a: F.coalesce(a, F.lit(""))), "TRIM": (1, trim), "UPPER": (1, F.upper), "VALUE": (1, value),
    "DATE": (3, date), "DATEVALUE": (1, datevalue), "DAY": (1, lambda s: F.day(serial_date(s))), "HOUR": (1, hour), "MINUTE": (1, minute), "MONTH": (1, lambda s: F.month(serial_date(s))), "NOW": (0, now_serial),
    "SECOND": (1, second), "TODAY": (0, lambda: F.date_diff(F.current_date(), _epoch())), "TIME": (3, time), "TIMEVALUE": (1, timevalue), "YEAR": (1, lambda s: F.year(serial_date(s))),
    "ABS": (1, F.abs), "ACOS": (1, lambda x: _real(F.acos(x))), "ASIN": (1, lambda x: _real(F.asin(x))), "ATAN": (1, F.atan), "ATAN2": (2, lambda x, y: F.atan2(y, x)), "COS": (1, F.cos), "DEGREES": (1, F.degrees),
    "EXP": (1, F.exp), "FACT": (1, fact), "INT": (1, lambda x: F.floor(x).cast("double")), "LN": (1, F.ln), "LOG10": (1, F.log10), "MOD": (2, lambda a, b: F.call_function("try_mod", a, b)), "PI": (0, F.pi),
    "RADIANS": (1, F.radians), "RAND": (0, F.rand), "ROUND": (2, F.round), "SIGN": (1, lambda x: F.signum(x).cast("int")), "SIN": (1, F.sin), "SQRT": (1, lambda x: _real(F.sqrt(x))), "TAN": (1, F.tan), "TRUNC": (1, trunc),
    "CTERM": (3, cterm), "DDB": (4, ddb), "FV": (3, fv), "PMT": (3, pmt), "PV": (3, pv), "RATE": (3, rate), "SLN": (3, sln), "SYD": (4, syd), "TERM": (3, term), "COMBIN": (2, combin), "PERMUT": (2, permut),
    "ADDRESS": (2, address), "INDIRECT": (1, reference), "IRR": (1, irr),
}
