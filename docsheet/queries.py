"""Queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary as B
from .functions import cells as C
from .functions import formula as X
from .functions import text as T
from .operators import runs as R
from .operators import sheet as S
from .plans import evaluate as E
from .sources import sinks as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    """Registers a function of (tables) under ``name``; ``tables("t")`` reads a table."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return f

    return add


# One query per row function: result by key over a whole table. Floats are rounded on both sides.
def c(name: str) -> Column:
    return F.col(name)


LINE = ("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
DOC = ("documents", ("doc_id",))
ORD = ("orders", ("o_orderkey",))
PART = ("part", ("p_partkey",))
INT = lambda sql: f"CAST({sql} AS INTEGER)"

#: Catalogue name: (query name, table, operands, SQL, digits to round to or None).
SCALARS: list[tuple[str, str, tuple, Callable[[], tuple], str, int | None]] = [
    ("<", "lt", LINE, lambda: (c("l_quantity"), c("l_extendedprice") / 1000), "l_quantity < l_extendedprice / 1000", None),
    ("<=", "le", LINE, lambda: (c("l_discount"), c("l_tax")), "l_discount <= l_tax", None),
    (">", "gt", LINE, lambda: (c("l_discount"), c("l_tax")), "l_discount > l_tax", None),
    (">=", "ge", LINE, lambda: (c("l_discount"), c("l_tax")), "l_discount >= l_tax", None),
    ("<>", "ne", LINE, lambda: (c("l_discount"), c("l_tax")), "l_discount <> l_tax", None),
    ("=", "eq", LINE, lambda: (c("l_discount"), c("l_tax")), "l_discount = l_tax", None),
    ("+", "add", LINE, lambda: (c("l_extendedprice"), c("l_quantity")), "l_extendedprice + l_quantity", 4),
    ("-", "sub", LINE, lambda: (c("l_extendedprice"), c("l_quantity")), "l_extendedprice - l_quantity", 4),
    ("*", "mul", LINE, lambda: (c("l_extendedprice"), F.lit(1.0) - c("l_discount")), "l_extendedprice * (1.0 - l_discount)", 4),
    ("/", "div", LINE, lambda: (c("l_extendedprice"), c("l_tax")), "l_extendedprice / nullif(l_tax, 0)", 4),
    ("^", "power", LINE, lambda: (F.lit(1.0) + c("l_discount"), c("l_quantity")), "power(1.0 + l_discount, l_quantity)", 4),
    ("NOT", "not", LINE, lambda: (c("l_discount") > c("l_tax"),), "NOT (l_discount > l_tax)", None),
    ("AND", "and", LINE, lambda: (c("l_discount") > c("l_tax"), c("l_quantity") > 25), "l_discount > l_tax AND l_quantity > 25", None),
    ("OR", "or", LINE, lambda: (c("l_discount") > c("l_tax"), c("l_quantity") > 25), "l_discount > l_tax OR l_quantity > 25", None),
    ("&", "concat", PART, lambda: (c("p_brand"), c("p_type")), "p_brand || p_type", None),
    ("IF", "if", LINE, lambda: (c("l_discount") > c("l_tax"), c("l_extendedprice"), c("l_quantity")), "CASE WHEN l_discount > l_tax THEN l_extendedprice ELSE l_quantity END", 4),
    ("TRUE", "true", PART, lambda: (), "true", None),
    ("FALSE", "false", PART, lambda: (), "false", None),
    ("CHAR", "char", PART, lambda: (F.lit(64) + c("p_size") % 26,), "chr(CAST(64 + p_size % 26 AS INTEGER))", None),
    ("CODE", "code", PART, lambda: (c("p_name"),), "ascii(p_name)", None),
    ("EXACT", "exact", DOC, lambda: (c("lang"), F.lit("en")), "lang = 'en'", None),
    ("FIND", "find", PART, lambda: (F.lit("i"), c("p_name"), 1), "CAST(nullif(instr(p_name, 'i'), 0) AS INTEGER)", None),
    ("LEFT", "left", PART, lambda: (c("p_name"), F.lit(3)), "left(p_name, 3)", None),
    ("LEN", "len", DOC, lambda: (c("text"),), "CAST(length(text) AS INTEGER)", None),
    ("LOWER", "lower", PART, lambda: (c("p_brand"),), "lower(p_brand)", None),
    ("MID", "mid", DOC, lambda: (c("text"), F.lit(5), F.lit(20)), "substr(text, 5, 20)", None),
    ("PROPER", "proper", PART, lambda: (c("p_name"),), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')", None),
    ("REPLACE", "replace", PART, lambda: (c("p_name"), F.lit(2), F.lit(3), F.lit("--")), "substr(p_name, 1, 1) || '--' || substr(p_name, 5)", None),
    ("REPT", "rept", PART, lambda: (c("p_brand"), F.lit(3)), "repeat(p_brand, 3)", None),
    ("RIGHT", "right", PART, lambda: (c("p_name"), F.lit(4)), "right(p_name, 4)", None),
    ("STRING", "string", ORD, lambda: (c("o_totalprice"), 2), "printf('%.2f', o_totalprice)", None),
    ("T", "t", DOC, lambda: (c("source"),), "coalesce(source, '')", None),
    ("TRIM", "trim", DOC, lambda: (c("text"),), "trim(regexp_replace(text, ' +', ' ', 'g'), ' ')", None),
    ("UPPER", "upper", PART, lambda: (c("p_name"),), "upper(p_name)", None),
    ("VALUE", "value", PART, lambda: (F.regexp_replace("p_brand", "Brand#", ""),), "try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE)", None),
    ("DATE", "date", ORD, lambda: (F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate")), INT("date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE))"), None),
    ("DATEVALUE", "datevalue", ORD, lambda: (F.date_format("o_orderdate", "yyyy-MM-dd"),), INT("date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE))"), None),
    ("DAY", "day", ORD, lambda: (c("o_orderkey") % 40000,), INT("day(DATE '1899-12-31' + CAST(o_orderkey % 40000 AS INTEGER))"), None),
    ("MONTH", "month", ORD, lambda: (c("o_orderkey") % 40000,), INT("month(DATE '1899-12-31' + CAST(o_orderkey % 40000 AS INTEGER))"), None),
    ("YEAR", "year", ORD, lambda: (c("o_orderkey") % 40000,), INT("year(DATE '1899-12-31' + CAST(o_orderkey % 40000 AS INTEGER))"), None),
    ("HOUR", "hour", ("events", ("event_id",)), lambda: ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / F.lit(86400.0),), INT("hour(ts)"), None),
    ("MINUTE", "minute", ("events", ("event_id",)), lambda: ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / F.lit(86400.0),), INT("minute(ts)"), None),
    ("SECOND", "second", ("events", ("event_id",)), lambda: ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / F.lit(86400.0),), INT("second(ts)"), None),
    ("TIME", "time", ("events", ("event_id",)), lambda: (F.hour("ts"), F.minute("ts"), F.lit(30)), "(hour(ts) * 3600 + minute(ts) * 60 + 30) / CAST(86400 AS DOUBLE)", 8),
    ("TIMEVALUE", "timevalue", ("events", ("event_id",)), lambda: (c("ts"),), "(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / CAST(86400 AS DOUBLE)", 8),
    ("ABS", "abs", LINE, lambda: (c("l_quantity") - 25,), "abs(l_quantity - 25)", 4),
    ("ACOS", "acos", LINE, lambda: (c("l_quantity") / 40,), "CASE WHEN l_quantity <= 40 THEN acos(least(1.0, l_quantity / 40)) END", 6),
    ("ASIN", "asin", LINE, lambda: (c("l_quantity") / 40,), "CASE WHEN l_quantity <= 40 THEN asin(least(1.0, l_quantity / 40)) END", 6),
    ("ATAN", "atan", LINE, lambda: (c("l_quantity"),), "atan(l_quantity)", 6),
    ("ATAN2", "atan2", LINE, lambda: (c("l_quantity"), c("l_discount")), "atan2(l_discount, l_quantity)", 6),
    ("COS", "cos", LINE, lambda: (c("l_quantity"),), "cos(l_quantity)", 6),
    ("DEGREES", "degrees", LINE, lambda: (c("l_discount"),), "degrees(l_discount)", 6),
    ("EXP", "exp", LINE, lambda: (c("l_discount"),), "exp(l_discount)", 6),
    ("FACT", "fact", PART, lambda: (c("p_size") % 12,), "CAST(factorial(CAST(p_size % 12 AS INTEGER)) AS DOUBLE)", None),
    ("INT", "int", LINE, lambda: (c("l_quantity") - c("l_extendedprice") / 1000,), "floor(l_quantity - l_extendedprice / 1000)", None),
    ("LN", "ln", LINE, lambda: (c("l_extendedprice"),), "ln(l_extendedprice)", 6),
    ("LOG10", "log10", LINE, lambda: (c("l_extendedprice"),), "log10(l_extendedprice)", 6),
    ("MOD", "mod", LINE, lambda: (c("l_partkey") - 50, c("l_linenumber").cast("long") - 3), "CASE WHEN l_linenumber <> 3 THEN (l_partkey - 50) % (l_linenumber - 3) END", None),
    ("PI", "pi", PART, lambda: (), "pi()", 8),
    ("RADIANS", "radians", LINE, lambda: (c("l_quantity"),), "radians(l_quantity)", 6),
    ("ROUND", "round", LINE, lambda: (c("l_extendedprice"), 0), "round(l_extendedprice, 0)", None),
    ("SIGN", "sign", LINE, lambda: (c("l_quantity") - 25,), INT("sign(l_quantity - 25)"), None),
    ("SIN", "sin", LINE, lambda: (c("l_quantity"),), "sin(l_quantity)", 6),
    ("SQRT", "sqrt", LINE, lambda: (c("l_extendedprice"),), "sqrt(l_extendedprice)", 6),
    ("TAN", "tan", LINE, lambda: (c("l_discount"),), "tan(l_discount)", 6),
    ("TRUNC", "trunc", LINE, lambda: (c("l_quantity") - c("l_extendedprice") / 1000,), "trunc(l_quantity - l_extendedprice / 1000)", None),
    ("CTERM", "cterm", LINE, lambda: (c("l_discount") + 0.01, c("l_extendedprice") + 1, c("l_quantity")), "ln((l_extendedprice + 1) / l_quantity) / ln(1 + (l_discount + 0.01))", 6),
    ("DDB", "ddb", LINE, lambda: (c("l_extendedprice"), F.lit(0.0), F.lit(10), c("l_linenumber")), "l_extendedprice * 0.2 * power(0.8, l_linenumber - 1)", 4),
    ("FV", "fv", LINE, lambda: (c("l_extendedprice"), c("l_discount"), c("l_linenumber")), "CASE WHEN l_discount = 0 THEN l_extendedprice * l_linenumber ELSE l_extendedprice * ((power(1 + l_discount, l_linenumber) - 1) / l_discount) END", 3),
    ("PMT", "pmt", LINE, lambda: (c("l_extendedprice"), c("l_discount"), c("l_linenumber")), "CASE WHEN l_discount = 0 THEN l_extendedprice / l_linenumber ELSE l_extendedprice * l_discount / (1 - power(1 + l_discount, -l_linenumber)) END", 6),
    ("PV", "pv", LINE, lambda: (c("l_extendedprice"), c("l_discount"), c("l_linenumber")), "CASE WHEN l_discount = 0 THEN l_extendedprice * l_linenumber ELSE l_extendedprice * ((1 - power(1 + l_discount, -l_linenumber)) / l_discount) END", 3),
    ("RATE", "rate", LINE, lambda: (c("l_extendedprice"), c("l_quantity"), c("l_linenumber")), "power(l_extendedprice / l_quantity, 1.0 / l_linenumber) - 1", 6),
    ("SLN", "sln", LINE, lambda: (c("l_extendedprice"), c("l_quantity"), c("l_linenumber")), "(l_extendedprice - l_quantity) / l_linenumber", 4),
    ("SYD", "syd", LINE, lambda: (c("l_extendedprice"), c("l_quantity"), F.lit(10), c("l_linenumber")), "(l_extendedprice - l_quantity) * (10 - l_linenumber + 1) / CAST(55 AS DOUBLE)", 4),
    ("TERM", "term", LINE, lambda: (c("l_quantity"), c("l_discount") + 0.01, c("l_extendedprice")), "ln(1 + l_extendedprice * (l_discount + 0.01) / l_quantity) / ln(1 + (l_discount + 0.01))", 6),
    ("COMBIN", "combin", PART, lambda: (c("p_size") % 15 + 5, c("p_size") % 5), "CAST(factorial(CAST(p_size % 15 + 5 AS INTEGER)) / (factorial(CAST(p_size % 5 AS INTEGER)) * factorial(CAST(p_size % 15 + 5 - p_size % 5 AS INTEGER))) AS DOUBLE)", 2),
    ("PERMUT", "permut", PART, lambda: (c("p_size") % 15 + 5, c("p_size") % 5), "CAST(factorial(CAST(p_size % 15 + 5 AS INTEGER)) / factorial(CAST(p_size % 15 + 5 - p_size % 5 AS INTEGER)) AS DOUBLE)", 2),
    ("ADDRESS", "address", PART, lambda: (c("p_size"), c("p_partkey") % 26 + 1), "'$' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '$' || p_size", None),
]


def _scalar(symbol: str, name: str, source: tuple, operands: Callable[[], tuple], sql: str, digits: int | None) -> None:
    tbl, keys = source
    wrap = f"round({sql}, {digits})" if digits is not None else sql

    @query(f"fn_{name}", f"SELECT {', '.join(keys)}, {wrap} AS result FROM {tbl}")
    def run(tables) -> DataFrame:
        value = X.FUNCTIONS[symbol][1](*operands())
        return tables(tbl).select(*keys, (F.round(value, digits) if digits is not None else value).alias("result"))


# ``operands`` are made when a query runs: columns need a session
for _row in SCALARS:
    _scalar(*_row)

# Aggregates over a block: by return flag.
_AGG_SQL = {
    "AVERAGE": "avg(l_quantity)", "COUNT": "count(l_quantity)", "COUNTA": "count(l_shipdate)", "COUNTBLANK": "count(*) FILTER (WHERE nullif(l_discount, 0) IS NULL)", "MAX": "max(l_extendedprice)", "MIN": "min(l_extendedprice)",
    "PRODUCT": "product(1 + l_discount / 100000)", "STDEVP": "stddev_pop(l_quantity)", "STDEV": "stddev_samp(l_quantity)", "SUM": "sum(l_extendedprice)", "SUMSQ": "sum(l_quantity * l_quantity)", "VARP": "var_pop(l_quantity)", "VAR": "var_samp(l_quantity)",
}


def _agg_operand(name: str) -> Column:
    return {"COUNTA": c("l_shipdate"), "COUNTBLANK": F.nullif(c("l_discount"), F.lit(0.0)), "MAX": c("l_extendedprice"), "MIN": c("l_extendedprice"), "SUM": c("l_extendedprice"), "PRODUCT": F.lit(1) + c("l_discount") / 100000}.get(name, c("l_quantity"))


def _aggregate(name: str, sql: str) -> None:
    whole = name.startswith("COUNT")

    @query(f"agg_{name.lower()}", f"SELECT l_returnflag, {sql if whole else f'round({sql}, 2)'} AS result FROM lineitem GROUP BY l_returnflag")
    def run(tables) -> DataFrame:
        value = X.AGGREGATES[name](_agg_operand(name))
        return tables("lineitem").groupBy("l_returnflag").agg((value if whole else F.round(value, 2)).alias("result"))


for _name, _sql in _AGG_SQL.items():
    _aggregate(_name, _sql)


@query("agg_sumproduct", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice), 0) AS result FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(X.sumproduct(c("l_quantity"), c("l_extendedprice")), 0).alias("result"))


@query("agg_npv", "SELECT l_orderkey, round(sum(l_extendedprice / power(1.1, l_linenumber)), 2) AS result FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.round(X.npv(F.lit(0.1), c("l_extendedprice"), c("l_linenumber")), 2).alias("result"))


@query("fn_irr", None)
def _(t):
    """Rate at which an order's lines, sorted by number, pay back half of their sum."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), lambda x: x["l_extendedprice"])
    flows = t("lineitem").groupBy("l_orderkey").agg(lines.alias("f")).select("l_orderkey", F.concat(F.array(-F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / 2), "f").alias("flows"))
    return flows.select("l_orderkey", F.round(X.irr(c("flows")), 4).alias("result"))


@query("fn_choose", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_type END AS result FROM part")
def _(t):
    return t("part").select("p_partkey", X.choose(c("p_size") % 4, c("p_name"), c("p_brand"), c("p_type")).alias("result"))


@query("fn_indirect", "SELECT p_partkey, p_size AS \"row\", CAST(p_partkey % 26 + 1 AS INTEGER) AS \"column\" FROM part")
def _(t):
    ref = X.reference(X.address(c("p_size"), c("p_partkey") % 26 + 1))
    return t("part").select("p_partkey", ref["row"].alias("row"), ref["column"].alias("column"))


# Tagged cells: each order is a cell of one of six kinds.
_KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'blank' WHEN 1 THEN 'int' WHEN 2 THEN 'bool' WHEN 3 THEN 'error' WHEN 4 THEN 'float' ELSE 'string' END"
_CELLS = f"(SELECT o_orderkey, {_KIND} AS kind, CASE WHEN o_orderkey % 6 = 3 THEN CAST(o_custkey % 8 AS INTEGER) END AS err, CASE WHEN o_orderkey % 6 IN (1, 4) THEN round(o_totalprice, 0) END AS num, CASE WHEN o_orderkey % 6 = 2 THEN o_custkey % 2 = 0 END AS flag FROM orders)"


def order_cells(orders: DataFrame) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("blank", "int", "bool", "error", "float", "string"))), (c("o_orderkey") % 6).cast("int"))
    cell = C.cell(kind, F.round("o_totalprice", 0), c("o_orderpriority"), c("o_custkey") % 2 == 0, (c("o_custkey") % 8).cast("int"))
    return orders.select("o_orderkey", cell.alias("cell"))


_CELL_SQL = {
    "ISBLANK": "kind = 'blank'", "ISERR": "CASE WHEN kind = 'error' THEN err <> 7 ELSE false END", "ISERROR": "kind = 'error'", "ISLOGICAL": "kind = 'bool'", "ISNA": "CASE WHEN kind = 'error' THEN err = 7 ELSE false END", "ISNONTEXT": "kind <> 'string'",
    "ISNUMBER": "kind IN ('int', 'float')", "ISTEXT": "kind = 'string'", "N": "CASE kind WHEN 'int' THEN num WHEN 'float' THEN num WHEN 'bool' THEN CAST(flag AS DOUBLE) ELSE 0 END", "TYPE": "CASE kind WHEN 'string' THEN 2 WHEN 'bool' THEN 4 WHEN 'error' THEN 16 ELSE 1 END", "ERRORTYPE": "err",
}


def _cell_query(name: str, sql: str) -> None:
    @query(f"fn_{name.lower()}", f"SELECT o_orderkey, {sql} AS result FROM {_CELLS}")
    def run(t) -> DataFrame:
        return order_cells(t("orders")).select("o_orderkey", C.CELL_FUNCTIONS[name](c("cell")).alias("result"))


for _name, _sql in _CELL_SQL.items():
    _cell_query(_name, _sql)


@query(
    "cell_divide",
    f"SELECT o_orderkey, CASE WHEN kind = 'error' THEN err WHEN kind = 'string' THEN 3 WHEN kind = 'blank' OR (kind = 'bool' AND NOT flag) THEN 2 END AS err, "
    f"CASE WHEN kind IN ('int', 'float') THEN round(1000000 / num, 6) WHEN kind = 'bool' AND flag THEN 1000000.0 END AS num FROM {_CELLS}",
)
def _(t):
    """A million divided by each cell: errors, text, blanks and numbers."""
    made = C.combine(X.div, C.cell(F.lit("float"), num=F.lit(1e6)), c("cell"), none=2)
    return order_cells(t("orders")).select("o_orderkey", made.alias("r")).select("o_orderkey", c("r.err").alias("err"), F.round("r.num", 6).alias("num"))


# Lookups and blocks: lines as cells of a sheet, summed where several share a place.
_SHEET = "(SELECT l_orderkey AS \"row\", CAST(l_linenumber AS BIGINT) AS \"column\", round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2)"
_BLOCKS = "(SELECT n_nationkey AS block, CAST(n_nationkey * 37 AS BIGINT) AS r1, CAST(n_nationkey * 37 + 500 AS BIGINT) AS r2, CAST(1 AS BIGINT) AS c1, CAST(n_nationkey % 7 + 1 AS BIGINT) AS c2 FROM nation)"


def line_cells(lines: DataFrame) -> DataFrame:
    return lines.groupBy(c("l_orderkey").alias("row"), c("l_linenumber").cast("long").alias("column")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


def nation_blocks(nations: DataFrame) -> DataFrame:
    n = c("n_nationkey")
    return nations.select(n.alias("block"), (n * 37).cast("long").alias("r1"), (n * 37 + 500).cast("long").alias("r2"), F.lit(1).cast("long").alias("c1"), (n % 7 + 1).cast("long").alias("c2"))


@query("block_sum", f'SELECT block, count(*) AS n, round(sum(value), 2) AS total FROM {_BLOCKS} b JOIN {_SHEET} s ON s."row" BETWEEN r1 AND r2 AND s."column" BETWEEN c1 AND c2 GROUP BY block')
def _(t):
    inside = S.cells_in_blocks(line_cells(t("lineitem")), nation_blocks(t("nation")))
    return inside.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("block_index", f'SELECT block, s.value FROM {_BLOCKS} b LEFT JOIN {_SHEET} s ON s."row" = r1 + 9 AND s."column" = c1 + 1 AND s."column" <= c2')
def _(t):
    return S.block_index(nation_blocks(t("nation")), line_cells(t("lineitem")), F.lit(10), F.lit(2)).select("block", "value")


@query("block_shape", f"SELECT block, r2 - r1 + 1 AS n_rows, c2 - c1 + 1 AS n_columns, r1 AS first_row, c1 AS first_column FROM {_BLOCKS}")
def _(t):
    """ROWS, COLUMNS, ROW and COLUMN of blocks."""
    return nation_blocks(t("nation")).select("block", (c("r2") - c("r1") + 1).alias("n_rows"), (c("c2") - c("c1") + 1).alias("n_columns"), c("r1").alias("first_row"), c("c1").alias("first_column"))


@query("cell_offset", f'SELECT a."row", a."column", a.value, b.value AS shifted FROM {_SHEET} a LEFT JOIN {_SHEET} b ON b."row" = a."row" + 1 AND b."column" = a."column" + 1')
def _(t):
    return S.offset(line_cells(t("lineitem")), 1, 1)


@query("lookup_exact", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    return S.lookup_exact(t("orders").select("o_orderkey", c("o_custkey").alias("c_custkey")), t("customer"), "c_custkey", "c_name").select("o_orderkey", "c_name")


@query(
    "lookup_last",
    "SELECT e.event_id, p.value AS last_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def _(t):
    events = t("events")
    table = events.where("event_type = 'purchase'").select("user_id", "ts", c("value").alias("last_value"))
    return S.lookup_last(events.select("event_id", "user_id", "ts"), table, ["user_id"], "ts", "last_value").select("event_id", "last_value")


@query("lookup_bracket", "SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1000 THEN 'middle' WHEN p_retailprice >= 0 THEN 'low' END AS bracket FROM part")
def _(t):
    return t("part").select("p_partkey", S.bracket(c("p_retailprice"), [0, 1000, 1500], ["low", "middle", "high"]).alias("bracket"))


@query(
    "cell_default_layout",
    "SELECT o_orderkey, coalesce(n.n_name, s.s_name, 'sheet') AS layout FROM orders LEFT JOIN nation n ON o_custkey = n.n_nationkey * 5 LEFT JOIN supplier s ON o_orderkey = s.s_suppkey",
)
def _(t):
    """Layout of a cell: that of its row, else its column, else the sheet's."""
    rows = t("nation").select((c("n_nationkey") * 5).cast("long").alias("o_custkey"), c("n_name").alias("layout"))
    columns = t("supplier").select(c("s_suppkey").alias("o_orderkey"), c("s_name").alias("layout"))
    return R.fallback(t("orders").select("o_orderkey", "o_custkey"), [(rows, "o_custkey"), (columns, "o_orderkey")], F.lit("sheet"), "layout").select("o_orderkey", "layout")


@query("cell_position", "SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey * 97 // 4) % 256 AS \"column\", (l_partkey * 97 // 1024) % 16384 AS \"row\" FROM lineitem")
def _(t):
    at = S.decode_position(c("l_partkey") * 97)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", at["column"].alias("column"), at["row"].alias("row"))


@query(
    "cell_reference",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE o_custkey + 3 END AS \"row\", CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE o_orderkey + 2 END AS \"column\" FROM orders",
)
def _(t):
    at = S.resolve_reference(c("o_custkey"), c("o_orderkey"), F.lit(3), F.lit(2), c("o_orderkey") % 2 == 0, c("o_orderkey") % 3 == 0)
    return t("orders").select("o_orderkey", at["row"].alias("row"), at["column"].alias("column"))


@query("formula_eval", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(-(l_quantity + l_extendedprice) * (1 - l_discount) / nullif(l_tax, 0), 6) AS result FROM lineitem")
def _(t):
    """Postfix tokens that all lines share, as one expression: -(quantity + price) * (1 - discount) / tax."""
    tokens = [(0x1F, c("l_quantity")), (0x1F, c("l_extendedprice")), (0x07,), (0x12,), (0x0D,), (0x20, 1), (0x1F, c("l_discount")), (0x08,), (0x09,), (0x1F, c("l_tax")), (0x0A,)]
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(E.plain(tokens), 6).alias("result"))


@query(
    "sheet_eval",
    "WITH RECURSIVE v AS (SELECT p_partkey AS cell, p_retailprice AS value, 0 AS level FROM part WHERE p_partkey = 0 UNION ALL SELECT p.p_partkey, p.p_retailprice + 0.5 * v.value, v.level + 1 FROM v JOIN part p ON p.p_partkey // 2 = v.cell AND p.p_partkey > 0) SELECT cell, round(value, 3) AS value, level FROM v",
)
def _(t):
    """Each part's cell is its price plus half of the cell of half its number, by rounds of joins."""
    parts = t("part")
    edges = parts.where("p_partkey > 0").select(c("p_partkey").alias("cell"), F.floor(c("p_partkey") / 2).alias("needs"), F.lit(0.5).alias("weight"))
    values = E.evaluate_levels(parts.select(c("p_partkey").alias("cell"), c("p_retailprice").alias("base")), edges)
    return values.select("cell", F.round("value", 3).alias("value"), "level")


# Binary scalars.
_N = "(l_partkey * 31 + l_linenumber)"


@query("varint_s_len", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_N} < 64 THEN 1 WHEN {_N} < 8192 THEN 2 END AS n_bytes, CASE WHEN {_N} < 8192 THEN {_N} END AS back FROM lineitem")
def _(t):
    code = B.s_encode(c("l_partkey") * 31 + c("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.length(code).alias("n_bytes"), B.s_varint(code, 0)["value"].alias("back"))


@query("varint_x_len", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_N} < 128 THEN 1 WHEN {_N} < 16384 THEN 2 ELSE 4 END AS n_bytes, {_N} AS back FROM lineitem")
def _(t):
    code = B.x_encode(c("l_partkey") * 31 + c("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.length(code).alias("n_bytes"), B.x_varint(code, 0)["value"].alias("back"))


@query("uint_roundtrip", "SELECT o_orderkey, o_custkey % 256 AS u8, o_custkey % 65536 AS u16, o_orderkey * 1009 AS u32 FROM orders")
def _(t):
    """Integers of one, two and four bytes; those beyond 32 bits are two words, the low one first."""
    whole = c("o_orderkey") * 1009
    words = B.little(whole.bitwiseAND(0xFFFFFFFF), 4), B.little(F.shiftrightunsigned(whole, 32), 4)
    code = F.concat(B.little(c("o_custkey") % 256, 1), B.little(c("o_custkey") % 65536, 2), *words)
    u32 = F.shiftleft(B.uint(code, 7, 4), 32) + B.uint(code, 3, 4)
    return t("orders").select("o_orderkey", B.uint(code, 0, 1).alias("u8"), B.uint(code, 1, 2).alias("u16"), u32.alias("u32"))


@query("length_cm", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_partkey * 2.54::DOUBLE / 1440, 6) AS cm, round(l_partkey / 20.0::DOUBLE, 4) AS pt FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(B.length_cm(c("l_partkey")), 6).alias("cm"), F.round(B.size_pt(c("l_partkey")), 4).alias("pt"))


@query(
    "checksum_uid",
    """
    WITH RECURSIVE b AS (
      SELECT o_orderkey, half, list_transform(range(6), lambda k: ((CASE (2 * k + half) // 4 WHEN 0 THEN 268435511 WHEN 1 THEN 268435565 ELSE 268435456 + o_orderkey END) >> CAST(8 * ((2 * k + half) % 4) AS INTEGER)) & 255) AS bytes FROM orders, (SELECT unnest([0, 1]) AS half)
    ), crc AS (
      SELECT o_orderkey, half, bytes, 0 AS step, CAST(0 AS BIGINT) AS v FROM b
      UNION ALL
      SELECT o_orderkey, half, bytes, step + 1, ((CASE WHEN (x & 32768) <> 0 THEN xor(x << 1, 4129) ELSE x << 1 END) & 65535) FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(v, CAST(bytes[step // 8 + 1] AS BIGINT) << 8) ELSE v END AS x FROM crc WHERE step < 48)
    )
    SELECT o_orderkey, CAST(sum(v * CASE half WHEN 0 THEN 1 ELSE 65536 END) AS BIGINT) AS uid4 FROM crc WHERE step = 48 GROUP BY o_orderkey
    """,
)
def _(t):
    """The fourth identifier for headers whose third is made from order keys."""
    return t("orders").select("o_orderkey", B.uid_checksum(F.lit(0x10000037).cast("long"), F.lit(0x1000006D).cast("long"), c("o_orderkey") + 0x10000000).alias("uid4"))


@query("bit_unpack", "SELECT p_partkey, CAST(p_size % 4 AS BIGINT) AS p0, CAST(p_size // 4 % 4 AS BIGINT) AS p1, CAST(p_partkey % 4 AS BIGINT) AS p2 FROM part")
def _(t):
    packed = B.pack_bits([c("p_size") % 4, F.floor(c("p_size") / 4) % 4, c("p_partkey") % 4], 2)
    bits = B.unpack_bits(packed, 2, 3)
    return t("part").select("p_partkey", *[F.get(bits, k).alias(f"p{k}") for k in range(3)])


# Text.

@query("para_split", f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS para_no, unnest(p) AS para FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS p FROM documents)")
def _(t):
    return R.split_paragraphs(t("documents").select("doc_id", "text"), T.paragraphs(c("text"), "\n")).select("doc_id", "para_no", "para")


@query("ctrl_render", "SELECT doc_id, length(translate(text, chr(10), chr(9))) AS n, md5(translate(text, chr(10), chr(9))) AS hash FROM documents")
def _(t):
    shown = T.render_text(c("text"))
    return t("documents").select("doc_id", F.length(shown).cast("long").alias("n"), F.md5(shown).alias("hash"))


@query("printable", "SELECT page_id, md5(regexp_replace(html, '[^\\x20-\\x7e]', '.', 'g')) AS hash FROM pages")
def _(t):
    return t("pages").select("page_id", F.md5(T.printable(c("html"))).alias("hash"))


@query("ascii_render", "SELECT doc_id, md5(regexp_replace(replace(text, chr(160), ' '), '[^\\x00-\\x7f]', '?', 'g')) AS hash FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.ascii_only(c("text"))).alias("hash"))


@query("html_render", "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ')) AS hash FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.render_html(c("text"))).alias("hash"))


@query("ascii_html", None)
def _(t):
    return t("pages").select("page_id", F.md5(T.ascii_html(c("html"))).alias("hash"))


@query("css_name", "SELECT p_partkey, regexp_replace(p_name, '[\\x00-\\x20\\x7f]', '_', 'g') AS class FROM part")
def _(t):
    return t("part").select("p_partkey", T.css_name(c("p_name")).alias("class"))


@query("heading_level", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 6 THEN p_size END AS level, CASE WHEN p_size < 8 THEN 1 WHEN p_size < 10 THEN 2 WHEN p_size < 13 THEN 3 WHEN p_size < 17 THEN 4 WHEN p_size < 24 THEN 5 WHEN p_size < 36 THEN 6 ELSE 7 END AS bucket FROM part")
def _(t):
    """Heading levels and HTML font sizes; names are those of headings of p_size, of which only one-digit ones count."""
    name = F.concat(F.lit("My Heading "), F.when(c("p_size") < 10, c("p_size").cast("string")).otherwise("x"))
    return t("part").select("p_partkey", T.heading_level(name).alias("level"), T.font_bucket(c("p_size")).alias("bucket"))


@query("text_compare", "SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS result FROM part")
def _(t):
    return t("part").select("p_partkey", T.compare(c("p_name"), c("p_type")).alias("result"))


@query("encode_ucs2", "SELECT doc_id, octet_length(encode(text)) AS utf8, 2 * length(text) AS ucs2 FROM documents")
def _(t):
    size = lambda charset: F.length(T.encode(c("text"), charset)).cast("long")
    return t("documents").select("doc_id", size("UTF8").alias("utf8"), size("UCS2").alias("ucs2"))


# Layout patterns.
@query(
    "run_merge",
    "WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM m) "
    "SELECT user_id, CAST(run_no AS BIGINT) AS run_no, event_type, count(*) AS n_rows, min(ts) AS \"first\", max(ts) AS \"last\" FROM r GROUP BY 1, 2, 3",
)
def _(t):
    return R.merge_runs(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query(
    "run_clip",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, e - l_quantity AS \"start\", greatest(0, least(e, 100) - (e - l_quantity)) AS clipped FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)",
)
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").withColumn("limit", F.lit(100.0))
    return R.clip_runs(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", "limit").drop("limit", "l_quantity")


@query(
    "run_pool",
    "WITH o AS (SELECT *, o_orderkey % 5 AS n, sum(o_orderkey % 5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto FROM orders), "
    "e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events) "
    "SELECT e.event_id, o.o_orderkey FROM e JOIN o ON o.o_custkey = e.user_id AND e.no <= upto AND e.no > upto - n",
)
def _(t):
    """Events of a user dealt in order to the orders of the customer of that number, a few to each."""
    owners = t("orders").select(c("o_custkey").alias("user_id"), "o_orderkey", (c("o_orderkey") % 5).alias("n"))
    return R.consume_pool(owners, t("events").select("event_id", "user_id"), "user_id", "o_orderkey", "n", "event_id").select("event_id", "o_orderkey")


_DICT = "(SELECT p_brand, p_type, p_size, min(p_partkey) AS \"first\", count(*) AS uses, row_number() OVER (ORDER BY min(p_partkey)) AS code FROM part GROUP BY 1, 2, 3)"


@query("layout_dictionary", f"SELECT * FROM {_DICT}")
def _(t):
    return R.dictionary(t("part"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("layout_encode", f"SELECT p.p_partkey, d.code FROM part p JOIN {_DICT} d USING (p_brand, p_type, p_size)")
def _(t):
    parts = t("part").select("p_partkey", "p_brand", "p_type", "p_size")
    return R.encode_with(parts, R.dictionary(parts, ["p_brand", "p_type", "p_size"], "p_partkey"), ["p_brand", "p_type", "p_size"])


@query("reloc_resolve", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o.o_custkey AS target_offset FROM lineitem JOIN orders o ON o_orderkey = l_orderkey")
def _(t):
    refs = t("lineitem").select(c("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_extendedprice")
    return R.resolve_references(refs, t("orders").select(c("o_orderkey").alias("k"), c("o_custkey").alias("at")), "k", "at")[0].withColumnRenamed("k", "l_orderkey")


@query("reloc_unresolved", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return R.resolve_references(t("customer").select(c("c_custkey").alias("k")), t("orders").select(c("o_custkey").alias("k"), "o_orderkey"), "k", "o_orderkey")[1].select(c("k").alias("c_custkey"))


@query("part_offsets", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT l_orderkey, l_partkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3)")
def _(t):
    parts = t("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    return R.part_offsets(parts, ["l_orderkey", "l_partkey"], "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "base")


@query("style_lookup", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Heading 1' WHEN 2 THEN 'Heading 2' ELSE 'Bulleted' END AS style FROM part")
def _(t):
    """Names by style number: 0, 255, 254, 253."""
    number = F.when(c("p_size") % 4 == 0, 0).otherwise(256 - c("p_size") % 4)
    out = F.lit(None).cast("string")
    for k, name in R.style_numbers(["Heading 1", "Heading 2", "Bulleted"]):
        out = F.when(number == k, name).otherwise(out)
    return t("part").select("p_partkey", out.alias("style"))


@query("css_difference", "SELECT p_partkey, CASE WHEN p_size <> 10 THEN 'font-size:' || p_size || ';' ELSE '' END || CASE WHEN p_brand <> 'Brand#1' THEN 'font-family:' || p_brand || ';' ELSE '' END AS css FROM part")
def _(t):
    css = K.css_difference({"font-size": c("p_size"), "font-family": c("p_brand")}, {"font-size": F.lit(10), "font-family": F.lit("Brand#1")})
    return t("part").select("p_partkey", css.alias("css"))


PALETTE = [(0.0, 0.0, 0.0), (0.1, 0.0, 0.0), (0.0, 0.1, 0.0), (0.0, 0.0, 0.1), (-0.1, -0.1, -0.1), (0.1, 0.1, 0.1)]


@query(
    "palette_nearest",
    "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS r, CAST(embedding[2] AS DOUBLE) AS g, CAST(embedding[3] AS DOUBLE) AS b FROM embeddings), "
    f"q AS (SELECT * FROM (VALUES {', '.join(f'({k}, {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)' for k, (r, g, b) in enumerate(PALETTE))}) v(k, x, y, z)) "
    "SELECT vec_id, k AS colour FROM p, q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z), k) = 1",
)
def _(t):
    pixels = t("embeddings").select("vec_id", *[F.get("embedding", k).cast("double").alias(n) for k, n in enumerate(("red", "green", "blue"))])
    return R.nearest_colour(pixels, PALETTE).select("vec_id", "colour")


@query("rgb_luma", "SELECT vec_id, round(0.212671::DOUBLE * embedding[1] + 0.715160::DOUBLE * embedding[2] + 0.072169::DOUBLE * embedding[3], 6) AS luma FROM embeddings")
def _(t):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t("embeddings").select("vec_id", F.round(B.luma(at(0), at(1), at(2)), 6).alias("luma"))


_CHARS = "(SELECT doc_id, i, text[i] AS ch FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents))"


@query(
    "rle8_runs",
    f"WITH m AS (SELECT doc_id, i, ch, CASE WHEN lag(ch) OVER (PARTITION BY doc_id ORDER BY i) = ch THEN 0 ELSE 1 END AS s FROM {_CHARS}), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m), "
    "n AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2) SELECT doc_id, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_chars, max(n) AS longest FROM n GROUP BY doc_id",
)
def _(t):
    runs = R.run_summary(c("text"))
    docs = t("documents").where("length(text) > 0").select("doc_id", runs.alias("r"))
    return docs.select("doc_id", *[c(f"r.{k}").cast("long").alias(n) for k, n in (("n_runs", "n_runs"), ("n_items", "n_chars"), ("longest", "longest"))])


@query("rle8_size", None)
def _(t):
    """Bytes of the run-length coding of each part name repeated, and whether it beats the plain bytes."""
    parts = t("part").select("p_partkey", F.concat(F.repeat(F.left("p_brand", F.lit(1)), c("p_size")), "p_name").alias("s"))
    sizes = R.rle8_size(R.run_lengths(parts, ["p_partkey"], F.split("s", "")), ["p_partkey"])
    return parts.join(sizes, "p_partkey").select("p_partkey", F.length("s").alias("plain"), "encoded", (c("encoded") < F.length("s")).alias("smaller"))


@query(
    "xref_link",
    "WITH d AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<h1>([A-Za-z]+)', 1))) AS name FROM pages), f AS (SELECT name, min(page_id) AS \"first\" FROM d GROUP BY 1), "
    "u AS (SELECT page_id, name, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, '<p>([A-Za-z]+)', 1)) AS name FROM pages) GROUP BY 1, 2) SELECT page_id, name, \"first\", uses FROM u LEFT JOIN f USING (name)",
)
def _(t):
    return R.link_names(t("pages").select("page_id", "html"), "page_id", "html", "<h1>([A-Za-z]+)", "<p>([A-Za-z]+)")


# Sinks: documents from their turns.
#: Turns of the conversations and a planted one, whose paragraphs and styles are null.
_TURNS = "(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, NULL, 'a<b'), (-1, 1, 'user', NULL), (-1, 2, NULL, NULL)) v)"


def _turns(t) -> DataFrame:
    own = t("conversations").select("conv_id", c("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(own.sparkSession.createDataFrame([(-1, 0, None, "a<b"), (-1, 1, "user", None), (-1, 2, None, None)], "conv_id long, turn long, role string, text string"))


_TURN = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BODY = lambda before, after: f"string_agg({before} || replace({_TURN}, chr(10), ' ') || {after}, '' ORDER BY turn)"


@query("doc_to_text", f"SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN '*   ' ELSE '' END || replace(coalesce(text, ''), chr(10), chr(9)) || chr(10), '' ORDER BY turn)) AS hash FROM {_TURNS} GROUP BY conv_id")
def _(t):
    return K.to_text(_turns(t), ["conv_id"], "turn", "text", F.when(c("role") == "user", F.lit("*"))).select("conv_id", F.md5("body").alias("hash"))


@query("doc_to_html4", f"SELECT conv_id, md5('<HTML><BODY>' || chr(10) || {_BODY(chr(39) + '<P>' + chr(39), chr(39) + '</P>' + chr(39) + ' || chr(10)')} || '</BODY></HTML>' || chr(10)) AS hash FROM {_TURNS} GROUP BY conv_id")
def _(t):
    return K.to_html4(_turns(t), ["conv_id"], "turn", "text").select("conv_id", F.md5("body").alias("hash"))


@query("doc_to_xhtml", f"""SELECT conv_id, md5('<html xmlns="http://www.w3.org/1999/xhtml"><body>' || chr(10) || {_BODY("'<p class=" + chr(34) + "style-' || coalesce(role, 'Normal') || '" + chr(34) + ">'", "'</p>' || chr(10)")} || '</body></html>' || chr(10)) AS hash FROM {_TURNS} GROUP BY conv_id""")
def _(t):
    return K.to_xhtml(_turns(t), ["conv_id"], "turn", c("role"), "text").select("conv_id", F.md5("body").alias("hash"))


@query("doc_to_html5", f"""SELECT conv_id, md5('<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || {_BODY("CASE WHEN role = 'user' THEN '<h2>' ELSE '<p>' END", "CASE WHEN role = 'user' THEN '</h2>' ELSE '</p>' END || chr(10)")} || '</body></html>' || chr(10)) AS hash FROM {_TURNS} GROUP BY conv_id""")
def _(t):
    style = F.when(c("role") == "user", "Heading 2").otherwise("Body")
    return K.to_html5(_turns(t), ["conv_id"], "turn", style, "text").select("conv_id", F.md5("body").alias("hash"))


from . import more_queries as _more  # noqa: E402, F401  registers its queries here
from . import sheet_queries as _sheets  # noqa: E402, F401
from . import document_queries as _documents  # noqa: E402, F401
