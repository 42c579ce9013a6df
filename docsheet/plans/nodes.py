"""Formulas as trees and as text: postfix tokens to node rows, to infix text with the fewest brackets, and back.

Everything is a fold over a row's own array. Brackets of the tokens (0x12) and separators hold nothing that the order of tokens
doesn't say; without them a formula is in normal form, and ``parse(infix(tokens))`` is the normal form of any formula that leaves one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import BLOCK, INTEGER, MARKERS, NUMBER, REFERENCE, STRING, VARARG_BLOCK, VARIABLE
from .workbook import LISTED, PLACED, SEPARATORS

TOKEN = "struct<marker:int,text:string,n:int>"
#: Ranks of operators, the loosest first: what ranks lower stands in brackets inside.
RANKS = {0x10: 1, 0x0F: 2, 0x0E: 3, **dict.fromkeys((0x01, 0x02, 0x03, 0x04, 0x05, 0x06), 4), 0x11: 5, 0x07: 6, 0x08: 6, 0x09: 7, 0x0A: 7, 0x0C: 8, 0x0D: 8, 0x0B: 9}
ATOM = 10
SIGNS = {0x0C: "+", 0x0D: "-", 0x0E: "NOT ", 0x0F: " AND ", 0x10: " OR "}
CALLS = {m: x for m, x in {**MARKERS, **PLACED, **LISTED}.items() if m not in RANKS and m != 0x12}
UNARY = (0x0C, 0x0D, 0x0E)


def token(marker: Column | int, text: Column | str | None = None, n: int | None = None) -> Column:
    """A token: numbers, names, references and blocks carry their ``text``, functions of any number of operands their number ``n``."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(marker).cast("int").alias("marker"), c(text).cast("string").alias("text"), F.lit(n).cast("int").alias("n"))


def normal(tokens: Column) -> Column:
    """Without brackets and separators; functions with a fixed number of operands carry no number."""
    counted = [m for m, (_, n) in CALLS.items() if n < 0]
    kept = F.filter(tokens, lambda t: ~t["marker"].isin(0x12, *SEPARATORS))
    return F.transform(kept, lambda t: t.withField("n", F.when(t["marker"].isin(counted), t["n"])))


def operands(token: Column) -> Column:
    """How many values a token takes; null for one that there is none of."""
    out = F.when(token["marker"].isin(NUMBER, INTEGER, VARIABLE, STRING, REFERENCE, BLOCK, VARARG_BLOCK), 0)
    for n in (0, 1, 2, 3, 4):
        fixed = [m for m, (_, k) in {**MARKERS, **PLACED, **LISTED}.items() if k == n]
        out = out.when(token["marker"].isin(fixed), n)
    return out.otherwise(token["n"])


def nodes(formulas: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """A row for each token in normal form: (by, node, marker, text, n_operands, start, parent, ordinal, depth). A node's subtree are the tokens from ``start`` to itself; the root has no parent; ordinals count from 0.

    The starts come from one fold over the tokens; what covers a token are its ancestors, the first of them its parent. A formula that doesn't leave exactly one value has no rows.
    """
    state = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("ok"))

    def step(s: Column, t: Column) -> Column:
        n, size, i = operands(t), F.size(s["stack"]), F.size(s["starts"])
        fits = s["ok"] & n.isNotNull() & (n >= 0) & (size >= n)
        start = F.when(n > 0, F.get(s["stack"], size - n)).otherwise(i)
        kept = F.slice(s["stack"], F.lit(1), F.greatest(size - F.coalesce(n, F.lit(0)), F.lit(0)))
        return F.struct(F.when(fits, F.concat(kept, F.array(start))).otherwise(s["stack"]).alias("stack"), F.concat(s["starts"], F.array(F.coalesce(start, i))).alias("starts"), F.coalesce(fits, F.lit(False)).alias("ok"))

    folded = formulas.select(*by, normal(F.col(tokens)).alias("_t")).withColumn("_s", F.aggregate("_t", state, step)).where("_s.ok and size(_s.stack) = 1")
    starts = F.col("_s.starts")
    each = folded.select(*by, starts.alias("_starts"), F.posexplode("_t").alias("node", "_k"))
    above = F.filter(F.sequence(F.lit(0), F.size("_starts") - 1), lambda j: (j > F.col("node")) & (F.get("_starts", j) <= F.col("node")))
    placed = each.select(*by, "node", "_k.marker", "_k.text", operands(F.col("_k")).alias("n_operands"), F.get("_starts", F.col("node")).alias("start"), F.array_min(above).alias("parent"), F.size(above).alias("depth"), "_starts")
    # a parent's operands lie side by side: the last ends before it, each other where the next begins
    first = F.get("_starts", F.col("parent"))
    sibling = lambda j: (j < F.col("node")) & (j >= first) & (F.size(F.filter(F.sequence(j + 1, F.col("parent") - 1), lambda k: F.get("_starts", k) <= j)) == 0)
    ordinal = F.when(F.col("node") == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.col("node") - 1, F.lit(0))), sibling)))
    return placed.select(*by, "node", "marker", "text", "n_operands", "start", "parent", F.when(F.col("parent").isNotNull(), ordinal).alias("ordinal"), "depth")


def infix(tokens: Column) -> Column:
    """The text of a formula: operators between their operands, brackets only where ranks ask for them; null if it doesn't leave exactly one value.

    Operators of one rank go from left to right. Texts are quoted, quotes in them doubled; a negative number is a sign and a number.
    """
    none = F.array().cast("array<struct<t:string,r:int>>")
    made = lambda text, rank: F.struct(text.alias("t"), F.lit(rank).alias("r"))

    def step(stack: Column, k: Column) -> Column:
        marker, size = k["marker"], F.size(stack)
        drop = lambda n: F.slice(stack, F.lit(1), F.greatest(size - n, F.lit(0)))
        arg = lambda n, i: F.get(stack, size - n + i)
        inside = lambda x, rank: F.when(x["r"] < rank, F.concat(F.lit("("), x["t"], F.lit(")"))).otherwise(x["t"])
        quoted = F.concat(F.lit('"'), F.replace(k["text"], F.lit('"'), F.lit('""')), F.lit('"'))
        out = F.when(marker == STRING, F.concat(stack, F.array(made(quoted, ATOM)))).when(marker.isin(NUMBER, INTEGER, VARIABLE, REFERENCE, BLOCK, VARARG_BLOCK), F.concat(stack, F.array(made(k["text"], ATOM))))
        for m, rank in RANKS.items():
            sign = SIGNS.get(m, MARKERS[m][0])
            if m in UNARY:
                out = out.when((marker == m) & (size >= 1), F.concat(drop(1), F.array(made(F.concat(F.lit(sign), inside(arg(1, 0), rank)), rank))))
            else:
                out = out.when((marker == m) & (size >= 2), F.concat(drop(2), F.array(made(F.concat(inside(arg(2, 0), rank), F.lit(sign), inside(arg(2, 1), rank + 1)), rank))))
        n = operands(k)
        name = F.element_at(F.create_map(*[F.lit(x) for m, (called, _) in CALLS.items() for x in (m, called)]), marker)
        args = F.array_join(F.transform(F.slice(stack, F.greatest(size - n, F.lit(0)) + 1, F.greatest(n, F.lit(0))), lambda x: x["t"]), ",")
        called = F.concat(name, F.lit("("), args, F.lit(")"))
        return out.when((n >= 0) & (size >= n), F.concat(drop(n), F.array(made(called, ATOM))))

    return F.aggregate(normal(tokens), none, step, lambda s: F.when(F.size(s) == 1, F.get(s, 0)["t"]))


_NUMBER, _PLACE = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", r"\$?[A-Z]{1,3}\$?[0-9]+"
_LEXEME = rf'"(?:[^"]|"")*"|{_NUMBER}|{_PLACE}(?::{_PLACE})?|[A-Za-z_][A-Za-z_0-9]*\(?|<=|>=|<>|[-+*/^&<>=(),]'


def parse(text: Column) -> Column:
    """The tokens of infix text in normal form: one fold over its lexemes with the operators that still wait; null for text that is no formula by its brackets.

    Numbers with a point or an exponent are floating-point numbers, others integers; names without brackets are variables, A1 and A1:B2 references and blocks.
    """
    item, waiting = TOKEN, "struct<marker:int,rank:int,n:int>"
    state = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.array().cast(f"array<{waiting}>").alias("ops"), F.lit(False).alias("after"), F.lit(True).alias("ok"))
    by_name = F.create_map(*[F.lit(x) for m, (name, _) in CALLS.items() for x in (name, m)])
    fixed = F.create_map(*[F.lit(x) for m, (_, n) in CALLS.items() for x in (m, n)])
    binary = F.create_map(*[F.lit(x) for m in RANKS if m not in UNARY for x in (SIGNS.get(m, MARKERS[m][0]).strip(), m)])
    unary = F.create_map(*[F.lit(x) for m in UNARY for x in (SIGNS[m].strip(), m)])
    ranks = F.create_map(*[F.lit(x) for x in sum(RANKS.items(), ())])
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def popped(s: Column, least: Column) -> Column:
        """(out, ops) after the operators at the end that rank ``least`` and more; open brackets rank 0."""
        held = F.size(F.filter(s["ops"], lambda o: o["rank"] < least))  # between brackets ranks rise, so those are at the front but for a sign before a sign
        last = F.array_max(F.transform(s["ops"], lambda o, i: F.when(o["rank"] < least, i + 1).otherwise(0)))
        keep = F.coalesce(F.greatest(last, F.lit(0)), held)
        moved = F.transform(F.reverse(F.slice(s["ops"], keep + 1, F.greatest(F.size(s["ops"]) - keep, F.lit(0)))), lambda o: F.struct(o["marker"].alias("marker"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("n")))
        return F.struct(F.concat(s["out"], moved).alias("out"), F.slice(s["ops"], F.lit(1), keep).alias("ops"))

    def after(s: Column, out: Column, ops: Column, operand: bool, ok: Column) -> Column:
        return F.struct(out.cast(f"array<{item}>").alias("out"), ops.cast(f"array<{waiting}>").alias("ops"), F.lit(operand).alias("after"), F.coalesce(s["ok"] & ok, F.lit(False)).alias("ok"))

    op = lambda marker, rank, n=0: F.array(F.struct(marker.cast("int").alias("marker"), rank.cast("int").alias("rank"), F.lit(n).alias("n")))

    def step(s: Column, x: Column) -> Column:
        kind = lambda marker, shown=x: F.struct(F.lit(marker).alias("marker"), shown.alias("text"))
        leaf = F.when(x.startswith('"'), kind(STRING, F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))))
        leaf = leaf.when(x.rlike(rf"^{_PLACE}:{_PLACE}$"), kind(BLOCK)).when(x.rlike(rf"^{_PLACE}$"), kind(REFERENCE)).when(x.rlike("^[0-9]+$"), kind(INTEGER)).when(x.rlike("^[0-9]"), kind(NUMBER))
        leaf = leaf.when(x.rlike("^[A-Za-z_]") & ~x.endswith("(") & ~x.isin("AND", "OR", "NOT"), kind(VARIABLE))
        call = F.try_element_at(by_name, F.rtrim(x, F.lit("(")))
        prefix, between = F.when(~s["after"], F.try_element_at(unary, x)), F.when(s["after"], F.try_element_at(binary, x))
        value = after(s, F.concat(s["out"], F.array(F.struct(leaf["marker"].alias("marker"), leaf["text"].alias("text"), F.lit(None).cast("int").alias("n")))), s["ops"], True, ~s["after"])
        opened = after(s, s["out"], F.concat(s["ops"], op(F.when(x == "(", -1).otherwise(call), F.lit(0))), False, ~s["after"] & ((x == "(") | call.isNotNull()))
        signed = after(s, s["out"], F.concat(s["ops"], op(prefix, F.element_at(ranks, prefix))), False, F.lit(True))
        infixed = once(popped(s, F.element_at(ranks, between)), lambda p: after(s, p["out"], F.concat(p["ops"], op(between, F.element_at(ranks, between))), False, F.lit(True)))

        def closing(p: Column) -> Column:
            top, rest = F.get(p["ops"], F.size(p["ops"]) - 1), F.slice(p["ops"], F.lit(1), F.greatest(F.size(p["ops"]) - 1, F.lit(0)))
            count = F.when(s["after"], top["n"] + 1).otherwise(top["n"])
            wanted = F.try_element_at(fixed, top["marker"])
            made = F.struct(top["marker"].alias("marker"), F.lit(None).cast("string").alias("text"), F.when(wanted < 0, count).cast("int").alias("n"))
            out = F.when(top["marker"] == -1, p["out"]).otherwise(F.concat(p["out"], F.array(made)))
            comma = after(s, p["out"], F.concat(rest, F.array(F.struct(top["marker"].alias("marker"), F.lit(0).alias("rank"), (top["n"] + 1).alias("n")))), False, s["after"] & top.isNotNull() & (top["marker"] != -1))
            good = top.isNotNull() & F.when(top["marker"] == -1, s["after"]).otherwise((s["after"] | (top["n"] == 0)) & ((wanted < 0) | (wanted == count)))
            return F.when(x == ",", comma).otherwise(after(s, out, rest, True, good))

        closed = once(popped(s, F.lit(1)), closing)
        return F.when(leaf["marker"].isNotNull(), value).when(x.endswith("("), opened).when(x.isin(")", ","), closed).when(prefix.isNotNull(), signed).when(between.isNotNull(), infixed).otherwise(after(s, s["out"], s["ops"], False, F.lit(False)))

    done = lambda s: once(popped(s, F.lit(1)), lambda p: F.when(s["ok"] & s["after"] & (F.size(p["ops"]) == 0), p["out"]))
    lexemes = F.regexp_extract_all(text, F.lit(_LEXEME), F.lit(0))
    whole = F.trim(F.regexp_replace(text, _LEXEME, "")) == ""
    return F.when(whole, F.aggregate(lexemes, state, step, done))
