"""Formulas as node rows and as text."""

import random

import pytest
from pyspark.sql import functions as F

from docsheet.plans import nodes as N


def postfix(rng, depth):
    """A random formula as tokens."""
    if depth == 0 or rng.random() < 0.2:
        return [rng.choice([(0x20, str(rng.randrange(99)), None), (0x1F, "2.5", None), (0x26, 'a "b" (c', None), (0x27, "$B$7", None), (0x25, "rate", None)])]
    kind = rng.choice(["binary", "binary", "unary", "call", "bracket", "many"])
    if kind == "bracket":
        return [*postfix(rng, depth - 1), (0x12, None, None)]
    if kind == "unary":
        return [*postfix(rng, depth - 1), (rng.choice([0x0C, 0x0D, 0x0E]), None, None)]
    if kind == "binary":
        return [*postfix(rng, depth - 1), *postfix(rng, depth - 1), (rng.choice([m for m in N.RANKS if m not in N.UNARY]), None, None)]
    if kind == "call":
        m, n = rng.choice([(0x34, 3), (0x77, 0), (0x6A, 1), (0x4C, 3)])
        return [t for _ in range(n) for t in postfix(rng, depth - 1)] + [(m, None, None)]
    n = rng.randrange(1, 4)
    return [(0x28, "A1:B$9", None), *(t for _ in range(n - 1) for t in postfix(rng, depth - 1)), (0x98, None, n)]


def table(spark, formulas):
    return spark.createDataFrame([(i, f) for i, f in enumerate(formulas)], f"id int, tokens array<{N.TOKEN}>")


def test_text_and_back(spark):
    rng = random.Random(2)
    made = table(spark, [postfix(rng, 4) for _ in range(300)]).select("id", N.normal(F.col("tokens")).alias("n"), N.infix(F.col("tokens")).alias("text")).withColumn("back", N.parse(F.col("text")))
    rows = made.collect()
    assert [(r["id"], r["text"]) for r in rows if r["back"] != r["n"]] == [] and len(rows) == 300


def test_fewest_brackets(spark):
    n = lambda x: (0x20, str(x), None)
    op = lambda m: (m, None, None)
    cases = {
        "1+2*3": [n(1), n(2), n(3), op(0x09), op(0x07)], "(1+2)*3": [n(1), n(2), op(0x07), n(3), op(0x09)], "1-(2-3)": [n(1), n(2), n(3), op(0x08), op(0x08)], "1-2-3": [n(1), n(2), op(0x08), n(3), op(0x08)],
        "-2^2": [n(2), n(2), op(0x0B), op(0x0D)], "(-2)^2": [n(2), op(0x0D), n(2), op(0x0B)], "NOT 1=2 AND 3<4": [n(1), n(2), op(0x06), op(0x0E), n(3), n(4), op(0x01), op(0x0F)], "PI()": [op(0x77)], "--1": [n(1), op(0x0D), op(0x0D)],
    }
    got = [r[0] for r in table(spark, list(cases.values())).orderBy("id").select(N.infix(F.col("tokens"))).collect()]
    assert got == list(cases)


@pytest.mark.parametrize("text", ["1+", "(1", "1)", "1 2", "SUM(1,)", "IF(1,2)", "NONE(1)", "1,2", "?", "", "+", "A1:"])
def test_no_formula(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(N.parse(F.col("t"))).first()[0] is None


def test_nodes_are_the_tree(spark):
    rng = random.Random(9)
    formulas = [postfix(rng, 4) for _ in range(60)] + [[(0x07, None, None)], [(0x20, "1", None)] * 2, []]
    got = {}
    for r in N.nodes(table(spark, formulas), ["id"], "tokens").collect():
        got.setdefault(r["id"], {})[r["node"]] = (r["marker"], r["start"], r["parent"], r["ordinal"], r["depth"])
    counts = {m: n for m, (_, n) in N.CALLS.items()} | dict.fromkeys(N.RANKS, 2) | dict.fromkeys(N.UNARY, 1) | dict.fromkeys((0x1F, 0x20, 0x25, 0x26, 0x27, 0x28), 0)
    for i, f in enumerate(formulas[:60]):
        stack, want = [], {}
        own = [t for t in f if t[0] != 0x12]
        for k, (m, _, n) in enumerate(own):
            take = counts[m] if counts[m] >= 0 else n
            children = stack[len(stack) - take :] if take else []
            del stack[len(stack) - take :]
            for o, c in enumerate(children):
                want[c][2:4] = [k, o]
            want[k] = [m, want[children[0]][1] if children else k, None, None, 0]
            stack.append(k)
        for k in reversed(range(len(own))):
            want[k][4] = want[want[k][2]][4] + 1 if want[k][2] is not None else 0
        assert got[i] == {k: tuple(v) for k, v in want.items()}, f
    assert set(got) == set(range(60))
