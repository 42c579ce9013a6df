"""Runs, styles, dictionaries and references: the relational patterns of document layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import scanned


def merge_runs(runs: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adjacent rows of a group with equal ``same`` columns become one: the columns of ``by`` and ``same``, run_no from 1, n_rows, and the first and last of ``order[0]``. Nulls equal nulls."""
    value = F.struct(*same)
    seen = scanned(runs, by, order, previous={"_before": value})
    starts = F.when(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(value), 1).otherwise(0)
    marked = scanned(seen, by, order, sums={"run_no": starts.cast("long")})
    return marked.groupBy(*by, "run_no", *same).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def clip_runs(runs: DataFrame, by: list[str], order: list[str], length: str, limit: str) -> DataFrame:
    """Adds ``start`` and ``clipped``: runs laid end to end, cut where their group's ``limit`` ends."""
    runs = scanned(runs, by, order, sums={"_end": F.col(length)})
    end = F.col("_end")
    start = end - F.col(length)
    return runs.withColumn("start", start).withColumn("clipped", F.greatest(F.lit(0), F.least(end, F.col(limit)) - start)).drop("_end")


def split_paragraphs(docs: DataFrame, text: Column) -> DataFrame:
    """One row per paragraph of an array column: para_no from 0 and para."""
    return docs.select("*", F.posexplode(text).alias("para_no", "para"))


def consume_pool(owners: DataFrame, pool: DataFrame, by: str, order: str, count: str, pool_order: str) -> DataFrame:
    """Deals the rows of ``pool`` in order to owners that take ``count`` rows each: pool rows with the ``order`` of their owner.

    Both sides are numbered per ``by`` and go through one sort of their union, in which a pool row takes the last owner that starts at or before it: no pair is formed, and groups may be of any size.
    """
    upto = scanned(owners.select(by, order, count), [by], [order], sums={"_to": F.col(count)})
    taken = upto.select(F.col(by), "_to", F.col(order).alias("_owner"), F.col(count).alias("_n")).where("_n > 0")
    starts = taken.select(by, (F.col("_to") - F.col("_n") + 1).cast("long").alias("_no"), F.struct(F.col("_to").cast("long").alias("to"), "_owner").alias("_o"), F.lit(None).cast(pool.schema.simpleString()).alias("_p"))
    ranked = scanned(pool.select(by, F.col(pool_order).alias("_at"), F.struct(*pool.columns).alias("_p")), [by], ["_at"], sums={"_no": F.lit(1).cast("long")})
    numbered = ranked.select(by, "_no", F.lit(None).cast(starts.schema["_o"].dataType).alias("_o"), "_p")
    both = starts.unionByName(numbered).withColumn("_asks", F.col("_p").isNotNull())
    found = scanned(both, [by], ["_no", "_asks"], lasts={"_o": F.col("_o")}).where("_asks and _no <= _o.to")
    return found.select("_p.*", F.col("_o._owner").alias(order))


def dictionary(rows: DataFrame, values: list[str], order: str) -> DataFrame:
    """Distinct ``values`` with ``code`` numbered from 1 by first appearance in ``order``."""
    return numbered(rows.groupBy(*values).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("uses")), ["first", *values], "code")


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """Adds ``number`` from 1 in ``order``: rows are dealt by ranges and sorted there, and each range starts where the counts of those before it end (only these counts meet in one task)."""
    from ..sources.shared import written

    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).drop("_n")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn(number, (inside + F.col("_before")).cast("long")).drop("_range", "_before")


def encode_with(rows: DataFrame, codes: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with the ``code`` of their values in place of them."""
    on = [rows[v].eqNullSafe(codes[v]) for v in values]
    keep = [rows[c] for c in rows.columns if c not in values]
    return rows.join(codes, on).select(*keep, codes["code"])


def resolve_references(refs: DataFrame, targets: DataFrame, key: str, offset: str) -> tuple[DataFrame, DataFrame]:
    """(refs with ``target_offset``, that of the first target of their key; refs without any target)."""
    first = targets.groupBy(key).agg(F.min(offset).alias("target_offset"))
    return refs.join(first, key), refs.join(first, key, "left_anti")


def part_offsets(parts: DataFrame, by: list[str], order: str, length: str) -> DataFrame:
    """Adds ``base``: where each part begins when the parts of a group are joined."""
    return scanned(parts, by, [order], sums={"base": F.col(length)}).withColumn("base", F.col("base") - F.coalesce(F.col(length), F.lit(0)))


def fallback(rows: DataFrame, levels: list[tuple[DataFrame, str]], default: Column, value: str) -> DataFrame:
    """Adds ``value``: that of the first level with a row for its key, else ``default``. A level is (table of key and value with one row a key, key)."""
    found = []
    for k, (table, key) in enumerate(levels):
        rows = rows.join(table.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        found.append(f"_v{k}")
    return rows.withColumn(value, F.coalesce(*found, default)).drop(*found)


def style_by_number(rows: DataFrame, styles: DataFrame, by: list[str], number: str, fields: list[str]) -> DataFrame:
    """``rows`` with the ``fields`` of the style of their ``number``, else those of number 0 of the same document. A style table has one row for each document and number; null keys are equal."""
    own = styles.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(number).alias("_number"), F.struct(*fields).alias("_style"))
    same = lambda side: reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{side}.{f'_{b}'}")) for b in by], F.lit(True))
    met = rows.join(own.alias("own"), same("own") & (F.col(number) == F.col("own._number")), "left").join(own.where("_number = 0").alias("normal"), same("normal"), "left")
    return met.select(*[rows[c] for c in rows.columns if c not in fields], *[F.coalesce(F.col(f"own._style.{f}"), F.col(f"normal._style.{f}")).alias(f) for f in fields])


def style_by_name(rows: DataFrame, styles: DataFrame, by: list[str], name: str, number: str, order: str) -> DataFrame:
    """``rows`` with the ``number`` of the first style (by ``order``) of their ``name`` in the same document; null if there is none."""
    first = styles.groupBy(*by, name).agg(F.min_by(number, order).alias("_found")).select(*[F.col(c).alias(f"_{c}") for c in (*by, name)], "_found")
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.col(name) == F.col(f"_{name}"))
    return rows.join(first, same, "left").select(*[c for c in rows.columns if c != number], F.col("_found").alias(number))


def style_numbers(names: list[str]) -> list[tuple[int, str]]:
    """(number, name): 0 for the normal style, then 255, 254 and on in order."""
    return [(0, "Normal"), *((255 - k, n) for k, n in enumerate(names))]


def patched(own: Column, base: Column, fields: list[str]) -> Column:
    """A layout with those fields of ``own`` that aren't null, and those of ``base`` for the others; ``own`` may be null as a whole."""
    return F.struct(*[F.coalesce(own[f], base[f]).alias(f) for f in fields])


def line_defaults(lines: DataFrame, sheets: DataFrame, by: list[str], fields: list[str], layout: str = "layout") -> DataFrame:
    """``lines`` (rows or columns of a sheet, with a ``layout`` that may have null fields) patched over the layout of their sheet."""
    base = sheets.select(*by, F.col(layout).alias("_base"))
    return lines.join(base, by, "left").withColumn(layout, patched(F.col(layout), F.col("_base"), fields)).drop("_base")


def nearest_colour(pixels: DataFrame, palette: list[tuple[float, float, float]]) -> DataFrame:
    """Adds ``colour``: index of the palette entry (256 at most) at the least squared distance of (red, green, blue); of equals the first. The palette is part of the expression."""
    if len(palette) > 256:
        raise ValueError("a palette has 256 colours at most")
    distances = F.array(*[F.struct(((F.col("red") - r) * (F.col("red") - r) + (F.col("green") - g) * (F.col("green") - g) + (F.col("blue") - b) * (F.col("blue") - b)).alias("d"), F.lit(k).alias("k")) for k, (r, g, b) in enumerate(palette)])
    return pixels.withColumn("colour", F.array_min(distances)["k"])


def run_lengths(rows: DataFrame, by: list[str], items: Column) -> DataFrame:
    """(by, run_no, value, start, n) of the runs of equal values in an array column: gaps and islands inside each array, without a shuffle."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  the value is computed once, however often the body names it
    starts = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
    runs = once(items, lambda a: F.when(F.size(a) > 0, once(starts(a), lambda s: F.transform(s, lambda i, k: F.struct(F.get(a, i).alias("value"), i.alias("start"), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).alias("n"))))))
    return rows.select(*by, F.posexplode(runs).alias("run_no", "_r")).select(*by, "run_no", "_r.value", "_r.start", "_r.n")


def run_summary(text: Column) -> Column:
    """(n_runs, n_items, longest) of the runs of equal characters of a text, found by one pattern without a row for each."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return F.struct(F.size(runs).alias("n_runs"), F.length(text).alias("n_items"), F.array_max(F.transform(runs, lambda r: F.length(r))).alias("longest"))


def rle8_size(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, encoded): bytes of the run-length coding of byte runs: a run of two and more takes 2 bytes per 128, a stretch of single bytes one more byte per 128."""
    window = W.partitionBy(*by).orderBy("run_no")
    marked = runs.withColumn("single", F.col("n") == 1).withColumn("_new", F.coalesce((F.col("single") != F.lag("single").over(window)).cast("int"), F.lit(1)) + F.when(F.col("single"), 0).otherwise(1))
    stretch = marked.withColumn("_i", F.sum("_new").over(window.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy(*by, "_i", "single").agg(F.sum("n").alias("n"))
    cost = F.when(F.col("single"), F.col("n") + F.ceil(F.col("n") / 128)).otherwise(2 * F.ceil(F.col("n") / 128))
    return stretch.groupBy(*by).agg(F.sum(cost).cast("long").alias("encoded"))


def style_number(name: Column, names: list[str]) -> Column:
    """The number of the first style of this name; null if there is none."""
    out = F.lit(None).cast("int")
    for k, n in reversed(style_numbers(names)):
        out = F.when(name == n, k).otherwise(out)
    return out


def from_tail(cells: DataFrame, formulas: DataFrame, by: list[str], number: str, reference: str) -> DataFrame:
    """``cells`` with the row of ``formulas`` (numbered from 0 per ``by``) that their ``reference`` counts from the tail: the last one is 0. An equi-join on count - 1 - number."""
    sizes = formulas.groupBy(*by).agg(F.max(number).alias("_last"))
    turned = formulas.join(sizes, by).withColumn(reference, F.col("_last") - F.col(number)).drop("_last")
    return cells.join(turned, [*by, reference], "left")


def fold_codes(rows: DataFrame, by: list[str], order: list[str], base: dict[int, Column], append: tuple[int, ...] = ()) -> DataFrame:
    """One row per group with a column ``c<code>`` for each code of ``base``: the value of the last of its rows (code, value) in ``order``, null if that is null, and that of ``base`` without any row; codes of ``append`` gather their values in order behind those of ``base`` (arrays)."""
    place = F.struct(*order)
    found = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("code") == c, F.struct(place.alias("o"), F.col("value").alias("v"))))), lambda x: x["v"]).alias(f"c{c}") if c in append else F.max_by(F.struct("value"), F.when(F.col("code") == c, place)).alias(f"c{c}")
        for c in base
    ]
    folded = rows.groupBy(*by).agg(*found)
    return folded.select(*by, *[(F.concat(v, F.col(f"c{c}")) if c in append else F.when(F.col(f"c{c}").isNull(), v).otherwise(F.col(f"c{c}.value"))).alias(f"c{c}") for c, v in base.items()])


def code_deltas(folded: DataFrame, by: list[str], base: dict[int, Column]) -> DataFrame:
    """The inverse of a fold without appended codes: (by, code, value) for each column ``c<code>`` that differs from ``base``."""
    changed = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"c{c}").alias("value"), F.col(f"c{c}").eqNullSafe(v).alias("same")) for c, v in base.items()]), lambda x: ~x["same"])
    return folded.select(*by, F.explode(changed).alias("_c")).select(*by, "_c.code", "_c.value")


def linked_text(pages: DataFrame, targets: DataFrame, id_col: str, text: str, reference: str, link: str) -> DataFrame:
    """``pages`` with each match of ``reference`` whose name (group 1) is one of ``targets`` (name, first) put as ``link``, in which {name} and {first} are filled in; other matches stay.

    Names are joined once per page; a page's text is cut at its references and put together again inside its row.
    """
    names = F.regexp_extract_all(text, F.lit(reference), F.lit(1))
    used = pages.select(id_col, F.explode(F.array_distinct(names)).alias("name")).join(targets.select("name", F.col("first").cast("string").alias("first")), "name")
    known = used.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("name", "first"))).alias("_first"))
    whole, gaps = F.regexp_extract_all(text, F.lit(reference), F.lit(0)), F.split(F.col(text), reference, -1)

    def put(x: Column) -> Column:
        first = F.try_element_at("_first", x["name"])
        parts = [first if p == "{first}" else x["name"] if p == "{name}" else F.lit(p) for p in _placeholders(link)]
        return F.concat(x["gap"], F.when(first.isNull(), x["whole"]).otherwise(F.concat(*parts)))

    pieces = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(names)).alias("gap"), whole.alias("whole"), names.alias("name")), put)
    joined = pages.join(known, id_col, "left")
    return joined.withColumn(text, F.when(F.col("_first").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1)))).drop("_first")


def _placeholders(link: str) -> list[str]:
    out = [""]
    for ch in link:
        if ch == "{" or out[-1].endswith("}"):
            out.append("")
        out[-1] += ch
    return [p for p in out if p]


def link_names(pages: DataFrame, id_col: str, text: str, target: str, reference: str) -> DataFrame:
    """(id, name, first, uses): for each name that a page refers to (group 1 of ``reference``), the least id of a page that defines it (group 1 of ``target``), null if none does."""
    names = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("name")
    targets = pages.select(id_col, names(target)).groupBy("name").agg(F.min(id_col).alias("first"))
    refs = pages.select(id_col, F.explode(F.regexp_extract_all(text, F.lit(reference), F.lit(1))).alias("name")).groupBy(id_col, "name").agg(F.count(F.lit(1)).alias("uses"))
    return refs.join(targets, "name", "left").select(id_col, "name", "first", "uses")
