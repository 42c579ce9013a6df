"""Queries over buffers, pictures and documents made of the driver tables: nested objects, linked parts, palettes and styles as tables, checked writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import binary as B
from .operators import buffers, nested, palettes
from .operators import runs as R
from .queries import c, query
from .sources import diagnostics as D
from .sources import sinks as K
from .sources.shared import note, scratch, shared_folder


def _children(data):
    """A byte with the number of objects and their offsets and lengths, 16 bits each."""
    n = B.uint(data, 0, 1)
    entries = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.struct(B.uint(data, 1 + 4 * k, 2).alias("offset"), B.uint(data, 3 + 4 * k, 2).alias("length")))
    return F.when((n > 0) & (F.length(data) >= 1 + 4 * n), entries).when(n == 0, F.array().cast("array<struct<offset:bigint,length:bigint>>"))


@query(
    "objects_nested",
    "SELECT o_orderkey, path AS object_path, CAST(depth AS INTEGER) AS depth, CAST(o AS BIGINT) AS \"offset\", CAST(n AS BIGINT) AS length, status FROM orders JOIN (VALUES (0, '', 0, 0, 10, 'ok'), (0, '0', 1, 9, 1, 'ok'), (0, '1', 1, 0, 10, 'loop'), (1, '', 0, 0, 11, 'ok'), (1, '0', 1, 5, 6, 'ok'), (1, '0/0', 2, 10, 1, 'ok'), "
    "(2, '', 0, 0, 1, 'unreadable'), (3, '', 0, 0, 5, 'ok'), (3, '0', 1, 9, 1, 'outside')) v(k, path, depth, o, n, status) ON k = o_orderkey % 4",
)
def _(t):
    """Objects in objects, one that would hold itself, one outside, and a buffer that can't be read."""
    kinds = ["02090001000000" + "0A0000", "01050006000105000100" + "00", "05", "0109000100"]
    content = F.unhex(F.get(F.array(*map(F.lit, kinds)), (c("o_orderkey") % 4).cast("int")))
    return nested.expanded(t("orders").select("o_orderkey", content.alias("content")), ["o_orderkey"], "content", _children).drop("data")


_PARTS = "(SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"


@query(
    "buffers_linked",
    f"""SELECT k AS l_orderkey, string_agg(hex(encode(printf('%08d', p))) || CASE WHEN next = n + 1 THEN printf('%02X%02X0000', (12 * r) % 256, (12 * r) // 256) ELSE '30303030' END, '' ORDER BY n) AS content, CAST(count(*) FILTER (WHERE next IS DISTINCT FROM n + 1) AS BIGINT) AS unplaced
    FROM (SELECT *, lead(n) OVER w AS next, row_number() OVER w AS r FROM {_PARTS} WINDOW w AS (PARTITION BY k ORDER BY n)) GROUP BY k""",
)
def _(t):
    """Lines as parts of twelve bytes, the last four for the place of the next line: joined, shifted and patched."""
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    parts = lines.select("l_orderkey", "l_linenumber", F.encode(F.concat(F.format_string("%08d", "p"), F.lit("0000")), "UTF-8").alias("content"))
    name = lambda n: n.cast("string").alias("target")
    targets = lines.select("l_orderkey", "l_linenumber", name(c("l_linenumber")), F.lit(0).cast("long").alias("offset"))
    references = lines.select("l_orderkey", "l_linenumber", name(c("l_linenumber") + 1), F.lit(8).cast("long").alias("at"))
    return buffers.linked(parts, targets, references, ["l_orderkey"], "l_linenumber", "content").withColumn("content", F.hex("content"))


_PIXELS = "(SELECT DISTINCT l_suppkey % 5 AS picture, l_discount * 10 AS red, l_tax * 10 AS green, l_quantity / 50.0 AS blue FROM lineitem)"
_PALETTES = "(SELECT p_partkey % 5 AS picture, CAST(p_partkey // 5 AS INTEGER) AS entry, p_size / 50.0 AS red, (p_partkey % 101) / 101.0 AS green, (p_partkey % 17) / 17.0 AS blue FROM part)"


def _palettes(t):
    return t("part").select((c("p_partkey") % 5).alias("picture"), F.floor(c("p_partkey") / 5).cast("int").alias("entry"), (c("p_size") / 50.0).alias("red"), (c("p_partkey") % 101 / 101.0).alias("green"), (c("p_partkey") % 17 / 17.0).alias("blue"))


@query("palette_nearest_table", f"SELECT picture, round(p.red, 6) AS red, round(p.green, 6) AS green, round(p.blue, 6) AS blue, min({{'d': (p.red - q.red) * (p.red - q.red) + (p.green - q.green) * (p.green - q.green) + (p.blue - q.blue) * (p.blue - q.blue), 'e': q.entry}}).e AS colour FROM {_PIXELS} p JOIN {_PALETTES} q USING (picture) GROUP BY picture, p.red, p.green, p.blue")
def _(t):
    """The nearest colour of a palette that is a table, one for each picture."""
    pixels = t("lineitem").select((c("l_suppkey") % 5).alias("picture"), (c("l_discount") * 10).alias("red"), (c("l_tax") * 10).alias("green"), (c("l_quantity") / 50.0).alias("blue")).distinct()
    return palettes.nearest(pixels, _palettes(t), ["picture"]).select("picture", *[F.round(x, 6).alias(x) for x in palettes.RGB], "colour")


@query("palette_colours", f"WITH q AS {_PALETTES} SELECT o_orderkey, round(coalesce(a.red, b.red), 6) AS red, round(coalesce(a.green, b.green), 6) AS green, round(coalesce(a.blue, b.blue), 6) AS blue FROM orders LEFT JOIN q a ON a.picture = o_orderkey % 5 AND a.entry = o_custkey JOIN (SELECT picture, arg_min(red, entry) AS red, arg_min(green, entry) AS green, arg_min(blue, entry) AS blue FROM q GROUP BY picture) b ON b.picture = o_orderkey % 5")
def _(t):
    pixels = t("orders").select("o_orderkey", (c("o_orderkey") % 5).alias("picture"), c("o_custkey").cast("int").alias("pixel"))
    return palettes.colours(pixels, _palettes(t), ["picture"]).select("o_orderkey", *[F.round(x, 6).alias(x) for x in palettes.RGB])


@query("write_checked", "SELECT 'error' AS level, 'discount' AS code, count(*) FILTER (WHERE l_discount > 0.08) AS n FROM lineitem UNION ALL SELECT 'warn', 'quantity', count(*) FILTER (WHERE l_quantity > 45) FROM lineitem UNION ALL SELECT 'fatal', 'both', count(*) FILTER (WHERE l_discount > 0.08 AND l_quantity > 45) FROM lineitem")
def _(t):
    """Messages counted while the lines are written, the bad ones aside."""
    lines = t("lineitem")
    spark = lines.sparkSession
    discount, quantity = c("l_discount") > 0.08, c("l_quantity") > 45
    with scratch(spark):
        out = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
        note(out)
        counts = D.write_checked(lines, out, [D.Rule("error", "discount", discount), D.Rule("warn", "quantity", quantity), D.Rule("fatal", "both", discount & quantity)])
    return spark.createDataFrame([(level, code, n) for (level, code), n in counts.items()], "level string, code string, n long")


_STYLES = "(SELECT r_regionkey AS s_nationkey, CAST(0 AS BIGINT) AS number, 'Normal' AS name, 10 AS size FROM region UNION ALL SELECT n_regionkey, 255 - n_nationkey, n_name, 11 + n_nationkey FROM nation)"


def _styles(t):
    normal = t("region").select(c("r_regionkey").cast("long").alias("document"), F.lit(0).cast("long").alias("number"), F.lit("Normal").alias("name"), F.lit(10).cast("long").alias("size"))
    return normal.unionByName(t("nation").select(c("n_regionkey").cast("long").alias("document"), (F.lit(255) - c("n_nationkey")).cast("long").alias("number"), c("n_name").alias("name"), (c("n_nationkey") + 11).cast("long").alias("size")))


@query(
    "style_joined",
    f"WITH s AS (SELECT s_nationkey AS document, number, name, size FROM {_STYLES}), p AS (SELECT o_orderkey, o_custkey % 5 AS document, 255 - o_orderkey % 30 AS number FROM orders), f AS (SELECT o_orderkey, document, coalesce(a.name, b.name) AS name, CAST(coalesce(a.size, b.size) AS BIGINT) AS size FROM p LEFT JOIN s a USING (document, number) JOIN (SELECT * FROM s WHERE number = 0) b USING (document)) "
    "SELECT o_orderkey, name, size, CAST((SELECT max(s.number) FROM s WHERE s.document = f.document AND s.name = f.name) AS BIGINT) AS number FROM f",
)
def _(t):
    """Styles of paragraphs by number from a table, the normal one for numbers without a style, and back by name."""
    paragraphs = t("orders").select("o_orderkey", (c("o_custkey") % 5).cast("long").alias("document"), (F.lit(255) - c("o_orderkey") % 30).cast("long").alias("number"))
    found = R.style_by_number(paragraphs, _styles(t), ["document"], "number", ["name", "size"])
    return R.style_by_name(found, _styles(t), ["document"], "name", "number", "number").select("o_orderkey", "name", "size", "number")


@query("doc_regions", "SELECT conv_id, md5('conversation' || chr(10) || string_agg(replace(coalesce(text, ''), chr(10), chr(9)) || chr(10), '' ORDER BY turn) || 'turns: ' || count(*) || chr(10)) AS hash FROM conversations GROUP BY conv_id")
def _(t):
    """Text of header, body and footer."""
    turns = t("conversations").select("conv_id", c("turn").cast("long").alias("turn"), c("text").alias("para"))
    header = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("conversation").alias("para"))
    footer = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("turn"), F.concat(F.lit("turns: "), F.count(F.lit(1)).cast("string")).alias("para"))
    return K.to_text(K.with_regions(turns, ["conv_id"], "turn", header, footer), ["conv_id"], "turn").select("conv_id", F.md5("body").alias("hash"))
