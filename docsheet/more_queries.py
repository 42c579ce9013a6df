"""More queries over the driver tables: formulas on tagged cells, number formats, layouts as CSS, links, pictures, scalars; planted rows stand on both sides."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import binary as B
from .functions import cells as C
from .functions import numberformat as N
from .functions import text as T
from .operators import runs as R
from .plans import evaluate as E
from .queries import SQL, c, query
from .sources import css as K
from .sources import files as P


def values(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


# The same postfix formulas as data: one fold for tables whose rows have formulas of their own.
@query("formula_fold", "SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN -(p_retailprice + p_size) WHEN 1 THEN sqrt(p_retailprice) * p_size ELSE round(p_retailprice, 0) END, 6) AS result FROM part")
def _(t):
    number = lambda x: F.struct(F.lit(0x1F).alias("marker"), x.cast("double").alias("number"))
    op = lambda m: F.struct(F.lit(m).alias("marker"), F.lit(None).cast("double").alias("number"))
    first = F.array(number(c("p_retailprice")), number(c("p_size")), op(0x07), op(0x12), op(0x0D), op(0x0C))
    second = F.array(number(c("p_retailprice")), op(0x7D), number(c("p_size")), op(0x09))
    third = F.array(number(F.round("p_retailprice", 0)))
    tokens = F.when(c("p_size") % 3 == 0, first).when(c("p_size") % 3 == 1, second).otherwise(third)
    return t("part").select("p_partkey", F.round(E.evaluate(tokens), 6).alias("result"))


#: Cells of a sheet: rows are order keys; column 1 the price, 2 the priority as text, 3 a flag, 4 an error for some, 5 blank. Planted: one row with zero, numeric text and no cells beyond.
_PLANTED = "(VALUES (-1, 1, 'float', 0.0, NULL, NULL, NULL), (-1, 2, 'string', NULL, ' 12 ', NULL, NULL), (-2, 1, 'int', 7.0, NULL, NULL, NULL), (-2, 4, 'error', NULL, NULL, NULL, 7)) v"
_CELLS = (
    "(SELECT o_orderkey AS r, 1 AS k, 'float' AS kind, o_totalprice AS num, CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BOOLEAN) AS flag, CAST(NULL AS INTEGER) AS err FROM orders "
    "UNION ALL SELECT o_orderkey, 2, 'string', NULL, o_orderpriority, NULL, NULL FROM orders UNION ALL SELECT o_orderkey, 3, 'bool', NULL, NULL, o_custkey % 2 = 0, NULL FROM orders "
    f"UNION ALL SELECT o_orderkey, 4, 'error', NULL, NULL, NULL, CAST(o_custkey % 7 + 1 AS INTEGER) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT * FROM {_PLANTED})"
)
_TARGETS = "(SELECT DISTINCT o_orderkey AS r FROM orders UNION SELECT * FROM (VALUES (-1), (-2), (-3)) x)"


def order_sheet(t):
    """(cells, targets) of the sheet above; a target stands in column 9 of each row."""
    orders = t("orders")
    spark = orders.sparkSession
    part = lambda k, cell, rows: rows.select(c("o_orderkey").alias("row"), F.lit(k).cast("long").alias("column"), cell.alias("cell"))
    cells = part(1, C.cell(F.lit("float"), num=c("o_totalprice")), orders).unionByName(part(2, C.cell(F.lit("string"), text=c("o_orderpriority")), orders)).unionByName(part(3, C.cell(F.lit("bool"), flag=c("o_custkey") % 2 == 0), orders))
    cells = cells.unionByName(part(4, C.cell(F.lit("error"), error=c("o_custkey") % 7 + 1), orders.where("o_orderkey % 5 = 0")))
    planted = values(spark, "row long, column long, kind string, num double, str string, err int", [(-1, 1, "float", 0.0, None, None), (-1, 2, "string", None, " 12 ", None), (-2, 1, "int", 7.0, None, None), (-2, 4, "error", None, None, 7)])
    cells = cells.unionByName(planted.select("row", "column", C.cell(c("kind"), c("num"), c("str"), None, c("err")).alias("cell")))
    rows = orders.select(c("o_orderkey").alias("row")).distinct().unionByName(values(spark, "row long", [(-1,), (-2,), (-3,)]))
    return cells, rows.select(c("row").alias("target"), "row", F.lit(9).cast("long").alias("column"))


def _shown(result):
    return result.select("target", c("result.kind").alias("kind"), F.round("result.num", 4).alias("num"), c("result.str").alias("str"), c("result.bool").alias("flag"), c("result.err").alias("err"))


_REF = lambda k: (E.REFERENCE, 0, k, False, True)  # noqa: E731  column k of the target's own row
_PIVOT = f"(SELECT r, any_value(num) FILTER (WHERE k = 1) AS price, any_value(kind) FILTER (WHERE k = 1) AS has, any_value(str) FILTER (WHERE k = 2) AS pri, any_value(flag) FILTER (WHERE k = 3) AS flag, any_value(err) FILTER (WHERE k = 4) AS err FROM {_TARGETS} LEFT JOIN {_CELLS} USING (r) GROUP BY r)"


@query(
    "formula_cells",
    f"SELECT r AS target, CASE WHEN err IS NOT NULL OR coalesce(price, 0) = 0 THEN 'error' ELSE 'float' END AS kind, CASE WHEN err IS NULL AND coalesce(price, 0) <> 0 THEN round(-(price + 3) * 2.5 / price, 4) END AS num, CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BOOLEAN) AS flag, "
    f"CASE WHEN err IS NOT NULL THEN err WHEN coalesce(price, 0) = 0 THEN 2 END AS err FROM {_PIVOT}",
)
def _(t):
    """-(A + 3) * rate / A + blank, where D may be an error: errors travel, a blank is 0, a variable is joined by name."""
    cells, targets = order_sheet(t)
    rate = values(cells.sparkSession, "name string, num double", [("rate", 2.5), ("other", 1.0)]).select("name", C.cell(F.lit("float"), num=c("num")).alias("cell"))
    tokens = [_REF(4), _REF(5), (0x09,), _REF(1), (0x20, 3), (0x07,), (0x12,), (0x0D,), (0x25, "rate"), (0x09,), _REF(1), (0x0A,), (0x07,)]
    return _shown(E.formula_cells(targets, tokens, cells, rate))


@query(
    "formula_text",
    f"SELECT r AS target, 'string' AS kind, CAST(NULL AS DOUBLE) AS num, CASE WHEN coalesce(price, 0) > 100000 THEN left(coalesce(pri, ''), 3) || '-big' ELSE upper(coalesce(pri, '')) END AS str, CAST(NULL AS BOOLEAN) AS flag, CAST(NULL AS INTEGER) AS err FROM {_PIVOT}",
)
def _(t):
    """IF(A > 100000, LEFT(B, 3) & "-big", UPPER(B))."""
    cells, targets = order_sheet(t)
    tokens = [_REF(1), (0x1F, 100000.0), (0x03,), _REF(2), (0x20, 3), (0x51,), (0x26, "-big"), (0x11,), _REF(2), (0x5C,), (0x34,)]
    return _shown(E.formula_cells(targets, tokens, cells))


@query(
    "formula_block",
    f"SELECT r AS target, CASE WHEN err IS NULL THEN 'float' ELSE 'error' END AS kind, CASE WHEN err IS NULL THEN round(coalesce(price, 0) + 1 + n, 4) END AS num, CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BOOLEAN) AS flag, err FROM {_PIVOT} LEFT JOIN (SELECT r, count(k) AS n FROM {_TARGETS} LEFT JOIN {_CELLS} USING (r) GROUP BY r) USING (r)",
)
def _(t):
    """SUM(A:D, 1) + COUNTA(A:D): numbers are added, the first error of the block travels, all but blanks count."""
    cells, targets = order_sheet(t)
    block = (E.BLOCK, 0, 1, False, True, 0, 4, False, True)
    tokens = [block, (0x20, 1), (0x98, 2), block, (0x91, 1), (0x07,)]
    return _shown(E.formula_cells(targets, tokens, cells))


@query(
    "formula_is",
    f"SELECT r AS target, 'bool' AS kind, CAST(NULL AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str, err IS NOT NULL OR (pri IS NOT NULL AND NOT coalesce(flag, false)) AS flag, CAST(NULL AS INTEGER) AS err FROM {_PIVOT}",
)
def _(t):
    """ISERROR(D) OR (ISTEXT(B) AND NOT C)."""
    cells, targets = order_sheet(t)
    return _shown(E.formula_cells(targets, [_REF(4), (0x3A,), _REF(2), (0x3F,), _REF(3), (0x0E,), (0x0F,), (0x12,), (0x10,)], cells))


@query("cell_info", f"SELECT r AS target, '$A$' || r AS address, CASE WHEN has IS NULL THEN 'b' ELSE 'v' END AS type FROM {_PIVOT}")
def _(t):
    """CELL on the first column."""
    cells, targets = order_sheet(t)
    found = E.formula_cells(targets, [_REF(1)], cells)
    own = lambda what: C.info(what, c("result"), c("row"), F.lit(1))["str"].alias(what)
    return found.select("target", own("address"), own("type"), "row").drop("row")


@query("formula_tail", "SELECT p_partkey, q.p_name AS formula FROM part p LEFT JOIN (SELECT p_name, m - p_partkey AS ref, p_brand FROM part JOIN (SELECT p_brand, max(p_partkey) AS m FROM part GROUP BY 1) USING (p_brand)) q ON q.p_brand = p.p_brand AND q.ref = p.p_size")
def _(t):
    """Formulas counted from the tail: each part refers to the formula of its brand at the distance of its size."""
    formulas = t("part").select("p_brand", c("p_partkey").alias("no"), c("p_name").alias("formula"))
    return R.from_tail(t("part").select("p_partkey", "p_brand", c("p_size").cast("long").alias("ref")), formulas, ["p_brand"], "no", "ref").select("p_partkey", "formula")


@query("style_number", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 254 END AS number FROM part")
def _(t):
    name = F.get(F.array(*map(F.lit, ("Normal", "Heading 1", "Bulleted", "no such style"))), c("p_size") % 4)
    return t("part").select("p_partkey", R.style_number(name, ["Heading 1", "Bulleted", "Heading 1"]).alias("number"))


# Number formats: each part's price in the format of its key.
_DATE = "(DATE '1899-12-31' + CAST(floor(v) AS INTEGER) + to_seconds(CAST(round((v - floor(v)) * 86400) AS BIGINT)))"
_STRF = {"d": "%-d", "dd": "%d", "MM": "%m", "MMM": "%b", "MMMM": "%B", "yy": "%y", "yyyy": "%Y", "hh": "%I", "HH": "%H", "mm": "%M", "ss": "%S", "a": "%p"}


def _strftime(pattern: str) -> str:
    import re

    return re.sub("[A-Za-z]+", lambda m: _STRF[m[0]], pattern)


_FORMATTED = "CASE f " + " ".join(f"WHEN {k} THEN strftime({_DATE}, '{_strftime(p)}')" for k, (_, p) in enumerate(N.FORMATS) if p) + (
    " WHEN 1 THEN CASE d WHEN 0 THEN printf('%.0f', v) WHEN 1 THEN printf('%.1f', v) ELSE printf('%.2f', v) END WHEN 2 THEN CASE d WHEN 0 THEN printf('%.0E', v) WHEN 1 THEN printf('%.1E', v) ELSE printf('%.2E', v) END"
    " WHEN 3 THEN '$' || CASE d WHEN 0 THEN format('{:,.0f}', v) WHEN 1 THEN format('{:,.1f}', v) ELSE format('{:,.2f}', v) END WHEN 4 THEN CASE d WHEN 0 THEN printf('%.0f', v * 100) WHEN 1 THEN printf('%.1f', v * 100) ELSE printf('%.2f', v * 100) END || '%'"
    " WHEN 5 THEN CASE d WHEN 0 THEN format('{:,.0f}', v) WHEN 1 THEN format('{:,.1f}', v) ELSE format('{:,.2f}', v) END WHEN 6 THEN CASE WHEN v <> 0 THEN 'TRUE' ELSE 'FALSE' END"
    " ELSE CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END END"
)


@query("number_format", f"SELECT p_partkey, {_FORMATTED} AS shown FROM (SELECT p_partkey, CAST(p_partkey % 33 AS INTEGER) AS f, CAST(p_size % 3 AS INTEGER) AS d, 30000 + p_size * 11 + CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE 0.375 END AS v FROM part)")
def _(t):
    """31 formats and two unknown codes; values have three eighths, so all digits are exact and no rounding is halfway at none or one decimal."""
    value = F.lit(30000) + c("p_size") * 11 + F.when(c("p_partkey") % 2 == 0, 0.0).otherwise(0.375)
    code = N.code_of((c("p_partkey") % 33 * 2).cast("int"))
    return t("part").select("p_partkey", N.render(value.cast("double"), code, N.decimals_of((c("p_size") % 3 * 2).cast("int"))).alias("shown"))


# Layout codes: the lines of an order are codes 1 to 3 over a base; code 4 gathers.
_BASE = {1: 10.0, 2: 20.0, 3: 30.0}


@query(
    "layout_fold",
    "SELECT l_orderkey, " + ", ".join(f"coalesce(arg_max(l_quantity, o) FILTER (WHERE code = {k}), {v}) AS c{k}" for k, v in _BASE.items())
    + ", len(list_concat([0.0], coalesce(list(l_quantity ORDER BY o) FILTER (WHERE code = 4), []))) AS n4 FROM (SELECT *, l_partkey % 4 + 1 AS code, row(l_linenumber, l_partkey, l_extendedprice) AS o FROM lineitem) GROUP BY l_orderkey",
)
def _(t):
    base = {k: F.lit(v) for k, v in _BASE.items()} | {4: F.array(F.lit(0.0))}
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (c("l_partkey") % 4 + 1).alias("code"), c("l_quantity").cast("double").alias("value"))
    folded = R.fold_codes(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], base, append=(4,))
    return folded.select("l_orderkey", "c1", "c2", "c3", F.size("c4").cast("long").alias("n4"))


@query("layout_delta", "SELECT p_partkey, unnest(list_filter([{'code': 1, 'value': p_size}, {'code': 2, 'value': CAST(p_partkey % 3 AS INTEGER)}, {'code': 3, 'value': CASE WHEN p_size > 25 THEN 7 END}], lambda x: x['value'] IS DISTINCT FROM CASE x['code'] WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE 7 END), recursive := true) FROM part")
def _(t):
    own = t("part").select("p_partkey", c("p_size").alias("c1"), (c("p_partkey") % 3).cast("int").alias("c2"), F.when(c("p_size") > 25, 7).alias("c3"))
    return R.code_deltas(own, ["p_partkey"], {1: F.lit(5), 2: F.lit(0), 3: F.lit(7)})


def _layouts():
    """Layouts with null fields: some have no colour, some no family."""
    bold, size = c("p_size") % 2 == 0, (c("p_size") % 5 + 8).cast("double")
    character = F.struct(F.when(c("p_size") % 10 != 9, "#000000").alias("color"), F.when(c("p_size") > 40, "#ffff00").otherwise("#ffffff").alias("back_color"), size.alias("font_size"), F.lit(False).alias("italic"), bold.alias("bold"), F.lit(None).cast("string").alias("super_sub"), (c("p_size") % 3 == 0).alias("underline"), (c("p_size") % 7 == 0).alias("strikethrough"), F.when(c("p_size") % 10 != 8, "serif").alias("family"))
    paragraph = F.struct(F.lit("#ffffff").alias("back_color"), (c("p_size") % 4).cast("double").alias("indent_left"), F.lit(0.0).alias("indent_right"), F.lit(1.0).alias("indent_first"), F.lit("left").alias("justify"), (c("p_size") % 2 == 1).alias("bullet"), F.lit(0.0).alias("space_above"), F.lit(0.0).alias("space_below"))
    return character, paragraph


def _base_layouts():
    character = F.struct(F.lit("#000000").alias("color"), F.lit("#ffffff").alias("back_color"), F.lit(10.0).alias("font_size"), F.lit(False).alias("italic"), F.lit(False).alias("bold"), F.lit(None).cast("string").alias("super_sub"), F.lit(False).alias("underline"), F.lit(False).alias("strikethrough"), F.lit("serif").alias("family"))
    paragraph = F.struct(F.lit("#ffffff").alias("back_color"), F.lit(0.0).alias("indent_left"), F.lit(0.0).alias("indent_right"), F.lit(0.0).alias("indent_first"), F.lit("left").alias("justify"), F.lit(False).alias("bullet"), F.lit(0.0).alias("space_above"), F.lit(0.0).alias("space_below"))
    return character, paragraph


_CHAR_CSS = (
    "CASE WHEN p_size > 40 THEN 'background-color:#ffff00;' ELSE '' END || CASE WHEN p_size % 5 <> 2 THEN 'font-size:' || printf('%.2f', CAST(p_size % 5 + 8 AS DOUBLE)) || 'pt;' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN 'font-weight:bold;' ELSE '' END || "
    "CASE WHEN p_size % 3 = 0 THEN 'text-decoration:underline;' WHEN p_size % 7 = 0 THEN 'text-decoration:line-through;' ELSE '' END"
)
_PARA_CSS = "CASE WHEN l <> 0 THEN 'padding-left:' || printf('%.2f', l) || 'cm;' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN 'text-indent:1.00cm;' ELSE '' END"
_STYLED = "(SELECT *, CAST(CASE WHEN p_size % 2 = 1 THEN least(p_size % 4, 1) ELSE p_size % 4 END AS DOUBLE) AS l FROM part)"


@query("style_css", f"SELECT p_partkey, {_PARA_CSS} || {_CHAR_CSS} AS css FROM {_STYLED}")
def _(t):
    """Paragraph and character rules over the base, with the padding rule of bullets."""
    (character, paragraph), (base_c, base_p) = _layouts(), _base_layouts()
    return t("part").select("p_partkey", F.concat(K.paragraph_css(paragraph, base_p), K.character_css(character, base_c)).alias("css"))


_BODY_RULE = "body {background-color:#ffffff;padding-left:0.00cm;padding-right:0.00cm;text-indent:0.00cm;text-align:left;padding-top:0.00pt;padding-bottom:0.00pt;color:#000000;background-color:#ffffff;font-size:10.00pt;font-style:normal;font-weight:normal;vertical-align:baseline;text-decoration:none;font-family:serif;}"
_SHEETS = f"""(SELECT p_brand, '<style type="text/css">' || chr(10) || '{_BODY_RULE}' || chr(10) || string_agg('*.style-' || regexp_replace(p_name, '[\\x00-\\x20\\x7f-\\xa0]', '_', 'g') || ' {{' || {_PARA_CSS} || {_CHAR_CSS} || '}}' || chr(10), '' ORDER BY p_partkey) || '</style>' || chr(10) AS css FROM {_STYLED} GROUP BY p_brand)"""


def _style_sheets(t):
    (character, paragraph), (base_c, base_p) = _layouts(), _base_layouts()
    styles = t("part").select("p_brand", "p_partkey", c("p_name").alias("name"), character.alias("character"), paragraph.alias("paragraph"))
    return K.style_sheet(styles, ["p_brand"], "p_partkey", base_p, base_c)


@query("style_sheet", f"SELECT p_brand, md5(css) AS hash FROM {_SHEETS}")
def _(t):
    return _style_sheets(t).select("p_brand", F.md5("css").alias("hash"))


@query(
    "doc_styled",
    f"""WITH r AS (SELECT p_brand, p_partkey, unnest([1, 2]) AS k, unnest([p_name, ' <' || p_type || '>']) AS x, {_CHAR_CSS} AS s FROM {_STYLED}),
    h AS (SELECT p_brand, p_partkey, string_agg(CASE WHEN k = 1 OR s = '' THEN replace(replace(x, '<', '&lt;'), '>', '&gt;') ELSE '<span style="' || s || '">' || replace(replace(x, '<', '&lt;'), '>', '&gt;') || '</span>' END, '' ORDER BY k) AS html FROM r GROUP BY 1, 2),
    b AS (SELECT p_brand, string_agg('<' || tag || ' class="style-' || CASE WHEN tag = 'p' THEN 'Body' ELSE 'Heading_2' END || '">' || html || '</' || tag || '>' || chr(10), '' ORDER BY p_partkey) AS body FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'h2' ELSE 'p' END AS tag FROM h) GROUP BY 1)
    SELECT p_brand, md5('<!DOCTYPE html>' || chr(10) || '<html><head>' || chr(10) || css || '</head><body>' || chr(10) || body || '</body></html>' || chr(10)) AS hash FROM b JOIN {_SHEETS} USING (p_brand)""",
)
def _(t):
    """A document per brand: paragraphs of two runs, the second with rules of its own, under the brand's style sheet."""
    (character, _), (base_c, _) = _layouts(), _base_layouts()
    rows = t("part").select("p_brand", "p_partkey", K.character_css(character, base_c).alias("s"), F.explode(F.array(F.struct(F.lit(1).alias("k"), c("p_name").alias("x")), F.struct(F.lit(2).alias("k"), F.concat(F.lit(" <"), "p_type", F.lit(">")).alias("x")))).alias("r"))
    runs = rows.select("p_brand", "p_partkey", c("r.k").alias("k"), c("r.x").alias("text"), F.when(c("r.k") != 1, c("s")).alias("s"))
    paragraphs = K.styled_paragraphs(runs, ["p_brand"], "p_partkey", "k", c("s"))
    style = F.when(c("p_partkey") % 10 == 0, "Heading 2").otherwise("Body")
    return K.styled_document(paragraphs, _style_sheets(t), ["p_brand"], "p_partkey", style, headings=True).select("p_brand", F.md5("body").alias("hash"))


@query(
    "xref_replace",
    "WITH d AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<h1>([A-Za-z]+)', 1))) AS name FROM pages), f AS (SELECT name, CAST(min(page_id) AS VARCHAR) AS \"first\" FROM d GROUP BY 1), "
    "p AS (SELECT page_id, string_split_regex(html, '<p>[A-Za-z]+') AS gaps, regexp_extract_all(html, '<p>([A-Za-z]+)', 1) AS names FROM pages), "
    "g AS (SELECT page_id, i, gaps[i] AS gap, names[i] AS name FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM p)) "
    "SELECT page_id, md5(string_agg(gap || CASE WHEN name IS NULL THEN '' WHEN \"first\" IS NULL THEN '<p>' || name ELSE '<p><a href=\"' || \"first\" || '.html#' || name || '\">' || name || '</a>' END, '' ORDER BY i)) AS hash FROM g LEFT JOIN f USING (name) GROUP BY page_id",
)
def _(t):
    """Second pass of the linker: first words of paragraphs become links to the page whose heading they begin."""
    pages = t("pages").select("page_id", "html")
    targets = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<h1>([A-Za-z]+)"), F.lit(1)))).alias("name")).groupBy("name").agg(F.min("page_id").alias("first"))
    return R.linked_text(pages, targets, "page_id", "html", "<p>([A-Za-z]+)", '<p><a href="{first}.html#{name}">{name}</a>').select("page_id", F.md5("html").alias("hash"))


# Pictures.
@query("pixel_rgb", "SELECT p_partkey, round(p_size % 16 / 15.0::DOUBLE, 6) AS grey, round(p_partkey % 4 / 3.0::DOUBLE, 6) AS red, round(p_partkey // 4 % 8 / 7.0::DOUBLE, 6) AS green, round(p_partkey // 32 % 8 / 7.0::DOUBLE, 6) AS blue, CAST(CASE p_size % 4 WHEN 1 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS chosen FROM part")
def _(t):
    """Grey, split and palette pixels; palette numbers beyond its two colours are its first."""
    split = B.split_rgb(c("p_partkey"), 2, 3, 3)
    palette = [(0.25, 0.0, 0.0), (0.5, 1.0, 1.0)]
    shown = [F.round(B.grey_rgb(c("p_size") % 16, 4)["red"], 6).alias("grey"), *[F.round(split[n], 6).alias(n) for n in ("red", "green", "blue")], B.palette_rgb(c("p_size") % 4, palette)["red"].alias("chosen")]
    return t("part").select("p_partkey", *shown)


@query("pixel_rows", "SELECT p_partkey, array_to_string([p_size % 16, p_size // 16 % 16, CAST(p_partkey % 16 AS INTEGER), CAST(p_partkey // 16 % 16 AS INTEGER), 0, 0], ',') AS pixels FROM part")
def _(t):
    """Two rows of three pixels of four bits, each row in four bytes."""
    data = F.concat(B.little(c("p_size") % 16 + F.floor(c("p_size") / 16) % 16 * 16, 1), B.little((c("p_partkey") % 16).cast("int"), 1), F.unhex(F.lit("FFFF")), B.little(F.floor(c("p_partkey") / 16) % 16, 1), F.unhex(F.lit("000000")))
    return t("part").select("p_partkey", F.array_join(B.unpack_rows(data, F.lit(3), 4), ",").alias("pixels"))


# Scalars of binary files, with planted rows.
@query("strings_doubles", "SELECT p_partkey, p_name AS s, p_brand AS short, p_retailprice - p_size AS d, p_size % 2 = 1 AS b, CAST(octet_length(encode(p_name)) + 1 AS BIGINT) AS s_size FROM part")
def _(t):
    """Texts with their sizes, doubles by their bits and flags, written and read back."""
    value = (c("p_retailprice") - c("p_size")).cast("double")
    exponent = F.floor(F.log2(F.abs(value)))
    rows = t("part").select("p_partkey", "p_name", "p_brand", "p_size", value.alias("v"), exponent.alias("e"), ((F.abs(value) / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).alias("f"))
    high = F.when(c("v") < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long") + (c("e") + 1023) * (1 << 20) + F.floor(c("f") / float(1 << 32))
    coded = rows.select("p_partkey", B.little((c("f") % float(1 << 32)).cast("long"), 4).alias("low"), B.little(high, 4).alias("high"), B.bool_encode(c("p_size") % 2 == 1).alias("flag"), F.concat(B.little(F.octet_length("p_brand"), 1), F.encode("p_brand", "UTF-8")).alias("short"), B.s_string_encode(c("p_name")).alias("s"))
    read = coded.select("p_partkey", F.concat("low", "high", "flag").alias("head"), B.short_string(c("short"), 0).alias("short"), B.s_string(c("s"), 0).alias("s"))
    return read.select("p_partkey", c("s.value").alias("s"), c("short.value").alias("short"), B.double(c("head"), 0).alias("d"), B.boolean(c("head"), 8).alias("b"), c("s.size").cast("long").alias("s_size"))


_LE16 = "printf('%02X%02X', n % 256, n // 256)"
_LITTLE = f"SELECT n, CASE WHEN n < 256 THEN printf('%02X', n) END AS u8, {_LE16} AS u16, CASE WHEN n < 64 THEN printf('%02X', n * 4 + 2) WHEN n < 8192 THEN printf('%02X%02X', (n * 8 + 5) % 256, (n * 8 + 5) // 256) END AS s FROM (SELECT CAST(p_partkey * 37 % 9000 AS INTEGER) AS n FROM part)"


@query("little_range", "SELECT * FROM (VALUES (0, '00', '0000', '02'), (63, '3F', '3F00', 'FE'), (64, '40', '4000', '0502'), (255, 'FF', 'FF00', 'FD07'), (300, NULL, '2C01', '6509'), (8191, NULL, 'FF1F', 'FDFF'), (8192, NULL, '0020', NULL), (70000, NULL, NULL, NULL), (-1, NULL, NULL, NULL)) v(n, u8, u16, s) UNION ALL " + _LITTLE)
def _(t):
    """Encoders at the ends of their ranges; what doesn't fit is null."""
    planted = values(t("part").sparkSession, "n int", [(n,) for n in (0, 63, 64, 255, 300, 8191, 8192, 70000, -1)])
    rows = t("part").select((c("p_partkey") * 37 % 9000).cast("int").alias("n")).unionByName(planted)
    return rows.select("n", F.hex(B.little(c("n"), 1)).alias("u8"), F.hex(B.little(c("n"), 2)).alias("u16"), F.hex(B.s_encode(c("n"))).alias("s"))


@query("reference_bits", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN -p_size ELSE p_size END AS \"offset\", p_size % 3 = 0 AS absolute FROM part")
def _(t):
    raw = c("p_size") + F.when(c("p_size") % 2 == 1, 0x8000).otherwise(0) + F.when(c("p_size") % 3 == 0, 0x4000).otherwise(0)
    return t("part").select("p_partkey", B.cell_offset(raw)["offset"].alias("offset"), B.cell_offset(raw)["absolute"].alias("absolute"))


@query("sint_roundtrip", "SELECT * FROM (VALUES (0, '00000000', 0), (1, '01000000', 1), (-1, '01000080', -1), (2147483647, 'FFFFFF7F', 2147483647), (-2147483647, 'FFFFFFFF', -2147483647)) v(n, code, back) UNION ALL SELECT n, printf('%02X%02X%02X%02X', abs(n) % 256, abs(n) // 256 % 256, abs(n) // 65536 % 256, abs(n) // 16777216 + CASE WHEN n < 0 THEN 128 ELSE 0 END), n FROM (SELECT CAST(CASE WHEN p_size % 2 = 1 THEN -p_partkey ELSE p_partkey END AS INTEGER) AS n FROM part)")
def _(t):
    """Signed numbers as sign and size."""
    planted = values(t("part").sparkSession, "n int", [(n,) for n in (0, 1, -1, 2147483647, -2147483647)])
    rows = t("part").select((c("p_partkey") * F.when(c("p_size") % 2 == 1, -1).otherwise(1)).cast("int").alias("n")).unionByName(planted)
    coded = rows.select("n", B.sint_encode(c("n")).alias("code"))
    return coded.select("n", F.hex("code").alias("code"), B.sint(c("code"), 0).cast("int").alias("back"))


@query("status_flags", "SELECT p_partkey, p_size % 2 = 1 AS tabs, p_size // 4 % 2 = 1 AS spaces, p_size // 8 % 2 = 1 AS hyphens FROM part")
def _(t):
    """Status bits; the second one has no name."""
    found = B.flags(c("p_size"), ["tabs", "", "spaces", "hyphens"])
    return t("part").select("p_partkey", *[found[n].alias(n) for n in ("tabs", "spaces", "hyphens")])


@query("subbuffer", "SELECT p_partkey, CASE WHEN p_size + 5 <= length(p_name || p_type) THEN substr(p_name || p_type, p_size + 1, 5) END AS part FROM part")
def _(t):
    data = F.encode(F.concat("p_name", "p_type"), "UTF-8")
    return t("part").select("p_partkey", F.decode(P.subrange(data, c("p_size"), F.lit(5)), "UTF-8").alias("part"))


@query(
    "style_patch",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 7 = 0 THEN NULL ELSE 'Normal' END AS font, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 10 END AS size FROM part",
)
def _(t):
    """Named styles over the normal one, field by field; the normal style itself lacks a font for some."""
    own = F.when(c("p_size") % 6 != 1, F.struct(F.when(c("p_size") % 3 == 0, c("p_brand")).alias("font"), F.when(c("p_size") % 2 == 0, c("p_size")).alias("size")))
    normal = F.struct(F.when(c("p_size") % 7 != 0, F.lit("Normal")).alias("font"), F.lit(10).alias("size"))
    made = R.patched(own, normal, ["font", "size"])
    return t("part").select("p_partkey", made["font"].alias("font"), made["size"].alias("size"))


@query(
    "line_defaults",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE n_regionkey END AS width, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS style FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(t):
    """Customers as lines of the sheets of their nations."""
    lines = t("customer").select("c_custkey", c("c_nationkey").alias("sheet"), F.struct(F.when(c("c_custkey") % 4 == 0, c("c_custkey")).alias("width"), F.when(c("c_custkey") % 3 == 0, c("c_mktsegment")).alias("style")).alias("layout"))
    sheets = t("nation").select(c("n_nationkey").alias("sheet"), F.struct(c("n_regionkey").cast("long").alias("width"), c("n_name").alias("style")).alias("layout"))
    return R.line_defaults(lines, sheets, ["sheet"], ["width", "style"]).select("c_custkey", c("layout.width").alias("width"), c("layout.style").alias("style"))


@query("length_raw", "SELECT p_partkey, CAST(p_partkey AS BIGINT) AS twips, CAST(p_size AS BIGINT) AS points FROM part")
def _(t):
    return t("part").select("p_partkey", B.length_raw(B.length_cm(c("p_partkey"))).alias("twips"), B.size_raw(B.size_pt(c("p_size"))).alias("points"))


@query("jump_table", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 3 AS BIGINT) END AS n, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS \"first\" FROM orders")
def _(t):
    """A table that is empty, has one offset, or states more than the file holds."""
    data = F.concat(F.unhex(F.lit("FF")), B.little(c("o_orderkey") % 3, 4), F.when(c("o_orderkey") % 3 == 1, B.little(c("o_custkey"), 4)).otherwise(F.unhex(F.lit(""))))
    offsets = P.jump_table(data, F.lit(1))
    return t("orders").select("o_orderkey", F.when(offsets.isNotNull(), F.size(offsets).cast("long")).alias("n"), F.get(offsets, 0).alias("first"))


@query("file_status", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7) THEN 'encrypted' WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'ok' END AS status FROM orders")
def _(t):
    """Orders as files, their lines as section tables: section 7 is the password's."""
    files = t("orders").select("o_orderkey", c("o_orderkey").cast("string").alias("path"), F.when(c("o_orderkey") % 4 == 0, "error").otherwise("word").alias("kind"))
    sections = t("lineitem").select(c("l_orderkey").cast("string").alias("path"), c("l_linenumber").alias("section_id"))
    return P.status(files, sections, 7).select("o_orderkey", "status")


@query("file_messages", "SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN {'level': 'error', 'offset': 12::BIGINT, 'message': 'checksum'} END, CASE WHEN o_orderkey % 6 = 0 THEN {'level': 'warn', 'offset': o_custkey, 'message': 'value ' || o_custkey} END], lambda x: x IS NOT NULL), recursive := true) FROM orders")
def _(t):
    """Diagnostics down to warnings; those of lower levels are left out."""
    found = [("error", c("o_orderkey") % 4 == 0, F.lit(12), F.lit("checksum")), ("warn", c("o_orderkey") % 6 == 0, c("o_custkey"), F.concat(F.lit("value "), c("o_custkey").cast("string"))), ("debug", F.lit(True), F.lit(0), F.lit("read"))]
    return P.messages(t("orders"), found, ["o_orderkey"])


@query("application_id", "SELECT n_nationkey, lower(n_name) = 'nation_3' AS own FROM nation")
def _(t):
    return t("nation").select("n_nationkey", P.application_is(c("n_name"), "NATION_3").alias("own"))


@query("text_section", "SELECT doc_id, md5(array_to_string(string_split(text, chr(10)), chr(6)) || chr(6)) AS hash FROM documents UNION ALL SELECT -1, md5(chr(6) || chr(2))")
def _(t):
    """Paragraphs with their marks; a planted document has none."""
    docs = t("documents").select("doc_id", F.split("text", "\n", -1).alias("p"))
    paragraphs = c("p")
    docs = docs.unionByName(values(docs.sparkSession, "doc_id long, p array<string>", [(-1, [])]))
    return docs.select("doc_id", F.md5(T.section(paragraphs)).alias("hash"))


@query("ctrl_codes", "SELECT * FROM (VALUES (6, chr(10), '<br/>', '_'), (7, chr(10), '<br/>', '_'), (8, chr(10), '<br/>', '_'), (9, chr(9), ' ', '_'), (10, chr(9), ' ', '_'), (11, '-', '-', '_'), (12, '-', '-', '_'), (14, '', '', '_'), (15, ' ', ' ', '_'), (32, ' ', ' ', '_'), (65, 'A', 'A', 'A'), (128, chr(128), chr(128), '_'), (160, chr(160), chr(160), '_'), (233, 'é', 'é', 'é')) v(code, plain, html, css) UNION ALL SELECT unicode(p_name), p_name[1], p_name[1], p_name[1] FROM part")
def _(t):
    """Every control code, and the characters that are no part of class names."""
    rows = t("part").select(F.ascii("p_name").alias("code"), F.left("p_name", F.lit(1)).alias("ch"))
    rows = rows.unionByName(values(rows.sparkSession, "code int, ch string", [(k, chr(k)) for k in (6, 7, 8, 9, 10, 11, 12, 14, 15, 32, 65, 128, 160, 233)]))
    return rows.select("code", T.render_text(c("ch")).alias("plain"), T.render_html(c("ch")).alias("html"), T.css_name(c("ch")).alias("css"))


@query("encode_planted", "SELECT * FROM (VALUES ('a', '61', '0061', '61'), ('é', 'C3A9', '00E9', '3F'), ('漢', 'E6BCA2', '6F22', '3F'), ('🙂', 'F09F9982', '003F', '3F')) v(ch, utf8, ucs2, ascii) UNION ALL SELECT p_name, hex(encode(p_name)), regexp_replace(hex(encode(p_name)), '(..)', '00\\1', 'g'), hex(encode(p_name)) FROM part")
def _(t):
    rows = t("part").select(c("p_name").alias("ch"))
    rows = rows.unionByName(values(rows.sparkSession, "ch string", [(x,) for x in "aé漢🙂"]))
    return rows.select("ch", *[F.hex(T.encode(c("ch"), k.upper())).alias(k) for k in ("utf8", "ucs2", "ascii")])


@query(
    "sheet_chain",
    "SELECT * FROM (SELECT i AS cell, CAST(i + 1 AS DOUBLE) AS value, CAST(i AS INTEGER) AS level FROM range(0, 200) r(i) UNION ALL SELECT * FROM (VALUES (1000, NULL, NULL), (1001, NULL, NULL), (1002, NULL, NULL), (1003, NULL, NULL)) v UNION ALL SELECT c_custkey + 10000, sum(CAST(c_custkey % 7 AS DOUBLE)) OVER w, CAST(count(*) OVER w - 1 AS INTEGER) FROM customer WINDOW w AS (PARTITION BY c_custkey // 50 ORDER BY c_custkey))",
)
def _(t):
    """Chains of up to 50 customers, a chain of 200 cells, each one more than the one before, a cycle of two, a cell behind it and one that needs what isn't there."""
    own = t("customer")
    spark = own.sparkSession
    cells = spark.range(200).select(c("id").alias("cell"), F.lit(1.0).alias("base")).unionByName(values(spark, "cell long, base double", [(k, 1.0) for k in range(1000, 1004)]))
    edges = spark.range(1, 200).select(c("id").alias("cell"), (c("id") - 1).alias("needs"), F.lit(1.0).alias("weight")).unionByName(values(spark, "cell long, needs long, weight double", [(1000, 1001, 1.0), (1001, 1000, 1.0), (1002, 1001, 1.0), (1003, 5000, 1.0)]))
    cells = cells.unionByName(own.select((c("c_custkey") + 10000).alias("cell"), (c("c_custkey") % 7).cast("double").alias("base")))
    linked = own.select("c_custkey", F.lag("c_custkey").over(W.partitionBy(F.floor(c("c_custkey") / 50)).orderBy("c_custkey")).alias("before")).where("before is not null")
    edges = edges.unionByName(linked.select((c("c_custkey") + 10000).alias("cell"), (c("before") + 10000).alias("needs"), F.lit(1.0).alias("weight")))
    return E.evaluate_levels(cells, edges)


@query(
    "sheet_graph",
    "WITH RECURSIVE v AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b UNION ALL SELECT i + 1, b, 1 + 0.5 * (a + b) FROM v WHERE i < 13) SELECT CAST(i AS BIGINT) AS cell, round(a, 6) AS value, CAST(greatest(0, i - 1) AS INTEGER) AS level FROM v UNION ALL SELECT * FROM (VALUES (1000, NULL, NULL), (1001, NULL, NULL)) w UNION ALL SELECT 2000 + s_suppkey, round(s_acctbal + 0.5 * a, 6), 3 FROM supplier, v WHERE i = 3",
)
def _(t):
    """Cells that need the two before them, suppliers that need one of those, and a cycle whose cells need a settled one, too."""
    own = t("supplier")
    spark = own.sparkSession
    cells = spark.range(14).select(c("id").alias("cell"), F.lit(1.0).alias("base")).unionByName(values(spark, "cell long, base double", [(1000, 1.0), (1001, 1.0)]))
    two = spark.range(2, 14).select(c("id").alias("cell"), F.explode(F.array(c("id") - 1, c("id") - 2)).alias("needs"), F.lit(0.5).alias("weight"))
    edges = two.unionByName(values(spark, "cell long, needs long, weight double", [(1000, 1001, 1.0), (1001, 1000, 1.0), (1001, 3, 1.0)]))
    cells = cells.unionByName(own.select((c("s_suppkey") + 2000).alias("cell"), c("s_acctbal").cast("double").alias("base")))
    edges = edges.unionByName(own.select((c("s_suppkey") + 2000).alias("cell"), F.lit(3).cast("long").alias("needs"), F.lit(0.5).alias("weight")))
    return E.evaluate_levels(cells, edges).withColumn("value", F.round("value", 6))


# SQL for queries that had none.
SQL["ascii_html"] = "SELECT page_id, md5(coalesce(string_agg(CASE WHEN unicode(ch) > 127 THEN '&#x' || lower(to_hex(unicode(ch))) || ';' ELSE ch END, '' ORDER BY i), '')) AS hash FROM (SELECT page_id, unnest(string_split(html, '')) AS ch, generate_subscripts(string_split(html, ''), 1) AS i FROM pages) GROUP BY page_id"
SQL["rle8_size"] = (
    "WITH s AS (SELECT p_partkey, repeat(left(p_brand, 1), p_size) || p_name AS s FROM part), c AS (SELECT p_partkey, i, s[i] AS ch FROM (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS i FROM s)), "
    "m AS (SELECT *, CASE WHEN lag(ch) OVER w = ch THEN 0 ELSE 1 END AS n FROM c WINDOW w AS (PARTITION BY p_partkey ORDER BY i)), r AS (SELECT *, sum(n) OVER (PARTITION BY p_partkey ORDER BY i) AS run FROM m), "
    "l AS (SELECT p_partkey, run, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT *, CASE WHEN n = 1 AND lag(n) OVER w = 1 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY run)), "
    "g AS (SELECT p_partkey, n = 1 AS single, sum(new) OVER (PARTITION BY p_partkey ORDER BY run) AS stretch, n FROM k), t AS (SELECT p_partkey, stretch, single, sum(n) AS n FROM g GROUP BY 1, 2, 3), "
    "e AS (SELECT p_partkey, CAST(sum(CASE WHEN single THEN n + ceil(n / 128.0) ELSE 2 * ceil(n / 128.0) END) AS BIGINT) AS encoded FROM t GROUP BY 1) SELECT p_partkey, CAST(length(s) AS INTEGER) AS plain, encoded, encoded < length(s) AS smaller FROM s JOIN e USING (p_partkey)"
)
SQL["fn_irr"] = (
    "WITH RECURSIVE f AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice) AS x FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, list_concat([-list_sum(x) / 2], x) AS x FROM f), "
    "b AS (SELECT l_orderkey, x, CAST(-0.99 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS k FROM g UNION ALL SELECT l_orderkey, x, CASE WHEN v > 0 THEN m ELSE lo END, CASE WHEN v > 0 THEN hi ELSE m END, k + 1 FROM "
    "(SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(x, lambda y, i: y * pow(1 + (lo + hi) / 2, 1 - i))) AS v FROM b WHERE k < 60)) SELECT l_orderkey, round((lo + hi) / 2, 4) AS result FROM b WHERE k = 60"
)
