"""Layouts as CSS: differences from a base, the rule for bullets, style sheets, and paragraphs of styled runs.

A character layout is a struct of color and back_color ("#rrggbb"), font_size (points), italic, bold, super_sub (super, sub or
null), underline, strikethrough and family; a paragraph layout one of back_color, indent_left, indent_right and indent_first (cm), justify,
bullet (on or off), space_above and space_below (points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHARACTER = "struct<color:string,back_color:string,font_size:double,italic:boolean,bold:boolean,super_sub:string,underline:boolean,strikethrough:boolean,family:string>"
PARAGRAPH = "struct<back_color:string,indent_left:double,indent_right:double,indent_first:double,justify:string,bullet:boolean,space_above:double,space_below:double>"


def _rule(name: str, own: Column, base: Column | None, shown: Column) -> Column:
    """``name:shown;`` where ``own`` differs from ``base``; always without a base. A null field has no rule."""
    rule = F.concat(F.lit(f"{name}:"), T.attribute(shown), F.lit(";"))
    return F.coalesce(rule if base is None else F.when(~own.eqNullSafe(base), rule), F.lit(""))


def _number(x: Column, unit: str) -> Column:
    return F.concat(F.format_string("%.2f", x.cast("double")), F.lit(unit))


def character_css(own: Column, base: Column | None = None) -> Column:
    """Rules of the attributes in which a character layout differs from ``base``; a null layout has none."""
    of = lambda *names: (F.struct(*[own[n] for n in names]), None if base is None else F.struct(*[base[n] for n in names]))
    decoration = F.when(own["underline"], "underline").when(own["strikethrough"], "line-through").otherwise("none")
    return F.when(own.isNull(), "").otherwise(F.concat(
        _rule("color", *of("color"), own["color"]), _rule("background-color", *of("back_color"), own["back_color"]), _rule("font-size", *of("font_size"), _number(own["font_size"], "pt")),
        _rule("font-style", *of("italic"), F.when(own["italic"], "italic").otherwise("normal")), _rule("font-weight", *of("bold"), F.when(own["bold"], "bold").otherwise("normal")),
        _rule("vertical-align", *of("super_sub"), F.coalesce(own["super_sub"], F.lit("baseline"))), _rule("text-decoration", *of("underline", "strikethrough"), decoration), _rule("font-family", *of("family"), own["family"]),
    ))


def padding(layout: Column) -> Column:
    """(left, indent): with a bullet the smaller of both indents and none for the first line."""
    on = layout["bullet"]
    return F.struct(F.when(on, F.least(layout["indent_left"], layout["indent_first"])).otherwise(layout["indent_left"]).alias("left"), F.when(on, 0.0).otherwise(layout["indent_first"]).alias("indent"))


def paragraph_css(own: Column, base: Column | None = None) -> Column:
    """Rules of the attributes in which a paragraph layout differs from ``base``; a null layout has none."""
    of = lambda name: (own[name], None if base is None else base[name])
    new, old = padding(own), None if base is None else padding(base)
    padded = lambda name: (new[name], None if old is None else old[name])
    return F.when(own.isNull(), "").otherwise(F.concat(
        _rule("background-color", *of("back_color"), own["back_color"]), _rule("padding-left", *padded("left"), _number(new["left"], "cm")), _rule("padding-right", *of("indent_right"), _number(own["indent_right"], "cm")),
        _rule("text-indent", *padded("indent"), _number(new["indent"], "cm")), _rule("text-align", *of("justify"), own["justify"]),
        _rule("padding-top", *of("space_above"), _number(own["space_above"], "pt")), _rule("padding-bottom", *of("space_below"), _number(own["space_below"], "pt")),
    ))


def style_sheet(styles: DataFrame, by: list[str], number: str, base_paragraph: Column, base_character: Column) -> DataFrame:
    """(by, css) of styles (name, paragraph, character), a few to a document: the body's rules, then one rule per style by ``number`` with what differs from the base."""
    body = F.concat(F.lit("body {"), paragraph_css(base_paragraph), character_css(base_character), F.lit("}\n"))
    rule = F.concat(F.lit("*.style-"), T.css_class(F.col("name")), F.lit(" {"), paragraph_css(F.col("paragraph"), base_paragraph), character_css(F.col("character"), base_character), F.lit("}\n"))
    rules = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), rule.alias("r")))), lambda x: x["r"]), "")
    return styles.groupBy(*by).agg(rules.alias("_rules")).select(*by, F.concat(F.lit('<style type="text/css">\n'), body, "_rules", F.lit("</style>\n")).alias("css"))


def styled_paragraphs(runs: DataFrame, by: list[str], paragraph: str, order: str, css: Column, text: str = "text") -> DataFrame:
    """(by, paragraph, html): the runs of each paragraph in order, those with rules of their own in a span; null rules are none, a null text is empty."""
    shown = T.render_html(F.coalesce(F.col(text), F.lit("")))
    one = F.when(F.coalesce(css, F.lit("")) == "", shown).otherwise(F.concat(F.lit('<span style="'), css, F.lit('">'), shown, F.lit("</span>")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))), lambda x: x["t"]), "")
    return runs.groupBy(*by, paragraph).agg(joined.alias("html"))


def styled_document(paragraphs: DataFrame, sheets: DataFrame, by: list[str], paragraph: str, style: Column, headings: bool = False) -> DataFrame:
    """(by, body): XHTML of paragraphs (html) under the style sheet of their document; with ``headings`` HTML5, where styles named like headings become headings."""
    level = T.heading_level(F.coalesce(style, F.lit(""))) if headings else F.lit(None).cast("int")
    tag = F.when(level.isNotNull(), F.concat(F.lit("h"), level.cast("string"))).otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(' class="style-'), T.css_class(style), F.lit('">'), F.coalesce("html", F.lit("")), F.lit("</"), tag, F.lit(">\n"))
    bodies = paragraphs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(paragraph).alias("o"), one.alias("t")))), lambda x: x["t"]), "").alias("_b"))
    start = '<!DOCTYPE html>\n<html><head>\n' if headings else '<html xmlns="http://www.w3.org/1999/xhtml"><head>\n'
    whole = F.concat(F.lit(start), F.coalesce("css", F.lit("")), F.lit("</head><body>\n"), "_b", F.lit("</body></html>\n"))
    return bodies.join(sheets, by, "left").select(*by, whole.alias("body"))
