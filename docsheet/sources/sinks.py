"""Documents from paragraphs: plain text and HTML. A null paragraph is an empty one, a null style the normal one. A document is an ordered group of bounded size: paragraphs are rendered as rows and joined once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _text(para: str) -> Column:
    return F.coalesce(F.col(para), F.lit(""))


def _joined(paras: DataFrame, by: list[str], order: str, rendered: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), rendered.alias("t"))))
    return paras.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("body"))


def with_regions(body: DataFrame, by: list[str], order: str, header: DataFrame | None = None, footer: DataFrame | None = None) -> DataFrame:
    """Paragraphs of a document's header, body and footer as one ordered set for any writer: ``order`` becomes (region, order)."""
    regions = [(k, df) for k, df in enumerate((header, body, footer)) if df is not None]
    placed = [df.withColumn(order, F.struct(F.lit(k).alias("region"), F.col(order).alias("at"))) for k, df in regions]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def to_text(paras: DataFrame, by: list[str], order: str, para: str = "para", bullet: Column | None = None) -> DataFrame:
    """(by, body): each paragraph and a line feed; a bullet and three spaces before it where ``bullet`` isn't null."""
    mark = F.concat(bullet, F.lit("   ")) if bullet is not None else F.lit(None)
    return _joined(paras, by, order, F.concat(F.coalesce(mark, F.lit("")), T.render_text(_text(para)), F.lit("\n")))


def to_html4(paras: DataFrame, by: list[str], order: str, para: str = "para") -> DataFrame:
    return _wrapped(_joined(paras, by, order, F.concat(F.lit("<P>"), T.render_html(_text(para), "<BR>"), F.lit("</P>\n"))), by, "<HTML><BODY>\n", "</BODY></HTML>\n")


def to_xhtml(paras: DataFrame, by: list[str], order: str, style: Column, para: str = "para") -> DataFrame:
    one = F.concat(F.lit('<p class="style-'), T.css_class(style), F.lit('">'), T.render_html(_text(para)), F.lit("</p>\n"))
    return _wrapped(_joined(paras, by, order, one), by, '<html xmlns="http://www.w3.org/1999/xhtml"><body>\n', "</body></html>\n")


def to_html5(paras: DataFrame, by: list[str], order: str, style: Column, para: str = "para") -> DataFrame:
    """As XHTML, but styles named like headings become headings."""
    level = T.heading_level(F.coalesce(style, F.lit("")))
    tag = F.when(level.isNotNull(), F.concat(F.lit("h"), level.cast("string"))).otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(">"), T.render_html(_text(para)), F.lit("</"), tag, F.lit(">\n"))
    return _wrapped(_joined(paras, by, order, one), by, "<!DOCTYPE html>\n<html><body>\n", "</body></html>\n")


def _wrapped(bodies: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    return bodies.select(*by, F.concat(F.lit(before), "body", F.lit(after)).alias("body"))


def css_difference(own: dict[str, Column], base: dict[str, Column]) -> Column:
    """CSS of the attributes that differ from the base style, in the order given."""
    return F.concat_ws("", *[F.when(~v.eqNullSafe(base[k]), F.concat(F.lit(f"{k}:"), v.cast("string"), F.lit(";"))) for k, v in own.items()])


#: Writers by lower-case name: the way to add one is to put it here.
WRITERS: dict[str, Callable[..., DataFrame]] = {"text": to_text, "html4": to_html4, "xhtml": to_xhtml, "html5": to_html5}


def writer(name: str) -> Callable[..., DataFrame]:
    """The writer of this name, in either case."""
    if name.lower() not in WRITERS:
        raise ValueError(f"no writer is called {name}; there are {', '.join(WRITERS)}")
    return WRITERS[name.lower()]
