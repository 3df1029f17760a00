"""Layout of transcribed lines on a page, and the operators that write them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import clamp
from foliospark.functions.text import has_text, number, without_controls
from foliospark.operators.quality import percentile_by_index

DEFAULT_GAP = 14
LINE_HEIGHTS = (6, 40)
FONT_SIZES = (5.0, 24.0)
MARGINS = (0.02, 0.9)


def fixed_width(text: Column, size: Column) -> Column:
    """Stand-in for a font's measure: every character six tenths of the size."""
    return F.length(text) * size * 0.6


def line_layout(lines: DataFrame, by: list[str], width: str = "page_width", height: str = "page_height", measure: Callable[[Column, Column], Column] = fixed_width) -> DataFrame:
    """by, seq, text, x, baseline, size, scale_x of lines (by, seq, text, x, y in thousandths, page size).

    Lines go from the top down, those at one height in the order of seq. The font follows from the upper median of the gaps
    of more than a thousandth; a line that would leave the page is squeezed.
    """
    order = Window.partitionBy(*by).orderBy("y", "seq")
    gaps = lines.select(*by, (F.col("y") - F.lag("y").over(order)).alias("gap")).where("gap > 1")
    median = percentile_by_index(gaps, by, "gap", 0.5, "__median")
    tall = clamp(F.coalesce(F.col("__median"), F.lit(DEFAULT_GAP)), *LINE_HEIGHTS)
    sized = lines.join(median, by, "left").withColumn("size", clamp(tall / 1000 * F.col(height) * 0.8, *FONT_SIZES))
    placed = sized.withColumn("__x", clamp(F.col("x") / 1000, *MARGINS) * F.col(width))
    natural = measure(F.col("text"), F.col("size"))
    squeeze = F.when(natural > 0, F.least(F.lit(1.0), F.try_divide(F.col(width) * 0.98 - F.col("__x"), natural))).otherwise(1.0)
    base = F.greatest(F.col("size"), F.col(height) - F.col("y") / 1000 * F.col(height) - F.col("size") * 0.9)
    return placed.select(*by, "seq", "y", "text", F.col("__x").alias("x"), base.alias("baseline"), "size", squeeze.alias("scale_x"))


def line_operators(text: Column, x: Column, baseline: Column, size: Column, scale_x: Column, font: str = "/F1") -> Column:
    """Page-description operators that write an invisible line; null for a line without text."""
    head = F.concat_ws("\n", F.concat(F.lit(f"{font} "), number(size), F.lit(" Tf")), F.concat_ws(" ", number(scale_x), F.lit("0 0 1"), number(x), number(baseline), F.lit("Tm")))
    return F.when(has_text(text), F.concat_ws("\n", head, _shown(text)))


def run_operators(text: Column, matrix: Column, stretch: Column) -> Column:
    """Operators that write an invisible run into its box; null where the text is empty or no stretch is known."""
    parts = [F.get(matrix, F.lit(i)) * (stretch if i < 2 else 1) for i in range(6)]
    # as elements of an array each is worked out once, however often number() names it
    head = F.concat_ws(" ", F.array_join(F.transform(F.array(*parts), number), " "), F.lit("Tm"))
    return F.when(has_text(text) & stretch.isNotNull(), F.concat_ws("\n", head, _shown(text)))


def _shown(text: Column) -> Column:
    return F.concat(F.lit("("), F.regexp_replace(without_controls(text), "([\\\\()])", "\\\\$1"), F.lit(") Tj"))


def text_layer(operators: DataFrame, by: list[str], order: str = "seq", ops: str = "ops", head: str = "") -> DataFrame:
    """by, layer: the operators of a page in order, as one invisible text object; none for a page without any."""
    # not by a filter on rows, which would work out the operators a second time
    kept = F.filter(F.collect_list(F.struct(order, ops)), lambda r: r[ops].isNotNull())
    pages = operators.groupBy(*by).agg(F.transform(F.array_sort(kept), lambda r: r[ops]).alias("__ops")).where(F.size("__ops") > 0)
    return pages.select(*by, F.concat(F.lit("q\nBT\n3 Tr\n" + head), F.array_join("__ops", "\n"), F.lit("\nET\nQ")).alias("layer"))


def straighten_operators(matrix: Column) -> Column:
    """Struct open, close: what goes before and after a page's content to turn it, without coding any image anew."""
    placed = F.concat_ws(" ", *[number(F.get(matrix, F.lit(i))) for i in range(6)], F.lit("cm"))
    return F.struct(F.concat(F.lit("q\n"), placed, F.lit("\n")).alias("open"), F.lit("\nQ\n").alias("close"))
