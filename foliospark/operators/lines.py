"""From recognised words to lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import WORD_CHARACTER, is_blank, let, trim

#: A gap of more than so many line heights parts two columns.
COLUMN_GAP = 2
LEAST_SIZE = 4
LEAST_CONFIDENCE = 10.0
WORD_LEVEL = "5"


def _number(text: Column) -> Column:
    """A number as the recogniser writes it; an empty field counts as 0, anything else is null."""
    return F.coalesce(text.try_cast("double"), F.when(is_blank(text), 0.0))


def words_from_tsv(pages: DataFrame, by: list[str], tsv: str = "tsv") -> DataFrame:
    """by, seq, block, par, line, text, x0, y0, x1, y1, conf of the words in the recogniser's tables, one table a row.

    Rows of other levels, with fewer than twelve columns, blank text, negative confidence or a box that isn't finite are
    passed over. Tabs within the text stay.
    """

    def word(c, seq):
        left, top, width, height, conf = (_number(F.get(c, F.lit(i))) for i in (6, 7, 8, 9, 10))
        text = trim(F.array_join(F.slice(c, F.lit(12), F.size(c) - 11), "\t"))
        box = F.struct(
            seq.alias("seq"), F.get(c, F.lit(2)).alias("block"), F.get(c, F.lit(3)).alias("par"), F.get(c, F.lit(4)).alias("line"), text.alias("text"),
            left.alias("x0"), top.alias("y0"), (left + width).alias("x1"), (top + height).alias("y1"), conf.alias("conf"),
        )
        return F.when((F.size(c) >= 12) & (F.get(c, F.lit(0)) == WORD_LEVEL), box)

    # parsed where the rows are made: what a filter says of cells that a row above works out is put in their place, and each of them
    # would take the row apart again
    parsed = F.transform(F.split(F.col(tsv), "\r?\n"), lambda row, i: let(F.split(row, "\t"), lambda c: word(c, i)))
    words = pages.select(*by, F.explode(F.filter(parsed, lambda w: w.isNotNull())).alias("__w")).select(*by, "__w.*")
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x0", "y0", "x1", "y1")]
    return words.where((F.col("text") != "") & (F.col("conf") >= 0) & finite[0] & finite[1] & finite[2] & finite[3])


def lines_from_words(words: DataFrame, by: list[str], line: list[str], gap: float = COLUMN_GAP, page: Sequence[str] = ()) -> DataFrame:
    """by, line, segment, first_seq, text, x, y, w, h, conf, page: the words of each line, parted at wide gaps.

    Words are taken from left to right, those at one place in the order of seq. A gap is wide if it is more than `gap` times
    the line's highest word; it is measured from the word before, not from the furthest edge so far. Confidence is the
    mean. Lines come in the order of first_seq, then segment. page: columns that all words of a page have in common.
    """
    keys = [*by, *line]
    order = Window.partitionBy(*keys).orderBy("x0", "seq")
    # in the same order, so that words are sorted once
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gapped = words.withColumns({"__h": F.max(F.col("y1") - F.col("y0")).over(whole), "__prev": F.lag("x1").over(order), "__first": F.min("seq").over(whole)})
    new = F.when(F.col("x0") - F.col("__prev") > gap * F.col("__h"), 1).otherwise(0)
    parted = gapped.withColumn("__new", new).withColumn("segment", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda w: w["text"]), " ")
    return parted.groupBy(*keys, "segment").agg(
        F.first("__first").alias("first_seq"), text.alias("text"), F.min("x0").alias("x"), F.min("y0").alias("y"),
        (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"), F.avg("conf").alias("conf"),
        *[F.first(c).alias(c) for c in page],
    )


def keep_line(text: Column, w: Column, h: Column, conf: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Not noise: a letter or digit, a size, and some confidence."""
    return text.rlike(f"[{WORD_CHARACTER}]") & (h >= LEAST_SIZE) & (w >= LEAST_SIZE) & (conf >= least)


def on_scanned_pages(lines: DataFrame, digital: DataFrame, by: list[str]) -> DataFrame:
    """lines of the pages that aren't digital; digital: by, digital. A page that it lacks counts as a scan."""
    return lines.join(digital.where("digital").select(*by), by, "left_anti")


def dense_ids(rows: DataFrame, by: list[str], order: list[str], to: str = "id") -> DataFrame:
    """rows with ids 0, 1, ... within by, in an order; to be called after any filter."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
