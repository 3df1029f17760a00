"""From recognised words to items of a page's text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import base_line, line_matrix, turned_back
from foliospark.operators.lines import dense_ids, keep_line, lines_from_words, on_scanned_pages, words_from_tsv

#: What is known of a page as a whole.
OF_A_PAGE = ("scale", "page_height", "skew", "straight_width", "straight_height", "image_width", "image_height")


def items_from_tsv(pages: DataFrame, by: list[str], digital: DataFrame | Column | None = None, least_confidence: float = 10.0) -> DataFrame:
    """by, id, text, transform, width of the lines on scanned pages.

    pages: by, tsv, scale (pixels a point), page_height (points), and for pages that were straightened skew (degrees), with
    the sizes of the straightened image (straight_width, straight_height) and of the original one (image_width,
    image_height); items lie on the page as it was. by: one row each, none for a null. digital: a table (by, digital) or a condition on
    pages; a page of which it isn't known counts as a scan. Ids are dense, after noise has gone.
    """
    scanned = pages.where(" and ".join(f"`{c}` is not null" for c in by))
    if isinstance(digital, Column):
        scanned = scanned.where(~F.coalesce(digital, F.lit(False)))
    elif digital is not None:
        scanned = on_scanned_pages(scanned, digital, by)
    # what is known of a page goes with its words, as a join with the pages would make their tables a second time
    known = [c for c in OF_A_PAGE if c in pages.columns]
    lines = lines_from_words(words_from_tsv(scanned, [*by, *known]), by, ["block", "par", "line"], page=known)
    placed = lines.where(keep_line(F.col("text"), F.col("w"), F.col("h"), F.col("conf"), least_confidence))

    def page_point(x, y):
        if "skew" in pages.columns:
            px, py = turned_back(x, y, (F.col("straight_width"), F.col("straight_height")), (F.col("image_width"), F.col("image_height")), F.coalesce("skew", F.lit(0.0)))
            turned = F.coalesce("skew", F.lit(0.0)) != 0
            x, y = F.when(turned, px).otherwise(x), F.when(turned, py).otherwise(y)
        return x / F.col("scale"), F.col("page_height") - y / F.col("scale")

    y = base_line(F.col("y"), F.col("h"))
    (x0, y0), (x1, y1) = page_point(F.col("x"), y), page_point(F.col("x") + F.col("w"), y)
    matrix, width = line_matrix(x0, y0, x1, y1, F.col("h"), F.col("scale"))
    numbered = dense_ids(placed.withColumns({"transform": matrix, "width": width}), by, ["first_seq", "segment"])
    return numbered.select(*by, "id", "text", "transform", "width")
