"""Text of pages in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank

#: A change of the base line by more than this share of a line's height starts a new line.
NEW_LINE = 0.5
DEFAULT_LINE_HEIGHT = 10.0
BOXES_A_CALL = 250
# The plain-text export's page header and its words for a page without text
PAGE_HEADER = "=== Seite %d ==="
NO_TEXT = "(kein Text gefunden)"


def _joined(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "")


def page_text(items: DataFrame, by: list[str], order: str = "id", text: str = "text", y: str = "y", line_height: str = "line_height") -> DataFrame:
    """by, text: the items that aren't blank, in order; a new line where the base line moves, else a space between."""
    seen = items.where(~is_blank(F.col(text)))
    before = F.lag(y).over(Window.partitionBy(*by).orderBy(order))
    tall = F.abs(F.col(line_height))
    moved = F.abs(F.col(y) - F.col("__y")) > F.when(tall > 0, tall).otherwise(DEFAULT_LINE_HEIGHT) * NEW_LINE
    parted = seen.withColumn("__y", before).withColumn("__t", F.concat(F.when(F.col("__y").isNull(), "").when(moved, "\n").otherwise(" "), F.col(text)))
    return parted.groupBy(*by).agg(_joined(order, "__t").alias(text))


def plain_text(runs: DataFrame, by: list[str], page: str = "page", order: str = "id", text: str = "text", ends_line: str = "ends_line") -> DataFrame:
    """by, text: the export of whole documents: runs as they follow, line ends where they have one, a header a page."""
    ended = runs.withColumn("__t", F.concat(F.coalesce(text, F.lit("")), F.when(F.col(ends_line), "\n").otherwise("")))
    pages = ended.groupBy(*by, page).agg(_joined(order, "__t").alias("__p"))
    headed = pages.withColumn("__p", F.concat(F.format_string(PAGE_HEADER, F.col(page)), F.lit("\n"), F.when(is_blank(F.col("__p")), NO_TEXT).otherwise(F.col("__p"))))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(page, "__p"))), lambda r: r["__p"])
    return headed.groupBy(*by).agg(F.array_join(parts, "\n\n").alias(text))


def chunk_of(position: Column, size: int = BOXES_A_CALL) -> Column:
    """Number of the fixed-size chunk that a position (from 0) falls into."""
    return F.floor(position / size).cast("int")


def line_boxes(text: Column) -> Column:
    """Array of structs id, text: the lines that aren't blank, with ids 0, 1, ..."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~is_blank(line))
    return F.transform(lines, lambda line, i: F.struct(i.alias("id"), line.alias("text")))


def text_lines(documents: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, id, text: the lines that aren't blank, with ids 0, 1, ...; each text is cut within its row."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: ~is_blank(line))
    return documents.select(*by, F.posexplode(lines).alias("id", "text"))
