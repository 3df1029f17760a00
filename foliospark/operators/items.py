"""Items of a page: its text runs as read, with dense ids and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import box_per_mille
from foliospark.functions.text import is_blank
from foliospark.operators.lines import dense_ids


def text_items(runs: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """by, id, str, transform, width and the box x, y, w, h of the runs that aren't blank.

    runs: by, order, str, transform (six numbers), width, height, view (page to image), page_width, page_height. Runs whose
    matrix doesn't have six numbers are passed over. Ids are dense, from 0 on each page, after blank runs have gone.
    """
    seen = runs.where(~is_blank(F.col("str")) & (F.size("transform") == 6))
    boxed = seen.withColumn("__b", box_per_mille(F.col("transform"), F.col("width"), F.col("height"), F.col("view"), F.col("page_width"), F.col("page_height")))
    return dense_ids(boxed, by, [order]).select(*by, "id", "str", "transform", "width", "__b.*")
