"""Parts of requests to models: lists of boxes and names, the text that goes along, and the shape of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import json_quoted, trim

MOST_CHARACTERS = 6000
NOBODY = "- (unknown)"
NO_TEXT = "(no text recognised)"


def box_line(box: Column, x: Column, y: Column, w: Column, h: Column, text: Column) -> Column:
    """Id, place and quoted text of a box, with tabs between."""
    return F.concat_ws("\t", box.cast("string"), F.concat_ws(",", *[c.cast("string") for c in (x, y, w, h)]), json_quoted(text))


def box_lists(boxes: DataFrame, by: list[str]) -> DataFrame:
    """by, listed: the lines of a call's boxes in the order of their ids."""
    line = box_line(*[F.col(c) for c in ("id", "x", "y", "w", "h", "text")])
    return boxes.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda b: b["line"]), "\n").alias("listed"))


def recipients(names: Column) -> Column:
    """One line for each own name; a line that says so if there are none."""
    return F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n")).otherwise(NOBODY)


def page_excerpt(text: Column) -> Column:
    """The trimmed text of a page, cut to what a request may hold."""
    cut = F.substring(trim(F.coalesce(text, F.lit(""))), 1, MOST_CHARACTERS)
    return F.when(cut == "", NO_TEXT).otherwise(cut)


def json_schema(kind: T.DataType, choices: dict[str, tuple[str, ...]] | None = None) -> dict:
    """Strict JSON Schema of a type: every member is required and no other allowed; choices by member name."""
    if isinstance(kind, T.StructType):
        members = {f.name: json_schema(f.dataType, choices) | ({"enum": list(choices[f.name])} if choices and f.name in choices else {}) for f in kind.fields}
        return {"type": "object", "properties": members, "required": kind.names, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, choices)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    return {"type": "string" if isinstance(kind, T.StringType) else "integer"}


def response_schemas() -> dict[str, dict]:
    """What the three kinds of calls are asked to answer."""
    from foliospark.operators import jsonio
    from foliospark.operators.routing import CONFIDENCES, LEGIBILITIES

    return {
        "corrections": json_schema(T.StructType([T.StructField("corrections", T.ArrayType(jsonio.CORRECTIONS))])),
        "metadata": json_schema(jsonio.META, {"confidence": CONFIDENCES}),
        "transcription": json_schema(jsonio.TRANSCRIPTION, {"legibility": LEGIBILITIES}),
    }
