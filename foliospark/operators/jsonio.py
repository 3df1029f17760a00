"""Strict decoding of what models answer, tolerant only about text around the JSON.

The engine's own JSON functions convert types and accept trailing text, where an answer must be refused; so the answer is
parsed by a small function, batch by batch, and everything after that is columns.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.geometry import clamp, rounded
from foliospark.functions.text import collapse, trim

CORRECTIONS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())])
META = T.StructType([T.StructField(f, T.StringType()) for f in ("date", "correspondent", "summary", "reference", "confidence")])
LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("certain", T.BooleanType())])
TRANSCRIPTION = T.StructType([T.StructField("legibility", T.StringType()), T.StructField("lines", T.ArrayType(LINE))])
NO_JSON, NO_LIST = "no JSON", "no list"


def _answer(value: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("value", value), T.StructField("error", T.StringType())])


def _refuse(constant: str):
    raise ValueError(constant)


def loads(text: str | None):
    """The JSON value of a text, or of what lies between its first { and last }; raises ValueError if neither is one."""
    text = text or ""
    try:
        return json.loads(text, parse_constant=_refuse)
    except ValueError:
        start, end = text.find("{"), text.rfind("}")
        if start < 0 or end <= start:
            raise ValueError(NO_JSON) from None
        return json.loads(text[start : end + 1], parse_constant=_refuse)


def _whole(value) -> int | None:
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")) or value != int(value):
        return None
    return int(value) if abs(value) < 1 << 31 else None


def _decode(answers: pd.Series, shape) -> pd.DataFrame:
    rows = []
    for answer in answers:
        try:
            rows.append((shape(loads(answer)), None))
        except (ValueError, RecursionError) as error:
            rows.append((None, NO_LIST if str(error) == NO_LIST else NO_JSON))
    return pd.DataFrame(rows, columns=["value", "error"])


def _list_of(data, name: str) -> list:
    found = data.get(name) if isinstance(data, dict) else None
    if not isinstance(found, list):
        raise ValueError(NO_LIST)
    return found


@F.pandas_udf(_answer(T.ArrayType(CORRECTIONS)))
def decode_corrections(answers: pd.Series) -> pd.DataFrame:
    def shape(data):
        pairs = [(_whole(c.get("id")), c.get("text")) for c in _list_of(data, "corrections") if isinstance(c, dict)]
        return [{"id": i, "text": t} for i, t in pairs if i is not None and isinstance(t, str)]

    return _decode(answers, shape)


@F.pandas_udf(_answer(T.MapType(T.StringType(), T.StringType())))
def decode_strings(answers: pd.Series) -> pd.DataFrame:
    """The string members of an object; members of other types are left out."""
    return _decode(answers, lambda data: {k: v for k, v in data.items() if isinstance(v, str)} if isinstance(data, dict) else {})


@F.pandas_udf(_answer(TRANSCRIPTION))
def decode_transcription(answers: pd.Series) -> pd.DataFrame:
    def coordinate(v):
        if isinstance(v, bool):
            return float(v)
        try:
            return float(v.strip() or 0) if isinstance(v, str) else float(v) if isinstance(v, int | float) else 0.0
        except ValueError:
            return 0.0

    def shape(data):
        lines = [{"text": c.get("text") if isinstance(c.get("text"), str) else "", "x": coordinate(c.get("x")), "y": coordinate(c.get("y")), "certain": c.get("certain") is True} for c in _list_of(data, "lines") if isinstance(c, dict)]
        legibility = data.get("legibility")
        return {"legibility": legibility if isinstance(legibility, str) else "", "lines": lines}

    return _decode(answers, shape)


def corrections(answers: DataFrame, boxes: DataFrame, by: list[str], answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """by, id, text, seq of the corrections of boxes that exist, the last of each; and by, error of answers without a list."""
    from foliospark.operators.overlay import known_only, last_of_each

    decoded = answers.select(*by, decode_corrections(F.col(answer)).alias("d"))
    each = decoded.select(*by, F.posexplode("d.value").alias("seq", "c")).select(*by, "seq", "c.*")
    return last_of_each(known_only(each, boxes, by), by), decoded.where("d.error is not null").select(*by, F.col("d.error").alias("error"))


def metadata(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with the fields of META and error: what isn't a string is empty, an unknown confidence is low."""
    decoded = answers.withColumn("__d", decode_strings(F.col(answer)))

    def field(name):
        return F.coalesce(trim(F.try_element_at("__d.value", F.lit(name))), F.lit(""))

    raw = F.try_element_at("__d.value", F.lit("confidence"))
    fields = {n: field(n) for n in META.names[:-1]} | {"confidence": F.when(raw.isin("high", "medium", "low"), raw).otherwise("low")}
    return decoded.withColumns(fields | {"error": F.col("__d.error")}).drop("__d")


def per_mille(value: Column) -> Column:
    """A coordinate as a whole number from 0 to 1000; 0 for what isn't finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return rounded(clamp(F.when(finite, value).otherwise(0.0), 0.0, 1000.0))


def transcription(answers: DataFrame, by: list[str], answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """by, seq, legibility, text, x, y, certain of the lines that aren't blank (order: y, then seq); and by, error."""
    decoded = answers.select(*by, decode_transcription(F.col(answer)).alias("d"))
    legibility = F.when(F.col("d.value.legibility").isin("good", "partial"), F.col("d.value.legibility")).otherwise("poor")
    each = decoded.select(*by, legibility.alias("legibility"), F.posexplode("d.value.lines").alias("seq", "l"))
    lines = each.select(*by, "seq", "legibility", collapse(F.col("l.text")).alias("text"), per_mille(F.col("l.x")).alias("x"), per_mille(F.col("l.y")).alias("y"), F.col("l.certain").alias("certain"))
    return lines.where("text <> ''"), decoded.where("d.error is not null").select(*by, F.col("d.error").alias("error"))
