"""What the library leaves to others: models, recognition, page descriptions. Protocols, and stand-ins for tests.

Each seam is a function from DataFrame to DataFrame, so that an implementation chooses its own batches. Calls of models and
engines cost money and don't repeat exactly: an implementation should be marked non-deterministic and its rows be
checkpointed, as the plans here do, before anything reads them twice.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Correct(Protocol):
    """Boxes (page keys, chunk, id, x, y, w, h, current) to answers (page keys, chunk, answer, error), one for each chunk."""

    def __call__(self, boxes: DataFrame, by: list[str]) -> DataFrame: ...


class Transcribe(Protocol):
    """Pages (keys, pixels, width, height, stride) to answers (keys, answer, error)."""

    def __call__(self, pages: DataFrame, by: list[str]) -> DataFrame: ...


class ExtractMeta(Protocol):
    """First pages (keys, text, ...) to answers (keys, answer, error)."""

    def __call__(self, pages: DataFrame, by: list[str]) -> DataFrame: ...


class Recognise(Protocol):
    """Page images (keys, png, languages, dpi) to tables of words (keys, tsv)."""

    def __call__(self, pages: DataFrame, by: list[str]) -> DataFrame: ...


class OpenDocuments(Protocol):
    """Files (path, content) to pages (path, page, rotation, runs, size, visible characters, pixels); page null if unreadable."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class RemoteRecognition(Protocol):
    """Files (path, content) to files (path, content, error) that were recognised elsewhere: sent, awaited, fetched."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


def dictionary_corrector(fixes: dict[str, str]) -> Correct:
    """Answers every chunk with its boxes' texts, those in fixes replaced."""

    def correct(boxes: DataFrame, by: list[str]) -> DataFrame:
        table = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])
        text = F.coalesce(F.try_element_at(table, F.col("current")), F.col("current"))
        entries = F.array_sort(F.collect_list(F.struct(F.col("id"), text.alias("text"))))
        answer = F.to_json(F.struct(entries.alias("corrections")))
        return boxes.groupBy(*by, "chunk").agg(answer.alias("answer"), F.lit(None).cast("string").alias("error"))

    return correct


def fixed_answer(answer: str) -> Transcribe:
    """The same answer for every page."""

    def call(pages: DataFrame, by: list[str]) -> DataFrame:
        return pages.select(*by, F.lit(answer).alias("answer"), F.lit(None).cast("string").alias("error"))

    return call


def failing(message: str):
    """Every call fails."""

    def call(rows: DataFrame, by: list[str]) -> DataFrame:
        keys = [*by, "chunk"] if "chunk" in rows.columns else by
        return rows.select(*keys).distinct().withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(message)})

    return call


def retried(strict, loose, unsupported: str = "(?i)schema|structured"):
    """A call that is made again, once and without a schema, for the rows whose provider doesn't take one.

    Refusals, cut-off answers and all other errors stay errors. The first answers are checkpointed, so none is paid twice.
    """
    from foliospark.checkpoints import checkpointed

    def call(rows: DataFrame, by: list[str]) -> DataFrame:
        keys = [*by, "chunk"] if "chunk" in rows.columns else by
        first = checkpointed(strict(rows, by))
        again = F.coalesce(F.col("error").rlike(unsupported), F.lit(False))
        missed = first.where(again).select(*keys)
        return first.where(~again).unionByName(loose(rows.join(missed, keys, "left_semi"), by))

    return call


def per_row(function: Callable[..., str], needs: list[str], timeout_s: float = 180.0) -> Transcribe:
    """A seam that calls a Python function for each row with the values of `needs`, in tasks; it returns the answer.

    The function runs in a child process of the task's worker. What it raises, that it took longer than timeout_s, and that
    its process died are the row's error; other rows go on. At the limit the process is killed, so nothing of the call is left,
    and the next row gets a new one. The result counts as made anew each time, so it should be checkpointed, as the plans do.
    """

    def call(rows: DataFrame, by: list[str]) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from foliospark.child import Child, Died, TookTooLong

        schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
        arrow = to_arrow_schema(schema)

        def answered(child, values):
            try:
                return child.call(values, timeout_s), None
            except (TookTooLong, Died) as problem:
                return None, str(problem)
            except Exception as problem:  # whatever a model's client raises
                return None, f"{type(problem).__name__}: {problem}"

        def run(batches):
            with Child(function) as child:
                for batch in batches:
                    columns = [c.to_pylist() for c in batch.columns[len(by) :]]
                    told = [answered(child, values) for values in zip(*columns)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array([a for a, _ in told], pa.string()), pa.array([e for _, e in told], pa.string())], schema=arrow)

        return rows.select(*by, *needs).mapInArrow(run, schema)

    return call
