"""Documents opened page by page, as a table function: `document_pages`, for SQL and for DataFrames.

The function takes the runs of documents as a table that it asks Spark to partition by document and to order, so that each document is
opened once, by one call, whatever the number of its runs; of these it holds those of the page it is at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NEEDED = ("doc", "page", "seq", "text")


class _DocumentPages:
    """doc, page (from 1 without gaps), source_page, runs, chars, text: a row for each page that has runs, its texts joined by spaces."""

    def __init__(self):
        self.doc = self.page = None
        self.number, self.first_only = 0, False
        self.texts: list[str] = []

    @staticmethod
    def analyze(runs: AnalyzeArgument, first_only: AnalyzeArgument) -> AnalyzeResult:
        if not runs.isTable or not isinstance(runs.dataType, StructType):
            raise ValueError("the first argument must be a table")
        kinds = {f.name: f.dataType for f in runs.dataType}
        if missing := [c for c in NEEDED if c not in kinds]:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        schema = StructType().add("doc", kinds["doc"]).add("page", IntegerType()).add("source_page", kinds["page"]).add("runs", IntegerType()).add("chars", IntegerType()).add("text", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("page"), OrderingColumn("seq")])

    def eval(self, run, first_only: bool) -> Iterator[tuple]:
        if self.page != run["page"] or self.doc is None:
            yield from self._ended()
            self.first_only = first_only
            self.doc, self.page, self.number, self.texts = (run["doc"],), run["page"], self.number + 1, []
        self.texts.append(run["text"] or "")

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended()

    def _ended(self) -> Iterator[tuple]:
        if self.doc is not None and not (self.first_only and self.number > 1):
            text = " ".join(t for t in self.texts if t)
            yield (self.doc[0], self.number, self.page, len(self.texts), len(text), text)


document_pages = F.udtf(_DocumentPages)


def register(spark: SparkSession) -> None:
    """Makes document_pages(TABLE(runs), first_only) known to SQL."""
    spark.udtf.register("document_pages", document_pages)


def pages(runs: DataFrame, first_only: bool = False) -> DataFrame:
    """document_pages of runs (doc, page, seq, text); first_only: the first page of each document, which metadata are read from.

    A null document is one of its own; a null page comes first; a null text counts as a run without characters.
    """
    return document_pages(runs.select(*NEEDED).asTable(), F.lit(first_only))
