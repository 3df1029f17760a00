"""The log of a run: counters that are gathered while rows pass to their sink, and the records made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.sinks import log_records


class RunLog:
    """Counters of the steps of a run. Nothing is read for them: each step's are worked out as its rows pass, in the one action
    that writes them, and can be had once that has ended.

    A failed task's rows count once, with the attempt that counts; what a plan works out twice is counted where it is read last.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.steps: list[tuple[str, Observation]] = []

    def step(self, rows: DataFrame, message: str, **counters: Column) -> DataFrame:
        """rows, observed: counters are aggregates by name. A counter named `warnings` makes the record a warning if it isn't zero."""
        seen = Observation()
        self.steps.append((message, seen))
        return rows.observe(seen, *[column.alias(name) for name, column in counters.items()])

    def records(self, time: str | None = None, threshold: str = "info") -> DataFrame:
        """A record for each step, in their order: time, level, msg, fields, line, stream; see log_records()."""
        rows = []
        for message, seen in self.steps:
            found = seen.get
            level = "warn" if found.get("warnings") else "info"
            rows.append((time, level, message, {name: None if value is None else str(value) for name, value in found.items()}))
        events = self.spark.createDataFrame(rows, "time string, level string, msg string, fields map<string,string>")
        return log_records(events, threshold)


def layer_counters(text: str = "text", junk: str = "junk") -> dict[str, Column]:
    """The counters of text layers: documents, characters, the longest, those without text, and as warnings the junk ones."""
    length = F.coalesce(F.length(text), F.lit(0))
    return {"documents": F.count(F.lit(1)), "chars": F.sum(length), "longest": F.max(length), "empty": F.count_if(length == 0), "warnings": F.count_if(F.col(junk))}
