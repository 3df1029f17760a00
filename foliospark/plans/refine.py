"""Refinement of text layers: passes of correction, transcription where there is nothing to correct, metadata, summary."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.checkpoints import checkpointed
from foliospark.functions.text import is_blank
from foliospark.operators import jsonio, reading, routing
from foliospark.operators.overlay import differs
from foliospark.seams import Correct

FEWEST_CHANGES = 5


@dataclass(frozen=True)
class RefineOptions:
    max_passes: int = 3
    boxes_a_call: int = 250
    lenient: bool = False

    @classmethod
    def of(cls, settings: dict[str, str]) -> RefineOptions:
        """From LLM_MAX_PASSES (1 to 5; 0 or no number: 3) and LLM_MAX_BOXES_PER_CALL (1 at least)."""

        def whole(name: str, default: int) -> int:
            try:
                return int(float(settings.get(name) or default))
            except ValueError:
                return 0

        return cls(max(1, min(5, whole("LLM_MAX_PASSES", 3) or 3)), max(1, whole("LLM_MAX_BOXES_PER_CALL", 250)))


def corrected(items: DataFrame, by: list[str], model: Correct, options: RefineOptions = RefineOptions()) -> tuple[DataFrame, DataFrame]:
    """items (by, id, text, ...) with `current`, and one row a page: by, passes, error, changes.

    Up to max_passes times the boxes that aren't blank go to the model in chunks, with their text as corrected so far. A page
    is done after a pass that changed fewer than FEWEST_CHANGES boxes, or that failed: in the first pass the page then fails
    and keeps its text, later it keeps what it has. changes counts the boxes that differ in the end. A pass reads, deals out
    and checkpoints only the items of pages that go on; those that are done are kept where their last pass left them. The
    answers are checkpointed too, so that calls are made once.
    """
    started = items.where(~is_blank(F.col("text"))).select(*by).distinct()
    first = items.withColumn("current", F.col("text"))
    idle, active = first.join(started, by, "left_anti"), first.join(started, by, "left_semi")
    order = Window.partitionBy(*by).orderBy("id")
    done, told = [idle], []
    for number in range(1, options.max_passes + 1):
        live = ~is_blank(F.col("current"))
        place = F.sum(live.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
        asked = active.withColumn("chunk", F.when(live, reading.chunk_of(place, options.boxes_a_call)))
        answers = model(asked.where("chunk is not null"), by).withColumn("d", jsonio.decode_corrections(F.coalesce("answer", F.lit(""))))
        answers = checkpointed(answers.select(*by, "chunk", F.coalesce(F.col("error"), F.col("d.error")).alias("failure"), F.col("d.value").alias("value")))
        # what a chunk after a failed one would have said was never asked; a page that fails in the first pass keeps its text
        broken = answers.where("failure is not null").groupBy(*by).agg(F.min("chunk").alias("at"), F.min_by("failure", "chunk").alias("said"))
        each = answers.where("failure is null").select(*by, "chunk", F.posexplode("value").alias("seq", "c")).select(*by, "chunk", "seq", "c.*")
        fixes = each.groupBy(*by, "chunk", "id").agg(F.max_by("text", "seq").alias("__new"))
        merged = asked.join(fixes, [*by, "chunk", "id"], "left").join(broken, by, "left")
        counts = F.col("at").isNull() | (F.lit(number > 1) & (F.col("chunk") < F.col("at")))
        merged = merged.withColumn("__changed", F.coalesce(F.col("__new").isNotNull() & counts & differs(F.col("__new"), F.col("current")), F.lit(False)))
        merged = checkpointed(merged.withColumn("current", F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("current"))).drop("__new", "at", "chunk"))
        goes_on = F.col("said").isNull() & (F.col("n") >= FEWEST_CHANGES) & F.lit(number < options.max_passes)
        pages = checkpointed(merged.groupBy(*by).agg(F.count_if("__changed").alias("n"), F.max("said").alias("said")).withColumn("open", goes_on))
        state = merged.drop("__changed", "said")
        error = F.col("said") if number == 1 else F.lit(None).cast("string")
        told.append(pages.where("not open").select(*by, F.lit(number).alias("passes"), error.alias("error")))
        done.append(state.join(pages.where("not open").select(*by), by, "left_semi"))
        if pages.where("open").isEmpty():
            break
        active = state.join(pages.where("open").select(*by), by, "left_semi")
    whole, closed = (functools.reduce(DataFrame.unionByName, parts) for parts in (done, told))
    real = whole.where(~is_blank(F.col("text")) | ~is_blank(F.col("current"))).groupBy(*by).agg(F.count_if(differs(F.col("current"), F.col("text"))).alias("changes"))
    return whole, closed.join(real, by, "left").select(*by, "passes", "error", F.coalesce("changes", F.lit(0)).alias("changes"))


def transcribed(pages: DataFrame, by: list[str], answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that may be written, and one row a page: by, legibility, lines, kept, error.

    answers: by, answer, error of the model for these pages.
    """
    lines, unread = jsonio.transcription(answers.where("error is null"), by)
    failures = answers.where("error is not null").select(*by, "error").unionByName(unread)
    counted = routing.dropped_lines(lines, by)
    decoded = answers.where("error is null").select(*by, jsonio.decode_transcription(F.col("answer")).alias("d"))
    legibility = decoded.where("d.error is null").select(*by, F.when(F.col("d.value.legibility").isin("good", "partial"), F.col("d.value.legibility")).otherwise("poor").alias("legibility"))
    told = pages.select(*by).join(legibility, by, "left").join(counted, by, "left").join(failures, by, "left")
    return routing.certain_lines(lines), told.select(*by, "legibility", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("kept", F.lit(0)).alias("kept"), "error")


def outcomes(pages: DataFrame, by: list[str], correction: DataFrame, transcription: DataFrame) -> DataFrame:
    """One row a page for the run's summary: attempted, failed, error, transcribed, changes.

    pages: by and items, the number of recognised items. A transcription without lines of a page without items is no edit.
    """
    joined = pages.join(correction.withColumnRenamed("error", "__c"), by, "left").join(transcription.withColumnRenamed("error", "__t"), by, "left")
    error = F.coalesce("__t", "__c")
    reread = F.col("lines").isNotNull() & F.col("__t").isNull() & ((F.col("kept") > 0) | (F.col("items") > 0))
    return joined.select(*by, (F.col("passes").isNotNull() | F.col("lines").isNotNull()).alias("attempted"), error.isNotNull().alias("failed"), error.alias("error"), reread.alias("transcribed"), F.coalesce("changes", F.lit(0)).alias("changes"))


def edits(entries: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, seq, text: the edits of pages, corrected entries and transcribed lines, as one table."""
    one = entries.select(*by, F.lit("entries").alias("kind"), F.col("id").alias("seq"), F.col("current").alias("text"))
    return one.unionByName(lines.select(*by, F.lit("lines").alias("kind"), "seq", "text"))


def rewritten(originals: DataFrame, changed: DataFrame, key: str, content: str = "content") -> DataFrame:
    """originals with the new content where there is one; a document without edits keeps its bytes."""
    fresh = changed.select(key, F.col(content).alias("__new"))
    return originals.join(fresh, key, "left").withColumn(content, F.coalesce("__new", content)).drop("__new")
