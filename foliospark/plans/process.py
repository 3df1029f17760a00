"""A whole refinement run, from pages and their items to edits, metadata and the summary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.checkpoints import checkpointed
from foliospark.operators import filing, jsonio, pixels, quality, reading, routing
from foliospark.plans import refine
from foliospark.seams import Correct, ExtractMeta, Transcribe


@dataclass(frozen=True)
class Models:
    """The calls of a run; what isn't given isn't done."""

    correct: Correct | None = None
    transcribe: Transcribe | None = None
    extract: ExtractMeta | None = None


@dataclass(frozen=True)
class Result:
    """edits: doc, page, kind, seq, text. outcomes: one row a page. summary: one row a document. meta: filed documents."""

    edits: DataFrame
    outcomes: DataFrame
    summary: DataFrame
    meta: DataFrame | None


BY = ["doc", "page"]


def refined(pages: DataFrame, items: DataFrame, models: Models, options: refine.RefineOptions = refine.RefineOptions(), now: datetime | None = None, ink=pixels.with_ink) -> Result:
    """Refines all pages.

    pages: doc, page, rotation, visible_chars, and pixels, width, height, stride. items: doc, page, id, text, y, line_height.

    Digital pages stay as they are. Pages whose layer is junk, or that have ink but no items, are transcribed; the others'
    boxes are corrected in passes. Metadata are read from the first page, with the text as it then is, and trusted less if
    that page was hard to read. A model that fails on a page fails that page only.
    """
    layers = quality.layer_quality(items, BY).withColumn("junk", quality.is_junk(F.col("chars"), F.col("plausible_share"))).select(*BY, "junk")
    counts = items.groupBy(*BY).agg(F.count("*").alias("items"))
    judged = pages.join(layers, BY, "left").join(counts, BY, "left").withColumns({
        "junk": F.coalesce("junk", F.lit(False)), "items": F.coalesce("items", F.lit(0)), "digital": quality.is_digital(F.col("visible_chars")),
    })
    wanted = F.lit(models.transcribe is not None and models.correct is not None)
    judged = judged.withColumn("can_transcribe", routing.can_transcribe(F.col("digital"), wanted, wanted, F.col("rotation")))
    routes = checkpointed(routing.needs_transcription(judged, ink).select(*BY, "digital", "items", "fallback"))
    reread = pages.join(routes.where("fallback").select(*BY), BY, "left_semi")
    nothing = reread.limit(0).select(*BY).withColumns({"answer": F.lit("").cast("string"), "error": F.lit("").cast("string")})
    answers = checkpointed(models.transcribe(reread, BY)) if models.transcribe and models.correct else nothing
    lines, read = refine.transcribed(answers, BY, answers)
    open_items = items.join(routes.where("not fallback and not digital").select(*BY), BY, "left_semi")
    if models.correct:
        state, told = refine.corrected(open_items, BY, models.correct, options)
    else:
        state, told = open_items.withColumn("current", F.col("text")), open_items.limit(0).select(*BY).withColumns({"passes": F.lit(0), "error": F.lit("").cast("string"), "changes": F.lit(0)})
    outcomes = checkpointed(refine.outcomes(routes, BY, told, read))
    changed = state.join(outcomes.where("not failed and changes > 0").select(*BY), BY, "left_semi")
    edits = refine.edits(changed, lines, BY)
    meta = _metadata(items, state, lines, read, models, now) if models.extract and now else None
    return Result(edits, outcomes, routing.run_summary(outcomes, ["doc"], options.lenient), meta)


def _metadata(items: DataFrame, state: DataFrame, lines: DataFrame, read: DataFrame, models: Models, now: datetime) -> DataFrame:
    own = items.where("page = 1").join(state.select(*BY, "id", "current"), [*BY, "id"], "left").withColumn("text", F.coalesce("current", "text"))
    texts = reading.page_text(own.drop("current"), BY)
    first = read.where("page = 1 and error is null").select(*BY, "legibility")
    again = lines.where("page = 1").groupBy(*BY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "seq", "text"))), lambda x: x["text"]), "\n").alias("lines"))
    told = items.where("page = 1").select(*BY).unionByName(first.select(*BY)).distinct().join(texts, BY, "left").join(first, BY, "left").join(again, BY, "left")
    asked = told.select(*BY, "legibility", F.when(F.col("legibility").isNotNull(), F.coalesce("lines", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    answered = checkpointed(models.extract(asked, BY)).join(asked.select(*BY, "legibility"), BY)
    decoded = jsonio.metadata(answered.where("error is null").drop("error"))
    return filing.filed(filing.downgraded(decoded.where("error is null")), now)


__all__ = ["BY", "Models", "Result", "refined"]
