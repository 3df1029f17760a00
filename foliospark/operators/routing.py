"""Admission, routing and summaries of documents and runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINES = ("adobe", "tesseract")
TYPES = ("exact", "deskew")
PROVIDERS = ("anthropic", "openai")
#: Name of the variable that holds a provider's key.
KEY_NAMES = {"anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY"}
CONFIDENCES = ("high", "medium", "low")
LEGIBILITIES = ("good", "partial", "poor")


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what}: {value!r} is none of {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class EngineConfig:
    engine: str = "adobe"
    fallback: str | None = None

    @classmethod
    def of(cls, settings: dict[str, str]) -> EngineConfig:
        """From OCR_ENGINE and OCR_FALLBACK, in any case; a fallback to the main engine itself is none."""
        engine = one_of((settings.get("OCR_ENGINE") or "adobe").strip().lower() or "adobe", ENGINES, "OCR_ENGINE")
        fallback = (settings.get("OCR_FALLBACK") or "").strip().lower()
        if fallback and fallback != "none":
            one_of(fallback, ("tesseract",), "OCR_FALLBACK")
        return cls(engine, "tesseract" if fallback == "tesseract" and engine != "tesseract" else None)


def is_quota_error(kind: Column, status: Column, message: Column) -> Column:
    """An exhausted allowance, which another engine can make up for: by class, by status, or by its words."""
    said = message.rlike("(?i)\\b(quota|usage limit)\\b")
    return F.coalesce(kind == "ServiceUsageError", F.lit(False)) | F.coalesce(status == 429, F.lit(False)) | F.coalesce(said, F.lit(False))


def digital_documents(pages: DataFrame, by: list[str], digital: str = "digital") -> DataFrame:
    """by, pages, digital_pages, all_digital, some_digital; no document without pages is all digital."""
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(digital).alias("digital_pages"), F.coalesce(F.bool_and(digital), F.lit(False)).alias("all_digital"), F.coalesce(F.bool_or(digital), F.lit(False)).alias("some_digital"))


def routed(documents: DataFrame, config: EngineConfig, has_credentials: bool, quota_error: Column | None = None, other_error: Column | None = None) -> DataFrame:
    """documents (all_digital; null if they couldn't be inspected) with engine, fell_back and status.

    All digital: engine none, nothing is recognised. Else the main engine; the local one instead if it lacks credentials or
    its allowance is exhausted, where that is the fallback. Status is 'failed' where no engine is left.
    """
    no = F.lit(False)
    quota = no if quota_error is None else F.coalesce(quota_error, no)
    other = no if other_error is None else F.coalesce(other_error, no)
    done = F.coalesce(F.col("all_digital"), no)
    if config.engine == "tesseract":
        engine, fell, failed = F.lit("tesseract"), no, no
    elif not has_credentials:
        engine, fell, failed = F.lit("tesseract"), F.lit(True), F.lit(config.fallback is None)
    else:
        away = quota & F.lit(config.fallback is not None)
        engine, fell, failed = F.when(away, "tesseract").otherwise("adobe"), away, (quota | other) & ~away
    return documents.withColumns({
        "engine": F.when(done, "none").when(~failed, engine), "fell_back": ~done & ~failed & fell,
        "status": F.when(done | ~failed, "ok").otherwise("failed"),
    })


def admitted(documents: DataFrame, most_pages: int = 50, pages: str = "pages", correct: str = "correct", lenient: str = "lenient") -> DataFrame:
    """documents with status, reason and the correction that is left of what was asked.

    pages is null for a document that couldn't be read: rejected. Too many pages for a correction: rejected, or, if lenient,
    taken without it.
    """
    unreadable = F.col(pages).isNull()
    many = ~unreadable & F.col(correct) & (F.col(pages) > most_pages)
    rejected = unreadable | (many & ~F.col(lenient))
    return documents.withColumns({
        "status": F.when(rejected, "rejected").otherwise("admitted"),
        "reason": F.when(unreadable, "unreadable").when(many & ~F.col(lenient), "too many pages").when(many, "uncorrected").otherwise(""),
        "corrects": F.col(correct) & ~rejected & ~many,
    })


def within_size(documents: DataFrame, most_megabytes: int = 100, length: str = "length") -> tuple[DataFrame, DataFrame]:
    """Documents of at most a size, and those beyond it."""
    small = F.coalesce(F.col(length) <= most_megabytes * 1024 * 1024, F.lit(False))
    return documents.where(small), documents.where(~small)


def can_transcribe(digital: Column, transcribe: Column, correct: Column, rotation: Column) -> Column:
    return ~digital & transcribe & correct & (rotation == 0)


def needs_transcription(pages: DataFrame, ink) -> DataFrame:
    """pages (can_transcribe, junk, items) with `fallback`: those whose layer is junk, or that lack one but have ink.

    ink: DataFrame to DataFrame, adds `ink`; it is costly and only gets the pages that depend on it.
    """
    open_ = F.col("can_transcribe") & (F.col("items") == 0) & ~F.col("junk")  # junk costs most, so it comes last
    tested = ink(pages.where(open_))
    plain = pages.where(~open_).withColumn("ink", F.lit(None).cast("boolean"))
    both = plain.unionByName(tested)
    return both.withColumn("fallback", F.col("can_transcribe") & (F.col("junk") | ((F.col("items") == 0) & F.coalesce("ink", F.lit(False)))))


def certain_lines(lines: DataFrame) -> DataFrame:
    """Transcribed lines that may be written: none of a poorly legible page, else the certain ones."""
    return lines.where((F.col("legibility") != "poor") & F.col("certain"))


def dropped_lines(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, lines, kept, dropped."""
    keeps = (F.col("legibility") != "poor") & F.col("certain")
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(keeps).alias("kept")).withColumn("dropped", F.col("lines") - F.col("kept"))


def run_summary(outcomes: DataFrame, by: list[str], lenient: bool = False) -> DataFrame:
    """by, pages, pages_refined, pages_failed, corrections, pages_transcribed, errors, failed.

    outcomes, one row a page: page, attempted, failed, error, transcribed, changes. Refined are pages with an edit,
    transcribed ones included; these count no corrections. Errors are in the order of the pages. A run fails if all pages
    that were attempted did, and at least one was, unless lenient.
    """
    edited = ~F.col("failed") & (F.col("transcribed") | (F.col("changes") > 0))
    errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("page", "error")))), lambda e: F.concat(F.lit("Seite "), e["page"].cast("string"), F.lit(": "), e["error"]))
    total = outcomes.groupBy(*by).agg(
        F.count("*").alias("pages"), F.count_if(edited).alias("pages_refined"), F.count_if("failed").alias("pages_failed"),
        F.sum(F.when(edited & ~F.col("transcribed"), F.col("changes")).otherwise(0)).alias("corrections"),
        F.count_if(edited & F.col("transcribed")).alias("pages_transcribed"), errors.alias("errors"), F.count_if("attempted").alias("__attempted"),
    )
    all_failed = (F.col("__attempted") > 0) & (F.col("pages_failed") == F.col("__attempted"))
    return total.withColumn("failed", F.lit(not lenient) & all_failed).drop("__attempted")


def batch_summary(files: DataFrame) -> DataFrame:
    """ok, skipped, failed, exit_code of a batch of files with a status each."""
    counts = files.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")])
    return counts.withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


def metric_headers(summary: DataFrame) -> DataFrame:
    """summary (engine, fell_back, model, corrects, skipped and the run's counters) with `headers`, a map.

    Counters are there only for a run that corrects, the fallback, transcribed pages and the skip only where they apply.
    """
    def when(condition, name, value):
        entry = F.create_map(F.lit(name), value.cast("string"))
        return F.when(F.coalesce(condition, F.lit(False)), entry).otherwise(F.create_map().cast("map<string,string>"))

    corrects, always = F.col("corrects"), F.lit(True)
    parts = [
        when(always, "X-OCR-Engine", F.col("engine")), when(F.col("fell_back"), "X-OCR-Engine-Fallback", F.lit("adobe-quota")),
        when(F.col("model").isNotNull(), "X-OCR-LLM", F.col("model")),
        when(corrects, "X-OCR-LLM-Pages", F.concat_ws("/", F.col("pages_refined").cast("string"), F.col("pages").cast("string"))),
        when(corrects, "X-OCR-LLM-Corrections", F.col("corrections")), when(corrects, "X-OCR-LLM-Failed", F.col("pages_failed")),
        when(corrects & (F.col("pages_transcribed") > 0), "X-OCR-LLM-Transcribed", F.col("pages_transcribed")),
        when(F.col("skipped"), "X-OCR-LLM-Skipped", F.lit("max-pages")),
    ]
    return summary.withColumn("headers", F.map_concat(*parts))


def request_id() -> Column:
    """Eight characters that tell requests apart; different each time."""
    return F.substring(F.uuid(), 1, 8)


def key_accepted(given: Column, expected: str | None) -> Column:
    """Whether a key is the expected one, compared by digest; without an expected key all are."""
    return F.lit(True) if not expected else F.coalesce(F.sha2(given, 256) == F.sha2(F.lit(expected), 256), F.lit(False))
