"""Filing: from what was read of a document to its path, properties and headers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.dates import chosen_date
from foliospark.functions.text import clean_name, slug

# Folder for documents without a known sender, folder for review, and words for what is missing
UNKNOWN_FOLDER = "_Unbekannt"
REVIEW_FOLDER = "_Pruefen"
NO_DATE = "ohne-Datum"
NO_SUMMARY = "Scan"
NO_NAME = "dokument"


def filed(raw: DataFrame, now: datetime) -> DataFrame:
    """raw (date, correspondent, summary, reference, confidence and perhaps scan_date, all strings) with its columns
    replaced by validated ones, and date_source and path added.

    What isn't known is the empty string, never null. The path has exactly one folder.
    """
    scan = F.col("scan_date") if "scan_date" in raw.columns else F.lit(None).cast("string")

    def text(c):
        return F.coalesce(F.col(c), F.lit(""))

    date, source = chosen_date(text("date"), scan, now)
    named = raw.withColumns({
        "date": date, "date_source": source, "correspondent": clean_name(text("correspondent"), 50),
        "summary": slug(text("summary"), 60), "reference": slug(text("reference"), 30),
    }).withColumn("summary", F.when(F.col("summary") == "", NO_SUMMARY).otherwise(F.col("summary")))
    low, nobody = F.col("confidence") == "low", F.col("correspondent") == ""
    sender = F.when(nobody, "").otherwise(slug(F.col("correspondent"), 40, composed=True))
    parts = F.array(F.when(F.col("date") == "", NO_DATE).otherwise(F.col("date")), sender, F.col("summary"), F.col("reference"))
    name = F.array_join(F.filter(parts, lambda p: p != ""), "_")
    folder = F.when(low, REVIEW_FOLDER).when(nobody, UNKNOWN_FOLDER).otherwise(F.col("correspondent"))
    return named.withColumn("path", F.concat(folder, F.lit("/"), name, F.lit(".pdf"))).drop("scan_date")


FILED_COLUMNS = ("date", "dateSource", "correspondent", "summary", "reference", "confidence", "path")


def metadata_header() -> Column:
    """Base64, in one line, of the JSON of a filed document."""
    fields = [F.col("date_source" if c == "dateSource" else c).alias(c) for c in FILED_COLUMNS]
    return F.regexp_replace(F.base64(F.encode(F.to_json(F.struct(*fields)), "UTF-8")), "[\\r\\n]", "")


def properties(documents: DataFrame) -> DataFrame:
    """documents with title, author and created: the file's own properties, null where they aren't to be set."""
    return documents.withColumns({
        "title": F.when((F.col("summary") != "") & (F.col("summary") != NO_SUMMARY), F.regexp_replace("summary", "-", " ")),
        "author": F.when(F.col("correspondent") != "", F.col("correspondent")),
        "created": F.when((F.col("date") != "") & (F.col("date_source") == "document"), F.concat("date", F.lit("T12:00:00Z"))),
    })


def disposition(original_name: Column) -> Column:
    """Content-Disposition header: an ASCII name, and the full one in percent encoding."""
    from foliospark.functions.text import base_name, let

    def header(base):
        encoded = F.url_encode(base)
        for written, plain in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            encoded = F.regexp_replace(encoded, written, plain)
        ascii_name = F.regexp_replace(base, "[^A-Za-z0-9_.-]", "_")
        return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit(".ocr.pdf\"; filename*=UTF-8''"), encoded, F.lit(".ocr.pdf"))

    name = base_name(original_name)
    return let(F.when(F.coalesce(name, F.lit("")) == "", NO_NAME).otherwise(name), header)


def output_name(path: Column) -> Column:
    from foliospark.functions.text import base_name

    return F.concat(base_name(path), F.lit(".ocr.pdf"))


def not_yet_written(inputs: DataFrame, existing: DataFrame, name: str = "out_name", force: bool = False) -> DataFrame:
    """Inputs whose output isn't there yet; all of them if forced."""
    return inputs if force else inputs.join(existing.select(name), name, "left_anti")


def written_before(inputs: DataFrame, existing: DataFrame, name: str = "out_name", force: bool = False) -> DataFrame:
    """The others: inputs whose output is there; none of them if forced."""
    return inputs.where("false") if force else inputs.join(existing.select(name), name, "left_semi")


def downgraded(meta: DataFrame, legibility: str = "legibility") -> DataFrame:
    """What was read of a page that is hard to read is trusted less: nothing but the names if poor, no reference if partial."""
    poor, partial = F.col(legibility).eqNullSafe("poor"), F.col(legibility).eqNullSafe("partial")
    return meta.withColumns({
        "date": F.when(poor, "").otherwise(F.col("date")),
        "reference": F.when(poor | partial, "").otherwise(F.col("reference")),
        "confidence": F.when(poor, "low").when(partial & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence")),
    })
