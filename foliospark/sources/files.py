"""Files of documents, in and out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import base_name
from foliospark.operators.filing import not_yet_written, output_name

#: A folder is read by this many tasks for each core, or by more, each of this many bytes as Spark's reader counts them.
TASKS_PER_CORE, TASK_BYTES = 8, 1 << 31


def _bytes(setting: str) -> int:
    """A size as Spark's settings have it: 16m, 128MB, 134217728b."""
    number, unit = re.fullmatch("([0-9]+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files in a folder, not in folders below, or of a single file.

    Spark's reader counts a file as spark.sql.files.openCostInBytes (4 MB) at least, so that a task takes 32 small ones: their
    number, and that of what follows, grows with the files and soon costs more than they do. Here a task takes some hundreds
    of them, whatever spark.sql.files.maxPartitionBytes is.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    splits = found.select("path").rdd.getNumPartitions()
    weight = splits * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, weight // TASK_BYTES)
    return found.coalesce(tasks) if tasks < splits else found


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the .pdf files in a folder, in any case of letters, not in folders below.

    A path that itself ends in .pdf, or a single file of another name, is taken as it is.
    """
    found = read_folder(spark, path)
    single = found.where(F.col("path").endswith(path.rstrip("/").rsplit("/", 1)[-1]))
    folder = found.where(F.lower("path").endswith(".pdf"))
    return single if not path.endswith("/") and not single.limit(1).isEmpty() else folder


def require_any(files: DataFrame) -> DataFrame:
    if not files.select("path").take(1):
        raise FileNotFoundError("no document files")
    return files


def pages_of(documents: DataFrame, count: str = "pages", to: str = "page") -> DataFrame:
    """documents once for each page, numbered from 1; none for a null or zero count."""
    return documents.where(F.col(count) >= 1).withColumn(to, F.explode(F.sequence(F.lit(1), F.col(count))))


def first_page_only(pages: DataFrame, correct: bool, page: str = "page") -> DataFrame:
    """All pages if they are to be corrected; else only the first, which metadata are read from."""
    return pages if correct else pages.where(F.col(page) == 1)


def pending(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """files with out_name, without those whose output exists."""
    return not_yet_written(files.withColumn("out_name", output_name(F.col("path"))), existing, force=force)


def names_in(spark: SparkSession, path: str, to: str = "out_name") -> DataFrame:
    """Names of the files in a folder; their content isn't read."""
    return read_folder(spark, path).select(F.regexp_extract("path", "([^/]*)$", 1).alias(to))


__all__ = ["base_name", "document_files", "first_page_only", "names_in", "pages_of", "pending", "read_folder", "require_any"]
