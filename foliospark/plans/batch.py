"""A batch over a folder: what isn't done yet is recognised elsewhere and written, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.checkpoints import checkpointed
from foliospark.operators import filing, routing
from foliospark.seams import RemoteRecognition
from foliospark.sources import files, sinks


def run(spark: SparkSession, folder: str, output: str, recognise: RemoteRecognition, existing: DataFrame, force: bool = False) -> tuple[DataFrame, int]:
    """out_name, status (ok, skipped, failed), error of every file in a folder, and the exit code: 1 if any failed.

    existing: out_name of what is there already, asked for before anything is written. A file that fails doesn't stop the others.
    """
    found = files.require_any(files.document_files(spark, folder)).withColumn("out_name", filing.output_name(F.col("path")))
    todo = filing.not_yet_written(found, existing, force=force)
    before = filing.written_before(found.select("out_name"), existing, force=force)
    skipped = checkpointed(before.select("out_name", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error")))
    answered = checkpointed(recognise(todo))
    failed = answered.where("error is not null").select("out_name", F.lit("failed").alias("status"), "error")
    written = sinks.write_files(answered.where("error is null"), output)
    told = checkpointed(written.unionByName(failed).unionByName(skipped))
    return told, routing.batch_summary(told).first()["exit_code"]
