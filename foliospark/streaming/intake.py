"""Files as they arrive: a folder that scans are put into, processed once each.

The batch operators are used as they are, on each micro-batch; what was done is kept by the stream's own checkpoint, so a
restart neither repeats nor skips a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import filing, quality

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """path, modificationTime, length, content, out_name of .pdf files put into a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return stream.withColumn("out_name", filing.output_name(F.col("path")))


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies work to each micro-batch and appends its rows to a Parquet table, each batch to a folder of its own.

    A batch that is run again after a failure replaces what it had written. once: all that is there, then stop.
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def quality_by_window(layers: DataFrame, time: str = "ts", text: str = "text", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Junk layers in each window of time of a stream of layers; rows later than the watermark no longer count."""
    measured = quality.with_quality(layers.select(time, text)).withColumn("junk", quality.is_junk(F.col("chars"), F.col("plausible_share")))
    counted = measured.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("layers"), F.count_if("junk").alias("junk_layers"))
    return counted.select(F.col("w.start").alias("start"), "layers", "junk_layers")
