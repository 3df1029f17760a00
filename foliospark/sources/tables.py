"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Splits up to which a table is dealt out again, so that no more than these, of spark.sql.files.maxPartitionBytes each, ever move.
FEW_SPLITS = 4


def plain_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns, as it lies there."""
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return table.select(*columns) if columns else table


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns; one of FEW_SPLITS or fewer in as many partitions as there are cores.

    A small file with one row group would keep most cores idle for work that is done row by row. Any larger table is read
    as it lies there.
    """
    table = plain_table(spark, folder, name, *columns)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() <= min(FEW_SPLITS, cores - 1) else table
