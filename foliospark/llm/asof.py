"""As-of lookup over ranges of keys and times that hold about equally many rows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed


def latest_before(facts: DataFrame, asked: DataFrame, key: str, at: str, value: str, to: str) -> DataFrame:
    """asked with column `to`: `value` of the latest row of facts with the same key and an earlier time `at` (a long).

    Of facts with equal times, the one with the largest value counts. Null if there is none, or if a key or time is null.
    All columns of asked stay, repeated rows too; one named `to` is replaced.

    Facts and questions are merged to one row for each key and time, and dealt to ranges of (key, time) by quantiles that
    Spark samples: a key that has most of the rows is spread over many ranges, whenever its rows fall. Across ranges goes
    only the last fact of each. The answers join by key and time.
    """
    asked = asked.drop(to)
    given = facts.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.col(value).alias("__v"))
    wanted = asked.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(None).cast(given.schema["__v"].dataType).alias("__v"))
    points = given.withColumn("__asked", F.lit(0)).unionByName(wanted.withColumn("__asked", F.lit(1))).where("__k is not null and __t is not null")
    merged = points.groupBy("__k", "__t").agg(F.max("__v").alias("__v"), F.max("__asked").alias("__asked"))
    ranged = checkpointed(merged.repartitionByRange("__k", "__t").withColumn("__range", F.spark_partition_id()))
    fact = F.when(F.col("__v").isNotNull(), F.struct("__k", "__v"))
    # one row a range, of which there are as many as tasks
    lasts = ranged.groupBy("__range").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct("__k", "__t", "__v"))).alias("__last"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("__range", F.last(F.when(F.col("__last").isNotNull(), F.struct("__last.__k", "__last.__v")), ignorenulls=True).over(upto).alias("__carried"))
    own = Window.partitionBy("__range").orderBy("__k", "__t").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("__near", F.last(fact, ignorenulls=True).over(own)).where("__asked = 1").join(F.broadcast(carried), "__range")
    before = F.coalesce("__near", "__carried")
    answers = near.select("__k", "__t", F.when(before["__k"] == F.col("__k"), before["__v"]).alias("__found"))
    joined = asked.join(answers, (asked[key] == answers["__k"]) & (asked[at] == answers["__t"]), "left")
    return joined.select(*[asked[f"`{c}`"] for c in asked.columns], F.col("__found").alias(to))
