"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed

#: Edges that one task handles at least; fewer don't need all the tasks that a shuffle has.
TASK_EDGES = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long: root is the smallest node that can be reached.

    Alternates large-star and small-star steps: each links the neighbours of a node to the smallest of them, so the
    number of edges never grows, and the depth falls by a constant factor a round. The rounds end when the edges are
    stars. Each round is cut off by a checkpoint; only a count and a checksum come to the driver. Self-loops and
    repeated edges are allowed; rows with a null are passed over. Without edges the result is empty.
    """
    def distinct(frame):
        return frame.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = checkpointed(edges.select("a", "b").where("a is not null and b is not null"))
    tasks = edges.count() // TASK_EDGES + 1

    def few(frame):
        return frame.coalesce(tasks)

    edges = few(edges)
    stars = checkpointed(few(distinct(edges)))
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()

    def mark(frame):
        return frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()

    seen = mark(stars)
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the smallest one
        large = both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().transform(few)
        # small star: smaller neighbours, and the node itself, go to the smallest one
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = checkpointed(few(distinct(small)))
        now = mark(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return few(members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("root").alias("root")))
