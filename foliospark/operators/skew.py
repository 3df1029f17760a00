"""Skew of pages from their ink points, as rows: keys, x, y. DataFrame functions only, so a page's points lie in many tasks.

Candidates are tried on two levels, half degrees and then tenths around the winner of each page. A candidate's energy is the sum of
the squared counts of points across the lines at its angle: the sharper the lines stand out, the higher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.pixels import EDGE, FEWEST_POINTS, LEAST_ANGLE, LEAST_GAIN

MOST_DEGREES = 30.0


def _candidate(rank, angle):
    """rank, angle, and its cosine and sine, which are worked out once for a page and not for each of its points."""
    a = F.radians(angle)
    return F.struct(rank.alias("rank"), angle.alias("angle"), F.cos(a).alias("cos"), F.sin(a).alias("sin"))


def _energies(points: DataFrame, by: list[str], candidates) -> DataFrame:
    """Keys, rank, angle, energy: candidates is a column of an array of _candidate()."""
    each = points.select(*by, "x", "y", "n", "width", "bin_size", F.explode(candidates).alias("c")).select(*by, "x", "y", "n", "width", "bin_size", "c.*")
    across = F.col("y") * F.col("cos") - F.col("x") * F.col("sin") + F.abs(F.col("width") * F.col("sin"))
    counts = each.groupBy(*by, "rank", "angle", F.floor(across / F.col("bin_size")).alias("bin")).agg(F.sum("n").alias("n"))
    return counts.groupBy(*by, "rank", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("energy"))


def _winner(energies: DataFrame, by: list[str]) -> DataFrame:
    """The candidate of most energy, of equal ones the first: one in office is only replaced by a better one."""
    return energies.groupBy(*by).agg(F.max_by(F.struct("angle", "energy"), F.struct("energy", -F.col("rank"))).alias("best"), F.max(F.when(F.col("rank") == 0, F.col("energy"))).alias("first")).select(*by, "best.*", "first")


def measured(points: DataFrame, sizes: DataFrame, by: list[str], most_degrees: float = MOST_DEGREES) -> DataFrame:
    """A row for each page of sizes (keys, width, height): points, degrees (lines fall to the right if positive; 0 if straight or
    unsure), unsure, and x0, y0, x1, y1, within which 99 of 100 points lie once the page is straightened; null for a page of fewer
    than 500 points.

    Straight is tried first and stays in office on ties, as does the winner of the half degrees on the second level. Winners
    under 0.3 degrees, or with less than 1.03 times the energy of straight, are unsure. Points without a place, and those of
    other pages, are passed over; a page that is there twice in sizes counts once.
    """
    pages = sizes.groupBy(*by).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    # points at one place are one row with their number: a page has no more of them than pixels, however often it is printed on
    inked = points.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    counted = inked.groupBy(*by).agg(F.sum("n").alias("points"))
    bin_size = F.greatest(F.lit(2), F.floor(F.least("width", "height") / 400 + 0.5))
    known = inked.join(pages.join(counted.where(F.col("points") >= FEWEST_POINTS), by), by).withColumn("bin_size", bin_size)
    steps = int(round(2 * most_degrees / 0.5))
    coarse = F.array(*[_candidate(F.lit(r), F.lit(a)) for r, a in enumerate([0.0, *[-most_degrees + 0.5 * k for k in range(steps + 1)]])])
    first = _winner(_energies(known, by, coarse), by).withColumnsRenamed({"angle": "coarse", "energy": "coarse_energy", "first": "straight"})
    around = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: _candidate(k + 1, F.col("coarse") - 0.5 + k * F.lit(0.1)))
    tried = _energies(known.join(first.select(*by, around.alias("around")), by), by, F.col("around"))
    office = first.select(*by, F.lit(0).alias("rank"), F.col("coarse").alias("angle"), F.col("coarse_energy").alias("energy"))
    best = _winner(tried.unionByName(office), by).drop("first").join(first.select(*by, "straight"), by)
    unsure = (F.abs("angle") < LEAST_ANGLE) | (F.col("energy") < F.col("straight") * F.lit(LEAST_GAIN))
    decided = best.select(*by, unsure.alias("unsure"), F.when(unsure, 0.0).otherwise(F.floor(F.col("angle") * 10 + 0.5) / 10).alias("degrees"))
    turned = _straightened(known.join(decided, by), by)
    return pages.join(counted, by, "left").join(decided, by, "left").join(turned, by, "left").select(*by, "width", "height", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("degrees", F.lit(0.0)).alias("degrees"), F.coalesce("unsure", F.lit(True)).alias("unsure"), "x0", "y0", "x1", "y1")


def _straightened(known: DataFrame, by: list[str]) -> DataFrame:
    """Keys, x0, y0, x1, y1 of points turned back around the page's middle: the values at floor(n x 0.005) and floor(n x 0.995).

    Points are counted by whole pixels first, and only those in the pixel column (or row) that holds a wanted place are put in
    order, so no task sorts a page.
    """
    a, dx, dy = F.radians("degrees"), F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2
    rx, ry = F.col("width") / 2 + dx * F.cos(a) + dy * F.sin(a), F.col("height") / 2 - dx * F.sin(a) + dy * F.cos(a)
    sides = F.array(*[F.struct(F.lit(axis).alias("axis"), value.alias("value")) for axis, value in (("x", rx), ("y", ry))])
    moved = known.select(*by, "n", F.explode(sides).alias("m")).select(*by, "n", "m.axis", "m.value", F.floor("m.value").alias("bin"))
    whole = Window.partitionBy(*by, "axis")
    bins = moved.groupBy(*by, "axis", "bin").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "all": F.sum("n").over(whole)})
    ends = F.array(*[F.struct(F.lit(end).alias("end"), F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(share))).alias("place")) for end, share in ((0, 0.005), (1, 0.995))])
    wanted = bins.withColumn("e", F.explode(ends)).select(*by, "axis", "bin", "e.end", (F.col("e.place") - F.col("upto") + F.col("n")).alias("place"), F.col("n").alias("most")).where("place >= 0 and place < most")
    near = moved.join(wanted.drop("most"), [*by, "axis", "bin"]).groupBy(*by, "axis", "end", "place", "value").agg(F.sum("n").alias("n"))
    upto = near.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "axis", "end").orderBy("value"))).where("upto > place")

    def at(axis: str, end: int):
        return F.min(F.when((F.col("axis") == axis) & (F.col("end") == end), F.col("value")))

    return upto.groupBy(*by).agg(at("x", 0).alias("x0"), at("y", 0).alias("y0"), at("x", 1).alias("x1"), at("y", 1).alias("y1"))


def fits(edge: int = EDGE):
    """Whether what measured() found stays on the page, by `edge` pixels, once it is straightened; false for a page without bounds."""
    return F.coalesce((F.col("x0") >= edge) & (F.col("y0") >= edge) & (F.col("x1") <= F.col("width") - edge) & (F.col("y1") <= F.col("height") - edge), F.lit(False))
