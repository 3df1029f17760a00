"""Quality of recognised text layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import is_plausible, let, tokens

FEWEST_CHARACTERS = 40
LEAST_PLAUSIBLE = 0.5
#: Visible characters from which a page counts as digital, not scanned.
VISIBLE_CHARACTERS = 20
#: Spread of luminance above which a page has ink.
INK_SPREAD = 12.0


def measures(text: Column) -> Column:
    """Struct chars, plausible: characters of the tokens, and of those that are words. Worked out within the row."""
    def add(state, token):
        n = F.length(token)
        return F.struct((state["chars"] + n).alias("chars"), (state["plausible"] + F.when(is_plausible(token), n).otherwise(0)).alias("plausible"))

    zero = F.struct(F.lit(0).cast("int").alias("chars"), F.lit(0).cast("int").alias("plausible"))
    return F.aggregate(tokens(text), zero, add)


def share(plausible: Column, chars: Column) -> Column:
    return F.coalesce(F.try_divide(plausible.cast("double"), chars.cast("double")), F.lit(0.0))


def layer_quality(runs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, chars, plausible_share of each layer: weighted by characters, not tokens; 0 without any."""
    measured = runs.select(*by, measures(F.col(text)).alias("m"))
    total = measured.groupBy(*by).agg(F.sum("m.chars").alias("chars"), F.sum("m.plausible").alias("plausible"))
    return total.select(*by, "chars", share(F.col("plausible"), F.col("chars")).alias("plausible_share"))


def with_quality(layers: DataFrame, text: str = "text") -> DataFrame:
    """layers, one row each, with chars and plausible_share; nothing is shuffled for it."""
    def spread(m):
        return F.struct(m["chars"].cast("long").alias("chars"), share(m["plausible"], m["chars"]).alias("plausible_share"))

    return layers.withColumn("__quality", let(measures(F.col(text)), spread)).select(*layers.columns, "__quality.*")


def is_junk(chars: Column, plausible_share: Column) -> Column:
    """Enough text to judge, and too little of it words: the layer is noise."""
    return (chars >= FEWEST_CHARACTERS) & (plausible_share < LEAST_PLAUSIBLE)


def is_junk_text(text: Column) -> Column:
    """is_junk() of a layer that is one text: one value to work out, also where it lands in a filter."""
    return let(measures(text), lambda m: is_junk(m["chars"], share(m["plausible"], m["chars"])))


def is_digital(visible_characters: Column) -> Column:
    """Real visible text; a page that couldn't be inspected (null) counts as a scan."""
    return F.coalesce(visible_characters >= VISIBLE_CHARACTERS, F.lit(False))


def spread(values: Column) -> Column:
    """Population standard deviation of an array of doubles, from the sum of squared differences to its mean; 0 for an empty one."""

    def deviation(mean):
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(values))

    return F.when(F.size(values) == 0, 0.0).otherwise(let(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values), deviation))


def has_ink(spread: Column) -> Column:
    return spread > INK_SPREAD


def percentiles(values: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by, and a column for each name of wanted, which gives the rule and the share q:

    'index'      the value at place floor(n x q) in ascending order, from 0; null if there is no such place. The upper
                 median is the one at 0.5
    'clamped'    the same, the last value at most
    'histogram'  the first value at which at least q of the values are reached, 1 at least

    Values are counted before they are sorted, so a group costs as many rows as it has different values, and all that is
    wanted comes from one pass. Nulls are left out.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*by))})

    def found(rule, q):
        if rule == "histogram":
            return F.greatest(F.min(F.when(F.col("upto") >= F.col("total") * q, F.col(value))), F.lit(1))
        place = F.floor(F.col("total") * q)
        place = F.least(place, F.col("total") - 1) if rule == "clamped" else place
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    return placed.groupBy(*by).agg(*[found(*how).alias(name) for name, how in wanted.items()])


def percentile_by_index(values: DataFrame, by: list[str], value: str, q: float, to: str, clamp: bool = False) -> DataFrame:
    """by, to: one percentile by its place, see percentiles()."""
    return percentiles(values, by, value, {to: ("clamped" if clamp else "index", q)})


def percentile_by_histogram(values: DataFrame, by: list[str], value: str, q: float, to: str) -> DataFrame:
    """by, to: one percentile by cumulative counts, see percentiles()."""
    return percentiles(values, by, value, {to: ("histogram", q)})


def profile_energy(points: DataFrame, by: list[str], position: str, bin_size: float) -> DataFrame:
    """by, energy: sum of the squared counts of the bins that the positions fall into."""
    binned = points.groupBy(*by, F.floor(F.col(position) / bin_size).alias("bin")).agg(F.count("*").alias("n"))
    return binned.groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).alias("energy"))


def best_by(scores: DataFrame, by: list[str], candidate: str, score: str, order: str) -> DataFrame:
    """by, candidate, score: the highest score, of equal ones the earliest in order (the one in office comes first)."""
    best = F.max(F.struct(F.col(score), (-F.col(order)).alias("o"), F.col(candidate)))
    return scores.groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{candidate}"), F.col(f"b.{score}"))
