"""International host names in their ASCII form, with Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of Punycode (RFC 3492, section 5), its digits, and the other full stops of host names
BASE, TMIN, TMAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
STOPS = "[。．｡]"
#: Digits of a number, and divisions in adapting the bias, that a 64-bit number can take: both loops end before.
MOST_DIGITS, MOST_DIVISIONS = 20, 14


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """Bias after a difference was written, with so many points written by then."""
    def settle(d):
        start = F.struct((d + _div(d, points)).alias("d"), F.lit(0).cast("long").alias("k"))

        def divide(s, _):
            large = s["d"] > (BASE - TMIN) * TMAX // 2
            return F.struct(F.when(large, _div(s["d"], BASE - TMIN)).otherwise(s["d"]).alias("d"), F.when(large, s["k"] + BASE).otherwise(s["k"]).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIVISIONS)), start, divide, lambda s: s["k"] + _div(s["d"] * (BASE - TMIN + 1), s["d"] + SKEW))

    return F.get(F.transform(F.array(F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))), settle), 0)


def _written(delta: Column, bias: Column) -> Column:
    """A difference as digits of growing weight."""
    def digit(s, k):
        t = F.greatest(F.least(k - bias, F.lit(TMAX).cast("long")), F.lit(TMIN).cast("long"))
        last = s["q"] < t
        value = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (F.lit(BASE).cast("long") - t))
        more = F.concat(s["out"], F.substring(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1)))
        return F.when(s["open"], F.struct(F.when(last, F.lit(0).cast("long")).otherwise(_div(s["q"] - t, F.lit(BASE).cast("long") - t)).alias("q"), more.alias("out"), (~last).alias("open"))).otherwise(s)

    weights = F.sequence(F.lit(BASE).cast("long"), F.lit(BASE * MOST_DIGITS).cast("long"), F.lit(BASE).cast("long"))
    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(True).alias("open"))
    return F.aggregate(weights, start, digit, lambda s: s["out"])


def _label(label: Column) -> Column:
    points = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))
    basic = F.regexp_replace(label, "[^\\x00-\\x7F]", "")
    b = F.length(basic).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("delta"), F.lit(FIRST_BIAS).cast("long").alias("bias"), b.alias("h"), F.concat(basic, F.when(b > 0, "-").otherwise("")).alias("out"), F.lit(FIRST_POINT).cast("long").alias("n"))

    def of_point(state, m):
        def of_place(s, c):
            hit = c == m
            return F.when(hit, F.struct(F.lit(0).cast("long").alias("delta"), _adapted(s["delta"], s["h"] + 1, s["h"] == b).alias("bias"), (s["h"] + 1).alias("h"), F.concat(s["out"], _written(s["delta"], s["bias"])).alias("out"), s["n"].alias("n"))).otherwise(
                F.struct((s["delta"] + (c < m).cast("long")).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"), s["n"].alias("n")))

        skipped = F.struct((state["delta"] + (m - state["n"]) * (state["h"] + 1)).alias("delta"), state["bias"].alias("bias"), state["h"].alias("h"), state["out"].alias("out"), m.alias("n"))
        return F.aggregate(points, skipped, of_place, lambda s: F.struct((s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"), (s["n"] + 1).alias("n")))

    foreign = F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= FIRST_POINT)))
    return F.concat(F.lit("xn--"), F.aggregate(foreign, zero, of_point, lambda s: s["out"]))


def ascii_host(host: Column) -> Column:
    """A lower-case host with each label that isn't ASCII as `xn--` and its Punycode; other hosts and null as they are.

    Letters are taken as they stand: they aren't composed, and ß stays ß.
    """
    parted = F.split(F.regexp_replace(host, STOPS, "."), "\\.")
    coded = F.array_join(F.transform(parted, lambda p: F.when(p.rlike("[^\\x00-\\x7F]"), _label(p)).otherwise(p)), ".")
    return F.when(host.rlike("[^\\x00-\\x7F]"), coded).otherwise(host)
