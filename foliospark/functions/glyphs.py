"""Glyphs of showing operators whose arguments are nested, as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank, let
from foliospark.operators.content import DEEPEST


def _one(glyph: Column) -> Column:
    """1 for a struct whose member unicode, a VARIANT, is there and isn't white space alone, 0 for any other, and for null."""
    unicode = glyph["unicode"]
    blank = let(F.try_variant_get(unicode, "$", "string"), lambda s: F.coalesce((s != "") & is_blank(s), F.lit(False)))
    return F.when(unicode.isNull(), 0).when(blank, 0).otherwise(1)


def glyph_count(arguments: Column, deepest: int = DEEPEST) -> Column:
    """Visible glyphs within a VARIANT of nested arrays of glyphs and spacing numbers (int); arrays deeper than `deepest` levels have
    none. Null for null.

    The objects of each level are taken out by one cast of the whole value, to an array type of as many levels, so that neither
    numbers nor arrays are looked at one by one.
    """

    def count(value: Column, depth: int) -> Column:
        found = F.try_variant_get(value, "$", "array<" * depth + "struct<unicode:variant>" + ">" * depth)
        found = found if depth else F.array(found)
        for _ in range(depth - 1):
            found = F.flatten(F.filter(found, lambda a: a.isNotNull()))
        return F.coalesce(F.aggregate(found, F.lit(0), lambda n, g: n + _one(g)), F.lit(0))

    # the test for null stands within as well: outside it would make the arguments a second time
    return let(arguments, lambda a: F.when(a.isNotNull(), sum((count(a, d) for d in range(1, deepest + 1)), count(a, 0))))
