"""Widths of text, from a font's advances: ranges of code points, found by binary search within a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advances of a common sans-serif in thousandths of its size. Each is that of the code points from its number on,
# up to the next one: controls, the characters of ASCII in their order, then scripts.
ADVANCES = [
    (0x0, 0), (0x20, 278), (0x22, 355), (0x23, 556), (0x25, 889), (0x26, 667), (0x27, 191), (0x28, 333), (0x2A, 389), (0x2B, 584), (0x2C, 278), (0x2D, 333), (0x2E, 278),
    (0x30, 556), (0x3A, 278), (0x3C, 584), (0x3F, 556), (0x40, 1015), (0x41, 667), (0x43, 722), (0x45, 667), (0x46, 611), (0x47, 778), (0x48, 722), (0x49, 278), (0x4A, 500), (0x4B, 667),
    (0x4C, 556), (0x4D, 833), (0x4E, 722), (0x4F, 778), (0x50, 667), (0x51, 778), (0x52, 722), (0x53, 667), (0x54, 611), (0x55, 722), (0x56, 667), (0x57, 944), (0x58, 667), (0x5A, 611),
    (0x5B, 278), (0x5E, 469), (0x5F, 556), (0x60, 333), (0x61, 556), (0x63, 500), (0x64, 556), (0x66, 278), (0x67, 556), (0x69, 222), (0x6B, 500), (0x6C, 222), (0x6D, 833), (0x6E, 556),
    (0x72, 333), (0x73, 500), (0x74, 278), (0x75, 556), (0x76, 500), (0x77, 722), (0x78, 500), (0x7B, 334), (0x7C, 260), (0x7D, 334), (0x7E, 584), (0x7F, 0),
    (0xA0, 278), (0xA1, 556), (0x300, 0), (0x370, 556), (0x1100, 1000), (0x1200, 556), (0x2000, 500), (0x200B, 0), (0x2010, 556), (0x2E80, 1000), (0xD7B0, 556), (0xF900, 1000), (0xFB00, 556), (0xFE00, 0), (0xFE10, 1000), (0xFE70, 556), (0xFF01, 1000), (0xFF61, 556), (0x1F300, 1000),
]


def advance(code_point: Column, advances: Sequence[tuple[int, int]] = ADVANCES) -> Column:
    """Advance of a code point (an integer column): that of the last range that begins at or before it, 0 before the first.

    The ranges are in ascending order. The expression is a balanced tree, so a lookup compares as often as their number has bits.
    """
    if not advances:
        return F.lit(0)
    if any(a[0] >= b[0] for a, b in zip(advances, advances[1:])):
        raise ValueError("ranges must ascend")

    def tree(low: int, high: int) -> Column:
        """Among ranges low to high, high left out; low - 1 stands for what comes before the first."""
        if low == high:
            return F.lit(advances[low - 1][1] if low else 0)
        middle = (low + high) // 2
        return F.when(code_point < advances[middle][0], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(advances))


def text_width(text: Column, advances: Sequence[tuple[int, int]] = ADVANCES) -> Column:
    """Sum of the advances of a text's characters, in thousandths of the font's size (long); null for null, 0 for the empty text."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.aggregate(characters, F.lit(0).cast("long"), lambda sum_, c: sum_ + advance(F.ascii(c), advances))


def measured(text: Column, size: Column) -> Column:
    """Width of a text in a font size, for layout.line_layout(measure=measured)."""
    return text_width(text) * size / 1000
