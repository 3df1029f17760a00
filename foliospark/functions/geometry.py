"""Geometry of pages: matrices are arrays of six numbers (a, b, c, d, e, f), as in page descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(matrix: Column, i: int) -> Column:
    return F.get(matrix, F.lit(i))


def rounded(value: Column) -> Column:
    """To the nearest integer, halves upwards."""
    return F.floor(value + 0.5).cast("int")


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def apply(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return at(matrix, 0) * x + at(matrix, 2) * y + at(matrix, 4), at(matrix, 1) * x + at(matrix, 3) * y + at(matrix, 5)


def length(x: Column, y: Column) -> Column:
    """Length of a vector, 1 for the zero vector."""
    n = F.hypot(x, y)
    return F.when(n == 0, 1.0).otherwise(n)


def quarter_turn(rotation: Column) -> Column:
    """Rotation modulo 360, never negative."""
    return F.pmod(rotation, F.lit(360))


def box_per_mille(run: Column, width: Column, height: Column, view: Column, page_width: Column, page_height: Column) -> Column:
    """Struct x, y, w, h: where a text run lies, in thousandths of the page, from the top left.

    run: the run's matrix; width and height: its size along and across its base line; view: page to image.
    """
    ux, uy = at(run, 0) / length(at(run, 0), at(run, 1)) * width, at(run, 1) / length(at(run, 0), at(run, 1)) * width
    vx, vy = at(run, 2) / length(at(run, 2), at(run, 3)) * height, at(run, 3) / length(at(run, 2), at(run, 3)) * height
    e, f = at(run, 4), at(run, 5)
    corners = [apply(view, e + dx, f + dy) for dx, dy in ((F.lit(0.0), F.lit(0.0)), (ux, uy), (vx, vy), (ux + vx, uy + vy))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    left, top = F.least(*xs), F.least(*ys)

    def thousandths(value, whole):
        return rounded(value / whole * 1000)

    return F.struct(
        thousandths(left, page_width).alias("x"), thousandths(top, page_height).alias("y"),
        F.greatest(F.lit(1), thousandths(F.greatest(*xs) - left, page_width)).alias("w"), F.greatest(F.lit(1), thousandths(F.greatest(*ys) - top, page_height)).alias("h"),
    )


def reading_scale(longest: Column, most_pixels: int) -> Column:
    """Scale of a page image for a model: the long side near most_pixels, between a half and four."""
    return clamp(F.lit(float(most_pixels)) / longest, 0.5, 4.0)


def recognition_scale(longest: Column, dpi: int) -> Column:
    """Scale of a page image for recognition: the resolution wanted, the long side at most 5000 pixels."""
    return F.least(F.lit(dpi / 72), F.lit(5000.0) / longest)


def turned_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Size of the canvas that holds an image turned by some degrees."""
    sine, cosine = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return F.ceil(width * cosine + height * sine), F.ceil(width * sine + height * cosine)


def turned_back(x: Column, y: Column, straight: tuple[Column, Column], original: tuple[Column, Column], degrees: Column) -> tuple[Column, Column]:
    """A pixel of the straightened image on the original one: both are turned about their middles."""
    sine, cosine = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    dx, dy = x - straight[0] / 2, y - straight[1] / 2
    return original[0] / 2 + dx * cosine - dy * sine, original[1] / 2 + dx * sine + dy * cosine


def line_matrix(x0: Column, y0: Column, x1: Column, y1: Column, line_height: Column, scale: Column) -> tuple[Column, Column]:
    """Matrix and width of a run whose base line goes from one page point to another; the font is 0.8 of the line's height."""
    width = length(x1 - x0, y1 - y0)
    ux, uy, size = (x1 - x0) / width, (y1 - y0) / width, line_height * 0.8 / scale
    return F.array(ux * size, uy * size, -uy * size, ux * size, x0, y0), width


def base_line(y: Column, height: Column) -> Column:
    return y + height * 0.8


def stretch(width: Column, natural: Column, matrix: Column) -> Column:
    """Factor that fits a text of natural width (at size 1) into its box; null where it can't be written."""
    along = F.hypot(at(matrix, 0), at(matrix, 1))
    return F.when((natural > 0) & (along > 0) & (width > 0), F.try_divide(width, natural * along))


def straighten(angle: Column, old_x: Column, old_y: Column, new_x: Column, new_y: Column) -> Column:
    """Matrix that turns a page by an angle about its old middle and moves that to the new one."""
    c, s = F.cos(angle), F.sin(angle)
    return F.array(c, s, -s, c, new_x - (c * old_x - s * old_y), new_y - (s * old_x + c * old_y))


def projected(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Distance of a point along and across the line of a run."""
    along = length(at(matrix, 0), at(matrix, 1))
    ux, uy = at(matrix, 0) / along, at(matrix, 1) / along
    dx, dy = x - at(matrix, 4), y - at(matrix, 5)
    return ux * dx + uy * dy, ux * dy - uy * dx


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.299 + green * 0.587 + blue * 0.114
