"""Pixel work on grey planes: numpy within a task, one page a row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.quality import INK_SPREAD

MOST_POINTS = 60_000
FEWEST_POINTS = 500
LEAST_ANGLE = 0.3
LEAST_GAIN = 1.03
INK_TO_MEAN, INK_TO_PAPER = 0.72, 0.85
EDGE = 4


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance of an image of shape (height, width) or (height, width, 3 or 4)."""
    if pixels.ndim == 2:
        return pixels.astype(np.float64)
    return pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def plane(data: bytes, width: int, height: int, stride: int = 1) -> np.ndarray:
    image = np.frombuffer(data, np.uint8)[: width * height * stride].reshape(height, width, stride)
    return image[..., 0] if stride < 3 else image[..., :3]


def spread(image: np.ndarray) -> float:
    """Population standard deviation of the luminance."""
    return float(grey(image).std()) if image.size else 0.0


def shrink(image: np.ndarray, width: int = 200) -> np.ndarray:
    """The grey image at a width of `width` pixels, each the mean of what it covers."""
    g = grey(image)
    height = max(1, round(width * g.shape[0] / g.shape[1]))
    ys, xs = (np.linspace(0, n, m + 1).astype(int) for n, m in ((g.shape[0], height), (g.shape[1], width)))
    total = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1, x0, x1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1), xs[:-1], np.maximum(xs[1:], xs[:-1] + 1)
    y1, x1 = np.minimum(y1, g.shape[0]), np.minimum(x1, g.shape[1])
    y0, x0 = np.minimum(y0, y1 - 1), np.minimum(x0, x1 - 1)
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    return sums / np.outer(y1 - y0, x1 - x0)


def local_mean(g: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the square around each point, as far as it lies on the plane."""
    height, width = g.shape
    total = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y, x = np.arange(height), np.arange(width)
    y0, y1, x0, x1 = np.maximum(0, y - radius), np.minimum(height, y + radius + 1), np.maximum(0, x - radius), np.minimum(width, x + radius + 1)
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    return sums / np.outer(y1 - y0, x1 - x0)


def at_share(values: np.ndarray, q: float) -> float:
    """The value at place floor(n x q) of the sorted ones, the last at most."""
    ordered = np.sort(values, axis=None)
    return float(ordered[min(len(ordered) - 1, max(0, int(np.floor(len(ordered) * q))))])


def ink_points(image: np.ndarray, most: int = MOST_POINTS) -> tuple[np.ndarray, np.ndarray]:
    """x, y of pixels of a coarse grid that are clearly darker than their surroundings and than the paper."""
    height, width = image.shape[:2]
    step = max(1, int(np.sqrt(width * height / (most * 4))))
    g = grey(image[::step, ::step]).astype(np.float32).astype(np.float64)
    if not g.size:
        return np.zeros(0), np.zeros(0)
    radius = max(2, int(np.floor(max(width, height) / step / 60 + 0.5)))
    y, x = np.nonzero((g < INK_TO_MEAN * local_mean(g, radius)) & (g < INK_TO_PAPER * at_share(g, 0.9)))
    return x * step, y * step


def profile(x: np.ndarray, y: np.ndarray, degrees: float, bin_size: int) -> int:
    """Energy of the histogram across lines at an angle: the sharper the lines stand out, the higher."""
    a = np.radians(degrees)
    v = np.floor((y * np.cos(a) - x * np.sin(a)) / bin_size).astype(np.int64)
    counts = np.bincount(v - v.min())
    return int((counts * counts).sum())


@dataclass(frozen=True)
class Skew:
    """degrees: lines fall to the right if positive, 0 if straight or unsure; bounds x0, y0, x1, y1 once straightened."""

    degrees: float
    bounds: tuple[float, float, float, float] | None = None

    def fits(self, width: int, height: int) -> bool:
        if self.bounds is None:
            return False
        x0, y0, x1, y1 = self.bounds
        return x0 >= EDGE and y0 >= EDGE and x1 <= width - EDGE and y1 <= height - EDGE


def measure_skew(image: np.ndarray, most_degrees: float = 30) -> Skew:
    """Coarse search by half degrees, then by tenths; the angle in office wins ties, 0 first."""
    if not most_degrees > 0:
        return Skew(0)
    x, y = ink_points(image)
    if len(x) < FEWEST_POINTS:
        return Skew(0)
    height, width = image.shape[:2]
    size = max(2, int(np.floor(min(width, height) / 400 + 0.5)))
    straight = energy = profile(x, y, 0, size)
    best = 0.0
    for around, reach, step in ((0.0, most_degrees, 0.5), (None, 0.5, 0.1)):
        middle = best if around is None else around
        for k in range(int(round(2 * reach / step)) + 1):
            angle = middle - reach + k * step
            found = profile(x, y, angle, size)
            if found > energy:
                best, energy = angle, found
    degrees = 0.0 if abs(best) < LEAST_ANGLE or energy < straight * LEAST_GAIN else float(np.floor(best * 10 + 0.5) / 10)
    a, cx, cy = np.radians(degrees), width / 2, height / 2
    rx = cx + (x - cx) * np.cos(a) + (y - cy) * np.sin(a)
    ry = cy - (x - cx) * np.sin(a) + (y - cy) * np.cos(a)
    return Skew(degrees, (at_share(rx, 0.005), at_share(ry, 0.005), at_share(rx, 0.995), at_share(ry, 0.995)))


def _by_block(g: np.ndarray, size: int, value) -> np.ndarray:
    """value(block) spread over each block of size x size pixels."""
    out = np.empty_like(g, dtype=np.float64)
    for y in range(0, g.shape[0], size):
        for x in range(0, g.shape[1], size):
            block = g[y : y + size, x : x + size]
            out[y : y + size, x : x + size] = value(block)
    return out


def mean_of_nine(g: np.ndarray) -> np.ndarray:
    """3 x 3 mean of the inner pixels; the border stays 0."""
    out = np.zeros_like(g)
    if min(g.shape) > 2:
        height, width = g.shape
        out[1:-1, 1:-1] = sum(g[dy : height - 2 + dy, dx : width - 2 + dx] for dy in range(3) for dx in range(3)) / 9
    return out


def enhance(image: np.ndarray) -> np.ndarray:
    """A faded page for reading: noise dampened, paper white by blocks of 32 pixels, ink darkened."""
    smooth = mean_of_nine(grey(image))
    ratio = np.clip(smooth / _by_block(smooth, 32, lambda b: np.sort(b, axis=None)[int(b.size * 0.9)] or 255.0), 0, 1)
    return np.floor(255 * np.maximum(0, (ratio - 0.72) / 0.28) ** 1.4 + 0.5).astype(np.uint8)


def flatten(image: np.ndarray) -> np.ndarray:
    """A page on coloured paper for recognition: each block is set in relation to its own paper."""
    g = np.floor(grey(image)).astype(np.uint8)
    size = max(24, int(np.floor(max(g.shape) / 80 + 0.5)))

    def paper(block):
        reached = np.cumsum(np.bincount(block.ravel(), minlength=256))
        return max(1, int(np.argmax(reached >= block.size * 0.9)))

    ratio = g / _by_block(g, size, paper)
    return np.floor(255 * np.clip((ratio - 0.35) / 0.55, 0, 1) + 0.5).astype(np.uint8)


@F.pandas_udf(T.DoubleType())
def luminance_spread(data: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series) -> pd.Series:
    """Spread of each image, seen at a width of 200 pixels."""
    return pd.Series([spread(shrink(plane(d, w, h, s))) if w and h else 0.0 for d, w, h, s in zip(data, width, height, stride)])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("degrees", "x0", "y0", "x1", "y1")]))
def skew_of(data: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series) -> pd.DataFrame:
    found = [measure_skew(plane(d, w, h, s)) for d, w, h, s in zip(data, width, height, stride)]
    return pd.DataFrame([(s.degrees, *(s.bounds or (None,) * 4)) for s in found], columns=["degrees", "x0", "y0", "x1", "y1"])


@F.pandas_udf(T.BinaryType())
def enhanced(data: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series) -> pd.Series:
    return pd.Series([enhance(plane(d, w, h, s)).tobytes() for d, w, h, s in zip(data, width, height, stride)])


@F.pandas_udf(T.BinaryType())
def flattened(data: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series) -> pd.Series:
    return pd.Series([flatten(plane(d, w, h, s)).tobytes() for d, w, h, s in zip(data, width, height, stride)])


def with_ink(pages, limit: float = INK_SPREAD):
    """pages (pixels, width, height, stride) with ink; pages without an image have none."""
    return pages.withColumn("ink", F.coalesce(luminance_spread("pixels", "width", "height", "stride") > limit, F.lit(False)))
