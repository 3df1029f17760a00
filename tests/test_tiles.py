"""Images as tiles, against the same rules on whole arrays; skew of points against that of images."""

import contextlib
import threading

import numpy as np
import psutil
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.operators import pixels, skew, tiles


def image_rows(images, by="k"):
    return [(k, x, y, int(v)) for k, image in images.items() for y, row in enumerate(image) for x, v in enumerate(row)]


def as_tiles(spark, images, size):
    rows = spark.createDataFrame(image_rows(images), "k string, x int, y int, value int")
    return tiles.tiles_of(rows, ["k"], size)


def whole(found, size, column="plane", dtype="uint8"):
    out = {}
    for r in found.collect():
        image = out.setdefault(r.k, np.full((r.height, r.width), -1, np.int64))
        (y0, y1), (x0, x1) = tiles._extent(r.ty, size, r.height), tiles._extent(r.tx, size, r.width)
        assert (image[y0:y1, x0:x1] == -1).all()
        image[y0:y1, x0:x1] = np.frombuffer(r[column], dtype).reshape(y1 - y0, x1 - x0)
    return out


RNG = np.random.default_rng(5)
IMAGES = {"page": RNG.integers(0, 256, (70, 90)), "line": RNG.integers(0, 256, (1, 50)), "dot": RNG.integers(0, 256, (1, 1)), "edge": RNG.integers(0, 256, (32, 64)), "tall": RNG.integers(200, 256, (65, 3))}


@pytest.mark.parametrize("radius", [0, 1, 9, 31, 32, 75, 200])
def test_window_sums(spark, radius):
    size = 32
    got = whole(tiles.window_sums(as_tiles(spark, IMAGES, size), ["k"], radius, size), size, "sums", "int64")
    assert got.keys() == IMAGES.keys()
    for k, image in IMAGES.items():
        means = pixels.local_mean(image.astype(float), radius)
        h, w = image.shape
        for y in range(0, h, 7):
            for x in range(0, w, 5):
                part = image[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
                assert got[k][y, x] == part.sum()
                assert means[y, x] == pytest.approx(part.mean())


def test_ink_and_paper(spark):
    size, radius = 32, 5
    page = RNG.integers(200, 256, (80, 100))
    page[20:23, 10:90] = 60
    page[50:53, 30:60] = 100
    images = {"page": page, "blank": np.full((40, 40), 250), "dark": np.zeros((3, 3), int)}
    tiled = as_tiles(spark, images, size)
    papers = {r.k: r.paper for r in tiles.paper(tiled, ["k"], size).collect()}
    assert papers == {k: int(pixels.at_share(v.astype(float), 0.9)) for k, v in images.items()}
    got = {(r.k, r.x, r.y) for r in tiles.ink_points(tiled, ["k"], radius, size).collect()}
    want = set()
    for k, image in images.items():
        g = image.astype(float)
        y, x = np.nonzero((g < 0.72 * pixels.local_mean(g, radius)) & (g < 0.85 * pixels.at_share(g, 0.9)))
        want |= {(k, int(a), int(b)) for a, b in zip(x, y)}
    assert got == want and ("page", 50, 21) in got


@pytest.mark.parametrize("size", [32, 64, 128])
def test_borders_leave_no_trace(spark, size):
    """The same page from tiles of any size, and from an array."""
    got = whole(tiles.enhanced_tiles(as_tiles(spark, IMAGES, size), ["k"], size), size)
    for k, image in IMAGES.items():
        assert (got[k] == pixels.enhance(image.astype(np.uint8))).all(), k


def test_missing_pixels_and_odd_rows(spark):
    rows = [("a", 0, 0, 5), ("a", 70, 0, 7), ("a", 70, 0, 9), ("a", -1, 0, 1), ("a", None, 0, 1), ("a", 1, 0, None), ("b", 0, 2, 300)]
    found = tiles.tiles_of(spark.createDataFrame(rows, "k string, x int, y int, value int"), ["k"], 32)
    got = whole(found, 32)
    assert got["a"].shape == (1, 71) and got["a"][0, 0] == 5 and got["a"][0, 70] == 7 and (got["a"][0, 1:70] == 255).all()
    assert got["b"].tolist() == [[255], [255], [255]] and found.count() == 4
    back = tiles.pixels_of(found, ["k"], 32)
    assert back.count() == 74 and back.where("value = 7").select("k", "tx", "x", "y").first() == ("a", 2, 70, 0)
    assert tiles.window_sums(found.limit(0), ["k"], 2, 32).collect() == [] == tiles.enhanced_tiles(found.limit(0), ["k"], 32).collect()
    with pytest.raises(ValueError):
        tiles.enhanced_tiles(found, ["k"], 40)


def printed(degrees, lines=14, width=600, height=800):
    """Points of lines of text, turned around the middle."""
    a = np.radians(degrees)
    x, y = np.meshgrid(np.arange(60, 540, 7), np.concatenate([np.arange(3) + 100 + 40 * k for k in range(lines)]))
    dx, dy = x.ravel() - width / 2, y.ravel() - height / 2
    return np.floor(width / 2 + dx * np.cos(a) - dy * np.sin(a) + 0.5).astype(int), np.floor(height / 2 + dx * np.sin(a) + dy * np.cos(a) + 0.5).astype(int)


def test_skew_of_points(spark):
    angles = {"straight": 0.0, "little": 0.1, "right": 3.2, "left": -4.1, "more": 6.5, "edge": 10.0}
    rows = [(k, int(a), int(b)) for k, d in angles.items() for a, b in zip(*printed(d))]
    rows += [("few", i, i) for i in range(499)] + [("noise", int(a), int(b)) for a, b in RNG.integers(0, 600, (2000, 2))] + [("right", None, 5), ("unknown", 1, 1)]
    points = spark.createDataFrame(rows, "k string, x int, y int")
    sizes = spark.createDataFrame([(k, 600, 800) for k in [*angles, "few", "noise", "none", "right"]], "k string, width int, height int")
    found = skew.measured(points, sizes, ["k"], 10.0).withColumn("fits", skew.fits())
    got = {r.k: r for r in found.collect()}
    assert len(got) == 9
    for k, d in angles.items():
        assert got[k].degrees == pytest.approx(d if abs(d) >= 0.3 else 0.0, abs=0.25), k
        assert got[k].unsure == (abs(d) < 0.3)
        straight = printed(0)
        assert got[k].x0 == pytest.approx(np.quantile(straight[0], 0.005), abs=8) and got[k].y1 == pytest.approx(np.quantile(straight[1], 0.995), abs=8)
        assert got[k].fits
    assert (got["few"].points, got["few"].degrees, got["few"].x0, got["few"].fits) == (499, 0.0, None, False)
    assert got["noise"].degrees == 0 and got["noise"].unsure and not got["noise"].fits or got["noise"].x0 is not None
    assert (got["none"].points, got["none"].unsure) == (0, True)


def test_ties_stay_with_the_one_in_office(spark):
    """A single column of points has one energy at many angles: straight, which is tried first, stays."""
    points = spark.createDataFrame([("k", 0, 7)] * 600, "k string, x int, y int")
    sizes = spark.createDataFrame([("k", 100, 100)], "k string, width int, height int")
    row = skew.measured(points, sizes, ["k"]).first()
    assert (row.degrees, row.unsure, row.points) == (0.0, True, 600)


def test_pixels_out_of_range_and_given_twice(spark):
    rows = [("k", 0, 0, 300), ("k", 2, 1, -5), ("k", 1, 0, 90), ("k", 1, 0, 40), ("k", 1, 0, 70), ("k", -1, 0, 9), ("k", 0, None, 9), ("k", 5, 0, None), ("k", 4, 3, 255)]
    found = tiles.tiles_of(spark.createDataFrame(rows, "k string, x int, y int, value int"), ["k"], 3, missing=200)
    want = np.full((4, 5), 200)
    want[0, 0], want[1, 2], want[0, 1], want[3, 4] = 255, 0, 40, 255
    assert (whole(found, 3)["k"] == want).all()


def test_batches_are_taken_a_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    parts = list(tiles._few([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) == tiles.AT_ONCE and [v for p in parts for v in p.column(0).to_pylist()] == list(range(1000))


def test_memory_of_python_while_tiles_are_built(spark):
    def peak(pixels):
        grid = spark.range(pixels).selectExpr("1 AS k", "CAST(id % 1000 AS INT) AS x", "CAST(id DIV 1000 AS INT) AS y", "CAST(id % 251 AS INT) AS value")
        most, done = [0], threading.Event()

        def watch():
            while not done.wait(0.02):
                for p in psutil.Process().children(recursive=True):
                    with contextlib.suppress(psutil.Error):
                        most[0] = max(most[0], p.memory_info().rss * ("python" in p.name()))

        watcher = threading.Thread(target=watch)
        watcher.start()
        assert tiles.tiles_of(grid, ["k"], 64).agg(F.sum(F.length("plane"))).first()[0] == pixels
        done.set()
        watcher.join()
        return most[0]

    small = peak(100_000)
    assert peak(3_000_000) < small + 150e6


def test_points_printed_over_each_other_are_one_row(spark, monkeypatch):
    xs, ys = RNG.integers(0, 400, 700), RNG.integers(0, 30, 700) * 17
    times = RNG.integers(1, 30, 700)
    points = spark.createDataFrame([("p", int(x), int(y)) for x, y, n in zip(xs, ys, times) for _ in range(n)], "k string, x int, y int")
    sizes = spark.createDataFrame([("p", 400, 510)], "k string, width int, height int")
    seen, straightened = [], skew._straightened
    monkeypatch.setattr(skew, "_straightened", lambda known, by: seen.append(known.count()) or straightened(known, by))
    row = skew.measured(points, sizes, ["k"], 5.0).first()
    assert row.points == times.sum() and seen == [len({*zip(xs.tolist(), ys.tolist())})]
    x, y, a = np.repeat(xs, times) - 200, np.repeat(ys, times) - 255, np.radians(row.degrees)
    rx, ry = 200 + x * np.cos(a) + y * np.sin(a), 255 - x * np.sin(a) + y * np.cos(a)
    assert (row.x0, row.y0, row.x1, row.y1) == pytest.approx((pixels.at_share(rx, 0.005), pixels.at_share(ry, 0.005), pixels.at_share(rx, 0.995), pixels.at_share(ry, 0.995)))
