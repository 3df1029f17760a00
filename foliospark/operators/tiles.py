"""Pixel work on images of any size: an image is a table of square tiles, and no task holds more than a tile and its neighbours.

A tile is a row: the image's keys, ty and tx (its place among the tiles), height and width (of the whole image) and plane, its grey
pixels as bytes, row by row. Tiles are `size` pixels wide and high, those at the right and lower edge what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SIZE = 256
#: Tiles that a task works on at a time, whatever the size of the batches that it is given.
AT_ONCE = 32
#: Edge of the blocks whose paper is estimated, and the share of a block's pixels that are at most as bright.
BLOCK, PAPER_SHARE = 32, 0.9


def _extent(tile, size: int, whole: int) -> tuple[int, int]:
    """First row (or column) of a tile and the one after its last."""
    return tile * size, min(whole, (tile + 1) * size)


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in names]


def _few(batches):
    """The rows of batches, AT_ONCE at a time: what Python makes of a batch is many times its size."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def tiles_of(pixels: DataFrame, by: list[str], size: int = SIZE, x: str = "x", y: str = "y", value: str = "value", missing: int = 255) -> DataFrame:
    """Tiles of pixels that are rows: keys, x and y (from 0) and value (0 to 255); height and width follow from the largest.

    Pixels that aren't there are `missing`, also in tiles without any; of a pixel given twice the darkest counts; rows with a
    null or negative place, or without a value, are passed over.
    """
    good = pixels.where((F.col(x) >= 0) & (F.col(y) >= 0) & F.col(value).isNotNull()).select(*by, F.col(x).cast("int").alias("__x"), F.col(y).cast("int").alias("__y"), F.col(value).cast("int").alias("__v"))
    sizes = good.groupBy(*by).agg((F.max("__y") + 1).alias("height"), (F.max("__x") + 1).alias("width"))
    grid = sizes.withColumn("ty", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / size).cast("int")))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / size).cast("int"))))
    # a pixel is one number: place in its tile, then value
    at = F.col("__y") % size * F.lit(size).cast("long") + F.col("__x") % size
    there = good.groupBy(*by, F.floor(F.col("__y") / size).cast("int").alias("ty"), F.floor(F.col("__x") / size).cast("int").alias("tx")).agg(F.collect_list(at * 256 + F.greatest(F.lit(0), F.least(F.lit(255), "__v"))).alias("__some"))
    joined = grid.join(there, [*by, "ty", "tx"], "left").select(*by, "ty", "tx", "height", "width", "__some")
    fields = [*_fields(joined, [*by, "ty", "tx", "height", "width"]), T.StructField("plane", T.BinaryType())]
    kinds = to_arrow_schema(T.StructType(fields))

    def run(batches):
        for batch in _few(batches):
            made = []
            for ty, tx, height, width, some in zip(*(c.to_pylist() for c in batch.columns[len(by) : -1]), batch.column("__some")):
                (y0, y1), (x0, x1) = _extent(ty, size, height), _extent(tx, size, width)
                plane = np.full((y1 - y0, x1 - x0), missing, np.uint8)
                if some.is_valid:
                    at, values = np.divmod(some.values.to_numpy(), 256)
                    order = np.argsort(-values, kind="stable")  # the darkest is written last
                    plane[at[order] // size, at[order] % size] = values[order]
                made.append(plane.tobytes())
            yield pa.RecordBatch.from_arrays([*[c.cast(k.type) for c, k in zip(batch.columns[:-1], kinds)], pa.array(made, pa.binary())], schema=kinds)

    return joined.mapInArrow(run, T.StructType(fields))


def _plane(raw: bytes, ty: int, tx: int, height: int, width: int, size: int) -> np.ndarray:
    (y0, y1), (x0, x1) = _extent(ty, size, height), _extent(tx, size, width)
    return np.frombuffer(raw, np.uint8).reshape(y1 - y0, x1 - x0)


def with_carries(tiles: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """tiles with what the two-dimensional prefix sums of an image bring into each: left, up (arrays) and corner.

    left[i] is the sum of row i in all tiles to the left, up[j] that of column j in all tiles above, corner the sum of all tiles
    both above and to the left. A tile sends its rows' and columns' sums only; windows run along rows and columns of tiles.
    """
    fields = [*_fields(tiles, [*by, "ty", "tx"]), T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("cols", T.ArrayType(T.LongType()))]
    kinds = to_arrow_schema(T.StructType(fields))

    def totals(batches):
        for batch in _few(batches):
            rows, cols = [], []
            for ty, tx, height, width, raw in zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "height", "width", "plane"))):
                plane = _plane(raw, ty, tx, height, width, size).astype(np.int64)
                rows.append(plane.sum(1))
                cols.append(plane.sum(0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(kinds.field(c).type) for c in (*by, "ty", "tx")], pa.array(rows, kinds.field("rows").type), pa.array(cols, kinds.field("cols").type)], schema=kinds)

    sums = tiles.mapInArrow(totals, T.StructType(fields))
    place = [*by, "ty", "tx"]

    def carried(column: str, fixed: str, along: str, to: str) -> DataFrame:
        each = sums.select(*place, F.posexplode(column).alias("i", "own"))
        before = Window.partitionBy(*by, fixed, "i").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        run = each.withColumn("sum", F.coalesce(F.sum("own").over(before), F.lit(0)))
        return run.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sum"))), lambda e: e["sum"]).alias(to))

    whole = sums.select(*place, F.aggregate("rows", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))
    beside = whole.withColumn("beside", F.coalesce(F.sum("total").over(Window.partitionBy(*by, "ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    corner = beside.select(*place, F.coalesce(F.sum("beside").over(Window.partitionBy(*by, "tx").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("corner"))
    return tiles.join(carried("rows", "ty", "tx", "left"), place).join(carried("cols", "tx", "ty", "up"), place).join(corner, place)


def _per_tile(lent: DataFrame, by: list[str], size: int, work, fields: list[T.StructField]) -> DataFrame:
    """work(ty, tx, height, width, rows lent to it as dicts) for each tile; it returns a value for each of fields."""
    place = ["ty", "tx", "height", "width"]
    schema = T.StructType([*_fields(lent, [*by, *place]), *fields])
    kinds = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        head = table.slice(0, 1)
        made = work(*(head[c][0].as_py() for c in place), table.drop_columns([*by, *place]).to_pylist())
        return pa.Table.from_arrays([*[head[c].combine_chunks().cast(kinds.field(c).type) for c in (*by, *place)], *[pa.array([v], f.type) for v, f in zip(made, list(kinds)[len(by) + len(place) :])]], schema=kinds)

    return lent.groupBy(*by, "ty", "tx").applyInArrow(run, schema)


def window_sums(tiles: DataFrame, by: list[str], radius: int, size: int = SIZE) -> DataFrame:
    """Keys, ty, tx, height, width, plane, and sums (bytes of int64): for each pixel the sum over the square around it that
    reaches `radius` pixels to all sides, as far as it lies on the image. Any radius; tiles without pixels give no row.

    The sum of a square follows from four prefix sums. Those lie in other tiles: each tile lends itself, with its carries, to the
    tiles that look up one in it, of which there are nine if the radius isn't larger than a tile.
    """
    def reached(tile: str, whole: str):
        """Numbers of the tiles that look up a prefix sum in this one: behind a square's end, or before its beginning."""
        last = F.floor((F.col(whole) - 1) / size).cast("int")
        t, n = F.col(tile), F.col(whole)

        def looked_up(of):
            first, end = of * size, F.least((of + 1) * size, n) - 1
            mine, mine_end = t * size, F.least((t + 1) * size, n) - 1
            ends = (F.least(n - 1, first + radius) <= mine_end) & (F.least(n - 1, end + radius) >= mine)
            begins = (end - radius - 1 >= mine) & (first - radius - 1 <= mine_end)
            return ends | begins

        low = F.greatest(F.lit(0), F.floor((t * size - radius) / size).cast("int") - 1)
        return F.filter(F.sequence(low, F.greatest(low, F.least(last, F.floor(((t + 1) * size + radius) / size).cast("int") + 1))), looked_up)

    carried = with_carries(tiles, by, size)
    lent = carried.select(*by, F.col("ty").alias("sy"), F.col("tx").alias("sx"), "height", "width", "plane", "left", "up", "corner", F.explode(reached("ty", "height")).alias("ty"), reached("tx", "width").alias("__tx")).withColumn("tx", F.explode("__tx")).drop("__tx")

    def work(ty, tx, height, width, rows):
        (y0, y1), (x0, x1) = _extent(ty, size, height), _extent(tx, size, width)
        ys, xs = np.arange(y0, y1), np.arange(x0, x1)
        total, own = np.zeros((y1 - y0, x1 - x0), np.int64), None
        for row in rows:
            plane = _plane(row["plane"], row["sy"], row["sx"], height, width, size)
            if (row["sy"], row["sx"]) == (ty, tx):
                own = row["plane"]
            prefix = plane.astype(np.int64).cumsum(0).cumsum(1) + np.cumsum(row["left"])[:, None] + np.cumsum(row["up"])[None, :] + row["corner"]
            (sy0, sy1), (sx0, sx1) = _extent(row["sy"], size, height), _extent(row["sx"], size, width)
            for sign_y, at_y in ((1, np.minimum(height - 1, ys + radius)), (-1, ys - radius - 1)):
                for sign_x, at_x in ((1, np.minimum(width - 1, xs + radius)), (-1, xs - radius - 1)):
                    iy, ix = np.flatnonzero((at_y >= sy0) & (at_y < sy1)), np.flatnonzero((at_x >= sx0) & (at_x < sx1))
                    if len(iy) and len(ix):
                        total[np.ix_(iy, ix)] += sign_y * sign_x * prefix[np.ix_(at_y[iy] - sy0, at_x[ix] - sx0)]
        return own, total.tobytes()

    # a tile always lends itself to itself if the radius is smaller than a tile; else its plane is joined back
    found = _per_tile(lent, by, size, work, [T.StructField("plane", T.BinaryType()), T.StructField("sums", T.BinaryType())])
    if radius < size:
        return found
    return found.drop("plane").join(tiles.select(*by, "ty", "tx", "plane"), [*by, "ty", "tx"])


def squares(ty: int, tx: int, height: int, width: int, radius: int, size: int) -> np.ndarray:
    """Pixels of the square around each pixel of a tile that lie on the image."""
    def reach(first, end, whole):
        at = np.arange(first, end)
        return np.minimum(whole, at + radius + 1) - np.maximum(0, at - radius)

    return np.outer(reach(*_extent(ty, size, height), height), reach(*_extent(tx, size, width), width))


def paper(tiles: DataFrame, by: list[str], size: int = SIZE, share: float = PAPER_SHARE) -> DataFrame:
    """Keys and paper: the grey value at place floor(n x share) of an image's ordered pixels. Tiles send a count for each value."""
    fields = [*_fields(tiles, by), T.StructField("value", T.IntegerType()), T.StructField("n", T.LongType())]
    kinds = to_arrow_schema(T.StructType(fields))

    def counted(batches):
        for batch in _few(batches):
            for i, raw in enumerate(batch.column("plane").to_pylist()):
                counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                met = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[i], len(met)).cast(kinds.field(c).type) for c in by], pa.array(met, pa.int32()), pa.array(counts[met], pa.int64())], schema=kinds)

    counts = tiles.mapInArrow(counted, T.StructType(fields)).groupBy(*by, "value").agg(F.sum("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("value"))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return upto.where(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * share))).groupBy(*by).agg(F.min("value").alias("paper"))


def ink_points(tiles: DataFrame, by: list[str], radius: int, size: int = SIZE) -> DataFrame:
    """Keys, x, y of the pixels that are clearly darker than their surroundings and than the image's paper.

    The thresholds, 0.72 of the mean around a pixel and 0.85 of the paper, are compared as whole numbers.
    """
    fields = [*_fields(tiles, by), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]
    kinds = to_arrow_schema(T.StructType(fields))
    known = window_sums(tiles, by, radius, size).join(paper(tiles, by, size), by)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ty, tx, height, width, raw, sums, white = (batch.column(c)[i].as_py() for c in ("ty", "tx", "height", "width", "plane", "sums", "paper"))
                plane = _plane(raw, ty, tx, height, width, size).astype(np.int64)
                y, x = np.nonzero((100 * plane * squares(ty, tx, height, width, radius, size) < 72 * np.frombuffer(sums, np.int64).reshape(plane.shape)) & (100 * plane < 85 * white))
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[i], len(x)).cast(kinds.field(c).type) for c in by], pa.array(x + tx * size, pa.int32()), pa.array(y + ty * size, pa.int32())], schema=kinds)

    return known.mapInArrow(run, T.StructType(fields))


def _with_halos(tiles: DataFrame, by: list[str], size: int) -> DataFrame:
    """Each tile as rows for itself and its eight neighbours: itself whole, to the others the edge or corner that they touch."""
    fields = [*_fields(tiles, [*by, "ty", "tx", "height", "width"]), *[T.StructField(c, T.IntegerType()) for c in ("dy", "dx")], T.StructField("piece", T.BinaryType())]
    kinds = to_arrow_schema(T.StructType(fields))

    def run(batches):
        for batch in _few(batches):
            rows = []
            for *keys, ty, tx, height, width, raw in zip(*(batch.column(c).to_pylist() for c in (*by, "ty", "tx", "height", "width", "plane"))):
                plane = _plane(raw, ty, tx, height, width, size)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        to_y, to_x = ty + dy, tx + dx
                        if 0 <= to_y * size < height and 0 <= to_x * size < width:
                            part = plane[{-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dy], {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dx]]
                            rows.append((*keys, to_y, to_x, height, width, -dy, -dx, part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k.type) for v, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k.type) for k in kinds], schema=kinds)

    return tiles.mapInArrow(run, T.StructType(fields))


def enhanced_tiles(tiles: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Tiles of a faded page for reading: noise dampened by 3 x 3 means, paper white by blocks, ink darkened; plane is replaced.

    Each tile lends its edges to its neighbours, so that the borders between tiles leave no trace. A block's paper is looked up in
    the grid of its tile, which must consist of whole blocks of 32 pixels. The border of the whole image becomes ink.
    """
    if size % BLOCK:
        raise ValueError(f"size must be a multiple of {BLOCK}")

    def work(ty, tx, height, width, rows):
        (y0, y1), (x0, x1) = _extent(ty, size, height), _extent(tx, size, width)
        h, w = y1 - y0, x1 - x0
        near = np.zeros((h + 2, w + 2), np.int64)
        for row in rows:
            at = [{-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}[row[d]] for d in ("dy", "dx")]
            near[at[0], at[1]] = np.frombuffer(row["piece"], np.uint8).reshape(near[at[0], at[1]].shape)
        nine = sum(near[i : i + h, j : j + w] for i in range(3) for j in range(3))
        inner = np.zeros((h, w), bool)
        inner[max(0, 1 - y0) : height - 1 - y0, max(0, 1 - x0) : width - 1 - x0] = True
        nine[~inner] = 0
        grid = np.empty((-(-h // BLOCK), -(-w // BLOCK)), np.int64)
        for by_, bx in np.ndindex(*grid.shape):
            block = np.sort(nine[by_ * BLOCK : (by_ + 1) * BLOCK, bx * BLOCK : (bx + 1) * BLOCK], axis=None)
            grid[by_, bx] = block[int(block.size * PAPER_SHARE)] or 255 * 9
        ratio = np.minimum(1, nine / grid[np.arange(h)[:, None] // BLOCK, np.arange(w)[None, :] // BLOCK])
        return (np.floor(255 * np.maximum(0, (ratio - 0.72) / 0.28) ** 1.4 + 0.5).astype(np.uint8).tobytes(),)

    return _per_tile(_with_halos(tiles, by, size), by, size, work, [T.StructField("plane", T.BinaryType())])


def pixels_of(tiles: DataFrame, by: list[str], size: int = SIZE, column: str = "plane", dtype: str = "uint8") -> DataFrame:
    """Keys, ty, tx, x, y and value (long) of every pixel of a column of bytes, numbers of dtype."""
    fields = [*_fields(tiles, [*by, "ty", "tx"]), *[T.StructField(c, T.IntegerType()) for c in ("x", "y")], T.StructField("value", T.LongType())]
    kinds = to_arrow_schema(T.StructType(fields))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ty, tx, height, width = (batch.column(c)[i].as_py() for c in ("ty", "tx", "height", "width"))
                values = np.frombuffer(batch.column(column)[i].as_py(), dtype)
                y, x = (a.ravel() for a in np.mgrid[slice(*_extent(ty, size, height)), slice(*_extent(tx, size, width))])
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[i], len(x)).cast(kinds.field(c).type) for c in (*by, "ty", "tx")], pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(values, pa.int64())], schema=kinds)

    return tiles.mapInArrow(run, T.StructType(fields))
