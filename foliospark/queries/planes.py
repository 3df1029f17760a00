"""Queries on images: tiles of large sheets, skew of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import skew, tiles
from foliospark.sources.tables import read_table as table

#: Of the sheets below: edge of a tile, reach of a window, orders in a row of pixels.
SIZE, RADIUS, ORDERS = 64, 29, 64


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of two sheets that all lines of orders are printed on: seven pixels an order, darker the more was ordered."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    k = F.floor(F.col("l_orderkey") / 2)
    pixels = lines.select((F.col("l_orderkey") % 2).alias("sheet"), (k % ORDERS * 7 + F.col("l_linenumber") - 1).alias("x"), F.floor(k / ORDERS).alias("y"), (255 - 4 * F.floor("l_quantity")).alias("value"))
    return tiles.tiles_of(pixels, ["sheet"], SIZE)


_GRID = f"""pixels AS (
  SELECT l_orderkey % 2 AS sheet, (l_orderkey // 2) % {ORDERS} * 7 + l_linenumber - 1 AS x, l_orderkey // 2 // {ORDERS} AS y, min(255 - 4 * floor(l_quantity)::BIGINT) AS v
  FROM lineitem GROUP BY ALL
), sizes AS (
  SELECT sheet, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY sheet
), places AS (
  SELECT sheet, width, height, y, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height)) AS y FROM sizes)
), grid AS (
  SELECT p.sheet, p.width, p.height, p.x, p.y, coalesce(q.v, 255) AS v FROM places p LEFT JOIN pixels q ON p.sheet = q.sheet AND p.x = q.x AND p.y = q.y
)"""


def window_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tile: pixels, the sum of all sums over windows around them, and one weighted by the pixels' places."""
    found = tiles.window_sums(sheets(spark, sf_dir), ["sheet"], RADIUS, SIZE)
    each = tiles.pixels_of(found, ["sheet"], SIZE, "sums", "int64")
    return each.groupBy("sheet", "ty", "tx").agg(F.count("*").alias("pixels"), F.sum("value").alias("total"), F.sum(F.col("value") * (1 + (F.col("x") + 3 * F.col("y")) % 7)).alias("weighted"))


def _around(radius: int) -> str:
    over = f"RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""rows_ AS (
  SELECT *, sum(v) OVER (PARTITION BY sheet, y ORDER BY x {over}) AS row_sum, count(*) OVER (PARTITION BY sheet, y ORDER BY x {over}) AS row_n FROM grid
), around AS (
  SELECT *, sum(row_sum) OVER (PARTITION BY sheet, x ORDER BY y {over}) AS s, sum(row_n) OVER (PARTITION BY sheet, x ORDER BY y {over}) AS n FROM rows_
)"""


WINDOW_SUMS = f"""
WITH {_GRID}, {_around(RADIUS)}
SELECT sheet, (y // {SIZE})::INT AS ty, (x // {SIZE})::INT AS tx, count(*) AS pixels, sum(s)::BIGINT AS total, sum(s * (1 + (x + 3 * y) % 7))::BIGINT AS weighted FROM around GROUP BY ALL
"""


def sheet_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ink point of the sheets."""
    return tiles.ink_points(sheets(spark, sf_dir), ["sheet"], RADIUS, SIZE)


SHEET_INK = f"""
WITH {_GRID}, {_around(RADIUS)}, paper AS (
  SELECT sheet, v AS paper FROM (SELECT sheet, v, row_number() OVER (PARTITION BY sheet ORDER BY v) AS place, count(*) OVER (PARTITION BY sheet) AS n FROM grid)
  WHERE place = least(n - 1, n * 9 // 10) + 1
)
SELECT sheet, x::INT AS x, y::INT AS y FROM around JOIN paper USING (sheet) WHERE 100 * v * n < 72 * s AND 100 * v < 85 * paper
"""


def enhanced_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tile of the sheets made legible: the sum of its pixels, one weighted by place, and its white and black pixels."""
    each = tiles.pixels_of(tiles.enhanced_tiles(sheets(spark, sf_dir), ["sheet"], SIZE), ["sheet"], SIZE)
    value = F.col("value")
    return each.groupBy("sheet", "ty", "tx").agg(F.sum(value).alias("total"), F.sum(value * (1 + (F.col("x") + 3 * F.col("y")) % 7)).alias("weighted"), F.count_if(value == 255).alias("white"), F.count_if(value == 0).alias("black"))


ENHANCED_SHEETS = f"""
WITH {_GRID}, {_around(1)}, nine AS (
  SELECT sheet, x, y, CASE WHEN n = 9 THEN s ELSE 0 END AS nine FROM around
), blocks AS (
  SELECT *, row_number() OVER (PARTITION BY sheet, y // 32, x // 32 ORDER BY nine) AS place, count(*) OVER (PARTITION BY sheet, y // 32, x // 32) AS n FROM nine
), paper AS (
  SELECT sheet, y // 32 AS b, x // 32 AS a, CASE WHEN nine = 0 THEN 2295 ELSE nine END AS paper FROM blocks WHERE place = n * 9 // 10 + 1
), done AS (
  SELECT q.sheet, q.x, q.y, floor(255 * pow(greatest(0::DOUBLE, (least(1::DOUBLE, q.nine::DOUBLE / p.paper::DOUBLE) - 0.72::DOUBLE) / 0.28::DOUBLE), 1.4::DOUBLE) + 0.5::DOUBLE)::BIGINT AS v
  FROM nine q JOIN paper p ON p.sheet = q.sheet AND p.b = q.y // 32 AND p.a = q.x // 32
)
SELECT sheet, (y // {SIZE})::INT AS ty, (x // {SIZE})::INT AS tx, sum(v)::BIGINT AS total, sum(v * (1 + (x + 3 * y) % 7))::BIGINT AS weighted, count(*) FILTER (v = 255) AS white, count(*) FILTER (v = 0) AS black FROM done GROUP BY ALL
"""

#: Of the pages below: width, height, angles that are tried, degrees between the pages' own angles.
WIDTH, HEIGHT, MOST_DEGREES, APART = 1000, 1300, 10.0, 1.3

_POINTS = f"""SELECT page, CAST(floor(500 + dx * cos(radians(own)) - dy * sin(radians(own)) + 0.5e0) AS BIGINT) AS x, CAST(floor(650 + dx * sin(radians(own)) + dy * cos(radians(own)) + 0.5e0) AS BIGINT) AS y
FROM (SELECT l_suppkey % 50 AS page, CAST((l_suppkey % 50) % 13 - 6 AS DOUBLE) * {APART}e0 AS own, CAST(50 + l_partkey % 900 - 500 AS DOUBLE) AS dx, CAST(60 + 40 * (l_orderkey % 29) + l_linenumber % 3 - 650 AS DOUBLE) AS dy FROM lineitem) AS lines"""


def skewed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, angle and bounds of pages of printed lines, each page turned by an angle of its own; whether it fits once straight."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    points = spark.sql(_POINTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    sizes = points.select("page").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
    found = skew.measured(points, sizes, ["page"], MOST_DEGREES).withColumn("fits", skew.fits())
    return found.select("page", "points", "degrees", "unsure", "fits", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _energy(points: str, candidates: str) -> str:
    return f"""SELECT page, rank, angle, sum(n * n) AS energy FROM (
    SELECT page, rank, angle, floor((y * cos(radians(angle)) - x * sin(radians(angle)) + abs({WIDTH} * sin(radians(angle)))) / 3) AS bin, count(*) AS n FROM {points} JOIN {candidates} GROUP BY ALL
  ) GROUP BY ALL"""


SKEWED_PAGES = f"""
WITH points AS ({_POINTS}), counted AS (SELECT page, count(*) AS points FROM points GROUP BY page),
inked AS (SELECT points.* FROM points JOIN counted c USING (page) WHERE c.points >= 500),
coarse AS (SELECT 0 AS rank, 0.0::DOUBLE AS angle UNION ALL SELECT k + 1, -{MOST_DEGREES}::DOUBLE + 0.5::DOUBLE * k FROM (SELECT unnest(range({int(4 * MOST_DEGREES) + 1})) AS k)),
first AS ({_energy('inked', 'coarse ON true')}),
won AS (SELECT page, angle, energy, straight FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY energy DESC, rank) AS place, max(CASE WHEN rank = 0 THEN energy END) OVER (PARTITION BY page) AS straight FROM first) WHERE place = 1),
fine AS (SELECT page AS p, k + 1 AS rank, angle - 0.5::DOUBLE + k * 0.1::DOUBLE AS angle FROM (SELECT *, unnest(range(11)) AS k FROM won)),
tried AS (SELECT page, 0 AS rank, angle, energy FROM won UNION ALL {_energy('inked', 'fine ON fine.p = inked.page')}),
best AS (SELECT t.page, t.angle, abs(t.angle) < 0.3 OR t.energy < w.straight * 1.03::DOUBLE AS unsure FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY energy DESC, rank) AS place FROM tried) t JOIN won w USING (page) WHERE t.place = 1),
decided AS (SELECT page, unsure, CASE WHEN unsure THEN 0.0::DOUBLE ELSE floor(angle * 10 + 0.5::DOUBLE) / 10 END AS degrees FROM best),
moved AS (
  SELECT page, {WIDTH / 2}::DOUBLE + (x - {WIDTH / 2}::DOUBLE) * cos(radians(degrees)) + (y - {HEIGHT / 2}::DOUBLE) * sin(radians(degrees)) AS rx,
         {HEIGHT / 2}::DOUBLE - (x - {WIDTH / 2}::DOUBLE) * sin(radians(degrees)) + (y - {HEIGHT / 2}::DOUBLE) * cos(radians(degrees)) AS ry FROM inked JOIN decided USING (page)
),
placed AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, row_number() OVER (PARTITION BY page ORDER BY rx) AS px, row_number() OVER (PARTITION BY page ORDER BY ry) AS py FROM moved),
bounds AS (
  SELECT page, max(CASE WHEN px = least(n - 1, n * 5 // 1000) + 1 THEN rx END) AS x0, max(CASE WHEN py = least(n - 1, n * 5 // 1000) + 1 THEN ry END) AS y0,
         max(CASE WHEN px = least(n - 1, n * 995 // 1000) + 1 THEN rx END) AS x1, max(CASE WHEN py = least(n - 1, n * 995 // 1000) + 1 THEN ry END) AS y1
  FROM placed GROUP BY page
)
SELECT page, points, coalesce(degrees, 0) AS degrees, coalesce(unsure, true) AS unsure, coalesce(x0 >= 4 AND y0 >= 4 AND x1 <= {WIDTH - 4} AND y1 <= {HEIGHT - 4}, false) AS fits,
       round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1
FROM counted LEFT JOIN decided USING (page) LEFT JOIN bounds USING (page)
"""


def queries():
    return {f.__name__: f for f in (window_sums, sheet_ink, enhanced_sheets, skewed_pages)}


def oracle_sql():
    return {"window_sums": WINDOW_SUMS, "sheet_ink": SHEET_INK, "enhanced_sheets": ENHANCED_SHEETS, "skewed_pages": SKEWED_PAGES}
