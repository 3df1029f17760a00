import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.operators import layout, lines, overlay, quality, reading
from foliospark.plans.recognise import items_from_tsv


def test_layer_quality(spark):
    garbage = ["".join("#*-:;/|"[(i * k) % 7] for i in range(1, 14)) + f" {k}x" for k in range(1, 8)]
    normal = ["Lieferschein Nr. 88-1203", "Gewicht: 12,75 kg netto", "Gärtnerei Öhlmann OHG"]
    runs = [("junk", t) for t in garbage] + [("fine", t) for t in normal] + [("short", "7 %"), ("short", "§"), ("none", None)]
    rows = {r.page: r for r in quality.layer_quality(spark.createDataFrame(runs, "page string, text string"), ["page"]).withColumn("junk", quality.is_junk(F.col("chars"), F.col("plausible_share"))).collect()}
    assert {k: r.junk for k, r in rows.items()} == {"junk": True, "fine": False, "short": False, "none": False}
    assert (rows["none"].chars, rows["none"].plausible_share) == (0, 0.0)
    whole = quality.with_quality(spark.createDataFrame([(1, "ab ..  cd")], "id int, text string")).first()
    assert (whole.chars, whole.plausible_share) == (6, pytest.approx(4 / 6))


def test_the_three_percentiles(spark):
    values = spark.createDataFrame([("a", v) for v in range(10)] + [("b", 5), ("b", None), ("c", 0)], "g string, v int")
    by = lambda f, **k: {r.g: r.p for r in f(values, ["g"], "v", 0.9, "p", **k).collect()}
    assert by(quality.percentile_by_index) == {"a": 9, "b": 5, "c": 0}
    assert by(quality.percentile_by_histogram) == {"a": 8, "b": 5, "c": 1}
    assert {r.g: r.m for r in quality.percentile_by_index(values.where("v < 4"), ["g"], "v", 0.5, "m").collect()} == {"a": 2, "c": 0}
    assert {r.g: r.m for r in quality.percentile_by_index(values, ["g"], "v", 1.0, "m", clamp=True).collect()} == {"a": 9, "b": 5, "c": 0}
    assert {r.g: r.m for r in quality.percentile_by_index(values, ["g"], "v", 1.0, "m").collect()}["a"] is None


def test_ties_go_to_the_one_in_office(spark):
    scores = spark.createDataFrame([("p", 0.0, 5, 0), ("p", -3.0, 7, 1), ("p", 2.0, 7, 2)], "page string, angle double, score long, o int")
    assert quality.best_by(scores, ["page"], "angle", "score", "o").first().angle == -3.0


def tsv(*rows):
    return "\n".join("\t".join(map(str, r)) for r in rows)


def word(block, line, place, left, top, width, height, conf, text, level=5):
    return (level, 1, block, 1, line, place, left, top, width, height, conf, text)


#: Two words side by side, noise, a blank one, a wide gap, one without a width that is a number, one with a tab, a torn row.
TABLE = tsv(
    ("level", "page", "block", "par", "line", "word", "x", "y", "w", "h", "confidence", "token"), word(1, 1, 0, 30, 70, 250, 22, -1, "", level=4),
    word(1, 1, 1, 30, 70, 110, 22, 80, "Garten"), word(1, 1, 2, 150, 72, 130, 25, 61, "zaun"), word(1, 2, 1, 30, 140, 50, 18, -1, "  "), word(1, 2, 2, 90, 140, 44, 18, 33, "=+="),
    word(2, 1, 1, 40, 210, 70, 20, 77, "vorn"), word(2, 1, 2, 200, 210, 70, 20, 79, "hinten"), word(3, 1, 1, 5, 300, "wide", 20, 90, "lost"), word(3, 1, 2, "", 300, 25, 20, 90, "c\td"), (5, 1, 3, 1),
)


def test_words_become_lines(spark):
    pages = spark.createDataFrame([("d", 1, TABLE.replace("\n", "\r\n"))], "doc string, page int, tsv string")
    words = lines.words_from_tsv(pages, ["doc", "page"])
    assert [r.text for r in words.orderBy("seq").collect()] == ["Garten", "zaun", "=+=", "vorn", "hinten", "c\td"]
    found = lines.lines_from_words(words, ["doc", "page"], ["block", "par", "line"]).orderBy("first_seq", "segment").collect()
    assert [r.text for r in found] == ["Garten zaun", "=+=", "vorn", "hinten", "c\td"]
    first = found[0]
    assert (first.x, first.y, first.w, first.h, first.conf) == (30, 70, 250, 27, pytest.approx(70.5))
    kept = lines.lines_from_words(words, ["doc", "page"], ["block", "par", "line"]).where(lines.keep_line(F.col("text"), F.col("w"), F.col("h"), F.col("conf"))).count()
    assert kept == 4


def test_items_of_a_page(spark):
    scale = 3.0
    table = tsv(word(1, 1, 1, 150, 300, 600, 50, 85, "Kopfzeile"), word(1, 2, 1, 12, 9, 40, 30, 85, "=+="))
    pages = spark.createDataFrame([("d", 1, table, scale, 800.0), ("d", 2, table, scale, 800.0)], "doc string, page int, tsv string, scale double, page_height double")
    digital = spark.createDataFrame([("d", 2, True)], "doc string, page int, digital boolean")
    (item,) = items_from_tsv(pages, ["doc", "page"], digital).collect()
    assert (item.id, item.page, item.text) == (0, 1, "Kopfzeile") and item.width == pytest.approx(200)
    assert item.transform[4:] == [pytest.approx(50), pytest.approx(800 - 340 / 3)] and item.transform[0] == pytest.approx(40 / 3)
    view = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 800.0)])
    box = spark.createDataFrame([item]).select(G.box_per_mille(F.col("transform"), F.col("width"), F.lit(40 / 3), view, F.lit(500.0), F.lit(800.0)).alias("b")).first().b
    assert (box.x, box.y, box.w, box.h) == (100, 125, 400, 17)


def test_a_table_is_made_and_taken_apart_once(spark):
    made = spark.range(40).selectExpr("id div 4 as doc", "concat_ws('\t', '5', 1, 1, 1, 1, id % 4, id % 4 * 60, 10, 50, 20, 90, concat('w', id)) as row")
    pages = made.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("tsv")).withColumns({"scale": F.col("doc") % 3 + 1.0, "page_height": F.col("doc") + 100.0})
    found = items_from_tsv(pages, ["doc"], F.col("doc") % 5 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Range (") == 1 and "Join" not in plan
    assert not [line for line in plan.splitlines() if line.strip(" +-:*()0123456789").startswith("Filter") and "split(" in line]
    rows = {r.doc: r for r in found.collect()}
    assert {d: r.text for d, r in rows.items()} == {d: " ".join(f"w{4 * d + k}" for k in range(4)) for d in range(10) if d % 5}
    assert all((r.width, r.transform[5]) == (pytest.approx(230 / (d % 3 + 1)), pytest.approx(d + 100 - 26 / (d % 3 + 1))) for d, r in rows.items())
    by_table = items_from_tsv(pages, ["doc"], spark.createDataFrame([(0, True), (5, True), (7, None), (8, False)], "doc long, digital boolean"))
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, rows.values()))


def test_skewed_pages_go_back(spark):
    pages = spark.createDataFrame([("d", tsv((5, 1, 1, 1, 1, 1, 400, 480, 200, 40, 90, "Mitte")), 1.0, 1000.0, 3.0, 1000, 1000, 1000, 1000)], "doc string, tsv string, scale double, page_height double, skew double, straight_width int, straight_height int, image_width int, image_height int")
    (item,) = items_from_tsv(pages, ["doc"]).collect()
    import math

    assert math.degrees(math.atan2(item.transform[1], item.transform[0])) == pytest.approx(-3)
    assert item.width == pytest.approx(200)


def test_reading_order(spark):
    items = spark.createDataFrame([(1, 0, "a", 700.0, 12.0), (1, 1, "b", 703.0, 12.0), (1, 2, " ", 0.0, 12.0), (1, 3, "c", 680.0, 0.0), (1, 4, "d", 676.0, 0.0), (1, 5, "e", 670.0, -12.0), (2, 0, "", 1.0, 1.0)], "page int, id int, text string, y double, line_height double")
    assert {r.page: r.text for r in reading.page_text(items, ["page"]).collect()} == {1: "a b\nc d e"}
    runs = spark.createDataFrame([("d", 1, 0, "a", False), ("d", 1, 1, "b", True), ("d", 2, 0, " ", False)], "doc string, page int, id int, text string, ends_line boolean")
    assert reading.plain_text(runs, ["doc"]).first().text == f"=== Seite 1 ===\nab\n\n\n=== Seite 2 ===\n{reading.NO_TEXT}"


def test_chunks_cover_all_boxes_once(spark):
    got = [r.c for r in spark.range(501).select(reading.chunk_of(F.col("id")).alias("c")).collect()]
    assert [got.count(k) for k in (0, 1, 2)] == [250, 250, 1]


def test_overlay(spark):
    boxes = spark.createDataFrame([(4, "Gartenzaum"), (5, "=+="), (7, "Holz")], "id int, text string").withColumn("p", F.lit(1))
    fixes = spark.createDataFrame([(1, 4, "Garten", 0), (1, 4, "Gartenzaun", 2), (1, 5, "", 1), (1, 7, "\tHolz ", 3), (1, 6, "y", 4), (2, 4, "y", 5)], "p int, id int, text string, seq int")
    last = overlay.last_of_each(overlay.known_only(fixes, boxes, ["p"]), ["p"])
    assert {(r.id, r.text, r.seq) for r in last.collect()} == {(4, "Gartenzaun", 0), (5, "", 1), (7, "\tHolz ", 3)}
    done = overlay.overlaid(boxes, last, ["p"])
    assert {r.id for r in overlay.real_changes(done).collect()} == {4, 5} and {r.id for r in overlay.live(done).collect()} == {4, 7}


def test_emptied_neighbours_are_taken_in(spark):
    """Five words of width 30 on a line of height 12, with gaps of 10, 10, 17 and 19; the bound is 18."""
    starts = [0.0, 40.0, 80.0, 127.0, 176.0]

    def page(texts):
        return [(i, f"w{i}", texts.get(i, f"w{i}"), [12.0, 0.0, 0.0, 12.0, x, 500.0], 30.0) for i, x in enumerate(starts)]

    cases = [
        ({1: "w1 and w2", 2: ""}, 1, 40.0, 70.0),  # the one behind
        ({2: "all of them", 0: "", 1: "", 3: ""}, 2, 0.0, 157.0),  # on both sides, up to a gap of 17
        ({3: "not so far", 4: ""}, 3, 127.0, 30.0),  # a gap of 19 ends the search
        ({0: "w0 and w2", 2: ""}, 0, 0.0, 30.0),  # so does one that isn't emptied
        ({0: "x", 1: ""}, 0, 0.0, 30.0),  # a text that has shrunk takes nothing in
    ]
    pages = spark.createDataFrame([(k, page(t)) for k, (t, *_) in enumerate(cases)], "k int, items array<struct<id int, str string, text string, transform array<double>, width double>>")
    rows = {r.k: r["items"] for r in overlay.widened(pages).collect()}
    for k, (_, i, x, width) in enumerate(cases):
        assert (rows[k][i].transform[4], rows[k][i].width) == (pytest.approx(x), pytest.approx(width)), k


def test_boxes_are_widened_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["widened_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HYPOT") > 0 and not [line for line in plan.splitlines() if line.strip(" +-:*()0123456789").startswith("Filter") and "HYPOT" in line]
    # on each side the search is named once, though four values of a box follow from it
    pages = spark.createDataFrame([(1, [])], "k int, items array<struct<id int, str string, text string, transform array<double>, width double>>")
    assert overlay.widened(pages)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_layout(spark):
    texts = [("Erste Zeile", 150, 240), ("Zweite", 410, 265), ("Dritte Zeile hier", 150, 290)]
    rows = [(1, i, t, x, y, 500.0, 700.0) for i, (t, x, y) in enumerate(reversed(texts))] + [(2, 0, "w" * 150, 880, 333, 500.0, 700.0)]
    found = layout.line_layout(spark.createDataFrame(rows, "page int, seq int, text string, x int, y int, page_width double, page_height double"), ["page"])
    page = found.where("page = 1").orderBy("y", "seq").collect()
    assert [r.text for r in page] == [t for t, *_ in texts]
    size = 25 / 1000 * 700 * 0.8
    assert [(r.x, r.size, r.baseline, r.scale_x) for r in page] == [(pytest.approx(x / 2), pytest.approx(size), pytest.approx(700 - y * 0.7 - 0.9 * size), 1.0) for _, x, y in texts]
    (long,) = found.where("page = 2").collect()
    assert long.scale_x == pytest.approx((490 - 440) / (150 * 0.6 * long.size))
    ops = found.withColumn("ops", layout.line_operators(F.col("text"), F.col("x"), F.col("baseline"), F.col("size"), F.col("scale_x")))
    layer = layout.text_layer(ops, ["page"], "y").where("page = 1").first().layer
    assert layer.startswith("q\nBT\n3 Tr\n") and layer.index("(Erste") < layer.index("(Zweite") < layer.index("(Dritte") and layer.endswith("\nET\nQ")


def test_run_operators(spark):
    row = spark.createDataFrame([("a(b)", [10.0, 0.0, 0.0, 10.0, 5.0, 6.0], 48.0), (" ", [10.0, 0.0, 0.0, 10.0, 5.0, 6.0], 48.0), ("a", [0.0, 0.0, 0.0, 10.0, 5.0, 6.0], 48.0)], "text string, m array<double>, width double")
    got = [r.o for r in row.withColumn("o", layout.run_operators(F.col("text"), F.col("m"), G.stretch(F.col("width"), F.length("text") * 0.6, F.col("m")))).collect()]
    assert got == ["20 0 0 10 5 6 Tm\n(a\\(b\\)) Tj", None, None]


def test_operators_are_worked_out_in_one_pass(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["page_operators"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert not [line for line in plan.splitlines() if line.strip(" +-:*()0123456789").startswith("Filter") and "regexp_replace" in line]
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 0, None), (2, 0, None)], "page int, seq int, ops string")
    assert [tuple(r) for r in layout.text_layer(rows, ["page"]).collect()] == [(1, "q\nBT\n3 Tr\na\nb\nET\nQ")]


def test_numbers_that_are_short_are_written_as_they_would_be_formatted(spark):
    from foliospark.functions.text import number

    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 100.0, 10.5, 0.25, 0.0001, 0.001, 0.0012, 0.00005, 0.00004, 9999999.0, 1e7, 12345678.9, 1e15, 1e22, 0.1 + 0.2, 1 / 3, 2e-3, float("inf"), float("nan"), None]
    values += [round(rng.uniform(-2000, 2000), rng.randrange(8)) for _ in range(2000)]
    text = F.regexp_replace(F.format_string("%.4f", F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")).otherwise(0.0)), "\\.?0+$", "")
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", number(F.col("v")).alias("got"), text.alias("want")).collect()
    assert [(r.v, r.got) for r in rows if r.got != r.want] == []


def test_geometry(spark):
    row = spark.range(1).select(
        G.rounded(F.lit(-2.5)).alias("half"), G.quarter_turn(F.lit(-90)).alias("turn"), G.reading_scale(F.lit(595.0), 5000).alias("four"), G.recognition_scale(F.lit(7200.0), 300).alias("most"),
        F.struct(*G.turned_size(F.lit(100), F.lit(50), F.lit(90.0))).alias("size"), F.struct(*G.projected(F.array(*[F.lit(v) for v in (0.0, 2.0, -2.0, 0.0, 1.0, 1.0)]), F.lit(1.0), F.lit(4.0))).alias("p"),
        G.straighten(F.lit(0.0), F.lit(5.0), F.lit(6.0), F.lit(7.0), F.lit(9.0)).alias("m"), G.luminance(F.lit(255), F.lit(255), F.lit(255)).alias("white"),
    ).first()
    assert (row.half, row.turn, row.four) == (-2, 270, 4.0) and row.most == pytest.approx(5000 / 7200) and tuple(row.p) == (3.0, 0.0) and row.m == [1, 0, 0, 1, 2, 3] and row.white == pytest.approx(255)
    assert [v in (50, 51, 100, 101) for v in row.size] == [True, True]


def test_corrections_laid_over_within_a_row(spark):
    rng = random.Random(9)
    pages = []
    for page in range(60):
        ids = rng.sample(range(40), rng.randrange(0, 12))
        pages.append((page, [(i, f"t{i}") for i in ids], [(rng.choice([*range(40), None]), rng.choice(["", "x", "y", None])) for _ in range(rng.randrange(0, 15))]))
    pages += [(100, [], []), (101, [(3, "a")], None), (102, None, [(3, "b")]), (103, [(1, "a" * 20_000)], [(1, "b"), (1, "b"), (1, "c")])]
    frame = spark.createDataFrame(pages, "page int, boxes array<struct<id:int,text:string>>, fixes array<struct<id:int,text:string>>")
    got = {r.page: r.done for r in frame.select("page", overlay.laid_over(F.col("boxes"), F.col("fixes")).alias("done")).collect()}
    for page, boxes, fixes in pages:
        new = {i: t for i, t in fixes or [] if i is not None and t is not None}
        want = None if boxes is None else sorted((i, t, new.get(i, t)) for i, t in boxes)
        assert (None if got[page] is None else [tuple(b) for b in got[page]]) == want, page
