"""Files that are published together, readers that plan ranges, calls that end at their limit, pages, widths, glyphs and run logs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from foliospark import seams
from foliospark.child import Child, Died, TookTooLong
from foliospark.functions import glyphs, pages, widths
from foliospark.operators import content
from foliospark.sources import publishing, runlog, wordtables


def names(folder):
    """What readers see: a job that fails may leave hidden files of tasks that still ran."""
    return sorted(n for n in os.listdir(folder) if not n.startswith("."))


def files(spark, rows):
    return spark.createDataFrame(rows, "out_name string, content binary").repartition(3)


def test_all_files_or_none(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rows = [(f"f{i}.pdf", f"content {i}".encode()) for i in range(20)] + [("empty.pdf", None)]
    publishing.publish(files(spark, rows), folder)
    assert names(folder) == sorted(n for n, _ in rows)
    assert (tmp_path / "out" / "f7.pdf").read_bytes() == b"content 7" and (tmp_path / "out" / "empty.pdf").read_bytes() == b""

    broken = files(spark, [(f"g{i}.pdf", b"x") for i in range(20)]).withColumn("content", F.when(F.col("out_name") == "g13.pdf", F.raise_error(F.lit("kaputt")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="kaputt"):
        publishing.publish(broken, folder)
    for bad in ([("h.pdf", b"1"), ("h.pdf", b"2")], [("i.pdf", b"1"), ("f3.pdf", b"there already")], [("j.pdf", b"1"), ("../k.pdf", b"2")], [("l.pdf", b"1"), (None, b"2")]):
        with pytest.raises(Exception, match="file name|files already"):
            publishing.publish(files(spark, bad), folder)
    assert names(folder) == sorted(n for n, _ in rows)
    publishing.publish(files(spark, [("f3.pdf", b"new"), ("m.pdf", b"m")]), folder, replace=True)
    assert (tmp_path / "out" / "f3.pdf").read_bytes() == b"new" and len(names(folder)) == len(rows) + 1
    publishing.publish(files(spark, []), folder)
    assert len(names(folder)) == len(rows) + 1


def test_a_driver_lost_while_it_published(tmp_path):
    folder = f"{tmp_path}/out"
    writer = publishing._Publisher(folder, replace=False)
    messages = [writer.write(iter([("a.pdf", b"a"), ("b.pdf", b"b")])), writer.write(iter([("c.pdf", b"c")])), None]
    lost = writer.write(iter([("a.pdf", b"by an attempt that was lost")]))
    assert lost.files and not [n for n in names(folder) if n.endswith(".pdf")]
    store, base = publishing._store(folder)
    staging = f"{base}/{writer.job}"
    moves = [f for m in messages if m for f in m.files]
    (tmp_path / "out" / writer.job / publishing.NOTE).write_text(json.dumps(moves))
    os.rename(f"{staging}/{moves[0][0]}", f"{base}/a.pdf")  # and then it was lost
    writer.abort(messages)
    assert publishing.recover(folder) == 1 and publishing.recover(folder) == 0 == publishing.recover(f"{tmp_path}/none")
    assert names(folder) == ["a.pdf", "b.pdf", "c.pdf"] and (tmp_path / "out" / "a.pdf").read_bytes() == b"a"
    unfinished = publishing._Publisher(folder, replace=False)
    unfinished.write(iter([("d.pdf", b"d")]))
    assert publishing.recover(folder) == 0
    unfinished.abort([])
    assert names(folder) == ["a.pdf", "b.pdf", "c.pdf"]


HEAD = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_word_tables_by_ranges(spark, tmp_path, part):
    (tmp_path / "in").mkdir()
    rows = [(4 + (i % 3 > 0), i % 5, 1, 1, i, i, float(i), 0.5, 1.0, 2.0, 90.5, f"Wort{i}" + ("\tmit Tab" if i % 4 == 0 else "")) for i in range(12 if part < 64 else 60)]
    lines = ["\t".join(map(str, r)) for r in rows]
    (tmp_path / "in" / "a.tsv").write_bytes(("\n".join([HEAD, *lines[:7]]) + "\n").encode())
    (tmp_path / "in" / "b.tsv").write_bytes("\r\n".join([*lines[7:], "5\t1", "x\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\tword", ""]).encode())
    (tmp_path / "in" / "_log").write_text("5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\thidden")
    (tmp_path / "in" / "empty.tsv").write_text("")
    got = wordtables.read(spark, f"{tmp_path}/in", part)
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(rows)
    kept = got.where((F.col("level") == 5) & F.col("page").isin(1, 2, 4) & (F.col("page") <= 2) & (F.col("conf") > 1))
    assert sorted(tuple(r)[1:] for r in kept.collect()) == sorted(r for r in rows if r[0] == 5 and r[1] in (1, 2))
    single = wordtables.read(spark, f"{tmp_path}/in/a.tsv", part)
    assert {r.file for r in single.collect()} == {"a.tsv"} and single.count() == 7


def test_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(f"{HEAD}\n5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\tword\n")
    plan = wordtables.read(spark, f"{tmp_path}/in").where("level = 5 and page >= 1 and text <> 'x'")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" +-:*()0123456789").startswith("Filter")]
    assert "text" in "".join(filters) and "level" not in "".join(filters) and "page" not in "".join(filters)


def answer(value):
    if value == "slow":
        time.sleep(120)
    if value == "dead":
        os._exit(1)
    if value == "bad":
        raise ValueError("no such thing")
    if value == "odd":
        raise type("Local", (Exception,), {})("can't be sent")
    print("what is printed doesn't disturb")
    return value * 2


def test_a_call_ends_at_its_limit():
    with Child(answer) as child:
        assert child.call(("a",), 5) == "aa"
        first = child.process.pid
        assert child.call(("b" * 3_000_000,), 5) == "b" * 6_000_000 and child.process.pid == first
        began = time.monotonic()
        with pytest.raises(TookTooLong, match="0.5 s"):
            child.call(("slow",), 0.5)
        assert time.monotonic() - began < 1.5
        with pytest.raises(ProcessLookupError):
            os.kill(first, 0)
        for value, kind in (("dead", Died), ("bad", ValueError), ("odd", Died)):
            with pytest.raises(kind):
                child.call((value,), 5)
        assert child.call(("c",), 5) == "cc"
        last = child.process.pid
    with pytest.raises(ProcessLookupError):
        os.kill(last, 0)


def test_a_job_ends_with_its_limits(spark):
    rows = spark.createDataFrame([(0, "slow"), (1, "a"), (2, "dead"), (3, "bad")], "page int, text string").coalesce(1)
    call = seams.per_row(answer, ["text"], 1.0)
    call(rows.where("page = 1"), ["page"]).collect()  # workers are there
    began = time.monotonic()
    told = {r.page: (r.answer, r.error) for r in call(rows, ["page"]).collect()}
    assert time.monotonic() - began < 40  # not the 120 seconds of the slow call
    assert told == {0: (None, "no answer within 1 s"), 1: ("aa", None), 2: (None, "the process has ended"), 3: (None, "ValueError: no such thing")}


def test_pages_of_runs(spark):
    runs = spark.createDataFrame([("a", 2, 1, "x"), ("a", 2, 0, "w"), ("a", 7, 0, None), ("b", 1, 0, ""), (None, 1, 0, "n"), ("a", None, 0, "first"), ("a", 2, 1, "x")], "doc string, page int, seq int, text string").repartition(4)
    got = sorted((tuple(r) for r in pages.pages(runs).collect()), key=repr)
    assert got == sorted([("a", 1, None, 1, 5, "first"), ("a", 2, 2, 3, 5, "w x x"), ("a", 3, 7, 1, 0, ""), ("b", 1, 1, 1, 0, ""), (None, 1, 1, 1, 1, "n")], key=repr)
    assert sorted((r.doc or "", r.page) for r in pages.pages(runs, first_only=True).collect()) == [("", 1), ("a", 1), ("b", 1)]
    assert pages.pages(runs.limit(0)).collect() == []
    pages.register(spark)
    with pytest.raises(Exception, match="lacks seq"):
        spark.sql("SELECT * FROM document_pages(TABLE(SELECT 1 AS doc, 1 AS page, 'x' AS text), true)")


def test_widths(spark):
    def plainly(text, table):
        return sum(next((w for first, w in reversed(table) if first <= ord(c)), 0) for c in text)

    texts = ["", "Rechnung Nr. 12", "Ärger über €", "日本語", "😀 naïve é", "\t\n", "~}|{zZ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for table in (widths.ADVANCES, [(65, 3), (66, 5)], [(0, 1)], []):
        got = [r.w for r in rows.withColumn("w", widths.text_width(F.col("t"), table)).orderBy("i").collect()]
        assert got == [*(plainly(t, table) for t in texts), None]
    assert rows.where("i = 1").select(widths.measured(F.col("t"), F.lit(10.0)).alias("w")).first().w == plainly(texts[1], widths.ADVANCES) / 100
    with pytest.raises(ValueError):
        widths.advance(F.lit(1), [(5, 1), (5, 2)])


def test_nested_glyphs_as_the_plain_function_counts_them(spark):
    g = lambda u: {"unicode": u}
    cases = [[], [g("a")], [[g("a"), -120, g(" "), g("")]], [[[g("a")]]], [[[[g("a")]]]], [[[[[g("a")]]]]], [[g("a"), [g("b"), [g("c"), [g("d")]]]]], g("x"), g("  "), 5, "text", None, [None, True, {"other": 1}, g(None), g(7), {"unicode": [1]}], [g("　"), g("\t\n")]]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(99, None)], "i int, j string")
    got = {r.i: r.n for r in rows.withColumn("n", glyphs.glyph_count(F.parse_json("j"))).collect()}
    assert got.pop(99) is None
    assert got == {i: content.glyphs(c) for i, c in enumerate(cases)}
    plan = rows.withColumn("n", glyphs.glyph_count(F.parse_json("j")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_arguments_of_glyphs_are_made_once_and_cast_as_a_whole(spark):
    g = lambda u: {"unicode": u}
    cases = [[[1, g("a")], g("b"), [[g("c"), [g("d")], None], 5]], [{"UNICODE": "a"}, {"unicode": "", "more": 1}, {"more": [g("a")]}, {"unicode": {}}], [[], [[]], [[[]]]]]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    for deepest in range(5):
        counted = rows.withColumn("n", glyphs.glyph_count(F.parse_json("j"), deepest))
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("array<variant>") == plan.count("ArrayType(VariantType") == 0

        def plainly(value, depth=0):
            return (0 if depth >= deepest else sum(plainly(v, depth + 1) for v in value)) if isinstance(value, list) else content.glyphs(value)

        assert {r.i: r.n for r in counted.collect()} == {i: plainly(c) for i, c in enumerate(cases)}, deepest


def test_counters_are_gathered_in_the_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, "x" * i, i % 4 == 0) for i in range(10)], "i int, text string, junk boolean").mapInArrow(count, "i int, text string, junk boolean")
    log = runlog.RunLog(spark)
    kept = log.step(rows, "judged", **runlog.layer_counters()).where("not junk")
    log.step(kept, "kept", n=F.count(F.lit(1)), most=F.max("i")).write.parquet(f"{tmp_path}/out")
    records = log.records("2026-01-01T00:00:00Z").collect()
    assert [(r.level, r.msg, r.fields, r.stream) for r in records] == [
        ("warn", "judged", {"documents": "10", "chars": "45", "longest": "9", "empty": "1", "warnings": "3"}, "stderr"), ("info", "kept", {"n": "7", "most": "9"}, "stdout")]
    assert read.value == 10 and json.loads(records[1].line) == {"time": "2026-01-01T00:00:00Z", "level": "info", "msg": "kept", "n": "7", "most": "9"}
    assert log.records(threshold="warn").count() == 1


def test_glyphs_of_operators_are_folded_as_the_plain_function_walks_them(spark):
    def op(name, mode=None, shown=None):
        return (name, mode, shown)

    pages_ = [
        [], None, [op("show", shown=["a", " ", "", None, "　"])], [op("mode", 3), op("show", shown=["a"]), op("mode", 7), op("show", shown=["b"]), op("mode"), op("show", shown=["c"]), op("mode", 6), op("show", shown=["d"])],
        [op("save"), op("mode", 3), op("form_begin"), op("mode", 0), op("show", shown=["x", "y"]), op("restore"), op("show", shown=["z"]), op("form_end"), op("show", shown=["w"]), op("restore"), op("show", shown=None)],
        [op("restore"), op("mode", 3), op("restore"), op("show", shown=["q"]), op("other", 0, ["r"])],
    ]
    rows = spark.createDataFrame(list(enumerate(pages_)), "i int, ops array<struct<name: string, mode: int, glyphs: array<string>>>")
    counted = rows.withColumn("n", content.visible_count("ops"))
    want = [None if p is None else content.visible_characters([(n, [m] if n == "mode" else [[{"unicode": g} for g in s or []]]) for n, m, s in p]) for p in pages_]
    assert [r.n for r in counted.orderBy("i").collect()] == want
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
