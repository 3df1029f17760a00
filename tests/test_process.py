import json
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from foliospark import seams
from foliospark.checkpoints import checkpointed
from foliospark.operators import items, layout, prompts, routing
from foliospark.plans import batch, process, refine
from foliospark.sources import files, sinks

JUNK = " ".join("".join("#*-:;/|"[(i * k) % 7] for i in range(1, 9)) for k in range(1, 9))
LINES = [("GÄRTNEREI ÖHLMANN", True), ("Am Anger 12", False), ("GEWICHT KG 12,75", True)]
PAGE = "doc string, page int, rotation int, visible_chars int, pixels binary, width int, height int, stride int"
ITEM = "doc string, page int, id int, text string, y double, line_height double"


def image(ink):
    g = np.full((120, 100), 255, np.uint8)
    if ink:
        g[20:100:8, 10:90] = 0
    return bytearray(g.tobytes())


def tables(spark, first=JUNK):
    pages = [("d", n, 0, v, image(ink), 100, 120, 1) for n, v, ink in ((1, 0, True), (2, 0, True), (3, 0, True), (4, 0, False), (5, 60, True))]
    texts = [("d", 1, 0, first, 700.0, 12.0), ("d", 2, 0, "Lieferschien 88-1203", 700.0, 12.0), ("d", 5, 0, "digital", 700.0, 12.0)]
    return spark.createDataFrame(pages, PAGE), spark.createDataFrame(texts, ITEM)


def transcriber(legibility, lines=LINES):
    return seams.fixed_answer(json.dumps({"legibility": legibility, "lines": [{"text": t, "x": 300, "y": 100 + 30 * i, "certain": c} for i, (t, c) in enumerate(lines)]}))


META = seams.fixed_answer('{"date":"2023-05-17","correspondent":"Gärtnerei Öhlmann","summary":"Wiegekarte","reference":"W 31","confidence":"high"}')
FIX = seams.dictionary_corrector({"Lieferschien 88-1203": "Lieferschein 88-1203"})
NOW = datetime(2026, 9, 20)


def run(spark, transcribe, first=JUNK, **options):
    result = process.refined(*tables(spark, first), process.Models(FIX, transcribe, META), refine.RefineOptions(**options), NOW)
    edits = sorted((r.page, r.kind, r.text) for r in result.edits.collect())
    return edits, result.summary.first(), result.meta.first(), {r.page: r for r in result.outcomes.collect()}


def test_pages_take_their_ways(spark):
    seen = []

    def transcribe(pages, by):
        seen.extend(sorted(r.page for r in pages.collect()))
        return transcriber("good")(pages, by)

    edits, summary, meta, outcomes = run(spark, transcribe)
    assert seen == [1, 3]  # junk, and ink without a layer; not the blank one, not the digital one
    assert edits == sorted([(p, "lines", t) for p in (1, 3) for t, c in LINES if c] + [(2, "entries", "Lieferschein 88-1203")])
    assert (summary.pages, summary.pages_refined, summary.pages_transcribed, summary.corrections, summary.pages_failed, summary.failed) == (5, 3, 2, 1, 0, False)
    assert meta.path == "Gärtnerei Öhlmann/2023-05-17_Gärtnerei-Öhlmann_Wiegekarte_W-31.pdf" and not outcomes[5].attempted


def test_hard_to_read_pages_are_trusted_less(spark):
    edits, _, meta, _ = run(spark, transcriber("partial"))
    assert (meta.confidence, meta.date, meta.reference) == ("medium", "2023-05-17", "") and "Hauptstr. 5" not in {t for *_, t in edits}
    edits, summary, meta, outcomes = run(spark, transcriber("poor"))
    assert (meta.confidence, meta.date) == ("low", "") and not any(k == "lines" for _, k, _ in edits)
    assert outcomes[1].transcribed and not outcomes[3].transcribed  # junk goes; where nothing was, nothing is written
    assert summary.pages_transcribed == 1


def test_failures_stay_on_their_pages(spark):
    edits, summary, _, outcomes = run(spark, seams.failing("kaputt"))
    assert summary.pages_failed == 2 and not summary.failed and outcomes[2].changes == 1 and [p for p, *_ in edits] == [2]
    assert summary.errors == ["Seite 1: kaputt", "Seite 3: kaputt"]


def test_metadata_alone(spark):
    result = process.refined(*tables(spark, "Guter Text auf der ersten Seite des Dokuments"), process.Models(extract=META), now=NOW)
    assert result.edits.count() == 0 and result.summary.first().pages_refined == 0 and result.meta.first().confidence == "high"


def test_a_schema_is_left_out_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p int, text string")

    def strict(frame, by):
        return frame.select("p", F.when(F.col("p") == 1, "yes").alias("answer"), F.when(F.col("p") == 2, "no structured output").when(F.col("p") == 3, "refused").alias("error"))

    got = {r.p: (r.answer, r.error) for r in seams.retried(strict, seams.fixed_answer("plain"))(rows, ["p"]).collect()}
    assert got == {1: ("yes", None), 2: ("plain", None), 3: (None, "refused")}


def test_items_and_requests(spark):
    view, unit = [1.0, 0.0, 0.0, -1.0, 0.0, 842.0], [10.0, 0.0, 0.0, 10.0, 59.5, 742.0]
    runs = spark.createDataFrame([(1, 0, " ", unit, 10.0, 10.0, view, 595.0, 842.0), (1, 1, 'Be"trag', unit, 119.0, 10.0, view, 595.0, 842.0), (1, 2, "x", [1.0], 1.0, 1.0, view, 595.0, 842.0)], "page int, seq int, str string, transform array<double>, width double, height double, view array<double>, page_width double, page_height double")
    (item,) = items.text_items(runs, ["page"]).collect()
    assert (item.id, item.x, item.y, item.w, item.h) == (0, 100, 107, 200, 12)
    listed = prompts.box_lists(spark.createDataFrame([item]).withColumnRenamed("str", "text"), ["page"]).first().listed
    assert listed == '0\t100,107,200,12\t"Be\\"trag"'
    row = spark.range(1).select(
        prompts.recipients(F.array(F.lit("A"), F.lit("B"))).alias("two"), prompts.recipients(F.array().cast("array<string>")).alias("none"), prompts.page_excerpt(F.lit(" " + "x" * 7000)).alias("cut"), prompts.page_excerpt(F.lit(None).cast("string")).alias("empty"),
        routing.key_accepted(F.lit("k"), "k").alias("right"), routing.key_accepted(F.lit(None).cast("string"), "k").alias("wrong"), routing.key_accepted(F.lit("x"), None).alias("open"), F.length(routing.request_id()).alias("id"), layout.straighten_operators(F.array(*[F.lit(float(v)) for v in view])).alias("s"),
    ).first()
    assert (row.two, row.none, len(row.cut), row.empty) == ("- A\n- B", prompts.NOBODY, 6000, prompts.NO_TEXT) and (row.right, row.wrong, row.open, row.id) == (True, False, True, 8) and row.s.open == "q\n1 0 0 -1 0 842 cm\n"
    schemas = prompts.response_schemas()
    assert schemas["metadata"]["properties"]["confidence"] == {"type": "string", "enum": ["high", "medium", "low"]} and schemas["corrections"]["properties"]["corrections"]["items"]["required"] == ["id", "text"]
    assert schemas["transcription"]["additionalProperties"] is False


def test_batch(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_bytes(name.encode())

    def recognise(todo):
        return todo.select("out_name", "content", F.when(F.col("out_name") == "b.ocr.pdf", "kaputt").alias("error"))

    existing = spark.createDataFrame([("c.ocr.pdf",)], "out_name string")
    told, code = batch.run(spark, f"{tmp_path}/", f"{tmp_path}/out", recognise, existing)
    assert {r.out_name: r.status for r in told.collect()} == {"a.ocr.pdf": "ok", "b.ocr.pdf": "failed", "c.ocr.pdf": "skipped"} and code == 1
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.ocr.pdf"]


def test_a_batch_asks_what_is_there_before_it_writes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(b"%d" % k)
    (tmp_path / "out" / "0.ocr.pdf").write_bytes(b"before")
    out = f"{tmp_path}/out"

    def look(batches):  # each time that it is run
        import os

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"out_name": os.listdir(out)})

    existing = spark.range(0, 1, 1, 1).mapInArrow(look, "out_name string")

    def recognise(todo):
        return todo.select("out_name", "content", F.when(F.col("out_name") == "5.ocr.pdf", "kaputt").alias("error"))

    told, code = batch.run(spark, f"{tmp_path}/in/", out, recognise, existing)
    assert sorted((r.out_name, r.status, r.error) for r in told.collect()) == [("0.ocr.pdf", "skipped", None), *[(f"{k}.ocr.pdf", "ok", None) for k in range(1, 5)], ("5.ocr.pdf", "failed", "kaputt")] and code == 1
    told, code = batch.run(spark, f"{tmp_path}/in/", out, lambda todo: todo.select("out_name", "content", F.lit(None).cast("string").alias("error")), existing, force=True)
    assert sorted((r.out_name, r.status) for r in told.collect()) == [(f"{k}.ocr.pdf", "ok") for k in range(6)] and code == 0 and (tmp_path / "out" / "0.ocr.pdf").read_bytes() == b"0"


def test_each_file_that_cannot_be_written_is_told(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("no/folder", b"2"), ("c", b"3")], "out_name string, content binary").coalesce(1)
    assert [(r.out_name, r.status, r.error is None) for r in sinks.write_files(rows, f"{tmp_path}/out").collect()] == [("a", "ok", True), ("no/folder", "failed", False), ("c", "ok", True)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "c"]
    (tmp_path / "file").write_text("")
    assert [(r.out_name, r.status) for r in sinks.write_files(rows, f"{tmp_path}/file").collect()] == [("a", "failed"), ("no/folder", "failed"), ("c", "failed")]


def test_a_batch_of_many_small_files_has_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(300):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(b"%d" % k)
    existing = spark.createDataFrame([(f"{k}.ocr.pdf",) for k in range(0, 300, 4)], "out_name string")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a split of Spark's reader for each file
        told, _ = batch.run(spark, f"{tmp_path}/in/", f"{tmp_path}/out", lambda todo: todo.select("out_name", "content", F.lit(None).cast("string").alias("error")), existing)
        tasks = files.read_folder(spark, f"{tmp_path}/in").rdd.getNumPartitions()
        assert tasks == files.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 300
        assert told.rdd.getNumPartitions() <= 3 * tasks and files.names_in(spark, f"{tmp_path}/out").rdd.getNumPartitions() == tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [files._bytes(t) for t in ("16m", "128MB", "134217728b", "134217728", "2g", "64KB")] == [1 << 24, 1 << 27, 1 << 27, 1 << 27, 1 << 31, 1 << 16]
    assert {r["status"]: r["count"] for r in told.groupBy("status").count().collect()} == {"ok": 225, "skipped": 75}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.ocr.pdf": b"%d" % k for k in range(300) if k % 4}


def test_a_pass_touches_open_pages_only(spark, monkeypatch):
    boxes = [(1, i, "abcdef") for i in range(8)] + [(2, i, "ab") for i in range(3)] + [(3, 0, "  ")] + [(4, i, "abc") for i in range(6)]
    seen = []

    def noted(df):
        done = checkpointed(df)
        seen.append((set(done.columns), {r.page for r in done.select("page").distinct().collect()}))
        return done

    def shorter(rows, by):
        answer = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", F.when(F.length("current") > 2, F.substring("current", 2, 99)).otherwise(F.col("current")).alias("text")))).alias("corrections")))
        return rows.groupBy(*by, "chunk").agg(answer.alias("answer"), F.lit(None).cast("string").alias("error"))

    monkeypatch.setattr(refine, "checkpointed", noted)
    state, told = refine.corrected(spark.createDataFrame(boxes, "page int, id int, text string"), ["page"], shorter, refine.RefineOptions(max_passes=5))
    touched = [pages for columns, pages in seen if "current" in columns]
    assert touched == [{1, 2, 4}, {1, 4}, {1}, {1}, {1}]
    assert sorted((r.page, r.passes, r.changes) for r in told.collect()) == [(1, 5, 8), (2, 1, 0), (4, 2, 6)]
    assert state.count() == len(boxes) and {r.current for r in state.where("page = 1").collect()} == {"ef"} and {r.current for r in state.where("page = 4").collect()} == {"bc"}


def test_calls_for_each_row_with_a_time_limit(spark):
    import time

    def model(text, n):
        if n == 2:
            raise ValueError("no such thing")
        if n == 3:
            time.sleep(3)
        return f"{text}{n}"

    rows = spark.createDataFrame([(k, "t", k, "unused") for k in range(5)], "page int, text string, n int, other string")
    told = {r.page: (r.answer, r.error) for r in seams.per_row(model, ["text", "n"], 0.5)(rows, ["page"]).collect()}
    assert told == {0: ("t0", None), 1: ("t1", None), 2: (None, "ValueError: no such thing"), 3: (None, "no answer within 0.5 s"), 4: ("t4", None)}
