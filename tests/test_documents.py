import base64
import itertools
import json
import logging
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark import seams
from foliospark.operators import filing, jsonio, routing
from foliospark.operators.quality import is_digital, is_junk
from foliospark.plans import refine
from foliospark.sources import files, settings, sinks
from foliospark.streaming import intake

NOW = datetime(2031, 5, 11, 12)
RAW = {"date": "2031-05-10", "correspondent": "Kranich", "summary": "Neue Pumpe", "reference": None, "confidence": "high", "scan_date": None}


def filed(spark, *changes):
    rows = [tuple({**RAW, **c}.values()) + (i,) for i, c in enumerate(changes)]
    return filing.filed(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in RAW) + ", i int"), NOW).orderBy("i").collect()


def test_paths_of_all_kinds_of_documents(spark):
    """Every combination of what is known: the path is put together here from the rule's words."""
    dates = [("2026-01-31", None, "2026-01-31", "document"), ("31.01.2026", "2025-12-24", "2025-12-24", "scan"), ("", "never", "ohne-Datum", "none")]
    senders = [("Ölmühle Kranich", "Ölmühle Kranich", "Ölmühle-Kranich"), (" . ", "_Unbekannt", ""), (None, "_Unbekannt", "")]
    summaries = [("Liefer Schein", "Liefer-Schein"), ("?!", "Scan")]
    references = [("Z 9/8", "Z-9-8"), (None, "")]
    changes, paths = [], []
    for (date, scan, day, source), (sender, folder, short), (summary, what), (reference, number), sure in itertools.product(dates, senders, summaries, references, ("high", "medium", "low")):
        changes.append({"date": date, "scan_date": scan, "correspondent": sender, "summary": summary, "reference": reference, "confidence": sure})
        paths.append(("_Pruefen" if sure == "low" else folder) + "/" + "_".join(p for p in (day, short, what, number) if p) + ".pdf")
    rows = filed(spark, *changes)
    assert [r.path for r in rows] == paths
    assert [r.date_source for r in rows] == [source for _, _, _, source in dates for _ in range(len(rows) // 3)]


def test_no_document_leaves_its_folder(spark):
    climbing = ["/".join([".."] * k) + sep + word for k, sep, word in itertools.product((1, 2, 5), ("/", "\\", " / "), ("x", "oben und unten", "NUL"))]
    rows = filed(spark, *[{field: value} for field in ("correspondent", "summary", "reference") for value in climbing])
    assert all(r.path.count("/") == 1 and "\\" not in r.path and not any(part in ("", ".", "..") for part in r.path.split("/")) for r in rows)
    assert all(not r.path.startswith(("NUL", ".", "/")) for r in rows)


def test_headers_and_properties(spark):
    rows = filing.properties(spark.createDataFrame(filed(spark, {"correspondent": "Müller"}, {"date": "", "scan_date": "2031-05-09", "summary": ""}))).withColumn("h", filing.metadata_header()).orderBy("i").collect()
    assert json.loads(base64.b64decode(rows[0].h)) == {"date": "2031-05-10", "dateSource": "document", "correspondent": "Müller", "summary": "Neue-Pumpe", "reference": "", "confidence": "high", "path": rows[0].path}
    assert (rows[0].title, rows[0].author, rows[0].created) == ("Neue Pumpe", "Müller", "2031-05-10T12:00:00Z") and (rows[1].title, rows[1].created) == (None, None)
    names = spark.createDataFrame([("Räch nung (1).pdf",), ("",)], "n string").select(filing.disposition(F.col("n")).alias("d")).collect()
    assert names[0].d == "attachment; filename=\"R_ch_nung__1_.ocr.pdf\"; filename*=UTF-8''R%C3%A4ch%20nung%20(1).ocr.pdf" and "dokument.ocr.pdf" in names[1].d


def test_downgrading(spark):
    rows = spark.createDataFrame([(l, "2023-05-17", "r", c) for l, c in (("poor", "high"), ("partial", "high"), ("partial", "low"), ("good", "high"), (None, "high"))], "legibility string, date string, reference string, confidence string")
    assert [tuple(r)[1:] for r in filing.downgraded(rows).collect()] == [("", "", "low"), ("2023-05-17", "", "medium"), ("2023-05-17", "", "low"), ("2023-05-17", "r", "high"), ("2023-05-17", "r", "high")]


@pytest.mark.parametrize("text, value", [('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ('x {"a": {"b": 2}} y', {"a": {"b": 2}})])
def test_tolerant_parsing(text, value):
    assert jsonio.loads(text) == value


@pytest.mark.parametrize("text", ["", None, "no", "}{", '{"a":1} x {"a":2}', '{"a": NaN}', "{'a': 1}"])
def test_refused(text):
    with pytest.raises(ValueError):
        jsonio.loads(text)


def test_answers(spark):
    boxes = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "p int, id int")
    answers = spark.createDataFrame([(1, '{"corrections":[{"id":1,"text":"a"},{"id":9,"text":"b"},{"id":2.0,"text":"c"},{"id":1,"text":"d"},{"id":"0","text":"e"},{"id":0,"text":5},{"id":true,"text":"x"},7]}'), (2, '{"x": 1}'), (3, "none")], "p int, answer string")
    found, failed = jsonio.corrections(answers, boxes, ["p"])
    assert {(r.p, r.id, r.text) for r in found.collect()} == {(1, 1, "d"), (1, 2, "c")} and {(r.p, r.error) for r in failed.collect()} == {(2, jsonio.NO_LIST), (3, jsonio.NO_JSON)}
    meta = jsonio.metadata(spark.createDataFrame([('{"date": 5, "correspondent": " A ", "confidence": "sure"}',), ("[]",), ("?",)], "answer string")).collect()
    assert [(m.date, m.correspondent, m.confidence, m.error is None) for m in meta] == [("", "A", "low", True), ("", "", "low", True), ("", "", "low", False)]
    lines, failed = jsonio.transcription(spark.createDataFrame([(1, '{"legibility":"good","lines":[{"text":" a  b ","x":-5,"y":1200.4,"certain":true},{"text":" "},{"text":"c","x":"7","y":null},{"text":"d","x":2.5}]}'), (2, '{"lines":[{"text":"e"}]}'), (3, "{}")], "p int, answer string"), ["p"])
    assert sorted(tuple(r) for r in lines.collect()) == [(1, 0, "good", "a b", 0, 1000, True), (1, 2, "good", "c", 7, 0, False), (1, 3, "good", "d", 3, 0, False), (2, 0, "poor", "e", 0, 0, False)]
    assert [(r.p, r.error) for r in failed.collect()] == [(3, jsonio.NO_LIST)]


def test_engine_settings():
    of = routing.EngineConfig.of
    assert of({}) == routing.EngineConfig("adobe", None) and of({"OCR_ENGINE": "adobe", "OCR_FALLBACK": "tesseract"}).fallback == "tesseract" and of({"OCR_ENGINE": "Tesseract", "OCR_FALLBACK": "tesseract"}) == routing.EngineConfig("tesseract", None)
    for bad in ({"OCR_ENGINE": "abbyy"}, {"OCR_FALLBACK": "x"}):
        with pytest.raises(ValueError):
            of(bad)
    assert [refine.RefineOptions.of({"LLM_MAX_PASSES": v}).max_passes for v in ("0", "9", "2", "x", "-4", "")] == [3, 5, 2, 3, 1, 3]
    model = settings.ModelSetup.of
    assert model({}).status == "off" and model({"LLM_PROVIDER": "other"}).status == "error" and model({"LLM_PROVIDER": "openai", "OPENAI_API_KEY": "k"}).reason == "LLM_MODEL is not set"
    assert model({"LLM_PROVIDER": " OpenAI ", "OPENAI_API_KEY": "k", "LLM_MODEL": "m-1"}) == settings.ModelSetup("ready", "openai", "m-1")
    whole = settings.Settings.of(settings.read_env_file("# c\nOWN_NAMES='A; B;;'\nLLM_TRANSCRIBE=False\nMAX_UPLOAD_MB=5"))
    assert (whole.own_names, whole.transcribe, whole.max_upload_mb) == (("A", "B"), False, 5.0)
    assert settings.languages_from_listing("List:\n deu \n\nosd\n") == ["deu", "osd"] and settings.version_from_listing("tool 5\nx") == "tool 5"


def test_quota_errors(spark):
    errors = spark.createDataFrame([("ServiceUsageError", None, "limit"), (None, 429, "x"), (None, None, "Monthly QUOTA reached"), (None, 500, "quotas"), (None, None, "network error")], "kind string, status int, message string")
    assert [r.q for r in errors.select(routing.is_quota_error(F.col("kind"), F.col("status"), F.col("message")).alias("q")).collect()] == [True, True, True, False, False]


def test_routing(spark):
    docs = spark.createDataFrame([(1, True, None), (2, False, None), (3, False, "quota"), (4, False, "network"), (5, None, None)], "d int, all_digital boolean, e string")
    said = [F.col("e") == "quota", F.col("e") == "network"]

    def engines(config, credentials):
        return [(r.engine, r.fell_back, r.status) for r in routing.routed(docs, config, credentials, *said).orderBy("d").collect()]

    none, main, local = ("none", False, "ok"), ("adobe", False, "ok"), ("tesseract", True, "ok")
    assert engines(routing.EngineConfig("adobe", "tesseract"), True) == [none, main, local, (None, False, "failed"), main]
    assert engines(routing.EngineConfig("adobe"), True)[2] == (None, False, "failed")
    assert engines(routing.EngineConfig("adobe", "tesseract"), False) == [none, local, local, local, local]
    assert engines(routing.EngineConfig("adobe"), False)[1] == (None, False, "failed")
    assert engines(routing.EngineConfig("tesseract"), False)[1:3] == [("tesseract", False, "ok")] * 2
    pages = spark.createDataFrame([("a", 25), ("a", 3), ("b", 20), ("c", None)], "doc string, visible int").withColumn("digital", is_digital(F.col("visible")))
    assert {r.doc: (r.pages, r.digital_pages, r.all_digital, r.some_digital) for r in routing.digital_documents(pages, ["doc"]).collect()} == {"a": (2, 1, False, True), "b": (1, 1, True, True), "c": (1, 0, False, False)}


def test_admission(spark):
    docs = spark.createDataFrame([(1, None, True, False), (2, 51, True, False), (3, 51, True, True), (4, 50, True, False), (5, 99, False, False)], "d int, pages int, correct boolean, lenient boolean")
    assert [(r.status, r.reason, r.corrects) for r in routing.admitted(docs).orderBy("d").collect()] == [("rejected", "unreadable", False), ("rejected", "too many pages", False), ("admitted", "uncorrected", False), ("admitted", "", True), ("admitted", "", False)]
    small, large = routing.within_size(spark.createDataFrame([(1, 5), (2, 2 << 20), (3, None)], "d int, length long"), 1)
    assert [r.d for r in small.collect()] == [1] and {r.d for r in large.collect()} == {2, 3}


def boxes_of(spark, pages):
    return spark.createDataFrame([(p, i, t) for p, texts in pages.items() for i, t in enumerate(texts)], "page int, id int, text string")


def test_passes_go_on_while_much_changes(spark):
    calls = []

    def model(boxes, by):
        calls.append({(r.page, r.id) for r in boxes.collect()})
        answer = F.to_json(F.struct(F.collect_list(F.struct("id", F.regexp_replace("current", "^x", "").alias("text"))).alias("corrections")))
        return boxes.groupBy(*by, "chunk").agg(answer.alias("answer"), F.lit(None).cast("string").alias("error"))

    items, pages = refine.corrected(boxes_of(spark, {1: ["xxa"] * 6 + ["x"], 2: ["xb", "c", " "], 3: [" "]}), ["page"], model, refine.RefineOptions(5, 2))
    told = {r.page: (r.passes, r.error, r.changes) for r in pages.collect()}
    assert told == {1: (3, None, 7), 2: (1, None, 1)}
    assert [len(c) for c in calls] == [9, 6, 6] and (1, 6) not in calls[1]
    assert {r.current for r in items.where("page = 1").collect()} == {"a", ""}


def test_failing_passes(spark):
    boxes = boxes_of(spark, {1: ["xxa"] * 6})
    items, pages = refine.corrected(boxes, ["page"], seams.failing("kaputt"))
    assert pages.first().error == "kaputt" and pages.first().changes == 0 and {r.current for r in items.collect()} == {"xxa"}
    good = seams.dictionary_corrector({"xxa": "xa", "xa": "a"})
    turn = []

    def later(rows, by):
        turn.append(1)
        return (good if len(turn) == 1 else seams.failing("kaputt"))(rows, by)

    items, pages = refine.corrected(boxes, ["page"], later)
    assert (pages.first().error, pages.first().changes, pages.first().passes) == (None, 6, 2) and {r.current for r in items.collect()} == {"xa"}


def test_whole_run(spark):
    by = ["doc", "page"]
    pages = spark.createDataFrame([("d", 1, 1), ("d", 2, 1), ("d", 3, 0), ("d", 4, 0)], "doc string, page int, items int")
    answers = spark.createDataFrame([("d", 1, '{"legibility":"partial","lines":[{"text":"A","x":1,"y":5,"certain":true},{"text":"B","x":1,"y":9}]}', None), ("d", 3, '{"legibility":"poor","lines":[{"text":"C","certain":true}]}', None), ("d", 4, None, "kaputt")], "doc string, page int, answer string, error string")
    lines, read = refine.transcribed(answers.select(*by), by, answers)
    assert [r.text for r in lines.collect()] == ["A"] and {r.page: (r.legibility, r.kept) for r in read.collect()} == {1: ("partial", 1), 3: ("poor", 0), 4: (None, 0)}
    correction = spark.createDataFrame([("d", 2, 2, None, 3)], "doc string, page int, passes int, error string, changes long")
    outcomes = refine.outcomes(pages, by, correction, read)
    row = routing.run_summary(outcomes, ["doc"]).first()
    assert (row.pages, row.pages_refined, row.pages_failed, row.corrections, row.pages_transcribed, row.errors, row.failed) == (4, 2, 1, 3, 1, ["Seite 4: kaputt"], False)
    failed = spark.createDataFrame([("d", 1, True, True, "x", False, 0)], "doc string, page int, attempted boolean, failed boolean, error string, transcribed boolean, changes long")
    assert routing.run_summary(failed, ["doc"]).first().failed and not routing.run_summary(failed, ["doc"], lenient=True).first().failed
    headers = routing.metric_headers(row_table(spark, row)).first().headers
    assert headers == {"X-OCR-Engine": "adobe", "X-OCR-LLM": "m", "X-OCR-LLM-Pages": "2/4", "X-OCR-LLM-Corrections": "3", "X-OCR-LLM-Failed": "1", "X-OCR-LLM-Transcribed": "1"}
    kept = refine.rewritten(spark.createDataFrame([(1, b"a"), (2, b"b")], "k int, content binary"), spark.createDataFrame([(2, b"c")], "k int, content binary"), "k")
    assert {r.k: bytes(r.content) for r in kept.collect()} == {1: b"a", 2: b"c"}


def row_table(spark, row):
    return spark.createDataFrame([("adobe", False, "m", True, False, row.pages, row.pages_refined, row.pages_failed, row.corrections, row.pages_transcribed)], "engine string, fell_back boolean, model string, corrects boolean, skipped boolean, pages long, pages_refined long, pages_failed long, corrections long, pages_transcribed long")


def test_only_open_pages_are_looked_at(spark):
    pages = spark.createDataFrame([(1, True, True, 3), (2, True, False, 0), (3, True, False, 4), (4, False, False, 0)], "page int, can_transcribe boolean, junk boolean, items int")
    seen = []

    def ink(rows):
        seen.extend(r.page for r in rows.collect())
        return rows.withColumn("ink", F.lit(True))

    found = {r.page: r.fallback for r in routing.needs_transcription(pages, ink).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False} and seen == [2]


def test_files_in_and_out(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt", "sub/d.pdf"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = files.document_files(spark, f"{tmp_path}/in/")
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a.pdf", "B.PDF"}
    assert files.document_files(spark, f"{tmp_path}/in/c.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        files.require_any(found.where("false"))
    existing = spark.createDataFrame([("a.ocr.pdf",)], "out_name string")
    todo = files.pending(found, existing)
    assert [r.out_name for r in todo.collect()] == ["B.ocr.pdf"] and files.pending(found, existing, force=True).count() == 2
    done = sinks.write_files(todo, f"{tmp_path}/out").collect()
    again = sinks.write_files(todo, f"file:{tmp_path}/by_address").collect()
    assert sorted(done) == sorted(again) and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(p.name for p in (tmp_path / "by_address").iterdir())
    assert [(r.out_name, r.status) for r in done] == [("B.ocr.pdf", "ok")] and (tmp_path / "out" / "B.ocr.pdf").read_bytes() == b"B.PDF" and len(list((tmp_path / "out").iterdir())) == 1
    assert {r.out_name for r in files.names_in(spark, f"{tmp_path}/out").collect()} == {"B.ocr.pdf"}
    (tmp_path / "file").write_text("")
    assert sinks.write_files(todo, f"{tmp_path}/file").first().status == "failed"
    summary = routing.batch_summary(spark.createDataFrame([("ok",), ("skipped",), ("failed",)], "status string")).first()
    assert tuple(summary) == (1, 1, 1, 1)


def test_pages_of_documents(spark):
    docs = spark.createDataFrame([("a", 3), ("b", 0), ("c", None)], "d string, pages int")
    pages = files.pages_of(docs)
    assert [r.page for r in pages.collect()] == [1, 2, 3] and files.first_page_only(pages, False).count() == 1


def test_log_records(spark):
    events = spark.createDataFrame([("t", "info", "m", {"a": "1", "b": None}), ("t", "debug", "m", {}), ("t", "error", "m", None)], "time string, level string, msg string, fields map<string,string>")
    rows = sinks.log_records(events).collect()
    assert [(r.stream, json.loads(r.line)) for r in rows] == [("stdout", {"time": "t", "level": "info", "msg": "m", "a": "1"}), ("stderr", {"time": "t", "level": "error", "msg": "m"})]
    line = spark.createDataFrame([("t", "warn", "m", {"k": "a b", "j": "x"})], "t string, l string, m string, f map<string,string>").select(sinks.text_line(F.col("t"), F.col("l"), F.col("m"), F.col("f")).alias("x"), sinks.library_level(F.lit("FATAL")).alias("y")).first()
    assert (line.x, line.y) == ('t WARN  m j=x k="a b"', "error")
    logging.getLogger(__name__).debug("done")


def test_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"1")

    def run():
        stream = intake.arriving_files(spark, f"{tmp_path}/in")
        intake.process(stream, lambda rows: rows.select("out_name", "length"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(r.out_name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["a.ocr.pdf"]
    (tmp_path / "in" / "b.PDF").write_bytes(b"22")
    assert run() == ["a.ocr.pdf", "b.ocr.pdf"] == run()


def test_quality_of_a_stream(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 10, 5), "~~" * 30), (datetime(2026, 1, 1, 10, 50), "gute Worte"), (datetime(2026, 1, 1, 15), "x")]
    spark.createDataFrame(rows, "ts timestamp, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    query = intake.quality_by_window(stream).writeStream.format("memory").queryName("layers_by_hour").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.start.hour, r.layers, r.junk_layers) for r in spark.table("layers_by_hour").orderBy("start").collect()] == [(10, 2, 1), (15, 1, 0)]
    assert is_junk(F.lit(40), F.lit(0.4)) is not None
