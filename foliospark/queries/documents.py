"""Queries on whole documents: names, filing, routing, answers, runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import filing, jsonio, quality, routing
from foliospark.plans.refine import RefineOptions, corrected
from foliospark.queries import sqltext as S
from foliospark.sources.tables import read_table as table

NOW = datetime(1998, 1, 1, 12)


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and slugs of every whole text."""
    whole = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return whole.select("doc_id", X.clean_name(F.col("t"), 50).alias("name"), X.slug(F.col("t"), 60).alias("slug60"), X.slug(F.col("t"), 30).alias("slug30"))


CLEAN_NAMES = f"SELECT doc_id, {S.clean_name('t', 50)} AS name, {S.slug('t', 60)} AS slug60, {S.slug('t', 30)} AS slug30 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    raw = orders.join(customers, "o_custkey").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("correspondent"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("summary"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Nr. "), F.col("o_orderkey").cast("string"))).otherwise("").alias("reference"),
        F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("confidence"),
        F.when(F.col("o_orderkey") % 10 == 0, "1995-02-30").otherwise("1995-02-28").alias("scan_date"),
    )
    return filing.filed(raw, NOW)


def filing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing paths; an order is a document, its customer the sender."""
    return _filed(spark, sf_dir).select("o_orderkey", "date", "date_source", "correspondent", "summary", "reference", "confidence", "path")


_RAW = """raw AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_name END AS correspondent,
    o_orderpriority || ' ' || c_mktsegment AS summary, CASE WHEN o_orderkey % 3 = 0 THEN 'Nr. ' || o_orderkey ELSE '' END AS reference,
    CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN o_orderkey % 10 = 0 THEN '1995-02-30' ELSE '1995-02-28' END AS scan_date
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
_OK = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast({0} AS DATE) BETWEEN DATE '1950-01-01' AND DATE '1999-01-02' THEN {0} END"
_FILED = f"""{_RAW}, dated AS (
  SELECT *, coalesce({_OK.format('date')}, {_OK.format('scan_date')}, '') AS day,
    CASE WHEN {_OK.format('date')} IS NOT NULL THEN 'document' WHEN {_OK.format('scan_date')} IS NOT NULL THEN 'scan' ELSE 'none' END AS date_source,
    {S.clean_name('correspondent', 50)} AS sender, coalesce(nullif({S.slug('summary', 60)}, ''), 'Scan') AS about, {S.slug('reference', 30)} AS ref FROM raw
), filed AS (
  SELECT o_orderkey, day AS date, date_source, sender AS correspondent, about AS summary, ref AS reference, confidence,
    CASE WHEN confidence = 'low' THEN '_Pruefen' WHEN sender = '' THEN '_Unbekannt' ELSE sender END || '/' ||
    array_to_string(list_filter([coalesce(nullif(day, ''), 'ohne-Datum'), {S.slug('sender', 40)}, about, ref], lambda p: p <> ''), '_') || '.pdf' AS path FROM dated
)"""
FILING = f"WITH {_FILED} SELECT * FROM filed"


def metadata_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata header and file properties of the same documents."""
    done = filing.properties(_filed(spark, sf_dir))
    return done.select("o_orderkey", filing.metadata_header().alias("header"), "title", "author", "created")


HEADER = f"""WITH {_FILED}
SELECT o_orderkey, to_base64(encode('{{"date":' || to_json(date) || ',"dateSource":' || to_json(date_source) || ',"correspondent":' || to_json(correspondent) || ',"summary":' || to_json(summary) || ',"reference":' || to_json(reference) || ',"confidence":' || to_json(confidence) || ',"path":' || to_json(path) || '}}')) AS header,
  CASE WHEN summary NOT IN ('', 'Scan') THEN replace(summary, '-', ' ') END AS title, nullif(correspondent, '') AS author, CASE WHEN date <> '' AND date_source = 'document' THEN date || 'T12:00:00Z' END AS created FROM filed
"""


def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata from answers with text around them; an event's properties are the answer, its type the sender."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    answer = F.concat(F.lit("Answer: {\"date\": 5, \"correspondent\": \" "), F.col("event_type"), F.lit(" \", \"confidence\": \"high\", \"props\": "), F.col("props"), F.when(F.col("event_id") % 9 == 0, "").otherwise("} done"))
    decoded = jsonio.metadata(events.select("event_id", answer.alias("answer")))
    return decoded.select("event_id", "date", "correspondent", "confidence", F.col("error").isNotNull().alias("failed"))


TOLERANT = "SELECT event_id, '' AS date, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS correspondent, CASE WHEN event_id % 9 = 0 THEN 'low' ELSE 'high' END AS confidence, event_id % 9 = 0 AS failed FROM events"


def _stub(boxes: DataFrame, by: list[str]) -> DataFrame:
    """A model that cuts one digit off the texts that have some left, and fails on pages whose number ends in 99."""
    answer = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", F.when(F.length("current") > 1, F.regexp_replace("current", ".$", "")).otherwise(F.col("current")).alias("text")))).alias("corrections")))
    answered = boxes.groupBy(*by, "chunk").agg(answer.alias("answer"))
    broken = F.col("custkey") % 100 == 99
    return answered.select(*by, "chunk", F.when(~broken, F.col("answer")).alias("answer"), F.when(broken, "broken").alias("error"))


def _passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    items = orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("key")).groupBy("custkey").agg(F.array_sort(F.collect_list("key")).alias("k")).select("custkey", F.posexplode("k").alias("id", "key"))
    boxes = items.select("custkey", "id", F.substring(F.lit("123456"), 1, (F.col("key") % 5 + 1).cast("int")).alias("text"))
    return corrected(boxes, ["custkey"], _stub, RefineOptions(max_passes=3, boxes_a_call=4))


def pass_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of correction until little changes; a customer is a page, its orders are boxes of one to five digits."""
    return _passes(spark, sf_dir)[1].select(F.col("custkey").alias("page"), "passes", F.col("error").isNotNull().alias("failed"), "changes")


_PASSES = """boxes AS (SELECT o_custkey AS page, (o_orderkey % 5 + 1) AS n FROM orders),
told AS (
  SELECT page, page % 100 = 99 AS failed, count(*) FILTER (n > 1) AS c1, count(*) FILTER (n > 2) AS c2, count(*) FILTER (n > 3) AS c3 FROM boxes GROUP BY page
)"""
CONVERGENCE = f"WITH {_PASSES} SELECT page, CASE WHEN failed OR c1 < 5 THEN 1 WHEN c2 < 5 THEN 2 ELSE 3 END AS passes, failed, CASE WHEN failed THEN 0 ELSE c1 END AS changes FROM told"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the same run; 25 pages are a document."""
    pages = _passes(spark, sf_dir)[1]
    outcomes = pages.select(F.floor(F.col("custkey") / 25).alias("doc"), F.col("custkey").alias("page"), F.lit(True).alias("attempted"), F.col("error").isNotNull().alias("failed"), "error", F.lit(False).alias("transcribed"), "changes")
    return routing.run_summary(outcomes, ["doc"]).withColumn("first_error", F.get("errors", F.lit(0))).drop("errors")


SUMMARY = f"""WITH {_PASSES}
SELECT page // 25 AS doc, count(*) AS pages, count(*) FILTER (NOT failed AND c1 > 0) AS pages_refined, count(*) FILTER (failed) AS pages_failed, coalesce(sum(c1) FILTER (NOT failed), 0)::BIGINT AS corrections,
  0::BIGINT AS pages_transcribed, bool_and(failed) AS failed, min('Seite ' || page || ': broken') FILTER (failed) AS first_error FROM told GROUP BY page // 25
"""


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of documents; 500 characters are a page, every 50th can't be read, languages set what is asked."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    asked = docs.withColumns({
        "pages": F.when(F.col("doc_id") % 50 != 0, F.ceil(F.col("n_chars") / 500).cast("int")), "correct": X.flag(F.when(F.col("lang") == "en", " Yes ").otherwise(F.when(F.col("lang") == "de", "ja").otherwise("off"))),
        "lenient": X.flag(F.when(F.col("doc_id") % 2 == 0, "1").otherwise("")),
    })
    return routing.admitted(asked, 20).select("doc_id", "status", "reason", "corrects")


ADMISSION = """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN ceil(n_chars / 500) END AS pages, lang IN ('en', 'de') AS correct, doc_id % 2 = 0 AS lenient FROM documents)
SELECT doc_id, CASE WHEN pages IS NULL OR (correct AND pages > 20 AND NOT lenient) THEN 'rejected' ELSE 'admitted' END AS status,
  CASE WHEN pages IS NULL THEN 'unreadable' WHEN correct AND pages > 20 AND NOT lenient THEN 'too many pages' WHEN correct AND pages > 20 THEN 'uncorrected' ELSE '' END AS reason,
  correct AND pages IS NOT NULL AND pages <= 20 AS corrects FROM a
"""


def engine_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines of documents; a source and language are a document, its documents are pages with their characters."""
    pages = table(spark, sf_dir, "documents", "source", "lang", "n_chars").select("source", "lang", quality.is_digital(F.col("n_chars") - 100).alias("digital"))
    docs = routing.digital_documents(pages, ["source", "lang"])
    message = F.when(F.col("lang") == "fr", "monthly Quota exceeded").when(F.col("lang") == "es", "network error").otherwise(F.lit(None).cast("string"))
    quota = routing.is_quota_error(F.lit(None).cast("string"), F.lit(None).cast("int"), message)
    return routing.routed(docs, routing.EngineConfig("adobe", "tesseract"), True, quota, message.isNotNull())


ROUTING = """
WITH d AS (
  SELECT source, lang, count(*) AS pages, count(*) FILTER (n_chars - 100 >= 20) AS digital_pages, bool_and(n_chars - 100 >= 20) AS all_digital, bool_or(n_chars - 100 >= 20) AS some_digital FROM documents GROUP BY source, lang
)
SELECT *, CASE WHEN all_digital THEN 'none' WHEN lang = 'fr' THEN 'tesseract' WHEN lang = 'es' THEN NULL ELSE 'adobe' END AS engine, NOT all_digital AND lang = 'fr' AS fell_back,
  CASE WHEN NOT all_digital AND lang = 'es' THEN 'failed' ELSE 'ok' END AS status FROM d
"""


def incremental_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs whose output isn't there yet, and its name; those of even documents are."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source").select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/Scan "), F.col("doc_id").cast("string"), F.lit(".v1.PDF")).alias("path"))
    inputs = docs.withColumn("out_name", filing.output_name(F.col("path")))
    left = filing.not_yet_written(inputs, inputs.where("doc_id % 2 = 0"))
    return left.select("doc_id", "out_name", filing.disposition(F.col("path")).alias("disposition"))


INCREMENTAL = """
SELECT doc_id, 'Scan ' || doc_id || '.v1.ocr.pdf' AS out_name, 'attachment; filename="Scan_' || doc_id || '.v1.ocr.pdf"; filename*=UTF-8''''Scan%20' || doc_id || '.v1.ocr.pdf' AS disposition FROM documents WHERE doc_id % 2 <> 0
"""


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of web pages, as an analogy: scripts, styles and comments are the invisible objects."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", X.shown_of_markup(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5(F.encode("t", "UTF-8")).alias("text_md5"))


VISIBLE = f"""
SELECT page_id, length(t)::BIGINT AS chars, md5(t) AS text_md5 FROM (
  SELECT page_id, {S.collapse("regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')")} AS t FROM pages)
"""


def queries():
    return {f.__name__: f for f in (clean_names, filing_paths, metadata_header, tolerant_json, pass_convergence, run_summary, admission, engine_routing, incremental_outputs, visible_text)}


def oracle_sql():
    return {
        "clean_names": CLEAN_NAMES, "filing_paths": FILING, "metadata_header": HEADER, "tolerant_json": TOLERANT, "pass_convergence": CONVERGENCE, "run_summary": SUMMARY, "admission": ADMISSION,
        "engine_routing": ROUTING, "incremental_outputs": INCREMENTAL, "visible_text": VISIBLE,
    }
