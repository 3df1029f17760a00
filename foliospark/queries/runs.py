"""Queries on runs: jobs that are awaited, files that are published and read, pages that are opened, records of what was done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.checkpoints import ensure_checkpoint_dir
from foliospark.functions import glyphs, pages, widths
from foliospark.operators import quality
from foliospark.plans import batch
from foliospark.queries import sqltext as S
from foliospark.sources import files, publishing, runlog, wordtables
from foliospark.sources.tables import read_table as table
from foliospark.streaming import jobs


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: For remote_jobs: hours that a job waits for an answer, and polls of it at most.
JOB_HOURS, JOB_POLLS = 36, 3

_REPLY = """CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'asked' ELSE 'uploaded' END WHEN 'view' THEN 'submitted'
  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'running' END WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'fetched' END
  ELSE CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'uploaded' END END"""


def replies_of(events: DataFrame) -> DataFrame:
    """Events as replies: a user's week is a document."""
    doc = F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)
    return events.select(doc.alias("doc"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.expr(_REPLY).alias("kind"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("value"))


def remote_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that the events, read as a stream of replies, lead to: upload, submit, poll, fetch, finished, failed."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a pattern, as a stream takes a single file by none other
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "event[s].parquet"))
    folder = scratch(spark, "remote-jobs")
    limits = jobs.Limits(JOB_HOURS * 3_600_000, JOB_POLLS)
    jobs.start(jobs.commands(replies_of(stream), "doc", limits), f"{folder}/commands", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/commands").withColumn("at", F.col("at").cast("timestamp_ntz"))


REMOTE_JOBS = f"""
WITH RECURSIVE replies AS (
  SELECT user_id * 10 + (day(ts) - 1) // 7 AS doc, epoch_us(ts) // 1000 AS told, {_REPLY} AS kind, 'r' || event_id AS value,
         row_number() OVER (PARTITION BY user_id * 10 + (day(ts) - 1) // 7 ORDER BY ts, event_id) AS rn
  FROM events
), steps AS (
  SELECT doc, 0::BIGINT AS rn, 'new' AS phase, NULL::VARCHAR AS address, 0 AS polls, 0::BIGINT AS deadline, 0::BIGINT AS sent, NULL::BIGINT AS sent_at, NULL::VARCHAR AS command, NULL::VARCHAR AS about
  FROM replies GROUP BY doc
  UNION ALL
  SELECT doc, rn,
         CASE act WHEN 'late' THEN 'ended' WHEN 'often' THEN 'ended' WHEN 'failed' THEN 'ended' WHEN 'upload' THEN 'uploading' WHEN 'submit' THEN 'submitting' WHEN 'poll' THEN 'polling' WHEN 'fetch' THEN 'fetching' WHEN 'finished' THEN 'ended' ELSE phase END,
         CASE WHEN act = 'poll' AND kind = 'submitted' THEN value ELSE address END,
         CASE WHEN act = 'poll' THEN polls + 1 ELSE polls END,
         CASE WHEN act IN ('upload', 'submit', 'poll', 'fetch', 'finished') THEN now + {JOB_HOURS * 3_600_000} ELSE deadline END,
         CASE WHEN act IS NULL THEN sent ELSE sent + 1 END,
         CASE WHEN act = 'late' THEN deadline WHEN act IS NOT NULL THEN now END,
         CASE WHEN act IN ('late', 'often') THEN 'failed' ELSE act END,
         CASE act WHEN 'late' THEN '{jobs.TOO_LATE}' WHEN 'often' THEN '{jobs.TOO_OFTEN}' WHEN 'poll' THEN CASE WHEN kind = 'submitted' THEN value ELSE address END ELSE CASE WHEN act IS NOT NULL THEN value END END
  FROM (
    SELECT s.doc, r.rn, s.phase, s.address, s.polls, s.deadline, s.sent, r.told AS now, r.kind, r.value,
           CASE WHEN s.phase NOT IN ('new', 'ended') AND r.told > s.deadline THEN 'late'
                WHEN s.phase NOT IN ('new', 'ended') AND r.kind = 'failed' THEN 'failed'
                WHEN s.phase = 'new' AND r.kind = 'asked' THEN 'upload'
                WHEN s.phase = 'uploading' AND r.kind = 'uploaded' THEN 'submit'
                WHEN s.phase = 'submitting' AND r.kind = 'submitted' OR s.phase = 'polling' AND r.kind = 'running' THEN CASE WHEN s.polls + 1 > {JOB_POLLS} THEN 'often' ELSE 'poll' END
                WHEN s.phase = 'polling' AND r.kind = 'done' THEN 'fetch'
                WHEN s.phase = 'fetching' AND r.kind = 'fetched' THEN 'finished' END AS act
    FROM steps s JOIN replies r ON r.doc = s.doc AND r.rn = s.rn + 1
  )
), sent AS (
  SELECT doc, sent_at, sent AS number, command, about FROM steps WHERE command IS NOT NULL
  UNION ALL
  SELECT doc, deadline, sent + 1, 'failed', '{jobs.TOO_LATE}'
  FROM (SELECT *, max(rn) OVER (PARTITION BY doc) AS last FROM steps)
  WHERE rn = last AND phase NOT IN ('new', 'ended') AND deadline <= (SELECT max(told) FROM replies)
)
SELECT doc, make_timestamp(sent_at * 1000) AS "at", number, command, about FROM sent
"""


def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and digest of the files that a job published: a conversation is one, with what was said in the order of its turns."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.coalesce(t["text"], F.lit(""))), "\n")
    talks = turns.groupBy("conv_id").agg(F.encode(said, "UTF-8").alias("content")).withColumn("out_name", F.concat(F.lit("talk-"), F.col("conv_id").cast("string"), F.lit(".txt")))
    folder = f"{scratch(spark, 'published')}/files"
    publishing.publish(talks, folder)
    there = files.read_folder(spark, folder)
    return there.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


PUBLISHED_FILES = """
WITH f AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id)
SELECT 'talk-' || conv_id || '.txt' AS name, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM f
"""

def folder_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch over a folder of files: a conversation is one, what it said its content. Every fourth was done before, some
    can't be recognised and stop nothing, what is recognised is written; bytes are those in the folder of outputs after it."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.coalesce(t["text"], F.lit(""))), "\n")
    name = F.concat(F.lit("talk-"), F.col("conv_id").cast("string"))
    talks = turns.groupBy("conv_id").agg(F.encode(said, "UTF-8").alias("content"))
    root = scratch(spark, "batch")
    publishing.publish(talks.withColumn("out_name", F.concat(name, F.when(F.col("conv_id") % 2 == 0, ".PDF").otherwise(".pdf"))), f"{root}/in")
    publishing.publish(talks.where("conv_id % 4 = 0").select(F.concat(name, F.lit(".ocr.pdf")).alias("out_name"), F.encode(F.lit("before"), "UTF-8").alias("content")), f"{root}/out")

    def recognise(todo: DataFrame) -> DataFrame:
        broken = F.length("content") % 3 == 0
        return todo.select("out_name", F.when(~broken, F.concat(F.encode(F.lit("%"), "UTF-8"), F.col("content"))).alias("content"), F.when(broken, "unreadable").alias("error"))

    told, _ = batch.run(spark, f"{root}/in/", f"{root}/out", recognise, files.names_in(spark, f"{root}/out"))
    there = files.read_folder(spark, f"{root}/out").select(F.regexp_extract("path", "([^/]*)$", 1).alias("out_name"), F.col("length").alias("bytes"))
    return told.join(there, "out_name", "left").select(F.col("out_name").alias("name"), "status", "error", "bytes")


FOLDER_BATCH = """
WITH f AS (SELECT conv_id, octet_length(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)))::BIGINT AS n FROM conversations GROUP BY conv_id)
SELECT 'talk-' || conv_id || '.ocr.pdf' AS name, CASE WHEN conv_id % 4 = 0 THEN 'skipped' WHEN n % 3 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN conv_id % 4 <> 0 AND n % 3 = 0 THEN 'unreadable' END AS error, CASE WHEN conv_id % 4 = 0 THEN 6 WHEN n % 3 <> 0 THEN n + 1 END AS bytes FROM f
"""

#: For scanned_words: bytes of a partition, words of that many pages.
PART_BYTES, PAGES = 1 << 19, 3


def scanned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the first pages, read from a folder of word tables: lines of orders are words, their numbers pages; totals are lines."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    whole = lambda c: F.col(c).cast("long")
    cells = lines.select(F.when(F.col("l_partkey") % 7 == 0, 4).otherwise(5), "l_linenumber", whole("l_suppkey"), F.lit(1), whole("l_partkey"), whole("l_orderkey"), whole("l_quantity"), whole("l_extendedprice"), F.lit(40), F.lit(9), F.round("l_discount", 2), F.concat("l_returnflag", F.lit(" "), "l_linestatus"))
    folder = f"{scratch(spark, 'words')}/tables"
    cells.toDF("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text").write.option("sep", "\t").option("header", "true").csv(folder)
    words = wordtables.read(spark, folder, PART_BYTES).where((F.col("level") == 5) & (F.col("page") <= PAGES))
    return words.select("page", "block", "line", "word", "left", "top", "conf", "text")


SCANNED_WORDS = f"""
SELECT l_linenumber AS page, l_suppkey::INT AS block, l_partkey::INT AS line, l_orderkey::INT AS word, l_quantity::BIGINT::DOUBLE AS "left", floor(l_extendedprice)::DOUBLE AS top, round(l_discount, 2) AS conf, l_returnflag || ' ' || l_linestatus AS text
FROM lineitem WHERE l_partkey % 7 <> 0 AND l_linenumber <= {PAGES}
"""


def opened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents by the table function, in SQL: a conversation is a document, four turns a page."""
    table(spark, sf_dir, "conversations", "conv_id", "turn", "text").createOrReplaceTempView("turns_of_conversations")
    pages.register(spark)
    return spark.sql("""SELECT doc AS conv_id, page, source_page, runs, chars, md5(text) AS text_md5
      FROM document_pages(TABLE(SELECT conv_id AS doc, CAST(turn DIV 4 AS INT) AS page, turn AS seq, text FROM turns_of_conversations), false)""")


OPENED_PAGES = """
WITH p AS (
  SELECT conv_id, (turn // 4)::INT AS source_page, count(*)::INT AS runs, string_agg(text, ' ' ORDER BY turn, text) FILTER (text <> '') AS text FROM conversations GROUP BY ALL
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY source_page)::INT AS page, source_page, runs, length(coalesce(text, ''))::INT AS chars, md5(coalesce(text, '')) AS text_md5 FROM p
"""


def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of every whole text in thousandths of the font's size."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", widths.text_width(F.coalesce("text", F.lit(""))).alias("width"))


TEXT_WIDTHS = f"""
WITH ranges(first, advance) AS (VALUES {', '.join(map(str, widths.ADVANCES))}),
characters AS (SELECT doc_id, unicode(c) AS point, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL),
wide AS (SELECT doc_id, sum(n * advance)::BIGINT AS width FROM characters ASOF JOIN ranges ON point >= first GROUP BY doc_id)
SELECT doc_id, coalesce(width, 0) AS width FROM documents LEFT JOIN wide USING (doc_id)
"""


def nested_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible glyphs of arguments of one to five levels: a word is a glyph, its length the spacing behind it, a document a page."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    glyph = F.transform(words, lambda w, i: F.concat(F.to_json(F.named_struct(F.lit("unicode"), F.when(i % 5 == 0, F.lit(" ")).otherwise(w))), F.lit(","), F.length(w).cast("string")))
    levels = (F.col("doc_id") % 5 + 1).cast("int")
    argument = F.concat(F.repeat(F.lit("["), levels), F.array_join(glyph, ","), F.repeat(F.lit("]"), levels))
    return docs.select("doc_id", glyphs.glyph_count(F.parse_json(argument)).alias("glyphs"))


NESTED_GLYPHS = f"""
WITH words AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS i FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 + 1 > 3 THEN 0 ELSE sum(CASE WHEN i % 5 = 0 OR w <> '' AND {S.blank('w')} THEN 0 ELSE 1 END) END::INT AS glyphs FROM words GROUP BY doc_id
"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of a run that judges all documents and writes what isn't junk; the run reads its table once."""
    log = runlog.RunLog(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = quality.with_quality(docs).withColumn("junk", quality.is_junk(F.col("chars"), F.col("plausible_share")))
    kept = log.step(judged, "judged", **runlog.layer_counters()).where(~F.col("junk"))
    log.step(kept, "kept", **runlog.layer_counters()).write.parquet(f"{scratch(spark, 'kept')}/layers")
    return log.records().select("level", "msg", F.map_entries("fields").alias("f"), "stream").select("level", "msg", "stream", F.explode("f").alias("f")).select("level", "msg", "stream", "f.*")


RUN_LOG = f"""
WITH measured AS (
  SELECT doc_id, text, coalesce(sum(length(t)), 0) AS chars, coalesce(sum(CASE WHEN {S.plausible('t')} THEN length(t) ELSE 0 END) / sum(length(t)), 0) AS share
  FROM (SELECT doc_id, text, unnest(CASE WHEN len({S.tokens('text')}) = 0 THEN [NULL] ELSE {S.tokens('text')} END) AS t FROM documents) GROUP BY doc_id, text
), judged AS (
  SELECT coalesce(length(text), 0) AS n, chars >= 40 AND share < 0.5 AS junk FROM measured
), steps AS (
  SELECT 'judged' AS msg, count(*) AS documents, sum(n)::BIGINT AS chars, max(n) AS longest, count(*) FILTER (n = 0) AS empty, count(*) FILTER (junk) AS warnings FROM judged
  UNION ALL
  SELECT 'kept', count(*), sum(n)::BIGINT, max(n), count(*) FILTER (n = 0), 0 FROM judged WHERE NOT junk
)
SELECT CASE WHEN warnings > 0 THEN 'warn' ELSE 'info' END AS level, msg, CASE WHEN warnings > 0 THEN 'stderr' ELSE 'stdout' END AS stream, key, value::VARCHAR AS value
FROM (SELECT msg, warnings, unnest(['documents', 'chars', 'longest', 'empty', 'warnings']) AS key, unnest([documents, chars, longest, empty, warnings]) AS value FROM steps)
"""


def queries():
    return {f.__name__: f for f in (remote_jobs, published_files, folder_batch, scanned_words, opened_pages, text_widths, nested_glyphs, run_log)}


def oracle_sql():
    return {
        "remote_jobs": REMOTE_JOBS, "published_files": PUBLISHED_FILES, "folder_batch": FOLDER_BATCH, "scanned_words": SCANNED_WORDS, "opened_pages": OPENED_PAGES,
        "text_widths": TEXT_WIDTHS, "nested_glyphs": NESTED_GLYPHS, "run_log": RUN_LOG,
    }
