"""Queries on text layers: quality, lines, reading order, corrections, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry
from foliospark.functions.text import is_blank
from foliospark.operators import layout, lines, overlay, quality, reading
from foliospark.queries import sqltext as S
from foliospark.sources.tables import read_table as table


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return quality.with_quality(docs).drop("text").withColumn("junk", quality.is_junk(F.col("chars"), F.col("plausible_share")))


def layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and share of plausible words of every layer; a document is a page, its words are tokens."""
    return _measured(spark, sf_dir).select("doc_id", "chars", F.round("plausible_share", 6).alias("plausible_share"))


_MEASURED = f"""measured AS (
  SELECT doc_id, lang, coalesce(sum(length(t)), 0)::BIGINT AS chars, coalesce(sum(CASE WHEN {S.plausible('t')} THEN length(t) ELSE 0 END) / sum(length(t)), 0) AS share
  FROM (SELECT doc_id, lang, text, unnest(CASE WHEN len({S.tokens('text')}) = 0 THEN [NULL] ELSE {S.tokens('text')} END) AS t FROM documents) GROUP BY doc_id, lang
)"""
LAYER_QUALITY = f"WITH {_MEASURED} SELECT doc_id, chars, round(share, 6) AS plausible_share FROM measured"


def junk_layers_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language: layers, lowest and mean share of plausible words, and layers that are junk."""
    share = F.col("plausible_share")
    return _measured(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.min(share), 6).alias("min_share"), F.round(F.avg(share), 6).alias("avg_share"), F.count_if("junk").alias("junk_docs"))


JUNK_BY_LANG = f"WITH {_MEASURED} SELECT lang, count(*) AS docs, round(min(share), 6) AS min_share, round(avg(share), 6) AS avg_share, count(*) FILTER (chars >= 40 AND share < 0.5) AS junk_docs FROM measured GROUP BY lang"


def junk_vs_quality_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How junk layers agree with the labels of the table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _measured(spark, sf_dir).join(labels, "doc_id").groupBy("quality", "junk").agg(F.count("*").alias("docs"))


JUNK_VS_LABEL = f"WITH {_MEASURED} SELECT quality, (chars >= 40 AND share < 0.5) AS junk, count(*) AS docs FROM measured JOIN labels USING (doc_id) GROUP BY ALL"


def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line parted at wide gaps; a user is a line, an event a word at its hour, its height by its id."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    x0 = (F.unix_timestamp("ts") / 3600.0).cast("double")
    words = events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("text"), x0.alias("x0"), (x0 + 2.0).alias("x1"), F.lit(0.0).alias("y0"), (F.lit(10.0) + F.col("event_id") % 30).alias("y1"), F.col("value").alias("conf"))
    found = lines.lines_from_words(words, ["user_id"], [])
    return found.select("user_id", "segment", "first_seq", "text", *[F.round(c, 4).alias(c) for c in ("x", "y", "w", "h", "conf")])


GAP_SEGMENTS = """
WITH words AS (
  SELECT user_id, event_id AS seq, event_type AS text, floor(epoch(ts)) / 3600.0 AS x0, floor(epoch(ts)) / 3600.0 + 2.0 AS x1, 0.0::DOUBLE AS y0, (10.0 + event_id % 30)::DOUBLE AS y1, value AS conf FROM events
), gapped AS (
  SELECT *, max(y1 - y0) OVER (PARTITION BY user_id) AS h, lag(x1) OVER (PARTITION BY user_id ORDER BY x0, seq) AS prev, min(seq) OVER (PARTITION BY user_id) AS first_seq FROM words
), parted AS (
  SELECT *, (sum(CASE WHEN x0 - prev > 2 * h THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x0, seq ROWS UNBOUNDED PRECEDING))::INT AS segment FROM gapped
)
SELECT user_id, segment, first_seq, string_agg(text, ' ' ORDER BY x0, seq) AS text, round(min(x0), 4) AS x, round(min(y0), 4) AS y, round(max(x1) - min(x0), 4) AS w, round(max(y1) - min(y0), 4) AS h, round(avg(conf), 4) AS conf
FROM parted GROUP BY user_id, segment, first_seq
"""


def reading_order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page in reading order; a conversation is a page, two turns share a base line."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), "text", (F.floor(F.col("turn") / 2) * 12.0).alias("y"), F.lit(12.0).alias("line_height"))
    return reading.page_text(turns, ["conv_id"])


READING_ORDER = f"""
WITH seen AS (
  SELECT conv_id, turn, text, turn // 2 * 12.0 AS y, lag(turn // 2 * 12.0) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE NOT ({S.blank('text')})
)
SELECT conv_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN abs(y - before) > 6 THEN chr(10) ELSE ' ' END || text, '' ORDER BY turn) AS text FROM seen GROUP BY conv_id
"""


def plain_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of whole documents; a conversation is a document, a turn a page of one run."""
    runs = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), F.lit(0).alias("id"), "text", F.lit(False).alias("ends_line"))
    exported = reading.plain_text(runs, ["conv_id"])
    return exported.select("conv_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


PLAIN_TEXT = f"""
WITH pages AS (
  SELECT conv_id, turn, '=== Seite ' || (turn + 1) || ' ===' || chr(10) || CASE WHEN {S.blank('t')} THEN '{reading.NO_TEXT}' ELSE t END AS page
  FROM (SELECT conv_id, turn, string_agg(coalesce(text, ''), '' ORDER BY text) AS t FROM conversations GROUP BY conv_id, turn)
)
SELECT conv_id, md5(string_agg(page, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM pages GROUP BY conv_id
"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every page in chunks for a call; the lines of a document that aren't blank are its boxes, 25 a call."""
    boxes = reading.text_lines(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return boxes.withColumn("chunk", reading.chunk_of(F.col("id"), 25)).groupBy("doc_id", "chunk").agg(F.min("id").alias("first_id"), F.count("*").alias("boxes"), F.sum(F.length("text")).alias("chars"))


PAGE_CHUNKS = f"""
WITH boxes AS (
  SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT ({S.blank('l')}))) AS text,
    unnest(range(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT ({S.blank('l')})))))::INT AS id FROM documents
)
SELECT doc_id, id // 25 AS chunk, min(id) AS first_id, count(*) AS boxes, sum(length(text))::BIGINT AS chars FROM boxes GROUP BY doc_id, id // 25
"""


def overlay_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after their corrections: lines are boxes, every seventh gets a mark, every eleventh is emptied, and a
    correction of a box that wasn't asked for is passed over."""
    pages = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", reading.line_boxes(F.col("text")).alias("boxes")).where(F.size("boxes") > 0)
    marked = F.filter("boxes", lambda b: (b["id"] % 7 == 0) | (b["id"] % 11 == 0))
    fixes = F.flatten(F.transform(marked, lambda b: F.transform(F.array(F.lit(0), F.lit(100_000)), lambda more: F.struct((b["id"] + more).alias("id"), F.when(b["id"] % 11 == 0, "").otherwise(F.concat(F.lit("# "), b["text"])).alias("text")))))
    done = pages.withColumn("done", overlay.laid_over(F.col("boxes"), fixes))
    changed = F.filter("done", lambda b: overlay.differs(b["current"], b["text"]))
    alive = F.filter("done", lambda b: ~is_blank(b["current"]))
    chars = F.aggregate("done", F.lit(0).cast("long"), lambda n, b: n + F.length(b["current"]))
    return done.select("doc_id", F.size("done").cast("long").alias("boxes"), F.size(changed).cast("long").alias("changed"), F.size(alive).cast("long").alias("alive"), chars.alias("chars"))


OVERLAY = f"""
WITH boxes AS (
  SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT ({S.blank('l')}))) AS text,
    unnest(range(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT ({S.blank('l')})))))::INT AS id FROM documents
), done AS (
  SELECT *, CASE WHEN id % 11 = 0 THEN '' WHEN id % 7 = 0 THEN '# ' || text ELSE text END AS current FROM boxes
)
SELECT doc_id, count(*) AS boxes, count(*) FILTER ({S.trim('current')} <> {S.trim('text')}) AS changed, count(*) FILTER (NOT ({S.blank('current')})) AS alive, sum(length(current))::BIGINT AS chars FROM done GROUP BY doc_id
"""


def ink_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each page and whether it has ink; a vector is an image, its numbers are brightnesses."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    spread = vectors.withColumn("spread", quality.spread(F.transform("embedding", lambda v: v.cast("double") * 100)))
    return spread.select("vec_id", F.round("spread", 4).alias("spread"), quality.has_ink(F.col("spread")).alias("has_ink"))


INK_SPREAD = "SELECT vec_id, round(s, 4) AS spread, s > 12 AS has_ink FROM (SELECT vec_id, stddev_pop(v::DOUBLE * 100) AS s FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id)"


def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three percentile rules on the quantities of each group of items."""
    items = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    wanted = {"p90": ("index", 0.9), "upper_median": ("index", 0.5), "level90": ("histogram", 0.9)}
    return quality.percentiles(items, ["l_returnflag", "l_linestatus"], "l_quantity", wanted)


PERCENTILES = """
WITH s AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_quantity)) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, q[floor(n * 0.9)::INT + 1] AS p90, q[n // 2 + 1] AS upper_median, greatest(q[ceil(n * 0.9)::INT], 1) AS level90 FROM s
"""


def profile_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each vector's histogram, and for each label the vector whose histogram is sharpest."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").select("vec_id", "label", F.explode("embedding").alias("v"))
    energy = quality.profile_energy(vectors.select("vec_id", "label", (F.col("v").cast("double") * 50).alias("v")), ["label", "vec_id"], "v", 2.0)
    return quality.best_by(energy.withColumn("o", F.col("vec_id")), ["label"], "vec_id", "energy", "o")


PROFILE = """
WITH e AS (
  SELECT label, vec_id, sum(n * n)::BIGINT AS energy FROM (SELECT label, vec_id, floor(v::DOUBLE * 50 / 2.0) AS bin, count(*) AS n FROM (SELECT label, vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY ALL) GROUP BY ALL
)
SELECT label, vec_id, energy FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY energy DESC, vec_id) AS r FROM e) WHERE r = 1
"""


def box_per_mille(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in thousandths of their page; an item is a run: its numbers are its place and size on a page of 595 x 842."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 500).cast("double").alias("e"), (F.col("l_partkey") % 800).cast("double").alias("f"), "l_quantity", "l_discount")
    view = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 842.0)])
    run = F.array(F.lit(10.0), F.col("l_discount") * 10, F.col("l_discount") * -10, F.lit(10.0), F.col("e"), F.col("f"))
    box = geometry.box_per_mille(run, F.col("l_quantity") * 3, F.lit(12.0), view, F.lit(595.0), F.lit(842.0))
    return items.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


BOX = """
WITH i AS (
  SELECT l_orderkey, l_linenumber, (l_orderkey % 500)::DOUBLE AS e, (l_partkey % 800)::DOUBLE AS f, l_quantity * 3 AS w, 12.0::DOUBLE AS h,
    10 / sqrt(100 + (l_discount * 10) * (l_discount * 10)) AS ux, l_discount * 10 / sqrt(100 + (l_discount * 10) * (l_discount * 10)) AS uy FROM lineitem
), c AS (
  SELECT *, least(e, e + ux * w, e - uy * h, e + ux * w - uy * h) AS x0, greatest(e, e + ux * w, e - uy * h, e + ux * w - uy * h) AS x1,
    842 - greatest(f, f + uy * w, f + ux * h, f + uy * w + ux * h) AS y0, 842 - least(f, f + uy * w, f + ux * h, f + uy * w + ux * h) AS y1 FROM i
)
SELECT l_orderkey, l_linenumber, floor(x0 / 595 * 1000 + 0.5)::INT AS x, floor(y0 / 842 * 1000 + 0.5)::INT AS y,
  greatest(1, floor((x1 - x0) / 595 * 1000 + 0.5)::INT) AS w, greatest(1, floor((y1 - y0) / 842 * 1000 + 0.5)::INT) AS h FROM c
"""


def line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcribed lines laid out; a conversation is a page, its turns are lines that come down it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "text", (F.col("conv_id") * 37 % 1000).cast("int").alias("x"), (F.col("turn") * (9 + F.col("conv_id") % 20)).cast("int").alias("y"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    found = layout.line_layout(turns, ["conv_id"])
    return found.select("conv_id", "seq", *[F.round(c, 4).alias(c) for c in ("x", "baseline", "size", "scale_x")])


LAYOUT = """
WITH l AS (
  SELECT conv_id, turn AS seq, length(text) AS n, (conv_id * 37 % 1000)::INT AS x, (turn * (9 + conv_id % 20))::INT AS y FROM conversations
), g AS (
  SELECT conv_id, y - lag(y) OVER (PARTITION BY conv_id ORDER BY y, seq) AS gap FROM l
), m AS (
  SELECT conv_id, list_sort(list(gap)) AS gaps FROM g WHERE gap > 1 GROUP BY conv_id
), s AS (
  SELECT l.*, least(24, greatest(5, least(40, greatest(6, coalesce(gaps[len(gaps) // 2 + 1], 14))) / 1000 * 842 * 0.8)) AS size, least(0.9, greatest(0.02, x / 1000)) * 595 AS left_x FROM l LEFT JOIN m USING (conv_id)
)
SELECT conv_id, seq, round(left_x, 4) AS x, round(greatest(size, 842 - y / 1000 * 842 - size * 0.9), 4) AS baseline, round(size, 4) AS size,
  round(CASE WHEN n > 0 THEN least(1.0, (595 * 0.98 - left_x) / (n * size * 0.6)) ELSE 1.0 END, 4) AS scale_x FROM s
"""


def queries():
    return {f.__name__: f for f in (layer_quality, junk_layers_by_lang, junk_vs_quality_label, gap_segments, reading_order_text, plain_text_export, page_chunks, overlay_corrections, ink_spread, index_percentiles, profile_energy, box_per_mille, line_layout)}


def oracle_sql():
    return {
        "layer_quality": LAYER_QUALITY, "junk_layers_by_lang": JUNK_BY_LANG, "junk_vs_quality_label": JUNK_VS_LABEL, "gap_segments": GAP_SEGMENTS, "reading_order_text": READING_ORDER,
        "plain_text_export": PLAIN_TEXT, "page_chunks": PAGE_CHUNKS, "overlay_corrections": OVERLAY, "ink_spread": INK_SPREAD, "index_percentiles": PERCENTILES, "profile_energy": PROFILE,
        "box_per_mille": BOX, "line_layout": LAYOUT,
    }
