"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of neighbouring lines decides after which lines a chunk ends, so an inserted or deleted
line moves no boundary but those next to it. Every remainder of the hash has boundaries of its own, and a long line is
a chunk by itself. Chunks that occur more than once anywhere are removed but for one occurrence, whose bytes are compared;
hashes only route them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed, plain_table

#: Lines that the rolling hash covers, its multiplier, and its remainders: in the chunks of each of them, one line in so
#: many is an end on average.
WINDOW_LINES = 2
MULTIPLIER = 31
REMAINDERS = 3
#: Words of a line, counted by its spaces, from which it is a chunk by itself.
LONG_WORDS = 50


def _lines(text: str) -> F.Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _chunks(keyed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, __r1, __r2, start, stop (0-based lines, stop exclusive), k1 and k2 (of its bytes) of every chunk that counts.

    A chunk counts if it has several lines or is one long line, and isn't blank. Chunks of the same lines count once.
    No row is without lines; the outer form keeps the optimizer from testing that, which would cut every text twice.
    """
    lined = keyed.select(F.col(doc_id).alias("doc_id"), "__r1", "__r2", _lines(text).alias("lines"))
    long = F.transform("lines", lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= LONG_WORDS - 1)
    hashed = lined.withColumns({"hashes": F.transform("lines", lambda line: F.conv(F.substring(F.md5(F.encode(line, "UTF-8")), 1, 7), 16, 10).cast("long")), "long": long})

    def rest(i):
        """The rolling hash's remainder behind a line, -1 where every kind of chunk ends: at long lines and at the end."""
        rolled = sum((F.coalesce(F.get("hashes", i - k), F.lit(0)) * MULTIPLIER**k for k in range(1, WINDOW_LINES)), F.get("hashes", i))
        return F.when((i == F.size("lines") - 1) | F.get("long", i) | F.coalesce(F.get("long", i + 1), F.lit(False)), F.lit(-1)).otherwise((rolled % REMAINDERS).cast("int"))

    cut = hashed.withColumn("rests", F.transform(F.sequence(F.lit(0), F.size("lines") - 1), rest))
    places = F.sequence(F.lit(0), F.size("lines") - 1)

    def ends_of(remainder):
        return F.filter(places, lambda i: F.get("rests", i).isin(-1, remainder))

    ends = F.array(*map(ends_of, range(REMAINDERS)))

    def spans(own):
        return F.transform(own, lambda end, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(own, k - 1) + 1).alias("start"), (end + 1).alias("stop")))

    counts = F.filter(F.array_distinct(F.flatten(F.transform("ends", spans))), lambda s: (s["stop"] - s["start"] > 1) | F.get("long", s["start"]))
    each = cut.withColumn("ends", ends).select("doc_id", "__r1", "__r2", "lines", F.explode_outer(counts).alias("span"))
    chunk = F.array_join(F.slice("lines", F.col("span.start") + 1, F.col("span.stop") - F.col("span.start")), "\n")
    found = each.where("span is not null").select("doc_id", "__r1", "__r2", "span.*", chunk.alias("chunk")).where(F.col("chunk").rlike("[^ \\t\\r\\n]"))
    return found.select("doc_id", "__r1", "__r2", "start", "stop", F.xxhash64("chunk").alias("k1"), F.xxhash64(F.lit(1), F.col("chunk")).alias("k2"))


def drop_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` rid of repeated chunks, and the columns n_lines, removed_lines (int) added.

    Of the occurrences of a chunk, that in the smallest doc_id stays, and in that document the first. A line goes with any
    chunk that goes; one copy of it stays where all these chunks come from. Lines under LONG_WORDS that are repeated
    alone, and blank chunks, always stay. Rows of one doc_id count as one document: a chunk that stays in it stays in each
    of its rows. Chunks that only rows with a null doc_id have stay in all those rows. A null text counts as empty (one
    empty line) and stays null; no row is dropped, even if nothing is left of its text. Input columns named n_lines or
    removed_lines are replaced. Different chunks with equal 128-bit keys would all be left alone.

    Only hashes of chunks are counted at first; they are worked out twice rather than stored. The bytes of those that repeat are grouped where
    they lie before they move: one copy of a chunk leaves each task.
    """
    docs = docs.drop("n_lines", "removed_lines")
    keyed = docs.withColumns({"__r1": F.xxhash64(doc_id, text), "__r2": F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))})
    chunks = _chunks(keyed.select(doc_id, text, "__r1", "__r2"), doc_id, text)
    # tables of their own, so that both sides of the join come straight from their shuffles and hot keys can be split
    repeated = checkpointed(chunks.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1").select("k1", "k2", "keeper"))
    found = checkpointed(chunks.join(repeated, ["k1", "k2"]).select("doc_id", "__r1", "__r2", "start", "stop", "k1", "k2", "keeper"))
    in_row = found.groupBy("__r1", "__r2").agg(F.collect_set(F.struct("start", "stop", "k1", "k2")).alias("spans"))
    read = keyed.select("__r1", "__r2", F.col(text).alias("text")).join(in_row, ["__r1", "__r2"]).select(_lines("text").alias("lines"), F.explode("spans").alias("s"))
    bytes_of = read.select("s.k1", "s.k2", F.array_join(F.slice("lines", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")), "\n").alias("chunk"))
    mixed = checkpointed(bytes_of.groupBy("k1", "k2", "chunk").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("texts")).where("texts > 1").select("k1", "k2"))
    equal = found.join(mixed, ["k1", "k2"], "left_anti") if not mixed.isEmpty() else found
    own = Window.partitionBy("__r1", "__r2", "k1", "k2")
    gone = equal.withColumn("first", F.min("start").over(own)).where((F.col("start") > F.col("first")) | ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    removal = gone.groupBy("__r1", "__r2").agg(F.collect_set(F.struct("start", "stop")).alias("__gone"))
    joined = keyed.join(removal, ["__r1", "__r2"], "left").withColumn("__lines", _lines(text))
    lines_gone = F.flatten(F.transform("__gone", lambda s: F.sequence(s["start"], s["stop"] - 1)))
    kept = joined.withColumn("__kept", F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), lines_gone), lambda i: F.get("__lines", i)))
    untouched = F.col("__gone").isNull()
    return kept.select(
        *[F.when(untouched, F.col(c)).otherwise(F.array_join("__kept", "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.size("__lines").alias("n_lines"),
        F.when(untouched, F.lit(0)).otherwise(F.size("__lines") - F.size("__kept")).alias("removed_lines"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, removed_lines, kept_md5 (of the text that is left) of every document."""
    done = drop_repeated_chunks(plain_table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "removed_lines", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kept_md5"))


_ENDS = "(len(lines) = i OR long[i] OR coalesce(long[i + 1], false))"

SQL = f"""
WITH lined AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), hashed AS (
  SELECT *, list_transform(lines, lambda l: ('0x' || substr(md5(l), 1, 7))::BIGINT) AS hashes,
    list_transform(lines, lambda l: length(l) - length(replace(l, ' ', '')) >= {LONG_WORDS - 1}) AS long FROM lined
), rests AS (
  SELECT *, list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN {_ENDS} THEN -1
    ELSE (hashes[i] + CASE WHEN i > 1 THEN hashes[i - 1] * {MULTIPLIER} ELSE 0 END) % {REMAINDERS} END) AS rests FROM hashed
), ended AS (
  SELECT r.*, n, list_filter(range(1, len(lines) + 1), lambda i: rests[i] = -1 OR rests[i] = n) AS ends FROM rests r, range(0, {REMAINDERS}) AS k(n)
), numbered AS (
  SELECT *, unnest(range(1, len(ends) + 1)) AS pos FROM ended
), spans AS (
  SELECT DISTINCT row_id, doc_id, CASE WHEN pos = 1 THEN 1 ELSE ends[pos - 1] + 1 END AS start, ends[pos] AS stop FROM numbered
), chunks AS (
  SELECT s.*, array_to_string(lines[start : stop], chr(10)) AS chunk FROM spans s JOIN hashed h USING (row_id) WHERE stop > start OR long[start]
), several AS (
  SELECT * FROM chunks WHERE regexp_matches(chunk, '[^ \\t\\r\\n]')
), repeated AS (
  SELECT chunk, min(doc_id) AS keeper FROM several GROUP BY chunk HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT row_id, unnest(range(start, stop + 1)) AS i FROM (
    SELECT s.*, keeper, min(start) OVER (PARTITION BY row_id, s.chunk) AS first FROM several s JOIN repeated r ON s.chunk = r.chunk
  ) WHERE start > first OR doc_id IS DISTINCT FROM keeper
), each AS (
  SELECT row_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM lined
), kept AS (
  SELECT e.row_id, count(*) AS n, string_agg(line, chr(10) ORDER BY e.i) AS text FROM each e LEFT JOIN gone g ON e.row_id = g.row_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.row_id
)
SELECT d.doc_id, len(d.lines)::INT AS n_lines, (len(d.lines) - coalesce(k.n, 0))::INT AS removed_lines, md5(coalesce(k.text, '')) AS kept_md5
FROM lined d LEFT JOIN kept k USING (row_id)
"""
