"""Importance resampling towards a target distribution, over hashed features.

An external sort-count: tasks write the buckets of their documents' features as packed streams of uint16 with the offsets of
the documents. The streams are sorted and run-length encoded for the counts of buckets; with the gains that follow from these,
each stream is read once more, its gains are gathered and added up between offsets. A feature never becomes a row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed, read_table

#: Fixed values of the features: buckets (uint16 holds their numbers), and words of a feature at most.
BUCKETS = 10_000
LONGEST = 1
#: Documents with fewer words aren't drawn; so many of 100 others are.
LEAST_WORDS = 20
DRAWN = 10
SEED = 2024
#: A packed row closes after so many documents, or at the first document that fills so many features.
PACKED_DOCS = 1_000
PACKED_FEATURES = 1 << 20

#: Bytes of words stay, A to Z in lower case; all other ASCII becomes white space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_buckets(text: bytes, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Words of a text in UTF-8, and the buckets (uint16) of its features: runs of 1 to `longest` words, repeats included."""
    words = text.translate(_WORD_BYTES).split()
    runs = [words, *([b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(2, longest + 1))]
    hashed = [np.fromiter(map(zlib.crc32, r), np.uint32, len(r)) for r in runs]
    return len(words), (np.concatenate(hashed) % BUCKETS).astype("<u2")


def packed(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """ids, words (arrays, one value a document), offsets (binary, int64) and stream (binary, uint16) of documents in turn."""
    shaped = docs.select((F.col(doc_id) if doc_id else F.lit(None)).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kinds = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("offsets", pa.binary()), ("stream", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, streams, held = [], [], [], 0

        def row():
            ends = np.cumsum([0, *map(len, streams)], dtype="<i8")
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((ids, words, ends.tobytes(), b"".join(s.tobytes() for s in streams)), kinds)], schema=kinds)

        for batch in batches:
            for i in range(batch.num_rows):
                n, stream = feature_buckets(batch.column(1)[i].as_py(), longest)
                ids.append(batch.column(0)[i].as_py())
                words.append(n)
                streams.append(stream)
                held += len(stream)
                if len(ids) >= PACKED_DOCS or held >= PACKED_FEATURES:
                    yield row()
                    ids, words, streams, held = [], [], [], 0
        if ids:
            yield row()

    return shaped.mapInArrow(run, "ids array<bigint>, words array<bigint>, offsets binary, stream binary")


def bucket_counts(streams: DataFrame) -> np.ndarray:
    """Features in each bucket (int64), over all packed streams. A task sends a row a bucket at most, as many as there are buckets."""
    kinds = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                ordered = np.sort(np.frombuffer(value.as_py(), "<u2"))
                if len(ordered):
                    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ 1))  # where a run begins
                    total[ordered[starts]] += np.diff(starts, append=len(ordered))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], schema=kinds)

    sums = streams.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier the target makes each bucket, by counts with one added (int64)."""
    every, target = float(all_counts.sum() + BUCKETS), float(target_counts.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * every / (float(s + 1) * target))) for s, t in zip(all_counts.tolist(), target_counts.tolist())], np.int64)


def weighted(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every packed document."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)
    kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, offsets, stream = (batch.column(k)[i] for k in range(4))
                ends = np.frombuffer(offsets.as_py(), "<i8")
                size = np.diff(ends)
                weight = np.zeros(len(size), np.int64)
                some = size > 0  # an empty stretch would take the next one's first gain
                if some.any():
                    weight[some] = np.add.reduceat(shared.value[np.frombuffer(stream.as_py(), "<u2")], ends[:-1][some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(size), pa.array(weight)], schema=kinds)

    return streams.select("ids", "words", "offsets", "stream").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: str = "doc_id", seed: int = SEED) -> F.Column:
    """floor(1000 x a Gumbel variate) that follows from the id; a null id draws like the id ""."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: the places of the highest scores among documents of enough words, null for all others.

    Ties go to the smaller id, null ids last. The order is that of ranges which Spark samples: each range counts its rows,
    and the sums of those before it (a row a range) are added to the places within it. No task sees more than its range.
    """
    fit = scored.withColumn("__fit", F.col("n_words") >= least_words)
    order = [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = checkpointed(fit.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"), F.count_if("__fit").alias("__fits"))
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), F.floor(F.sum("__fits").over(every) * drawn / 100).alias("__drawn"))
    placed = ranged.join(F.broadcast(starts), "__range").withColumn("__place", F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    kept = [c for c in scored.columns if c != "rank"]
    return placed.select(*kept, F.when(F.col("__place") <= F.col("__drawn"), F.col("__place")).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; see ranked() for what is drawn.

    A null or empty text has no words: weight 0. Repeated rows stay, each has a place of its own. An empty target leaves all
    counts of it at zero; an empty table of documents gives an empty table. Other columns of docs aren't read: join by id.
    The packed streams are written once, to the shared checkpoint folder, two bytes a feature. The driver holds one number a
    bucket. A text is held whole by its task.
    """
    streams = checkpointed(packed(docs, doc_id, text, longest))
    gains = bucket_gains(bucket_counts(streams), bucket_counts(packed(target, None, target_text, longest)))
    return ranked(weighted(streams, gains).withColumn("score", F.col("weight") + noise("doc_id", seed)), drawn, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the texts of benchmark."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return resampled(docs, read_table(spark, sf_dir, "benchmark", "text")).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is worked out from its polynomial, a table of 256 values and a fold over the bytes of each different word.
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS steps
), words AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (SELECT (sum(s) + {BUCKETS})::DOUBLE FROM counts) / ((s + 1)::DOUBLE * (SELECT (sum(t) + {BUCKETS})::DOUBLE FROM counts))))::BIGINT AS gain FROM counts
), sums AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= {LEAST_WORDS} DESC, score DESC, doc_id) AS place, (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) AS n FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= {DRAWN} * n // 100 THEN place END AS rank FROM placed
"""
