"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and decides over all of it. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, line_chunks, mixing, quality, simhash_cover
from foliospark.llm.common import ensure_checkpoint_dir, read_table
from foliospark.shipping import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; its labels are those of the tables in sf_dir.

    Where they are too few for a model, as with one class alone, nothing is rejected.
    """
    model = quality.fit_on(docs, read_table(spark, sf_dir, "labels"))
    if not model.weight:
        return docs
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without chunks of lines that an earlier one has; n_chars follows the text."""
    done = line_chunks.drop_repeated_chunks(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; a row that is there twice goes once."""
    return simhash_cover.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of smaller sources again, as the tempered weights want."""
    return mixing.mixed(docs, mixing.plan(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and ids, the tokens to train on, of every row."""
    ranks, pattern = bpe.public_ranks()
    return bpe.token_digests(docs.select("doc_id", "source", "text"), ranks, pattern, keep=["doc_id", "source"], to="ids")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode_tokens),
]

#: Compression, fingerprints and token ids are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what they return lies in the shared checkpoint folder, a new one for each run."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
