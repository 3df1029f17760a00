"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import backoff, bpe, fill_middle, fingerprint, importance, line_chunks, mixing, pii, quality, revisit, simhash_cover, tiff, url_lists
from foliospark.llm.common import read_table


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(spark, read_table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.query,
        "op2_temperature_mixing": mixing.query,
        "op3_simhash_near_dedup": simhash_cover.query,
        "op4_skip_chain_pii": pii.query,
        "op5_line_chunk_dedup": line_chunks.query,
        "op6_temporal_url_lists": url_lists.query,
        "op7_revisit_resolution": revisit.query,
        "op8_tiff_media": tiff.query,
        "op9_document_fingerprints": fingerprint.query,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_importance_resampling": importance.query,
        "op12_fill_in_middle": fill_middle.query,
        "op13_backoff_automaton": backoff.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_chunk_dedup": line_chunks.SQL,
        "op6_temporal_url_lists": url_lists.SQL,
        "op7_revisit_resolution": revisit.SQL,
        "op11_importance_resampling": importance.SQL,
        "op12_fill_in_middle": fill_middle.SQL,
    }
