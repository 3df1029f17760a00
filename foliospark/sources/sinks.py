"""Sinks: whole files in a folder that all executors share, and log records."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40}


def write_files(files: DataFrame, folder: str, name: str = "out_name", content: str = "content") -> DataFrame:
    """Writes each row's content to a file in a folder that all executors share; returns out_name, status, error.

    folder: a path, or an address that pyarrow's file systems know (file:, hdfs:, s3: and so on). A file appears whole or
    not at all: it is written under another name and then moved; only where the store can't move over a file that is there,
    that one goes first. A failure is told in its row, leaves nothing behind, and doesn't stop the others.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        named = re.match("[A-Za-z][A-Za-z0-9+.-]+:", folder)
        store, base = None, ""
        for batch in batches:
            told = []
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = ""
                try:
                    if store is None:  # as long as the folder can't be had, each row tells so
                        opened, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder)) if named else (fs.LocalFileSystem(), folder)
                        opened.create_dir(base, recursive=True)
                        store = opened
                    part, target = f"{base.rstrip('/')}/{label}.{uuid.uuid4().hex}.part", f"{base.rstrip('/')}/{label}"
                    with store.open_output_stream(part) as out:
                        out.write(data or b"")
                    if store.type_name != "local" and store.get_file_info(target).type != fs.FileType.NotFound:
                        store.delete_file(target)
                    store.move(part, target)
                    status, error = "ok", None
                except (OSError, ValueError) as problem:  # what pyarrow's file systems raise
                    status, error = "failed", str(problem)
                    if store is not None and part and store.get_file_info(part).type == fs.FileType.File:
                        store.delete_file(part)
                told.append((label, status, error))
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], pa.string()) for k in range(3)], names=["out_name", "status", "error"])

    return files.select(name, content).mapInArrow(run, "out_name string, status string, error string")


def log_records(events: DataFrame, threshold: str = "info") -> DataFrame:
    """events (time, level, msg, fields: map of strings) at or above a level, with `line` and `stream`.

    line is JSON without the fields that are null; warnings and errors go to the error stream.
    """
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("level"))
    kept = events.where(F.coalesce(rank, F.lit(20)) >= LEVELS[threshold])
    known = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    head = F.create_map(F.lit("time"), F.col("time").cast("string"), F.lit("level"), F.col("level"), F.lit("msg"), F.col("msg"))
    return kept.withColumns({"line": F.to_json(F.map_concat(head, known)), "stream": F.when(rank >= LEVELS["warn"], "stderr").otherwise("stdout")})


def text_line(time: Column, level: Column, msg: Column, fields: Column) -> Column:
    """A log record as text: fields as key=value, quoted where needed."""
    from foliospark.functions.text import log_value

    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), log_value(e["value"])))
    return F.concat_ws(" ", time, F.rpad(F.upper(level), 5, " "), msg, F.when(F.size(pairs) > 0, F.array_join(pairs, " ")))


def library_level(level: Column) -> Column:
    """Level of another library's record: fatal counts as error, what isn't a warning or error as debug."""
    return F.when(level.isin("ERROR", "FATAL"), "error").when(level == "WARN", "warn").otherwise("debug")
