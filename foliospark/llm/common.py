"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.checkpoints import checkpointed, ensure_checkpoint_dir
from foliospark.sources.tables import plain_table, read_table

__all__ = ["checkpointed", "ensure_checkpoint_dir", "hashed_share", "map_columns", "plain_table", "read_table"]


#: Rows that map_columns() hands to its function in one call.
ROWS_AT_ONCE = 256


def map_columns(df: DataFrame, needs: Sequence[str], fields: Sequence[T.StructField], work: Callable[..., Sequence[Sequence]], keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns computed batch by batch in Python from the columns `needs`.

    work gets one list per needed column and returns one list per field. The columns of `keep` (by default all)
    pass through untouched; one that has the name of a new field is replaced by it.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    taken = {c: f"__in_{i}" for i, c in enumerate(needs)}
    shaped = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in taken.items()])
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a few rows at a time, so that only their values exist as Python objects
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                columns = whole.slice(at, ROWS_AT_ONCE).columns
                made = work(*[c.to_pylist() for c in columns[len(kept):]])
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns[: len(kept)], arrow)], *[pa.array(v, f.type) for v, f in zip(made, list(arrow)[len(kept):])]], schema=arrow)

    return shaped.mapInArrow(run, schema)


def hashed_share(*columns: str) -> F.Column:
    """A number in [0, 1) that follows from the columns' values alone: rows below a bound are a sample of that share."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(97), *[F.col(c) for c in columns]), 11) / F.lit(float(1 << 53))
