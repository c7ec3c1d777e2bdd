"""Helpers that every corpus operator shares: columns, Arrow maps and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attestra.sources.tables import Workspace, removed, scratch, shared_dir, written  # noqa: F401

#: Bytes at which an Arrow batch on its way to Python is closed; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Close the session's Arrow batches by their bytes, as texts can be long; a setting of the user's own stays."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that clash (in any case) with names about to be added."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns that an operator would replace (names, in any case) under other names, and the way back to
    df's own columns."""
    taken = {n.lower() for n in names}
    new = {c: f"__aside_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    order = list(df.columns)
    renamed = df.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in order])
    return renamed, lambda out: out.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in order])


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def add_with_arrow(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append fields computed batch by batch in Arrow. make() runs once per task and returns the batch function.

    keep: the columns to carry over (all by default); a column named like an added field is replaced.
    """
    bounded_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            added = step(batch)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in order]
            arrays += [a if a.type == t else a.cast(t) for a, t in zip(added, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*order, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)


_memories: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Within a Python worker, which Spark reuses: let go of what other operators' tasks have remembered there."""
    for other in [k for k in _memories if k != name]:
        _memories.pop(other)()
        pa.default_memory_pool().release_unused()
    _memories[name] = forget
