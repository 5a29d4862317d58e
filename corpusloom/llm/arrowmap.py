"""Row-preserving Arrow maps: a function sees a batch and returns new columns for the same rows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.session import ship_package


def with_arrow_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField], drop: list[str] = ()
) -> DataFrame:
    """``df`` less ``drop``, plus ``fields``. ``make()`` runs once a task and returns the batch function,
    whose attribute ``close``, if it has one, is called at the task's end.

    No shuffle: rows stay where they are. A new name that ``df`` already has is an error.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    # names that differ in case alone are one name to Spark
    if clash := {f.name.lower() for f in kept} & {f.name.lower() for f in fields}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    if len({f.name.lower() for f in df.schema.fields}) < len(df.schema.fields):
        raise ValueError("column names are not unique")
    schema = T.StructType(kept + list(fields))
    names, old = [f.name for f in schema.fields], [f.name for f in kept]

    def run(batches):
        work = make()
        close = getattr(work, "close", None)
        try:
            for batch in batches:
                new = work(batch)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in old] + new, names=names)
        finally:
            del work
            if close:
                close()
            give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, rows: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(rows, schema)`` whose tasks return the memory they freed as they end."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def prefixed(fields: list[tuple[str, T.DataType]], prefix: str) -> list[T.StructField]:
    return [T.StructField(prefix + n, t) for n, t in fields]
