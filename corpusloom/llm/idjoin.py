"""Joins of wide rows with a list of ids, by broadcast where the list is proven small, else by shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows, as they lie in memory, that may be broadcast.
BROADCAST_BYTES = 48 << 20


def by_id(df: DataFrame, ids: DataFrame, id_col: str | list[str], how: str, null_safe: bool = False) -> DataFrame:
    """``df`` joined with ``ids`` (stored rows: measuring them is cheap) on ``id_col``.

    A list proven small is broadcast, so the texts of ``df`` aren't shuffled; a longer one takes a sort-merge join, whose
    skewed keys Spark splits. With ``null_safe``, null ids are equal.
    """
    if memory_bytes(ids) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    else:
        ids = ids.hint("merge")
    if not null_safe:
        return df.join(ids, id_col, how)
    keys = [id_col] if isinstance(id_col, str) else id_col
    ids = ids.withColumnsRenamed({k: f"__loom_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__loom_r_{k}")) for k in keys]
    return df.join(ids, on, how).drop(*(f"__loom_r_{k}" for k in keys))


def whole_ids(df: DataFrame, id_col: str) -> Column:
    """The id column, whole numbers as long: ids that order as they are otherwise."""
    return F.col(id_col).cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.col(id_col)


def memory_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: 8 a field and 8 a row, and what arrays (of int or long), texts and bytes hold."""
    held = F.lit(8 * (len(df.columns) + 1))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            held = held + (4 if isinstance(f.dataType.elementType, T.IntegerType) else 8) * F.coalesce(F.size(f.name), F.lit(0))
        elif isinstance(f.dataType, T.StringType | T.BinaryType):
            held = held + F.coalesce(F.octet_length(f.name), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(held.cast("long")), F.lit(0))).first()[0])


def unrepeated(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key repeats (null keys aside)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
