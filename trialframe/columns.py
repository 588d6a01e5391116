"""Small helpers for column names, lists and joins shared by all modules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def col(name: str) -> Column:
    """Column by its literal name, also when it holds dots, ``$`` or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(value) -> list:
    """A single value becomes a one-element list, None an empty one."""
    if value is None:
        return []
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        return [value]
    return list(value)


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: columns {missing} not in {df.columns}")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def key_struct(names: Sequence[str]) -> Column:
    """The key columns as one struct value.

    Two structs are equal when their fields are equal, missing fields included, so a plain equality on this
    column keeps NULL keys and still hash-partitions exactly like a group-by or window on the same column.
    """
    return F.struct(*[col(n).alias(f"k{i}") for i, n in enumerate(names)])


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the key columns of ``left`` are kept."""
    joint = "__key"
    lhs = left.withColumn(joint, key_struct(keys))
    rhs = right.withColumn(joint, key_struct(keys)).drop(*keys)
    return lhs.join(rhs, joint, how).drop(joint)


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure whether a frame fits the broadcast bound: its rows first, then their size as text."""
    if df.limit(max_rows + 1).count() > max_rows:
        return False
    width = F.octet_length(F.to_json(F.struct("*")))
    return (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint only behind a measured size; beyond it Spark's shuffled join with skew splitting runs."""
    return F.broadcast(df) if small_enough(df) else df
