"""Nested records to dotted columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import col


@dataclass(frozen=True)
class Leaf:
    """One dotted column of a nested record."""

    path: tuple[str, ...]
    dtype: T.DataType

    @property
    def name(self) -> str:
        return ".".join(self.path)


def _column_type(dtype: T.DataType) -> T.DataType:
    """The column type for a type found in the data: no decimals, and text where types are mixed."""
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, (T.NullType, T.VariantType)):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_column_type(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _column_type(f.dataType)) for f in dtype.fields])
    return dtype


def _as_struct_text(found: str) -> str:
    """The type text of a variant schema with OBJECT spelled as STRUCT (quoted field names stay as they are)."""
    parts = re.split(r"(`(?:[^`]|``)*`)", found)
    return "".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in parts)


def ddl(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StructType):
        fields = ", ".join(f"`{f.name.replace('`', '``')}`: {ddl(f.dataType)}" for f in dtype.fields)
        return f"struct<{fields}>"
    if isinstance(dtype, T.ArrayType):
        return f"array<{ddl(dtype.elementType)}>"
    return dtype.simpleString()


def variant_type(df: DataFrame, name: str) -> T.StructType:
    """The common type of all records in a variant column (one aggregation over the data)."""
    found = df.agg(F.schema_of_variant_agg(col(name))).first()[0]
    if found is None or found in ("VOID", "OBJECT<>"):
        return T.StructType([])
    dtype = T.DataType.fromDDL(_as_struct_text(found))
    if not isinstance(dtype, T.StructType):
        raise ValueError(f"records must be objects, but the data has {found}")
    return _column_type(dtype)


def leaves(dtype: T.StructType, path: tuple[str, ...] = ()) -> list[Leaf]:
    """Dotted columns of a record type; lists stay whole, empty objects vanish."""
    found = []
    for f in dtype.fields:
        here = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            found += leaves(f.dataType, here)
        else:
            found.append(Leaf(here, f.dataType))
    return found


def _walk(base: Column, path: tuple[str, ...]) -> Column:
    for key in path:
        base = base.getField(key)
    return base


def _has(name: str, leaf: Leaf) -> Column:
    """Does the record have this entry (a JSON null counts)?"""
    steps = "".join("['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" for key in leaf.path)
    return F.try_variant_get(col(name), "$" + steps, "variant").isNotNull()


def _either(test: Column, new: Column, new_type: T.DataType, old: Column, old_type: T.DataType) -> Column:
    """New value where the test holds, else the old one, in a type that fits both."""
    if new_type != old_type:
        numbers = isinstance(new_type, T.NumericType) and isinstance(old_type, T.NumericType)
        target = "double" if numbers else "string"

        def fit(c: Column, dtype: T.DataType) -> Column:
            nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
            return F.to_json(c) if nested and not numbers else c.cast(target)

        new, old = fit(new, new_type), fit(old, old_type)
    return F.when(test, new).otherwise(old)


def flatten_variant(df: DataFrame, name: str, dtype: T.StructType | None = None) -> DataFrame:
    """Replace a variant column by its dotted columns.

    Where a record has an entry, it replaces the value of an existing column of that name.
    """
    dtype = variant_type(df, name) if dtype is None else dtype
    found = leaves(dtype)
    if not found:
        return df.drop(name)
    types = {f.name: f.dataType for f in df.schema.fields}
    record = f"__{name}_record"
    df = df.withColumn(record, F.variant_get(col(name), "$", ddl(dtype)))
    new = {}
    for leaf in found:
        value = _walk(col(record), leaf.path)
        if leaf.name in types and leaf.name != name:
            value = _either(_has(name, leaf), value, leaf.dtype, col(leaf.name), types[leaf.name])
        new[leaf.name] = value
    kept = [col(c) for c in df.columns if c not in new and c not in (name, record)]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def flatten_structs(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Replace struct columns by their dotted columns."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType) and (names is None or f.name in names):
            out += [_walk(col(f.name), leaf.path).alias(f"{f.name}.{leaf.name}") for leaf in leaves(f.dataType)]
        else:
            out.append(col(f.name))
    return df.select(*out)


def path_values(df: DataFrame, name: str, keep: list[str], dtype: T.StructType | None = None) -> DataFrame:
    """One row per dotted path and value (as text) of a variant column."""
    dtype = variant_type(df, name) if dtype is None else dtype
    record = F.variant_get(col(name), "$", ddl(dtype))
    cells = []
    for leaf in leaves(dtype):
        value = _walk(F.col("__r"), leaf.path)
        text = F.to_json(value) if isinstance(leaf.dtype, T.ArrayType) else value.cast("string")
        cells.append(F.struct(F.lit(leaf.name).alias("path"), text.alias("value")))
    rows = df.withColumn("__r", record).select(*[col(k) for k in keep], F.inline(F.array(*cells)))
    return rows.filter(F.col("value").isNotNull())
