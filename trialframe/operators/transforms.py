"""Row-level steps: conditional replacement, filters, column choice, expressions, union."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import all_of, as_list, col, dtype_of, is_nested, require_columns
from trialframe.operators.ordered import edge_rows, sort_columns


def conditional_replace(df: DataFrame, col_name: str, dest: str, value: Mapping) -> DataFrame:
    """Where ``col_name`` equals a rule's key, ``dest`` gets the rule's value.

    Rules run one after the other: if both columns are the same, a later rule sees earlier replacements.
    """
    require_columns(df, [col_name], "conditional replace")
    source = col(col_name)
    target: Column = col(dest) if dest in df.columns else F.lit(None)
    for key, replacement in value.items():
        test = source.cast("string") == F.lit(key) if isinstance(key, str) else source == F.lit(key)
        target = F.when(test, F.lit(replacement)).otherwise(target)
        if dest == col_name:
            source = target
    return df.withColumn(dest, target)


def filter_equal(df: DataFrame, filters: Mapping, allow_empty_result: bool = False) -> DataFrame:
    """Keep rows whose columns equal the given values; an empty result is an error unless allowed."""
    if not filters:
        return df
    require_columns(df, list(filters), "filter")
    kept = df.filter(all_of([col(k) == F.lit(v) for k, v in filters.items()]))
    if not allow_empty_result and kept.isEmpty():
        raise ValueError(f"no rows left after filters {dict(filters)}")
    return kept


def choose_columns(df: DataFrame, items: Sequence[str] | None = None, like: str | None = None,
                   regex: str | None = None) -> DataFrame:
    """Select columns by names (absent ones ignored), by a contained text, or by a regular expression."""
    given = [x is not None for x in (items, like, regex)]
    if sum(given) != 1:
        raise ValueError("give exactly one of items, like, regex")
    if items is not None:
        names = [n for n in items if n in df.columns]
    elif like is not None:
        names = [n for n in df.columns if like in n]
    else:
        names = [n for n in df.columns if re.search(regex, n)]
    return df.select(*[col(n) for n in names])


#: quoted texts and names in an expression
QUOTED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""", re.DOTALL)


def outside_quotes(expression: str, change) -> str:
    """Apply ``change`` to the parts of an expression that are not quoted."""
    return "".join(part if i % 2 else change(part) for i, part in enumerate(QUOTED.split(expression)))


def sql_text(expression: str) -> str:
    """``==`` is accepted for equality; everything else is a Spark SQL expression."""
    return outside_quotes(expression, lambda part: part.replace("==", "="))


def add_expression(df: DataFrame, expr: str) -> DataFrame:
    """``name = expression`` adds or replaces a column."""
    name, found, body = expr.partition("=")
    if not found or not name.strip() or body.startswith("="):
        raise ValueError(f"expected 'column = expression' but got {expr!r}")
    return df.withColumn(name.strip().strip("`"), F.expr(sql_text(body)))


def keep_where(df: DataFrame, expr: str) -> DataFrame:
    return df.filter(F.expr(sql_text(expr)))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with different columns; a column with different types becomes text or the wider number."""
    if not frames:
        raise ValueError("nothing to union")
    types: dict[str, set] = {}
    for df in frames:
        for f in df.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType)
    casts = {n: _common_type(t) for n, t in types.items() if len(t) > 1}

    def aligned(df: DataFrame) -> DataFrame:
        changed = {}
        for n, target in casts.items():
            if n in df.columns and dtype_of(df, n) != target:
                nested = is_nested(dtype_of(df, n))
                changed[n] = F.to_json(col(n)) if nested else col(n).cast(target)
        return df.withColumns(changed) if changed else df

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [aligned(d) for d in frames])


def _common_type(types: set) -> T.DataType:
    known = {t for t in types if not isinstance(t, T.NullType)}
    if len(known) == 1:
        return next(iter(known))
    if all(isinstance(t, T.IntegralType) for t in known):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in known):
        return T.DoubleType()
    if all(isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)) for t in known):
        return T.TimestampType()
    return T.StringType()


def sort_values(df: DataFrame, by, ascending=True, na_position: str = "last") -> DataFrame:
    """Total sort; missing values last unless asked otherwise."""
    names = as_list(by)
    directions = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(names)
    if len(directions) != len(names):
        raise ValueError("ascending needs one entry per sort column")
    if na_position not in ("first", "last"):
        raise ValueError("na_position is 'first' or 'last'")
    columns = []
    for name, up in zip(names, directions, strict=True):
        c = col(name)
        if na_position == "last":
            columns.append(c.asc_nulls_last() if up else c.desc_nulls_last())
        else:
            columns.append(c.asc_nulls_first() if up else c.desc_nulls_first())
    return df.orderBy(*columns)


def first_rows(df: DataFrame, n: int, order) -> DataFrame:
    """The first ``n`` rows in the given order."""
    if n <= 10_000:
        return df.orderBy(*sort_columns(order)).limit(n)
    return edge_rows(df, [], order, n)


def last_rows(df: DataFrame, n: int, order) -> DataFrame:
    if n <= 10_000:
        return df.orderBy(*sort_columns(order, reverse=True)).limit(n)
    return edge_rows(df, [], order, n, last=True)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first",
                    order=None) -> DataFrame:
    """One row per combination of ``subset``: the first or last in ``order``, or none of the repeated ones."""
    names = as_list(subset) or df.columns
    if subset is None and keep:
        return df.distinct()
    if keep is False:
        once = df.groupBy(*[col(n) for n in names]).agg(
            F.count(F.lit(1)).alias("__n"), *[F.first(col(c)).alias(c) for c in df.columns if c not in names])
        return once.filter(F.col("__n") == 1).select(*[col(c) for c in df.columns])
    if order is None:
        raise ValueError("keep='first' or 'last' with a subset needs an order")
    return edge_rows(df, names, order, 1, last=keep == "last")

