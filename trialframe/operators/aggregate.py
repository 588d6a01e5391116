"""Aggregation over repetitions, factors and free group keys."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import all_of, as_list, col, dtype_of, is_nested, is_numeric, join_keys, require_columns
from trialframe.operators.ordered import (
    OrderKey,
    column_quantiles,
    edge_rows,
    order_keys,
)

DEFAULT_FUNCTIONS = ["mean", "min", "max", "std", "count"]
FACTORS = "$FACTORS$"


# ---------------------------------------------------------------- casts before grouping

def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Make columns numeric; text that is no number is an error."""
    changed = {}
    for name in names:
        dtype = dtype_of(df, name)
        if is_numeric(dtype):
            continue
        if isinstance(dtype, T.BooleanType):
            changed[name] = col(name).cast("bigint")
            continue
        text = col(name).cast("string")
        number = text.try_cast("double")
        bad = F.concat(F.lit(f"column {name} is not numeric: "), text)
        changed[name] = F.when(number.isNull() & text.isNotNull(), F.raise_error(bad).cast("double")).otherwise(number)
    return df.withColumns(changed) if changed else df


def hashable(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Turn arrays, structs, maps and variants into their JSON text so that they can be grouped."""
    names = df.columns if names is None else names
    changed = {n: F.to_json(col(n)) for n in names if is_nested(dtype_of(df, n))}
    return df.withColumns(changed) if changed else df


# ---------------------------------------------------------------- vocabulary

def _skew(c: Column) -> Column:
    n = F.count(c)
    raw = F.coalesce(F.when(F.isnan(F.skewness(c)), 0.0).otherwise(F.skewness(c)), F.lit(0.0))
    return F.when(n >= 3, F.try_divide(F.sqrt((n * (n - 1)).cast("double")), (n - 2).cast("double")) * raw)


def _kurt(c: Column) -> Column:
    n = F.count(c).cast("double")
    raw = F.kurtosis(c)
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * raw + 6)
    return F.when(n >= 4, F.when(raw.isNull() | F.isnan(raw), F.lit(0.0)).otherwise(corrected))


def _zero(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


SIMPLE: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "sum": lambda c: _zero(F.sum(c), 0),
    "sem": lambda c: F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c).cast("double"))),
    "nunique": F.count_distinct,
    "size": lambda c: F.count(F.lit(1)),
    "prod": lambda c: _zero(F.product(c), 1.0),
    "any": lambda c: _zero(F.bool_or(c.cast("boolean")), False),
    "all": lambda c: _zero(F.bool_and(c.cast("boolean")), True),
    "skew": _skew,
    "kurt": _kurt,
}
ORDERED = ("first", "last")
QUANTILE = {"median": 0.5}
TAIL = "custom_tail"

_registered: dict[str, Callable[[Column], Column]] = {}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Add a named aggregate: a function from a column to an aggregate column."""
    if name in SIMPLE or name in ORDERED or name in QUANTILE or name == TAIL or name in _registered:
        raise ValueError(f"aggregate {name!r} already exists")
    _registered[name] = build


def _order_value(df: DataFrame, keys: list[OrderKey], value: str, last: bool) -> Column:
    """First or last non-missing value of a group as a mergeable aggregate."""
    if len({k.ascending for k in keys}) > 1:
        raise ValueError("first/last need one sort direction for all order columns")
    place = F.when(col(value).isNotNull(), F.struct(*[col(k.name) for k in keys]))
    pick = F.max_by if last == keys[0].ascending else F.min_by
    return pick(col(value), place)


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    data_columns: Sequence[str],
    functions: Sequence[str],
    order_by=None,
    tail_length: int = 5,
    names: Callable[[str, str], str] = lambda c, f: f"{c}_{f}",
) -> DataFrame:
    """Group and aggregate; output columns are the keys followed by ``<column>_<function>``."""
    keys, functions = list(keys), list(functions)
    for f in functions:
        known = f in SIMPLE or f in ORDERED or f in QUANTILE or f == TAIL or f in _registered
        if not known:
            raise ValueError(f"unknown aggregate function {f!r}")
    if (TAIL in functions or set(functions) & set(ORDERED)) and order_by is None:
        raise ValueError("first, last and custom_tail depend on row order: give order_by")

    one_pass = []
    for c in data_columns:
        for f in functions:
            if f in ORDERED:
                one_pass.append(_order_value(df, order_keys(order_by), c, f == "last").alias(names(c, f)))
            elif f in SIMPLE or f in _registered:
                one_pass.append((SIMPLE.get(f) or _registered[f])(col(c)).alias(names(c, f)))
    parts = []
    if one_pass or not functions:
        grouped = df.groupBy(*[col(k) for k in keys])
        parts.append(grouped.agg(*one_pass) if one_pass else df.select(*[col(k) for k in keys]).distinct())
    wanted = [f for f in functions if f in QUANTILE]
    if wanted:
        function_of = {QUANTILE[f]: f for f in wanted}
        parts.append(column_quantiles(df, keys, list(data_columns), list(function_of),
                                      lambda c, p: names(c, function_of[p])))
    if TAIL in functions:
        slim = df.select(*[col(n) for n in dict.fromkeys(
            [*keys, *data_columns, *[k.name for k in order_keys(order_by)]])])
        last_rows = edge_rows(slim, keys, order_by, tail_length, last=True)
        parts.append(last_rows.groupBy(*[col(k) for k in keys]).agg(
            *[F.avg(col(c)).alias(names(c, TAIL)) for c in data_columns]))
    result = reduce(lambda a, b: join_keys(a, b, keys), parts) if keys else side_by_side(parts)
    ordered = [*keys, *[names(c, f) for c in data_columns for f in functions]]
    return result.select(*[col(n) for n in ordered])


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Put one-row frames next to each other: stacked with empty columns, then the present value per column."""
    if len(parts) == 1:
        return parts[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for p in parts for c in p.columns]
    return stacked.agg(*[F.first(col(c), ignorenulls=True).alias(c) for c in names])


# ---------------------------------------------------------------- factor columns

def expand_factors(df: DataFrame, columns: Sequence[str], factor_column: str = "factor_columns") -> list[str]:
    """Replace the magic entry by the factor names found in the data, sorted; duplicates are an error."""
    columns = list(columns)
    if FACTORS not in columns:
        return columns
    require_columns(df, [factor_column], "factor expansion")
    names = df.select(F.explode(col(factor_column)).alias("f")).distinct()
    factors = sorted(r["f"] for r in names.collect())  # bounded by the number of columns of the frame
    at = columns.index(FACTORS)
    expanded = columns[:at] + factors + columns[at + 1:]
    repeated = sorted({c for c in expanded if expanded.count(c) > 1})
    if repeated:
        raise ValueError(f"columns listed twice after factor expansion: {repeated}")
    return expanded


# ---------------------------------------------------------------- the two aggregation steps

def rep_aggregate(
    df: DataFrame,
    data_columns: Sequence[str],
    ignore_columns: Sequence[str] = (),
    agg_functions: Sequence[str] = tuple(DEFAULT_FUNCTIONS),
    rep_column: str = "rep",
    order_by=None,
) -> DataFrame:
    """Aggregate over repetitions: group by every column that is neither data, nor ``rep``, nor ignored.

    Rows whose non-text key is missing are dropped; a missing text key is a group of its own.
    """
    data_columns = as_list(data_columns)
    require_columns(df, data_columns, "repetition aggregate")
    keys = [c for c in df.columns if c not in data_columns and c != rep_column and c not in ignore_columns]
    plain = [k for k in keys if not is_nested(dtype_of(df, k)) and not isinstance(dtype_of(df, k), T.StringType)]
    df = hashable(coerce_numeric(df, data_columns), keys)
    if plain:
        df = df.filter(all_of([col(k).isNotNull() for k in plain]))
    return aggregate(df, keys, data_columns, agg_functions, order_by=order_by)


def group_aggregate(
    df: DataFrame,
    data_columns: Sequence[str],
    groupby_columns: Sequence[str],
    agg_functions: Sequence[str] = tuple(DEFAULT_FUNCTIONS),
    custom_tail_length: int = 5,
    order_by=None,
) -> DataFrame:
    """Group by the listed columns (``$FACTORS$`` expands to all factors); missing keys form groups."""
    data_columns = as_list(data_columns)
    keys = expand_factors(df, as_list(groupby_columns))
    missing = [c for c in data_columns if c not in df.columns]
    if missing:
        warnings.warn(f"group aggregate: data columns {missing} not present, input returned unchanged", stacklevel=2)
        return df
    require_columns(df, keys, "group aggregate")
    df = hashable(coerce_numeric(df, data_columns), keys)
    return aggregate(df, keys, data_columns, agg_functions, order_by=order_by, tail_length=custom_tail_length)


# ---------------------------------------------------------------- whole-frame summaries

def describe(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (exact) and max per numeric column; one row per statistic."""
    names = list(names) if names else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    stats = {
        "count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"),
    }
    parts = [df.agg(*[f(col(c)).alias(f"{c}|{s}") for c in names for s, f in stats.items()])]
    parts.append(column_quantiles(df, [], names, [0.25, 0.5, 0.75], lambda c, p: f"{c}|{p:.0%}"))
    wide = side_by_side(parts)
    labels = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    table = F.array(*[
        F.struct(F.lit(s).alias("statistic"), *[col(f"{c}|{s}").alias(c) for c in names]) for s in labels
    ])
    return wide.select(F.inline(table))


def value_counts(df: DataFrame, subset: Sequence[str] | None = None, dropna: bool = True,
                 normalize: bool = False) -> DataFrame:
    """Number (or share) of rows per distinct value combination."""
    names = as_list(subset) or df.columns
    if dropna:
        df = df.filter(all_of([col(n).isNotNull() for n in names]))
    counted = df.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counted
    total = counted.agg(F.sum("count")).first()[0]
    return counted.select(*[col(n) for n in names], (F.col("count") / F.lit(total)).alias("proportion"))


def _matrix(df: DataFrame, names: Sequence[str] | None, pair: Callable[[Column, Column], Column]) -> DataFrame:
    names = list(names) if names else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    number = {n: col(n).cast("double") for n in names}

    def cell(a: str, b: str) -> Column:
        both = number[a].isNotNull() & number[b].isNotNull()
        return pair(F.when(both, number[a]), F.when(both, number[b]))

    cells = {(a, b): cell(a, b) for i, a in enumerate(names) for b in names[i:]}
    wide = df.agg(*[c.alias(f"{a}|{b}") for (a, b), c in cells.items()])
    table = F.array(*[
        F.struct(F.lit(a).alias("column"),
                 *[col(f"{a}|{b}" if (a, b) in cells else f"{b}|{a}").alias(b) for b in names])
        for a in names
    ])
    return wide.select(F.inline(table))


def corr(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation matrix, one row per column."""
    return _matrix(df, names, F.corr)


def cov(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Sample covariance matrix, one row per column."""
    return _matrix(df, names, F.covar_samp)


def mode(df: DataFrame, name: str) -> DataFrame:
    """All most frequent values of a column."""
    counted = df.filter(col(name).isNotNull()).groupBy(col(name)).agg(F.count(F.lit(1)).alias("__n"))
    top = counted.agg(F.max("__n")).first()[0]
    return counted.filter(F.col("__n") == F.lit(top)).select(col(name))


def extreme_rows(df: DataFrame, keys: Sequence[str], by: str, largest: bool, order=()) -> DataFrame:
    """The whole row with the largest (smallest) value per group; ties go to the first row in ``order``."""
    names = [c for c in df.columns if c not in keys]
    payload = F.struct(*[col(n) for n in names])
    place = [col(by)]
    for k in order_keys(order) if order else []:
        dtype = dtype_of(df, k.name)
        if is_numeric(dtype):
            flip = k.ascending == largest
            place.append(-col(k.name) if flip else col(k.name))
        else:
            raise ValueError("ties are broken by numeric columns only")
    pick = F.max_by if largest else F.min_by
    best = df.groupBy(*[col(k) for k in keys]).agg(
        pick(payload, F.when(col(by).isNotNull(), F.struct(*place))).alias("__row"))
    return best.select(*[col(k) for k in keys], *[F.col("__row").getField(n).alias(n) for n in names])
