"""Chainable table verbs, named after the data-frame methods that a pipeline step ``df.<verb>`` may call.

Every verb takes a frame (or a grouping / frame object of an earlier step) and keyword arguments and returns the
next one. Verbs that depend on row order take ``order_by``, because rows of a distributed frame have no order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import all_of, as_list, col, dtype_of, is_numeric, join_keys, numeric_columns, require_columns
from trialframe.operators import aggregate as agg
from trialframe.operators import transforms as tf
from trialframe.operators.ordered import (
    PLACE,
    Scan,
    chunk_rows,
    column_quantiles,
    count_rows,
    edge_rows,
    framed,
    in_bounds,
    order_keys,
    positions,
    ranks,
    running,
)
from trialframe.session import cut, settled


def _numeric(df: DataFrame, columns=None) -> list[str]:
    names = as_list(columns) or numeric_columns(df)
    require_columns(df, names, "verb")
    return names


def _map(df: DataFrame, names: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({n: f(col(n)) for n in names})


# ---------------------------------------------------------------- columns and types

def drop(df: DataFrame, columns=None, labels=None) -> DataFrame:
    names = as_list(columns) or as_list(labels)
    require_columns(df, names, "drop")
    return df.select(*[col(c) for c in df.columns if c not in names])


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select(*[col(c).alias(columns.get(c, c)) for c in df.columns])


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return rename(df, {c: prefix + c for c in df.columns})


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return rename(df, {c: c + suffix for c in df.columns})


def reindex(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[(col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in columns])


def set_axis(df: DataFrame, labels: Sequence[str], axis=1) -> DataFrame:
    if len(labels) != len(df.columns):
        raise ValueError("one label per column is needed")
    return df.toDF(*labels)


def pop(df: DataFrame, item: str) -> DataFrame:
    require_columns(df, [item], "pop")
    return df.select(col(item))


def _type_group(dtype: T.DataType) -> set[str]:
    groups = {dtype.simpleString()}
    if is_numeric(dtype):
        groups.add("number")
    if isinstance(dtype, T.IntegralType):
        groups.add("int")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        groups.add("float")
    if isinstance(dtype, T.BooleanType):
        groups.add("bool")
    if isinstance(dtype, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        groups.add("datetime")
    if isinstance(dtype, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
        groups.add("object")
    return groups


def select_dtypes(df: DataFrame, include=None, exclude=None) -> DataFrame:
    include, exclude = set(as_list(include)), set(as_list(exclude))
    kept = [
        f.name for f in df.schema.fields
        if (not include or _type_group(f.dataType) & include) and not _type_group(f.dataType) & exclude
    ]
    return df.select(*[col(c) for c in kept])


TYPE_NAMES = {
    "int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float",
    "str": "string", "object": "string", "bool": "boolean", "datetime64[ns]": "timestamp", "category": "string",
}


def astype(df: DataFrame, dtype) -> DataFrame:
    wanted = dtype if isinstance(dtype, Mapping) else {c: dtype for c in df.columns}
    require_columns(df, list(wanted), "astype")
    return df.withColumns({c: col(c).cast(TYPE_NAMES.get(t, t)) for c, t in wanted.items()})


def infer_objects(df: DataFrame, columns=None) -> DataFrame:
    """Text columns whose present values all read as whole numbers, numbers or booleans get that type."""
    names = as_list(columns) or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    kinds = ("bigint", "double", "boolean")
    checks = [
        F.coalesce(F.bool_and(col(c).try_cast(k).isNotNull() | col(c).isNull()), F.lit(False)).alias(f"{i}|{k}")
        for i, c in enumerate(names) for k in kinds
    ]
    fits = df.agg(*checks, *[F.count(col(c)).alias(f"{i}|n") for i, c in enumerate(names)]).first()
    changed = {}
    for i, c in enumerate(names):
        kind = next((k for k in kinds if fits[f"{i}|{k}"] and fits[f"{i}|n"]), None)
        if kind:
            changed[c] = col(c).cast(kind)
    return df.withColumns(changed) if changed else df


def set_index(df: DataFrame, keys) -> DataFrame:
    """There is no index; the key columns move to the front."""
    names = as_list(keys)
    require_columns(df, names, "set_index")
    return df.select(*[col(c) for c in [*names, *[c for c in df.columns if c not in names]]])


def reset_index(df: DataFrame, order_by=None, name: str = "index", drop: bool = False) -> DataFrame:
    """Identity, or an ordinal column when an order is given."""
    if drop or order_by is None:
        return df
    numbered = positions(df, [], order_by, name)
    return numbered.select(col(name), *[col(c) for c in df.columns])


# ---------------------------------------------------------------- missing values

def fillna(df: DataFrame, value) -> DataFrame:
    values = value if isinstance(value, Mapping) else {c: value for c in df.columns}
    changed = {}
    for c, v in values.items():
        if c not in df.columns:
            continue
        numeric = is_numeric(dtype_of(df, c))
        if isinstance(value, Mapping) or numeric == (isinstance(v, (int, float)) and not isinstance(v, bool)):
            changed[c] = F.coalesce(col(c), F.lit(v))
    return df.withColumns(changed) if changed else df


def dropna(df: DataFrame, how: str = "any", thresh: int | None = None, subset=None) -> DataFrame:
    names = as_list(subset) or df.columns
    present = reduce(lambda a, b: a + b, [col(n).isNotNull().cast("int") for n in names])
    need = thresh if thresh is not None else (len(names) if how == "any" else 1)
    return df.filter(present >= need)


def isna(df: DataFrame) -> DataFrame:
    return _map(df, df.columns, lambda c: c.isNull())


def notna(df: DataFrame) -> DataFrame:
    return _map(df, df.columns, lambda c: c.isNotNull())


def ffill(df: DataFrame, order_by, columns=None, keys=(), limit: int | None = None) -> DataFrame:
    return _fill(df, order_by, columns, keys, limit, back=False)


def bfill(df: DataFrame, order_by, columns=None, keys=(), limit: int | None = None) -> DataFrame:
    return _fill(df, order_by, columns, keys, limit, back=True)


def _fill(df, order_by, columns, keys, limit, back) -> DataFrame:
    ordering = [k.name for k in order_keys(order_by)]
    names = as_list(columns) or [c for c in df.columns if c not in keys and c not in ordering]
    if limit is not None:
        def near(window) -> dict[str, Column]:
            frame = window.rowsBetween(0, limit) if back else window.rowsBetween(-limit, 0)
            pick = F.first if back else F.last
            return {f"__f{i}": pick(col(c), ignorenulls=True).over(frame) for i, c in enumerate(names)}

        filled = framed(df, keys, order_by, 0 if back else limit, limit if back else 0, near)
    else:
        scans = {f"__f{i}": Scan("last", c) for i, c in enumerate(names)}
        filled = running(df, keys, order_by, scans, reverse=back)
    return filled.withColumns({c: F.col(f"__f{i}") for i, c in enumerate(names)}).select(
        *[col(c) for c in df.columns])


def interpolate(df: DataFrame, order_by, columns=None, keys=()) -> DataFrame:
    """Linear interpolation by row place between known neighbours; after the last known value it is repeated."""
    names = _numeric(df, columns)
    out = positions(df, keys, order_by)
    marks = {f"__m{i}": F.when(col(c).isNotNull(), F.struct(col(c).cast("double").alias("v"), F.col(PLACE).alias("p")))
             for i, c in enumerate(names)}
    out = out.withColumns(marks)
    out = running(out, keys, order_by, {f"__p{i}": Scan("last", f"__m{i}") for i in range(len(names))})
    out = running(out, keys, order_by, {f"__n{i}": Scan("last", f"__m{i}") for i in range(len(names))}, reverse=True)
    changed = {}
    for i, c in enumerate(names):
        before, after = F.col(f"__p{i}"), F.col(f"__n{i}")
        share = F.try_divide(F.col(PLACE) - before["p"], after["p"] - before["p"])
        line = before["v"] + (after["v"] - before["v"]) * share
        changed[c] = F.when(col(c).isNotNull(), col(c).cast("double")).when(after.isNull(), before["v"]).otherwise(line)
    return out.withColumns(changed).select(*[col(c) for c in df.columns])


# ---------------------------------------------------------------- values

def replace(df: DataFrame, to_replace, value=None) -> DataFrame:
    """``{old: new}`` for all columns, ``{column: {old: new}}``, or old and new value(s)."""
    if isinstance(to_replace, Mapping) and all(isinstance(v, Mapping) for v in to_replace.values()):
        per_column = to_replace
    else:
        rules = to_replace if isinstance(to_replace, Mapping) else {
            k: value for k in as_list(to_replace)}
        per_column = {c: rules for c in df.columns}
    changed = {}
    for c, rules in per_column.items():
        numeric = is_numeric(dtype_of(df, c))
        out, hit = col(c), False
        chain = None
        for old, new in rules.items():
            if numeric == (isinstance(old, (int, float)) and not isinstance(old, bool)):
                test = col(c) == F.lit(old)
                chain = F.when(test, F.lit(new)) if chain is None else chain.when(test, F.lit(new))
                hit = True
        if hit:
            changed[c] = chain.otherwise(out)
    return df.withColumns(changed) if changed else df


def clip(df: DataFrame, lower=None, upper=None, columns=None) -> DataFrame:
    def bound(c: Column) -> Column:
        out = c
        if lower is not None:
            out = F.greatest(out, F.lit(lower))
        if upper is not None:
            out = F.least(out, F.lit(upper))
        return F.when(c.isNotNull(), out)

    return _map(df, _numeric(df, columns), bound)


def round_(df: DataFrame, decimals=0) -> DataFrame:
    """Half-even rounding."""
    places = decimals if isinstance(decimals, Mapping) else {c: decimals for c in numeric_columns(df)}
    return df.withColumns({c: F.bround(col(c), d) for c, d in places.items()})


def abs_(df: DataFrame, columns=None) -> DataFrame:
    return _map(df, _numeric(df, columns), F.abs)


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("double")


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "floordiv": _floor_div,
    "mod": lambda a, b: a - b * _floor_div(a, b),
    "pow": lambda a, b: F.pow(a.cast("double"), b.cast("double")),
}
ALIASES = {"subtract": "sub", "multiply": "mul", "divide": "div", "truediv": "div"}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: F.coalesce(a == b, F.lit(False)),
    "ne": lambda a, b: F.coalesce(a != b, F.lit(True)),
    "lt": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "le": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "gt": lambda a, b: F.coalesce(a > b, F.lit(False)),
    "ge": lambda a, b: F.coalesce(a >= b, F.lit(False)),
}


def _scalar(op: Callable[[Column, Column], Column], reverse: bool = False):
    def verb(df: DataFrame, other, columns=None) -> DataFrame:
        rhs = F.lit(other)
        return _map(df, _numeric(df, columns), lambda c: op(rhs, c) if reverse else op(c, rhs))

    return verb


def _comparison(op: Callable[[Column, Column], Column]):
    def verb(df: DataFrame, other, columns=None) -> DataFrame:
        return _map(df, as_list(columns) or df.columns, lambda c: op(c, F.lit(other)))

    return verb


def isin(df: DataFrame, values) -> DataFrame:
    """Boolean columns: is the value in the list (per column with a mapping; unlisted columns are false)."""
    def test(c: str) -> Column:
        wanted = values.get(c, []) if isinstance(values, Mapping) else values
        fits = [v for v in wanted if is_numeric(dtype_of(df, c)) == (isinstance(v, (int, float)))]
        return F.coalesce(col(c).isin(fits), F.lit(False)) if fits else F.lit(False)

    return df.withColumns({c: test(c) for c in df.columns})


# ---------------------------------------------------------------- duplicates, limits, samples

def duplicated(df: DataFrame, subset=None, keep="first", order_by=None, name: str = "duplicated") -> DataFrame:
    """Boolean column: is the row a repetition of an earlier (later) one with the same ``subset``."""
    names = as_list(subset) or df.columns
    if keep is False:
        counts = df.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("__n"))
        return join_keys(df, counts, names, "left").withColumn(name, F.col("__n") > 1).drop("__n")
    if order_by is None:
        raise ValueError("duplicated needs order_by")
    seen = running(df, names, order_by, {PLACE: Scan("count")}, reverse=keep == "last")
    return seen.withColumn(name, F.col(PLACE) > 1).drop(PLACE)


def head(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    return tf.first_rows(df, n, order_by)


def tail(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    return tf.last_rows(df, n, order_by)


def nlargest(df: DataFrame, n: int, columns, order_by=()) -> DataFrame:
    names = as_list(columns)
    return tf.first_rows(df.filter(col(names[0]).isNotNull()), n, [*[(c, False) for c in names], *as_list(order_by)])


def nsmallest(df: DataFrame, n: int, columns, order_by=()) -> DataFrame:
    names = as_list(columns)
    return tf.first_rows(df.filter(col(names[0]).isNotNull()), n, [*[(c, True) for c in names], *as_list(order_by)])


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, random_state: int = 0, replace: bool = False,
           weights: str | None = None) -> DataFrame:
    """An exact number of rows; reruns with the same seed choose the same rows, and equal rows are drawn one by one.

    ``weights`` names a column: a row is drawn in proportion to it, never where it is missing or zero. Without replacement
    the rows with the smallest exponential keys are taken; with it ``n`` independent draws fall on the running total of the
    weights, which is split over tasks like any running value.
    """
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    if frac is not None:
        n = round(frac * df.count())
    if weights is not None:
        worst = df.agg(F.min(col(weights))).first()[0]
        if worst is not None and worst < 0:
            raise ValueError("weights must not be negative")
    weight = F.lit(1.0) if weights is None else col(weights).cast("double")
    drawable = df.withColumns({"__weight": weight, "__same": F.xxhash64(F.to_json(F.struct(*[col(c) for c in df.columns])))})
    numbered = positions(drawable.filter(F.col("__weight") > 0), ["__same"], "__same", "__copy")
    if replace:
        return _draws(numbered, df.columns, n, random_state)
    chance = _uniform(F.lit(random_state), F.col("__same"), F.col("__copy"))
    keyed = numbered.withColumn("__draw", -F.log(chance) / F.col("__weight"))
    return tf.first_rows(keyed, n, ["__draw", "__same", "__copy"]).select(*[col(c) for c in df.columns])


def _uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 52))


def _draws(numbered: DataFrame, names: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` independent draws with replacement: each takes the first row whose running weight lies beyond it."""
    placed = cut(running(numbered, [], ["__same", "__copy"], {"__upto": Scan("sum", "__weight")}))
    total = placed.agg(F.max("__upto")).first()[0]
    if total is None:
        return placed.select(*[col(c) for c in names])
    hits = numbered.sparkSession.range(n).select(
        (_uniform(F.lit(seed), F.col("id")) * F.lit(total)).alias("__upto"), F.lit(1).alias("__kind"))
    owners = placed.select("__upto", F.lit(0).alias("__kind"), F.struct(*[col(c) for c in names]).alias("__row"))
    found = running(owners.unionByName(hits, allowMissingColumns=True), [], ["__upto", "__kind"], {"__hit": Scan("last", "__row")},
                    reverse=True)
    return found.filter(F.col("__kind") == 1).select("__hit.*")


def truncate(df: DataFrame, on: str, before=None, after=None) -> DataFrame:
    """Rows whose ``on`` value lies between the two bounds, both included."""
    tests = []
    if before is not None:
        tests.append(col(on) >= F.lit(before))
    if after is not None:
        tests.append(col(on) <= F.lit(after))
    return df.filter(all_of(tests))


def take(df: DataFrame, indices: Sequence[int], order_by) -> DataFrame:
    """Rows at the given places of the order; negative places count from the end."""
    placed = positions(df, [], order_by)
    wanted = list(indices)
    if any(i < 0 for i in wanted):
        n = df.count()
        wanted = [i + n if i < 0 else i for i in wanted]
    return placed.filter(F.col(PLACE).isin(wanted)).drop(PLACE)


# ---------------------------------------------------------------- reshaping

def melt(df: DataFrame, id_vars=None, value_vars=None, var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    ids = as_list(id_vars)
    values = as_list(value_vars) or [c for c in df.columns if c not in ids]
    if len({dtype_of(df, v).simpleString() for v in values}) > 1:
        target = "double" if all(is_numeric(dtype_of(df, v)) for v in values) else "string"
        df = df.withColumns({v: col(v).cast(target) for v in values})
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], var_name, value_name)


def stack(df: DataFrame, id_vars, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Melt without the missing values."""
    return melt(df, id_vars, None, var_name, value_name).filter(col(value_name).isNotNull())


def pivot(df: DataFrame, index, columns: str, values: str) -> DataFrame:
    """Long to wide; two values for one cell are an error."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot: several values for one cell")).cast(
        dtype_of(df, values))).otherwise(F.first(col(values)))
    return df.groupBy(*[col(i) for i in as_list(index)]).pivot(columns).agg(cell)


def pivot_table(df: DataFrame, index, columns: str, values: str, aggfunc: str = "mean",
                levels: Sequence | None = None, order_by=None) -> DataFrame:
    """Long to wide with an aggregate per cell; ``first`` and ``last`` go by ``order_by``."""
    if aggfunc in agg.SIMPLE:
        cell = agg.SIMPLE[aggfunc](col(values))
        return df.groupBy(*[col(i) for i in as_list(index)]).pivot(columns, list(levels) if levels else None).agg(cell)
    # other aggregates are computed per cell first, which leaves one row for each
    cells = agg.aggregate(df, [*as_list(index), columns], [values], [aggfunc], order_by=order_by, names=lambda c, f: c)
    return cells.groupBy(*[col(i) for i in as_list(index)]).pivot(columns, list(levels) if levels else None).agg(F.first(col(values)))


def unstack(df: DataFrame, index, columns: str, values: str) -> DataFrame:
    return pivot(df, index, columns, values)


def explode(df: DataFrame, column) -> DataFrame:
    """One row per array element; an empty or missing array gives one row with a missing value."""
    out = df
    names = as_list(column)
    if len(names) == 1:
        return out.withColumn(names[0], F.explode_outer(col(names[0])))
    zipped = df.withColumn("__z", F.explode_outer(F.arrays_zip(*[col(n).alias(n) for n in names])))
    return zipped.withColumns({n: F.col("__z").getField(n) for n in names}).drop("__z")


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Small frames only (Spark refuses more than ``spark.sql.transposeMaxValues`` rows)."""
    return df.transpose(col(index))


# ---------------------------------------------------------------- whole-frame aggregates

def summarize(df: DataFrame, func, columns=None, order_by=None) -> DataFrame:
    """One row with the aggregate of every column; several functions give ``<column>_<function>``."""
    names = _numeric(df, columns)
    functions = as_list(func)
    single = len(functions) == 1 and isinstance(func, str)
    return agg.aggregate(df, [], names, functions, order_by=order_by,
                         names=(lambda c, f: c) if single else (lambda c, f: f"{c}_{f}"))


def _mapped(df: DataFrame, keys: Sequence[str], func: Mapping, order_by) -> DataFrame:
    """``{column: functions}`` in one aggregate call; Spark drops the pairs that were not asked for."""
    functions = list(dict.fromkeys(f for fs in func.values() for f in as_list(fs)))
    out = agg.aggregate(df, keys, list(func), functions, order_by=order_by)
    return out.select(*[col(k) for k in keys], *[col(f"{c}_{f}") for c, fs in func.items() for f in as_list(fs)])


def aggregate_verb(df: DataFrame, func, order_by=None) -> DataFrame:
    if isinstance(func, Mapping):
        return _mapped(df, [], func, order_by)
    return summarize(df, func, order_by=order_by)


def quantile(df: DataFrame, q=0.5, columns=None) -> DataFrame:
    """Exact quantiles; one row per probability."""
    names = _numeric(df, columns)
    probabilities = as_list(q)
    wide = column_quantiles(df, [], names, probabilities, lambda c, p: f"{c}|{p}")
    table = F.array(*[
        F.struct(F.lit(float(p)).alias("quantile"), *[col(f"{c}|{p}").alias(c) for c in names])
        for p in probabilities
    ])
    return wide.select(F.inline(table))


def idx_extreme(df: DataFrame, by: str, keys=(), order_by=(), largest: bool = True) -> DataFrame:
    return agg.extreme_rows(df, as_list(keys), by, largest, as_list(order_by))


# ---------------------------------------------------------------- groups and frames

@dataclass(frozen=True)
class Grouped:
    """Result of ``df.groupby``; the next verb decides what is computed."""

    df: DataFrame
    keys: tuple[str, ...]
    dropna: bool = True
    sort: bool = False
    as_index: bool = True

    def frame(self) -> DataFrame:
        return self.df.filter(all_of([col(k).isNotNull() for k in self.keys])) if self.dropna else self.df

    def data(self, columns=None) -> list[str]:
        return as_list(columns) or [c for c in numeric_columns(self.df) if c not in self.keys]

    def agg(self, func, columns=None, order_by=None) -> DataFrame:
        frame = self.frame()
        if isinstance(func, Mapping):
            out = _mapped(frame, self.keys, func, order_by)
        else:
            single = isinstance(func, str)
            out = agg.aggregate(frame, self.keys, self.data(columns), as_list(func), order_by=order_by,
                                names=(lambda c, f: c) if single else (lambda c, f: f"{c}_{f}"))
        return out.orderBy(*[col(k).asc_nulls_last() for k in self.keys]) if self.sort else out

    def size(self) -> DataFrame:
        return self.frame().groupBy(*[col(k) for k in self.keys]).agg(F.count(F.lit(1)).alias("size"))


def groupby(df: DataFrame, by, dropna: bool = True, sort: bool = False, as_index: bool = True) -> Grouped:
    names = as_list(by)
    require_columns(df, names, "groupby")
    return Grouped(df, tuple(names), dropna, sort, as_index)


def _source(obj) -> tuple[DataFrame, list[str]]:
    return (obj.frame(), list(obj.keys)) if isinstance(obj, Grouped) else (obj, [])


def _series(obj, order_by, columns) -> tuple[DataFrame, list[str], list[str]]:
    df, keys = _source(obj)
    ordering = [k.name for k in order_keys(order_by)]
    names = as_list(columns) or [c for c in numeric_columns(df) if c not in keys and c not in ordering]
    return df, keys, names


def _cumulative(kind: str):
    def verb(obj, order_by, columns=None, suffix: str = "") -> DataFrame:
        df, keys, names = _series(obj, order_by, columns)
        done = running(df, keys, order_by, {f"__r{i}": Scan(kind, c) for i, c in enumerate(names)})
        values = {c + suffix: F.when(col(c).isNotNull(), F.col(f"__r{i}")) for i, c in enumerate(names)}
        return done.withColumns(values).drop(*[f"__r{i}" for i in range(len(names))])

    return verb


def cumcount(obj, order_by, name: str = "cumcount") -> DataFrame:
    df, keys = _source(obj)
    return positions(df, keys, order_by, name)


def _offsets(obj, order_by, columns, periods: int, suffix: str, f: Callable[[Column, Column], Column]) -> DataFrame:
    df, keys, names = _series(obj, order_by, columns)

    def build(window) -> dict[str, Column]:
        return {c + suffix: f(col(c), F.lag(col(c), periods).over(window)) for c in names}

    return framed(df, keys, order_by, max(periods, 0), max(-periods, 0), build)


def shift(obj, order_by, periods: int = 1, columns=None, suffix: str = "") -> DataFrame:
    return _offsets(obj, order_by, columns, periods, suffix, lambda now, then: then)


def diff(obj, order_by, periods: int = 1, columns=None, suffix: str = "") -> DataFrame:
    return _offsets(obj, order_by, columns, periods, suffix, lambda now, then: now - then)


def pct_change(obj, order_by, periods: int = 1, columns=None, suffix: str = "") -> DataFrame:
    return _offsets(obj, order_by, columns, periods, suffix,
                    lambda now, then: F.try_divide(now.cast("double"), then.cast("double")) - 1)


def rank(obj, columns=None, method: str = "average", ascending: bool = True, pct: bool = False, order_by=None,
         suffix: str = "") -> DataFrame:
    df, keys = _source(obj)
    names = as_list(columns) or [c for c in numeric_columns(df) if c not in keys]
    outs = []
    rows = count_rows(df, names[:1])
    for i, c in enumerate(names):
        outs.append(f"__rank{i}")
        df = ranks(df, keys, c, outs[-1], method, ascending, pct, order_by, rows=rows)
    return df.withColumns({c + suffix: F.col(o) for c, o in zip(names, outs, strict=True)}).drop(*outs)


FRAME_FUNCTIONS = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "count": F.count, "median": lambda c: F.percentile(c.cast("double"), F.lit(0.5)),
}


@dataclass(frozen=True)
class Rolling:
    """A moving window of ``window`` rows; fewer than ``min_periods`` known values give no result."""

    source: DataFrame | Grouped
    window: int
    order_by: object
    min_periods: int | None = None
    center: bool = False

    def apply(self, func: str, columns=None, suffix: str = "") -> DataFrame:
        df, keys, names = _series(self.source, self.order_by, columns)
        ahead = (self.window - 1) // 2 if self.center else 0
        behind = self.window - 1 - ahead
        need = (0 if func == "count" else self.window) if self.min_periods is None else self.min_periods

        def build(window) -> dict[str, Column]:
            frame = window.rowsBetween(-behind, ahead)
            # a count is a result for missing values too, so it only asks for enough rows
            seen = {c: F.lit(1) if func == "count" else col(c) for c in names}
            return {
                c + suffix: F.when(F.count(seen[c]).over(frame) >= need, FRAME_FUNCTIONS[func](col(c)).over(frame))
                for c in names
            }

        return framed(df, keys, self.order_by, behind, ahead, build)


@dataclass(frozen=True)
class Expanding:
    """All rows so far."""

    source: DataFrame | Grouped
    order_by: object
    min_periods: int = 1

    def apply(self, func: str, columns=None, suffix: str = "") -> DataFrame:
        if func not in ("sum", "mean", "min", "max", "count", "std", "var"):
            raise ValueError(f"expanding has no {func!r}")
        df, keys, names = _series(self.source, self.order_by, columns)
        df = df.withColumns({f"__one{i}": F.when(col(c).isNotNull(), F.lit(1)) for i, c in enumerate(names)})
        scans = {f"__n{i}": Scan("sum", f"__one{i}") for i in range(len(names))} | {"__rows": Scan("count")}
        spread = func in ("std", "var")
        if spread:
            # sums of squares around a fixed centre per column keep their precision
            centre = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
            df = df.withColumns({f"__d{i}": col(c) - F.lit(centre[f"m{i}"]) for i, c in enumerate(names)})
            df = df.withColumns({f"__q{i}": F.col(f"__d{i}") * F.col(f"__d{i}") for i in range(len(names))})
            scans |= {f"__s{i}": Scan("sum", f"__d{i}") for i in range(len(names))}
            scans |= {f"__t{i}": Scan("sum", f"__q{i}") for i in range(len(names))}
        elif func in ("sum", "mean"):
            scans |= {f"__s{i}": Scan("sum", c) for i, c in enumerate(names)}
        elif func in ("min", "max"):
            scans |= {f"__s{i}": Scan(func, c) for i, c in enumerate(names)}
        done = running(df, keys, self.order_by, scans)
        values = {}
        for i, c in enumerate(names):
            n, s = F.coalesce(F.col(f"__n{i}"), F.lit(0)), F.col(f"__s{i}") if func != "count" else None
            if spread:
                squares = F.greatest(F.col(f"__t{i}") - F.try_divide(s * s, n), F.lit(0.0))
                value = F.try_divide(squares, n - 1)
                value = F.sqrt(value) if func == "std" else value
            else:
                value = {"sum": s, "mean": F.try_divide(s, n) if s is not None else None, "min": s, "max": s,
                         "count": n.cast("double")}[func]
            seen = F.col("__rows") if func == "count" else n
            values[c + suffix] = F.when(seen >= self.min_periods, value)
        helper = ["__rows", *[f"__{t}{i}" for t in ("one", "n", "s", "t", "d", "q") for i in range(len(names))]]
        return done.withColumns(values).drop(*helper)


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean; a missing value keeps the mean and ages the values before it.

    Weights of rows a block back underflow in double precision, so a block needs its own weighted sums and those
    of the block before it; no group is scanned as a whole.
    """

    source: DataFrame | Grouped
    alpha: float
    order_by: object
    adjust: bool = True

    def apply(self, func: str = "mean", columns=None, suffix: str = "") -> DataFrame:
        if func != "mean":
            raise ValueError("ewm supports mean")
        df, keys, names = _series(self.source, self.order_by, columns)
        placed = positions(df, keys, self.order_by)
        if self.alpha >= 1.0:
            filled = running(placed, keys, self.order_by, {f"__f{i}": Scan("last", c) for i, c in enumerate(names)})
            return filled.withColumns({c + suffix: F.col(f"__f{i}") for i, c in enumerate(names)}).drop(
                PLACE, *[f"__f{i}" for i in range(len(names))])
        decay = 1.0 - self.alpha
        size = max(1, int(200.0 / -math.log(decay)))
        block = F.floor(F.col(PLACE) / F.lit(size)).cast("bigint")
        inner = F.col(PLACE) - block * F.lit(size)
        blocks = placed.withColumns({"__block": block, "__in": inner})
        boost = F.pow(F.lit(decay), -F.col("__in").cast("double"))
        first = F.lit(1.0) if self.adjust else F.when(F.col(PLACE) == 0, F.lit(1.0 / self.alpha)).otherwise(F.lit(1.0))
        terms = {}
        for i, c in enumerate(names):
            terms[f"__x{i}"] = F.when(col(c).isNotNull(), col(c) * boost * first)
            terms[f"__w{i}"] = F.when(col(c).isNotNull(), boost * first)
        blocks = blocks.withColumns(terms)
        group = [*keys, "__block"]
        scans = {f"__s{t}{i}": Scan("sum", f"__{t}{i}") for i in range(len(names)) for t in "xw"}
        here = running(blocks, group, self.order_by, scans)
        # the last block before with values: next to values of the block itself, earlier ones weigh nothing
        totals = cut(blocks.groupBy(*[col(k) for k in keys], "__block").agg(
            *[F.sum(f"__{t}{i}").alias(f"__t{t}{i}") for i in range(len(names)) for t in "xw"]))
        totals = totals.withColumns({f"__tb{i}": F.when(F.col(f"__tw{i}").isNotNull(), F.col("__block")) for i in range(len(names))})
        marks = {f"__b{t}{i}": Scan("last", f"__t{t}{i}", exclusive=True) for i in range(len(names)) for t in "xwb"}

        def mean(own: str, i: int) -> Column:
            fade = F.pow(F.lit(decay), F.lit(float(size)) * (F.col("__block") - F.col(f"__bb{i}")))
            old_x, old_w = F.coalesce(F.col(f"__bx{i}") * fade, F.lit(0.0)), F.coalesce(F.col(f"__bw{i}") * fade, F.lit(0.0))
            # null without values of the block's own
            return F.try_divide(F.col(f"__{own}x{i}") + old_x, F.col(f"__{own}w{i}") + old_w)

        # without values of its own yet a block stays at the mean that held at the end of the last block with values
        ends = running(totals, keys, "__block", marks).withColumns({f"__h{i}": mean("t", i) for i in range(len(names))})
        held = {f"__bh{i}": Scan("last", f"__h{i}", exclusive=True) for i in range(len(names))}
        before = running(ends, keys, "__block", held).select(*[col(k) for k in keys], "__block", *marks, *held)
        both = join_keys(here, before, group, "left")
        values = {c + suffix: F.coalesce(mean("s", i), F.col(f"__bh{i}")) for i, c in enumerate(names)}
        helper = [f"__{t}{i}" for t in ("x", "w", "sx", "sw", "bx", "bw", "bb", "bh") for i in range(len(names))]
        return both.withColumns(values).drop(PLACE, "__block", "__in", *helper)


@dataclass(frozen=True)
class TimeRolling:
    """A moving window as long as ``window`` (such as ``1h``) that ends at each row's own time; rows of one time share it.

    ``closed`` names the ends that belong to the window. Rows without a time get no result. Where every group fits a task,
    this is a range frame. In larger groups time is cut into cells as long as the window, so that each window is the end of
    one cell and the beginning of the next: both are running values, which are split inside a cell of any size, and
    nothing is subtracted, so least and greatest values come out as well.
    """

    source: DataFrame | Grouped
    window: str
    on: str
    min_periods: int | None = None
    closed: str = "right"

    def apply(self, func: str, columns=None, suffix: str = "") -> DataFrame:
        if func not in ("sum", "mean", "min", "max", "count", "std", "var"):
            raise ValueError(f"rolling by time has no {func!r}")
        width = rule_micros(self.window)
        if width is None:
            raise ValueError(f"rolling takes windows of fixed length, not {self.window!r}")
        df, keys, names = _series(self.source, self.on, columns)
        need = (0 if func == "count" else 1) if self.min_periods is None else self.min_periods
        at = F.unix_micros(col(self.on).cast("timestamp"))
        rows = count_rows(df, [self.on])
        if rows > chunk_rows(df):
            df = settled(df)
        if not in_bounds(df, keys, rows):
            return self._by_cells(df.withColumn("__at", at), keys, names, func, need, width, suffix)
        oldest = width if self.closed in ("both", "left") else width - 1
        newest = 0 if self.closed in ("both", "right") else 1
        frame = Window.partitionBy(*[col(k) for k in keys]).orderBy(at).rangeBetween(-oldest, -newest)
        return df.withColumns({
            c + suffix: F.when(at.isNotNull() & (F.count(col(c)).over(frame) >= need), FRAME_FUNCTIONS[func](col(c)).over(frame))
            for c in names
        })

    def _by_cells(self, timed: DataFrame, keys, names, func: str, need: int, width: int, suffix: str) -> DataFrame:
        spread, centre = func in ("std", "var"), {}
        if spread:
            # sums of squares around a fixed centre per column keep their precision
            centre = timed.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first().asDict()
        parts, scans = {}, {}
        for i, c in enumerate(names):
            parts[f"__n{i}"] = F.count(col(c))
            if spread:
                away = col(c) - F.lit(centre[f"m{i}"])
                parts |= {f"__s{i}": F.sum(away), f"__t{i}": F.sum(away * away)}
            elif func != "count":
                parts[f"__s{i}"] = {"min": F.min, "max": F.max}.get(func, F.sum)(col(c))
        for part in parts:
            scans[part] = func if part.startswith("__s") and func in ("min", "max") else "sum"
        states = timed.filter(F.col("__at").isNotNull()).groupBy(*[col(k) for k in keys], "__at").agg(
            *[v.alias(part) for part, v in parts.items()])
        span = F.lit(width).cast("bigint")
        states = cut(states.withColumn("__cell", F.col("__at") - F.pmod(F.col("__at"), span)))
        cell = [*keys, "__cell"]
        own_time = self.closed in ("both", "right")
        heads = running(states, cell, "__at", {f"{p}h": Scan(kind, p, exclusive=not own_time) for p, kind in scans.items()})
        # each time asks the cell before for its end; the question comes before or after a row of the very border
        asked = states.select(*[col(k) for k in keys], (F.col("__at") - span).alias("__at"), (F.col("__cell") - span).alias("__cell"),
                              F.lit(-1 if self.closed in ("both", "left") else 1).alias("__kind"), F.col("__at").alias("__home"))
        points = asked.unionByName(states.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
        ends = running(points, cell, ["__at", "__kind"], {f"{p}e": Scan(kind, p) for p, kind in scans.items()}, reverse=True)
        ends = ends.filter(F.col("__home").isNotNull()).select(
            *[col(k) for k in keys], F.col("__home").alias("__at"), *[f"{p}e" for p in scans])
        both = join_keys(heads, ends, [*keys, "__at"])
        merged = {p: Scan(kind).merge(F.col(f"{p}e"), F.col(f"{p}h")) for p, kind in scans.items()}
        results = {}
        for i in range(len(names)):
            n = F.coalesce(merged[f"__n{i}"], F.lit(0))
            s = merged.get(f"__s{i}")
            if spread:
                value = F.try_divide(F.greatest(merged[f"__t{i}"] - F.try_divide(s * s, n), F.lit(0.0)), F.nullif(n - 1, F.lit(0)))
                value = F.sqrt(value) if func == "std" else value
            else:
                value = n if func == "count" else F.try_divide(s, n) if func == "mean" else s
            results[f"__r{i}"] = F.when(n >= need, value)
        both = both.select(*[col(k) for k in keys], "__at", *[v.alias(r) for r, v in results.items()])
        done = join_keys(timed, both, [*keys, "__at"], "left")
        return done.withColumns({c + suffix: F.col(f"__r{i}") for i, c in enumerate(names)}).drop("__at", *results)


def rolling(obj, window: int | str, order_by=None, min_periods: int | None = None, center: bool = False, on: str | None = None,
            closed: str = "right") -> Rolling | TimeRolling:
    """A window of rows, or with a length of time one over the times in column ``on``."""
    if isinstance(window, str):
        if on is None or center:
            raise ValueError("a window of time needs the column of times (on) and ends at each row")
        if closed not in ("right", "left", "both", "neither"):
            raise ValueError(f"unknown ends {closed!r}")
        return TimeRolling(obj, window, on, min_periods, closed)
    return Rolling(obj, window, order_by, min_periods, center)


def expanding(obj, order_by, min_periods: int = 1) -> Expanding:
    return Expanding(obj, order_by, min_periods)


def ewm(obj, order_by, alpha: float | None = None, span: float | None = None, com: float | None = None,
        halflife: float | None = None, adjust: bool = True) -> Ewm:
    given = [x for x in (alpha, span, com, halflife) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of alpha, span, com, halflife")
    if span is not None:
        alpha = 2.0 / (span + 1.0)
    elif com is not None:
        alpha = 1.0 / (1.0 + com)
    elif halflife is not None:
        alpha = 1.0 - math.exp(-math.log(2.0) / halflife)
    return Ewm(obj, alpha, order_by, adjust)


# ---------------------------------------------------------------- time

UNITS = {
    "us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "S": 1_000_000, "min": 60_000_000, "T": 60_000_000,
    "h": 3_600_000_000, "H": 3_600_000_000, "hour": 3_600_000_000, "D": 86_400_000_000, "d": 86_400_000_000,
    "day": 86_400_000_000,
}
# months of a calendar period, and whether it is named by its last day; weeks end on Sunday and are named by it
MONTHS = {"MS": (1, False), "QS": (3, False), "YS": (12, False), "ME": (1, True), "M": (1, True), "QE": (3, True), "Q": (3, True),
          "YE": (12, True), "Y": (12, True)}


def rule_micros(rule: str) -> int | None:
    """Length of a rule of fixed length; None for calendar periods."""
    found = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", rule)
    count, unit = (int(found.group(1) or 1), found.group(2)) if found else (0, "")
    if count > 0 and unit in UNITS:
        return count * UNITS[unit]
    if count == 1 and (unit in MONTHS or unit in ("W", "W-SUN")):
        return None
    if count > 1 and unit in ("W", "W-SUN", *MONTHS):
        raise ValueError(f"a calendar rule takes single periods: {rule!r}")
    raise ValueError(f"unknown time rule {rule!r}")


def _period(rule: str) -> tuple[int, bool] | None:
    return MONTHS.get(re.sub(r"[\s\d]", "", rule))


def bucket_start(time: Column, rule: str) -> Column:
    """Name of the time's bucket: the start of a fixed length counted from the epoch, or a calendar period's first or last day."""
    width = rule_micros(rule)
    if width is not None:
        micros = F.unix_micros(time.cast("timestamp"))
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(width).cast("bigint")))
    day, period = time.cast("date"), _period(rule)
    if period is None:
        return F.date_add(day, (8 - F.dayofweek(day)) % 7).cast("timestamp")
    months, last = period
    first = F.trunc(day, {1: "month", 3: "quarter", 12: "year"}[months])
    return (F.last_day(F.add_months(first, months - 1)) if last else first).cast("timestamp")


def bucket_names(low: Column, high: Column, rule: str) -> Column:
    """All bucket names from one to another, as an array."""
    width = rule_micros(rule)
    if width is not None:
        steps = F.sequence(F.unix_micros(low), F.unix_micros(high), F.lit(width).cast("bigint"))
        return F.transform(steps, F.timestamp_micros)
    period = _period(rule)
    if period is None:
        return F.transform(F.sequence(low.cast("date"), high.cast("date"), F.expr("interval 7 days")), lambda d: d.cast("timestamp"))
    months, last = period
    begin = lambda c: F.add_months(F.trunc(c.cast("date"), "month"), 1 - months if last else 0)
    firsts = F.sequence(begin(low), begin(high), F.expr(f"interval {months} months"))
    return F.transform(firsts, lambda d: (F.last_day(F.add_months(d, months - 1)) if last else d).cast("timestamp"))


@dataclass(frozen=True)
class Resampler:
    """Time buckets; buckets without rows between a group's first and last are kept (sum and count 0, other results missing)."""

    source: DataFrame | Grouped
    rule: str
    on: str
    fill_empty: bool = True

    def apply(self, func, columns=None) -> DataFrame:
        df, keys = _source(self.source)
        names = as_list(columns) or [c for c in numeric_columns(df) if c not in keys and c != self.on]
        buckets = df.withColumn(self.on, bucket_start(col(self.on), self.rule))
        single = isinstance(func, str)
        label = (lambda c, f: c) if single else (lambda c, f: f"{c}_{f}")
        out = agg.aggregate(buckets, [*keys, self.on], names, as_list(func), names=label)
        if not self.fill_empty:
            return out
        out = cut(out)
        low, high = F.min(col(self.on)), F.max(col(self.on))
        ends = out.groupBy(*[col(k) for k in keys]).agg(low.alias("__low"), high.alias("__high")).filter("__low is not null")
        grid = ends.select(*[col(k) for k in keys], F.explode(bucket_names(F.col("__low"), F.col("__high"), self.rule)).alias(self.on))
        full = join_keys(grid, out, [*keys, self.on], "left")
        zero = {label(c, f): F.coalesce(col(label(c, f)), F.lit(0))
                for c in names for f in as_list(func) if f in ("sum", "count", "size", "nunique")}
        return full.withColumns(zero) if zero else full


def resample(obj, rule: str, on: str, fill_empty: bool = True) -> Resampler:
    return Resampler(obj, rule, on, fill_empty)


def asfreq(df: DataFrame, freq: str, on: str) -> DataFrame:
    """One row per tick from the first time to the last; ticks without a row at that very time stay empty."""
    step = rule_micros(freq)
    if step is None:
        raise ValueError(f"asfreq takes rules of fixed length, not {freq!r}")
    at_tick = df.withColumn(on, col(on).cast("timestamp"))
    low, high = at_tick.agg(F.min(F.unix_micros(col(on))), F.max(F.unix_micros(col(on)))).first()
    ticks = df.sparkSession.range(low or 0, 0 if low is None else high + 1, step)
    return ticks.select(F.timestamp_micros("id").alias(on)).join(at_tick, on, "left").select(*[col(c) for c in df.columns])


def _clock(time: str) -> str:
    parts = (time + ":00:00").split(":")[:3]
    return ":".join(p.zfill(2) for p in parts)


def between_time(df: DataFrame, start_time: str, end_time: str, on: str, inclusive: str = "both") -> DataFrame:
    """Rows whose time of day lies between the two; an end before the start wraps over midnight."""
    now = F.date_format(col(on), "HH:mm:ss.SSSSSS")
    start, end = F.lit(_clock(start_time) + ".000000"), F.lit(_clock(end_time) + ".000000")
    after = now >= start if inclusive in ("both", "left") else now > start
    before = now <= end if inclusive in ("both", "right") else now < end
    return df.filter(after & before if _clock(start_time) <= _clock(end_time) else after | before)


def at_time(df: DataFrame, time: str, on: str) -> DataFrame:
    return df.filter(F.date_format(col(on), "HH:mm:ss.SSSSSS") == F.lit(_clock(time) + ".000000"))


# ---------------------------------------------------------------- dispatch

def _reduction(name: str):
    def verb(obj, columns=None, order_by=None) -> DataFrame:
        if isinstance(obj, Grouped):
            return obj.agg(name, columns, order_by)
        if isinstance(obj, (Rolling, TimeRolling, Expanding, Ewm)):
            return obj.apply(name, columns)
        if isinstance(obj, Resampler):
            return obj.apply(name, columns)
        return summarize(obj, name, columns, order_by)

    return verb


def _agg_verb(obj, func, columns=None, order_by=None):
    if isinstance(obj, Grouped):
        return obj.agg(func, columns, order_by)
    if isinstance(obj, Resampler):
        return obj.apply(func, columns)
    if isinstance(obj, (Rolling, TimeRolling, Expanding, Ewm)):
        return obj.apply(func, columns)
    return aggregate_verb(obj, func, order_by)


def _size(obj) -> DataFrame:
    return obj.size() if isinstance(obj, Grouped) else obj.agg(F.count(F.lit(1)).alias("size"))


def _pick(obj, n: int, order_by, last: bool) -> DataFrame:
    if isinstance(obj, Grouped):
        return edge_rows(obj.frame(), list(obj.keys), order_by, n, last=last)
    return tail(obj, order_by, n) if last else head(obj, order_by, n)


def _named_function(obj, func, **kwargs):
    if not isinstance(func, str):
        raise ValueError("only function names can be applied")
    return call(obj, func, kwargs)


VERBS: dict[str, Callable] = {
    "sort_values": tf.sort_values,
    "sort_index": lambda df, index, ascending=True: tf.sort_values(df, index, ascending),
    "filter": tf.choose_columns,
    "eval": tf.add_expression,
    "query": tf.keep_where,
    "drop": drop, "rename": rename, "add_prefix": add_prefix, "add_suffix": add_suffix, "reindex": reindex,
    "select_dtypes": select_dtypes, "set_axis": set_axis, "pop": pop,
    "astype": astype, "convert_dtypes": infer_objects, "infer_objects": infer_objects,
    "fillna": fillna, "dropna": dropna, "isna": isna, "isnull": isna, "notna": notna, "notnull": notna,
    "ffill": ffill, "pad": ffill, "bfill": bfill, "backfill": bfill, "interpolate": interpolate,
    "replace": replace, "clip": clip, "round": round_, "abs": abs_, "isin": isin,
    "drop_duplicates": lambda df, subset=None, keep="first", order_by=None: tf.drop_duplicates(
        df, subset, keep, order_by),
    "duplicated": duplicated,
    "head": lambda obj, order_by, n=5: _pick(obj, n, order_by, False),
    "tail": lambda obj, order_by, n=5: _pick(obj, n, order_by, True),
    "nlargest": nlargest, "nsmallest": nsmallest, "sample": sample, "truncate": truncate, "take": take,
    "melt": melt, "stack": stack, "pivot": pivot, "pivot_table": pivot_table, "unstack": unstack,
    "explode": explode, "transpose": transpose,
    "agg": _agg_verb, "aggregate": _agg_verb, "quantile": quantile, "describe": agg.describe,
    "mode": agg.mode, "value_counts": agg.value_counts, "corr": agg.corr, "cov": agg.cov,
    "groupby": groupby, "size": _size, "cumcount": cumcount,
    "cumsum": _cumulative("sum"), "cumprod": _cumulative("product"), "cummin": _cumulative("min"),
    "cummax": _cumulative("max"), "shift": shift, "diff": diff, "pct_change": pct_change, "rank": rank,
    "rolling": rolling, "expanding": expanding, "ewm": ewm, "resample": resample, "asfreq": asfreq,
    "reset_index": reset_index, "set_index": set_index, "between_time": between_time, "at_time": at_time,
    "idxmax": idx_extreme,
    "idxmin": lambda df, by, keys=(), order_by=(): idx_extreme(df, by, keys, order_by, largest=False),
    "map": _named_function, "applymap": _named_function, "apply": _named_function, "transform": _named_function,
    "pipe": _named_function,
}
VERBS |= {n: _reduction(n) for n in (
    "sum", "mean", "median", "max", "min", "std", "var", "sem", "skew", "kurt", "prod", "count", "nunique", "any",
    "all", "first", "last")}
VERBS |= {n: _scalar(op) for n, op in ARITHMETIC.items()}
VERBS |= {alias: VERBS[n] for alias, n in ALIASES.items()}
VERBS |= {"r" + n: _scalar(op, reverse=True) for n, op in ARITHMETIC.items()}
VERBS["rtruediv"] = VERBS["rdiv"]
VERBS |= {n: _comparison(op) for n, op in COMPARE.items()}
VERBS |= {"kurtosis": VERBS["kurt"], "product": VERBS["prod"]}


def call(obj, name: str, kwargs: Mapping | None = None):
    """Run one verb by name."""
    if name not in VERBS:
        raise ValueError(f"unknown verb {name!r}")
    return VERBS[name](obj, **dict(kwargs or {}))


def chain(obj, steps: Sequence[Mapping]):
    """Run ``[{"df.name": {arguments}}, ...]`` one after the other."""
    for step in steps:
        (name, kwargs), = step.items()
        obj = call(obj, name.removeprefix("df."), kwargs)
    return obj
