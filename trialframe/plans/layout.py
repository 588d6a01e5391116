"""Chart-ready tables: metric fan-out, grid and bar positions, stacks, box statistics, labels, limits.

All nesting levels (figure, subplot, group, bar, part) are columns of one flat table with an ordinal per level.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import all_of, as_list, broadcast_if_small, col, join_keys, require_columns
from trialframe.functions.text import file_name, label, ticks
from trialframe.operators.aggregate import coerce_numeric
from trialframe.operators.ordered import (
    OrderKey,
    Scan,
    chunk_rows,
    count_rows,
    dense_places,
    order_keys,
    positions,
    quantiles,
    running,
)
from trialframe.operators.transforms import QUOTED
from trialframe.session import cut, settled

METRIC, UNIT = "$metrics$", "$metric_unit$"


# ---------------------------------------------------------------- metrics

@dataclass(frozen=True)
class Metric:
    """Value (and error) columns that are shown together, with their scaling and unit."""

    value_cols: Sequence[str] | str
    error_cols: Sequence[str] | str | None = None
    value_multiplicator: float = 1.0
    error_multiplicator: float = 1.0
    value_divider: float = 1.0
    error_divider: float = 1.0
    unit_label: str | None = None

    @property
    def values(self) -> list[str]:
        return as_list(self.value_cols)

    @property
    def errors(self) -> list[str]:
        return as_list(self.error_cols)

    def value(self, name: str) -> Column:
        return col(name) * F.lit(self.value_multiplicator) / F.lit(self.value_divider)

    def error(self, name: str) -> Column:
        return col(name) * F.lit(self.error_multiplicator) / F.lit(self.error_divider)


def _metric_columns(metrics: Mapping[str, Metric]) -> list[str]:
    return list(dict.fromkeys(c for m in metrics.values() for c in [*m.values, *m.errors]))


def fan_out(df: DataFrame, metrics: Mapping[str, Metric]) -> DataFrame:
    """One copy of every row per metric with that metric's columns scaled; the input is read once."""
    names = _metric_columns(metrics)
    require_columns(df, names, "metrics")
    df = coerce_numeric(df, names)

    def scaled(m: Metric, name: str) -> Column:
        if name in m.values:
            return m.value(name)
        return m.error(name) if name in m.errors else col(name).cast("double")

    copies = F.array(*[
        F.struct(F.lit(key).alias(METRIC), *[scaled(m, n).cast("double").alias(n) for n in names])
        for key, m in metrics.items()
    ])
    rest = [c for c in df.columns if c not in names]
    return df.select(*[col(c) for c in rest], F.inline(copies))


def metric_values(df: DataFrame, metrics: Mapping[str, Metric]) -> DataFrame:
    """Long form of a fanned-out table: ``value_no, value_col, error_col, value, error`` and the unit."""
    chosen = None
    for key, m in metrics.items():
        errors = m.errors or [None] * len(m.values)
        if len(errors) != len(m.values):
            raise ValueError(f"metric {key}: one error column per value column is needed")
        cells = F.array(*[
            F.struct(
                F.lit(i).alias("value_no"), F.lit(v).alias("value_col"),
                F.lit(e).cast("string").alias("error_col"), col(v).cast("double").alias("value"),
                (col(e) if e else F.lit(None)).cast("double").alias("error"),
                F.lit(m.unit_label).cast("string").alias(UNIT))
            for i, (v, e) in enumerate(zip(m.values, errors, strict=True))
        ])
        test = col(METRIC) == key
        chosen = F.when(test, cells) if chosen is None else chosen.when(test, cells)
    rest = [c for c in df.columns if c not in _metric_columns(metrics)]
    return df.select(*[col(c) for c in rest], F.inline(chosen))


# ---------------------------------------------------------------- filter and order

def allowed_filter(df: DataFrame, columns: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Text form of the grouping columns, and only the rows with allowed values."""
    require_columns(df, columns, "data filter")
    unused = [c for c in allowed if c not in columns]
    if unused:
        warnings.warn(f"data filter: {unused} are not used for grouping and ignored", stacklevel=2)
    names = list(dict.fromkeys(columns))
    df = df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit("None")) for c in names}) if names else df
    tests = [col(c).isin(list(allowed[c])) for c in names if c in allowed]
    return df.filter(all_of(tests)) if tests else df


def value_rank(name: str, allowed: Sequence[str]) -> Column:
    """Place of the value in the allowed list, from 0."""
    return F.array_position(F.array(*[F.lit(v) for v in allowed]), col(name)) - 1


# fixed values: spellings accepted in predicates and their SQL form
PREDICATE_FORMS = {
    "&&": " and ", "||": " or ", "==": "=", "starts_with(": "startswith(", "ends_with(": "endswith(",
    "to_number(": "double(",
}


def predicate(text: str) -> Column:
    """A boolean SQL expression over the id columns.

    Also accepted: ``&&``, ``||``, ``==``, double quotes around column names, back-ticks around literal numbers.
    """
    def plain(part: str) -> str:
        for form, sql in PREDICATE_FORMS.items():
            part = part.replace(form, sql)
        return part

    out = []
    for i, part in enumerate(QUOTED.split(text)):
        if i % 2 == 0:
            out.append(plain(part))
        elif part[0] == "`":
            out.append(re.sub(r"^`(-?\d+(?:\.\d+)?|true|false)`$", r"\1", part))
        else:
            out.append("`" + part[1:-1] + "`" if part[0] == '"' else part)
    return F.expr("".join(out))


@dataclass(frozen=True)
class Level:
    """One nesting level: the columns whose combinations it runs over, and combinations to leave out."""

    name: str
    cols: Sequence[str] = ()
    leave_out: str | None = None


def order_helpers(df: DataFrame, columns: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> tuple[DataFrame, dict]:
    """Rank columns for the columns with an allowed list; the others sort by value."""
    ranks = {c: f"__rank:{c}" for c in dict.fromkeys(columns) if c in allowed}
    if ranks:
        df = df.withColumns({r: value_rank(c, allowed[c]) for c, r in ranks.items()})
    return df, {c: ranks.get(c, c) for c in columns}


def with_ordinals(df: DataFrame, levels: Sequence[Level], allowed: Mapping[str, Sequence[str]] | None = None,
                  rows: int | None = None) -> DataFrame:
    """Add ``<level>_idx``: the number of the level's value combination below the levels before it.

    Combinations that a level leaves out are dropped before it is numbered.
    """
    columns = [c for lv in levels for c in lv.cols]
    df = settled(df)
    df, rank = order_helpers(df, columns, allowed or {})
    rows = count_rows(df, columns[:1]) if rows is None and columns else rows or 0
    parents: list[str] = []
    for lv in levels:
        out = f"{lv.name}_idx"
        if lv.leave_out:
            df = df.filter(~F.coalesce(predicate(lv.leave_out), F.lit(False)))
        if not lv.cols:
            df = df.withColumn(out, F.lit(0).cast("bigint"))
            continue
        order = [OrderKey(rank[c]) for c in lv.cols]
        if rows <= chunk_rows(df):
            window = Window.partitionBy(*[col(p) for p in parents]).orderBy(*[k.sort() for k in order])
            df = df.withColumn(out, F.dense_rank().over(window).cast("bigint") - 1)
        else:
            df = settled(df)
            numbered = dense_places(df, parents, order, out)
            df = join_keys(df, numbered, [*parents, *[k.name for k in order]])
        parents.append(out)
    return df.drop(*[r for c, r in rank.items() if r != c])


# ---------------------------------------------------------------- grid

def grid_shape(ids: DataFrame, figure: Sequence[str] = ("fig_idx",)) -> DataFrame:
    """Rows and columns of the subplot grid per figure."""
    per_row = ids.groupBy(*[col(f) for f in figure], "row_idx").agg(F.count_distinct("col_idx").alias("n"))
    return per_row.groupBy(*[col(f) for f in figure]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("n_cols"), (F.min("n") == F.max("n")).alias("is_grid"))


def require_grid(ids: DataFrame) -> None:
    if not grid_shape(ids).filter(~F.col("is_grid")).isEmpty():
        raise ValueError("subplots do not form a grid: rows have different numbers of columns")


# ---------------------------------------------------------------- bars

def bar_positions(ids: DataFrame, subplot: Sequence[str], width: float = 0.6, padding: float = 0.0,
                  group_padding: float = 0.1) -> DataFrame:
    """Left and centre of every bar and centre of its group; one row per (subplot, group, bar)."""
    keys = list(subplot)
    bars = ids.select(*[col(k) for k in keys], "group_idx", "bar_idx").distinct()
    placed = positions(bars, keys, ["group_idx", "bar_idx"], "bar_no")
    offset = F.col("bar_no") * F.lit(width + padding) + F.col("group_idx") * F.lit(group_padding)
    placed = placed.withColumn("bar_center_pos", offset)
    ends = placed.groupBy(*[col(k) for k in keys], "group_idx").agg(
        ((F.min("bar_center_pos") + F.max("bar_center_pos")) / 2).alias("group_center_pos"))
    both = join_keys(placed, ends, [*keys, "group_idx"])
    return both.withColumn("bar_left_pos", F.col("bar_center_pos") - F.lit(width / 2))


def stack_bottoms(df: DataFrame, bar: Sequence[str], order, value: str = "value",
                  out: str = "bar_part_bottom") -> DataFrame:
    """Bottom of each part: the sum of the parts before it in its bar; parts without a value are left out."""
    present = df.filter(col(value).isNotNull())
    done = running(present, list(bar), order, {out: Scan("sum", value, exclusive=True)})
    return done.withColumn(out, F.coalesce(col(out), F.lit(0.0)))


def require_single_rows(df: DataFrame, keys: Sequence[str]) -> None:
    """A bar part must come from exactly one row."""
    repeated = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    found = repeated.limit(1).collect()
    if found:
        raise ValueError(f"a bar part must have exactly one row, but {found[0].asDict()}")


# ---------------------------------------------------------------- boxes

def box_statistics(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 times the quartile distance) and the number of outliers."""
    stats, fences = _fences(df, keys, value)
    limits = df.select(*[col(k) for k in keys], col(value).cast("double").alias("__v"))
    joined = _with_fences(limits.filter(F.col("__v").isNotNull()), fences, keys)
    inside = F.col("__v").between(F.col("__low"), F.col("__high"))
    whiskers = joined.groupBy(*[col(k) for k in keys]).agg(
        F.min(F.when(F.col("__v") >= F.col("__low"), F.col("__v"))).alias("__lo"),
        F.max(F.when(F.col("__v") <= F.col("__high"), F.col("__v"))).alias("__hi"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n_values"),
        F.min("__v").alias("value_min"), F.max("__v").alias("value_max"))
    both = join_keys(stats, whiskers, keys)
    return both.select(
        *[col(k) for k in keys], "q1", "median", "q3",
        F.least("__lo", "q1").alias("whisker_low"), F.greatest("__hi", "q3").alias("whisker_high"),
        "n_outliers", "n_values", "value_min", "value_max")


def _fences(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    present = df.filter(col(value).isNotNull())
    # read for the result, for the fences and for their size
    stats = cut(quantiles(present, list(keys), value, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = stats.select(*[col(k) for k in keys], (F.col("q1") - reach).alias("__low"),
                          (F.col("q3") + reach).alias("__high"))
    return stats, fences


def _with_fences(rows: DataFrame, fences: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_keys(rows, broadcast_if_small(fences), keys)


def box_outliers(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One row per value outside the whiskers."""
    _, fences = _fences(df, keys, value)
    rows = df.select(*[col(k) for k in keys], col(value).cast("double").alias(value))
    joined = _with_fences(rows.filter(col(value).isNotNull()), fences, keys)
    return joined.filter(~col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


# ---------------------------------------------------------------- configuration per id

@dataclass(frozen=True)
class Rule:
    """Settings for the ids that a predicate selects (all ids without one)."""

    settings: Mapping[str, object] = field(default_factory=dict)
    where: str | None = None


def resolve(rules: Sequence[Rule], names: Sequence[str], fields: Sequence[str],
            label_map: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Per field the first matching rule that sets it; a ``{"template": …}`` value is filled from the id."""
    out = {}
    for f in fields:
        options = []
        for r in rules:
            value = r.settings.get(f)
            if value is None:
                continue
            if isinstance(value, Mapping) and "template" in value:
                shown = label(value["template"], names, label_map)
            else:
                shown = F.lit(json.dumps(value) if isinstance(value, (Mapping, list)) else value)
            options.append(shown if r.where is None else F.when(predicate(r.where), shown))
        out[f] = F.coalesce(*options) if options else F.lit(None).cast("string")
    return out


def matching_rule(rules: Sequence[Rule], fields: Sequence[str]) -> Column:
    """Number of the first rule that matches and sets one of the fields."""
    options = []
    for i, r in enumerate(rules):
        if any(r.settings.get(f) is not None for f in fields):
            options.append(F.lit(i) if r.where is None else F.when(predicate(r.where), F.lit(i)))
    return F.coalesce(*options, F.lit(None).cast("int")) if options else F.lit(None).cast("int")


# ---------------------------------------------------------------- axes and legends

def _limit(rule, low: Column, high: Column) -> Column:
    if isinstance(rule, Mapping):
        (name, factor), = rule.items()
        if name not in ("data_min_scaler", "data_max_scaler"):
            raise ValueError(f"unknown axis limit {name!r}")
        return (low if name == "data_min_scaler" else high) * F.lit(float(factor))
    return F.lit(None if rule is None else float(rule)).cast("double")


def axis_limits(df: DataFrame, keys: Sequence[str], low: Column, high: Column, minimum=0.0, maximum=None,
                n_ticks: int | None = None) -> DataFrame:
    """Data interval per subplot, the limits that follow from it, and evenly spaced ticks."""
    data = df.groupBy(*[col(k) for k in keys]).agg(F.min(low).alias("data_min"), F.max(high).alias("data_max"))
    out = data.withColumns({
        "axis_min": _limit(minimum, F.col("data_min"), F.col("data_max")),
        "axis_max": _limit(maximum, F.col("data_min"), F.col("data_max")),
    })
    if n_ticks:
        top = F.coalesce("axis_max", "data_max")
        bottom = F.coalesce("axis_min", "data_min")
        out = out.withColumn("ticks", ticks(bottom, top, n_ticks))
    return out


def legend(df: DataFrame, keys: Sequence[str], text: str, order, reverse: bool = False) -> DataFrame:
    """Distinct legend labels in the order they first appear (reversed for legends inside an axis)."""
    names = [k.name for k in order_keys(order)]
    first = df.filter(col(text).isNotNull()).groupBy(*[col(k) for k in keys], col(text)).agg(
        F.min(F.struct(*[col(n) for n in names])).alias("__first"))
    flat = first.select(*[col(k) for k in keys], col(text), *[F.col("__first").getField(n).alias(f"__f{i}")
                                                            for i, n in enumerate(names)])
    ordered = [OrderKey(f"__f{i}", not reverse) for i in range(len(names))]
    return positions(flat, list(keys), ordered, "legend_no").drop(*[f"__f{i}" for i in range(len(names))])


def keep_empty(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """All allowed values, also those without rows."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v, i) for i, v in enumerate(allowed)], f"`{column}` string, allowed_no int")
    return F.broadcast(wanted).join(df, column, "left")


# ---------------------------------------------------------------- whole charts

def _foreach(options, name: str) -> Level:
    options = options or {}
    return Level(name, as_list(options.get("cols")), options.get("jp_except"))


def _rules(entries: Sequence[Mapping] | None) -> list[Rule]:
    return [Rule({k: v for k, v in (e or {}).items() if k != "jp_query"}, (e or {}).get("jp_query"))
            for e in entries or []]


def _all_columns(options: Mapping) -> list[str]:
    names = [*_foreach(options.get("fig_foreach"), "fig").cols]
    for e in options.get("cum_plot_config") or []:
        grid = (e or {}).get("subplot_grid") or {}
        names += [*as_list(grid.get("rows")), *as_list(grid.get("cols"))]
    for e in options.get("cum_subplot_config") or []:
        chart = (e or {}).get("chart") or {}
        for part in ("group_foreach", "bar_foreach", "box_foreach", "part_foreach"):
            names += _foreach(chart.get(part), part).cols
    return list(dict.fromkeys(names))


SUBPLOT = ("fig_idx", "row_idx", "col_idx")


@dataclass(frozen=True)
class Hooks:
    """Callbacks between the phases; each gets a frame and returns the one to go on with.

    All rows pass ``pre_metrics``, ``pre_filter`` and ``pre_group``. The rows of each subplot grid pass ``pre_figure`` before and
    ``post_figure`` after they are placed, its settings ``post_subplots``. Each chart's rows pass ``pre_bars`` or ``pre_boxes``, its
    table ``post_bars`` or ``post_boxes``. ``post`` gets every table at the end.
    """

    pre_metrics: object = None
    pre_filter: object = None
    pre_group: object = None
    pre_figure: object = None
    post_figure: object = None
    post_subplots: object = None
    pre_bars: object = None
    post_bars: object = None
    pre_boxes: object = None
    post_boxes: object = None
    post: object = None


def _hooked(hook, df: DataFrame) -> DataFrame:
    return df if hook is None else hook(df)


def chart_tables(df: DataFrame, options: Mapping, hooks: Hooks = Hooks()) -> dict[str, DataFrame]:
    """All tables behind the charts of one chart specification.

    Returns ``data`` (filtered rows with figure and subplot ordinals), ``subplots`` and, where charts of that kind
    exist, ``bars`` and ``boxes`` with their ``axes`` (intervals, limits and ticks per subplot). Configured legends give
    ``legend`` (per subplot, last label first) and ``figure_legend``.
    """
    metrics = {k: v if isinstance(v, Metric) else Metric(**v) for k, v in options["metrics"].items()}
    allowed = (options.get("data_filter") or {}).get("allowed") or {}
    plot_rules, subplot_rules = _rules(options.get("cum_plot_config")), _rules(options.get("cum_subplot_config"))
    if not subplot_rules:
        raise ValueError("cum_subplot_config is missing or empty")
    df = _hooked(hooks.pre_metrics, df)
    wide = _hooked(hooks.pre_filter, fan_out(df, metrics))
    columns = [c for c in _all_columns(options)]
    wide = _hooked(hooks.pre_group, allowed_filter(wide, columns, allowed))
    figure = _foreach(options.get("fig_foreach"), "fig")

    tables: dict[str, list[DataFrame]] = {"data": [], "subplots": [], "bars": [], "boxes": [], "axes": []}
    labels = []
    grid_of = matching_rule(plot_rules, ["subplot_grid"]) if plot_rules else F.lit(None).cast("int")
    grids = [i for i, r in enumerate(plot_rules) if r.settings.get("subplot_grid")]
    has_other = not any(plot_rules[i].where is None for i in grids)
    if len(grids) + has_other > 1:
        wide = cut(wide)
    for i in [*grids, *([None] if has_other else [])]:
        grid = plot_rules[i].settings["subplot_grid"] if i is not None else {}
        mine = wide.filter(grid_of == i if i is not None else grid_of.isNull()) if grids else wide
        rows, cols = as_list(grid.get("rows")), as_list(grid.get("cols"))
        if len(metrics) > 1 and METRIC not in [*figure.cols, *rows, *cols]:
            raise ValueError(f"several metrics need {METRIC} in the figure or subplot columns")
        levels = [figure, Level("row", rows, grid.get("jp_except")), Level("col", cols)]
        placed = with_ordinals(_hooked(hooks.pre_figure, mine), levels, allowed)
        unit = F.coalesce(*[F.when(col(METRIC) == k, F.lit(m.unit_label)) for k, m in metrics.items()],
                          F.lit(None).cast("string"))
        placed = placed.withColumn(UNIT, unit)
        ids = list(dict.fromkeys([*figure.cols, *rows, *cols, METRIC, UNIT]))
        placed = placed.withColumn("file_name", file_name(figure.cols) if figure.cols else F.lit("out"))
        # the grid check, the settings and every chart read these rows
        placed = cut(_hooked(hooks.post_figure, placed))
        if rows or cols:
            require_grid(placed)
        tables["data"].append(placed)
        frame = placed.select("file_name", "fig_idx", "row_idx", "col_idx", *[col(c) for c in ids]).distinct()
        tables["subplots"].append(_hooked(hooks.post_subplots, _subplot_settings(frame, subplot_rules, ids)))
        chart_of = matching_rule(subplot_rules, ["chart"])
        for j, rule in enumerate(subplot_rules):
            chart = rule.settings.get("chart")
            if chart is None:
                continue
            part = placed.filter(chart_of == j)
            if "box_foreach" in chart:
                kind, number = "boxes", "box_idx"
                shown = _hooked(hooks.post_boxes, _boxes(_hooked(hooks.pre_boxes, part), chart, metrics, allowed, ids, subplot_rules))
            else:
                kind, number = "bars", "bar_idx"
                shown = _hooked(hooks.post_bars, _bars(_hooked(hooks.pre_bars, part), chart, metrics, allowed, ids, subplot_rules))
            # the chart, its axes and its legends read this table
            shown = cut(shown)
            tables[kind].append(shown)
            tables["axes"].append(_axes(shown, kind, chart, subplot_rules, ids))
            labels.append(shown.select("file_name", *SUBPLOT, "group_idx", col(number).alias("bar_idx"), "part_idx", "value_no",
                                       col("artist_label").alias("label")))
    found = {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for name, parts in tables.items() if parts}
    if labels:
        drawn, order = reduce(DataFrame.unionByName, labels), ["group_idx", "bar_idx", "part_idx", "value_no"]
        if any(r.settings.get("legend_ax") for r in subplot_rules):
            found["legend"] = legend(drawn, ["file_name", *SUBPLOT], "label", order, reverse=True)
        if any(r.settings.get("legend_fig") for r in plot_rules):
            found["figure_legend"] = legend(drawn, ["file_name", "fig_idx"], "label", ["row_idx", "col_idx", *order])
    return {name: _hooked(hooks.post, df) for name, df in found.items()}


def _first_set(rules: Sequence[Rule], path: Sequence[str], value) -> Column:
    """``value`` of the setting at ``path`` in the first matching rule that has one."""
    out = F.lit(None)
    for r in reversed(rules):
        setting = reduce(lambda found, name: (found or {}).get(name), path, r.settings)
        if setting is not None:
            out = F.when(F.lit(True) if r.where is None else predicate(r.where), value(setting)).otherwise(out)
    return out


def _axes(df: DataFrame, kind: str, chart: Mapping, rules: Sequence[Rule], ids: Sequence[str]) -> DataFrame:
    """Per subplot and axis the interval that the chart covers, the configured limits and the ticks."""
    if kind == "boxes":
        left, width, low, high = F.col("box_left_pos"), chart.get("box_width", 0.6), F.col("value_min"), F.col("value_max")
    else:
        left, width = F.col("bar_left_pos"), chart.get("bar_width", 0.6)
        end, spread = F.col("bar_part_bottom") + F.col("value"), F.coalesce("error", F.lit(0.0))
        low, high = F.least("bar_part_bottom", end - spread), F.greatest("bar_part_bottom", end + spread)
    out = df.groupBy("file_name", *SUBPLOT, *[col(c) for c in ids]).agg(
        F.min(left).alias("x_data_min"), F.max(left + F.lit(width)).alias("x_data_max"),
        F.min(low).alias("y_data_min"), F.max(high).alias("y_data_max"))
    for axis in ("x", "y"):
        first, last, place = F.col(f"{axis}_data_min"), F.col(f"{axis}_data_max"), f"{axis}axis"
        out = out.withColumns({
            f"{axis}_min": _first_set(rules, [place, "lim"], lambda x: _limit(x.get("min", 0.0), first, last)).cast("double"),
            f"{axis}_max": _first_set(rules, [place, "lim"], lambda x: _limit(x.get("max"), first, last)).cast("double"),
            f"{axis}_scale": _first_set(rules, [place, "scale"], F.lit).cast("string"),
        })
        ends = F.coalesce(f"{axis}_min", first), F.coalesce(f"{axis}_max", last)
        out = out.withColumn(f"{axis}_ticks", _first_set(rules, [place, "ticks"], lambda t: (
            ticks(*ends, t) if isinstance(t, int) else F.array(*[F.lit(float(x)) for x in t["ticks"]]))).cast("array<double>"))
    return out


def _subplot_settings(frame: DataFrame, rules: Sequence[Rule], ids: Sequence[str]) -> DataFrame:
    label_map = next((r.settings["label_map"] for r in rules if r.settings.get("label_map")), None)
    shown = {}
    titles = [Rule({"title": r.settings.get("ax_title")}, r.where) for r in rules]
    shown |= {"ax_title": resolve(titles, ids, ["title"], label_map)["title"]}
    for axis in ("xaxis", "yaxis"):
        labels = [Rule({"label": (r.settings.get(axis) or {}).get("label")}, r.where) for r in rules]
        shown[f"{axis}_label"] = resolve(labels, ids, ["label"], label_map)["label"]
    return frame.withColumns(shown)


def _artists(df: DataFrame, rules: Sequence[Rule], ids: Sequence[str]) -> DataFrame:
    label_map = next((r.settings["label_map"] for r in rules if r.settings.get("label_map")), None)
    artist: list[Rule] = []
    for r in rules:
        for a in _rules(r.settings.get("cum_artist_config")):
            where = " and ".join(f"({w})" for w in (r.where, a.where) if w) or None
            artist.append(Rule(a.settings, where))
    for r in rules:
        base = (r.settings.get("legend_ax") or {}).get("label")
        if base is not None:
            artist.append(Rule({"label": base}, r.where))
    fields = list(dict.fromkeys(["label", *[k for a in artist for k in a.settings]]))
    chosen = resolve(artist, ids, fields, label_map)
    return df.withColumns({f"artist_{k}": v for k, v in chosen.items()})


def _level_label(df: DataFrame, options, ids: Sequence[str], out: str, rules: Sequence[Rule]) -> DataFrame:
    template = ((options or {}).get("label") or {}).get("template")
    if template is None:
        return df
    label_map = next((r.settings["label_map"] for r in rules if r.settings.get("label_map")), None)
    return df.withColumn(out, label(template, ids, label_map))


def _bars(df: DataFrame, chart: Mapping, metrics: Mapping[str, Metric], allowed: Mapping, ids: list[str],
          rules: Sequence[Rule]) -> DataFrame:
    levels = [_foreach(chart.get(f"{n}_foreach"), n) for n in ("group", "bar", "part")]
    subplot = ["fig_idx", "row_idx", "col_idx"]
    names = list(dict.fromkeys([*ids, *[c for lv in levels for c in lv.cols]]))
    base = [Level("fig", ["fig_idx"]), Level("row", ["row_idx"]), Level("col", ["col_idx"])]
    placed = with_ordinals(df, [*base, *levels], allowed)
    keys = [*subplot, "group_idx", "bar_idx"]
    require_single_rows(placed, [*keys, "part_idx"])
    long = metric_values(placed.drop(UNIT), metrics)
    where = bar_positions(long, subplot, chart.get("bar_width", 0.6), chart.get("bar_padding", 0.0),
                          chart.get("group_padding", 0.1))
    stacked = stack_bottoms(long, keys, ["part_idx", "value_no"])
    bars = join_keys(stacked, where, keys)
    bars = _level_label(bars, chart.get("group_foreach"), names, "group_label", rules)
    bars = _level_label(bars, chart.get("bar_foreach"), names, "bar_label", rules)
    bars = _artists(bars, rules, names + ["value_col"])
    shown = [c for c in bars.columns if c.startswith("artist_") or c in ("group_label", "bar_label")]
    return bars.select(
        "file_name", *[col(k) for k in keys], "part_idx", *[col(n) for n in names], "value_no", "value_col",
        "error_col", "value", "error", "bar_no", "group_center_pos", "bar_left_pos", "bar_center_pos",
        "bar_part_bottom", *[col(c) for c in shown])


def _boxes(df: DataFrame, chart: Mapping, metrics: Mapping[str, Metric], allowed: Mapping, ids: list[str],
           rules: Sequence[Rule]) -> DataFrame:
    wrong = [k for k, m in metrics.items() if m.errors]
    if wrong:
        raise ValueError(f"box charts take no error columns, but metrics {wrong} have some")
    levels = [_foreach(chart.get("group_foreach"), "group"), _foreach(chart.get("box_foreach"), "bar"),
              _foreach(chart.get("part_foreach"), "part")]
    names = list(dict.fromkeys([*ids, *[c for lv in levels for c in lv.cols]]))
    long = metric_values(df.drop(UNIT), metrics)
    keep = list(dict.fromkeys(["file_name", "fig_idx", "row_idx", "col_idx", *names, "value_no", "value_col"]))
    stats = box_statistics(long, keep)
    base = [Level("fig", ["fig_idx"]), Level("row", ["row_idx"]), Level("col", ["col_idx"])]
    placed = with_ordinals(stats, [*base, *levels], allowed)
    subplot = ["fig_idx", "row_idx", "col_idx"]
    keys = [*subplot, "group_idx", "bar_idx"]
    where = bar_positions(placed, subplot, chart.get("box_width", 0.6), chart.get("box_padding", 0.0),
                          chart.get("group_padding", 0.1))
    renamed = {"bar_center_pos": "box_center_pos", "bar_left_pos": "box_left_pos", "bar_no": "box_no"}
    boxes = join_keys(placed, where, keys).withColumnsRenamed(renamed)
    boxes = _level_label(boxes, chart.get("group_foreach"), names, "group_label", rules)
    boxes = _level_label(boxes, chart.get("box_foreach"), names, "box_label", rules)
    return _artists(boxes, rules, names + ["value_col"]).withColumnRenamed("bar_idx", "box_idx")


