"""Text functions: labels, file-safe names, masks, number formats."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialframe.columns import col

MASK = "%REPL%"  # fixed value: what masked text is replaced with


def mapped(value: Column, label_map: Mapping[str, str] | None) -> Column:
    """Display text of a value; values without an entry stay as they are."""
    if not label_map:
        return value
    pairs = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value)


def label(template: str, names: Sequence[str], label_map: Mapping[str, str] | None = None) -> Column:
    """Fill ``"{system}: {workload}"`` from columns; a name that is not available is an error."""
    pieces = []
    for text, name, _spec, _conversion in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            if name not in names:
                raise KeyError(f"label template {template!r}: no column {name!r} among {list(names)}")
            pieces.append(F.coalesce(mapped(col(name).cast("string"), label_map), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def file_name(names: Sequence[str]) -> Column:
    """``k=v_k=v`` without dots and spaces."""
    parts = [F.concat(F.lit(n.strip() + "="), F.trim(col(n).cast("string"))) for n in names]
    return F.translate(F.concat_ws("_", *parts), ". ", "")


def joined_name(names: Sequence[str]) -> Column:
    """Values joined by underscores, without dots."""
    return F.translate(F.concat_ws("_", *[col(n).cast("string") for n in names]), ".", "")


def masked(text: Column, patterns: Sequence[str]) -> Column:
    """Replace every match of every pattern by a fixed mark, pattern after pattern."""
    for p in patterns:
        text = F.regexp_replace(text, p, MASK)
    return text


# ---------------------------------------------------------------- templates

REFERENCE = re.compile(r"\[%\s*(.+?)\s*%\]")


def rendered(value: Column, dtype: str) -> Column:
    """Value as template text: booleans as True/False."""
    if dtype == "boolean":
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    return value.cast("string")


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``[% name %]`` references of a literal text from columns; an unknown name is an error."""
    pieces, at = [], 0
    for found in REFERENCE.finditer(template):
        if found.start() > at:
            pieces.append(F.lit(template[at:found.start()]))
        name = found.group(1)
        if name not in values:
            raise KeyError(f"template refers to {name!r}, known are {sorted(values)}")
        pieces.append(values[name])
        at = found.end()
    if at < len(template):
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces) if pieces else F.lit("")


def fill_column(text: Column, values: Mapping[str, Column]) -> Column:
    """Fill plain ``[% name %]`` references in a text column."""
    for name, value in values.items():
        text = F.replace(text, F.lit(f"[% {name} %]"), F.coalesce(value, F.lit("None")))
    return text


# ---------------------------------------------------------------- numbers

def fixed_text(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals (half-even on the exact value) and no thousands marks."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def round_short(value: Column) -> Column:
    """Compact number: B, M or k suffix, one to four decimals by size, no trailing zeros."""
    number = value.cast("double")
    size = F.abs(number)
    unit = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).when(size >= 1e3, 1e3).otherwise(1.0)
    suffix = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "k").otherwise("")
    scaled = number / unit
    text = (
        F.when(size < 0.001, fixed_text(scaled, 4)).when(size < 0.01, fixed_text(scaled, 3))
        .when(size < 0.1, fixed_text(scaled, 2)).otherwise(fixed_text(scaled, 1))
    )
    short = F.concat(F.regexp_replace(text, r"\.?0+$", ""), suffix)
    return F.when(short == "100M", F.lit("0.1B")).otherwise(short)


def ticks(low: Column, high: Column, n: int) -> Column:
    """``n`` evenly spaced values from low to high."""
    if n == 1:
        return F.array(low)
    step = (high - low) / F.lit(float(n - 1))
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: low + i.cast("double") * step)
    return F.concat(inner, F.array(high))
