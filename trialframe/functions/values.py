"""Small value functions: maps from lists, host picks, ranges, truth values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that count as true
TRUE_TEXTS = ["true", "yes", "on", "1"]


def as_map(keys: Sequence[str], values: Sequence[Column]) -> Column:
    """Names and values as a map of texts; both lists need the same length."""
    if len(keys) != len(values):
        raise ValueError(f"{len(values)} values for {len(keys)} names")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[v.cast("string") for v in values]))


def pick_host(hosts: Column, host_type: str, number: int, field: str) -> Column:
    """A field of the n-th host of a type from an array of host structs; a missing host is an error."""
    chosen = F.filter(hosts, lambda h: h["host_type"] == host_type)
    missing = F.raise_error(F.lit(f"no host number {number} of type {host_type}")).cast("string")
    return F.when(F.size(chosen) > number, F.get(chosen, F.lit(number))[field]).otherwise(missing)


def range_levels(start: int | Column, stop: int | Column, step: int = 1) -> Column:
    """Whole numbers from start up to, but without, stop."""
    first = F.lit(start) if isinstance(start, int) else start
    end = F.lit(stop) if isinstance(stop, int) else stop
    last = end - 1 if step > 0 else end + 1
    empty = F.array().cast("array<bigint>")
    fits = first <= last if step > 0 else first >= last
    return F.when(fits, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))).otherwise(empty)


def truth(value: Column) -> Column:
    """Text or number as a boolean."""
    return F.lower(F.trim(value.cast("string"))).isin(TRUE_TEXTS)


def json_entry(text: Column, path: str) -> Column:
    """The entry of a JSON text at a dotted path, as text."""
    return F.get_json_object(text, "$." + path)
