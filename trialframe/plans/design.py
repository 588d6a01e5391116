"""Experiment designs to run and job tables.

A design is a small nested configuration written by a user; the table of its runs can be very large. Runs are
numbered by ``spark.range`` and every factor's level follows from the number by division, so the product of the
factors needs neither a join nor a shuffle.
"""

from __future__ import annotations

import copy
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import all_of, any_of, as_list, broadcast_if_small, col
from trialframe.functions.text import REFERENCE, fill_column, fill_template, rendered
from trialframe.operators.ordered import positions
from trialframe.session import settled

FACTOR = "$FACTOR$"
COMMAND = "$CMD$"
# fixed values: names that no experiment may have
RESERVED_NAMES = [
    "state", "$FACTOR$", "is_controller_yes", "is_controller_no", "check_status_yes", "check_status_no", "localhost",
    "n_repetitions", "common_roles", "host_types", "base_experiment", "factor_levels", "n", "init_roles",
    "check_status", "$CMD$",
]
MAX_NAME_LENGTH = 200


# ---------------------------------------------------------------- nested configurations

def paths_of(node: Mapping, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Paths and values of the leaves of a nested mapping."""
    for key, value in node.items():
        if isinstance(value, Mapping):
            yield from paths_of(value, (*path, str(key)))
        else:
            yield (*path, str(key)), value


def with_defaults(base: Mapping, defaults: Mapping) -> dict:
    """Add the defaults whose path is not present yet; present values stay."""
    merged = copy.deepcopy(dict(base))
    for path, value in paths_of(defaults):
        node = merged
        for key in path[:-1]:
            node = node.setdefault(key, {})
            if not isinstance(node, dict):
                break
        if isinstance(node, dict):
            node.setdefault(path[-1], value)
    return merged


def resolve_includes(node: Mapping, files: Mapping[str, Mapping], depth: int = 0) -> dict:
    """Fill ``$INCLUDE_VARS$`` entries at any depth from the named variable files."""
    if depth > 100:
        raise ValueError("variable files include each other without end")
    here = {k: v for k, v in node.items() if k != "$INCLUDE_VARS$"}
    for name in as_list(node.get("$INCLUDE_VARS$")):
        if not isinstance(name, str) or name not in files:
            raise ValueError(f"unknown variable file {name!r}")
        here = with_defaults(here, resolve_includes(files[name], files, depth + 1))
    return {k: resolve_includes(v, files, depth) if isinstance(v, Mapping) else v for k, v in here.items()}


def merge_defaults(own: DataFrame, defaults: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Table form of :func:`with_defaults`: own values win, defaults fill the keys that are missing."""
    other = defaults.select(*[col(k) for k in keys], col(value).alias("__default"))
    both = own.withColumn("__own", F.lit(True)).join(other, list(keys), "full")
    return both.withColumn(value, F.when(F.col("__own"), col(value)).otherwise(F.col("__default"))).drop(
        "__own", "__default")


# ---------------------------------------------------------------- factors

def listed_factors(experiment: Mapping) -> list[tuple[str, ...]]:
    """Factors whose levels are listed in ``factor_levels`` (``$FACTOR$`` as a value)."""
    return [p for p, v in paths_of(experiment["base_experiment"]) if isinstance(v, str) and v == FACTOR]


def crossed_factors(experiment: Mapping) -> dict[tuple[str, ...], list]:
    """Factors with their own level list (``$FACTOR$`` as a key), which are crossed with each other."""
    found = {}
    for path, value in paths_of(experiment["base_experiment"]):
        if path[-1] == FACTOR:
            if not isinstance(value, list):
                raise ValueError(f"levels of factor {'.'.join(path[:-1])} must be a list")
            found[path[:-1]] = value
    return found


def factor_columns(experiment: Mapping) -> list[str]:
    """Names of all factors in the order of the design."""
    names = []
    for path, value in paths_of(experiment["base_experiment"]):
        if path[-1] == FACTOR:
            names.append(".".join(path[:-1]))
        elif isinstance(value, str) and value == FACTOR:
            names.append(".".join(path))
    return names


def check_experiment(name: str, experiment: Mapping) -> None:
    """Naming rules, complete level lists, and exclusions that only speak of factors."""
    if name in RESERVED_NAMES or len(name) > MAX_NAME_LENGTH or not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"experiment name {name!r} is not allowed")
    listed = sorted(listed_factors(experiment))
    for level in experiment.get("factor_levels", [{}]):
        given = sorted(p for p, _ in paths_of(level))
        if given != listed:
            raise ValueError(f"{name}: level {level} must set exactly the factors {listed}")
    allowed = {*listed, *crossed_factors(experiment)}
    for entry in experiment.get("except_filters", []):
        wrong = [p for p, _ in paths_of(entry) if p not in allowed]
        if wrong:
            raise ValueError(f"{name}: exclusion {entry} names {wrong}, which are no factors")


# ---------------------------------------------------------------- run table

def _literal(value) -> Column:
    if isinstance(value, list):
        if value and all(isinstance(v, (bool, int, float, str)) for v in value) and len({type(v) for v in value}) == 1:
            return F.array(*[F.lit(v) for v in value])
        return F.lit(json.dumps(value))
    return F.lit(json.dumps(value, sort_keys=True)) if isinstance(value, Mapping) else F.lit(value)


def _levels(values: Sequence) -> Column:
    """The levels as an array; levels of different kinds are kept as JSON text."""
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int, float} and kinds:
        kind = float if float in kinds else int
        return F.array(*[F.lit(None if v is None else kind(v)) for v in values])
    if len(kinds) == 1 and kinds <= {bool, str}:
        return F.array(*[F.lit(v) for v in values])
    return F.array(*[F.lit(None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True))
                     for v in values])


def normal_commands(host_type: Mapping) -> list[dict]:
    """One mapping per host with at least ``main``; a single command is repeated for all hosts."""
    n, command = host_type.get("n", 1), host_type[COMMAND]
    commands = command if isinstance(command, list) else [command] * n
    if len(commands) != n:
        raise ValueError(f"{len(commands)} commands given for {n} hosts")
    out = []
    for c in commands:
        entry = {"main": c} if isinstance(c, str) else dict(c)
        if "main" not in entry:
            raise ValueError("a command mapping needs an entry 'main'")
        out.append(entry)
    return out


def run_table(
    spark: SparkSession,
    name: str,
    experiment: Mapping,
    suite_vars: Mapping | None = None,
    variables: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per run: ``exp_name``, ``run``, the dotted configuration, and the commands of each host type.

    Runs count through the listed levels first and through the crossed factors with the last one fastest; excluded
    combinations get no number. References ``[% my_run.x %]`` are filled from the run's own configuration.
    """
    experiment = dict(experiment)
    if suite_vars:
        experiment["base_experiment"] = with_defaults(experiment["base_experiment"], suite_vars)
    check_experiment(name, experiment)
    listed, crossed = listed_factors(experiment), crossed_factors(experiment)
    levels = [dict(paths_of(level)) for level in experiment.get("factor_levels", [{}])]

    total = len(levels) * math.prod(len(v) for v in crossed.values())
    runs = spark.range(total)
    stride = total // max(len(levels), 1)
    place = F.floor(F.col("id") / F.lit(max(stride, 1))).cast("int")
    config: dict[str, Column] = {}
    for path in listed:
        config[".".join(path)] = F.get(_levels([level[path] for level in levels]), place)
    for path, values in crossed.items():
        stride //= max(len(values), 1)
        at = F.pmod(F.floor(F.col("id") / F.lit(max(stride, 1))), F.lit(len(values))).cast("int")
        config[".".join(path)] = F.get(_levels(values), at)
    factors = set(config)
    constants = {".".join(p): v for p, v in paths_of(experiment["base_experiment"])
                 if p not in listed and p[-1] != FACTOR}
    config |= {n: _literal(v) for n, v in constants.items()}
    order = factor_and_constant_order(experiment)
    runs = runs.select("id", *[config[n].alias(n) for n in order])

    excluded = []
    for entry in experiment.get("except_filters", []):
        tests = [col(".".join(p)).eqNullSafe(_literal(v)) for p, v in paths_of(entry)]
        excluded.append(all_of(tests))
    if excluded:
        runs = positions(runs.filter(~any_of(excluded)), [], "id", "run")
    else:
        runs = runs.withColumn("run", F.col("id"))

    commands = {t: normal_commands(h) for t, h in experiment.get("host_types", {}).items()}
    runs = _fill(runs, order, factors, constants, variables or {})
    types = dict(runs.dtypes)
    values = {f"my_run.{n}": rendered(col(n), types[n]) for n in order}
    values |= {"run": F.col("run").cast("string"), **{k: F.lit(v) for k, v in (variables or {}).items()}}
    for host_type, entries in commands.items():
        filled = [
            F.create_map(*[x for k, v in e.items() for x in (F.lit(k), fill_template(v, values))]) for e in entries
        ]
        runs = runs.withColumn(f"{COMMAND}.{host_type}", F.array(*filled))
    ordered = ["run", *order, *[f"{COMMAND}.{t}" for t in commands]]
    return runs.select(F.lit(name).alias("exp_name"), *[col(c) for c in ordered])


def suite_run_tables(
    spark: SparkSession,
    design: Mapping,
    variable_files: Mapping[str, Mapping] | None = None,
    variables: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Run table of every experiment of a suite design, with its included files and shared variables."""
    files = variable_files or {}
    shared = resolve_includes(design.get("$SUITE_VARS$") or {}, files)
    tables = {}
    for name, body in design.items():
        if name.startswith("$"):
            continue
        base = resolve_includes(body["base_experiment"], files)
        tables[name] = run_table(spark, name, {**body, "base_experiment": base}, shared, variables)
    return tables


def factor_and_constant_order(experiment: Mapping) -> list[str]:
    """Dotted configuration columns in the order of the design."""
    return [".".join(p[:-1] if p[-1] == FACTOR else p) for p, _ in paths_of(experiment["base_experiment"])]


def _fill(runs: DataFrame, order: Sequence[str], factors: set[str], constants: Mapping, variables: Mapping) -> DataFrame:
    """Resolve references between configuration columns; nested references are resolved step by step."""
    for _ in range(20):
        types = dict(runs.dtypes)
        values = {f"my_run.{n}": rendered(col(n), types[n]) for n in order}
        values |= {"run": F.col("run").cast("string"), **{k: F.lit(v) for k, v in variables.items()}}
        text = [n for n in order if types[n] == "string"]
        pending = [n for n in text if n in constants and isinstance(constants[n], str) and REFERENCE.search(constants[n])]
        pending += [n for n in text if n in factors]
        if not pending:
            return runs
        open_constants = {n: constants[n] for n in pending if n in constants}
        used = {m for v in open_constants.values() for m in REFERENCE.findall(v)}
        unknown = used - set(values)
        if unknown:
            raise KeyError(f"templates refer to unknown names {sorted(unknown)}")
        runs = runs.withColumns({n: fill_column(col(n), {k: v for k, v in values.items() if k != f"my_run.{n}"})
                                 for n in pending})
        nested = any(f"my_run.{n}" in used for n in open_constants)
        constants = {k: v for k, v in constants.items() if k not in open_constants or nested}
        if not nested:
            return runs
        constants = {k: (_substitute(v, constants) if isinstance(v, str) else v) for k, v in constants.items()}
    raise ValueError("templates refer to each other without end")


def _substitute(text: str, constants: Mapping) -> str:
    """One step of replacing references to constants inside a constant (only to see which references remain)."""
    def swap(found: re.Match) -> str:
        value = constants.get(found.group(1).removeprefix("my_run."))
        return value if isinstance(value, str) else "0"

    return REFERENCE.sub(swap, text)


# ---------------------------------------------------------------- products of level tables

def factor_product(spark: SparkSession, factors: Mapping[str, tuple[DataFrame, object]], out: str = "run") -> DataFrame:
    """All combinations of level tables ``{name: (levels, order)}``, numbered with the last factor fastest.

    The size of the product is counted from the level tables; each table is then joined by its level number.
    """
    numbered, sizes = {}, {}
    for name, (levels, order) in factors.items():
        levels = settled(levels)
        numbered[name] = positions(levels, [], order, f"__at_{name}")
        sizes[name] = levels.count()
    total = math.prod(sizes.values())
    runs = spark.range(total).withColumnRenamed("id", out)
    stride = total
    for name, levels in numbered.items():
        stride //= max(sizes[name], 1)
        at = F.pmod(F.floor(col(out) / F.lit(max(stride, 1))).cast("bigint"), F.lit(max(sizes[name], 1)))
        runs = runs.withColumn(f"__at_{name}", at).join(broadcast_if_small(levels), f"__at_{name}").drop(f"__at_{name}")
    return runs


def exclude(runs: DataFrame, entries: Sequence[Mapping[str, object]]) -> DataFrame:
    """Drop the runs that contain one of the partial assignments."""
    if not entries:
        return runs
    hit = any_of([all_of([col(k).eqNullSafe(F.lit(v)) for k, v in e.items()]) for e in entries])
    return runs.filter(~hit)


def exclude_rows(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Table form: a missing value in an exclusion row matches every level."""
    names = [c for c in entries.columns if c in runs.columns]
    flags = [col(n).isNotNull() for n in names]
    # one equality anti join per set of columns that exclusions use, so no pairwise comparison is needed
    patterns = entries.select(F.array(*flags).alias("p")).distinct().collect()
    kept = runs
    for row in patterns:
        used = [n for n, on in zip(names, row["p"], strict=True) if on]
        same = [f if on else ~f for f, on in zip(flags, row["p"], strict=True)]
        part = entries.filter(all_of(same)).select(*[col(n) for n in used])
        if not used:
            return runs.limit(0)
        kept = kept.join(part, used, "left_anti")
    return kept


def renumber(runs: DataFrame, order, out: str = "run") -> DataFrame:
    """Dense run numbers in the given order."""
    return positions(runs, [], order, out)


# ---------------------------------------------------------------- jobs

def job_table(runs: DataFrame, suite: str, suite_id: str, n_repetitions: int | Column = 1) -> DataFrame:
    """One row per run and repetition, identified by the five job keys."""
    n = F.lit(n_repetitions) if isinstance(n_repetitions, int) else n_repetitions
    reps = F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)))
    rest = [c for c in runs.columns if c not in ("exp_name", "run")]
    keyed = runs.select(
        F.lit(suite).alias("suite"), F.lit(str(suite_id)).alias("suite_id"), col("exp_name"),
        col("run").alias("exp_run"), reps.alias("exp_run_rep"), *[col(c) for c in rest])
    return keyed


def job_schedule(jobs: DataFrame, hosts: DataFrame, commands: str = "commands", on: Sequence[str] = ("exp_name",),
                 host_no: str = "host_no", runner: str = "runner") -> DataFrame:
    """One row per job and host of its experiment with the command of that host.

    ``commands`` is an array with one mapping per host. Hosts with background commands are started by a runner.
    """
    both = jobs.join(broadcast_if_small(hosts), list(on), "inner")
    entry = F.get(col(commands), col(host_no).cast("int"))
    command = F.when(F.size(entry) > 1, F.concat_ws(" ", F.lit(runner), col(host_no).cast("string"))).otherwise(
        F.try_element_at(entry, F.lit("main")))
    return both.withColumn("exp_run_cmd", command).drop(commands)


def command_list(runs: DataFrame, host_types: Sequence[str], keys: Sequence[str] = ("exp_name", "run")) -> DataFrame:
    """One row per run, host and command name."""
    entries = F.array(*[
        F.struct(F.lit(t).alias("host_type"), col(f"{COMMAND}.{t}").alias("hosts")) for t in host_types])
    hosts = runs.select(*[col(k) for k in keys], F.inline(entries))
    each = hosts.select(*[col(k) for k in keys], "host_type", F.posexplode("hosts").alias("host_idx", "entry"))
    return each.select(*[col(k) for k in keys], "host_type", "host_idx", F.explode("entry").alias("name", "command"))


def run_configs_json(runs: DataFrame, keys: Sequence[str] = ("exp_name", "run")) -> DataFrame:
    """Run configurations as JSON text with sorted names."""
    names = sorted(c for c in runs.columns if c not in keys)
    return runs.select(*[col(k) for k in keys], F.to_json(F.struct(*[col(n) for n in names])).alias("config"))

