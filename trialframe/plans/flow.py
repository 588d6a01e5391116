"""Declarative flows: extract, transform, load steps given as nested configuration.

A flow names its experiments, the extractors for their files, an ordered list of transformers and the loaders of the
final frame. Building a flow only stacks DataFrame operations; loaders are the actions.
"""

from __future__ import annotations

import copy
import json
import re
import warnings
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from inspect import signature

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import as_list, broadcast_if_small, col
from trialframe.operators import aggregate as agg
from trialframe.operators import transforms as tf
from trialframe.operators import verbs
from trialframe.plans.design import factor_columns
from trialframe.plans.layout import Hooks, chart_tables
from trialframe.session import cut
from trialframe.sinks import writers
from trialframe.sources import formats as fm
from trialframe.sources.results import extract
from trialframe.sources.tree import FILE_KEYS

SUITE_IDS, FLOWS, DEFAULT = "$SUITE_ID$", "$ETL$", "$DEFAULT$"
INCLUDE_ALL, INCLUDE_STEPS, VARS = "$INCLUDE_PIPELINE$", "$INCLUDE_STEPS$", "$ETL_VARS$"
SOURCES = ("suite", "config", "template")


# ---------------------------------------------------------------- steps

@dataclass
class Registry:
    """Step names and what they run; a name can be registered once."""

    extractors: dict[str, Callable] = field(default_factory=dict)
    transformers: dict[str, Callable] = field(default_factory=dict)
    loaders: dict[str, Callable] = field(default_factory=dict)
    readers: dict[str, Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, step: Callable, reader: Callable | None = None) -> None:
        """``kind`` is extractor, transformer or loader; an extractor of one's own brings its reader.

        A reader is called with the documents, the extractor with its options, and the run configurations.
        """
        known = getattr(self, kind + "s")
        if name in known:
            raise ValueError(f"duplicate {kind}: {name}")
        known[name] = step
        if reader is not None:
            self.readers[name] = reader

    def copy(self) -> Registry:
        return Registry(dict(self.extractors), dict(self.transformers), dict(self.loaders), dict(self.readers))


def conditional(df, col, dest, value):
    return tf.conditional_replace(df, col, dest, value)


def rep_agg(df, data_columns, ignore_columns=(), agg_functions=tuple(agg.DEFAULT_FUNCTIONS), order_by=None):
    return agg.rep_aggregate(df, data_columns, ignore_columns, agg_functions, order_by=order_by or frame_order(df))


def group_agg(df, data_columns, groupby_columns, agg_functions=tuple(agg.DEFAULT_FUNCTIONS), custom_tail_length=5,
              order_by=None):
    return agg.group_aggregate(df, data_columns, groupby_columns, agg_functions, custom_tail_length,
                               order_by=order_by or frame_order(df))


def filter_column(df, filters=None, allow_empty_result=False):
    return tf.filter_equal(df, filters or {}, allow_empty_result)


@dataclass(frozen=True)
class LoadInfo:
    """Where a loader writes and for which flow."""

    flow: str
    folder: str | None


def load_csv(df, info, skip_empty=False, order_by=None):
    writers.write_csv(df, f"{info.folder}/{info.flow}.csv", skip_empty, as_list(order_by))


def load_table(df, info, skip_empty=False, order_by=None):
    writers.write_table(agg.hashable(df), f"{info.folder}/{info.flow}.parquet", skip_empty, order_by=as_list(order_by))


def load_latex(df, info, skip_empty=False, order_by=None):
    writers.write_latex(df, f"{info.folder}/{info.flow}.tex", order_by or frame_order(df) or df.columns, skip_empty)


def chart_loader(hooks: Hooks = Hooks()) -> Callable:
    """The chart loader with callbacks of one's own; register it under a name that flows use."""
    def load_charts(df, info, metrics, cum_subplot_config, cum_plot_config=(), fig_foreach=None, data_filter=None):
        if df.isEmpty():
            return
        tables = chart_tables(df, {"metrics": metrics, "cum_subplot_config": cum_subplot_config,
                                   "cum_plot_config": cum_plot_config, "fig_foreach": fig_foreach,
                                   "data_filter": data_filter}, hooks)
        writers.write_chart_tables(tables, info.folder)

    return load_charts


STANDARD = Registry(
    extractors={
        "JsonExtractor": fm.JsonFiles, "YamlExtractor": fm.YamlFiles, "CsvExtractor": fm.CsvFiles,
        "ErrorExtractor": fm.ErrorFiles, "IgnoreExtractor": fm.IgnoredFiles,
    },
    transformers={
        "ConditionalTransformer": conditional, "RepAggTransformer": rep_agg, "GroupByAggTransformer": group_agg,
        "FilterColumnTransformer": filter_column,
    },
    loaders={
        "CsvSummaryLoader": load_csv, "PickleSummaryLoader": load_table, "LatexTableLoader": load_latex,
        "ColumnCrossPlotLoader": chart_loader(),
    },
)


def frame_order(df) -> list[str] | None:
    """The order of a results table: its job and file keys."""
    if not isinstance(df, DataFrame):
        df = df.df if hasattr(df, "df") else getattr(df, "source", None)
    present = [k for k in FILE_KEYS if isinstance(df, DataFrame) and k in df.columns]
    return present or None


def _options(step: Callable, given: Mapping, reserved: Sequence[str], what: str) -> dict:
    known = [p for p in signature(step).parameters if p not in reserved]
    unknown = [k for k in given if k not in known]
    if unknown:
        raise ValueError(f"{what}: unknown options {unknown}, known are {known}")
    return dict(given)


def transform_step(step: Mapping, registry: Registry = STANDARD) -> Callable:
    """One configured step as a function from frame to frame."""
    if "name" in step:
        name = step["name"]
        if name not in registry.transformers:
            raise ValueError(f"transformer not found: {name}")
        f = registry.transformers[name]
        options = _options(f, {k: v for k, v in step.items() if k != "name"}, ["df"], name)
        return lambda df: f(df, **options)
    if len(step) == 1:
        (name, options), = step.items()
        verb = name.removeprefix("df.")
        if not name.startswith("df.") or verb not in verbs.VERBS:
            raise ValueError(f"transformer not found: {name}")
        return _verb_step(verb, dict(options or {}))
    raise ValueError(f"transformer with illegal format: {dict(step)}")


def _verb_step(verb: str, options: dict) -> Callable:
    f = verbs.VERBS[verb]
    options = {k: v for k, v in options.items() if k not in ("ignore_index", "inplace", "axis")}
    needs_order = "order_by" in signature(f).parameters

    def run(obj):
        given = dict(options)
        if needs_order and "order_by" not in given:
            default = frame_order(obj)
            if default:
                given["order_by"] = default
        return f(obj, **given)

    return run


# ---------------------------------------------------------------- configuration

def from_design(suite: str, suite_id, design: Mapping) -> dict:
    """The flows of one suite design in the form for several suites."""
    flows = copy.deepcopy(dict(design.get(FLOWS, {})))
    names = [k for k in design if not k.startswith("$")]
    for body in flows.values():
        wanted = body.get("experiments", "*")
        body["experiments"] = {suite: names if wanted == "*" else list(wanted)}
    return {SUITE_IDS: {suite: suite_id}, FLOWS: flows}


def _included(source: Mapping, sources: Mapping[str, Mapping[str, Mapping]]) -> dict:
    given = [k for k in SOURCES if source.get(k) is not None]
    if len(given) != 1 or set(source) - {*SOURCES, "pipeline"}:
        raise ValueError(f"an include names exactly one of {SOURCES} and a pipeline: {dict(source)}")
    kind = given[0]
    try:
        body = sources[kind][source[kind]][FLOWS][source["pipeline"]]
    except KeyError as e:
        raise ValueError(f"include source not found: {dict(source)}") from e
    return resolve_includes(body, sources)


def resolve_includes(body: Mapping, sources: Mapping[str, Mapping[str, Mapping]]) -> dict:
    """Insert included flows and stages."""
    body = copy.deepcopy(dict(body))
    whole = body.pop(INCLUDE_ALL, None)
    if whole is not None:
        if any(body.get(k) for k in ("extractors", "transformers", "loaders")):
            raise ValueError("a flow that is included as a whole cannot have steps of its own")
        body |= {k: v for k, v in _included(whole, sources).items() if k != "experiments"}
    for stage in ("extractors", "loaders"):
        steps = dict(body.get(stage) or {})
        for source in steps.pop(INCLUDE_STEPS, []):
            steps |= _included(source, sources).get(stage, {})
        body[stage] = steps
    steps = []
    for step in body.get("transformers") or []:
        steps += _included(step[INCLUDE_STEPS], sources)["transformers"] if INCLUDE_STEPS in step else [step]
    body["transformers"] = steps
    return body


def resolve_variables(body: Mapping) -> dict:
    """Fill ``[% NAME %]`` in the options of all steps from ``$ETL_VARS$``."""
    body = dict(body)
    variables = body.pop(VARS, None)
    if not variables:
        return body
    pattern = re.compile(r"\[%\s*(\w+)\s*%\]")

    def fill(text: str) -> str:
        for _ in range(50):
            names = pattern.findall(text)
            if not names:
                return text
            missing = [n for n in names if n not in variables]
            if missing:
                raise KeyError(f"undefined flow variables {missing}")
            text = pattern.sub(lambda m: json.dumps(str(variables[m.group(1)]))[1:-1], text)
        raise ValueError("flow variables refer to each other without end")

    return {k: json.loads(fill(json.dumps(v))) if k in ("extractors", "transformers", "loaders") else v
            for k, v in body.items()}


def check_flow(name: str, body: Mapping, registry: Registry = STANDARD) -> None:
    """Unknown fields, steps and options are errors."""
    extra = set(body) - {"experiments", "extractors", "transformers", "loaders"}
    if extra:
        raise ValueError(f"flow {name}: unknown fields {sorted(extra)}")
    for step, options in body["extractors"].items():
        if step not in registry.extractors:
            raise ValueError(f"extractor not found: {step}")
        _options(registry.extractors[step], options or {}, [], step)
    for step in body["transformers"]:
        transform_step(step, registry)
    for step, options in body["loaders"].items():
        if step not in registry.loaders:
            raise ValueError(f"loader not found: {step}")
        _options(registry.loaders[step], options or {}, ["df", "info"], step)


def check_experiments(wanted, available: Sequence[str]) -> list[str]:
    """``*`` means all; unknown experiments are an error."""
    if wanted == "*":
        return list(available)
    missing = [e for e in wanted if e not in available]
    if missing:
        raise ValueError(f"non-existing experiments: {missing}")
    return list(wanted)


def keep_experiments(design: Mapping, pattern: str) -> dict:
    """Only the experiments that match; flows that lose all their experiments are removed."""
    fits = re.compile(pattern).match
    kept = {k: v for k, v in design.items() if k.startswith("$") or fits(k)}
    names = [k for k in kept if not k.startswith("$")]
    flows = {}
    for flow, body in (design.get(FLOWS) or {}).items():
        wanted = body["experiments"]
        left = names if wanted == "*" else [e for e in wanted if e in names]
        if left:
            flows[flow] = {**body, "experiments": wanted if wanted == "*" else left}
    if FLOWS in kept:
        kept[FLOWS] = flows
    return kept


def keep_flows(spec: Mapping, names: Sequence[str]) -> dict:
    missing = [n for n in names if n not in spec[FLOWS]]
    if missing:
        raise ValueError(f"flows not found: {missing}")
    return {**spec, FLOWS: {k: v for k, v in spec[FLOWS].items() if k in names}}


def experiment_ids(suite: str, experiments: Sequence[str], ids: Mapping) -> dict[str, str]:
    """Suite id of each experiment: its own, else the default, else the suite-wide one."""
    given = ids[suite]
    if isinstance(given, Mapping):
        found = {e: given.get(e, given.get(DEFAULT)) for e in experiments}
        missing = [e for e, v in found.items() if v is None]
        if missing:
            raise ValueError(f"no suite id for experiments {missing} of {suite}")
        return {e: str(v) for e, v in found.items()}
    return {e: str(given) for e in experiments}


def resolve_ids(experiments: DataFrame, specific: DataFrame, defaults: DataFrame) -> DataFrame:
    """Table form: experiments with ids of their own or the default of their suite; a missing id is an error."""
    own = specific.select("suite", "exp_name", F.col("suite_id").alias("__own"))
    default = defaults.select("suite", F.col("suite_id").alias("__default"))
    both = experiments.join(broadcast_if_small(own), ["suite", "exp_name"], "left").join(
        broadcast_if_small(default), "suite", "left")
    none = F.raise_error(F.concat(F.lit("no suite id for "), col("suite"), F.lit("/"), col("exp_name")))
    return both.withColumn("suite_id", F.coalesce("__own", "__default", none.cast("string"))).drop("__own", "__default")


def kept_flows_table(flows: DataFrame, experiments: DataFrame, pattern: str) -> DataFrame:
    """Table form of :func:`keep_experiments`: flow rows whose experiment matches."""
    kept = experiments.filter(col("exp_name").rlike(f"^(?:{pattern})")).select("exp_name").distinct()
    return flows.join(kept, "exp_name", "left_semi")


# ---------------------------------------------------------------- running

def transform(df: DataFrame, steps: Sequence[Mapping], registry: Registry = STANDARD, until: str | None = None):
    """Apply the steps in order; with ``until`` stop before the named one."""
    for step in steps:
        if until is not None and (step.get("name") == until or until in step):
            return df
        df = transform_step(step, registry)(df)
    return df


def load(df: DataFrame, loaders: Mapping[str, Mapping], info: LoadInfo, registry: Registry = STANDARD) -> None:
    """Run all loaders on the frame; it is written to the shared folder first if several of them read it."""
    if len(loaders) > 1:
        df = cut(df)
    for name, options in loaders.items():
        registry.loaders[name](df, info, **dict(options or {}))


def prepare(spec: Mapping, sources: Mapping | None = None, registry: Registry = STANDARD,
            only: Sequence[str] | None = None, suite_ids: Mapping | None = None) -> dict:
    """Includes, variables and checks; ``suite_ids`` replaces the ids and drops suites that are not in it."""
    spec = copy.deepcopy(dict(spec))
    if suite_ids is not None:
        spec[SUITE_IDS] = dict(suite_ids)
        for body in spec[FLOWS].values():
            body["experiments"] = {s: e for s, e in body["experiments"].items() if s in suite_ids}
    if only is not None:
        spec = keep_flows(spec, only)
    for name, body in spec[FLOWS].items():
        body = resolve_variables(resolve_includes(body, sources or {}))
        check_flow(name, body, registry)
        spec[FLOWS][name] = body
    return spec


def results_frame(spark: SparkSession, root: str, body: Mapping, ids: Mapping, designs: Mapping[tuple, Mapping],
                  registry: Registry = STANDARD) -> DataFrame | None:
    """Union of the results tables of all experiments of a flow, or None without any results."""
    extractors = {n: registry.extractors[n](**dict(o or {})) for n, o in body["extractors"].items()}
    frames = []
    for suite, wanted in body["experiments"].items():
        names = as_list(wanted) if wanted != "*" else None
        if names is None:
            names = [k for k in _design_of(designs, suite, ids) if not k.startswith("$")]
        per_id: dict[str, list[str]] = {}
        for experiment, suite_id in experiment_ids(suite, names, ids).items():
            per_id.setdefault(suite_id, []).append(experiment)
        for suite_id, experiments in per_id.items():
            design = designs[(suite, suite_id)]
            check_experiments(experiments, [k for k in design if not k.startswith("$")])
            factors = {e: factor_columns(design[e]) for e in experiments}
            try:
                df = extract(spark, root, suite, suite_id, experiments, extractors, factors, registry.readers)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue  # none of these experiments has results yet
            if df is not None:
                frames.append(df)
    return tf.union_by_name(frames) if frames else None


def _extraction(body: Mapping) -> str:
    """What a flow reads: its experiments and extractors."""
    return json.dumps([body["experiments"], body["extractors"]], sort_keys=True, default=str)


def _design_of(designs: Mapping[tuple, Mapping], suite: str, ids: Mapping) -> Mapping:
    given = ids[suite]
    chosen = given.get(DEFAULT, next(iter(given.values()))) if isinstance(given, Mapping) else given
    return designs[(suite, str(chosen))]


def load_designs(spark: SparkSession, root: str, ids: Mapping) -> dict[tuple, Mapping]:
    """Stored designs of the suite runs that a specification names (small files, one per suite run)."""
    wanted = {(s, str(i)) for s, g in ids.items() for i in (g.values() if isinstance(g, Mapping) else [g])}
    found = {}
    for suite, suite_id in sorted(wanted):
        path = f"{root.rstrip('/')}/{suite}_{suite_id}/suite_design.yml"
        row = spark.read.text(path, wholetext=True).first()
        found[(suite, suite_id)] = fm.load_yaml(row["value"])
    return found


def run(
    spark: SparkSession,
    spec: Mapping,
    root: str,
    output: str | None = None,
    config_name: str | None = None,
    sources: Mapping | None = None,
    only: Sequence[str] | None = None,
    suite_ids: Mapping | None = None,
    return_frames: bool = False,
    until: str | None = None,
    registry: Registry = STANDARD,
) -> dict[str, DataFrame]:
    """Run the flows of a specification over a result tree.

    With ``return_frames`` the transformed frames are returned and nothing is written; ``until`` stops before a step.
    """
    spec = prepare(spec, sources, registry, only, suite_ids)
    designs = load_designs(spark, root, spec[SUITE_IDS])
    frames, extracted = {}, {}
    wanted = Counter(_extraction(body) for body in spec[FLOWS].values())
    for name, body in spec[FLOWS].items():
        key = _extraction(body)
        if key not in extracted:
            df = results_frame(spark, root, body, spec[SUITE_IDS], designs, registry)
            # flows over the same files share one pass over them
            extracted[key] = cut(df) if df is not None and wanted[key] > 1 else df
        df = extracted[key]
        if df is None:
            warnings.warn(f"flow {name} skipped: no results yet", stacklevel=2)
            continue
        out = transform(df, body["transformers"], registry, until)
        frames[name] = out
        if not return_frames and until is None:
            folder = writers.output_folder(output, config_name, name) if output else None
            load(out, body["loaders"], LoadInfo(name, folder), registry)
    return frames


def run_design(spark: SparkSession, root: str, suite: str, suite_id, output: str | None = None, **options):
    """Run the flows that a suite's own stored design contains."""
    design = load_designs(spark, root, {suite: suite_id})[(suite, str(suite_id))]
    output = output or f"{root.rstrip('/')}/{suite}_{suite_id}/etl_results"
    return run(spark, from_design(suite, suite_id, design), root, output, **options)
