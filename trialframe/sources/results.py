"""Results table: records joined with the configuration of their run and the factors of their experiment."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import broadcast_if_small, col
from trialframe.functions.flatten import flatten_variant, variant_type
from trialframe.operators.transforms import union_by_name
from trialframe.session import cut
from trialframe.sources import formats as fm
from trialframe.sources.tree import FILE_KEYS, JOB_KEYS, file_list, scan, suite_paths, texts, with_file_keys, with_job_keys

# fixed values: entries of a run configuration that only say what is varied
LEVEL_KEYS = ["$FACTOR_LEVEL", "~FACTORS_LEVEL"]


def run_configs(docs: DataFrame) -> DataFrame:
    """Run configurations: job keys and the configuration as a variant (``config.json`` per repetition)."""
    keyed = with_job_keys(docs.filter(F.col("path").rlike(r"/rep_\d+/config\.json$")))
    return keyed.select(*JOB_KEYS, F.parse_json("content").alias("config"))


def flat_configs(configs: DataFrame, dtype: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """Run configurations as dotted columns, and the names of these columns."""
    flat = flatten_variant(configs, "config", dtype)
    names = [c for c in flat.columns if c not in JOB_KEYS and c.split(".")[0] not in LEVEL_KEYS]
    return flat.select(*JOB_KEYS, *[col(n) for n in names]), names


def records_with_configs(records: DataFrame, configs: DataFrame, record_type: T.StructType | None = None,
                         config_type: T.StructType | None = None) -> DataFrame:
    """Join records with the configuration of their repetition; records without one are left out.

    On equal names the record wins over the configuration and the configuration over the job keys. The types of the
    columns are found by a pass over the data unless they are given.
    """
    flat, names = flat_configs(configs, config_type)
    renamed = flat.select(*JOB_KEYS, *[col(n).alias(f"__config:{n}") for n in names])
    joined = records.join(broadcast_if_small(renamed), JOB_KEYS, "inner")
    found = None
    if "record" in records.columns:
        found = variant_type(records, "record") if record_type is None else record_type
    own = [c for c in records.columns if c not in names and c != "record"]
    merged = joined.select(
        *[col(c) for c in own], *[col(f"__config:{n}").alias(n) for n in names],
        *([col("record").alias("__record")] if found is not None else []))
    return flatten_variant(merged, "__record", found) if found is not None else merged


def with_factor_columns(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Join the factor names of each experiment; ``factors`` has one row per suite run and experiment."""
    return df.join(broadcast_if_small(factors), ["suite_name", "suite_id", "exp_name"], "left")


def extract(
    spark: SparkSession,
    root: str,
    suite: str,
    suite_id: str,
    experiments: Sequence[str],
    extractors: Mapping[str, fm.Extractor],
    factors: Mapping[str, Sequence[str]] | None = None,
    custom: Mapping[str, object] | None = None,
    record_type: str | None = None,
    config_type: str | None = None,
) -> DataFrame | None:
    """The results table of some experiments of one suite run, or None when there are no records.

    ``custom`` maps extractor names to functions ``(documents, extractor, configurations) -> records`` for formats of one's
    own; the extractor holds the options of the flow, the configurations are those of ``run_configs``. Known types of records and
    configurations (as ``a bigint, b struct<...>``) save the passes that find them.
    """
    paths = suite_paths(root, suite, suite_id, experiments)
    files = scan(spark, paths)
    fm.require_coverage(with_file_keys(file_list(files)), dict(extractors))
    whole = {n: e for n, e in extractors.items() if not isinstance(e, (fm.IgnoredFiles, fm.CsvFiles))}
    # many small files are opened once: their texts go to one table, which all later passes read
    content = cut(texts(files, [r"config\.json$", *[p for e in whole.values() for p in e.patterns]]))
    configs = run_configs(content)
    parts = []
    for name, e in extractors.items():
        if isinstance(e, fm.IgnoredFiles):
            continue
        if isinstance(e, fm.CsvFiles):
            part = with_file_keys(fm.csv_records(spark, paths, e))
        else:
            keyed = with_file_keys(content)
            docs = keyed.filter(e.fits(F.col("source_file")))
            if isinstance(e, fm.ErrorFiles):
                # one partition at a time, so that any number of error files can be told
                for row in fm.error_report(docs).select("path", "message").toLocalIterator():
                    warnings.warn(f"error file {row['path']}: {row['message']}", stacklevel=2)
                continue
            if custom and name in custom:
                part = custom[name](docs, e, configs)
            elif isinstance(e, fm.YamlFiles):
                part = fm.yaml_records(docs)
            elif isinstance(e, fm.JsonFiles):
                part = fm.json_records(docs)
            else:
                raise ValueError(f"extractor {name} has no reader")
        parts.append(part.select(*FILE_KEYS, "record"))
    if not parts:
        return None
    records = fm.drop_empty(union_by_name(parts))
    known = {e: list((factors or {}).get(e, [])) for e in experiments}
    by_experiment = F.create_map(*[
        x for e, names in known.items() for x in (F.lit(e), F.array(*[F.lit(n) for n in names]).cast("array<string>"))])
    records = records.withColumn("factor_columns", F.try_element_at(by_experiment, F.col("exp_name")))
    records = records.select(*FILE_KEYS[:-1], "factor_columns", "source_file", "record")
    return records_with_configs(records, configs, record_type and T.StructType.fromDDL(record_type),
                                config_type and T.StructType.fromDDL(config_type))
