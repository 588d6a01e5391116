"""Catalog of suite runs, their designs and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.sources.formats import yaml_records
from trialframe.sources.tree import plain_path, split_folder

# fixed values: the id lists of a job-state file and the state they stand for
STATE_LISTS = {
    "exp_job_ids": "all",
    "exp_job_ids_unfinished": "unfinished",
    "exp_job_ids_pending": "pending",
    "exp_job_ids_queued": "queued",
    "exp_job_ids_running": "running",
    "exp_job_ids_finished": "finished",
}
JOB_ID = "struct<suite: string, suite_id: string, exp_name: string, exp_run: bigint, exp_run_rep: bigint>"
ERROR_MARKER = "ETL_ERROR.log"


def files_below(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths of the files that a glob names."""
    found = spark.read.format("binaryFile").load(pattern)
    return found.select(plain_path(F.col("_metadata.file_path")).alias("path"))


def _suite_folder(path: Column, below: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+)/{below}$", 1)


def suite_runs(paths: DataFrame, below: str = r"[^/]+") -> DataFrame:
    """Distinct suite runs of a list of paths, with a flag whether the id is a number."""
    folder = paths.select(_suite_folder(F.col("path"), below).alias("folder")).filter(F.col("folder") != "").distinct()
    suite, suite_id = split_folder(F.col("folder"))
    runs = folder.select("folder", suite.alias("suite"), suite_id.alias("suite_id"))
    return runs.withColumn("id_is_number", F.col("suite_id").rlike(r"^[+-]?\d+$"))


def without_expected(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("suite_id") != "$expected")


def design_experiments(designs: DataFrame) -> DataFrame:
    """Experiments named by each suite design (keys that do not start with ``$``)."""
    records = yaml_records(designs)
    keys = F.json_object_keys(F.to_json("record"))
    kept = [c for c in designs.columns if c != "content"]
    return records.select(*[col(c) for c in kept], F.explode(keys).alias("exp_name")).filter(
        ~F.col("exp_name").startswith("$"))


def result_experiments(folders: DataFrame, designed: DataFrame) -> DataFrame:
    """Experiment folders that the design of the same suite run knows."""
    return folders.join(designed, ["suite", "suite_id", "exp_name"], "left_semi")


def design_factors(designs: DataFrame) -> DataFrame:
    """Factor names per suite run and experiment, in the order of the design.

    A factor is marked by ``$FACTOR$`` as a value, or as a key that holds the list of levels.
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    from trialframe.sources.formats import load_yaml, spread

    def walk(node, path=()):
        for key, value in node.items():
            here = (*path, str(key))
            if isinstance(value, dict):
                yield from walk(value, here)
            else:
                yield here, value

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, suite_id, text in zip(batch["suite_name"], batch["suite_id"], batch["content"], strict=True):
                for exp, body in (load_yaml(text) or {}).items():
                    if str(exp).startswith("$") or "base_experiment" not in body:
                        continue
                    for i, (path, value) in enumerate(walk(body["base_experiment"])):
                        rows.append((name, suite_id, exp, i, list(path), json.dumps(value, default=str)))
            yield pd.DataFrame(rows, columns=["suite_name", "suite_id", "exp_name", "place", "path", "value"])

    paths = spread(designs).mapInPandas(
        parse, "suite_name string, suite_id string, exp_name string, place int, path array<string>, value string")
    return factor_names(paths, ["suite_name", "suite_id", "exp_name"])


def factor_names(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Factor columns from design paths ``(keys, place, path, value as JSON)``."""
    last = F.element_at("path", -1)
    inline = last == "$FACTOR$"
    listed = F.col("value") == '"$FACTOR$"'
    name = F.when(inline, F.array_join(F.slice("path", 1, F.size("path") - 1), ".")).otherwise(
        F.array_join("path", "."))
    marked = paths.filter(inline | listed).select(*[col(k) for k in keys], "place", name.alias("factor"))
    listed_up = F.sort_array(F.collect_list(F.struct("place", "factor")))  # bounded by the columns of one design
    return marked.groupBy(*[col(k) for k in keys]).agg(
        F.transform(listed_up, lambda s: s["factor"]).alias("factor_columns"))


def job_states(states: DataFrame) -> DataFrame:
    """Job ids of state documents: one row per list and job."""
    lists = F.array(*[
        F.struct(F.lit(label).alias("state"),
                 F.try_variant_get("record", f"$.{name}", f"array<{JOB_ID}>").alias("ids"))
        for name, label in STATE_LISTS.items()
    ])
    rows = yaml_records(states).select(F.inline(lists)).select("state", F.explode("ids").alias("id"))
    return rows.select("state", "id.suite", "id.suite_id", "id.exp_name", "id.exp_run", "id.exp_run_rep")


def mark_failed(runs: DataFrame, markers: DataFrame) -> DataFrame:
    """Add ``etl_failed``: is there an error marker in the folder of the suite run?"""
    failed = markers.select(_suite_folder(F.col("path"), ERROR_MARKER.replace(".", r"\.")).alias("folder")).distinct()
    flagged = runs.join(failed.withColumn("etl_failed", F.lit(True)), "folder", "left")
    return flagged.withColumn("etl_failed", F.coalesce("etl_failed", F.lit(False)))
