"""Result trees: ``<suite>_<id>/<experiment>/run_<n>/rep_<n>/<host type>/host_<n>/<file>``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import any_of, col

JOB_KEYS = ["suite_name", "suite_id", "exp_name", "run", "rep"]
FILE_KEYS = [*JOB_KEYS, "host_type", "host_idx", "source_file"]

# fixed values: folder names of a result tree
RUN, REP = "run_", "rep_"


def plain_path(path: Column) -> Column:
    """The path without URL encoding."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def trailing_number(name: Column) -> Column:
    """``run_3`` gives 3."""
    return F.regexp_extract(name, r"_(\d+)$", 1).cast("int")


def split_folder(folder: Column) -> tuple[Column, Column]:
    """Suite and id of a folder name; the id is the part after the last underscore."""
    suite = F.regexp_extract(folder, r"^(.*)_([^_]*)$", 1)
    suite_id = F.regexp_extract(folder, r"^(.*)_([^_]*)$", 2)
    bad = F.raise_error(F.concat(F.lit("folder name has no suite: "), folder)).cast("string")
    return F.when(suite == "", bad).otherwise(suite), suite_id


def folder_name(suite: Column, suite_id: Column) -> Column:
    return F.concat_ws("_", suite, suite_id)


def job_path(base: Column, suite: Column, suite_id: Column, exp: Column, run: Column, rep: Column) -> Column:
    """Working directory of a job."""
    return F.concat_ws("/", base, folder_name(suite, suite_id), exp,
                       F.concat(F.lit("run_"), run.cast("string")), F.concat(F.lit("rep_"), rep.cast("string")))


def _numbered(name: Column, prefix: str) -> Column:
    """The number in ``run_3``; NULL for other names, an error for a number that is too large."""
    return F.when(name.rlike(f"^{re.escape(prefix)}[+-]?[0-9]+$"), F.substring(name, len(prefix) + 1, 1_000).cast("int"))


def _keys(parts: Column, below: int, with_host: bool) -> Column:
    """Keys from the path elements, counted from the end of the path."""
    def part(from_end: int) -> Column:
        return F.try_element_at(parts, F.lit(-from_end))

    folder = part(below + 4)
    suite_id = F.substring_index(folder, "_", -1)
    keys = [
        F.left(folder, F.length(folder) - F.length(suite_id) - 1).alias("suite_name"), suite_id.alias("suite_id"),
        part(below + 3).alias("exp_name"), _numbered(part(below + 2), RUN).alias("run"),
        _numbered(part(below + 1), REP).alias("rep"),
    ]
    if with_host:
        digits = F.regexp_extract(part(2), r"(\d+)$", 1)
        number = F.when(digits != "", digits.cast("int"))
        keys += [part(3).alias("host_type"), number.alias("host_idx"), part(1).alias("source_file")]
    return F.struct(*keys)


def _with_keys(df: DataFrame, path: str, below: int, with_host: bool) -> DataFrame:
    # the path is split once per row; the explosion keeps the later filter from repeating the split
    parts = F.array(F.split(col(path), "/"))
    keyed = df.select("*", F.inline(F.transform(parts, lambda p: _keys(p, below, with_host))))
    needed = ["run", "rep", *(["host_idx"] if with_host else [])]
    present = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in needed])
    return keyed.filter(present & (F.col("suite_name") != "") & (F.col("suite_id") != ""))


def with_job_keys(df: DataFrame, path: str = "path", below: int = 1) -> DataFrame:
    """Job keys of files ``below`` path elements under a repetition folder; other paths are dropped."""
    return _with_keys(df, path, below, with_host=False)


def with_file_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Job keys, host type, host number and file name of result files; other paths are dropped."""
    return _with_keys(df, path, below=3, with_host=True)


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """Does the name match a pattern, anchored at its start only."""
    return any_of([name.rlike(f"^(?:{p})") for p in patterns])


def suite_paths(root: str, suite: str, suite_id: str, experiments: Sequence[str] | None = None) -> list[str]:
    """Folders to scan: naming the experiments keeps Spark from listing the others; absent ones are left out."""
    base = f"{root.rstrip('/')}/{suite}_{suite_id}"
    return [base] if experiments is None else [f"{base}/{{{','.join(experiments)}}}"]


def scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files below some folders: ``path, name, length, content``, listed once.

    The content of a file is only read where it is asked for, and files that a filter on the name leaves out are not
    opened. Files of length zero do not appear.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(plain_path(F.col("_metadata.file_path")).alias("path"),
                        F.col("_metadata.file_name").alias("name"), "length", "content")


def texts(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Whole files with matching names as ``(path, content)``."""
    return files.filter(matches_any(F.col("name"), patterns)).select("path", F.col("content").cast("string").alias("content"))


def documents(spark: SparkSession, paths: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Whole files below some folders as ``(path, content)``; files of other names are not opened."""
    return texts(scan(spark, paths), patterns)


def file_list(files: DataFrame) -> DataFrame:
    """Names and sizes of scanned files without their content."""
    return files.select("path", "length")
