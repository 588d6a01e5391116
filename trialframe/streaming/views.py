"""Aggregates over result files that come, change and vanish, kept up to date from the files that did.

Every file leaves mergeable partial states (rows, count, total, squared deviations, least and greatest value) per group. A
refresh lists the folder and reads only files that are new or changed. Groups that only gain files merge the new states into
their row of the view; groups that lose one, because it changed or is gone, are merged anew from the states that still hold.
Nothing is subtracted, so least and greatest values can be taken back and deviations lose no digits.

The state lies in a shared folder. A refresh writes a version of its own and counts once its list of files is complete; one that
fails changes nothing and may be run again. Refreshes of one state must not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import col, key_struct
from trialframe.session import cut
from trialframe.sources.tree import plain_path

#: every so many versions the whole view is written, and readers begin there
FOLD = 20
STATE = "struct<n: bigint, total: double, m2: double, low: double, high: double>"

FINISH: dict[str, Callable[[Column], Column]] = {
    "count": lambda s: s["n"],
    "sum": lambda s: F.coalesce(s["total"], F.lit(0.0)),
    "mean": lambda s: F.try_divide(s["total"], s["n"]),
    "min": lambda s: s["low"],
    "max": lambda s: s["high"],
    "var": lambda s: F.try_divide(s["m2"], s["n"] - 1),
    "std": lambda s: F.sqrt(F.try_divide(s["m2"], s["n"] - 1)),
    "sem": lambda s: F.sqrt(F.try_divide(F.try_divide(s["m2"], s["n"] - 1), s["n"])),
}


def parquet_rows(spark: SparkSession, schema: T.StructType) -> Callable[[list[str]], DataFrame]:
    """Reader of Parquet files that tells each row's ``path``."""
    return lambda paths: spark.read.schema(schema).parquet(*paths).select("*", plain_path(F.col("_metadata.file_path")).alias("path"))


def refresh(spark: SparkSession, folder: str, state: str, read: Callable[[list[str]], DataFrame], schema: T.StructType,
            keys: Sequence[str], data_columns: Sequence[str], functions: Sequence[str], names: str = "*") -> DataFrame:
    """Take up what changed below ``folder`` since the last refresh of ``state`` and return the whole aggregate.

    ``read`` turns paths into rows with the fields of ``schema`` and their ``path``; ``names`` is a glob of file names. Values are
    taken as doubles; missing ones are not counted, groups with a missing key are groups of their own, and groups whose rows
    have all gone are left out. The paths of files to read pass the driver, as they do with any reader.
    """
    unknown = [f for f in functions if f not in FINISH]
    if unknown:
        raise ValueError(f"functions {unknown} have no mergeable state, known are {sorted(FINISH)}")
    done = newest_version(spark, state)
    both = cut(_changes(spark, folder, names, state, done))
    fresh = both.filter(F.col("seen").isNotNull() & ~F.col("seen").eqNullSafe(F.col("known")))
    lost = both.filter(F.col("known").isNotNull() & ~F.col("seen").eqNullSafe(F.col("known"))).select("path", "read_in")
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in fresh.select("path").toLocalIterator()]
    if paths or not lost.isEmpty():
        version = 0 if done is None else done + 1
        states = _states_schema(schema, keys, len(data_columns))
        added = spark.createDataFrame([], states)
        if paths:
            target = f"{state}/partials/version={version}"
            _file_states(read(paths), keys, data_columns).write.mode("overwrite").parquet(target)
            added = spark.read.schema(states).parquet(target)
        view = _view(spark, state, done, states)
        _next_view(spark, state, done, both, lost, added, view, len(data_columns), whole=version % FOLD == 0).write.mode(
            "overwrite").parquet(f"{state}/view/version={version}")
        held = F.when(F.col("seen").eqNullSafe(F.col("known")), F.col("read_in")).otherwise(F.lit(version))
        both.filter(F.col("seen").isNotNull()).select("path", "seen.*", held.cast("long").alias("read_in")).write.mode(
            "overwrite").parquet(f"{state}/files/version={version}")
    return read_view(spark, state, schema, keys, data_columns, functions)


def read_view(spark: SparkSession, state: str, schema: T.StructType, keys: Sequence[str], data_columns: Sequence[str],
              functions: Sequence[str]) -> DataFrame:
    """The aggregate as of the last refresh: the keys and ``<column>_<function>``."""
    rows = _view(spark, state, newest_version(spark, state), _states_schema(schema, keys, len(data_columns)))
    return rows.filter("size > 0").select(
        *[F.col("key")[f"k{i}"].alias(k) for i, k in enumerate(keys)],
        *[FINISH[f](F.col(f"c{i}")).alias(f"{c}_{f}") for i, c in enumerate(data_columns) for f in functions])


def newest_version(spark: SparkSession, state: str) -> int | None:
    """The last version whose list of files was written to its end."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/files/version=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def _states_schema(schema: T.StructType, keys: Sequence[str], columns: int) -> T.StructType:
    key = T.StructType([T.StructField(f"k{i}", schema[k].dataType) for i, k in enumerate(keys)])
    one = T.StructType.fromDDL(f"c {STATE}")["c"].dataType
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("key", key), T.StructField("size", T.LongType()),
                         *[T.StructField(f"c{i}", one) for i in range(columns)]])


def _changes(spark: SparkSession, folder: str, names: str, state: str, done: int | None) -> DataFrame:
    """``path, seen, known, read_in``: each file as it is now and as it was; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    now = files.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.struct(
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("length")).alias("seen"))
    if done is None:
        known = spark.createDataFrame([], "path string, modified timestamp, length long, read_in long")
    else:
        known = spark.read.parquet(f"{state}/files/version={done}")
    known = known.select("path", F.struct("modified", "length").alias("known"), "read_in")
    return now.join(known, "path", "full_outer")


def _file_states(rows: DataFrame, keys: Sequence[str], data_columns: Sequence[str]) -> DataFrame:
    """One row per file and group: how many rows, and a state per column."""
    values = {f"v{i}": col(c).cast("double") for i, c in enumerate(data_columns)}
    flat = rows.select("path", key_struct(keys).alias("key"), *[v.alias(name) for name, v in values.items()])
    return flat.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size"), *[
        F.struct(F.count(v).alias("n"), F.sum(v).alias("total"), (F.var_pop(v) * F.count(v)).alias("m2"),
                 F.min(v).alias("low"), F.max(v).alias("high")).alias(f"c{i}") for i, v in enumerate(values)])


def _merged(states: DataFrame, columns: int) -> DataFrame:
    """One row per group; deviations are taken from the mean of the whole group, which is known first."""
    sums = states.groupBy("key").agg(F.sum("size").alias("rows"), *[
        F.struct(F.sum(f"c{i}.n").alias("n"), F.sum(f"c{i}.total").alias("total"), F.min(f"c{i}.low").alias("low"),
                 F.max(f"c{i}.high").alias("high")).alias(f"s{i}") for i in range(columns)])
    both = states.join(sums, "key")

    def state(i: int) -> Column:
        own, all_ = F.col(f"c{i}"), F.first(f"s{i}")
        gap = F.try_divide(own["total"], own["n"]) - F.try_divide(F.col(f"s{i}.total"), F.col(f"s{i}.n"))
        m2 = F.sum(F.when(own["n"] > 0, own["m2"] + own["n"] * gap * gap))
        return F.struct(all_["n"].alias("n"), all_["total"].alias("total"), m2.alias("m2"), all_["low"].alias("low"),
                        all_["high"].alias("high")).alias(f"c{i}")

    return both.groupBy("key").agg(F.first("rows").alias("size"), *[state(i) for i in range(columns)])


def _view(spark: SparkSession, state: str, done: int | None, states: T.StructType) -> DataFrame:
    """The newest state of each group, empty ones included."""
    fields = T.StructType([f for f in states.fields if f.name != "path"])
    if done is None:
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(T.StructType([*fields.fields, T.StructField("version", T.LongType())])).parquet(f"{state}/view")
    rows = rows.filter(F.col("version").between(done // FOLD * FOLD, done))
    rest = [f.name for f in fields.fields if f.name != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("newest")).select("key", "newest.*")


def _next_view(spark: SparkSession, state: str, done: int | None, both: DataFrame, lost: DataFrame, added: DataFrame, view: DataFrame,
               columns: int, whole: bool) -> DataFrame:
    """The rows of the next version: groups that gained or lost a file, or all groups if the view is written whole."""
    fields = ["key", "size", *[f"c{i}" for i in range(columns)]]
    if done is None:
        return _merged(added.select(fields), columns)
    old = spark.read.schema(T.StructType([*added.schema.fields, T.StructField("version", T.LongType())])).parquet(f"{state}/partials")
    old = old.withColumnRenamed("version", "read_in").filter(F.col("read_in") <= done)
    touched = cut(old.join(lost, ["path", "read_in"], "left_semi").select("key").distinct())
    held = both.filter(F.col("seen").eqNullSafe(F.col("known"))).select("path", "read_in")
    left = old.join(touched, "key", "left_semi").join(held, ["path", "read_in"], "left_semi").select(fields)
    # a group that lost its last file stays in the view with no rows
    none = touched.select("key", F.lit(0).cast("long").alias("size"), *[
        F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(x) for x in ("total", "m2", "low", "high")]).alias(f"c{i}")
        for i in range(columns)])
    kept = view.select(fields).join(touched, "key", "left_anti")
    gained = kept if whole else kept.join(added.select("key").distinct(), "key", "left_semi")
    rows = _merged(left.unionByName(none).unionByName(gained).unionByName(added.select(fields)), columns)
    return rows.filter("size > 0") if whole else rows
