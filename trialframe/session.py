"""Session settings and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: paths that each application wrote below its shared folder
_written: dict[str, list[str]] = {}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trialframe")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process gets a temporary one; a cluster, whose machines would each
    see a folder of their own, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.trialframe.sharedFolder", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="trialframe-")
        spark.conf.set("spark.trialframe.sharedFolder", named)
    return named


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to a table in the shared folder once and continue from there.

    Later steps read only the columns they need, and a lost executor costs a re-read instead of a recomputation.
    """
    empty = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({name: F.lit(None).cast("string") for name in empty}) if empty else df
    path = new_shared_path(df.sparkSession, "frame")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_costly(df: DataFrame) -> bool:
    """Does computing the frame move rows between tasks or through Python?"""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(sign in plan for sign in ("Exchange", "InPandas", "InArrow", "ArrowEvalPython", "BatchEvalPython"))


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the tables that are cut meanwhile go as soon as each is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote, once nothing reads it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in [p for p in known if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        known.remove(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that this session wrote to the shared folder; frames that read them end with it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = hadoop.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame) -> DataFrame:
    """A frame that is about to be read several times: written out if it is costly to compute, else unchanged.

    A plain scan is cheaper to read again (each reader prunes its columns) than to copy.
    """
    return cut(df) if is_costly(df) else df
