"""Results that arrive batch by batch: the same transforms on a file stream.

Aggregates keep their state between batches, so new results update old ones without reading them again. Checkpoints
and outputs live in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trialframe.columns import col
from trialframe.operators.aggregate import SIMPLE
from trialframe.session import new_shared_path
from trialframe.sources.formats import json_records
from trialframe.sources.tree import matches_any, plain_path, with_file_keys


def file_stream(spark: SparkSession, path: str, schema: T.StructType, file_glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def document_stream(spark: SparkSession, pattern: str, names: Sequence[str] = (r".*\.json$",)) -> DataFrame:
    """New result files as ``(path, content)``."""
    files = spark.readStream.text(pattern, wholetext=True, recursiveFileLookup=True)
    kept = files.filter(matches_any(F.col("_metadata.file_name"), names))
    return kept.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))


def record_stream(docs: DataFrame, schema: str) -> DataFrame:
    """Records of a document stream with job keys and the fields of a given schema."""
    records = json_records(with_file_keys(docs))
    fields = F.variant_get("record", "$", f"struct<{schema}>").alias("__r")
    return records.select(*[col(c) for c in records.columns if c not in ("record", "record_no")], fields).select(
        "*", "__r.*").drop("__r", "path")


def aggregate_stream(events: DataFrame, keys: Sequence[str], data_columns: Sequence[str],
                     functions: Sequence[str]) -> DataFrame:
    """Group aggregate over everything seen so far (output mode complete)."""
    return events.groupBy(*[col(k) for k in keys]).agg(
        *[SIMPLE[f](col(c)).alias(f"{c}_{f}") for c in data_columns for f in functions])


def windowed(events: DataFrame, time: str, length: str, keys: Sequence[str], data_columns: Sequence[str],
             functions: Sequence[str], lateness: str | None = None) -> DataFrame:
    """Aggregates per time window; with ``lateness`` a window is final once the watermark passed it."""
    if lateness:
        events = events.withWatermark(time, lateness)
    grouped = events.groupBy(F.window(col(time), length), *[col(k) for k in keys])
    out = grouped.agg(*[SIMPLE[f](col(c)).alias(f"{c}_{f}") for c in data_columns for f in functions])
    return out.withColumn("window_start", F.col("window.start")).drop("window")


def latest_states(events: DataFrame, keys: Sequence[str], order: Sequence[str], state: str = "state") -> DataFrame:
    """Current state per job from a stream of state changes."""
    newest = F.max_by(col(state), F.struct(*[col(o) for o in order]))
    return events.groupBy(*[col(k) for k in keys]).agg(newest.alias(state))


def life_cycles(events: DataFrame, keys: Sequence[str], time: str, moves: Mapping[str | None, Sequence[str]], silence: str,
                lateness: str = "0 seconds", order: Sequence[str] = (), state: str = "state") -> DataFrame:
    """Every step of each job's life as ``(keys, at, before, state, kind)`` (output mode append).

    ``moves`` names the states that may follow a state; those after None begin a life. A change that is allowed is ``moved``;
    any other, one without a state and one older than the last move of an earlier batch are ``refused`` and change nothing. A job
    without a move for longer than ``silence`` (such as ``5 days``) is ``expired`` at that time and may begin anew. Between its
    events a timer on the watermark tells so, and the job's state is dropped; so state is bounded by the jobs that are alive.
    Events without a time or not above the watermark are left out. Events of one batch are taken by time, then by the columns of ``order``; the events of one
    job in one batch are held by one task.
    """
    allowed = {before: frozenset(after) for before, after in moves.items()}
    patience = pd.Timedelta(silence) // pd.Timedelta(microseconds=1)
    fields = [events.schema[k] for k in keys]
    schema = T.StructType([
        *fields, T.StructField("__at", T.LongType()), T.StructField("before", T.StringType()),
        T.StructField("state", T.StringType()), T.StructField("kind", T.StringType())])
    ties = [f"__o{i}" for i in range(len(order))]

    def live(key, frames, held):
        steps = []
        now, since = held.get if held.exists else (None, None)
        if held.hasTimedOut:
            steps.append((since + patience, now, None, "expired"))
            held.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["__us", *ties])
            for at, new in zip(rows["__us"].tolist(), rows["__state"].tolist(), strict=True):
                if now is not None and at > since + patience:
                    steps.append((since + patience, now, None, "expired"))
                    now = None
                if new in allowed.get(now, ()) and (now is None or at >= since):
                    steps.append((at, now, new, "moved"))
                    now, since = new, at
                else:
                    steps.append((at, now, new, "refused"))
            if now is not None and (since + patience) // 1000 <= held.getCurrentWatermarkMs():
                steps.append((since + patience, now, None, "expired"))
                now = None
            if now is not None:
                held.update((now, since))
                held.setTimeoutTimestamp((since + patience) // 1000)
            elif held.exists:
                held.remove()
        yield pd.DataFrame([(*key, *step) for step in steps], columns=schema.names).astype({"__at": "int64"})

    known = events.filter(col(time).isNotNull()).select(
        *[col(k) for k in keys], col(time).cast("timestamp").alias("__time"), *[col(o).alias(t) for o, t in zip(order, ties, strict=True)],
        col(state).alias("__state")).withWatermark("__time", lateness).withColumn("__us", F.unix_micros("__time"))
    steps = known.groupBy(*[col(k) for k in keys]).applyInPandasWithState(
        live, schema, "state string, since bigint", "append", "EventTimeTimeout")
    return steps.select(*[col(k) for k in keys], F.timestamp_micros("__at").alias("at"), "before", "state", "kind")


def guarded(work: Callable[[DataFrame, int], None], errors: str) -> Callable[[DataFrame, int], None]:
    """A batch that fails does not stop the stream; its error is recorded in a table."""
    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            work(batch, batch_id)
        except Exception as e:  # any failure of the analysis is data for the error table
            spark = batch.sparkSession
            row = spark.createDataFrame([(batch_id, type(e).__name__, str(e))],
                                        "batch_id bigint, kind string, message string")
            row.write.mode("append").parquet(errors)

    return run


def start(out: DataFrame, work: Callable[[DataFrame, int], None], mode: str, checkpoint: str,
          every: str | None = None) -> StreamingQuery:
    """Start a stream: over the files present now, or polling for new ones at an interval such as ``5 seconds``."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_available(out: DataFrame, mode: str = "complete", target: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Process all files present, write the result as a table and return it.

    In mode ``complete`` each batch holds the whole result and replaces the version before it; otherwise batches add
    up. A rerun with the same target and checkpoint continues with new files only.
    """
    spark = out.sparkSession
    target = target or new_shared_path(spark, "stream-result")
    checkpoint = checkpoint or new_shared_path(spark, "stream-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{target}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)

    start(out, write, mode, checkpoint).awaitTermination()
    return read_result(spark, target, out.schema, mode)


def read_result(spark: SparkSession, target: str, schema: T.StructType, mode: str) -> DataFrame:
    """The current content of a stream's result table."""
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
    if mode == "complete":
        newest = table.agg(F.max("batch")).first()[0]
        table = table.filter(F.col("batch") == F.lit(newest))
    return table.drop("batch")
