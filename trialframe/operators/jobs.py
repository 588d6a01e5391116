"""Job states, progress and catalog selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.operators.ordered import edge_rows, positions

# fixed values: parts of a job label, in order, and the states a queue reports
LABEL_PARTS = ["suite", "suite_id", "exp_name", "exp_run", "exp_run_rep"]
DONE_STATE = "COMPLETED"
ACTIVE_STATES = ["PENDING", "RUNNING", "COMPLETING"]
UNFINISHED = ["pending", "queued", "running"]


# ---------------------------------------------------------------- labels

def job_label(parts: Sequence[str] = LABEL_PARTS) -> Column:
    """``suite_x__suite_id_y__exp_name_z__exp_run_0__exp_run_rep_0``."""
    return F.concat_ws("__", *[F.concat(F.lit(p + "_"), col(p).cast("string")) for p in parts])


def parse_label(label: Column) -> dict[str, Column]:
    pattern = "^" + "__".join(f"{p}_(.*)" for p in LABEL_PARTS) + "$"
    return {p: F.regexp_extract(label, pattern, i + 1) for i, p in enumerate(LABEL_PARTS)}


# ---------------------------------------------------------------- progress

def progress(states: DataFrame, keys: Sequence[str] = ("suite", "suite_id", "exp_name"),
             state: str = "state") -> DataFrame:
    """Jobs in total, unfinished and finished per experiment; complete when none is unfinished."""
    open_job = col(state).isin(UNFINISHED)
    counted = states.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(open_job).alias("n_jobs_unfinished"),
        F.count_if(col(state) == "finished").alias("n_jobs_finished"),
    )
    return counted.withColumn("is_complete", F.col("n_jobs_unfinished") == 0)


def listed_progress(lists: DataFrame, keys: Sequence[str] = ("suite", "suite_id", "exp_name")) -> DataFrame:
    """The same from the id lists of state files (one row per list entry, labelled by list)."""
    counted = lists.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(F.col("state") == "all").alias("n_jobs"),
        F.count_if(F.col("state") == "unfinished").alias("n_jobs_unfinished"),
        F.count_if(F.col("state") == "finished").alias("n_jobs_finished"),
    )
    return counted.withColumn("is_complete", F.col("n_jobs_unfinished") == 0)


def suite_complete(runs: DataFrame, experiments: DataFrame, keys: Sequence[str] = ("suite", "suite_id")) -> DataFrame:
    """A suite run is complete when all its experiments are; without any state it is incomplete."""
    done = experiments.groupBy(*[col(k) for k in keys]).agg(F.bool_and("is_complete").alias("is_complete"))
    return runs.join(done, list(keys), "left").withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))


def latest_ids(runs: DataFrame, suite: str = "suite", suite_id: str = "suite_id") -> DataFrame:
    """Highest numeric id per suite; other ids are ignored."""
    number = col(suite_id).cast("string").try_cast("bigint")
    return runs.withColumn("__n", number).filter(F.col("__n").isNotNull()).groupBy(col(suite)).agg(
        F.max("__n").alias("last_id"))


def latest_suite(runs: DataFrame, suite: str = "suite", suite_id: str = "suite_id") -> DataFrame:
    """Suite and id of the newest run of all."""
    number = col(suite_id).cast("string").try_cast("bigint")
    return runs.withColumn("__n", number).filter(F.col("__n").isNotNull()).agg(
        F.max_by(col(suite), F.struct("__n", col(suite))).alias(suite), F.max("__n").alias("last_id"))


def removable(runs: DataFrame, suite: str = "suite", suite_id: str = "suite_id",
              complete: str = "is_complete") -> DataFrame:
    """Complete suite runs with a numeric id that are not the latest complete one of their suite."""
    number = col(suite_id).cast("string").try_cast("bigint")
    done = runs.withColumn("__n", number).filter(F.col("__n").isNotNull() & col(complete))
    newest = done.groupBy(col(suite)).agg(F.max("__n").alias("__last"))
    return done.join(newest, suite).filter(F.col("__n") < F.col("__last")).drop("__n", "__last")


def run_counts(runs: DataFrame, pipelines: DataFrame, suite: str = "suite", exp: str = "exp_name") -> DataFrame:
    """Number of runs per experiment and whether its suite has an ETL definition."""
    counted = runs.groupBy(col(suite), col(exp)).agg(F.count(F.lit(1)).alias("n_runs"))
    flagged = pipelines.select(col(suite)).distinct().withColumn("has_etl", F.lit(True))
    return counted.join(flagged, suite, "left").withColumn("has_etl", F.coalesce("has_etl", F.lit(False)))


# ---------------------------------------------------------------- queue snapshots

def classify(jobs: DataFrame, queue: DataFrame, label: str = "label", state: str = "job_state") -> DataFrame:
    """Add ``status``: absent or completed jobs are complete, active ones incomplete, anything else an error."""
    known = queue.select(col(label), col(state)).distinct()
    status = (
        F.when(col(state).isNull() | (col(state) == DONE_STATE), F.lit("complete"))
        .when(col(state).isin(ACTIVE_STATES), F.lit("incomplete")).otherwise(F.lit("error"))
    )
    return jobs.join(known, label, "left").withColumn("status", status)


def no_longer_listed(queued: DataFrame, listed: DataFrame, label: str = "label") -> DataFrame:
    """Queued jobs that the scheduler does not list any more are finished."""
    return queued.join(listed.select(col(label)).distinct(), label, "left_anti")


def finished_known(jobs: DataFrame, tasks: DataFrame, label: str = "label", state: str = "state") -> DataFrame:
    """Known jobs among the finished tasks."""
    return jobs.join(tasks.filter(col(state) == "finished").select(col(label)).distinct(), label, "left_semi")


def unknown_tasks(jobs: DataFrame, tasks: DataFrame, label: str = "label") -> DataFrame:
    """Tasks whose label belongs to no job; must be empty."""
    return tasks.join(jobs.select(col(label)).distinct(), label, "left_anti")


# ---------------------------------------------------------------- sets

def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*[col(k) for k in keys]).distinct(), list(keys), "left_anti")


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def symmetric_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    names = [col(k) for k in keys]
    sides = left.select(*names, F.lit("left").alias("side")).unionByName(
        right.select(*names, F.lit("right").alias("side")))
    found = sides.groupBy(*names).agg(F.min("side").alias("side"), F.max("side").alias("__other"))
    return found.filter(F.col("side") == F.col("__other")).drop("__other")


def state_violations(lists: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Jobs that break the rules of the state lists, with the broken rule; must be empty.

    Rules: all = unfinished + finished, unfinished = pending + queued + running, and the last three are disjoint.
    """
    def listed(name: str) -> Column:
        return F.count_if(col(state) == name)

    per_job = lists.groupBy(*[col(k) for k in keys]).agg(
        *[listed(n).alias(f"__{n}") for n in ("all", "unfinished", "finished", *UNFINISHED)])
    active = F.col("__pending") + F.col("__queued") + F.col("__running")
    rule = F.array_compact(F.array(
        F.when((F.col("__all") > 0) != (F.col("__unfinished") + F.col("__finished") > 0), F.lit("all")),
        F.when((F.col("__unfinished") > 0) != (active > 0), F.lit("unfinished")),
        F.when(active > 1, F.lit("disjoint")),
    ))
    return per_job.select(*[col(k) for k in keys], F.explode(rule).alias("rule"))


# ---------------------------------------------------------------- collections

def collected(df: DataFrame, key: str, order, columns: Sequence[str], page: int = 1000) -> DataFrame:
    """Rows of each key as lists of structs, in pages of bounded length, so that a huge key fits."""
    placed = positions(df, [key], order)
    paged = placed.withColumn("page", F.floor(F.col("__place") / F.lit(page)).cast("bigint"))
    entry = F.struct("__place", *[col(c).alias(c) for c in columns])
    lists = paged.groupBy(col(key), "page").agg(F.sort_array(F.collect_list(entry)).alias("__items"))
    plain = F.transform("__items", lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    return lists.select(col(key), "page", F.size("__items").cast("bigint").alias("n_items"), plain.alias("items"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; must be empty when keys are meant to be unique."""
    return df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def disagreements(df: DataFrame, host: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Values that only some of the hosts report; empty when all hosts agree."""
    names = [col(k) for k in keys]
    seen = df.select(*names, col(host), col(value)).distinct()
    per_value = seen.groupBy(*names, col(value)).agg(F.count(F.lit(1)).alias("n_with"))
    hosts = df.select(*names, col(host)).distinct()
    if keys:
        totals = hosts.groupBy(*names).agg(F.count(F.lit(1)).alias("n_hosts"))
        joined = per_value.join(totals, list(keys))
    else:
        joined = per_value.withColumn("n_hosts", F.lit(hosts.count()))
    return joined.filter(F.col("n_with") < F.col("n_hosts"))


def agreed_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value all rows of a key share; ``agrees`` is false where they differ."""
    same = F.min(col(value)).eqNullSafe(F.max(col(value))) & (F.count(col(value)) == F.count(F.lit(1)))
    return df.groupBy(*[col(k) for k in keys]).agg(F.min(col(value)).alias(value), same.alias("agrees"))


def latest_state(events: DataFrame, keys: Sequence[str], order, columns: Sequence[str]) -> DataFrame:
    """Newest state per job."""
    newest = edge_rows(events, keys, order, 1, last=True)
    return newest.select(*[col(c) for c in [*keys, *columns]])
