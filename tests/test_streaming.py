import json

import pytest

from trialframe.streaming import incremental


def put(tree, run, values):
    tree.job("s_1", "e", run, 0, {}, {"out.json": json.dumps([{"lat": v} for v in values])})


def test_results_arrive_in_batches(spark, tree, tmp_path_factory):
    put(tree, 0, [1.0, 3.0])
    state, out = str(tmp_path_factory.mktemp("state")), str(tmp_path_factory.mktemp("out"))

    def update():
        docs = incremental.document_stream(spark, f"{tree.root}/*/*/*/*/*/*")
        records = incremental.record_stream(docs, "lat double")
        sums = incremental.aggregate_stream(records, ["exp_name"], ["lat"], ["mean", "count"])
        return incremental.run_available(sums, "complete", out, state).collect()

    assert [tuple(r) for r in update()] == [("e", 2.0, 2)]
    put(tree, 1, [8.0])
    assert [tuple(r) for r in update()] == [("e", 4.0, 3)]
    assert [tuple(r) for r in update()] == [("e", 4.0, 3)]


def test_life_cycle(spark, tmp_path):
    rows = [("j1", 1, "pending"), ("j1", 2, "queued"), ("j2", 1, "pending"), ("j1", 3, "finished")]
    spark.createDataFrame(rows, "job string, at int, state string").write.parquet(str(tmp_path / "e"))
    events = incremental.file_stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    done = incremental.run_available(incremental.latest_states(events, ["job"], ["at"]))
    assert {tuple(r) for r in done.collect()} == {("j1", "finished"), ("j2", "pending")}


def test_late_windows_are_final(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,id) as ts, id as v from range(5)").write.parquet(src)
    events = incremental.file_stream(spark, src, spark.read.parquet(src).schema)
    out = incremental.windowed(events, "ts", "1 hour", [], ["v"], ["sum"], lateness="30 minutes")
    done = incremental.run_available(out, "append")
    # the newest row is at 4:00, so only windows that end before 3:30 are final
    assert {r["v_sum"] for r in done.collect()} == {0, 1, 2}


def test_failed_batch_is_recorded(spark, tmp_path):
    src, errors = str(tmp_path / "e"), str(tmp_path / "errors")
    spark.range(3).write.parquet(src)
    events = incremental.file_stream(spark, src, spark.read.parquet(src).schema)

    def broken(batch, batch_id):
        raise ValueError("analysis failed")

    incremental.start(events, incremental.guarded(broken, errors), "append", str(tmp_path / "state")).awaitTermination()
    row = spark.read.parquet(errors).first()
    assert (row["kind"], row["message"]) == ("ValueError", "analysis failed")


def test_unknown_function(spark, tmp_path):
    with pytest.raises(KeyError):
        incremental.aggregate_stream(spark.range(1), ["id"], ["id"], ["nope"])


MOVES = {None: ["pending"], "pending": ["queued"], "queued": ["finished"]}


def steps_of(spark, src, out, state):
    events = incremental.file_stream(spark, src, spark.read.parquet(src).schema)
    steps = incremental.life_cycles(events, ["job"], "ts", MOVES, "1 hour", order=["n"])
    done = incremental.run_available(steps, "append", out, state)
    return {(r["job"], r["at"].hour * 60 + r["at"].minute, r["before"], r["state"], r["kind"]) for r in done.collect()}


def test_life_cycles_refuse_expire_and_begin_anew(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("e", "out", "state"))

    def add(*rows):
        spark.createDataFrame(rows, "job string, minute int, n int, state string").selectExpr(
            "job", "timestamp_seconds(86400 + minute * 60) as ts", "n", "state").write.mode("append").parquet(src)

    add(("a", 1, 1, "queued"), ("a", 0, 1, "pending"), ("b", 0, 2, "pending"), ("b", 0, 1, "queued"), ("c", 5, 1, "pending"),
        ("c", 200, 1, "pending"), ("d", 199, 1, None), ("d", None, 1, "pending"), (None, 190, 1, "pending"))
    first = {("a", 0, None, "pending", "moved"), ("a", 1, "pending", "queued", "moved"), ("b", 0, None, "queued", "refused"),
             ("b", 0, None, "pending", "moved"), ("c", 5, None, "pending", "moved"), ("c", 65, "pending", None, "expired"),
             ("c", 200, None, "pending", "moved"), ("d", 199, None, None, "refused"), (None, 190, None, "pending", "moved"),
             # the watermark stands at 200, so the timers of the silent jobs have gone off
             ("a", 61, "queued", None, "expired"), ("b", 60, "pending", None, "expired")}
    assert steps_of(spark, src, out, state) == first
    # their state is gone: what goes on from it is refused, what is still alive goes on
    add(("a", 210, 1, "finished"), ("c", 215, 1, "queued"), ("c", 215, 2, "pending"))
    second = first | {("a", 210, None, "finished", "refused"), ("c", 215, "pending", "queued", "moved"),
                      ("c", 215, "queued", "pending", "refused")}
    assert steps_of(spark, src, out, state) == second
    assert steps_of(spark, src, out, state) == second
