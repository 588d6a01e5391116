import pytest
from pyspark.sql import functions as F

from trialframe.operators import compare, jobs


def test_tree_comparison(spark, tmp_path):
    for side, text in (("l", "id 17\nsame\nold\n"), ("r", "id 99\nsame\nnew\nextra\n")):
        (tmp_path / side / "sub").mkdir(parents=True)
        (tmp_path / side / "sub/a.txt").write_text(text)
        (tmp_path / side / "skip.log").write_text(side)
    (tmp_path / "l/only.txt").write_text("x")
    (tmp_path / "l/.gitkeep").write_text("k")
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    found = compare.compare_trees(spark, left, right, [r"\d+"], [r"skip\.log"]).collect()
    assert {(r["path"], r["line_no"], r["status"]) for r in found} == {
        ("sub/a.txt", 2, "diff"), ("sub/a.txt", 3, "right_only"), ("only.txt", 0, "left_only"),
        ("only.txt", -1, "left_only")}
    assert compare.same_trees(spark, left, left) and not compare.same_trees(spark, left, right)


def test_classification_has_an_error_class(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "label string")
    queue = spark.createDataFrame([("b", "PENDING"), ("c", "COMPLETED"), ("d", "NODE_FAIL")], "label string, job_state string")
    got = {r["label"]: r["status"] for r in jobs.classify(known, queue).collect()}
    assert got == {"a": "complete", "b": "incomplete", "c": "complete", "d": "error"}


def test_latest_and_removable(spark):
    runs = spark.createDataFrame([("a", "1", True), ("a", "3", False), ("a", "2", True), ("ab", "9", True),
                                  ("a", "$expected", True)], "suite string, suite_id string, is_complete boolean")
    assert {(r["suite"], r["last_id"]) for r in jobs.latest_ids(runs).collect()} == {("a", 3), ("ab", 9)}
    assert tuple(jobs.latest_suite(runs).first()) == ("ab", 9)
    assert {(r["suite"], r["suite_id"]) for r in jobs.removable(runs).collect()} == {("a", "1")}


def test_agreement(spark):
    df = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h1", "y"), ("h1", "y")], "host string, label string")
    assert [tuple(r) for r in jobs.disagreements(df, "host", "label").collect()] == [("y", 1, 2)]
    same = spark.createDataFrame([(1, "v"), (1, "v"), (2, "v"), (2, None)], "k int, v string")
    assert {(r["k"], r["agrees"]) for r in jobs.agreed_value(same, ["k"], "v").collect()} == {(1, True), (2, False)}


def test_collected_pages_are_bounded(spark, chunked):
    df = spark.range(500).selectExpr("if(id % 3 = 0, id % 5, 99) as k", "id")
    pages = jobs.collected(df, "k", "id", ["id"], page=64).collect()
    assert max(p["n_items"] for p in pages) <= 64
    hot = [i["id"] for p in sorted((p for p in pages if p["k"] == 99), key=lambda p: p["page"]) for i in p["items"]]
    assert hot == [i for i in range(500) if i % 3]


def test_state_rules(spark):
    lists = spark.createDataFrame([(1, "all"), (1, "finished"), (2, "all"), (2, "unfinished"), (2, "pending"), (2, "queued"),
                                   (3, "finished"), (4, "all"), (4, "unfinished")], "id int, state string")
    got = {(r["id"], r["rule"]) for r in jobs.state_violations(lists, ["id"]).collect()}
    assert got == {(2, "disjoint"), (3, "all"), (4, "unfinished")}


def test_progress_of_unknown_suites(spark):
    runs = spark.createDataFrame([("a", "1"), ("a", "2")], "suite string, suite_id string")
    states = spark.createDataFrame([("a", "1", "e", "finished"), ("a", "1", "f", "finished")],
                                   "suite string, suite_id string, exp_name string, state string")
    done = jobs.suite_complete(runs, jobs.progress(states))
    assert {(r["suite_id"], r["is_complete"]) for r in done.collect()} == {("1", True), ("2", False)}


def test_sets(spark):
    a, b = spark.range(5).toDF("id"), spark.range(3, 8).toDF("id")
    assert {tuple(r) for r in jobs.symmetric_difference(a, b, ["id"]).collect()} == {
        (0, "left"), (1, "left"), (2, "left"), (5, "right"), (6, "right"), (7, "right")}
    assert jobs.difference(a, b, ["id"]).count() == 3 and jobs.union_distinct(a, b).count() == 8
    assert jobs.duplicate_keys(a.union(a.filter("id = 1")), "id").first()["id"] == 1
    counts = jobs.run_counts(a.select(F.lit("s").alias("suite"), F.lit("e").alias("exp_name")),
                             spark.createDataFrame([], "suite string"))
    assert tuple(counts.first()) == ("s", "e", 5, False)


def test_labels_round_trip(spark):
    df = spark.createDataFrame([("a__b", "7", "e_1", 3, 0)], "suite string, suite_id string, exp_name string, exp_run int, exp_run_rep int")
    parsed = df.select(jobs.job_label().alias("l")).select(*[c.alias(n) for n, c in jobs.parse_label(F.col("l")).items()])
    assert tuple(parsed.first()) == ("a__b", "7", "e_1", "3", "0")
    with pytest.raises(Exception):
        df.select(jobs.job_label(["nope"])).collect()


def test_trees_with_empty_and_binary_files(spark, tmp_path):
    for side in ("l", "r", "same"):
        (tmp_path / side / "d").mkdir(parents=True)
        (tmp_path / side / "d" / "t.txt").write_text("one\n")
        (tmp_path / side / ".gitkeep").write_text("")
    left, right, same = (str(tmp_path / s) for s in ("l", "r", "same"))
    assert compare.same_trees(spark, left, same)
    (tmp_path / "l" / "none.txt").write_text("")
    (tmp_path / "r" / "bin").write_bytes(b"\x00\x01\xff")
    found = {(r["path"], r["status"]) for r in compare.compare_trees(spark, left, right).collect()}
    assert found == {("none.txt", "left_only"), ("bin", "right_only")}
    (tmp_path / "l" / "bin").write_bytes(b"\x00\x02\xff")
    found = {(r["path"], r["status"]) for r in compare.compare_trees(spark, left, right).collect()}
    assert found == {("none.txt", "left_only"), ("bin", "diff")}
