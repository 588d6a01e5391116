import itertools
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialframe.operators import jobs
from trialframe.plans import design
from trialframe.sinks import writers

EXPERIMENT = {
    "n_repetitions": 2,
    "host_types": {"small": {"n": 2, "$CMD$": [{"main": "run [% my_run.out %] [% my_run.app.size %] [% my_run.opt %]", "bg": "w"},
                                               "go [% run %]"]}},
    "base_experiment": {"out": "[% my_run.base %]/o", "base": "root", "app": {"name": "$FACTOR$", "size": {"$FACTOR$": [1, 2, 3]}},
                        "opt": {"$FACTOR$": [True, False]}},
    "factor_levels": [{"app": {"name": "A"}}, {"app": {"name": "B"}}],
    "except_filters": [{"app": {"name": "A", "size": 2}}, {"opt": True, "app": {"size": 3}}],
}


def test_run_table(spark, chunked):
    runs = design.run_table(spark, "e", EXPERIMENT).orderBy("run").collect()
    want = [(n, s, o) for n, s, o in itertools.product("AB", [1, 2, 3], [True, False])
            if not (n == "A" and s == 2) and not (o and s == 3)]
    assert [(r["app.name"], r["app.size"], r["opt"]) for r in runs] == want
    assert [r["run"] for r in runs] == list(range(len(want)))
    assert runs[0]["out"] == "root/o"
    assert runs[0]["$CMD$.small"] == [{"main": "run root/o 1 True", "bg": "w"}, {"main": "go 0"}]
    assert design.factor_columns(EXPERIMENT) == ["app.name", "app.size", "opt"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(0, 3))
def test_expansion_count(spark, sizes, n_except):
    base = {f"f{i}": {"$FACTOR$": list(range(n))} for i, n in enumerate(sizes)}
    excluded = [{f"f{i % len(sizes)}": 0} for i in range(n_except)]
    runs = design.run_table(spark, "e", {"base_experiment": base, "except_filters": excluded})
    want = [c for c in itertools.product(*[range(n) for n in sizes])
            if not any(all(c[int(k[1:])] == v for k, v in e.items()) for e in excluded)]
    got = [tuple(r[f"f{i}"] for i in range(len(sizes))) for r in runs.orderBy("run").collect()]
    assert got == want


def test_mixed_levels_and_constants(spark):
    exp = {"base_experiment": {"m": {"$FACTOR$": ["a", 1, {"k": 2}]}, "l": [1, 2], "f": {"$FACTOR$": [1, 2.5]}, "none": None}}
    rows = design.run_table(spark, "e", exp).orderBy("run").collect()
    assert [r["m"] for r in rows] == ["a", "a", "1", "1", '{"k": 2}', '{"k": 2}']
    assert rows[0]["l"] == [1, 2] and rows[1]["f"] == 2.5 and rows[0]["none"] is None


def test_rules():
    with pytest.raises(ValueError, match="not allowed"):
        design.check_experiment("state", {"base_experiment": {}})
    with pytest.raises(ValueError, match="not allowed"):
        design.check_experiment("a-b", {"base_experiment": {}})
    with pytest.raises(ValueError, match="exactly"):
        design.check_experiment("e", {"base_experiment": {"a": "$FACTOR$"}, "factor_levels": [{"b": 1}]})
    with pytest.raises(ValueError, match="no factors"):
        design.check_experiment("e", {"base_experiment": {"a": 1}, "except_filters": [{"a": 1}]})
    with pytest.raises(ValueError, match="must be a list"):
        design.crossed_factors({"base_experiment": {"a": {"$FACTOR$": 3}}})
    with pytest.raises(ValueError, match="main"):
        design.normal_commands({"$CMD$": [{"side": "x"}]})
    with pytest.raises(ValueError, match="2 hosts"):
        design.normal_commands({"n": 2, "$CMD$": ["x"]})
    assert design.normal_commands({"n": 2, "$CMD$": "x"}) == [{"main": "x"}, {"main": "x"}]


def test_templates(spark):
    with pytest.raises(KeyError):
        design.run_table(spark, "e", {"base_experiment": {"a": "[% my_run.nope %]"}}).collect()
    exp = {"base_experiment": {"a": "x[% my_run.b %]", "b": "y[% my_run.c %]", "c": {"$FACTOR$": ["1", "2"]}, "d": "[% var %]"}}
    rows = design.run_table(spark, "e", exp, variables={"var": "v"}).orderBy("run").collect()
    assert [(r["a"], r["d"]) for r in rows] == [("xy1", "v"), ("xy2", "v")]


def test_defaults_and_includes():
    base = {"a": 1, "n": {"x": 1}}
    assert design.with_defaults(base, {"a": 9, "n": {"y": 2}, "z": {"q": 3}}) == {
        "a": 1, "n": {"x": 1, "y": 2}, "z": {"q": 3}}
    files = {"f.yml": {"a": 7, "b": {"c": 1}}, "g.yml": {"$INCLUDE_VARS$": "f.yml", "d": 4}}
    assert design.resolve_includes({"a": 0, "in": {"$INCLUDE_VARS$": ["g.yml"]}}, files) == {
        "a": 0, "in": {"d": 4, "a": 7, "b": {"c": 1}}}
    with pytest.raises(ValueError):
        design.resolve_includes({"$INCLUDE_VARS$": "h.yml"}, files)


def test_suite_vars(spark):
    exp = {"base_experiment": {"own": 1, "f": {"$FACTOR$": [1, 2]}}}
    row = design.run_table(spark, "e", exp, suite_vars={"own": 5, "more": "x"}).first()
    assert (row["own"], row["more"]) == (1, "x")


def test_jobs_and_export(spark, tmp_path):
    runs = design.run_table(spark, "e", EXPERIMENT)
    table = design.job_table(runs, "s", "1", 2)
    assert table.count() == 2 * runs.count()
    hosts = spark.createDataFrame([("e", "h0", 0), ("e", "h1", 1)], "exp_name string, host string, host_no int")
    schedule = design.job_schedule(table.withColumnRenamed("$CMD$.small", "commands"), hosts)
    got = {(r["host"], r["exp_run_cmd"]) for r in schedule.filter("exp_run = 0 and exp_run_rep = 0").collect()}
    assert got == {("h0", "runner 0"), ("h1", "go 0")}
    writers.write_run_configs(table, str(tmp_path / "runs"), ["suite", "suite_id", "exp_name", "exp_run", "exp_run_rep"])
    back = spark.read.json(str(tmp_path / "runs"))
    config = json.loads(back.filter("exp_run = 0").first()["config"])
    assert list(config) == sorted(config) and config["app.size"] == 1
    labels = table.select("exp_run", jobs.job_label().alias("label"))
    parsed = labels.select("exp_run", jobs.parse_label(F.col("label"))["exp_run"].alias("again"))
    assert parsed.filter("exp_run <> again").count() == 0


def test_state_snapshot(spark, tmp_path):
    table = design.job_table(spark.range(5).selectExpr("'e' as exp_name", "id as run"), "s", "1", 1)
    states = table.withColumn("state", F.when(F.col("exp_run") < 2, "finished").otherwise("pending"))
    writers.write_states(states, str(tmp_path / "states"))
    assert spark.read.parquet(str(tmp_path / "states")).count() == 5
    pages = writers.state_lists(states, page=2).filter("list = 's/1/e/pending'").orderBy("page").collect()
    assert [[i["exp_run"] for i in p["items"]] for p in pages] == [[2, 3], [4]]


def test_exclusions_as_table(spark):
    runs = spark.range(12).selectExpr("id as run", "id % 3 as a", "id div 3 as b")
    entries = spark.createDataFrame([(1, None), (None, 2), (0, 0)], "a bigint, b bigint")
    left = design.exclude_rows(runs, entries)
    want = {(r, r % 3, r // 3) for r in range(12) if not (r % 3 == 1 or r // 3 == 2 or (r % 3 == 0 and r // 3 == 0))}
    assert {(r["run"], r["a"], r["b"]) for r in left.collect()} == want


def test_suite_design(spark):
    suite = {"$SUITE_VARS$": {"shared": 1, "$INCLUDE_VARS$": "more.yml"}, "$ETL$": {},
             "a": {"base_experiment": {"f": {"$FACTOR$": [1, 2]}, "in": {"$INCLUDE_VARS$": "more.yml"}}},
             "b": {"base_experiment": {"shared": 9}}}
    tables = design.suite_run_tables(spark, suite, {"more.yml": {"extra": "e"}})
    assert {n: t.count() for n, t in tables.items()} == {"a": 2, "b": 1}
    row = tables["a"].first()
    assert (row["shared"], row["extra"], row["in.extra"]) == (1, "e", "e")
    assert tables["b"].first()["shared"] == 9
