import json
import warnings

import pytest
from pyspark.sql import functions as F

from trialframe.sources import catalog, formats, results, tree as paths
from trialframe.functions.flatten import flatten_structs, flatten_variant

from trialframe.sources.tree import with_file_keys as tree_keys  # noqa: E402

SPEC = {"json": formats.JsonFiles(), "yaml": formats.YamlFiles(), "csv": formats.CsvFiles(),
        "errors": formats.ErrorFiles(), "ignored": formats.IgnoredFiles()}


def build(tree):
    for run in range(3):
        for rep in range(2):
            config = {"size": run * 10, "opt": {"fast": run % 2 == 0, "empty": {}}, "$CMD$": {"small": [{"main": "go"}]},
                      "mark": "config", "$FACTOR_LEVEL": {"size": 1}}
            tree.job("my_suite_$expected", "exp", run, rep, config, {
                "out.json": json.dumps([{"lat": run + rep / 4, "opt": {"fast": "yes"}}, {"lat": 0.125, "mark": None}]),
                "one.yaml": f"x: {run}\nflag: yes\nwhen: 2020-01-01\nnum: 1e3\noct: 012\n",
                "stdout.log": "noise", "stderr.log": "  \n"})
    tree.put("my_suite_$expected/exp/run_0/rep_0/small/host_7/t.csv", "a,b\n1,\"x,y\"\n2,z\n")
    tree.put("my_suite_$expected/exp/run_0/rep_1/small/host_0/t.csv", "b,c d\nq,w\n")
    tree.put("my_suite_$expected/exp/run_9/rep_0/small/host_0/out.json", "{}")  # no config.json here
    tree.put("my_suite_$expected/other/run_0/rep_0/small/host_0/core.bin", "??")


@pytest.fixture
def extracted(spark, tree):
    build(tree)
    return results.extract(spark, str(tree.root), "my_suite", "$expected", ["exp"], SPEC, {"exp": ["size"]})


def test_records_of_all_formats(extracted):
    df = extracted
    assert df.count() == 12 + 6 + 3  # two per JSON file, one per YAML file, three CSV rows; no config means no rows
    types = dict(df.dtypes)
    assert types["run"] == "int" and types["lat"] == "double" and types["x"] == "bigint" and types["a"] == "string"
    assert types["`c d`" if "`c d`" in types else "c d"] == "string"
    yaml = df.filter("source_file = 'one.yaml' and run = 2 and rep = 0").first()
    assert (yaml["flag"], yaml["when"], yaml["num"], yaml["oct"], yaml["size"]) == ("yes", "2020-01-01", 1000.0, 12, 20)
    assert df.filter("source_file = 't.csv' and host_idx = 7").count() == 2
    assert df.filter("b = 'x,y'").count() == 1
    assert {r["suite_id"] for r in df.select("suite_id").collect()} == {"$expected"}
    assert df.first()["factor_columns"] == ["size"]


def test_record_wins_over_config(extracted):
    json_rows = extracted.filter("source_file = 'out.json'")
    # an entry of the record replaces the configuration, an explicit null too; absent entries leave it alone
    assert {r["opt.fast"] for r in json_rows.filter("lat <> 0.125").collect()} == {"yes"}
    assert {r["opt.fast"] for r in json_rows.filter("lat = 0.125 and run = 0").collect()} == {"true"}
    assert {r["mark"] for r in json_rows.filter("lat = 0.125").collect()} == {None}
    assert {r["mark"] for r in json_rows.filter("lat <> 0.125").collect()} == {"config"}
    assert not [c for c in extracted.columns if "FACTOR_LEVEL" in c or c.startswith("opt.empty")]


def test_files_without_extractor_are_an_error(spark, tree):
    build(tree)
    with pytest.raises(ValueError, match="core.bin"):
        results.extract(spark, str(tree.root), "my_suite", "$expected", ["other"], SPEC)
    both = {**SPEC, "again": formats.JsonFiles(r"out.*")}
    with pytest.raises(ValueError, match="matches 2"):
        results.extract(spark, str(tree.root), "my_suite", "$expected", ["exp"], both)


def test_error_files_warn(spark, tree):
    build(tree)
    tree.put("my_suite_$expected/exp/run_1/rep_0/small/host_0/stderr.log", "line one\nline two\n")
    with pytest.warns(UserWarning, match="line one line two"):
        results.extract(spark, str(tree.root), "my_suite", "$expected", ["exp"], SPEC)


def test_own_extractor(spark, tree):
    build(tree)
    tree.put("my_suite_$expected/own/run_0/rep_0/config.json", "{}")
    tree.put("my_suite_$expected/own/run_0/rep_0/small/host_0/n.kv", "a=1\nb=2")

    def read(docs, extractor, configs):
        assert extractor.patterns == [r".*\.kv$"] and "exp_name" in configs.columns
        pairs = F.str_to_map("content", F.lit("\n"), F.lit("="))
        return docs.withColumn("record", F.parse_json(F.to_json(pairs))).drop("content")

    df = results.extract(spark, str(tree.root), "my_suite", "$expected", ["own"], {"kv": formats.Extractor([r".*\.kv$"])},
                         custom={"kv": read})
    assert (df.first()["a"], df.first()["b"]) == ("1", "2")


def test_csv_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;2\n3;4\n")
    named = formats.csv_records(spark, [str(tmp_path)], formats.CsvFiles(delimiter=";", has_header=False,
                                                                         fieldnames=["x", "y"]))
    assert {r[0] for r in named.select(F.to_json("record")).collect()} == {'{"x":"1","y":"2"}', '{"x":"3","y":"4"}'}
    bare = formats.csv_records(spark, [str(tmp_path)], formats.CsvFiles(delimiter=";", has_header=False))
    assert '{"_c0":"1","_c1":"2"}' in {r[0] for r in bare.select(F.to_json("record")).collect()}
    kept = formats.csv_records(spark, [str(tmp_path)], formats.CsvFiles(delimiter=";", fieldnames=["x", "y"]))
    assert kept.count() == 2
    skipped = formats.csv_records(spark, [str(tmp_path)], formats.CsvFiles(delimiter=";", has_header=True, fieldnames=["x", "y"]))
    assert skipped.count() == 1


def test_csv_values_are_never_lost(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("a,b\n1,2,3\n4\n\n5,\"6,7\",,8\n")
    (tmp_path / "torn.csv").write_text('a,"long\nname"\n"x\ny","say ""hi"""\n1,2,3,4\n')
    rows = formats.csv_records(spark, [str(tmp_path)])
    got = {r[0] for r in rows.select(F.to_json("record")).collect()}
    assert got == {'{"_extra":"[\\"3\\"]","a":"1","b":"2"}', '{"a":"4","b":null}', '{"_extra":"[\\"8\\"]","a":"5","b":"6,7"}',
                   '{"a":"x\\ny","long\\nname":"say \\"hi\\""}', '{"_extra":"[\\"3\\",\\"4\\"]","a":"1","long\\nname":"2"}'}
    bare = formats.csv_records(spark, [str(tmp_path / "ragged.csv")], formats.CsvFiles(has_header=False))
    assert '{"_c0":"1","_c1":"2","_c2":"3"}' in {r[0] for r in bare.select(F.to_json("record")).collect()}


def test_infinite_numbers_of_yaml_stay(spark):
    docs = spark.createDataFrame([("p", "{a: .inf, b: -.Inf, c: .nan, d: [.inf]}")], "path string, content string")
    row = formats.yaml_records(docs).selectExpr("variant_get(record, '$.a', 'double') a", "variant_get(record, '$.b', 'double') b",
                                                "variant_get(record, '$.c', 'double') c", "variant_get(record, '$.d[0]', 'double') d").first()
    assert row[:] == (float("inf"), float("-inf"), None, float("inf"))


def test_numbers_beyond_an_integer_are_an_error(spark):
    path = spark.createDataFrame([("/r/s_1/exp/run_99999999999/rep_0/h/host_0/out.json",)], "path string")
    with pytest.raises(Exception, match="99999999999"):
        tree_keys(path).collect()


def test_large_csv_is_split_over_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n,t\n" + "".join(f"{i},{'x' * 30}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = formats.csv_records(spark, [str(tmp_path)])
        assert rows.rdd.getNumPartitions() > 3
        flat = flatten_variant(rows.drop("path"), "record")
        assert flat.agg(F.count("n"), F.sum(F.col("n").cast("bigint"))).first()[:] == (20000, 20000 * 19999 // 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_records_are_dropped(spark):
    docs = spark.createDataFrame([("p", "[null, {\"a\": 1}]"), ("q", "null")], "path string, content string")
    assert formats.drop_empty(formats.json_records(docs)).count() == 1
    empty = spark.createDataFrame([("p", ""), ("q", "- 1: x\n- {a: .nan}\n")], "path string, content string")
    records = formats.drop_empty(formats.yaml_records(empty))
    assert {r[0] for r in records.select(F.to_json("record")).collect()} == {'{"1":"x"}', '{"a":null}'}


def test_paths(spark):
    df = spark.createDataFrame([("file:/r/a_b_12/e/run_3/rep_4/client/host_10/f.json",), ("file:/r/a_1/e/run_3/notes.txt",)],
                               "path string")
    keyed = paths.with_file_keys(df).drop("path").collect()
    assert [tuple(r) for r in keyed] == [("a_b", "12", "e", 3, 4, "client", 10, "f.json")]
    names = spark.createDataFrame([("a_b_12",), ("x_",)], "f string")
    suite, suite_id = paths.split_folder(F.col("f"))
    assert [tuple(r) for r in names.select(suite, suite_id).collect()] == [("a_b", "12"), ("x", "")]
    with pytest.raises(Exception, match="no suite"):
        spark.createDataFrame([("12",)], "f string").select(paths.split_folder(F.col("f"))[0]).collect()
    assert names.select(paths.job_path(F.lit("w"), F.lit("s"), F.lit("1"), F.lit("e"), F.lit(0), F.lit(2))).first()[0] == \
        "w/s_1/e/run_0/rep_2"
    assert names.select(paths.trailing_number(F.lit("run_13"))).first()[0] == 13
    assert paths.suite_paths("/r/", "s", "1", ["a", "b"]) == ["/r/s_1/{a,b}"]


def test_catalog_and_states(spark, tree):
    tree.put("s_one_5/suite_design.yml", "e1: {base_experiment: {a: $FACTOR$, b: {c: {$FACTOR$: [1, 2]}}}}\n$ETL$: {}\n")
    tree.put("s_one_$expected/suite_design.yml", "e1: {}\n")
    tree.put("s_one_5/ETL_ERROR.log", "failed")
    job = "{'suite': 's_one', 'suite_id': '5', 'exp_name': 'e1', 'exp_run': %d, 'exp_run_rep': 0}"
    tree.put("s_one_5/e1/state.yml", "---\nexp_job_ids: [%s, %s]\nexp_job_ids_unfinished: [%s] # note\n"
             "exp_job_ids_pending: [%s]\nexp_job_ids_queued: []\nexp_job_ids_running: []\nexp_job_ids_finished: [%s]\n"
             % (job % 0, job % 1, job % 1, job % 1, job % 0))
    root = str(tree.root)
    designs = catalog.files_below(spark, f"{root}/*/suite_design.yml")
    runs = catalog.suite_runs(designs, r"suite_design\.yml")
    assert {(r["suite"], r["suite_id"], r["id_is_number"]) for r in runs.collect()} == {
        ("s_one", "5", True), ("s_one", "$expected", False)}
    assert catalog.without_expected(runs).count() == 1
    failed = catalog.mark_failed(runs, catalog.files_below(spark, f"{root}/*/ETL_ERROR.log"))
    assert {(r["suite_id"], r["etl_failed"]) for r in failed.collect()} == {("5", True), ("$expected", False)}
    states = catalog.job_states(paths.documents(spark, [root], [r"state\.yml$"]))
    assert sorted((r["state"], r["exp_run"]) for r in states.collect()) == [
        ("all", 0), ("all", 1), ("finished", 0), ("pending", 1), ("unfinished", 1)]
    from trialframe.operators.jobs import listed_progress

    row = listed_progress(states).first()
    assert (row["n_jobs"], row["n_jobs_unfinished"], row["n_jobs_finished"], row["is_complete"]) == (2, 1, 1, False)
    docs = paths.documents(spark, [f"{root}/s_one_5"], [r"suite_design\.yml$"]).select(
        F.lit("s_one").alias("suite_name"), F.lit("5").alias("suite_id"), "content")
    assert catalog.design_factors(docs).first()["factor_columns"] == ["a", "b.c"]


def test_flatten_structs(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 'x', 'd', array(1))) as s, 5 as n")
    assert flatten_structs(df).columns == ["s.a", "s.b.c", "s.b.d", "n"]


def test_no_warning_without_errors(spark, tree):
    build(tree)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        results.extract(spark, str(tree.root), "my_suite", "$expected", ["exp"], SPEC)


def test_documents_of_one_file_are_parsed_by_all_tasks(spark):
    docs = spark.range(4000, numPartitions=1).selectExpr("id", "concat('a: ', id) as content")
    records = formats.yaml_records(docs)
    tasks = records.select(F.spark_partition_id().alias("p"), F.variant_get("record", "$.a", "bigint").alias("a"), "id").toPandas()
    assert tasks["p"].nunique() > 4 and tasks["p"].value_counts().max() < 1000
    assert (tasks["a"] == tasks["id"]).all() and len(tasks) == 4000
