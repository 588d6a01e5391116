import json
from dataclasses import dataclass

import pytest
import yaml
from pyspark.sql import functions as F

from trialframe.plans import flow
from trialframe.sources import formats
from trialframe.sources.tree import JOB_KEYS

DESIGN = {
    "exp1": {"base_experiment": {"size": {"$FACTOR$": [10, 20]}, "out": "json"}, "n_repetitions": 2},
    "exp2": {"base_experiment": {"kind": "$FACTOR$"}, "factor_levels": [{"kind": "x"}, {"kind": "y"}]},
    "$ETL$": {
        "latency": {
            "experiments": ["exp1"],
            "extractors": {"JsonExtractor": {}, "ErrorExtractor": {}, "IgnoreExtractor": {}},
            "transformers": [{"name": "RepAggTransformer", "data_columns": ["lat"], "ignore_columns": ["source_file"]},
                             {"df.sort_values": {"by": ["run"], "ignore_index": True}}],
            "loaders": {"CsvSummaryLoader": {"skip_empty": True}, "PickleSummaryLoader": {}, "LatexTableLoader": {}},
        },
        "by_factor": {
            "experiments": "*",
            "extractors": {"JsonExtractor": {"file_regex": "out.json"}, "IgnoreExtractor": {"file_regex": ["stdout.log"]}},
            "transformers": [{"name": "GroupByAggTransformer", "data_columns": ["lat"], "groupby_columns": ["exp_name", "$FACTORS$"],
                              "agg_functions": ["mean", "custom_tail"], "custom_tail_length": 1}],
            "loaders": {},
        },
    },
}


@pytest.fixture
def root(tree):
    for run, size in enumerate([10, 20]):
        for rep in range(2):
            tree.job("demo_1", "exp1", run, rep, {"size": size, "out": "json"},
                     {"out.json": json.dumps([{"lat": float(run + rep)}]), "stdout.log": "x"})
    for run, kind in enumerate("xy"):
        tree.job("demo_1", "exp2", run, 0, {"kind": kind}, {"out.json": json.dumps({"lat": 5.0})})
    tree.put("demo_1/suite_design.yml", yaml.safe_dump(DESIGN, sort_keys=False))
    return str(tree.root)


def test_design_flows_end_to_end(spark, root, tmp_path):
    frames = flow.run_design(spark, root, "demo", 1, str(tmp_path / "out"))
    assert set(frames) == {"latency", "by_factor"}
    csv = spark.read.option("header", True).csv(str(tmp_path / "out/latency/latency.csv"))
    assert csv.count() == 2 and {"size", "lat_mean", "lat_std", "lat_count", "factor_columns"} <= set(csv.columns)
    assert {(r["size"], r["lat_mean"], r["lat_count"]) for r in csv.collect()} == {("10", "0.5", "2"), ("20", "1.5", "2")}
    assert spark.read.parquet(str(tmp_path / "out/latency/latency.parquet")).count() == 2
    tex = [r["value"] for r in spark.read.text(str(tmp_path / "out/latency/latency.tex")).collect()]
    assert sum(line.endswith(r"\\") for line in tex) == 3 and any("host\\_type" in line for line in tex)
    rows = {(r["exp_name"], r["size"], r["kind"], r["lat_mean"], r["lat_custom_tail"]) for r in frames["by_factor"].collect()}
    assert rows == {("exp1", 10, None, 0.5, 1.0), ("exp1", 20, None, 1.5, 2.0), ("exp2", None, "x", 5.0, 5.0),
                    ("exp2", None, "y", 5.0, 5.0)}


def test_several_suites_and_returned_frames(spark, root, tree):
    tree.job("demo_2", "exp1", 0, 0, {"size": 99}, {"out.json": json.dumps([{"lat": 7.0}])})
    tree.put("demo_2/suite_design.yml", yaml.safe_dump(DESIGN, sort_keys=False))
    body = {"experiments": {"demo": ["exp1", "exp2"]}, "extractors": {"JsonExtractor": {}, "IgnoreExtractor": {}},
            "transformers": [{"df.query": {"expr": "lat >= 1"}}, {"name": "RepAggTransformer", "data_columns": ["lat"]}],
            "loaders": {}}
    spec = {"$SUITE_ID$": {"demo": {"exp1": 2, "$DEFAULT$": 1}}, "$ETL$": {"f": body, "g": body}}
    frames = flow.run(spark, spec, root, return_frames=True, only=["f"], until="RepAggTransformer")
    assert list(frames) == ["f"]
    assert {(r["suite_id"], r["exp_name"], r["lat"]) for r in frames["f"].collect()} == {
        ("2", "exp1", 7.0), ("1", "exp2", 5.0)}
    moved = flow.run(spark, spec, root, return_frames=True, suite_ids={"demo": 1})
    assert moved["f"].filter("exp_name = 'exp1'").count() == 2
    with pytest.raises(ValueError, match="flows not found"):
        flow.run(spark, spec, root, only=["nope"])


def test_flow_without_results_is_skipped(spark, root):
    design = {**DESIGN, "exp3": {"base_experiment": {}}}
    spec = {"$SUITE_ID$": {"demo": 1}, "$ETL$": {"late": {**DESIGN["$ETL$"]["by_factor"], "experiments": {"demo": ["exp3"]}}}}
    (__import__("pathlib").Path(root) / "demo_1/suite_design.yml").write_text(yaml.safe_dump(design, sort_keys=False))
    with pytest.warns(UserWarning, match="no results"):
        assert flow.run(spark, spec, root, return_frames=True) == {}
    spec["$ETL$"]["late"]["experiments"] = {"demo": ["ghost"]}
    with pytest.raises(ValueError, match="non-existing"):
        flow.run(spark, spec, root, return_frames=True)


def test_includes_and_variables():
    sources = {"template": {"t": {"$ETL$": {"p": {
        "experiments": "*", "extractors": {"JsonExtractor": {"file_regex": "[% NAME %].json"}},
        "transformers": [{"df.head": {"n": 1}}], "loaders": {"CsvSummaryLoader": {}}}}}},
        "suite": {"s": {"$ETL$": {"q": {"extractors": {}, "transformers": [], "loaders": {"LatexTableLoader": {}}}}}}}
    whole = flow.resolve_includes({"experiments": "*", "$INCLUDE_PIPELINE$": {"template": "t", "pipeline": "p"}}, sources)
    assert whole["loaders"] == {"CsvSummaryLoader": {}}
    parts = {"experiments": ["a"], "extractors": {"$INCLUDE_STEPS$": [{"template": "t", "pipeline": "p"}], "IgnoreExtractor": {}},
             "transformers": [{"df.tail": {}}, {"$INCLUDE_STEPS$": {"template": "t", "pipeline": "p"}}],
             "loaders": {"$INCLUDE_STEPS$": [{"suite": "s", "pipeline": "q"}]}, "$ETL_VARS$": {"NAME": "[% X %]", "X": "a\"b"}}
    body = flow.resolve_variables(flow.resolve_includes(parts, sources))
    assert body["extractors"]["JsonExtractor"] == {"file_regex": "a\"b.json"}
    assert body["transformers"] == [{"df.tail": {}}, {"df.head": {"n": 1}}] and "LatexTableLoader" in body["loaders"]
    for wrong in ({"template": "t", "suite": "s", "pipeline": "p"}, {"template": "none", "pipeline": "p"}):
        with pytest.raises(ValueError):
            flow.resolve_includes({"$INCLUDE_PIPELINE$": wrong}, sources)
    with pytest.raises(ValueError, match="steps of its own"):
        flow.resolve_includes({"$INCLUDE_PIPELINE$": {"template": "t", "pipeline": "p"}, "loaders": {"x": {}}}, sources)
    with pytest.raises(KeyError):
        flow.resolve_variables({"loaders": {"L": {"a": "[% NO %]"}}, "$ETL_VARS$": {"YES": 1}})


@pytest.mark.parametrize("change", [
    {"extractors": {"NoExtractor": {}}}, {"extractors": {"JsonExtractor": {"wrong": 1}}},
    {"transformers": [{"name": "NoTransformer"}]}, {"transformers": [{"name": "RepAggTransformer", "data_columns": [], "x": 1}]},
    {"transformers": [{"df.no_verb": {}}]}, {"transformers": [{"a": 1, "b": 2}]},
    {"loaders": {"NoLoader": {}}}, {"loaders": {"CsvSummaryLoader": {"wrong": 1}}}, {"surprise": 1},
])
def test_wrong_specifications(change):
    body = {"experiments": {}, "extractors": {}, "transformers": [], "loaders": {}, **change}
    with pytest.raises(ValueError):
        flow.check_flow("f", body)


def test_registry(spark):
    own = flow.STANDARD.copy()
    own.add("transformer", "Doubler", lambda df, column: df.withColumn(column, F.col(column) * 2))
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert flow.transform(df, [{"name": "Doubler", "column": "a"}], own).first()["a"] == 2
    with pytest.raises(ValueError, match="duplicate"):
        own.add("transformer", "Doubler", lambda df: df)
    assert "Doubler" not in flow.STANDARD.transformers
    seen = []
    own.add("loader", "Keep", lambda df, info, tag="x": seen.append((info.flow, tag, df.count())))
    flow.load(df, {"Keep": {"tag": "y"}}, flow.LoadInfo("f", None), own)
    own.add("extractor", "Mine", formats.Extractor, reader=lambda docs, extractor, configs: docs)
    assert seen == [("f", "y", 1)] and "Mine" in own.readers


@dataclass(frozen=True)
class LineFiles(formats.Extractor):
    file_regex: str = r".*\.log$"
    unit: str = "s"


def test_own_extractor_gets_its_options_and_the_run_configuration(spark, root):
    def read(docs, extractor, configs):
        sizes = configs.selectExpr(*JOB_KEYS, "variant_get(config, '$.size', 'int') as size")
        return docs.join(sizes, JOB_KEYS).withColumn(
            "record", F.expr(f"parse_json(concat('{{\"shown\": \"', size, ' {extractor.unit}\"}}'))"))

    own = flow.STANDARD.copy()
    own.add("extractor", "LineExtractor", LineFiles, reader=read)
    body = {"experiments": {"demo": ["exp1"]}, "transformers": [], "loaders": {},
            "extractors": {"LineExtractor": {"unit": "ms"}, "IgnoreExtractor": {"file_regex": "out.json"}}}
    frames = flow.run(spark, {"$SUITE_ID$": {"demo": 1}, "$ETL$": {"f": body}}, root, return_frames=True, registry=own)
    assert sorted(r["shown"] for r in frames["f"].collect()) == ["10 ms", "10 ms", "20 ms", "20 ms"]


def test_flows_over_the_same_files_share_one_extraction(spark, root, monkeypatch):
    seen, extract = [], flow.results_frame
    monkeypatch.setattr(flow, "results_frame", lambda *a: seen.append(1) or extract(*a))
    body = {"experiments": {"demo": ["exp1"]}, "extractors": {"JsonExtractor": {}, "IgnoreExtractor": {}}, "transformers": [], "loaders": {}}
    spec = {"$SUITE_ID$": {"demo": 1}, "$ETL$": {"f": body, "g": {**body, "transformers": [{"df.query": {"expr": "lat > 1"}}]},
                                                 "h": {**body, "experiments": {"demo": ["exp2"]}}}}
    frames = flow.run(spark, spec, root, return_frames=True)
    assert len(seen) == 2 and [frames[x].count() for x in "fgh"] == [4, 1, 2]


def test_experiment_filters():
    design = {"a1": {}, "b1": {}, "$ETL$": {"p": {"experiments": ["a1", "b1"]}, "q": {"experiments": ["b1"]}, "r": {"experiments": "*"}}}
    kept = flow.keep_experiments(design, "a.*")
    assert kept["$ETL$"] == {"p": {"experiments": ["a1"]}, "r": {"experiments": "*"}} and "b1" not in kept
    assert flow.check_experiments("*", ["x"]) == ["x"]
    with pytest.raises(ValueError):
        flow.check_experiments(["y"], ["x"])
    with pytest.raises(ValueError, match="no suite id"):
        flow.experiment_ids("s", ["e"], {"s": {"f": 1}})
    assert flow.experiment_ids("s", ["e", "f"], {"s": {"f": 1, "$DEFAULT$": 3}}) == {"e": "3", "f": "1"}


def test_empty_frames(spark, tmp_path):
    from trialframe.sinks import writers

    empty = spark.createDataFrame([], "a int")
    writers.write_csv(empty, str(tmp_path / "x"), skip_empty=True)
    assert not (tmp_path / "x").exists()
    for write in (writers.write_csv, writers.write_table, lambda d, p: writers.write_latex(d, p, "a")):
        with pytest.raises(ValueError, match="empty"):
            write(empty, str(tmp_path / "y"))
    assert writers.output_folder("/o", "c", "f") == "/o/c/f" and writers.output_folder("/o/", None, "f") == "/o/f"


def test_text_tables(spark):
    from trialframe.sinks import writers

    df = spark.createDataFrame([(2, "a_b & <c>", None), (1, "50% \\", [1])], "n int, t string, l array<int>")
    tex = [r[0] for r in writers.latex_lines(df, "n").collect()]
    assert tex[4:6] == [r"1 & 50\% \textbackslash  & [1] \\", r"2 & a\_b \& <c> & NaN \\"]
    html = [r[0] for r in writers.html_lines(df, "n").collect()]
    assert html[4].strip() == "<tr><td>2</td><td>a_b &amp; &lt;c&gt;</td><td>NaN</td></tr>"


def test_chart_loader(spark, root, tmp_path):
    spec = {"$SUITE_ID$": {"demo": 1}, "$ETL$": {"c": {
        "experiments": {"demo": ["exp1"]}, "extractors": {"JsonExtractor": {}, "IgnoreExtractor": {}},
        "transformers": [{"name": "GroupByAggTransformer", "data_columns": ["lat"], "groupby_columns": ["size"]}],
        "loaders": {"ColumnCrossPlotLoader": {"metrics": {"t": {"value_cols": "lat_mean", "error_cols": "lat_std"}},
                                              "cum_subplot_config": [{"chart": {"bar_foreach": {"cols": ["size"]}}}]}}}}}
    flow.run(spark, spec, root, str(tmp_path / "o"), config_name="cfg")
    bars = spark.read.parquet(str(tmp_path / "o/cfg/c/bars"))
    assert bars.count() == 2 and spark.read.parquet(str(tmp_path / "o/cfg/c/data")).count() == 2
    lines = [r[0] for r in spark.read.text(str(tmp_path / "o/cfg/c/html/file_name=out")).collect()]
    assert sum("<td>" in line for line in lines) == 2 and lines.count("<table>") == 1


def test_chart_hooks_axes_and_legends(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.0, 0.5), ("a", "y", 3.0, None), ("b", "x", 2.0, 0.1), ("b", "y", -1.0, 0.5)],
                               "g string, b string, v double, e double")
    own, seen = flow.STANDARD.copy(), []

    def told(name):
        return lambda frame: seen.append(name) or frame

    names = ["pre_metrics", "pre_filter", "pre_group", "pre_figure", "post_figure", "post_subplots", "pre_bars", "post_bars"]
    own.add("loader", "Charts", flow.chart_loader(flow.Hooks(**{n: told(n) for n in names}, post=lambda f: f.withColumn("tag", F.lit(1)))))
    options = {"metrics": {"m": {"value_cols": "v", "error_cols": "e"}},
               "cum_plot_config": [{"legend_fig": {"kwargs": {}}}],
               "cum_subplot_config": [{"xaxis": {"ticks": {"ticks": [0, 1]}, "scale": "log"},
                                       "yaxis": {"lim": {"min": {"data_min_scaler": 2.0}}, "ticks": 2},
                                       "legend_ax": {"label": {"template": "bar {b}"}},
                                       "chart": {"group_foreach": {"cols": ["g"]}, "bar_foreach": {"cols": ["b"]}}}]}
    flow.load(df, {"Charts": options}, flow.LoadInfo("f", str(tmp_path)), own)
    assert seen == names
    (axes,) = spark.read.parquet(str(tmp_path / "axes")).collect()
    assert (axes["y_data_min"], axes["y_data_max"], axes["y_min"], axes["y_max"]) == (-1.5, 3.0, -3.0, None)
    assert (axes["y_ticks"], axes["x_ticks"], axes["x_scale"], axes["y_scale"], axes["x_min"]) == ([-3.0, 3.0], [0.0, 1.0], "log", None, None)
    for table, labels in (("legend", ["bar y", "bar x"]), ("figure_legend", ["bar x", "bar y"])):
        rows = spark.read.parquet(str(tmp_path / table)).orderBy("legend_no").collect()
        assert [r["label"] for r in rows] == labels and rows[0]["tag"] == 1


def test_sorted_output(spark, tmp_path):
    from trialframe.sinks import writers

    df = spark.range(100).select((F.col("id") * 37 % 100).alias("n"))
    writers.write_csv(df, str(tmp_path / "c"), order_by=["n"])
    parts = sorted((tmp_path / "c").glob("part-*"))
    assert [int(x) for p in parts for x in p.read_text().split()[1:]] == list(range(100))


def test_frames_are_cut_to_the_shared_folder(spark):
    from trialframe.session import cut, is_costly, settled, shared_folder

    df = spark.sql("select id, null as nothing, parse_json('{\"a\": 1}') as v, 'x' as `$odd name.b, c` from range(3)")
    again = cut(df)
    assert again.columns == df.columns and again.selectExpr("variant_get(v, '$.a', 'int') as a").first()["a"] == 1
    assert not is_costly(df) and settled(df) is df
    grouped = df.groupBy((F.col("id") % 2).alias("k")).count()
    assert is_costly(grouped) and not is_costly(settled(grouped))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", shared_folder(spark))
