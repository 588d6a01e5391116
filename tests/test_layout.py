import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import text
from trialframe.plans import layout
from trialframe.plans.layout import Hooks, Level, Metric, Rule


@pytest.fixture
def measured(spark):
    rows = [(s, c, w, 1.0 + i, 2.0 * i, 3.0) for i, (s, c, w) in enumerate(itertools.product(
        ["s1", "s2", "s3"], ["c1", "c2"], ["w1", "w2"])) if not (s == "s2" and c == "c2")]
    return spark.createDataFrame(rows, "system string, cfg string, workload string, base double, over double, mem double")


def chart(**changes):
    options = {
        "metrics": {"time": {"value_cols": ["base", "over"], "unit_label": "sec"}},
        "data_filter": {"allowed": {"system": ["s3", "s1", "s2"]}},
        "fig_foreach": {"cols": ["workload"]},
        "cum_subplot_config": [{
            "chart": {"group_foreach": {"cols": ["system"], "label": {"template": "{system}"}},
                      "bar_foreach": {"cols": ["cfg"], "label": {"template": "{cfg}"}},
                      "bar_width": 0.5, "bar_padding": 0.25, "group_padding": 1.0},
            "label_map": {"s1": "one"}, "yaxis": {"label": {"template": "{$metrics$} [{$metric_unit$}]"}},
            "cum_artist_config": [{"jp_query": "cfg == 'c1' && system == 's1'", "color": "red"}, {"color": "blue"}],
        }],
    }
    return {**options, **changes}


def by_hand(groups, width, padding, group_padding):
    """Positions by walking over the bars one after the other."""
    at, centers, group_centers = 0.0, [], []
    for bars in groups:
        first = last = at
        for _ in range(bars):
            centers.append(at)
            last = at
            at += width + padding
        group_centers.append((first + last) / 2)
        at += group_padding
    return centers, group_centers


def test_bars(measured):
    tables = layout.chart_tables(measured, chart())
    bars = tables["bars"].filter("workload = 'w1'").orderBy("bar_no", "value_no").collect()
    centers, groups = by_hand([2, 2, 1], 0.5, 0.25, 1.0)
    assert [r["system"] for r in bars[::2]] == ["s3", "s3", "s1", "s1", "s2"]
    np.testing.assert_allclose([r["bar_center_pos"] for r in bars[::2]], centers)
    np.testing.assert_allclose([r["bar_left_pos"] for r in bars[::2]], [c - 0.25 for c in centers])
    np.testing.assert_allclose(sorted({r["group_center_pos"] for r in bars}), groups)
    for lower, upper in zip(bars[::2], bars[1::2]):
        assert lower["bar_part_bottom"] == 0.0 and upper["bar_part_bottom"] == lower["value"]
    assert {r["file_name"] for r in bars} == {"workload=w1"}
    assert {r["group_label"] for r in bars} == {"s3", "one", "s2"}
    assert {(r["system"], r["cfg"]) for r in bars if r["artist_color"] == "red"} == {("s1", "c1")}
    assert {r["yaxis_label"] for r in tables["subplots"].collect()} == {"time [sec]"}


def test_grid_and_metric_rules(measured):
    two = {"time": {"value_cols": "base"}, "memory": {"value_cols": "mem", "value_divider": 2.0}}
    with pytest.raises(ValueError, match="several metrics"):
        layout.chart_tables(measured, chart(metrics=two))
    ok = chart(metrics=two, cum_plot_config=[{"subplot_grid": {"rows": ["$metrics$"], "cols": []}}])
    bars = layout.chart_tables(measured, ok)["bars"].collect()
    assert {(r["$metrics$"], r["row_idx"]) for r in bars} == {("memory", 0), ("time", 1)}
    assert {r["value"] for r in bars if r["$metrics$"] == "memory"} == {1.5}
    ragged = chart(cum_plot_config=[{"subplot_grid": {"rows": ["system"], "cols": ["cfg"]}}])
    with pytest.raises(ValueError, match="grid"):
        layout.chart_tables(measured, ragged)
    fixed = chart(cum_plot_config=[{"subplot_grid": {"rows": ["system"], "cols": ["cfg"], "jp_except": "cfg == 'c2'"}}])
    assert layout.chart_tables(measured, fixed)["subplots"].count() == 6
    with pytest.raises(ValueError, match="exactly one row"):
        layout.chart_tables(measured.union(measured), chart())
    with pytest.raises(ValueError, match="cum_subplot_config"):
        layout.chart_tables(measured, chart(cum_subplot_config=[]))


def test_charts_by_subplot(measured):
    entries = [{"jp_query": "workload == 'w1'", "chart": {"bar_foreach": {"cols": ["system", "cfg"]}}},
               {"chart": {"box_foreach": {"cols": ["system"]}}}]
    tables = layout.chart_tables(measured, chart(cum_subplot_config=entries))
    assert {r["workload"] for r in tables["bars"].collect()} == {"w1"}
    assert {r["workload"] for r in tables["boxes"].collect()} == {"w2"}
    errors = chart(metrics={"t": {"value_cols": "base", "error_cols": "over"}}, cum_subplot_config=entries)
    with pytest.raises(ValueError, match="no error columns"):
        layout.chart_tables(measured, errors)


def test_hooks(measured):
    hooks = Hooks(pre_metrics=lambda d: d.filter("system <> 's3'"), post=lambda d: d.withColumn("note", F.lit("x")))
    bars = layout.chart_tables(measured, chart(), hooks)["bars"]
    assert {r["system"] for r in bars.collect()} == {"s1", "s2"} and "note" in bars.columns


def test_box_statistics(spark, chunked):
    rng = np.random.default_rng(3)
    data = {g: np.round(np.concatenate([rng.normal(0, 1, 120), rng.normal(0, 9, 12)]), 3) for g in "ab"}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, value double")
    stats = {r["g"]: r for r in layout.box_statistics(df, ["g"]).collect()}
    outliers = layout.box_outliers(df, ["g"]).collect()
    for g, v in data.items():
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        s = stats[g]
        np.testing.assert_allclose([s["q1"], s["median"], s["q3"]], [q1, med, q3])
        assert s["whisker_low"] == v[v >= low].min() and s["whisker_high"] == v[v <= high].max()
        assert sorted(r["value"] for r in outliers if r["g"] == g) == sorted(v[(v < low) | (v > high)])
        assert s["n_outliers"] == ((v < low) | (v > high)).sum()


def test_stacks_sum_up(spark, chunked):
    df = spark.range(300).selectExpr("id % 2 as bar", "id as part", "if(id % 7 = 0, null, cast(id as double)) as value")
    got = layout.stack_bottoms(df, ["bar"], "part").collect()
    total = {0: 0.0, 1: 0.0}
    for r in sorted(got, key=lambda r: r["part"]):
        assert r["bar_part_bottom"] == total[r["bar"]]
        total[r["bar"]] += r["value"]
    assert len(got) == 300 - 43


def test_ordinals(spark, chunked):
    df = spark.range(400).selectExpr("cast(id % 4 as string) as a", "cast(id div 4 as string) as b")
    out = layout.with_ordinals(df, [Level("x", ["a"], "a == '2'"), Level("y", ["b"]), Level("z")], {"a": ["3", "1", "0", "2"]})
    got = out.collect()
    assert {r["a"]: r["x_idx"] for r in got} == {"3": 0, "1": 1, "0": 2}
    names = sorted({str(i) for i in range(100)})
    assert all(r["y_idx"] == names.index(r["b"]) and r["z_idx"] == 0 for r in got)


def test_rules_and_labels(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "k string, n int")
    rules = [Rule({"color": "red"}, "k == 'A'"), Rule({"color": "blue", "label": {"template": "{k}-{n}"}})]
    out = df.select(*[c.alias(n) for n, c in layout.resolve(rules, df.columns, ["color", "label", "x"], {"A": "Ah"}).items()])
    assert [tuple(r) for r in out.collect()] == [("red", "Ah-1", None), ("blue", "B-2", None)]
    with pytest.raises(KeyError):
        text.label("{nope}", ["k"])
    with pytest.warns(UserWarning, match="not used"):
        layout.allowed_filter(df, ["k"], {"k": ["A"], "other": ["x"]})
    assert df.select(text.joined_name(["k", "n"])).first()[0] == "A_1"
    full = layout.keep_empty(df, "k", ["A", "B", "C"])
    assert full.count() == 3 and full.filter("n is null").first()["k"] == "C"


def short_by_hand(v):
    def shown(x):
        digits = 4 if abs(x) < 0.001 else 3 if abs(x) < 0.01 else 2 if abs(x) < 0.1 else 1
        return f"{x:.{digits}f}".rstrip("0").rstrip(".")

    for limit, unit in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        if abs(v) >= limit:
            return "0.1B" if shown(v / limit) + unit == "100M" else shown(v / limit) + unit
    return shown(v)


def test_short_numbers(spark):
    rng = np.random.default_rng(2)
    values = [0.0, 0.15, 0.25, 0.35, 2.5, 999.95, 1250.0, 1e6, 1e8, 1e9, -2500.0, 0.045, 0.0055, 0.00015, 123456789.0]
    values += [float(x) for x in np.round(rng.random(500) * 10.0 ** rng.integers(-4, 12, 500), 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", text.round_short(F.col("v")).alias("s")).collect():
        assert r["s"] == short_by_hand(r["v"]), r["v"]


def test_axis(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0), ("a", 2.0, 8.0)], "k string, lo double, hi double")
    row = layout.axis_limits(df, ["k"], F.col("lo"), F.col("hi"), maximum={"data_max_scaler": 1.5}, n_ticks=4).first()
    assert (row["axis_min"], row["axis_max"], row["ticks"]) == (0.0, 12.0, [0.0, 4.0, 8.0, 12.0])
    with pytest.raises(ValueError):
        layout.axis_limits(df, ["k"], F.col("lo"), F.col("hi"), {"wrong": 1})
    assert math.isclose(df.select(text.ticks(F.lit(0.0), F.lit(1.0), 1)).first()[0][0], 0.0)


def test_fan_out_keeps_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 1.0D as a", "id * 2.0D as b").write.parquet(str(tmp_path / "t"))
    import contextlib
    import io

    out = layout.fan_out(spark.read.parquet(str(tmp_path / "t")), {"x": Metric("a"), "y": Metric("b")})
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain()
    assert shown.getvalue().count("FileScan") == 1 and out.count() == 20


def test_predicate_spellings(spark):
    df = spark.createDataFrame([("time", "4", "abc"), ("mem", "12", "xbc")], "`$metrics$` string, n string, s string")
    for text, kept in [("\"$metrics$\" == 'time'", 1), ("to_number(n) > `4` || starts_with(s, 'a')", 2),
                       ("(n == '4') && ends_with(s, 'c')", 1), ("not contains(s, 'b')", 0)]:
        assert df.filter(layout.predicate(text)).count() == kept, text
